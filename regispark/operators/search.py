"""Document search: one builder of lazy plans for pages, totals and details.

A request is validated before any job runs. Filters are plain column predicates that reach the scan; wide text
columns are not part of the sort, they are joined to the page. The order is by registration date, then by original
id compared as text, then rank and id, so that pages are stable.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regispark.functions.text import day_lag
from regispark.operators.fulltext import Index, match

PUBLIC, RESTRICTED = "Avalik", "AK"
HIDDEN = [RESTRICTED, "Unknown"]
PAGE = 100
SORTS = ("registration_date", "created_at", "rank")


class RequestError(ValueError):
    """A request that no plan is made for."""


@dataclass(frozen=True)
class SearchRequest:
    query: str | None = None
    org_ids: tuple[int, ...] = ()
    with_restricted: bool = False
    date_start: str | None = None
    date_end: str | None = None
    min_delta: int = 0
    sort_by: str = "registration_date"
    page: int = 1
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.query is not None and len(self.query) > 500:
            raise RequestError("the query is longer than 500 characters")
        if self.sort_by not in SORTS:
            raise RequestError(f"sort_by must be one of {', '.join(SORTS)}")
        if self.page < 1:
            raise RequestError("pages are counted from 1")
        for d in (self.date_start, self.date_end):
            if d is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", d):
                raise RequestError(f"not a date: {d}")

    @classmethod
    def from_params(cls, params: dict[str, str]) -> SearchRequest:
        """A request from text parameters, as a web form sends them."""
        number = lambda x: int(m[0]) if (m := re.match(r"\s*[+-]?\d+", x or "")) else 0
        return cls(
            query=params.get("query") or None, org_ids=tuple(number(x) for x in (params.get("org_ids") or "").split(",") if x.strip()), with_restricted=params.get("with_restricted") == "1",
            date_start=params.get("date_start") or None, date_end=params.get("date_end") or None, min_delta=number(params.get("min_delta", "")), sort_by=params.get("sort_by") or "registration_date", page=number(params.get("page", "1")) or 1,
        )


def hits(docs: DataFrame, request: SearchRequest, index: Index | None = None) -> DataFrame:
    """All documents that fit a request, unsorted, with rank (null without a text query; lower is better)."""
    out = docs
    if request.org_ids:
        out = out.where(F.col("organisation_id").isin(list(request.org_ids)))
    if not request.with_restricted:
        out = out.where(F.col("restriction") == PUBLIC)
    if request.date_start:
        out = out.where(F.col("registration_date") >= F.lit(request.date_start).cast("date"))
    if request.date_end:
        out = out.where(F.col("registration_date") <= F.lit(request.date_end).cast("date"))
    if request.min_delta:
        out = out.where(day_lag(F.col("created_at"), F.col("registration_date")) >= request.min_delta)
    if request.query:
        if index is None:
            raise RequestError("a text query needs an index")
        return out.join(match(index, request.query), out["id"] == F.col("doc_id")).drop("doc_id")
    return out.withColumn("rank", F.lit(None).cast("double"))


def order(request: SearchRequest) -> list:
    first = {
        "registration_date": [F.col("registration_date").desc_nulls_last(), F.col("original_id").desc_nulls_last()], "created_at": [F.col("created_at").desc_nulls_last()], "rank": [],
    }[request.sort_by]
    return [*first, F.col("rank").asc_nulls_first(), F.col("id").asc()]


def page(found: DataFrame, request: SearchRequest) -> DataFrame:
    """One page of hits: a top-k, never a full sort."""
    return found.orderBy(*order(request)).offset((request.page - 1) * PAGE).limit(PAGE)


def page_numbers(total: int, request: SearchRequest) -> dict[str, int]:
    return {"total": total, "per_page": PAGE, "current_page": request.page, "last_page": max(1, math.ceil(total / PAGE))}


def list_items(rows: DataFrame, orgs: DataFrame) -> DataFrame:
    """The fields of a list item, the organisation nested."""
    o = orgs.select(F.col("id").alias("organisation_id"), F.struct(F.col("id").alias("id"), "name", "slug").alias("organisation"))
    return rows.join(o, "organisation_id", "left").select(
        "id", "title", "reference", F.date_format("registration_date", "yyyy-MM-dd").alias("registration_date"), "doc_type", "doc_function", "series", "dossier", "restriction", "to_party", "delivery_method", "responsible", "url", "original_id", "created_at", "organisation",
    )


def json_page(items: DataFrame) -> DataFrame:
    """One JSON text for each list item."""
    return items.select("id", F.to_json(F.struct(*[F.col(c) for c in items.columns])).alias("json"))


@dataclass(frozen=True)
class Found:
    """The answer to a point lookup: status 200 with the row, 404 if there is none, 451 if its registry hides it."""

    status: int
    row: dict | None = None


def point_lookup(docs: DataFrame, orgs: DataFrame, files: DataFrame, doc_id: int, admin: bool = False, base_url: str = "") -> Found:
    """One document with its files; the id reaches the scans of documents and files."""
    own = docs.where(F.col("id") == doc_id)
    head = own.select("last_visibility").first()
    if head is None:
        return Found(404)
    if head["last_visibility"] in HIDDEN and not admin:
        return Found(451)
    return Found(200, details(own, orgs, files.where(F.col("document_id") == doc_id), base_url).first().asDict(recursive=True))


def nothing(docs: DataFrame) -> DataFrame:
    """The empty answer to a text query that does not parse, with the columns of `hits`."""
    return docs.where("false").withColumn("rank", F.lit(None).cast("double"))


def visible(docs: DataFrame) -> DataFrame:
    """Documents that may be shown; one never audited is visible."""
    return docs.where(~F.coalesce(F.col("last_visibility").isin(HIDDEN), F.lit(False)))


def details(docs: DataFrame, orgs: DataFrame, files: DataFrame, base_url: str = "") -> DataFrame:
    """List items with their files nested, by file id. Files are collected for each document alone."""
    nested = files.where("document_id is not null").groupBy(F.col("document_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("id", "name", "parent_id", "parsed_with", F.concat(F.lit(base_url), "storage_path").alias("url"), "contents"))).alias("files")
    )
    return list_items(docs, orgs).join(nested, "id", "left").withColumn("files", F.coalesce("files", F.array()))
