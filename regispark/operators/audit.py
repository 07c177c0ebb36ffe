"""Audits of what registries show: which documents to look at again, and what was found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regispark.operators.fulltext import Index, match_all

# The phrase of a legal basis, with its point, and the phrase that rules a text out.
BASIS_QUERY = '"Alus: AvTS § 35 lg 1 p {point}" NOT "Struktuurüksus on tunnistatud"'
POINTS = range(1, 20)


def never_audited(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("last_audit_check_at").isNull())


def stale(docs: DataFrame, before: str) -> DataFrame:
    """Last looked at before a time; those never looked at are not stale."""
    return docs.where(F.col("last_audit_check_at") < F.lit(before).cast("timestamp"))


def to_recheck(docs: DataFrame) -> DataFrame:
    """Hidden by their registry when last looked at."""
    return docs.where(F.col("last_audit_check_at").isNotNull() & F.col("last_visibility").isin("AK"))


def candidates(index: Index, points: range = POINTS, query: str = BASIS_QUERY) -> DataFrame:
    """(id, query): documents whose text holds a legal basis for a restriction, one search for each point."""
    return match_all(index, [query.format(point=p) for p in points]).withColumnRenamed("doc_id", "id")


def report(index: Index, docs: DataFrame, orgs: DataFrame, seen: DataFrame) -> DataFrame:
    """(visibility, slug, id, url, query) of the candidates; seen: id, visibility as the registries show it now."""
    o = orgs.select(F.col("id").alias("organisation_id"), "slug")
    rows = candidates(index).join(docs.select("id", "organisation_id", "url"), "id").join(o, "organisation_id", "left").join(seen, "id", "left")
    return rows.select("visibility", "slug", "id", "url", "query")


def apply_results(docs: DataFrame, results: DataFrame) -> DataFrame:
    """Documents with the outcome of an audit; of several results for a document the last counts.

    results: id, failed, visibility, reason, reason_change, checked_at. A failed look leaves the reasons as they
    were and makes the visibility Unknown.
    """
    r = results.groupBy("id").agg(F.max_by(F.struct("failed", "visibility", "reason", "reason_change", "checked_at"), "checked_at").alias("r"))
    own = {c: F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("last_visibility", "last_reason", "last_reason_change")}
    failed, seen = F.col("r.failed"), F.col("r").isNotNull()
    rest = [c for c in docs.columns if c not in (*own, "last_audit_check_at")]
    checked = F.col("last_audit_check_at") if "last_audit_check_at" in docs.columns else F.lit(None).cast("timestamp")
    return docs.join(r, "id", "left").select(
        *rest, F.when(~seen, own["last_visibility"]).when(failed, F.lit("Unknown")).otherwise(F.col("r.visibility")).alias("last_visibility"), F.when(~seen | failed, own["last_reason"]).otherwise(F.col("r.reason")).alias("last_reason"),
        F.when(~seen | failed, own["last_reason_change"]).otherwise(F.col("r.reason_change")).alias("last_reason_change"), F.coalesce(F.col("r.checked_at"), checked).alias("last_audit_check_at"),
    )


def write_report(rows: DataFrame, path: str) -> None:
    """Tab-separated report with a header."""
    rows.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
