"""Keeping tables up to date: insert-only and upsert by key, child tables, watermarks, resume positions.

Plain Parquet has no MERGE: a changed table is an anti-join and a union, to be written beside the old one; where the
table format supports it, `merge_into` uses MERGE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regispark.functions.text import bases


def last_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the last in order; rows with a null key stay, and in no window."""
    top = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    last = rows.where(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(top)).where("__r = 1").drop("__r")
    return last.unionByName(rows.where(F.col(key).isNull()))


def new_only(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet."""
    return incoming.join(stored.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*incoming.columns)


def upserted(stored: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Stored rows with incoming ones in place of those of equal key; of several incoming the last counts."""
    fresh = last_by(incoming, key, order)
    kept = stored.join(fresh.select(key).where(F.col(key).isNotNull()), key, "left_anti").select(*stored.columns)
    return kept.unionByName(fresh, allowMissingColumns=True)


def merge_into(incoming: DataFrame, table: str, key: str) -> None:
    """MERGE on a table format that has it; `incoming` holds each key once, as `last_by` gives it."""
    on = F.col(f"{table}.{key}") == F.col(f"source.{key}")
    incoming.alias("source").mergeInto(table, on).whenMatched().updateAll().whenNotMatched().insertAll().merge()


def with_children(stored: DataFrame, incoming: DataFrame, children: DataFrame, key: str = "url") -> DataFrame:
    """Child rows (files, bases) of an upsert: those of documents that came again are replaced, the others stay.

    stored, children: key and the children's columns; incoming: key.
    """
    again = incoming.select(key).where(F.col(key).isNotNull()).distinct()
    return stored.join(again, key, "left_anti").select(*stored.columns).unionByName(children.join(again, key, "left_semi").select(*stored.columns))


def base_rows(docs: DataFrame, text_col: str, id_col: str = "id") -> DataFrame:
    """(document_id, basis) of a comma list of legal bases."""
    return docs.select(F.col(id_col).alias("document_id"), F.explode(bases(F.col(text_col))).alias("basis"))


def resume_ids(docs: DataFrame, default: int = 1) -> DataFrame:
    """(organisation_id, numeric_max, text_max): where an enumeration goes on. Ids are text; the greatest number is
    meant, the greatest text is kept to show the difference."""
    number = F.when(F.col("original_id").rlike(r"^\d{1,18}$"), F.col("original_id").cast("bigint"))
    return docs.groupBy("organisation_id").agg(F.coalesce(F.max(number), F.lit(default).cast("bigint")).alias("numeric_max"), F.max("original_id").alias("text_max"))


def stamped(orgs: DataFrame, fetched: DataFrame) -> DataFrame:
    """Organisations with last_fetched_at moved on; fetched: id, fetched_at."""
    at = fetched.groupBy("id").agg(F.max("fetched_at").alias("__at"))
    return orgs.join(at, "id", "left").withColumn("last_fetched_at", F.coalesce(F.col("__at").cast(dict(orgs.dtypes)["last_fetched_at"]), "last_fetched_at")).select(*orgs.columns)
