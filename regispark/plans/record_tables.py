"""Queries over the registry's JSON answers (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regispark.operators.shredding import ROOT, infer_schema_graph, plan_inlining, shred, valid_records
from regispark.session import read_table

FILE = "failid"
WHOLE_NUMBER = r"^\s*-?\d{1,18}(\.0+)?\s*$"


def _number(col: str):
    """A JSON id as bigint, written as number or text; null where it is neither."""
    return F.when(F.col(col).rlike(WHOLE_NUMBER), F.col(col).cast("decimal(38,6)").cast("bigint"))


def _records(spark: SparkSession, folder: str):
    df = read_table(spark, folder, "rmk_records")
    return df, plan_inlining(infer_schema_graph(df, "payload"), own_tables=["doc_proceeder", FILE])


def file_objects(df: DataFrame, plan) -> DataFrame:
    """Each file object with its fetch and the file object that holds it (0: the record itself)."""
    if FILE not in plan.tables:
        return df.sparkSession.createDataFrame([], "fetch_id bigint, parent_file_id bigint, file_id bigint")
    rows = shred(df, "payload", plan, FILE, keys=["fetch_id"], natural_key="id")
    rows = rows if "id" in rows.columns else rows.withColumn("id", F.lit(None).cast("string"))
    return rows.select("fetch_id", F.coalesce(_number("_held_by"), F.lit(0).cast("bigint")).alias("parent_file_id"), _number("id").alias("file_id"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    df, plan = _records(spark, folder)
    return file_objects(df, plan).where("file_id is not null").distinct()


def p1_records(spark: SparkSession, folder: str) -> DataFrame:
    """The table of records, singleton descendants inlined."""
    df, plan = _records(spark, folder)
    return shred(df, "payload", plan, ROOT, keys=["fetch_id"])


def p1_proceeders(spark: SparkSession, folder: str) -> DataFrame:
    """The table of proceeders, each with the record that holds it."""
    df, plan = _records(spark, folder)
    if "doc_proceeder" not in plan.tables:
        return spark.createDataFrame([], "fetch_id bigint, _key string, _parent_table string, _parent_key string, _held_by string")
    return shred(df, "payload", plan, "doc_proceeder", keys=["fetch_id"])


def p1_files(spark: SparkSession, folder: str) -> DataFrame:
    """The table of file objects with all their fields, also of those without id, each with what holds it."""
    df, plan = _records(spark, folder)
    if FILE not in plan.tables:
        return spark.createDataFrame([], "fetch_id bigint, _key string, _parent_table string, _parent_key string, _held_by string")
    return shred(df, "payload", plan, FILE, keys=["fetch_id"], natural_key="id")


def p1_validity(spark: SparkSession, folder: str) -> DataFrame:
    """How many payloads parse, by HTTP status."""
    df = valid_records(read_table(spark, folder, "rmk_records"), "payload")
    return df.groupBy("http_status", "is_valid").agg(F.count("*").alias("n"))


QUERIES = {"p1_found": p1_found, "p1_records": p1_records, "p1_proceeders": p1_proceeders, "p1_files": p1_files, "p1_validity": p1_validity}

ORACLES = {
    "p1_validity": """
        SELECT http_status, CASE WHEN payload IS NULL THEN NULL ELSE json_valid(payload) END AS is_valid, count(*) AS n
        FROM rmk_records GROUP BY ALL""",
    # Containers are decoded and flattened level by level; "#" marks a list written as an object.
    "p1_found": """
        WITH RECURSIVE
        txt AS (SELECT fetch_id, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'VARCHAR' THEN payload::JSON ->> '$' ELSE payload END END AS p FROM rmk_records),
        top AS (SELECT fetch_id, CASE WHEN json_valid(p) AND json_type(p) = 'OBJECT' THEN p::JSON -> 'data' END AS d FROM txt),
        dec AS (SELECT fetch_id, CASE WHEN json_type(d) = 'VARCHAR' THEN CASE WHEN json_valid(d ->> '$') THEN (d ->> '$')::JSON END ELSE d END AS d FROM top),
        dat AS (SELECT fetch_id, d FROM dec WHERE json_type(d) = 'OBJECT'
                UNION ALL SELECT fetch_id, unnest(d::JSON[]) FROM dec WHERE json_type(d) = 'ARRAY'),
        walk(fetch_id, parent, box) AS (
            SELECT fetch_id, 0::BIGINT, d -> 'failid' FROM dat WHERE json_type(d) = 'OBJECT'
            UNION ALL
            SELECT fetch_id, CASE WHEN json_type(o) = 'OBJECT' THEN coalesce(TRY_CAST(o ->> 'id' AS BIGINT), parent) ELSE parent END, o -> 'failid'
            FROM (
                SELECT fetch_id, parent, unnest(CASE json_type(b) WHEN 'ARRAY' THEN b::JSON[]
                    WHEN 'OBJECT' THEN CASE WHEN json_keys(b)[1] ~ '^[0-9]+$' THEN map_values(b::MAP(VARCHAR, JSON)) ELSE [b] END ELSE []::JSON[] END) AS o
                FROM (SELECT fetch_id, parent, CASE WHEN json_type(box) = 'VARCHAR' THEN CASE WHEN json_valid(box ->> '$') THEN (box ->> '$')::JSON END ELSE box END AS b FROM walk WHERE box IS NOT NULL)
            ) WHERE json_type(o) = 'OBJECT'
        ),
        objs AS (
            SELECT fetch_id, parent, unnest(CASE json_type(b) WHEN 'ARRAY' THEN b::JSON[]
                WHEN 'OBJECT' THEN CASE WHEN json_keys(b)[1] ~ '^[0-9]+$' THEN map_values(b::MAP(VARCHAR, JSON)) ELSE [b] END ELSE []::JSON[] END) AS o
            FROM (SELECT fetch_id, parent, CASE WHEN json_type(box) = 'VARCHAR' THEN CASE WHEN json_valid(box ->> '$') THEN (box ->> '$')::JSON END ELSE box END AS b FROM walk WHERE box IS NOT NULL)
        )
        SELECT DISTINCT fetch_id, parent AS parent_file_id, TRY_CAST(o ->> 'id' AS BIGINT) AS file_id
        FROM objs WHERE json_type(o) = 'OBJECT' AND TRY_CAST(o ->> 'id' AS BIGINT) IS NOT NULL""",
}
