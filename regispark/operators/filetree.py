"""The file tree of documents: depth, descendants, derived texts, deletion and replacement.

The tree is walked level by level with equi-joins on parent_id; a level is checkpointed, so the plan does not grow
with the depth. Files that hang below a missing or cyclic parent are reached from no root and keep no depth.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from regispark.session import cut_lineage


def depths(files: DataFrame) -> DataFrame:
    """(id, root_id, depth) of every file reached from a root."""
    edges = cut_lineage(files.select("id", "parent_id"))
    level = edges.where("parent_id is null").select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"))
    out, d = level, 0
    while True:
        d += 1
        level = cut_lineage(edges.join(level.select(F.col("id").alias("parent_id"), "root_id"), "parent_id").select("id", "root_id", F.lit(d).alias("depth")))
        if not level.limit(1).count():
            return out
        out = out.unionByName(level)


def descendants(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(id) of the files given and of all below them; a cycle ends where it meets itself."""
    edges = cut_lineage(files.select("id", "parent_id"))
    seen = level = cut_lineage(roots.select("id").distinct())
    while True:
        level = cut_lineage(edges.join(level.select(F.col("id").alias("parent_id")), "parent_id").select("id").distinct().join(seen, "id", "left_anti"))
        if not level.limit(1).count():
            return seen
        seen = cut_lineage(seen.unionByName(level))


def without(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files after a recursive deletion."""
    return files.join(descendants(files, roots), "id", "left_anti").select(*files.columns)


def replaced(files: DataFrame, file_id: int, parsed: DataFrame) -> DataFrame:
    """Files after one of them (with all below it) gave way to newly parsed ones.

    parsed has the columns of files; its roots (parent_id null) take the old file's parent and document.
    """
    old = files.where(F.col("id") == file_id).select(F.col("parent_id").alias("old_parent"), F.col("document_id").alias("old_document"))
    rest = without(files, files.where(F.col("id") == file_id))
    new = parsed.join(F.broadcast(old), F.lit(True), "left").withColumn("parent_id", F.coalesce("parent_id", "old_parent")).withColumn("document_id", F.coalesce("document_id", "old_document"))
    return rest.unionByName(new.select(*files.columns))


def document_of(files: DataFrame) -> DataFrame:
    """Files with the document their root belongs to where they name none themselves."""
    tree = depths(files)
    roots = files.where("parent_id is null").select(F.col("id").alias("root_id"), F.col("document_id").alias("root_document"))
    owned = tree.join(roots, "root_id").select("id", "root_document")
    return files.join(owned, "id", "left").withColumn("document_id", F.coalesce("document_id", "root_document")).select(*files.columns)


def file_contents(files: DataFrame) -> DataFrame:
    """(document_id, file_contents): names and texts of a document's files by id; a file without text gives nothing, not even its name."""
    part = F.struct("id", F.concat("name", F.lit(" "), "contents").alias("text"))
    rows = files.where("document_id is not null").groupBy("document_id").agg(F.sort_array(F.collect_list(F.when(F.col("name").isNotNull() & F.col("contents").isNotNull(), part))).alias("p"))
    return rows.select("document_id", F.when(F.size("p") > 0, F.array_join(F.transform("p", lambda x: x["text"]), "  ")).alias("file_contents"))


def summary_text(files: DataFrame) -> DataFrame:
    """(document_id, text): texts of the first file of each name, by id, tags off."""
    first = Window.partitionBy("document_id", "name").orderBy("id")
    rows = files.where("document_id is not null").withColumn("r", F.row_number().over(first)).where("r = 1 and contents is not null")
    text = F.struct("id", F.regexp_replace("contents", "<[^>]*>", "").alias("t"))
    return rows.groupBy("document_id").agg(F.sort_array(F.collect_list(text)).alias("p")).select("document_id", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n\n\n").alias("text"))


def rows_without(rows: DataFrame, files: DataFrame, roots: DataFrame, file_col: str = "file_id") -> DataFrame:
    """Rows that belong to files (signatures, stored blobs) after a recursive deletion of these."""
    gone = descendants(files, roots).withColumnRenamed("id", file_col)
    return rows.join(gone, file_col, "left_anti").select(*rows.columns)


def with_signatures(files: DataFrame, signatures: DataFrame, bases: DataFrame) -> DataFrame:
    """Files with their signatures and the legal bases of their document, as lists; empty where there are none."""
    signed = signatures.groupBy(F.col("file_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("name", "pno", "signing_time"))).alias("signatures"))
    based = bases.where("basis is not null").groupBy("document_id").agg(F.sort_array(F.collect_set("basis")).alias("bases"))
    out = files.join(signed, "id", "left").join(based, "document_id", "left")
    return out.select(*files.columns, F.coalesce("signatures", F.array()).alias("signatures"), F.coalesce("bases", F.array()).alias("bases"))


def summarised(texts: DataFrame, docs: DataFrame, summarise: Callable[[list[str]], list[tuple[str, str]]]) -> DataFrame:
    """(document_id, ai_title, ai_summary) of the documents that may be summarised. `summarise` takes a batch of texts and
    gives (title, summary) for each; it runs in the executors and is all that calls a model."""
    fit = texts.join(may_summarise(texts, docs), "document_id", "left_semi")

    def ask(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = summarise(list(b["text"]))
            yield pd.DataFrame({"document_id": b["document_id"], "ai_title": [t for t, _ in got], "ai_summary": [s for _, s in got]})

    return fit.select("document_id", "text").mapInPandas(ask, "document_id bigint, ai_title string, ai_summary string")


def may_summarise(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """(document_id): texts of more than 100 bytes and at most 16000 characters, of documents not summarised before."""
    done = F.lit(False)
    for c in ("ai_summary", "ai_title"):
        if c in docs.columns:
            done = done | (F.coalesce(F.col(c), F.lit("")) != "")
    open_docs = docs.where(~done).select(F.col("id").alias("document_id"))
    return texts.where((F.octet_length("text") > 100) & (F.char_length("text") <= 16000)).join(open_docs, "document_id", "left_semi").select("document_id")
