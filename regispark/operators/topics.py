"""Topics: documents linked by relations are one topic, named by its smallest document id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regispark.operators.components import connected_components


def relation_edges(relations: DataFrame, docs: DataFrame) -> DataFrame:
    """(src, dst) by document id. relations: id, related_original_id, organisation_id; only documents of the same organisation are meant."""
    target = docs.select(F.col("id").alias("dst"), F.col("original_id").alias("related_original_id"), "organisation_id").where("related_original_id is not null")
    return relations.select(F.col("id").alias("src"), "related_original_id", "organisation_id").join(target, ["related_original_id", "organisation_id"]).where("src <> dst").select("src", "dst")


def topics(edges: DataFrame) -> DataFrame:
    """(id, topic_id)"""
    return connected_components(edges).select(F.col("node").alias("id"), F.col("component").alias("topic_id"))


def siblings(docs: DataFrame, topic_ids: DataFrame, doc_id: int) -> DataFrame:
    """The other documents of a document's topic, newest first."""
    own = topic_ids.where(F.col("id") == doc_id).select("topic_id")
    others = topic_ids.join(F.broadcast(own), "topic_id").where(F.col("id") != doc_id).select("id")
    return docs.join(others, "id", "left_semi").orderBy(F.col("registration_date").desc_nulls_last(), F.col("original_id").desc_nulls_last(), "id")
