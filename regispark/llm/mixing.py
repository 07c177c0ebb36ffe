"""Mixing sources to target weights (problem 9): weighted fair queueing.

Every source shuffles its documents (by a hash of id and copy) and each document copy gets the virtual time at
which it would have been sent: the source's tokens up to and with it, divided by the source's weight. At any
virtual time each source has sent its share of all tokens, so the mixture of a budget is what has finished by
then, range-sorted by finish time. A source too small for its share is repeated, up to its `max_repeats`.

The running sums are made in two steps, over parts of the hash range and inside a part, so that a source with a
third of all rows is spread like any other. Only sums by source reach the driver: one row for each target.

The total budget fixes the virtual time at which the mixture is cut. `full_budget` is the largest at which every source
with documents still has its share; it is the default. Under a larger one a source that has sent all its copies leaves the
queue and the others share what it leaves, as fair queueing does; so do, always, the shares of sources without
documents. `shares` tells what was reached.

Defined results for odd input: null and empty texts hold no tokens and are not taken; sources are compared without
case and blanks around them, documents without a source or of a source without target are not taken; targets
that are null, not above zero or repeat a source (the first in order of share, largest first, counts) are ignored;
ties in finish time go by source, copy and id; repeated rows are documents of their own; other columns
are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regispark.llm.tokens import TOKENIZER, token_count
from regispark.session import cut_lineage, read_table

#: Documents that one part of a source's hash range holds on average.
PART_ROWS = 50_000
BINS = 16_384
MIXTURE = "id {kind}, source string, copy int, tokens bigint, finish double"


def _source(col: str):
    return F.lower(F.trim(F.col(col)))


def targets_of(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """source -> (share, most copies); the table is a list of targets, one row each."""
    out: dict[str, tuple[float, int]] = {}
    for r in targets.select(_source("source").alias("s"), "target_share", "max_repeats").where("s is not null and target_share > 0").orderBy(F.desc("target_share"), "s").collect():
        out.setdefault(r["s"], (r["target_share"], max(1, r["max_repeats"] or 1)))
    return out


def full_budget(held: dict[str, int], most: dict[str, int], weight: dict[str, float]) -> int:
    """The most tokens of which every source can give its share. held: tokens of each source, most: copies it may give."""
    return math.floor(min(held[s] * most[s] / weight[s] for s in held) * sum(weight.values()))


def cut_time(held: dict[str, int], most: dict[str, int], weight: dict[str, float], budget: int) -> float:
    """Virtual time at which `budget` tokens have been sent, or all there are."""
    dry = sorted((held[s] * most[s] / weight[s], s) for s in held)
    sent, flowing = 0.0, sum(weight.values())
    for t, s in dry:
        if sent + flowing * t >= budget:
            return (budget - sent) / flowing
        sent, flowing = sent + held[s] * most[s], flowing - weight[s]
    return dry[-1][0]


def mix(docs: DataFrame, id_col: str, source_col: str, tokens_col: str, targets: dict[str, tuple[float, int]], budget: int | None = None) -> DataFrame:
    """(id, source, copy, tokens, finish): the mixture of at most `budget` tokens, in order of virtual finish time."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), _source(source_col).alias("source"), F.col(tokens_col).cast("long").alias("tokens")).where("tokens > 0 and id is not null").where(F.col("source").isin(list(targets)))
    held = {r["source"]: (r["t"], r["n"]) for r in rows.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    present = {s: w for s, w in targets.items() if s in held}
    if not present:
        return spark.createDataFrame([], MIXTURE.format(kind=kind))
    whole = sum(w for w, _ in present.values())
    weight = {s: w / whole for s, (w, _) in present.items()}
    tokens, most = {s: held[s][0] for s in present}, {s: m for s, (_, m) in present.items()}
    until = cut_time(tokens, most, weight, full_budget(tokens, most, weight) if budget is None else budget)
    # Documents finish late by half their size on average, so the order is looked at some way past the cut.
    beyond = until * 1.5 + max(1.0, until * 0.01)
    copies = {s: min(present[s][1], max(1, math.ceil(beyond * weight[s] / held[s][0]))) for s in present}
    lookup = lambda d, cast: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v).cast(cast))])[F.col("source")]
    parts = max(16, math.ceil(max(n for _, n in held.values()) / PART_ROWS))
    taken = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), lookup(copies, "int")))).withColumn("h", F.xxhash64("id", "copy", F.lit("mix")))
    taken = taken.withColumn("part", F.floor((F.col("h").cast("double") / 2.0**63 + 1.0) / 2.0 * parts).cast("int"))
    sums = taken.groupBy("source", "copy", "part").agg(F.sum("tokens").alias("t"))
    over = Window.partitionBy("source").orderBy("copy", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("source", "copy", "part", F.coalesce(F.sum("t").over(over), F.lit(0)).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("source", "copy", "part").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))
    timed = taken.withColumn("inside", inside).join(before, ["source", "copy", "part"]).withColumn("finish", (F.col("before") + F.col("inside")) / lookup(weight, "double"))
    timed = cut_lineage(timed.where(F.col("finish") <= beyond).select("id", "source", "copy", "tokens", "finish"))
    # The total budget truncates the order; where, a histogram over BINS parts of the time tells.
    want = sum(weight.values()) * until if budget is None else budget
    sent, cut = 0, 0.0
    for r in sorted(timed.groupBy(F.floor(F.col("finish") / beyond * BINS).alias("bin")).agg(F.sum("tokens").alias("t"), F.max("finish").alias("last")).collect(), key=lambda r: r["bin"]):
        if sent + r["t"] > want:
            break
        sent, cut = sent + r["t"], r["last"]
    return timed.where(F.col("finish") <= cut).orderBy("finish", "source", "copy", "id")


def shares(mixture: DataFrame, targets: dict[str, tuple[float, int]]) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_rows, most_copies) of every target, also of those without documents."""
    spark = mixture.sparkSession
    want = spark.createDataFrame([(s, w, m) for s, (w, m) in targets.items()], "source string, target_share double, max_repeats int")
    got = mixture.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.max("copy").alias("c"))
    total = got.agg(F.sum("t").alias("total"))
    both = want.join(got, "source", "left").crossJoin(F.broadcast(total))
    return both.select(
        "source", "target_share", F.coalesce(F.col("t") / F.col("total"), F.lit(0.0)).alias("actual_share"), F.coalesce("t", F.lit(0)).alias("n_tokens"), F.coalesce("n", F.lit(0)).alias("n_rows"),
        F.coalesce("c", F.lit(0)).alias("most_copies"), "max_repeats",
    )


def _sized(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> tuple[DataFrame, dict[str, tuple[float, int]]]:
    docs = read_table(spark, folder, "documents")
    targets = targets_of(read_table(spark, folder, "mix_targets"))
    wanted = docs.where(_source("source").isin(list(targets)))
    return cut_lineage(wanted.select("doc_id", "source", token_count(docs, "text", tokenizer).alias("n"))), targets


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The largest mixture with every share, one row for each document copy, in order."""
    sized, targets = _sized(spark, folder)
    return mix(sized, "doc_id", "source", "n", targets).withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source."""
    sized, targets = _sized(spark, folder)
    return shares(mix(sized, "doc_id", "source", "n", targets), targets)


def p9_shares_of_half(spark: SparkSession, folder: str) -> DataFrame:
    """The same for a budget of half the tokens the sources hold, at which small sources run dry."""
    sized, targets = _sized(spark, folder)
    budget = (sized.agg(F.sum("n")).first()[0] or 0) // 2
    return shares(mix(sized, "doc_id", "source", "n", targets, budget), targets)


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_shares_of_half": p9_shares_of_half}
