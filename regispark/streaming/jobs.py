"""Streaming-like work: poll windows, cut-offs of enumerations, rate limits, index maintenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regispark.operators.fulltext import Index, refreshed


def poll_dates(orgs: DataFrame, last: str, days: int = 7) -> DataFrame:
    """(organisation_id, listed_on): the days to list for each organisation, newest first."""
    day = F.lit(last).cast("date")
    return orgs.select(F.col("id").alias("organisation_id"), F.explode(F.sequence(day, F.date_sub(day, days - 1), F.expr("interval -1 day"))).alias("listed_on"))


def before_cutoff(probes: DataFrame, by: str, order: str, missed: str, most: int) -> DataFrame:
    """Probes up to the end of the first run of `most` misses in a row, in each group; null groups are one group.

    The groups are enumerations of one source each and may hold most rows, so they are cut into ranges of `order`: each range
    tells how many misses it begins and ends with and where a run inside it is complete, and only these few rows are
    put in sequence. `order` is a whole number, each once in a group.
    """
    rows = probes.select(F.col(by).alias("g"), F.col(order).cast("bigint").alias("o"), F.coalesce(F.col(missed), F.lit(False)).alias("m")).where("o is not null")

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row for each stretch of a group: first order, misses at the beginning with the place of the first `most` of
        them, whether it is misses only, misses at the end, and where the first run after a hit is complete."""
        out: list[list] = []
        now: list | None = None
        for b in batches:
            for g, o, m in zip(b["g"], b["o"], b["m"]):
                if now is None or (g != now[0] and not (pd.isna(g) and pd.isna(now[0]))):
                    now = [g, o, [], True, 0, None]
                    out.append(now)
                if m:
                    now[4] += 1
                    if now[3] and len(now[2]) < most:
                        now[2].append(o)
                    if not now[3] and now[5] is None and now[4] == most:
                        now[5] = o
                else:
                    now[3], now[4] = False, 0
        yield pd.DataFrame(out, columns=["g", "first", "lead", "only", "tail", "inside"], dtype=object)

    kind = rows.schema["g"].dataType.simpleString()
    parts = rows.repartitionByRange("g", "o").sortWithinPartitions("g", "o").mapInPandas(ranges, f"g {kind}, first bigint, lead array<bigint>, only boolean, tail bigint, inside bigint")
    run = Window.partitionBy("g").orderBy("first")
    # Misses that reach into a range: those at the end of the last range that is not misses only, and all since.
    parts = parts.withColumn("block", F.sum(F.when(F.col("only"), 0).otherwise(1)).over(run.rowsBetween(Window.unboundedPreceding, -1)))
    parts = parts.withColumn("block", F.coalesce("block", F.lit(0)))
    before = F.coalesce(F.sum("tail").over(Window.partitionBy("g", "block").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = Window.partitionBy("g").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    hit_tail = F.coalesce(F.last(F.when(~F.col("only"), F.col("tail")), ignorenulls=True).over(last), F.lit(0))
    parts = parts.withColumn("carried", before + hit_tail)
    need = F.greatest(F.lit(most) - F.col("carried"), F.lit(1)).cast("int")
    cuts = parts.select("g", F.coalesce(F.when(F.size("lead") >= need, F.try_element_at("lead", need)), F.col("inside")).alias("cut")).where("cut is not null").groupBy(F.col("g").alias("__g")).agg(F.min("cut").alias("__cut"))
    return probes.join(cuts, probes[by].eqNullSafe(cuts["__g"]), "left").where(F.col("__cut").isNull() | (F.col(order) <= F.col("__cut"))).select(*probes.columns)


def capped_listing(rows: DataFrame, most: int = 100) -> DataFrame:
    """At most `most` documents of each organisation, day and restriction class, as the listing pages give them."""
    w = Window.partitionBy("organisation_id", "registration_date", "restriction").orderBy("id")
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def rate_windows(hits: DataFrame, key: str, ts: str, seconds: int = 10, most: int = 10) -> DataFrame:
    """(key, window_start, n, limited): tumbling windows; works on streams with a watermark as on tables."""
    rows = hits.groupBy(F.col(key), F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return rows.select(F.col(key), F.col("w.start").alias("window_start"), "n", (F.col("n") > most).alias("limited"))


def first_hit_limits(hits: DataFrame, key: str, ts: str, seconds: int = 10, most: int = 10) -> DataFrame:
    """(key, ts, allowed): windows that begin with a key's first hit after the last one ended.

    State runs along the hits of one key in order of time, in Arrow batches of a sorted partition, so that a key is
    never held as a whole.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, n = None, 0, 0
        for b in batches:
            allowed = []
            for k, t in zip(b["k"], b["t"]):
                if k != now or t >= start + seconds * 1_000_000:
                    now, start, n = k, t, 0
                n += 1
                allowed.append(n <= most)
            yield b.assign(allowed=allowed)

    kind = hits.schema[key].dataType.simpleString()
    rows = hits.select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).where("k is not null and t is not null")
    return rows.repartition("k").sortWithinPartitions("k", "t").mapInPandas(judge, f"k {kind}, t bigint, allowed boolean")


def keep_index(read: Callable[[], Index], write: Callable[[Index, int], None], columns: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that refreshes the index for each batch of changed documents.

    `write` gets the batch number, so that a batch replayed after a failure writes the same version again.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        top = Window.partitionBy("id").orderBy(F.col("updated_at").desc_nulls_last())
        write(refreshed(read(), batch.withColumn("__r", F.row_number().over(top)).where("__r = 1").drop("__r"), columns), epoch)

    return apply
