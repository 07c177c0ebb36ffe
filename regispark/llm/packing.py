"""Filling fixed-capacity containers (problem 8): bin completion over the histogram of sizes.

Sizes are whole numbers up to the capacity, so texts of one size are interchangeable and the problem has no more
unknowns than the capacity has units, however many texts there are. The histogram (at most `capacity` rows, the
only thing the driver receives) is packed by bin completion: around the largest size left, a branch-and-bound
search looks for the undominated filling with the least waste, largest items first. Best fit gives the first incumbent,
branches whose smaller items could not beat the incumbent are cut, dominated fillings are passed over, and a perfect fit ends
the search. The filling found is applied to as many containers as the counts allow at once; `least_containers` bounds
what any packing could do. `most` limits the branches of one filling (None: search to the end). Texts are then numbered inside their size, in salted
parts so that no task gets a whole hot size, and looked up in the plan.

A text larger than the capacity is cut into full containers and a rest, which is packed like any other item.

Defined results for odd input: null and empty texts need no room and are in no container; a capacity that is null or
below one gives no rows; ties between texts of one size are broken by a hash of the id, then by the id; repeated
rows are packed as often as they occur; texts are sized whole; columns other than those named are not looked at;
an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regispark.llm.tokens import TOKENIZER, token_count
from regispark.session import cut_lineage, parallelism, read_table

#: Branches the search may visit for one filling before it takes its incumbent; None searches to the end.
MOST_BRANCHES = 4000


def best_fit(room: int, sizes: list[int], left: dict[int, int]) -> list[tuple[int, int]]:
    """The first incumbent: largest items first, as many as fit."""
    out = []
    at = bisect_right(sizes, room) - 1
    while at >= 0:
        s = sizes[at]
        if k := min(left[s], room // s):
            out.append((s, k))
            room -= k * s
        at = min(at, bisect_right(sizes, room)) - 1
    return out


def undominated(filling: list[tuple[int, int]], waste: int, sizes: list[int], left: dict[int, int]) -> list[tuple[int, int]]:
    """A filling in which no item could give way to a larger one that is left. One that could is dominated: it
    wastes more room and leaves the smaller item, which fits wherever the larger would."""
    have = dict(filling)
    for s in sorted(have):
        while waste and have.get(s):
            at = bisect_right(sizes, s + waste) - 1
            while sizes[at] > s and left[sizes[at]] <= have.get(sizes[at], 0):
                at -= 1
            if at < 0 or sizes[at] <= s:
                break
            have[s] -= 1
            have[sizes[at]] = have.get(sizes[at], 0) + 1
            waste -= sizes[at] - s
    return sorted(((s, k) for s, k in have.items() if k), reverse=True)


def best_completion(room: int, sizes: list[int], left: dict[int, int], most: int | None = MOST_BRANCHES) -> list[int]:
    """Items (largest first) that fill `room` with the least waste. sizes: ascending, those with left[size] > 0.

    A branch takes a number of items of one size and goes on with smaller ones. It is cut if all that is left of
    smaller items could not beat the incumbent. If the search ends early, its incumbent is made undominated. It keeps its own stack.
    """
    best = best_fit(room, sizes, left)
    best_sum = sum(s * k for s, k in best)
    # What all items up to a place hold together.
    upto, total = [], 0
    for s in sizes:
        total += s * left[s]
        upto.append(total)
    branches = 0
    chosen: list[tuple[int, int]] = []
    stack: list[list[int]] = [[room, bisect_right(sizes, room) - 1, 0]]  # room left, place of the next size, items of it to try (0: begin)
    while stack and best_sum < room:
        frame = stack[-1]
        space, at, k = frame
        if at < 0 or room - space + min(space, upto[at]) <= best_sum:
            stack.pop()
            if stack:
                chosen.pop()
            continue
        s = sizes[at]
        k = min(left[s], space // s) if k == 0 else k - 1
        if k == 0:
            frame[1:] = [at - 1, 0]
            continue
        frame[2] = k if k > 1 else 0
        if k == 1:
            frame[1] = at - 1
        branches += 1
        if most is not None and branches > most:
            break
        chosen.append((s, k))
        rest = space - k * s
        if room - rest > best_sum:
            best, best_sum = list(chosen), room - rest
        stack.append([rest, min(at - 1, bisect_right(sizes, rest) - 1), 0])
    return [s for s, k in undominated(best, room - best_sum, sizes, left) for _ in range(k)]


def least_containers(histogram: dict[int, int], capacity: int) -> int:
    """A number of containers that no packing goes below: by total size, and by items too large to lie together
    (the bound of Martello and Toth)."""
    items = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
    total = sum(s * n for s, n in items.items())
    best = -(-total // capacity)
    for k in {s for s in items if 2 * s <= capacity} | {0}:
        alone = sum(n for s, n in items.items() if s > capacity - k)
        large = sum(n for s, n in items.items() if 2 * s > capacity and s <= capacity - k)
        large_sum = sum(s * n for s, n in items.items() if 2 * s > capacity and s <= capacity - k)
        small_sum = sum(s * n for s, n in items.items() if k <= s and 2 * s <= capacity)
        best = max(best, alone + large + max(0, -(-(small_sum - (large * capacity - large_sum)) // capacity)))
    return best


def plan_containers(histogram: dict[int, int], capacity: int, most: int | None = MOST_BRANCHES) -> list[tuple[int, list[int]]]:
    """(number of containers, items of each) that take up the whole histogram."""
    left = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
    sizes = sorted(left)
    plan = []
    while sizes:
        s = sizes[-1]
        left[s] -= 1
        if not left[s]:
            sizes.pop()
        rest = best_completion(capacity - s, sizes, left, most) if sizes and sizes[0] <= capacity - s else []
        left[s] += 1
        if not sizes or sizes[-1] != s:
            sizes.append(s)
        items = [s, *rest]
        need = {x: items.count(x) for x in dict.fromkeys(items)}
        times = min(left[x] // k for x, k in need.items())
        plan.append((times, items))
        for x, k in need.items():
            left[x] -= k * times
            if not left[x]:
                sizes.remove(x)
    return plan


def slots(plan: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: where runs of slots begin, the first container of each run, the slots a container has."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 1
    for times, items in plan:
        for s in dict.fromkeys(items):
            k = items.count(s)
            runs.setdefault(s, []).append((taken.get(s, 0), first, k))
            taken[s] = taken.get(s, 0) + k * times
        first += times
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for s, r in runs.items()}


def pack(docs: DataFrame, id_col: str, tokens_col: str, capacities: dict[int, int], most: int | None = MOST_BRANCHES) -> DataFrame:
    """(spec_id, container_id, id, piece, tokens): every text in containers of each capacity.

    Containers of a spec are numbered from 1; those of full pieces of cut texts come after the packed ones.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    sized = docs.select(F.col(id_col).alias("id"), F.col(tokens_col).cast("long").alias("n")).where("n > 0")
    specs = [(k, c) for k, c in capacities.items() if k is not None and c is not None and c > 0]
    if not specs:
        return spark.createDataFrame([], f"spec_id int, container_id bigint, id {kind}, piece int, tokens bigint")
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("spec_id"), F.lit(c).cast("long").alias("cap")) for k, c in specs]))
    items = sized.select("id", "n", each.alias("s")).select("id", "n", "s.spec_id", "s.cap").withColumn("full", F.when(F.col("n") > F.col("cap"), F.floor(F.col("n") / F.col("cap"))).otherwise(F.lit(0)).cast("long"))
    items = items.withColumn("rest", F.col("n") - F.col("full") * F.col("cap"))
    histogram: dict[int, dict[int, int]] = {}
    for r in items.where("rest > 0").groupBy("spec_id", "rest").agg(F.count("*").alias("k")).collect():
        histogram.setdefault(r["spec_id"], {})[r["rest"]] = r["k"]
    plans = {k: plan_containers(histogram.get(k, {}), c, most) for k, c in specs}
    packed = {k: sum(t for t, _ in p) for k, p in plans.items()}
    lookup = spark.sparkContext.broadcast({k: slots(p) for k, p in plans.items()})

    def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
        """place: number from 0 of each row in its group, by salted parts."""
        salt = F.pmod(F.xxhash64("id"), F.lit(max(64, parallelism(rows))))
        rows = rows.withColumn("salt", salt)
        parts = rows.groupBy(*by, "salt").agg(F.count("*").alias("k"))
        before = parts.withColumn("before", F.sum("k").over(Window.partitionBy(*by).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select(*by, "salt", F.coalesce("before", F.lit(0)).alias("before"))
        own = F.row_number().over(Window.partitionBy(*by, "salt").orderBy(F.xxhash64("id", F.lit(1)), "id")) - 1
        return rows.withColumn("own", own).join(before, [*by, "salt"]).withColumn("place", F.col("own") + F.col("before")).drop("own", "before", "salt")

    def containers(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros(len(b), dtype=np.int64)
            for (spec, size), g in b.groupby(["spec_id", "rest"]):
                start, first, per = lookup.value[spec][size]
                place = g["place"].to_numpy()
                run = np.searchsorted(start, place, side="right") - 1
                out[b.index.get_indexer(g.index)] = first[run] + (place - start[run]) // per[run]
            yield pd.DataFrame({"spec_id": b["spec_id"], "container_id": out, "id": b["id"], "piece": (b["full"] + 1).astype("int32"), "tokens": b["rest"]})

    rests = numbered(items.where("rest > 0"), ["spec_id", "rest"]).mapInPandas(containers, f"spec_id int, container_id bigint, id {kind}, piece int, tokens bigint")
    # Full pieces: one container each, numbered by (number of pieces, place); the table of numbers of pieces is short.
    cut = numbered(items.where("full > 0"), ["spec_id", "full"])
    totals = cut.groupBy("spec_id", "full").agg((F.count("*") * F.col("full")).alias("k"))
    offset = totals.withColumn("o", F.coalesce(F.sum("k").over(Window.partitionBy("spec_id").orderBy("full").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("spec_id", "full", "o")
    after = F.create_map(*[F.lit(x) for k, v in packed.items() for x in (int(k), int(v))])
    pieces = (
        cut.join(offset, ["spec_id", "full"]).withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("full").cast("int"))))
        .select("spec_id", (after[F.col("spec_id")] + F.col("o") + F.col("place") * F.col("full") + F.col("piece")).cast("bigint").alias("container_id"), "id", "piece", F.col("cap").alias("tokens"))
    )
    return rests.unionByName(pieces)


def _packed(spark: SparkSession, folder: str, tokenizer: str = TOKENIZER) -> tuple[DataFrame, dict[int, int]]:
    docs = read_table(spark, folder, "documents")
    sized = cut_lineage(docs.select("doc_id", token_count(docs, "text", tokenizer).alias("n")))
    capacities = {r["spec_id"]: r["capacity"] for r in read_table(spark, folder, "pack_specs").select("spec_id", "capacity").collect()}
    return pack(sized, "doc_id", "n", capacities), capacities


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in containers of each capacity."""
    return _packed(spark, folder)[0].withColumnRenamed("id", "doc_id")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """For each capacity: containers used, a number no packing goes below, and the share of room used."""
    rows, capacities = _packed(spark, folder)
    rows = cut_lineage(rows)
    cap = F.create_map(*[F.lit(int(x)) for k, v in capacities.items() for x in (k, v)])[F.col("spec_id")]
    sizes: dict[int, dict[int, int]] = {}
    full: dict[int, int] = {}
    for r in rows.groupBy("spec_id", "tokens").agg(F.count("*").alias("n")).collect():
        spec, c = r["spec_id"], capacities[r["spec_id"]]
        if r["tokens"] == c:
            full[spec] = r["n"]
        else:
            sizes.setdefault(spec, {})[r["tokens"]] = r["n"]
    least = F.create_map(*[F.lit(int(x)) for k, c in capacities.items() for x in (k, full.get(k, 0) + least_containers(sizes.get(k, {}), c))])[F.col("spec_id")]
    by = rows.groupBy("spec_id").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("tokens").alias("n_tokens"))
    return by.select("spec_id", cap.alias("capacity"), "n_containers", least.cast("bigint").alias("least_containers"), "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * cap)).alias("fill"))


QUERIES = {"p8_containers": p8_containers, "p8_report": p8_report}
