"""Variant spellings of names (problem 2): metric-space partitioning with exact radius joins.

A name is a pair of words or groups of words: a frequent one (a given name, a line of business, an institution)
and a rare one (a surname, the name of a firm), in any order. The metric is the sum of the Damerau-Levenshtein distances of the
two. The frequent words, learned from all values, are the pivots. A name whose frequent word is a pivot belongs to
that pivot's cell; one whose word is none is replicated to the cell of every pivot within the radius of that word. Two
different frequent words are two names, however near, so a pair that may be linked has at most one word that is no
pivot or two such words near one pivot, and by the triangle inequality it meets in a cell. Inside a cell an exact radius join finds the names
whose rare words are within two edits (one for short ones), a swap of neighbours counting as one: names
that close share a string left by deleting at most two letters, so the join is an equi-join on
(pivot, remaining string), checked with the distance itself. A value follows a name if both distances together are at most
`RADIUS`. Two spellings that are both well attested
(three different ways of writing each) are namesakes and stay apart, unless they are one edit apart and one has `SLIPS`
times the rows of the other: slips recur as a share of the rows of a name. Also apart stay firms of
different legal forms, and names two edits apart that both consist of usual triples of letters, as slips do not.

Each name follows the nearest larger name of its cell, and so on up; the top is the entity. An initial or an
abbreviation follows only if exactly one entity fits.

Defined results for odd input: null, blank and dash-only values mean nobody and are linked with nothing; ties in
distance go to the better attested name, then to the one first in binary order; very long values are read whole;
repeated values count as attestation; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regispark.llm.parties import INSTITUTIONS, Pivots, fold, read_party, readings
from regispark.operators.shredding import _members, parse_record
from regispark.session import cut_lineage, parallelism, read_table

#: A word of at least this share of the values is a pivot, so there are at most words-per-value / PIVOT_SHARE.
PIVOT_SHARE = 0.004
LEAST_PIVOT = 6
ESTABLISHED = 3
SLIPS = 50  #: a name with so many times the rows of another explains it as a slip, however often that recurs
USUAL_SHARE = 5e-4
RADIUS = 3  #: edits in both words together


def damerau(a: str, b: str, most: int = 3) -> int:
    """Damerau-Levenshtein distance, most + 1 if it is larger: insertions, deletions, changes, and swaps of letters
    between which others may have come or gone (without that last, the triangle inequality would not hold).
    Only a band around the diagonal is filled."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    far = most + 1
    if abs(n - m) > most:
        return far
    # The last rows, newest at the end; a swap reaches back over no more than `most` letters.
    rows: list[list[int]] = [list(range(m + 1)) if m <= most else [*range(most + 1), *([far] * (m - most))]]
    for i in range(1, n + 1):
        above = rows[-1]
        row = [far] * (m + 1)
        if i <= most:
            row[0] = i
        for j in range(max(1, i - most), min(m, i + most) + 1):
            cost = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (a[i - 1] != b[j - 1]))
            if cost > 1:
                for k in range(i - 1, max(0, i - 1 - most), -1):
                    if a[k - 1] == b[j - 1]:
                        for x in range(j - 1, max(0, j - 1 - most), -1):
                            if b[x - 1] == a[i - 1]:
                                # rows[-1] is row i - 1, so row k - 1 is i - k rows before the one being filled.
                                cost = min(cost, rows[-(i - k + 1)][x - 1] + (i - k - 1) + 1 + (j - x - 1))
                                break
                        break
            row[j] = min(cost, far)
        rows.append(row)
        if len(rows) > most + 2:
            rows.pop(0)
    return rows[-1][m]


def radius(root: str) -> int:
    return 2 if len(root) >= 8 else 1 if len(root) >= 5 else 0


#: From this length on a word is found by its segments instead of what is left of it.
SEGMENTED = 33


def remains(root: str) -> set[str]:
    """Keys of a word, such that two words within the radius share one.

    Short words: what is left when up to radius letters are deleted. Long words: five segments, of which two edits
    (a swap may touch two) leave one untouched, at most two places off; cut for each length a partner may have.
    """
    n = len(root)
    if n < SEGMENTED:
        out = {root}
        for k in range(1, radius(root) + 1):
            out |= {"".join(c for i, c in enumerate(root) if i not in gone) for gone in combinations(range(n), k)}
        if n >= SEGMENTED - 2:
            out |= _segments(root)
        return out
    return _segments(root)


def _segments(root: str) -> set[str]:
    out = set()
    for length in range(max(5, len(root) - 2), len(root) + 3):
        cuts = [length * k // 5 for k in range(6)]
        for k in range(5):
            for off in range(-2, 3):
                at = cuts[k] + off
                if at >= 0 and at + cuts[k + 1] - cuts[k] <= len(root):
                    out.add(f"{length}:{k}:{root[at : at + cuts[k + 1] - cuts[k]]}")
    return out


def learn_pivots(values: DataFrame) -> Pivots:
    """The frequent words of all values. What the driver receives is bounded by PIVOT_SHARE, not by the data."""

    def words(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for v in b["value"]:
                p = read_party(v)
                rows += [(w, bool(p.form)) for w in set(p.words)]
            yield pd.DataFrame(rows, columns=["word", "firm"])

    least = max(LEAST_PIVOT, PIVOT_SHARE * values.count())
    rows = (
        values.select("value").mapInPandas(words, "word string, firm boolean")
        .groupBy("word").agg(F.count("*").alias("n"), F.avg(F.col("firm").cast("int")).alias("firms"))
        .where(F.col("n") >= least).collect()
    )
    institutions = {fold(w) for w in INSTITUTIONS}
    return Pivots([r["word"] for r in rows], [r["word"] for r in rows if r["firms"] > 0.3 or r["word"] in institutions])


def reads_well(root: str, usual: set[str]) -> bool:
    w = f"^{root}$"
    return all(w[i : i + 3] in usual for i in range(len(w) - 2))


def usual_triples(nodes: DataFrame) -> set[str]:
    """Triples of letters that many different rare words share. Bounded by the alphabet, not by the data."""
    roots = nodes.where("rows > 0").select("root").distinct().where("root rlike '^[a-z]{5,}$'")
    least = max(3, USUAL_SHARE * roots.count())

    def triples(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        for b in batches:
            for root in b["root"]:
                w = f"^{root}$"
                n.update(w[i : i + 3] for i in range(len(w) - 2))
        yield pd.DataFrame(list(n.items()), columns=["t", "n"])

    return {r["t"] for r in roots.mapInPandas(triples, "t string, n bigint").groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()}


def linked_names(values: DataFrame) -> DataFrame:
    """(value, entity) for each distinct value; values: value string, n bigint (rows that hold it)."""
    values = cut_lineage(values.where("value is not null and value rlike '[\\\\p{L}]'").groupBy("value").agg(F.sum("n").alias("n")))
    pivots = values.sparkSession.sparkContext.broadcast(learn_pivots(values))

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for v, n in zip(b["value"], b["n"]):
                found = readings(read_party(v), pivots.value)
                rows += [(v, n, r.pivot, r.root, r.form, r.cost, len(found)) for r in found]
            yield pd.DataFrame(rows, columns=["value", "n", "pivot", "root", "form", "cost", "of"])

    read_as = cut_lineage(values.mapInPandas(read, "value string, n bigint, pivot string, root string, form string, cost int, of int"))
    nodes = read_as.groupBy("pivot", "root").agg(
        F.coalesce(F.sum(F.when(F.col("of") == 1, F.col("n"))), F.lit(0)).alias("rows"), F.count(F.when(F.col("of") == 1, 1)).alias("ways"),
        F.max(F.when(F.col("form") != "", F.col("form"))).alias("form"),
    )
    usual = values.sparkSession.sparkContext.broadcast(usual_triples(nodes))

    def keys(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(xxhash.xxh64_intdigest(f"{p}\x00{k}") - (1 << 63), p, r, n, w, f) for p, r, n, w, f in zip(b["pivot"], b["root"], b["rows"], b["ways"], b["form"]) for k in remains(r)]
            yield pd.DataFrame(out, columns=["key", "pivot", "root", "rows", "ways", "form"])

    # A name makes many keys, so the few names are spread before.
    keyed = nodes.repartition(parallelism(nodes)).mapInPandas(keys, "key bigint, pivot string, root string, rows bigint, ways bigint, form string")
    size = lambda x: F.struct(F.col(f"{x}ways"), F.col(f"{x}rows"), F.col(f"{x}root"))
    # Of each key only the names of one cell remain; the larger is the hub. Every name meets every larger one that shares its key.
    small = keyed.select("key", F.col("pivot"), F.col("root").alias("a_root"), F.col("rows").alias("a_rows"), F.col("ways").alias("a_ways"), F.col("form").alias("a_form"))
    large = keyed.where("rows > 0").select("key", F.col("pivot"), F.col("root").alias("b_root"), F.col("rows").alias("b_rows"), F.col("ways").alias("b_ways"), F.col("form").alias("b_form"))
    pairs = small.join(large, ["key", "pivot"]).where(size("b_") > size("a_")).withColumn("namesakes", (F.col("a_ways") >= ESTABLISHED) & (F.col("b_ways") >= ESTABLISHED)).where(~F.col("namesakes") | (F.col("b_rows") >= SLIPS * F.col("a_rows"))).where("a_form is null or b_form is null or a_form = b_form").drop("key").distinct()

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            d = damerau(x, y)
            # Two edits between two words that both read like names are two names.
            out.append(9 if d > 1 and usual.value and reads_well(x, usual.value) and reads_well(y, usual.value) else d)
        return pd.Series(out, dtype="int32")

    reach = F.when(F.least(F.length("a_root"), F.length("b_root")) >= 8, 2).when(F.least(F.length("a_root"), F.length("b_root")) >= 5, 1).otherwise(0)
    near = pairs.withColumn("d", distance("a_root", "b_root")).where(F.col("d") <= F.when(F.col("namesakes"), F.least(reach, F.lit(1))).otherwise(reach))
    up = near.groupBy("pivot", F.col("a_root").alias("root")).agg(F.min(F.struct(F.col("d"), (-F.col("b_ways")).alias("w"), (-F.col("b_rows")).alias("r"), F.col("b_root"))).alias("best"))
    tops = cut_lineage(
        nodes.join(up, ["pivot", "root"], "left")
        .select("pivot", "root", "rows", F.coalesce("best.b_root", "root").alias("top"), F.coalesce("best.d", F.lit(0)).alias("d"), F.when(F.col("best").isNull(), F.col("rows")).alias("own"))
    )
    # Up the chain of ever larger names; each step doubles its reach.
    while True:
        over = tops.select(F.col("pivot"), F.col("root").alias("top"), F.col("top").alias("next"))
        jumped = cut_lineage(tops.join(over, ["pivot", "top"]).select("pivot", "root", "rows", F.col("next").alias("top"), "d", (F.col("next") != F.col("top")).alias("moved")))
        tops = jumped.drop("moved")
        if not jumped.where("moved").limit(1).count():
            break
    attested = tops.where("rows > 0").groupBy("pivot", "top").agg(F.sum("rows").alias("support"))
    placed = read_as.join(tops.select("pivot", "root", "top", "d"), ["pivot", "root"]).join(attested, ["pivot", "top"], "left").where((F.col("support").isNotNull() | (F.col("of") == 1)) & (F.col("d") + F.col("cost") <= RADIUS))
    rank = F.struct(F.col("d"), F.col("cost"))
    best = placed.groupBy("value").agg(F.min(rank).alias("b"))
    fits = placed.join(best, "value").where(rank == F.col("b")).groupBy("value").agg(F.collect_set(F.concat_ws("\x00", "pivot", "top")).alias("e"))
    return values.join(fits, "value", "left").select("value", F.when(F.size("e") == 1, F.concat(F.lit("n:"), F.col("e")[0])).otherwise(F.concat(F.lit("v:"), F.col("value"))).alias("entity"))


def trans_actors(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the decoded doc_trans_actor of every record that has one."""

    def actors(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, found = [], []
            for i, text in enumerate(b["payload"]):
                if text is None or "doc_trans_actor" not in text:
                    continue
                for record in _members(parse_record(text)) or []:
                    for data in _members(record.get("data")) or []:
                        if isinstance(v := data.get("doc_trans_actor"), str) and v:
                            at.append(i)
                            found.append(v)
            yield b[keys].iloc[at].reset_index(drop=True).assign(value=pd.Series(found, dtype=object))

    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "value string"])
    return df.select(*keys, "payload").mapInPandas(actors, schema)


def party_values(spark: SparkSession, folder: str) -> DataFrame:
    """(value, n): the counterparties of both tables, counted before they are brought together."""
    to_party = read_table(spark, folder, "registry_docs").select(F.col("to_party").alias("value"))
    actors = trans_actors(read_table(spark, folder, "rmk_records"), ["fetch_id"]).select("value")
    return to_party.unionByName(actors).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    names = cut_lineage(linked_names(party_values(spark, folder)))
    several = names.groupBy("entity").agg(F.count("*").alias("k")).where("k > 1").select("entity")
    names = names.join(several, "entity")
    a, b = names.select("entity", F.col("value").alias("name_a")), names.select("entity", F.col("value").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")


def p2_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Each value with its entity and the number of spellings that entity has."""
    names = cut_lineage(linked_names(party_values(spark, folder)))
    return names.join(names.groupBy("entity").agg(F.count("*").alias("n_spellings")), "entity").select("value", "entity", "n_spellings")


QUERIES = {"p2_found": p2_found, "p2_entities": p2_entities}
