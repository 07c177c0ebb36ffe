"""Near-duplicate records with small edits (problem 6): BagMinHash, banding, exact overlap.

A text is a bag of words: its different words, or with `counted` each as often as it occurs. Two texts are similar
if `num / den` or more of their words together are common. Exact copies (equal bags) are one class from the
start; only one set of each class is compared.

Candidates come in two ways, split by what a pair must share. Let the words of a text be ordered from rare to
frequent. A similar partner shares one of the first words (prefix filter), so a text

1. is joined on the *rare* words of its prefix, exactly. Rare means in less than one in `RARE` sets, so that
   the groups of this join are small parts of the collection; the places of the common word in the two orders bound
   what the texts can still have in common, and so does the difference of two bit sketches.
2. takes part in BagMinHash if its prefix reaches into the *frequent* words, where such a join would be quadratic.
   BagMinHash (Ertl, KDD 2018) sees a word of weight w as a Poisson process over (0, w] x time whose points
   fall on random registers; a register keeps its earliest point, and two signatures agree in a register with
   probability equal to the weighted Jaccard similarity, the measure that is accepted in the end. Weights (counts) are
   discretised by halving: (0, 1], (1, 2], (2, 4], ... each is a process of its own. Points of a word are drawn in
   order of time and no further than to the latest point any register keeps (the early stop), so a signature costs
   m log m draws of its whole text, not m of each word. Pairs that agree in `AGREE` of `BANDS` bands of `ROWS` registers
   are compared: of pairs at a similarity of 0.6 these are 0.998, of pairs at 0.3 one in 200.

With exact=True the prefix join takes in the frequent words too and BagMinHash is not needed: no pair is missed, but
the cost grows with the square of the number of texts that share a word.

Every candidate is checked by the exact overlap. Bounds: the frequent words, the only data broadcast, are at most RARE times
the mean number of words of a set; their number is counted before they are collected, and the limit of rarity
falls back to fewer words where they would exceed `MOST_FREQUENT`.

Defined results for odd input: null texts and texts without words are in no pair and no group; ties do not arise
(similarity is compared in whole numbers); repeated ids with equal texts give one pair of ids at most, never an id
with itself; texts of any length are read whole; columns other than those named are not looked at; an empty
table gives empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regispark.operators.components import connected_components
from regispark.session import cut_lineage, read_table

RARE = 2048
FEW = 64  #: words of fewer sets than this are rare in any collection
MOST_FREQUENT = 2_000_000
BANDS, ROWS, AGREE = 180, 6, 2
_WORD = re.compile(r"[^\W_]+")
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def words_of(text: str, field: str = "", counted: bool = False) -> list[int]:
    """Sorted hashes of the words (runs of letters or digits in lower case), apart by field; with `counted` the k-th
    occurrence of a word is an element of its own, so that common elements are the overlap of the bags."""
    found = _WORD.findall(text.lower())
    if not counted:
        return sorted(xxhash.xxh64_intdigest(f"{field}\x00{w}") - (1 << 63) for w in set(found))
    n: dict[str, int] = {}
    out = []
    for w in found:
        n[w] = n.get(w, 0) + 1
        out.append(xxhash.xxh64_intdigest(f"{field}\x00{w}\x00{n[w]}" if n[w] > 1 else f"{field}\x00{w}") - (1 << 63))
    return sorted(out)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit integers, by a strong mixing function."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def points(words: np.ndarray, level: int, until: float, registers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(times, registers, heights) of the processes of `words` over the level's interval, in order of time and past `until`.

    Level 0 is (0, 1], level k is (2**(k-1), 2**k]; the rate is the interval's width.
    """
    width = 1.0 if level == 0 else 2.0 ** (level - 1)
    k = int(until * width + 6 * math.sqrt(until * width) + 12)
    seed = words[:, None] + np.arange(1, k + 1, dtype=np.uint64)[None, :] * _MIX[2] + np.full(1, level, dtype=np.uint64) * _MIX[1]
    times = np.cumsum(-np.log(_uniform(seed)) / width, axis=1)
    where = _uniform(seed ^ _MIX[0])
    register = (where * registers).astype(np.int64)
    # What is left of the number that chose the register is uniform again: the height inside the interval.
    heights = (0.0 if level == 0 else width) + width * (where * registers - register)
    return times, register, heights


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """BagMinHash signatures of bags given as (words, whole weights from 1): the earliest time in each register."""
    out = np.full((len(bags), registers), np.inf)
    slack = 2.5
    todo = sorted(range(len(bags)), key=lambda i: int(bags[i][1].sum()))
    while todo:
        again: list[int] = []
        at = 0
        while at < len(todo):
            # The lightest bag of a run needs the latest points; a run ends where too many would be held at once.
            until = registers * (math.log(registers) + slack) / float(bags[todo[at]][1].sum())
            end, held = at, 0.0
            while end < len(todo) and (end == at or held + bags[todo[end]][1].sum() * until <= 1_500_000):
                held += bags[todo[end]][1].sum() * until
                end += 1
            run = todo[at:end]
            words = np.concatenate([bags[i][0] for i in run])
            weights = np.concatenate([bags[i][1] for i in run])
            row = np.repeat(np.arange(len(run)), [len(bags[i][0]) for i in run])
            part = np.full(len(run) * registers, np.inf)
            for level in range(int(weights.max() - 1).bit_length() + 1):
                here = weights > (0 if level == 0 else 2 ** (level - 1))
                if not here.any():
                    break
                unique, place = np.unique(words[here], return_inverse=True)
                times, register, heights = points(unique, level, until, registers)
                t, r, w, to = times[place], register[place], weights[here][:, None], row[here][:, None] * registers
                keep = (t <= until) & (heights[place] <= w) if level else t <= until
                np.minimum.at(part, (r + to)[keep], t[keep])
            part = part.reshape(len(run), registers)
            full = np.isfinite(part).all(axis=1)
            for k, i in enumerate(run):
                if full[k]:
                    out[i] = part[k]
                else:
                    again.append(i)
            at = end
        todo, slack = again, slack * 2
    return out


def band_keys(bags: list[tuple[np.ndarray, np.ndarray]], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each bag and band: equal keys mean equal registers."""
    with np.errstate(over="ignore"):
        found = signatures(bags, bands * rows).view(np.uint64).reshape(len(bags), bands, rows)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _MIX[2], (len(bags), bands)).copy()
        for r in range(rows):
            key = (key ^ found[:, :, r]) * _MIX[r % 2]
            key ^= key >> np.uint64(29)
        return key.view(np.int64)


def sketch(words: np.ndarray) -> tuple[int, int, int, int]:
    """256 bits, each the parity of the words that fall on it: two sketches differ in no more bits than two sets in words."""
    bits = np.bincount(words.astype(np.int64).view(np.uint64) % np.uint64(256), minlength=256) & 1
    return tuple(np.packbits(bits.astype(np.uint8)).view(np.int64).tolist())


def word_sets(df: DataFrame, min_words: int = 1, counted: bool = False, with_words: bool = True) -> DataFrame:
    """(field, id, k1, k2, words): k1 and k2 identify the set of words. df: field, id, text."""

    def sets(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, i, t, least in zip(b["field"], b["id"], b["text"], b["least"]):
                w = words_of(t, f, counted)
                if len(w) >= max(1, least):
                    d = xxhash.xxh128_intdigest(np.array(w, dtype=np.int64).tobytes())
                    rows.append((f, i, (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), *([w] if with_words else [])))
            yield pd.DataFrame(rows, columns=["field", "id", "k1", "k2", *(["words"] if with_words else [])])

    kind = df.schema["id"].dataType.simpleString()
    least = F.col("least") if "least" in df.columns else F.lit(min_words)
    source = df.where("text is not null and id is not null").select("field", "id", F.col("text").cast("string").alias("text"), least.alias("least"))
    return source.mapInPandas(sets, f"field string, id {kind}, k1 bigint, k2 bigint" + (", words array<bigint>" if with_words else ""))


def frequent_words(counts: DataFrame, n: dict[str, int], most: int = MOST_FREQUENT) -> dict[int, int]:
    """Words in at least one of RARE sets of their field with their number of sets; fewer if those were more than `most`."""
    limit = F.lit(float(FEW))
    for f, k in n.items():
        limit = F.when(F.col("field") == f, F.greatest(F.lit(float(FEW)), F.lit(k / RARE))).otherwise(limit)
    rows = counts.where(F.col("df") >= limit)
    by = sorted(((r["p"], r["k"]) for r in rows.groupBy(F.floor(F.log2("df")).alias("p")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, least = 0, 0
    for p, k in by:
        if total + k > most:
            least = 2 ** (p + 1)
            break
        total += k
    return {r["w"]: r["df"] for r in rows.where(F.col("df") >= least).select("w", "df").collect()}


def similar_sets(sets: DataFrame, num: int = 3, den: int = 5, exact: bool = False) -> DataFrame:
    """(a, b): pairs of different sets with num/den or more of their words in common, the smaller s first.

    sets: s (a whole number), field, words; each set once.
    """
    n = {r["field"]: r["n"] for r in sets.groupBy("field").agg(F.count("*").alias("n")).collect()}
    counts = cut_lineage(sets.select("field", F.explode("words").alias("w")).groupBy("field", "w").agg(F.count("*").alias("df")).where("df > 1"))
    found = frequent_words(counts, n)
    order = np.array(sorted(found), dtype=np.int64)
    frequent = sets.sparkSession.sparkContext.broadcast((order, np.array([found[w] for w in order.tolist()], dtype=np.int64)))

    def flat(b: pd.DataFrame) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
        """(s, words of each set, all words, index of their set, number of sets of frequent words, 0 for rare ones)."""
        known, df = frequent.value
        for at in range(0, len(b), 2000):
            s, words = b["s"].to_numpy()[at : at + 2000], [np.asarray(w, dtype=np.int64) for w in b["words"].iloc[at : at + 2000]]
            every = np.concatenate(words)
            place = np.minimum(np.searchsorted(known, every), max(len(known) - 1, 0))
            n_sets = np.where(known[place] == every, df[place], 0) if len(known) else np.zeros(len(every), dtype=np.int64)
            yield s, words, every, np.repeat(np.arange(len(s)), [len(w) for w in words]), n_sets

    def described(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, words, _, row, n_sets in flat(b):
                bits = pd.DataFrame([sketch(w) for w in words], columns=["x0", "x1", "x2", "x3"])
                yield pd.concat([pd.DataFrame({"s": s, "size": np.array([len(w) for w in words], dtype=np.int32), "rare": np.bincount(row[n_sets == 0], minlength=len(s)).astype(np.int32)}), bits], axis=1)

    def rare_words(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, _, every, row, n_sets in flat(b):
                yield pd.DataFrame({"s": s[row[n_sets == 0]], "w": every[n_sets == 0]})

    def placed_words(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The frequent words with their places, which come after all rare ones."""
        for b in batches:
            for s, _, every, row, n_sets in flat(b):
                by = np.lexsort((every, n_sets, row))
                r, k = row[by], n_sets[by]
                starts = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1])
                place = np.arange(len(r)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(r)]])))
                yield pd.DataFrame({"s": s[r[k > 0]], "w": every[by][k > 0], "place": place[k > 0].astype(np.int32)})

    of = sets.select("s", "words")
    bits = ["x0", "x1", "x2", "x3"]
    meta = cut_lineage(of.mapInPandas(described, "s bigint, size int, rare int, x0 bigint, x1 bigint, x2 bigint, x3 bigint"))
    # The first words of a set, rare ones first: a partner shares one of the first `reach`, a partner no smaller one of the first `own`.
    reach = F.expr(f"size - int(ceil(size * {num} / {den})) + 1")
    own = F.expr(f"size - int(ceil(size * {2 * num} / {num + den})) + 1")
    ranked = of.mapInPandas(rare_words, "s bigint, w bigint").join(counts.select("w", "df"), "w").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("l"))
    # Words of one set alone come first of all and have no partner.
    postings = meta.join(ranked, "s").select(*meta.columns, F.posexplode("l").alias("p", "e"), F.size("l").alias("several")).select(*meta.columns, (F.col("rare") - F.col("several") + F.col("p")).alias("place"), F.col("e.w").alias("w"))
    if exact:
        postings = postings.unionByName(meta.join(of.mapInPandas(placed_words, "s bigint, w bigint, place int"), "s").select(*postings.columns))
    postings = postings.where(F.col("place") < reach).withColumn("small", F.col("place") < own).drop("rare")
    enough = f"({num + den}) * {{o}} >= {num} * (a_size + b_size)"
    apart = " + ".join(f"bit_count(a_{x} ^ b_{x})" for x in bits)
    possible = F.expr(f"a_size * {den} >= b_size * {num}") & F.expr(enough.format(o=f"(a_size + b_size - ({apart})) / 2"))
    side = lambda df, x: df.select(*[F.col(c).alias(c if c == "w" else f"{x}_{c}") for c in df.columns])
    a, b = side(postings.where("small").drop("small"), "a"), side(postings.drop("small"), "b")
    met = a.join(b, "w").where(F.expr("a_size < b_size or (a_size = b_size and a_s < b_s)")).where(F.expr(enough.format(o="least(a_size - a_place, b_size - b_place)")) & possible).select(F.least("a_s", "b_s").alias("a"), F.greatest("a_s", "b_s").alias("b")).distinct()
    if not exact:
        if meta.where(F.col("rare") < reach).limit(1).count():

            def keys(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    for s, words, _, row, n_sets in flat(b):
                        rare = np.bincount(row[n_sets == 0], minlength=len(s))
                        # Only sets whose prefix reaches into the frequent words.
                        dense = [i for i, w in enumerate(words) if rare[i] < len(w) - -(-len(w) * num // den) + 1]
                        for at in range(0, len(dense), 500):
                            some = dense[at : at + 500]
                            k = band_keys([(words[i].view(np.uint64), np.ones(len(words[i]), dtype=np.int64)) for i in some])
                            yield pd.DataFrame({"band": k.ravel(), "s": np.repeat(s[some], BANDS)})

            bands = of.mapInPandas(keys, "band bigint, s bigint").repartition("band")
            hit = bands.select("band", F.col("s").alias("a")).join(bands.select("band", F.col("s").alias("b")), "band").where("a < b").groupBy("a", "b").agg(F.count("*").alias("k")).where(F.col("k") >= AGREE).select("a", "b")
            left, right = side(meta.drop("rare"), "a"), side(meta.drop("rare"), "b")
            near = hit.join(left.withColumnRenamed("a_s", "a"), "a").join(right.withColumnRenamed("b_s", "b"), "b")
            met = met.union(near.where(F.expr(f"b_size * {den} >= a_size * {num}") & possible).select("a", "b")).distinct()
    met = cut_lineage(met)
    ends = met.select(F.col("a").alias("s")).union(met.select("b")).distinct()
    held = sets.select("s", "words").join(ends, "s", "left_semi")
    checked = met.join(held.select(F.col("s").alias("a"), F.col("words").alias("wa")), "a").join(held.select(F.col("s").alias("b"), F.col("words").alias("wb")), "b").withColumn("c", F.size(F.array_intersect("wa", "wb")))
    return checked.where(F.col("c") * (num + den) >= (F.size("wa") + F.size("wb")) * num).select("a", "b")


def _sets(df: DataFrame, min_words: int = 1, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members: field, id, s), (sets: s, field, words): each different set has a number s."""
    rows = word_sets(df, min_words, counted)
    first = rows.groupBy("field", "k1", "k2").agg(F.first("words").alias("words"))
    sets = cut_lineage(first.withColumn("s", F.monotonically_increasing_id()))
    members = word_sets(df, min_words, counted, with_words=False).distinct().join(sets.select("field", "k1", "k2", "s"), ["field", "k1", "k2"]).select("field", "id", "s")
    return cut_lineage(members), sets.select("s", "field", "words")


def revision_pairs(df: DataFrame, min_words: int = 1, exact: bool = False, counted: bool = False) -> DataFrame:
    """(field, id_a, id_b): all pairs of rows with 0.6 or more of their different words (with `counted`, of all their words) in common."""
    members, sets = _sets(df, min_words, counted)
    pairs = cut_lineage(similar_sets(sets, exact=exact))
    a = members.select("field", F.col("s").alias("a"), F.col("id").alias("x"))
    b = members.select(F.col("s").alias("b"), F.col("id").alias("y"))
    across = pairs.join(a, "a").join(b, "b").select("field", "x", "y")
    several = members.groupBy("s").agg(F.count("*").alias("n")).where("n > 1").select(F.col("s").alias("a"))
    copies = a.join(several, "a")
    same = copies.join(copies.select("a", F.col("x").alias("y")), "a").where("x < y").select("field", "x", "y")
    return across.unionByName(same).where("x <> y").select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def revision_groups(df: DataFrame, min_words: int = 1, exact: bool = False, counted: bool = False) -> DataFrame:
    """(field, id, class_id, n_links): one row for each record with words; records linked by revisions, directly or through others, share a class.

    class_id is the smallest id of the class; n_links counts the other word sets that a record's own is similar to.
    """
    members, sets = _sets(df, min_words, counted)
    pairs = cut_lineage(similar_sets(sets, exact=exact))
    links = pairs.union(pairs.select("b", "a")).groupBy(F.col("a").alias("s")).agg(F.count("*").alias("n_links"))
    heads = members.groupBy("s").agg(F.min("id").alias("head")).join(links, "s", "left").join(connected_components(pairs, "a", "b").withColumnRenamed("node", "s"), "s", "left")
    heads = heads.withColumn("part", F.coalesce("component", "s"))
    classes = heads.groupBy("part").agg(F.min("head").alias("class_id"))
    named = heads.join(classes, "part").select("s", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(named, "s").select("field", "id", "class_id", "n_links")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    titles = read_table(spark, folder, "registry_docs").select(F.lit("title").alias("field"), "id", F.col("title").alias("text"), F.lit(8).alias("least"))
    files = read_table(spark, folder, "files").where("parsed_with = 'FileParser'").select(F.lit("contents").alias("field"), "id", F.col("contents").alias("text"), F.lit(1).alias("least"))
    return titles.unionByName(files)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return revision_pairs(_records(spark, folder)).withColumnRenamed("field", "field_name")


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    return revision_groups(_records(spark, folder)).withColumnRenamed("field", "field_name")


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}
