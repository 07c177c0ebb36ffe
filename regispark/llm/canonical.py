"""Freely typed values mapped to a canonical list (problem 7).

Values are deduplicated, normalised and compared with the reference entries of their field by the weighted
cosine of their character n-grams, retrieved through an inverted n-gram index. The n-grams are single letters, pairs,
pairs with a letter between them and triples, so that a swap or a slip in a short value leaves enough of them. A value
is also tried by its parts: each run of its words, the pieces around separators, and its words as abbreviations of an
entry's words, scored by how much of the value the part covers. The cosine decides: an entry is accepted if its score reaches
`threshold` and leads every other entry by `margin`; otherwise the value is reported as unmatched (ref_id 0). The edit
distance only rejects: entries that are less than `LEAST_EDIT` alike letter by letter are no candidates.

Defined results for odd input: null and blank values are not mapped (no row in `map_values`); a value equal to
a label of its field maps to that entry; ties between two entries give 0; a text of any length is read whole
(its word runs are bounded by the longest entry's word count); repeated rows share one mapping; an empty
reference list gives 0 everywhere; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regispark.session import cut_lineage, read_table

THRESHOLD, MARGIN, LEAST_EDIT, LEAST_PART = 0.4, 0.03, 0.5, 0.75
#: Weights of single letters, pairs, pairs with a gap, triples.
WEIGHTS = (2.0, 1.0, 1.0, 0.5)
#: Colloquial names an entry goes by besides its labels, by entry label.
ALIASES = {"e-post": ["meil", "e-mail"]}

_SEPARATOR = re.compile(r"\s*[/|;=]\s*|\s+[-–—]\s+|:\s+|[()\[\]]")
_NOISE = re.compile(r"[^\w\s.\-]+")


def normalise(value: str) -> str:
    """Lower case, composed, single spaces, no punctuation but full stops inside and hyphens."""
    text = unicodedata.normalize("NFKC", value).casefold().replace("­", "")
    return " ".join(_NOISE.sub(" ", text).split())


def compact(text: str) -> str:
    """Letters and digits only, accents off: what typing habits leave alone."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if c.isalnum())


def variants(value: str, most_words: int) -> list[tuple[str, float]]:
    """(part, share of the value it covers): the whole, the pieces around separators and every run of words."""
    whole = normalise(value)
    total = len(compact(whole)) or 1
    best: dict[str, float] = {}

    def add(text: str, cover: float) -> None:
        key = compact(text)
        if key and best.get(key, 0.0) < cover:
            best[key] = cover

    add(whole, 1.0)
    pieces = [normalise(p) for p in _SEPARATOR.split(value) if p and p.strip()]
    for piece in pieces:
        # A piece set apart by a separator says the same again or qualifies it: half of the rest is forgiven.
        add(piece, 0.5 + 0.5 * len(compact(piece)) / total if len(pieces) > 1 else 1.0)
    words = whole.split()
    for n in range(1, min(most_words, len(words) - 1) + 1):
        for i in range(len(words) - n + 1):
            run = " ".join(words[i : i + n])
            add(run, len(compact(run)) / total)
    return list(best.items())


def abbreviates(value: str, label: str) -> bool:
    """Words of `value` stand, in order, for words of `label`: at least one is cut short with a full stop, each other is spelt out."""
    short, words = re.findall(r"\w+\.?", normalise(value)), normalise(label).replace("-", " ").split()
    if len(words) < 2 or not 2 <= len(short) <= len(words) or not any(s.endswith(".") for s in short):
        return False
    at = 0
    for s in short:
        stem = s.rstrip(".")
        if len(stem) < 3:
            return False
        while at < len(words) and not (words[at].startswith(stem) if s.endswith(".") else words[at] == stem):
            at += 1
        if at == len(words):
            return False
        at += 1
    return True


def _grams(text: Column) -> Column:
    """The n-grams of a text with its ends marked, with repeats, each with its weight."""
    t = F.concat(F.lit("^"), text, F.lit("$"))
    weighed = lambda g, w: F.struct(g.alias("gram"), F.lit(w).alias("weight"))
    run = lambda n: F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1)))
    one = F.transform(F.sequence(F.lit(2), F.length(t) - 1), lambda i: weighed(F.substring(t, i, F.lit(1)), WEIGHTS[0]))
    two = F.transform(run(2), lambda i: weighed(F.substring(t, i, F.lit(2)), WEIGHTS[1]))
    gap = F.transform(run(3), lambda i: weighed(F.concat(F.substring(t, i, F.lit(1)), F.lit("_"), F.substring(t, i + 2, F.lit(1))), WEIGHTS[2]))
    three = F.transform(run(3), lambda i: weighed(F.substring(t, i, F.lit(3)), WEIGHTS[3]))
    return F.concat(one, two, gap, three)


def _first_stem(text: str) -> str:
    words = re.findall(r"\w+", normalise(text))
    return words[0][:3] if words else ""


def map_values(values: DataFrame, reference: DataFrame, aliases: dict[str, list[str]] = ALIASES, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(field_name, value, ref_id, score) for each distinct non-blank value.

    values: field_name, value. reference: ref_id, field_name, label, alt_label, short_label. Both sides are
    joined on (field, n-gram), so neither has to fit anywhere; only distinct values take part.
    """
    names = reference.select("ref_id", "field_name", F.explode(F.array("label", "alt_label", "short_label")).alias("name"), F.col("label"))
    extra = [(k, a) for k, v in aliases.items() for a in v]
    if extra:
        more = reference.sparkSession.createDataFrame(extra, "label string, name string")
        names = names.unionByName(reference.select("ref_id", "field_name", "label").join(more, "label").select("ref_id", "field_name", "name", "label"))
    names = names.where("name is not null and trim(name) <> ''").select("ref_id", "field_name", "name").distinct()

    def keyed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(part=[compact(normalise(x)) for x in b["name"]])

    entries = names.mapInPandas(keyed, "ref_id int, field_name string, name string, part string").where("part <> ''")
    longest = names.select(F.max(F.size(F.split(F.trim("name"), r"[\s-]+")))).first()[0] or 1

    def parts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, v, p, c) for f, v in zip(b["field_name"], b["value"]) for p, c in variants(v, longest)]
            yield pd.DataFrame(rows, columns=["field_name", "value", "part", "cover"])

    distinct = cut_lineage(values.where("value is not null and trim(value) <> ''").select("field_name", "value").distinct())
    tried = cut_lineage(distinct.mapInPandas(parts, "field_name string, value string, part string, cover double"))
    entries = cut_lineage(entries)

    grams = lambda df: df.withColumn("g", F.explode(_grams(F.col("part")))).groupBy(*df.columns, F.col("g.gram").alias("gram")).agg(F.sum("g.weight").alias("tf"))
    postings = grams(entries.select("field_name", "ref_id", "part").distinct())
    sizes = entries.groupBy("field_name").agg(F.countDistinct("ref_id", "part").alias("n"))
    idf = postings.groupBy("field_name", "gram").agg(F.count("*").alias("df")).join(sizes, "field_name").select("field_name", "gram", (1 + F.log1p(F.col("n") / F.col("df"))).alias("idf"))
    postings = postings.join(idf, ["field_name", "gram"]).withColumn("w", F.col("tf") * F.col("idf"))
    norms = postings.groupBy("field_name", "ref_id", "part").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    index = cut_lineage(postings.join(norms, ["field_name", "ref_id", "part"]).select("field_name", "gram", "ref_id", F.col("part").alias("entry"), "idf", (F.col("w") / F.col("norm")).alias("u")))

    each = grams(tried.select("field_name", "part").distinct())
    weights = index.select("field_name", "gram", "idf").distinct()
    unseen = sizes.select("field_name", (1 + F.log1p(F.col("n"))).alias("most"))
    each = cut_lineage(each.join(weights, ["field_name", "gram"], "left").join(unseen, "field_name", "left").withColumn("w", F.col("tf") * F.coalesce("idf", "most")).select("field_name", "part", "gram", "w"))
    length = each.groupBy("field_name", "part").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    cosine = (
        each.join(index, ["field_name", "gram"]).groupBy("field_name", "part", "ref_id", "entry").agg(F.sum(F.col("w") * F.col("u")).alias("dot"))
        .where(1 - F.levenshtein("part", "entry") / F.greatest(F.length("part"), F.length("entry")) >= LEAST_EDIT)
        .join(length, ["field_name", "part"]).groupBy("field_name", "part", "ref_id").agg(F.max(F.col("dot") / F.col("norm")).alias("cos"))
    )
    weight = F.when(F.col("cos") > 0.999, 0.6 + 0.4 * F.col("cover")).otherwise(0.5 + 0.5 * F.col("cover"))
    # A part of a value counts only if it is nearly an entry.
    by_part = tried.join(cosine, ["field_name", "part"]).withColumn("score", F.when((F.col("cover") < 1) & (F.col("cos") < LEAST_PART), 0.0).otherwise(F.col("cos") * weight))
    scored = by_part.groupBy("field_name", "value", "ref_id").agg(F.max("score").alias("score"))

    # Abbreviations: a dotted value meets the names that hold a word which begins like its first.
    def stems(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(stem=[_first_stem(v) for v in b["value"]])

    def name_stems(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r, f, n, s) for r, f, n in zip(b["ref_id"], b["field_name"], b["name"]) for s in {w[:3] for w in re.findall(r"\w+", normalise(n))}]
            yield pd.DataFrame(rows, columns=["ref_id", "field_name", "name", "stem"])

    @F.pandas_udf("boolean")
    def is_short_form(value: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([abbreviates(v, n) for v, n in zip(value, name)], dtype=bool)

    dotted = distinct.where("value rlike '\\\\p{L}[.]'").mapInPandas(stems, "field_name string, value string, stem string").join(names.mapInPandas(name_stems, "ref_id int, field_name string, name string, stem string"), ["field_name", "stem"])
    dotted = dotted.where(is_short_form("value", "name")).select("field_name", "value", "ref_id", F.lit(1.0).alias("score")).distinct()
    # A value that is, letter for letter, the label of another field was typed into the wrong one.
    labels = reference.select(F.col("field_name").alias("of_field"), "label").mapInPandas(lambda it: (b.assign(part=[compact(normalise(x)) for x in b["label"]]) for b in it), "of_field string, label string, part string")
    misplaced = tried.where("cover >= 1").join(labels, "part").where("of_field <> field_name").select("field_name", "value").distinct()
    scored = scored.join(misplaced.withColumn("other", F.lit(True)), ["field_name", "value"], "left").where("other is null or score > 0.95").select("field_name", "value", "ref_id", "score")
    scored = scored.unionByName(dotted).groupBy("field_name", "value", "ref_id").agg(F.max("score").alias("score"))
    best = scored.groupBy("field_name", "value").agg(F.max(F.struct("score", "ref_id")).alias("b"), F.collect_list(F.struct("score", "ref_id")).alias("all"))
    second = F.coalesce(F.array_max(F.transform(F.filter("all", lambda x: x["ref_id"] != F.col("b.ref_id")), lambda x: x["score"])), F.lit(0.0))
    chosen = best.select("field_name", "value", F.when((F.col("b.score") >= threshold) & (F.col("b.score") - second >= margin), F.col("b.ref_id")).otherwise(0).alias("ref_id"), F.col("b.score").alias("score"))
    return distinct.join(chosen, ["field_name", "value"], "left").select("field_name", "value", F.coalesce("ref_id", F.lit(0)).alias("ref_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


FIELDS = ["doc_type", "restriction", "delivery_method"]


def _typed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs, reference = read_table(spark, folder, "registry_docs"), read_table(spark, folder, "ref_values")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS]))
    rows = docs.select("id", pairs.alias("x")).select("id", "x.field_name", "x.value").where(F.col("value").isNotNull() & F.col("value").rlike(r"\S"))
    return rows.join(reference.select("field_name", F.col("label").alias("value")), ["field_name", "value"], "left_anti"), reference


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    rows, reference = _typed(spark, folder)
    mapping = map_values(rows, reference).select("field_name", "value", "ref_id")
    return rows.join(mapping, ["field_name", "value"]).select("id", "field_name", F.col("ref_id").cast("int").alias("ref_id")).distinct()


def p7_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The values that mean no entry, with the number of rows that hold them."""
    rows, reference = _typed(spark, folder)
    return map_values(rows, reference).where("ref_id = 0").select("field_name", "value").join(rows, ["field_name", "value"]).groupBy("field_name", "value").agg(F.count("*").alias("n_rows"))


QUERIES = {"p7_found": p7_found, "p7_unmatched": p7_unmatched}
