"""Visually identical text with different characters (problem 10): script-aware repair.

`unify` brings every text to one form, so that texts which look the same become equal:

1. invisible characters go, every blank becomes a space, wide forms, ligatures and mathematical letters become
   ordinary ones, accents are composed;
2. each token gets its dominant script: that of its letters without a look-alike in another script, or, where it
   has none, the dominant script of the text's such letters (Latin in doubt). These letters are the same in all texts that
   look alike, so the scripts are too;
3. look-alike letters of a token that mixes scripts, or stands in the wrong one, are replaced by those of its
   script, if the result is in the corpus vocabulary, that is occurs as a token in any text. Where it does not, and
   the token is written in several ways, all take the Latin form if that occurs, else the most frequent one.

Nothing else changes: superscripts, lost accents, line breaks and letter case stay as they are. Two texts look the
same if and only if their forms are equal; `look_key` is the hash of the form.

Most texts hold ordinary characters of one script only, are their own form and are never sent to Python for it. Data
sent to all executors: the tokens sought in the vocabulary, if they are at most `MOST_SOUGHT`; more are joined.

Defined results for odd input: a null text stays null and has no key, an empty text stays empty and has none; a text of
invisible characters only becomes empty; ties between scripts go to Latin; repeated rows are kept; other
columns, whatever their names, pass through unchanged; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regispark.session import cut_lineage, read_table

# Characters that show nothing, blanks, hyphens, and letters that look like Latin ones.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿"
BLANK = "\t   -   　"
HYPHEN = "‐‑"
WIDE = "！-￮ﬀ-ﬆ"
CYRILLIC_LIKE = dict(zip("\u0430\u0441\u0435\u043e\u0440\u0443\u0445\u0456\u0458\u0455\u0501\u04bb\u051b\u051d\u04cf\u0475\u0410\u0412\u0415\u041a\u041c\u041d\u041e\u0420\u0421\u0422\u0425\u0406\u0408\u0405\u0423\u050c\u051a\u051c\u0474", "aceopyxijsdhqwlvABEKMHOPCTXIJSYGQWV"))
GREEK_LIKE = dict(zip("\u0391\u0392\u0395\u0396\u0397\u0399\u039a\u039c\u039d\u039f\u03a1\u03a4\u03a5\u03a7\u03bf\u03bd\u037f\u03f3", "ABEZHIKMNOPTYXovJj"))
# Letters of scripts without texts here: Armenian, Cherokee, Lisu, letter variants.
OTHER_LIKE = dict(zip("\u0585\u13aa\u13f4\u13df\u13ac\u13c0\u13bb\u13ab\u13e6\u13de\u13b7\u13e2\u13a1\u13da\u13a2\u13d9\u13b3\u13c3\ua4ee\ua4d0\ua4da\ua4d3\ua4f0\ua4dd\ua4d6\ua4e7\ua4f2\ua4d9\ua4d7\ua4e1\ua4df\ua4e0\ua4f3\ua4d1\ua4e3\ua4e2\ua4d4\ua4f4\ua4e6\ua4ea\ua4eb\ua4ec\ua4dc\u0261", "oABCEGHJKLMPRSTVWZABCDEFGHIJKLMNOPRSTUVWXYZg"))

_INVISIBLE, _BLANK, _WIDE = (re.compile(f"[{x}]") for x in (INVISIBLE, BLANK, WIDE + "\u2160-\u217f\U0001d400-\U0001d7ff"))
_HYPHEN = re.compile(f"[{HYPHEN}]")
_ODD = re.compile(f"[{INVISIBLE}{BLANK}{HYPHEN}{WIDE}\u2160-\u217f\U0001d400-\U0001d7ff\u0300-\u036f]")
_TO_LATIN = {ord(k): v for k, v in (CYRILLIC_LIKE | GREEK_LIKE | OTHER_LIKE).items()}
_FOREIGN = re.compile("[" + "".join(map(chr, _TO_LATIN)) + "\u0370-\u052f]")
_TOKEN = re.compile(r"[^\W_]+(?:[\u0300-\u036f]+[^\W_]*)*")
_FROM_LATIN = {"latin": {}, "cyrillic": {ord(v): k for k, v in CYRILLIC_LIKE.items()}, "greek": {ord(v): k for k, v in GREEK_LIKE.items()}}
_SHARED = set("".join(CYRILLIC_LIKE.values()) + "".join(GREEK_LIKE.values()) + "".join(OTHER_LIKE.values()))
#: Texts of these characters alone are their own form: ordinary Latin letters, digits, signs, spaces and line breaks.
TAME_JVM = r"^[\n\r -~\x{00A1}-\x{00AC}\x{00AE}-\x{0250}\x{2012}-\x{2027}\x{20AC}\x{2116}]*+$"
#: Characters that are, or become in plain form, a letter of another script or a look-alike.
FOREIGN_JVM = r"[\x{0261}\x{0370}-\x{052F}\x{0585}\x{13A0}-\x{13FF}\x{A4D0}-\x{A4FF}\x{FF00}-\x{FFEF}\x{1D400}-\x{1D7FF}]"
MOST_SOUGHT = 200_000


def plain(text: str) -> str:
    """Invisible characters, blanks, hyphens, wide forms and accents in their one form."""
    if _ODD.search(text):
        text = _BLANK.sub(" ", _INVISIBLE.sub("", text))
        text = _HYPHEN.sub("-", _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text))
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def skeleton(text: str) -> str:
    """What a reader sees: `plain`, with the Latin letter for all its look-alikes."""
    text = plain(text)
    if not _FOREIGN.search(text):
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_TO_LATIN))


def _distinct(first: int, last: int) -> re.Pattern:
    """Letters of a range that no other script has, accents or not."""
    return re.compile("[" + "".join(chr(o) for o in range(first, last) if chr(o).isalpha() and ord(unicodedata.normalize("NFD", chr(o))[0]) not in _TO_LATIN) + "]")


_DISTINCT = {"cyrillic": _distinct(0x400, 0x530), "greek": _distinct(0x370, 0x400)}
_LATIN_DISTINCT = re.compile("[" + "".join(c for c in map(chr, range(65, 123)) if c.isalpha() and c not in _SHARED) + "]")


def dominant(text: str, doubt: str = "latin") -> str:
    """The script of most letters, of a text in plain form or its skeleton, that no other script has; `doubt` if it has none."""
    n = {"latin": len(_LATIN_DISTINCT.findall(text)), "cyrillic": len(_DISTINCT["cyrillic"].findall(text)), "greek": len(_DISTINCT["greek"].findall(text))}
    best = max(n, key=lambda s: n[s])
    return best if n[best] else doubt


def form_of(token_skeleton: str, doubt: str = "latin") -> str:
    """A token in its dominant script."""
    letters = _FROM_LATIN[dominant(token_skeleton, doubt)]
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", token_skeleton).translate(letters)) if letters else token_skeleton


@lru_cache(maxsize=200_000)
def _looks(token: str, doubt: str) -> tuple[str, str]:
    skel = skeleton(token)
    return skel, form_of(skel, doubt)


def tokens_to_place(text: str) -> dict[str, tuple[str, str]]:
    """token -> (skeleton, form in its script) of those tokens of a text in plain form that could be written otherwise."""
    if not _FOREIGN.search(text):
        return {}
    doubt = dominant(text)
    out = {}
    for token in set(_TOKEN.findall(text)):
        if doubt != "latin" or (not token.isascii() and _FOREIGN.search(token)):
            skel, form = _looks(token, doubt)
            if form != token or skel != token:
                out[token] = (skel, form)
    return out


def _odd(text):
    return F.coalesce(~text.rlike(TAME_JVM), F.lit(False))


def placed_tokens(tokens: DataFrame, texts: DataFrame) -> DataFrame:
    """(token, form, written): how each token is to be written that is not written so already.

    tokens: token, skel, form, of all texts with letters of several scripts; texts: text, all of the corpus.
    """
    rows = cut_lineage(tokens.groupBy("token", "skel", "form").agg(F.count("*").alias("n")))
    # Only what is not in its form, or shares its look with something that is not, has to be looked up.
    open_looks = rows.where("token <> form").select("skel").distinct()
    rows = rows.join(open_looks, "skel", "left_semi")
    sought = cut_lineage(rows.select(F.explode(F.array("skel", "form")).alias("word")).distinct())
    known = None
    if sought.count() <= MOST_SOUGHT:
        known = texts.sparkSession.sparkContext.broadcast({r["word"] for r in sought.collect()})

    def words(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: set[str] = set()
        for batch in batches:
            for t in batch["text"]:
                own = set(_TOKEN.findall(plain(t)))
                found |= own if known is None else own & known.value
            if len(found) > 200_000:
                yield pd.DataFrame({"word": list(found)}, dtype=object)
                found = set()
        yield pd.DataFrame({"word": list(found)}, dtype=object)

    if known is not None and not known.value:
        return texts.sparkSession.createDataFrame([], "token string, form string, written string")
    occurs = texts.mapInPandas(words, "word string").distinct().join(sought, "word", "left_semi")
    most = rows.groupBy("skel").agg(F.min(F.struct((-F.col("n")).alias("n"), "token")).alias("most")).select("skel", F.col("most.token").alias("most"))
    written = (
        rows.join(occurs.select(F.col("word").alias("form"), F.lit(True).alias("form_occurs")), "form", "left")
        .join(occurs.select(F.col("word").alias("skel"), F.lit(True).alias("skel_occurs")), "skel", "left").join(most, "skel")
        .select("token", "form", F.when(F.col("form_occurs"), F.col("form")).when(F.col("skel_occurs"), F.col("skel")).otherwise(F.col("most")).alias("written"))
    )
    return written.where("written <> token").distinct()


def unify(df: DataFrame, text_col: str, out_col: str | None = "text_norm", key_col: str = "look_key") -> DataFrame:
    """`df` with the text's consistent form and its key; with out_col None the key alone.

    Only texts with characters beyond ordinary Latin ones go through Python. Of these, only the ones with a token to be
    written otherwise are joined with `placed_tokens`, by a hash of the text, so that exact copies are repaired once and
    no text travels with more than its own tokens.
    """
    text = F.col(f"`{text_col}`").cast("string")
    place = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("token", "skel", "form")]))

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else plain(t) for t in texts], dtype=object)

    @F.pandas_udf(place)
    def to_place(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"token": a, "skel": s, "form": f} for a, (s, f) in sorted(tokens_to_place(plain(t)).items())] for t in texts], dtype=object)

    @F.pandas_udf("string")
    def fixed(texts: pd.Series, tokens: pd.Series, forms: pd.Series) -> pd.Series:
        norm = []
        for t, a, b in zip(texts, tokens, forms):
            by = {} if a is None else dict(zip(a, b))
            norm.append(_TOKEN.sub(lambda m, by=by: by.get(m[0], m[0]), plain(t)) if by else plain(t))
        return pd.Series(norm, dtype=object)

    own = [F.col(f"`{c}`") for c in df.columns]
    tame = df.where(~_odd(text)).withColumn("__n", text)
    odd = cut_lineage(df.where(_odd(text)))
    foreign = F.coalesce(text.rlike(FOREIGN_JVM), F.lit(False))
    h = F.struct(F.xxhash64(text), F.length(text), F.crc32(F.encode(text, "UTF-8")))
    texts = odd.where(foreign).select(text.alias("t")).withColumn("h", F.struct(F.xxhash64("t"), F.length("t"), F.crc32(F.encode("t", "UTF-8")))).dropDuplicates(["h"])
    tokens = cut_lineage(texts.select("h", F.explode(to_place("t")).alias("p")).select("h", "p.token", "p.skel", "p.form"))
    placed = placed_tokens(tokens.select("token", "skel", "form"), df.select(text.alias("text")).where("text is not null and text <> ''"))
    by_text = tokens.join(placed, ["token", "form"]).groupBy("h").agg(F.collect_list("token").alias("__a"), F.collect_list("written").alias("__b")).withColumnRenamed("h", "__h")
    odd_rows = odd.where(~foreign).withColumn("__n", form(text))
    foreign_rows = odd.where(foreign).withColumn("__h", h).join(by_text, "__h", "left").withColumn("__n", fixed(text, F.col("__a"), F.col("__b")))
    every = tame.select(*own, "__n").unionByName(odd_rows.select(*own, "__n")).unionByName(foreign_rows.select(*own, "__n"))
    return every.select(*own, *([F.col("__n").alias(out_col)] if out_col else []), F.when(text != "", F.md5(F.encode("__n", "UTF-8"))).alias(key_col))


def same_look_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_a, doc_b): documents that look the same but differ in characters, the smaller id first.

    Exact copies share a class, so keys with one class (copies only) end before any pair is made.
    """
    rows = cut_lineage(
        unify(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("raw")).where("id is not null and text <> ''"), "text", out_col=None)
        .where("look_key is not null")
        .select("id", "look_key", "raw")
    )
    keys = rows.groupBy("look_key").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("look_key")
    rows = cut_lineage(rows.join(keys, "look_key"))
    a, b = rows.select("look_key", F.col("id").alias("doc_a"), F.col("raw").alias("raw_a")), rows.select("look_key", F.col("id").alias("doc_b"), F.col("raw").alias("raw_b"))
    return a.join(b, "look_key").where("doc_a < doc_b and raw_a <> raw_b").select("doc_a", "doc_b").distinct()


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_look_pairs(read_table(spark, folder, "documents"), "doc_id", "text")


def p10_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's consistent form."""
    return unify(read_table(spark, folder, "documents"), "text").select("doc_id", "text_norm", "look_key")


QUERIES = {"p10_found": p10_found, "p10_unified": p10_unified}
