"""Quoted history and signatures in e-mails (problem 5): only what the sender newly wrote.

Two passes decide about each line of a body.

1. Structure, inside one message: reference headings (attribution lines and forwarded header blocks) open the
   embedded messages of the thread; a heading of mail-program style reaches to the end of the body, an
   attribution reaches over the lines marked with ">"; sign-offs, signatures, disclaimers and device notes end
   what the sender wrote, postscripts resume it.
2. Threads, between messages: a message descends from the one that wrote a line it quotes, by ">" or below a heading
   (the store holds bodies without message ids, so that these references stand for the headers). Exact copies of a body
   count as one message, and of several writers of a line the one with the smallest id stands
   for all, so the joins are on (message, hash) with one side unique and a line that very many messages share pairs
   each of them with one. Ancestors are followed up. A message's new lines are then aligned with those of each
   ancestor: shingles of `SHINGLE` words, found by a rolling hash, are the seeds, seeds grow to the longest equal runs
   of words, and the heaviest chain of runs in one order is the alignment. A line of which `INHERITED` of the words
   are in it, however the lines were broken, is inherited without any mark and removed.

Defined results for odd input: a null or empty body gives no lines; blank lines are never new; lines are counted
from 1 after splitting at "\\n"; a body without any structure is new as a whole; repeated rows give equal lines;
messages with a null id take part in pass 1 only; texts of any length are read whole; columns other than the
two named are not looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regispark.session import cut_lineage, read_table

# Phrases of e-mail customs, Estonian and English.
SIGN_OFFS = [
    "lugupidamisega", "austusega", "tervitades", "tervitustega", "parimat", "parimatega", "parimate soovidega", "parimate tervitustega", "heade soovidega", "kõike head",
    "kena päeva soovides", "kena päeva", "ilusat päeva", "head päeva soovides", "lgp", "lp", "tervitusi", "tänades", "ette tänades",
    "best regards", "kind regards", "warm regards", "regards", "best wishes", "best", "sincerely", "yours sincerely", "yours faithfully", "br", "kr", "с уважением",
]
DEVICE_NOTES = r"^(sent from my \w+|sent from (outlook|mail|yahoo).*|saadetud (minu )?(telefonist|nutiseadmest|nutitelefonist|mobiilist|iphone'?ist|tahvelarvutist)|get outlook for \w+|отправлено с .*)\.?$"
DISCLAIMERS = [
    "konfidentsiaal", "confidential", "intended recipient", "eksituse tõttu", "eksikombel", "üksnes adressaadile", "ainult adressaadile", "piiratud juurdepääsuga teavet", "ametialaseks kasutamiseks",
    "väljatrükki mõtle", "enne väljatrükkimist", "enne printimist", "before printing", "think of the environment", "ei vastuta kirja muutmise", "received this e-mail in error", "received this message in error", "please delete it", "palume see kustutada",
]
HEADER_FIELDS = "from|sent|to|cc|bcc|date|subject|reply-to|saatja|saatmisaeg|saadetud|adressaat|saaja|kellele|kellelt|koopia|teema|kuupäev|lisad|manused|attachments|от|кому|дата|тема|отправлено"
MONTHS = "jaanuar|veebruar|märts|aprill|mai|juuni|juuli|august|september|oktoober|november|detsember|january|february|march|april|may|june|july|october|december"

_DATE = rf"(?:\d{{1,2}}[./]\s?\d{{1,2}}[./]\s?\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}\.? (?:{MONTHS}) \d{{4}})"
_ATTRIBUTION = re.compile(
    rf"^\s*(?:(?:on|op)\s.{{0,80}}{_DATE}.*\bwrote:|on\s.*\bwrote:|.*\bkirjutas(?: kuupäeval)?\s.{{0,40}}{_DATE}.{{0,40}}:|.{{0,40}}{_DATE}.*\bkirjutas:|.*<[^>]*>\s*(?:kirjutas|wrote):|.*\d{{1,2}}:\d{{2}}.*(?:kirjutas|wrote|пишет):)\s*$",
    re.I,
)
_RULE_HEADING = re.compile(r"^\s*-{3,}\s*(?:original message|algne sõnum|algne kiri|edastatud kiri|edastatud sõnum|forwarded message|begin forwarded message|исходное сообщение)\s*-{3,}\s*$", re.I)
_RULE = re.compile(r"^\s*_{5,}\s*$")
_FIELD = re.compile(rf"^\s*\*?(?:{HEADER_FIELDS})\*?\s*:\s*\S", re.I)
_SENDER_FIELD = re.compile(r"^\s*\*?(?:from|saatja|kellelt|от)\*?\s*:\s*\S", re.I)
_SIGN_OFF = re.compile(rf"^\s*(?:{'|'.join(map(re.escape, SIGN_OFFS))})\s*[,.!]?\s*$", re.I)
_DASHES = re.compile(r"^\s*(?:--|—|_{5,}|-{5,}|\*{5,})\s*$")
_DEVICE = re.compile(DEVICE_NOTES, re.I)
_DISCLAIMER = re.compile("|".join(DISCLAIMERS), re.I)
_POSTSCRIPT = re.compile(r"^\s*(?:p\.?\s?p?\.?\s?s\b\.?:?|nb!?|ps:|p\.s\.)\s*\S", re.I)
_GREETING = re.compile(r"^\s*(?:tere|tervist|hello|hi|dear|hea|head|lugupeetud|austatud|lp|kallis|здравствуйте)\b", re.I)
_WORD = r"[A-ZÕÄÖÜŠŽА-Я][\w'’]*(?:-[A-ZÕÄÖÜŠŽА-Я][\w'’]*)*"
_NAME = re.compile(rf"^\s*(?:(?:hr|pr|dr)\.?\s+)?(?:{_WORD}\.?,?\s+){{1,3}}{_WORD}\.?\s*$")
_LOWER_NAME = re.compile(r"^\s*[^\W\d]+(?:-[^\W\d]+)*,? [^\W\d]+(?:-[^\W\d]+)*\s*$")
_SENTENCE_END = re.compile(r"[.!?…]\s*$")


def _quoted(line: str) -> bool:
    return line.lstrip().startswith(">")


class _Lines:
    """The lines of a body up to its embedded message, and what can be said about each in one pass."""

    def __init__(self, lines: list[str], end: int) -> None:
        self.lines, self.end = lines, end
        self.quote = [_quoted(x) for x in lines[:end]]
        self.attribution = [bool(_ATTRIBUTION.match(x)) for x in lines[:end]]
        self.note = [bool(_DEVICE.match(x.strip()) or _DISCLAIMER.search(x)) for x in lines[:end]]
        # Where the block of a line ends, where the next whole sentence stands, and whether only quotes and notes follow.
        self.block, self.sentence, self.over = [end] * (end + 1), [end] * (end + 1), [True] * (end + 1)
        for i in range(end - 1, -1, -1):
            line = lines[i]
            blank = not line.strip()
            self.block[i] = i if blank or self.quote[i] or self.attribution[i] or self.note[i] else self.block[i + 1]
            self.sentence[i] = i if _SENTENCE_END.search(line) and len(line.split()) > 6 else self.sentence[i + 1]
            self.over[i] = self.over[i + 1] and (blank or self.quote[i] or self.attribution[i] or self.note[i] or bool(_POSTSCRIPT.match(line)))

    def signature_at(self, at: int) -> bool:
        """Whether the block that begins at a line is a signature without sign-off, after which nothing is written: a
        name, then a post, body or contacts, but no sentence."""
        stop = self.block[at]
        first = self.lines[at]
        if stop == at or not self.over[stop] or _GREETING.match(first) or (_SENTENCE_END.search(first) and not re.search(r"\b\w\.\s*$", first)):
            return False
        if not _NAME.match(first) and not (_LOWER_NAME.match(first) and stop > at + 1 and not any(_SENTENCE_END.search(x) for x in self.lines[at:stop])):
            return False
        return self.sentence[at + 1] >= stop


SHINGLE = 5  #: words in a row
INHERITED = 0.8
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def heading_at(lines: list[str]) -> int:
    """Place of the heading of mail-program style that opens the embedded message, the number of lines if there is none."""
    n = len(lines)
    for i, line in enumerate(lines):
        if _quoted(line):
            continue
        if _RULE_HEADING.match(line):
            return i
        if _RULE.match(line) and i + 1 < n and _SENDER_FIELD.match(lines[i + 1]):
            return i
        if _SENDER_FIELD.match(line) and i + 1 < n and _FIELD.match(lines[i + 1]) and (i + 2 >= n or _FIELD.match(lines[i + 2]) or not lines[i + 2].strip()):
            return i
    return n


def new_lines(body: str) -> list[int]:
    """Numbers of the lines that are newly written, by the structure of the body."""
    lines = [x.rstrip("\r") for x in body.split("\n")]
    end = heading_at(lines)
    known = _Lines(lines, end)
    out, signed = [], False
    for i in range(end):
        line = lines[i]
        if not line.strip():
            continue
        if known.quote[i] or known.attribution[i]:
            # Text below the quoted part is a new part of the letter.
            signed = signed and not known.attribution[i]
            if known.attribution[i] and i + 1 < end and not any(known.quote[i + 1 : i + 4]):
                break
            continue
        if known.note[i]:
            continue
        if _POSTSCRIPT.match(line):
            signed = False
        if not signed and (_SIGN_OFF.match(line) or _DASHES.match(line)):
            signed = True
            continue
        if not signed and known.signature_at(i):
            signed = True
        if not signed:
            out.append(i + 1)
    return out


def _words(text: str) -> list[str]:
    return re.sub(r"^[>\s]+", "", text).lower().split()


def line_hash(line: str) -> int:
    """Hash of a line's words without quote marks and case, 0 for lines shorter than a shingle, which say too little."""
    words = _words(line)
    return int.from_bytes(blake2b("".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) if len(words) >= SHINGLE else 0


def shingles(words: list[str]) -> list[int]:
    """Rolling hash of every run of SHINGLE words."""
    codes = [int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big") for w in words]
    first, now, out = pow(_BASE, SHINGLE - 1, _PRIME), 0, []
    for i, c in enumerate(codes):
        if i >= SHINGLE:
            now -= codes[i - SHINGLE] * first
        now = (now * _BASE + c) % _PRIME
        if i >= SHINGLE - 1:
            out.append(now)
    return out


def aligned_runs(mine: list[str], theirs: list[str]) -> list[tuple[int, int, int]]:
    """(place in mine, place in theirs, words) of the heaviest chain of equal runs that keeps the order of both.

    Of a shingle that the ancestor has several times the next place after the run before counts, so that a repeated
    phrase makes one seed a place, not all pairs of places.
    """
    where: dict[int, list[int]] = {}
    for j, h in enumerate(shingles(theirs)):
        where.setdefault(h, []).append(j)
    runs: list[tuple[int, int, int]] = []
    i, hashes, last = 0, shingles(mine), 0
    while i < len(hashes):
        places = where.get(hashes[i])
        if not places:
            i += 1
            continue
        k = bisect_left(places, last)
        j = places[k] if k < len(places) else places[0]
        n = 0
        while i + n < len(mine) and j + n < len(theirs) and mine[i + n] == theirs[j + n]:
            n += 1
        if n < SHINGLE:  # the hashes met by chance
            i += 1
            continue
        runs.append((i, j, n))
        last = j + n
        i += n - SHINGLE + 1 if n > SHINGLE else 1
    # The runs are in order of `mine`; the heaviest increasing chain in `theirs` by a running maximum over sorted ends.
    ends: list[int] = []
    best: list[tuple[int, int]] = []  # weight and run of the heaviest chain that ends at or before the end
    before: list[int] = [-1] * len(runs)
    for r, (_, j, n) in enumerate(runs):
        at = bisect_right(ends, j)
        weight, before[r] = (best[at - 1][0] + n, best[at - 1][1]) if at else (n, -1)
        at = bisect_right(ends, j + n)
        if at and best[at - 1][0] >= weight:
            continue
        ends.insert(at, j + n)
        best.insert(at, (weight, r))
        while at + 1 < len(best) and best[at + 1][0] <= weight:
            del ends[at + 1], best[at + 1]
    chain, r = [], best[-1][1] if best else -1
    while r >= 0:
        chain.append(runs[r])
        r = before[r]
    return chain[::-1]


def inherited_lines(own: list[tuple[int, str]], ancestor: list[str]) -> list[int]:
    """Numbers of those lines of `own` that are, however broken, text of the ancestor's lines."""
    words = [(k, w) for k, line in own for w in _words(line)]
    n: dict[int, int] = {}
    for k, _ in words:
        n[k] = n.get(k, 0) + 1
    held = [False] * len(words)
    for i, _, size in aligned_runs([w for _, w in words], [w for line in ancestor for w in _words(line)]):
        held[i : i + size] = [True] * size
    found: dict[int, int] = {}
    for (k, _), h in zip(words, held):
        found[k] = found.get(k, 0) + h
    return [k for k, _ in own if n.get(k) and found[k] >= INHERITED * n[k]]


def new_text_lines(df: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(id, line_no) of the newly written, non-blank lines of every body."""

    def lines(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, body in zip(b["id"], b["body"]):
                own, split = set(new_lines(body)), body.split("\n")
                below = heading_at([x.rstrip("\r") for x in split]) + 1
                copy = int.from_bytes(blake2b(body.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                for k, line in enumerate(split, 1):
                    if k in own:
                        rows.append((key, k, line_hash(line), True, copy))
                    elif (_quoted(line) or k > below) and (h := line_hash(line)) and not _DISCLAIMER.search(line):
                        rows.append((key, k, h, False, copy))
            yield pd.DataFrame(rows, columns=["id", "line_no", "h", "own", "copy"])

    kind = df.schema[id_col].dataType.simpleString()
    bodies = df.select(F.col(id_col).alias("id"), F.col(body_col).cast("string").alias("body")).where("body is not null and body <> ''")
    rows = cut_lineage(bodies.mapInPandas(lines, f"id {kind}, line_no int, h bigint, own boolean, copy bigint"))
    own, keyed = rows.where("own"), rows.where("h <> 0 and id is not null")
    # Reference: the writer of a quoted line. One row a hash, so no key grows; copies of a body are one writer, no message its own source.
    sources = keyed.where("own").groupBy("h").agg(F.min(F.struct("id", "copy")).alias("s")).select("h", F.col("s.id").alias("source"), F.col("s.copy").alias("written"))
    edges = cut_lineage(keyed.where("not own").select("id", "h", "copy").join(sources, "h").where("id <> source and copy <> written").select("id", "source").distinct())
    # Ancestors of ancestors; each round doubles the reach.
    n = edges.count()
    while n:
        up = edges.select(F.col("id").alias("source"), F.col("source").alias("top"))
        edges = cut_lineage(edges.unionByName(edges.join(up, "source").select("id", F.col("top").alias("source")).where("id <> source")).distinct())
        if n == (n := edges.count()):
            break

    def compared(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, body, theirs in zip(b["id"], b["body"], b["theirs"]):
                mine, split, above = new_lines(body), body.split("\n"), theirs.split("\n")
                out += [(key, k) for k in inherited_lines([(k, split[k - 1]) for k in mine], [above[k - 1] for k in new_lines(theirs)])]
            yield pd.DataFrame(out, columns=["id", "line_no"])

    texts = bodies.where("id is not null")
    inherited = (
        edges.join(texts, "id").join(texts.select(F.col("id").alias("source"), F.col("body").alias("theirs")), "source").select("id", "body", "theirs")
        .mapInPandas(compared, f"id {kind}, line_no int").distinct()
    )
    return own.select("id", "line_no").join(inherited, ["id", "line_no"], "left_anti")


def _mails(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "files").where("parsed_with = 'MsgParser' and contents is not null").select("id", "contents")


def reduced(df: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(id, new_text) of every body that is not null: its newly written lines, in order; empty where there are none."""
    bodies = df.select(F.col(id_col).alias("id"), F.col(body_col).cast("string").alias("body")).where("body is not null")
    lines = new_text_lines(bodies, "id", "body").groupBy("id").agg(F.sort_array(F.collect_set("line_no")).alias("at"))

    @F.pandas_udf("string")
    def kept(body: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for text, numbers in zip(body, at):
            split = text.split("\n")
            out.append("" if numbers is None else "\n".join(split[k - 1].rstrip("\r") for k in numbers))
        return pd.Series(out, dtype=object)

    return bodies.join(lines, bodies["id"].eqNullSafe(lines["id"]), "left").select(bodies["id"], kept("body", "at").alias("new_text"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return new_text_lines(_mails(spark, folder), "id", "contents").select(F.col("id").alias("file_id"), "line_no").distinct()


def p5_reduced(spark: SparkSession, folder: str) -> DataFrame:
    """Every mail reduced to what its sender newly wrote."""
    return reduced(_mails(spark, folder), "id", "contents").withColumnRenamed("id", "file_id")


QUERIES = {"p5_found": p5_found, "p5_reduced": p5_reduced}
