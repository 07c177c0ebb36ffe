"""Personal information inside free text (problem 4).

Patterns propose spans, validators confirm them, context words adjust their score; spans of `ACCEPT` or more are
kept, the surer one where two overlap. Kinds: e-mail addresses (also spelt out), phone numbers, identity codes
(birth date and check digit must hold), street and farm addresses, persons' names, and card and account numbers, which
Luhn and mod-97 confirm; no part of these passes for a phone number.

Given names are learned: those that stand before a surname in mail headings and salutations of all texts make up
the lexicon, together with the endings of the surnames. `LEAST_SHARE` bounds both by 1 / LEAST_SHARE entries,
whatever the size of the corpus; they are the only data broadcast.

Defined results for odd input: null and empty texts give no span and stay as they are; a text of any length is
scanned whole; equal spans at different places are separate rows of `find_pii`; repeated rows give equal rows;
overlapping proposals of equal score go to the longer, then to the earlier; columns other than those named are not
looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regispark.llm.names import trans_actors
from regispark.llm.parties import INSTITUTIONS, SHORT_NAMES, FORMS, edits, fold, head_of
from regispark.session import read_table

ACCEPT = 0.5
LEAST_SHARE = 1e-5
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "idcode": "[IDCODE]", "address": "[ADDRESS]", "name": "[NAME]", "card": "[CARD]", "account": "[ACCOUNT]"}
KINDS = ["email", "phone", "idcode", "address", "name"]  #: those asked for; cards and accounts are masked besides

_UP, _LOW = "A-ZÀ-ÖØ-ÞŠŽА-ЯЁ", "a-zß-öø-ÿšžа-яё"
_L = f"[{_UP}{_LOW}]"
_AT = r"(?:@|\s?\(\s?(?:at|ät)\s?\)\s?|\s?\[\s?(?:at|ät)\s?\]\s?)"
_DOT = r"(?:\.|\s?\[\s?(?:punkt|dot)\s?\]\s?|\s?\(\s?(?:punkt|dot)\s?\)\s?)"
_EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9_][\w.+-]*{_AT}[A-Za-z0-9][\w-]*(?:{_DOT}[A-Za-z0-9][\w-]*)+", re.A)
_PREFIX = r"(?:\(\+\d{1,3}\)|\+\d{1,3}|\(00\d{1,3}\)|00\d{3})"
_PHONE = re.compile(rf"(?<![\w+(])(?<!\d )(?<!\d[.,/-])(?:(?P<cc>{_PREFIX})[\s-]?)?(?P<no>\d{{3,4}}-\d{{3,4}}|\d{{4}} \d{{4}}|\d{{4}} \d{{3}}|\d{{3}} \d{{4}}|\d{{3}} \d{{2}} \d{{2}}|\d{{3}}-\d{{2}}-\d{{2}}|\d{{7,8}})(?![\w-]*\d)(?! \d)(?![.,/]\d)")
#: Numbers of other countries: prefix and two to six groups.
_ABROAD = re.compile(r"(?<![\w+(])(?:\(\+(?!372)\d{1,3}\)|\+(?!372)\d{1,3})(?:[ -]?\(?\d{1,4}\)?){2,6}(?![\w-]*\d)")
_IDCODE = re.compile(r"(?<![\d-])(?<!\d )\d{7}[ -]?\d{4}(?![\d-])(?! ?\d)")
_ACCOUNT = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b|\b\d(?:[ -]?\d){12,18}\b")
_PLACE = rf"[{_UP}]{_L}+(?:-{_L}+)*"
_AREA = r"(?:\s(?:küla|alevik|alev|vald|linn|linnaosa|maakond))"
_STREET_TYPE = r"(?:tänav|tn\.?|tee|pst\.?|puiestee|mnt\.?|maantee|allee|põik|plats|väljak|rada)"
_TAIL = rf"(?:,\s(?:\d{{5}}\s)?{_PLACE}{_AREA}?(?:\s\d{{5}})?(?:,\s{_PLACE}{_AREA})*(?:,?\s\d{{5}})?)"
_STREET = re.compile(
    rf"(?<![\w-])(?P<street>{_PLACE})(?P<type>\s{_STREET_TYPE})?\s\d{{1,4}}[a-zA-Z]?(?:[-/]\d{{1,4}}[a-z]?)?(?:\s(?:krt|korter|k)\.?\s?\d{{1,4}}[a-z]?)?(?P<tail>{_TAIL})?(?!\w)"
)
_FARM = re.compile(rf"(?<![\w-]){_PLACE}\s(?:talu|mõis|kinnistu)(?:,\s{_PLACE}{_AREA})+(?:,?\s\d{{5}})?")
_NAME_WORD = rf"{_L}+(?:[-'’]{_L}+)*"

# Words that speak for or against the number or name beside them.
PHONE_WORDS = re.compile(r"(?:\btel(?:efon)?|\bmob(?:iil)?|\bgsm|\bphone|\bfaks|\bfax|\bt|\bnumbril|\bhelista\w*|\bühendust|тел)[.:]?\s*$|/\s*$", re.I)
NO_PHONE_WORDS = re.compile(r"(?:registrikood|reg|viitenumber|viide|arve|nr|no|number on|tellimuse|konto|toimik\w*|asi|katastri\w*|summa|kood|punkt\w*|maht on|isikukood|eurot|jaanuar|veebruar|märts|aprill|mai|juuni|juuli|august|september|oktoober|november|detsember)\.?:?\s*$", re.I)
NO_NAME_WORDS = {
    "lugupeetud", "austatud", "tere", "tervist", "hello", "hea", "head", "best", "kind", "regards", "parimat", "tervitades", "lugupidamisega", "from", "sent", "subject", "date", "saatja", "kellelt", "teema", "adressaat", "hr", "pr", "härra", "proua",
    "on", "to", "kiri", "arve", "leping", "kontaktisik", "taotleja", "avaldaja", "kohtusime", "lisateavet", "objekti", "dokumendid", "tel", "mob", "nr", "lp",
}
FIRM_WORDS = {"ou", "as", "mtu", "sa", "osauhing", "aktsiaselts", "sihtasutus", "mittetulundusuhing", "fie", "tu"}
BODY_WORDS = {fold(w) for w in INSTITUTIONS} | {"talitus", "osakond", "juhtkond", "tootajad", "isik", "eraisik", "adressaadid", "nimekirjale", "koda", "moõtekoda", "ühendamet", "teenused", "kuuria", "maakohus", "ringkonnakohus", "buroo", "komisjon", "noukogu"}


def id_code_holds(code: str) -> bool:
    """Century and sex, birth date and check digit of an Estonian identity code."""
    d = [int(c) for c in code if c.isdigit()]
    if len(d) != 11 or not 1 <= d[0] <= 8:
        return False
    try:
        date(1800 + 100 * ((d[0] - 1) // 2) + d[1] * 10 + d[2], d[3] * 10 + d[4], d[5] * 10 + d[6])
    except ValueError:
        return False
    for weights in ((1, 2, 3, 4, 5, 6, 7, 8, 9, 1), (3, 4, 5, 6, 7, 8, 9, 1, 2, 3)):
        rest = sum(a * b for a, b in zip(d, weights)) % 11
        if rest < 10:
            return rest == d[10]
    return d[10] == 0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed([int(c) for c in digits if c.isdigit()])):
        total += c if i % 2 == 0 else (2 * c - 9 if c > 4 else 2 * c)
    return total % 10 == 0


def mod97(account: str) -> bool:
    text = "".join(account.split()).upper()
    return text[:2].isalpha() and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


class Lexicon:
    """Given names (folded) and surname endings."""

    def __init__(self, given: Iterable[str], endings: Iterable[str]) -> None:
        self.given = set(given)
        self.short = {fold(s) for k, v in SHORT_NAMES.items() if fold(k).split("-")[0] in self.given for s in v.split()}
        self.endings = set(endings)
        self.begun = {g[:n] for g in self.given for n in (2, 3, 4)}
        #: Given names by each third of their letters: two edits leave one third as it is, at most two places off.
        self.thirds: dict[tuple[int, int, str], list[str]] = {}
        for g in self.given:
            cuts = [len(g) * k // 3 for k in range(4)]
            for k in range(3):
                self.thirds.setdefault((len(g), k, g[cuts[k] : cuts[k + 1]]), []).append(g)
        self.slips: dict[str, bool] = {}

    def is_misspelt(self, word: str) -> bool:
        """Whether a word is a given name but for a slip or two."""
        hit = self.slips.get(word)
        if hit is None:
            if len(self.slips) > 200_000:
                self.slips.clear()
            hit = self.slips[word] = self._misspelt(word)
        return hit

    def _misspelt(self, word: str) -> bool:
        most = 2 if len(word) > 5 else 1
        for n in range(max(1, len(word) - most), len(word) + most + 1):
            cuts = [n * k // 3 for k in range(4)]
            for k in range(3):
                for off in range(-most, most + 1):
                    if (at := cuts[k] + off) < 0:
                        continue
                    for g in self.thirds.get((n, k, word[at : cuts[k + 1] + off]), ()):
                        if (g[0] == word[0] or g[1:3] == word[1:3]) and edits(word, g, most) <= most:
                            return True
        return False

    def is_given(self, word: str) -> bool:
        w = fold(word)
        return w in self.given or w in self.short or ("-" in w and w.split("-")[0] in self.given)

    def is_surname(self, word: str) -> bool:
        return len(word) >= 6 and fold(word)[-4:] in self.endings


_PAIR = re.compile(rf"(?<![\w.@-])({_NAME_WORD}|{_L}\.|[{_UP}][{_LOW}]{{1,3}}\.)(,?)([ ]{{1,2}})(?:({_L}\.)\s)?({_NAME_WORD}|{_L}\.)(?![\w@-])(?!\.\w)(?!\s?[\[(]at)")


_AFTER = re.compile(r"\s?[\"”]?,?\s?([^\W\d]+)")
_ENDING = re.compile(r"[^\S\n]*(?:\Z|\n|[,;(<\[]|-\s|tel|ik|kirjutas|wrote)")


def _shape(word: str) -> str:
    bare = word.rstrip(".")
    return "upper" if bare.isupper() and len(bare) > 1 else "title" if bare[:1].isupper() else "lower"


def names_in(text: str, lex: Lexicon) -> Iterator[tuple[int, int, float]]:
    """Proposed names: (start, end, score)."""
    at = 0
    while m := _PAIR.search(text, at):
        a, comma, _, middle, b = m.groups()
        at = m.end(1)
        if fold(a) in NO_NAME_WORDS or fold(b.rstrip(".")) in NO_NAME_WORDS:
            continue
        after = _AFTER.match(text, m.end())
        if fold(b) in FIRM_WORDS | BODY_WORDS or fold(a) in FIRM_WORDS | BODY_WORDS or (after and not comma and fold(after[1]) in FIRM_WORDS):
            continue
        before = re.search(r"([^\W\d]+)[\s\"“„]$", text[max(0, m.start() - 30) : m.start()])
        if before and fold(before[1]) in {"ou", "mtu", "osauhing", "aktsiaselts"}:
            continue
        sa, sb = _shape(a), _shape(b)
        score = 0.0
        if a.endswith("."):  # an initial or a cut given name
            if (len(a) == 2 or fold(a[:-1]) in lex.begun) and not b.endswith(".") and (lex.is_surname(b) or (sb != "lower" and len(b) > 4 and len(a) == 2)) and (sa != "lower" or sb == "lower"):
                score = 0.8 if lex.is_surname(b) else 0.5
        elif b.endswith("."):
            if lex.is_surname(a) and len(b) == 2 and sa != "lower":
                score = 0.6 if _ENDING.match(text, m.end()) else 0.0
        elif lex.is_given(a) and not comma:
            if lex.is_surname(b):
                score = 0.9 if sa == sb or "upper" in (sa, sb) or sb == "title" else 0.0
            elif sa == "title" and sb in ("title", "upper") and len(b) > 3 and not lex.is_given(b):
                score = 0.5
        elif lex.is_given(b) and not middle:
            if lex.is_surname(a) and sa != "lower":
                score = 0.9
            elif comma and lex.is_surname(a) and sa == sb == "lower":
                score = 0.7
            elif lex.is_surname(a) and sa == sb == "lower":
                score = 0.7
        if score >= ACCEPT:
            yield m.start(1), m.end(5), score
            at = m.end()


def party_name(value: str, lex: Lexicon) -> tuple[int, int] | None:
    """Where a counterparty value holds a person's name at its beginning, typos and all."""
    head = head_of(value)
    start = value.find(head)
    m = re.match(r"\s*(?:hr|pr|härra|proua)\.?\s+", head, re.I)
    if m:
        start, head = start + m.end(), head[m.end() :]
    words = re.findall(r"[^\s,]+", head)
    bare = [fold(w.strip(".,\"'„“”")) for w in words]
    if not 2 <= len(words) <= 3 or any(b in FIRM_WORDS or b in BODY_WORDS for b in bare) or any(w.casefold() in FORMS or "\"" in w for w in words) or any(c.isdigit() for c in head):
        return None
    score = 0.0
    for w, b in zip(words, bare):
        others = [x for x in bare if x is not b]
        if lex.is_given(b):
            score += 0.6
        elif w.endswith(".") and len(b) == 1:
            score += 0.5 if any(x[-4:] in lex.endings for x in others) else 0
        elif w.endswith(".") and len(b) in (2, 3) and b in lex.begun and w is words[0]:
            score += 0.5
        elif len(b) > 3 and b[-4:] not in lex.endings and lex.is_misspelt(b.split("-")[0]):
            score += 0.5
    return (start, start + len(head)) if score >= ACCEPT else None


def pii_spans(text: str, lex: Lexicon, party: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every piece of personal information, in order of place."""
    found: list[tuple[float, int, int, str]] = []
    for m in _EMAIL.finditer(text):
        found.append((1.0, m.start(), m.end(), "email"))
    for m in _ACCOUNT.finditer(text):
        digits = re.sub(r"\D", "", m[0])
        if mod97(m[0]) if m[0][:2].isalpha() else (len(digits) >= 13 and luhn(digits)):
            found.append((0.95, m.start(), m.end(), "account" if m[0][:2].isalpha() else "card"))
    for m in _IDCODE.finditer(text):
        if id_code_holds(m[0]):
            found.append((0.9, m.start(), m.end(), "idcode"))
    for m in _PHONE.finditer(text):
        before = text[max(0, m.start() - 24) : m.start()]
        score = 0.9 if m["cc"] else 0.2 if m["no"].isdigit() else 0.55
        score += 0.3 if PHONE_WORDS.search(before) else -0.5 if NO_PHONE_WORDS.search(before) and not m["cc"] else 0.0
        if 7 <= len(re.sub(r"\D", "", m["no"])) <= 8:
            found.append((min(score, 0.89), m.start(), m.end(), "phone"))
    for m in _ABROAD.finditer(text):
        if 8 <= len(re.sub(r"\D", "", m[0])) <= 15:
            found.append((0.87, m.start(), m.end(), "phone"))
    for m in _FARM.finditer(text):
        found.append((0.88, m.start(), m.end(), "address"))
    for m in _STREET.finditer(text):
        score = (0.45 if m["type"] else 0.2) + (0.4 if m["tail"] else 0.1 if m["type"] else 0)
        found.append((score, m.start(), m.end(), "address"))
    whole = party_name(text, lex) if party else None
    if whole:
        found.append((0.85, *whole, "name"))
    for a, b, score in names_in(text, lex):
        if not (whole and a < whole[1] and b > whole[0]):
            found.append((score * 0.9, a, b, "name"))
    kept: list[tuple[int, int, str]] = []
    for score, a, b, kind in sorted(found, key=lambda x: (-x[0], x[1] - x[2], x[1])):
        if score >= ACCEPT * (0.9 if kind == "name" else 1) and not any(a < y and b > x for x, y, _ in kept):
            kept.append((a, b, kind))
    return sorted(kept)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by the placeholder of its kind."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDER[kind]]
        at = b
    return "".join([*out, text[at:]])


_HEADING = re.compile(
    rf"^[> ]*(?:saatja|from|kellelt|to|adressaat|cc): ({_NAME_WORD}) ({_NAME_WORD})(?=\s*(?:[<\[]|$))|^[> ]*(?:lugupeetud|austatud|dear) ({_NAME_WORD}) ({_NAME_WORD})\s?!|^[> ]*(?:on .{{10,40}}, )?({_NAME_WORD}) ({_NAME_WORD})(?: <.*>)? (?:kirjutas|wrote)\b",
    re.I | re.M,
)


def learn_lexicon(texts: DataFrame, col: str) -> Lexicon:
    """Given names and surname endings of the headings and salutations of all texts."""

    def words(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[tuple[str, str], int] = {}
        for b in batches:
            for text in b["text"]:
                for m in _HEADING.finditer(text):
                    a, s = next((m[i], m[i + 1]) for i in (1, 3, 5) if m[i])
                    if fold(a) in NO_NAME_WORDS or len(a) < 3 or fold(s) in BODY_WORDS:
                        continue
                    for key in (("given", fold(a).split("-")[0]), ("ending", fold(s)[-4:])):
                        n[key] = n.get(key, 0) + 1
        yield pd.DataFrame([(k, w, c) for (k, w), c in n.items()], columns=["kind", "word", "n"])

    counts = texts.select(F.col(col).cast("string").alias("text")).where("text is not null").mapInPandas(words, "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n"))
    total = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    least = F.greatest(F.lit(2), F.col("total") * F.when(F.col("kind") == "given", LEAST_SHARE).otherwise(LEAST_SHARE * 50))
    rows = counts.join(F.broadcast(total), "kind").where(F.col("n") >= least).select("kind", "word").collect()
    return Lexicon([r["word"] for r in rows if r["kind"] == "given"], [r["word"] for r in rows if r["kind"] == "ending"])


def find_pii(df: DataFrame, text_col: str, lexicon: Lexicon, keep: Iterable[str] = (), party: bool = False) -> DataFrame:
    """keep, kind, pii_value, at (place from 0) of every span in `text_col`."""
    keep = list(keep)
    lex = df.sparkSession.sparkContext.broadcast(lexicon)

    def spans(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b["__text"]):
                for x, y, kind in pii_spans(text, lex.value, party) if text else ():
                    at.append(i)
                    rows.append((kind, text[x:y], x))
            out = pd.DataFrame(rows, columns=["kind", "pii_value", "at"])
            yield pd.concat([b[keep].iloc[at].reset_index(drop=True), out], axis=1)

    source = df.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), "kind string, pii_value string, at int"])
    return source.mapInPandas(spans, schema)


def mask_pii(df: DataFrame, text_col: str, lexicon: Lexicon, out_col: str = "masked", party: bool = False) -> DataFrame:
    """`df` with the text in which every span is a placeholder."""
    lex = df.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return pd.Series([mask(t, pii_spans(t, lex.value, party)) if t else t for t in texts], dtype=object)

    return df.withColumn(out_col, masked(F.col(f"`{text_col}`").cast("string")))


def _sources(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, Lexicon]:
    mails = read_table(spark, folder, "files").where("parsed_with = 'MsgParser' and contents is not null").select("id", "contents")
    actors = trans_actors(read_table(spark, folder, "rmk_records"), ["fetch_id"])
    return mails, actors, learn_lexicon(mails, "contents")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    mails, actors, lex = _sources(spark, folder)
    a = find_pii(mails, "contents", lex, ["id"]).select(F.lit("files").alias("tbl"), F.col("id").alias("row_id"), "kind", "pii_value")
    b = find_pii(actors, "value", lex, ["fetch_id"], party=True).select(F.lit("rmk_records").alias("tbl"), F.col("fetch_id").alias("row_id"), "kind", "pii_value")
    return a.unionByName(b).where(F.col("kind").isin(KINDS)).distinct()


def p4_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Every mail and every decoded counterparty with its personal information replaced, keyed as in `p4_found`."""
    mails, actors, lex = _sources(spark, folder)
    a = mask_pii(mails, "contents", lex).select(F.lit("files").alias("tbl"), F.col("id").alias("row_id"), "masked")
    b = mask_pii(actors, "value", lex, party=True).select(F.lit("rmk_records").alias("tbl"), F.col("fetch_id").alias("row_id"), "masked")
    return a.unionByName(b)


QUERIES = {"p4_found": p4_found, "p4_masked": p4_masked}
