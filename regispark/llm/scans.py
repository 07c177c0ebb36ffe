"""Noise in text from scanned pages (problem 3): repair into continuous paragraphs.

1. Words are counted over all texts, words broken at line ends joined first. The frequent ones are the vocabulary.
2. Skip-gram vectors of the vocabulary: skip-gram with negative sampling factorises the matrix of pointwise mutual
   information of words and their neighbours (Levy and Goldberg 2014), so the vectors are had by counting all
   neighbours within two words and a truncated singular value decomposition.
3. A word is linked to the more frequent words that a plausible misreading of glyphs turns into it, if they are
   `RATIO` times as frequent or the vectors say that both are used alike. Where several fit, the neighbours' vectors
   decide. A word with no such link (a name) is judged by a model of letter
   triples of all words, and changed only if a misreading explains it far better.
4. Page-number lines and running headers are found by shape, by place at a page boundary and by repetition,
   then the rest is reflowed.

Bounds on what is broadcast: `MOST_WORDS` vocabulary entries (a word takes part if it makes up 1 / MOST_WORDS of all
words) with `DIMENSIONS` small numbers each, and the letter triples of the alphabets. Every vocabulary
word is a row of the matrix and counts as a neighbour: the `CONTEXTS` most frequent have a column each, the others share
as many. Rows stay in the executors: the driver receives sums over them and the finished vectors.

Defined results for odd input: null and empty texts give no finding and stay as they are; a text of blank lines
gives no finding; ties between candidates go to the more frequent, then to the first in binary order; repeated
rows give equal findings; very long texts are read whole; an empty table gives an empty table; columns other
than the two named are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regispark.session import cut_lineage, read_table

MOST_WORDS = 1_000_000
LEAST_COUNT = 5
CONTEXTS, DIMENSIONS = 512, 48
COLUMNS = 2 * CONTEXTS
RATIO = 15
ALIKE = 0.8  #: cosine from which two words are used alike
NAME_GAIN = 3.0
RARE_STEP = math.log(0.006)

# What a scanner reads -> what stood there.
GLYPHS = [
    ("n", "u"), ("u", "n"), ("5", "s"), ("c", "e"), ("f", "t"), ("1", "l"), ("1", "i"), ("0", "o"), ("6", "õ"), ("9", "g"), ("cl", "d"), ("rn", "m"), ("m", "rn"), ("li", "h"), ("h", "li"), ("a", "ä"), ("o", "õ"), ("o", "ö"), ("u", "ü"),
    ("l", "i"), ("i", "l"), ("vv", "w"), ("ii", "ü"), ("8", "B"), ("0", "O"), ("5", "S"), ("1", "I"), ("l", "I"), ("e", "c"), ("t", "f"), ("s", "š"), ("z", "ž"), ("A", "Ä"), ("O", "Õ"), ("O", "Ö"), ("U", "Ü"),
]
#: The misreadings that alone may change a word without any frequent relative.
STRONG = {("n", "u"), ("c", "e"), ("f", "t"), ("cl", "d"), ("rn", "m"), ("li", "h"), ("h", "li"), ("a", "ä"), ("5", "s"), ("1", "l"), ("1", "i"), ("0", "o"), ("6", "õ"), ("9", "g"), ("8", "B"), ("0", "O"), ("5", "S"), ("1", "I")}
EDGE = ".,;:()\""
HYPHENS = "-¬­‐"
_N = r"[\dlIoO]{1,4}"
_NUMBER_LINE = re.compile(
    rf"^[\x0c\s]*(?:(?:lk|[1lI]k|lehek[uü][l1I]g|leht|page|p)\.?\s*{_N}(?:\s?/\s?{_N})?|{_N}\s?/\s?{_N}|[-–—]\s?{_N}\s?[-–—]|\[\s?{_N}\s?\]|\d{{1,4}})\s*$",
    re.I,
)
_PLAIN_NUMBER = re.compile(r"^[\x0c\s]*(\d{1,4})\s*$")
_ENDS = re.compile(r"[.,;:!?]$")
_REFERENCE = re.compile(r"[\dlIoO]+-[\dlIoO]+(?:[./][\dlIoO]+)+")
_LETTERS = re.compile(r"[^\W\d_]")


def _header_shape(line: str) -> bool:
    """A line that could be a running header: short, begins large, is no sentence and more than a bare word."""
    s = line.strip("\x0c ")
    if len(s) < 4 or _ENDS.search(s) or not (s[0].isupper() or s[0].isdigit() or line.startswith("\x0c")):
        return False
    words = s.split()
    if len(words) < 2:
        return False
    large = sum(w[0].isupper() or w[0].isdigit() or w in "–-" for w in words)
    return large == len(words) or ("–" in words and large >= len(words) - 1) or (len(words) <= 4 and bool(_REFERENCE.fullmatch(words[-1])))


def _alike(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 2:
        return False
    wrong = sum(x != y for x, y in zip(a, b)) if len(a) == len(b) else None
    if wrong is not None and wrong <= 2:
        return True
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 3


def furniture(lines: list[str]) -> set[int]:
    """Places of running headers and page-number lines."""
    full = [k for k, x in enumerate(lines) if x.strip("\x0c \t\r")]
    if not full:
        return set()
    at = {k: i for i, k in enumerate(full)}
    near = lambda k, d: full[at[k] + d] if 0 <= at[k] + d < len(full) else None
    shaped = {k for k in full if _header_shape(lines[k])}
    numbers, plain = set(), []
    for k in full:
        if not _NUMBER_LINE.match(lines[k]):
            continue
        m = _PLAIN_NUMBER.match(lines[k])
        if not m:
            if re.search(r"\d|/|\[", lines[k]):
                numbers.add(k)
            continue
        before = near(k, -1)
        # A cell of a table stands right below the one item that follows the table's head.
        head = near(k, -2)
        cell = before is not None and head is not None and not lines[k].startswith(" ") and not _NUMBER_LINE.match(lines[before]) and _table_head(lines[head]) and not _table_head(lines[before])
        if not cell:
            plain.append((k, int(m[1])))
    # Bare numbers count up by one from page to page: the longest such chain, in one pass.
    ends: dict[int, tuple[int, int]] = {}  # number -> length and place in `plain` of the longest chain that ends with it
    link: list[int] = []
    for i, (_, n) in enumerate(plain):
        size, before = ends.get(n - 1, (0, -1))
        link.append(before)
        if size + 1 > ends.get(n, (0, -1))[0]:
            ends[n] = (size + 1, i)
    best: list[int] = []
    at_end = max(ends.values(), key=lambda e: (e[0], -e[1]))[1] if ends else -1
    while at_end >= 0:
        best.append(plain[at_end][0])
        at_end = link[at_end]
    if not numbers or len(best) > 1:
        numbers |= set(best)
    found = set(numbers)
    page_edge = {k for k in shaped if lines[k].startswith("\x0c") or near(k, -1) in numbers or near(k, 1) in numbers or at[k] in (0, len(full) - 1)}
    page_edge -= {k for k in page_edge if _table_head(lines[k])}
    # A header without a page number beside it: alone in a line of large words, or amid a sentence.
    wide = sorted(len(lines[k]) for k in full)[len(full) // 2]
    amid = {
        k for k in shaped - page_edge
        if len(lines[k].strip()) < 0.9 * wide and not _table_head(lines[k]) and (p := near(k, -1)) is not None and (n := near(k, 1)) is not None
        and (all(w[0].isupper() or w[0].isdigit() or w in "–-" for w in lines[k].split()) or (not _ENDS.search(lines[p].strip()) and lines[n].lstrip()[:1].islower()))
    }
    heads = {lines[h].strip("\x0c ") for h in page_edge | amid}
    alike = {x: x in heads or any(_alike(x, h) for h in heads) for x in {lines[k].strip("\x0c ") for k in shaped - page_edge - amid}}
    again = {k for k in shaped - page_edge - amid if alike[lines[k].strip("\x0c ")]}
    return found | page_edge | amid | again


def _table_head(line: str) -> bool:
    return line.strip("\x0c ").casefold() in {"nimetus", "kogus", "hind", "summa"}


def broken_pairs(lines: list[str], gone: set[int]) -> list[tuple[int, str, int, str, str]]:
    """(line, beginning, line it goes on in, rest, hyphen) of words broken at line ends."""
    out = []
    for k, line in enumerate(lines):
        if k in gone:
            continue
        s = line.rstrip()
        if not s or s[-1] not in HYPHENS or len(s) < 2 or s[-2] in HYPHENS + " ":
            continue
        nxt = k + 1
        while nxt < len(lines) and (nxt in gone or not lines[nxt].strip("\x0c \t\r")):
            nxt += 1
        if nxt == len(lines):
            continue
        head, rest = s[:-1].split()[-1].lstrip(EDGE), lines[nxt].split()[0]
        if not _LETTERS.search(head) or not _LETTERS.match(rest.lstrip(EDGE)[:1] or "-"):
            continue
        if s[-1] == "-" and rest.strip(EDGE) in {"ja", "või", "ning", "ega", "and", "or"}:
            continue
        out.append((k, head, nxt, rest, s[-1]))
    return out


def _counted(text: str) -> Iterator[str]:
    lines = text.split("\n")
    gone = furniture(lines)
    joined = {}
    skip = set()
    for k, head, nxt, rest, _ in broken_pairs(lines, gone):
        joined[k] = head + rest.strip(EDGE)
        skip.add(nxt)
    for k, line in enumerate(lines):
        if k in gone:
            continue
        words = line.split()
        for i, w in enumerate(words):
            if i == 0 and k in skip:
                continue
            if k in joined and i == len(words) - 1:
                yield joined[k]
            elif w := w.strip(EDGE):
                yield w


class Vectors:
    """Unit vectors of words, one row each of a small matrix; a word that begins large has that of its small form if it has none."""

    def __init__(self, at: dict[str, int], rows: np.ndarray) -> None:
        self.at, self.rows = at, rows

    def get(self, word: str) -> np.ndarray | None:
        i = self.at.get(word, self.at.get(word[:1].lower() + word[1:]))
        return None if i is None else self.rows[i].astype(np.float32)


class ScanModel:
    """Vocabulary with counts, skip-gram vectors, letter triples; and what they say about a word."""

    def __init__(self, counts: dict[str, int], vectors: Vectors, triples: dict[str, float], pairs: dict[str, float], least: float = LEAST_COUNT) -> None:
        self.counts, self.vectors, self.triples, self.pairs, self.least = counts, vectors, triples, pairs, max(LEAST_COUNT, least)
        self.seen: dict[str, list[tuple[str, float]]] = {}

    def steps(self, word: str) -> list[float]:
        """Log probability of each letter of a word after the two before it, under the letter-triple model."""
        w = f"^^{word.lower()}$"
        return [math.log((self.triples.get(w[i : i + 3], 0.0) + 0.02) / (self.pairs.get(w[i : i + 2], 0.0) + 1.0)) for i in range(len(w) - 2)]

    def misread(self, word: str, twice: bool) -> dict[str, list[tuple[str, str]]]:
        """Words that a misreading (or two) turns into `word`."""
        out: dict[str, list[tuple[str, str]]] = {}
        for a, b in GLYPHS:
            at = word.find(a)
            while at >= 0:
                out.setdefault(word[:at] + b + word[at + len(a) :], [(a, b)])
                at = word.find(a, at + 1)
        if twice:
            for first, how in list(out.items()):
                if how[0] in STRONG:
                    for second, more in self.misread(first, False).items():
                        if second != word and more[0] in STRONG:
                            out.setdefault(second, how + more)
        return out

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """What may have stood there, best first by frequency; empty if the word stands as it is."""
        hit = self.seen.get(word)
        if hit is None:
            if len(self.seen) > 300_000:
                self.seen.clear()
            hit = self.seen[word] = self._candidates(word)
        return hit

    def _candidates(self, word: str) -> list[tuple[str, float]]:
        letters = sum(map(str.isalpha, word))
        if letters < 2 or not 3 <= len(word) <= self.longest or any(c in "/@" for c in word):
            return []
        digits = sum(map(str.isdigit, word))
        if digits and (digits > 2 or letters < 3):
            return []
        # Of a word outside the vocabulary it is known only that it has less than `least`.
        own = self.counts.get(word, 0)
        unseen = self.least / LEAST_COUNT
        if own >= self.top:
            return []
        low = {}
        for twice in (False, True):
            if twice and low:
                break
            for v, how in self.misread(word, twice).items():
                n = self.counts.get(v, 0)
                if not n and v[:1].isupper():
                    n = self.counts.get(v[:1].lower() + v[1:], 0)
                if n < self.least or n <= own or not (n >= RATIO * 2 * unseen or how[0] in STRONG):
                    continue
                # Far more frequent, or used in the same places: either tells a misreading; two at once need both if the word is in the vocabulary.
                frequent = bool(digits) or n >= RATIO * (own or unseen)
                if (frequent and (len(how) == 1 or not own or digits or self.alike(word, v))) or (not frequent and own and len(how) == 1 and self.alike(word, v)):
                    low[v] = math.log(n) - 2.0 * (len(how) - 1)
        if low:
            return sorted(low.items(), key=lambda x: (-x[1], x[0]))
        # No frequent relative: letters decide, but what is well attested is misread only for something more frequent.
        attested = own >= 2 * self.least and not digits
        steps = self.steps(word)
        if not digits and min(steps) > RARE_STEP:
            return []  # every triple of letters is usual: a name nobody has to explain
        base = sum(steps)
        good = {}
        for v, how in self.misread(word, digits > 1).items():
            if all(h in STRONG for h in how) and not (digits and any(c.isdigit() for c in v)):
                new = self.steps(v)
                if attested and self.counts.get(v, 0) <= own:
                    continue
                if sum(new) - base > (0.0 if digits else NAME_GAIN) and (digits or min(new) > RARE_STEP):
                    good[v] = sum(new) - base
        return sorted(((v, g) for v, g in good.items()), key=lambda x: (-x[1], x[0]))[:1]

    def alike(self, a: str, b: str) -> bool:
        x, y = self.vectors.get(a), self.vectors.get(b)
        return x is not None and y is not None and float(x @ y) >= ALIKE

    @property
    def top(self) -> int:
        if not hasattr(self, "_top"):
            self._top = max(self.counts.values(), default=0)
        return self._top

    @property
    def longest(self) -> int:
        """Letters of the longest word of the vocabulary, broken in two once more: what is longer is no misread word of it."""
        if not hasattr(self, "_longest"):
            self._longest = 2 + max(map(len, self.counts), default=0)
        return self._longest

    def right(self, word: str, around: list[str]) -> str:
        """The word that stood there, by frequency and, among several, by the neighbours' vectors."""
        found = self.candidates(word)
        if not found:
            return word
        if len(found) > 1 and (near := [v for w in around if (v := self.vectors.get(w)) is not None]):
            mean = np.sum(near, axis=0)
            size = float(np.linalg.norm(mean)) or 1.0
            fit = {w: 0.0 if (v := self.vectors.get(w)) is None else float(v @ mean) / size for w, _ in found}
            found = sorted(found, key=lambda c: (-(c[1] + 4.0 * fit[c[0]]), c[0]))
        return found[0][0]

    def whole(self, head: str, rest: str, hyphen: str, around: list[str]) -> str:
        """A broken word in one piece, keeping a hyphen that belongs to it."""
        plain, kept = head + rest, f"{head}-{rest}"
        if hyphen == "-":
            n, m = self.counts.get(plain, 0), self.counts.get(kept, 0)
            if m > n or (not n and (rest[:1].isupper() and head[:1].isupper() and not head.isupper())):
                return kept
            if not n:
                fixed = self.right(kept, around)
                if fixed != kept and self.counts.get(fixed, 0) > self.counts.get(self.right(plain, around), 0):
                    return fixed
        return self.right(plain, around)


class Page:
    """A text with what is to be repaired in it: furniture, broken words in one piece, right words for misread ones."""

    def __init__(self, text: str, model: ScanModel) -> None:
        self.lines = text.split("\n")
        self.gone = furniture(self.lines)
        self.broken = {k: (head, nxt, rest, hyphen) for k, head, nxt, rest, hyphen in broken_pairs(self.lines, self.gone)}
        self.taken = {nxt for _, nxt, _, _ in self.broken.values()}
        self.whole: dict[int, str] = {}  # line -> word begun at its end
        self.right: dict[tuple[int, int], str] = {}  # line and place of a misread word -> right word
        stream = [(k, i, w.strip(EDGE)) for k, line in enumerate(self.lines) if k not in self.gone for i, w in enumerate(line.split())]
        last = {k: i for k, i, _ in stream}
        words = [w for *_, w in stream]
        for j, (k, i, w) in enumerate(stream):
            if k in self.broken and i == last[k]:
                head, _, rest, hyphen = self.broken[k]
                self.whole[k] = model.whole(head, rest.strip(EDGE), hyphen, words[max(0, j - 2) : j] + words[j + 2 : j + 4])
            elif w and not (i == 0 and k in self.taken):
                fixed = model.right(w, words[max(0, j - 2) : j] + words[j + 1 : j + 3])
                if fixed != w:
                    self.right[k, i] = fixed


def findings(text: str, model: ScanModel) -> Iterator[tuple[int, str, str]]:
    """(line number, kind, word) of furniture, broken words and misread words."""
    page = Page(text, model)
    yield from ((k + 1, "furniture", "") for k in sorted(page.gone))
    yield from ((k + 1, "broken_word", w) for k, w in page.whole.items())
    yield from ((k + 1, "bad_char", w) for (k, _), w in page.right.items())


def repaired(text: str, model: ScanModel) -> str:
    """The text in continuous paragraphs, one a line, words whole and corrected, without furniture."""
    page = Page(text, model)
    lines, gone = page.lines, page.gone
    paragraphs, now = [], []
    cross = False
    for k, line in enumerate(lines):
        if k in gone:
            cross = True
            continue
        words = line.split()
        if not words:
            # A blank line at a page break parts nothing if a word or a sentence runs on.
            if now and not cross and not any(x in page.broken for x in range(max(0, k - 1), k)):
                if re.search(r"[.!?:]$", now[-1]) or not (k + 1 < len(lines) and k + 1 in gone):
                    paragraphs.append(" ".join(now))
                    now = []
            continue
        cross = False
        for i, w in enumerate(words):
            if i == 0 and k in page.taken:
                continue
            core = w.strip(EDGE)
            if k in page.broken and i == len(words) - 1:
                rest = page.broken[k][2]
                now.append(w[: len(w) - len(w.lstrip(EDGE))] + page.whole[k] + rest[len(rest.rstrip(EDGE)) :])
            else:
                now.append(w.replace(core, page.right.get((k, i), core), 1) if core else w)
    if now:
        paragraphs.append(" ".join(now))
    return "\n\n".join(paragraphs)


def learn_model(df: DataFrame, text_col: str) -> ScanModel:
    """Count words and their neighbours over all texts; what the driver receives is bounded as the module says."""
    texts = df.select(F.col(text_col).cast("string").alias("text")).where("text is not null and text <> ''")

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        for b in batches:
            for t in b["text"]:
                n.update(_counted(t))
            if len(n) > 500_000:
                yield pd.DataFrame(list(n.items()), columns=["word", "n"])
                n.clear()
        yield pd.DataFrame(list(n.items()), columns=["word", "n"])

    words = cut_lineage(texts.mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_COUNT, total / MOST_WORDS)
    counts = {r["word"]: r["n"] for r in words.where(F.col("n") >= least).collect()}

    def grams(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        for b in batches:
            for word in b["word"]:
                w = f"^^{word.lower()}$"
                n.update(w[i : i + 3] for i in range(len(w) - 2))
        yield pd.DataFrame(list(n.items()), columns=["g", "n"])

    found = words.where("word rlike '^[\\\\p{L}-]{3,}$'").select("word").mapInPandas(grams, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").collect()
    triples = {r["g"]: float(r["n"]) for r in found}
    pairs: dict[str, float] = {}
    for g, n in triples.items():
        pairs[g[:2]] = pairs.get(g[:2], 0.0) + n
    return ScanModel(counts, learn_vectors(texts, counts), triples, pairs, least)


def learn_vectors(texts: DataFrame, counts: dict[str, int]) -> Vectors:
    """The vector of every word of `counts`, from the neighbours it has in texts (column text)."""
    order = sorted(counts, key=lambda w: (-counts[w], w))
    at = {w: i for i, w in enumerate(order)}
    shared = texts.sparkSession.sparkContext.broadcast(at)

    def neighbours(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = shared.value
        n: Counter[int] = Counter()
        for b in batches:
            for text in b["text"]:
                row = [rank.get(w) for line in text.split("\n") for w in (x.strip(EDGE) for x in line.split())]
                column = [i if i is None or i < CONTEXTS else CONTEXTS + i % CONTEXTS for i in row]
                for d in (1, 2):
                    for w, x, own, other in zip(row, row[d:], column, column[d:]):
                        if w is not None and x is not None:
                            n[w * COLUMNS + other] += 1
                            n[x * COLUMNS + own] += 1
            if len(n) > 500_000:
                yield pd.DataFrame(list(n.items()), columns=["cell", "n"])
                n.clear()
        yield pd.DataFrame(list(n.items()), columns=["cell", "n"])

    # A row of the matrix is the list of its full cells, each as count * COLUMNS + column.
    cells = texts.mapInPandas(neighbours, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = cut_lineage(cells.selectExpr(f"cell div {COLUMNS} word", f"n * {COLUMNS} + cell % {COLUMNS} c").groupBy("word").agg(F.collect_list("c").alias("cells")))
    column = np.zeros(COLUMNS)
    for r in rows.select(F.explode("cells").alias("c")).groupBy(F.expr(f"c % {COLUMNS}").alias("k")).agg(F.sum(F.expr(f"c div {COLUMNS}")).alias("n")).collect():
        column[r["k"]] = r["n"] ** 0.75
    share = column / max(float(column.sum()), 1.0)

    def information(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words and their rows of positive pointwise mutual information, a thousand at a time."""
        for b in batches:
            for i in range(0, len(b), 1000):
                some = b.iloc[i : i + 1000]
                m = np.zeros((len(some), COLUMNS))
                for k, c in enumerate(some["cells"]):
                    m[k, c % COLUMNS] = c // COLUMNS
                expected = np.outer(m.sum(1), share)
                with np.errstate(divide="ignore", invalid="ignore"):
                    yield some["word"].to_numpy(), np.where(m > 0, np.maximum(np.log(m / np.maximum(expected, 1e-12)), 0.0), 0.0)

    def gram(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = np.zeros((COLUMNS, COLUMNS))
        for _, pmi in information(batches):
            g += pmi.T @ pmi
        yield pd.DataFrame({"part": range(16), "g": [x.tobytes() for x in np.split(g, 16)]})

    def added(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": b["part"][:1], "g": [np.sum([np.frombuffer(x) for x in b["g"]], axis=0).tobytes()]})

    # Principal axes by the contexts' Gram matrix: COLUMNS x COLUMNS, whatever the vocabulary; few partial sums.
    parts = rows.coalesce(32).mapInPandas(gram, "part int, g binary").groupBy("part").applyInPandas(added, "part int, g binary").collect()
    whole = np.frombuffer(b"".join(bytes(r["g"]) for r in sorted(parts, key=lambda r: r["part"]))).reshape(-1, COLUMNS) if parts else np.zeros((COLUMNS, COLUMNS))
    axes = np.linalg.eigh(whole)[1][:, ::-1][:, :DIMENSIONS]

    def project(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for words, pmi in information(batches):
            vec = pmi @ axes
            vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9)
            yield pd.DataFrame({"words": [words.astype(np.int64).tobytes()], "vec": [vec.astype(np.float16).tobytes()]})

    out = np.zeros((len(order), DIMENSIONS), dtype=np.float16)
    for r in rows.mapInPandas(project, "words binary, vec binary").collect():
        out[np.frombuffer(r["words"], dtype=np.int64)] = np.frombuffer(r["vec"], dtype=np.float16).reshape(-1, DIMENSIONS)
    return Vectors(at, out)


def scan_findings(df: DataFrame, id_col: str, text_col: str, model: ScanModel | None = None) -> DataFrame:
    """(id, line_no, kind, word) for every text."""
    shared = df.sparkSession.sparkContext.broadcast(model or learn_model(df, text_col))

    def find(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, *f) for key, t in zip(b["id"], b["text"]) for f in findings(t, shared.value)]
            yield pd.DataFrame(rows, columns=["id", "line_no", "kind", "word"])

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null and text <> ''")
    return source.mapInPandas(find, f"id {kind}, line_no int, kind string, word string")


def repair(df: DataFrame, text_col: str, out_col: str = "repaired", model: ScanModel | None = None) -> DataFrame:
    """`df` with the repaired text."""
    shared = df.sparkSession.sparkContext.broadcast(model or learn_model(df, text_col))

    @F.pandas_udf("string")
    def fixed(texts: pd.Series) -> pd.Series:
        return pd.Series([repaired(t, shared.value) if t else t for t in texts], dtype=object)

    return df.withColumn(out_col, fixed(F.col(f"`{text_col}`").cast("string")))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "files").where("parsed_with = 'PdfParser' and contents is not null").select("id", "contents")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan_findings(_pages(spark, folder), "id", "contents").select(F.col("id").alias("file_id"), "line_no", "kind", "word").distinct()


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Every page text in continuous paragraphs."""
    return repair(_pages(spark, folder), "contents").select("id", "repaired")


QUERIES = {"p3_found": p3_found, "p3_repaired": p3_repaired}
