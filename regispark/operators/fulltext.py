"""Full-text search: a positional inverted index as DataFrames and a query language over it.

The language has terms, "phrases", prefixes (term*), phrases joined by +, ^ for the first word of a column,
column filters (col:, {a b}:, -col:), NEAR(a b, n), NOT, AND, OR, parentheses, and an implicit AND that binds
closest. Terms are folded runs of letters and digits.

A phrase is one aggregation: each of its words shifts its positions by its place in the phrase, and a position at
which all words meet is a match; nothing is joined with itself, so frequent words cost their postings and no more.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from regispark.functions.text import fold_table, tokens
from regispark.session import cut_lineage

COLUMNS = ["title", "responsible", "series", "to_party", "doc_function", "original_id", "reference", "file_contents"]
K1, B = 1.2, 0.75


@dataclass
class Index:
    """postings: term, doc_id, col, pos (from 0). doc_stats: doc_id, length (tokens in all columns).

    buckets: how many parts a written index has (column bucket of postings). source: documents, columns and id of an
    index that is not built: a lookup then makes the postings of the query's words only.
    """

    postings: DataFrame
    doc_stats: DataFrame
    buckets: int | None = None
    source: tuple[DataFrame, list[str] | None, str] | None = None

    def lookup(self, phrases: list[Phrase]) -> DataFrame:
        """The postings of the words of some phrases. Of a written index only the buckets of these words are read,
        unless one is a prefix."""
        words = {w for p in phrases for w in p.words[: -1 if p.prefix else None]}
        prefixes = {p.words[-1] for p in phrases if p.prefix and p.words}
        if self.source:
            docs, columns, id_col = self.source
            return postings_of(docs, columns, id_col, words, prefixes)
        fits: Column = F.col("term").isin(sorted(words))
        for p in sorted(prefixes):
            fits = fits | F.col("term").startswith(p)
        rows = self.postings.where(fits)
        if self.buckets and not prefixes:
            at: Column = F.lit(False)
            for w in sorted(words):
                at = at | (F.col("bucket") == bucket_of(F.lit(w), self.buckets))
            rows = rows.where(at)
        return rows.select("term", "doc_id", "col", "pos")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings_of(docs: DataFrame, columns: list[str] | None = None, id_col: str = "id", words: set[str] | None = None, prefixes: set[str] | None = None) -> DataFrame:
    """term, doc_id, col, pos of all documents; with words or prefixes, of these terms alone."""
    cols = [c for c in columns or COLUMNS if c in docs.columns]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("text")) for c in cols]))
    rows = docs.select(F.col(id_col).alias("doc_id"), each.alias("c")).where("c.text is not null")
    if words is None:
        return rows.select("doc_id", "c.col", F.posexplode(tokens(F.col("c.text"))).alias("pos", "term")).select("term", "doc_id", "col", "pos")

    def wanted(t: Column) -> Column:
        out = t.isin(sorted(words))
        for p in sorted(prefixes or ()):
            out = out | t.startswith(p)
        return out

    placed = F.transform(tokens(F.col("c.text")), lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    return rows.select("doc_id", "c.col", F.explode(F.filter(placed, lambda x: wanted(x["term"]))).alias("x")).select("x.term", "doc_id", "col", "x.pos")


def stats_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("doc_id").agg(F.count("*").alias("length"))


def build_index(docs: DataFrame, columns: list[str] | None = None, id_col: str = "id") -> Index:
    postings = postings_of(docs, columns, id_col)
    return Index(postings, stats_of(postings))


def write_index(index: Index, path: str, buckets: int = 64) -> None:
    """Persist an index: postings partitioned by a hash of the term and sorted by it, so that a lookup reads the
    buckets of its words and skips by the terms' statistics inside them. A bucket is written by several tasks, parted by
    document, so that a term of very many documents is no single file."""
    p = index.postings.withColumn("bucket", bucket_of(F.col("term"), buckets)).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    p.repartition("bucket", "part").drop("part").sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    index.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")
    index.doc_stats.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/layout")


def read_index(spark, path: str) -> Index:
    """A written index; how many buckets it has is stored with it."""
    buckets = spark.read.schema("buckets int").json(f"{path}/layout").first()["buckets"]
    schema = "term string, doc_id bigint, col string, pos int, bucket int"
    return Index(spark.read.schema(schema).parquet(f"{path}/postings"), spark.read.parquet(f"{path}/doc_stats"), buckets)


def index_over(docs: DataFrame, columns: list[str] | None = None, id_col: str = "id") -> Index:
    """An index that is never built as a whole: each lookup is one scan that keeps the places of the query's words."""
    cols = [c for c in columns or COLUMNS if c in docs.columns]
    length = sum((F.coalesce(F.size(tokens(F.col(c).cast("string"))), F.lit(0)) for c in cols), F.lit(0)).cast("bigint")
    stats = docs.select(F.col(id_col).alias("doc_id"), length.alias("length")).where("length > 0")
    return Index(postings_of(docs, columns, id_col), stats, source=(docs, columns, id_col))


def refreshed(index: Index, changed: DataFrame, columns: list[str] | None = None, id_col: str = "id", gone: DataFrame | None = None) -> Index:
    """The index after documents changed or went: delete by document, then insert."""
    ids = changed.select(F.col(id_col).alias("doc_id"))
    out = ids if gone is None else ids.unionByName(gone.select(F.col(id_col).alias("doc_id")))
    fresh = postings_of(changed, columns, id_col)
    kept = index.postings.join(out.distinct(), "doc_id", "left_anti")
    return Index(kept.select("term", "doc_id", "col", "pos").unionByName(fresh), index.doc_stats.join(out.distinct(), "doc_id", "left_anti").unionByName(stats_of(fresh)))


# --- the query language -------------------------------------------------------------------------------------------


class QuerySyntaxError(ValueError):
    """A query that does not parse; the message says where and hints at quoting."""


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Op:
    kind: str
    left: object
    right: object


_LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|([\w\x1a]+)|([(){}:+*^,-]))')
_ACCENTS = str.maketrans(*fold_table())


def fold_word(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower().translate(_ACCENTS))


def _lex(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(query.rstrip()):
        m = _LEX.match(query, at)
        if not m:
            raise QuerySyntaxError(f'syntax error near "{query[at:].strip()[:1]}": put words with signs in double quotes')
        out.append(("string", m[1][1:-1].replace('""', '"')) if m[1] is not None else ("word", m[2]) if m[2] else ("sign", m[3]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, query: str, columns: list[str]) -> None:
        self.items, self.at, self.columns = _lex(query), 0, columns

    def peek(self, n: int = 0) -> tuple[str, str]:
        return self.items[self.at + n] if self.at + n < len(self.items) else ("end", "")

    def take(self, sign: str | None = None) -> tuple[str, str]:
        got = self.peek()
        if sign is not None and got != ("sign", sign):
            raise QuerySyntaxError(f'syntax error near "{got[1]}": put words with signs in double quotes')
        self.at += 1
        return got

    def parse(self):
        if not self.items:
            raise QuerySyntaxError("the query is empty")
        node = self.either()
        if self.peek()[0] != "end":
            raise QuerySyntaxError(f'syntax error near "{self.peek()[1]}": put words with signs in double quotes')
        return node

    def either(self):
        node = self.both()
        while self.peek() == ("word", "OR"):
            self.take()
            node = Op("or", node, self.both())
        return node

    def both(self):
        node = self.without()
        while self.peek() == ("word", "AND"):
            self.take()
            node = Op("and", node, self.without())
        return node

    def without(self):
        node = self.together()
        while self.peek() == ("word", "NOT"):
            self.take()
            node = Op("not", node, self.together())
        return node

    def _begins(self) -> bool:
        kind, text = self.peek()
        return kind == "string" or (kind == "word" and text not in ("AND", "OR", "NOT")) or (kind == "sign" and text in "{^-")

    def together(self):
        node, closed = self.primary()
        while self._begins() and not closed:
            right, closed = self.primary()
            node = Op("and", node, right)
        return node

    def primary(self):
        """A node, and whether it stands in parentheses (next to which no AND is implied)."""
        if self.peek() == ("sign", "("):
            self.take()
            node = self.either()
            self.take(")")
            return node, True
        columns = self.filter()
        if columns is not None and self.peek() == ("sign", "("):
            self.take()
            node = self.either()
            self.take(")")
            return self.narrowed(node, columns), True
        if self.peek() == ("word", "NEAR") and self.peek(1) == ("sign", "("):
            return self.near(columns), False
        return self.phrase(columns), False

    def filter(self) -> tuple[str, ...] | None:
        start, minus, names = self.at, False, []
        if self.peek() == ("sign", "-"):
            self.take()
            minus = True
        if self.peek() == ("sign", "{"):
            self.take()
            while self.peek()[0] in ("word", "string"):
                names.append(self.take()[1])
            self.take("}")
        elif self.peek()[0] in ("word", "string") and self.peek(1) == ("sign", ":"):
            names.append(self.take()[1])
        if not names:
            if minus or self.at != start:
                raise QuerySyntaxError('syntax error near "-": put words with signs in double quotes')
            return None
        self.take(":")
        low = {c.lower(): c for c in self.columns}
        for n in names:
            if n.lower() not in low:
                raise QuerySyntaxError(f"no such column: {n}")
        chosen = tuple(low[n.lower()] for n in names)
        return tuple(c for c in self.columns if c not in chosen) if minus else chosen

    def narrowed(self, node, columns: tuple[str, ...]):
        if isinstance(node, Op):
            return Op(node.kind, self.narrowed(node.left, columns), self.narrowed(node.right, columns))
        if isinstance(node, Near):
            return Near(tuple(self.narrowed(p, columns) for p in node.phrases), node.distance)
        own = node.columns
        return Phrase(node.words, node.prefix, node.first, columns if own is None else tuple(c for c in own if c in columns))

    def near(self, columns: tuple[str, ...] | None) -> Near:
        self.take()
        self.take("(")
        phrases, distance = [], 10
        while self.peek() not in (("sign", ")"), ("sign", ","), ("end", "")):
            phrases.append(self.phrase(columns))
        if self.peek() == ("sign", ","):
            self.take()
            kind, text = self.take()
            if kind != "word" or not text.isdigit():
                raise QuerySyntaxError("NEAR takes a number after the comma")
            distance = int(text)
        self.take(")")
        if not phrases:
            raise QuerySyntaxError("NEAR takes at least one phrase")
        return Near(tuple(phrases), distance)

    def phrase(self, columns: tuple[str, ...] | None) -> Phrase:
        first = False
        if self.peek() == ("sign", "^"):
            self.take()
            first = True
        words: list[str] = []
        while True:
            kind, text = self.take()
            if kind not in ("word", "string") or (kind == "word" and text in ("AND", "OR", "NOT")):
                raise QuerySyntaxError(f'syntax error near "{text}": put words with signs in double quotes')
            words += fold_word(text)
            if self.peek() != ("sign", "+"):
                break
            self.take()
        prefix = self.peek() == ("sign", "*")
        if prefix:
            self.take()
        return Phrase(tuple(words), prefix, first, columns)


def parse_query(query: str, columns: list[str] | None = None):
    """The tree of a query, or QuerySyntaxError."""
    return _Parser(query, columns or COLUMNS).parse()


# --- execution ----------------------------------------------------------------------------------------------------


def _leaves(node) -> list[Phrase]:
    if isinstance(node, Op):
        return _leaves(node.left) + _leaves(node.right)
    return list(node.phrases) if isinstance(node, Near) else [node]


def _places(postings: DataFrame, phrase: Phrase) -> DataFrame:
    """doc_id, col, pos of every match of a phrase (pos: its first word)."""
    if not phrase.words:
        return postings.select("doc_id", "col", "pos").where("false")
    p = postings if phrase.columns is None else postings.where(F.col("col").isin(list(phrase.columns)))
    last = len(phrase.words) - 1
    fits: Column = F.lit(False)
    place: Column = F.array()
    for k, w in enumerate(phrase.words):
        is_w = F.col("term").startswith(w) if phrase.prefix and k == last else F.col("term") == w
        fits = fits | is_w
        place = F.array_union(place.cast("array<int>"), F.when(is_w, F.array(F.lit(k))).otherwise(F.array().cast("array<int>")))
    rows = p.where(fits)
    if last:
        rows = rows.withColumn("k", F.explode(place)).select("doc_id", "col", (F.col("pos") - F.col("k")).alias("pos"), "k")
        rows = rows.groupBy("doc_id", "col", "pos").agg(F.countDistinct("k").alias("n")).where(F.col("n") == len(phrase.words))
    rows = rows.select("doc_id", "col", "pos")
    return rows.where("pos = 0") if phrase.first else rows


def _docs(postings: DataFrame, node) -> DataFrame:
    if isinstance(node, Phrase):
        return _places(postings, node).select("doc_id").distinct()
    if isinstance(node, Near):
        if len(node.phrases) == 1:
            return _docs(postings, node.phrases[0])
        every = None
        for k, ph in enumerate(node.phrases):
            rows = _places(postings, ph).select("doc_id", "col", "pos", F.lit(k).alias("k"), F.lit(max(1, len(ph.words))).alias("w"))
            every = rows if every is None else every.unionByName(rows)
        # Between the end of the first and the start of the last phrase at most `distance` words.
        from_here = Window.partitionBy("doc_id", "col").orderBy("reach").rangeBetween(0, node.distance + max(len(p.words) for p in node.phrases))
        rows = every.withColumn("reach", F.col("pos")).withColumn("near", F.collect_set(F.struct("k", "pos")).over(from_here))
        end = F.col("pos") + F.col("w")
        close = F.filter("near", lambda x: x["pos"] <= end + node.distance)
        return rows.where(F.size(F.array_distinct(F.transform(close, lambda x: x["k"]))) == len(node.phrases)).select("doc_id").distinct()
    left, right = _docs(postings, node.left), _docs(postings, node.right)
    if node.kind == "and":
        return left.join(right, "doc_id", "left_semi")
    return left.unionByName(right).distinct() if node.kind == "or" else left.join(right, "doc_id", "left_anti")


def match_docs(index: Index, query: str, columns: list[str] | None = None) -> DataFrame:
    """doc_id of the documents that match."""
    node = parse_query(query, columns)
    return _docs(index.lookup(_leaves(node)), node)


def match_all(index: Index, queries: list[str], columns: list[str] | None = None) -> DataFrame:
    """(doc_id, query) of the documents that match each of several queries; their words are looked up in one scan."""
    nodes = {q: parse_query(q, columns) for q in queries}
    postings = cut_lineage(index.lookup([p for n in nodes.values() for p in _leaves(n)]))
    out = None
    for q, node in nodes.items():
        found = _docs(postings, node).select("doc_id", F.lit(q).alias("query"))
        out = found if out is None else out.unionByName(found)
    return out


def bm25(index: Index, phrases: list[Phrase]) -> DataFrame:
    """doc_id, rank: the negated sum over phrases, so that lower is better."""
    n_docs = index.doc_stats.agg(F.count("*").alias("big_n"), F.avg("length").alias("avgdl"))
    every, postings = None, index.lookup(phrases)
    for k, ph in enumerate(phrases):
        tf = _places(postings, ph).groupBy("doc_id").agg(F.count("*").alias("tf")).select("doc_id", "tf", F.lit(k).alias("k"))
        every = tf if every is None else every.unionByName(tf)
    df = every.groupBy("k").agg(F.count("*").alias("df"))
    scored = every.join(F.broadcast(df), "k").join(index.doc_stats, "doc_id").join(F.broadcast(n_docs), F.lit(True))
    idf = F.greatest(F.log((F.col("big_n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    return scored.groupBy("doc_id").agg((-F.sum(part)).alias("rank"))


def match(index: Index, query: str, columns: list[str] | None = None) -> DataFrame:
    """doc_id and rank of the documents that match."""
    node = parse_query(query, columns)
    return _docs(index.lookup(_leaves(node)), node).join(bm25(index, _leaves(node)), "doc_id", "left")
