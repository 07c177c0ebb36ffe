"""Queries of the document registry, each with the SQL it is compared with.

"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regispark.functions import text as V
from regispark.operators import audit, filetree, fulltext, rollups, search, topics, upsert
from regispark.operators.shredding import parse_record
from regispark.session import checkpoint_folder, read_table
from regispark.sources import registries
from regispark.streaming import jobs

Query = "Callable[[SparkSession, str], DataFrame]"
SHOWN = ["id", "original_id", "title", "registration_date", "restriction"]


def _t(name: str):
    return lambda spark, folder: read_table(spark, folder, name)


docs_of, orgs_of, files_of = _t("registry_docs"), _t("organisations"), _t("files")


def with_contents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the texts of the files that name them; files that hang deeper and name no document are left out, as
    the registry itself leaves them out."""
    contents = filetree.file_contents(files_of(spark, folder))
    docs = docs_of(spark, folder)
    return docs.join(contents.withColumnRenamed("document_id", "id"), "id", "left")


def index_of(spark: SparkSession, folder: str) -> fulltext.Index:
    """The index of a folder's documents. Nothing is kept between queries: each scans the texts for its own words."""
    return fulltext.index_over(with_contents(spark, folder))


def written_index(spark: SparkSession, folder: str) -> fulltext.Index:
    """The index of a folder's documents, written to the shared folder and opened again."""
    path = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
    fulltext.write_index(fulltext.build_index(with_contents(spark, folder)), path)
    return fulltext.read_index(spark, path)


# --- search [S1 F1-F5 O1-O3 A1 J6 O10 K8 K9 F15] -------------------------------------------------------------------

REQUESTS = {
    "search_page_default": search.SearchRequest(page=2),
    "search_page_filtered": search.SearchRequest(org_ids=(1, 2, 3, 5, 8, 13, 21), date_start="2023-01-01", date_end="2024-12-31", with_restricted=True),
    "search_page_created": search.SearchRequest(sort_by="created_at", min_delta=30),
}


def _page(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        request = REQUESTS[name]
        return search.page(search.hits(docs_of(spark, folder), request), request).select(*SHOWN)

    return run


def search_total(spark: SparkSession, folder: str) -> DataFrame:
    return search.hits(docs_of(spark, folder), REQUESTS["search_page_filtered"]).agg(F.count("*").alias("total"))


def publication_lag(spark: SparkSession, folder: str) -> DataFrame:
    d = docs_of(spark, folder).where("registration_date is not null and created_at is not null")
    lag = V.day_lag(F.col("created_at"), F.col("registration_date"))
    return d.where(lag >= 30).select("id", F.round(lag, 6).alias("lag_days"), V.lag_shown(F.col("created_at"), F.col("registration_date")).alias("shown"), F.round(V.julian_day(F.col("created_at")), 4).alias("jd"))


def visibility_guard(spark: SparkSession, folder: str) -> DataFrame:
    return search.visible(docs_of(spark, folder)).groupBy("last_visibility").agg(F.count("*").alias("n"))


def list_items(spark: SparkSession, folder: str) -> DataFrame:
    items = search.list_items(docs_of(spark, folder), orgs_of(spark, folder))
    return items.select("id", "registration_date", F.col("organisation.slug").alias("slug"), F.col("organisation.name").alias("name"))


def document_details(spark: SparkSession, folder: str) -> DataFrame:
    d = search.details(search.visible(docs_of(spark, folder)), orgs_of(spark, folder), files_of(spark, folder))
    return d.select("id", F.size("files").cast("bigint").alias("n_files"), F.array_join(F.transform("files", lambda f: f["name"]), "|").alias("names"))


def json_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items as JSON texts, read back: a round trip."""
    items = search.list_items(docs_of(spark, folder), orgs_of(spark, folder))
    return search.json_page(items).select("id", F.get_json_object("json", "$.title").alias("title"), F.get_json_object("json", "$.organisation.slug").alias("slug"))


def organisation_list(spark: SparkSession, folder: str) -> DataFrame:
    return orgs_of(spark, folder).select("id", "name", "slug").orderBy("name")


# --- roll-ups [A2-A10 J2 J5 F7-F9 O4 O5 K10 R6] ----------------------------------------------------------------------


def archive_years(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.years(docs_of(spark, folder))


def archive_years_of_org(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.years(rollups.of_organisation(docs_of(spark, folder), orgs_of(spark, folder), orgs_of(spark, folder).agg(F.min("slug")).first()[0]))


def archive_months(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.months(docs_of(spark, folder), 2024)


def archive_month_listing(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.month_listing(docs_of(spark, folder), 2024, 3).select(*SHOWN)


def dossier_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Dossiers that hold several documents."""
    d = docs_of(spark, folder).where("dossier is not null")
    return d.groupBy("dossier").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def dossier_page(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the first dossier that holds several, asked for by its percent-encoded name."""
    name = dossier_documents(spark, folder).agg(F.url_encode(F.min("dossier"))).first()[0]
    return rollups.dossier(docs_of(spark, folder), name or "").select("id", "dossier")


def org_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.organisation_stats(docs_of(spark, folder), orgs_of(spark, folder))


def sitemap_freshness(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.freshness(docs_of(spark, folder), orgs_of(spark, folder))


def sitemap_latest(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.latest(docs_of(spark, folder), orgs_of(spark, folder))


def sitemap_urls(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.sitemap_urls(docs_of(spark, folder), orgs_of(spark, folder), "https://registry.example")


def sitemap_index(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.sitemap_index(docs_of(spark, folder), orgs_of(spark, folder), "https://registry.example")


def sitemap_documents(spark: SparkSession, folder: str) -> DataFrame:
    orgs = orgs_of(spark, folder)
    return rollups.sitemap_documents(docs_of(spark, folder), orgs, orgs.agg(F.min("slug")).first()[0], 2024, "https://registry.example").select("loc", "lastmod", "priority")


# --- files [J3 J4 J7 J9 A6 A13 F10 F24 K6 K7 I6] -----------------------------------------------------------------------


def file_contents(spark: SparkSession, folder: str) -> DataFrame:
    f = filetree.file_contents(files_of(spark, folder))
    return f.select("document_id", F.md5("file_contents").alias("digest"), F.length("file_contents").cast("bigint").alias("n_chars"))


def summary_texts(spark: SparkSession, folder: str) -> DataFrame:
    texts = filetree.summary_text(files_of(spark, folder))
    fit = filetree.may_summarise(texts, docs_of(spark, folder))
    return texts.join(fit, "document_id").select("document_id", F.md5("text").alias("digest"))


def file_depths(spark: SparkSession, folder: str) -> DataFrame:
    return filetree.depths(files_of(spark, folder))


def files_after_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Files that stay when every signed container is deleted with all it holds."""
    f = files_of(spark, folder)
    return filetree.without(f, f.where("parsed_with = 'AsiceParser'")).select("id", "parent_id")


def documents_of_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every file with the document its root belongs to."""
    return filetree.document_of(files_of(spark, folder)).select("id", "document_id")


def file_classes(spark: SparkSession, folder: str) -> DataFrame:
    return files_of(spark, folder).groupBy(V.file_class(F.col("name")).alias("file_class")).agg(F.count("*").alias("n"))


def file_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return files_of(spark, folder).groupBy(V.extension(F.col("name")).alias("ext"), "parsed_with").agg(F.count("*").alias("n"), F.sum(F.when(F.col("parent_id").isNull(), 1).otherwise(0)).alias("n_roots"))


# --- full text [X1-X6 U4 J1 J17 A17 I1-I3] -----------------------------------------------------------------------------

TEXT_QUERIES = {
    "fts_term": "leping",
    "fts_and": "leping menetlus",
    "fts_not": "leping NOT taotlus",
    "fts_or": "arve OR kaebus",
    "fts_phrase": '"kirja lisas on"',
    "fts_prefix": "metsa*",
    "fts_column": "title : vastus",
    "fts_first": "^ protokoll",
}


def _matches(query: str):
    return lambda spark, folder: fulltext.match_docs(index_of(spark, folder), query)


def fts_near(spark: SparkSession, folder: str) -> DataFrame:
    return fulltext.match_docs(index_of(spark, folder), "NEAR(otsuse vaide, 4)")


def fts_terms(spark: SparkSession, folder: str) -> DataFrame:
    p = index_of(spark, folder).postings
    return p.groupBy("term").agg(F.countDistinct("doc_id").alias("df"), F.count("*").alias("cf"))


def fts_ranked(spark: SparkSession, folder: str) -> DataFrame:
    m = fulltext.match(index_of(spark, folder), "kaebus menetlus")
    return m.select("doc_id", F.round("rank", 6).alias("rank"))


def fts_search_page(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: text query, filters, order, page."""
    request = search.SearchRequest(query='kaebus OR "kirja lisas"', date_start="2023-01-01", with_restricted=True)
    found = search.hits(docs_of(spark, folder).select(*SHOWN, "organisation_id", "created_at"), request, index_of(spark, folder))
    return search.page(found, request).select(*SHOWN)


def fts_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of the whole index after the titles of all public documents changed."""
    d = with_contents(spark, folder)
    index = fulltext.build_index(d)
    changed = d.where("restriction = 'Avalik'").withColumn("title", F.concat(F.lit("uus "), F.coalesce("title", F.lit(""))))
    return fulltext.refreshed(index, changed).postings.groupBy("term").agg(F.count("*").alias("n"))


# --- upkeep [K1-K4 K14 J16 A11 A14 F12-F14 K13 O12 T-S1 T-S2 T-S3 D4] -----------------------------------------------------


def fts_written(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked matches in an index that was written and opened again."""
    m = fulltext.match(written_index(spark, folder), "kaebus menetlus")
    return m.select("doc_id", F.round("rank", 6).alias("rank"))


def last_by_url(spark: SparkSession, folder: str) -> DataFrame:
    return upsert.last_by(docs_of(spark, folder), "url", ["created_at", "id"]).select("id", "url")


def upsert_by_url(spark: SparkSession, folder: str) -> DataFrame:
    """Documents stored before 2025 after those created later were upserted."""
    d = docs_of(spark, folder)
    return upsert.upserted(d.where("created_at < '2025-01-01'"), d.where("created_at >= '2025-01-01'"), "url", ["created_at", "id"]).select("id", "url")


def upserted_bases(spark: SparkSession, folder: str) -> DataFrame:
    """Legal bases by link after the same upsert: those of documents that came again give way to the new ones."""
    d = docs_of(spark, folder).where("url is not null")
    bases = d.join(read_table(spark, folder, "restriction_bases").where("basis is not null").withColumnRenamed("document_id", "id"), "id").select("url", "basis", "created_at")
    old, new = bases.where("created_at < '2025-01-01'").select("url", "basis"), bases.where("created_at >= '2025-01-01'").select("url", "basis")
    return upsert.with_children(old, d.where("created_at >= '2025-01-01'"), new).groupBy("url").agg(F.count("*").alias("n_bases"))


def new_documents(spark: SparkSession, folder: str) -> DataFrame:
    d = docs_of(spark, folder)
    return upsert.new_only(d.where("created_at >= '2025-01-01'"), d.where("created_at < '2025-01-01'"), "url").select("id", "url")


def resume_ids(spark: SparkSession, folder: str) -> DataFrame:
    return upsert.resume_ids(docs_of(spark, folder))


def bases_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by legal basis, each document's bases given as a comma list."""
    b = read_table(spark, folder, "restriction_bases").where("document_id is not null and basis is not null")
    lists = b.groupBy(F.col("document_id").alias("id")).agg(F.array_join(F.collect_list("basis"), ", ").alias("listed"))
    return upsert.base_rows(lists, "listed").groupBy("basis").agg(F.countDistinct("document_id").alias("n_docs"))


def audit_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by audit state; looked at last when they were updated, those never shown were never looked at."""
    d = docs_of(spark, folder).withColumn("last_audit_check_at", F.when(F.col("last_visibility").isNotNull(), F.col("updated_at").cast("timestamp")))
    states = {"never": audit.never_audited(d), "stale": audit.stale(d, "2024-06-01"), "recheck": audit.to_recheck(d)}
    out = None
    for name, rows in states.items():
        part = rows.select(F.lit(name).alias("state"), "id")
        out = part if out is None else out.unionByName(part)
    return out


def audit_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return audit.candidates(index_of(spark, folder), range(1, 20), '"toimik {point}" NOT "on tasutud"')


def listing_cap(spark: SparkSession, folder: str) -> DataFrame:
    d = docs_of(spark, folder).where("organisation_id is not null and registration_date is not null and restriction is not null")
    return jobs.capped_listing(d, 2).select("id")


def poll_days(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.poll_dates(orgs_of(spark, folder), "2026-05-14")


def rate_windows(spark: SparkSession, folder: str) -> DataFrame:
    e = read_table(spark, folder, "events")
    return jobs.rate_windows(e, "user_id", "ts", seconds=3600, most=1)


def rate_first_hit(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.first_hit_limits(read_table(spark, folder, "events"), "user_id", "ts", seconds=86400, most=3)


def miss_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    """Fetches of each month up to the first two misses in a row (an answer without data), by month."""
    missed = ~F.coalesce(F.col("payload").rlike(r'"data\\?": ?[{\["]'), F.lit(False))
    p = read_table(spark, folder, "rmk_records").select("fetch_id", F.date_format("fetched_at", "yyyy-MM").alias("month"), missed.alias("missed"))
    return jobs.before_cutoff(p, "month", "fetch_id", "missed", 2).select("fetch_id")


# --- graph [T10 J11 O11 O9] ------------------------------------------------------------------------------------------------


def topic_components(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of one organisation that share a dossier are one topic, and so are those that share a reference."""
    d = docs_of(spark, folder)
    edges = None
    for c in ("dossier", "reference"):
        heads = d.where(F.col(c).isNotNull()).groupBy("organisation_id", c).agg(F.min("id").alias("dst"))
        part = d.select("id", "organisation_id", c).join(heads, ["organisation_id", c]).select(F.col("id").alias("src"), "dst")
        edges = part if edges is None else edges.unionByName(part)
    return topics.topics(edges)


def relation_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges from each document to the one its dossier begins with, given by that one's original id."""
    d = docs_of(spark, folder).where("dossier is not null and original_id is not null and organisation_id is not null")
    heads = d.groupBy("organisation_id", "dossier").agg(F.min("original_id").alias("related_original_id"))
    return topics.relation_edges(d.select("id", "organisation_id", "dossier").join(heads, ["organisation_id", "dossier"]), docs_of(spark, folder)).distinct()


# --- functions [V1-V26] ------------------------------------------------------------------------------------------------------


def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("url")
    return docs_of(spark, folder).where("url is not null").select("id", V.site(u).alias("site"), V.last_segment(u).alias("last"), V.trailing_id(u).alias("number"))


def text_functions(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("title")
    d = docs_of(spark, folder).where("title is not null")
    return d.select(
        "id", V.slug(t).alias("slug"), V.fold(t).alias("folded"), V.note_id(F.col("id")).alias("note"), V.note_number(V.note_id(F.col("id"))).alias("number"), V.month_name(F.col("registration_date")).alias("month"),
        F.char_length(t).cast("bigint").alias("n_chars"), F.octet_length(t).cast("bigint").alias("n_bytes"), V.whole_number(F.col("original_id")).alias("as_number"),
    )


def file_names(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("name")
    return files_of(spark, folder).select("id", V.file_name(n, F.lit("file")).alias("safe"), V.extension(n).alias("ext"), V.encoded_path(F.col("storage_path")).alias("encoded"))


def json_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical documents of the JSON source: the last valid answer for each link."""
    r = read_table(spark, folder, "rmk_records").where("http_status = 200")
    site = V.site(F.col("url"))
    pages = r.select(F.lit(3).cast("bigint").alias("organisation_id"), F.lit("rmk").alias("fetcher_type"), site.alias("site"), F.col("rmk_id").cast("string").alias("source_id"), F.col("payload").alias("body"), "fetched_at")
    last = upsert.last_by(pages.withColumn("k", F.col("source_id")), "k", ["fetched_at"]).drop("k", "fetched_at")
    return registries.documents(registries.parse_pages(last)).select("url", "original_id", "title", "reference", "registration_date", "doc_type", "restriction", "to_party", "responsible", F.size("file_urls").alias("n_public_files"))


def namespace_words(spark: SparkSession, folder: str) -> DataFrame:
    return registries.namespace_candidates(spark)


QUERIES = {
    **{k: _page(k) for k in REQUESTS}, "search_total": search_total, "publication_lag": publication_lag, "visibility_guard": visibility_guard, "list_items": list_items, "document_details": document_details, "json_items": json_items,
    "organisation_list": organisation_list, "archive_years": archive_years, "archive_years_of_org": archive_years_of_org, "archive_months": archive_months, "archive_month_listing": archive_month_listing, "dossier_documents": dossier_documents,
    "org_stats": org_stats, "sitemap_freshness": sitemap_freshness, "sitemap_latest": sitemap_latest, "sitemap_urls": sitemap_urls, "file_contents": file_contents, "summary_texts": summary_texts, "file_depths": file_depths,
    "files_after_delete": files_after_delete, "file_kinds": file_kinds, **{k: _matches(q) for k, q in TEXT_QUERIES.items()}, "fts_near": fts_near, "fts_terms": fts_terms, "fts_ranked": fts_ranked, "fts_search_page": fts_search_page,
    "fts_refresh": fts_refresh, "upsert_by_url": upsert_by_url, "new_documents": new_documents, "resume_ids": resume_ids, "bases_by_kind": bases_by_kind, "audit_queue": audit_queue, "audit_candidates": audit_candidates, "listing_cap": listing_cap,
    "poll_days": poll_days, "rate_windows": rate_windows, "rate_first_hit": rate_first_hit, "miss_cutoff": miss_cutoff, "topic_components": topic_components, "url_parts": url_parts, "text_functions": text_functions, "file_names": file_names,
    "json_documents": json_documents, "namespace_words": namespace_words, "dossier_page": dossier_page, "sitemap_index": sitemap_index, "sitemap_documents": sitemap_documents, "documents_of_files": documents_of_files,
    "file_classes": file_classes, "fts_written": fts_written, "last_by_url": last_by_url, "upserted_bases": upserted_bases, "relation_edges": relation_edges,
}

_A, _B = V.fold_table()
_SHOWN = ", ".join(SHOWN)
_FOLD = lambda x: f"translate(lower({x}), '{_A}', '{_B}')"
_CONTENTS = "SELECT document_id, string_agg(name || ' ' || contents, '  ' ORDER BY id) AS file_contents FROM files WHERE document_id IS NOT NULL GROUP BY document_id"
_COLS = [c for c in fulltext.COLUMNS if c != "file_contents"]
_POSTINGS = f"""
    WITH c AS ({_CONTENTS}),
    t AS ({" UNION ALL ".join(f"SELECT id AS doc_id, '{c}' AS col, CAST({c} AS VARCHAR) AS x FROM registry_docs" for c in _COLS)}
          UNION ALL SELECT d.id, 'file_contents', c.file_contents FROM registry_docs d JOIN c ON c.document_id = d.id),
    l AS (SELECT doc_id, col, regexp_extract_all({_FOLD("x")}, '[\\p{{L}}\\p{{N}}]+') AS w FROM t WHERE x IS NOT NULL),
    p AS (SELECT doc_id, col, unnest(w) AS term, unnest(range(len(w))) AS pos FROM l)"""
_WITH = lambda cond: f"SELECT DISTINCT doc_id FROM p WHERE {cond}"
_MATCH = {
    "fts_term": _WITH("term = 'leping'"),
    "fts_and": f"{_WITH("term = 'leping'")} INTERSECT {_WITH("term = 'menetlus'")}",
    "fts_not": f"{_WITH("term = 'leping'")} EXCEPT {_WITH("term = 'taotlus'")}",
    "fts_or": _WITH("term IN ('arve', 'kaebus')"),
    "fts_phrase": "SELECT DISTINCT doc_id FROM l WHERE list_aggregate(w, 'string_agg', ' ') ~ '(^| )kirja lisas on( |$)'",
    "fts_prefix": _WITH("starts_with(term, 'metsa')"),
    "fts_column": _WITH("term = 'vastus' AND col = 'title'"),
    "fts_first": _WITH("term = 'protokoll' AND pos = 0"),
    "fts_near": "SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.col = b.col AND a.term = 'otsuse' AND b.term = 'vaide' AND abs(a.pos - b.pos) <= 5",
}
_ISO = lambda x: f"strftime({x}, '%Y-%m-%dT%H:%M:%SZ')"
_RESTRICTED = "CAST(sum(CASE WHEN restriction = 'AK' THEN 1 ELSE 0 END) AS BIGINT)"

ORACLES = {
    "search_page_default": f"SELECT {_SHOWN} FROM registry_docs WHERE restriction = 'Avalik' ORDER BY registration_date DESC NULLS LAST, original_id DESC NULLS LAST, id LIMIT 100 OFFSET 100",
    "search_page_filtered": f"SELECT {_SHOWN} FROM registry_docs WHERE organisation_id IN (1,2,3,5,8,13,21) AND registration_date BETWEEN DATE '2023-01-01' AND DATE '2024-12-31' ORDER BY registration_date DESC NULLS LAST, original_id DESC NULLS LAST, id LIMIT 100",
    "search_page_created": f"SELECT {_SHOWN} FROM registry_docs WHERE restriction = 'Avalik' AND (epoch_us(created_at) - epoch_us(CAST(registration_date AS TIMESTAMP))) / 86400000000.0 >= 30 ORDER BY created_at DESC NULLS LAST, id LIMIT 100",
    "search_total": "SELECT count(*) AS total FROM registry_docs WHERE organisation_id IN (1,2,3,5,8,13,21) AND registration_date BETWEEN DATE '2023-01-01' AND DATE '2024-12-31'",
    "publication_lag": "SELECT id, round(lag, 6) AS lag_days, CAST(round(lag) AS INTEGER) AS shown, round(epoch_us(created_at) / 86400000000.0 + 2440587.5, 4) AS jd FROM (SELECT id, created_at, (epoch_us(created_at) - epoch_us(CAST(registration_date AS TIMESTAMP))) / 86400000000.0 AS lag FROM registry_docs) WHERE lag >= 30",
    "visibility_guard": "SELECT last_visibility, count(*) AS n FROM registry_docs WHERE last_visibility IS NULL OR last_visibility NOT IN ('AK', 'Unknown') GROUP BY last_visibility",
    "list_items": "SELECT d.id, strftime(d.registration_date, '%Y-%m-%d') AS registration_date, o.slug, o.name FROM registry_docs d LEFT JOIN organisations o ON o.id = d.organisation_id",
    "document_details": "SELECT d.id, count(f.id) AS n_files, coalesce(string_agg(f.name, '|' ORDER BY f.id), '') AS names FROM registry_docs d LEFT JOIN files f ON f.document_id = d.id WHERE d.last_visibility IS NULL OR d.last_visibility NOT IN ('AK', 'Unknown') GROUP BY d.id",
    "json_items": "SELECT d.id, d.title, o.slug FROM registry_docs d LEFT JOIN organisations o ON o.id = d.organisation_id",
    "organisation_list": "SELECT id, name, slug FROM organisations",
    "archive_years": f"SELECT strftime(registration_date, '%Y') AS year, count(*) AS n, {_RESTRICTED} AS n_restricted FROM registry_docs GROUP BY 1",
    "archive_years_of_org": f"SELECT strftime(registration_date, '%Y') AS year, count(*) AS n, {_RESTRICTED} AS n_restricted FROM registry_docs WHERE organisation_id = (SELECT id FROM organisations ORDER BY slug LIMIT 1) GROUP BY 1",
    "archive_months": "SELECT strftime(registration_date, '%m') AS month, count(*) AS n, ['jaanuar','veebruar','märts','aprill','mai','juuni','juuli','august','september','oktoober','november','detsember'][month(any_value(registration_date))] AS name FROM registry_docs WHERE strftime(registration_date, '%Y') = '2024' GROUP BY 1",
    "archive_month_listing": f"SELECT {_SHOWN} FROM registry_docs WHERE strftime(registration_date, '%Y-%m') = '2024-03'",
    "dossier_documents": "SELECT dossier, count(*) AS n, min(id) AS first_id FROM registry_docs WHERE dossier IS NOT NULL GROUP BY dossier HAVING count(*) > 1",
    "org_stats": "SELECT o.id, o.name, o.slug, count(d.id) AS n_docs, CAST(coalesce(sum(CASE WHEN d.restriction = 'AK' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_restricted, CASE WHEN count(d.id) > 0 THEN round(sum(CASE WHEN d.restriction = 'AK' THEN 1 ELSE 0 END) / count(d.id) * 100, 2) END AS restricted_pct, min(d.registration_date) AS first_date, max(d.registration_date) AS last_date FROM organisations o LEFT JOIN registry_docs d ON d.organisation_id = o.id GROUP BY o.id, o.name, o.slug",
    "sitemap_freshness": "SELECT o.slug, strftime(registration_date, '%Y') AS year, CAST(NULL AS VARCHAR) AS month, max(d.updated_at) AS lastmod FROM registry_docs d JOIN organisations o ON o.id = d.organisation_id WHERE registration_date IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT o.slug, strftime(registration_date, '%Y'), strftime(registration_date, '%m'), max(d.updated_at) FROM registry_docs d JOIN organisations o ON o.id = d.organisation_id WHERE registration_date IS NOT NULL GROUP BY 1, 2, 3",
    "sitemap_latest": "SELECT o.slug, max(d.updated_at) AS lastmod FROM registry_docs d JOIN organisations o ON o.id = d.organisation_id GROUP BY 1 UNION ALL SELECT NULL, max(updated_at) FROM registry_docs",
    "file_contents": f"SELECT document_id, md5(file_contents) AS digest, length(file_contents) AS n_chars FROM ({_CONTENTS})",
    "summary_texts": "WITH f AS (SELECT *, row_number() OVER (PARTITION BY document_id, name ORDER BY id) AS r FROM files WHERE document_id IS NOT NULL), t AS (SELECT document_id, string_agg(regexp_replace(contents, '<[^>]*>', '', 'g'), chr(10) || chr(10) || chr(10) || chr(10) ORDER BY id) AS text FROM f WHERE r = 1 AND contents IS NOT NULL GROUP BY document_id) SELECT document_id, md5(text) AS digest FROM t WHERE strlen(text) > 100 AND length(text) <= 16000 AND document_id IN (SELECT id FROM registry_docs)",
    "file_depths": "WITH RECURSIVE t AS (SELECT id, id AS root_id, 0 AS depth FROM files WHERE parent_id IS NULL UNION ALL SELECT f.id, t.root_id, t.depth + 1 FROM files f JOIN t ON f.parent_id = t.id) SELECT * FROM t",
    "files_after_delete": "WITH RECURSIVE g AS (SELECT id FROM files WHERE parsed_with = 'AsiceParser' UNION SELECT f.id FROM files f JOIN g ON f.parent_id = g.id) SELECT id, parent_id FROM files WHERE id NOT IN (SELECT id FROM g)",
    "file_kinds": "SELECT lower(regexp_extract(name, '\\.([^./\\\\]+)$', 1)) AS ext, parsed_with, count(*) AS n, CAST(sum(CASE WHEN parent_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_roots FROM files GROUP BY 1, 2",
    **{k: f"{_POSTINGS} {q}" for k, q in _MATCH.items()},
    "fts_terms": f"{_POSTINGS} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term",
    "fts_ranked": f"""{_POSTINGS}, s AS (SELECT doc_id, count(*) AS dl FROM p GROUP BY doc_id), n AS (SELECT count(*) AS big_n, avg(dl) AS avgdl FROM s),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM p WHERE term IN ('kaebus', 'menetlus') GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        m AS (SELECT doc_id FROM tf GROUP BY doc_id HAVING count(*) = 2)
        SELECT doc_id, round(-sum(greatest(ln((big_n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS rank FROM m JOIN tf USING (doc_id) JOIN df USING (term) JOIN s USING (doc_id), n GROUP BY doc_id""",
    "fts_search_page": f"""{_POSTINGS}, h AS (SELECT doc_id FROM p WHERE term = 'kaebus' UNION SELECT doc_id FROM l WHERE list_aggregate(w, 'string_agg', ' ') ~ '(^| )kirja lisas( |$)'),
        s AS (SELECT doc_id, count(*) AS dl FROM p GROUP BY doc_id), n AS (SELECT count(*) AS big_n, avg(dl) AS avgdl FROM s),
        q AS (SELECT a.doc_id, a.col, a.pos, 1 AS k FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.col = b.col AND b.pos = a.pos + 1 AND a.term = 'kirja' AND b.term = 'lisas' UNION ALL SELECT doc_id, col, pos, 0 FROM p WHERE term = 'kaebus'),
        tf AS (SELECT doc_id, k, count(*) AS tf FROM q GROUP BY 1, 2), df AS (SELECT k, count(*) AS df FROM tf GROUP BY 1),
        r AS (SELECT doc_id, -sum(greatest(ln((big_n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS rank FROM tf JOIN df USING (k) JOIN s USING (doc_id), n GROUP BY doc_id)
        SELECT {", ".join("d." + c for c in SHOWN)} FROM registry_docs d JOIN h ON h.doc_id = d.id JOIN r ON r.doc_id = d.id WHERE registration_date >= DATE '2023-01-01' ORDER BY registration_date DESC NULLS LAST, original_id DESC NULLS LAST, rank, id LIMIT 100""",
    "fts_refresh": _POSTINGS.replace("SELECT id AS doc_id, 'title' AS col, CAST(title AS VARCHAR) AS x", "SELECT id AS doc_id, 'title' AS col, CASE WHEN restriction = 'Avalik' THEN 'uus ' || coalesce(title, '') ELSE title END AS x") + " SELECT term, count(*) AS n FROM p GROUP BY term",
    "last_by_url": "SELECT id, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY created_at DESC NULLS LAST, id DESC) AS r FROM registry_docs) WHERE r = 1 OR url IS NULL",
    "new_documents": "SELECT id, url FROM registry_docs a WHERE created_at >= TIMESTAMP '2025-01-01' AND NOT EXISTS (SELECT 1 FROM registry_docs b WHERE b.url = a.url AND b.created_at < TIMESTAMP '2025-01-01')",
    "resume_ids": "SELECT organisation_id, coalesce(max(CASE WHEN regexp_full_match(original_id, '[0-9]{1,18}') THEN TRY_CAST(original_id AS BIGINT) END), 1) AS numeric_max, max(original_id) AS text_max FROM registry_docs GROUP BY organisation_id",
    "bases_by_kind": "SELECT basis, count(DISTINCT document_id) AS n_docs FROM restriction_bases WHERE basis IS NOT NULL GROUP BY basis",
    "audit_queue": "SELECT 'never' AS state, id FROM registry_docs WHERE last_visibility IS NULL OR updated_at IS NULL UNION ALL SELECT 'stale', id FROM registry_docs WHERE last_visibility IS NOT NULL AND updated_at < TIMESTAMP '2024-06-01' UNION ALL SELECT 'recheck', id FROM registry_docs WHERE last_visibility = 'AK' AND updated_at IS NOT NULL",
    "audit_candidates": f"""{_POSTINGS}, x AS (SELECT doc_id, list_aggregate(w, 'string_agg', ' ') AS s FROM l)
        SELECT DISTINCT doc_id AS id, '"toimik ' || k || '" NOT "on tasutud"' AS query FROM x, range(1, 20) r(k) WHERE s ~ ('(^| )toimik ' || k || '( |$)') AND doc_id NOT IN (SELECT doc_id FROM x WHERE s ~ '(^| )on tasutud( |$)')""",
    "listing_cap": "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY organisation_id, registration_date, restriction ORDER BY id) AS r FROM registry_docs WHERE organisation_id IS NOT NULL AND registration_date IS NOT NULL AND restriction IS NOT NULL) WHERE r <= 2",
    "poll_days": "SELECT id AS organisation_id, CAST(DATE '2026-05-14' - CAST(k AS INTEGER) AS DATE) AS listed_on FROM organisations, range(7) r(k)",
    "rate_windows": "SELECT user_id, time_bucket(INTERVAL 1 hour, ts) AS window_start, count(*) AS n, count(*) > 1 AS limited FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "miss_cutoff": """WITH p AS (SELECT fetch_id, strftime(fetched_at, '%Y-%m') AS day, NOT coalesce(regexp_matches(payload, '"data\\\\?": ?[{\\["]'), false) AS missed FROM rmk_records),
        q AS (SELECT *, missed AND coalesce(lag(missed) OVER (PARTITION BY day ORDER BY fetch_id), false) AS twice FROM p),
        f AS (SELECT day, min(fetch_id) AS last FROM q WHERE twice GROUP BY day)
        SELECT fetch_id FROM p LEFT JOIN f ON f.day IS NOT DISTINCT FROM p.day WHERE f.last IS NULL OR p.fetch_id <= f.last""",
    "url_parts": "SELECT id, regexp_extract(url, '^(https?://[^/:]+)', 1) AS site, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/*$', 1) AS last, coalesce(TRY_CAST(regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/*$', 1), '^(\\d{1,18})', 1) AS BIGINT), 0) AS number FROM registry_docs WHERE url IS NOT NULL",
    "text_functions": f"""SELECT id, regexp_replace(regexp_replace({_FOLD("title")}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, {_FOLD("title")} AS folded, 'NT' || lpad(upper(to_hex(id)), 8, '0') AS note, id AS number,
        ['jaanuar','veebruar','märts','aprill','mai','juuni','juuli','august','september','oktoober','november','detsember'][month(registration_date)] AS month, length(title) AS n_chars, strlen(title) AS n_bytes,
        coalesce(TRY_CAST(regexp_extract(original_id, '^\\s*([+-]?\\d{{1,18}})', 1) AS BIGINT), 0) AS as_number FROM registry_docs WHERE title IS NOT NULL""",
    "upsert_by_url": """WITH n AS (SELECT * FROM registry_docs WHERE created_at >= TIMESTAMP '2025-01-01')
        SELECT id, url FROM registry_docs WHERE created_at < TIMESTAMP '2025-01-01' AND (url IS NULL OR url NOT IN (SELECT url FROM n WHERE url IS NOT NULL))
        UNION ALL SELECT id, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY created_at DESC, id DESC) AS r FROM n) WHERE r = 1 OR url IS NULL""",
    "upserted_bases": """WITH b AS (SELECT d.url, d.created_at >= TIMESTAMP '2025-01-01' AS fresh FROM restriction_bases r JOIN registry_docs d ON d.id = r.document_id WHERE basis IS NOT NULL AND url IS NOT NULL AND created_at IS NOT NULL),
        n AS (SELECT DISTINCT url FROM registry_docs WHERE created_at >= TIMESTAMP '2025-01-01' AND url IS NOT NULL)
        SELECT url, count(*) AS n_bases FROM b WHERE fresh OR url NOT IN (SELECT url FROM n) GROUP BY url""",
    "dossier_page": "SELECT id, dossier FROM registry_docs WHERE dossier = (SELECT min(dossier) FROM (SELECT dossier FROM registry_docs WHERE dossier IS NOT NULL GROUP BY dossier HAVING count(*) > 1))",
    "relation_edges": """WITH d AS (SELECT id, organisation_id, dossier, original_id FROM registry_docs WHERE dossier IS NOT NULL AND original_id IS NOT NULL AND organisation_id IS NOT NULL),
        h AS (SELECT organisation_id, dossier, min(original_id) AS o FROM d GROUP BY 1, 2)
        SELECT DISTINCT d.id AS src, t.id AS dst FROM d JOIN h USING (organisation_id, dossier) JOIN registry_docs t ON t.original_id = h.o AND t.organisation_id = d.organisation_id WHERE t.id <> d.id""",
    "documents_of_files": """WITH RECURSIVE t AS (SELECT id, document_id AS root_document FROM files WHERE parent_id IS NULL UNION ALL SELECT f.id, t.root_document FROM files f JOIN t ON f.parent_id = t.id)
        SELECT f.id, coalesce(f.document_id, t.root_document) AS document_id FROM files f LEFT JOIN t ON t.id = f.id""",
    "file_classes": "SELECT CASE WHEN lower(regexp_extract(name, '\\.([^./\\\\]+)$', 1)) IN ('jpg', 'jpeg', 'png', 'gif', 'bmp', 'webp') THEN 'image' WHEN lower(regexp_extract(name, '\\.([^./\\\\]+)$', 1)) = 'xlsx' THEN 'sheet' ELSE 'other' END AS file_class, count(*) AS n FROM files GROUP BY 1",
    "sitemap_index": f"""SELECT 'https://registry.example/sitemap-pages.xml' AS loc, {_ISO("max(updated_at)")} AS lastmod FROM registry_docs
        UNION ALL SELECT 'https://registry.example/sitemaps/' || o.slug || '/' || strftime(registration_date, '%Y') || '.xml', {_ISO("max(d.updated_at)")} FROM registry_docs d JOIN organisations o ON o.id = d.organisation_id WHERE registration_date IS NOT NULL GROUP BY 1""",
    "sitemap_documents": f"""SELECT 'https://registry.example/dokumendid/' || d.id || coalesce('/' || regexp_replace(regexp_replace({_FOLD("title")}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS loc, {_ISO("d.updated_at")} AS lastmod, CAST(0.6 AS DOUBLE) AS priority
        FROM registry_docs d WHERE organisation_id = (SELECT id FROM organisations ORDER BY slug LIMIT 1) AND strftime(registration_date, '%Y') = '2024'""",
    "sitemap_urls": f"""WITH j AS (SELECT o.slug, strftime(registration_date, '%Y') AS y, strftime(registration_date, '%m') AS m, d.updated_at AS u FROM registry_docs d JOIN organisations o ON o.id = d.organisation_id)
        SELECT 'https://registry.example' AS loc, {_ISO("max(updated_at)")} AS lastmod, 'hourly' AS changefreq, CAST(1.0 AS DOUBLE) AS priority FROM registry_docs
        UNION ALL SELECT 'https://registry.example/arhiiv', {_ISO("max(updated_at)")}, NULL, 1.0 FROM registry_docs UNION ALL SELECT 'https://registry.example/projektist', '2024-03-27T00:00:00Z', NULL, 1.0
        UNION ALL SELECT 'https://registry.example/arhiiv/' || slug, {_ISO("max(u)")}, NULL, 0.8 FROM j GROUP BY slug
        UNION ALL SELECT 'https://registry.example/arhiiv/' || slug || '/' || y, {_ISO("max(u)")}, NULL, NULL FROM j WHERE y IS NOT NULL GROUP BY slug, y
        UNION ALL SELECT 'https://registry.example/arhiiv/' || slug || '/' || y || '/' || m, {_ISO("max(u)")}, NULL, NULL FROM j WHERE y IS NOT NULL GROUP BY slug, y, m""",
    "rate_first_hit": """WITH RECURSIVE e AS (SELECT user_id AS k, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        w(k, t, n, start, c) AS (SELECT k, t, n, t, 1 FROM e WHERE n = 1
            UNION ALL SELECT e.k, e.t, e.n, CASE WHEN e.t >= w.start + 86400000000 THEN e.t ELSE w.start END, CASE WHEN e.t >= w.start + 86400000000 THEN 1 ELSE w.c + 1 END FROM w JOIN e ON e.k = w.k AND e.n = w.n + 1)
        SELECT k, t, c <= 3 AS allowed FROM w""",
    "file_names": r"""SELECT id, CASE WHEN c IS NULL OR c IN ('', '.', '..') THEN 'file' ELSE c END AS safe, lower(regexp_extract(name, '\.([^./\\]+)$', 1)) AS ext, p AS encoded
        FROM (SELECT id, name, replace(regexp_replace(trim(regexp_replace(name, '^.*[/\\]', '')), '\s+', ' ', 'g'), '%', '_percent') AS c, replace(url_encode(storage_path), '%2F', '/') AS p FROM files)""",
    "namespace_words": "WITH l AS (SELECT chr(CAST(97 + k AS INTEGER)) AS x FROM range(26) r(k)) SELECT a.x || b.x || c.x || d.x AS name FROM l a, l b, l c, l d WHERE a.x <> b.x AND a.x <> c.x AND a.x <> d.x AND b.x <> c.x AND b.x <> d.x AND c.x <> d.x",
    "topic_components": """WITH RECURSIVE e AS (
            SELECT d.id AS a, min(d.id) OVER (PARTITION BY d.organisation_id, d.dossier) AS b FROM registry_docs d WHERE dossier IS NOT NULL AND organisation_id IS NOT NULL
            UNION SELECT d.id, min(d.id) OVER (PARTITION BY d.organisation_id, d.reference) FROM registry_docs d WHERE reference IS NOT NULL AND organisation_id IS NOT NULL),
        u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(n, m) AS (SELECT a, a FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.n)
        SELECT n AS id, min(m) AS topic_id FROM r GROUP BY n""",
}
ORACLES["fts_written"] = ORACLES["fts_ranked"]
