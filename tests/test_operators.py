import datetime as dt

import pytest
from pyspark.sql import functions as F

from regispark.functions import text as V
from regispark.operators import audit, filetree, rollups, topics, upsert
from regispark.operators.components import connected_components
from regispark.operators.fulltext import build_index

FILES = "id bigint, document_id bigint, parent_id bigint, name string, storage_path string, parsed_with string, contents string, html string"


def one(spark, column, schema="x string", value=("",)):
    return spark.createDataFrame([value], schema).select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("fn", "text", "want"),
    [
        (V.lenient_date, "3. märts 2024", dt.date(2024, 3, 3)), (V.lenient_date, "03.03.2024 12:10", dt.date(2024, 3, 3)), (V.lenient_date, "2024-03-03T01:02:03", dt.date(2024, 3, 3)), (V.lenient_date, "31.02.2024", None), (V.lenient_date, None, None),
        (V.strict_date, "1.2.2024", dt.date(2024, 2, 1)), (V.strict_date, "2024-02-01", None), (V.slug, " Õigus & kord! ", "oigus-kord"), (V.slug, "", ""), (V.url_uuid, "https://x/dokument/0A1b2c3d-0000-1111-2222-333344445555/", "0a1b2c3d-0000-1111-2222-333344445555"),
        (V.url_uuid, "https://x/", None), (V.trailing_id, "https://x/dokument/123/", 123), (V.trailing_id, "https://x/dokument/a1", 0), (V.extension, "A.b/C.PDF", "pdf"), (V.extension, "none", ""), (V.strip_tags, "<b>a</b><br>c", "ac"),
        (V.whole_number, " 12ab", 12), (V.whole_number, "ab", 0), (V.breaks, "a\nb", "a<br />\nb"), (V.encoded_path, "a b/õ", "a%20b/%C3%B5"), (V.bases, "a, b, , 0, a", ["a", "b"]), (V.site, "https://h.example/x/y", "https://h.example"),
    ],
)
def test_functions(spark, fn, text, want):
    assert one(spark, fn(F.col("x")), value=(text,)) == want


def test_more_functions(spark):
    assert one(spark, V.file_name(F.col("x"), F.lit("f")), value=("..\\a/ b  50%.txt ",)) == "b 50_percent.txt"
    assert one(spark, V.file_name(F.col("x"), F.lit("f")), value=("..",)) == "f"
    assert one(spark, V.absolute(F.col("x"), F.lit("https://h.example/a/b")), value=("/c/d",)) == "https://h.example/c/d"
    assert one(spark, V.note_number(V.note_id(F.lit(4276514)))) == 4276514
    assert one(spark, V.lag_shown(F.lit(dt.datetime(2024, 1, 2, 12)), F.lit(dt.date(2024, 1, 1)))) == 2


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (6, 6), (None, 1), (1, 2), *((k, k + 1) for k in range(10, 60))], "src bigint, dst bigint")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, **{k: 10 for k in range(10, 61)}}
    assert connected_components(e.limit(0)).count() == 0


@pytest.fixture(scope="module")
def files(spark):
    data = [(1, 10, None, "a.asice", "s", "AsiceParser", None, None), (2, None, 1, "b.txt", "s", "TxtParser", "bee", None), (3, 10, 1, "c.txt", "s", "TxtParser", "<i>cee</i>", None), (4, None, 3, "d", "s", "FileParser", None, None), (5, 10, None, "c.txt", "s", "TxtParser", "again", None), (6, 11, 99, "lost", "s", "TxtParser", "x", None), (7, 11, 8, "l1", "s", "", "x", None), (8, 11, 7, "l2", "s", "", "x", None)]
    return spark.createDataFrame(data, FILES)


def test_file_tree(files, rows):
    assert rows(filetree.depths(files)) == [(1, 1, 0), (2, 1, 1), (3, 1, 1), (4, 1, 2), (5, 5, 0)]
    assert rows(filetree.descendants(files, files.where("id = 7"))) == [(7,), (8,)]
    assert rows(filetree.without(files, files.where("id = 3")).select("id")) == [(1,), (2,), (5,), (6,), (7,), (8,)]
    assert {r["id"]: r["document_id"] for r in filetree.document_of(files).collect()}[2] == 10
    contents = {r[0]: r[1] for r in filetree.file_contents(files).collect()}
    assert contents[10] == "c.txt <i>cee</i>  c.txt again"
    assert {r[0]: r[1] for r in filetree.summary_text(files).collect()}[10] == "cee"
    assert filetree.depths(files.limit(0)).count() == 0


def test_replace_keeps_the_place(spark, files, rows):
    parsed = spark.createDataFrame([(20, None, None, "n.zip", "s", "AsiceParser", None, None), (21, None, 20, "n.txt", "s", "TxtParser", "new", None)], FILES)
    out = filetree.replaced(files, 3, parsed)
    assert rows(out.select("id", "parent_id")) == [(1, None), (2, 1), (20, 1), (21, 20), (5, None), (6, 99), (7, 8), (8, 7)]
    assert out.count() == files.count() - 1 - 1 + 2


def test_summary_gate_counts_bytes_and_characters(spark, rows):
    texts = spark.createDataFrame([(1, "õ" * 51), (2, "a" * 100), (3, "a" * 16000), (4, "a" * 16001), (5, "b" * 200)], "document_id bigint, text string")
    docs = spark.createDataFrame([(1, None), (2, None), (3, ""), (4, None), (5, "done")], "id bigint, ai_summary string")
    assert rows(filetree.may_summarise(texts, docs)) == [(1,), (3,)]


@pytest.fixture(scope="module")
def archive(spark):
    docs = spark.createDataFrame([(1, 1, "2023-12-31", "AK", "10"), (2, 1, "2024-01-01", "Avalik", "9"), (3, 1, "2024-02-01", "Asutusesiseseks kasutamiseks", "8"), (4, 2, None, "AK", None)], "id bigint, organisation_id bigint, d string, restriction string, original_id string")
    docs = docs.selectExpr("id", "organisation_id", "cast(d as date) registration_date", "restriction", "original_id", "timestamp'2024-05-01' updated_at")
    return docs, spark.createDataFrame([(1, "A", "a"), (2, "B", "b"), (3, "C", "c")], "id bigint, name string, slug string")


def test_rollups(archive, rows, tmp_path):
    docs, orgs = archive
    assert rows(rollups.years(docs)) == [("2023", 1, 1), ("2024", 2, 0), (None, 1, 1)]
    assert rows(rollups.months(docs, 2024)) == [("01", 1, "jaanuar"), ("02", 1, "veebruar")]
    assert [r["id"] for r in rollups.month_listing(docs, 2023, 12).collect()] == [1]
    stats = {r["slug"]: (r["n_docs"], r["n_restricted"], r["restricted_pct"]) for r in rollups.organisation_stats(docs, orgs).collect()}
    assert stats == {"a": (3, 1, 33.33), "b": (1, 1, 100.0), "c": (0, 0, None)}
    assert rollups.freshness(docs, orgs).count() == 5
    with pytest.raises(LookupError):
        rollups.of_organisation(docs, orgs, "nope")
    urls = rollups.sitemap_urls(docs, orgs, "https://x.example/")
    assert "https://x.example/arhiiv/a/2024/01" in {r["loc"] for r in urls.collect()}
    rollups.write_sitemap(urls, f"{tmp_path}/s")
    assert docs.sparkSession.read.format("xml").option("rowTag", "url").load(f"{tmp_path}/s").count() == urls.count()


def test_year_filter_is_pushed(spark, archive, tmp_path):
    archive[0].write.mode("overwrite").parquet(f"{tmp_path}/d")
    plan = rollups.months(spark.read.parquet(f"{tmp_path}/d"), 2024)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(registration_date" in plan and "LessThan(registration_date" in plan


def test_upserts(spark, rows):
    stored = spark.createDataFrame([(1, "u1", 1), (2, "u2", 1), (3, None, 1)], "id bigint, url string, v int")
    new = spark.createDataFrame([(4, "u2", 2), (5, "u2", 3), (6, "u3", 1), (7, None, 1)], "id bigint, url string, v int")
    once = upsert.upserted(stored, new, "url", ["v"])
    assert rows(once.select("id")) == [(1,), (3,), (5,), (6,), (7,)]
    assert rows(upsert.new_only(new, stored, "url").select("id")) == [(6,), (7,)]
    keyed = new.where("url is not null")
    again = upsert.upserted(upsert.upserted(stored, keyed, "url", ["v"]), keyed, "url", ["v"])
    assert rows(again) == rows(upsert.upserted(stored, keyed, "url", ["v"]))
    ids = spark.createDataFrame([(1, "99"), (1, "411"), (1, "x"), (2, "x"), (3, None)], "organisation_id bigint, original_id string")
    assert rows(upsert.resume_ids(ids, 7)) == [(1, 411, "x"), (2, 7, "x"), (3, 7, None)]
    orgs = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, None)], "id bigint, last_fetched_at timestamp")
    seen = spark.createDataFrame([(1, dt.datetime(2024, 2, 1)), (1, dt.datetime(2024, 1, 5))], "id bigint, fetched_at timestamp")
    assert rows(upsert.stamped(orgs, seen)) == [(1, dt.datetime(2024, 2, 1)), (2, None)]


def test_audits(spark, rows):
    docs = spark.createDataFrame([(1, None, None, None, 1, "u"), (2, "AK", "r", dt.datetime(2024, 1, 1), 1, "u"), (3, "Avalik", None, dt.datetime(2024, 6, 1), 9, "u")], "id bigint, last_visibility string, last_reason string, last_audit_check_at timestamp, organisation_id bigint, url string")
    assert rows(audit.never_audited(docs).select("id")) == [(1,)]
    assert rows(audit.stale(docs, "2024-03-01").select("id")) == [(2,)]
    assert rows(audit.to_recheck(docs).select("id")) == [(2,)]
    res = spark.createDataFrame([(1, False, "AK", "why", "chg", dt.datetime(2024, 7, 1)), (2, True, None, None, None, dt.datetime(2024, 7, 2))], "id bigint, failed boolean, visibility string, reason string, reason_change string, checked_at timestamp")
    out = {r["id"]: (r["last_visibility"], r["last_reason"]) for r in audit.apply_results(docs, res).collect()}
    assert out == {1: ("AK", "why"), 2: ("Unknown", "r"), 3: ("Avalik", None)}
    texts = spark.createDataFrame([(1, "Alus: AvTS § 35 lg 1 p 9"), (2, "Alus: AvTS § 35 lg 1 p 9. Struktuurüksus on tunnistatud"), (3, "Alus: AvTS § 35 lg 1 p 91")], "id bigint, title string")
    assert {r["id"] for r in audit.candidates(build_index(texts, ["title"])).collect()} == {1}
    orgs = spark.createDataFrame([(1, "a")], "id bigint, slug string")
    seen = spark.createDataFrame([(1, "AK")], "id bigint, visibility string")
    assert audit.report(build_index(texts, ["title"]), docs, orgs, seen).select("visibility", "slug", "id").collect()[0] == ("AK", "a", 1)


def test_topics(spark, rows):
    docs = spark.createDataFrame([(1, 1, "a", None), (2, 1, "b", None), (3, 2, "a", None), (4, 1, "c", None)], "id bigint, organisation_id bigint, original_id string, registration_date date")
    rel = spark.createDataFrame([(1, "b", 1), (4, "a", 1), (3, "b", 2)], "id bigint, related_original_id string, organisation_id bigint")
    t = topics.topics(topics.relation_edges(rel, docs))
    assert rows(t) == [(1, 1), (2, 1), (4, 1)]
    assert [r["id"] for r in topics.siblings(docs, t, 2).collect()] == [4, 1]
