import pytest
from pyspark.sql import functions as F

from regispark.functions import text as V
from regispark.operators import filetree, fulltext, rollups, search, upsert
from regispark.sources import registries
from regispark.streaming import jobs


def test_header_file_names(spark):
    want = {
        "attachment; filename=\"a b.pdf\"": "a b.pdf", "attachment; filename=plain.pdf; size=3": "plain.pdf", "attachment; filename*=UTF-8''%C3%B5is%20a.pdf; filename=\"x.pdf\"": "õis a.pdf",
        "attachment; filename='k.pdf'": "k.pdf", "inline": "last name.pdf", "": "last name.pdf", None: "last name.pdf",
    }
    rows = spark.createDataFrame([(h, "https://x/y/last%20name.pdf?z=1") for h in want], "h string, u string")
    assert {r["h"]: r["n"] for r in rows.select("h", V.header_file_name(F.col("h"), F.col("u")).alias("n")).collect()} == want


def test_point_lookup(spark):
    docs = spark.createDataFrame([(1, 7, None), (2, 7, "AK"), (3, 7, "Avalik")], "id bigint, organisation_id bigint, last_visibility string")
    for c in ("title", "reference", "doc_type", "doc_function", "series", "dossier", "restriction", "to_party", "delivery_method", "responsible", "url", "original_id"):
        docs = docs.withColumn(c, F.lit(c))
    docs = docs.withColumn("registration_date", F.lit("2024-01-02").cast("date")).withColumn("created_at", F.current_timestamp())
    orgs = spark.createDataFrame([(7, "A", "a")], "id bigint, name string, slug string")
    files = spark.createDataFrame([(5, 1, None, "f", "p", "PdfParser", "t")], "id bigint, document_id bigint, parent_id bigint, name string, storage_path string, parsed_with string, contents string")
    assert search.point_lookup(docs, orgs, files, 9) == search.Found(404) and search.point_lookup(docs, orgs, files, 2) == search.Found(451)
    assert search.point_lookup(docs, orgs, files, 2, admin=True).status == 200
    row = search.point_lookup(docs, orgs, files, 1).row
    assert row["organisation"]["slug"] == "a" and [f["id"] for f in row["files"]] == [5]
    assert search.nothing(docs).count() == 0 and "rank" in search.nothing(docs).columns


def test_upserts_with_null_keys_and_children(spark):
    stored = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "url string, v int")
    incoming = spark.createDataFrame([("a", 4), ("a", 5), (None, 6), (None, 7), ("c", 8)], "url string, v int")
    assert sorted((r["v"] for r in upsert.upserted(stored, incoming, "url", ["v"]).collect())) == [2, 3, 5, 6, 7, 8]
    plan = upsert.last_by(incoming, "url", ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(url" in plan and "isnull(url" in plan
    old = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "url string, basis string")
    new = spark.createDataFrame([("a", "p"), ("a", "q"), ("other", "r")], "url string, basis string")
    got = sorted(map(tuple, upsert.with_children(old, incoming, new).collect()), key=repr)
    assert got == [("a", "p"), ("a", "q"), ("b", "y"), (None, "z")] or sorted(got, key=str) == sorted([("a", "p"), ("a", "q"), ("b", "y"), (None, "z")], key=str)


def test_merge_names_both_sides(spark):
    """No table format here has MERGE; the condition must at least resolve, so that only this is what Spark complains of."""
    spark.sql("CREATE TABLE IF NOT EXISTS merge_target (id bigint, v int) USING parquet")
    try:
        with pytest.raises(Exception, match="(?i)merge"):
            upsert.merge_into(spark.createDataFrame([(1, 2)], "id bigint, v int"), "merge_target", "id")
    finally:
        spark.sql("DROP TABLE merge_target")


def test_written_index_reads_the_buckets_of_its_words(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"sõna{k} ühine tekst") for k in range(50)], "id bigint, title string")
    fulltext.write_index(fulltext.build_index(docs), str(tmp_path), 16)
    index = fulltext.read_index(spark, str(tmp_path))
    found = fulltext.match_docs(index, "sõna7 ühine", ["title"])
    assert [r["doc_id"] for r in found.collect()] == [7]
    plan = index.lookup(fulltext._leaves(fulltext.parse_query("sõna7", ["title"])))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "pmod" not in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert fulltext.match_docs(index, "sõna1*", ["title"]).count() == 11
    over = fulltext.index_over(docs)
    for q in ("sõna7 OR sõna9", "ühine NOT sõna3", '"ühine tekst"', "sõn* NOT tekst"):
        want = sorted(r["doc_id"] for r in fulltext.match_docs(fulltext.build_index(docs), q, ["title"]).collect())
        assert want == sorted(r["doc_id"] for r in fulltext.match_docs(index, q, ["title"]).collect()) == sorted(r["doc_id"] for r in fulltext.match_docs(over, q, ["title"]).collect())
    assert sorted(map(tuple, fulltext.match(index, "sõna7").collect())) == sorted(map(tuple, fulltext.match(over, "sõna7").collect()))
    assert sorted(map(tuple, fulltext.match_all(index, ["sõna7", "sõna8"]).collect())) == [(7, "sõna7"), (8, "sõna8")]


def test_index_is_kept_by_a_stream_of_batches(spark):
    docs = spark.createDataFrame([(1, "vana", None), (2, "teine", None)], "id bigint, title string, updated_at timestamp")
    state = {"index": fulltext.build_index(docs), "epochs": []}

    def write(index, epoch):
        state["index"] = index
        state["epochs"].append(epoch)

    jobs.keep_index(lambda: state["index"], write)(docs.where("id = 1").withColumn("title", F.lit("uus")), 4)
    terms = sorted((r["term"], r["doc_id"]) for r in state["index"].postings.collect())
    assert terms == [("teine", 2), ("uus", 1)] and state["epochs"] == [4]


def test_sitemaps(spark, tmp_path):
    docs = spark.createDataFrame([(1, 7, "2024-01-02", "Õigus & kord", "2024-05-01 10:00:00"), (2, 7, "2023-01-02", "x", "2023-05-01 10:00:00")], "id bigint, organisation_id bigint, d string, title string, u string")
    docs = docs.select("id", "organisation_id", F.col("d").cast("date").alias("registration_date"), "title", F.col("u").cast("timestamp").alias("updated_at"))
    orgs = spark.createDataFrame([(7, "a")], "id bigint, slug string")
    assert sorted(r["loc"] for r in rollups.sitemap_index(docs, orgs, "https://x/").collect()) == ["https://x/sitemap-pages.xml", "https://x/sitemaps/a/2023.xml", "https://x/sitemaps/a/2024.xml"]
    assert [tuple(r) for r in rollups.sitemap_documents(docs, orgs, "a", 2024, "https://x").collect()] == [("https://x/dokumendid/1/oigus-kord", "2024-05-01T10:00:00Z", None, 0.6)]
    with pytest.raises(LookupError):
        rollups.sitemap_documents(docs, orgs, "none", 2024, "https://x")
    rollups.write_sitemap_index(rollups.sitemap_index(docs, orgs, "https://x").coalesce(1), f"{tmp_path}/i")
    text = "".join(p.read_text() for p in (tmp_path / "i").glob("part*"))
    assert "sitemapindex xmlns=" in text and "</sitemapindex>" in text and text.count("<sitemap>") == 3


def test_signatures_go_with_their_files_and_join_them(spark):
    files = spark.createDataFrame([(1, None, 10), (2, 1, None), (3, None, 10)], "id bigint, parent_id bigint, document_id bigint")
    signed = spark.createDataFrame([(2, "A B", "1", "t1"), (2, "C D", "2", "t2"), (3, "E", None, None)], "file_id bigint, name string, pno string, signing_time string")
    bases = spark.createDataFrame([(10, "p 1"), (10, "p 1"), (10, None), (11, "p 2")], "document_id bigint, basis string")
    assert [r["file_id"] for r in filetree.rows_without(signed, files, files.where("id = 1")).collect()] == [3]
    got = {r["id"]: (len(r["signatures"]), r["bases"]) for r in filetree.with_signatures(files, signed, bases).collect()}
    assert got == {1: (0, ["p 1"]), 2: (2, []), 3: (1, ["p 1"])}


def test_summaries_are_made_once_and_in_batches(spark):
    texts = spark.createDataFrame([(1, "x" * 200), (2, "short"), (3, "y" * 200)], "document_id bigint, text string")
    docs = spark.createDataFrame([(1, None), (2, None), (3, "done")], "id bigint, ai_summary string")
    got = filetree.summarised(texts, docs, lambda batch: [(t[:2], str(len(t))) for t in batch]).collect()
    assert [tuple(r) for r in got] == [(1, "xx", "200")]


def test_seeds(spark):
    lines = spark.createDataFrame([("https://a.test/one/",), ("",), ("https://b.test/two",), ("https://a.test/one/",)], "value string")
    got = {r["registry_base_uri"]: (r["name"], r["fetcher_type"]) for r in registries.seeded_organisations(lines, [("B", "bb", "https://b.test/two", "rmk")]).collect()}
    assert got == {"https://a.test/one/": ("one", "delta-adr"), "https://b.test/two": ("B", "rmk")}
    with pytest.raises(ValueError, match="fetcher"):
        registries.seeded_organisations(lines, [("B", "bb", "https://b.test", "no")])


def test_no_checkpoint_folder_of_one_machine_on_a_cluster():
    from regispark.session import checkpoint_folder

    class Conf:
        get = staticmethod(lambda _: None)

    class Empty:
        isEmpty = staticmethod(lambda: True)

    class Jsc:
        sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: Empty)}))

    context = type("C", (), {"_jsc": Jsc, "getConf": staticmethod(lambda: Conf), "master": "spark://host:7077"})
    with pytest.raises(RuntimeError, match="checkpoint"):
        checkpoint_folder(type("Session", (), {"sparkContext": context}))
