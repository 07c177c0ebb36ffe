import datetime as dt
import random

from pyspark.sql import functions as F

from regispark.operators.fulltext import Index, build_index, match_docs
from regispark.streaming import jobs


def at(s):
    return dt.datetime(2024, 1, 1, 0, 0, s)


def test_poll_dates(spark, rows):
    orgs = spark.createDataFrame([(1,)], "id bigint")
    assert rows(jobs.poll_dates(orgs, "2024-03-01", 2)) == [(1, dt.date(2024, 2, 29)), (1, dt.date(2024, 3, 1))]


def test_cutoff(spark, rows):
    p = spark.createDataFrame([("a", k, m) for k, m in enumerate([False, True, False, True, True, True, False])] + [("b", 0, True), ("b", 1, False)], "g string, k int, missed boolean")
    assert rows(jobs.before_cutoff(p, "g", "k", "missed", 2).select("g", "k")) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 0), ("b", 1)]


def test_cutoff_over_ranges(spark, rows):
    """One group holds most rows and is cut into several ranges; runs of misses cross them."""
    rnd = random.Random(3)
    for most, share in ((1, 0.2), (3, 0.6), (7, 0.8), (40, 0.9)):
        probes = [(g, k, rnd.random() < share) for g, n in (("a", 400), ("b", 30), (None, 60), ("c", 1)) for k in range(n)]
        want, run, over = [], {}, set()
        for g, k, m in probes:
            if g not in over:
                want.append((g, k, "x"))
                run[g] = run.get(g, 0) + 1 if m else 0
                if run[g] >= most:
                    over.add(g)
        df = spark.createDataFrame([(g, k, m, "x") for g, k, m in probes], "g string, k int, missed boolean, cut string").repartition(8)
        assert rows(jobs.before_cutoff(df, "g", "k", "missed", most).select("g", "k", "cut")) == sorted(want, key=repr)
    assert jobs.before_cutoff(df.limit(0), "g", "k", "missed", 2).count() == 0


def test_first_hit_windows(spark):
    h = spark.createDataFrame([("x", at(s)) for s in (0, 1, 2, 9, 10, 11)] + [("y", at(5)), (None, at(1)), ("x", None)], "ip string, ts timestamp")
    got = [(r["k"], r["allowed"]) for r in jobs.first_hit_limits(h, "ip", "ts", 10, 2).orderBy("k", "t").collect()]
    assert got == [("x", True), ("x", True), ("x", False), ("x", False), ("x", True), ("x", True), ("y", True)]


def test_rate_windows_as_stream(spark, tmp_path):
    h = spark.createDataFrame([("x", at(s)) for s in (0, 1, 2, 11)], "ip string, ts timestamp")
    h.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(h.schema).parquet(f"{tmp_path}/in").withWatermark("ts", "1 minute")
    q = jobs.rate_windows(stream, "ip", "ts", 10, 2).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["n"], r["limited"]) for r in spark.table("rates").collect()) == [(1, False), (3, True)]


def test_index_follows_a_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "vana", at(0)), (2, "teine", at(0))], "id bigint, title string, updated_at timestamp")
    state = {"index": build_index(docs, ["title"])}

    def write(index: Index, epoch: int) -> None:
        state["index"] = Index(spark.createDataFrame(index.postings.collect(), index.postings.schema), spark.createDataFrame(index.doc_stats.collect(), index.doc_stats.schema))

    spark.createDataFrame([(1, "uus", at(2)), (1, "vahepeal", at(1))], docs.schema).write.parquet(f"{tmp_path}/in")
    q = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in").writeStream.foreachBatch(jobs.keep_index(lambda: state["index"], write, ["title"])).option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    find = lambda w: {r[0] for r in match_docs(state["index"], w, ["title"]).collect()}
    assert (find("uus"), find("vana"), find("vahepeal"), find("teine")) == ({1}, set(), set(), {2})


def test_listing_cap(spark, rows):
    d = spark.createDataFrame([(k, 1, dt.date(2024, 1, 1), "Avalik") for k in range(5)] + [(9, 1, dt.date(2024, 1, 1), "AK")], "id bigint, organisation_id bigint, registration_date date, restriction string")
    assert rows(jobs.capped_listing(d, 3).select("id")) == [(0,), (1,), (2,), (9,)]
    assert jobs.capped_listing(d.limit(0)).count() == 0 and F is not None
