import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from regispark.operators import fulltext as ft
from regispark.operators.search import RequestError, SearchRequest, hits, page, page_numbers, visible

TEXTS = {
    1: ("Leping nr 5", "kirja lisas on leping"), 2: ("Õigus ja kord", "otsuse peale saab esitada vaide"), 3: ("leping", "taotlus ja leping"), 4: (None, "Metsatee hooldus"), 5: ("vaide otsuse", ""), 6: ("", None),
}


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame([(k, *v) for k, v in TEXTS.items()], "id bigint, title string, file_contents string")
    return ft.Index(ft.postings_of(df).cache(), ft.build_index(df).doc_stats.cache())


def ids(index, q):
    return {r[0] for r in ft.match_docs(index, q).collect()}


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("leping", {1, 3}), ("LEPING", {1, 3}), ("oigus", {2}), ("õigus", {2}), ("leping NOT taotlus", {1}), ("oigus OR metsatee", {2, 4}), ("leping taotlus", {3}), ("leping AND taotlus", {3}), ('"kirja lisas"', {1}),
        ("kirja + lisas + on", {1}), ("mets*", {4}), ('"kirja li" *', {1}), ("title : leping", {1, 3}), ("{title file_contents} : taotlus", {3}), ("- title : leping", {1, 3}), ("- title : oigus", set()), ("^ leping", {1, 3}), ("^ taotlus", {3}),
        ("NEAR(otsuse vaide, 3)", {2, 5}), ("NEAR(otsuse vaide, 2)", {5}), ("(leping OR oigus) NOT taotlus", {1, 2}), ("leping OR oigus NOT kord", {1, 3}), ('""', set()),
    ],
)
def test_queries(index, query, want):
    assert ids(index, query) == want


@pytest.mark.parametrize("bad", ["1-2/3", "", "AND", "leping AND", "(leping", '"open', "nocol : x", "leping )", "NEAR(", "NEAR(a, x)", "-", "a ++ b"])
def test_syntax_errors(bad):
    with pytest.raises(ft.QuerySyntaxError):
        ft.parse_query(bad)


def test_precedence():
    t = ft.parse_query("a OR b AND c NOT d e")
    assert t.kind == "or" and t.right.kind == "and" and t.right.right.kind == "not" and t.right.right.right.kind == "and"


WORDS = ["aru", "bel", "cor", "dim"]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS), max_size=6), min_size=1, max_size=5), st.lists(st.sampled_from(WORDS), min_size=1, max_size=3))
def test_phrase_is_brute_force(spark, docs, phrase):
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "id bigint, title string")
    got = {r[0] for r in ft.match_docs(ft.build_index(df), '"' + " ".join(phrase) + '"').collect()}
    want = {i for i, d in enumerate(docs) if re.search(rf"(^| ){' '.join(phrase)}( |$)", " ".join(d))}
    assert got == want


def test_rank_prefers_rare_and_short(index):
    r = {x["doc_id"]: x["rank"] for x in ft.match(index, "leping OR oigus").collect()}
    assert set(r) == {1, 2, 3} and all(v < 0 for v in r.values())


def test_refresh_equals_rebuild(spark, index):
    changed = spark.createDataFrame([(1, "uus pealkiri", None)], "id bigint, title string, file_contents string")
    gone = spark.createDataFrame([(3,)], "id bigint")
    new = ft.refreshed(index, changed, gone=gone)
    whole = spark.createDataFrame([(k, *(("uus pealkiri", None) if k == 1 else v)) for k, v in TEXTS.items() if k != 3], "id bigint, title string, file_contents string")
    again = ft.build_index(whole)
    assert sorted(map(tuple, new.postings.collect())) == sorted(map(tuple, again.postings.select("term", "doc_id", "col", "pos").collect()))
    assert ids(new, "pealkiri") == {1} and ids(new, "leping") == set()


def test_index_on_disk(spark, index, tmp_path):
    ft.write_index(index, str(tmp_path), 4)
    assert ids(ft.read_index(spark, str(tmp_path)), "leping") == {1, 3}


def test_search_requests(spark, index):
    docs = spark.createDataFrame(
        [(1, 1, "Avalik", "2024-01-05", "10", "2024-02-20 00:00:00", None), (2, 1, "AK", "2024-01-06", "9", "2024-01-07 00:00:00", "AK"), (3, 2, "Avalik", "2024-01-05", "9", "2024-01-05 12:00:00", "Unknown"), (4, 2, "Avalik", None, None, None, "Avalik")],
        "id bigint, organisation_id bigint, restriction string, registration_date string, original_id string, created_at string, last_visibility string",
    ).selectExpr("id", "organisation_id", "restriction", "cast(registration_date as date) registration_date", "original_id", "cast(created_at as timestamp) created_at", "last_visibility")

    def run(**k):
        q = SearchRequest(**k)
        return [r["id"] for r in page(hits(docs, q, index), q).collect()]

    assert run() == [3, 1, 4]  # text order of original ids: "9" before "10"
    assert run(with_restricted=True, date_end="2024-01-05") == [3, 1]
    assert run(with_restricted=True, min_delta=30) == [1]
    assert run(org_ids=(2,)) == [3, 4]
    assert run(query="leping") == [3, 1]
    assert run(page=2) == []
    assert sorted(r["id"] for r in visible(docs).collect()) == [1, 4]
    assert page_numbers(0, SearchRequest())["last_page"] == 1 and page_numbers(201, SearchRequest(page=3)) == {"total": 201, "per_page": 100, "current_page": 3, "last_page": 3}
    for bad in ({"page": 0}, {"sort_by": "x"}, {"query": "x" * 501}, {"date_start": "1.2.2024"}):
        with pytest.raises(RequestError):
            SearchRequest(**bad)
    assert SearchRequest.from_params({"org_ids": "1, 2x", "with_restricted": "1", "min_delta": "-3d"}) == SearchRequest(org_ids=(1, 2), with_restricted=True, min_delta=-3)


def test_page_is_a_top_k_with_pushed_filters(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 organisation_id", "'Avalik' restriction", "date'2024-01-01' registration_date", "cast(id as string) original_id", "timestamp'2024-01-01' created_at").write.parquet(f"{tmp_path}/d")
    q = SearchRequest(org_ids=(1, 2), date_start="2024-01-01", page=2)
    plan = page(hits(spark.read.parquet(f"{tmp_path}/d"), q), q)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(registration_date" in plan and "Cartesian" not in plan
