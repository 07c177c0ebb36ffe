import json

from regispark.operators.shredding import ROOT, infer_schema_graph, plan_inlining, shred, valid_records
from regispark.plans.record_tables import file_objects

FILE = lambda i, **k: {"id": i, "file_name": f"f{i}", **k}


def table(spark, payloads):
    return spark.createDataFrame([(i, p) for i, p in enumerate(payloads, 1)], "fetch_id bigint, payload string")


def found(spark, payloads):
    df = table(spark, payloads)
    return {tuple(r) for r in file_objects(df, plan_inlining(infer_schema_graph(df, "payload"), ["failid"])).where("file_id is not null").collect()}


def test_shapes_of_nested_files(spark):
    nested = [FILE(1, failid=[FILE("2", failid={"0": FILE(3), "1": None})]), FILE(4), {"file_name": "no id"}]
    data = {"id": 9, "failid": nested, "doc_proceeder": {"who": "x"}}
    want = {(0, 1), (1, 2), (2, 3), (0, 4)}
    shapes = [{"data": data}, {"data": [data]}, {"data": json.dumps(data)}, {"data": {**data, "failid": json.dumps(nested)}}, {"data": {**data, "failid": {str(i): f for i, f in enumerate(nested)}}}]
    payloads = [json.dumps(s) for s in shapes] + [json.dumps(json.dumps(shapes[0]))]
    assert found(spark, payloads) == {(k, *w) for k in range(1, 7) for w in want}


def test_records_without_files(spark):
    odd = [None, "", "{", '{"data":false}', '{"data":null}', '{"data":{"id":1,"failid":null}}', '{"data":{"id":1,"failid":"not json ["}}', "[]", "3", '"text"', json.dumps({"data": {"failid": FILE("x")}})]
    assert found(spark, odd) == set()
    assert found(spark, []) == set()


def test_inlining_rules(spark):
    df = table(spark, [json.dumps({"a": {"x": 1, "b": {"y": 2}}, "list": [{"z": 1}, {"z": 2}], "c": {"b2": {"q": 1}}, "d": {"b2": {"q": 3}}, "e": {"e": {"v": 1}}})])
    plan = plan_inlining(infer_schema_graph(df, "payload"))
    assert plan.why == {ROOT: "root", "list": "repeated", "b2": "shared", "e": "recursive"}
    row = shred(df, "payload", plan, ROOT, ["fetch_id"]).first()
    assert (row["a_x"], row["a_b_y"]) == ("1", "2")
    links = {(r["_parent_table"], r["q"]) for r in shred(df, "payload", plan, "b2", ["fetch_id"]).collect()}
    assert links == {("record", "1"), ("record", "3")}


def test_every_file_keeps_its_parent_row(spark):
    df = table(spark, [json.dumps({"data": {"failid": [FILE(1, failid=[FILE(2)])]}})])
    plan = plan_inlining(infer_schema_graph(df, "payload"))
    out = shred(df, "payload", plan, "failid", ["fetch_id"], "id").collect()
    keys = {r["_key"] for r in out}
    assert all(r["_parent_key"] in keys for r in out if r["_parent_table"] == "failid")


def test_clashing_columns_and_repeats(spark):
    p = json.dumps({"data": {"failid": [FILE(1)]}})
    df = spark.createDataFrame([(7, p, "a", 1), (7, p, "b", 2)], "fetch_id bigint, payload string, id string, _key int")
    plan = plan_inlining(infer_schema_graph(df, "payload"), ["failid"])
    assert shred(df, "payload", plan, "failid", ["fetch_id"], "id").count() == 2
    assert shred(df, "payload", plan, "failid", ["id"], "id").columns[0] == "id"


def test_lone_files_are_found(spark):
    assert found(spark, [json.dumps({"data": {"failid": FILE(5)}})]) == {(1, 0, 5)}


def test_deep_and_long_texts(spark):
    deep = {"id": 60}
    for i in range(59, 0, -1):
        deep = {"id": i, "failid": [deep]}
    long = json.dumps({"data": {"doc_headline": "x" * 300_000, "failid": [deep]}})
    assert len(found(spark, [long])) == 60
    assert found(spark, ["[" * 100_000]) == set()


def test_validity(spark):
    out = [r["is_valid"] for r in valid_records(table(spark, ["{}", "{", None]), "payload").orderBy("fetch_id").collect()]
    assert out == [True, False, None]
