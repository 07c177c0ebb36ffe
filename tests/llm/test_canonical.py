from regispark.llm.canonical import abbreviates, map_values, variants

REF = [(1, "a", "Kiri", "Letter", None), (2, "a", "Hankeleping", "Procurement contract", "HL"), (3, "a", "Leping", "Contract", "Lep."), (4, "b", "e-post", "Email", None), (5, "b", "Avaldamine edasi lükatud", "Deferred", "AEL"), (6, "b", "AK", "Asutusesiseseks kasutamiseks", None), (7, "a", "Istungi päevakord", "Agenda", None)]


def mapped(spark, *values):
    ref = spark.createDataFrame(REF, "ref_id int, field_name string, label string, alt_label string, short_label string")
    df = spark.createDataFrame([(f, v, 1) for f, v in values], "field_name string, value string, ref_id int")
    return {(r["field_name"], r["value"]): r["ref_id"] for r in map_values(df, ref).collect()}


def test_typing(spark):
    want = {"kiri": 1, "KIRI ": 1, "Kiri (koopia)": 1, "sissetulev kiri": 1, "lettre": 1, "Kiri/Letter": 1, "kiri nr 2": 1, "lepign": 3, "hankelepping": 2, "hl": 2, "Istun. päevakord": 7, "Foto": 0, "???": 0, "2026": 0, "x": 0, "e-post": 0}
    assert mapped(spark, *[("a", v) for v in want]) == {("a", v): k for v, k in want.items()}
    want = {"epost": 4, "eopst": 4, "meil": 4, "E-MAIL": 4, "Avald. lükatud": 5, "a k": 6, "A.K.": 6, "AK § 35": 6, "asutusesisesek kasutamiseks": 6, "Leping": 0}
    assert mapped(spark, *[("b", v) for v in want]) == {("b", v): k for v, k in want.items()}


def test_odd_values(spark):
    got = mapped(spark, ("a", None), ("a", ""), ("a", "  "), ("a", "kiri"), ("a", "kiri"), ("c", "kiri"), ("a", "pikk " * 3000))
    assert got == {("a", "kiri"): 1, ("c", "kiri"): 0, ("a", "pikk " * 3000): 0}
    assert mapped(spark) == {}


def test_ties_are_unmatched(spark):
    ref = spark.createDataFrame([(1, "a", "abcdx", None, None), (2, "a", "abcdy", None, None)], "ref_id int, field_name string, label string, alt_label string, short_label string")
    df = spark.createDataFrame([("a", "abcdz")], "field_name string, value string")
    assert map_values(df, ref).first()["ref_id"] == 0
    assert map_values(df, ref.limit(0)).first()["ref_id"] == 0


def test_parts():
    assert dict(variants("Kiri/Letter", 3))["kiri"] > 0.5 and abbreviates("Osal. avalik", "Osaliselt avalik") and not abbreviates("avalik", "Osaliselt avalik")


def test_the_cosine_decides_and_edits_only_reject(spark):
    """Swaps and slips of short values are found by their letters; what shares letters in another order is rejected."""
    want = {"lepnig": 3, "ikri": 1, "pingel": 0, "kir": 1, "leping leping": 3, "gnipel": 0}
    assert mapped(spark, *[("a", v) for v in want]) == {("a", v): k for v, k in want.items()}
