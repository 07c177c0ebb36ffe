import pytest

from regispark.llm import names
from regispark.llm.names import damerau, linked_names, remains, trans_actors
from regispark.llm.parties import Pivots, edits, head_of, read_party, readings

GIVEN = ["Andreas", "Veronika", "Kristjan", "Dmitri"]


def table(spark, values):
    return spark.createDataFrame([(v, 1) for v in values], "value string, n bigint")


def population():
    """Enough people and firms that given names and lines of business are frequent words and surnames are not."""
    roots = ["Tarmukivi", "Sorvelaid", "Pihtonurm", "Kalduvere", "Mölnajärv", "Hünsupaväli", "Jaaderand"] + [f"{a}{b}{c}" for a in ("Tam", "Vih", "Ros", "Pet", "Lin") for b in ("noko", "suda", "veri") for c in ("salu", "mäe", "oja")]
    out = []
    for i, root in enumerate(roots):
        out += [f"{GIVEN[i % 4]} {root}", f"{GIVEN[(i + 1) % 4]} {root}", f"{root} Ehitus OÜ" if i % 2 else f"{root} Transport AS"]
    return out


@pytest.fixture(autouse=True)
def frequent(monkeypatch):
    monkeypatch.setattr(names, "LEAST_PIVOT", 18)


def entities(spark, extra):
    got = {r["value"]: r["entity"] for r in linked_names(table(spark, population() + extra)).collect()}
    return got


def test_variants_of_people(spark):
    same = ["Andreas Tarmukivi", "ANDREAS TARMUKIVI", "Tarmukivi, Andreas", "Tarmukivi Andreas", "hr Andreas  Tarmukivi", "Andreas M. Tarmukivi", "Ants Tarmukivi", "And. Tarmukivi", "Andreas Tarmukvi", "Anderas Tarmukivi", "Andreas Tarmukivi, tel +372 2345 6789", "Andreas Tarmukivi; Kooli 5, Sorvelaid"]
    e = entities(spark, same)
    assert len({e[v] for v in same}) == 1
    assert e["Veronika Tarmukivi"] != e["Andreas Tarmukivi"]


def test_variants_of_firms(spark):
    same = ["Sorvelaid Ehitus OÜ", "OÜ Sorvelaid Ehitus", '"Sorvelaid Ehitus" OÜ', "Sorvelaid-Ehitus OÜ", "Sorvelaid Ehitus osaühing", "Ehitus Sorvelaid OÜ", "SORVELAID EHITUS OÜ", "Sorvelaid Eh. OÜ", "Sorvelaid Ehitsu OÜ", "Sorvelaid Ehitus", "Sorvelaid Ehitus OÜ, kontakt: Dmitri Jaaderand"]
    e = entities(spark, same)
    assert len({e[v] for v in same}) == 1
    assert e["Sorvelaid Ehitus OÜ"] != e["Kalduvere Ehitus OÜ"]


def test_initials_need_one_fit(spark):
    e = entities(spark, ["D. Kalduvere", "Kalduvere A.", "V. Kalduvere"])
    assert e["D. Kalduvere"] == e["Dmitri Kalduvere"] and e["Kalduvere A."] == e["Andreas Kalduvere"] and e["V. Kalduvere"] not in (e["Dmitri Kalduvere"], e["Andreas Kalduvere"])


def test_odd_values(spark):
    e = entities(spark, [None, "", "-", "  ", "Eraisik", "eraisik", "x" * 50_000, "1234"])
    assert e["Eraisik"] == e["eraisik"] and None not in e and "-" not in e and "1234" not in e
    assert linked_names(table(spark, [])).count() == 0
    assert linked_names(table(spark, ["Üks"])).first()["value"] == "Üks"


def test_reading():
    assert head_of("Mets OÜ - +372 2345 6789, Kooli 1") == "Mets OÜ" and head_of("Jaan Tamm (jaan [at] x [punkt] ee)") == "Jaan Tamm" and head_of("Mets OÜ reg 12345678") == "Mets OÜ"
    p = Pivots(["andreas", "ehitus"], ["ehitus"])
    assert readings(read_party("A. Tarmukivi"), p)[0].pivot == "andreas" and readings(read_party("Tundmatu Sõna"), p)[0].pivot == ""


def test_metric():
    assert damerau("metsa", "mesta") == 1 and damerau("", "ab") == 2 and damerau("a" * 40_000 + "xy", "a" * 40_000 + "yx") == 1 and damerau("abcd", "wxyz", 2) == 3 and edits("abc", "abd", 1) == 1 and edits("abc", "xyz", 1) == 2
    assert remains("abcdefgh") & remains("bacdefgh") and remains("abcd") == {"abcd"}
    long = "".join(chr(97 + (k * k) % 23) for k in range(60))
    assert remains(long) & remains(long[:20] + long[21:40] + "q" + long[40:]) and remains(long[:33]) & remains(long[:32]) and len(remains("x" * 50_000)) < 150


def test_metric_holds_the_triangle_inequality():
    words = ["", "a", "ca", "ac", "abc", "cab", "bca", "acb", "tarmu", "tamru", "tramu", "tarm", "atrmu"]
    d = {(a, b): damerau(a, b, 9) for a in words for b in words}
    assert d["ca", "abc"] == 2 and all(d[a, b] == d[b, a] for a in words for b in words)
    assert all(d[a, c] <= d[a, b] + d[b, c] for a in words for b in words for c in words)
    assert all(damerau(a, b, 2) == min(3, d[a, b]) for a in words for b in words)


def test_actors_keep_their_fetch(spark):
    df = spark.createDataFrame([(1, '{"data":{"doc_trans_actor":"A B"}}', 5), (2, '"{\\"data\\":[{\\"doc_trans_actor\\":\\"C\\"}]}"', 6), (3, None, 7), (4, "{", 8)], "fetch_id bigint, payload string, value int")
    assert sorted((r["fetch_id"], r["value"]) for r in trans_actors(df, ["fetch_id"]).collect()) == [(1, "A B"), (2, "C")]


def test_recurring_slips_follow_a_name_with_far_more_rows(spark):
    """Both names are attested in three ways; only their shares tell a slip from a namesake, at any size."""
    ways = ["Andreas {}", "{}, Andreas", "Andreas {}, tel 123 4567"]
    for times in (1, 1000):
        for rows, same in ((2, True), (900, False)):
            values = [(w.format("Tarmukivi"), 1000 * times) for w in ways] + [(w.format("Tarmokivi"), rows * times) for w in ways] + [(v, 1) for v in population()]
            got = {r["value"]: r["entity"] for r in linked_names(spark.createDataFrame(values, "value string, n bigint")).collect()}
            assert (got["Andreas Tarmukivi"] == got["Andreas Tarmokivi"]) == same
            assert len({got[w.format("Tarmokivi")] for w in ways}) == 1
