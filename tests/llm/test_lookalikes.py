import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from regispark.llm import lookalikes as la


def test_pairs_look_the_same(spark):
    base = "Märgukiri nr 5: 20 m² kokku"
    texts = [base, base, unicodedata.normalize("NFD", base), base.replace(" ", " "), base.replace("ri", "r​i"), base.replace("5", "５"), base.replace("k", "к").replace("o", "о"), base.replace("²", "2"), base.replace("ä", "a"), base + "\n", "", None, "M"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {tuple(r) for r in la.same_look_pairs(df, "doc_id", "text").collect()}
    alike = [0, 1, 2, 3, 4, 5]
    assert got == {(a, b) for a in alike for b in alike if a < b and texts[a] != texts[b]}  # small Cyrillic k is no look-alike


def test_repair_needs_the_vocabulary(spark):
    df = spark.createDataFrame([(1, "kоhus tegi otsuse", "x"), (2, "kohus", "y"), (3, "tuntmаtu", "z"), (4, "прoверка проверка", "w"), (5, None, "v"), (6, "", "u"), (7, "​", "t"), (1, "kоhus tegi otsuse", "x")], "id bigint, text string, look_key2 string")
    out = [(r["id"], r["text_norm"]) for r in la.unify(df, "text").orderBy("id").collect()]
    assert out == [(1, "kohus tegi otsuse")] * 2 + [(2, "kohus"), (3, "tuntmаtu"), (4, "проверка проверка"), (5, None), (6, ""), (7, "")]
    assert la.unify(df, "text").columns == ["id", "text", "look_key2", "text_norm", "look_key"]


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert la.same_look_pairs(empty, "doc_id", "text").count() == 0
    long = "sõna " * 40_000
    df = spark.createDataFrame([(1, long), (2, long.replace("sõna ", "sõnа ", 1)), (None, long)], "doc_id bigint, text string")
    assert [tuple(r) for r in la.same_look_pairs(df, "doc_id", "text").collect()] == [(1, 2)]


def test_dominant_script():
    form = lambda t, doubt="latin": la.form_of(la.skeleton(t), doubt)
    assert form("kоhus") == "kohus" and form("прoверка") == "проверка" and form("plain") == "plain"
    assert form("сор") == "cop" and form("cop", "cyrillic") == "сор"
    assert la.dominant(la.skeleton("Еще одна проверка")) == "cyrillic" and la.dominant(la.skeleton("Еще cop")) == "cyrillic" and la.dominant(la.skeleton("cop сор")) == "latin"


def test_one_form_for_each_look(spark):
    """Tokens of one script in the wrong place, repairs outside the vocabulary, three scripts: one form for each look."""
    looks = [
        ["СОРТ nr 5 jah", "COPT nr 5 jah", "CОPT nr 5 jah"], ["tuntmаtu siin", "tuntmatu siin", "tuntmаtu siin\u200b"], ["rnaоs x", "rnаos x", "rnаоs x"],
        ["а и б сидели", "a и б сидели"], ["Ꭺpᴏx\u00a0k", "Apᴏx k"], ["𝐓𝐞𝐫𝐞 maailm", "Tere maailm"], ["ΑΒΕ", "ABE", "АВЕ"], ["ⅣX b", "IVX b"], ["сор", "cop"],
    ]
    rows = [(10 * k + i, t) for k, g in enumerate(looks) for i, t in enumerate(g)]
    out = {r["doc_id"]: (r["text_norm"], r["look_key"]) for r in la.unify(spark.createDataFrame(rows, "doc_id bigint, text string"), "text").collect()}
    for k, g in enumerate(looks):
        assert len({out[10 * k + i] for i in range(len(g))}) == 1, g
    assert len({n for n, _ in out.values()}) == len(looks)
    got = {tuple(r) for r in la.same_look_pairs(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()}
    assert got == {(10 * k + a, 10 * k + b) for k, g in enumerate(looks) for a in range(len(g)) for b in range(a + 1, len(g))}
    assert out[30][0] == "а и б сидели" and out[0][0] == "COPT nr 5 jah"


def test_large_vocabularies_are_joined(spark, monkeypatch):
    rows = [(1, "kоhus tegi otsuse"), (2, "kohus"), (3, "tuntmаtu")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    want = sorted(map(tuple, la.unify(df, "text").collect()))
    monkeypatch.setattr(la, "MOST_SOUGHT", 0)
    assert sorted(map(tuple, la.unify(df, "text").collect())) == want


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aeocpxyABCEKMаеосрхАВЕКМжя ä​ ", max_size=30))
def test_forms_are_stable(text):
    assert la.plain(la.plain(text)) == la.plain(text)
    assert la.skeleton(la.skeleton(text)) == la.skeleton(text)
    assert la.skeleton(la.plain(text)) == la.skeleton(text)
