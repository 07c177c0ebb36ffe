import numpy as np

from regispark.llm import scans as sc

GOOD = "Kontrollimisel tuvastati puudust, neist olulisim puudutab hooldust ja talitus esitas taotluse. Piirangu alus on lisatud toimikusse."


def corpus(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate([GOOD] * 60 + list(texts))], "id bigint, contents string")


def found(spark, *texts):
    df = corpus(spark, *texts)
    out = {}
    for r in sc.scan_findings(df, "id", "contents").where(f"id >= 60").collect():
        out.setdefault(r["id"] - 60, set()).add((r["line_no"], r["kind"], r["word"]))
    return out


def test_misread_words(spark):
    got = found(spark, "Kontro1limisel fuvastati pnudust, neist o1ulisim.\n\ntahtus esitas taot1use. Piirangu alus on lisatud toirnikusse.", GOOD)
    assert got == {0: {(1, "bad_char", w) for w in ("Kontrollimisel", "tuvastati", "puudust", "olulisim")} | {(3, "bad_char", w) for w in ("talitus", "taotluse", "toimikusse")}}


def test_broken_words_and_furniture(spark):
    text = "Mingi Vallavalitsus\nKontrollimisel tuvas-\ntati puudust, neist olulisim puudu\xad\n1 / 2\n\x0cMingi Vallavalitsus\n\ntab hooldust e-\npost ja\nID-\nkaart.\n2 / 2"
    got = found(spark, text, *["e-post ja ID-kaart"] * 20)[0]
    assert {(k, w) for k, kind, w in got if kind == "broken_word"} == {(2, "tuvastati"), (3, "puudutab"), (7, "e-post"), (9, "ID-kaart")}
    assert {k for k, kind, _ in got if kind == "furniture"} == {1, 4, 5, 11}


def test_tables_are_no_page_numbers():
    lines = "Sissejuhatus algab siin ja kestab pika rea lõpuni välja\nNimetus\nKogus\nhooldus\n33\nkokku 5,00 eurot\n1\n\nTekst jätkub siin pikal real kuni lehe lõpuni välja ka\n2".split("\n")
    assert sc.furniture(lines) == {6, 9}


def test_reflow(spark):
    df = corpus(spark, "Kontrollimisel tuvas-\ntati puudust,\nneist o1ulisim.\n\nPiirangu alus\n- 1 -\non lisatud.", None, "", "\n\n")
    out = {r["id"] - 60: r["repaired"] for r in sc.repair(df, "contents").where("id >= 60").collect()}
    assert out == {0: "Kontrollimisel tuvastati puudust, neist olulisim.\n\nPiirangu alus on lisatud.", 1: None, 2: "", 3: ""}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "id bigint, contents string")
    assert sc.scan_findings(empty, "id", "contents").count() == 0
    clash = corpus(spark, "fuvastati").selectExpr("id", "contents", "'w' word", "1 line_no", "'t' text")
    assert sc.scan_findings(clash, "id", "contents").where("id = 60").count() == 1
    assert found(spark, GOOD + " fuvastati" + " tuvastati" * 50_000)[0] == {(1, "bad_char", "tuvastati")}
    assert found(spark, None, "", "\n \n") == {}


def test_every_vocabulary_word_has_a_vector(spark):
    """Rare words behind 4500 more frequent ones, with neighbours as rare as they are."""
    letters = "bdgjkprvxy"
    many = [a + "a" + b + "a" + c + "a" + d for a in letters for b in letters for c in letters for d in letters][:4500]
    texts = ["ja " + " ja ".join(many)] * 6 + ["üks kaks hanu kolm neli", "üks kaks halu kolm neli", "viis kuus hann seitse kaheksa"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, contents string")
    v = sc.learn_model(df, "contents").vectors
    assert all(v.get(w) is not None and np.linalg.norm(v.get(w)) > 0.9 for w in ("hanu", "hann", many[0], many[-1]))
    assert float(v.get("hanu") @ v.get("halu")) > 0.9 > float(v.get("hanu") @ v.get("hann"))


def test_recurring_misreadings_are_found_whatever_the_size(spark):
    """A misreading less than 15 times as rare as its word, at one size and at eight times that size; a real word stays."""
    rows = [GOOD] * 60 + [GOOD.replace("tuvastati", "fuvastati")] * 6 + ["Nende aastate enne oli pikk ja lai."] * 12 + ["Vana kiri, mille ennc kirjutas sai otsa."] * 6
    for times in (1, 8):
        df = spark.createDataFrame(list(enumerate(rows * times)), "id bigint, contents string")
        got = {(r["word"], r["n"]) for r in sc.scan_findings(df, "id", "contents").groupBy("word").count().withColumnRenamed("count", "n").collect()}
        assert got == {("tuvastati", 6 * times)}


def test_vectors_decide(spark):
    """A misreading nearly as frequent as its word is told by its neighbours alone: the same model without vectors leaves it."""
    rows = [GOOD] * 60 + ["Nende aastate enne oli pikk ja lai."] * 12 + ["Nende aastate ennc oli pikk ja lai."] * 6
    model = sc.learn_model(spark.createDataFrame(list(enumerate(rows)), "id bigint, contents string"), "contents")
    bare = sc.ScanModel(model.counts, sc.Vectors({}, np.zeros((0, sc.DIMENSIONS))), model.triples, model.pairs, model.least)
    assert list(sc.findings(rows[-1], model)) == [(1, "bad_char", "enne")] and not list(sc.findings(rows[-1], bare))


def test_repaired_text_and_findings_agree(spark):
    text = "Kontrollimisel fuvas-\ntati puudust, neist\no1ulisim puudutab\nhooldust ja taIitus"
    model = sc.learn_model(corpus(spark), "contents")
    out = sc.repaired(text, model)
    assert all(w in out for _, kind, w in sc.findings(text, model) if kind != "furniture")


def test_long_lines_words_and_number_columns():
    model = sc.ScanModel({"sõna": 50, "teine": 40}, sc.Vectors({}, np.zeros((0, sc.DIMENSIONS))), {}, {})
    assert list(sc.findings("x" * 50_000 + " sõna", model)) == []
    assert sc.furniture([str(n) for n in range(5000, 7000)]) == set(range(2000))
    head = "Väga Pika Nimega Riikliku Registri Ja Arhiivi Ning Raamatukogu Ühisosakond"
    body = "Siin on tekst, mis jätkub ja jätkub kuni rea lõpuni välja ning veel kaugemale"
    lines = [head, body, body, "1 / 2", head, body, body, "2 / 2"]
    assert {0, 3, 4, 7} <= sc.furniture(lines)
