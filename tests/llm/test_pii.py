import pytest

from regispark.llm import pii

LEX = pii.Lexicon(["liisa", "vilne", "inko", "dmitri", "taiko"], ["metsa", "kivi", "etsa", "saar", "rand"])


def spans(text, party=False):
    return {(k, text[a:b]) for a, b, k in pii.pii_spans(text, LEX, party)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Kirjuta a.b_c1@x-y.example, palun.", {("email", "a.b_c1@x-y.example")}), ("(ab(at)x.test)", {("email", "ab(at)x.test")}), ("ab [at] x [punkt] test / 273 5364.", {("email", "ab [at] x [punkt] test"), ("phone", "273 5364")}), ("A.B@X.TEST", {("email", "A.B@X.TEST")}),
        ("tel (+372) 2541 8289.", {("phone", "(+372) 2541 8289")}), ("mob. 00372 222 4650", {("phone", "00372 222 4650")}), ("+3722981752", {("phone", "+3722981752")}), ("numbril +372-2765-6990 pärast", {("phone", "+372-2765-6990")}), ("2889 7685", {("phone", "2889 7685")}), ("222 67 11", {("phone", "222 67 11")}),
        ("Viitenumber on 993466071920, registrikood 1719200.", set()), ("Tellimuse 022695-75040 olek", set()), ("Arve nr 71967", set()), ("reg 13807620", set()), ("summa 2024 1234 eurot", set()),
        ("isikukood 81111235639", {("idcode", "81111235639")} if pii.id_code_holds("81111235639") else set()), ("i.k. 8091111-6910", {("idcode", "8091111-6910")} if pii.id_code_holds("80911116910") else set()), ("kood 12345678901", set()), ("99999999999", set()),
        ("elan Kooli 86, Hallipekülm.", {("address", "Kooli 86, Hallipekülm")}), ("Kivi tn 14-34, 99028 Nardiholaid", {("address", "Kivi tn 14-34, 99028 Nardiholaid")}), ("Vana-Turu pst 74a, Valkimaste 84776 ja", {("address", "Vana-Turu pst 74a, Valkimaste 84776")}),
        ("Põllu tänav 25 krt 29, Tiilatajärv eile", {("address", "Põllu tänav 25 krt 29, Tiilatajärv")}), ("Aia tee 1, Jaama alevik", {("address", "Aia tee 1, Jaama alevik")}), ("Loomäe talu, Kopna küla, Harna vald.", {("address", "Loomäe talu, Kopna küla, Harna vald")}),
        ("Kohtusime Vilne Lennumetsa ja L. Ranmikivi juures", {("name", "Vilne Lennumetsa"), ("name", "L. Ranmikivi")}), ("Arve maksab Tepkikivi, Inko.", {("name", "Tepkikivi, Inko")}), ("toimetati taiko petlusaar elukohta", {("name", "taiko petlusaar")}), ("hr Inko-Mai Tulvosaar", {("name", "Inko-Mai Tulvosaar")}),
        ("tasus Liisa Ehitus OÜ eile", set()), ("Vänvasaar, Kopnukivi ja esindaja", set()), ("Jänmesaar Kohus", set()), ("Lugupeetud vastaja", set()), ("", set()),
    ],
)
def test_spans(text, want):
    assert spans(text) == want


def test_parties():
    assert spans("Dimtri Halnumetsa, ik 1", True) == {("name", "Dimtri Halnumetsa")}
    assert spans("hr Liisa  Halnumetsa", True) == {("name", "Liisa  Halnumetsa")}
    assert spans("Halnumetsa Ehitus OÜ, kontakt: Liisa Tarmukivi", True) == {("name", "Liisa Tarmukivi")}
    assert spans("Halnumetsa Põhikool", True) == set()


def test_checks():
    assert pii.luhn("4539 1488 0343 6467") and not pii.luhn("4539 1488 0343 6468") and pii.mod97("EE38 2200 2210 2014 5685") and not pii.mod97("EE39 2200 2210 2014 5685")
    assert spans("konto EE38 2200 2210 2014 5685") == {("account", "EE38 2200 2210 2014 5685")} and spans("kaart 4539 1488 0343 6467") == {("card", "4539 1488 0343 6467")}
    assert spans("konto EE39 2200 2210 2014 5685") == set() and spans("kaart 4539 1488 0343 6468") == set()
    text = "Makske kontole EE38 2200 2210 2014 5685, kaart 4539 1488 0343 6467."
    assert pii.mask(text, pii.pii_spans(text, LEX)) == "Makske kontole [ACCOUNT], kaart [CARD]."
    assert pii.id_code_holds("37605030299") and not pii.id_code_holds("37605030298") and not pii.id_code_holds("37613030299")


@pytest.mark.parametrize("number", ["+44 20 7946 0958", "+358 40 123 4567", "+1 415 555 2671", "(+46) 8 123 456 78", "+49-30-901820"])
def test_phones_of_other_countries(number):
    assert spans(f"Helista {number} homme") == {("phone", number)}


def test_slips_in_given_names_are_found_by_thirds():
    lex = pii.Lexicon(["aleksander", "veronika", "liis", "ants"], [])
    near = {"aleksandre": True, "alksander": True, "verinika": True, "lis": False, "antso": True, "xyzw": False, "varenika": True, "aleksndar": True}
    assert {w: lex.is_misspelt(w) for w in near} == {w: any(pii.edits(w, g, 2 if len(w) > 5 else 1) <= (2 if len(w) > 5 else 1) and (g[0] == w[0] or g[1:3] == w[1:3]) for g in lex.given) for w in near}


def test_tables(spark):
    texts = ["Lugupeetud Liisa Tarmukivi!\nKirjutan a@b.test", None, "", "Lugupeetud Liisa Tarmukivi!\nKirjutan a@b.test", "sõna " * 50_000 + "a@b.test"]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "id bigint, t string, at int, kind2 string")
    lex = pii.learn_lexicon(df, "t")
    assert lex.given == {"liisa"}
    got = sorted((r["id"], r["kind"], r["pii_value"]) for r in pii.find_pii(df, "t", lex, ["id"]).collect())
    assert got == [(k, "email", "a@b.test") if j == 0 else (k, "name", "Liisa Tarmukivi") for k in (0, 3) for j in (0, 1)] + [(4, "email", "a@b.test")]
    masked = {r["id"]: r["masked"] for r in pii.mask_pii(df, "t", lex).collect()}
    assert masked[0] == "Lugupeetud [NAME]!\nKirjutan [EMAIL]" and masked[1] is None and masked[2] == ""
    assert pii.find_pii(df.limit(0), "t", lex, ["id"]).count() == 0


def test_masked_query_gives_mails_and_counterparties(spark, tmp_path):
    mail = "Lugupeetud Liisa Tarmukivi!\nKirjutan a@b.test"
    spark.createDataFrame([(1, "MsgParser", mail), (2, "MsgParser", mail), (3, "PdfParser", mail), (4, "MsgParser", None)], "id bigint, parsed_with string, contents string").write.parquet(f"{tmp_path}/files.parquet")
    payloads = ['{"data": [{"doc_trans_actor": "Liisa Tarmukivi, a@b.test"}, {"doc_trans_actor": "Metsa Amet"}]}', '{"data": {"doc_trans_actor": "Liisa Halnumetsa"}}', "{", None]
    spark.createDataFrame(list(enumerate(payloads, 1)), "fetch_id bigint, payload string").write.parquet(f"{tmp_path}/rmk_records.parquet")
    got = sorted(tuple(r[c] for c in ("tbl", "row_id", "masked")) for r in pii.p4_masked(spark, str(tmp_path)).collect())
    want = [("files", k, "Lugupeetud [NAME]!\nKirjutan [EMAIL]") for k in (1, 2)]
    assert got == [*want, ("rmk_records", 1, "Metsa Amet"), ("rmk_records", 1, "[NAME], [EMAIL]"), ("rmk_records", 2, "[NAME]")]
