import pytest

from regispark.llm.mailtext import aligned_runs, inherited_lines, new_lines, new_text_lines, reduced, shingles

LONG = "See on üks täiesti tavaline pikk lause kirja sees."


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("Tere\n\nUus tekst.\n\nLugupidamisega,\nLiisa Mets\nnõunik\ntel 123 4567", [1, 3]), ("Uus tekst siin.\nLiisa Mets\njurist\nMetsa Amet", [1]), ("Tekst.\n\nLgp\n--\nL. Mets\n\nP.S. Veel midagi tuli meelde.", [1, 7]), ("Tekst.\nNB! Sõnum on konfidentsiaalne; levitamine keelatud.", [1]),
        ("Tekst.\n\nSent from my phone", [1]), ("Liisa Mets kirjutas 3.05.2024:\n> vana\n>> vanem\nVastus siia.\n> vana\nTeine vastus.", [4, 6]), ("Edastan.\n\n-----Algne sõnum-----\nSaatja: A\nTeema: B\n\nVana tekst.", [1]), ("Uus.\n\n________________________________\nSaatja: A B\nSaatmisaeg: 1\nTeema: B\nVana.", [1]),
        ("Uus.\n\nFrom: A B <a@b.test>\nSent: 1.1.2024\nTo: C\nSubject: D\n\nVana.", [1]), ("Uus.\n\nOn 03.05.2024 16:15, Liisa Mets wrote:\n>vana", [1]), ("Nagu kolleeg kirjutas: tähtaeg on jäik.\nTeie kirjas jäi Saatja: lahter tühjaks.", [1, 2]), ("12.11.2022 15:58 Liisa Mets kirjutas:\nvana ilma märgita", []), ("\n \n", []), ("", []),
    ],
)
def test_lines(body, want):
    assert new_lines(body) == want


def test_inherited_lines_are_removed(spark):
    rows = [(1, f"Tere\n{LONG}\nJa teine üsna pikk lause selles kirjas kah."), (2, f"Liisa kirjutas 1.2.2024:\n> {LONG}\nMinu vastus.\nJa teine üsna pikk lause selles kirjas kah."), (3, "Ja teine üsna pikk lause selles kirjas kah."), (4, None), (5, ""), (None, "Tere")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id bigint, contents string, h string, line_no int")
    got = sorted(((r["id"], r["line_no"]) for r in new_text_lines(df, "id", "contents").collect()), key=repr)
    assert got == sorted([(1, 1), (1, 2), (1, 3), (2, 3), (3, 1), (None, 1)], key=repr)
    assert new_text_lines(df.limit(0), "id", "contents").count() == 0


def test_long_bodies(spark):
    df = spark.createDataFrame([(1, "\n".join(["Rida tekstiga."] * 20_000))], "id bigint, contents string")
    assert new_text_lines(df, "id", "contents").count() == 20_000


def test_threads_through_copies_headings_and_other_line_breaks(spark):
    other = "Ja teine üsna pikk lause selles kirjas kah."
    first = f"Tere\n{LONG}\n{other}"
    quoted = f"Liisa kirjutas 1.2.2024:\n> {LONG}\n"
    rows = [
        (1, first), (2, first), (3, f"{quoted}Minu vastus.\n{other}"),
        (4, f"Edastan.\n{other}\n\n-----Algne sõnum-----\nSaatja: A\nTeema: B\n\n{LONG}"),
        (5, f"{quoted}Uus mõte.\nSee on üks täiesti tavaline pikk\nlause kirja sees. Ja\nteine üsna pikk lause selles kirjas kah."),
        (6, f"Esimene oma lause on siin vastuses täiesti olemas.\n{quoted}"), (7, f"Mari kirjutas 2.2.2024:\n> Esimene oma lause on siin vastuses täiesti olemas.\nNii on.\n{other}"),
    ]
    got = sorted(tuple(r) for r in new_text_lines(spark.createDataFrame(rows, "id bigint, contents string"), "id", "contents").collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 3), (4, 1), (5, 3), (6, 1), (7, 3)]


def test_marks_alone_keep_what_threads_remove(spark):
    """Without the comparison with ancestors the unmarked lines would count as new."""
    other = "Ja teine üsna pikk lause selles kirjas kah."
    body = f"Liisa kirjutas 1.2.2024:\n> {LONG}\nMinu vastus.\n{other}"
    assert new_lines(body) == [3, 4]
    df = spark.createDataFrame([(1, f"Tere\n{LONG}\n{other}"), (2, body)], "id bigint, contents string")
    assert [r["line_no"] for r in new_text_lines(df, "id", "contents").where("id = 2").collect()] == [3]


def test_alignment_keeps_the_order():
    a, b = "üks kaks kolm neli viis".split(), "kuus seitse kaheksa üheksa kümme".split()
    assert aligned_runs(a + b, a + ["vahe"] + b) == [(0, 0, 5), (5, 6, 5)]
    assert len(aligned_runs(a + b, b + a)) == 1
    assert aligned_runs(a + ["x"] + b, b + ["y"] + a + b) == [(0, 6, 5), (6, 11, 5)]
    assert aligned_runs(a[:4], a[:4]) == [] and aligned_runs([], a) == []
    many = ["sama"] * 3000
    assert sum(n for *_, n in aligned_runs(many, many)) >= 3000
    assert len(shingles(a + b)) == 6 and shingles(a + b)[5] == shingles(b)[0]
    assert inherited_lines([(1, "Tere"), (2, "üks kaks kolm neli viis lisa")], [" ".join(a)]) == [2]


def test_long_signatures_and_lists(spark):
    lines = "\n".join(["Liisa Mets", *["Metsa Amet"] * 12])
    assert new_lines(f"Tekst on siin ja jätkub.\n{lines}") == [1]
    assert len(new_lines("\n".join(f"Nimi Perenimi{k}" for k in range(20_000)) + "\nja see on kõik, mida ma täna öelda tahtsin.")) == 20_001


def test_reduced_text(spark):
    rows = [(1, "Tere\r\n\r\nUus tekst.\r\n\r\nLugupidamisega,\r\nLiisa Mets"), (2, ""), (3, None), (None, "Tere"), (4, "> vana")]
    got = {r["id"]: r["new_text"] for r in reduced(spark.createDataFrame(rows, "id bigint, contents string"), "id", "contents").collect()}
    assert got == {1: "Tere\nUus tekst.", 2: "", None: "Tere", 4: ""}
