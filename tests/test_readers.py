import struct
import zlib

import pytest

from regispark.sources import attachments as at
from regispark.sources.listing import enumerated, form_ids, lister, note_ids, register_source
from regispark.sources.msg import read_compound, read_msg
from regispark.sources.pdf import pdf_text, unicode_map


def compound(tree):
    """A compound file with small sectors of 64 bytes for everything below 4096, from nested dicts of bytes."""
    entries, pool, small_fat, big = [("Root Entry", 5, None, b"")], b"", [], []

    def add(name, node):
        at_ = len(entries)
        entries.append((name, 1 if isinstance(node, dict) else 2, node, b""))
        return at_

    links = {0: [0xFFFFFFFF] * 3}

    def below(parent, node):
        kids = [add(k, v) for k, v in node.items()]
        for a, b in zip(kids, [*kids[1:], 0xFFFFFFFF]):
            links[a] = [0xFFFFFFFF, b, 0xFFFFFFFF]
        links[parent][2] = kids[0] if kids else 0xFFFFFFFF
        for k, v in zip(kids, node.values()):
            if isinstance(v, dict):
                below(k, v)

    below(0, tree)
    starts = {}
    for i, (_, kind, node, _) in enumerate(entries):
        if kind == 2:
            if len(node) < 4096:
                n = -(-len(node) // 64)
                starts[i] = len(small_fat) if n else 0xFFFFFFFE
                small_fat += [*range(len(small_fat) + 1, len(small_fat) + n), 0xFFFFFFFE] if n else []
                pool += node.ljust(n * 64, b"\0")
            else:
                big.append(i)
    sectors, fat = [], []

    def put(data):
        first = len(sectors)
        n = max(1, -(-len(data) // 512))
        sectors.extend(data[k * 512 : (k + 1) * 512].ljust(512, b"\0") for k in range(n))
        fat.extend([*range(first + 1, first + n), 0xFFFFFFFE])
        return first

    root_start = put(pool)
    small_start = put(struct.pack(f"<{len(small_fat)}I", *small_fat))
    for i in big:
        starts[i] = put(entries[i][2])
    directory = b""
    for i, (name, kind, node, _) in enumerate(entries):
        raw = name.encode("utf-16-le") + b"\0\0"
        size = len(pool) if i == 0 else len(node) if kind == 2 else 0
        directory += raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<3I", *links[i]) + b"\0" * 36 + struct.pack("<IQ", root_start if i == 0 else starts.get(i, 0), size)
    dir_start = put(directory)
    fat_start = len(sectors)
    fat.append(0xFFFFFFFD)
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIIII", 0, 1, dir_start, 0, 4096, small_start, 1, 0xFFFFFFFE, 0, fat_start)
    return head.ljust(512, b"\xff") + b"".join(sectors) + table


def wide(text):
    return text.encode("utf-16-le")


def test_mail_files():
    inner = {"__substg1.0_1000001F": wide("Sisemine")}
    raw = compound({
        "__substg1.0_1000001F": wide("Õige tekst\r\nteine rida"), "__substg1.0_10130102": b"<html><head><meta charset=utf-8></head><body><p>\xc3\x95ige <b>tekst</b></p></body></html>",
        "__attach_version1.0_#00000000": {"__substg1.0_3707001F": wide("suur.txt"), "__substg1.0_37010102": b"x" * 9000}, "__attach_version1.0_#00000001": {"__substg1.0_3704001F": wide("a.msg"), "__substg1.0_3701000D": inner},
    })
    text, html, found = read_msg(raw)
    assert text == "Õige tekst\r\nteine rida" and b"<b>tekst</b>" in html
    assert [(n, len(d)) for n, d in found] == [("suur.txt", 9000), ("a.msg.txt", 8)]
    files, _ = at.unpack("x/kiri.msg", raw)
    assert [(f[3], f[5], (f[6] or "")[:11]) for f in files] == [("kiri.msg", "MsgParser", "Õige tekst"), ("suur.txt", "TxtParser", "x" * 11), ("a.msg.txt", "TxtParser", "Sisemine")]
    assert all(f[1] == files[0][0] for f in files[1:])
    bare, _ = at.unpack("b.msg", compound({"__attach_version1.0_#00000000": {"__substg1.0_3707001F": wide("a.txt"), "__substg1.0_37010102": b"hi"}}))
    assert [(f[3], f[6], f[7]) for f in bare] == [("b.msg", None, ""), ("a.txt", "hi", None)]
    assert at.unpack("c.msg", b"broken")[0][0][6:8] == (None, "")
    with pytest.raises(ValueError, match="compound"):
        read_compound(b"no")


def pdf(pages, packed=True):
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <0020> endbfchar 1 beginbfrange <0010> <0012> <00D5> endbfrange"
    stream = lambda d, extra=b"": b"<<" + extra + (b"/Filter/FlateDecode" if packed else b"") + b"/Length 1>>stream\n" + (zlib.compress(d) if packed else d) + b"\nendstream"
    out = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[" + b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages))) + b"]>>", 3: stream(cmap), 4: b"<</Type/Font/ToUnicode 3 0 R>>", 5: b"<</Type/Font/BaseFont/Times>>"}
    for k, content in enumerate(pages):
        out[10 + 2 * k] = b"<</Type/Page/Parent 2 0 R/Resources<</Font<</F1 4 0 R/F2 5 0 R>>>>/Contents %d 0 R>>" % (11 + 2 * k)
        out[11 + 2 * k] = stream(content)
    return b"%PDF-1.5\n" + b"\n".join(b"%d 0 obj\n" % n + b + b"\nendobj" for n, b in out.items()) + b"\n%%EOF"


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_text(packed):
    raw = pdf([b"BT /F2 12 Tf 1 0 0 1 50 700 Tm (Esimene \\(rida\\)) Tj 0 -14 Td [(te) 20 (ine) -400 (s\\365na)] TJ ET", b"BT /F1 9 Tf <001000030011> Tj T* <0012> Tj ET"], packed)
    assert pdf_text(raw) == "Esimene (rida)\nteine sõna\n\fÕ Ö\n×"
    files, _ = at.unpack("a.pdf", raw)
    assert files[0][5:8] == ("PdfParser", "Esimene (rida)\nteine sõna\n\fÕ Ö\n×", "Esimene (rida)<br />\nteine sõna<br />\n\fÕ Ö<br />\n×")


def test_pdf_without_text():
    assert pdf_text(b"") is None and pdf_text(pdf([b""])) is None and pdf_text(b"%PDF broken") is None
    assert at.unpack("a.pdf", b"%PDF broken")[0][0][6:8] == (None, "")
    assert unicode_map(b"")[0] == {} and unicode_map(b"beginbfrange <01> <02> [<0041> <0042>] endbfrange") == ({1: "A", 2: "B"}, 1)


def test_containers_of_any_depth_and_replacements(tmp_path):
    import io
    import zipfile

    data, name = b"tere", "a.txt"
    for k in range(30):
        box = io.BytesIO()
        with zipfile.ZipFile(box, "w") as z:
            z.writestr(name, data)
        data, name = box.getvalue(), f"{k}.zip"
    files, _ = at.unpack("top.zip", data)
    assert len(files) == 31 and files[-1][6] == "tere"
    assert at.unpack("x.xml", b"<a/>")[0] == [] and [f[5] for f in at.unpack("x.xml", b"<a/>", replacing=True)[0]] == ["FileParser"]


def test_uploads_and_blobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"abc")
    (tmp_path / "in" / "b.txt").write_bytes(b"x" * 100)
    folder = str(tmp_path / "in")
    assert at.stored_files(spark, folder).count() == 2 and at.stored_files(spark, folder, 50).count() == 1
    assert [r["length"] for r in at.refused_uploads(spark, folder, 50).collect()] == [100]
    for r in at.stored_blobs(at.stored_files(spark, folder), str(tmp_path / "out")).collect():
        assert (tmp_path / "out" / r["storage_path"]).stat().st_size == r["size"]


def test_listing_pages():
    rows = lambda n, at_=0: "<table>" + "".join(f'<tr><td><a href="/x/dokument/{at_ + k}">t</a></td></tr>' for k in range(n)) + "</table>"
    asked = []

    def get(r):
        asked.append((r.get("restriction"), r.get("page")))
        return {("Avalik", 1): rows(20), ("Avalik", 2): rows(2, 20), ("AK", 1): rows(19, 50)}[asked[-1]]

    assert len(list(form_ids(get, "s", "2024-01-01"))) == 41 and asked == [("Avalik", 1), ("Avalik", 2), ("AK", 1)]
    note = lambda n: "<entries>" + "".join(f'<document noteid="NT{k:08X}"/>' for k in range(n)) + "</entries>"
    pages = {1: note(20), 2: note(0)}
    assert len(list(note_ids(lambda r: pages[r["page"]], "s", "d"))) == 20


def test_lister_skips_what_fails_and_repeats():
    def get(r):
        if r["kind"] == "list":
            return "one two two bad"
        if r["id"] == "bad":
            raise OSError("500")
        return f"body {r['id']}"

    register_source("test-type", lambda get, site, day: ((x, "") for x in get({"site": site, "kind": "list"}).split()), lambda body, site: (True, {}, [], [], [], []))
    assert list(lister(get)({"fetcher_type": "test-type", "site": "s", "listed_on": "d"})) == [("one", "body one"), ("two", "body two"), ("bad", "")]


def test_enumeration():
    there = {3: '{"data": {"id": 3}}', 5: '{"data": {"id": 5}}', 40: '{"data": {"id": 40}}'}
    get = lambda r: there.get(int(r["id"]), '{"data": false}')
    assert [i for i, _ in enumerated(get, "s", "rmk", 1)] == ["3", "5"]
    assert [i for i, _ in enumerated(get, "s", "rmk", 45, last=1)] == ["40", "5", "3"]


def test_polling_as_a_stream(spark, tmp_path):
    import json

    from regispark.sources import polling

    polling.register(spark, lambda p: iter([(f"{p['id']}-{p['listed_on']}", "body")]), name="streamed")
    orgs = json.dumps([{"id": 1, "fetcher_type": "rmk", "site": "s"}])

    def run(until):
        s = spark.readStream.format("streamed").option("organisations", orgs).option("date", "2024-01-02").option("days", "2").option("until", until).load()
        q = s.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r["listed_on"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run("2024-01-02") == ["2024-01-01", "2024-01-02"]
    assert run("2024-01-04") == ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-04"]
