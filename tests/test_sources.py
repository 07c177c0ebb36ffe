import base64
import io
import json
import zipfile
from email.message import EmailMessage

import pytest

from regispark.sources import attachments as at
from regispark.sources import polling
from regispark.sources import registries as rg

SITE = "https://r.example/"
FORM = """<table class="form"><tr><th>Viit:</th><td>1-2/3</td></tr><tr><th>Pealkiri:</th><td>Kiri &amp; lisa</td></tr><tr><th>Registreerimise kpv:</th><td>05.03.2024</td></tr>
<tr><th>Juurdepääsupiirang:</th><td>{r}</td></tr><tr><th>Juurdepääsupiirangu alus:</th><td>AvTS 35, , MKS 26</td></tr><tr><th>Viit:</th><td>9-9/9</td></tr></table>
<table class="data hover"><tr><td><a href="/f/1">a.pdf</a></td></tr><tr><td class="subfile"><a href="/f/2">b</a></td></tr></table>
<table class="data hover"><tr><td><a href="/r/dokument/77">x</a></td><td><a href="/no">y</a></td></tr></table>"""
LABEL = """<div id="document_container"><div class="row"><div class="detail_label">Lepingu pool</div><div class="detail_desc">Me</div></div><div class="row"><div class="detail_label">Lepingu pool</div><div class="detail_desc">Teie OÜ</div></div>
<div class="row"><div class="detail_label">Objekt</div><div class="detail_desc">Tee</div></div><div class="row"><div class="detail_label">Failid</div><div class="detail_desc"><a href="f/1">esimene</a><a href="https://o.example/a%20b.pdf"></a></div></div></div>"""
TABLE = """<section class="content-section"><table class="table table-striped"><tr><td>Pealkiri:</td><td>Eelnõu</td></tr><tr><td>Kuupäev</td><td>01.02.2024</td></tr></table>
<table class="table table-striped"><tbody><tr><td><a href="/d/1">x.pdf</a></td><td>{a}</td><td>alus</td></tr><tr><td>y</td><td>AK</td><td>alus</td></tr></tbody></table></section>"""
NOTE = """<document form="x" noteid="NT00000010"><field name="docid"> 5-1 </field><field name="date">02.01.2024</field><field name="date">03.01.2024</field><field name="doctype">Kiri</field><file href="/f/a.pdf">a.pdf</file>
<case><document noteid="NT1"><field name="subject">inner</field><file href="/no">no</file></document></case></document>"""
JSON = {"data": {"doc_headline": "H", "doc_number": "7", "doc_proc_marker": "1-2", "doc_access": "RESTRICTED", "unit_name": "Osakond", "doc_trans_date": "7. mai 2024", "doc_proceeder": {"wResponsibleUser": ""}, "failid": [{"id": 3, "file_access": "PUBLIC", "file_name": "p.pdf"}, {"id": 4, "file_access": "RESTRICTED"}]}}


def docs(spark, *pages):
    df = spark.createDataFrame([(1, k, SITE, str(s), b) for k, s, b in pages], "organisation_id bigint, fetcher_type string, site string, source_id string, body string")
    return rg.documents(rg.parse_pages(df), spark.createDataFrame([("u1", "Eelnõu liik")], "uuid string, doc_type string")).collect()


def test_form_page(spark):
    (d,) = docs(spark, ("delta-adr", 5, FORM.format(r="Avalik")))
    assert (d["url"], d["title"], d["reference"], str(d["registration_date"]), d["restriction"]) == ("https://r.example/dokument/5", "Kiri & lisa", "9-9/9", "2024-03-05", "Avalik")
    assert d["bases"] == ["AvTS 35", "MKS 26"] and d["file_urls"] == ["https://r.example/f/1"] and d["relations"] == ["https://r.example/r/dokument/77"]
    assert rg.form_page(FORM.format(r="AK"), SITE)[2] == [] and rg.form_page(FORM.format(r="AK"), SITE)[4][0].endswith("/f/1")
    assert rg.form_list('<table><tr><td><a href="/x/dokument/12">a</a></td><td><a href="/13">b</a></td></tr></table>') == ["12"]
    assert rg.form_type_count('<input name="documentTypes"><input name="_documentTypes"><input name="_documentTypes">') == 2


def test_label_page(spark):
    (d,) = docs(spark, ("tallinn-atp", 5, LABEL))
    assert (d["title"], d["to_party"], d["restriction"]) == ("Tee", "Teie OÜ", "Avalik")
    assert docs(spark, ("tallinn-atp", 5, "<div id='document_container'></div>"), ("tallinn-atp", 6, "<p>none</p>"), ("tallinn-atp", 7, None), ("other", 8, LABEL)) == []
    bag = spark.createDataFrame([("u", ["https://r.example/f/1", "https://o.example/a%20b.pdf"], ["esimene", ""])], "url string, file_urls array<string>, file_names array<string>")
    assert [(r["position"], r["name"]) for r in rg.document_files(bag).collect()] == [(0, "esimene"), (1, "a b.pdf")]


def test_table_page(spark):
    (d,) = docs(spark, ("riigikogu", "u1", TABLE.format(a="Avalik")))
    assert (d["doc_type"], d["restriction"], d["bases"], d["file_names"], str(d["registration_date"])) == ("Eelnõu liik", "Avalik", ["alus"], ["x.pdf"], "2024-02-01")
    assert docs(spark, ("riigikogu", "u2", TABLE.format(a="AK")))[0]["restriction"] == "Asutusesiseseks kasutamiseks"
    row = "<tr><td>1</td><td>2</td><td><a href='/dokument/0a1b2c3d-0000-1111-2222-333344445555'>x</a></td><td>{t}</td></tr>"
    html = f"<table><tbody class='search-results-eelnoud'>{row.format(t='Kiri')}{row.format(t='Üksuse istungi päevakorrapunkt')}<tr><td>short</td></tr></tbody></table><div class='pagination'><a class='next' href='#'>&gt;</a></div>"
    assert rg.table_list(html) == ([("0a1b2c3d-0000-1111-2222-333344445555", "Kiri")], True)


def test_note_xml(spark):
    (d,) = docs(spark, ("riigikantselei-dhs", 16, NOTE))
    assert (d["url"], d["title"], d["reference"], str(d["registration_date"]), d["file_urls"]) == ("https://r.example/documents/NT00000010?open", "Kiri", "5-1", "2024-01-02", ["https://r.example/f/a.pdf"])
    assert rg.note_list('<entries><document noteid="NT0000000A"/><document noteid="NT00000010"/></entries>') == [10, 16]
    assert rg.note_list("<broken") == [] and rg.note_xml("<broken", SITE)[0] is False


def test_json_record(spark):
    (d,) = docs(spark, ("rmk", 3, json.dumps(JSON)))
    assert (d["reference"], d["restriction"], d["responsible"], str(d["registration_date"]), d["file_urls"]) == ("1-2/7", "Avalik", "", "2024-05-07", ["https://r.example/api/fail/3"])
    assert docs(spark, ("rmk", 3, '{"data":false}'), ("rmk", 4, "{"), ("rmk", 5, "")) == []


def test_organisations_and_namespaces(spark, rows):
    lines = spark.createDataFrame([("https://a.example/aaa/",), ("",), (" https://a.example/bbb ",), ("https://a.example/aaa/",)], "value string")
    assert rows(rg.organisations_from_lines(lines).select("slug")) == [("aaa",), ("bbb",)]
    assert rg.namespace_candidates(spark, "abcd", 3).distinct().count() == 24


def _zip(**entries):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in entries.items():
            z.writestr(k.replace("__", "/").replace("_dot_", "."), v)
    return b.getvalue()


def _tlv(tag, body):
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else b"\x82" + n.to_bytes(2, "big")) + body


def _certificate(**fields):
    oid = {"CN": b"\x55\x04\x03", "SN": b"\x55\x04\x04", "GN": b"\x55\x04\x2a", "serialNumber": b"\x55\x04\x05"}
    name = b"".join(_tlv(0x31, _tlv(0x30, _tlv(6, oid[k]) + _tlv(0x0C, v.encode()))) for k, v in fields.items())
    tbs = _tlv(0xA0, _tlv(2, b"\x02")) + _tlv(2, b"\x01") + _tlv(0x30, b"") + _tlv(0x30, b"") + _tlv(0x30, b"") + _tlv(0x30, name) + _tlv(0x30, b"x" * 200)
    return base64.b64encode(_tlv(0x30, _tlv(0x30, tbs))).decode()


def test_attachments(spark, tmp_path):
    mail = EmailMessage()
    mail["Subject"] = "x"
    mail.set_content("Tere\nõhtust")
    mail.add_attachment(b"sisu", maintype="application", subtype="octet-stream", filename="lisa.txt")
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    docx = _zip(**{"word__document_dot_xml": f"<w:document {w}><w:body><w:p><w:r><w:t>Üks</w:t></w:r></w:p><w:p><w:r><w:t>kaks</w:t></w:r></w:p></w:body></w:document>"})
    sig = f"<a><d:X509Certificate xmlns:d='d'>{_certificate(CN='X', GN='Mari', SN='Maasikas', serialNumber='1')}</d:X509Certificate><d:X509Certificate xmlns:d='d'>{_certificate(CN='Asutus', serialNumber='2')}</d:X509Certificate><x:SigningTime xmlns:x='x'>2024-01-01T00:00:00Z</x:SigningTime></a>"
    asice = _zip(**{"mimetype": "m", "a_dot_docx": docx, "META-INF__signatures12_dot_xml": sig, "META-INF__other_dot_xml": "<x/>", "inner_dot_eml": mail.as_bytes()})
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "k.asice").write_bytes(asice)
    (tmp_path / "r.rtf").write_bytes(rb"{\rtf1\ansicpg1257{\fonttbl x}Tere \'f5htu\par uus \u353?}")
    (tmp_path / "b.zip").write_bytes(b"not a zip")
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    (tmp_path / "x.bin").write_bytes(b"\0")
    stored = at.stored_files(spark, str(tmp_path)).cache()
    got = {r["name"]: r for r in at.parse_files(stored).collect()}
    assert set(got) == {"k.asice", "a.docx", "inner.eml", "lisa.txt", "r.rtf", "b.zip", "p.pdf", "x.bin"}
    assert got["a.docx"]["contents"] == "Üks\nkaks" and got["a.docx"]["parent_id"] == got["k.asice"]["id"] and got["k.asice"]["contents"] is None
    assert got["inner.eml"]["contents"] == "Tere\nõhtust" and got["lisa.txt"]["parent_id"] == got["inner.eml"]["id"] and got["lisa.txt"]["contents"] == "sisu" and got["lisa.txt"]["depth"] == 2
    assert got["r.rtf"]["contents"] == "Tere õhtu\nuus š" and (got["b.zip"]["contents"], got["b.zip"]["html"]) == (None, "") and (got["p.pdf"]["contents"], got["p.pdf"]["html"]) == (None, "") and got["x.bin"]["html"] is None
    signed = sorted((r["name"], r["pno"], r["signing_time"], r["file_id"]) for r in at.parse_signatures(stored).collect())
    assert signed == [("Asutus", "2", None, got["k.asice"]["id"]), ("Mari Maasikas", "1", "2024-01-01T00:00:00Z", got["k.asice"]["id"])]
    again = {r["name"]: r["id"] for r in at.parse_files(stored).collect()}
    assert again == {k: r["id"] for k, r in got.items()}
    plugged = {r["name"]: r["contents"] for r in at.parse_files(stored, {"pdf": lambda raw: ("pages", "")}).collect()}
    assert plugged["p.pdf"] == "pages"


def test_polled_source(spark):
    def transport(p):
        yield p["listed_on"], f"body {p['id']}"

    polling.register(spark, transport, "polled")
    orgs = json.dumps([{"id": 1, "fetcher_type": "rmk", "site": SITE}, {"id": 2, "fetcher_type": "rmk", "site": SITE}])
    df = spark.read.format("polled").option("organisations", orgs).option("date", "2024-03-02").option("days", "3").load()
    assert sorted({(r["organisation_id"], r["listed_on"]) for r in df.collect()}) == [(k, d) for k in (1, 2) for d in ("2024-02-29", "2024-03-01", "2024-03-02")]

    def failing(p):
        raise OSError("no answer")

    reader = polling._Reader({"organisations": orgs, "date": "2024-03-02", "days": "1"}, failing, 2, 0.0)
    with pytest.raises(OSError):
        list(reader.read(reader.partitions()[0]))
