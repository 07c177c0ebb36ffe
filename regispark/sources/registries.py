"""Registry answers in HTML, XML and JSON, normalised to one document schema.

Each format has a page parser (plain functions of one text, run in Arrow batches) that yields a raw bag: labels and
values, links and bases. Mapping a bag to document columns, with each source's own fallbacks, is column algebra.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regispark.functions.text import last_segment, lenient_date, strict_date
from regispark.operators.shredding import parse_record
from regispark.sources.dom import parse_html

PUBLIC, RESTRICTED_SHORT, RESTRICTED_LONG = "Avalik", "AK", "Asutusesiseseks kasutamiseks"
AGENDA_ITEM = "Üksuse istungi päevakorrapunkt"
BAG = "valid boolean, data map<string,string>, file_urls array<string>, file_names array<string>, relations array<string>, bases array<string>"
DOCUMENT_COLUMNS = ["organisation_id", "url", "original_id", "title", "reference", "registration_date", "doc_type", "doc_function", "series", "dossier", "restriction", "to_party", "delivery_method", "responsible", "bases", "file_urls", "file_names", "relations"]

Bag = tuple[bool, dict[str, str], list[str], list[str], list[str], list[str]]
NOTHING: Bag = (False, {}, [], [], [], [])


def _absolute(href: str, site: str) -> str:
    return href if href.startswith("http") else f"{site.rstrip('/')}/{href.lstrip('/')}"


def form_page(html: str, site: str) -> Bag:
    """Label tables (table.form); file links only on public pages, relations in the table after them."""
    root = parse_html(html)
    data: dict[str, str] = {}
    for table in root.find("table", "form"):
        for tr in table.find("tr"):
            cells = [c for c in tr.find() if c.tag in ("th", "td")]
            if cells and (label := cells[0].text().replace(":", "").strip()):
                data[label] = cells[1].text() if len(cells) > 1 else ""
    tables = root.find("table", "data", "hover")
    public = data.get("Juurdepääsupiirang") == PUBLIC
    files = [a for td in (tables[0].find("td") if public and tables else []) if "subfile" not in td.classes for a in td.find("a") if a.attrs.get("href")]
    at = 1 if public else 0
    links = []
    for tr in tables[at].find("tr") if len(tables) > at else []:
        cells = [c for c in tr.children if getattr(c, "tag", "") == "td"]
        links += [a.attrs["href"] for a in (cells[0].find("a") if cells else []) if a.attrs.get("href")][:1]
    bases = [b for b in data.get("Juurdepääsupiirangu alus", "").split(", ") if b not in ("", "0")]
    return bool(data), data, [_absolute(a.attrs["href"], site) for a in files], [a.text() for a in files], [_absolute(x, site) for x in links], bases


def form_list(html: str) -> list[str]:
    """Document ids of a result page, in order."""
    out = []
    for tr in parse_html(html).find("tr"):
        cells = [c for c in tr.children if getattr(c, "tag", "") == "td"]
        out += [m[1] for a in (cells[0].find("a") if cells else []) if (m := re.search(r"/(\d+)[^/]*$", a.attrs.get("href", "")))]
    return out


def form_type_count(html: str) -> int:
    """Number of document types a search form offers."""
    return len([i for i in parse_html(html).find("input") if i.attrs.get("name") == "_documentTypes"])


def label_page(html: str, site: str) -> Bag:
    """Rows of label and value in #document_container; of a repeated label the last value counts."""
    box = parse_html(html).find(None, id_="document_container")
    rows = box[0].find(None, "row") if box else []
    data: dict[str, str] = {}
    urls, names = [], []
    for row in rows:
        label, value = row.find(None, "detail_label"), row.find(None, "detail_desc")
        if not label or not value:
            continue
        key = label[0].text()
        if key == "Failid":
            links = value[0].find("a")
            urls, names = [_absolute(a.attrs["href"], site) for a in links if a.attrs.get("href")], [a.text() for a in links]
        else:
            data[key] = value[0].text()
    alus = data.get("Juurdepääsupiirangu alus", "")
    return (True, data, urls, names, [], [alus] if alus else []) if data or urls else NOTHING


def table_page(html: str, site: str) -> Bag:
    """Two striped tables: labels and values; files with restriction and basis."""
    tables = [t for t in parse_html(html).find("table", "table", "table-striped") if t.below("section", "content-section")]
    data: dict[str, str] = {}
    for tr in tables[0].find("tr") if tables else []:
        cells = tr.find("td")
        if len(cells) >= 2 and (label := cells[0].text().rstrip(":")):
            data[label] = cells[1].text()
    urls, names, bases, public, closed = [], [], [], False, False
    for tr in tables[1].find("tr") if len(tables) > 1 else []:
        cells = tr.find("td")
        if len(cells) < 3 or not tr.below("tbody"):
            continue
        if cells[1].text() == PUBLIC:
            public = True
            for a in cells[0].find("a")[:1]:
                if a.attrs.get("href"):
                    urls.append(_absolute(a.attrs["href"], site))
                    names.append(a.text())
        else:
            closed = True
            if (basis := cells[2].text()) and basis not in bases:
                bases.append(basis)
    data["restriction"] = PUBLIC if public or not closed else RESTRICTED_LONG
    return True, data, urls, names, [], bases


def table_list(html: str) -> tuple[list[tuple[str, str]], bool]:
    """((uuid, type) of each document row but agenda items, whether a next page exists)."""
    root = parse_html(html)
    out = []
    for tr in root.find("tr"):
        cells = tr.find("td")
        if not tr.below("tbody", "search-results-eelnoud") or len(cells) < 4 or cells[3].text() == AGENDA_ITEM:
            continue
        for a in cells[2].find("a")[:1]:
            if m := re.search(r"dokument/([0-9a-f-]{36})", a.attrs.get("href", ""), re.I):
                out.append((m[1].lower(), cells[3].text()))
    return out, any(a.below(None, "pagination") for a in root.find("a", "next"))


def note_xml(xml: str, site: str) -> Bag:
    """Fields and files right below the document element; of a repeated field the first counts."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return NOTHING
    doc = root if root.tag == "document" else next(root.iter("document"), None)
    if doc is None:
        return NOTHING
    data: dict[str, str] = {}
    urls, names = [], []
    for el in doc:
        text = " ".join("".join(el.itertext()).split())
        if el.tag == "field" and el.get("name"):
            data.setdefault(el.get("name"), text)
        elif el.tag == "file" and el.get("href"):
            urls.append(_absolute(el.get("href"), site))
            names.append(text)
    reason = data.get("accessrestrictionreason", "")
    return (True, data, urls, names, [], [reason] if reason else []) if data or urls else NOTHING


def note_list(xml: str) -> list[int]:
    """Numbers of the note ids of a search answer."""
    try:
        return [int(d.get("noteid")[2:], 16) for d in ElementTree.fromstring(xml).iter("document") if d.get("noteid")]
    except (ElementTree.ParseError, ValueError):
        return []


def json_record(text: str, site: str) -> Bag:
    """A JSON answer; data false, null or missing is no document."""
    record = parse_record(text)
    data = record.get("data") if isinstance(record, dict) else None
    data = parse_record(data) if isinstance(data, str) else data
    data = next((d for d in data if isinstance(d, dict)), None) if isinstance(data, list) else data
    if not isinstance(data, dict):
        return NOTHING
    files = data.get("failid")
    files = parse_record(files) if isinstance(files, str) else files
    files = list(files.values()) if isinstance(files, dict) and all(k.isdigit() for k in files) else [files] if isinstance(files, dict) else files
    public = [f for f in files if isinstance(f, dict) and f.get("file_access") == "PUBLIC"] if isinstance(files, list) else []
    flat = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in data.items() if v is not None and not isinstance(v, (dict, list))}
    proceeder = data.get("doc_proceeder")
    if isinstance(proceeder, dict) and proceeder.get("wResponsibleUser") is not None:
        flat["responsible"] = str(proceeder["wResponsibleUser"])
    flat["restriction"] = PUBLIC if data.get("doc_access") == "PUBLIC" or public else RESTRICTED_SHORT
    reason = flat.get("doc_restrict_desc", "")
    return True, flat, [f"{site.rstrip('/')}/api/fail/{f['id']}" for f in public if f.get("id") is not None], [str(f.get("file_name") or "") for f in public if f.get("id") is not None], [], [reason] if reason else []


PARSERS = {"delta-adr": form_page, "tallinn-atp": label_page, "riigikogu": table_page, "riigikantselei-dhs": note_xml, "rmk": json_record}


def parse_pages(pages: DataFrame) -> DataFrame:
    """pages (organisation_id, fetcher_type, site, source_id, body) with the raw bag of each; unknown types are not valid."""

    def bags(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for kind, body, site in zip(b["fetcher_type"], b["body"], b["site"]):
                parser = PARSERS.get(kind)
                valid, data, urls, names, relations, bases = parser(body, site or "") if parser and body else NOTHING
                out.append((valid, data, urls, names, relations, bases))
            yield pd.concat([b.drop(columns=["body"]).reset_index(drop=True), pd.DataFrame(out, columns=["valid", "data", "file_urls", "file_names", "relations", "bases"])], axis=1)

    keys = ["organisation_id", "fetcher_type", "site", "source_id"]
    schema = ", ".join([*(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys), BAG])
    return pages.select(*keys, "body").mapInPandas(bags, schema)


def documents(bags: DataFrame, list_types: DataFrame | None = None) -> DataFrame:
    """Document columns of all valid bags. list_types (uuid, doc_type) gives types that only list pages show."""
    d = lambda key: F.col("data")[key]
    kind = F.col("fetcher_type")

    def by(**values: Column) -> Column:
        names = {"form": "delta-adr", "json": "rmk", "label": "tallinn-atp", "note": "riigikantselei-dhs", "table": "riigikogu"}
        out = F.lit(None)
        for k, v in values.items():
            out = F.when(kind == names[k], v).otherwise(out)
        return out

    filled = lambda c: F.when(F.trim(c) != "", F.trim(c))
    sid = F.col("source_id").cast("string")
    rows = bags.where("valid")
    listed = F.lit("")
    if list_types is not None:
        rows = rows.join(list_types.select(F.col("uuid").alias("source_id"), F.col("doc_type").alias("__listed")), "source_id", "left")
        listed = F.coalesce("__listed", F.lit(""))
    note_type = F.trim(F.coalesce(d("doctype"), d("acttype"), F.lit("")))
    note_ref = F.trim(F.coalesce(d("docid"), F.lit("")))
    base = F.rtrim(F.col("site"), F.lit("/"))
    slash = F.concat(base, F.lit("/dokument/"), sid)
    day = by(form=d("Registreerimise kpv"), json=d("doc_trans_date"), label=d("Reg kpv"), note=d("date"), table=F.coalesce(d("Dokumendi loomise kuupäev"), d("Kuupäev")))
    return rows.select(
        "organisation_id",
        by(form=slash, json=slash, table=F.concat(slash, F.lit("/")), label=slash, note=F.concat(base, F.lit("/documents/NT"), F.lpad(F.hex(sid.cast("bigint")), 8, "0"), F.lit("?open"))).alias("url"),
        sid.alias("original_id"),
        by(form=d("Pealkiri"), json=d("doc_headline"), label=F.coalesce(d("Pealkiri"), d("Lepingu objekt"), d("Objekt")), note=F.coalesce(filled(d("subject")), filled(note_type), note_ref), table=F.coalesce(d("Pealkiri"), F.lit(""))).alias("title"),
        by(form=d("Viit"), json=F.concat(F.coalesce(d("doc_proc_marker"), F.lit("")), F.lit("/"), F.coalesce(d("doc_number"), F.lit(""))), label=d("Reg nr"), note=note_ref, table=F.coalesce(d("Dokumendi viit"), F.lit(""))).alias("reference"),
        F.when(kind.isin("riigikantselei-dhs", "riigikogu"), strict_date(day)).otherwise(lenient_date(day)).cast("date").alias("registration_date"),
        by(form=d("Dokumendi liik"), json=d("doc_type_friendly"), label=d("Liik"), note=note_type, table=listed).alias("doc_type"),
        by(form=d("Funktsioon"), json=d("ds_code")).alias("doc_function"),
        by(form=d("Sari"), json=d("ds_name"), note=d("journalkeyhierarchy")).alias("series"),
        by(form=d("Toimik"), table=d("Toimik")).alias("dossier"),
        by(form=d("Juurdepääsupiirang"), json=d("restriction"), label=F.coalesce(d("Juurdepääsupiirang"), F.lit(PUBLIC)), note=F.coalesce(d("docaccesstype"), F.lit(PUBLIC)), table=d("restriction")).alias("restriction"),
        by(form=d("Adressaat"), json=d("doc_trans_actor"), label=F.coalesce(d("Kellele"), d("Saatja"), d("Lepingu pool")), note=F.coalesce(d("companyname"), d("govinstitution")), table=d("Autor/Adressaat")).alias("to_party"),
        by(form=d("Saabumis/saatmisviis"), json=d("doc_delivery_mode"), label=d("Saatmisviis"), note=d("indoccat"), table=d("Saabumise/Saatmise viis")).alias("delivery_method"),
        by(form=d("Vastutaja"), json=F.coalesce(d("responsible"), d("unit_name")), label=F.coalesce(d("Täitja"), d("Asutus"))).alias("responsible"),
        "bases", "file_urls", "file_names", "relations",
    )


def document_files(docs: DataFrame) -> DataFrame:
    """(url, position, file_url, name): links and names paired by place; a missing name comes from the link."""
    pairs = docs.select("url", F.posexplode(F.arrays_zip(F.col("file_urls").alias("u"), F.col("file_names").alias("n"))).alias("position", "f"))
    return pairs.where("f.u is not null").select("url", "position", F.col("f.u").alias("file_url"), F.coalesce(F.when(F.col("f.n") != "", F.col("f.n")), F.url_decode(last_segment(F.col("f.u")))).alias("name"))


def organisations_from_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Organisations of a text list of registry addresses, one a line; blank lines are skipped, repeated ones count once."""
    uri = F.trim(F.col(col))
    return lines.where(uri != "").select(uri.alias("registry_base_uri"), last_segment(uri).alias("slug"), F.lit("delta-adr").alias("fetcher_type")).dropDuplicates(["registry_base_uri"])


# The sources that are no form registries, with the type of their answers.
OTHER_TYPES = ["rmk", "tallinn-atp", "riigikantselei-dhs", "riigikogu"]


def seeded_organisations(lines: DataFrame, others: list[tuple[str, str, str, str]], col: str = "value") -> DataFrame:
    """Organisations of the text list and the others, given as (name, slug, registry_base_uri, fetcher_type); an address
    occurs once, that of the others first."""
    wrong = [o for o in others if o[3] not in OTHER_TYPES]
    if wrong:
        raise ValueError(f"unknown fetcher type: {wrong[0][3]}")
    own = lines.sparkSession.createDataFrame(others, "name string, slug string, registry_base_uri string, fetcher_type string")
    listed = organisations_from_lines(lines, col).withColumn("name", F.col("slug")).join(own.select("registry_base_uri"), "registry_base_uri", "left_anti")
    return own.unionByName(listed.select("name", "slug", "registry_base_uri", "fetcher_type"))


def namespace_candidates(spark: SparkSession, letters: str = "abcdefghijklmnopqrstuvwxyz", length: int = 4) -> DataFrame:
    """All words of different letters, numbered and decoded, so that no table is crossed with itself."""
    n = len(letters)
    digit = lambda k: F.floor(F.col("id") / F.lit(n**k)) % n
    word = F.concat(*[F.substring(F.lit(letters), (digit(k) + 1).cast("int"), F.lit(1)) for k in reversed(range(length))])
    return spark.range(n**length).select(word.alias("name")).where(F.size(F.array_distinct(F.split("name", ""))) >= length)
