"""Attachments into a tree of files with text, and signatures of signed containers.

Formats that the standard library reads are built in, mail files and PDF among them. Others (DOC), or better readers, are
plugged in by `extractors`, a dict from extension to a function of bytes that returns (text, html) or, for containers,
[(name, bytes), ...]. Without one the file keeps its row, with null contents, as if the extraction had failed. Containers
are opened to any depth and files of any size are read.
"""

from __future__ import annotations

import base64
import email
import email.policy
import hashlib
import io
import os
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regispark.sources.dom import html_to_text, parse_html
from regispark.sources.msg import read_msg
from regispark.sources.pdf import pdf_text

# Entries of containers that are no files of their own.
SKIPPED = {"mimetype", "manifest.xml", "message.json", "message.html", "header.txt"}
FILES = "id bigint, parent_id bigint, path string, name string, storage_path string, parsed_with string, contents string, html string, depth int"
SIGNATURES = "file_id bigint, name string, pno string, signing_time string"
PARSED_WITH = {"asice": "AsiceParser", "bdoc": "AsiceParser", "zip": "AsiceParser", "eml": "EmlParser", "rtf": "RtfParser", "docx": "DocxParser", "doc": "DocxParser", "txt": "TxtParser", "pdf": "PdfParser", "msg": "MsgParser"}
Extractors = dict[str, Callable[[bytes], object]]


def extension(name: str) -> str:
    m = re.search(r"\.([^./\\]+)$", name)
    return m[1].lower() if m else ""


def decoded(raw: bytes, charset: str | None = None) -> str:
    for c in (charset, "utf-8", "cp1257", "latin-1"):
        try:
            if c:
                return raw.decode(c)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("utf-8", "replace")


def html_body(raw: bytes, charset: str | None = None) -> str:
    """Inner HTML of the body, decoded by the charset the text names, else by trial."""
    m = re.search(rb"charset=[\"']?([\w-]+)", raw)
    text = decoded(raw, charset or (m[1].decode("ascii") if m else None))
    m2 = re.search(r"<body[^>]*>(.*?)(?:</body>|$)", text, re.S | re.I)
    return m2[1] if m2 else text


def mail_parts(raw: bytes) -> tuple[str, str, list[tuple[str, bytes]]]:
    """(text, html, attachments) of an e-mail."""
    msg = email.message_from_bytes(raw, policy=email.policy.default)
    body = msg.get_body(preferencelist=("html", "plain"))
    html = ""
    if body is not None:
        payload = body.get_payload(decode=True) or b""
        if body.get_content_type() == "text/html":
            html = html_body(payload, body.get_content_charset())
        else:
            html = re.sub(r"(\r\n|\n|\r)", "<br />\n", decoded(payload, body.get_content_charset()))
    found = []
    for part in msg.iter_attachments():
        name = part.get_filename() or ("message.eml" if part.get_content_type() == "message/rfc822" else "attachment")
        if part.get_content_type() == "message/rfc822":
            inner = part.get_payload()
            found.append((name, inner[0].as_bytes() if isinstance(inner, list) and inner else b""))
        else:
            found.append((name, part.get_payload(decode=True) or b""))
    return html_to_text(html), html, found


def docx_text(raw: bytes) -> str:
    """Paragraphs of a word-processor document, one a line."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = []
    for p in root.iter(f"{ns}p"):
        lines.append("".join((t.text or "") if t.tag == f"{ns}t" else "\t" if t.tag == f"{ns}tab" else "\n" if t.tag == f"{ns}br" else "" for t in p.iter()))
    return "\n".join(lines)


_RTF = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.S | re.I)
_RTF_HIDDEN = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "themedata", "datastore"}


def rtf_text(raw: bytes) -> str:
    """Visible text of a rich-text document."""
    text = raw.decode("latin-1")
    m = re.search(r"\\ansicpg(\d+)", text)
    page = f"cp{m[1]}" if m else "cp1252"
    out, stack, hidden, skip = [], [], False, 0
    for word, arg, code, sign, brace, char in _RTF.findall(text):
        if brace == "{":
            stack.append(hidden)
        elif brace == "}":
            hidden = stack.pop() if stack else False
        elif sign == "*" or word in _RTF_HIDDEN:
            hidden = True
        elif hidden:
            continue
        elif word == "u" and arg:
            out.append(chr(int(arg) % 65536))
            skip = 1
        elif code:
            if skip:
                skip -= 1
            else:
                out.append(bytes.fromhex(code).decode(page, "replace"))
        elif word in ("par", "line", "row"):
            out.append("\n")
        elif word in ("tab", "cell"):
            out.append("\t")
        elif sign and sign in "\\{}":
            out.append(sign)
        elif sign == "~":
            out.append(" ")
        elif char:
            if skip:
                skip -= 1
            else:
                out.append(char)
    return "".join(out).strip()


def _der(data: bytes, at: int = 0) -> tuple[int, bytes, int]:
    """(tag, contents, end) of a DER value."""
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
    return tag, data[at : at + n], at + n


def _members(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        tag, value, at = _der(data, at)
        yield tag, value


# Object identifiers of subject fields, in DER.
_OIDS = {b"\x55\x04\x03": "CN", b"\x55\x04\x04": "SN", b"\x55\x04\x2a": "GN", b"\x55\x04\x05": "serialNumber"}


def certificate_subject(certificate: str) -> dict[str, str]:
    """Subject fields of a certificate in base64."""
    _, cert, _ = _der(base64.b64decode("".join(certificate.split())))
    fields = [v for t, v in _members(next(_members(cert))[1]) if t != 0xA0]
    out: dict[str, str] = {}
    for _, group in _members(fields[4]):
        for _, pair in _members(group):
            (_, oid), (kind, value) = list(_members(pair))[:2]
            if oid in _OIDS:
                out.setdefault(_OIDS[oid], value.decode("utf-16-be" if kind == 0x1E else "utf-8", "replace"))
    return out


def signatures(xml: bytes) -> list[tuple[str | None, str | None, str | None]]:
    """(name, personal number, signing time) of each certificate, times paired by place."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return []
    certs = [e.text or "" for e in root.iter() if e.tag.endswith("}X509Certificate") or e.tag == "X509Certificate"]
    times = [e.text for e in root.iter() if e.tag.endswith("}SigningTime") or e.tag == "SigningTime"]
    out = []
    for i, c in enumerate(certs):
        try:
            s = certificate_subject(c)
        except (ValueError, IndexError, StopIteration):
            s = {}
        name = f"{s['GN']} {s['SN']}" if "GN" in s and "SN" in s else s.get("CN")
        out.append((name, s.get("serialNumber"), times[i] if i < len(times) else None))
    return out


def node_id(path: str) -> int:
    """A stable positive number for a place in a tree."""
    return int.from_bytes(hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


def unpack(path: str, raw: bytes, extractors: Extractors | None = None, replacing: bool = False) -> tuple[list[tuple], list[tuple]]:
    """(file rows, signature rows) of one stored file and all it holds. A file that replaces another keeps its row even if it is
    XML, which is no file of its own elsewhere."""
    files, signed = [], []
    todo: list[tuple[str, bytes, int | None, int]] = [(path, raw, None, 0)]
    while todo:
        at, data, parent, depth = todo.pop()
        name = at.rsplit("/", 1)[-1]
        if name in SKIPPED:
            continue
        ext = extension(name)
        if ext == "xml" and not (replacing and parent is None):
            # Other XML has no row of its own.
            if parent is not None and re.search(r"signatures\d+\.xml$", name):
                signed += [(parent, *s) for s in signatures(data)]
            continue
        own, text, html, inner = node_id(at), None, None, []
        try:
            found = extractors[ext](data) if extractors and ext in extractors else None
            if isinstance(found, list):
                inner = found
            elif found is not None:
                text, html = found
            elif ext in ("asice", "bdoc", "zip"):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    inner = [(n.filename, z.read(n)) for n in sorted(z.infolist(), key=lambda n: n.filename) if not n.is_dir()]
            elif ext == "eml":
                text, html, inner = mail_parts(data)
            elif ext == "docx":
                text = docx_text(data)
            elif ext == "rtf":
                text = rtf_text(data)
                html = "<br />\n".join(text.split("\n"))
            elif ext == "txt":
                text = decoded(data)
            elif ext == "msg":
                plain, page, inner = read_msg(data)
                html = html_body(page) if page is not None else "" if plain is None else re.sub(r"(\r\n|\n|\r)", "<br />\n", plain)
                text = html_to_text(html) if html else None
            elif ext == "pdf":
                text = pdf_text(data)
                html = "<br />\n".join(text.split("\n")) if text else ""
        except Exception:  # a damaged attachment keeps its row, without text
            text, html, inner = None, "", []
        files.append((own, parent, at, name, f"{hashlib.sha256(data).hexdigest()[:32]}/{name}", PARSED_WITH.get(ext, "FileParser"), text, html, depth))
        todo += [(f"{at}/{n}", d, own, depth + 1) for n, d in reversed(inner)]
    return files, signed


def parse_files(stored: DataFrame, extractors: Extractors | None = None, replacing: bool = False) -> DataFrame:
    """File rows of stored files (path, content), as the binaryFile source gives them."""

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [r for p, c in zip(b["path"], b["content"]) if c is not None for r in unpack(p, bytes(c), extractors, replacing)[0]]
            # As objects: a column of ids and nulls would become floating point and lose digits.
            yield pd.DataFrame(out, columns=[x.split()[0] for x in FILES.split(", ")], dtype=object)

    return stored.select("path", "content").mapInPandas(rows, FILES)


def parse_signatures(stored: DataFrame) -> DataFrame:
    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [r for p, c in zip(b["path"], b["content"]) if c is not None for r in unpack(p, bytes(c))[1]]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SIGNATURES.split(", ")])

    return stored.select("path", "content").mapInPandas(rows, SIGNATURES)


#: What an upload may hold; files found in folders have no limit.
UPLOAD_BYTES = 50_000_000


def stored_files(spark, folder: str, most_bytes: int | None = None) -> DataFrame:
    """Files below a folder as (path, content); with most_bytes (`UPLOAD_BYTES` for uploads) only those no larger."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return (files if most_bytes is None else files.where(F.col("length") <= most_bytes)).select("path", "content")


def refused_uploads(spark, folder: str, most_bytes: int = UPLOAD_BYTES) -> DataFrame:
    """(path, length) of the files an upload refuses."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") > most_bytes).select("path", "length")


def stored_blobs(stored: DataFrame, root: str) -> DataFrame:
    """Write each stored file under its key, the hash of its bytes and its name, below `root`; (path, storage_path, size).

    Keys depend on the bytes alone, so that a task that runs twice writes the same file. `root` is a folder that all
    executors reach.
    """

    def put(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                key = f"{hashlib.sha256(bytes(content)).hexdigest()[:32]}/{path.rsplit('/', 1)[-1]}"
                at = os.path.join(root, key)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                part = f"{at}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(bytes(content))
                os.replace(part, at)
                rows.append((path, key, len(content)))
            yield pd.DataFrame(rows, columns=["path", "storage_path", "size"])

    return stored.where("content is not null").select("path", "content").mapInPandas(put, "path string, storage_path string, size bigint")


__all__ = ["parse_files", "parse_signatures", "stored_files", "unpack", "parse_html"]
