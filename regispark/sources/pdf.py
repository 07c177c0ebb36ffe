"""Text of PDF files, with the standard library alone: plain and deflated streams, object streams, text operators and
the fonts' maps to Unicode. Encrypted files and pages that are pictures give no text."""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_HEX = rb"<([0-9A-Fa-f\s]*)>"
_OPERATOR = re.compile(
    rb"\((?P<text>(?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*)\)|<(?P<hex>[0-9A-Fa-f\s]*)>(?!>)|/(?P<name>[^\s/<>\[\]()]+)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<word>[A-Za-z'\"*]+\d?)|(?P<sign>[\[\]])",
    re.S,
)
# Escapes inside strings.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c[:1].isdigit() else b"" if c in (b"\n", b"\r\n") else _ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw, flags=re.S)


def _stream(body: bytes) -> bytes | None:
    """The decoded stream of an object; None if it has none or is packed in another way."""
    m = _STREAM.search(body)
    if not m:
        return None
    head, data = body[: m.start()], m[1]
    if b"/FlateDecode" in head or b"/Fl " in head:
        if b"/DecodeParms" in head and re.search(rb"/Predictor\s+(?!1\b)\d", head):
            return None
        d = zlib.decompressobj()
        try:
            return d.decompress(data)
        except zlib.error:
            return None
    return None if b"/Filter" in head else data


def objects(raw: bytes) -> dict[int, bytes]:
    """Bodies of all objects, those packed into object streams too; of a repeated number the last counts."""
    out = {int(n): body for n, body in _OBJECT.findall(raw)}
    for body in list(out.values()):
        if b"/ObjStm" in body and (data := _stream(body)) is not None and (first := re.search(rb"/First\s+(\d+)", body)):
            at = int(first[1])
            numbers = [int(x) for x in data[:at].split()]
            starts = numbers[1::2]
            for k, (n, o) in enumerate(zip(numbers[::2], starts)):
                out.setdefault(n, data[at + o : at + starts[k + 1] if k + 1 < len(starts) else None])
    return out


def unicode_map(cmap: bytes) -> tuple[dict[int, str], int]:
    """(code -> text, bytes of a code) of a font's map."""
    text = lambda h: bytes.fromhex(h.decode().replace(" ", "").replace("\n", "")).decode("utf-16-be", "replace")
    out: dict[int, str] = {}
    m = re.search(rb"begincodespacerange\s*" + _HEX, cmap)
    width = max(1, len(re.sub(rb"\s", b"", m[1])) // 2) if m else 1
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(_HEX + rb"\s*" + _HEX, block):
            out[int(a, 16)] = text(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c, many in re.findall(_HEX + rb"\s*" + _HEX + rb"\s*(?:" + _HEX + rb"|\[(.*?)\])", block, re.S):
            low, high = int(a, 16), min(int(b, 16), int(a, 16) + 65535)
            each = [text(x) for x in re.findall(_HEX, many)] if many else None
            for k in range(low, high + 1):
                if each is not None:
                    if k - low < len(each):
                        out[k] = each[k - low]
                elif c:
                    t = text(c)
                    out[k] = t[:-1] + chr(ord(t[-1]) + k - low) if t else ""
    return out, width


def _shown(content: bytes, fonts: dict[bytes, tuple[dict[int, str], int]]) -> str:
    """The text a page's operators show; a move to another line is a line break, a wide gap in a line a blank."""
    out: list[str] = []
    held: list[tuple[str, object]] = []
    font: tuple[dict[int, str], int] | None = None
    y = None

    def decoded(raw: bytes) -> str:
        if font is None:
            return raw.decode("cp1252", "replace")
        table, width = font
        return "".join(table.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))

    def line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for m in _OPERATOR.finditer(content):
        kind = m.lastgroup
        if kind == "text":
            held.append((kind, _string(m["text"])))
        elif kind == "hex":
            h = re.sub(rb"\s", b"", m["hex"])
            held.append(("text", bytes.fromhex((h + b"0" * (len(h) % 2)).decode())))
        elif kind == "number":
            held.append((kind, float(m["number"])))
        elif kind == "name":
            held.append((kind, m["name"]))
        elif kind == "word":
            word, numbers = m["word"], [v for k, v in held if k == "number"]
            if word == b"Tf" and held and (names := [v for k, v in held if k == "name"]):
                font = fonts.get(names[-1])
            elif word in (b"Td", b"TD") and len(numbers) > 1:
                line() if numbers[-1] else out.append(" ")
            elif word == b"Tm" and len(numbers) > 5:
                line() if y is not None and abs(numbers[-1] - y) > 1 else out.append(" " if out else "")
                y = numbers[-1]
            elif word == b"T*":
                line()
            elif word in (b"Tj", b"TJ", b"'", b'"'):
                if word in (b"'", b'"'):
                    line()
                for k, v in held:
                    if k == "text":
                        out.append(decoded(v))
                    elif k == "number" and word == b"TJ" and v < -200:
                        out.append(" ")
            held = []
    return re.sub(r"[ \t]+", " ", "".join(out)).replace(" \n", "\n").replace("\n ", "\n").strip()


def pdf_text(raw: bytes) -> str | None:
    """Text of all pages in order, parted by form feeds; None if there is none."""
    if b"/Encrypt" in raw[-4096:]:
        return None
    every = objects(raw)
    maps: dict[int, tuple[dict[int, str], int]] = {}

    def fonts_of(page: bytes) -> dict[bytes, tuple[dict[int, str], int]]:
        out: dict[bytes, tuple[dict[int, str], int]] = {}
        resources = page
        if m := re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", page):
            resources = every.get(int(m[1]), b"")
        if m := re.search(rb"/Font\s+(\d+)\s+\d+\s+R", resources):
            resources = b"/Font<<" + every.get(int(m[1]), b"")
        at = resources.find(b"/Font")
        for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", resources[at:] if at >= 0 else b""):
            if (u := re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", every.get(int(n), b""))) is not None:
                k = int(u[1])
                if k not in maps:
                    maps[k] = unicode_map(_stream(every.get(k, b"")) or b"")
                out[name] = maps[k]
        return out

    # Pages in the order of the page tree, else as they stand in the file.
    pages: list[int] = []
    root = next((n for n, b in every.items() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b), None)
    todo, met = [root] if root is not None else [], set()
    while todo:
        n = todo.pop()
        if n in met or n not in every:
            continue
        met.add(n)
        if kids := re.search(rb"/Kids\s*\[(.*?)\]", every[n], re.S):
            todo += [int(k) for k in reversed(_REF.findall(kids[1]))]
        elif re.search(rb"/Type\s*/Page\b", every[n]):
            pages.append(n)
    pages = pages or [n for n, b in every.items() if re.search(rb"/Type\s*/Page\b(?!s)", b)]
    texts = []
    for n in pages:
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", every[n], re.S)
        content = b"\n".join(s for k in _REF.findall(m[1]) if (s := _stream(every.get(int(k), b""))) is not None) if m else b""
        texts.append(_shown(content, fonts_of(every[n])))
    return "\n\f".join(texts) if any(texts) else None
