"""Text, HTML and attachments of mail files in the compound binary format, with the standard library alone."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

_MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END = 0xFFFFFFF0  # sector numbers from here on mark ends and gaps


@dataclass
class Storage:
    """A folder of a compound file: its streams and the folders in it, by name."""

    streams: dict[str, bytes] = field(default_factory=dict)
    folders: dict[str, Storage] = field(default_factory=dict)


def read_compound(raw: bytes) -> Storage:
    """The root folder of a compound file; ValueError if it is none. A broken chain ends where it breaks."""
    if raw[:8] != _MAGIC:
        raise ValueError("not a compound file")
    size, small = 1 << struct.unpack_from("<H", raw, 30)[0], 1 << struct.unpack_from("<H", raw, 32)[0]
    first_dir, cutoff, first_small = struct.unpack_from("<I", raw, 48)[0], struct.unpack_from("<I", raw, 56)[0], struct.unpack_from("<I", raw, 60)[0]
    sector = lambda n: raw[(n + 1) * size : (n + 2) * size]
    numbers = lambda b: list(struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4]))
    tables, more = list(struct.unpack_from("<109I", raw, 76)), struct.unpack_from("<I", raw, 68)[0]
    seen: set[int] = set()
    while more < _END and more not in seen:
        seen.add(more)
        *part, more = numbers(sector(more))
        tables += part
    fat = [x for t in tables if t < _END for x in numbers(sector(t))]

    def chain(start: int, table: list[int]) -> list[int]:
        out, met = [], set()
        while start < len(table) and start not in met:
            met.add(start)
            out.append(start)
            start = table[start]
        return out

    entries = []
    directory = b"".join(map(sector, chain(first_dir, fat)))
    for at in range(0, len(directory) - 127, 128):
        e = directory[at : at + 128]
        length = max(0, struct.unpack_from("<H", e, 64)[0] - 2)
        left, right, child = struct.unpack_from("<3I", e, 68)
        entries.append((e[:length].decode("utf-16-le", "replace"), e[66], left, right, child, struct.unpack_from("<I", e, 116)[0], struct.unpack_from("<Q", e, 120)[0]))
    if not entries:
        raise ValueError("no directory")
    small_fat = numbers(b"".join(map(sector, chain(first_small, fat))))
    pool = b"".join(map(sector, chain(entries[0][5], fat)))

    def content(start: int, length: int) -> bytes:
        if length < cutoff:
            return b"".join(pool[n * small : (n + 1) * small] for n in chain(start, small_fat))[:length]
        return b"".join(map(sector, chain(start, fat)))[:length]

    root, used = Storage(), {0}
    todo = [(root, entries[0][4])]
    while todo:
        into, n = todo.pop()
        if n >= len(entries) or n in used:
            continue
        used.add(n)
        name, kind, left, right, child, start, length = entries[n]
        todo += [(into, left), (into, right)]
        if kind == 2:
            into.streams[name] = content(start, length)
        elif kind == 1:
            into.folders[name] = Storage()
            todo.append((into.folders[name], child))
    return root


def _text(s: Storage, tag: str) -> str | None:
    """A property as text: Unicode if there is such a stream, else in the usual code page."""
    if (raw := s.streams.get(f"__substg1.0_{tag}001F")) is not None:
        return raw.decode("utf-16-le", "replace").rstrip("\x00")
    if (raw := s.streams.get(f"__substg1.0_{tag}001E")) is not None:
        return raw.decode("cp1257", "replace").rstrip("\x00")
    return None


def message(s: Storage) -> tuple[str | None, bytes | None, list[tuple[str, bytes]]]:
    """(text, html, attachments) of a message folder; a message within the message is an attachment with its text."""
    html = s.streams.get("__substg1.0_10130102")
    if html is None and (typed := _text(s, "1013")) is not None:
        html = typed.encode()
    found = []
    for name in sorted(n for n in s.folders if n.startswith("__attach_version1.0_")):
        a = s.folders[name]
        called = _text(a, "3707") or _text(a, "3704") or _text(a, "3001") or "attachment"
        if (data := a.streams.get("__substg1.0_37010102")) is not None:
            found.append((called, data))
        elif (inner := a.folders.get("__substg1.0_3701000D")) is not None:
            text, inner_html, more = message(inner)
            found += [(f"{called}.txt", (text or "").encode())] if inner_html is None else [(f"{called}.html", inner_html)]
            found += more
    return _text(s, "1000"), html, found


def read_msg(raw: bytes) -> tuple[str | None, bytes | None, list[tuple[str, bytes]]]:
    return message(read_compound(raw))
