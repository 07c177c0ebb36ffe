"""Listing and enumeration of registries: what a transport does for one (organisation, date) or one run of ids.

Each source is a function of `get`, which answers a request (a dict, always with `site` and `kind`) with the text of a
page, so that these loops hold the paging rules and nothing of HTTP. `Transport` of the polling source is `lister(get)`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from regispark.sources.registries import PARSERS, PUBLIC, RESTRICTED_SHORT, form_list, note_list, table_list

Get = Callable[[dict], str]
ROWS = 20  #: rows of a full page; a shorter one is the last
FORM_PAGES = 5  #: pages the form source gives of one class and day


class Source(Protocol):
    """A registry: ids (with the type a list page shows, or "") of one day."""

    def __call__(self, get: Get, site: str, day: str) -> Iterator[tuple[str, str]]: ...


def form_ids(get: Get, site: str, day: str, most_pages: int = FORM_PAGES) -> Iterator[tuple[str, str]]:
    """Both restriction classes, page by page until one is short."""
    for restriction in (PUBLIC, RESTRICTED_SHORT):
        for page in range(1, most_pages + 1):
            ids = form_list(get({"site": site, "kind": "list", "day": day, "restriction": restriction, "page": page}))
            yield from ((i, "") for i in ids)
            if len(ids) < ROWS:
                break


def note_ids(get: Get, site: str, day: str) -> Iterator[tuple[str, str]]:
    page, full = 0, True
    while full:
        page += 1
        ids = note_list(get({"site": site, "kind": "list", "day": day, "page": page}))
        yield from ((str(i), "") for i in ids)
        full = len(ids) >= ROWS


def table_ids(get: Get, site: str, day: str) -> Iterator[tuple[str, str]]:
    page, more = 0, True
    while more:
        page += 1
        rows, more = table_list(get({"site": site, "kind": "list", "day": day, "page": page}))
        yield from rows


LISTED: dict[str, Source] = {"delta-adr": form_ids, "riigikantselei-dhs": note_ids, "riigikogu": table_ids}


def register_source(fetcher_type: str, source: Source, parser: Callable | None = None) -> None:
    """Add a source of your own, and the parser of its pages."""
    LISTED[fetcher_type] = source
    if parser is not None:
        PARSERS[fetcher_type] = parser


def lister(get: Get) -> Callable[[dict], Iterator[tuple[str, str]]]:
    """The transport of the polling source: (source_id, body) of every document listed on a day, each once.

    A document whose page cannot be read comes with an empty body and is no document; an error of the list itself fails.
    """

    def read(p: dict) -> Iterator[tuple[str, str]]:
        seen: set[str] = set()
        for source_id, _ in LISTED[p["fetcher_type"]](get, p["site"], p["listed_on"]):
            if source_id in seen:
                continue
            seen.add(source_id)
            try:
                body = get({"site": p["site"], "kind": "document", "id": source_id})
            except OSError:
                body = ""
            yield source_id, body

    return read


def enumerated(get: Get, site: str, fetcher_type: str, first: int, last: int | None = None, most_misses: int = 30) -> Iterator[tuple[str, str]]:
    """(source_id, body) of numbered documents: downwards from `first` to `last` if that is given, else upwards until
    `most_misses` in a row are none."""
    misses, n = 0, first
    while misses < most_misses if last is None else n >= last:
        body = get({"site": site, "kind": "document", "id": str(n)})
        if body and PARSERS[fetcher_type](body, site)[0]:
            misses = 0
            yield str(n), body
        else:
            misses += 1
        n += 1 if last is None else -1
