"""A small tree of HTML elements from the standard library's parser, with the few lookups registry pages need."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_SILENT = {"script", "style", "head", "title"}
_BLOCK = {"p", "div", "tr", "li", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "section", "blockquote", "pre"}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    @property
    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def fits(self, tag: str | None, cls: tuple[str, ...], id_: str | None) -> bool:
        return (tag is None or self.tag == tag) and set(cls) <= self.classes and (id_ is None or self.attrs.get("id") == id_)

    def find(self, tag: str | None = None, *cls: str, id_: str | None = None) -> list[Node]:
        """Descendants with the tag, all the classes and the id, in document order."""
        return [n for n in self.walk() if n is not self and n.fits(tag, cls, id_)]

    def below(self, tag: str, *cls: str) -> bool:
        """Whether some ancestor has the tag and classes."""
        n = self.parent
        while n is not None:
            if n.fits(tag, cls, None):
                return True
            n = n.parent
        return False

    def text(self) -> str:
        """All text, blanks collapsed."""
        parts, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                parts.append(n)
            elif n.tag not in _SILENT:
                todo += reversed(n.children)
        return " ".join("".join(parts).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.at.tag in _CLOSES.get(tag, ()):
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse_html(text: str) -> Node:
    b = _Builder()
    b.feed(text)
    b.close()
    return b.root


def html_to_text(html: str) -> str:
    """Readable text: breaks for blocks and <br>, links' texts, no scripts."""
    out: list[str] = []
    todo: list = [parse_html(html)]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n if n.strip("\n") == "" and n != "\n" else " ".join(n.split()) if n.strip() else " ")
            if n[-1:].isspace() and n.strip():
                out.append(" ")
        elif n == ("end",):
            out.append("\n")
        elif n.tag not in _SILENT:
            if n.tag == "br":
                out.append("\n")
                continue
            if n.tag in _BLOCK:
                out.append("\n")
                todo.append(("end",))
            elif n.tag in ("td", "th"):
                out.append(" ")
            todo += reversed(n.children)
    lines = [" ".join(x.split()) for x in "".join(out).split("\n")]
    text: list[str] = []
    for x in lines:
        if x or (text and text[-1]):
            text.append(x)
    return "\n".join(text).strip()
