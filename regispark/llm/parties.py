"""Counterparty names as clerks type them: what a value names, taken apart.

`read_party` cuts contact details off a value and splits the rest into words, legal form and role marks;
`Pivots` holds the frequent words (given names, lines of business, institutions), learned from all values,
and says which of them a word may stand for.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field

# Legal forms, forms of address, initialisms of institutions, and usual short forms of given names.
FORMS = {
    "oü": "oü", "ou": "oü", "o.ü.": "oü", "o.ü": "oü", "o.u.": "oü", "osaühing": "oü", "osauhing": "oü", "as": "as", "a.s.": "as", "a/s": "as", "aktsiaselts": "as",
    "mtü": "mtü", "mtu": "mtü", "m.t.ü.": "mtü", "m.t.u.": "mtü", "mittetulundusühing": "mtü", "mittetulundusuhing": "mtü", "sa": "sa", "s.a.": "sa", "sihtasutus": "sa",
    "tü": "tü", "fie": "fie", "ühistu": "ühistu", "uü": "uü", "täisühing": "tü", "usaldusühing": "uü",
}
TITLES = {"hr", "pr", "prl", "hra", "härra", "proua", "preili", "mr", "mrs", "ms", "dr"}
INITIALISMS = {"vv": "vallavalitsus", "lv": "linnavolikogu", "lvk": "linnavolikogu", "pk": "põhikool", "tai": "arendusinstituut", "kv": "kinnisvara", "g": "gümnaasium", "lk": "linnakantselei", "hk": "hooldekodu"}
SHORT_NAMES = {
    "aleksander": "sass aleks sasha ali", "andreas": "ants andres atso", "bernhard": "benno bernd berni", "dmitri": "dima mitja", "eduard": "eedi edi eedu", "elisabet": "liisi betti liisu elsbet", "friedrich": "fritz priidik fredi",
    "gabriel": "gabi gabo", "hendrik": "henn henka hendo", "ingeborg": "inge inga", "jekaterina": "katja katjuša", "johannes": "hannes juhan joh", "katariina": "kati kata kadri", "kristjan": "kris krissu", "leonhard": "leo lenni hardi", "maarja-liis": "maali maarja liis mai",
    "mihkel": "miku miki mihk", "nikolai": "kolja niko", "oskar": "oss ossu", "pauliine": "polli pauli", "rosaalia": "roosi rosi", "sebastian": "basti seb", "svetlana": "sveta lana", "tõnis": "tõnts tõnn", "veronika": "vera ronni", "vladimir": "vova volodja",
    "wilhelmine": "mina miina", "zinaida": "zina", "ülleke": "ülle", "õnnela": "õnne", "margarita": "rita", "elena": "lena", "aleksei": "aljoša", "sergei": "serjoža", "tatjana": "tanja", "natalia": "nataša", "ivan": "vanja", "jevgeni": "ženja",
}
INSTITUTIONS = ["vallavalitsus", "linnavalitsus", "linnavolikogu", "vallavolikogu", "põhikool", "gümnaasium", "kool", "lasteaed", "haigla", "arendusinstituut", "instituut", "ülikool", "ministeerium", "amet", "kohus", "keskus", "inspektsioon", "prokuratuur", "raamatukogu", "muuseum", "selts", "fond"]

_EMAIL = r"[\w.+-]+\s?(?:@|\(at\)|\[at\])\s?[\w-]+(?:(?:\.|\s?\[(?:punkt|dot)\]\s?|\((?:punkt|dot)\))[\w-]+)+"
_TAIL = re.compile(
    r"\s*(?:"
    r"[,;]?\s+(?:tel|telefon|mob|mobiil|ik|isikukood|reg|registrikood|reg\.?\s?kood|e-post|e-mail|aadress)\b\.?:?\s*\S"
    r"|[,;]\s*kontakt(?:isik)?\s*:"
    r"|;\s*"
    r"|\s+-\s+(?=[+(\d])"
    rf"|\s*[(<\[]?\s*(?<![\w.+-]){_EMAIL}"
    r"|[,]?\s+\(?\+?\d[\d ()-]{5,}"
    r").*$",
    re.I | re.S,
)
_TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*-?\.?|[^\W\d_](?:\.[^\W\d_])+\.?|\d+")
_QUOTES = re.compile("[\"'“”„«»‘’`]")


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def head_of(value: str) -> str:
    """The party a value begins with, contact details cut off."""
    value = value.strip()
    head = _TAIL.sub("", value)
    return (head if head.strip(" ,;-(") else value).strip(" ,;-(")


@dataclass
class Party:
    head: str
    words: list[str] = field(default_factory=list)  #: folded, in order
    form: str = ""
    comma: bool = False


def read_party(value: str) -> Party:
    """A value's head in words, its legal form, and whether a comma parts it."""
    head = " ".join(unicodedata.normalize("NFKC", head_of(value)).split())
    low = _QUOTES.sub(" ", head).casefold()
    party = Party(head, comma="," in low)
    for raw in re.findall(r"[^\s,;/]+", low):
        token = raw.strip("()[]:")
        if token.rstrip(".") in TITLES:
            continue
        form = FORMS.get(token) or (FORMS.get(token.rstrip(".")) if len(token) > 2 else None)
        if form and not party.form:
            party.form = form
            continue
        party.words.append(token)
    words: list[str] = []
    for w in party.words:
        # "Root-Business" is two words; a double given name stays one.
        parts = w.split("-") if w.count("-") == 1 and len(w.split("-")[0]) > 6 and len(w.split("-")[1]) > 3 else [w]
        words += [fold(p).strip("-") for p in parts if p.strip("-.")]
    party.words = words
    return party


def edits(a: str, b: str, most: int) -> int:
    """Levenshtein distance, most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    row = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        last, row[0], low = row[0], i, i
        for j, cb in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (ca != cb))
            low = min(low, row[j])
        if low > most:
            return most + 1
    return min(row[-1], most + 1)


class Pivots:
    """The frequent words, and for any word the pivots it may stand for, each with a distance."""

    def __init__(self, words: Iterable[str], bodies: Iterable[str] = ()) -> None:
        """words: all pivots; bodies: those of firms and institutions, which no initial stands for."""
        self.bodies = set(bodies)
        self.words = sorted({w for w in words if len(w) > 2 and not w.endswith(".")})
        self.set = set(self.words)
        self.short: dict[str, list[str]] = {}
        for full, shorts in SHORT_NAMES.items():
            for s in [fold(full), *map(fold, shorts.split())]:
                if fold(full) in self.set:
                    self.short.setdefault(s, []).append(fold(full))
        self.initialism = {k: fold(v) for k, v in INITIALISMS.items() if fold(v) in self.set}
        self.known: dict[str, list[tuple[str, int]]] = {}

    def near(self, word: str) -> list[tuple[str, int]]:
        """(pivot, distance): the pivot itself, else short names and initialisms, else those within the radius."""
        hit = self.known.get(word)
        if hit is None:
            if len(self.known) > 200_000:
                self.known.clear()
            hit = self.known[word] = self._near(word)
        return hit

    def _near(self, word: str) -> list[tuple[str, int]]:
        if word in self.set:
            return [(word, 0)]
        bare = word.rstrip(".")
        if word in self.short:
            return [(w, 1) for w in self.short[word]]
        if bare in self.initialism and not word.endswith("."):
            return [(self.initialism[bare], 1)]
        if word.endswith("."):
            return [(w, 1) for w in self.words if w.startswith(bare) and (len(bare) > 1 or w not in self.bodies)]
        if len(bare) >= 6:
            begun = [w for w in self.words if w.startswith(bare)]
            if begun:
                return [(w, 1) for w in begun]
        if len(bare) < 4:
            return []
        radius = 1 if len(bare) < 5 else 2
        return sorted(((w, d) for w in self.words if (d := edits(bare, w, radius)) <= radius), key=lambda x: x[1])


@dataclass(frozen=True)
class Reading:
    """One way to read a value: pivot (given name or business), root (surname or name of the firm), form."""

    pivot: str
    root: str
    form: str
    cost: int


SPLIT_WORDS = {("valla", "valitsus"): "vallavalitsus", ("linna", "volikogu"): "linnavolikogu", ("linna", "valitsus"): "linnavalitsus", ("pohi", "kool"): "pohikool"}


def readings(party: Party, pivots: Pivots) -> list[Reading]:
    """The ways to read a party, the cheapest first. Without a pivot: its words in order as the root."""
    words = list(party.words)
    for i in range(len(words) - 1):
        if (joined := SPLIT_WORDS.get((words[i], words[i + 1]))) and joined in pivots.set:
            words[i : i + 2] = [joined]
            break
    words = [w for w in words if w.strip("-") not in ("teadus", "ja")]
    bare = [w for w in words if not (len(w.rstrip(".")) == 1 and w.endswith("."))]
    out: dict[tuple[str, str], Reading] = {}
    if len(words) >= 2:
        for i, w in enumerate(words):
            rest = [x for j, x in enumerate(words) if j != i]
            initial = len(w.rstrip(".")) == 1
            if len(rest) > 1 and not party.form:
                # A middle initial, or a second given name.
                rest = [x for x in rest if len(x.rstrip(".")) > 1] or rest
            if initial and len(bare) > 1 and not w.rstrip(".") == "g":
                continue
            root = " ".join(x.rstrip(".") for x in rest)
            if len(root) < 4:
                continue
            for p, d in pivots.near(w):
                if any(x in pivots.set for x in rest) and d > 0:
                    continue
                key = (p, root)
                if key not in out or out[key].cost > d:
                    out[key] = Reading(p, root, party.form, d)
    found = sorted(out.values(), key=lambda r: (r.cost, r.pivot))
    return found or [Reading("", " ".join(words), party.form, 0)]
