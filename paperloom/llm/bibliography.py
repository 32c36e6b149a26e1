"""Comparable forms of bibliographic fields and the similarity of two records."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from urllib.parse import unquote

from paperloom.llm.lookalikes import canonical

#: Names of Greek letters in titles that are spelled out elsewhere.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "κ": "kappa"}
#: Openings that make a notice on a work a work of its own.
NOTICES = ["correction to", "correction", "author correction", "corrigendum", "erratum to", "erratum", "retraction notice", "retraction of", "retraction", "comment on", "reply to", "re"]
#: Tails that name a version of the same work.
VERSIONS = ["article", "preprint", "a preprint", "version", "review", "research article"]
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6}

_DOI = re.compile(r"10\.\d{4,9}/\S+")
_YEAR = re.compile(r"(?<!\d)(1[89]\d\d|20\d\d)(?!\d)")
_SPLIT = re.compile(r"\s*(?:[;|&]|\band\b)\s*")
_TAIL = re.compile(r"(?:\(([^()]{3,24})\)|: ([^:]{3,18}))\.?$")


_GREEK = str.maketrans(GREEK | {k.upper(): v for k, v in GREEK.items()})
_MARKS = re.compile("[\u0300-\u036f]+")
_BLANK = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    """Lower case, plain letters, Greek letters by name; all but letters and digits is a blank.

    Takes a text in its consistent form.
    """
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text.translate(_GREEK)))
    return _BLANK.sub(" ", text.lower())


def grams(text: str, n: int = 3) -> set[str]:
    """The n-grams of the words of a folded text, each word bounded by blanks."""
    return {w[i : i + n] for word in text.split() for w in (f" {word} ",) for i in range(max(1, len(w) - n + 1))}


def dice(a: set, b: set) -> float:
    """Twice the common members by all members; 0 if either is empty."""
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def close(a: str, b: str) -> bool:
    """Whether two words are equal but for a slip or so."""
    return a == b or dice(grams(a, 2), grams(b, 2)) >= 0.62


def doi_of(text: str | None) -> str | None:
    """The identifier in lower case without address, label or trailing stop."""
    found = _DOI.search(unquote(text or "").lower())
    return found.group().rstrip(".,;") if found else None


def year_of(text: str | None) -> int | None:
    found = _YEAR.search(text or "")
    return int(found.group()) if found else None


_INITIALS = re.compile(r"[A-Z]\.?|[A-Z]{2,3}")


def _surname(name: str) -> str:
    name = name.replace("-", "")
    if "," in name:
        words = fold(name.split(",")[0]).split()
        return words[-1] if words else ""
    words = [w for w in name.replace(".", ". ").split() if not _INITIALS.fullmatch(w)] or name.split()
    return (fold(words[-1]).split() or [""])[-1] if words else ""


def surnames_of(text: str | None) -> list[str]:
    """Folded surnames in order from a JSON list or from any usual way to write a list of names."""
    text = (canonical(text or "") or "").strip()
    if text.startswith("["):
        try:
            names = [str(x) for x in json.loads(text)]
        except ValueError:
            names = []
    else:
        text = re.sub(r"\bet al\b\.?", "", text).strip(" ,")
        names = [n for n in _SPLIT.split(text) if n.strip(" ,.")]
        if len(names) == 1 and "," in names[0]:
            parts = [p.strip() for p in names[0].split(",") if p.strip()]
            first = [w for w in parts[0].split() if len(w.strip(".")) > 1 and w.islower() is False]
            if len(parts) > 2 or len(first) > 1 or "." in parts[0]:
                names = parts
    return [s for s in map(_surname, names) if s]


_HEAD = re.compile(r"([^:\"]{2,20})(:|(?= \"))")
_TAGS = re.compile(r"</?[a-z]{1,4}>")
_NOTICE_GRAMS = {v: grams(v, 2) for v in NOTICES}
_VERSION_GRAMS = [grams(v, 2) for v in VERSIONS]
_PART_GRAMS = grams("part", 2)


def _says_part(word: str, last: bool) -> bool:
    """Whether a word before a number is "part" but for a slip; at the end of a title a worse one will do."""
    return sorted(word) == sorted("part") or word in ("ppart", "partt") or (last and len(word) in (3, 4) and dice(grams(word, 2), _PART_GRAMS) >= 0.4)


_FIELDS = ("title", "cut", "notice", "part", "surnames", "year", "doi")


def _is_version(tail: str) -> bool:
    own = grams(fold(re.sub(r"\d+", "", tail)), 2)
    return any(dice(own, g) >= 0.6 for g in _VERSION_GRAMS)


class Record:
    """A work's fields in comparable form."""

    __slots__ = (*_FIELDS, "grams")

    @classmethod
    def of(cls, *fields) -> Record:
        """A record from its comparable forms, in the order of ``fields``."""
        made = cls.__new__(cls)
        for name, value in zip(_FIELDS, fields):
            setattr(made, name, value)
        made.grams = grams(made.title)
        return made

    def pack(self) -> str:
        """The comparable forms in one text; none of them holds U+001F or a comma within a name."""
        return "\x1f".join((self.title, str(int(self.cut)), self.notice, str(self.part), ",".join(self.surnames), str(self.year or ""), self.doi or ""))

    @classmethod
    def unpack(cls, text: str) -> Record:
        title, cut, notice, part, surnames, year, doi = text.split("\x1f")
        return cls.of(title, cut == "1", notice, int(part), surnames.split(",") if surnames else [], int(year) if year else None, doi or None)

    def sort_keys(self) -> list[str | None]:
        """Composite keys under which records of one work lie close together; None if unknown.

        Behind U+001F, which sorts before all that a key holds, stand the fields that order equal keys.
        """
        words, year = self.title.split(), str(self.year or "")
        names, doi = ",".join(self.surnames), self.doi or ""
        coded = " ".join(sorted(w for w in words if any(c.isdigit() for c in w)))
        keys = [
            (self.doi, self.title, year, names),
            (f"{self.surnames[0]}|{self.title}" if self.surnames else None, year, names, doi),
            (self.title or None, year, names, doi),
            (f"{coded}|{year}|{self.title}" if coded else None, names, doi),
            ("".join(sorted(words, key=lambda w: (-len(w), w))) or None, names, year, doi),
            (f"{self.surnames[-1]}|{year}|{self.title}" if self.surnames else None, names, doi),
        ]
        return ["\x1f".join(k) if k[0] else None for k in keys]

    def __init__(self, title: str | None, doi: str | None, authors: str | None, date: str | None) -> None:
        raw = _TAGS.sub(" ", canonical(title or "")).strip().strip("[]").strip()
        self.cut = bool(re.search(r"(\.\.\.|…)$", raw))
        raw = raw.rstrip(". …")
        while (tail := _TAIL.search(raw)) and _is_version(tail[1] or tail[2]):
            raw = raw[: tail.start()].rstrip(". ")
        self.notice = ""
        head = _HEAD.match(raw)
        if head:
            own = grams(fold(head[1]), 2)
            score, name = max((dice(own, g), v) for v, g in _NOTICE_GRAMS.items())
            if score >= 0.68:
                self.notice = name
                raw = raw[head.end() :]
        self.title = " ".join(fold(raw).split())
        words = self.title.split()
        self.part = 0
        for i, n in enumerate(words[1:]):
            if (n.isdigit() and len(n) < 3 or n in ROMAN) and _says_part(words[i], i == len(words) - 2):
                self.part = int(n) if n.isdigit() else ROMAN[n]
                self.title = " ".join(words[:i] + words[i + 2 :])
                break
        if len(words) > 3 and abs(len(words[-1]) - 7) < 3 and close(words[-1], "results") and close(words[-2], "further"):
            self.part = -1
        self.grams = grams(self.title)
        self.surnames = surnames_of(authors)
        self.year = year_of(date)
        self.doi = doi_of(doi)


#: Weights of the comparison, in units of log odds.  Set by hand on the fields' meaning: a title
#: alone decides if it is nearly equal, names decide between equal titles, an identifier supports.
TITLE_WEIGHT, TITLE_EVEN = 13.0, 0.70
NAMES_AGREE, NAMES_DIFFER = 3.2, -6.0
DOI_EQUAL, DOI_DIFFERS = 3.5, -0.8
YEAR_EQUAL, YEAR_NEXT, YEAR_FAR = 0.8, 0.2, -1.5
#: For each pair of words that only one title and only the other has.
OTHER_WORD = -4.5


def names_agreement(a: list[str], b: list[str]) -> float | None:
    """Part of the shorter list found in the other, the first name counting most; None if unknown."""
    if not a or not b:
        return None
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    hits = sum(any(close(x, y) for y in long_) for x in short) / len(short)
    return 0.6 * close(a[0], b[0]) + 0.4 * hits


_DIGITS = re.compile(r"\D")


def other_words(a: list[str], b: list[str]) -> int:
    """Number of words that would have to be replaced: left over on both sides but for slips.

    Words whose digits differ, such as the codes of two genes, are never slips of each other.
    """
    only_a = [(grams(w, 2), _DIGITS.sub("", w)) for w in set(a).difference(b) if len(w) > 2]
    only_b = [(grams(w, 2), _DIGITS.sub("", w)) for w in set(b).difference(a) if len(w) > 2]
    if not only_a or not only_b:
        return 0

    def slip(x: tuple[set[str], str], y: tuple[set[str], str]) -> bool:
        return x[1] == y[1] and dice(x[0], y[0]) >= 0.45

    left_a = sum(not any(slip(x, y) for y in only_b) for x in only_a)
    left_b = sum(not any(slip(x, y) for x in only_a) for y in only_b)
    return min(left_a, left_b)


def confidence(a: Record, b: Record) -> float:
    """Confidence in 0..1 that two records are the same work; 0 if they can't be.

    Notices on a work and numbered sequels are works of their own.  Without a title on either
    side there is no telling.
    """
    if not a.grams or not b.grams or a.notice != b.notice:
        return 0.0
    cut = a.cut or b.cut
    if a.part != b.part and not (cut and (a.part == 0 or b.part == 0)):
        return 0.0
    common = len(a.grams & b.grams)
    title = common / min(len(a.grams), len(b.grams)) * 0.97 if cut and min(len(a.grams), len(b.grams)) >= 12 else 2 * common / (len(a.grams) + len(b.grams))
    if title < 0.4:
        return 0.0
    z = TITLE_WEIGHT * (title - TITLE_EVEN)
    names = names_agreement(a.surnames, b.surnames)
    if names is not None:
        z += NAMES_DIFFER + (NAMES_AGREE - NAMES_DIFFER) * names
    if a.year and b.year:
        gap = abs(a.year - b.year)
        z += YEAR_EQUAL if gap == 0 else YEAR_NEXT if gap == 1 else YEAR_FAR
    if a.doi and b.doi:
        z += DOI_EQUAL if a.doi == b.doi else DOI_DIFFERS
    if z > -2:
        z += OTHER_WORD * other_words(a.title.split(), b.title.split())
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
