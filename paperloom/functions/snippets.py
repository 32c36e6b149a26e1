"""The part of a text that a search shows: its best sentence and what of its neighbours still fits."""

from __future__ import annotations

import re
from collections.abc import Iterable

_BREAK = re.compile(r"(?<=[.!?])\s+")
_TOKEN = re.compile(r"[a-z0-9]+")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, without the blanks between them; none for a blank text."""
    out, start = [], len(text) - len(text.lstrip())
    stop = len(text.rstrip())
    for m in _BREAK.finditer(text, start, stop):
        if m.start() > start:
            out.append((start, m.start()))
        start = m.end()
    return [*out, (start, stop)] if stop > start else out


def best_window(text: str | None, wanted: Iterable[str], most: int = 500) -> tuple[int, int] | None:
    """(start, end) of the sentence with most of the wanted tokens, the first of equals, and its neighbours.

    The next sentence joins while the whole stays within ``most`` characters, then the one before, in
    turn, until neither fits.  A best sentence above ``most`` stays whole.  Null and blank texts have none.
    """
    spans = sentence_spans(text) if text else []
    if not spans:
        return None
    want = set(wanted)
    hits = [len(want.intersection(_TOKEN.findall(text[a:b].lower()))) for a, b in spans]
    lo = hi = hits.index(max(hits))
    moved = True
    while moved:
        moved = False
        for before, after in ((0, 1), (1, 0)):
            left, right = lo - before, hi + after
            if left >= 0 and right < len(spans) and spans[right][1] - spans[left][0] <= most:
                lo, hi, moved = left, right, True
    return spans[lo][0], spans[hi][1]
