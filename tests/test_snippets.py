"""Windows of snippets, containment against brute force, and metered searches."""

from __future__ import annotations

import random

from paperloom.functions.snippets import best_window, sentence_spans
from paperloom.operators.lexical import metered
from paperloom.operators.matching import containment


def test_spans_and_windows():
    text = "  One two.  Three cell four! Five?\nSix cell seven. "
    assert [text[a:b] for a, b in sentence_spans(text)] == ["One two.", "Three cell four!", "Five?", "Six cell seven."]
    assert sentence_spans("") == sentence_spans(" \n ") == [] and best_window(None, ["cell"]) is None and best_window("  ", []) is None
    show = lambda words, most: text[slice(*best_window(text, words, most))]
    assert show(["cell"], 0) == "Three cell four!" and show(["seven", "cell"], 3) == "Six cell seven."
    # The next sentence joins first, then the one before, as far as they fit.
    assert show(["four"], 24) == "Three cell four! Five?" and show(["four"], 34) == "One two.  Three cell four! Five?"
    assert show(["one"], 500) == text.strip() and show([], 10) == "One two."
    assert best_window("a" * 10_000, ["x"]) == (0, 10_000)


def test_containment_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["v", "v", "u", None]), sorted({rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 7))}), 0) for i in range(70)] + [(90, "v", None, 0), (91, "v", ["a", "b"], 0), (92, "v", ["a", "b"], 0)]
    want = {}
    for i, g, w, _ in rows:
        near = sorted((-len(set(w) & set(v)) / min(len(w), len(v)), j) for j, h, v, _ in rows if j != i and g and g == h and w and v and 2 * len(set(w) & set(v)) >= min(len(w), len(v)))
        if near:
            want[i] = (near[0][1], round(-near[0][0], 6), len(near))
    df = spark.createDataFrame(rows, "id int, venue string, toks array<string>, partner int")
    got = containment(df, "id", "venue", "toks").collect()
    assert {r.id: (r.partner, round(r.containment, 6), r.links) for r in got} == want
    assert containment(df.limit(0), "id", "venue", "toks").count() == 0


def test_metered_room_is_spent_in_order(spark):
    rng = random.Random(7)
    hits = [(run, f"q{q}", p, k + 1) for run in (1, 2) for q in range(6) for k, p in enumerate(rng.sample(range(15), 5))]
    want = set()
    for run in (1, 2):
        delivered = set()
        for r, q, p, k in sorted((h for h in hits if h[0] == run), key=lambda h: (h[1], h[3])):
            if p in delivered or len(delivered) < 8:
                delivered.add(p)
                want.add((r, q, p, k))
    df = spark.createDataFrame(hits, "run int, call string, pmid int, rank int")
    assert {tuple(r) for r in metered(df, "run", "call", "pmid", 8).select("run", "call", "pmid", "rank").collect()} == want
