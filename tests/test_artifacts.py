"""Functions over model output."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import artifacts as X


def test_salvage_json():
    cases = {
        '{"a": 1} tail': ({"a": 1}, "ok"), 'x ```json\n["a", "b"]\n``` y': (["a", "b"], "ok"), '["a", {"b": "]"}, "c': (["a", {"b": "]"}], "cut"),
        '{"a": [1, 2': (None, "cut"), "no json": (None, "none"), "": (None, "empty"), None: (None, "empty"), "[1, x]": (None, "broken"), "[": ([], "cut"),
    }
    for text, want in cases.items():
        assert X.salvage_json(text) == want, text


def test_columns(spark):
    df = spark.createDataFrame([("See Fig. 2 by J. Doe et al. in 1.5 h. Then (B) ends! Done", "See Fig. 2"), (None, "x"), ("", "")], "a string, b string")
    got = [r.s for r in df.select(X.careful_sentences(F.col("a")).alias("s")).collect()]
    assert got == [["See Fig. 2 by J. Doe et al. in 1.5 h.", "Then (B) ends!", "Done"], None, []]
    sims = [r.s for r in df.select(X.text_similarity("a", "b").alias("s")).collect()]
    assert 0 < sims[0] < 1 and sims[1] is None and sims[2] == 1.0
    states = [(r.j.state, r.j.n) for r in df.select(X.json_state("a").alias("j")).collect()]
    assert states == [("none", 0), ("empty", 0), ("empty", 0)]
