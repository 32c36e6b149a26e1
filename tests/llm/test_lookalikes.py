"""Cases and non-cases of look-alike characters."""

from __future__ import annotations

import pytest

from paperloom.llm.lookalikes import canonical, consistent, find_lookalikes, group_lookalikes, has_lookalikes, skeleton

CASES = {"Ｆｕｌｌ width": "Full width", "diﬀuse": "diffuse", "ñora": "ñora", "a​b": "ab", "so­ft": "soft", "a b": "a b", "p53‐dependent": "p53-dependent", "rеgion": "region", "phaɡe": "phage", "３４％": "34%"}
NONE = ["plain text", "naïve café", "Влияние света на развитие", "NF-κB and TGF-β", "Ca²⁺", "A–B", "样本，差异", "👩‍🔬 lab", "", "κB", "IFN-γ"]


@pytest.mark.parametrize("text,form", CASES.items())
def test_cases(text, form):
    assert has_lookalikes(text)
    assert canonical(text) == form
    assert skeleton(text) == skeleton(form)
    assert not has_lookalikes(form)


@pytest.mark.parametrize("text", NONE)
def test_none(text):
    assert not has_lookalikes(text)
    assert canonical(text) == text


def test_frames(spark):
    rows = [(1, "rеgion", None), (1, "rеgion", None), (2, "region", "ﬁne"), (3, None, ""), (None, "Ｘ", "y")]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    assert {tuple(r) for r in find_lookalikes(df, "k", ["a", "b"]).collect()} == {(1, "a"), (2, "b"), (None, "a")}
    assert [tuple(r) for r in consistent(df.where("k = 2"), ["a", "b"]).collect()] == [(2, "region", "fine")]
    groups = group_lookalikes(df.withColumnRenamed("b", "n_forms"), "k", "a").collect()
    assert sorted((r.k, r.n_forms) for r in groups) == [(1, 2), (1, 2), (2, 2)]
    assert len({r.class_id for r in groups}) == 1
    assert find_lookalikes(df.limit(0), "k", ["a"]).count() == 0
