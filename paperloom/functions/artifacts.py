"""Functions over model output and run artifacts."""

from __future__ import annotations

import difflib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Abbreviations after which a stop ends no sentence.
ABBREVIATIONS = "Fig Figs fig figs Table Tables Tab Eq Eqs ref refs Ref Refs No Nos Sec Suppl Supp e.g i.e cf vs viz approx ca etc al Dr Prof Mr Ms Mrs St Inc Ltd Co i.v i.p s.c p.o a.u wt vol Vol ed Eds".split()
#: Stands for a protected stop; no text of the data holds U+E000.
_KEPT = "\ue000"
_STATE = T.StructType([T.StructField("state", T.StringType()), T.StructField("n", T.IntegerType())])


def careful_sentences(text: Column) -> Column:
    """Sentences, with stops after abbreviations, initials and within numbers protected."""
    names = "|".join(re.escape(a) for a in ABBREVIATIONS)
    t = F.regexp_replace(text, rf"\b({names})\.", f"$1{_KEPT}")
    t = F.regexp_replace(t, r"\b([A-Z])\.(\s+[A-Z])", f"$1{_KEPT}$2")
    t = F.regexp_replace(t, r"(\d)\.(\d)", f"$1{_KEPT}$2")
    t = F.regexp_replace(t, r"""([.!?]["')\]]?)\s+([A-Z(\[])""", "$1\u0001$2")
    return F.filter(F.transform(F.split(t, "\u0001"), lambda s: F.trim(F.regexp_replace(s, _KEPT, "."))), lambda s: s != "")


def salvage_json(text: str | None) -> tuple[object, str]:
    """(value, state) of the first object or array in a model's text.

    State is ok, empty, none (there is no such thing), broken (it does not parse) or cut (it does not
    end); of a cut array the whole items are kept as value.
    """
    if not text or not text.strip():
        return None, "empty"
    body = text.strip()
    for part in body.split("```"):
        part = part.strip().removeprefix("json").strip()
        if part[:1] in ("{", "["):
            body = part
            break
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None, "none"
    decoder = json.JSONDecoder()
    try:
        return decoder.raw_decode(body, start)[0], "ok"
    except ValueError:
        depth, inside, slash = 0, False, False
        for c in body[start:]:
            if inside:
                inside = slash or c != '"'
                slash = c == "\\" and not slash
            elif c == '"':
                inside, slash = True, False
            else:
                depth += (c in "{[") - (c in "}]")
                if depth == 0:
                    return None, "broken"
    if body[start] != "[":
        return None, "cut"
    items, at = [], start + 1
    while True:
        while at < len(body) and body[at] in " \t\r\n,":
            at += 1
        try:
            value, at = decoder.raw_decode(body, at)
        except ValueError:
            return items, "cut"
        items.append(value)


@F.pandas_udf(_STATE)
def json_state(text: pd.Series) -> pd.DataFrame:
    """State of the salvage, and number of items of an array or keys of an object."""
    found = [salvage_json(t) for t in text]
    return pd.DataFrame({"state": [s for _, s in found], "n": [len(v) if isinstance(v, (list, dict)) else 0 for v, _ in found]})


@F.pandas_udf(T.DoubleType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of two texts that lies in common blocks, 0..1; null if either is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")
