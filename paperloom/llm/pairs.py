"""Defects of prompt and response pairs."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import at_least_parallel
from paperloom.llm.label_model import NO, PASS, YES, posteriors
from paperloom.llm.language import asked_for, by_script, by_words, language_of
from paperloom.session import Workspace
from paperloom.sources.tables import latest

DEFECTS = ["empty", "copy", "refusal", "other_language", "truncated"]
#: Posterior from which a defect is reported; checked on labelled fixtures in the tests.
CUTOFFS = {"empty": 0.5, "copy": 0.5, "refusal": 0.5, "other_language": 0.5, "truncated": 0.5}
#: First guesses of the share of cases, and of how often a vote of each function is right.
PRIORS = {"empty": 0.03, "copy": 0.03, "refusal": 0.03, "other_language": 0.02, "truncated": 0.05}
TRUST = {
    "empty": [0.99, 0.97, 0.9],
    "copy": [0.97, 0.9, 0.9],
    "refusal": [0.95, 0.85, 0.9, 0.7, 0.85],
    "other_language": [0.97, 0.9, 0.85],
    "truncated": [0.97, 0.93, 0.85, 0.85, 0.8, 0.6],
}
#: A word that ends a line in at least this share of its occurrences is a known end.
END_RATE = 0.05

_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_THINK = re.compile(r"(?is)<(think|thinking|reasoning)>.*?</\1>|</?(think|thinking|reasoning|answer|response)>")
_FENCE = re.compile(r"```[a-zA-Z]*|```")
_LABEL = re.compile(r"(?i)^\s*[\"'“]?\s*(answer|response|output|result|antwort|respuesta|réponse|resposta|question|assistant|prompt)\s*:\s*")
_NOTHING_ALLOWED = re.compile(r"(?i)\b(return|reply with|answer with|give|output)\b[^.\n]{0,30}(\[\]|\{\}|an? empty|nothing|none)|(\[\]|\{\}|empty (list|string|answer))")
_TERMINAL = re.compile(r"[.!?…。！？]['\"”»’)\]]*\s*$")
_DOMAIN = re.compile(r"\d|\b\w+-[αβγδκ]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")

# Ways to decline, in the languages of the corpus.  Each names the act of declining
# itself, not regret or doubt, which sound answers express too.
REFUSALS = [
    r"(can't|cannot|can not|can’t|won't|won’t|will not|unable to|not able to|not going to)( be)?( able to)? (help|assist|answer|respond|provide|comply|complete|completing|fulfil|fulfill|take this|do (this|that|so)|write|writing|discuss|support|engage|continue|process|produce|generate)",
    r"\b(i|we) (must|have to|need to|am going to|will|would like to|shall)? ?(decline|refuse|pass on)", r"\bmust decline\b", r"^declined?:", r"request conflicts with",
    r"(not|isn't|n't) (something )?(i am|i'm|i’m) (able|allowed|permitted|in a position|comfortable|willing)|(not|n't) (able|allowed|permitted|in a position|comfortable|willing) to",
    r"(off limits|off-limits)", r"no can do", r"lack the (access|ability|means|permission)", r"no answer (will|can) be given", r"rather not\b", r"not possible for me", r"as an? (ai|language model|assistant)\b", r"against (my|our|the) (policy|policies|guidelines|rules)",
    r"consult a (qualified|professional|medical)", r"\bno (puedo|podemos|me es posible)\b", r"\blo siento\b", r"no estoy en (posición|condiciones)", r"(tengo|debo) (que )?(rechazar|declinar)",
    r"\bje ne (peux|puis) pas\b", r"(suis|sommes) désolée?s?", r"(dois|devons) (décliner|refuser)", r"\b(kann|können|darf) (ich|wir)[^.]{0,20} nicht\b", r"(muss|müssen) (ich|wir)?[^.]{0,20}ablehnen", r"tut mir leid", r"nicht (helfen|beantworten|möglich)[^.]{0,20}$",
    r"não (posso|podemos|consigo)\b", r"(sinto muito|desculpe|lamento)", r"(tenho|devo) (que )?(recusar|declinar)",
    r"must leave (this )?to", r"(falls|lies|is) outside (of )?what", r"allowed to (discuss|answer|share|say)", r"(guidelines|policies|policy|rules) (prevent|forbid|prohibit|do not allow|don't allow)", r"will stop here", r"no me está permitido", r"prefiero no\b", r"keine auskunft", r"darf (ich )?[^.]{0,30}(nicht|keine)", r"il ne m'est pas (permis|possible)", r"je préfère ne pas", r"não me é permitido", r"prefiro não\b",
    r"restricted (material|content)", r"don't (feel|think it) [^.]{0,20}(appropriate|comfortable)", r"(cannot|can't) provide an answer",
]
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS), re.I)
# Words of one who speaks of the request instead of its subject.
_META = re.compile(r"(?i)\b(i|i'm|i’m|i'd|i won't|my|me|request|task|question|topic|sorry|apolog\w+|regret\w*|unfortunately|anfrage|leider|ich|mir|petición|siento|puedo|demande|désolée?|je|pedido|não posso|policy|guidelines|richtlinien)\b")
_NUMBER = re.compile(r"\W*\d+\W*")
_LISTED, _NUMBERED = re.compile(r"\s*(\d+[.)]|[-*•])\s"), re.compile(r"^\W*\d+[.)]\s")
_STRUCTURED = re.compile(r"(?i)json|one per line|yes or no|outline|\blist\b")
_BROKEN_OFF = re.compile(r"(?i)clos|reset|timeout|context length|cut off|interrupt|abort")


def unwrap(text: str | None) -> str:
    """The content of an answer without reasoning, fences, labels and characters that do not show."""
    text = _FENCE.sub(" ", _THINK.sub(" ", _INVISIBLE.sub("", text or "")))
    return _LABEL.sub("", text).strip().strip("\"'“”").strip()


def _vote(condition: bool | None) -> str:
    return PASS if condition is None else YES if condition else NO


def _empty(prompt: str, raw: str, content: str) -> str:
    words = bool(_WORD.search(content))
    bare = re.sub(r"[\[\]{}\s,:\"'`]|\bnull\b|\bnone\b|\bn/a\b", "", content.lower())
    allowed = bool(_NOTHING_ALLOWED.search(prompt)) and bool(re.search(r"[\[{]\s*[\]}]|null|none", content.lower()))
    return _vote(not words and not allowed) + _vote(not _INVISIBLE.sub("", raw).strip() or None) + _vote(not bare and not allowed)


def _copy(prompt: str, content: str) -> str:
    pa_, pb_ = _WORD.findall(prompt.lower()), _WORD.findall(content.lower())
    if not pa_ or not pb_:
        return NO + PASS + PASS
    common = (Counter(pa_) & Counter(pb_)).total()
    given, taken = common / len(pa_), common / len(pb_)
    both = 0.0
    if taken >= 0.6:
        both = (Counter(zip(pa_, pa_[1:])) & Counter(zip(pb_, pb_[1:]))).total() / max(1, len(pa_) - 1)
    return _vote(given >= 0.7 and taken >= 0.7) + _vote(pa_[:6] == pb_[: len(pa_[:6])] and len(pb_) >= 3) + _vote(both >= 0.65 and taken >= 0.6)


def _refusal(prompt: str, content: str, reason: str | None) -> str:
    parts = [s for s in _SENTENCE.split(content) if _WORD.search(s)]
    if not parts:
        return NO + PASS + PASS + PASS + PASS
    words = len(_WORD.findall(content))
    structured = content[:1] in "[{" or words < 3
    plain = not structured and not any(_LISTED.match(s) for s in parts) and not any(_DOMAIN.search(_NUMBERED.sub("", s)) for s in parts)
    # Only a text without figures, codes and lists can decline; the others need no closer look.
    declined = [s for s in parts if _REFUSAL.search(s)] if plain else []
    meta = [s for s in parts if _META.search(s)] if plain else []
    content_parts = [s for s in parts if s not in meta and s not in declined and len(_WORD.findall(s)) >= 5]
    return (
        _vote(bool(declined) and plain)
        + _vote(plain and bool(meta or declined) and words <= 60)
        + _vote(True if reason == "content_filter" else None)
        + _vote(plain and words >= 4 if _STRUCTURED.search(prompt) else None)
        + _vote(plain and bool(meta or declined) and not content_parts and words <= 60)
    )


def _other_language(prompt: str, content: str) -> str:
    want = asked_for(prompt)
    if want is None or content[:1] in "[{":
        return PASS * 3
    words, script = by_words(content), by_script(content)
    if words == want and script in (None, want):
        return NO + (PASS if script is None else NO) + NO
    parts = [language_of(s) for s in _SENTENCE.split(content)]
    known = [x for x in parts if x]
    return _vote(None if words is None and script not in ("zh", "ru") else (script if script in ("zh", "ru") else words) != want) + _vote(None if script is None else script != want) + _vote(sum(x != want for x in known) > len(known) / 2 if known else None)


def _closed(content: str, raw: str) -> bool | None:
    """Whether brackets, strings and fences are closed; None where the answer has no such form."""
    if raw.count("```") % 2:
        return False
    if content[:1] not in "[{":
        return None
    try:
        json.loads(content)
        return True
    except ValueError:
        depth, inside, slash = 0, False, False
        for c in content:
            if inside:
                inside = slash or c != '"'
                slash = c == "\\" and not slash
            elif c == '"':
                inside, slash = True, False
            else:
                depth += (c in "[{") - (c in "]}")
        return depth <= 0 and not inside


def _truncated(raw: str, content: str, reason: str | None, error: str | None) -> tuple[str, str]:
    """The votes if the last word is a known end of a line, and those if it is not."""
    words = _WORD.findall(content)
    if not words:
        return NO + PASS * 5, NO + PASS * 5
    closed = _closed(content, raw)
    lines = [x for x in content.splitlines() if x.strip()]
    items = sum(bool(_LISTED.match(x)) for x in lines)
    numbers = all(_NUMBER.fullmatch(x) for x in lines)
    prose = closed is None and items < 1 and not numbers and len(words) >= 4
    stop = bool(_TERMINAL.search(content))
    head = _vote(None if closed is None else not closed) + _vote(not stop if prose else None) + _vote(True if reason == "length" else None)
    tail = _vote(True if error and _BROKEN_OFF.search(error) else None)
    out = []
    for ended in (True, stop):
        short = None
        if numbers and len(lines) > 1:
            size = Counter(len(x.strip()) for x in lines[:-1]).most_common(1)[0][0]
            short = len(lines[-1].strip()) < size
        elif items > 1 and items >= len(lines) - 1:
            short = not ended or len(_WORD.findall(lines[-1])) < 3
        out.append(head + _vote(not ended if items and closed is None else None) + _vote(short) + tail)
    return out[0], out[1]


def _line_ends(rows: DataFrame, text: str) -> DataFrame:
    """w: words that are known ends, by the lines before the last of all answers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        ended: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([ended[w] for w in held], pa.int64()), pa.array(list(held.values()), pa.int64())], names=["w", "ends", "n"])
            held.clear()
            ended.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for line in unwrap(t).splitlines()[:-1]:
                    if words := [w.lower() for w in _WORD.findall(line)]:
                        held.update(words)
                        ended[words[-1]] += 1
            if len(held) > 200_000:
                yield flush()
        yield flush()

    counts = rows.select(text).mapInArrow(count, "w string, ends long, n long").groupBy("w").agg(F.sum("ends").alias("ends"), F.sum("n").alias("n"))
    return counts.where((F.col("ends") > 0) & (F.col("ends") >= END_RATE * F.col("n"))).select("w")


def label_pairs(df: DataFrame, key: str, prompt: str, completion: str, reason: str, error: str, order: str) -> DataFrame:
    """(``key``, defect, posterior) of every defect whose posterior reaches its cutoff.

    Labelling functions vote on each defect from the texts, the finish reason and the error; a label
    model per defect, fitted by expectation-maximization over the counts of vote patterns of all
    rows, turns the votes into a posterior.  A pair may keep several defects; ``main_defect`` picks one.

    Null and blank prompts and answers are voted on like others (a null answer is empty); null
    reasons and errors say nothing.  Of repeated keys the latest row by ``order`` counts.  Extra
    columns are not read.
    """
    source = at_least_parallel(df.select(F.col(key), F.col(order).alias("_order"), prompt, completion, reason, error))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[str]] = [[] for _ in DEFECTS]
            last, unended = [], []
            for p, c, r, e in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                p, c = p or "", c or ""
                content = unwrap(c)
                word = (_WORD.findall(content) or [""])[-1].lower()
                # Which of the two holds is joined below.
                truncated, cut = _truncated(c, content, r, e)
                votes = (_empty(p, c, content), _copy(p, content), _refusal(p, content, r), _other_language(p, content), truncated)
                last.append(word if truncated != cut else None)
                unended.append(cut)
                for column, v in zip(out, votes):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.string()) for c in (*out, last, unended))], names=["key", "_order", *DEFECTS, "w", "cut"])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    votes = source.mapInArrow(vote, f"key {kinds[key]}, _order {kinds['_order']}, " + ", ".join(f"{c} string" for c in (*DEFECTS, "w", "cut")))
    work = Workspace(df.sparkSession, "pairs")
    voted = work.write(latest(votes, ["key"], "_order").drop("_order"))
    open_ = voted.where("w is not null").join(_line_ends(source, completion).withColumn("known", F.lit(True)), "w", "left")
    settled = open_.withColumn("truncated", F.when(F.col("known"), F.col("truncated")).otherwise(F.col("cut")))
    kept = work.write(voted.where("w is null").select("key", *DEFECTS).unionByName(settled.select("key", *DEFECTS)))
    stacked = kept.select("key", F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("votes")) for d in DEFECTS])).alias("x")).select("key", "x.*")
    counts = stacked.groupBy("defect", "votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** functions rows per defect
    found = []
    for d in DEFECTS:
        patterns = {r["votes"]: r["n"] for r in counts if r["defect"] == d}
        found += [(d, v, p) for v, p in posteriors(patterns, PRIORS[d], TRUST[d]).items() if p >= CUTOFFS[d]]
    table = df.sparkSession.createDataFrame(found, "defect string, votes string, posterior double")
    return stacked.join(F.broadcast(table), ["defect", "votes"]).select(F.col("key").alias(key), "defect", "posterior")


def main_defect(labelled: DataFrame, key: str) -> DataFrame:
    """(``key``, defect): one defect of each pair that has any.

    An empty answer has no other defect; a copied prompt or a refusal may look broken off or be in
    another language, which then follows from it; so the order of ``DEFECTS`` decides.
    """
    rank = reduce(lambda acc, i: acc.when(F.col("defect") == DEFECTS[i], -i), range(1, len(DEFECTS)), F.when(F.col("defect") == DEFECTS[0], 0))
    return labelled.groupBy(key).agg(F.max_by("defect", rank).alias("defect"))
