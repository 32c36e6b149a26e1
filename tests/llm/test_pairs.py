"""Defects of pairs on a labelled fixture, and the label model."""

from __future__ import annotations

import random

import pytest

from paperloom.llm.label_model import posteriors
from paperloom.llm.language import asked_for, by_words
from paperloom.llm.pairs import _line_ends, label_pairs, main_defect

SENTENCES = {
    "en": ["The dose of 12 mM was the cause of a delayed response in these cells.", "Loss of RAC9 reduced the survival of the cells by 30%.", "It is not clear that this was due to the treatment with 8 nM."],
    "de": ["Der Verlust von RAC9 verringerte die Rate der untersuchten Zellen um 30%.", "Eine Dosis von 12 mM führte zu einer verzögerten Antwort.", "Die Messungen wurden dreimal wiederholt und nicht verblindet."],
    "fr": ["Une dose de 12 mM a provoqué une réponse retardée dans les cellules.", "La perte de RAC9 a réduit la survie des cellules de 30%.", "Les mesures ont été répétées trois fois par les auteurs."],
}
REFUSE = ["I'm sorry, but I can't help with that request.", "As a language model I must decline.", "Je suis désolé, mais je ne peux pas répondre à cette demande.", "Ich darf zu diesem Thema keine Auskunft geben."]
EMPTY = ["", "  \n", "```json\n```", "<think>hm</think>", "​", '""', None]


def fixture(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(500):
        lang = rng.choice(list(SENTENCES))
        ask = {"en": "Summarise the findings in a few words for the reader:", "de": "Fasse die folgenden Befunde in wenigen Worten für den Leser zusammen:", "fr": "Résume les résultats suivants en quelques phrases pour le lecteur :"}[lang]
        prompt = f"{ask}\n" + " ".join(rng.choices(SENTENCES[lang], k=3)) + f" [{k}]"
        answer = " ".join(rng.sample(SENTENCES[lang], 2))
        label, reason, error = None, "stop", None
        roll = rng.random()
        if roll < 0.05:
            label, answer = "empty", rng.choice(EMPTY)
        elif roll < 0.1:
            label, answer = "copy", rng.choice(["", "Question: "]) + prompt
        elif roll < 0.15:
            label, answer = "refusal", rng.choice(REFUSE)
        elif roll < 0.2:
            label, answer = "other_language", " ".join(rng.sample(SENTENCES[rng.choice([x for x in SENTENCES if x != lang])], 2))
        elif roll < 0.28:
            label, answer = "truncated", answer[: rng.randrange(30, len(answer) - 8)].rstrip(" .") + " unfinis"
            reason = rng.choice(["stop", "length", None])
        elif roll < 0.3:
            error = "read timeout"
        rows.append((k, prompt, answer, reason, error, k, label))
    rows.append((600, "Write queries as a JSON list. If nothing fits, return [].", "[]", "stop", None, 0, None))
    rows.append((601, "Write queries as a JSON list.", '["a b", "c', "stop", None, 0, "truncated"))
    rows.append((602, "Is it so? Answer yes or no.", "yes", None, None, 0, None))
    rows.append((603, "Copy the first sentence word for word.\nPassage: " + " ".join(SENTENCES["en"]), SENTENCES["en"][0], "stop", None, 0, None))
    rows.append((604, "What is known of it in the cells?", "I cannot rule out confounding, but the evidence is as follows. " + SENTENCES["en"][0], "stop", None, 0, None))
    rows.append((605, None, "fine answer with several words here.", None, None, 0, None))
    return rows + rows[:30]


@pytest.mark.parametrize("seed", [1, 2])
def test_labelled_fixture(spark, seed):
    rows = fixture(seed)
    df = spark.createDataFrame(rows, "id int, p string, c string, r string, e string, at int, defect string")
    got = {r.id: r.defect for r in main_defect(label_pairs(df, "id", "p", "c", "r", "e", "at"), "id").collect()}
    want = {r[0]: r[6] for r in rows}
    wrong = {k for k in want if got.get(k) != want[k]}
    assert len(wrong) <= 0.01 * len(want), [(k, got.get(k), want[k]) for k in wrong]
    assert not wrong & {600, 601, 602, 603, 604, 605}


def test_empty(spark):
    df = spark.createDataFrame([], "id int, p string, c string, r string, e string, at int")
    assert label_pairs(df, "id", "p", "c", "r", "e", "at").count() == 0


def test_label_model():
    # Two good functions and one that guesses: the posterior follows the good ones.
    counts = {"111": 40, "110": 45, "001": 400, "000": 500, "100": 6, "011": 5, "---": 4}
    post = posteriors(counts, 0.1, [0.9, 0.9, 0.6])
    assert post["110"] > 0.9 and post["001"] < 0.1 and post["---"] < 0.5
    assert posteriors({}, 0.1, [0.9]) == {}


def test_language():
    for lang, texts in SENTENCES.items():
        assert by_words(" ".join(texts)) == lang
    assert asked_for("Translate into German: the cells of the dose") == "de"
    assert asked_for("Summarise this for the reader. Please answer in French.") == "fr"


def test_known_ends_do_not_depend_on_table_size(spark):
    """One answer gets the same votes in a small and a large table of the same make."""
    base = [f"1. uptake of iron in {x}\n2. loss of the signal in {x}\n3. results." for x in ("yeast", "mice", "leaves", "roots")]
    # A list may end at "of", as lines do now and then, but rarely for how often the word occurs.
    base += ["1. the fate of\n2. nothing of note in all of these lines of cells of the skin of the back of the heads of flies.\n3. results."]
    base += ["1. the use of the rate of the flow of the loss of the gain of the sum of the parts of the whole of the set of the list of yeast\n2. results."] * 3
    asked = {"whole": "1. uptake of iron in mice\n2. uptake of iron in leaves", "cut": "1. uptake of iron in mice\n2. uptake of"}
    got = {}
    for size in (1, 30):
        rows = [(f"{i}", "Write a list of titles.", c, "stop", None, 0) for i, c in enumerate(base * size)] + [(k, "Write a list of titles.", c, "stop", None, 0) for k, c in asked.items()]
        df = spark.createDataFrame(rows, "id string, p string, c string, r string, e string, at int")
        known = {r.w for r in _line_ends(df, "c").collect()}
        got[size] = {w: w in known for w in ("mice", "leaves", "of", "uptake")}
        assert {r.defect for r in label_pairs(df, "id", "p", "c", "r", "e", "at").where("id = 'whole'").collect()} == set()
    assert got[1] == got[30] == {"mice": True, "leaves": True, "of": False, "uptake": False}


@pytest.mark.parametrize(
    ("prompt", "language"),
    [
        ("What is known about iron uptake in hepatocytes?", "en"),
        ("Explain how splice-site choice relates to spleen sections.", "en"),
        ("Write two or three sentences on quorum sensing.", "en"),
        ("Was ist über die Aufnahme von Eisen bekannt?", "de"),
        ("¿Qué se sabe sobre la captación de hierro?", "es"),
        ("Que sait-on sur le transport du fer ?", "fr"),
        ("Explain it. Answer in French.", "fr"),
        ("Xyz 12", None),
        ("", None),
    ],
)
def test_short_prompts_have_a_language(prompt, language):
    assert asked_for(prompt) == language
