"""Personal data: what is found, what is not, and what takes its place."""

from __future__ import annotations

import pytest

from paperloom.llm.pii import find_all, find_pii, pseudonymise, redact

FOUND = [
    ("Write to rosa.kelm+x@lab.uni.example today.", "email", "rosa.kelm+x@lab.uni.example"),
    ("mail kelm [at] lab [dot] uni [dot] test", "email", "kelm [at] lab [dot] uni [dot] test"),
    ("KELM88(at)inbox.example", "email", "KELM88(at)inbox.example"),
    ("call +44 1632 960559 now", "phone", "44 1632 960559"),
    ("call (821) 555-0143 now", "phone", "821) 555-0143"),
    ("tel=333.555.0107;", "phone", "333.555.0107"),
    ("phoned (030/23125 880) twice", "phone", "030/23125 880"),
    ("or 0017005550112.", "phone", "0017005550112"),
    ("passport no. K47658956 at", "id_number", "K47658956"),
    ("Her record (MRN 646-540-78) lists", "id_number", "646-540-78"),
    ("health insurance number Q974 787 010)", "id_number", "Q974 787 010"),
    ("tax ID 91/983/0770.", "id_number", "91/983/0770"),
    ("lives at Flat 8, 157 Foundry Road, Bexmoor and", "address", "Flat 8, 157 Foundry Road, Bexmoor"),
    ("wohnhaft Am Alten Hof 73, 70123 Altavara.", "address", "Am Alten Hof 73, 70123 Altavara"),
    ("of Calle de la Noria 49, 90496 Eastvane, was", "address", "Calle de la Noria 49, 90496 Eastvane"),
    ("to 13, rue des Saules, 29226 Eastvane.", "address", "13, rue des Saules, 29226 Eastvane"),
    ("at P.O. Box 238, Saint-Aurel.", "address", "P.O. Box 238, Saint-Aurel"),
    ("Birkenstraße 60, 23382 Bexmoor", "address", "Birkenstraße 60, 23382 Bexmoor"),
    ("Dear Dr. Rosa T. de la Kelmar, we", "name", "Rosa T. de la Kelmar"),
    ("signed by Kelmar-Vindo, Rosa, on", "name", "Kelmar-Vindo, Rosa"),
    ("checked by S. T. Tumide.", "name", "S. T. Tumide"),
    ("labelled ROSA KELMAR.", "name", "ROSA KELMAR"),
    ("通讯作者：Zoe Kelmar，来信", "name", "Zoe Kelmar"),
]
NONE = [
    "As shown by Kelmar et al. (2007), it is so.", "The Kelmar–Vindo test and Kelmar syndrome", "In San Telmiro and Vallée-Sorin", "Catalogue no. 4471-0203, lot 2061-7", "Grant ZX-2010-04844", "PMID 500047512",
    "handle @cell_news", "stored @4 °C. Tapz-43 was", "The Novabrook Street cohort enrolled 275 adults", "89 ± 225 cells (range 162-382-281)", "Plate barcode 0800-5521-3310", "Uma dose de 12 mM", "accession ZQ_0032.2", "1234567890123", "", "version 10.328.2.1",
]


@pytest.mark.parametrize("text,kind,value", FOUND)
def test_found(text, kind, value):
    assert [(k, text[s:e]) for k, s, e in find_pii(text)] == [(kind, value)]


@pytest.mark.parametrize("text", NONE)
def test_none(text):
    assert find_pii(text) == []


def test_frames(spark):
    texts = [t for t, _, _ in FOUND]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(100, None, "x"), (101, "", "x"), (102, "🙂 R. Kelmar wrote. Rosa Kelmar wrote again to Jonas Vindo.", "x")]
    df = spark.createDataFrame(rows, "id int, body string, kind string")
    found = find_all(df, "id", "body").collect()
    assert len(found) == len(FOUND) + 3 and (102, "name", 2) in {(r.id, r.kind, r.start_at) for r in found}
    clean = {r.id: r.body for r in redact(df, "id", "body").collect()}
    assert clean[0] == "Write to [EMAIL] today." and clean[100] is None and clean[101] == ""
    one, two = ({r.id: r.body for r in pseudonymise(df, "id", "body", s).collect()} for s in ("k", "k"))
    assert one == two and one[100] is None and one[101] == ""
    first, second, third = (w.rstrip(".").split()[-1] for w in (one[102].split(" wrote")[0], one[102].split(" wrote")[1], one[102]))
    assert first == second != third and "Kelmar" not in one[102]
    for i, t in enumerate(texts):
        assert one[i] != t
        assert [k for k, _, _ in find_pii(one[i])][:1] in ([FOUND[i][1]], []) or FOUND[i][1] in ("address", "phone", "id_number")
    assert find_all(df.limit(0), "id", "body").count() == 0
    assert pseudonymise(df.limit(0), "id", "body", "k").count() == 0


def test_collisions_are_resolved(spark, monkeypatch):
    from paperloom.llm import pii

    monkeypatch.setattr(pii, "_SYLLABLES", ["bar", "bel"])
    df = spark.createDataFrame([(i, f"Rosa Kelmar{chr(97 + i)} signed.") for i in range(6)], "id int, body string")
    got = [r.body.split()[1] for r in pseudonymise(df, "id", "body", "k").collect()]
    assert len(set(got)) == 6
