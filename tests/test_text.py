"""Text functions: fixed cases and edge cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as T


def one(spark, make, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r.y for r in df.select(make(F.col("x")).alias("y")).collect()]


def test_tokens(spark):
    assert one(spark, T.pool_tokens, "The p53-Gene, a B12 of it", "", None) == [["p53", "gene", "b12"], [], None]
    assert one(spark, T.query_tokens, "Role of gene GENE in 2019 yeast", None) == [["gene", "yeast"], None]


def test_ids_and_years(spark):
    assert one(spark, T.resolve_id, "PMID: 12", " 7 ", "CorpusId:3x", "doi:1", "pubmed:9", None) == ["12", "7", None, None, "9", None]
    low, high = (lambda x: T.year_range(x)[0]), (lambda x: T.year_range(x)[1])
    assert one(spark, low, "2001", "2001-", "-2004", "2001-2004", "x", None) == [2001, 2001, None, 2001, None, None]
    assert one(spark, high, "2001", "2001-", "-2004", "2001-2004", "x", None) == [2001, None, 2004, 2004, None, None]


def test_sentences(spark):
    assert one(spark, T.sentences, "One is 1.5 x. Two? (Three) ends", "", None) == [["One is 1.5 x.", "Two?", "(Three) ends"], [], None]
    assert one(spark, T.loose_sentences, "a. b! c", None) == [["a.", "b!", "c"], None]


def test_citations(spark):
    assert one(spark, T.citation_markers, "x [1,3-5] y (Smith et al., 2001) z (Doe 1999) (4)", "none") == [["[1,3-5]", "(Smith et al., 2001)", "(Doe 1999)", "(4)"], []]
    assert one(spark, T.reference_ids, "x [1,3-5] y [9–7] (2) [5-99]", "none", None) == [[1, 2, 3, 4, 5], [], None]


def test_forms(spark):
    assert one(spark, T.heading, "2.1 Main  Results:", "IV. Methods") == ["main results", "methods"]
    assert one(spark, T.section_kind, "Introduction to X", "Discussion", "References", "Other") == ["background", "discussion_or_conclusion", "references", "body"]
    assert one(spark, T.clean_text, " eﬁ hy- phen\n x ", None) == ["efi hyphen x", None]
    assert one(spark, lambda x: T.snippet(x, 10), "short", "a longer text of words") == ["short", "a longer ..."]
    assert one(spark, T.strip_scheme, "202007.12", "12") == ["12", "12"]
    assert one(spark, lambda x: T.resource_bin(F.length(x)), "", "a", "a" * 17, "a" * 1025, None) == ["0", "1-16", "17-64", ">1024", "0"]
