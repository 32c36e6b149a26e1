"""Text functions as column expressions; a null text gives null unless said otherwise."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: The stop words of the pool tokenizer.
POOL_STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
#: The stop words of query comparison.
QUERY_STOP = (
    "the and for with from into onto that this these those are was were been being its their of in on to a an by as at or is be not no via using use based "
    "review systematic meta analysis update updated recent current new role"
).split()
#: Prefixes under which an id may be given.
ID_PREFIXES = ["pmid", "pubmed", "corpusid"]
#: Edges of the bins of result counts.
RESOURCE_EDGES = [(0, "0"), (16, "1-16"), (64, "17-64"), (256, "65-256"), (1024, "257-1024")]
#: Patterns of citation markers: numbers in brackets or parentheses, author and year.
CITED = [
    r"\[\s*\d[\d,;\s–—-]*\]",
    r"\([A-Z][A-Za-z-]+(?:\s+et\s+al\.)?,\s*[12]\d{3}[a-z]?(?:;\s*[A-Z][A-Za-z-]+(?:\s+et\s+al\.)?,\s*[12]\d{3}[a-z]?)*\)",
    r"\([A-Z][A-Za-z-]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z-]+|\s+et\s+al\.)?\s+[12]\d{3}[a-z]?\)",
    r"\(\s*\d{1,3}(?:\s*[,;–—-]\s*\d{1,3})*\s*\)",
]


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def pool_tokens(text: Column) -> Column:
    """Tokens of the search index: runs of a-z0-9 in lower case, two characters or more, no stop words."""
    return F.filter(_all(F.lower(text), "[a-z0-9]+"), lambda t: (F.length(t) > 1) & ~t.isin(POOL_STOP))


def query_tokens(text: Column) -> Column:
    """The set of telling tokens of a query, sorted: longer than two, no stop words, no years."""
    kept = F.filter(_all(F.lower(text), "[a-z0-9]+"), lambda t: (F.length(t) > 2) & ~t.isin(QUERY_STOP) & ~t.rlike(r"^(19|20)\d\d$"))
    return F.array_sort(F.array_distinct(kept))


def jaccard(a: Column, b: Column, empty: float) -> Column:
    """Common members by all members of two arrays of distinct values; ``empty`` if both are."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(empty))


def resolve_id(raw: Column) -> Column:
    """The digits of an id, with or without a known prefix; null for anything else."""
    s = F.trim(raw)
    known = F.lower(F.substring_index(s, ":", 1)).isin(ID_PREFIXES)
    rest = F.when(~F.contains(s, F.lit(":")), s).when(known, F.trim(F.regexp_replace(s, "^[^:]*:", "")))
    return F.when(rest.rlike(r"^\d+$"), rest)


def year_range(text: Column) -> tuple[Column, Column]:
    """(from, to) of "Y", "Y-", "-Y" and "Y-Z"; null for an open or unreadable end."""
    s = F.trim(text)
    low, high = F.substring_index(s, "-", 1), F.regexp_replace(s, "^[^-]*-", "")
    single = ~F.contains(s, F.lit("-"))
    number = lambda c: F.trim(c).try_cast("int")
    return number(low), F.when(single, number(low)).otherwise(number(high))


def clean_text(text: Column) -> Column:
    """Ligatures spelled out, no control characters, words broken at a hyphen joined, single blanks."""
    t = F.regexp_replace(F.regexp_replace(text, "ﬁ", "fi"), "ﬂ", "fl")
    t = F.regexp_replace(F.translate(t, " ", " "), r"[\x00-\x08\x0b\x0c\x0e-\x1f]+", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"-\s+", ""), r"\s+", " "), r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Sentences: split at blanks after an end mark and before a capital or an opening bracket."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z(\[])"), F.trim), lambda s: s != "")


def loose_sentences(text: Column) -> Column:
    """Sentences: split at blanks after any end mark."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def citation_markers(text: Column) -> Column:
    """All citation markers, kind by kind in the order of the text."""
    return F.concat(*[_all(text, p) for p in CITED])


def reference_ids(text: Column, widest: int = 50) -> Column:
    """Numbers cited in brackets or parentheses, ranges spelled out, sorted without repeats.

    A range that falls or spans more than ``widest`` names nothing.
    """
    marks = F.concat(_all(text, CITED[0]), _all(text, CITED[3]))
    parts = F.flatten(F.transform(marks, lambda m: F.split(F.regexp_replace(m, r"[\[\]()\s]", ""), "[,;]")))
    pieces = F.transform(parts, lambda p: F.split(p, "[–—-]"))

    def spelled(p: Column) -> Column:
        lo, hi = F.get(p, F.lit(0)).try_cast("int"), F.get(p, F.lit(1)).try_cast("int")
        none = F.array().cast("array<int>")
        span = F.when((hi > lo) & (hi - lo <= widest), F.sequence(lo, F.when(hi > lo, hi).otherwise(lo))).otherwise(none)
        return F.when(F.size(p) == 1, F.when(lo.isNotNull(), F.array(lo)).otherwise(none)).when((F.size(p) == 2) & lo.isNotNull() & hi.isNotNull(), span).otherwise(none)

    return F.array_sort(F.array_distinct(F.flatten(F.transform(pieces, spelled))))


def section_kind(title: Column) -> Column:
    """What a section's title says it is."""
    t = F.lower(title)
    return (
        F.when(t.startswith("abstract"), "abstract").when(t.startswith("keywords"), "keywords").when(t.startswith("references"), "references")
        .when(F.contains(t, F.lit("introduction")), "background").when(F.contains(t, F.lit("conclusion")) | F.contains(t, F.lit("discussion")), "discussion_or_conclusion").otherwise("body")
    )


def is_noise(sentence: Column) -> Column:
    """A line of metadata: it gives a doi, or two or more names with affiliation numbers."""
    return sentence.rlike(r"(?i)\bdoi:") | (F.regexp_count(sentence, F.lit("[A-Z][a-z]{2,}[0-9]+")) >= 2)


def heading(text: Column) -> Column:
    """A heading for comparison: no leading number, lower case, single blanks, no outer marks."""
    t = F.regexp_replace(F.lower(text), r"^\s*(\d+(\.\d+)*[.)]?|[ivxlc]+[.)])\s+", "")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ :.\-]+|[ :.\-]+$", "")


def word_count(text: Column) -> Column:
    """Number of runs of word characters."""
    return F.regexp_count(text, F.lit("[A-Za-z0-9_]+"))


def blank_count(text: Column) -> Column:
    """Number of runs of other characters than blanks."""
    return F.regexp_count(text, F.lit(r"[^\s]+"))


def resource_bin(n: Column) -> Column:
    """The bin of a count of results; null counts as none."""
    n = F.coalesce(n, F.lit(0))
    out = F.when(n <= RESOURCE_EDGES[0][0], RESOURCE_EDGES[0][1])
    for edge, name in RESOURCE_EDGES[1:]:
        out = out.when(n <= edge, name)
    return out.otherwise(">1024")


def result_effect(n: Column, k: Column) -> Column:
    """How much of what was asked for came back: none, few (a fifth), some (four fifths) or many."""
    n, k = F.coalesce(n, F.lit(0)), F.greatest(k, F.lit(1))
    return F.when(n == 0, "none").when(n <= 0.2 * k, "few").when(n <= 0.8 * k, "some").otherwise("many")


def digest(text: Column) -> Column:
    """sha256 of the text in hexadecimal."""
    return F.sha2(text, 256)


def snippet(text: Column, size: int = 320) -> Column:
    """A text cut to ``size`` characters at a blank, with dots if anything is lost."""
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, size), r"\s[^\s]*$", ""), F.lit(" ...")))


def synthetic_id(year: Column, pmid: Column) -> Column:
    """An id in the form of a preprint server's: year, month 07, number."""
    return F.when(year.isNotNull(), F.format_string("%04d07.%d", year, pmid))


def strip_scheme(text: Column) -> Column:
    """What follows the first dot of a composite id; the id itself if it has none."""
    return F.regexp_replace(text, r"^[^.]*\.", "")


def term_hash(terms: Column) -> Column:
    """A term as a signed 64-bit number: its 8-byte blake2b digest, read little-endian; null gives null."""
    return _blake(terms)


@F.arrow_udf(LongType())
def _blake(terms: pa.Array) -> pa.Array:
    return pa.array([None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little", signed=True) for t in terms.to_pylist()], pa.int64())


def bibtex(pmid: Column, title: Column, journal: Column, year: Column) -> Column:
    """A bibliography entry; unknown fields are left empty."""
    e = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat(F.lit("@article{pmid"), e(pmid), F.lit(", title={"), e(title), F.lit("}, journal={"), e(journal), F.lit("}, year={"), e(year), F.lit("}}"))
