"""Text that looks the same in different characters: skeletons, consistent form, detection."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.operators.skew import lookup_join
from paperloom.session import Workspace

# Letters of other scripts (and stray Latin forms) with the plain Latin letter they
# look like, after the public confusables data.  The Greek letters that name genes and pathways
# (alpha, beta, gamma, delta, kappa) are left out on purpose: they are not look-alikes here.
CYRILLIC = "аa еe оo рp сc уy хx іi јj ѕs ԁd һh ԛq ԝw ӏl ԍG ѵv ґr АA ВB ЕE ЗЗ КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԌG ԚQ ԜW ҮY ӀI"
GREEK = "οo νv ρp ιi υu χx ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ϺM ͿJ"
ARMENIAN = "օo սu հh ցg զq ոn ՍU ՏS ՕO ԼL"
CHEROKEE = "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᎳW ᎩY ᏃZ"
LATIN = "ɡg ɑa ıi ȷj ɩi ʋu ʀR ɴN ʏY ᴄc ᴏo ᴠv ᴡw ᴢz ꜱs \u212aK \u212bÅ"

#: look-alike letter -> plain letter
LETTERS = {pair[0]: pair[1:] for table in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LATIN) for pair in table.split() if pair[0] != pair[1:]}

#: Hyphens that look like U+002D.
HYPHENS = "\u2010\u2011\u2043\ufe63\uff0d\u02d7"
#: Characters without any mark on the page.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u206a-\u206f\ufeff"
#: Blanks of other width.
BLANKS = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
#: Full-width forms and Latin ligatures; what they stand for follows from compatibility decomposition.
WIDE = "\uff01-\uff5e\uffe0-\uffe6\ufb00-\ufb06"

_INVISIBLE = regex.compile(f"[{INVISIBLE}]")
_JOINED_EMOJI = regex.compile(r"(?<=[\p{So}\p{Sk}\ufe0f])\u200d(?=\p{So})")
_CJK_MARK = regex.compile(r"(?<=[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\u3000-\u303f])[\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff5e]|[\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff5e](?=[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}])")
_CJK_BLANK = regex.compile(r"(?<=[\p{Han}\u3001-\u303f])\u3000|\u3000(?=\p{Han})")
_ODD = regex.compile(f"[{WIDE}{INVISIBLE}{BLANKS}{HYPHENS}\u212a\u212b]|(?<=\\p{{L}})[\u0300-\u036f]")
_LOOKALIKE = regex.compile("[" + "".join(LETTERS) + "]")
#: Whether anything but the composition of accents may change, and whether the place decides on it.
_CHANGED = regex.compile(f"[{WIDE}{INVISIBLE}{BLANKS}{HYPHENS}{''.join(LETTERS)}]")
_SPECIAL = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\u3000-\u303f]|\u200d")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_PLAIN = regex.compile(r"\p{Latin}")
_OTHER = regex.compile(r"(?!\p{Latin})\p{L}")


def _prototypes() -> dict[int, str]:
    """Code point -> what stands for it in a skeleton."""
    table = {ord(a): unicodedata.normalize("NFD", b) for a, b in LETTERS.items()}
    for block in regex.findall(r"(.)-(.)|(.)", WIDE):
        first, last = (block[0], block[1]) if block[0] else (block[2], block[2])
        table |= {cp: unicodedata.normalize("NFKD", chr(cp)) for cp in range(ord(first), ord(last) + 1)}
    table |= {ord(c): "-" for c in HYPHENS}
    for text, to in ((INVISIBLE, ""), (BLANKS, " ")):
        for a, b, c in regex.findall(r"(.)-(.)|(.)", text):
            table |= {cp: to for cp in range(ord(a or c), ord(b or c) + 1)}
    return table


PROTOTYPES = _prototypes()
_FORMS = {cp: to for cp, to in PROTOTYPES.items() if chr(cp) not in LETTERS or chr(cp) in "\u212a\u212b"}


def skeleton(text: str | None) -> str | None:
    """Decompose, replace every character by its prototype, decompose again.

    Texts that look alike have equal skeletons; a skeleton is for comparison, not for reading.
    Null gives null.
    """
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(PROTOTYPES))


def _mixed(word: str) -> bool:
    """Whether a word of otherwise plain Latin letters holds a look-alike."""
    bare = _INVISIBLE.sub("", word)
    if not _LOOKALIKE.search(bare) or not any(c not in LETTERS and _PLAIN.match(c) for c in unicodedata.normalize("NFKC", bare)):
        return False
    return all(c in LETTERS for c in _OTHER.findall(bare) if c not in "αβγδκ")


def canonical(text: str | None) -> str | None:
    """The one consistent form: plain Latin for full-width forms, ligatures and look-alikes inside
    otherwise Latin words, no invisible characters, plain blanks and hyphens, composed accents.

    Whole words of other scripts, gene symbols in Greek, superscripts, en dashes, full-width marks
    beside Chinese or Japanese text and joined emoji stay.  Null gives null, an empty text itself.
    """
    if text is None or text.isascii():
        return text
    if not _CHANGED.search(text):
        return unicodedata.normalize("NFC", text)
    if _SPECIAL.search(text):
        kept: dict[int, str] = {}
        for keep in (_JOINED_EMOJI, _CJK_MARK, _CJK_BLANK):
            kept |= {m.start(): m.group() for m in keep.finditer(text)}
        out = "".join(c if i in kept else _FORMS.get(ord(c), c) for i, c in enumerate(text))
    else:
        out = text.translate(_FORMS)
    if _LOOKALIKE.search(out):
        out = _WORD.sub(lambda m: "".join(LETTERS.get(c, c) for c in m.group()) if _mixed(m.group()) else m.group(), out)
    return unicodedata.normalize("NFC", out)


def has_lookalikes(text: str | None) -> bool:
    """Whether the text looks like plain text but differs from it in its characters.

    The skeleton decides first: a text whose skeleton is its own decomposition has none.  Of the
    rest, each replaced character is looked at in its place.
    """
    if text is None or text.isascii():
        return False
    if skeleton(text) == unicodedata.normalize("NFD", text) and not _ODD.search(text):
        return False
    kept = {m.start() for keep in (_JOINED_EMOJI, _CJK_MARK, _CJK_BLANK) for m in keep.finditer(text)}
    if any(m.start() not in kept for m in _ODD.finditer(text)):
        return True
    return any(_mixed(m.group()) for m in _WORD.finditer(text))


def _map_texts(df: DataFrame, columns: list[str], kind: T.DataType, made: pa.DataType, function) -> DataFrame:
    """``df`` with each of ``columns`` replaced by ``function`` of its text, in Arrow batches."""
    schema = T.StructType([T.StructField(f.name, kind) if f.name in columns else f for f in df.schema.fields])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [pa.array([function(t) for t in a.to_pylist()], made) if n in columns else a for n, a in zip(names, batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(run, schema)


def find_lookalikes(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(``key``, ``field``) of every value that holds look-alike characters, once each.

    Plain ASCII values are told apart in the JVM and never reach Python.  Null and empty values
    are no cases, a null key is a key.  No shuffle but that of the few rows found.
    """
    odd = [F.when(F.col(c).rlike(r"[^\x00-\x7F]"), F.col(c)).alias(f"v{i}") for i, c in enumerate(columns)]
    values = df.select(F.col(key), *odd)
    flagged = _map_texts(values.where(" or ".join(f"v{i} is not null" for i in range(len(columns)))), [f"v{i}" for i in range(len(columns))], T.BooleanType(), pa.bool_(), has_lookalikes)
    fields = F.filter(F.array(*[F.when(F.col(f"v{i}"), F.lit(c)) for i, c in enumerate(columns)]), lambda x: x.isNotNull())
    return flagged.select(key, F.explode(fields).alias("field")).distinct()


def consistent(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the texts of ``columns`` in their one consistent form."""
    return _map_texts(df, columns, T.StringType(), pa.string(), canonical)


def group_lookalikes(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row per row of ``df`` with a value: ``key``, ``value``, ``form``, ``class_id``, ``n_forms``.

    Values with equal skeletons form a class; ``class_id`` is a hash of the skeleton, ``n_forms``
    the number of distinct originals in it.  Distinct values are counted before the join, so a
    value with a large part of all rows costs one row.  Null values belong to no class.
    """
    rows = df.where(F.col(column).isNotNull()).select(F.col(key), F.col(column).alias("value"))
    forms = _map_texts(rows.select("value", F.col("value").alias("skeleton")).distinct(), ["skeleton"], T.StringType(), pa.string(), skeleton)
    forms = forms.select("value", F.xxhash64("skeleton").alias("class_id"), F.sha2("skeleton", 256).alias("full"))
    sizes = forms.groupBy("class_id", "full").agg(F.count(F.lit(1)).alias("n_forms"))
    classes = forms.join(sizes, ["class_id", "full"]).select("value", "class_id", "n_forms")
    several = classes.where("n_forms > 1")
    several = Workspace(df.sparkSession, "lookalikes").write(several)
    return lookup_join(rows, several, ["value"], rows.count(), "inner").select(key, "value", "class_id", "n_forms")
