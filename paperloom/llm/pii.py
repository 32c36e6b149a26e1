"""Personal information in free text: detection, typed placeholders and keyed surrogates."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import at_least_parallel
from paperloom.operators.skew import lookup_join
from paperloom.session import Workspace

# Given names by grammatical gender, as met in the corpus.  Accents and case do not matter.
FEMALE = "Amara Anouk Bruna Célia Elif Greta Hana Ilse Inés Jutta Leila Lorna Lucía Mira Nadia Petra Priya Rosa Salma Thandi Tova Uma Vera Wanda Yara Zoë"
MALE = "Anders Björn Dario Deniz Emeka Farid Imre Ivo Jonas Kasper Koji Magnus Mateus Noé Oskar Quentin Rasmus Renzo Samir Stefan Tomas Ugo Willem Zeno"
# Capitalised words that open sentences or headings and are no surnames.
STARTERS = """a across after all an and are as at background based because before between both but by catalogue conclusion consent contact correspondence data deposited
despite during each earlier email figure follow following for from further future grant he her here his home how if in interview it its log loss may methods mean nurse no note of on only
once one or our plate please pmid primer questions reagents results reviewer samples see sent she shipment since some such taken tel the their then there these they this those to
together toward treatment trial two under until using we what when where whereas which while with write
aber als am an auch auf aus bei damit das dass dem den der des die diese ein eine einige er es frau für frühere herr im in ist kennzeichen messungen mit nach nicht rückfragen sie telefonisch und unter von weitere wir zu zwischen
au aucune avec ce ces cette correspondance dans de des dossier du elle en et il ils joindre la le les leur mme monsieur nous on ou par pour quelques si sous sur un une
agradecemos al aún con correspondencia del desde el ella en entre escriba esta este estos estudiamos la las lo los más no nuestros para pero por según se sin sobre su teléfono trabajos tras una uno
as ao aos com correspondência da das do dos em foi isso mais na nas não nos o os ou para pela pelo por são sem sob um uma
mr mrs ms dr prof sir madam miss sr sra dra don doña herr m mme mlle"""
#: What makes a surname part of a term, place or citation instead of a person.
NOT_AFTER = r"(?:\s*(?:[–-]\s*\p{Lu}\p{L}+\s+)?(?:et al\b|test\b|score\b|syndrome\b|index\b|scale\b|method\b|criteria\b|cohort\b|disease\b|reaction\b|effect\b|stain\b|plot\b))"

_PARTICLE = r"(?:(?i:van der|van den|van de|van|von der|von|de la|de los|del|de|di|da|dos|al|el|ben|ibn|le|la)(?:[^\S\n]+|-))"
_PART = r"\p{Lu}[\p{L}\p{M}'’]+"
_SURNAME = rf"(?:{_PARTICLE})?{_PART}(?:-(?:{_PARTICLE})?{_PART})*"
_GAP = r"[^\S\n]+"


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


_GENDER = {_plain(n): g for g, names in (("f", FEMALE), ("m", MALE)) for n in names.split()}
_STARTERS = frozenset(_plain(w) for w in STARTERS.split())
_GIVEN_WORDS = {w for n in [*FEMALE.split(), *MALE.split()] for w in (n, n.upper(), unicodedata.normalize("NFD", n), "".join(c for c in unicodedata.normalize("NFD", n) if not unicodedata.combining(c)))}
_GIVEN_WORDS |= {w.upper() for w in _GIVEN_WORDS} | {w.lower() for w in _GIVEN_WORDS}
#: A maximal run of letters and marks, which is where a given name may stand, and what may not be beside it.
_RUN = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
_BESIDE = re.compile(r"[\w@._+/-]"), re.compile(r"[\w@+̀-ͯ]")
_AFTER_GIVEN = regex.compile(rf"(?:{_GAP}\p{{Lu}}\.?(?!\p{{L}}))*{_GAP}(?P<surname>{_SURNAME})(?![\p{{L}}\p{{N}}@]|-\p{{N}})")
_INITIALS_AFTER = regex.compile(rf"(?:{_GAP}\p{{Lu}}\.?(?![\p{{L}}\p{{N}}]))*")
_BEFORE_GIVEN = regex.compile(rf"(?<![\p{{L}}\p{{N}}@._-])(?P<surname>{_SURNAME}),[^\S\n]*$")
_INITIALS = regex.compile(rf"(?<![\p{{L}}\p{{N}}.@'’°-])(?:\p{{Lu}}\.[^\S\n]?){{1,3}}(?P<surname>{_SURNAME})(?![\p{{L}}\p{{N}}@]|-\p{{N}})")
_TITLED = regex.compile(rf"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Mme|Mlle|Monsieur|Madame|Herr|Frau|Sr|Sra|Dra|Nurse|[Pp]atient|[Pp]aciente)\b[.,]?{_GAP}(?P<name>{_PART}(?:{_GAP}\p{{Lu}}\.?)*{_GAP}{_SURNAME})(?![\p{{L}}\p{{N}}@])")
_TERM = regex.compile(NOT_AFTER)

_DOT = r"(?:\.|[^\S\n]?(?:\[dot\]|\(dot\)|\{dot\})[^\S\n]?|[^\S\n]dot[^\S\n])"
_EMAIL = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}._%+-])(?P<local>[A-Za-z0-9](?:[A-Za-z0-9_%+-]|\.(?=[A-Za-z0-9]))*)(?:@|[^\S\n]?(?:\[at\]|\(at\)|\{{at\}})[^\S\n]?|[^\S\n]at[^\S\n](?=[A-Za-z0-9-]+[^\S\n]dot[^\S\n]))"
    rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![A-Za-z0-9])",
    regex.I,
)
#: What stands between the two parts of an email, and the characters of its first part.
_AT = re.compile(r"(?i)@|[^\S\n]?(?:\[at\]|\(at\)|\{at\})|[^\S\n]at(?=[^\S\n][a-z0-9-]+[^\S\n]dot[^\S\n])")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_BLANK = r"[ \u00a0\u2007\u2009\u202f]"
_PHONE = regex.compile(
    r"(?<![\p{L}\p{N}.+/_-])\(?(?:"
    rf"\+\d{{1,3}}(?:{_BLANK}?\(0\))?(?:(?:{_BLANK}|[.\-/])?\(?\d{{1,6}}\)?){{2,7}}"
    rf"|(?<=\()\d{{3}}\){_BLANK}?\d{{3}}(?:{_BLANK}|[-.])\d{{4}}"
    r"|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}"
    rf"|0\d{{1,4}}/{_BLANK}?\d{{3,6}}(?:{_BLANK}?\d{{2,4}})?|0\d{{2,4}}{_BLANK}\d{{3,4}}{_BLANK}\d{{3,4}}|00[1-9]\d{{9,12}}"
    rf")(?:{_BLANK}?(?:ext|extn|x)\.?{_BLANK}?\d{{1,5}})?(?![\p{{N}}\p{{L}}]|[-./]\d)"
)
_ID = regex.compile(
    r"(?i:\b(?:passport(?: (?:no|number|nr))?|tax (?:id|number|no|ident\w*)|national (?:id|identity)(?: (?:no|number|card))?|identity (?:no|number|card)|personal (?:id|no|number)|patient (?:id|no|number)|"
    r"health insurance (?:no|number)|insurance (?:no|number)|social security (?:no|number)|medical record (?:no|number)|mrn|ssn|nhs (?:no|number)|nino|steuer-?id|reisepass(?:nr)?|personalausweis(?:nr)?|dni|nif|cpf|pasaporte|passeport))"
    r"\.?:?#?[^\S\n]*(?:is[^\S\n]+)?(?P<number>(?=[\p{L}\d /.-]{0,14}\d)[A-Z]{0,3}\d[\dA-Z]*(?:[ \u00a0/.-]\d[\dA-Z]*)*[A-Z]?)(?![\p{L}\p{N}])"
)
# Words that name a kind of street.
_STREET = "Road|Rd|Street|St|Lane|Ln|Close|Drive|Dr|Avenue|Ave|Way|Terrace|Court|Place|Crescent|Square|Row|Gardens|Grove|Walk|Mews|Rise|Yard|Parade|Boulevard|Blvd"
_TOWN = r"\p{Lu}[\p{L}'’-]+(?:[^\S\n](?:am|an der|de|la|le|sur)?[^\S\n]?\p{Lu}[\p{L}'’-]+){0,3}"
_WORDS = r"[\p{L}'’.-]+(?:[^\S\n][\p{L}'’.-]+){0,5}?"
_ADDRESS = regex.compile(
    r"(?<![\p{L}\p{N}.,/-])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)[^\S\n]\d{1,4}[a-z]?,?[^\S\n])?(?:"
    rf"\d{{1,5}}[a-z]?(?:/\d{{1,3}})?[^\S\n](?:\p{{Lu}}[\p{{L}}'’]+[^\S\n]){{1,3}}(?i:{_STREET})\b\.?"
    r"|P\.?[^\S\n]?O\.?[^\S\n]?Box[^\S\n]\d+|Postfach[^\S\n]\d+|Apartado(?:[^\S\n]de[^\S\n]correos)?[^\S\n]\d+|(?:Boîte postale|B\.?P\.?)[^\S\n]\d{2,}|Caixa postal[^\S\n]\d+"
    rf"|(?:Calle|CALLE|C/|Avenida|AVENIDA|Plaza|Paseo|Camino|Rua|RUA|Praça|Travessa|Via|VIA|Piazza)[^\S\n]{_WORDS},?[^\S\n](?:n\.?º[^\S\n]?)?\d{{1,4}}[a-z]?\b"
    rf"|\d{{1,4}}(?:[^\S\n]?(?:bis|ter|[a-z]))?,?[^\S\n](?i:rue|avenue|boulevard|chemin|allée|impasse|quai|cours)[^\S\n]{_WORDS}(?=,|\.|;|$|\n|[^\S\n]\d{{5}}|[)|])"
    r"|(?:Am|Im|An der|An den|Auf dem|Auf der|Zum|Zur|Unter den|In der|Hinter der|Alte[rn]?)[^\S\n]\p{Lu}\p{L}+(?:[^\S\n]\p{Lu}\p{L}+)?[^\S\n]\d{1,4}[a-z]?\b(?=,)"
    r"|\p{Lu}\p{L}+(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer|steig|pfad)[^\S\n]\d{1,4}[a-z]?\b"
    rf")(?:,?[^\S\n]\d{{4,6}}[^\S\n]{_TOWN}|,[^\S\n]{_TOWN}(?:[^\S\n]\d{{4,6}}\b)?)?"
)

KINDS = ["email", "id_number", "address", "phone", "name"]


def _surname_ok(word: str) -> bool:
    bare = _plain(regex.sub(rf"^{_PARTICLE}", "", word))
    return len(bare) >= 3 and bare not in _STARTERS and bare not in _GENDER


def _given_names(text: str) -> list[re.Match[str]]:
    """The given names of the list that stand in a text as words of their own."""
    if _GIVEN_WORDS.isdisjoint(_RUN.findall(text)):
        return []
    before, after = _BESIDE
    return [m for m in _RUN.finditer(text) if m.group() in _GIVEN_WORDS and not (m.start() and before.match(text, m.start() - 1)) and not after.match(text, m.end())]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Emails, found from what stands between their two parts; the first begins where its characters do."""
    done = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (found := _EMAIL.match(text, start)) and found.end() > m.end():
            done = found.end()
            yield start, done


def _names(text: str) -> Iterator[tuple[int, int]]:
    for m in _given_names(text):
        after = _AFTER_GIVEN.match(text, m.end())
        if m.group()[0].isupper() and after and _surname_ok(after["surname"]):
            if not _TERM.match(text, after.end()):
                yield m.start(), after.end()
            continue
        before = _BEFORE_GIVEN.search(text, max(0, m.start() - 60), m.start())
        if before and m.group()[0].isupper() and _surname_ok(before["surname"]):
            yield before.start(), _INITIALS_AFTER.match(text, m.end()).end()
    for m in _INITIALS.finditer(text):
        if _surname_ok(m["surname"]) and not _TERM.match(text, m.end()):
            yield m.start(), m.end()
    for m in _TITLED.finditer(text):
        first = _plain(m["name"].split()[0])
        if first not in _STARTERS and _surname_ok(m["name"].split()[-1]) and not _TERM.match(text, m.end()):
            yield m.start("name"), m.end("name")


def find_pii(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the personal data in a text, in order and without overlap.

    Emails, plain or disguised, go first, then labelled identity numbers, addresses, phone numbers
    and names; what one kind has taken no later one takes.
    """
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    taken = bytearray(len(text))

    def take(kind: str, start: int, end: int) -> None:
        if start < end and not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            found.append((kind, start, end))

    for start, end in _emails(text):
        take("email", start, end)
    for m in _ID.finditer(text):
        if sum(c.isdigit() for c in m["number"]) >= 5:
            take("id_number", m.start("number"), m.end("number"))
    for m in _ADDRESS.finditer(text):
        take("address", m.start(), m.end())
    for m in _PHONE.finditer(text):
        first = regex.search(r"\d", m.group()).start()
        if 7 <= sum(c.isdigit() for c in m.group()) <= 20:
            value = m.group()[first:]
            cut = value.endswith(")") and value.count("(") < value.count(")") and not regex.match(r"\d+\)", value)
            take("phone", m.start() + first, m.end() - cut)
    for start, end in sorted(_names(text), key=lambda s: (s[0], -s[1])):
        take("name", start, end)
    return sorted(found, key=lambda x: x[1])


def find_all(df: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, kind, start_at, end_at, value) of all personal data, in code points, in rows as they are.

    Null, empty and blank texts have none; whole texts are read; repeated rows repeat theirs.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for k, s, e in find_pii(t):
                    at.append(i)
                    rows.append((k, s, e, t[s:e]))
            columns = list(zip(*rows)) or [(), (), (), ()]
            types = [pa.string(), pa.int32(), pa.int32(), pa.string()]
            made = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(made, names=[key, "kind", "start_at", "end_at", "value"])

    return at_least_parallel(df.select(key, F.col(text).alias("_text")).where("_text <> ''")).mapInArrow(run, f"`{key}` {kind}, kind string, start_at int, end_at int, value string")


# ---------------------------------------------------------------------------------------------
# Replacement


def _digest(secret: str, *parts: object) -> bytes:
    return hmac.new(secret.encode(), "\x1f".join(map(str, parts)).encode(), hashlib.sha256).digest()


def _letters(value: str, seed: bytes) -> str:
    """``value`` with every letter and digit exchanged for a keyed one of the same class."""
    stream = (b for i in range(len(value) // 32 + 1) for b in hashlib.sha256(seed + bytes([i % 256, i // 256 % 256])).digest())
    out = []
    for c in value:
        b = next(stream)
        if c.isdigit():
            out.append(str(b % 10))
        elif c.isalpha():
            new = "bcdfghklmnprstvz"[b % 16] if _plain(c)[:1] not in "aeiouy" else "aeiou"[b % 5]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


#: Syllables that made-up surnames consist of.
_SYLLABLES = "bar bel bor dan del dor fal fen gar gol han hel jor kal kel lan lin mar mel nor pal per ral ren sal sol tal tor val ven wal win zan".split()
#: Words of an address that say what kind it is, and stay.
_KEEP = frozenset(f"flat apt apartment unit suite room p o box postfach apartado de correos boîte postale bp caixa postal calle avenida plaza paseo camino rua praça travessa via piazza rue avenue boulevard chemin allée impasse quai cours la le les des du del der den am im an auf dem zum zur unter in hinter alter alten bis ter {_STREET.replace('|', ' ')}".lower().split())


def entity_keys(kind: str, value: str) -> list[str]:
    """The identities that an occurrence speaks of: for a name its surname and its given name or initials."""
    if kind != "name":
        return [_plain("".join(value.split()) if kind != "address" else " ".join(value.split()))]
    first, last = _split_name(value)
    return [_plain(last)]


def _split_name(value: str) -> tuple[list[str], str]:
    """(given names and initials, surname with particles)."""
    if "," in value:
        last, first = value.split(",", 1)
        return first.split(), last.strip()
    words = regex.findall(r"\p{Lu}\.|\S+", value)
    for i, w in enumerate(words):
        if i and len(w.strip(".")) > 1:
            return words[:i], " ".join(words[i:])
    return words[:1], " ".join(words[1:])


def _cased(model: str, text: str) -> str:
    return text.upper() if model.isupper() and len(model) > 1 else text.lower() if model.islower() else text.capitalize()


def surrogate_core(kind: str, identity: str, attempt: int, secret: str) -> str:
    """What stands for an identity: a made-up surname, or letters and digits in its own format."""
    seed = _digest(secret, kind, identity, attempt)
    if kind == "name":
        n = 2 + seed[0] % 2
        return "".join(_SYLLABLES[int.from_bytes(seed[2 * i + 1 : 2 * i + 3], "big") % len(_SYLLABLES)] for i in range(n)) + ("", "d", "k", "s")[seed[9] % 4]
    return _letters(identity, seed)


def _given(word: str, secret: str) -> str:
    """A given name of the same gender, or for an initial an initial; one word always gives the same."""
    plain = _plain(word.strip("."))
    if len(plain) < 2:
        return _letters(word, _digest(secret, "initial", plain))
    gender = _GENDER.get(plain)
    names = sorted((FEMALE if gender == "f" else MALE if gender == "m" else f"{FEMALE} {MALE}").split())
    want = _letters(plain[0], _digest(secret, "initial", plain[0]))
    alike = [n for n in names if _plain(n)[0] == want and _plain(n) != plain] or [n for n in names if _plain(n) != plain]
    pick = alike[int.from_bytes(_digest(secret, "given", plain)[:4], "big") % len(alike)]
    return pick.upper() if word.isupper() else pick


def surrogate(kind: str, value: str, core: str, secret: str) -> str:
    """The text that takes the place of ``value``, in its script, case and format."""
    if kind == "name":
        first, last = _split_name(value)
        new_first = " ".join(_given(w, secret) + ("," if w.endswith(",") else "") for w in first)
        parts = last.split("-")
        body = [p.split()[-1] if p.split() else p for p in parts]
        lead = last[: len(last) - len("-".join(parts).split()[-1])] if " " in last else ""
        size = max(1, len(core) // len(body))
        cores = [core] if len(body) == 1 else [core[i * size : (i + 1) * size if i + 1 < len(body) else None] for i in range(len(body))]
        new_last = lead + "-".join(b if _plain(b) in ("al", "el") else _cased(b, x or core) for b, x in zip(body, cores))
        return f"{new_last}, {new_first}" if "," in value else f"{new_first} {new_last}"
    it = iter(core)
    skip = 0
    if kind == "phone":  # country code and trunk prefix stay
        skip = 2 if value.startswith("00") else 1 if value[0] == "0" else 0
    if kind == "address":
        letters = {}
        out = []
        for word in regex.findall(r"[\p{L}\p{M}]+|\d+|[^\p{L}\p{M}\d]+", value):
            if word[0].isdigit() or (word[0].isalpha() and word.lower() not in _KEEP):
                letters.setdefault(word, _letters(word, _digest(secret, core, _plain(word))))
                out.append(letters[word])
            else:
                out.append(word)
        return "".join(out)
    out = []
    markers = [m.span() for m in regex.finditer(r"(?i)[\[({]?\b(?:at|dot)\b[\])}]?|\bext\b\.?", value)] if kind in ("email", "phone") else []
    tail = value.rfind(".") if kind == "email" and "." in value else len(value)
    for i, c in enumerate(value):
        if c.isspace():
            out.append(c)
            continue
        new = next(it, c)
        fixed = i < skip or i > tail or any(a <= i < b for a, b in markers) or not c.isalnum()
        out.append(c if fixed else new.upper() if c.isupper() else new)
    return "".join(out)


def redact(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``text`` with every finding replaced by its kind in brackets, such as [EMAIL].

    All else stays as it is; null gives null, an empty text itself.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                parts, at = [], 0
                for k, s, e in find_pii(t):
                    parts += [t[at:s], f"[{k.upper()}]"]
                    at = e
                out.append(t if not parts else "".join(parts) + t[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, text])

    return at_least_parallel(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, `{text}` string")


def pseudonymise(df: DataFrame, key: str, text: str, secret: str) -> DataFrame:
    """``key`` and ``text`` with every finding replaced by a surrogate of its kind and format.

    Surrogates are keyed by ``secret``: an identity has the same one wherever it occurs, so that
    texts still speak of the same person (a surname in full or after initials alike; given names
    keep their gender).  Of identities whose surrogates would be equal, or equal to an identity
    that occurs, all but one are keyed again until none collide.  ``key`` must be unique; null and
    empty texts come out as they are.
    """
    spark = df.sparkSession
    work = Workspace(spark, "pii")

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [entity_keys(k, v)[0] for k, v in zip(batch.column("kind").to_pylist(), batch.column("value").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.string())], names=[*batch.schema.names, "identity"])

    kind = df.schema[key].dataType.simpleString()
    base = f"`{key}` {kind}, kind string, start_at int, end_at int, value string"
    found = work.write(find_all(df, key, text).mapInArrow(identify, base + ", identity string"))

    def core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("kind", "identity", "attempt")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "identity", "attempt")), pa.array([surrogate_core(k, i, a, secret) for k, i, a in zip(*cols)], pa.string())], names=["kind", "identity", "attempt", "core"])

    schema = "kind string, identity string, attempt int, core string"
    entities = work.write(found.select("kind", "identity").distinct().withColumn("attempt", F.lit(0)).mapInArrow(core, schema))
    while True:
        taken = entities.select("kind", F.col("identity").alias("core"), F.lit(True).alias("real"))
        first = entities.groupBy("kind", "core").agg(F.min("identity").alias("keeps"))
        marked = entities.join(first, ["kind", "core"]).join(taken, ["kind", "core"], "left")
        again = (F.col("identity") != F.col("keeps")) | F.col("real").isNotNull()
        # An identity without letters and digits to exchange stays as it is.
        marked = work.write(marked.select("kind", "identity", "attempt", "core", (again & (F.col("attempt") < 64)).alias("again")))
        if not marked.where("again").limit(1).count():
            break
        redone = marked.where("again").select("kind", "identity", (F.col("attempt") + 1).cast("int").alias("attempt")).mapInArrow(core, schema)
        entities = work.write(marked.where("not again").select("kind", "identity", "attempt", "core").unionByName(redone))
    spans = lookup_join(found, entities.select("kind", "identity", "core"), ["kind", "identity"], found.count(), "inner")
    spans = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_at", "end_at", "kind", "core"))).alias("spans"))

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, spans_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts, at = [], 0
                for s in spans_ or []:
                    parts += [t[at : s["start_at"]], surrogate(s["kind"], t[s["start_at"] : s["end_at"]], s["core"], secret)]
                    at = s["end_at"]
                out.append(t if not parts else "".join(parts) + t[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, text])

    return df.select(key, text).join(spans, key, "left").mapInArrow(replace, f"`{key}` {kind}, `{text}` string")
