"""Near-duplicate records by a prefix join over word multisets, in packed lists."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.common import at_least_parallel
from paperloom.operators.components import connected_components
from paperloom.operators.skew import lookup_join
from paperloom.session import Workspace

#: A word is frequent if it occurs more often than max(FREQUENT_LEAST, FREQUENT_SHARE x records).
#: At most (mean words per record) / FREQUENT_SHARE words can be, so their list may be broadcast.
FREQUENT_LEAST = 2000
FREQUENT_SHARE = 1e-4
#: Occurrences of a word in one record whose frequencies are told apart; later ones count as the last.
DEPTH = 8
#: Classes of frequent words; two of CLASSES + 1 common words share a class, three of 2 CLASSES + 1.
CLASSES = 4
#: Records from which keys of two frequent words are extended by a third where the two are expected in more than PAIR_MOST records.
TRIPLES_FROM = 1_000_000
PAIR_MOST = 1000
#: Pairs compared at a time in a reducer, which bounds its memory whatever the size of a list.
PAIRS_AT_ONCE = 500_000
#: Records whose keys are packed together, and records of a task that compares.
PACKED = 16_384
RECORDS_A_TASK = 40_000

_NUMBERED = np.uint64(0x9E3779B97F4A7C15)


_WORD = re.compile(r"[^\W_]+")
#: Sizes from here on are not told apart in a row; such records skip the filters by size.
SIZE_CAP = (1 << 15) - 1
_PROBE = np.uint16(1 << 15)


def words_of(text: str | None) -> list[str]:
    """The words of a text: maximal runs of letters and digits in lower case."""
    return _WORD.findall(text.lower()) if text else []


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


def _mix(h: np.ndarray) -> np.ndarray:
    """A finaliser with good avalanche over uint64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


#: For bytes: letters and digits of ASCII in lower case, bytes of other letters as they are, 0 between texts, else a blank.
_LETTER = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 0 if b == 10 else 32 for b in range(256))
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, words of each text), the words being those of ``words_of``."""
    plain = [t.replace("\n", " ") if t else "" for t in texts]
    odd = [i for i, t in enumerate(plain) if not t.isascii()]
    if odd:
        lower = "\n".join([plain[i] for i in odd]).lower()
        if marks := "".join(c for c in set("".join(_BEYOND_ASCII.findall(lower))) if not c.isalnum()):
            lower = re.sub(f"[{re.escape(marks)}]", " ", lower)
        for i, t in zip(odd, lower.split("\n")):
            plain[i] = t
    data = np.frombuffer((" " + "\n".join(plain) + "\n        ").encode("utf-8", "surrogatepass").translate(_LETTER), dtype=np.uint8)
    edge = np.flatnonzero(np.diff((data > 32).view(np.int8)))
    start = edge[::2] + 1
    size = edge[1::2] + 1 - start
    eight = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    h = _mix((eight[start] & _LOW_BYTES[np.minimum(size, 8)]) + _NUMBERED * size.astype(np.uint64))
    at, rest = 8, np.flatnonzero(size > 8)
    while len(rest):
        h[rest] = _mix(h[rest] * np.uint64(3) + (eight[start[rest] + at] & _LOW_BYTES[np.minimum(size[rest] - at, 8)]))
        at += 8
        rest = rest[size[rest] > at]
    return h, np.diff(np.searchsorted(start, np.flatnonzero(data == 0)), prepend=0)


def classes_of(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of the word multiset of each record of ``n`` > 0 words: the sum of its words' hashes, whatever their order."""
    return np.add.reduceat(word, np.cumsum(n) - n).view(np.int64) if len(n) else np.empty(0, dtype=np.int64)


def _occurrences(word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, record, how many times before in the record) of the words of up to 2^14 records of ``n`` words."""
    doc = np.repeat(np.arange(len(n)), n)
    # The k-th occurrence of a word in a record is an element of its own.
    order = np.argsort(doc.astype(np.uint64) << np.uint64(50) | word >> np.uint64(14))
    word = word[order]
    new = np.r_[True, (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])]
    return word, doc, _ramp(np.diff(np.r_[np.flatnonzero(new), len(word)]))


def _element(word: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return _mix(word + _NUMBERED * nth.astype(np.uint64))


class _Mapper:
    """Turns records into rows (bucket, key, size and role, member, sketch) of a prefix join."""

    def __init__(self, frequent: tuple[np.ndarray, np.ndarray], threshold: float, pair_most: float | None) -> None:
        """pair_most: up to which product of their frequencies two frequent words are a key without a third; None for any."""
        element, freq = frequent
        order = np.lexsort((element, freq))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        by = np.argsort(element)
        # The last is for elements that are not frequent.
        self.element, self.freq, self.rank = element[by], np.r_[freq[by], 0], np.r_[rank[by], 0]
        self.pair_most, self.t = pair_most, threshold
        self.seen: set[int] = set()

    def _place(self, element: np.ndarray) -> np.ndarray:
        if not len(self.element):
            return np.zeros(len(element), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.element, element), len(self.element) - 1)
        return np.where(self.element[at] == element, at, len(self.element))

    def rows(self, texts: list[str | None]) -> list[np.ndarray]:
        """key (64 bits), size and role, member, sketch (64 and 32 bits)."""
        word, n = word_hashes(texts)
        n = n[n > 0]
        members = classes_of(word, n)
        # Copies within a partition give their rows once.
        fresh = np.zeros(len(n), dtype=bool)
        for i, m in enumerate(members.tolist()):
            if m not in self.seen:
                self.seen.add(m)
                fresh[i] = True
        if len(self.seen) > 1_000_000:
            self.seen.clear()
        word, n, members = word[np.repeat(fresh, n)], n[fresh], members[fresh]
        if not len(n):
            return [np.empty(0, dtype=k) for k in (np.uint64, np.uint16, np.int64, np.uint64, np.uint32)]
        word, doc, nth = _occurrences(word, n)
        element = _element(word, nth)
        place = self._place(_element(word, np.minimum(nth, DEPTH - 1)))
        freq = self.freq[place]
        # Global order of elements: rare ones by hash, then frequent ones by ascending frequency.
        within = np.where(freq == 0, element >> np.uint64(15), np.uint64(1 << 49) | self.rank[place].astype(np.uint64) << np.uint64(25) | np.minimum(nth, (1 << 25) - 1).astype(np.uint64))
        order = np.argsort(doc.astype(np.uint64) << np.uint64(50) | within)
        element, freq = element[order], freq[order]
        start = np.cumsum(n) - n
        pos = _ramp(n)
        t = self.t
        probe_miss = n - _ceil(t * n)  # elements that a record may have beyond a smaller partner
        index_miss = n - _ceil(2 * t / (1 + t) * n)  # and beyond one that is no smaller
        # The parity of the elements in each of 96 buckets.
        slot = (element >> np.uint64(32)) * np.uint64(96) >> np.uint64(32)
        sketch = np.bitwise_xor.reduceat(np.where(slot < 64, np.left_shift(np.uint64(1), slot & np.uint64(63)), np.uint64(0)), start)
        more = np.bitwise_xor.reduceat(np.where(slot < 64, np.uint64(0), np.left_shift(np.uint64(1), slot & np.uint64(31))), start).astype(np.uint32)
        # Rare elements of the prefix are keys on their own; so are frequent ones of short records.
        # What a record's partners have in common with it decides on the kinds of keys: the smaller
        # of a pair must have as many words as the kind needs.
        rare = freq == 0
        in_prefix = pos <= probe_miss[doc]
        most, least = _ceil(t * n), _ceil(t * _ceil(t * n))
        single = in_prefix & (rare | (least < CLASSES + 1)[doc])
        keys = [(element[single], doc[single], pos[single] <= index_miss[doc[single]])]
        three = 1 << 40 if self.pair_most is None else 2 * CLASSES + 1
        n_rare = np.add.reduceat(rare.astype(np.int64), start)
        for need, able in ((CLASSES + 1, (most >= CLASSES + 1) & (least < three)), (three, most >= three)):
            keys += self._class_keys(element, freq, doc, pos, n_rare, probe_miss, index_miss, need, able)
        key, at, index = (np.concatenate(c) for c in zip(*keys))
        size = np.minimum(n, SIZE_CAP).astype(np.uint16)
        return [key, size[at] | np.where(index, np.uint16(0), _PROBE), members[at], sketch[at], more[at]]

    def _class_keys(self, element, freq, doc, pos, n_rare, probe_miss, index_miss, need, able) -> list[tuple]:
        """Keys for pairs that share no rare element, so that all their rare elements are unmatched.

        The first ``need`` common elements lie in the first (misses left + need) frequent elements of
        either record.  Of CLASSES + 1, two share one of the classes by hash, and each two elements of
        a class make a key.  Of 2 CLASSES + 1, three share one: two of them are a key if few records
        are expected to have both, else three.
        """
        left = probe_miss - n_rare
        nth = pos - n_rare[doc]
        part = np.flatnonzero((nth >= 0) & (able & (left >= 0))[doc] & (nth < left[doc] + need))
        if not len(part):
            return []
        cls = (element[part] >> np.uint64(5)) % np.uint64(CLASSES)
        # Elements are in order within their record.
        order = np.argsort(doc[part] * CLASSES + cls.astype(np.int64), kind="stable")
        part, cls = part[order], cls[order]
        d, e, k, f = doc[part], element[part], nth[part], freq[part]
        lane = d * CLASSES + cls.astype(np.int64)
        end = np.searchsorted(lane, lane, side="right")
        index_left = index_miss - n_rare
        out = []

        def put(key: np.ndarray, last: np.ndarray) -> None:
            room = index_left[d[last]]
            out.append((key, d[last], (room >= 0) & (k[last] < room + need)))

        def followers(last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(i, element after last[i] in its class) for all such elements."""
            after = end[last] - last - 1
            i = np.repeat(np.arange(len(last)), after)
            return i, last[i] + 1 + _ramp(after)

        a, b = followers(np.arange(len(part)))
        key = _mix(e[a] * np.uint64(3) + e[b] + np.uint64(need))
        if need == CLASSES + 1:
            put(key, b)
            return out
        few = f[a] * f[b].astype(np.float64) <= self.pair_most
        put(key[few], b[few])
        key, b = key[~few], b[~few]
        i, c = followers(b)
        put(_mix(key[i] * np.uint64(3) + e[c]), c)
        return out


#: Side of the squares in which the rows of a key are compared; lists up to that long are compared many at a time.
SQUARE = 400


def _may_differ(t: float) -> np.ndarray:
    """What two records may differ by, from their sizes together; all 96 bits where a size is capped."""
    total = np.arange(2 * 4096)
    may = np.minimum(total - 2 * _ceil(t / (1 + t) * total), 96)
    may[4095:] = 96
    return may.astype(np.uint8)


def _compare(key: np.ndarray, role: np.ndarray, member: np.ndarray, sketch: np.ndarray, more: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate member pairs of rows, all rows of a key present."""
    # Those that may be the smaller of a pair come first within a key.
    order = np.argsort(key.astype(np.uint64) << np.uint64(32) | (role & _PROBE).astype(np.uint64) << np.uint64(16) | member.view(np.uint64) & np.uint64((1 << 31) - 1))
    key, role, member = key[order], role[order], member[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (member[1:] != member[:-1])]
    key, role, member, order = key[fresh], role[fresh], member[fresh], order[fresh]
    sketch, more = sketch[order], more[order]
    index, size = role < _PROBE, (role & ~_PROBE).astype(np.int64)
    short = np.minimum(size, 4095)
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    end = np.r_[begin[1:], len(key)]
    mid = begin + np.add.reduceat(index.astype(np.int64), begin)
    may = _may_differ(t)

    # Half units of what either may differ by, which together are no less than the table has; 64 bits differ at most.
    half = np.where(size >= 4095, 127, np.clip(np.ceil(2 * (1 - t) / (1 + t) * size + 1e-6), 1, 127)).astype(np.uint8)

    def near(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Places in the squares of rows p by rows q (last axis) where the first 64 bits leave a pair near."""
        apart = np.bitwise_count(sketch[p][..., :, None] ^ sketch[q][..., None, :])
        apart <<= 1
        return np.flatnonzero(apart <= half[p][..., :, None] + half[q][..., None, :])

    def sift(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = np.bitwise_count(sketch[a] ^ sketch[b]) + np.bitwise_count(more[a] ^ more[b]) <= may[short[a] + short[b]]
        a, b = a[ok], b[ok]
        small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        able = np.where(size[a] < size[b], index[a], np.where(size[a] > size[b], index[b], index[a] | index[b]))
        ok = ((small >= t * large - 1e-9) & able) | (large == SIZE_CAP)
        return member[a[ok]], member[b[ok]]

    def squares() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Near pairs of an earlier row that may be the smaller and a later row of its key."""
        rows, able = end - begin, mid - begin
        lists = np.flatnonzero((rows > 1) & (able > 0) & (rows <= SQUARE))
        # Lists of about equal length and number of rows that may be the smaller make one block.
        alike = np.log(rows[lists]) // np.log(1.12) * 1000 + np.log(able[lists]) // np.log(1.25)
        order = np.argsort(alike, kind="stable")
        lists, alike = lists[order], alike[order]
        cuts = np.flatnonzero(np.r_[True, alike[1:] != alike[:-1], True]) if len(lists) else np.zeros(1, dtype=np.int64)
        for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            wide, high = int(rows[lists[first:last]].max()), int(able[lists[first:last]].max())
            for k in range(first, last, max(1, SQUARE * SQUARE // (wide * high))):
                at = lists[k : min(last, k + max(1, SQUARE * SQUARE // (wide * high)))]
                lo, to, hi = begin[at], mid[at], end[at]
                flat = near(np.minimum(lo[:, None] + np.arange(high), to[:, None] - 1), np.minimum(lo[:, None] + np.arange(wide), hi[:, None] - 1))
                of, flat = flat // (wide * high), flat % (wide * high)
                i, j = flat // wide, flat % wide
                ok = (i < j) & (i < (to - lo)[of]) & (j < (hi - lo)[of])
                yield (lo[of] + i)[ok], (lo[of] + j)[ok]
        long = np.flatnonzero((rows > SQUARE) & (able > 0))
        for lo, to, hi in zip(begin[long].tolist(), mid[long].tolist(), end[long].tolist()):
            for i in range(lo, to, SQUARE):
                for j in range(i, hi, SQUARE):
                    width = min(j + SQUARE, hi) - j
                    flat = near(np.arange(i, min(i + SQUARE, to)), np.arange(j, j + width))
                    a, b = i + flat // width, j + flat % width
                    yield (a[a < b], b[a < b]) if i == j else (a, b)

    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for a, b in squares():
        found.append((a, b))
        held += len(a)
        if held > PAIRS_AT_ONCE:
            yield sift(*(np.concatenate(c) for c in zip(*found)))
            found, held = [], 0
    if found:
        yield sift(*(np.concatenate(c) for c in zip(*found)))


_LISTS = "bucket int, key binary, role binary, member binary, sketch binary, more binary"
_KINDS = (np.uint32, np.uint16, np.int64, np.uint64, np.uint32)
_PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _packed(rows: list[np.ndarray], n_buckets: int) -> pa.RecordBatch:
    """One row per bucket with the rows of its keys."""
    bucket = (rows[0] >> np.uint64(32)) % np.uint64(n_buckets)
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=np.uint64))
    lists = [pa.array(np.arange(n_buckets, dtype=np.int32))]
    for column, kind in zip(rows, _KINDS):
        data = column.astype(kind)[order]
        lists.append(pa.BinaryArray.from_buffers(pa.binary(), n_buckets, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32)), pa.py_buffer(data)]))
    return pa.RecordBatch.from_arrays(lists, names=["bucket", "key", "role", "member", "sketch", "more"]).filter(pa.array(np.diff(bounds) > 0))


def _frequent_elements(texts: DataFrame, n_records: int) -> tuple[np.ndarray, np.ndarray]:
    """(element, in how many records it is met) of the elements above the frequency bound.

    All records are counted, and the first DEPTH occurrences of a word in each.
    """
    limit = max(FREQUENT_LEAST, int(FREQUENT_SHARE * n_records))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def flush() -> pa.RecordBatch:
            element = np.concatenate([h[0] for h in held])
            order = np.argsort(element)
            element, n = element[order], np.concatenate([h[1] for h in held])[order]
            first = np.flatnonzero(np.r_[True, element[1:] != element[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(element[first].view(np.int64)), pa.array(np.add.reduceat(n, first))], names=["e", "n"])

        for batch in batches:
            word, n = word_hashes(batch.column(0).to_pylist())
            if not len(word):
                continue
            word, _, nth = _occurrences(word, n)
            held.append(np.unique(_element(word[nth < DEPTH], nth[nth < DEPTH]), return_counts=True))
            n_held += len(held[-1][0])
            if n_held > 1_000_000:
                yield flush()
                held, n_held = [], 0
        if held:
            yield flush()

    counts = texts.mapInArrow(count, "e long, n long").groupBy("e").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") > limit).collect()
    return np.array([r.e for r in found], dtype=np.int64).view(np.uint64), np.array([r.n for r in found], dtype=np.int64)


def _verify(threshold: float):
    """Similarity of the word multisets of two texts; only pairs that reach the threshold stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            if not len(a):
                continue
            # Each text of the batch once.
            _, first, of = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
            both = pa.concat_arrays([batch.column("ta"), batch.column("tb")]).take(pa.array(first)).to_pylist()
            parts = [word_hashes(both[i : i + PACKED]) for i in range(0, len(both), PACKED)]
            n = np.concatenate([p[1] for p in parts])
            element = np.concatenate([_element(w, nth) for w, nth in ((o[0], o[2]) for o in (_occurrences(*p) for p in parts))])
            start = np.cumsum(n) - n
            x, y = of[: len(a)], of[len(a) :]
            common = np.empty(len(a), dtype=np.int64)
            _, number = np.unique(element, return_inverse=True)
            lo = 0
            ends = np.cumsum(n[x] + n[y])
            while lo < len(a):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 4 * PAIRS_AT_ONCE, side="right")))
                # An element met twice in a pair is in both.
                rows = np.ravel(np.stack([x[lo:hi], y[lo:hi]], axis=1))
                pair = np.repeat(np.repeat(np.arange(hi - lo), 2), n[rows])
                met = np.sort(pair << 32 | number[np.repeat(start[rows], n[rows]) + _ramp(n[rows])])
                common[lo:hi] = np.bincount(met[1:][met[1:] == met[:-1]] >> 32, minlength=hi - lo)
                lo = hi
            value = common / (n[x] + n[y] - common)
            ok = value >= threshold
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(value[ok])], names=["a", "b", "similarity"])

    return run


def _batches_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, PACKED):
        yield batch.slice(i, PACKED)


def similar_classes(df: DataFrame, key: str, text: str, threshold: float, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(members, links): classes of records with equal word multisets, and all pairs of classes
    whose similarity is at least ``threshold``.

    members: ``key``, ``member`` (class).  links: ``a`` < ``b`` (classes), ``similarity``.
    Similarity is that of word multisets: words in common, counted with repetition, by the words of
    both less those in common.  Texts without words (null, empty, blank) belong to no class.
    Exact for any input but for equal 64-bit hashes: no list of candidates is cut, and every pair is verified on whole texts.
    """
    source = at_least_parallel(df.select(F.col(key), F.col(text).cast("string").alias("_text")).where("_text <> ''"))
    texts = source.select("_text")
    spark = df.sparkSession
    n_records = df.count()
    shared = spark.sparkContext.broadcast(_frequent_elements(texts, n_records))
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")) if n_records > RECORDS_A_TASK else 1, spark.sparkContext.defaultParallelism, n_records // RECORDS_A_TASK)
    n_buckets = 4 * n_tasks
    pair_most = float(PAIR_MOST) * n_records if n_records >= TRIPLES_FROM else None

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = word_hashes(batch.column(1).to_pylist())
            rows = batch.column(0).take(pa.array(np.flatnonzero(n)))
            yield pa.RecordBatch.from_arrays([rows, pa.array(classes_of(word, n[n > 0]))], names=[key, "member"])

    def text_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, n = word_hashes(batch.column(0).to_pylist())
            member, first = np.unique(classes_of(word, n[n > 0]), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(member), batch.column(0).take(pa.array(np.flatnonzero(n)[first]))], names=["member", "text"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapper = _Mapper(shared.value, threshold, pair_most)
        held: list[list[np.ndarray]] = []
        for batch in (part for whole in batches for part in _batches_of(whole)):
            held.append(mapper.rows(batch.column(0).to_pylist()))
            if sum(len(h[0]) for h in held) > 20 * PACKED:
                yield _packed([np.concatenate(c) for c in zip(*held)], n_buckets)
                held = []
        if held:
            yield _packed([np.concatenate(c) for c in zip(*held)], n_buckets)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = []
        bucket = -1

        def emit() -> Iterator[pa.RecordBatch]:
            block = [np.frombuffer(b"".join(c), dtype=k) for c, k in zip(zip(*held), _KINDS)]
            for x, y in _compare(*block, threshold):
                x, y = np.minimum(x, y), np.maximum(x, y)
                order = np.lexsort((y, x))
                x, y = x[order], y[order]
                fresh = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])][: len(x)] & (x != y)
                if fresh.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[fresh]), pa.array(y[fresh])], names=["a", "b"])

        for batch in batches:
            of = batch.column(0).to_numpy()
            for i in range(len(of)):
                if of[i] != bucket:
                    if held:
                        yield from emit()
                    held, bucket = [], of[i]
                held.append([batch.column(c)[i].as_py() for c in range(1, 6)])
        if held:
            yield from emit()

    lists = texts.mapInArrow(rows, _LISTS).repartition(n_tasks, "bucket").sortWithinPartitions("bucket")
    candidates = lists.mapInArrow(pairs, _PAIRS).distinct()
    whole = texts.mapInArrow(text_of, "member long, text string").groupBy("member").agg(F.first("text").alias("text"))
    one = candidates.join(whole.select(F.col("member").alias("a"), F.col("text").alias("ta")), "a")
    both = one.join(whole.select(F.col("member").alias("b"), F.col("text").alias("tb")), "b")
    links = both.mapInArrow(_verify(threshold), "a long, b long, similarity double")
    members = source.mapInArrow(name, T.StructType([df.schema[key], T.StructField("member", T.LongType())])).distinct()
    return members, work.write(links)


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """All pairs of keys with similarity at least ``threshold``: ``id_a`` < ``id_b``, ``similarity``.

    Copies are expanded into pairs here, since the result lists pairs of keys; where that isn't
    wanted, ``groups`` gives one row per record.  A key met with two texts pairs by either.  Null
    keys, and texts without words, pair with nothing.
    """
    members, links = similar_classes(df.where(F.col(key).isNotNull()), key, text, threshold, Workspace(df.sparkSession, "near-duplicates"))
    one = members.select(F.col("member").alias("a"), F.col(key).alias("id_a"))
    two = members.select(F.col("member").alias("b"), F.col(key).alias("id_b"))
    between = links.join(one, "a").join(two, "b").where(F.col("id_a") != F.col("id_b"))
    pairs = between.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "similarity")
    within = one.join(two, F.col("a") == F.col("b")).where("id_a < id_b").select("id_a", "id_b", F.lit(1.0).alias("similarity"))
    return pairs.union(within).groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def groups(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """One row per key: ``key``, ``group_id``, ``n_links``.

    Groups are the connected components of the links; ``group_id`` is the least key of the group,
    ``n_links`` the number of other classes of equal texts that the record's class is linked to.
    Records without words are groups of their own.  Copies are never expanded into pairs.
    """
    work = Workspace(df.sparkSession, "near-duplicates")
    members, links = similar_classes(df.where(F.col(key).isNotNull()), key, text, threshold, work)
    members = work.write(members)
    # A key met with two texts joins their classes.
    first = members.groupBy(key).agg(F.min("member").alias("a"), F.max("member").alias("b"))
    component = connected_components(links.select("a", "b").union(first.select("a", "b")), "a", "b", work)
    ends = links.select(F.col("a").alias("member")).union(links.select(F.col("b").alias("member")))
    degree = ends.groupBy("member").agg(F.count(F.lit(1)).alias("n_links"))
    classes = members.select("member").distinct().join(component.withColumnRenamed("node", "member"), "member", "left").join(degree, "member", "left")
    classes = classes.select("member", F.coalesce("component", "member").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    placed = lookup_join(members, classes, ["member"], members.count(), "inner").groupBy(key).agg(F.min("component").alias("component"), F.max("n_links").alias("n_links"))
    least = placed.groupBy("component").agg(F.min(key).alias("group_id"))
    named = placed.join(least, "component").select(key, "group_id", "n_links")
    rest = df.where(F.col(key).isNotNull()).select(key).distinct().join(named, key, "left")
    return rest.select(key, F.coalesce("group_id", key).alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
