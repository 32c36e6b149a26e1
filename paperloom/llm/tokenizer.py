"""Byte-level BPE encoding by batched numpy merge rounds."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the public tokenizer's file lies; a parameter of every function that reads it.
DEFAULT_FILE = "/opt/tokenizers/byte_bpe_50k.json"

#: Fixed value: the split pattern of the public byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A worker forgets its encoded words when it holds this many; results do not depend on it.
CACHE_WORDS = 400_000

_NO_RANK = np.iinfo(np.int32).max


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def load_merges(path: str = DEFAULT_FILE) -> dict[str, np.ndarray]:
    """Arrays of the tokenizer: ids of single bytes; pair keys in ascending order with rank and merged id.

    Their size is that of the vocabulary file, whatever the corpus, so they may be broadcast.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
    right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
    key = (left << 32) | right
    order = np.argsort(key, kind="stable")
    return {
        "bytes": np.array([vocab[c] for c in _byte_characters()], dtype=np.int32),
        "key": key[order],
        "rank": np.arange(len(pairs), dtype=np.int32)[order],
        "merged": np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)[order],
    }


def encode_words(words: list[str], merges: dict[str, np.ndarray]) -> list[list[int]]:
    """Token ids of each non-empty word.

    The symbols of all words lie in one flat array.  Each round looks every neighbouring pair up
    by binary search over the sorted pair keys, finds each word's lowest rank by a segmented
    minimum, and merges all places of that pair in all words at once.  Words without a known pair
    leave the array.
    """
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    sym = merges["bytes"][np.frombuffer(b"".join(raw), dtype=np.uint8)]
    word = np.repeat(np.arange(len(raw)), size)
    out: list[list[int]] = [[] for _ in raw]
    key, rank_of, merged = merges["key"], merges["rank"], merges["merged"]
    while len(sym):
        pair = (sym[:-1].astype(np.int64) << 32) | sym[1:]
        at = np.searchsorted(key, pair)
        at[at == len(key)] = 0
        rank = np.full(len(sym), _NO_RANK, dtype=np.int32)
        known = (key[at] == pair) & (word[:-1] == word[1:])
        rank[:-1][known] = rank_of[at[known]]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        length = np.diff(np.r_[first, len(sym)])
        lowest = np.minimum.reduceat(rank, first)
        done = lowest == _NO_RANK
        if done.any():
            ends = first + length
            for w, a, b in zip(word[first[done]].tolist(), first[done].tolist(), ends[done].tolist()):
                out[w] = sym[a:b].tolist()
        floor = np.repeat(lowest, length)
        chosen = np.flatnonzero((rank == floor) & (floor != _NO_RANK))
        if not len(chosen):
            break
        # Of places that overlap (a a a) every second one counts from the run's start.
        run = np.cumsum(np.r_[True, np.diff(chosen) != 1])
        start = chosen[np.r_[True, np.diff(run) != 0]]
        chosen = chosen[(chosen - start[run - 1]) % 2 == 0]
        sym = sym.copy()
        sym[chosen] = merged[at[chosen]]
        keep = np.repeat(~done, length)
        keep[chosen + 1] = False
        sym, word = sym[keep], word[keep]
    return out


#: Words of more bytes than this are encoded one by one: merge rounds over a word cost its length
#: each, and a word may need as many rounds as it has distinct pairs.
LONG_WORD = 400


def encode_long_word(word: str, merges: dict[str, np.ndarray]) -> list[int]:
    """Token ids of one word of any length, by a queue of pairs over a linked list: O(n log n)."""
    sym = merges["bytes"][np.frombuffer(word.encode("utf-8", "surrogatepass"), dtype=np.uint8)].tolist()
    n = len(sym)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    table: dict[tuple[int, int], tuple[int, int] | None] = {}
    key = merges["key"]

    def look(a: int, b: int) -> tuple[int, int] | None:
        if (a, b) not in table:
            at = int(np.searchsorted(key, want := (a << 32) | b))
            hit = at < len(key) and key[at] == want
            table[a, b] = (int(merges["rank"][at]), int(merges["merged"][at])) if hit else None
        return table[a, b]

    queue = [(p[0], i, sym[i], sym[i + 1], p[1]) for i in range(n - 1) if (p := look(sym[i], sym[i + 1]))]
    heapq.heapify(queue)
    while queue:
        _, i, a, b, made = heapq.heappop(queue)
        j = after[i]
        if j < 0 or sym[i] != a or sym[j] != b:
            continue  # a neighbour was merged since
        sym[i], sym[j] = made, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if p := look(made, sym[k]):
                heapq.heappush(queue, (p[0], i, made, sym[k], p[1]))
        h = before[i]
        if h >= 0 and (p := look(sym[h], made)):
            heapq.heappush(queue, (p[0], h, sym[h], made, p[1]))
    return [s for s in sym if s >= 0]


class Encoder:
    """Encodes texts, keeping the ids of words already met."""

    def __init__(self, merges: dict[str, np.ndarray]) -> None:
        self.merges = merges
        self.split = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def _learn(self, texts: list[list[str]]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = list({w for words in texts for w in words if w not in self.known})
        short = [w for w in new if len(w.encode("utf-8", "surrogatepass")) <= LONG_WORD]
        self.known.update(zip(short, encode_words(short, self.merges)))
        if len(short) < len(new):
            self.known.update((w, encode_long_word(w, self.merges)) for w in new if w not in self.known)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts give an empty list."""
        words = [self.split.findall(t) if t else [] for t in texts]
        self._learn(words)
        known = self.known
        return [[i for w in ws for i in known[w]] for ws in words]

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of ids of each text."""
        words = [self.split.findall(t) if t else [] for t in texts]
        self._learn(words)
        known = self.known
        return [sum(len(known[w]) for w in ws) for ws in words]


#: Characters encoded at a time, which bounds a worker's memory whatever the length of the texts.
SLICE_CHARS = 2_000_000


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= SLICE_CHARS:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_corpus(df: DataFrame, text: str = "text", out: str = "ids", path: str = DEFAULT_FILE, counts_only: bool = False) -> DataFrame:
    """``df`` without ``text`` but with ``out``: the token ids (or with ``counts_only`` their number).

    Null and empty texts give an empty list (0).  Strings that look like special tokens are
    ordinary text.  Whole texts are encoded; rows stay as they are, repeats included; other
    columns are passed through, and one named like ``out`` is replaced.  No shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_merges(path))
    rest = [c for c in df.columns if c not in (text, out)]
    source = df.select(*rest, text)
    kind = T.LongType() if counts_only else T.ArrayType(T.IntegerType())
    schema = T.StructType([source.schema[c] for c in rest] + [T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in _slices(texts):
                if counts_only:
                    made = pa.array(encoder.count(texts[a:b]), pa.int64())
                else:
                    ids = encoder.encode(texts[a:b])
                    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                    np.cumsum([len(x) for x in ids], out=offsets[1:])
                    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array([i for x in ids for i in x], pa.int32()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*rest, out])

    return source.mapInArrow(run, schema)
