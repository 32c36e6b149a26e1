"""Records of one work across sources without a common key: sorted neighbourhood and assignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.bibliography import Record, confidence
from paperloom.llm.common import at_least_parallel
from paperloom.operators.components import connected_components
from paperloom.session import Workspace

#: Rows after a record in each order that it is compared with.
WINDOW = 6
#: Pairs of at least this confidence are taken for the same work.
LEAST_CONFIDENCE = 0.5
#: Components of at most this many edges are solved within one task, whose time this bounds; the
#: edges of larger ones are spread over blocks of about as many, of which TOGETHER share a task.
TASK_EDGES, TOGETHER = 20_000, 16
#: By how much a bid of the auction exceeds what the next best is worth.  The total confidence reached is
#: below the optimum by at most this for each record that gets a partner, and no record is bid for
#: more than 1 / INCREMENT times.
INCREMENT = 0.005

_FEATURES = T.StructType(
    [T.StructField("src", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("packed", T.StringType()), T.StructField("keys", T.ArrayType(T.StringType()))]
    + [T.StructField(c, T.LongType()) for c in ("s1", "s2", "marks")]
)


def _h(text: str, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> (64 - bits)


_BITS: dict[str, int] = {}


def _sketch(record: Record) -> tuple[int, int, int]:
    """128 bits of the title's n-grams, and 16 bits each of first name, last name and identifier."""
    bits = 0
    for g in record.grams:
        if (bit := _BITS.get(g)) is None:
            if len(_BITS) > 200_000:
                _BITS.clear()
            bit = _BITS[g] = 1 << _h(g, 7)
        bits |= bit
    marks = [_h(x, 15) + 1 if x else 0 for x in (record.surnames[0] if record.surnames else "", record.surnames[-1] if record.surnames else "", record.doi or "")]
    signed = [x - (1 << 64) if x >> 63 else x for x in (bits & (2**64 - 1), bits >> 64)]
    return signed[0], signed[1], marks[0] | marks[1] << 16 | marks[2] << 32 | int(record.cut) << 48


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for src, key, title, doi, authors, date in zip(*(c.to_pylist() for c in batch.columns)):
            r = Record(title, doi, authors, date)
            rows.append((src, key, r.pack(), r.sort_keys(), *_sketch(r)))
        columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), _ARROW)] if rows else [pa.array([], f.type) for f in _ARROW]
        yield pa.RecordBatch.from_arrays(columns, names=_ARROW.names)


_ARROW = pa.schema([("src", pa.int32()), ("id", pa.int64()), ("packed", pa.string()), ("keys", pa.list_(pa.string())), ("s1", pa.int64()), ("s2", pa.int64()), ("marks", pa.int64())])

_SEEN = ["kind", "src", "id", "s1", "s2", "marks"]
_WINDOWED = "a_src int, a long, b_src int, b long, pid int, pos int, kind int, src int, id long, s1 long, s2 long, marks long"


def _worth(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> np.ndarray:
    """Whether the sketches of two rows leave it open that they are the same work."""

    def count(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        bits = np.bitwise_count(p.view(np.uint64)).astype(float) + np.bitwise_count(q.view(np.uint64))
        return -128 * np.log(1 - np.minimum(bits, 127) / 128)

    na, nb = count(x["s1"], x["s2"]), count(y["s1"], y["s2"])
    common = na + nb - count(x["s1"] | y["s1"], x["s2"] | y["s2"])
    cut = ((x["marks"] | y["marks"]) >> 48) & 1
    alike = np.where(cut == 1, common / np.maximum(1, np.minimum(na, nb)), 2 * common / np.maximum(1, na + nb))
    part = lambda z, i: (z["marks"] >> (16 * i)) & 0xFFFF
    unnamed = (part(x, 0) == 0) | (part(y, 0) == 0)
    same = unnamed | (part(x, 0) == part(y, 0)) | (part(x, 1) == part(y, 1)) | ((part(x, 2) == part(y, 2)) & (part(x, 2) != 0))
    return (alike >= 0.72) | (same & (alike >= np.where(unnamed, 0.6, 0.45)))


def _slide(rows: dict[str, np.ndarray], window: int, across: bool) -> dict[str, np.ndarray]:
    """Pairs of rows at most ``window`` apart in one order that are worth a comparison.

    Rows of source 0 are not compared with each other.  ``across``: only pairs of two partitions.
    """
    found = []
    n = len(rows["id"])
    for d in range(1, min(window, n - 1) + 1):
        x, y = {k: v[:-d] for k, v in rows.items()}, {k: v[d:] for k, v in rows.items()}
        ok = (x["kind"] == y["kind"]) & ((x["src"] | y["src"]) != 0)
        if across:
            ok &= x["pid"] != y["pid"]
        at = np.flatnonzero(ok)
        at = at[_worth({k: v[at] for k, v in x.items()}, {k: v[at] for k, v in y.items()})]
        swap = (x["src"][at] > y["src"][at]) | ((x["src"][at] == y["src"][at]) & (x["id"][at] > y["id"][at]))
        a = {k: np.where(swap, y[k][at], x[k][at]) for k in ("src", "id")}
        b = {k: np.where(swap, x[k][at], y[k][at]) for k in ("src", "id")}
        found.append(np.stack([a["src"], a["id"], b["src"], b["id"]]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((4, 0), dtype=np.int64)
    return dict(zip(("a_src", "a", "b_src", "b"), pairs))


def _batch(columns: dict[str, np.ndarray], n: int) -> pa.RecordBatch:
    names = [x.split()[0] for x in _WINDOWED.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.int32() for x in _WINDOWED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c].astype(k.to_pandas_dtype())) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds)], names=names)


def window_pairs(features: DataFrame, window: int, work: Workspace) -> DataFrame:
    """(a_src, a, b_src, b) of records close to each other in some order, once each.

    All orders are sorted together, by range; a partition compares its rows in a sliding window
    and hands on its first and last rows, with which the windows over the borders of partitions
    are completed: 2 x ``window`` rows per partition, whatever the number of records.  Rows that are
    equal in all fields of a key come in an order that mixes the sources.
    """
    rows = features.select(F.posexplode("keys").alias("kind", "key"), "src", "id", "s1", "s2", "marks").where("key is not null").withColumn("mixed", F.xxhash64("id", "src"))
    spark = features.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = ["kind", "key", "mixed", "src", "id"]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*_SEEN)

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        held: dict[str, np.ndarray] | None = None
        head: dict[str, np.ndarray] | None = None
        total = 0

        def edges(part: dict[str, np.ndarray], first: int) -> pa.RecordBatch:
            k = len(part["id"])
            return _batch(part | {"pid": np.full(k, pid), "pos": np.arange(first, first + k)}, k)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = {c: batch.column(c).to_numpy() for c in _SEEN}
            if head is None or len(head["id"]) < window:
                more = {c: v[: window - (len(head["id"]) if head else 0)] for c, v in now.items()}
                head = more if head is None else {c: np.concatenate([head[c], more[c]]) for c in _SEEN}
            total += batch.num_rows
            joined = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in _SEEN}
            pairs = _slide(joined, window, False)
            if len(pairs["a"]):
                yield _batch(pairs, len(pairs["a"]))
            held = {c: v[-window:] for c, v in joined.items()}
        if head is not None and held is not None:
            yield edges(head, 0)
            fresh = min(window, total - len(head["id"]))
            if fresh > 0:
                yield edges({c: v[-fresh:] for c, v in held.items()}, 1 << 30)

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [{c: b.column(c).to_numpy() for c in [*_SEEN, "pid"]} for b in batches if b.num_rows]
        if parts:
            pairs = _slide({c: np.concatenate([p[c] for p in parts]) for c in parts[0]}, window, True)
            yield _batch(pairs, len(pairs["a"]))

    done = work.write(dealt.mapInArrow(slide, _WINDOWED))
    rest = done.where("pid is not null").repartition(1).sortWithinPartitions("pid", "pos").mapInArrow(borders, _WINDOWED)
    pair = ["a_src", "a", "b_src", "b"]
    return done.where("a is not null").select(*pair).union(rest.select(*pair)).distinct()


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made: dict[str, Record] = {}

    def pick(text: str) -> Record:
        if text not in made:
            if len(made) > 50_000:
                made.clear()
            made[text] = Record.unpack(text)
        return made[text]

    for batch in batches:
        pairs = zip(batch.column("x_packed").to_pylist(), batch.column("y_packed").to_pylist())
        score = np.array([confidence(pick(x), pick(y)) for x, y in pairs])
        good = np.flatnonzero(score >= LEAST_CONFIDENCE)
        kept = [batch.column(c).take(pa.array(good)) for c in ("a_src", "a", "b")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(score[good])], names=["a_src", "a", "b", "confidence"])


def _bid(begin: list[int], thing: list[int], weight: list[float], price: list[float], holder: list[int], held: list[int]) -> None:
    """Goes on until no bidder would rather have another thing; changes ``price``, ``holder`` and ``held``.

    The edges of bidder i are begin[i] .. begin[i + 1] - 1, and held[i] is the one by which it holds a
    thing, or -1; holder[j] is who holds thing j, -1 for none, -2 for a bidder of another task.  Each
    bidder without a thing bids for the one worth most at its price, up to where the next best, or
    none, is worth as much, and INCREMENT more, and so puts out who held it; if nothing is worth
    its price, it stays alone.
    """
    waiting = [i for i, e in enumerate(held) if e < 0]
    while waiting:
        i = waiting.pop()
        best = second = 0.0
        at = -1
        for e in range(begin[i], begin[i + 1]):
            worth = weight[e] - price[thing[e]]
            if worth > best:
                best, second, at = worth, best, e
            elif worth > second:
                second = worth
        if at < 0:
            continue
        j = thing[at]
        price[j] += best - second + INCREMENT
        if holder[j] >= 0:
            held[holder[j]] = -1
            waiting.append(holder[j])
        holder[j], held[i] = i, at


def _numbered(bidder: np.ndarray, thing: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """(where each bidder's edges begin, each edge's thing by number, the things) of edges sorted by bidder."""
    begin = np.r_[np.flatnonzero(np.r_[True, bidder[1:] != bidder[:-1]]), len(bidder)]
    things, number = np.unique(thing, return_inverse=True)
    return begin.tolist(), number.tolist(), things


def _best_assignment(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The edges, by their place, of a one-to-one assignment of greatest sum of weights within the bound of INCREMENT."""
    order = np.lexsort((_shuffled(a, b), a))
    begin, number, things = _numbered(a[order], b[order])
    held = [-1] * (len(begin) - 1)
    _bid(begin, number, weight[order].tolist(), [0.0] * len(things), [-1] * len(things), held)
    at = np.array(held, dtype=np.int64)
    return order[at[at >= 0]]


def _shuffled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each edge, by which bidders that find things equal choose different ones."""
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _assign_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chosen edges of whole components, of which many are solved together; rows come by component."""
    held: list[list[np.ndarray]] = []
    names = ["component", "a", "b", "confidence"]

    def solve(block: list[np.ndarray]) -> pa.RecordBatch:
        kept = _best_assignment(*block[1:])
        return pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in block[1:]], names=names[1:])

    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in names])
        if sum(len(h[0]) for h in held) < TASK_EDGES:
            continue
        block = [np.concatenate(c) for c in zip(*held)]
        cut = int(np.searchsorted(block[0], block[0][-1]))
        held = [[c[cut:] for c in block]]
        if cut:
            yield solve([c[:cut] for c in block])
    if held and sum(len(h[0]) for h in held):
        yield solve([np.concatenate(c) for c in zip(*held)])


def _bid_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bids that one task's records add to what is held, once none of them bids more."""
    parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "confidence", "price", "holder")] for b in batches if b.num_rows]
    if parts:
        a, b, weight, cost, owner = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((_shuffled(a, b), a))
        a, b, weight, cost, owner = a[order], b[order], weight[order], cost[order], owner[order]
        begin, number, things = _numbered(a, b)
        bidders = a[np.array(begin[:-1])]
        before = np.zeros(len(things))
        before[number] = cost
        held = np.full(len(bidders), -1)
        own = np.flatnonzero(owner == a)
        held[np.searchsorted(bidders, a[own])] = own
        holder = np.full(len(things), -1)
        holder[np.array(number)[owner >= 0]] = -2
        holder[np.array(number)[own]] = np.searchsorted(bidders, a[own])
        price, now = before.tolist(), held.tolist()
        _bid(begin, number, weight.tolist(), price, holder.tolist(), now)
        at = np.array(now, dtype=np.int64)
        at = at[(at >= 0) & (at != held)]
        yield pa.RecordBatch.from_arrays([pa.array(b[at]), pa.array(a[at]), pa.array(np.array(price)[np.array(number)[at]])], names=["b", "a", "price"])


def _auction(edges: DataFrame, work: Workspace) -> DataFrame:
    """One-to-one subset of (component, a, b, confidence) by an auction whose bidders are spread over tasks.

    Bidders are dealt into blocks.  In each round the blocks of bidders that were outbid, and of those
    that outbid them, bid anew: TOGETHER blocks to a task, by a hash that changes from round to round,
    until no bidder of the task would rather have another thing at the prices it knows; a thing then
    goes to the highest bid of all tasks.  Prices only rise, so rounds end; no task holds a component.
    """
    blocks = -(-edges.count() // TASK_EDGES)
    dealt = edges.withColumn("place", F.xxhash64("a", F.lit(0))).repartitionByRange(blocks, "component", "place", "a")
    edges = work.write(dealt.select("a", "b", "confidence", F.spark_partition_id().alias("block")))
    home = work.write(edges.select("a", "block").distinct())
    active = work.write(home.select("block").distinct())
    held: DataFrame | None = None  # b, a, price: what is held, by whom, at what price
    turn = 0
    while n := active.count():
        turn += 1
        asked = edges.join(active, "block", "left_semi")
        if held is None:
            seen = asked.select("*", F.lit(0.0).alias("price"), F.lit(-1).cast("long").alias("holder"))
        else:
            seen = asked.join(held.select("b", F.col("a").alias("holder"), F.col("price").alias("paid")), "b", "left").select(*asked.columns, F.coalesce("paid", F.lit(0.0)).alias("price"), F.coalesce("holder", F.lit(-1).cast("long")).alias("holder"))
        bids = work.write(seen.repartition(-(-n // TOGETHER), F.xxhash64("block", F.lit(turn))).select("a", "b", "confidence", "price", "holder").mapInArrow(_bid_apart, "b long, a long, price double"))
        both = bids if held is None else held.unionByName(bids)
        after = work.write(both.groupBy("b").agg(F.max_by("a", F.struct("price", "a")).alias("a"), F.max("price").alias("price")))
        outbid = both.join(after.select("a"), "a", "left_anti")
        rivals = outbid.select("a").union(after.join(outbid.select("b"), "b", "left_semi").select("a")).distinct()
        active = work.write(home.join(rivals, "a", "left_semi").select("block").distinct())
        held = after
    return edges.join(held.select("a", "b"), ["a", "b"]).select("a", "b", "confidence")


def assign(edges: DataFrame, work: Workspace) -> DataFrame:
    """One-to-one subset of (a, b, confidence) with the greatest total confidence.

    Edges without competition stay.  The rest is auctioned: components of at most TASK_EDGES edges
    within a task each, larger ones by bidders spread over many tasks, in rounds.  Either way the
    total is below the optimum by at most INCREMENT for each record that gets a partner.
    """
    one = ["a", "b", "confidence"]
    deg_a = edges.groupBy("a").agg(F.count(F.lit(1)).alias("na"))
    deg_b = edges.groupBy("b").agg(F.count(F.lit(1)).alias("nb"))
    # A component is a star or less unless some edge has competition at both ends.
    known = work.write(edges.join(deg_a, "a").join(deg_b, "b"))
    alone = known.where("na = 1 and nb = 1").select(*one)
    rest = known.where("na > 1 or nb > 1").select(*one)
    if not rest.limit(1).count():
        return alone
    nodes = rest.select((F.col("a") * 2).alias("x"), (F.col("b") * 2 + 1).alias("y"), *one)
    component = connected_components(nodes.select("x", "y"), "x", "y", work)
    placed = nodes.join(component, nodes["x"] == component["node"]).select("component", *one)
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("edges"))
    placed = work.write(placed.join(sizes, "component"))
    small = placed.where(F.col("edges") <= TASK_EDGES).select("component", *one)
    solved = small.repartition("component").sortWithinPartitions("component").mapInArrow(_assign_whole, "a long, b long, confidence double")
    result = alone.unionByName(solved)
    big = placed.where(F.col("edges") > TASK_EDGES).select("component", *one)
    return result.unionByName(_auction(big, work)) if big.limit(1).count() else result


def match_records(papers: DataFrame, listings: DataFrame, window: int = WINDOW) -> DataFrame:
    """(paper, listing, confidence): for each listing the paper that is the same work, if any.

    Both frames have the columns ``id`` (whole number), ``title``, ``doi``, ``authors``, ``date``, one row
    per record.  Any field may be null, empty or wrong: a record without title or with nothing in
    common with another matches none, and rows with a null id are left out.  Extra columns are not read.

    Records are put in comparable form, sorted by several composite keys and compared with the
    ``window`` rows after them in each order by a weighted sum of field similarities.  Listings that match
    one another are listings of one work; works are then assigned to papers one to one so that
    the total confidence is greatest.
    """
    work = Workspace(papers.sparkSession, "matching")
    fields = ["title", "doi", "authors", "date"]
    named = [df.where("id is not null").select(F.lit(i).alias("src"), F.col("id").cast("long").alias("id"), *fields) for i, df in enumerate((papers, listings))]
    features = work.write(at_least_parallel(named[0].union(named[1])).mapInArrow(_featurise, _FEATURES))
    pairs = window_pairs(features, window, work)
    side = lambda p, q: features.select(F.col("src").alias(f"{p}_src"), F.col("id").alias(p), F.col("packed").alias(f"{q}_packed"))
    both = pairs.join(side("a", "x"), ["a_src", "a"]).join(side("b", "y"), ["b_src", "b"])
    scored = work.write(both.mapInArrow(_score, "a_src int, a long, b long, confidence double"))
    copies = connected_components(scored.where("a_src = 1").select("a", "b"), "a", "b", work)
    links = scored.where("a_src = 0").select("a", "b", "confidence").join(copies, F.col("b") == F.col("node"), "left")
    grouped = work.write(links.select("a", "b", F.coalesce("component", "b").alias("g"), "confidence"))
    edges = grouped.groupBy("a", "g").agg(F.max("confidence").alias("confidence")).withColumnRenamed("g", "b")
    chosen = assign(edges, work).select("a", F.col("b").alias("g"), F.col("confidence").alias("best"))
    return grouped.join(chosen, ["a", "g"]).select(F.col("a").alias("paper"), F.col("b").alias("listing"), "confidence")
