"""Items into containers of fixed capacity by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import spread

#: Containers per shard.  A shard leaves less than one container unfilled beyond what differencing
#: leaves, so the loss stays under 1/CONTAINERS of the capacity; a shard's memory does not grow.
CONTAINERS = 256


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, sum of each container) for ``k`` containers of near-equal sums.

    Every item starts as a partial partition of its own.  The two partial partitions with the
    greatest difference between their fullest and emptiest container are merged, the fullest
    containers of one meeting the emptiest of the other, until one partition is left.  The items'
    containers are then read back down the tree of merges.
    """
    n = len(sizes)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(k, dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    # The k largest items always meet in one partial partition first: they only fill empty places.
    top = order[:k]
    sums: dict[int, np.ndarray] = {n: np.pad(sizes[top].astype(np.int64), (0, k - len(top)))}
    value = {int(i): int(sizes[i]) for i in order[k:]}
    heap = [(-int(sums[n][0] - sums[n][-1]), n)] + [(-v, i) for i, v in value.items()]
    heapq.heapify(heap)
    merged: list[tuple[int, int, int, np.ndarray]] = []
    made = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x = sums.pop(a) if a >= n else None
        y = sums.pop(b) if b >= n else None
        if x is None and y is not None:
            a, b, x, y = b, a, y, None
        if x is None:
            x = np.zeros(k, dtype=np.int64)
            x[0] = value[a]
        else:
            x = x.copy()
        if y is None:
            x[-1] += value[b]
        else:
            x += y[::-1]
        turn = np.argsort(-x, kind="stable")
        made += 1
        sums[made] = x = x[turn]
        merged.append((made, a, b, turn))
        heapq.heappush(heap, (-int(x[0] - x[-1]), made))
    final = heap[0][1]
    label = np.zeros(n, dtype=np.int64)
    places = {final: np.arange(k)}
    for node, a, b, turn in reversed(merged):
        at = np.empty(k, dtype=np.int64)
        at[turn] = places.pop(node)
        for child, mine in ((a, at), (b, at[::-1])):
            if child >= n:
                places[child] = mine
            else:
                label[child] = mine[0]
    label[top] = places[n][: len(top)] if n in places else label[top]
    return label, np.bincount(label, weights=sizes, minlength=k).astype(np.int64)


def _relieve(sizes: np.ndarray, label: np.ndarray, sums: np.ndarray, capacity: int) -> bool:
    """Move or swap items out of containers above capacity; whether all then fit."""
    for full in np.argsort(-sums):
        while sums[full] > capacity:
            excess = sums[full] - capacity
            mine = np.flatnonzero(label == full)
            room = capacity - sums[label]
            away = np.flatnonzero((label != full) & (room > 0))
            gain = sizes[mine][:, None] - sizes[away][None, :]
            # The least change that relieves the container and still fits the other one.
            ok = (gain >= excess) & (gain <= room[away][None, :])
            if ok.any():
                flat = np.where(ok, gain, np.iinfo(np.int64).max).argmin()
                i, j = mine[flat // len(away)], away[flat % len(away)]
                label[i], label[j] = label[j], full
                sums[label[i]] += sizes[i] - sizes[j]
                sums[full] -= sizes[i] - sizes[j]
                continue
            free = capacity - sums
            moves = [(s, i) for i, s in zip(mine, sizes[mine]) if s <= free.max()]
            if moves:
                s, i = max(moves)
                to = int(np.argmax(free))
                label[i] = to
                sums[to] += s
                sums[full] -= s
                continue
            # Steps that only lessen the excess.
            ok = (gain > 0) & (gain <= room[away][None, :])
            if not ok.any():
                return False
            flat = np.where(ok, gain, -1).argmax()
            i, j = mine[flat // len(away)], away[flat % len(away)]
            label[i], label[j] = label[j], full
            sums[label[i]] += sizes[i] - sizes[j]
            sums[full] -= sizes[i] - sizes[j]
    return bool((sums <= capacity).all())


def pack_items(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, sums) with as few containers as differencing finds.

    Starts at the least number that the total allows; the number rises while the capacity is
    exceeded.  No item may exceed the capacity.
    """
    k = max(1, -(-int(sizes.sum()) // capacity)) if len(sizes) else 0
    while len(sizes):
        label, sums = difference(sizes, k)
        if sums.max() <= capacity or _relieve(sizes, label, sums, capacity):
            break
        k += 1
    else:
        label, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return label, sums


def pack(df: DataFrame, key: str, size: str, capacities: dict[str, int], containers: int = CONTAINERS) -> DataFrame:
    """Rows (cap_name, prompt, ``key``, piece, start_at, n): item pieces in containers.

    ``df`` has one row per item; ``prompt`` numbers the containers of a capacity within their shard
    as text "shard-number".  An item above the capacity, and only such a one, is cut: into pieces
    of exactly the capacity, each filling a container, and a rest that is packed like an item.
    Items of null or no size take no room: they get no piece, so each row of the result has n > 0.
    Null keys and repeated rows are items like any other.  Other columns are not read.

    Items are dealt to shards by hash; a shard holds about ``containers`` containers, so the work
    of a task has a bound however many items there are.  Equal rows are counted before they are
    dealt, each by its number, so any number of copies spreads over all shards.  Nothing but the
    totals reaches the driver.
    """
    counted = df.select(F.col(key), F.col(size).cast("long").alias("n")).where("n > 0").groupBy(key, "n").agg(F.count(F.lit(1)).alias("_copies"))
    items = counted.select(key, "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("copy"))
    total = df.agg(F.coalesce(F.sum(F.when(F.col(size) > 0, F.col(size).cast("long"))), F.lit(0))).first()[0]
    caps = F.array(*[F.struct(F.lit(name).alias("cap_name"), F.lit(int(cap)).cast("long").alias("cap"), F.lit(max(1, round(total / (cap * containers)))).cast("long").alias("shards")) for name, cap in capacities.items()])
    each = items.select(key, "n", "copy", F.explode(caps).alias("c")).select(key, "n", "copy", "c.*")
    each = each.withColumn("shard", F.pmod(F.xxhash64(key, "n", "copy"), F.col("shards")))
    whole = F.when(F.col("n") > F.col("cap"), F.expr("n div cap")).otherwise(0)
    each = each.withColumn("whole", whole)
    full = each.where("whole > 0").select("cap_name", "shard", key, "n", "copy", "cap", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("piece"))
    number = F.concat(F.col("shard"), F.lit("-full-"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("-"), F.col("n"), F.lit("-"), F.col("copy"), F.lit("-"), F.col("piece"))
    full = full.select("cap_name", number.alias("prompt"), key, F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("cap")).alias("start_at"), F.col("cap").alias("n"))
    rest = each.select("cap_name", "cap", "shard", key, F.col("whole").cast("int").alias("piece"), (F.col("whole") * F.col("cap")).alias("start_at"), (F.col("n") - F.col("whole") * F.col("cap")).alias("n")).where("n > 0")
    kind = df.schema[key].dataType.simpleString()
    names = ["cap_name", "prompt", key, "piece", "start_at", "n"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([key, "piece"], kind="stable")
        label, _ = pack_items(group["n"].to_numpy(np.int64), int(group["cap"].iloc[0]))
        return group.assign(prompt=[f"{group['shard'].iloc[0]}-{x}" for x in label])[names]

    packed = spread(rest, "cap_name", "shard").groupBy("cap_name", "shard").applyInPandas(run, f"cap_name string, prompt string, `{key}` {kind}, piece int, start_at long, n long")
    return packed.unionByName(full)


def fill(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(cap_name, n_prompts, n_chars, least_prompts, fill): how well the containers are filled."""
    prompts = packed.groupBy("cap_name", "prompt").agg(F.sum("n").alias("n"))
    caps = packed.sparkSession.createDataFrame([*capacities.items()], "cap_name string, cap long")
    totals = prompts.groupBy("cap_name").agg(F.count(F.lit(1)).alias("n_prompts"), F.sum("n").alias("n_chars"), F.max("n").alias("fullest"))
    return totals.join(F.broadcast(caps), "cap_name").select(
        "cap_name", "n_prompts", "n_chars", "fullest", F.ceil(F.col("n_chars") / F.col("cap")).alias("least_prompts"), (F.col("n_chars") / (F.col("n_prompts") * F.col("cap"))).alias("fill")
    )
