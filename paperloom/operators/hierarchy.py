"""Parent-child rows to full hierarchies by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.skew import LEAST_HOT_ROWS, lookup_join
from paperloom.session import Workspace

#: Stands for a null tree key inside the operator; no text of the data holds U+0000.
NO_KEY = "\u0000"

SOUND, MISSING, ON_CYCLE, BELOW_CYCLE = "sound", "missing_parent", "on_cycle", "below_cycle"


def _links(nodes: DataFrame, tree: list[str], node: str, parent: str) -> DataFrame:
    """One row per node: tree keys (strings without null), id, up (null at a root)."""
    named = nodes.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit(NO_KEY)).alias(f"t{i}") for i, c in enumerate(tree)],
        F.col(node).cast("string").alias("id"),
        F.when(F.col(parent).cast("string") != "", F.col(parent).cast("string")).alias("up"),
    )
    keys = [f"t{i}" for i in range(len(tree))]
    return named.where("id is not null").groupBy(*keys, "id").agg(F.min("up").alias("up"))


def resolve(nodes: DataFrame, tree: list[str], node: str = "id", parent: str = "parent", paths: bool = True, hot_rows: int = LEAST_HOT_ROWS) -> DataFrame:
    """Every node with its kind, root, depth and path from the root.

    Columns: the ``tree`` keys and ``node`` as strings, ``kind`` (sound, missing_parent, on_cycle,
    below_cycle), ``root``, ``depth`` (0 at a root) and, with ``paths``, ``path`` (array of ids
    from the root to the node).  Nodes that are on or below a cycle have null root, depth and path.

    A null or empty parent marks a root; a parent that names no node of the same tree set makes
    its node a root of kind missing_parent.  Rows without an id are no nodes; repeated rows count
    once, and if copies of a node disagree the smallest parent holds.  Null tree keys form a tree
    set of their own.  Other columns, whatever their names, are not read.  An empty table gives
    an empty result.

    Each round joins every open pointer with the row it points to and so doubles its reach; the
    paths are concatenated on the way.  A round that closes no pointer proves that the rest leads
    into cycles, since a node of greater depth has an ancestor that would have been closed.
    Pointers of the rest go on doubling until their set of targets stops shrinking; it then is
    the set of nodes that lie on cycles.  Rounds grow with the logarithm of the depth; the number
    of rows never grows.  A parent with a large part of all rows is looked up by broadcast.
    """
    work = Workspace(nodes.sparkSession, "hierarchy")
    keys = [f"t{i}" for i in range(len(tree))]
    links = work.write(_links(nodes, tree, node, parent))
    n = links.count()
    ids = links.select(*keys, F.col("id").alias("up"), F.lit(True).alias("known"))
    start = lookup_join(links, ids, [*keys, "up"], n, "left", hot_rows)
    own = F.array("id") if paths else F.lit(None).cast("array<string>")
    lost = F.col("up").isNotNull() & F.col("known").isNull()
    jump = F.when(F.col("known"), F.col("up"))
    state = work.write(
        start.select(
            *keys, "id", lost.alias("lost"), jump.alias("jump"), F.when(jump.isNull(), F.col("id")).alias("root"),
            F.when(jump.isNull(), 0).otherwise(1).cast("long").alias("dist"), own.alias("path"),
        )
    )
    closed = [state.where("jump is null")]
    active = state.where("jump is not null")
    left = active.count()
    tables = [state]
    while left:
        targets = state.select(*keys, F.col("id").alias("jump"), F.col("jump").alias("jump2"), F.col("root").alias("root2"), F.col("dist").alias("dist2"), F.col("path").alias("path2"))
        moved = lookup_join(active, targets, [*keys, "jump"], left, "inner", hot_rows)
        state_now = work.write(
            moved.select(
                *keys, "id", "lost", F.col("jump2").alias("jump"), F.col("root2").alias("root"),
                (F.col("dist") + F.col("dist2")).alias("dist"), (F.concat("path2", "path") if paths else F.col("path")).alias("path"),
            )
        )
        tables.append(state_now)
        closed.append(state_now.where("jump is null"))
        active = state_now.where("jump is not null")
        remaining = active.count()
        if remaining == left:
            break
        left = remaining
        # Closed nodes of earlier rounds stay as they are; open ones are those of this round.
        state = closed[0]
        for part in closed[1:]:
            state = state.unionByName(part)
        state = state.unionByName(active)
    result = closed[0]
    for part in closed[1:]:
        result = result.unionByName(part)
    result = result.withColumn("kind", F.when(F.col("lost"), MISSING).otherwise(SOUND))
    if left:
        result = result.unionByName(_cycles(work, active, keys, left, hot_rows))
    renamed = [F.when(F.col(k) != NO_KEY, F.col(k)).alias(c) for k, c in zip(keys, tree)]
    depth = F.when(F.col("root").isNotNull(), F.col("dist")).alias("depth")
    return result.select(*renamed, F.col("id").alias(node), "kind", "root", depth, *(["path"] if paths else []))


def _cycles(work: Workspace, active: DataFrame, keys: list[str], n: int, hot_rows: int) -> DataFrame:
    """Split the nodes that never reach a root into those on a cycle and those below one."""
    open_nodes = active.select(*keys, "id", "lost", "jump")
    goals = work.write(open_nodes.select(*keys, "jump").distinct())
    n_goals = goals.count()
    while True:
        step = open_nodes.select(*keys, F.col("id").alias("jump"), F.col("jump").alias("jump2"))
        open_nodes = work.write(
            lookup_join(open_nodes, step, [*keys, "jump"], n, "inner", hot_rows).select(*keys, "id", "lost", F.col("jump2").alias("jump"))
        )
        goals = work.write(open_nodes.select(*keys, "jump").distinct())
        now = goals.count()
        if now == n_goals:
            break
        n_goals = now
    on = goals.select(*keys, F.col("jump").alias("id"), F.lit(True).alias("on"))
    none = F.lit(None)
    return open_nodes.join(on, [*keys, "id"], "left").select(
        *keys, "id", "lost", "jump", none.cast("string").alias("root"), none.cast("long").alias("dist"), none.cast("array<string>").alias("path"),
        F.when(F.col("on"), ON_CYCLE).otherwise(BELOW_CYCLE).alias("kind"),
    )


def descendants(resolved: DataFrame, tree: list[str], node: str = "id") -> DataFrame:
    """All (ancestor, descendant) pairs: ``tree`` keys, ``ancestor``, ``node``, ``distance`` (> 0).

    One row per pair, never one list per ancestor, so a root over a large part of all rows is no
    unbounded group.  Nodes without a path have no ancestors here.
    """
    up = resolved.where("path is not null and depth > 0").select(*tree, node, "depth", F.posexplode("path").alias("at", "ancestor"))
    return up.where(F.col("at") < F.col("depth")).select(*tree, "ancestor", node, (F.col("depth") - F.col("at")).cast("long").alias("distance"))


def with_descendant_counts(resolved: DataFrame, tree: list[str], node: str = "id") -> DataFrame:
    """``resolved`` with ``n_descendants`` (0 at a leaf, null on or below a cycle)."""
    pairs = descendants(resolved, tree, node).groupBy(*tree, "ancestor").agg(F.count(F.lit(1)).alias("n_descendants"))
    same = [resolved[c].eqNullSafe(pairs[c]) for c in tree] + [resolved[node] == pairs["ancestor"]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    counted = resolved.join(pairs, cond, "left").select(resolved["*"], pairs["n_descendants"])
    return counted.withColumn("n_descendants", F.when(F.col("path").isNotNull(), F.coalesce("n_descendants", F.lit(0)).cast("long")))
