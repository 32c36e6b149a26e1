"""One-to-one matching within groups."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.session import Workspace

#: Groups of at most this many edges are matched within one task, whose memory this bounds; larger ones in rounds.
GROUP_EDGES = 100_000


def one_to_one(edges: DataFrame, by: list[str], a: str, b: str, order: list[tuple[str, bool]], work: Workspace) -> DataFrame:
    """The edges that a greedy matching takes within each group: one after another in ``order``, if both ends are free.

    ``order`` lists columns, with whether they descend; with ``a`` and ``b`` it must tell all edges of a
    group apart.  Groups of at most GROUP_EDGES edges are matched in a task each.  Larger ones go in
    rounds that take every edge that comes first at both its ends, which gives the same edges without
    gathering a group anywhere.
    """
    sizes = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sized = work.write(edges.join(sizes, by))
    names, down = [c for c, _ in order], [d for _, d in order]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        used_a, used_b, kept = set(), set(), []
        for i, x, y in pdf.sort_values(names, ascending=[not d for d in down])[[a, b]].itertuples():
            if x not in used_a and y not in used_b:
                used_a.add(x)
                used_b.add(y)
                kept.append(i)
        return pdf.loc[kept]

    found = sized.where(F.col("_n") <= GROUP_EDGES).select(*edges.columns).groupBy(*by).applyInPandas(choose, edges.schema)
    big = sized.where(F.col("_n") > GROUP_EDGES).select(*edges.columns)
    directions: list[Column] = [F.col(c).desc() if d else F.col(c).asc() for c, d in order]
    while big.limit(1).count():
        first = lambda k: F.row_number().over(Window.partitionBy(*by, k).orderBy(*directions)) == 1
        best = [big.withColumn("_first", first(k)).where("_first").drop("_first") for k in (a, b)]
        taken = work.write(reduce(lambda p, q: p.join(q.select(*by, a, b), [*by, a, b], "left_semi"), best))
        found = found.unionByName(taken)
        big = work.write(big.join(taken.select(*by, a), [*by, a], "left_anti").join(taken.select(*by, b), [*by, b], "left_anti"))
    return found
