"""Sources mixed to target weights by Pfair scheduling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import ranked
from paperloom.session import Workspace

#: Documents per bucket of the running sums within a source.
BUCKET_ROWS = 50_000
#: The mix keeps at least this part of the tokens that its sources have, even if a source that is
#: very small for its target then falls short of it.
LEAST_KEPT = 0.5


@dataclass(frozen=True)
class Target:
    """What a source should give, and may: share of the tokens, and uses of one document."""

    source: str
    share: float
    repeats: int


def budgets(targets: list[Target], tokens: dict[str, int], total: float | None = None, least_kept: float = LEAST_KEPT) -> dict[str, float]:
    """Tokens that each source gives.

    Sources without tokens give none, and their share is spread over the others in proportion.
    Without ``total`` the mix is as large as it can be with every remaining target met exactly,
    but no smaller than ``least_kept`` of all tokens the sources have.  At a given total, a source
    that can't give its share even with all repeats gives what it has, and what it lacks is
    spread over the others in proportion to their targets.
    """
    limit = {t.source: tokens.get(t.source, 0) * max(0, t.repeats) for t in targets}
    live = [t for t in targets if limit[t.source] > 0 and t.share > 0]
    weight = sum(t.share for t in live)
    if not live:
        return {t.source: 0.0 for t in targets}
    if total is None:
        exact = min(limit[t.source] * weight / t.share for t in live)
        total = max(exact, least_kept * sum(tokens.get(t.source, 0) for t in live))
    given: dict[str, float] = {t.source: 0.0 for t in targets}
    open_, rest = live, min(float(total), float(sum(limit.values())))
    while open_:
        weight = sum(t.share for t in open_)
        short = [t for t in open_ if limit[t.source] < rest * t.share / weight * (1 - 1e-12)]
        if not short:
            given |= {t.source: rest * t.share / weight for t in open_}
            break
        given |= {t.source: float(limit[t.source]) for t in short}
        rest -= sum(limit[t.source] for t in short)
        open_ = [t for t in open_ if t not in short]
    return given


def mix(df: DataFrame, key: str, source: str, size: str, targets: list[Target], total: float | None = None) -> DataFrame:
    """Rows (``source``, ``key``, ``use``, ``n_tokens``, ``release_at``, ``deadline_at``, ``slot``).

    One row per use of a document, ``use`` counting from 1; ``slot`` is its place in the mix.
    Each source is a task whose weight is its part of the mix.  The document that fills tokens
    a..b of its source is released at a / weight and due at b / weight; the earliest deadline goes
    first, so that after any number of tokens each source is within about one document of its
    part.  A source's documents come in an order given by a hash, the whole source before any
    document's next use, and stop with the document whose middle passes the source's budget.

    Documents of other sources, without source (null) or without tokens (null or 0) have no part.
    A key that occurs twice counts as two documents.  Running sums are taken within buckets
    of bounded size, so a source with a large part of all rows is no unbounded group.
    """
    spark = df.sparkSession
    work = Workspace(spark, "mixing")
    names = spark.createDataFrame([(t.source,) for t in targets], "source string")
    chosen = df.select(F.col(source).alias("source"), F.col(key), F.col(size).cast("long").alias("n_tokens")).where("n_tokens > 0")
    sized = work.write(chosen.join(F.broadcast(names), "source"))
    sums = {r["source"]: (r["n"], r["t"]) for r in sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()}
    given = budgets(targets, {s: t for s, (_, t) in sums.items()}, total)
    all_tokens = sum(given.values())
    plan = spark.createDataFrame(
        [(t.source, float(sums[t.source][1]), given[t.source], given[t.source] / all_tokens, max(1, -(-sums[t.source][0] // BUCKET_ROWS)), t.repeats) for t in targets if t.source in sums and given[t.source] > 0],
        "source string, tokens double, budget double, weight double, buckets long, repeats int",
    )
    h = F.xxhash64(F.lit("mix"), key)
    rows = sized.join(F.broadcast(plan), "source").withColumn("h", h).withColumn("bucket", F.pmod("h", "buckets"))
    per = rows.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = per.select("source", "bucket", (F.sum("t").over(Window.partitionBy("source").orderBy("bucket")) - F.col("t")).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", key, "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("n_tokens").over(inside)).join(before, ["source", "bucket"])
    uses = placed.withColumn("use", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    end = F.col("base") + F.col("upto") + (F.col("use") - 1) * F.col("tokens")
    uses = uses.withColumn("end", end).where(F.col("end") - F.col("n_tokens") / 2 <= F.col("budget"))
    timed = uses.select("source", key, "use", "n_tokens", ((F.col("end") - F.col("n_tokens")) / F.col("weight")).alias("release_at"), (F.col("end") / F.col("weight")).alias("deadline_at"))
    return ranked(timed, [F.col("deadline_at"), F.col("release_at"), F.col("source"), F.col(key), F.col("use")], "slot", work)


def shares(mixed: DataFrame, targets: list[Target]) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_documents, max_use) of every target source."""
    goal = mixed.sparkSession.createDataFrame([(t.source, t.share, t.repeats) for t in targets], "source string, target_share double, max_repeats int")
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.sum((F.col("use") == 1).cast("long")).alias("n_documents"), F.max("use").alias("max_use"))
    whole = mixed.agg(F.sum("n_tokens").alias("all_tokens"))
    joined = goal.join(got, "source", "left").crossJoin(F.broadcast(whole))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.select(
        "source", "target_share", F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
        zero("n_tokens").alias("n_tokens"), zero("n_documents").alias("n_documents"), zero("max_use").alias("max_use"), "max_repeats",
    )
