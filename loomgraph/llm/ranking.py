"""One ranking from several differently-scaled scores: robust rank aggregation.

Within a query each score is replaced by its normalised rank r = (candidates with a value at least as high) / n, so no
scale or shape survives. Under the hypothesis that the scores order the candidates at random, the k-th smallest of an
item's m ranks follows a Beta(k, m - k + 1) law; the item's significance is the smallest of these m tail
probabilities, corrected for taking the smallest. Candidates are ranked by significance.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.staging import stage

SCORES = ("sim_score", "bm25_score", "frequency_score", "recency_score")


@dataclass(frozen=True)
class RankSpec:
    """A query is heavy if it holds more than ``share`` of all rows and more than ``rows`` rows; there are at most
    1/share of them, so their list may be broadcast. ``pieces``: ranges a heavy query's values are cut into."""

    scores: tuple[str, ...] = SCORES
    share: float = 0.002
    rows: int = 100_000
    pieces: int = 64


def candidates(scored: DataFrame, spec: RankSpec) -> DataFrame:
    """One row per (query_id, node_id): the highest value of each score; NaN and null are missing (null)."""
    value = {s: F.col(s).cast("double") for s in spec.scores}
    return scored.groupBy("query_id", "node_id").agg(*[F.max(F.when(~F.isnan(v), v)).alias(s) for s, v in value.items()])


def heavy_queries(rows: DataFrame, spec: RankSpec) -> list[tuple[int | None, int]]:
    """(query, n) of the heavy queries; at most 1/share rows come to the driver."""
    per = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n")).first()[0] or 0
    if total <= spec.rows:
        return []
    least = max(spec.rows, total * spec.share)
    return [(r["query_id"], r["n"]) for r in per.where(F.col("n") > least).collect()]


def _times(factor: Column, n: int) -> list[Column]:
    return [factor] * n


def tail(ordered: list[Column]) -> Column:
    """Corrected smallest beta order-statistic probability of the ranks, which ascend."""
    m = len(ordered)
    probability = [
        functools.reduce(Column.__add__, [functools.reduce(Column.__mul__, [F.lit(float(math.comb(m, j))), *_times(r, j), *_times(1.0 - r, m - j)]) for j in range(k, m + 1)]) for k, r in enumerate(ordered, 1)
    ]
    return F.least(F.lit(1.0), F.round(F.least(*probability) * m, 12))


def _positions(rows: DataFrame, spec: RankSpec) -> DataFrame:
    """Rows of ordinary queries with n and, per score, at_least_<score>: one shuffle by query serves all scores."""
    by = Window.partitionBy("query_id")
    return rows.select("*", F.count(F.lit(1)).over(by).alias("n"), *[F.count(F.lit(1)).over(by.orderBy(F.desc_nulls_last(s)).rangeBetween(Window.unboundedPreceding, 0)).alias(f"at_least_{s}") for s in spec.scores])


def _heavy_positions(rows: DataFrame, heavy: DataFrame, spec: RankSpec) -> DataFrame:
    """The same for heavy queries: counts per distinct value, summed over ranges of values that many tasks share."""
    out = stage(rows.join(F.broadcast(heavy), rows["query_id"].eqNullSafe(heavy["heavy_id"])).drop("heavy_id"), "heavy")
    total = out.count()
    steps = [i / spec.pieces for i in range(1, spec.pieces)]
    for s in spec.scores:
        cuts = rows.groupBy("query_id").agg(F.percentile_approx(s, steps).alias("cuts")).select(F.col("query_id").alias("q"), "cuts")
        counts = out.groupBy("query_id", F.col(s).alias("value")).agg(F.count(F.lit(1)).alias("c"))
        piece = F.when(F.col("value").isNull(), -1).otherwise(F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda x: x < F.col("value"))))
        counts = counts.join(F.broadcast(cuts), counts["query_id"].eqNullSafe(F.col("q"))).select("query_id", "value", "c", piece.alias("piece"))
        above = counts.groupBy("query_id", "piece").agg(F.sum("c").alias("total"))
        above = above.withColumn("above", F.coalesce(F.sum("total").over(Window.partitionBy("query_id").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        above = above.select(F.col("query_id").alias("q"), F.col("piece").alias("p"), "above")
        within = F.sum("c").over(Window.partitionBy("query_id", "piece").orderBy(F.desc_nulls_last("value")).rangeBetween(Window.unboundedPreceding, 0))
        placed = counts.withColumn("within", within).join(F.broadcast(above), F.col("query_id").eqNullSafe(F.col("q")) & (F.col("piece") == F.col("p")))
        placed = stage(placed.select(F.col("query_id").alias("q"), "value", "c", (F.col("within") + F.col("above")).alias(f"at_least_{s}")), "heavy-values")
        # A value tied in a set share of the rows goes by broadcast (at most 1/share can be that frequent), all others by a shuffle.
        often = F.col("c") > max(spec.rows, spec.share * total)
        tied = F.broadcast(placed.where(often).drop("c"))
        on = F.col("query_id").eqNullSafe(F.col("q")) & F.col(s).eqNullSafe(F.col("value"))
        plain = out.join(tied.select("q", "value"), on, "left_anti").join(placed.where(~often).drop("c"), on).drop("q", "value")
        out = stage(plain.unionByName(out.join(tied, on).drop("q", "value")), "heavy")
    return out


def aggregate_ranks(scored: DataFrame, spec: RankSpec = RankSpec(), heavy: list | None = None, placed: bool = True) -> DataFrame:
    """(query_id, node_id, scores, n, at_least_*, rho, mean_rank[, place]): one row per candidate.

    ``rho`` in (0, 1] is the corrected significance (small is good); equal rho is ordered by the mean of the ranks,
    then by node id. Missing scores (null, NaN) rank below every value, level with each other. Repeated candidates
    count once with their highest scores; infinities are ordinary extreme values; a null query is a query; other
    columns are dropped. Empty tables give no rows.
    """
    rows = candidates(scored, spec)
    heavy = heavy_queries(rows, spec) if heavy is None else heavy
    if heavy:
        listed = rows.sparkSession.createDataFrame([tuple(h) for h in heavy], "heavy_id long, n long")
        is_heavy = rows["query_id"].eqNullSafe(listed["heavy_id"])
        light = _positions(rows.join(F.broadcast(listed), is_heavy, "left_anti"), spec)
        some = rows.join(F.broadcast(listed), is_heavy, "left_semi")
        ranked = light.unionByName(_heavy_positions(stage(some, "heavy"), listed, spec))
    else:
        ranked = _positions(rows, spec)
    ranks = [F.col(f"at_least_{s}") / F.col("n") for s in spec.scores]
    # Sorted once a row, not once for each use.
    ranked = ranked.withColumn("mean_rank", F.round(sum(ranks, F.lit(0.0)) / len(ranks), 12)).withColumn("ordered", F.sort_array(F.array(*ranks)))
    ranked = ranked.withColumn("rho", tail([F.col("ordered")[i] for i in range(len(ranks))])).drop("ordered")
    return _place(ranked, heavy, spec) if placed else ranked


def _place(ranked: DataFrame, heavy: list, spec: RankSpec) -> DataFrame:
    order = ["rho", "mean_rank", "node_id"]
    if not heavy:
        return ranked.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))
    listed = ranked.sparkSession.createDataFrame([tuple(h) for h in heavy], "heavy_id long, heavy_n long").select("heavy_id")
    # One number that rises with (rho, mean_rank), to cut heavy queries into pieces.
    z = F.when(F.col("rho") < 1, F.col("rho")).otherwise(1 + F.col("mean_rank"))
    steps = [i / spec.pieces for i in range(1, spec.pieces)]
    on = F.col("query_id").eqNullSafe(F.col("heavy_id"))
    cuts = ranked.withColumn("z", z).join(F.broadcast(listed), on, "left_semi").groupBy("query_id").agg(F.percentile_approx("z", steps).alias("cuts")).withColumnRenamed("query_id", "heavy_id")
    cut = ranked.join(F.broadcast(cuts), on, "left").withColumn("piece", F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda x: x < z)))).drop("cuts", "heavy_id")
    sizes = cut.join(F.broadcast(listed), on, "left_semi").groupBy("query_id", "piece").agg(F.count(F.lit(1)).alias("c"))
    before = sizes.select(F.col("query_id").alias("q"), F.col("piece").alias("p"), F.coalesce(F.sum("c").over(Window.partitionBy("query_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = cut.withColumn("local", F.row_number().over(Window.partitionBy("query_id", "piece").orderBy(*order)))
    both = local.join(F.broadcast(before), F.col("query_id").eqNullSafe(F.col("q")) & (F.col("piece") == F.col("p")), "left")
    return both.withColumn("place", (F.col("local") + F.coalesce("before", F.lit(0))).cast("long")).drop("q", "p", "piece", "local", "before")


@functools.lru_cache
def rank_bound(n: int, m: int, least: int) -> float:
    """The largest rho that a candidate of a query of ``n`` can have and still beat each other one in ``least`` scores.

    Each of the n - 1 others is level or ahead in at most m - least scores, so the m normalised ranks sum up to at most
    ((m - least)(n - 1) + m) / n. A rho of m * t needs every k-th smallest rank at its Beta quantile of t or beyond, and
    the quantiles' sum rises with t: the bound is where it meets that sum.
    """
    most = ((m - least) * (n - 1) + m) / n

    def quantile(k: int, t: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(40):
            mid = (low + high) / 2
            below = sum(math.comb(m, j) * mid**j * (1 - mid) ** (m - j) for j in range(k, m + 1)) < t
            low, high = (mid, high) if below else (low, mid)
        return high

    low, high = 0.0, 1.0
    for _ in range(40):
        mid = (low + high) / 2
        fits = sum(quantile(k, mid) for k in range(1, m + 1)) <= most
        low, high = (mid, high) if fits else (low, mid)
    return min(1.0, m * high + 1e-6)


#: Sizes of queries for which the bound is computed; it falls with the size, so each serves those up to the next one.
SIZES = (1, 2, 3, 4, 6, 9, 14, 24, 48, 128, 1024)


def _winners(query: np.ndarray, scores: np.ndarray, least: int) -> np.ndarray:
    """Rows left of a knock-out within each query (rows are sorted by it): of each pair that meets only a winner stays."""
    at = np.arange(len(query))
    while len(at):
        q = query[at]
        place = np.arange(len(at)) - np.searchsorted(q, q)
        first = np.flatnonzero((place % 2 == 0) & np.r_[q[1:] == q[:-1], False])
        if not len(first):
            return at
        a, b = scores[at[first]], scores[at[first + 1]]
        missing_a, missing_b = np.isnan(a), np.isnan(b)
        wins = (~missing_a & (missing_b | (a > b))).sum(axis=1) >= least
        losses = (~missing_b & (missing_a | (b > a))).sum(axis=1) >= least
        stays = np.ones(len(at), bool)
        stays[first], stays[first + 1] = wins, losses
        at = at[stays]
    return at


def dominant(scored: DataFrame, least: int = 3, spec: RankSpec = RankSpec()) -> DataFrame:
    """(query_id, node_id): the candidate that is strictly higher than each other one in at least ``least`` scores.

    The aggregation's significance bounds who can be one (:func:`rank_bound`). The candidates it leaves meet in a
    knock-out (a loser, and both of a draw, are out; the winner of all can't be knocked out), in parts and then across
    parts, which leaves at most one per query; it is then checked against every candidate of its query. A lone
    candidate passes.
    """
    m = len(spec.scores)
    rows = candidates(scored, spec)
    heavy = heavy_queries(rows, spec)
    ranked = aggregate_ranks(scored, spec, heavy, placed=False)
    schema = "query_id long, node_id string, " + ", ".join(f"{s} double" for s in spec.scores)
    names = ["query_id", "node_id", *spec.scores]

    bounds = np.array([rank_bound(n, m, least) for n in SIZES])

    def possible(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Here and not as a filter: the planner would repeat the whole formula of rho in it.
        for b in batches:
            rho, n = b.column("rho").to_numpy(), b.column("n").to_numpy()
            yield b.filter(pa.array(rho <= bounds[np.searchsorted(SIZES, n, side="right") - 1])).select(names)

    def knock_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # at most one row for each query met so far
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            t = t.take(pc.sort_indices(t, [("query_id", "ascending")])).combine_chunks()  # nulls last
            null = t.column(0).is_null().to_numpy()
            key = np.searchsorted(np.unique(t.column(0).drop_null().to_numpy()), t.column(0).fill_null(0).to_numpy())
            key = np.where(null, len(key), key)
            values = np.stack([t.column(i).to_numpy().astype(np.float64) for i in range(2, 2 + m)], axis=1)
            held = t.take(pa.array(_winners(key, values, least)))
        if held is not None:
            yield from held.select(names).to_batches()

    parts = ranked.select("rho", "n", *names).mapInArrow(lambda batches: knock_out(possible(batches)), schema)
    one = parts.repartition("query_id").mapInArrow(knock_out, schema)
    renamed = one.select(F.col("query_id").alias("q"), F.col("node_id").alias("x"), *[F.col(s).alias(f"x_{s}") for s in spec.scores])
    wins = sum((((F.col(f"x_{s}").isNotNull()) & (F.col(s).isNull() | (F.col(f"x_{s}") > F.col(s)))).cast("int") for s in spec.scores), F.lit(0))
    on = F.col("query_id").eqNullSafe(F.col("q"))
    if heavy:
        listed = F.broadcast(rows.sparkSession.createDataFrame([tuple(h) for h in heavy], "heavy_id long, n long").select("heavy_id"))
        mine = F.col("query_id").eqNullSafe(F.col("heavy_id"))
        theirs = F.col("q").eqNullSafe(F.col("heavy_id"))
        met = rows.join(listed, mine, "left_semi").join(F.broadcast(renamed.join(listed, theirs, "left_semi")), on)
        met = met.unionByName(rows.join(listed, mine, "left_anti").join(renamed.join(listed, theirs, "left_anti"), on))
    else:
        met = rows.join(renamed, on)
    beaten = met.where(~F.col("node_id").eqNullSafe(F.col("x"))).groupBy("q").agg(F.min(wins).alias("worst")).where(F.col("worst") < least)
    return one.join(beaten, F.col("query_id").eqNullSafe(F.col("q")), "left_anti").select("query_id", "node_id")
