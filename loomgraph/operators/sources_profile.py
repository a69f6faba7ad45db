"""Per-source edge statistics without stragglers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ids import clean_id
from loomgraph.operators.skew import salted, two_stage


def source_stats(edges: DataFrame, salts: int = 64, total: int | None = None) -> DataFrame:
    """(source_id, n_edges, total_weight, max_weight, n_neighbours) for every non-blank source.

    Ids are trimmed and lower-cased. Null and NaN weights count as no weight: they add 0 to the total and are
    ignored by the maximum (null if a source has none). ``total``: the number of rows, where it is known. Blank targets are no neighbours. Repeated edges count as
    often as they come in ``n_edges`` and ``total_weight`` and once in ``n_neighbours``. An empty table gives no rows.
    """
    total = edges.count() if total is None else total
    w = F.col("weight").cast("double")
    clean = edges.select(clean_id(F.col("source_id")).alias("source_id"), clean_id(F.col("target_id")).alias("target_id"), F.when(~F.isnan(w), w).alias("weight")).where(F.col("source_id") != "")
    spread, salt = salted(clean, "source_id", F.col("target_id"), total, salts=salts)
    per_pair = spread.groupBy("source_id", salt, "target_id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.max("weight").alias("m"))
    return two_stage(
        per_pair,
        "source_id",
        salt,
        {"n": F.sum("n"), "w": F.sum("w"), "m": F.max("m"), "d": F.sum((F.col("target_id") != "").cast("long"))},
        {"n_edges": F.sum("n"), "total_weight": F.coalesce(F.sum("w"), F.lit(0.0)), "max_weight": F.max("m"), "n_neighbours": F.sum("d")},
    )


def neighbours(edges: DataFrame) -> DataFrame:
    """(source_id, target_id, n_edges, total_weight): each source's neighbours, one row each.

    Grouping on both ids spreads the rows of a heavy source by itself; no list of neighbours is ever built.
    """
    w = F.col("weight").cast("double")
    return (
        edges.select(clean_id(F.col("source_id")).alias("source_id"), clean_id(F.col("target_id")).alias("target_id"), F.when(~F.isnan(w), w).alias("weight"))
        .where((F.col("source_id") != "") & (F.col("target_id") != ""))
        .groupBy("source_id", "target_id")
        .agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total_weight"))
    )


def dominant_sources(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """(source_id): non-blank sources with at least ``share`` of all rows of the table (blank ones included in all)."""
    total = edges.count()
    return source_stats(edges, total=total).where(F.col("n_edges") >= F.lit(total * share)).select("source_id")
