"""Queries of the llm operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import langid, leakage, mixing, near, ranking, vectors
from loomgraph.llm.staging import stage
from loomgraph.session import spread, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.similar_pairs(table(spark, d, "nodes"))


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Of each node's ten most similar nodes those with cosine 0.97 or more."""
    return vectors.nearest(table(spark, d, "nodes")).where(F.col("cosine") >= 0.97).withColumn("cosine", F.round("cosine", 5))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar nodes, at any distance, of every node."""
    return vectors.nearest(table(spark, d, "nodes")).withColumn("cosine", F.round("cosine", 6))


def p3_top10(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar nodes, at any distance, of every node whose hashed id is divisible by 20, against all nodes."""
    rows = stage(vectors.usable_vectors(table(spark, d, "nodes"), "id", "embedding"), "usable")
    mine = F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("long") % 20 == 0
    found = vectors.top_k_blocks(rows, rows.where(mine), 10)
    return found.select(F.col("query").alias("id"), F.col("id").alias("other"), F.round("cosine", 6).alias("cosine"), "place")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.dominant(table(spark, d, "scored_nodes"))


def p4_ranking(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.aggregate_ranks(table(spark, d, "scored_nodes"))
    return ranked.select("query_id", "node_id", F.round("rho", 9).alias("rho"), F.round("mean_rank", 9).alias("mean_rank"), "place")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return near.near_pairs(spread(table(spark, d, "nodes").select("id", "label", "summary")))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return near.near_groups(spread(table(spark, d, "nodes").select("id", "label", "summary")), near.NearSpec(numerator=8))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(spread(table(spark, d, "documents")), table(spark, d, "eval_items"))


def p7_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps of at least twelve words, four fifths of them equal."""
    found = leakage.overlaps(spread(table(spark, d, "documents")), table(spark, d, "eval_items"))
    return found.where(F.col("overlap_words") >= 12)


def p7_runs(spark: SparkSession, d: str) -> DataFrame:
    """How many words of an item run unchanged through a document, where there are at least twelve."""
    found = leakage.overlaps(spread(table(spark, d, "documents")), table(spark, d, "eval_items"), exact=True)
    return found.where(F.col("exact_run") >= leakage.LeakSpec.run).select("doc_id", "item_id", "exact_run")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = mixing.mix(spread(table(spark, d, "documents")), table(spark, d, "mixture_targets"))
    return mixing.short_sources(report).select("source")


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(spread(table(spark, d, "documents")), table(spark, d, "mixture_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(spread(table(spark, d, "documents")), table(spark, d, "mixture_targets"))[1]


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every target source's selection: no document used more often than allowed or from another
    source, no more of it taken than there is, a share of the total within seven deviations of the draw (and a block for the
    last one) of what is asked for or can be had."""
    docs = spread(table(spark, d, "documents"))
    spec = mixing.MixSpec()
    selection, report = mixing.mix(docs, table(spark, d, "mixture_targets"), spec)
    selection = stage(selection, "selection")
    own = docs.select("doc_id", mixing.source_name(F.col("source")).alias("own"))
    per = selection.join(own, "doc_id").groupBy("source").agg(F.max("uses").alias("most_uses"), F.every(F.col("source") == F.col("own")).alias("own_documents"), F.sum("tokens_used").alias("used"))
    r = report.join(per, "source", "left")
    wanted = F.least(F.col("share") * F.col("goal"), F.col("capacity"))
    spread_of = 7 * F.sqrt(F.col("share") * F.col("goal") / spec.block + 1) * spec.block + (F.col("max_repeats") + 1) * spec.block
    return r.select(
        "source", (F.coalesce("most_uses", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"), F.coalesce("own_documents", F.lit(True)).alias("own_documents"),
        ((F.col("selected") == F.coalesce("used", F.lit(0))) & (F.col("selected") <= F.col("capacity"))).alias("tokens_add_up"), (F.abs(F.col("selected") - wanted) <= spread_of).alias("share_met"),
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.mislabelled(spread(table(spark, d, "documents")))


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return langid.document_languages(spread(table(spark, d, "documents")))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return langid.segments(spread(table(spark, d, "documents")))


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the languages found, for each language that labels name: its share of a text's words lies in
    (0, 1] and all shares of a text make 1, confidences are probabilities, and of the texts in one language that are so
    labelled most are found to be in it, although some labels are wrong."""
    found = stage(langid.document_languages(spread(table(spark, d, "documents"))), "languages")
    whole = found.groupBy("doc_id").agg(F.abs(F.sum("share") - 1.0).alias("off"))
    rows = found.join(whole, "doc_id").where(F.col("label").isNotNull())
    agree = F.avg(F.when((F.col("share") > 0.8), (F.col("lang") == F.col("label")).cast("double"))) > 0.5
    fine = F.every((F.col("share") > 0) & (F.col("share") <= 1) & (F.col("off") < 1e-9))
    return rows.groupBy(F.col("label").alias("lang")).agg(fine.alias("shares_add_up"), F.every(F.col("confidence").between(0, 1)).alias("confidences_fit"), agree.alias("labels_agree"))


QUERIES = {f.__name__: f for f in (p3_found, p3_nearest, p3_neighbours, p3_top10, p4_found, p4_ranking, p6_found, p6_groups, p7_found, p7_overlaps, p7_runs, p8_found, p8_selection, p8_shares, p8_checks, p9_found, p9_documents, p9_segments, p9_checks)}
