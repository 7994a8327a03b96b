"""Fusing ranked lists by rank: reciprocal ranks, or the best rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.config import Fusion


def stamped(evidence: DataFrame) -> DataFrame:
    """Evidence with claim and query, rows sent again left out; a null rank has no place in a list."""
    kept = ["evidence_id", "atomic_claim_id", "query_id", "source", "chunk_id", "rank", "recorded_at"]
    return evidence.where("atomic_claim_id is not null and query_id is not null and rank is not null").select(*kept).distinct()


def unstamped(evidence: DataFrame) -> DataFrame:
    """(evidence_id, reason) of the rows that can't be fused: not stamped yet, or without a rank."""
    reason = F.when(F.col("atomic_claim_id").isNull(), "no claim").when(F.col("query_id").isNull(), "no query").when(F.col("rank").isNull(), "no rank")
    return evidence.select("evidence_id", reason.alias("reason")).where("reason is not null").distinct()


def by_claim(evidence: DataFrame) -> DataFrame:
    """(atomic_claim_id, pos, evidence_id, chunk_id, query_id, source, rank): stamped evidence of each claim numbered from 1 in the order it was recorded.

    One row a record; a claim's evidence is never gathered into one value.
    """
    order = Window.partitionBy("atomic_claim_id").orderBy("recorded_at", "query_id", "source", "rank", "chunk_id", "evidence_id")
    return evidence.withColumn("pos", F.row_number().over(order)).select("atomic_claim_id", "pos", "evidence_id", "chunk_id", "query_id", "source", "rank")


def _fuse(evidence: DataFrame, score: Column, top_k: int) -> DataFrame:
    first = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("seen", c))), lambda s: s[c]), ",")
    text = [F.min_by("text", F.struct("recorded_at", "text")).alias("text")] if "text" in evidence.columns else []
    per_query = evidence.groupBy("atomic_claim_id", "chunk_id", "source", "query_id").agg(F.min("rank").alias("best"), F.sum(F.lit(1.0) / (60 + F.col("rank"))).alias("rr"), F.min("recorded_at").alias("seen"), *text)
    sources = per_query.groupBy("atomic_claim_id", "chunk_id", "source").agg(F.min("best").alias("best"), F.sum("rr").alias("rr"), F.min("seen").alias("seen"), F.collect_set(F.struct("seen", "query_id")).alias("queries"), *([F.min_by("text", F.struct("seen", "text")).alias("text")] if text else []))
    queries = F.array_sort(F.flatten(F.collect_list("queries")))
    fused = sources.groupBy("atomic_claim_id", "chunk_id").agg(
        F.min("best").alias("best"), F.sum("rr").alias("rr"), first("source").alias("contributing_sources"), F.array_distinct(F.transform(queries, lambda q: q["query_id"])).alias("contributing_query_ids"),
        *([F.min_by("text", F.struct("seen", "text")).alias("text")] if text else []),
    )
    order = Window.partitionBy("atomic_claim_id").orderBy(F.desc("score"), "chunk_id")
    ranked = fused.withColumn("score", F.round(score, 9)).withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= top_k)
    return ranked.select("atomic_claim_id", "chunk_id", "score", "contributing_sources", "contributing_query_ids", F.size("contributing_query_ids").alias("n_queries"), "pos", *(["text"] if text else []))


def rrf(evidence: DataFrame, cfg: Fusion = Fusion()) -> DataFrame:
    """Sum over all (query, source) hits of 1 / (rrf_k + rank) per claim and chunk, best top_k, ties by chunk_id.

    contributing_sources and contributing_query_ids: in the order they were first recorded; text, where there is one: the first recorded. Grouped per query and source first, so
    hits given again are reduced before the shuffle.
    """
    if cfg.rrf_k != 60:
        evidence = evidence.withColumn("rank", F.col("rank") + (cfg.rrf_k - 60))
    return _fuse(evidence, F.col("rr"), cfg.top_k)


def round_robin(evidence: DataFrame, top_k: int = 10) -> DataFrame:
    """As rrf, with 1 / (1 + best rank) as the score."""
    return _fuse(evidence, F.lit(1.0) / (1 + F.col("best")), top_k)
