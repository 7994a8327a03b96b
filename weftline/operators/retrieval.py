"""Queries of claims and questions, and stamping of search hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import content_id


def build_queries(claims: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, text, atomic_claim_id, question_id, origin) of claims (claim_id, text) and questions (question_id, atomic_claim_id, text).

    A query id that occurs again keeps its first text, claims before questions.
    """
    a = claims.select(F.col("claim_id").alias("atomic_claim_id"), F.lit(None).cast("string").alias("question_id"), "text", F.lit("CLAIM").alias("origin"))
    q = questions.select("atomic_claim_id", "question_id", "text", F.lit("QUESTION").alias("origin"))
    both = a.unionByName(q).withColumn("query_id", content_id(F.col("atomic_claim_id"), F.col("origin"), F.coalesce("question_id", F.lit("")), F.col("text")))
    first = Window.partitionBy("query_id").orderBy("origin", "question_id", "text")
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("query_id", "text", "atomic_claim_id", "question_id", "origin")


def probe_questions(claims: DataFrame) -> DataFrame:
    """(question_id, atomic_claim_id, text, index): one scripted question per claim, where no model is at hand."""
    text = F.concat(F.lit("Is it stated that "), F.regexp_replace("text", r"[.!?]+$", ""), F.lit("?"))
    return claims.select(F.col("claim_id").alias("atomic_claim_id"), text.alias("text"), F.lit(0).alias("index")).select(content_id(F.col("atomic_claim_id"), F.col("index"), F.col("text")).alias("question_id"), "atomic_claim_id", "text", "index")


def stamp(hits: DataFrame, queries: DataFrame, source: str) -> DataFrame:
    """Hits (query_id, chunk_id, raw_score, rank) of one backend with claim and evidence_id."""
    linked = hits.join(queries.select("query_id", "atomic_claim_id"), "query_id").withColumn("source", F.lit(source))
    return linked.select(content_id(F.col("query_id"), F.col("source"), F.col("chunk_id"), F.col("rank")).alias("evidence_id"), "atomic_claim_id", "query_id", "source", "chunk_id", "raw_score", "rank")
