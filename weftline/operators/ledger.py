"""Integrity of a run's records, and its fingerprint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(child: DataFrame, parent: DataFrame, child_key: list[str], parent_key: list[str], constraint: str) -> DataFrame:
    """(constraint, violations): rows of ``child`` whose key ``parent`` doesn't have; a null key is a violation."""
    keys = parent.select(*[F.col(p).alias(c) for c, p in zip(child_key, parent_key)]).distinct()
    return child.join(keys, child_key, "left_anti").agg(F.count("*").alias("violations")).select(F.lit(constraint).alias("constraint"), "violations")


def repeated(rows: DataFrame, key: list[str], constraint: str) -> DataFrame:
    """(constraint, violations): keys that are written more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("violations")).select(F.lit(constraint).alias("constraint"), "violations")


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def questions_known(questions: DataFrame, claims: DataFrame) -> DataFrame:
    return missing(questions, claims, ["atomic_claim_id"], ["claim_id"], "question has a claim")


def evidence_known(evidence: DataFrame, claims: DataFrame, queries: DataFrame) -> DataFrame:
    """Evidence is stamped, and its claim and its query are recorded."""
    bare = evidence.where("atomic_claim_id is null or query_id is null").agg(F.count("*").alias("violations")).select(F.lit("evidence is stamped").alias("constraint"), "violations")
    stamped = evidence.where("atomic_claim_id is not null and query_id is not null")
    return report([bare, missing(stamped, claims, ["atomic_claim_id"], ["claim_id"], "evidence has a claim"), missing(stamped, queries, ["query_id"], ["query_id"], "evidence has a query")])


def results_known(results: DataFrame, fused: DataFrame) -> DataFrame:
    return missing(results, fused.withColumnRenamed("chunk_id", "evidence_chunk_id"), ["atomic_claim_id", "evidence_chunk_id"], ["atomic_claim_id", "evidence_chunk_id"], "result has fused evidence")


def classification_known(cited: DataFrame, unsupported: DataFrame, claims: DataFrame) -> DataFrame:
    """Cited evidence and claims without support belong to recorded claims."""
    return report([missing(cited, claims, ["atomic_claim_id"], ["claim_id"], "cited evidence has a claim"), missing(unsupported, claims, ["claim_id"], ["claim_id"], "unsupported claim is known")])


def record(table: DataFrame, rows: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(table with the new rows, refused rows): what is recorded once isn't recorded again; repeats within ``rows`` count once."""
    new = rows.distinct()
    return table.unionByName(new.join(table.select(*key).distinct(), key, "left_anti").select(table.columns)), new.join(table.select(*key).distinct(), key, "left_semi")


def add(table: DataFrame, rows: DataFrame, unique: bool = False) -> DataFrame:
    """``table`` with rows added unchecked; ``unique``: those it has already are left out, as for claims marked unsupported."""
    return table.unionByName(rows.distinct().join(table.distinct(), table.columns, "left_anti") if unique else rows)


def log_events(rows: DataFrame, stage: str, message: str) -> DataFrame:
    """(event_id, stage, message, at): one event per row; ids and times differ between runs, so no fingerprint holds them."""
    return rows.select(F.expr("uuid()").alias("event_id"), F.lit(stage).alias("stage"), F.expr(message).alias("message"), F.current_timestamp().alias("at"))


#: Parts of a ledger's fingerprint, in order.
PARTS = ("claim", "claim_id", "atomic_claims", "questions", "evidence", "fused", "results", "contradictions", "support", "unsupported", "verdict", "fired_rule")


def parts_of(key: str, **frames: DataFrame) -> DataFrame:
    """(key, part, item) rows for fingerprint; ``frames`` by the names of PARTS, each (key, item). A part a key has nothing for is there with an empty item."""
    unknown = set(frames) - set(PARTS)
    if unknown:
        raise ValueError(f"no parts of a ledger: {sorted(unknown)}")
    rows = reduce(DataFrame.unionByName, [f.select(key, F.lit(PARTS.index(name)).alias("part"), F.col("item").cast("string").alias("item")) for name, f in frames.items()])
    every = rows.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(len(PARTS) - 1))).alias("part"))
    return every.join(rows, [key, "part"], "left")


def fingerprint(parts: DataFrame, key: str) -> DataFrame:
    """(key, fingerprint) of (key, part, item): items of a part sorted and joined by commas, parts 0.. by bars; nulls are left out.

    A key is one claim's ledger, whose items are bounded by its queries and their top hits.
    """
    joined = parts.groupBy(key, "part").agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "|")
    return joined.groupBy(key).agg(F.substring(F.sha2(whole, 256), 1, 16).alias("fingerprint"))
