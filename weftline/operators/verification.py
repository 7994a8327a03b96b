"""Labels of claim-evidence pairs, classification of claims, verdicts, and sweeps over thresholds."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.config import Rules
from weftline.functions.text import tokens


# What a pair's label says of the claim as a fact.
FACT_LABELS = {"ENTAILMENT": "SUPPORTED", "CONTRADICTION": "CONTRADICTED", "NEUTRAL": "NOT_MENTIONED"}


def lexical_labels(pairs: DataFrame, premise: str = "premise", hypothesis: str = "hypothesis") -> DataFrame:
    """``pairs`` with label and score by the share of the hypothesis's words the premise holds.

    Stands in where no model is at hand: half or more is ENTAILMENT, under a
    tenth CONTRADICTION, else NEUTRAL; the score is the share on that side. A model goes in
    its place as a pandas UDF of the same two columns.
    """
    asked = F.array_distinct(tokens(F.col(hypothesis)))
    share = F.coalesce(F.size(F.array_intersect(asked, tokens(F.col(premise)))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))
    out = pairs.withColumn("_share", F.round(share, 6))
    label = F.when(F.col("_share") >= 0.5, "ENTAILMENT").when(F.col("_share") < 0.1, "CONTRADICTION").otherwise("NEUTRAL")
    score = F.when(F.col("_share") < 0.1, F.round(1 - F.col("_share"), 6)).otherwise(F.col("_share"))
    return out.withColumn("label", label).withColumn("score", score).drop("_share")


class LexicalScorer:
    """lexical_labels as a PairScorer."""

    def score(self, premises: Sequence[str], hypotheses: Sequence[str]) -> list[tuple[str, float]]:
        out = []
        for p, h in zip(premises, hypotheses):
            asked = set(re.findall(r"[a-z0-9]+", h.lower()))
            share = round(len(asked & set(re.findall(r"[a-z0-9]+", p.lower()))) / len(asked), 6) if asked else 0.0
            out.append(("CONTRADICTION", round(1 - share, 6)) if share < 0.1 else ("ENTAILMENT" if share >= 0.5 else "NEUTRAL", share))
        return out


def _strong(label: str, threshold: Column | float) -> Column:
    return (F.col("label") == label) & (F.col("score") >= threshold)


def classify(claims: DataFrame, results: DataFrame, rules: Rules = Rules(), also: list[str] = []) -> DataFrame:  # noqa: B006
    """(claim_id, .., status): a strong contradiction outweighs support; neither, or no result at all, is UNRESOLVED.

    ``also`` names further key columns of ``results``, such as the thresholds of a sweep.
    """
    best = results.groupBy("atomic_claim_id", *also).agg(
        F.bool_or(_strong("CONTRADICTION", rules.contradiction)).alias("_c"), F.bool_or(_strong("ENTAILMENT", rules.entailment)).alias("_e")
    )
    status = F.when(F.coalesce("_c", F.lit(False)), "CONTRADICTED").when(F.coalesce("_e", F.lit(False)), "SUPPORTED").otherwise("UNRESOLVED")
    return claims.join(best.withColumnRenamed("atomic_claim_id", "claim_id"), ["claim_id", *also], "left").withColumn("status", status).drop("_c", "_e")


def cited_evidence(classified: DataFrame, results: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(atomic_claim_id, evidence_chunk_id, kind, nli_score, explanation) behind CONTRADICTED and SUPPORTED claims."""
    r = results.join(classified.select(F.col("claim_id").alias("atomic_claim_id"), "status"), "atomic_claim_id")
    against = (F.col("status") == "CONTRADICTED") & _strong("CONTRADICTION", rules.contradiction)
    support = (F.col("status") == "SUPPORTED") & _strong("ENTAILMENT", rules.entailment)
    # The wording of both explanations.
    text = F.when(against, F.format_string("NLI contradiction (score=%.3f) against evidence chunk '%s'.", "score", "evidence_chunk_id")).otherwise(F.format_string("NLI entailment (score=%.3f) from evidence chunk '%s'.", "score", "evidence_chunk_id"))
    return r.where(against | support).select("atomic_claim_id", "evidence_chunk_id", F.when(against, "contradiction").otherwise("support").alias("kind"), F.col("score").alias("nli_score"), text.alias("explanation"))


def verdicts(classified: DataFrame, rules: Rules = Rules(), key: list[str] = ["parent_claim_id"]) -> DataFrame:  # noqa: B006
    """One verdict per set of claims: contradicted, else (strictly) unresolved, else consistent."""
    n = classified.groupBy(*key).agg(F.count_if(F.col("status") == "CONTRADICTED").alias("n_contradicted"), F.count_if(F.col("status") == "UNRESOLVED").alias("n_unresolved"), F.count("*").alias("n_claims"))
    open_, against = F.col("n_unresolved") > 0, F.col("n_contradicted") > 0
    blocked = open_ & F.lit(rules.strict)
    verdict = F.when(against, "CONTRADICTORY").when(blocked, "INSUFFICIENT_EVIDENCE").otherwise("CONSISTENT")
    fired = F.when(against, "rule_1_contradiction").when(blocked, "rule_2_unresolved").when(open_, "rule_3_no_contradiction").otherwise("rule_3_all_supported")
    return n.withColumn("verdict", verdict).withColumn("fired_rule", fired)


def without_claims(parents: DataFrame, classified: DataFrame, key: str = "parent_claim_id") -> DataFrame:
    """(key, reason) of the sets that have no claim to judge: they get no verdict."""
    return parents.select(key).distinct().join(classified.select(key).distinct(), key, "left_anti").withColumn("reason", F.lit("no claims"))


def claim_scores(claims: DataFrame, results: DataFrame) -> DataFrame:
    """(claim_id, n_results, best_contradiction, best_entailment, margin): each claim's scores, for thresholds to be read from; claims without results are there too."""
    best = lambda label: F.max(F.when(F.col("label") == label, F.col("score")))
    per = results.groupBy(F.col("atomic_claim_id").alias("claim_id")).agg(F.count("*").alias("n_results"), best("CONTRADICTION").alias("best_contradiction"), best("ENTAILMENT").alias("best_entailment"))
    out = claims.select("claim_id").distinct().join(per, "claim_id", "left")
    return out.select("claim_id", F.coalesce("n_results", F.lit(0)).alias("n_results"), "best_contradiction", "best_entailment", F.round(F.col("best_contradiction") - F.col("best_entailment"), 6).alias("margin"))


def sweep(claims: DataFrame, results: DataFrame, contradiction: list[float], entailment: list[float], strict: bool = True) -> DataFrame:
    """Verdict counts at every point of the threshold grid, in one job; the grid is a broadcast of a few rows.

    Only each claim's best score per label matters, so results are reduced before they meet the grid.
    """
    spark = claims.sparkSession
    grid = spark.createDataFrame([(c, e) for c in contradiction for e in entailment], "t_contradiction double, t_entailment double")
    best = results.groupBy(F.col("atomic_claim_id").alias("claim_id")).agg(F.max(F.when(F.col("label") == "CONTRADICTION", F.col("score"))).alias("c"), F.max(F.when(F.col("label") == "ENTAILMENT", F.col("score"))).alias("e"))
    per = claims.join(best, "claim_id", "left").crossJoin(F.broadcast(grid))
    status = F.when(F.col("c") >= F.col("t_contradiction"), "CONTRADICTED").when(F.col("e") >= F.col("t_entailment"), "SUPPORTED").otherwise("UNRESOLVED")
    found = verdicts(per.withColumn("status", status), Rules(strict=strict), ["t_contradiction", "t_entailment", "parent_claim_id"])
    return found.groupBy("t_contradiction", "t_entailment", "verdict").agg(F.count("*").alias("n"))


def score_histogram(results: DataFrame) -> DataFrame:
    """(label, bucket, n) in tenths."""
    return results.groupBy("label", F.round(F.floor(F.col("score") * 10) / 10, 1).alias("bucket")).agg(F.count("*").alias("n"))
