"""Jobs over a folder of tables: ``python -m weftline JOB DATA [--out FOLDER]``; every job writes or prints one result.

The session comes from spark-submit's settings; on a cluster they name spark.checkpoint.dir.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import Variant
from weftline.operators import verification as V
from weftline.plans import evaluation, model_queries, report_queries
from weftline.plans import queries as core
from weftline.plans.pipeline import run
from weftline.session import table


def _examples(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(examples, narratives, no spans) of the claim rows that have a label."""
    c = table(spark, d, "claim_rows").where("char is not null and content is not null").groupBy("id").agg(F.min(F.struct("char", "content", "label")).alias("r")).select("id", "r.*")
    label = F.lower(F.trim("label"))
    gold = F.when(label == "consistent", "CONSISTENT").when(label == "contradict", "CONTRADICTORY")
    rows = c.select(F.col("id").alias("example_id"), F.concat(F.lit("Regarding "), "char", F.lit(": "), "content").alias("claim"), gold.alias("gold")).where("gold is not null")
    spans = spark.createDataFrame([], "example_id string, source_id string, span_start int, span_end int")
    return rows, core.narratives(spark, d), spans


def verify(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of the labelled claim rows against all narratives."""
    return evaluation.evaluate(*_examples(spark, d)).examples


def ablate(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of the full pipeline and of variants without a backend or with plain fusion."""
    variants = (Variant(), Variant("no_lexical", backends=("SEMANTIC", "GRAPH")), Variant("no_graph", backends=("SEMANTIC", "LEXICAL")), Variant("no_fusion", fusion="round_robin"))
    return evaluation.ablation(*_examples(spark, d), variants)[1]


def sweep(spark: SparkSession, d: str) -> DataFrame:
    """Verdict counts over a grid of thresholds."""
    return core.threshold_sweep(spark, d)


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Each claim's best scores, for thresholds to be read from."""
    return report_queries.claim_scores(spark, d)


def missed(spark: SparkSession, d: str) -> DataFrame:
    """Contradictions that weren't found, and whether retrieval or the verifier missed them."""
    return report_queries.missed_contradictions(spark, d)


def decompose(spark: SparkSession, d: str) -> DataFrame:
    """Claims taken apart by recorded answers."""
    return model_queries.decompose_replay(spark, d)


def recall(spark: SparkSession, d: str) -> DataFrame:
    """How many chunks each backend adds to the fused ones of the claims."""
    out = run(core.narratives(spark, d), core.claims_of(spark, d).where("text is not null").select("claim_id", "text").distinct())
    kept = out.evidence.join(out.fused.select("atomic_claim_id", "chunk_id").distinct(), ["atomic_claim_id", "chunk_id"], "left_semi")
    return kept.groupBy("source").agg(F.countDistinct("atomic_claim_id").alias("n_claims"), F.countDistinct("chunk_id").alias("n_chunks"))


def histogram(spark: SparkSession, d: str) -> DataFrame:
    """Labels' scores in tenths."""
    return V.score_histogram(core.nli_labels(spark, d))


JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (verify, ablate, sweep, scores, missed, decompose, recall, histogram)}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="weftline", description="Jobs over a folder of tables.")
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("data")
    parser.add_argument("--out", help="folder for the result as parquet; else its first rows are shown")
    given = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"weftline-{given.job}").getOrCreate()
    result = JOBS[given.job](spark, given.data)
    if given.out:
        result.write.mode("overwrite").parquet(given.out)
    else:
        result.show(50, truncate=False)


if __name__ == "__main__":
    main()
