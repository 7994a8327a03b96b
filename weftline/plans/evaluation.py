"""Gold examples against the pipeline: reports per variant, and what each component adds."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.config import ABLATION, Evaluation, Resources, Variant, run_id
from weftline.operators import chunking, metrics
from weftline.plans.pipeline import Ledger, Steps, run
from weftline.session import cut
from weftline.sources import sinks


@dataclass(frozen=True)
class Report:
    """run: id of dataset, variant and settings. examples: one row each. verdicts, retrieval, citations: over all of them."""

    run: str
    variant: str
    examples: DataFrame
    verdicts: DataFrame
    retrieval: DataFrame
    citations: DataFrame
    ledger: Ledger


def dataset_fingerprint(examples: DataFrame) -> str:
    """Of the examples (example_id, claim, gold ..), whatever their order: hashes added up, so nothing is gathered."""
    row = examples.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("example_id", "claim", "gold").cast("decimal(38,0)")), F.lit(0))).first()
    return f"{row[0]}:{row[1]}"


def gold_chunks(spans: DataFrame, chunks: DataFrame, width: int = 700) -> DataFrame:
    """(example_id, chunk_id): chunks that any gold span (example_id, source_id, span_start, span_end) overlaps."""
    ends = chunks.select("chunk_id", "source_id", "char_start", (F.col("char_start") + F.length("text")).alias("char_end"))
    return chunking.overlapping(spans, ends, "source_id", width).select("example_id", "chunk_id").distinct()


def evaluate(examples: DataFrame, narratives: DataFrame, spans: DataFrame, variant: Variant = Variant(), res: Resources = Resources(), steps: Steps = Steps(), cfg: Evaluation = Evaluation()) -> Report:
    """The report of one variant over examples (example_id, claim, gold), narratives (source_id, cleaned_text) and gold spans (example_id, source_id, span_start, span_end).

    One run of the pipeline answers all examples. An example without a verdict counts as not judged: it has a row with a null prediction and is left out of the accuracies.
    Retrieval is measured over each example's fused chunks, the best score of a chunk found for several of its claims counting; examples without gold spans have none. With ``cfg.keep``
    the report's rows and the ledgers' fingerprints are written below ``cfg.folder``.
    """
    out = run(narratives, examples.select(F.col("example_id").alias("claim_id"), F.col("claim").alias("text")), variant, res, steps)
    of = out.claims.select(F.col("claim_id").alias("atomic_claim_id"), F.col("parent_claim_id").alias("example_id"))
    gold = cut(gold_chunks(spans, out.chunks, res.chunking.size))
    best = out.fused.join(of, "atomic_claim_id").groupBy("example_id", "chunk_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("pos", F.row_number().over(Window.partitionBy("example_id").orderBy(F.desc("score"), "chunk_id")))
    found = metrics.retrieval_metrics(ranked, gold, cfg.cutoffs, "example_id")
    cited = out.cited.join(of, "atomic_claim_id").select(F.col("example_id").alias("atomic_claim_id"), "evidence_chunk_id", "kind")
    gold_by = gold.withColumnRenamed("example_id", "atomic_claim_id")
    judged = out.verdicts.select(F.col("parent_claim_id").alias("example_id"), F.col("verdict").alias("predicted"), "fired_rule")
    prints = out.fingerprints().withColumnRenamed("parent_claim_id", "example_id").withColumnRenamed("fingerprint", "ledger_fingerprint")
    rows = examples.select("example_id", "gold").join(judged, "example_id", "left").join(found, "example_id", "left").join(prints, "example_id", "left")
    rows = cut(rows.withColumn("correct", F.col("predicted") == F.col("gold")).withColumn("variant", F.lit(variant.name)))
    pairs = rows.select("gold", "predicted")
    names = ["mrr", *[f"{m}_{k}" for k in cfg.cutoffs for m in ("recall", "precision")]]
    means = found.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in names])
    made = run_id(dataset_fingerprint(examples), variant, cfg)
    report = Report(made, variant.name, rows, metrics.verdict_metrics(pairs), means, metrics.micro_citations(cited, gold_by), out)
    if cfg.keep:
        sinks.save_report(rows, f"{cfg.folder}/reports", made)
        sinks.save_ledgers(prints.select(F.concat_ws("_", "example_id", F.lit(variant.name), "ledger_fingerprint").alias("name"), "example_id", "ledger_fingerprint"), f"{cfg.folder}/ledgers")
    return report


def ablation(examples: DataFrame, narratives: DataFrame, spans: DataFrame, variants: tuple[Variant, ...] = ABLATION, res: Resources = Resources(), steps: Steps = Steps(), cfg: Evaluation = Evaluation()) -> tuple[list[Report], DataFrame]:
    """(reports, (variant, accuracy, delta)): each variant's report, and how much accuracy the full one has beyond it."""
    if not any(v.name == "full" for v in variants):
        raise ValueError('one variant must be named "full"')
    reports = [evaluate(examples, narratives, spans, v, res, steps, cfg) for v in variants]
    rows = reduce(DataFrame.unionByName, [r.examples.select("variant", "gold", "predicted") for r in reports])
    return reports, metrics.contribution(metrics.variant_metrics(rows))


def markdown(report: Report) -> str:
    """One report as Markdown."""
    facts = {"run": report.run, "variant": report.variant, "examples": report.examples.count()}
    return sinks.render_report("Evaluation", facts, {"Verdicts": report.verdicts, "Retrieval": report.retrieval, "Citations": report.citations})
