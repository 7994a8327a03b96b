"""Evaluation metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut

VERDICTS = ("CONSISTENT", "CONTRADICTORY", "INSUFFICIENT_EVIDENCE")


def confusion(pairs: DataFrame) -> DataFrame:
    """(gold, predicted, n) of pairs, nulls left out."""
    return pairs.where("gold is not null and predicted is not null").groupBy("gold", "predicted").agg(F.count("*").alias("n"))


def verdict_metrics(pairs: DataFrame) -> DataFrame:
    """(verdict, tp, fp, fn, support, precision, recall, f1, accuracy, macro_f1) of all verdicts; an undefined ratio is 0."""
    counts = confusion(pairs)
    spark = pairs.sparkSession
    labels = spark.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    n = F.col("n")
    per = labels.crossJoin(F.broadcast(counts)).groupBy("verdict").agg(
        F.sum(F.when((F.col("gold") == F.col("verdict")) & (F.col("predicted") == F.col("verdict")), n).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("gold") != F.col("verdict")) & (F.col("predicted") == F.col("verdict")), n).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("gold") == F.col("verdict")) & (F.col("predicted") != F.col("verdict")), n).otherwise(0)).alias("fn"),
        F.sum(F.when(F.col("gold") == F.col("predicted"), n).otherwise(0)).alias("right"),
        F.sum(n).alias("all"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    per = per.withColumn("p", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("r", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    per = per.withColumn("f", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    every = Window.partitionBy(F.lit(1))  # three rows
    return per.select(
        "verdict", "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"), F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round("f", 6).alias("f1"),
        F.round(ratio(F.col("right"), F.col("all")), 6).alias("accuracy"), F.round(F.avg("f").over(every), 6).alias("macro_f1"),
    )


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, cutoffs: tuple[int, ...] = (5, 10), key: str = "atomic_claim_id") -> DataFrame:
    """(key, mrr, recall_k, precision_k ..) of ranked (key, chunk_id, pos) against gold (key, chunk_id); keys without gold have no row.

    Precision divides by the number of chunks there are among the first k.
    """
    g = gold.select(key, "chunk_id").distinct()
    n = g.groupBy(key).agg(F.count("*").alias("n_gold"))
    hit = ranked.join(g.withColumn("hit", F.lit(1)), [key, "chunk_id"], "left")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    at = [F.sum(F.when(F.col("pos") <= k, F.col("hit"))).alias(f"h{k}") for k in cutoffs] + [F.count_if(F.col("pos") <= k).alias(f"c{k}") for k in cutoffs]
    per = n.join(hit.groupBy(key).agg(F.min(F.when(F.col("hit") == 1, F.col("pos"))).alias("first"), *at), key, "left")
    cols = [F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr")]
    for k in cutoffs:
        h = F.coalesce(f"h{k}", F.lit(0))
        cols += [F.round(ratio(h, F.col("n_gold")), 6).alias(f"recall_{k}"), F.round(ratio(h, F.coalesce(f"c{k}", F.lit(0))), 6).alias(f"precision_{k}")]
    return per.select(key, *cols)


def citation_metrics(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """One row over all citations, repeats counted: share that is gold, share that isn't."""
    g = gold.select("atomic_claim_id", F.col("chunk_id").alias("evidence_chunk_id")).distinct().withColumn("hit", F.lit(1))
    n = cited.join(g, ["atomic_claim_id", "evidence_chunk_id"], "left").agg(F.count("*").alias("cited"), F.count("hit").alias("grounded"))
    return n.select("cited", "grounded", F.round(F.try_divide(F.col("grounded").cast("double"), F.col("cited").cast("double")), 6).alias("citation_accuracy"), F.round(1 - F.try_divide(F.col("grounded").cast("double"), F.col("cited").cast("double")), 6).alias("hallucination_rate"))


def stage_latency(log: DataFrame, stage: str, at: str) -> DataFrame:
    """(stage, milliseconds) between the first and the last event of each stage; stage null is the whole."""
    return log.where(F.col(at).isNotNull()).groupingSets([[stage], []], stage).agg(F.timestamp_diff("MILLISECOND", F.min(at), F.max(at)).alias("milliseconds")).select(F.col(stage).alias("stage"), "milliseconds")


def micro_citations(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """citation_metrics over all runs: sums of citations by sums, so runs that cite much count more."""
    return citation_metrics(cited, gold)


def contradiction_recall(pairs: DataFrame) -> DataFrame:
    """(cdr): the share of gold contradictions that are found; null without any."""
    m = verdict_metrics(pairs).where("verdict = 'CONTRADICTORY'")
    return m.select(F.when(F.col("support") > 0, F.col("recall")).alias("cdr"))


def variant_metrics(pairs: DataFrame, variant: str = "variant") -> DataFrame:
    """(variant, n, correct, accuracy, cdr) of pairs (variant, gold, predicted), all variants in one job."""
    both = pairs.where("gold is not null and predicted is not null")
    hit = F.col("gold") == F.col("predicted")
    against = F.col("gold") == "CONTRADICTORY"
    m = both.groupBy(variant).agg(F.count("*").alias("n"), F.count_if(hit).alias("correct"), F.count_if(hit & against).alias("_h"), F.count_if(against).alias("_g"))
    return m.select(variant, "n", "correct", F.round(F.col("correct") / F.col("n"), 6).alias("accuracy"), F.round(F.try_divide(F.col("_h").cast("double"), F.col("_g").cast("double")), 6).alias("cdr"))


def contribution(per_variant: DataFrame, full: str = "full", variant: str = "variant", value: str = "accuracy") -> DataFrame:
    """(variant, value, delta): what each variant lacks against the full one; without a full variant the delta is null."""
    whole = per_variant.where(F.col(variant) == full).agg(F.max(value).alias("_full"))  # one row
    return per_variant.crossJoin(F.broadcast(whole)).select(variant, value, F.round(F.col("_full") - F.col(value), 6).alias("delta"))


def compare_verifiers(rows: DataFrame) -> DataFrame:
    """(n, changes, corrections, regressions, accuracy_a, accuracy_b) of rows (gold, a, b) that two verifiers judged; rows with a null are left out."""
    r = rows.where("gold is not null and a is not null and b is not null")
    right = lambda c: F.col(c) == F.col("gold")
    n = r.agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("changes"), F.count_if(~right("a") & right("b")).alias("corrections"), F.count_if(right("a") & ~right("b")).alias("regressions"), F.count_if(right("a")).alias("_a"), F.count_if(right("b")).alias("_b"))
    share = lambda c: F.round(F.try_divide(F.col(c).cast("double"), F.col("n").cast("double")), 6)
    return n.select("n", "changes", "corrections", "regressions", share("_a").alias("accuracy_a"), share("_b").alias("accuracy_b"))


def verdict_changes(baseline: DataFrame, other: DataFrame, key: str, verdict: str = "verdict") -> DataFrame:
    """(key, before, after) of the rows both runs have and judge differently; a null is a verdict of its own."""
    both = baseline.select(key, F.col(verdict).alias("before")).join(other.select(key, F.col(verdict).alias("after")), key)
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def missed_contradictions(verdicts: DataFrame, fused: DataFrame, claims: DataFrame) -> DataFrame:
    """(parent_claim_id, n_evidence, cause) of gold contradictions judged otherwise: no atomic claim had evidence, or the verifier missed it.

    verdicts (parent_claim_id, gold, predicted), claims (claim_id, parent_claim_id), fused (atomic_claim_id, chunk_id).
    """
    n = claims.join(fused.groupBy(F.col("atomic_claim_id").alias("claim_id")).agg(F.count("*").alias("n")), "claim_id", "left").groupBy("parent_claim_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_evidence"))
    missed = verdicts.where("gold = 'CONTRADICTORY' and predicted <> 'CONTRADICTORY'").select("parent_claim_id").distinct().join(n, "parent_claim_id", "left")
    return missed.select("parent_claim_id", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), F.when(F.coalesce("n_evidence", F.lit(0)) == 0, "retrieval").otherwise("verifier").alias("cause"))


def grounded_contradictions(examples: DataFrame, cited: DataFrame, gold: DataFrame, key: str = "example_id") -> DataFrame:
    """(key, grounded): whether a chunk cited against an example is among its gold contradicting ones; null unless its gold verdict is a contradiction with such chunks."""
    hits = cited.where("kind = 'contradiction'").select(key, "chunk_id").distinct().join(gold.select(key, "chunk_id").distinct(), [key, "chunk_id"], "left_semi").select(key, F.lit(True).alias("_hit")).distinct()
    asked = gold.select(key, F.lit(True).alias("_asked")).distinct()
    told = examples.select(key, "gold").distinct().join(asked, key, "left").join(hits, key, "left")
    return told.select(key, F.when((F.col("gold") == "CONTRADICTORY") & F.col("_asked"), F.coalesce("_hit", F.lit(False))).alias("grounded"))


def gold_sanity(pairs: DataFrame, key: str) -> DataFrame:
    """(key, sane, note) of (key, gold, predicted): a consistent claim may stay without enough evidence, but never be contradicted; the others must be met."""
    gold, got = F.col("gold"), F.col("predicted")
    tolerated = (gold == "CONSISTENT") & (got == "INSUFFICIENT_EVIDENCE")
    note = F.when(gold == got, "matched").when(tolerated, "not enough evidence, tolerated").when((gold == "CONSISTENT"), "consistent claim contradicted").otherwise(F.concat(F.lit("expected "), gold, F.lit(", got "), got))
    return pairs.where("gold is not null and predicted is not null").select(key, ((gold == got) | tolerated).alias("sane"), note.alias("note"))


def same_runs(one: DataFrame, other: DataFrame, key: str, fingerprint: str = "fingerprint") -> DataFrame:
    """(n, same, every_same): how many keys of two runs have equal fingerprints; a key only one has is not the same."""
    both = one.select(key, F.col(fingerprint).alias("_a")).join(other.select(key, F.col(fingerprint).alias("_b")), key, "full")
    n = both.agg(F.count("*").alias("n"), F.count_if(F.col("_a") == F.col("_b")).alias("same"))
    return n.select("n", "same", (F.col("n") == F.col("same")).alias("every_same"))


def call_cost(texts: DataFrame, key: str, text: str, answer_tokens: int, price_in: float, price_out: float) -> DataFrame:
    """(key, calls, tokens, cost) of one call per text: about four characters a token, at least one, and prices per million tokens."""
    n = texts.select(key, F.greatest(F.lit(1), F.floor(F.length(text) / 4)).alias("_t"))
    per = n.groupBy(key).agg(F.count("*").alias("calls"), F.sum("_t").cast("bigint").alias("tokens"))
    return per.select(key, "calls", "tokens", F.round(F.col("tokens") * price_in / 1e6 + F.col("calls") * answer_tokens * price_out / 1e6, 6).alias("cost"))


def stratified_sample(rows: DataFrame, n: int, strata: list[str], key: str) -> DataFrame:
    """At most ``n`` rows spread over the strata in proportion, each stratum's first by key; the last stratum takes what is left.

    Shares are rounded half to even.
    """
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("g"))
    w = Window.orderBy(*[F.col(c).asc_nulls_first() for c in strata])  # one row per stratum
    total = Window.partitionBy(F.lit(1))
    quota = sizes.withColumn("q", F.bround(F.lit(float(n)) * F.col("g") / F.sum("g").over(total), 0).cast("bigint")).withColumn("i", F.row_number().over(w)).withColumn("m", F.count("*").over(total))
    before = F.coalesce(F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = quota.withColumn("q", F.when(F.col("i") == F.col("m"), F.greatest(F.lit(n) - before, F.lit(0))).otherwise(F.col("q"))).select(*[F.col(c).alias(f"_{c}") for c in strata], "q")
    same = None
    for c in strata:
        t = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = t if same is None else same & t
    pos = Window.partitionBy(*strata).orderBy(key)
    return rows.withColumn("_pos", F.row_number().over(pos)).join(quota, same).where(F.col("_pos") <= F.col("q")).select(rows.columns)


def order_statistics(values: DataFrame, column: str) -> DataFrame:
    """(n, least, median, p95, most, mean): each an element of the sorted values at floor(share * n).

    Values are counted, and counts summed over ranges of values first, so that only the range that holds an element is sorted through, not all distinct values.
    """
    n = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    spans = cut(n.repartitionByRange(column).select(column, "c", F.spark_partition_id().alias("_p")))  # read twice, so the ranges have to be settled
    before = spans.groupBy("_p").agg(F.sum("c").alias("_c"), F.min(column).alias("_v"))  # one row per partition
    before = before.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("_c").over(Window.partitionBy(F.lit(1))))
    run = spans.join(F.broadcast(before.select("_p", "_before", "n")), "_p").withColumn("upto", F.col("_before") + F.sum("c").over(Window.partitionBy("_p").orderBy(column)))
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("n") * share), F.col(column)))
    return run.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.min(column).alias("least"), at(0.5).alias("median"), at(0.95).alias("p95"), F.max(column).alias("most"), F.round(F.sum(F.col(column) * F.col("c")) / F.sum("c"), 6).alias("mean"))
