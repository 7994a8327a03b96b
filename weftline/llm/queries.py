"""The pN_ queries: each problem's operator over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.score_fusion import first_chunk, rank_evidence

    return first_chunk(rank_evidence(table(spark, d, "retrieved_evidence")))


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.score_fusion import rank_evidence_and_fused

    return rank_evidence_and_fused(table(spark, d, "retrieved_evidence"), table(spark, d, "fused_evidence"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.cross_split import repeated_claims

    pairs = repeated_claims(table(spark, d, "claim_rows"))
    return pairs.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.cross_split import overlap_report, repeated_claims

    claims = table(spark, d, "claim_rows")
    return overlap_report(claims, repeated_claims(claims))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.pieces import narrative_items, oversized_items

    return oversized_items(narrative_items(table(spark, d, "raw_documents"), table(spark, d, "document_chunks")))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.pieces import narrative_items, split_items

    return split_items(narrative_items(table(spark, d, "raw_documents"), table(spark, d, "document_chunks")).distinct())


def p3_invariants(spark: SparkSession, d: str) -> DataFrame:
    """(item_kind, item_id, n_chars, n_rows, fits): of each item whether its pieces are true slices within the limit that cover it in order with overlap."""
    from weftline.llm.pieces import PieceSize, narrative_items, split_items

    items = cut(narrative_items(table(spark, d, "raw_documents"), table(spark, d, "document_chunks")).where("length(text) > 0").distinct())
    one = items.groupBy("item_kind", "item_id").agg(F.min("text").alias("text"), F.count("*").alias("n_rows"))
    order = Window.partitionBy("item_kind", "item_id").orderBy("piece_index")
    size = PieceSize()
    p = split_items(one, size).withColumn("before", F.lag("char_end").over(order)).join(one.select("item_kind", "item_id", F.col("text").alias("whole"), "n_rows"), ["item_kind", "item_id"])
    true_slice = F.col("text") == F.substring("whole", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    shared = F.col("before") - F.col("char_start")
    joins = F.when(F.col("before").isNull(), F.col("char_start") == 0).otherwise(shared.between(1, size.overlap + size.slack))
    ok = true_slice & (F.length("text") <= size.limit) & joins
    return p.groupBy("item_kind", "item_id").agg(F.first(F.length("whole")).cast("bigint").alias("n_chars"), F.first("n_rows").alias("n_rows"), (F.bool_and(ok) & (F.max("char_end") == F.first(F.length("whole")))).alias("fits"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.group_splits import split_claims

    return split_claims(table(spark, d, "claim_rows")).select("id", "group_id")


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.group_splits import split_claims

    return split_claims(table(spark, d, "claim_rows"))


def p4_invariants(spark: SparkSession, d: str) -> DataFrame:
    """(n_ids, n_groups, torn_groups, near): whether no group is torn, and all splits are within a hundredth of all records, or the largest group, of what was asked for."""
    from weftline.llm.group_splits import SplitPlan, split_claims

    s, plan = cut(split_claims(table(spark, d, "claim_rows"))), SplitPlan()
    groups = s.groupBy("group_id").agg(F.countDistinct("new_split").alias("k"), F.count("*").alias("n"))
    told = groups.agg(F.count("*").alias("n_groups"), F.count_if(F.col("k") > 1).alias("torn_groups"), F.max("n").alias("_g"))
    held = s.agg(F.countDistinct("id").alias("n_ids"), *[F.abs(F.count_if(F.col("new_split") == name) - share * F.count("*")).alias(f"_{k}") for k, (name, share) in enumerate(zip(plan.splits, plan.proportions))])
    both = held.crossJoin(told)
    return both.select("n_ids", "n_groups", "torn_groups", (F.greatest(*[F.col(f"_{k}") for k in range(len(plan.splits))]) <= F.greatest(F.col("n_ids") / 100.0, F.col("_g") * 1.0)).alias("near"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.name_variants import variant_mentions

    return variant_mentions(table(spark, d, "raw_entity_mentions"), table(spark, d, "entity_records"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.lookalikes import match_lookalikes

    return match_lookalikes(table(spark, d, "raw_entity_mentions"), table(spark, d, "entity_records"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.lookalikes import group_lookalikes

    names = table(spark, d, "raw_entity_mentions").select("source_id", "name").unionByName(table(spark, d, "entity_records").select("source_id", F.col("canonical_name").alias("name")))
    return group_lookalikes(names, "name", ["source_id"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.components import mention_groups

    return mention_groups(table(spark, d, "mention_matches"), table(spark, d, "raw_entity_mentions"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.containers import pack

    return pack(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.containers import Packing, fill_report, pack

    return fill_report(pack(table(spark, d, "documents")), Packing().capacity)


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """(n_documents, n_rows, covered, within, whole): whether every text is packed as a whole, no container holds more than its capacity, and only texts beyond it are split."""
    from weftline.llm.containers import Packing, pack

    p, most = cut(pack(table(spark, d, "documents"))), Packing().capacity
    each = p.groupBy("doc_id", "piece", "token_start", "token_end").agg(F.count("*").alias("n")).groupBy("doc_id").agg(
        F.max("n").alias("n"), F.min("token_start").alias("lo"), F.max("token_end").alias("hi"), F.sum(F.col("token_end") - F.col("token_start")).alias("held"), F.count("*").alias("pieces")
    )
    docs = each.agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_rows"), F.bool_and((F.col("lo") == 0) & (F.col("held") == F.col("hi"))).alias("covered"), F.bool_and((F.col("pieces") == 1) | (F.col("hi") > most)).alias("whole"))
    full = p.where("container > 0 or token_end > 0").groupBy("container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("t")).agg((F.max("t") <= most).alias("within"))
    return docs.crossJoin(full).select("n_documents", "n_rows", "covered", "within", "whole")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.leaks import find_leaks

    return find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.subjects import document_subjects

    return document_subjects(table(spark, d, "documents"), table(spark, d, "subject_areas"), table(spark, d, "subject_labels")).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    from weftline.llm.subjects import corpus_composition, document_subjects

    docs = table(spark, d, "documents")
    return corpus_composition(docs, document_subjects(docs, table(spark, d, "subject_areas"), table(spark, d, "subject_labels")))


QUERIES = {f.__name__: f for f in (p1_found, p1_ranking, p2_found, p2_report, p3_found, p3_pieces, p3_invariants, p4_found, p4_splits, p4_invariants, p5_found, p6_found, p6_groups, p7_found, p8_containers, p8_fill, p8_invariants, p9_found, p10_found, p10_composition)}
