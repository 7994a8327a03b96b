"""Problem 1: one ranking out of several differently scaled scores.

Each ranked list is brought to a common bounded scale by robust standardisation
(median and median absolute deviation of the list), a logistic squash keeps
outliers within (0, 1), and the lists of one group are combined by a weighted
geometric mean in which every list weighs the same unless weights are given.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FusionScale:
    """Parameters of the standardisation.

    floor: value of an item in a list that doesn't hold it; below what a present
        item gets unless it lies more than ``ln((1-floor)/floor)`` deviations off.
    bound: standardised values beyond it are cut before the squash (it is flat there).
    quantiles: of a list's scores, evenly spaced, from which its median and deviations are
        taken; for lists of more items both are true to half a percent of the ranks.
    accuracy: of percentile_approx, whose quantiles are exact for lists up to this size.
    """

    floor: float = 0.02
    bound: float = 30.0
    quantiles: int = 101
    accuracy: int = 1_000


def _squash(value: Column, centre: Column, mad: Column, mean_dev: Column, bound: float) -> Column:
    """Logistic of the robust z-score. Without any spread every item stands at 0.5."""
    spread = F.when(mad > 0, mad * 1.4826).when(mean_dev > 0, mean_dev * 1.2533)
    z = F.coalesce((value - centre) / spread, F.lit(0.0))
    z = F.greatest(F.least(z, F.lit(bound)), F.lit(-bound))
    return F.when(value.isNotNull(), 1 / (1 + F.exp(-z)))


def _spread(q: Column, suffix: str) -> list[Column]:
    """Median, median absolute and mean absolute deviation, from evenly spaced quantiles."""
    centre = F.element_at(q, F.ceil(F.size(q) / 2).cast("int"))
    off = F.array_sort(F.transform(q, lambda x: F.abs(x - centre)))
    mean = F.aggregate(off, F.lit(0.0), lambda acc, x: acc + x) / F.size(off)
    return [centre.alias(f"_m{suffix}"), F.element_at(off, F.ceil(F.size(off) / 2).cast("int")).alias(f"_d{suffix}"), mean.alias(f"_a{suffix}")]


def fuse_scores(
    scores: DataFrame,
    group: str,
    item: str,
    ranking: list[str],
    score: str = "raw_score",
    rank: str = "rank",
    weight: str | None = None,
    params: FusionScale = FusionScale(),
) -> DataFrame:
    """(group, item, fused_score, fused_rank, lists) over all lists of a group.

    ``ranking`` names the columns that, with the group, identify one list. Which
    direction of a score is better is read from its covariance with the rank in
    the same list (1 is best); a list without any rank counts higher as better.
    Score and rank of a list are two readings of the same judgement: each is
    standardised, and their geometric mean is the list's value for the item. A
    null, NaN or infinite score, or a null rank, leaves the other reading; an item with
    neither counts as absent from the list. An item given several times by a list
    has its best value there. Rows with a null group, item or list column are left
    out. Ties in the fused score go to the smaller item. Lists are seen whole only by grouped aggregates
    with map-side combine, so none is ever held by one task; a group's items are ordered
    by a window, one task a group, which spills, and first_chunk cuts it to the best of each partition before. An empty input gives an empty result.
    """
    finite = F.col("_s").isNotNull() & ~F.isnan("_s") & (F.abs("_s") != float("inf"))
    present = F.col(group).isNotNull() & F.col(item).isNotNull()
    for c in ranking:
        present = present & F.col(c).isNotNull()
    keys = [group, "_list"]  # with the group, 64 bits tell its lists apart
    rows = (
        scores.where(present)
        .select(group, F.xxhash64(*ranking).alias("_list"), item, F.col(score).cast("double").alias("_s"), F.col(rank).cast("double").alias("_r"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"))
        .withColumn("_s", F.when(finite, F.col("_s")))
    )
    grid = F.array(*[F.lit((i + 0.5) / params.quantiles) for i in range(params.quantiles)])
    quantiles = rows.groupBy(*keys).agg(
        F.percentile_approx("_s", grid, params.accuracy).alias("_qs"),
        F.percentile_approx("_r", grid, params.accuracy).alias("_qr"),
        F.when(F.covar_pop("_s", "_r") > 0, -1.0).otherwise(1.0).alias("_sign"),
        F.max("_w").alias("_w"),
    )
    lists = quantiles.select(*keys, "_sign", "_w", *[x for q in ("s", "r") for x in _spread(F.col(f"_q{q}"), q)])
    us = _squash(F.col("_sign") * F.col("_s"), F.col("_sign") * F.col("_ms"), F.col("_ds"), F.col("_as"), params.bound)
    ur = _squash(-F.col("_r"), -F.col("_mr"), F.col("_dr"), F.col("_ar"), params.bound)
    value = F.coalesce((F.ln(us) + F.ln(ur)) / 2, F.ln(us), F.ln(ur))
    in_list = (
        rows.drop("_w").join(lists, keys)
        .select(*keys, item, "_w", value.alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, item)
        .agg(F.max("_v").alias("_v"), F.max("_w").alias("_w"))
    )
    totals = lists.groupBy(group).agg(F.sum("_w").alias("_wt"))
    ln_floor = F.lit(params.floor)
    fused = (
        in_list.groupBy(group, item)
        .agg(F.sum(F.col("_v") * F.col("_w")).alias("_sum"), F.sum("_w").alias("_wi"), F.count("*").alias("lists"))
        .join(totals, group)
        .select(group, item, F.round(F.exp((F.col("_sum") + (F.col("_wt") - F.col("_wi")) * F.ln(ln_floor)) / F.col("_wt")), 9).alias("fused_score"), "lists")
    )
    order = Window.partitionBy(group).orderBy(F.desc("fused_score"), F.asc(item))
    return fused.withColumn("fused_rank", F.row_number().over(order))


def distinct_evidence(evidence: DataFrame) -> DataFrame:
    """Stamped evidence, each evidence_id once: of rows sent again the first that arrived. _ranking stands for (query_id, source).

    Rows without atomic_claim_id or query_id aren't stamped and are left out. Rows
    without evidence_id can't be told to be repeats and stay, exact copies once.
    """
    kept = ["atomic_claim_id", "_ranking", "chunk_id", "raw_score", "rank"]
    stamped = evidence.where("atomic_claim_id is not null and query_id is not null and source is not null and chunk_id is not null").withColumn("_ranking", F.xxhash64("query_id", "source"))
    key = F.coalesce("evidence_id", F.concat(F.lit("?"), F.xxhash64(*kept).cast("string")))
    return (
        stamped.select(key.alias("_id"), F.struct("ingested_at", *kept).alias("_row"))
        .groupBy("_id")
        .agg(F.min("_row").alias("_row"))
        .select(*[F.col(f"_row.{c}").alias(c) for c in kept])
    )


def rank_evidence(evidence: DataFrame, params: FusionScale = FusionScale()) -> DataFrame:
    """One ranking of chunks per atomic_claim_id, all (query_id, source) lists counting alike."""
    return fuse_scores(distinct_evidence(evidence), "atomic_claim_id", "chunk_id", ["_ranking"], params=params)


def rank_evidence_and_fused(evidence: DataFrame, fused: DataFrame, params: FusionScale = FusionScale()) -> DataFrame:
    """As rank_evidence, with the earlier fusion's rrf_score as one more list of each claim.

    That list counts as much as any other; null scores of it are absences.
    """
    lists = distinct_evidence(evidence)
    earlier = (
        fused.where("atomic_claim_id is not null and chunk_id is not null and rrf_score is not null")
        .select("atomic_claim_id", F.xxhash64(F.lit(""), F.lit("FUSED")).alias("_ranking"), "chunk_id", F.col("rrf_score").alias("raw_score"), F.lit(None).cast("int").alias("rank"))
        .distinct()
    )
    return fuse_scores(lists.unionByName(earlier), "atomic_claim_id", "chunk_id", ["_ranking"], params=params)


def first_chunk(ranking: DataFrame) -> DataFrame:
    """The chunk that comes first for each claim."""
    return ranking.where("fused_rank = 1").select("atomic_claim_id", "chunk_id")
