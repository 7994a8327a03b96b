"""Problem 4: train, validation and test splits that keep related records together.

Records related through equal book_name or char, directly or through others, form
components. Components start in hashed splits; annealing then moves single components
and exchanges pairs between splits to reduce the deviation of sizes and labels.
Chains run in parallel, over buckets of components and with several seeds; the best
of each bucket is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import connected_components
from weftline.session import cut


@dataclass(frozen=True)
class SplitPlan:
    """splits and proportions: what is asked for. labels: balanced ones, others count as one more.
    bucket: components one chain works on. chains: seeds per bucket. sweeps: steps per component.
    large: components over 1/large of all records (so fewer than ``large``) are settled first, together.
    """

    splits: tuple[str, ...] = ("train", "validation", "test")
    proportions: tuple[float, ...] = (0.8, 0.1, 0.1)
    labels: tuple[str, ...] = ("consistent", "contradict")
    bucket: int = 20_000
    chains: int = 4
    sweeps: int = 30
    large: int = 2_000
    seed: int = 7

    def __post_init__(self) -> None:
        if len(self.splits) != len(self.proportions) or abs(sum(self.proportions) - 1) > 1e-9 or min(self.proportions) <= 0:
            raise ValueError("proportions must be positive, one per split, and sum to 1")


def written_value(column: str) -> Column:
    """A value as compared: case and leading, trailing or repeated blanks don't count; blanks only are null."""
    tidy = F.trim(F.regexp_replace(F.lower(F.col(column)), r"(?U)\s+", " "))
    return F.when(tidy != "", tidy)


def related_groups(records: DataFrame, id_column: str, keys: list[str]) -> DataFrame:
    """(id, group_id): each record's bigint id with the smallest id of its component.

    Two records belong together when they share a written value of one of ``keys``,
    directly or through others; null connects nothing. Records that repeat an id
    give one row; ids that aren't numbers are left out. Rows are reduced to distinct
    combinations of values first, each standing for its smallest id, so a value
    held by a third of all rows costs one pair per combination, not per row.
    """
    rows = records.select(F.expr(f"try_cast({id_column} as bigint)").alias("id"), *[written_value(k).alias(f"k{i}") for i, k in enumerate(keys)]).where("id is not null")
    names = [f"k{i}" for i in range(len(keys))]
    combos = cut(rows.groupBy(*names).agg(F.min("id").alias("first")))
    linked = combos.where(F.coalesce(*names).isNotNull())
    pairs = None
    for k in names:
        held = linked.where(F.col(k).isNotNull()).select(k, "first")
        star = held.join(held.groupBy(k).agg(F.min("first").alias("u")), k).select("u", F.col("first").alias("v"))
        pairs = star if pairs is None else pairs.unionByName(star)
    groups = connected_components(pairs, "u", "v").withColumnRenamed("node", "first")
    named = linked.join(groups, "first").select(*names, "group")
    same = None
    for k in names:
        test = F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}"))
        same = test if same is None else same & test
    found = rows.alias("r").join(named.alias("g"), same, "left").select("r.id", F.coalesce("g.group", "r.id").alias("group_id"))
    return found.groupBy("id").agg(F.min("group_id").alias("group_id"))


def anneal(units: np.ndarray, start: np.ndarray, targets: np.ndarray, sweeps: int, seed: int) -> tuple[np.ndarray, float]:
    """Best assignment found of units (n x measures) to splits, and its cost.

    targets: splits x measures. Cost: sum over both of |sum - target| by the measure's total.
    Each step moves one unit to another split or exchanges two units; worse states are
    taken with a probability that falls as the temperature does. The best state at the
    end of a sweep is kept.
    """
    rng = np.random.default_rng(seed)
    n, k = units.shape[0], len(targets)
    scale = 1.0 / np.maximum(units.sum(axis=0), 1)
    sums = np.zeros(targets.shape)
    np.add.at(sums, start, units)
    gap = ((sums - targets) * scale).tolist()
    cost = sum(abs(x) for row in gap for x in row)
    best, best_cost = start.copy(), cost
    if n == 0 or k < 2:
        return best, best_cost
    rows, where = (units * scale).tolist(), start.tolist()
    measures = range(units.shape[1])
    heat = max(cost / 4, 1e-9)
    for sweep in range(sweeps):
        drawn = zip(rng.integers(0, n, n).tolist(), rng.integers(0, n, n).tolist(), rng.integers(0, k, n).tolist(), np.log(rng.random(n) + 1e-300).tolist())
        for i, j, to, luck in drawn:
            a = where[i]
            swap = a != where[j] and luck * 1e6 % 2 < 1
            b = where[j] if swap else to
            if a == b:
                continue
            delta = [x - y for x, y in zip(rows[i], rows[j])] if swap else rows[i]
            ga, gb = gap[a], gap[b]
            change = sum(abs(ga[m] - delta[m]) - abs(ga[m]) + abs(gb[m] + delta[m]) - abs(gb[m]) for m in measures)
            if change <= 0 or luck < -change / heat:
                for m in measures:
                    ga[m] -= delta[m]
                    gb[m] += delta[m]
                where[i] = b
                if swap:
                    where[j] = a
                cost += change
        if cost < best_cost - 1e-12:
            best, best_cost = np.array(where), cost
        heat *= 1e-5 ** (1 / sweeps)
    return best, best_cost


def _hashed(plan: SplitPlan) -> Column:
    """A group's first split: its hash as a share of 1 against the proportions."""
    share = (F.pmod(F.xxhash64(F.lit(plan.seed), "group_id"), F.lit(1_000_003)) + 0.5) / 1_000_003
    at, bound = F.lit(len(plan.splits) - 1), 0.0
    cases, acc = [], 0.0
    for i, p in enumerate(plan.proportions[:-1]):
        acc += p
        cases.append((i, acc))
    for i, bound in reversed(cases):
        at = F.when(share < bound, i).otherwise(at)
    return at.cast("int")


def assign_splits(records: DataFrame, groups: DataFrame, id_column: str, label: str, plan: SplitPlan = SplitPlan()) -> DataFrame:
    """(id, group_id, new_split): every record of ``groups`` in a split, no group in two.

    Labels are read without case or blanks; null and unknown ones are one further class.
    Components of very uneven size are allowed: the few large ones are settled first
    over the whole, and every bucket of small ones aims at its share of what then
    remains to each split, so a giant component is compensated by the others. Fewer
    components than splits, or no records at all, leave splits empty.
    """
    measures = ["m0", *[f"m{i + 1}" for i in range(len(plan.labels))]]
    known = records.select(F.expr(f"try_cast({id_column} as bigint)").alias("id"), written_value(label).alias("label")).where("id is not null").groupBy("id").agg(F.max("label").alias("label"))
    rows = groups.join(known, "id", "left")
    units = rows.groupBy("group_id").agg(F.count("*").alias("m0"), *[F.count_if(F.col("label") == name).alias(f"m{i + 1}") for i, name in enumerate(plan.labels)])
    units = cut(units.select("group_id", *[F.col(m).cast("double") for m in measures], _hashed(plan).alias("at")))
    total = units.agg(*[F.sum(m) for m in measures], F.count("*")).first()
    if not total[-1]:
        return rows.select("id", "group_id", F.lit(None).cast("string").alias("new_split"))
    sums = np.array(total[:-1])
    want = np.outer(plan.proportions, sums)
    cutoff = sums[0] / plan.large
    big = units.where(F.col("m0") > cutoff).orderBy("group_id").toPandas()  # fewer than plan.large rows
    big_at, _ = anneal(big[measures].to_numpy(), big["at"].to_numpy(), want, plan.sweeps * 10, plan.seed)
    settled = np.zeros_like(want)
    np.add.at(settled, big_at, big[measures].to_numpy())
    rest = sums - settled.sum(axis=0)
    left = np.maximum(want - settled, 0)
    left *= np.where(left.sum(axis=0) > 0, rest / np.maximum(left.sum(axis=0), 1e-9), 0)
    shares = left / np.maximum(rest, 1e-9)
    buckets = max(1, -(-int(total[-1]) // plan.bucket))
    small = units.where(F.col("m0") <= cutoff).withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(buckets)).cast("int"))

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group_id")
        own = pdf[measures].to_numpy()
        at, cost = anneal(own, pdf["at"].to_numpy(), shares * own.sum(axis=0), plan.sweeps, plan.seed * 1009 + int(key[0]) * 31 + int(key[1]))
        return pd.DataFrame({"bucket": key[0], "chain": key[1], "cost": cost, "group_id": pdf["group_id"].to_numpy(), "at": at})

    tried = cut(
        small.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(plan.chains - 1))))
        .groupBy("bucket", "chain")
        .applyInPandas(chain, "bucket int, chain int, cost double, group_id bigint, at int")
    )
    best = tried.groupBy("bucket", "chain").agg(F.min("cost").alias("cost")).groupBy("bucket").agg(F.min_by("chain", F.struct("cost", "chain")).alias("chain"))
    spark = records.sparkSession
    placed = tried.join(best, ["bucket", "chain"]).select("group_id", "at").unionByName(
        spark.createDataFrame(pd.DataFrame({"group_id": big["group_id"].astype("int64"), "at": np.asarray(big_at, dtype="int32")}), "group_id bigint, at int")
    )
    names = F.array(*[F.lit(s) for s in plan.splits])
    return rows.join(placed, "group_id").select("id", "group_id", F.element_at(names, F.col("at") + 1).alias("new_split"))


def claim_groups(claims: DataFrame) -> DataFrame:
    """(id, group_id) of claim_rows by book_name and char."""
    return related_groups(claims, "id", ["book_name", "char"])


def split_claims(claims: DataFrame, plan: SplitPlan = SplitPlan()) -> DataFrame:
    """(id, group_id, new_split) of claim_rows, balanced by label."""
    return assign_splits(claims, cut(claim_groups(claims)), "id", "label", plan)
