"""Problem 7: one group identifier for all records linked directly or indirectly.

Union-find runs inside bounded partitions of the pairs and keeps only each
partition's spanning forest, as stars around the smallest id. A record that several
partitions hold ties their roots together; those ties are the pairs of the next level.
Partitions of a long chain may share hardly a neighbour, so that their forests merge little: before a
level goes into partitions again, every root joins the one of its neighbours, or
itself, that comes first in a random order drawn for the level. That leaves at most three quarters of the roots on
average, whatever the graph. When the ties of a level fit one partition, a single
union-find ends the descent, and the levels are composed on the way back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, drop_cut

#: Pairs that one task joins in memory: about 16 bytes each in arrays, 100 in the tables beside them.
PARTITION_PAIRS = 1_000_000


def spanning_forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) for every node of the pairs, by union-find with path halving."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    parent = list(range(len(nodes)))
    ends = at.tolist()
    half = len(left)
    for a, b in zip(ends[:half], ends[half:]):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    roots = np.array(parent, dtype=np.int64)
    while len(roots) and not np.array_equal(roots, up := roots[roots]):
        roots = up
    return nodes, nodes[roots] if len(nodes) else nodes


def _forest_of_partition(limit: int):
    """Batches of (u, v) to (node, root), at most ``limit`` pairs joined at once.

    A partition that grew beyond the limit is worked off in pieces, each with a
    forest of its own: the ties between them are the next level's like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            node, root = spanning_forest(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])

        for b in batches:
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
            n += b.num_rows
            if n >= limit:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    return run


def _contract(ties: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """(map (node, root), ties between the roots): every node joins the first of its neighbours and itself in a random order."""
    place = lambda c: F.struct(F.xxhash64(F.lit(level), c).alias("h"), F.col(c).alias("n"))
    near = ties.unionByName(ties.select(F.col("v").alias("u"), F.col("u").alias("v")))
    first = near.groupBy("u").agg(F.min(place("v")).alias("v"))
    joined = cut(first.select(F.col("u").alias("node"), F.least("v", place("u"))["n"].alias("root")))
    end = lambda c: joined.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    moved = ties.join(end("u"), "u").join(end("v"), "v").where("ru <> rv")
    return joined, cut(moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())


def connected_components(pairs: DataFrame, left: str, right: str, partition_pairs: int = PARTITION_PAIRS, trace: list[int] | None = None) -> DataFrame:
    """(node, group): every bigint id of ``pairs`` with the smallest id it is linked to.

    Pairs in either order, repeated, or of a record with itself are allowed; a pair
    with a null end links nothing and adds no record. No pairs give no rows. A level shuffles what is left a
    fixed number of times, and the number of levels grows with the logarithm of the records, for chains too; a hub's pairs spread over all partitions, and a level
    has at most one row per record and partition that holds it. ``trace`` is given the number of ties after each level.
    """
    level = pairs.select(F.col(left).cast("bigint").alias("u"), F.col(right).cast("bigint").alias("v")).where("u is not null and v is not null")
    maps: list[DataFrame] = []
    ties_left, contracted = None, False
    while True:
        forest = level.mapInArrow(_forest_of_partition(partition_pairs), "node bigint, root bigint")
        if ties_left is not None and ties_left <= partition_pairs:
            maps.append(cut(forest))
            break
        forest = cut(forest)
        best = forest.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("last"))
        maps.append(cut(best.select("node", "root")))
        split = best.where("root < last").select("node", F.col("root").alias("u"))
        ties = cut(forest.join(split, "node").where("root <> u").select("u", F.col("root").alias("v")).distinct())
        drop_cut(forest)
        ties_left = ties.count()
        if ties_left > partition_pairs:
            joined, ties = _contract(ties, len(maps))
            maps.append(joined)
            ties_left, contracted = ties.count(), True
        if trace is not None:
            trace.append(ties_left)
        if not ties_left:
            break
        level = ties.coalesce(1) if ties_left <= partition_pairs else ties.repartition(max(2, -(-ties_left // (partition_pairs // 2))))
    groups = maps.pop()
    while maps:
        groups = (
            maps.pop().alias("m").join(groups.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
            .select("node", F.coalesce("top", "root").alias("root"))
        )
    if contracted:  # a root taken at random isn't the smallest
        groups = cut(groups)
        groups = groups.join(groups.groupBy("root").agg(F.min("node").alias("least")), "root").select("node", F.col("least").alias("root"))
    return groups.withColumnRenamed("root", "group")


def mention_links(matches: DataFrame, mentions: DataFrame) -> DataFrame:
    """(u, v) pairs of known mentions out of match rows.

    Only decision 'match' links. A row with matched_entity_id ties its mention to that
    entity: all mentions of an entity are linked to the smallest of them, so an entity
    with very many mentions is a star made by one pre-aggregated minimum.
    """
    known = mentions.where("mention_id is not null").select(F.col("mention_id").alias("id")).distinct()
    yes = matches.where("decision = 'match'")
    direct = yes.where("left_mention_id is not null and right_mention_id is not null and left_mention_id <> right_mention_id").select(
        F.least("left_mention_id", "right_mention_id").alias("u"), F.greatest("left_mention_id", "right_mention_id").alias("v")
    ).distinct()
    direct = direct.join(known.withColumnRenamed("id", "u"), "u", "left_semi").join(known.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v")
    tied = (
        yes.where("matched_entity_id is not null")
        .select("matched_entity_id", F.explode(F.array("left_mention_id", "right_mention_id")).alias("id"))
        .where("id is not null")
        .distinct()
        .join(known, "id", "left_semi")
    )
    stars = tied.join(tied.groupBy("matched_entity_id").agg(F.min("id").alias("u")), "matched_entity_id").where("id <> u").select("u", F.col("id").alias("v"))
    return direct.unionByName(stars)


def mention_groups(matches: DataFrame, mentions: DataFrame, partition_pairs: int = PARTITION_PAIRS) -> DataFrame:
    """(mention_id, group_id) of mentions in groups of two or more; the group is named by its smallest mention."""
    found = connected_components(mention_links(matches, mentions), "u", "v", partition_pairs)
    return found.select(F.col("node").alias("mention_id"), F.col("group").alias("group_id"))
