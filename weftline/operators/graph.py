"""Entity graphs: co-occurrence, collapse of relations, bounded traversal, topology, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import content_id, mentions
from weftline.operators.vector import best_of
from weftline.session import cut


def chunk_mentions(chunks: DataFrame, least: int = 2) -> DataFrame:
    """(chunk_id, chunk_pos, mention_pos, surface, name): mentions of each chunk; ``chunks`` has a column pos for their order."""
    return chunks.select("chunk_id", F.col("pos").alias("chunk_pos"), F.posexplode(mentions(F.col("text"), least)).alias("mention_pos", "surface")).withColumn("name", F.lower("surface"))


def entities_of(found: DataFrame) -> DataFrame:
    """(name, entity_id, canonical_name): one entity per lower-cased name, its id from the surface seen first."""
    first = found.groupBy("name").agg(F.min_by("surface", F.struct("chunk_pos", "mention_pos")).alias("canonical_name"))
    return first.select("name", content_id(F.col("canonical_name"), F.lit("OTHER")).alias("entity_id"), "canonical_name")


def cooccurrence(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(subject_entity_id, object_entity_id, weight): pairs of entities in a chunk, smaller id first, by number of chunks.

    A chunk has at most as many mentions as its bounded text holds, so its pairs are bounded too.
    """
    at = found.join(entities, "name").select("chunk_id", "entity_id").distinct()
    pairs = at.alias("a").join(at.alias("b"), "chunk_id").where("a.entity_id < b.entity_id")
    return pairs.groupBy(F.col("a.entity_id").alias("subject_entity_id"), F.col("b.entity_id").alias("object_entity_id")).agg(F.count("*").alias("weight"))


def entity_provenance(mentions: DataFrame, key: str = "entity_id") -> DataFrame:
    """(key, provenance, n_places): the distinct places (chunk_id, char_start, char_end) of each entity in order.

    Rows are made distinct before they are gathered, so an entity holds one entry a place, however often it was written.
    """
    places = mentions.select(key, "chunk_id", "char_start", "char_end").distinct()
    return places.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_id", "char_start", "char_end"))).alias("provenance"), F.count("*").alias("n_places"))


def collapse_relations(relations: DataFrame, provenance: str | None = None) -> DataFrame:
    """(subject, object, relation_type, weight[, provenance]) of directed typed relations (subject, object, relation_type, weight ..): one edge per unordered pair.

    Type, subject and object are those of the relation whose type comes first (of several, the smaller subject); weights add up, and
    the sets of places in the column ``provenance`` are united in order. Relations of an entity with itself are left out.
    """
    ends = relations.where("subject <> object").withColumn("_low", F.least("subject", "object")).withColumn("_high", F.greatest("subject", "object"))
    first = F.min(F.struct("relation_type", "subject", "object"))
    more = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(provenance)))).alias("provenance")] if provenance else []
    edges = ends.groupBy("_low", "_high").agg(first.alias("_f"), F.sum("weight").alias("weight"), *more)
    return edges.select("_f.subject", "_f.object", "_f.relation_type", "weight", *(["provenance"] if provenance else []))


def neighbours(edges: DataFrame) -> DataFrame:
    """(entity_id, neighbour_id, weight) of edges, once from either end."""
    turned = edges.select(F.col("object_entity_id").alias("entity_id"), F.col("subject_entity_id").alias("neighbour_id"), "weight")
    return edges.select(F.col("subject_entity_id").alias("entity_id"), F.col("object_entity_id").alias("neighbour_id"), "weight").unionByName(turned)


def entity_by_name(names: DataFrame, entities: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with entity_id: the entity of that name, whatever the case; of several the last by id."""
    known = entities.groupBy(F.lower("canonical_name").alias("_n")).agg(F.max("entity_id").alias("entity_id"))
    return names.join(known, F.lower(F.col(name)) == F.col("_n"), "left").drop("_n")


def entry_entities(queries: DataFrame, entities: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, entity_id): entities whose name a query mentions, whatever the case."""
    asked = queries.select("query_id", F.explode(mentions(F.col("text"), least)).alias("m")).select("query_id", F.lower("m").alias("name")).distinct()
    return asked.join(entities, "name").select("query_id", "entity_id").distinct()


def traverse(entry: DataFrame, edges: DataFrame, places: DataFrame, hops: int, top_k: int) -> DataFrame:
    """(query_id, chunk_id, raw_score, rank): chunks of entities within ``hops`` of a query's entry entities.

    Entry entities count 1 for each of their places (entity_id, chunk_id, ..); one first reached at hop h
    counts the weight of its edge to the smallest frontier entity by 1 + h. Each entity counts once. Queries
    without an entry entity have no row. Unrolled joins: a frontier that has become empty costs little.
    """
    both = edges.select(F.col("subject_entity_id").alias("entity_id"), F.col("object_entity_id").alias("next"), "weight").unionByName(edges.select(F.col("object_entity_id").alias("entity_id"), F.col("subject_entity_id").alias("next"), "weight"))
    seen = entry.select("query_id", "entity_id", F.lit(1.0).alias("gain"))
    frontier = entry.select("query_id", "entity_id")
    for hop in range(1, hops + 1):
        reached = frontier.join(both, "entity_id").groupBy("query_id", "next").agg(F.min_by("weight", "entity_id").alias("weight"))
        new = reached.select("query_id", F.col("next").alias("entity_id"), (F.col("weight") / (1 + hop)).alias("gain")).join(seen.select("query_id", "entity_id"), ["query_id", "entity_id"], "left_anti")
        seen = seen.unionByName(new)
        frontier = new.select("query_id", "entity_id")
    return _ranked(cut(seen), places, top_k)


#: Rows (query, entity, gain) sent to all executors at once, about 30 bytes each, and sums of gains that a task makes at once.
WALK_ROWS, WALK_SUMS = 400_000, 4_000_000


def _gathered(sent, k: int):
    """Partition of chunks (chunk_id, entities) to the rows (q, key, score) that can be among the best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bounds, query, gain, n_queries = sent.value
        for b in batches:
            b = b.take(pc.sort_indices(b.column(0)))  # ties by id
            at = pc.index_in(b.column(1).flatten(), known)
            there = at.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))[there]
            entity = at.drop_null().to_numpy(zero_copy_only=False)
            count = bounds[entity + 1] - bounds[entity]
            done = np.concatenate([[0], np.cumsum(np.bincount(row, count, minlength=b.num_rows))])
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(done, done[lo] + WALK_SUMS, side="right")) - 1)
                x, y = np.searchsorted(row, [lo, hi])
                n, times = hi - lo, count[x:y]
                entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - bounds[entity[x:y]], times)
                place = query[entry] * np.int64(n) + np.repeat(row[x:y] - lo, times)
                if n * n_queries <= 4 * len(place):
                    hit = np.flatnonzero(np.bincount(place, minlength=n * n_queries))
                    score = np.bincount(place, gain[entry], minlength=n * n_queries)[hit]
                else:
                    hit, own = np.unique(place, return_inverse=True)
                    score = np.bincount(own, gain[entry], minlength=len(hit))
                r, c, score = best_of(hit // n, hit % n, np.round(score, 6), k)
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), b.column(0).take(pa.array(c + lo)), pa.array(score)], ["q", "key", "score"])
                lo = hi

    return run


def _ranked_pass(own: DataFrame, held: DataFrame, top_k: int) -> DataFrame | None:
    """_ranked of the gains of one pass, over ``held`` (chunk_id, entities)."""
    spark, kinds = own.sparkSession, {"query_id": own.schema["query_id"].dataType.simpleString(), "chunk_id": held.schema["chunk_id"].dataType.simpleString()}
    ids = own.select("query_id").distinct().toArrow().column(0).combine_chunks()
    if not len(ids):
        return None
    named = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(ids), dtype=np.int32)), "query_id": ids}))
    gains = own.join(F.broadcast(named), "query_id").select("q", "entity_id", "gain").toArrow()
    known = gains.column("entity_id").unique()
    entity = pc.index_in(gains.column("entity_id"), known).to_numpy()
    order = np.argsort(entity, kind="stable")
    sent = spark.sparkContext.broadcast((known, np.searchsorted(entity[order], np.arange(len(known) + 1)), gains.column("q").to_numpy()[order], gains.column("gain").to_numpy()[order], len(ids)))
    hits = held.mapInArrow(_gathered(sent, top_k), f"q int, key {kinds['chunk_id']}, score double")
    top = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= top_k)
    return top.join(F.broadcast(named), "q").select(F.col("query_id").cast(kinds["query_id"]), F.col("key").alias("chunk_id"), F.col("score").alias("raw_score"), "rank")


def _ranked(seen: DataFrame, places: DataFrame, top_k: int) -> DataFrame:
    """(query_id, chunk_id, raw_score, rank): the chunks with the highest sums of the gains of ``seen`` (query_id, entity_id, gain).

    Gains go out in passes of about WALK_ROWS; each partition of chunks adds them up and passes on top_k per query, so the rows of a name that is in every chunk are never shuffled.
    """
    held = cut(places.where("entity_id is not null").groupBy("chunk_id").agg(F.collect_list("entity_id").alias("entities")))
    passes = -(-seen.count() // WALK_ROWS)
    found = None
    for i in range(passes):
        part = _ranked_pass(seen.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i), held, top_k)
        found = part if found is None else found if part is None else found.unionByName(part)
    if found is None:
        return seen.crossJoin(held.select("chunk_id")).select("query_id", "chunk_id", F.lit(0.0).alias("raw_score"), F.lit(0).alias("rank")).limit(0)
    return found


def topology(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(n_entities, n_relations, n_components, density, average_degree); an entity without an edge is a component of its own."""
    labels = component_labels(edges, "subject_entity_id", "object_entity_id")
    tied = labels.agg(F.count("*").alias("_tied"), F.countDistinct("label").alias("_groups"))
    n = entities.agg(F.count("*").alias("n_entities")).crossJoin(edges.agg(F.count("*").alias("n_relations"))).crossJoin(tied).withColumn("n_components", F.col("n_entities") - F.col("_tied") + F.col("_groups"))
    n_, m = F.col("n_entities"), F.col("n_relations")
    return n.select("n_entities", "n_relations", "n_components", F.round(F.coalesce(F.try_divide(2.0 * m, (n_ * (n_ - 1)).cast("double")), F.lit(0.0)), 9).alias("density"), F.round(F.coalesce(F.try_divide(2.0 * m, n_.cast("double")), F.lit(0.0)), 6).alias("average_degree"))


#: Edges that one task joins in memory, about 300 bytes each.
TASK_EDGES = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) edges of one task to (node, label), each node with the smallest it is connected with."""
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not held:
        return
    nodes, at = np.unique(np.concatenate([x for pair in held for x in pair]), return_inverse=True)
    sizes = [len(x) for pair in held for x in pair]
    parts = np.split(at, np.cumsum(sizes)[:-1])
    left, right = np.concatenate(parts[::2]), np.concatenate(parts[1::2])
    label = np.arange(len(nodes))
    while len(left):  # every node takes the smallest label beside it, then its label's label
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
    while not np.array_equal(label, up := label[label]):
        label = up
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "label"])


def component_labels(edges: DataFrame, left: str, right: str, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, label): smallest node each node is connected with.

    Up to ``task_edges`` different edges are joined in one task. More go through alternating large and small stars: each round links the neighbours of a node to the smallest of them; edges stay at most as many
    as they were, distances halve, and a round that changes no edge ends it. Both give the same labels.
    """
    given = cut(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u is not null and v is not null").distinct())
    if given.count() <= task_edges:
        kind = given.schema["u"].dataType.simpleString()
        return given.coalesce(1).mapInArrow(_joined, f"node {kind}, label {kind}")
    nodes = given.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e, state = given.where("u <> v"), None
    while True:
        near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return nodes.join(e, nodes["node"] == e["u"], "left").select("node", F.coalesce("v", "node").alias("label"))
