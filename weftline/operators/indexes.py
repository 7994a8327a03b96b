"""Indexes over chunks, searched by frames of queries: words, dense vectors, and the graph of entities."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import Graph, Retrieval
from weftline.operators import graph, lexical, vector
from weftline.session import cut


class Index(Protocol):
    """Built once from chunks (chunk_id, text, source_id, char_start); gives (query_id, chunk_id, raw_score, rank) of queries (query_id, text)."""

    def index(self, chunks: DataFrame) -> None: ...

    def query(self, queries: DataFrame, top_k: int) -> DataFrame: ...


def _checked(built: object, top_k: int) -> None:
    if built is None:
        raise ValueError("nothing is indexed")
    if top_k < 1:
        raise ValueError("top_k must be at least 1")


class LexicalIndex:
    """BM25; a query without a known word has the first chunks by id, scored 0."""

    def __init__(self, cfg: Retrieval = Retrieval()) -> None:
        self.cfg, self._chunks = cfg, None

    def index(self, chunks: DataFrame) -> None:
        self._chunks = chunks.select("chunk_id", "text")

    def query(self, queries: DataFrame, top_k: int) -> DataFrame:
        _checked(self._chunks, top_k)
        return lexical.bm25_search(queries, self._chunks, replace(self.cfg, top_k=top_k))


class DenseIndex:
    """Exact cosine over vectors of ``vectorise`` (texts, key, text) to (key, embedding); a chunk indexed again has its new vector."""

    def __init__(self, vectorise: Callable[[DataFrame, str, str], DataFrame] = vector.hashed_vectors) -> None:
        self.vectorise, self._vectors = vectorise, None

    def index(self, chunks: DataFrame) -> None:
        made = cut(self.vectorise(chunks.select("chunk_id", "text").distinct(), "chunk_id", "text"))
        if self._vectors is not None:
            made = self._vectors.join(made, "chunk_id", "left_anti").unionByName(made)
        self._vectors = made

    def query(self, queries: DataFrame, top_k: int) -> DataFrame:
        _checked(self._vectors, top_k)
        wanted = self.vectorise(queries, "query_id", "text").withColumnRenamed("query_id", "chunk_id")
        return vector.nearest(self._vectors, wanted, top_k, "chunk_id").withColumnRenamed("cosine", "raw_score")


class GraphIndex:
    """Chunks of the entities a query mentions and of their neighbours; a query that mentions none has no row.

    Queries that mention the same entities are walked once.
    """

    def __init__(self, cfg: Graph = Graph()) -> None:
        self.cfg, self._entities = cfg, None

    def index(self, chunks: DataFrame) -> None:
        found = cut(graph.chunk_mentions(chunks.select("chunk_id", "text", F.struct("source_id", "char_start").alias("pos")), self.cfg.least_mention))
        entities = cut(graph.entities_of(found))
        self.load(entities, graph.cooccurrence(found, entities), found.join(entities, "name").select("entity_id", "chunk_id").distinct())

    def load(self, entities: DataFrame, edges: DataFrame, places: DataFrame) -> None:
        """A graph that is there already: entities (name, entity_id), edges (subject_entity_id, object_entity_id, weight), places (entity_id, chunk_id)."""
        self._entities, self._edges, self._places = entities, edges, places

    def query(self, queries: DataFrame, top_k: int) -> DataFrame:
        _checked(self._entities, top_k)
        entry = graph.entry_entities(queries, self._entities, self.cfg.least_mention)
        sets = cut(entry.groupBy("query_id").agg(F.array_sort(F.collect_set("entity_id")).alias("_set")))
        alike = cut(sets.groupBy("_set").agg(F.min("query_id").alias("_first")))
        walked = graph.traverse(alike.select(F.col("_first").alias("query_id"), F.explode("_set").alias("entity_id")), self._edges, self._places, self.cfg.max_hops, top_k)
        return sets.join(alike, "_set").select("query_id", "_first").join(walked.withColumnRenamed("query_id", "_first"), "_first").drop("_first")
