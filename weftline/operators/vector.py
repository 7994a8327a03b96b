"""Dense vectors: exact k-nearest neighbours in blocks, hashed bags of words, cache-through embedding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import tokens

#: Queries sent to all executors at once, with 1,024 dimensions about 80 MB, and of these how many are multiplied with a batch at once.
QUERY_BLOCK, QUERY_SLICE = 10_000, 500

#: Of so many vectors one is in the sample that says how near a neighbour has to be, where that leaves LEAST_SAMPLE of them.
SAMPLED, LEAST_SAMPLE = 8, 1_000


def sampled(rows: DataFrame, key: str, n: int) -> DataFrame:
    """About one in SAMPLED of the ``n`` rows, by the hash of their key; of few rows more, or all."""
    part = max(1, min(SAMPLED, n // LEAST_SAMPLE))
    return rows.where(F.pmod(F.xxhash64(key), F.lit(part)) == 0)


def best_of(r: np.ndarray, c: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the hits (r, c, s) the k with the highest s of each r, ties by c."""
    order = np.lexsort((c, -s, r))
    r, c, s = r[order], c[order], s[order]
    kept = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[kept], c[kept], s[kept]


def kth_best(hits: DataFrame, k: int, n: int) -> np.ndarray:
    """The k-th highest score of each of ``n`` queries among hits (q, key, score), minus infinity where there are fewer.

    Hits of any part of all rows give a bound that the k best of all rows can't be below.
    """
    found = hits.groupBy("q").agg(F.sort_array(F.collect_list("score"), False).alias("s")).where(F.size("s") >= k).select("q", F.col("s")[k - 1].alias("s")).toArrow()
    out = np.full(n, -np.inf)
    out[found.column("q").to_numpy()] = found.column("s").to_numpy()
    return out


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _cosines(sent, k: int):
    """Partition of vectors (key, vector) to the rows (q, key, score) that can be among the k nearest of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, q, least = sent.value
        dims = q.shape[1]
        low, margin = q.astype(np.float32), 1e-6 + dims * 2.4e-7  # of 32 bits: only to find what is compared in full
        for b in batches:
            b = b.filter(pc.is_valid(b.column(1)))
            if not b.num_rows:
                continue
            b = b.take(pc.sort_indices(b.column(0)))  # ties by key
            x = _unit(b.column(1), dims)
            real = np.flatnonzero(x.any(axis=1))
            own = np.array([place.get(i, -1) for i in b.column(0).to_pylist()])[real]
            x, keys = x[real], b.column(0).take(pa.array(real))
            if not len(x):
                continue
            x32, n = np.ascontiguousarray(x.astype(np.float32).T), min(k + 1, len(x))  # one more for the query itself
            for first in range(0, len(q), QUERY_SLICE):
                s, known = low[first : first + QUERY_SLICE] @ x32, least[first : first + QUERY_SLICE]
                if np.isinf(known).any():
                    known = np.maximum(known, np.partition(s, len(x) - n, axis=1)[:, len(x) - n] - margin)
                r, c = np.divmod(np.flatnonzero(s >= (known - margin).astype(np.float32)[:, None]), len(x))
                r += first
                apart = own[c] != r
                r, c = r[apart], c[apart]
                exact = np.round(np.einsum("ij,ij->i", q[r], x[c]), 6)
                near = exact >= least[r]
                r, c, exact = best_of(r[near], c[near], exact[near], k)
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), keys.take(pa.array(c)), pa.array(exact)], ["q", "key", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, key, cosine, rank): the k nearest of all vectors for each query vector, itself left out, ties by key.

    Exact. Queries go out in blocks of bounded size; a sample of the vectors tells each query how near its k-th neighbour is at least, then every
    partition multiplies its vectors with a block and passes on, of what is as near, at most k per query.
    Null vectors and zero vectors are nobody's neighbour.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("q"), F.col(vector).alias("v"))
    blocks = max(1, -(-asked.count() // block))
    given = vectors.select(key, vector)
    some, schema = sampled(given, key, given.count()), f"q int, key {kind}, score double"
    found = None
    for i in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).toArrow().combine_chunks()  # about ``block`` rows
        if not held.num_rows:
            continue
        ids, v = held.column("q").combine_chunks(), held.column("v").combine_chunks()
        q, place = _unit(v, len(v[0])), {x: j for j, x in enumerate(ids.to_pylist())}
        bound = kth_best(some.mapInArrow(_cosines(spark.sparkContext.broadcast((place, q, np.full(len(q), -np.inf))), k), schema), k, len(q))
        hits = given.mapInArrow(_cosines(spark.sparkContext.broadcast((place, q, bound)), k), schema)
        order = Window.partitionBy("q").orderBy(F.desc("score"), "key")
        best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        named = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(q), dtype=np.int32)), "query_id": ids}))
        part = best.join(F.broadcast(named), "q").select(F.col("query_id").cast(kind), F.col("key").alias(key), F.col("score").alias("cosine"), "rank")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.select(F.col(key).alias("query_id"), key, F.lit(0.0).alias("cosine"), F.lit(0).alias("rank")).limit(0)
    return found


def hashed_embedding(texts: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """(key, dim, weight): unit-length bag of words, a word's dimension being its SHA-256 modulo ``dims`` (at most 256, a power of two)."""
    digest = F.sha2(F.col("w"), 256)
    dim = (F.conv(F.substring(digest, 63, 2), 16, 10).cast("int") % dims).alias("dim")
    n = texts.select(key, F.explode(tokens(F.col(text))).alias("w")).select(key, dim).groupBy(key, "dim").agg(F.count("*").alias("n"))
    length = n.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    return n.join(length, key).select(key, "dim", F.round(F.col("n") / F.col("length"), 9).alias("weight"))


def hashed_vectors(texts: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """(key, embedding): the hashed embeddings as arrays of ``dims`` numbers, for nearest; texts without a word have none."""
    at = hashed_embedding(texts, key, text, dims).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("dim", "weight"))).alias("at"))
    return at.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.col("at")[i], F.lit(0.0))).alias("embedding"))


class HashedEmbedder:
    """An Embedder of hashed bags of words, as hashed_embedding makes them, for where no model is at hand."""

    def __init__(self, dims: int = 64) -> None:
        self.dims, self._dim = dims, {}

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        if not texts:
            raise ValueError("nothing to embed")
        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            for w in re.findall(r"[a-z0-9]+", t.lower()):
                if w not in self._dim:
                    self._dim[w] = hashlib.sha256(w.encode()).digest()[-1] % self.dims
                out[i, self._dim[w]] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def cache_misses(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Distinct texts that the cache doesn't hold: the only ones to compute."""
    return texts.where(F.col(text).isNotNull()).select(text).distinct().join(cache.select(text), text, "left_anti")
