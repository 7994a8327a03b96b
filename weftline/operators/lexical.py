"""BM25 over chunks: corpus statistics, and batched search of all queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.config import Retrieval
from weftline.functions.text import tokens
from weftline.operators.vector import best_of, kth_best, sampled
from weftline.session import cut


def term_statistics(chunks: DataFrame, cfg: Retrieval = Retrieval()) -> tuple[DataFrame, int, float]:
    """((term, df, idf), number of chunks, their mean length): idf = ln(n - df + .5) - ln(df + .5), a negative one replaced by epsilon times the mean over all terms.

    Chunks (chunk_id, words) are counted with map-side combine by term only; the table of terms is kept, as its mean and its rows are both needed.
    """
    counts = cut(chunks.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    n, length = chunks.agg(F.count("*"), F.avg(F.size("words"))).first()
    raw = F.ln(F.lit(float(n)) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    mean = counts.agg(F.avg(raw)).first()[0] or 0.0
    return counts.select("term", "df", F.when(raw < 0, cfg.epsilon * mean).otherwise(raw).alias("idf")), n, float(length or 1.0)


def tokenised(chunks: DataFrame) -> DataFrame:
    """(chunk_id, words): tokenised once, and kept for all that is done with them."""
    return cut(chunks.select("chunk_id", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("words")))


#: Queries sent to all executors for one pass over the chunks; queries and chunks that are scored at once; the share of pairs of both with a word from which it is a frequent one.
QUERY_PASS, QUERY_SLICE, CHUNK_BLOCK, FREQUENT = 20_000, 256, 8_192, 0.003


def _postings(words: pa.Array, known: pa.Array, avgdl: float, cfg: Retrieval) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): the sorted numbers term * chunks + chunk of the terms of ``known``, with BM25's value of the term's count and the chunk's length."""
    n, length = len(words), pc.list_value_length(words).to_numpy(zero_copy_only=False)
    at = pc.index_in(words.flatten(), known)
    there = at.is_valid().to_numpy(zero_copy_only=False)
    place, tf = np.unique(at.drop_null().to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), length)[there], return_counts=True)
    return place, tf * (cfg.k1 + 1) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * length[place % n] / avgdl))


def _block_hits(ids: pa.Array, words: pa.Array, sent: tuple, cfg: Retrieval) -> Iterator[pa.RecordBatch]:
    """The rows (q, key, score) of some chunks that can be among the best of each query.

    Scores of 32 bits, by a product for frequent words and by their chunks for others, only find the pairs that are scored in full.
    """
    known, first, terms, weights, least, avgdl = sent
    order = pc.sort_indices(ids)  # ties by id
    ids, words = ids.take(order), words.take(order)
    place, value = _postings(words, known, avgdl, cfg)
    if not len(place):
        return
    n, k = len(ids), min(cfg.top_k, len(ids))
    chunk, low = place % n, value.astype(np.float32)
    bounds = np.searchsorted(place, np.arange(len(known) + 1) * n)
    df = np.diff(bounds)
    often = df * np.bincount(terms, minlength=len(known)) > FREQUENT * n * (len(first) - 1)
    column, full = np.cumsum(often) - 1, np.zeros((int(often.sum()), n))
    own = often[place // n]
    full[column[place[own] // n], chunk[own]] = value[own]
    dense = full.astype(np.float32)
    rest = ~often[terms] & (df[terms] > 0)
    for lo in range(0, len(first) - 1, QUERY_SLICE):
        hi = min(lo + QUERY_SLICE, len(first) - 1)
        a, b = first[lo], first[hi]
        query = np.repeat(np.arange(hi - lo), np.diff(first[lo : hi + 1]))
        term, weight = terms[a:b], weights[a:b]
        asked = np.zeros((hi - lo, len(dense)), dtype=np.float32)
        asked[query[often[term]], column[term[often[term]]]] = weight[often[term]]
        s = asked @ dense
        for q, t, w in zip(query[rest[a:b]].tolist(), term[rest[a:b]].tolist(), weight[rest[a:b]].tolist()):
            x, y = bounds[t], bounds[t + 1]
            row = s[q]
            row[chunk[x:y]] += low[x:y] * np.float32(w)
        margin = 1e-6 + (np.bincount(query, minlength=hi - lo) + 8) * np.bincount(query, np.abs(weight), minlength=hi - lo) * (cfg.k1 + 1) * 2.4e-7
        bound = least[lo:hi].copy()
        new = np.isinf(bound)
        if new.any():
            bound[new] = np.partition(s[new], n - k, axis=1)[:, n - k] - margin[new]
        r, c = np.divmod(np.flatnonzero(s >= np.maximum(bound - margin, 0).astype(np.float32)[:, None]), n)
        count = np.diff(first[lo : hi + 1])[r]
        pair, entry = np.repeat(np.arange(len(r)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[lo:hi][r], count)
        by, held, sparse = terms[entry], np.zeros(len(entry)), rest[entry]
        held[often[by]] = full[column[by[often[by]]], c[pair[often[by]]]]
        wanted = by[sparse] * np.int64(n) + c[pair[sparse]]
        at = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
        held[sparse] = np.where(place[at] == wanted, value[at], 0.0)
        exact = np.round(np.bincount(pair, weights[entry] * held, minlength=len(r)), 6)
        near = (exact > 0) & (exact >= least[lo:hi][r])
        r, c, exact = best_of(r[near], c[near], exact[near], cfg.top_k)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array((r + lo).astype(np.int32)), ids.take(pa.array(c)), pa.array(exact)], ["q", "key", "score"])


def _scores(sent, cfg: Retrieval):
    """Partition of chunks (chunk_id, words) to the rows (q, key, score) that can be among the best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= CHUNK_BLOCK:
                whole, held = pa.Table.from_batches(held).combine_chunks(), []
                yield from _block_hits(whole.column(0).combine_chunks(), whole.column(1).combine_chunks(), sent.value, cfg)
        if sum(x.num_rows for x in held):
            whole = pa.Table.from_batches(held).combine_chunks()
            yield from _block_hits(whole.column(0).combine_chunks(), whole.column(1).combine_chunks(), sent.value, cfg)

    return run


def bm25_search(queries: DataFrame, chunks: DataFrame, cfg: Retrieval = Retrieval()) -> DataFrame:
    """(query_id, chunk_id, raw_score, rank): the best chunks of each query (query_id, text), ties by chunk_id.

    A query's terms count as often as it has them. Chunks without a common term score 0 and fill
    up to top_k in the order of their ids; of those only the 2 * top_k smallest ids can be needed.
    Chunks are tokenised once. A pass over them serves QUERY_PASS queries, sent as their weighted terms, a few MB. A sample of the chunks gives each query a bound
    for its top_k-th score, then each partition of chunks passes on, of what reaches the bound, at most top_k per query,
    so a word that is in every chunk and every query costs no shuffle.
    """
    spark = chunks.sparkSession
    words = tokenised(chunks.select("chunk_id", "text"))
    stats, n, avgdl = term_statistics(words, cfg)
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    weighted = cut(asked.join(stats.select("term", "idf"), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w")))
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "chunk_id": chunks.schema["chunk_id"].dataType.simpleString()}
    passes = max(1, -(-weighted.select("query_id").distinct().count() // QUERY_PASS))
    some, schema = sampled(words, "chunk_id", n), f"q int, key {kinds['chunk_id']}, score double"
    best, enough = None, []
    for i in range(passes):
        held = weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).toArrow()  # the terms of about QUERY_PASS queries
        if not held.num_rows:
            continue
        ids, known = held.column("query_id").unique(), held.column("term").unique()
        q, term = pc.index_in(held.column("query_id"), ids).to_numpy(), pc.index_in(held.column("term"), known).to_numpy()
        order = np.lexsort((term, q))
        sent = (known, np.searchsorted(q[order], np.arange(len(ids) + 1)), term[order], held.column("w").to_numpy()[order])
        bound = kth_best(some.mapInArrow(_scores(spark.sparkContext.broadcast((*sent, np.full(len(ids), -np.inf), avgdl)), cfg), schema), cfg.top_k, len(ids))
        enough.append(ids.filter(pa.array(np.isfinite(bound))))
        hits = words.mapInArrow(_scores(spark.sparkContext.broadcast((*sent, bound, avgdl)), cfg), schema)
        named = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(ids), dtype=np.int32)), "query_id": ids}))
        top = hits.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))).where(F.col("_n") <= cfg.top_k)
        part = top.join(F.broadcast(named), "q").select(F.col("query_id").cast(kinds["query_id"]), F.col("key").alias("chunk_id"), F.col("score").alias("raw_score"))
        best = part if best is None else best.unionByName(part)
    short = queries.select("query_id").distinct()
    for ids in enough:
        if len(ids):
            short = short.join(spark.createDataFrame(pa.table({"query_id": ids})), "query_id", "left_anti")
    smallest = words.select("chunk_id").orderBy("chunk_id").limit(2 * cfg.top_k)
    fill = short.crossJoin(F.broadcast(smallest)).select("query_id", "chunk_id", F.lit(0.0).alias("raw_score"))
    best = (fill if best is None else best.unionByName(fill)).groupBy("query_id", "chunk_id").agg(F.max("raw_score").alias("raw_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.top_k)
