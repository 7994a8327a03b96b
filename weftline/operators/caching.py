"""Cache-through computation: only what a cache doesn't hold is computed, once per distinct input, and joined back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.models import Completer, Embedder, PairScorer
from weftline.session import cut


def cache_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by colons: settings' fingerprints and versions first, then the inputs."""
    joined: list[Column] = []
    for p in parts:
        joined += [F.lit(":"), F.lit(p) if isinstance(p, str) else p.cast("string")]
    return F.sha2(F.concat(*joined[1:]), 256)


def upsert(table: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """``table`` with ``entries`` put in: a key given again has its new row. Of several entries of a key the one with the greatest values stays."""
    rest = [c for c in table.columns if c != key]
    last = entries.groupBy(key).agg(F.max(F.struct(*rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    return table.join(last, key, "left_anti").select(table.columns).unionByName(last)


def cache_through(rows: DataFrame, inputs: list[str], cache: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(rows with results, fresh cache entries) of rows (key, inputs..) and a cache (key, results..).

    ``compute`` gets the distinct misses (key, inputs..) and gives (key, results.., error); rows without an error are new entries, so a failed call is
    never cached and its rows have null results and the error. A key is repeated in ``rows`` at no cost; the cache has each once.
    """
    results = [c for c in cache.columns if c != key]
    asked = rows.select(key, *inputs).where(F.col(key).isNotNull()).dropDuplicates([key])
    made = cut(compute(asked.join(cache.select(key), key, "left_anti")).select(key, *results, "error"))
    fresh = made.where("error is null").select(key, *results)
    held = cache.select(key, *results).withColumn("error", F.lit(None).cast("string")).unionByName(made)
    return rows.join(held, key, "left"), fresh


def _rowwise(call: Callable[..., tuple], inputs: list[str], kinds: list[pa.DataType], names: list[str], key: str):
    """One call per row; what it raises becomes the row's error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in inputs)):
                try:
                    out.append((*call(*row), None))
                except Exception as e:  # noqa: BLE001  a row's failure never stops the others
                    out.append((*[None] * len(names), f"{type(e).__name__}: {e}"))
            cols = list(zip(*out)) or [()] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([b.column(key), *[pa.array(c, k) for c, k in zip(cols, kinds)], pa.array(cols[-1], pa.string())], [key, *names, "error"])

    return run


def completions(prompts: DataFrame, completer: Completer, cache: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
    """(rows with answer and error, fresh entries (key, answer)) of rows with a prompt; null prompts have neither.

    ``namespace``: the model's fingerprint and, for structured answers, the schema's version. Misses are spread over the cluster, one call each.
    """
    rows = prompts.withColumn("key", cache_key(namespace, F.col("prompt")))
    run = _rowwise(lambda p: (completer.complete(p),), ["prompt"], [pa.string()], ["answer"], "key")
    return cache_through(rows, ["prompt"], cache.select("key", "answer"), lambda df: df.mapInArrow(run, "key string, answer string, error string"))


def replay(prompts: DataFrame, cache: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
    """(rows with answer, misses) without any call: what the cache doesn't hold is set aside."""
    rows = prompts.withColumn("key", cache_key(namespace, F.col("prompt"))).join(cache.select("key", "answer"), "key", "left")
    return rows.where("answer is not null"), rows.where("answer is null").drop("answer")


def embeddings(texts: DataFrame, embedder: Embedder, cache: DataFrame, namespace: str, text: str = "text", batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """(texts with embedding, fresh entries (key, embedding)): each distinct text is embedded once, in batches; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                x = np.asarray(embedder.embed(part.column(1).to_pylist()), dtype=np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.nulls(part.num_rows, pa.string())], ["key", "embedding", "error"])

    rows = texts.withColumn("key", F.when(F.length(text) > 0, cache_key(namespace, F.col(text))))
    out, fresh = cache_through(rows, [text], cache.select("key", "embedding"), lambda df: df.select("key", text).mapInArrow(run, "key string, embedding array<double>, error string"))
    return out.drop("error"), fresh


def pair_labels(pairs: DataFrame, scorer: PairScorer, cache: DataFrame, namespace: str, premise: str = "premise", hypothesis: str = "hypothesis", batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """(pairs with label and score, fresh entries (key, label, score)): each distinct pair of texts is scored once, in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                got = scorer.score(part.column(1).to_pylist(), part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([float(g[1]) for g in got], pa.float64()), pa.nulls(len(got), pa.string())], ["key", "label", "score", "error"])

    rows = pairs.withColumn("key", cache_key(namespace, F.length(premise), F.col(premise), F.col(hypothesis)))
    out, fresh = cache_through(rows, [premise, hypothesis], cache.select("key", "label", "score"), lambda df: df.select("key", premise, hypothesis).mapInArrow(run, "key string, label string, score double, error string"))
    return out.drop("error"), fresh


def latest(entries: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Of each key the row that comes last by ``order``."""
    last = Window.partitionBy(key).orderBy(*[c.desc() for c in order])
    return entries.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
