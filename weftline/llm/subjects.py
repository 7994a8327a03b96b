"""Problem 10: the subject areas a document deals with.

Sentences are placed in the latent space of the corpus (term weighting, truncated SVD).
Centroids start as clusters of the sentences of a bounded sample of labelled
documents; a cluster belongs to the subject whose documents it comes from, or to none
if it comes from documents of all kinds alike. They are refined over all sentences
of the corpus, and a document has each subject that wins a fifth of its sentences.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.latent import END, Space, Terms, singular_vectors, telling_terms, unpack, word_ids, word_table
from weftline.session import cut


@dataclass(frozen=True)
class Subjects:
    """share: of a document's sentences from which it has a subject. least: fewest words of a sentence.
    labelled: most labelled documents that weights and centroids are learnt from, taken by the hash of their id.
    prior: imaginary documents, spread as all are, beside those that hold a term. weight: least of a kept term.
    clusters: centroids that start in each subject. pure: share of a cluster's sentences from one subject's documents.
    rounds: refinements over the whole corpus. telling: least length of a sentence's vector, below which it is
    about nothing. cosine: least similarity of a sentence to its centroid.
    """

    share: float = 0.18
    least: int = 3
    labelled: int = 10_000
    prior: float = 2.0
    weight: float = 0.3
    clusters: int = 12
    pure: float = 0.5
    rounds: int = 3
    telling: float = 1.0
    cosine: float = 0.2
    seed: int = 5
    space: Space = Space(terms=4_000, dims=64, passage=24)


def subject_terms(flat: np.ndarray, offsets: np.ndarray, has: np.ndarray, p: Subjects) -> dict[int, float]:
    """Hash slots of the terms that tell subjects apart, and by how much.

    A term's documents are spread over the subjects and "none"; its factor is the divergence
    of that spread, with a prior, from the spread of all labelled documents. Terms of a single document
    are names or chance and left out.
    """
    of = np.concatenate([has, (has.sum(axis=1) == 0)[:, None]], axis=1)
    of = of / of.sum(axis=1, keepdims=True)
    doc = np.repeat(np.arange(len(has)), np.diff(offsets))
    word = flat != END
    pair = np.unique((flat[word] & (p.space.slots - 1)).astype(np.int64) * len(has) + doc[word])
    slots, at = np.unique(pair // max(len(has), 1), return_inverse=True)
    spread = np.zeros((len(slots), of.shape[1]))
    np.add.at(spread, at, of[pair % max(len(has), 1)])
    base = (of.sum(axis=0) + 1e-6) / (of.sum() + 1e-6 * of.shape[1])
    n = spread.sum(axis=1)
    share = (spread + p.prior * base) / (n + p.prior)[:, None]
    factor = (share * np.log(share / base)).sum(axis=1)
    order = [k for k in np.argsort(-factor * np.minimum(n, 20), kind="stable")[: p.space.terms] if n[k] > 1.5 and factor[k] > 0]
    return {int(slots[k]): float(factor[k]) for k in order}


_STEPS = 32


def summed(vectors: np.ndarray, term: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the terms' vectors over the stretches of ``term`` that begin at ``first``, none of them empty.

    The k-th terms of all stretches are added at once, which for stretches of a few terms is many times faster than one by one; what a stretch has beyond 32 terms is added by itself.
    """
    n = np.diff(np.append(first, len(term)))
    out = vectors[term[first]]
    for k in range(1, min(int(n.max(initial=0)), _STEPS)):
        more = np.flatnonzero(n > k)
        out[more] += vectors[term[first[more] + k]]
    for i in np.flatnonzero(n > _STEPS):
        out[i] += vectors[term[first[i] + _STEPS : first[i] + n[i]]].sum(axis=0)
    return out


def sentence_vectors(flat: np.ndarray, offsets: np.ndarray, terms: Terms, vectors: np.ndarray, p: Subjects) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors of the sentences, the text of each); zero for a sentence that is about nothing.

    Stretches of fewer than ``least`` words, as after an abbreviation, are no sentences.
    """
    new = flat == END
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(new)
    if not len(start):
        return np.zeros((0, vectors.shape[1]), np.float32), start
    size = np.add.reduceat((flat != END).astype(np.int32), start)
    term = terms.of(flat)
    owner = np.searchsorted(offsets, start, "right") - 1
    kept = term >= 0
    at = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(flat))))[kept]
    out = np.zeros((len(start), vectors.shape[1]), dtype=np.float32)
    if len(at):
        first = np.flatnonzero(np.diff(at, prepend=-1))
        out[at[first]] = summed(vectors, term[kept], first)
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    out = np.divide(out, norm, out=np.zeros_like(out), where=norm >= p.telling)
    whole = size >= p.least
    return out[whole], owner[whole]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of the largest cosine for each row, in slices of bounded memory."""
    return np.concatenate([np.argmax(x[k : k + 20_000] @ centres.T, axis=1) for k in range(0, len(x), 20_000)] or [np.zeros(0, dtype=np.int64)])


def seed_centroids(x: np.ndarray, owner: np.ndarray, has: np.ndarray, own: np.ndarray, p: Subjects) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, subject of each or -1) from labelled sentences.

    x: sentences, owner: their document, has: documents x subjects, own: one vector per
    subject from its name and description. Each subject's sentences give seeds far from one
    another, so that its languages and sides all have some; spherical k-means follows. A
    cluster goes to the subject with the largest share of its sentences in documents
    that have it, if that share is ``pure``. A subject that wins no cluster keeps its description.
    """
    rng = np.random.default_rng(p.seed)
    filled = np.flatnonzero(x.any(axis=1))
    x, owner = x[filled], owner[filled]
    seeds = []
    for s in range(len(own)):
        mine = x[has[owner, s] > 0] if len(x) else x
        if not len(mine):
            continue
        seeds.append(mine[rng.integers(len(mine))])
        away = 1 - mine @ seeds[-1]
        for _ in range(p.clusters - 1):
            odds = np.maximum(away, 0) ** 2
            if odds.sum() <= 1e-9:
                break
            seeds.append(mine[rng.choice(len(mine), p=odds / odds.sum())])
            away = np.minimum(away, 1 - mine @ seeds[-1])
    centres, subject = own[:0], np.zeros(0, dtype=np.int64)
    if seeds:
        centres = np.array(seeds)
        for _ in range(8):
            at = _nearest(x, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, at, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centres)
        at = _nearest(x, centres)
        held = np.zeros((len(centres), has.shape[1]))
        np.add.at(held, at, has[owner])
        held /= np.maximum(np.bincount(at, minlength=len(centres)), 1)[:, None]
        subject = np.where(held.max(axis=1) >= p.pure, held.argmax(axis=1), -1)
    missing = [s for s in range(len(own)) if s not in set(subject.tolist()) and own[s].any()]
    return np.concatenate([centres, own[missing]]).astype(np.float32), np.concatenate([subject, missing]).astype(np.int64)


def _refine_partition(sent, p: Subjects):
    """Sums of the sentences nearest to each centroid: one row per centroid and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, vectors, centres, _ = sent.value
        total = np.zeros(centres.shape, dtype=np.float64)
        for b in batches:
            x, _ = sentence_vectors(*unpack(b.column("words")), terms, vectors, p)
            if not len(x):
                continue
            near = x @ centres.T
            at = near.argmax(axis=1)
            close = near[np.arange(len(x)), at] >= p.cosine
            order = np.argsort(at[close], kind="stable")
            at, x = at[close][order], x[close][order]
            first = np.flatnonzero(np.diff(at, prepend=-1))
            for lo, hi in zip(first, np.append(first[1:], len(at))):
                total[at[lo]] += x[lo:hi].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["cell", "sums"])

    return run


def _score_partition(sent, key: str, p: Subjects, labels: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, vectors, centres, subject = sent.value
        for b in batches:
            x, owner = sentence_vectors(*unpack(b.column("words")), terms, vectors, p)
            rows, found, share = [], [], []
            if len(x):
                near = x @ centres.T
                at = near.argmax(axis=1)
                won = np.where(near[np.arange(len(x)), at] >= p.cosine, subject[at], -1)
                n = np.bincount(owner, minlength=b.num_rows)
                hit = won >= 0
                held = np.zeros((b.num_rows, len(labels)))
                np.add.at(held, (owner[hit], won[hit]), 1)
                held /= np.maximum(n, 1)[:, None]
                rows, which = np.nonzero(held >= p.share)
                found, share = [labels[k] for k in which], held[rows, which]
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(np.asarray(rows, dtype=np.int64))), pa.array(found, pa.string()), pa.array(share, pa.float64())], [key, "subject", "share"])

    return run


def document_subjects(
    docs: DataFrame, areas: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", params: Subjects = Subjects()
) -> DataFrame:
    """(key, subject, share): the subjects of each document with their share of its sentences.

    Null and empty texts, and texts without telling words, have no subject. A repeated
    document id gives the subjects of each of its rows, once. Labels count without case and
    blanks, a label outside ``areas`` as "no subject"; a subject given by any annotator
    counts. Without labels each subject's description is its only centroid.
    """
    p = params
    spark = docs.sparkSession
    words = cut(word_table(docs.where(f"{key} is not null"), key, text, ends=True))
    named = areas.where("subject is not null").select(F.lower(F.trim("subject")).alias("s"), F.concat_ws(" ", "subject", "description").alias("d")).groupBy("s").agg(F.min("d").alias("d")).orderBy("s").collect()  # the list of subjects
    subjects = [r["s"] for r in named]
    own_flat, own_counts = word_ids([r["d"] for r in named])
    own_offsets = np.concatenate([[0], np.cumsum(own_counts)])
    said = labels.where(F.col(key).isNotNull() & F.col("subject").isNotNull()).groupBy(key).agg(F.collect_set(F.lower(F.trim("subject"))).alias("said"))
    sample = said.orderBy(F.xxhash64(F.col(key)), key).limit(p.labelled)
    held = words.join(F.broadcast(sample), key).orderBy(key).select("said", "words").toArrow()  # at most p.labelled documents
    has = np.array([[s in v for s in subjects] for v in map(set, held.column("said").to_pylist())], dtype=np.float64).reshape(held.num_rows, len(subjects))
    has = np.concatenate([has, np.repeat(np.eye(len(subjects)), 2, axis=0)])  # the descriptions count as documents, twice as names don't
    parts = [unpack(c) for c in held.column("words").chunks if len(c)]
    lengths = [np.diff(o) for _, o in parts]
    flat = np.concatenate([*[f for f, _ in parts], *[own_flat[own_offsets[k] : own_offsets[k + 1]] for k in range(len(subjects)) for _ in (0, 1)], []]).astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([*lengths, np.repeat(own_counts, 2)]))]).astype(np.int64)
    terms = telling_terms(words, p.space, subject_terms(flat, offsets, has, p))
    terms.slot[np.isin(terms.slot, np.flatnonzero(terms.weight < p.weight))] = -1
    vectors = singular_vectors(words, terms, p.space)
    vectors = (terms.weight[:, None] * vectors).astype(np.float32)
    own = np.zeros((len(subjects), p.space.dims), dtype=np.float32)
    x, at = sentence_vectors(own_flat, own_offsets, terms, vectors, dataclasses.replace(p, least=1, telling=1e-6))
    np.add.at(own, at, x)
    del held
    parts = []
    for lo in range(0, len(has), 500):  # in slices, as every word's vector is held for a moment
        cut_at = offsets[lo : lo + 501]
        x, at = sentence_vectors(flat[cut_at[0] : cut_at[-1]], cut_at - cut_at[0], terms, vectors, p)
        parts.append((x[x.any(axis=1)], at[x.any(axis=1)] + lo))
    x, owner = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
    del parts, flat
    centres, subject = seed_centroids(x, owner, has, own, p)
    for _ in range(p.rounds):
        sent = spark.sparkContext.broadcast((terms, vectors, centres, subject))
        sums = words.mapInArrow(_refine_partition(sent, p), "cell int, sums array<double>")
        sums = sums.select("cell", F.posexplode("sums").alias("dim", "v")).groupBy("cell", "dim").agg(F.sum("v").alias("v")).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("v"))
        moved = centres.copy()
        for r in sums.collect():  # one row per centroid
            v = np.array([c["v"] for c in r["v"]])
            if v.any():
                moved[r["cell"]] = v / np.linalg.norm(v)
        centres = moved
        sent.unpersist()
    sent = spark.sparkContext.broadcast((terms, vectors, centres, subject))
    kind = docs.schema[key].dataType.simpleString()
    scored = words.mapInArrow(_score_partition(sent, key, p, subjects), f"{key} {kind}, subject string, share double")
    return scored.groupBy(key, "subject").agg(F.max("share").alias("share"))


def corpus_composition(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(subject, documents, share_of_documents) over all documents; 'none' for those without a subject."""
    each = docs.select(key).where(F.col(key).isNotNull()).distinct().join(found.select(key, "subject"), key, "left").select(key, F.coalesce("subject", F.lit("none")).alias("subject"))
    total = docs.where(F.col(key).isNotNull()).agg(F.countDistinct(key).alias("all"))
    return each.groupBy("subject").agg(F.count("*").alias("documents")).crossJoin(F.broadcast(total)).select("subject", "documents", F.round(F.col("documents") / F.col("all"), 6).alias("share_of_documents"))
