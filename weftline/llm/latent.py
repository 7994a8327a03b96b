"""Latent semantic space of a corpus: term weighting and a distributed randomised SVD.

With A the matrix of unit-length weighted passages by terms, executors add up A'A
over the most frequent telling terms, a matrix whose size is a parameter and doesn't grow
with the corpus, and a randomised range finder with subspace iterations takes its leading
eigenvectors, which are A's right singular vectors. Every passage counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a byte of lower-case UTF-8 is: 0 separates words, 1 is of a word, 2 ends a sentence.
_KIND = bytes(2 if chr(c) in ".!?;\n" else int(c >= 128 or chr(c).isalnum()) for c in range(256))
#: Other characters that are of no word; signs of the blocks that ``_tokens`` knows aside.
_ODD = r"[^\x00-\x7F\x{80}-\x{BF}\x{2000}-\x{206F}\p{L}\p{N}\p{M}]"
_SLICE = 1 << 17

#: Marks the end of a sentence between word hashes.
END = 0


@dataclass(frozen=True)
class Space:
    """terms: that shape the space; words that are over ``common`` of all words aren't telling.
    dims: kept singular vectors. extra: sketched beyond them. passage: successive terms of a text that make one.
    slots: of the table that finds a word's term by its hash.
    """

    terms: int = 3_000
    dims: int = 64
    extra: int = 16
    passage: int = 16
    common: float = 0.01
    slots: int = 1 << 20
    seed: int = 11


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 to the 64; grown to the longest slice met."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.append(np.ones(1, np.uint64), np.full(max(n, 2 * _SLICE), x))) for x in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64)))]
    return _POWERS[0], _POWERS[1]


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 32-bit hash other than END of each stretch of bytes: a polynomial in the bytes, taken from running sums, then mixed."""
    power, inverse = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(raw * power[: len(raw)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return ((h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)).view(np.int32)


def _kinds(raw: np.ndarray) -> np.ndarray:
    """What each byte is. Two blocks of signs outside ASCII are found by their lead bytes: Latin-1's and general punctuation."""
    kind = np.frombuffer(bytearray(raw.tobytes().translate(_KIND)), dtype=np.uint8)
    after = np.append(raw, np.zeros(2, np.uint8))
    two = np.flatnonzero(raw == 0xC2)
    two = two[~np.isin(after[two + 1], (0xAA, 0xB5, 0xBA))]
    kind[two] = kind[two + 1] = 0
    three = np.flatnonzero(raw == 0xE2)
    three = three[(after[three + 1] == 0x80) | (after[three + 1] == 0x81)]
    for k in range(3):
        kind[three + k] = 0
    kind[three[(after[three + 1] == 0x80) & (after[three + 2] == 0xA6)]] = 2  # the ellipsis
    return kind


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, rows' offsets) of the tokens of lower-case texts: words, and the marks that end sentences, in order."""
    texts = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))  # a row ends its last word
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    kind = _kinds(raw)
    word = kind == 1
    turn = np.append(word[:1], word[1:] != word[:-1])
    start = np.flatnonzero((turn & word) | (kind == 2))
    end = start.copy()  # a mark is an empty stretch
    end[kind[start] == 1] = np.flatnonzero(turn & ~word)
    return raw, start, end, offsets - offsets[0]


def lower_text(texts: pa.Array) -> pa.Array:
    """Texts in lower case, with a blank for every character that is of no word."""
    low = pc.utf8_lower(texts)
    odd = pc.match_substring_regex(low, _ODD)
    if pc.any(odd).as_py():
        low = pc.if_else(odd, pc.replace_substring_regex(low, _ODD, " "), low)
    return low


def words_of(text: str) -> list[bytes]:
    """Words in lower case, and sentence marks, in order; anything else separates words."""
    raw, start, end, _ = _tokens(lower_text(pa.array([text], pa.string())))
    return [raw[a : max(b, a + 1)].tobytes() for a, b in zip(start.tolist(), end.tolist())]


def word_ids(texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words and END marks in order, their number per text); whole columns at a time, in slices of bounded memory."""
    raw, start, end, offsets = _tokens(lower_text(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())))
    out = np.empty(len(start), dtype=np.int32)
    lo = 0
    while lo < len(start):
        hi = max(int(np.searchsorted(end, start[lo] + _SLICE, "right")), lo + 1)
        a = start[lo]
        out[lo:hi] = _hashes(raw[a : end[hi - 1]].astype(np.uint64), start[lo:hi] - a, end[lo:hi] - a)
        lo = hi
    out[start == end] = END
    return out, np.diff(np.searchsorted(start, offsets))


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def word_table(docs: DataFrame, key: str, text: str, ends: bool) -> DataFrame:
    """(key, words array<int>): the hashed words of each text in order, with END marks where asked for.

    Texts without words are left out. Arrays of ints cost parquet a few bits a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                flat, counts = word_ids(part.column(1))
                if not ends:
                    word = flat != END
                    counts = np.diff(np.concatenate([[0], np.cumsum(word)])[np.concatenate([[0], np.cumsum(counts)])])
                    flat = flat[word]
                out = pa.RecordBatch.from_arrays([part.column(0), _lists(flat, counts)], [key, "words"])
                yield out.filter(pa.array(counts > 0))

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, words array<int>")


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, offsets from 0) of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def passages(offsets: np.ndarray, most: int) -> np.ndarray:
    """Ascending passage number of each word of some texts: a new one at each text and after ``most`` words."""
    counts = np.diff(offsets)
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts)
    return np.cumsum(at % most == 0)


def within(offsets: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Offsets of the same lists when only the ``kept`` values stay."""
    return np.concatenate([[0], np.cumsum(kept)])[offsets]


@dataclass(frozen=True)
class Terms:
    """slot: term of each hash slot, -1 for none. weight: idf of each term. common: slots of the words that are too common for a term."""

    slot: np.ndarray
    weight: np.ndarray
    common: np.ndarray

    def of(self, words: np.ndarray) -> np.ndarray:
        found = self.slot[words & (len(self.slot) - 1)]
        return np.where(words == END, np.int16(-1), found)


def telling_terms(words: DataFrame, space: Space, chosen: dict[int, float] | None = None) -> Terms:
    """Terms weighted by ln(texts' words / occurrences), counted over all texts.

    By default the most frequent ones below the common share of words; with ``chosen``
    those slots, their weights multiplied by the given factors.
    """
    mask = space.slots - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(space.slots, dtype=np.int64)
        for b in batches:
            flat, _ = unpack(b.column("words"))
            n += np.bincount(flat[flat != END] & mask, minlength=space.slots)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(n[at], n.sum()))], ["slot", "n"])

    counts = words.mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))  # at most ``slots`` rows
    if chosen is None:
        best = counts.where("slot >= 0").orderBy(F.desc("n"), "slot").limit(2 * space.terms)
    else:
        best = counts.where(F.col("slot").isin([int(k) for k in chosen]))
    rows = best.unionByName(counts.where("slot = -1")).collect()
    total = max([int(r["n"]) for r in rows if r["slot"] == -1] or [1])
    common = np.array([r["slot"] for r in rows if r["slot"] >= 0 and chosen is None and r["n"] > total * space.common], dtype=np.int64)
    rows = sorted((r for r in rows if r["slot"] >= 0 and (chosen is not None or r["n"] <= total * space.common)), key=lambda r: (-r["n"], r["slot"]))[: space.terms]
    slot = np.full(space.slots, -1, dtype=np.int16)
    weight = np.zeros(max(len(rows), 1), dtype=np.float32)
    for i, r in enumerate(rows):
        slot[r["slot"]] = i
        weight[i] = np.log(total / r["n"]) * (1.0 if chosen is None else chosen[r["slot"]])
    return Terms(slot, weight, common)


_BLOCK = 64


def _gram_of_partitions(words: DataFrame, terms: Terms, space: Space) -> np.ndarray:
    """A'A over all passages: partial sums by a bounded number of tasks, added up in a tree."""
    from pyspark import TaskContext

    spark = words.sparkSession
    size = len(terms.weight)
    sent = spark.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: Terms = sent.value
        gram = np.zeros(size * size, dtype=np.float32)
        for b in batches:
            flat, offsets = unpack(b.column("words"))
            if not len(flat):
                continue
            term = terms.of(flat)
            kept = term >= 0
            term, row = term[kept].astype(np.int64), passages(within(offsets, kept), space.passage)
            if not len(row):
                continue
            w = terms.weight[term]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            w = w / np.repeat(np.sqrt(np.add.reduceat(w * w, first)), np.diff(np.append(first, len(row))))
            np.add.at(gram, term * size + term, w * w)
            for lag in range(1, space.passage):
                same = np.flatnonzero(row[lag:] == row[:-lag])
                if not len(same):
                    break
                np.add.at(gram, term[same] * size + term[same + lag], w[same] * w[same + lag])
        part = TaskContext.get().partitionId()
        step = _BLOCK * size
        used = [k for k in range(0, len(gram), step) if gram[k : k + step].any()]
        for k in used:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([k // step], pa.int32()), pa.array([gram[k : k + step].tobytes()], pa.binary())], ["part", "block", "data"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, dtype=np.float32) for x in pdf["data"]], axis=0, dtype=np.float32)
        return pd.DataFrame({"part": [key[1]], "block": [key[0]], "data": [total.tobytes()]})

    tasks = max(1, min(words.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))
    partial, left = words.coalesce(tasks).mapInArrow(run, "part int, block int, data binary"), tasks
    while left > 1:
        partial = partial.withColumn("part", F.floor(F.col("part") / 32).cast("int")).groupBy("block", "part").applyInPandas(add, "part int, block int, data binary")
        left = -(-left // 32)
    gram = np.zeros((size, size), dtype=np.float32)
    for r in partial.collect():  # size x size floats at most
        part = np.frombuffer(r["data"], dtype=np.float32).reshape(-1, size)
        gram[r["block"] * _BLOCK : r["block"] * _BLOCK + len(part)] += part
    sent.unpersist()
    return gram + gram.T - np.diag(np.diag(gram)) if size else gram


def singular_vectors(words: DataFrame, terms: Terms, space: Space) -> np.ndarray:
    """terms x dims: leading right singular vectors of the passages (zero columns beyond the rank)."""
    gram = _gram_of_partitions(words, terms, space)
    rng = np.random.default_rng(space.seed)
    size = len(gram)
    width = min(size, space.dims + space.extra)
    basis = np.linalg.qr(rng.standard_normal((size, width)).astype(np.float32))[0]
    for _ in range(6):
        basis = np.linalg.qr(gram @ basis)[0]
    value, turn = np.linalg.eigh(basis.T @ gram @ basis)
    out = np.zeros((size, space.dims), dtype=np.float32)
    kept = [i for i in np.argsort(-value)[: space.dims] if value[i] > max(value[-1], 0) * 1e-6]
    out[:, : len(kept)] = basis @ turn[:, kept]
    return out
