"""Problem 9: evaluation passages that occur in corpus texts.

Short windows of all texts and of the evaluation items are placed in the latent
space of the corpus (TF-IDF, randomised SVD). What of a word lies outside that space is
kept as a random sketch beside it, so that cosines stay near those of the full TF-IDF and rare words, terms or
not, tell windows apart. Windows of like direction are candidates, found through cells of the items' windows; most of a candidate's words must stand
near each other in both texts, and the texts around those that pass are aligned with the item by longest common subsequence. An alignment of
barely enough words must also hold the item's answer, the words that tell it from other items, not stock phrases.
Equal windows are candidates wherever they lie, and a run of equal words that makes a passage is a case whatever it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.latent import END, Space, Terms, singular_vectors, telling_terms, unpack, within, word_ids, word_table
from weftline.session import cut

#: Words placed at once.
_SLICE = 160_000


@dataclass(frozen=True)
class Leaks:
    """passage: successive words that make a case, without any other check when all are equal. window, stride: words of a window, and between the starts of
    a text's windows; window + stride - 1 <= passage, so each such run holds a whole window. apart: between the starts of an item's windows.
    sketch: dimensions for what lies outside the latent space. cosine: of candidates; two or three of a window's words may differ. agree: words of a candidate window that
    stand near each other in both. cells, probes: the items' windows are in ``cells`` times the root of their number of cells, by k-means, of which a text's window
    visits the nearest. sure: aligned words from which no answer check is needed. items: evaluation items searched for at once.
    """

    passage: int = 12
    window: int = 8
    stride: int = 5
    apart: int = 3
    sketch: int = 40
    cosine: float = 0.65
    agree: int = 5
    cells: float = 1.7
    probes: int = 4
    sure: int = 15
    items: int = 20_000
    space: Space = Space(dims=24)

    def __post_init__(self) -> None:
        if self.window + self.stride - 1 > self.passage:
            raise ValueError("a passage must hold a whole window")


def alignment(text: np.ndarray, item: np.ndarray) -> tuple[int, np.ndarray]:
    """(score, matched item positions) of the best local alignment: 1 for a common word, -1 for any other step.

    One row of the table per item word, each computed whole; the path is read back from the rows.
    """
    n = len(text)
    table = np.zeros((len(item) + 1, n + 1), dtype=np.int16)
    step = np.arange(n + 1, dtype=np.int16)
    for i, w in enumerate(item):
        prev = table[i]
        row = np.maximum(prev - 1, 0)
        np.maximum(row[1:], prev[:-1] + np.where(text == w, 1, -1).astype(np.int16), out=row[1:])
        table[i + 1] = np.maximum.accumulate(row + step) - step
    i, j = np.unravel_index(int(np.argmax(table)), table.shape)
    best, matched = int(table[i, j]), []
    while i and j and table[i, j] > 0:
        if text[j - 1] == item[i - 1] and table[i, j] == table[i - 1, j - 1] + 1:
            matched.append(i - 1)
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j - 1] - 1:
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return best, np.array(matched[::-1], dtype=np.int64)


def _cluster(x: np.ndarray, cells: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: (centres, cell of each row)."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(8):
        at = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centres).astype(np.float32)
    return centres, np.argmax(x @ centres.T, axis=1)


class _Index:
    """The windows of some evaluation items, in cells, with the words themselves.

    ``vectors``: right singular vectors of the terms. A word that is no term and that no item holds has no direction:
    it neither makes a window a candidate nor keeps it from being one.
    """

    def __init__(self, ids: np.ndarray, flat: np.ndarray, counts: np.ndarray, terms: Terms, vectors: np.ndarray, p: Leaks) -> None:
        self.ids, self.flat, self.starts = ids, flat, np.concatenate([[0], np.cumsum(counts)])
        self.p, self.mask = p, len(terms.slot) - 1
        self.owner = owner = np.repeat(np.arange(len(ids)), counts)
        known = np.unique(flat & self.mask)
        rare = known[(terms.slot[known] < 0) & ~np.isin(known, terms.common)]
        self.slot = terms.slot.astype(np.int32)
        self.slot[rare] = np.arange(len(rare)) + len(vectors)
        weight = np.concatenate([terms.weight[: len(vectors)], np.full(len(rare), terms.weight.max()), [0]]).astype(np.float32)  # the last for words without a direction
        self.weight = weight[self.slot[flat & self.mask]]  # a word that is no term is rarer than all terms, or so common that it tells nothing
        beside = np.random.default_rng(p.space.seed).standard_normal((len(weight), p.sketch))
        latent = np.concatenate([vectors, np.zeros((len(rare) + 1, vectors.shape[1]))])
        beside *= (np.sqrt(np.maximum(1 - (latent**2).sum(axis=1), 0)) / np.linalg.norm(beside, axis=1))[:, None]
        self.vectors = (np.concatenate([latent, beside], axis=1) * weight[:, None]).astype(np.float32)
        pos = np.arange(max(len(flat) - p.window + 1, 0))
        pos = pos[owner[pos] == owner[pos + p.window - 1]]
        marks = self._marks(flat, pos)
        order = np.argsort(marks, kind="stable")
        self.marks, self.marked = marks[order], pos[order]
        at, left = pos - self.starts[owner[pos]], counts[owner[pos]]
        pos = pos[(at % p.apart == 0) | (at + p.window == left)]
        x = self._unit(sum(self.vectors[self.slot[flat[pos + j] & self.mask]] for j in range(p.window)))
        kept = x.any(axis=1)
        self.pos, x = pos[kept], x[kept]
        if len(x):
            self.centres, cell = _cluster(x, max(1, int(p.cells * len(x) ** 0.5)), p.space.seed)
            order = np.argsort(cell, kind="stable")
            self.pos, self.x = self.pos[order], x[order]
            self.bounds = np.searchsorted(cell[order], np.arange(len(self.centres) + 1))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-6)

    def place(self, flat: np.ndarray) -> np.ndarray:
        """Unit vectors of the windows that begin at every ``stride``-th word; zero where no word has a direction. Blocks of words are summed once."""
        p, n = self.p, (len(flat) - self.p.window) // self.p.stride + 1
        words = np.concatenate([self.slot[flat & self.mask], np.full(-len(flat) % p.stride, -1, np.int32)])
        blocks = self.vectors[words].reshape(-1, p.stride, self.vectors.shape[1])
        whole, more = p.window // p.stride, p.window % p.stride
        x = sum(blocks[k : k + n].sum(axis=1) for k in range(whole))
        return self._unit(x + blocks[whole : whole + n, :more].sum(axis=1) if more else x)

    def _marks(self, flat: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Hashes of the windows that begin at ``pos``."""
        h = np.zeros(len(pos), dtype=np.uint64)
        for j in range(self.p.window):
            h = (h ^ flat[pos + j].astype(np.uint32)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def _equal(self, flat: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in flat, positions in the items) of equal windows."""
        marks = self._marks(flat, pos)
        lo = np.searchsorted(self.marks, marks)
        hit = np.flatnonzero(self.marks.take(lo, mode="clip") == marks) if len(self.marks) else lo[:0]
        lo, n = lo[hit], np.searchsorted(self.marks, marks[hit], "right") - lo[hit]
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(pos[hit], n), self.marked[at]

    def candidates(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in flat, positions in the items) of window pairs that are equal, or of like meaning and mostly equal words; ``offsets`` of the texts in flat."""
        p = self.p
        pos = np.arange(0, len(flat) - p.window + 1, p.stride)
        row = np.searchsorted(offsets, pos, "right") - 1
        inner = pos + p.window <= offsets[row + 1]
        found = [self._equal(flat, pos[inner])]
        if not len(self.pos) or not inner.any():
            return found[0]
        x, pos = self.place(flat)[inner], pos[inner]
        near = x @ self.centres.T
        k = min(p.probes, near.shape[1])
        visit = near >= np.partition(near, near.shape[1] - k, axis=1)[:, -k][:, None]
        cell, rows = np.nonzero(visit.T)
        begin = np.searchsorted(cell, np.arange(len(self.centres) + 1))
        pairs = []
        for c in np.flatnonzero(np.diff(begin)):
            part, lo = rows[begin[c] : begin[c + 1]], self.bounds[c]
            i, j = np.nonzero(x[part] @ self.x[lo : self.bounds[c + 1]].T >= p.cosine)
            pairs.append((part[i], lo + j))
        a = pos[np.concatenate([i for i, _ in pairs])]
        b = self.pos[np.concatenate([j for _, j in pairs])]
        same = sum(self._same(flat, a + w, b + w) for w in range(p.window))
        a, b = a[same >= p.agree], b[same >= p.agree]
        run, best = np.zeros(len(a), dtype=np.int8), np.zeros(len(a), dtype=np.int8)
        for w in range(-p.passage, p.window + p.passage):  # best run of agreeing words around the window
            run = np.maximum(run + np.where(self._same(flat, a + w, b + w), 1, -1).astype(np.int8), 0)
            np.maximum(best, run, out=best)
        ok = best >= p.passage - 3
        found.append((a[ok], b[ok]))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def _same(self, flat: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """1 where the word at ``a`` is the item's at ``b`` or one of the two beside it on either side, words having been lost or put in."""
        word = flat.take(a, mode="clip")
        hit = word == self.flat.take(b, mode="clip")
        for d in (-2, -1, 1, 2):
            hit |= word == self.flat.take(b + d, mode="clip")
        return hit.astype(np.int8)

    def leaks(self, words: np.ndarray, at: np.ndarray, b: np.ndarray) -> list[int]:
        """Items that one text's candidate windows (``at`` in its words, ``b`` in the items) prove to be in it."""
        out, p = [], self.p
        owner = self.owner[b]
        for item in np.unique(owner):
            lo, hi = self.starts[item], self.starts[item + 1]
            mine = owner == item
            pairs = sorted(set(zip(at[mine].tolist(), b[mine].tolist())))
            if any(self._run(words, a, q, lo, hi) >= p.passage for a, q in pairs):
                out.append(int(item))
                continue
            tried = -1
            for a, q in pairs:
                if a < tried:
                    continue  # within the stretch that was just aligned
                begin, end = max(0, a - (q - lo) - 12), min(len(words), a + (hi - q) + 12)
                score, matched = alignment(words[begin:end], self.flat[lo:hi])
                tried = end - p.passage
                if score >= p.sure or (score >= p.passage and self._answers(lo + matched, lo, hi)):
                    out.append(int(item))
                    break
        return out

    def _run(self, words: np.ndarray, a: int, q: int, lo: int, hi: int) -> int:
        """Number of equal successive words, of which one is at ``a`` in the text and ``q`` in the items."""
        if words[a] != self.flat[q]:
            return 0
        begin, end = max(-self.p.passage, -a, lo - q), min(self.p.passage, len(words) - a, hi - q)
        off = np.flatnonzero(words[a + begin : a + end] != self.flat[q + begin : q + end]) + begin
        return int(min(off[off > 0], default=end) - max(off[off < 0], default=begin - 1)) - 1

    def _answers(self, matched: np.ndarray, lo: int, hi: int) -> bool:
        """Whether few matched words, with others between them, make a passage of this item: close together, and as telling as its words are on the whole.

        Stock phrases are of common words, and agree with gaps; a passage also has the
        names and things it is about.
        """
        near = len(matched) >= 0.8 * (matched[-1] - matched[0] + 1)
        return bool(near and self.weight[matched].mean() >= self.weight[lo:hi].mean())


def _search(index, key: str, item_key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: _Index = index.value
        p = ix.p
        for b in batches:
            flat, offsets = unpack(b.column("words"))
            docs, items = [], []
            step = _SLICE // p.stride * p.stride
            for lo in range(0, len(flat), step):
                piece = flat[lo : lo + step + p.window]
                a, q = ix.candidates(piece, np.append(offsets[np.searchsorted(offsets, lo, "right") - 1 :] - lo, len(flat) - lo + 1))
                a = a + lo
                row = np.searchsorted(offsets, a, "right") - 1
                order = np.argsort(row, kind="stable")
                a, q, row = a[order], q[order], row[order]
                for r in np.unique(row):
                    s, e = np.searchsorted(row, [r, r + 1])
                    words = flat[offsets[r] : offsets[r + 1]]
                    for item in ix.leaks(words, a[s:e] - offsets[r], q[s:e]):
                        docs.append(int(r))
                        items.append(ix.ids[item])
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(docs, pa.int64())), pa.array(items, pa.int64())], [key, item_key])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", params: Leaks = Leaks()) -> DataFrame:
    """(key, item_key), both bigint: documents whose text holds an item, whole or as a passage of ``passage`` words.

    Case, punctuation, blanks and line breaks don't count; changed, lost or misspelled
    words lower the alignment's score by one or two each. Null or empty texts and
    items, and items of fewer words than a window, match nothing. Repeated rows give
    one pair. The corpus is read once and its words kept as a table, which two passes learn the space
    from and one searches; nothing of it is shuffled but matrices of fixed size. Items
    are searched for in blocks of a bounded number, sent to all executors.
    """
    p = params
    words = cut(word_table(docs.where(f"{key} is not null"), key, text, ends=False))
    terms = telling_terms(words, p.space)
    vectors = singular_vectors(words, terms, p.space)
    spark = docs.sparkSession
    asked = items.where(F.col(item_key).isNotNull() & F.col(text).isNotNull()).select(F.col(item_key).cast("bigint").alias("i"), text).distinct()
    blocks = max(1, -(-asked.count() // p.items))
    found = None
    for k in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).orderBy("i", text).collect()  # about p.items rows
        flat, counts = word_ids([r[1] for r in held])
        counts = np.diff(within(np.concatenate([[0], np.cumsum(counts)]), flat != END))
        flat = flat[flat != END]
        index = spark.sparkContext.broadcast(_Index(np.array([r[0] for r in held], dtype=np.int64), flat, counts, terms, vectors, p))
        part = words.mapInArrow(_search(index, key, item_key), f"{key} {docs.schema[key].dataType.simpleString()}, {item_key} bigint")
        found = part if found is None else found.unionByName(part)
    return found.select(F.col(key).cast("bigint").alias(key), item_key).distinct()
