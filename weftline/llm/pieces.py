"""Problem 3: cutting oversized texts at natural boundaries, with overlap.

Content-defined: a rolling hash over the last characters marks landmarks; a cut is
the first landmark past the minimum size, moved to the nearest natural boundary
that keeps the piece between minimum and maximum. Cuts depend on nearby text only, so
an edit changes the pieces around it and later cuts fall where they fell before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words whose full stop doesn't end a sentence.
ABBREVIATIONS = frozenset("mr mrs ms dr st mt prof rev hon capt col gen lt sgt sr jr no vol ch pp fig vs etc cf i.e e.g a.m p.m bzw z.b d.h m mme mlle".split())

PARAGRAPH, SENTENCE, CLAUSE, WORD = 4, 3, 2, 1
_BREAKS = re.compile(r"(?P<para>\n[^\S\n]*\n\s*)|(?P<line>\n\s*)|(?P<stop>[.!?…]+[\"'”’»)\]]*\s+)|(?P<clause>[,;:—–][\"'”’»)\]]*\s+)|(?P<word>\s+)")
_LAST_WORD = re.compile(r"[\w.]*\Z")
_ROLL = 32


@dataclass(frozen=True)
class PieceSize:
    """limit: most code points in a piece, overlap included. overlap: wanted between neighbours.
    slack: by how much the overlap may exceed the wanted one to reach a boundary.
    least: fewest new code points in a piece but the last. mask: a landmark is where the hash has these bits zero.
    """

    limit: int = 700
    overlap: int = 120
    slack: int = 20
    least: int = 240
    mask: int = 0x7F

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.limit or self.least < 1 or self.least >= self.limit - self.overlap - self.slack:
            raise ValueError("need 0 <= overlap < limit and 1 <= least < limit - overlap - slack")


def boundaries(text: str) -> np.ndarray:
    """Strength of a cut before each code point: 0 none, else PARAGRAPH, SENTENCE, CLAUSE or WORD."""
    strength = np.zeros(len(text) + 1, dtype=np.int8)
    for m in _BREAKS.finditer(text):
        kind = m.lastgroup
        if kind == "para":
            value = PARAGRAPH
        elif kind == "line":
            value = SENTENCE
        elif kind == "clause":
            value = CLAUSE
        elif kind == "word":
            value = WORD
        else:
            value = SENTENCE
            if text[m.start()] == "." and m.end() < len(text):
                word = _LAST_WORD.search(text, max(0, m.start() - 12), m.start()).group().lower()
                if text[m.end()].islower() or word in ABBREVIATIONS or (len(word) == 1 and word.isalpha()):
                    value = WORD
        strength[m.end()] = value
    strength[0] = strength[-1] = 0
    return strength


def rolling_hash(text: str) -> np.ndarray:
    """Hash of the last 32 code points before each position, from a multiplicative mix of each; wraps at 32 bits."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = points * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    width = 1
    while width < _ROLL:
        h[width:] += h[:-width] << np.uint32(width)  # the right side is a copy, so this doubles the window
        width *= 2
    return h ^ (h >> np.uint32(16))


def _nearest(strength: np.ndarray, low: int, high: int, to: int, least: int) -> int | None:
    """The position in [low, high] nearest to ``to`` whose boundary is at least so strong; the earlier of two. A paragraph's end may be twice as far as another."""
    at = np.flatnonzero(strength[low : high + 1] >= least)
    if not len(at):
        return None
    at += low
    return int(at[np.argmin(np.abs(at - to) * np.where(strength[at] == PARAGRAPH, 1, 2))])


def cut_points(text: str, size: PieceSize = PieceSize()) -> list[tuple[int, int]]:
    """(start, end) of the pieces of one text, in order; one pair for a text within the limit, none for ''."""
    n = len(text)
    if n <= size.limit:
        return [(0, n)] if n else []
    strength, marks = boundaries(text), rolling_hash(text)
    most = size.limit - size.overlap - size.slack
    out, start, fresh = [], 0, 0
    while n - start > size.limit:
        low, high = fresh + size.least, min(fresh + most, n - 1)
        landmarks = np.flatnonzero((marks[low - 1 : high] & np.uint32(size.mask)) == 0)
        landmark = low + int(landmarks[0] if len(landmarks) else np.argmin(marks[low - 1 : high]))
        end = landmark
        for least in (SENTENCE, CLAUSE, WORD):
            if (at := _nearest(strength, low, high, landmark, least)) is not None:
                end = at
                break
        out.append((start, end))
        fresh = end
        wanted = end - size.overlap
        back = _nearest(strength, max(wanted - size.slack, start + 1), end - 1, wanted, WORD)
        start = wanted if back is None else back
    out.append((start, n))
    return out


def _pieces_of_batch(size: PieceSize, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, ids = b.column(0), b.column(1)
            row, index, begin, end, texts = [], [], [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                if t is None:
                    continue
                for k, (s, e) in enumerate(cut_points(t, size)):
                    row.append(i)
                    index.append(k)
                    begin.append(s)
                    end.append(e)
                    if with_text:
                        texts.append(t[s:e])
            take = pa.array(row, pa.int32())
            columns = [kinds.take(take), ids.take(take), pa.array(index, pa.int32()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())]
            names = ["item_kind", "item_id", "piece_index", "char_start", "char_end"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def split_items(items: DataFrame, size: PieceSize = PieceSize(), with_text: bool = True) -> DataFrame:
    """(item_kind, item_id, piece_index, char_start, char_end[, text]) of items (item_kind, item_id, text).

    Every piece is text[char_start:char_end] in code points and at most ``limit`` long;
    the pieces of an item cover it without a gap. A null or empty text has no piece,
    one within the limit is its own piece. Rows given twice are cut twice. No shuffle.
    """
    schema = "item_kind string, item_id string, piece_index int, char_start int, char_end int" + ", text string" * with_text
    return items.select("item_kind", "item_id", "text").mapInArrow(_pieces_of_batch(size, with_text), schema)


def narrative_items(raw_documents: DataFrame, document_chunks: DataFrame) -> DataFrame:
    """Documents (cleaned_text) and chunks as items; rows without an id are left out."""
    docs = raw_documents.select(F.lit("document").alias("item_kind"), F.col("source_id").alias("item_id"), F.col("cleaned_text").alias("text"))
    chunks = document_chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "text")
    return docs.unionByName(chunks).where("item_id is not null")


def oversized_items(items: DataFrame, size: PieceSize = PieceSize()) -> DataFrame:
    """(item_kind, item_id) of the items that had to be cut."""
    return split_items(items, size, with_text=False).where("piece_index = 1").select("item_kind", "item_id").distinct()
