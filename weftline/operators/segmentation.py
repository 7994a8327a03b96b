"""Chapters and extraction windows of narratives."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.config import Windows

# How chapter headings begin, in the order they are tried; the last as it is written, the others in any case.
HEADINGS = (
    r"(?dimU)^[ \t]*Chapter\s+[IVXLCDM]+\.?(?=\s|$)",
    r"(?dimU)^[ \t]*Chapter\s+\d+\.?(?=\s|$)",
    r"(?dimU)^[ \t]*Chapter\s+the\s+[A-Za-z]+\b",
    r"(?dmU)^[ \t]*(?:[IVXLCDM]+|\d+)\.\s+[A-Z]",
)

_MARK, _OTHER = "\x01", "\x02"
_PARAGRAPH = re.compile(r"\n[ \t]*\n")


def chapter_spans(docs: DataFrame, cfg: Windows = Windows(), text: str = "cleaned_text") -> DataFrame:
    """(source_id, chapter_index, char_start, char_end) by the first kind of heading with enough of them.

    A heading may run over a line end. What stands before the first one is chapter 0; null and empty texts and texts without chapters have no row.
    Every heading gets a mark before it, the text is split there, and the pieces' lengths add up to the places, so all stays in the JVM; the window runs within one text.
    """
    plain = F.translate(text, _MARK, _OTHER)
    pieces = [F.split(F.regexp_replace(plain, f"({h})", f"{_MARK}$1"), _MARK) for h in HEADINGS]
    told = F.coalesce(*[F.when(F.size(p) > cfg.least_chapters, F.transform(p, F.length)) for p in pieces])
    parts = docs.where(F.length(text) > 0).select("source_id", F.posexplode(told).alias("pos", "n"))
    upto = F.sum("n").over(Window.partitionBy("source_id").orderBy("pos"))
    spans = parts.select("source_id", "pos", (upto - F.col("n")).alias("char_start"), upto.alias("char_end"), F.first("n").over(Window.partitionBy("source_id").orderBy("pos")).alias("before"))
    return spans.where("pos > 0 or n > 0").select("source_id", F.when(F.col("before") > 0, F.col("pos")).otherwise(F.col("pos") - 1).alias("chapter_index"), "char_start", "char_end")


def approximate_tokens(text: str) -> np.ndarray:
    """Ends of tokens of about four characters: a word's pieces with the blanks before them. For where no vocabulary is at hand."""
    return np.array([m.end() for m in re.finditer(r"\s*\S{1,4}|\s+", text)], dtype=np.int64)


@lru_cache(maxsize=2)
def vocabulary_tokens(path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """Ends, in code points, of the tokens of a byte-pair vocabulary (a rank file) that cuts texts by ``pattern`` first.

    A token may end within a character; that character counts as reached.
    """
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    size[list(ranks.values())] = [len(b) for b in ranks]

    def ends(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        points = np.cumsum((raw & 0xC0) != 0x80)
        return points[np.cumsum(size[coder.encode_ordinary(text)]) - 1] if len(raw) else points

    return ends


def count_tokens(text: str, tokenize: Callable[[str], np.ndarray] = approximate_tokens) -> int:
    return len(tokenize(text))


def window_bounds(text: str, most: int, cfg: Windows, tokenize: Callable[[str], np.ndarray] = approximate_tokens) -> list[tuple[int, int]]:
    """(start, end) of windows of at most ``most`` tokens that cover the text, each beginning ``overlap`` tokens before the last one's end by tokens.

    The k-th window ends at token most + k * (most - overlap), and all but the last end at the blank line nearest to that within ``snap`` tokens of
    four characters, if the window keeps to ``most`` tokens then.
    """
    at = np.concatenate([[0], tokenize(text)])
    total = len(at) - 1
    n = 1 + max(0, -(-(total - most) // (most - cfg.overlap)))
    stops = np.minimum(most + np.arange(n) * (most - cfg.overlap), total)
    starts = at[np.concatenate([[0], np.maximum(stops[:-1] - cfg.overlap, 0)])].tolist()
    ends = [*at[stops[:-1]].tolist(), len(text)]
    for k in range(n - 1):
        breaks = np.array([m.end() for m in _PARAGRAPH.finditer(text, max(0, ends[k] - cfg.snap * 4), ends[k] + cfg.snap * 4)])
        if len(breaks):
            near = int(breaks[np.argmin(np.abs(breaks - ends[k]))])
            if near > starts[k] and len(tokenize(text[starts[k] : near])) <= most:
                ends[k] = near
    return list(zip(starts, ends))


def extraction_windows(docs: DataFrame, cfg: Windows = Windows(), text: str = "cleaned_text", tokenize: Callable[[str], np.ndarray] = approximate_tokens) -> DataFrame:
    """(source_id, chapter_index, window_index, char_start, char_end): chapters, the long ones in windows; texts without chapters in windows that count as chapters."""
    spans = chapter_spans(docs, cfg, text).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("chapter_index", "char_start", "char_end"))).alias("chapters"))
    rows = docs.where(F.length(text) > 0).select("source_id", F.col(text).alias("t")).join(spans, "source_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, t, chapters in zip(*(b.column(c).to_pylist() for c in ("source_id", "t", "chapters"))):
                if not chapters:
                    out += [(s, i, None, a, e) for i, (a, e) in enumerate(window_bounds(t, cfg.fallback, cfg, tokenize))]
                    continue
                for c in chapters:
                    lo = c["char_start"]
                    got = window_bounds(t[lo : c["char_end"]], cfg.most, cfg, tokenize)
                    out += [(s, c["chapter_index"], k if len(got) > 1 else None, lo + a, lo + e) for k, (a, e) in enumerate(got)]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["source_id", "chapter_index", "window_index", "char_start", "char_end"])

    return rows.mapInArrow(run, "source_id string, chapter_index int, window_index int, char_start bigint, char_end bigint")
