"""Problem 8: filling fixed-capacity containers with texts of varying token counts.

Sizes are rounded up to a grid and counted. Shallow combinations of sizes that fill a
container, or nearly, are enumerated; non-negative least squares finds how often
to repeat each so that the histogram is met; counts are rounded down, and what is left is packed
greedily, largest first, as patterns with repeats. All that works on the histogram,
whose size is a parameter. Items then look up their containers by their number among those of their size.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary's tokenizer cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass(frozen=True)
class Packing:
    """capacity: tokens of a container. grid: sizes told apart. depth: most items of an enumerated combination.
    window: tokens a combination may leave empty, in grid steps. vocabulary: of the tokenizer. rounds: of the solver.
    """

    capacity: int = 2048
    grid: int = 256
    depth: int = 4
    window: int = 1
    vocabulary: str = VOCABULARY
    rounds: int = 400

    def __post_init__(self) -> None:
        if self.capacity % self.grid:
            raise ValueError("the grid must divide the capacity")

    @property
    def step(self) -> int:
        return self.capacity // self.grid


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class TokenCounter:
    """Tokens of a text, counting each distinct word once per worker; special tokens' strings are ordinary text."""

    def __init__(self, path: str) -> None:
        import regex

        self._find, self._encode, self._known = regex.compile(PATTERN).findall, _tokenizer(path).encode_ordinary, {}

    def __call__(self, text: str) -> int:
        known, total = self._known, 0
        for w in self._find(text):
            n = known.get(w)
            if n is None:
                if len(known) > 500_000:
                    known.clear()
                n = known[w] = len(self._encode(w))
            total += n
        return total


def token_sizes(docs: DataFrame, key: str, text: str, p: Packing) -> DataFrame:
    """(key, tokens, piece, token_start, token_end, bin, part, seq): pieces of the texts and their place among equals.

    A text over the capacity is cut into whole containers and a rest, by tokens. bin: size on the grid, rounded up.
    seq: number of the piece among those of its bin in its partition, part. Null and
    empty texts have one piece of no tokens, in bin 0.
    """
    step = p.step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count, seen = TokenCounter(p.vocabulary), np.zeros(p.grid + 1, dtype=np.int64)
        part = TaskContext.get().partitionId()
        for b in batches:
            tokens = np.array([count(t) if t else 0 for t in b.column(1).to_pylist()], dtype=np.int64)
            pieces = np.maximum(-(-tokens // p.capacity), 1)
            row = np.repeat(np.arange(len(tokens)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * p.capacity
            end = np.minimum(start + p.capacity, tokens[row])
            size = -(-(end - start) // step)
            order = np.argsort(size, kind="stable")
            counts = np.bincount(size, minlength=p.grid + 1)
            seq = np.empty(len(row), dtype=np.int64)
            seq[order] = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + seen[size[order]]
            seen += counts
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(tokens[row]), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(end), pa.array(size.astype(np.int32)), pa.array(np.full(len(row), part, np.int32)), pa.array(seq)],
                [key, "tokens", "piece", "token_start", "token_end", "bin", "part", "seq"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, tokens bigint, piece int, token_start bigint, token_end bigint, bin int, part int, seq bigint")


def combinations(sizes: np.ndarray, grid: int, depth: int, window: int) -> list[tuple[int, ...]]:
    """Descending combinations of at most ``depth`` present sizes that sum to grid - window .. grid.

    The last item of one is the largest that fits, so a combination is fixed by the ones before it;
    from the fourth item on all but the first two are equal, which keeps their number near grid squared.
    """
    present = np.zeros(grid + 1, dtype=bool)
    present[sizes] = True
    found: set[tuple[int, ...]] = set()

    def close(head: tuple[int, ...]) -> None:
        gap = grid - sum(head)
        if gap <= window:
            found.add(head)
        for last in range(min(head[-1], gap), max(0, gap - window - 1), -1):
            if last and present[last]:
                found.add((*head, last))

    for a in sizes.tolist():
        close((a,))
        for b in sizes[(sizes <= a) & (sizes < grid - a)].tolist():
            if depth >= 3:
                close((a, b))
            for k in range(2, depth - 1):
                if a + k * b < grid and depth >= k + 2:
                    close((a, *[b] * k))
        for k in range(2, grid // a + 1):  # one size repeated as often as it fits
            if k * a <= grid:
                close((a,) * k)
    return sorted((tuple(sorted(c, reverse=True)) for c in found), reverse=True)


def repeat_counts(histogram: np.ndarray, combos: list[tuple[int, ...]], rounds: int) -> np.ndarray:
    """Non-negative least squares of combos x counts = histogram, weighted by size; accelerated projected gradient."""
    member = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    size = np.array([s for c in combos for s in c], dtype=np.int64)
    weight = np.sqrt(np.arange(len(histogram)) + 1.0) / np.sqrt(len(histogram))
    scale = max(float(histogram.max()), 1.0)
    target = histogram / scale * weight
    ahead = lambda x: np.bincount(size, weights=x[member], minlength=len(histogram)) * weight
    back = lambda r: np.bincount(member, weights=(r * weight)[size], minlength=len(combos))
    x = np.random.default_rng(3).random(len(combos))
    for _ in range(15):  # the largest eigenvalue bounds the step
        x = back(ahead(x))
        norm = np.linalg.norm(x)
        x /= norm
    x, y, t = np.zeros(len(combos)), np.zeros(len(combos)), 1.0
    for _ in range(rounds):
        new = np.maximum(y - back(ahead(y) - target) / (norm * 1.05), 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x * scale


def plan_patterns(histogram: np.ndarray, p: Packing) -> list[tuple[tuple[int, ...], int]]:
    """(sizes, repeats) that hold exactly the histogram's items, none over the grid."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[tuple[int, ...], int]] = []
    sizes = np.flatnonzero(left)
    combos = combinations(sizes, p.grid, p.depth, p.window) if len(sizes) else []
    if combos:
        counts = np.floor(repeat_counts(left.astype(float), combos, p.rounds) + 0.01).astype(np.int64)
        for k in np.argsort(-counts, kind="stable"):
            if counts[k] <= 0:
                break
            held, need = np.unique(combos[k], return_counts=True)
            n = int(min(counts[k], (left[held] // need).min()))
            if n > 0:
                plan.append((combos[k], n))
                left[held] -= need * n
    while (sizes := np.flatnonzero(left)).size:
        pattern: dict[int, int] = {}
        room = p.grid
        for s in sizes[::-1].tolist():
            n = min(room // s, int(left[s]))
            if n:
                pattern[s] = n
                room -= n * s
        n = int(min(left[s] // k for s, k in pattern.items()))
        plan.append((tuple(s for s, k in pattern.items() for _ in range(k)), n))
        for s, k in pattern.items():
            left[s] -= k * n
    return plan


def _slots(plan: list[tuple[tuple[int, ...], int]], grid: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By size: (first item number, first container, items per container) of each stretch of equal patterns."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    given = [0] * (grid + 1)
    container = 0
    for pattern, n in plan:
        for s, k in zip(*np.unique(pattern, return_counts=True)):
            by.setdefault(int(s), []).append((given[s], container, int(k)))
            given[s] += int(k) * n
        container += n
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for s, v in by.items()}


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", params: Packing = Packing()) -> DataFrame:
    """(key, piece, token_start, token_end, container): every text in one container, oversized ones in several.

    Null and empty texts take no room and go to container 0. A repeated row is an item of its
    own. Containers are numbered from 0 without gaps, and no container holds more than the
    capacity. Sizes are rounded up by less than capacity/grid tokens. Nothing is shuffled but the
    counts of each partition; any number of items of one size spreads over all tasks.
    """
    p = params
    sized = cut(token_sizes(docs, key, text, p))
    counts = cut(sized.groupBy("part", "bin").agg(F.count("*").alias("n")))
    histogram = np.zeros(p.grid + 1)
    for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most grid + 1 rows
        histogram[r["bin"]] = r["n"]
    slots = sized.sparkSession.sparkContext.broadcast(_slots(plan_patterns(histogram, p), p.grid))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = sized.join(before.select("part", "bin", F.coalesce("before", F.lit(0)).alias("before")), ["part", "bin"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for b in batches:
            size, number = b.column(4).to_numpy(), b.column(5).to_numpy()
            out = np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size):
                if s == 0:
                    continue
                first, container, each = table[int(s)]
                mine = size == s
                at = np.searchsorted(first, number[mine], "right") - 1
                out[mine] = container[at] + (number[mine] - first[at]) // each[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out)], [key, "piece", "token_start", "token_end", "container"])

    kind = docs.schema[key].dataType.simpleString()
    return numbered.select(key, "piece", "token_start", "token_end", "bin", (F.col("seq") + F.col("before")).alias("number")).mapInArrow(
        run, f"{key} {kind}, piece int, token_start bigint, token_end bigint, container bigint"
    )


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """(containers, tokens, fill, fullest): how well the containers are filled."""
    each = packed.groupBy("container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"))
    return each.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / (F.count("*") * capacity), 6).alias("fill"), F.max("tokens").alias("fullest"))
