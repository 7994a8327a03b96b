"""Resolving quotes to places in texts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.config import Quotes
from weftline.functions.text import canonical_text

# Typographic signs and what stands for them in the form quotes are compared in.
SIGNS = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."})

_RUN = re.compile(r"\S+")


class Canonical:
    """The compared form of a text as words, with the places they came from.

    ``words`` are the runs without a blank, their signs replaced; ``begins`` where each stands in the form, ``raw`` where its run
    stands in the text. A place of the form is found by its word and its distance from the word's begin.
    """

    def __init__(self, text: str) -> None:
        runs = list(_RUN.finditer(text))
        self.runs = [m.group() for m in runs]
        self.words = [r.translate(SIGNS) for r in self.runs]
        self.text = " ".join(self.words)
        self.begins = np.cumsum([0, *[len(w) + 1 for w in self.words]])
        self.raw = [m.start() for m in runs]

    def origin(self, at: int) -> int:
        """The text's position of a character of the form; a blank belongs to the word before it."""
        k = int(np.searchsorted(self.begins, at, "right")) - 1
        run, off = self.runs[k], at - int(self.begins[k])
        if len(run) != len(self.words[k]):  # signs that became several characters
            off = int(np.searchsorted(np.cumsum([len(c.translate(SIGNS)) for c in run]), off, "right"))
        return self.raw[k] + off

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.origin(start), self.origin(end - 1) + 1


def least_fuzzy_words(cfg: Quotes) -> int:
    """Fewest words of a quote that can agree but for one: shorter quotes are exact or failed."""
    return max(1, math.ceil(round(1 / (1 - cfg.overlap), 9))) if cfg.overlap < 1 else 1 << 30


def place_quote(quote: str, text: str, cfg: Quotes = Quotes()) -> tuple[str, int | None, int | None, bool]:
    """(tier, start, end, ambiguous) of a quote: EXACT in the compared form, else FUZZY, else FAILED.

    Fuzzy: of all windows of as many words the one that agrees best word by word, the first of several, if its share and its lead over the next suffice.
    """
    whole, asked = Canonical(text), Canonical(quote)
    failed = ("FAILED", None, None, False)
    if not asked.text:
        return failed
    found = whole.text.find(asked.text)
    if found >= 0:
        return "EXACT", *whole.span(found, found + len(asked.text)), whole.text.count(asked.text) > 1
    n = len(asked.words)
    if n < least_fuzzy_words(cfg) or n > len(whole.words):
        return failed
    known = {w: i for i, w in enumerate(asked.words)}
    ids = np.array([known.get(w, -1) for w in whole.words])
    agree = (np.lib.stride_tricks.sliding_window_view(ids, n) == np.array([known[w] for w in asked.words])).sum(axis=1)
    best = int(np.argmax(agree))
    rest = np.delete(agree, best)
    share = agree[best] / n
    if share < cfg.overlap or (len(rest) and share - rest.max() / n < cfg.margin):
        return failed
    return "FUZZY", *whole.span(int(whole.begins[best]), int(whole.begins[best + n]) - 1), False


def _occurrences(text: Column, quote: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, quote, F.lit("")))) / F.length(quote)).cast("bigint")


def exact_quotes(quotes: DataFrame, text: str = "text", quote: str = "quote") -> DataFrame:
    """``quotes`` with canon_start and occurrences of the quote in the compared form of its text; no Python."""
    q, t = canonical_text(F.col(quote)), canonical_text(F.col(text))
    out = quotes.withColumn("_q", q).withColumn("_t", t)
    found, n = F.when(F.length("_q") > 0, F.expr("locate(_q, _t)")), F.when(F.length("_q") > 0, _occurrences(F.col("_t"), F.col("_q")))
    return out.withColumn("canon_start", found - 1).withColumn("occurrences", n).drop("_q", "_t")


def resolve_quotes(quotes: DataFrame, key: list[str], cfg: Quotes = Quotes()) -> DataFrame:
    """(key.., tier, char_start, char_end, ambiguous) of quotes (key.., quote, text), in positions of the text.

    Null quotes and texts fail. Quotes found in a text that is its own compared form have their place from the JVM, and so have the failures of quotes
    too short for the fuzzy tier; only the others go to Python, where places are traced back or windows of words compared.
    """
    kinds = ", ".join(f"{k} {quotes.schema[k].dataType.simpleString()}" for k in key)
    schema = f"{kinds}, tier string, char_start int, char_end int, ambiguous boolean"
    q, t = canonical_text(F.coalesce("quote", F.lit(""))), canonical_text(F.coalesce("text", F.lit("")))
    rows = quotes.select(*key, F.coalesce("quote", F.lit("")).alias("_quote"), F.coalesce("text", F.lit("")).alias("_text"), q.alias("_q"), t.alias("_t"))
    rows = rows.withColumn("_at", F.when(F.length("_q") > 0, F.expr("locate(_q, _t)")).otherwise(0))
    short = F.size(F.split("_q", " ")) < least_fuzzy_words(cfg)
    plain = (F.col("_at") > 0) & (F.col("_text") == F.col("_t"))
    lost = (F.col("_at") == 0) & (short | (F.length("_q") == 0))
    none = F.lit(None).cast("int")
    at = F.col("_at").cast("int")
    told = rows.where(plain | lost).select(
        *key, F.when(plain, "EXACT").otherwise("FAILED").alias("tier"), F.when(plain, at - 1).otherwise(none).alias("char_start"), F.when(plain, at - 1 + F.length("_q")).otherwise(none).alias("char_end"),
        (plain & (_occurrences(F.col("_t"), F.when(F.length("_q") > 0, F.col("_q"))) > 1)).alias("ambiguous"),
    )
    told = told.withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [place_quote(q, t, cfg) for q, t in zip(b.column("_quote").to_pylist(), b.column("_text").to_pylist())]
            cols = list(zip(*got)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in key], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.bool_())], [*key, "tier", "char_start", "char_end", "ambiguous"])

    return told.unionByName(rows.where(~(plain | lost)).select(*key, "_quote", "_text").mapInArrow(run, schema))


def clip_to_chunks(overlaps: DataFrame, fact: list[str]) -> DataFrame:
    """(fact.., chunk_id, char_start, char_end): each span cut to the chunks it overlaps, once."""
    return overlaps.select(*fact, "chunk_id", F.greatest("span_start", "char_start").alias("char_start"), F.least("span_end", "char_end").alias("char_end")).distinct()


def verified_quotes(quotes: DataFrame, evidence: DataFrame, key: str = "claim_id") -> tuple[DataFrame, DataFrame]:
    """(anchors (key, chunk_id), rejected (key, reason)) of quotes (key, pos, quote) against evidence (key, pos, chunk_id, text).

    Every quote has to stand exactly, in the compared form, in some evidence text of its key. The anchor is the first text, by pos, that holds the first quote; a key
    without quotes is anchored at its first text. Joined by key, so a quote meets only its own evidence.
    """
    q = quotes.where("quote is not null").select(key, F.col("pos").alias("_q"), canonical_text(F.col("quote")).alias("_quote"))
    e = evidence.where("text is not null").select(key, F.col("pos").alias("_e"), "chunk_id", canonical_text(F.col("text")).alias("_text"))
    held = q.join(e, key).where(F.col("_text").contains(F.col("_quote")) & (F.col("_quote") != "")).groupBy(key, "_q").agg(F.min_by("chunk_id", "_e").alias("chunk_id"))
    each = q.select(key, "_q").join(held, [key, "_q"], "left")
    per = each.groupBy(key).agg(F.min_by("chunk_id", "_q").alias("quoted"), F.bool_or(F.col("chunk_id").isNull()).alias("lost"))
    first = evidence.groupBy(key).agg(F.min_by("chunk_id", "pos").alias("first"))
    state = first.join(per, key, "full")
    reason = F.when(F.col("first").isNull(), "no evidence").when(F.col("lost"), "a quote is in no evidence text")
    state = state.withColumn("reason", reason)
    return state.where("reason is null").select(key, F.coalesce("quoted", "first").alias("chunk_id")), state.where("reason is not null").select(key, "reason")


def resolve_facts(quotes: DataFrame, windows: DataFrame, chunks: DataFrame, cfg: Quotes = Quotes(), width: int = 700) -> tuple[DataFrame, DataFrame]:
    """(provenance (kind, fact_id, chunk_id, char_start, char_end), rejected (kind, fact_id, reason)) of facts' quotes (kind, fact_id, window_id, quote).

    kind tells entities, relations and events apart; windows (window_id, source_id, char_start, text) are the texts that were read, chunks (chunk_id, source_id, char_start,
    char_end) what facts are traced to. A fact of which no quote resolves, or none to a chunk, is rejected.
    """
    from weftline.operators.chunking import overlapping

    asked = quotes.join(windows.select("window_id", "source_id", F.col("char_start").alias("_w"), "text"), "window_id")
    placed = resolve_quotes(asked, ["kind", "fact_id", "source_id", "_w"], cfg).where("tier <> 'FAILED'")
    spans = placed.select("kind", "fact_id", "source_id", (F.col("_w") + F.col("char_start")).alias("span_start"), (F.col("_w") + F.col("char_end")).alias("span_end"))
    found = clip_to_chunks(overlapping(spans, chunks.select("chunk_id", "source_id", "char_start", "char_end"), "source_id", width), ["kind", "fact_id"])
    state = quotes.select("kind", "fact_id").distinct().join(spans.select("kind", "fact_id", F.lit(True).alias("_s")).distinct(), ["kind", "fact_id"], "left").join(found.select("kind", "fact_id", F.lit(True).alias("_c")).distinct(), ["kind", "fact_id"], "left")
    reason = F.when(F.col("_s").isNull(), "no quote resolves").when(F.col("_c").isNull(), "no chunk holds it")
    return found, state.withColumn("reason", reason).where("reason is not null").select("kind", "fact_id", "reason")
