"""Fixed-size chunks of narratives and the interval join of spans with chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import Chunking
from weftline.functions.text import chunk_starts, content_id


def chunk_documents(docs: DataFrame, cfg: Chunking = Chunking(), source: str = "source_id", text: str = "cleaned_text") -> DataFrame:
    """(chunk_id, source_id, char_start, char_end, text); null and empty texts have no chunk. A projection, without a shuffle."""
    starts = docs.where(F.length(text) > 0).select(F.col(source).alias("source_id"), F.col(text).alias("_t"), F.explode(chunk_starts(F.col(text), cfg.size, cfg.overlap)).alias("char_start"))
    return starts.select("source_id", "char_start", F.least(F.col("char_start") + cfg.size, F.length("_t")).alias("char_end"), F.substring("_t", F.col("char_start") + 1, F.lit(cfg.size)).alias("text")).select(
        content_id(F.col("source_id"), F.col("char_start"), F.col("char_end"), F.col("text")).alias("chunk_id"), "source_id", "char_start", "char_end", "text"
    )


def overlapping(spans: DataFrame, chunks: DataFrame, key: str = "source_id", width: int = 700) -> DataFrame:
    """Inner join of half-open spans (key, span_start, span_end, ..) and chunks (key, char_start, char_end, ..) that overlap.

    Both sides are spread over cells of ``width`` positions, which makes it an equi-join;
    a pair is kept in the first cell both share, so it appears once.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    s = spans.where("span_end > span_start").withColumn("_cell", cells("span_start", "span_end"))
    c = chunks.where("char_end > char_start").withColumn("_cell", cells("char_start", "char_end"))
    joined = s.join(c, [key, "_cell"]).where("char_start < span_end and span_start < char_end")
    return joined.where(F.col("_cell") == F.floor(F.greatest("span_start", "char_start") / width)).drop("_cell")
