"""Readers and writers of the engine's files; schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import clean_text

GOLD = "example_id string, narrative_path string, original_claim string, expected_verdict string, gold_evidence array<struct<char_start:int,char_end:int,note:string>>, gold_contradicting_spans array<struct<char_start:int,char_end:int,note:string>>"


def read_texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents (source_id, raw_text, cleaned_text), rejects (source_id, reason)): whole files, strictly UTF-8; what is invalid or empty is rejected."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_id"), F.is_valid_utf8(F.col("content").cast("string")).alias("ok"), F.col("content").cast("string").alias("raw_text"))
    cleaned = files.withColumn("cleaned_text", clean_text(F.col("raw_text")))
    reason = F.when(~F.col("ok"), "not UTF-8").when(F.coalesce(F.length("cleaned_text"), F.lit(0)) == 0, "empty")
    cleaned = cleaned.withColumn("reason", reason)
    return cleaned.where("reason is null").select("source_id", "raw_text", "cleaned_text"), cleaned.where("reason is not null").select("source_id", "reason")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold examples, one JSON object a line, blank lines skipped; a bad line fails the read, and so does a file without examples."""
    gold = spark.read.schema(GOLD).option("mode", "FAILFAST").json(path)
    if not gold.take(1):
        raise ValueError(f"no examples in {path}")
    return gold


def read_claims(spark: SparkSession, path: str, has_label: bool = True) -> DataFrame:
    """Claims as CSV with a header; quoted fields may hold commas, quotes and line breaks."""
    schema = "id string, book_name string, char string, caption string, content string" + ", label string" * has_label
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_cache(spark: SparkSession, path: str, schema: str, key: str = "key") -> DataFrame:
    """A key-value cache, one JSON object a line; of a key written again the last entry counts: in the file written last, by time and then name, and there on the last line."""
    lines = spark.read.text(path).select("value", "_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_line"))
    place = ["file_modification_time", "file_path", "file_block_start", "_line"]
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", schema).alias("_v"), F.struct(*place).alias("_at"))
    return rows.groupBy(F.col(f"_v.{key}").alias("_k")).agg(F.max_by("_v", "_at").alias("_v")).where("_k is not null").select("_v.*")


def remaining(rows: DataFrame, checkpoint: DataFrame, key: str) -> DataFrame:
    """Rows that an earlier run didn't finish."""
    return rows.join(checkpoint.select(key).distinct(), key, "left_anti")
