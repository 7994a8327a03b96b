"""Strict parsing of model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import content_id


def strip_fence(text: Column) -> Column:
    """Without a Markdown code fence around the whole."""
    inner = F.regexp_extract(F.trim(text), r"(?s)^```(?:json)?\s*\n?(.*?)\n?```\s*$", 1)
    return F.when(F.trim(text).startswith("```") & (inner != ""), inner).otherwise(text)


def parse_list(answers: DataFrame, key: str, answer: str, fenced: bool = True, questions: bool = False, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(items, errors) of answers that should be JSON arrays of strings.

    Items are trimmed, empty ones dropped, repeats dropped whatever their case (the first stays) and numbered
    anew; for questions only those that end in a question mark stay. An answer that isn't such
    an array, has more than ``most`` items or (unless questions) none, is an error with a reason.
    """
    text = strip_fence(F.col(answer)) if fenced else F.col(answer)
    parsed = answers.select(key, F.from_json(text, "array<string>").alias("a"))
    items = parsed.select(key, F.posexplode_outer("a").alias("pos", "text")).withColumn("text", F.trim("text")).where("text is not null and text <> ''")
    if questions:
        items = items.where(F.col("text").endswith("?"))
    first = Window.partitionBy(key, F.lower("text")).orderBy("pos")
    items = items.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("index", (F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1))
    n = items.groupBy(key).agg(F.count("*").alias("n"))
    state = parsed.join(n, key, "left").select(key, F.when(F.col("a").isNull(), "not a JSON array").when(F.coalesce("n", F.lit(0)) > most, "too many items").when(F.lit(not questions) & F.col("n").isNull(), "no items").alias("reason"))
    errors = state.where("reason is not null")
    good = items.join(errors, key, "left_anti").select(content_id(F.col(key), F.col("index"), F.col("text")).alias("item_id"), key, "index", "text")
    return good, errors
