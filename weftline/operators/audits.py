"""Audits of merged mentions: what kind each key is, how large components grow, and what weak keys would do alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import PARTICLES, is_weak_key, words_array
from weftline.operators.graph import component_labels
from weftline.session import cut


def key_kinds(keys: DataFrame, mentions: DataFrame, given: tuple[str, ...] = ()) -> DataFrame:
    """(source_id, key, kind, n_mentions) of merge keys (source_id, mention_id, key, pos) and mentions (mention_id, type).

    By the most frequent type of the key's mentions (of several the first by name), by whether it is any mention's own name, and by its words;
    ``given``: known given names.
    """
    rows = keys.groupBy("source_id", "key", "mention_id").agg(F.min("pos").alias("pos")).join(mentions.select("mention_id", "type"), "mention_id")
    types = rows.groupBy("source_id", "key", "type").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    per = types.groupBy("source_id", "key").agg(F.min_by("type", F.struct(-F.col("n"), "type")).alias("type"), F.sum("n").alias("n_mentions"), (F.min("pos") == 0).alias("own"))
    words = F.split("key", " ")
    first, known = F.element_at(words, 1), words_array(given) if given else F.array().cast("array<string>")
    kind = (
        F.when(F.col("type") == "LOCATION", "location").when(F.col("type") == "ORGANIZATION", "organization").when(~F.col("own"), "alias")
        .when((F.size(words) == 1) & F.array_contains(known, first), "given name").when(F.size(words) == 1, "surname")
        .when(F.array_contains(words_array(PARTICLES), first), "surname with particle")
        .when(F.array_contains(known, first) | ~F.array_contains(words_array(PARTICLES), F.element_at(words, -1)), "full name").otherwise("other")
    )
    return per.select("source_id", "key", kind.alias("kind"), "n_mentions")


def _stars(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(rows.groupBy(*by).agg(F.min("mention_id").alias("a")), by).where("mention_id <> a").select("a", F.col("mention_id").alias("b"))


def key_components(keys: DataFrame, kept: Column | None = None) -> DataFrame:
    """(mention_id, component) when every key, or every one that ``kept`` holds for, ties all its mentions: what merging without care would do."""
    rows = (keys.where(kept) if kept is not None else keys).select("source_id", "key", "mention_id").distinct()
    labels = component_labels(_stars(rows, ["source_id", "key"]), "a", "b")
    return keys.select("mention_id").distinct().join(labels, F.col("mention_id") == F.col("node"), "left").select("mention_id", F.coalesce("label", "mention_id").alias("component"))


def corroborated_components(keys: DataFrame) -> DataFrame:
    """(mention_id, component) when strong keys tie all their mentions, and a weak one only those that share a strong key's component's other weak key too.

    A fix point in two steps: components by strong keys first; then, for every pair of weak keys that a component holds together, those components are tied.
    """
    strong = cut(key_components(keys, ~is_weak_key(F.col("key"))))
    weak = keys.where(is_weak_key(F.col("key"))).select("source_id", "mention_id", "key").distinct().join(strong, "mention_id").select("source_id", "component", "key").distinct()
    pairs = weak.join(weak.withColumnRenamed("key", "other"), ["source_id", "component"]).where("key < other")
    ties = _stars(pairs.select("source_id", "key", "other", F.col("component").alias("mention_id")).distinct(), ["source_id", "key", "other"])
    labels = component_labels(ties, "a", "b")
    return strong.join(labels, F.col("component") == F.col("node"), "left").select("mention_id", F.coalesce("label", "component").alias("component"))


def component_sizes(components: DataFrame, mentions: DataFrame) -> DataFrame:
    """(source_id, n_mentions, n_components, largest) per narrative."""
    size = components.join(mentions.select("mention_id", "source_id"), "mention_id").groupBy("source_id", "component").agg(F.count("*").alias("n"))
    return size.groupBy("source_id").agg(F.sum("n").alias("n_mentions"), F.count("*").alias("n_components"), F.max("n").alias("largest"))


def kept_together(components: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, n_components): over how many components each group (group, mention_id) that should stay one is spread."""
    return groups.join(components, "mention_id").groupBy("group").agg(F.countDistinct("component").alias("n_components"))


def kept_apart(components: DataFrame, names: DataFrame) -> DataFrame:
    """(component, n_names): components that hold several of the names (name, mention_id) that should stay apart."""
    return names.join(components, "mention_id").groupBy("component").agg(F.countDistinct("name").alias("n_names")).where("n_names > 1")
