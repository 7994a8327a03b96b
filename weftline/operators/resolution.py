"""Merging mentions by shared name keys, with care for family names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import content_id, is_generic, is_weak_key, norm_name, qualifier_tag
from weftline.operators.graph import component_labels
from weftline.session import cut


def merge_keys(mentions: DataFrame) -> DataFrame:
    """(source_id, mention_id, key, surface, pos): keys of each mention (mention_id, name, aliases), specific ones only.

    The name's key always counts, an alias's only if it is some mention's name key in the narrative.
    pos 0 is the name, then the aliases in order.
    """
    own = mentions.select("source_id", "mention_id", F.lit(0).alias("pos"), F.col("name").alias("surface"))
    other = mentions.select("source_id", "mention_id", F.posexplode("aliases").alias("p", "surface")).select("source_id", "mention_id", (F.col("p") + 1).alias("pos"), "surface")
    keyed = lambda df: df.where("surface is not null").withColumn("key", norm_name(F.col("surface"))).where(~is_generic(F.col("key")))
    primary = keyed(own)
    known = primary.select("source_id", "key").distinct()
    return primary.unionByName(keyed(other).join(known, ["source_id", "key"], "left_semi").select(primary.columns)).select("source_id", "mention_id", "key", "surface", "pos")


def key_tags(keys: DataFrame) -> DataFrame:
    """(source_id, key, mention_id, tag): what a mention's surfaces say beyond the key, the first that says anything."""
    tagged = keys.withColumn("t", qualifier_tag(F.col("surface"), F.col("key")))
    return tagged.groupBy("source_id", "key", "mention_id").agg(F.min_by("t", F.when(F.col("t").isNotNull(), F.col("pos"))).alias("tag"))


def ambiguous_keys(tags: DataFrame) -> DataFrame:
    """(source_id, key): weak keys that more than one person goes by."""
    other = F.col("tag").startswith("other:")
    n = tags.where(is_weak_key(F.col("key"))).groupBy("source_id", "key").agg(F.countDistinct(F.when(~other, F.col("tag"))).alias("r"), F.countDistinct(F.when(other, F.col("tag"))).alias("o"))
    return n.where("r >= 2 or o >= 2 or (r >= 1 and o >= 1)").select("source_id", "key")


def merge_edges(keys: DataFrame) -> DataFrame:
    """(a, b): pairs of mentions to merge, as stars around each group's smallest mention.

    Mentions of an unambiguous key form one group. Those of an ambiguous key form one per tag, those without a tag
    going to the most frequent one (the first by name of several); groups of a key are tied when a
    mention of each shares another key.
    """
    tags = key_tags(keys)
    unsure = ambiguous_keys(tags)
    star = lambda df, by: df.join(df.groupBy(*by).agg(F.min("mention_id").alias("a")), by).where("mention_id <> a").select("a", F.col("mention_id").alias("b"))
    plain = star(tags.join(unsure, ["source_id", "key"], "left_anti").select("source_id", "key", "mention_id"), ["source_id", "key"])
    held = tags.join(unsure, ["source_id", "key"], "left_semi")
    counts = held.where("tag is not null").groupBy("source_id", "key", "tag").agg(F.count("*").alias("n"))
    anchor = counts.groupBy("source_id", "key").agg(F.min_by("tag", F.struct(-F.col("n"), "tag")).alias("anchor"))
    grouped = held.join(anchor, ["source_id", "key"]).withColumn("group", F.coalesce("tag", "anchor")).select("source_id", "key", "group", "mention_id")
    within = star(grouped, ["source_id", "key", "group"])
    # groups of one key that hold mentions with the same second key: each ties to the smallest of them
    second = grouped.join(tags.select("mention_id", F.col("key").alias("key2")), "mention_id").where("key <> key2").groupBy("source_id", "key", "key2", "group").agg(F.min("mention_id").alias("mention_id"))
    across = star(second, ["source_id", "key", "key2"])
    return plain.unionByName(within).unionByName(across).distinct()


def resolve(mentions: DataFrame) -> DataFrame:
    """(mention_id, component) of all mentions of all narratives: the smallest mention id each is merged with."""
    labels = component_labels(merge_edges(cut(merge_keys(mentions))), "a", "b")
    return mentions.select("mention_id").distinct().join(labels, F.col("mention_id") == F.col("node"), "left").select("mention_id", F.coalesce("label", "mention_id").alias("component"))


def local_entities(mentions: DataFrame, components: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_id, local_id, entity_id): the entity a narrative's local id was merged into; of an id used for several, the smallest."""
    at = mentions.join(components, "mention_id").join(entities.select("component", "entity_id"), "component")
    return at.groupBy("source_id", "local_id").agg(F.min("entity_id").alias("entity_id"))


def canonical_entities(mentions: DataFrame, components: DataFrame) -> DataFrame:
    """(component, entity_id, canonical_name, entity_type, n_mentions) per component.

    Name: most frequent, then seen earliest, then first by spelling. Type: the most frequent, OTHER on a tie.
    """
    m = mentions.join(components, "mention_id")
    names = m.groupBy("component", "name").agg(F.count("*").alias("n"), F.min("char_start").alias("at"))
    name = names.groupBy("component").agg(F.min_by("name", F.struct(-F.col("n"), "at", "name")).alias("canonical_name"), F.sum("n").alias("n_mentions"))
    types = m.groupBy("component", "type").agg(F.count("*").alias("n")).withColumn("r", F.rank().over(Window.partitionBy("component").orderBy(F.desc("n")))).where("r = 1")
    kind = types.groupBy("component").agg(F.when(F.count("*") == 1, F.min("type")).otherwise("OTHER").alias("entity_type"))
    return name.join(kind, "component").select("component", content_id(F.col("canonical_name"), F.col("entity_type")).alias("entity_id"), "canonical_name", "entity_type", "n_mentions")
