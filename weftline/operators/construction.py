"""Typed relations and events over resolved entities, and the graph's fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import content_id


def build_relations(facts: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations, rejected) of facts (source_id, subject_local_id, object_local_id, relation_type, chunk_id) and entities (source_id, local_id, entity_id).

    A relation is directed; its weight is the number of chunks. A fact whose end is unknown, or whose ends are one entity, is rejected.
    """
    side = lambda n: entities.select("source_id", F.col("local_id").alias(f"{n}_local_id"), F.col("entity_id").alias(f"{n}_entity_id"))
    at = facts.join(side("subject"), ["source_id", "subject_local_id"], "left").join(side("object"), ["source_id", "object_local_id"], "left")
    dangling = F.col("subject_entity_id").isNull() | F.col("object_entity_id").isNull()
    reason = F.when(dangling, "dangling reference").when(F.col("subject_entity_id") == F.col("object_entity_id"), "self-relation")
    at = at.withColumn("reason", reason)
    good = at.where("reason is null").groupBy("subject_entity_id", "object_entity_id", "relation_type").agg(F.countDistinct("chunk_id").alias("weight"))
    return good, at.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def _resolved_events(facts: DataFrame, participants: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts with event_id, participants with event_id and entity_id); facts with an unknown participant have a null event_id."""
    known = participants.join(entities.select("source_id", "local_id", "entity_id").distinct(), ["source_id", "local_id"], "left")
    per = known.groupBy("fact_id").agg(F.bool_or(F.col("entity_id").isNull()).alias("dangling"), F.array_sort(F.collect_list("entity_id")).alias("ids"))
    event = F.when(~F.col("dangling"), content_id(F.col("predicate"), F.array_join("ids", ":"), F.col("chunk_id"), F.col("char_start")))
    told = facts.join(per, "fact_id").withColumn("event_id", event).drop("ids", "dangling")
    return told, known.join(told.select("fact_id", "event_id", "chunk_id").where("event_id is not null"), "fact_id")


def build_events(facts: DataFrame, participants: DataFrame, entities: DataFrame) -> DataFrame:
    """(event_id, predicate, fact_id, n_facts) of facts (fact_id, source_id, predicate, chunk_id, char_start, chapter_index, window_index, local_id) and participants (fact_id, source_id, local_id ..).

    One unknown participant rejects the fact. Facts of one predicate, participants and place are one event, told by the first by chapter, window and local id.
    """
    told, _ = _resolved_events(facts, participants, entities)
    order = F.struct("chapter_index", F.coalesce("window_index", F.lit(-1)), "local_id", "fact_id")
    return told.where("event_id is not null").groupBy("event_id", "predicate").agg(F.min_by("fact_id", order).alias("fact_id"), F.count("*").alias("n_facts"))


def build_participations(facts: DataFrame, participants: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, event_id, role, weight): who takes part in the events of build_events as what, by number of chunks."""
    _, known = _resolved_events(facts, participants, entities)
    return known.groupBy("entity_id", "event_id", "role").agg(F.countDistinct("chunk_id").alias("weight"))


def rejected_events(facts: DataFrame, participants: DataFrame, entities: DataFrame) -> DataFrame:
    """(fact_id, reason) of the facts build_events leaves out."""
    told, _ = _resolved_events(facts, participants, entities)
    return told.where("event_id is null").select("fact_id", F.lit("dangling reference").alias("reason"))


def united_provenance(facts: DataFrame, key: list[str]) -> DataFrame:
    """(key.., chunk_id, char_start, char_end, place): the distinct places of facts' groups, numbered from 1 by chunk, start and end."""
    order = Window.partitionBy(*key).orderBy("chunk_id", "char_start", "char_end")
    return facts.select(*key, "chunk_id", "char_start", "char_end").distinct().withColumn("place", F.row_number().over(order))


def entity_lines(entities: DataFrame, key: list[str] = []) -> DataFrame:  # noqa: B006
    """(key.., section, order, line) of entities (entity_id, canonical_name, entity_type)."""
    return entities.select(*key, F.lit("1").alias("section"), F.col("entity_id").alias("order"), F.concat_ws(":", F.lit("E"), "entity_id", "canonical_name", "entity_type").alias("line"))


def relation_lines(relations: DataFrame, key: list[str] = []) -> DataFrame:  # noqa: B006
    order = F.concat_ws("\x00", "subject_entity_id", "object_entity_id", "relation_type")
    return relations.select(*key, F.lit("2").alias("section"), order.alias("order"), F.concat_ws(":", F.lit("R"), "subject_entity_id", "object_entity_id", "relation_type", F.col("weight").cast("string")).alias("line"))


def event_lines(events: DataFrame, key: list[str] = []) -> DataFrame:  # noqa: B006
    return events.select(*key, F.lit("3").alias("section"), F.col("event_id").alias("order"), F.concat_ws(":", F.lit("V"), "event_id", "predicate", F.coalesce("temporal_kind", F.lit("NONE")), F.coalesce("temporal_expression", F.lit(""))).alias("line"))


def participation_lines(participations: DataFrame, key: list[str] = []) -> DataFrame:  # noqa: B006
    order = F.concat_ws("\x00", "entity_id", "event_id", "role")
    return participations.select(*key, F.lit("4").alias("section"), order.alias("order"), F.concat_ws(":", F.lit("P"), "entity_id", "event_id", "role", F.col("weight").cast("string")).alias("line"))


def graph_fingerprint(lines: DataFrame, key: list[str], order: list[str], line: str = "line") -> DataFrame:
    """(key.., fingerprint): SHA-256 of a graph's lines in the order of their identifiers, one per line.

    The text of one graph is hashed as a whole, so it is gathered whole; a key is one narrative's graph.
    """
    rows = F.array_sort(F.collect_list(F.struct(*order, line)))
    return lines.groupBy(*key).agg(F.sha2(F.array_join(F.transform(rows, lambda r: r[line]), "\n"), 256).alias("fingerprint"))


def bucketed_fingerprint(lines: DataFrame, order: str, line: str = "line", digits: int = 2) -> DataFrame:
    """(fingerprint) of lines of any number, as one row: lines go to buckets by their hash, each bucket's sorted lines are hashed, then the buckets' hashes in order.

    There are 16 to the ``digits`` buckets, and the last step has one row each; raise it with the lines.
    """
    part = F.substring(F.sha2(F.concat_ws("\x00", order, line), 256), 1, digits).alias("_b")
    rows = F.array_sort(F.collect_list(F.struct(order, line)))
    each = lines.groupBy(part).agg(F.sha2(F.array_join(F.transform(rows, lambda r: r[line]), "\n"), 256).alias("_h"))
    whole = F.array_sort(F.collect_list(F.struct("_b", "_h")))
    return each.agg(F.sha2(F.array_join(F.transform(whole, lambda r: r["_h"]), "\n"), 256).alias("fingerprint"))
