"""Narratives to a typed graph: windows are read by a model, facts are traced to their places, mentions are merged into entities, and relations and events are built over these.

A window, a fact or a reference that can't be used goes to a frame of what was left out and why; nothing else of its narrative is lost.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.config import Quotes, Windows
from weftline.functions.text import content_id
from weftline.operators import construction, provenance, reasoning, resolution, segmentation
from weftline.session import cut


@dataclass(frozen=True)
class NovelGraph:
    """entities, relations, events, participations: the graph's records. mentions: what was merged, with component. places: of all facts. left_out (kind, id, reason)."""

    entities: DataFrame
    relations: DataFrame
    events: DataFrame
    participations: DataFrame
    mentions: DataFrame
    places: DataFrame
    left_out: DataFrame


def narrative_windows(narratives: DataFrame, cfg: Windows = Windows()) -> DataFrame:
    """(window_id, source_id, char_start, text, chapter_index, window_index) of narratives (source_id, cleaned_text)."""
    w = segmentation.extraction_windows(narratives, cfg)
    rows = w.join(narratives.select("source_id", "cleaned_text"), "source_id")
    text = F.substring("cleaned_text", F.col("char_start").cast("int") + 1, (F.col("char_end") - F.col("char_start")).cast("int"))
    return rows.select(content_id(F.col("source_id"), F.col("char_start"), F.col("char_end")).alias("window_id"), "source_id", F.col("char_start").cast("int").alias("char_start"), text.alias("text"), "chapter_index", "window_index")


def mention_number(window: str, local: str):
    """A number for each local id of a window, for merging."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", window, local), 256), 1, 15), 16, 10).cast("bigint")


def read_mentions(windows: DataFrame, chunks: DataFrame, answers: reasoning.Answering, cfg: Quotes = Quotes()) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(mentions, places, relations, events, left out) of windows (window_id, source_id, char_start, text, chapter_index, window_index): facts that are traced to a chunk.

    With answers that only replay a cache this is the corpus of mentions an earlier extraction gave.
    """
    e, r, v, errors, _ = reasoning.extract_windows(windows, answers)
    e, r, v = cut(e.distinct()), cut(r.distinct()), cut(v.distinct())
    fact = lambda df, kind, *key: df.withColumn("kind", F.lit(kind)).withColumn("fact_id", F.concat_ws(":", "window_id", *key))
    e, r, v = fact(e, "entity", "local_id"), fact(r, "relation", "subject_local_id", "relation_type", "object_local_id"), fact(v, "event", "local_id")
    quotes = reduce(DataFrame.unionByName, [x.select("kind", "fact_id", "window_id", F.explode("evidence_quotes").alias("quote")) for x in (e, r, v)]).distinct()
    places, rejected = provenance.resolve_facts(cut(quotes), windows, chunks, cfg)
    places = cut(places)
    first = places.groupBy("kind", "fact_id").agg(F.min(F.struct("char_start", "chunk_id")).alias("_p")).select("kind", "fact_id", "_p.*")
    at = windows.select("window_id", "source_id", "chapter_index", "window_index")
    held = lambda df: df.join(first, ["kind", "fact_id"]).join(at, "window_id")
    mentions = held(e).select(mention_number("window_id", "local_id").alias("mention_id"), "window_id", "source_id", "chapter_index", "window_index", "local_id", "name", "type", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "chunk_id", "char_start")
    left_out = errors.select(F.lit("window").alias("kind"), F.col("window_id").alias("id"), "reason").unionByName(rejected.select("kind", F.col("fact_id").alias("id"), "reason"))
    return mentions, places, held(r), held(v), left_out


def build_graph(windows: DataFrame, chunks: DataFrame, answers: reasoning.Answering, cfg: Quotes = Quotes()) -> NovelGraph:
    """The graph of all narratives whose windows are given; entities of different narratives are never merged."""
    mentions, places, relations, events, left_out = read_mentions(windows, chunks, answers, cfg)
    m = cut(mentions)
    comp = cut(resolution.resolve(m))
    entities = cut(resolution.canonical_entities(m, comp))
    # local ids count within their window, so the window stands for the narrative when facts are resolved
    known = m.join(comp, "mention_id").join(entities.select("component", "entity_id"), "component").select(F.col("window_id").alias("source_id"), "local_id", "entity_id").distinct()
    of_window = lambda df: df.drop("source_id").withColumnRenamed("window_id", "source_id")
    good, bad = construction.build_relations(of_window(relations).select("source_id", "subject_local_id", "object_local_id", "relation_type", "chunk_id"), known)
    facts = of_window(events).select("fact_id", "source_id", "predicate", "chunk_id", "char_start", "chapter_index", "window_index", "local_id")
    parts = of_window(events).select("fact_id", "source_id", F.explode("participants").alias("p")).select("fact_id", "source_id", F.col("p.entity_local_id").alias("local_id"), F.col("p.role").alias("role"))
    told = construction.build_events(facts, parts, known)
    said = events.select("fact_id", F.col("temporal.kind").alias("temporal_kind"), F.col("temporal.time_expression").alias("temporal_expression"))
    lost = construction.rejected_events(facts, parts, known).select(F.lit("event").alias("kind"), F.col("fact_id").alias("id"), "reason")
    lost = lost.unionByName(bad.select(F.lit("relation").alias("kind"), F.concat(F.col("n").cast("string"), F.lit(" facts")).alias("id"), "reason"))
    return NovelGraph(entities, good, told.join(said, "fact_id"), construction.build_participations(facts, parts, known), m.join(comp, "mention_id"), places, left_out.unionByName(lost))
