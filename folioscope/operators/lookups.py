"""Reads of single things and short lists from the stored tables, as callers of the tools ask for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def non_empty(value: str, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} is empty")
    return value


def one(rows: DataFrame, column: str, value) -> DataFrame:
    """The rows with this value: a file by its absolute path, a profile, report, relation or community by its id."""
    return rows.filter(F.col(column) == value)


def chunks_of_source(chunks: DataFrame, path: str) -> DataFrame:
    return one(chunks, "source_rel_path", path).orderBy("chunk_index", "chunk_id")


def mentions_of_source(mentions: DataFrame, chunks: DataFrame, path: str) -> DataFrame:
    """chunk_id, mentions: those of every chunk of a source, by start, end and entity."""
    mine = one(chunks, "source_rel_path", path).select("chunk_id").distinct()
    rows = mentions.join(mine, "chunk_id", "left_semi").select("chunk_id", F.struct("start_char", "end_char", "entity_id", "term_source", "surface_form").alias("m"))
    return rows.groupBy("chunk_id").agg(F.sort_array(F.collect_list("m")).alias("mentions"))  # the mentions of a chunk


def claims_about(claims: DataFrame, entities: list[str], limit: int = 50) -> DataFrame:
    """The surest claims whose subject or object is one of the entities."""
    return claims.filter(F.col("subject_entity_id").isin(entities) | F.col("object_entity_id").isin(entities)).orderBy(F.desc("confidence"), "claim_id").limit(limit)


def claims_of_chunk(claims: DataFrame, chunk: str) -> DataFrame:
    return one(claims, "chunk_id", chunk).orderBy(F.desc("confidence"), "claim_id")


def relations_about(relations: DataFrame, entity: str, limit: int = 50) -> DataFrame:
    """Extracted relations that the entity is an end of, the surest first."""
    return relations.filter((F.col("subject_entity_id") == entity) | (F.col("object_entity_id") == entity)).orderBy(F.desc("confidence"), "relation_id").limit(limit)


def canonical_about(relations: DataFrame, entity: str, limit: int = 50) -> DataFrame:
    """Canonical relations that the entity is an end of, the best supported first."""
    return relations.filter((F.col("subject_entity_id") == entity) | (F.col("object_entity_id") == entity)).orderBy(F.desc("support_count"), "relation_id").limit(limit)


def chunks_with_relations(relations: DataFrame, entities: list[str]) -> DataFrame:
    return relations.filter(F.col("subject_entity_id").isin(entities) | F.col("object_entity_id").isin(entities)).select("chunk_id").distinct()


def evidence_of(evidence: DataFrame, relation: str, most: int = 500) -> DataFrame:
    """Evidence for a relation, the surest first, its text cut."""
    return one(evidence, "relation_id", relation).withColumn("evidence_text", F.substring("evidence_text", 1, most)).orderBy(F.desc("confidence"), "evidence_id")


def top(rows: DataFrame, metric: str, limit: int = 20, key: str = "entity_id") -> DataFrame:
    return rows.orderBy(F.desc(metric), key).limit(limit)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: relations, evidence, claims, profiles, communities and reports."""
    names = {"relations": "relations", "relation_evidence": "relation_evidence", "claims": "claims", "entity_profiles": "entity_profiles", "entity_communities": "communities", "community_reports": "community_reports"}
    out = None
    for table, name in names.items():
        rows = tables[table].select(F.lit(name).alias("name"), (F.col("community_id") if table == "entity_communities" else F.lit(None)).cast("string").alias("c"))
        out = rows if out is None else out.union(rows)
    mine = lambda name: F.count_distinct(F.when(F.col("name") == name, F.col("c"))) if name == "communities" else F.count_if(F.col("name") == name)
    return out.agg(*(mine(name).alias(name) for name in names.values()))


def latest(runs: list[dict]) -> dict | None:
    """The run that started last."""
    return max(runs, key=lambda r: (r.get("started_at") or "", r["run_id"]), default=None)
