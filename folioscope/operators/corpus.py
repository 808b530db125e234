"""Chunks, mentions, relations and claims: cleaning, deriving, validating and summing up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope import ids
from folioscope.functions import text as X

# Kinds of claims, and how many items of a model's answer count.
CLAIM_TYPES = ["assertion", "definition", "comparison", "causal", "procedural"]
MOST_RELATIONS, MOST_CLAIMS = 15, 10
BLANK = r"^\s+|\s+$"


def folded(c: str | Column) -> Column:
    return F.translate(F.lower(F.trim(c)), " -", "__")


def chunk_sources(chunks: DataFrame) -> DataFrame:
    """chunk_id with its source, index and document, for joins that need no text."""
    return chunks.filter("chunk_id is not null").groupBy("chunk_id").agg(F.min(F.struct("source_rel_path", "chunk_index", "document_id")).alias("r")).select("chunk_id", "r.*")


def clean_mentions(mentions: DataFrame) -> DataFrame:
    """Distinct mentions with folded entity names; null and blank names are left out."""
    return mentions.withColumn("entity_id", folded("entity_id")).filter("entity_id <> ''").select("chunk_id", "entity_id", "term_source", "surface_form", "start_char", "end_char").distinct()


def clean_relations(relations: DataFrame) -> DataFrame:
    """The first row per (chunk, subject, predicate, object), by time, then id and confidence; confidence in 0..1, null as 0.5."""
    when = F.regexp_replace("extracted_at", "Z$", "+00:00")
    rows = relations.withColumn("extracted_at", when).withColumn("confidence", X.unit_interval(F.coalesce(F.when(~F.isnan("confidence"), F.col("confidence")), F.lit(0.5))))
    key = ["chunk_id", "subject_entity_id", "predicate", "object_entity_id"]
    first = F.min(F.struct("extracted_at", "relation_id", "confidence", "document_id", "source_rel_path")).alias("r")
    return rows.dropna(subset=key).groupBy(*key).agg(first).select(*key, "r.extracted_at", "r.confidence", "r.document_id", "r.source_rel_path", ids.content_id(*key).alias("relation_id"))


def window_chunks(docs: DataFrame, key: str, text: str, size: int = 256, overlap: int = 50, least: int = 20) -> DataFrame:
    """Windows of `size` words, `size - overlap` apart; a last window of fewer than `least` words is dropped unless it is the first."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap in 0..size-1")
    stride = size - overlap
    rows = docs.select(key, X.words_of(text).alias("w")).filter(F.size("w") > 0).withColumn("n", F.size("w"))
    starts = F.filter(F.sequence(F.lit(0), F.col("n") - 1, F.lit(stride)), lambda s: (s == 0) | ((F.col("n") - s >= least) & (s - stride + size < F.col("n"))))
    out = rows.select(key, "w", F.posexplode(starts).alias("chunk_index", "s"))
    part = F.slice("w", F.col("s") + 1, F.lit(size))
    return out.select(key, "chunk_index", F.size(part).alias("n_tokens"), F.array_join(part, " ").alias("chunk_text"))


def with_occurrence(rows: DataFrame, document: str, text_hash: str, index: str) -> DataFrame:
    """The how-manieth chunk of its document with this hash, from 0, in chunk order."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(document, text_hash).orderBy(index)) - 1)


def entity_stats(mentions: DataFrame, sources: DataFrame) -> DataFrame:
    both = mentions.join(sources.select("chunk_id", "source_rel_path"), "chunk_id")
    return both.groupBy("entity_id").agg(F.count_distinct("chunk_id").alias("n_chunks"), F.count_distinct("source_rel_path").alias("n_sources"), F.count("*").alias("n_mentions"))


def qualifying_chunks(mentions: DataFrame, sources: DataFrame, least: int = 2) -> DataFrame:
    pairs = mentions.select("chunk_id", "entity_id").distinct().join(sources.select("chunk_id"), "chunk_id", "left_semi")
    return pairs.groupBy("chunk_id").agg(F.count("*").alias("n_entities")).filter(F.col("n_entities") >= least)


def canonical_relations(relations: DataFrame) -> DataFrame:
    key = ["subject_entity_id", "predicate", "object_entity_id"]
    out = relations.groupBy(*key).agg(F.count("*").alias("support_count"), F.avg("confidence").alias("avg_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"), F.min("extracted_at").alias("first_seen_at"), F.max("extracted_at").alias("last_seen_at"))
    return out.withColumn("relation_id", ids.content_id(*key))


def relation_evidence(relations: DataFrame, chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """The most confident row per (triple, chunk), with the chunk's text and the last surface form of both entities."""
    key = ["subject_entity_id", "predicate", "object_entity_id", "chunk_id"]
    best = relations.groupBy(*key).agg(F.max("confidence").alias("confidence"))
    forms = mentions.groupBy("chunk_id", "entity_id").agg(F.max(F.struct("start_char", "surface_form")).alias("m")).select("chunk_id", "entity_id", F.col("m.surface_form").alias("form"))
    cited = best.select("chunk_id").distinct()
    texts = chunks.select("chunk_id", "text").join(cited, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.min("text").alias("text"))
    forms = forms.join(cited, "chunk_id", "left_semi")
    out = best.join(texts, "chunk_id", "left")
    for side in ("subject", "object"):
        out = out.join(forms.select("chunk_id", F.col("entity_id").alias(f"{side}_entity_id"), F.col("form").alias(f"surface_{side}")), ["chunk_id", f"{side}_entity_id"], "left").withColumn(f"surface_{side}", F.coalesce(f"surface_{side}", f"{side}_entity_id"))
    relation = ids.content_id("subject_entity_id", "predicate", "object_entity_id")
    return out.withColumn("evidence_text", F.coalesce("text", F.lit(""))).drop("text").withColumn("relation_id", relation).withColumn("evidence_id", ids.content_id("relation_id", "chunk_id"))


def edge_weights(relations: DataFrame, floor: float = 0.5) -> DataFrame:
    return relations.filter(F.col("confidence") >= floor).groupBy("subject_entity_id", "predicate", "object_entity_id").agg(F.max("confidence").alias("weight"), F.count("*").alias("support"))


def _is(item: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(item).startswith(kind), F.lit(False))


def _text(item: str, name: str) -> Column:
    return F.when(_is(F.try_variant_get(item, f"$.{name}", "variant"), "STRING"), F.try_variant_get(item, f"$.{name}", "string"))


def _items(payloads: DataFrame, key: str, raw: str, name: str, strings: list[str]) -> DataFrame:
    """key, position, item: the objects of a list in a model's JSON answer in which all of `strings` are texts."""
    good = lambda x: _is(x, "OBJECT") if not strings else _is(x, "OBJECT") & F.forall(F.array(*(F.coalesce(_is(F.try_variant_get(x, f"$.{n}", "variant"), "STRING"), F.lit(False)) for n in strings)), lambda ok: ok)
    items = F.filter(F.try_variant_get(F.try_parse_json(raw), f"$.{name}", "array<variant>"), good)
    return payloads.select(key, F.posexplode(items).alias("position", "item"))


def _confidence() -> Column:
    """A number, or a text that reads as one; anything else counts as 0.5."""
    return F.coalesce(F.try_variant_get("item", "$.confidence", "string").try_cast("double"), F.lit(0.5))


def parse_relations(payloads: DataFrame, key: str, raw: str) -> DataFrame:
    """Rows of `relations` in a model's JSON answer. Broken JSON and items that are no object or lack a text give nothing;
    `position` counts the items that are left."""
    names = ["subject", "predicate", "object"]
    return _items(payloads, key, raw, "relations", names).select(key, "position", *(_text("item", n).alias(n) for n in names), _confidence().alias("confidence"))


def parse_claims(payloads: DataFrame, key: str, raw: str) -> DataFrame:
    """Rows of `claims` in a model's JSON answer; a claim text that is no string is null and dropped by valid_claims."""
    return _items(payloads, key, raw, "claims", []).select(key, "position", *(_text("item", n).alias(n) for n in ("claim_text", "subject", "object", "claim_type")), _confidence().alias("confidence"))


def predicate_vocabulary(edges: DataFrame) -> DataFrame:
    """predicate: the kinds of relations between entities that an ontology's edges (relation, origin) have."""
    return edges.filter(F.col("origin") == "entity").select(F.col("relation").alias("predicate")).distinct()


def valid_relations(rows: DataFrame, entities: DataFrame, predicates: DataFrame, key: str = "chunk_id", limit: int = MOST_RELATIONS) -> DataFrame:
    """Of the first `limit` items per chunk those whose two different entities are mentioned in it and whose predicate is known."""
    known = entities.select(F.col("chunk_id").alias(key), "entity_id").distinct()
    out = rows.filter((F.col("position") < limit) & (F.col("subject") != F.col("object"))).join(predicates.select("predicate").distinct(), "predicate", "left_semi")
    for side in ("subject", "object"):
        out = out.join(known.withColumnRenamed("entity_id", side), [key, side], "left_semi")
    return out.withColumn("confidence", X.unit_interval("confidence"))


def valid_claims(rows: DataFrame, entities: DataFrame, key: str = "chunk_id", limit: int = MOST_CLAIMS) -> DataFrame:
    """First `limit` items per chunk with text; entities not mentioned in the chunk become null, unknown types `assertion`.
    The id is that of the text as given, the text itself is stripped."""
    known = entities.select(F.col("chunk_id").alias(key), "entity_id").distinct()
    out = rows.filter((F.col("position") < limit) & (F.col("claim_text") != ""))
    for side in ("subject", "object"):
        out = out.join(known.select(key, F.col("entity_id").alias(side), F.lit(True).alias(f"k_{side}")), [key, side], "left").withColumn(side, F.when(F.col(f"k_{side}"), F.col(side))).drop(f"k_{side}")
    kind = F.when(F.col("claim_type").isin(CLAIM_TYPES), F.col("claim_type")).otherwise("assertion")
    out = out.withColumn("claim_type", kind).withColumn("confidence", X.unit_interval("confidence")).withColumn("claim_id", ids.content_id(key, "claim_text"))
    return out.withColumn("claim_text", F.regexp_replace("claim_text", BLANK, ""))


def mean_vectors(mentions: DataFrame, chunks: DataFrame, dims: int, top: int = 20, least: int = 3) -> DataFrame:
    """entity_id, vector: mean vector per entity over its `top` chunks by mention count (ties by chunk_id); vectors of another width are skipped."""
    counts = mentions.groupBy("entity_id", "chunk_id").agg(F.count("*").alias("c"))
    total = counts.groupBy("entity_id").agg(F.sum("c").alias("t")).filter(F.col("t") >= least).select("entity_id")
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("c"), "chunk_id"))
    best = counts.join(total, "entity_id", "left_semi").withColumn("r", place).filter(F.col("r") <= top)
    good = chunks.filter((F.size("vector") == dims) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select("chunk_id", "vector")
    near = best.join(good, "chunk_id").select("entity_id", "vector")
    return near.groupBy("entity_id").applyInArrow(_mean, "entity_id string, vector array<double>")  # at most `top` vectors a group


def _mean(part: pa.Table) -> pa.Table:
    rows = part.column("vector").combine_chunks()
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    return pa.table({"entity_id": part.column("entity_id")[:1], "vector": pa.array([x.mean(0)], pa.list_(pa.float64()))})
