"""Relations and claims from chunks by a model: which chunks, what is asked, what counts of the answers; also by files of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import ids, providers
from folioscope.operators import corpus as C

RELATIONS = "relation_id string, chunk_id string, document_id string, source_rel_path string, subject_entity_id string, predicate string, object_entity_id string, confidence double, extraction_model string, extracted_at string"
CLAIMS = "claim_id string, chunk_id string, document_id string, source_rel_path string, claim_text string, subject_entity_id string, object_entity_id string, claim_type string, confidence double, extraction_model string, extracted_at string"
RELATION_TASK = (
    "Name the relations that the text states between the entities listed below it. Use only listed entities and predicates. "
    'Answer with JSON alone: {"relations": [{"subject": "id", "predicate": "name", "object": "id", "confidence": 0.0 to 1.0}]}. An empty list is a good answer.'
)
CLAIM_TASK = (
    "Name the statements of fact that the text makes, one sentence each, with the listed entity that each is about, if any. "
    f"The type is one of {', '.join(C.CLAIM_TYPES)}. "
    'Answer with JSON alone: {"claims": [{"claim_text": "...", "subject": "id or null", "object": "id or null", "claim_type": "assertion", "confidence": 0.0 to 1.0}]}. An empty list is a good answer.'
)


def task_with_vocabulary(task: str, entities: list[str] = (), predicates: list[str] = ()) -> str:
    """The task followed by the sorted vocabularies: the same for all requests of a run, so that services can cache it."""
    parts = [task]
    if entities:
        parts.append(f"Known entities ({len(entities)}):\n" + "\n".join(f"- {e}" for e in sorted(entities)))
    if predicates:
        parts.append(f"Known predicates ({len(predicates)}): " + ", ".join(sorted(predicates)))
    return "\n\n".join(parts)


def qualifying(chunks: DataFrame, mentions: DataFrame, least: int) -> DataFrame:
    """chunk_id, document_id, source_rel_path, text, entity_ids (sorted): chunks that mention at least `least` entities.

    Repeated rows of a chunk give one; chunks without text are left out."""
    named = mentions.select("chunk_id", "entity_id").distinct().groupBy("chunk_id").agg(F.sort_array(F.collect_set("entity_id")).alias("entity_ids")).filter(F.size("entity_ids") >= least)  # the entities of a chunk
    rows = chunks.filter("text is not null").join(named, "chunk_id")
    return rows.groupBy("chunk_id", "entity_ids").agg(F.min(F.struct("source_rel_path", "document_id", "text")).alias("r")).select("chunk_id", "r.document_id", "r.source_rel_path", "r.text", "entity_ids")


def todo(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks from which nothing has been extracted yet."""
    return chunks.join(done.select("chunk_id"), "chunk_id", "left_anti")


def preview(chunks: DataFrame, mentions: DataFrame, done: DataFrame, least: int) -> DataFrame:
    """One row: chunks that qualify, of those done already, and calls that a run would make."""
    ready = qualifying(chunks, mentions, least).select("chunk_id").join(done.select("chunk_id", F.lit(1).alias("d")).distinct(), "chunk_id", "left")
    return ready.agg(F.count("*").alias("qualifying"), F.count("d").alias("done"), F.count_if(F.col("d").isNull()).alias("calls"))


def prompt(predicates: list[str] | None = None) -> Column:
    """What is asked about a qualifying chunk."""
    parts = [F.lit("Text:\n"), F.col("text"), F.lit("\n\nEntities:\n- "), F.array_join("entity_ids", "\n- ")]
    return F.concat(*parts, *([F.lit("\n\nPredicates: " + ", ".join(sorted(predicates)))] if predicates else []))


def relation_records(raw: DataFrame, chunks: DataFrame, predicates: DataFrame, model: str, now: str, limit: int = C.MOST_RELATIONS) -> DataFrame:
    """RELATIONS from raw answers (chunk_id, raw) to qualifying chunks; the first of equal relations of a chunk counts."""
    entities = chunks.select("chunk_id", F.explode("entity_ids").alias("entity_id"))
    rows = C.valid_relations(C.parse_relations(raw, "chunk_id", "raw"), entities, predicates, limit=limit)
    key = ["chunk_id", "subject", "predicate", "object"]
    rows = rows.groupBy(*key).agg(F.min_by("confidence", "position").alias("confidence")).join(chunks.select("chunk_id", "document_id", "source_rel_path"), "chunk_id")
    return rows.select(ids.content_id(*key).alias("relation_id"), "chunk_id", "document_id", "source_rel_path", F.col("subject").alias("subject_entity_id"), "predicate", F.col("object").alias("object_entity_id"), "confidence", F.lit(model).alias("extraction_model"), F.lit(now).alias("extracted_at"))


def claim_records(raw: DataFrame, chunks: DataFrame, model: str, now: str, limit: int = C.MOST_CLAIMS) -> DataFrame:
    """CLAIMS from raw answers (chunk_id, raw) to qualifying chunks; the first of equal claims of a chunk counts."""
    entities = chunks.select("chunk_id", F.explode("entity_ids").alias("entity_id"))
    rows = C.valid_claims(C.parse_claims(raw, "chunk_id", "raw"), entities, limit=limit)
    first = F.min_by(F.struct("claim_text", "subject", "object", "claim_type", "confidence"), "position").alias("r")
    rows = rows.groupBy("chunk_id", "claim_id").agg(first).select("chunk_id", "claim_id", "r.*").join(chunks.select("chunk_id", "document_id", "source_rel_path"), "chunk_id")
    return rows.select("claim_id", "chunk_id", "document_id", "source_rel_path", "claim_text", F.col("subject").alias("subject_entity_id"), F.col("object").alias("object_entity_id"), "claim_type", "confidence", F.lit(model).alias("extraction_model"), F.lit(now).alias("extracted_at"))


def extract_relations(chunks: DataFrame, predicates: list[str], backends: list[providers.Backend], model: str, now: str) -> DataFrame:
    """Relations of qualifying chunks; none without a predicate. A chunk whose call fails has none."""
    spark = chunks.sparkSession
    if not predicates:
        return spark.createDataFrame([], RELATIONS)
    raw = providers.ask(chunks.withColumn("user", prompt(predicates)), "chunk_id", task_with_vocabulary(RELATION_TASK, (), predicates), "user", backends)
    return relation_records(raw, chunks, spark.createDataFrame([(p,) for p in predicates], "predicate string"), model, now)


def extract_claims(chunks: DataFrame, backends: list[providers.Backend], model: str, now: str) -> DataFrame:
    raw = providers.ask(chunks.withColumn("user", prompt()), "chunk_id", CLAIM_TASK, "user", backends)
    return claim_records(raw, chunks, model, now)


def request_lines(chunks: DataFrame, system: str, user: Column, model: str, most_tokens: int = 2000, temperature: float = 0.0) -> DataFrame:
    """chunk_id, value: a line of JSON per chunk, as services take requests in files."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", user)).alias("messages"), F.lit(temperature).alias("temperature"), F.lit(most_tokens).alias("max_tokens"), F.struct(F.lit("json_object").alias("type")).alias("response_format"))
    line = F.struct(F.col("chunk_id").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))
    return chunks.select("chunk_id", F.to_json(line).alias("value"))


def write_requests(lines: DataFrame, chunks: DataFrame, folder: str) -> None:
    """Request files and, beside them, what is needed to read the answers. No qualifying chunk is an error."""
    if chunks.isEmpty():
        raise RuntimeError("no chunk qualifies")
    lines.select("value").write.mode("overwrite").text(f"{folder}/requests")
    chunks.select("chunk_id", "document_id", "source_rel_path", "entity_ids").write.mode("overwrite").parquet(f"{folder}/chunks")


def answers_of(lines: DataFrame) -> DataFrame:
    """chunk_id, raw: the first choice of each line (value) of an answer file; lines without one, or that are broken, give nothing."""
    v = F.try_parse_json("value")
    raw = F.try_variant_get(v, "$.response.body.choices[0].message.content", "string")
    return lines.select(F.try_variant_get(v, "$.custom_id", "string").alias("chunk_id"), raw.alias("raw")).filter("chunk_id is not null and raw is not null")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return answers_of(spark.read.text(path))


def batch_counts(lines: DataFrame) -> DataFrame:
    """One row: lines of an answer file, with an answer, and without one."""
    n = answers_of(lines).count()
    return lines.filter(F.trim("value") != "").agg(F.count("*").alias("total")).select("total", F.lit(n).cast("long").alias("completed"), (F.col("total") - n).alias("failed"))
