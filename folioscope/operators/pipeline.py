"""The two batch jobs: bringing a corpus folder into the store, and building the knowledge graph from it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import ids, providers
from folioscope.functions import text as X
from folioscope.operators import chunking as K
from folioscope.operators import corpus as C
from folioscope.operators import extraction as E
from folioscope.operators import graph as G
from folioscope.operators import matching as M
from folioscope.operators import store as S
from folioscope.operators.store import Store, diff, moves
from folioscope.session import materialize_plain as materialize
from folioscope.sources import corpus as files_of
from folioscope.sources.ontology import Ontology

PHASES = ["consolidate", "claims", "centrality", "communities", "profiles", "reports", "embeddings", "enrichment"]
MANIFEST = "source_rel_path string, absolute_path string, source_type string, source_domain string, document_id string, file_size_bytes long, content_hash string, parent_source_path string, chunk_count int, last_seen_at string, last_processed_at string, last_committed_at string, error_message string, lifecycle_status string, retrieval_status string"
CHUNKS = "chunk_id string, document_id string, source_rel_path string, source_path string, source_filename string, source_type string, source_domain string, source_hash string, citation_label string, chunk_index int, chunk_occurrence int, token_count int, text string, chunk_hash string, score_hint string, metadata_json string, vector array<float>, embedding_model string, embedding_dims int"
MENTIONS = "chunk_id string, entity_id string, term_source string, surface_form string, start_char int, end_char int"
PROFILES = "entity_id string, label string, entity_type string, domain string, aliases array<string>, summary string, llm_summary string, n_chunks long, n_sources long, n_mentions long, n_claims long, top_predicates array<struct<predicate:string,count:long>>, top_claims array<struct<claim_text:string,confidence:double,claim_type:string>>, pagerank double, betweenness double, closeness double, in_degree long, out_degree long, eigenvector double, community_id int, source_hash string, generated_at string"

# What profiles and reports say.
PROFILE_SENTENCE = "%s is a %s entity in the %s domain. It has %d mentions across %d chunks from %d source documents. Centrality: PageRank %d/%d | Betweenness %d/%d | Closeness %d/%d. Community: %s. Key relationships: %s. Key claims: %s."
REPORT_SENTENCE = "Community %d contains %d entities. Top members: %s. Intra-community edges: %d. Key claims: %s."


@dataclass
class Options:
    """What a run may be told. Backends are asked in turn; without any nothing is extracted."""

    size: int = 256
    overlap: int = 50
    least: int = 20
    strategy: str = "hybrid"
    tokenizer: str = "words"
    tokenizer_file: str | None = None
    dims: int = 96
    embedder: providers.Embedder | None = None
    embedding_model: str = "hashing"
    ontology: Ontology | None = None
    settings: dict[str, str] = field(default_factory=dict)
    ignore: list[str] = field(default_factory=list)
    relation_backends: list[providers.Backend] = field(default_factory=list)
    relation_model: str = "offline"
    predicates: list[str] = field(default_factory=list)
    least_entities: int = 2
    most_relations: int = C.MOST_RELATIONS


def _chunked(docs: DataFrame, o: Options) -> DataFrame:
    """source_rel_path, chunk_index, n_tokens, chunk_text, headings_json of documents (source_rel_path, text)."""
    if o.strategy == "windows":
        return C.window_chunks(docs.withColumn("clean", X.chunk_form("text")), "source_rel_path", "clean", o.size, o.overlap, o.least).withColumn("headings_json", F.lit("{}"))
    return K.chunk_documents(docs, "source_rel_path", "text", o.size, o.least, o.strategy, o.tokenizer, o.tokenizer_file)


def build_chunks(docs: DataFrame, stored: DataFrame, o: Options) -> DataFrame:
    """CHUNKS of documents (source_rel_path, text, page_no and the columns of their file).

    Vectors of chunks that are stored already with the same text, document and model are taken over. Texts that the embedder
    can't take are halved until it can, and indexes count on over all parts of a document."""
    parts = _chunked(docs, o).join(docs.drop("text"), "source_rel_path").withColumn("chunk_hash", ids.content_id("chunk_text"))
    known = stored.filter((F.col("embedding_model") == o.embedding_model) & (F.col("embedding_dims") == o.dims)).groupBy("document_id", "chunk_hash").agg(F.first("vector", ignorenulls=True).alias("vector"))
    parts = materialize(parts.join(known, ["document_id", "chunk_hash"], "left").withColumn("row", F.struct("document_id", "chunk_index")))
    fresh = parts.filter("vector is null").withColumn("row_id", ids.content_id("document_id", "chunk_index"))
    made = K.embed_or_split(fresh.select("row_id", "chunk_text"), "row_id", "chunk_text", o.embedder or providers.hashing_embedder(o.dims), o.dims)
    made = fresh.drop("chunk_text", "vector", "chunk_hash").join(made, "row_id").withColumnRenamed("part_text", "chunk_text").withColumn("chunk_hash", ids.content_id("chunk_text")).drop("row_id")
    made = made.withColumn("n_tokens", F.when(F.count("*").over(_same_row()) > 1, F.size(X.words_of("chunk_text"))).otherwise(F.col("n_tokens")))
    both = made.unionByName(parts.filter("vector is not null").withColumn("part", F.lit(0)))
    rows = K.reindexed(both, "document_id", ["chunk_index", "part"], "chunk_hash").withColumn("chunk_id", ids.chunk_id("document_id", "chunk_hash", "occurrence"))
    return rows.select(
        "chunk_id", "document_id", "source_rel_path", F.col("absolute_path").alias("source_path"), F.element_at(F.split("source_rel_path", "/"), -1).alias("source_filename"), "source_type", "source_domain", "source_hash", X.citation("source_rel_path", "page_no").alias("citation_label"),
        "chunk_index", F.col("occurrence").alias("chunk_occurrence"), F.col("n_tokens").alias("token_count"), F.col("chunk_text").alias("text"), "chunk_hash", F.substring("chunk_text", 1, 160).alias("score_hint"), F.col("headings_json").alias("metadata_json"), "vector", F.lit(o.embedding_model).alias("embedding_model"), F.lit(o.dims).alias("embedding_dims"),
    )


def _same_row():
    from pyspark.sql import Window

    return Window.partitionBy("document_id", "chunk_index")


def ingest(spark: SparkSession, store: Store, root: str, terms: DataFrame, now: str, run_id: str, full: bool = False, options: Options | None = None) -> dict:
    """Bring a folder into the store. Returns the run's counters; a run that breaks off is logged as failed."""
    o = options or Options()
    store.log_run({"run_id": run_id, "status": "running", "started_at": now, "mode": "full" if full else "incremental"})
    try:
        scanned = materialize(files_of.scan(spark, root, o.ignore, content=True))
        return merge(store, scanned, terms, now, run_id, full, o, whole=True)
    except Exception as problem:
        store.log_run({"run_id": run_id, "status": "failed", "finished_at": now, "notes": [f"fatal: {problem}"[:2000]]})
        raise


def merge(store: Store, scanned: DataFrame, terms: DataFrame, now: str, run_id: str, full: bool, o: Options, whole: bool) -> dict:
    """Diff scanned files against the manifest, then chunk, embed, tag and relate what is new or changed.

    Files that moved keep their document id, and all that is stored of them; a full run gives new document ids and treats every
    file as changed. What is gone becomes a tombstone, if the scan was of the `whole` corpus. Data is written first, the manifest last."""
    spark = store.spark
    old = store.read("corpus_manifest", MANIFEST)
    live = materialize(old.filter("lifecycle_status <> 'deleted'"))
    change = diff(live, scanned)
    change = materialize(change if whole else change.filter("change <> 'deleted'"))
    moved = materialize(moves(live, scanned) if whole and not full else live.limit(0).select(F.col("source_rel_path").alias("new_path"), F.col("source_rel_path").alias("old_path")))
    moved = materialize(moved.groupBy("old_path").agg(F.min("new_path").alias("new_path")))  # of copies of a file that is gone one takes its place
    gone = change.filter("change = 'deleted'").select("source_rel_path").join(moved.select(F.col("old_path").alias("source_rel_path")), "source_rel_path", "left_anti")
    if not moved.isEmpty():
        store.move_sources(moved, now)
    if not gone.isEmpty():
        store.delete_sources(gone, now)
    stored = materialize(store.read("chunk_rows", CHUNKS).groupBy("source_rel_path").agg(F.count_distinct("chunk_id").alias("n")))
    same = S.ready(live, stored).join(change.filter("change = 'unchanged'"), "source_rel_path", "left_semi")
    todo = scanned if full else scanned.join(same, "source_rel_path", "left_anti").join(moved.select(F.col("new_path").alias("source_rel_path")), "source_rel_path", "left_anti")
    known = live.select("source_rel_path", "document_id") if not full else live.limit(0).select("source_rel_path", "document_id")
    todo = todo.join(known, "source_rel_path", "left").withColumn("document_id", F.when(F.col("source_type") != "image_png", F.coalesce("document_id", ids.content_id("source_rel_path", "content_hash", F.lit(now)))))
    todo = materialize(todo)
    store.log_run({"run_id": run_id, "status": "running", "phase": "1-diff", "files_total": scanned.count(), "unchanged_files_skipped": same.count()})
    docs = files_of.documents(todo).join(todo.select("source_rel_path", "absolute_path", "document_id", "source_domain", "source_type", F.col("content_hash").alias("source_hash")), "source_rel_path")
    chunks = materialize(build_chunks(docs, store.read("chunk_rows", CHUNKS), o))
    store.log_run({"run_id": run_id, "status": "running", "phase": "2-chunks", "chunks_written": chunks.count()})
    mentions = materialize(M.detect(chunks, terms, "chunk_id", "text").select(*(c.split()[0] for c in MENTIONS.split(", "))))
    children = {"mention_rows": mentions}
    predicates = o.predicates or (o.ontology.predicates() if o.ontology else [])
    if o.relation_backends and predicates:
        asked = E.qualifying(chunks, mentions, o.least_entities)
        children["extracted_relations"] = materialize(E.extract_relations(asked, predicates, o.relation_backends, o.relation_model, now))
    store.replace_source_chunks(chunks, children, todo.filter("source_type <> 'image_png'").select("source_rel_path"))
    counts = chunks.groupBy("source_rel_path").agg(F.count("*").cast("int").alias("n"))
    asset, empty = F.col("source_type") == "image_png", F.col("n").isNull()
    fresh = todo.join(counts, "source_rel_path", "left").select(
        "source_rel_path", "absolute_path", "source_type", "source_domain", "document_id", "file_size_bytes", "content_hash", F.lit(None).cast("string").alias("parent_source_path"), F.coalesce("n", F.lit(0)).alias("chunk_count"), F.lit(now).alias("last_seen_at"), F.lit(now).alias("last_processed_at"), F.lit(now).alias("last_committed_at"),
        F.when(~asset & empty, "no text").alias("error_message"), F.when(~asset & empty, "failed").otherwise("complete").alias("lifecycle_status"), F.when(asset, "asset_only").when(empty, "not_searchable").otherwise("searchable").alias("retrieval_status"),
    )
    fresh, before = materialize(fresh), store.read("corpus_manifest", MANIFEST)
    arrived = scanned.drop("content").join(moved.withColumnRenamed("new_path", "source_rel_path"), "source_rel_path").join(live.select(F.col("source_rel_path").alias("old_path"), "document_id", "chunk_count", "error_message", "lifecycle_status", "retrieval_status"), "old_path")
    arrived = arrived.withColumns({"parent_source_path": F.lit(None).cast("string"), "last_seen_at": F.lit(now), "last_processed_at": F.lit(now), "last_committed_at": F.lit(now)}).select(*fresh.columns)
    if not moved.isEmpty():
        fresh = materialize(fresh.unionByName(materialize(arrived)))
    manifest = materialize(S.upsert(before, fresh, "source_rel_path"))
    links = S.asset_records(manifest.filter("lifecycle_status <> 'deleted'"), now)
    parents = links.select(F.col("asset_path").alias("source_rel_path"), F.col("parent_source_path").alias("__parent"))
    manifest = manifest.drop("parent_source_path").join(parents, "source_rel_path", "left").withColumnRenamed("__parent", "parent_source_path").select(*before.columns)
    store.replace("asset_links", links)
    if o.ontology is not None:
        _keep_ontology(store, o.ontology, now)
    if o.settings:
        store.put("ingest_config", o.settings, now, whole=True)
    store.replace("corpus_manifest", manifest)
    kinds = {r.change: r.c for r in change.groupBy("change").agg(F.count("*").alias("c")).collect()}
    failed = [f"{r.source_rel_path}: {r.error_message}" for r in fresh.filter("lifecycle_status = 'failed'").orderBy("source_rel_path").limit(100).collect()]
    report = {"run_id": run_id, "status": "complete_with_warnings" if failed else "complete", "finished_at": now, "chunks_written": chunks.count(), "mentions": mentions.count(), "moved": moved.count(), "notes": failed, **{k: kinds.get(k, 0) for k in ("new", "changed", "unchanged", "deleted")}}
    store.log_run(report)
    store.write_json("ingest_snapshot.json", {"run_id": run_id, "finished_at": now} | S.status(store.read("corpus_manifest"), store.read("chunk_rows", CHUNKS), store.read("mention_rows", MENTIONS)).first().asDict())
    return report


def _keep_ontology(store: Store, ontology: Ontology, now: str) -> None:
    """The tables of an ontology, and one row that sums it up."""
    tables = ontology.tables(store.spark)
    for name, rows in tables.items():
        store.replace(f"ontology_{name}", rows)
    terms = M.termset_hash(tables["terms"]).first()[0]
    row = ("current", ontology.snapshot_hash, terms, len(ontology.terms()), len(ontology.sources), len(ontology.entities), len(ontology.paths), len(ontology.edges), len(ontology.issues), now)
    store.replace("ontology_snapshot", store.spark.createDataFrame([row], "snapshot_id string, snapshot_hash string, matcher_termset_hash string, matcher_term_count long, source_file_count long, entity_count long, coverage_path_count long, graph_relation_count long, validation_issue_count long, last_loaded_at string"))


def profiles(definitions: DataFrame, stats: DataFrame, centrality: DataFrame, communities: DataFrame, relations: DataFrame, claims: DataFrame, mentions: DataFrame, old: DataFrame, now: str) -> DataFrame:
    """PROFILES of all defined entities (entity_id, label, kind, domain, aliases). One whose sources have not changed since its
    old row keeps that row's summary by a model. Ranks count all nodes of the graph, an entity outside comes last."""
    n_nodes, n_entities = centrality.count(), definitions.select("entity_id").distinct().count()
    ranks = centrality.select("entity_id", "pagerank", "betweenness", "closeness")
    for measure in ("pagerank", "betweenness", "closeness"):
        ranks = G.ranked(ranks, measure, "entity_id", f"rank_{measure}")
    sides = relations.select("relation_id", "predicate", F.explode(F.array_distinct(F.array("subject_entity_id", "object_entity_id"))).alias("entity_id"))
    by_count = lambda c: F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), "predicate", "count"))), 1, c), lambda x: F.struct(x.predicate.alias("predicate"), x["count"].alias("count")))
    predicates = sides.groupBy("entity_id", "predicate").agg(F.count("*").alias("count")).groupBy("entity_id").agg(by_count(10).alias("top_predicates"))  # the predicates of a vocabulary
    about = claims.select("claim_id", "claim_text", "confidence", "claim_type", F.explode(F.array_distinct(F.filter(F.array("subject_entity_id", "object_entity_id"), lambda x: x.isNotNull()))).alias("entity_id"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("confidence"), "claim_id"))
    best = about.withColumn("r", place).filter("r <= 10")  # a profile counts ten claims at most
    told = best.groupBy("entity_id").agg(F.count("*").alias("n_claims"), F.array_sort(F.collect_list("claim_id")).alias("claim_ids"), F.transform(F.slice(F.array_sort(F.collect_list(F.struct("r", "claim_text", "confidence", "claim_type"))), 1, 5), lambda x: F.struct(x.claim_text.alias("claim_text"), x.confidence.alias("confidence"), x.claim_type.alias("claim_type"))).alias("top_claims"))
    places = mentions.groupBy("entity_id").agg(F.bit_xor(F.xxhash64("chunk_id")).alias("x"), F.count_distinct("chunk_id").alias("c")).select("entity_id", F.concat_ws(":", "x", "c").alias("places"))  # stands for the set of chunks, whatever its size
    sizes = communities.groupBy("community_id").agg(F.count("*").alias("members"))
    rows = definitions.dropDuplicates(["entity_id"])
    for other in (stats, centrality, ranks.drop("pagerank", "betweenness", "closeness"), communities.select("entity_id", "community_id"), predicates, told, places):
        rows = rows.join(other, "entity_id", "left")
    rows = rows.join(sizes, "community_id", "left").fillna(0, ["n_chunks", "n_sources", "n_mentions", "n_claims", "pagerank", "betweenness", "closeness", "in_degree", "out_degree", "eigenvector"]).fillna(n_nodes, ["rank_pagerank", "rank_betweenness", "rank_closeness"])
    rows = rows.withColumn("label", X.title_of_id("entity_id"))
    said = lambda items, most, show: F.coalesce(F.nullif(F.array_join(F.transform(F.slice(items, 1, most), show), "; "), F.lit("")), F.lit("none"))
    text = F.format_string(
        PROFILE_SENTENCE,
        "label", "kind", "domain", "n_mentions", "n_chunks", "n_sources", "rank_pagerank", F.lit(n_entities), "rank_betweenness", F.lit(n_entities), "rank_closeness", F.lit(n_entities),
        F.when(F.col("community_id").isNull(), "unassigned").otherwise(F.concat(F.col("community_id").cast("string"), F.lit(" ("), F.col("members").cast("string"), F.lit(" members)"))),
        said(F.col("top_predicates"), 5, lambda p: F.concat(p.predicate, F.lit(" ("), p["count"].cast("string"), F.lit(")"))), said(F.col("top_claims"), 3, lambda c: F.substring(c.claim_text, 1, 80)),
    )
    marks = ["places", *(F.round(m, 10) for m in ("pagerank", "betweenness", "closeness")), "in_degree", "out_degree", F.round("eigenvector", 8), "community_id", F.array_join("claim_ids", ",")]
    rows = rows.withColumn("summary", text).withColumn("source_hash", ids.content_id(*marks))
    was = old.select("entity_id", F.col("source_hash").alias("h"), F.col("llm_summary").alias("l"), F.col("generated_at").alias("g"))
    kept = F.col("h").isNotNull() & (F.col("h") == F.col("source_hash"))
    rows = rows.join(was, "entity_id", "left").withColumn("llm_summary", F.when(kept, F.col("l"))).withColumn("generated_at", F.when(kept, F.col("g")).otherwise(F.lit(now)))
    return rows.withColumnsRenamed({"kind": "entity_type"}).withColumn("community_id", F.col("community_id").cast("int")).select(*(c.split()[0] for c in PROFILES.split(", ") if " " in c and c.split()[0].isidentifier()))


def community_reports(members: DataFrame, relations: DataFrame, claims: DataFrame, now: str) -> DataFrame:
    """A row per community of profiles (PROFILES with a community): members, the ten highest by PageRank, the five surest claims
    about any member, the relations with both ends inside, a sentence, and a hash of the members and their profiles."""
    at = members.select("entity_id", "community_id")
    side = lambda c: at.select(F.col("entity_id").alias(f"{c}_entity_id"), F.col("community_id").alias(f"c_{c}"))
    inner = relations.join(side("subject"), "subject_entity_id").join(side("object"), "object_entity_id").filter("c_subject = c_object").groupBy(F.col("c_subject").alias("community_id")).agg(F.count("*").alias("inner_edges"))
    about = claims.select("claim_id", "claim_text", "confidence", F.explode(F.array("subject_entity_id", "object_entity_id")).alias("entity_id")).join(at, "entity_id").groupBy("community_id", "claim_id").agg(F.max(F.struct("confidence", "claim_text")).alias("c"))
    from pyspark.sql import Window

    best = about.withColumn("r", F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc("c.confidence"), "claim_id"))).filter("r <= 5")
    told = best.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "c.claim_text", "c.confidence"))), lambda x: F.struct(x.claim_text.alias("claim_text"), x.confidence.alias("confidence"))).alias("top_claims"))
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("pagerank")).alias("o"), "entity_id", "pagerank"))), 1, 10), lambda x: F.struct(x.entity_id.alias("entity_id"), x.pagerank.alias("pagerank")))
    rows = members.groupBy("community_id").agg(F.count("*").alias("member_count"), F.array_sort(F.collect_set("entity_id")).alias("members"), top.alias("top_entities"), F.array_sort(F.collect_set("source_hash")).alias("hashes"))
    rows = rows.join(inner, "community_id", "left").fillna(0, ["inner_edges"]).join(told, "community_id", "left")
    names = F.array_join(F.transform(F.slice("top_entities", 1, 5), lambda x: X.title_of_id(x.entity_id)), ", ")
    claims_text = F.coalesce(F.nullif(F.array_join(F.transform(F.slice("top_claims", 1, 3), lambda c: F.substring(c.claim_text, 1, 60)), "; "), F.lit("")), F.lit("none"))
    text = F.format_string(REPORT_SENTENCE, "community_id", "member_count", names, "inner_edges", claims_text)
    return rows.withColumn("summary", text).withColumn("llm_summary", F.lit(None).cast("string")).withColumn("source_hash", ids.content_id(F.array_join("members", ","), F.array_join("hashes", ","))).withColumn("community_level", F.lit(0)).withColumn("generated_at", F.lit(now)).drop("hashes")


def definitions_of(terms: DataFrame, ontology: Ontology | None) -> DataFrame:
    """entity_id, kind, domain, aliases of all entities: of the ontology, or as far as the terms tell."""
    if ontology is not None:
        return ontology.tables(terms.sparkSession)["entities"].select("entity_id", "kind", "domain", "aliases")
    names = F.array_sort(F.collect_set(F.when(F.col("term_source") == "alias", F.col("normalized_term"))))
    return terms.groupBy("entity_id").agg(names.alias("aliases")).select("entity_id", F.lit("").alias("kind"), F.lit("").alias("domain"), "aliases")


def build_graph(store: Store, terms: DataFrame, phases: list[str] | None = None, ontology: Ontology | None = None, claim_backends: list[providers.Backend] = (), writers: list[providers.Backend] = (), now: str = "", run_id: str = "graph", full: bool = False, portion: int = 500, least_entities: int = 1, floor: float = 0.5) -> list[str]:
    """Rebuild the derived tables phase by phase; each phase replaces its tables, so a run can be repeated from anywhere.

    Claims are extracted with `claim_backends`, from chunks that have none unless the run is `full`, a portion at a time; profiles and
    reports get a text by `writers`, if there are any. The run is logged phase by phase, and its version kept. Graphs above the
    bound of the searches from every node have no betweenness, closeness and eigenvector (null), and communities by label propagation."""
    phases = PHASES if phases is None else phases
    if unknown := set(phases) - set(PHASES):
        raise ValueError(f"unknown phases: {sorted(unknown)}")
    spark = store.spark
    version = int(store.get("graph_metadata").get("graph_version", "0")) + (1 if full else 0)
    log: Callable = lambda status, **more: store.log_run({"run_id": run_id, "status": status, "graph_version": version} | more, "graph_builds")
    log("running", started_at=now)
    try:
        notes = _phases(store, terms, phases, ontology, claim_backends, writers, now, full, portion, least_entities, floor, log)
    except Exception as problem:
        log("failed", finished_at=now, notes=[f"error: {problem}"[:2000]])
        raise
    store.put("graph_metadata", {"graph_version": str(version), "last_build_at": now}, now)
    log("complete", finished_at=now, notes=notes)
    return [p for p in PHASES if p in phases] if spark else []


def _phases(store, terms, phases, ontology, claim_backends, writers, now, full, portion, least_entities, floor, log) -> list[str]:
    spark, notes = store.spark, []

    def done(phase: str, **counts: int) -> None:
        log("running", phase=f"{PHASES.index(phase)}-{phase}", **counts)
        notes.extend(f"{k}={v}" for k, v in counts.items())

    mentions = C.clean_mentions(store.read("mention_rows", MENTIONS))
    relations = C.clean_relations(store.read("extracted_relations", E.RELATIONS))
    if "consolidate" in phases:
        store.replace("relations", C.canonical_relations(relations))
        store.replace("relation_evidence", C.relation_evidence(relations, store.read("chunk_rows", CHUNKS), mentions))
        done("consolidate", relations_consolidated=store.read("relations").count(), evidence_rows_built=store.read("relation_evidence").count())
    if "claims" in phases and claim_backends:
        attempted = extract_claims(store, claim_backends, "model", now, full, portion, least_entities)
        done("claims", claims_extracted=attempted)
    known = ontology.tables(spark)["edges"] if ontology is not None else spark.createDataFrame([], "src string, dst string, relation string")
    edges = materialize(G.combined_edges(known, relations, floor))
    if "centrality" in phases:
        rank = G.pagerank(edges).join(G.degrees(edges), "id")
        if G.within_bound(edges):
            for measure in (G.betweenness, G.closeness, G.eigenvector):
                rank = rank.join(measure(edges), "id", "left")
        else:
            rank = rank.withColumns({m: F.lit(None).cast("double") for m in ("betweenness", "closeness", "eigenvector")})
        store.replace("centrality", rank.withColumnsRenamed({"id": "entity_id", "rank": "pagerank"}))
        done("centrality", centrality_computed=store.read("centrality").count())
    if "communities" in phases:
        found = G.communities_of_any_size(edges).withColumnsRenamed({"id": "entity_id", "community": "community_id"})
        store.replace("entity_communities", found.withColumn("community_level", F.lit(0)))
        communities = store.read("entity_communities")
        if store.exists("community_reports"):
            store.replace("community_reports", store.read("community_reports").join(communities.select("community_id").distinct(), "community_id", "left_semi"))
        done("communities", communities_detected=communities.select("community_id").distinct().count())
    claims = store.read("claims", E.CLAIMS)
    canonical = store.read("relations") if store.exists("relations") else C.canonical_relations(relations)
    if "profiles" in phases:
        stats = C.entity_stats(mentions, C.chunk_sources(store.read("chunk_rows", CHUNKS)))
        old = store.read("entity_profiles", PROFILES)
        rows = profiles(definitions_of(terms, ontology), stats, store.read("centrality"), store.read("entity_communities"), canonical, claims, mentions, old.limit(0) if full else old, now)
        store.replace("entity_profiles", rows)
        done("profiles", entity_profiles_built=store.read("entity_profiles").filter(F.col("generated_at") == now).count())
    if "reports" in phases:
        members = store.read("entity_communities").select("entity_id", "community_id").join(store.read("entity_profiles", PROFILES).select("entity_id", "source_hash"), "entity_id", "left").join(store.read("centrality").select("entity_id", "pagerank"), "entity_id", "left")
        store.replace("community_reports", community_reports(members, canonical, claims, now))
        done("reports", community_reports_built=store.read("community_reports").count())
    if "embeddings" in phases:
        chunks = store.read("chunk_rows", CHUNKS)
        dims = (chunks.agg(F.max("embedding_dims")).first() or [0])[0] or 1
        means = C.mean_vectors(mentions, chunks, dims)
        named = store.read("entity_communities", "entity_id string, community_id int").select("entity_id", "community_id")
        store.replace("entity_embeddings", means.join(named, "entity_id", "left").withColumn("label", X.title_of_id("entity_id")).fillna(-1, ["community_id"]).select("entity_id", "label", F.col("community_id").cast("int").alias("community_id"), "vector"))
        done("embeddings", entity_embeddings_computed=store.read("entity_embeddings").count())
    if "enrichment" in phases and writers:
        done("enrichment", llm_enrichment_count=enrich(store, writers, full))
    return notes


def extract_claims(store: Store, backends: list[providers.Backend], model: str, now: str, full: bool = False, portion: int = 500, least_entities: int = 1) -> int:
    """Claims of chunks that mention enough entities and have none yet, committed a portion at a time; claims whose id is known are
    left as they are. Returns how many were put forward."""
    mentions = C.clean_mentions(store.read("mention_rows", MENTIONS))
    chunks = E.qualifying(store.read("chunk_rows", CHUNKS), mentions, least_entities)
    chunks = materialize(chunks if full else E.todo(chunks, store.read("claims", E.CLAIMS)))
    attempted = 0

    def commit(rows: DataFrame) -> None:
        nonlocal attempted
        rows = materialize(rows)
        attempted += rows.count()
        store.insert_or_ignore("claims", rows, "claim_id")

    providers.in_portions(chunks, "chunk_id", portion, lambda part: E.extract_claims(part, backends, model, now), commit)
    return attempted


def enrich(store: Store, writers: list[providers.Backend], full: bool = False) -> int:
    """A text by a model for profiles and reports that have none; those whose call fails stay without. Returns how many got one."""
    n = 0
    for table, key, about in (("entity_profiles", "entity_id", F.concat(F.lit("Entity: "), "label")), ("community_reports", "community_id", F.format_string("Community %d (%d members)", "community_id", "member_count") if store.exists("community_reports") else None)):
        if not store.exists(table):
            continue
        rows = store.read(table)
        todo = (rows if full else rows.filter("llm_summary is null")).withColumn("user", F.concat_ws("\n\n", about, "summary"))
        told = materialize(providers.ask(todo, key, "Write a short summary for readers who don't know it, from what is said below only.", "user", writers).withColumnRenamed("raw", "llm_summary"))
        n += told.filter("trim(llm_summary) <> ''").count()
        store.replace(table, S.filled_in(rows, told, key, "llm_summary"))
    return n
