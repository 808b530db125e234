"""The tools a caller asks, as functions over a store. Names that don't exist give empty tables, wrong arguments an error."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope import providers, settings
from folioscope.functions import text as X
from folioscope.operators import corpus as C
from folioscope.operators import extraction as E
from folioscope.operators import graph as G
from folioscope.operators import lookups as L
from folioscope.operators import matching as M
from folioscope.operators import pipeline as P
from folioscope.operators import retrieval as R
from folioscope.operators import store as S
from folioscope.operators.store import Store, latest_manifest
from folioscope.sources.ontology import Ontology

MOST_RESULTS = 50
MIN_CHUNKS, MIN_CHARS = 2, 400
# What a caller reads where there is no answer by a model.
NO_RESULTS = "No matching evidence was found in the current store."
TOO_LITTLE = "Evidence was retrieved, but it is not sufficient to ground a reliable answer."
NO_MODEL = "Evidence was retrieved, but the configured synthesis model is unavailable."
Synthesizer = Callable[[str], str]
log = logging.getLogger(__name__)


@dataclass
class Found:
    """Hits of a search, best first, with what is to be said about how they were found."""

    hits: DataFrame
    warnings: list[str] = field(default_factory=list)
    matched: list[str] = field(default_factory=list)
    added: list[str] = field(default_factory=list)
    reranked: bool = False


@dataclass
class Answer:
    status: str
    text: str
    citations: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)


class Tools:
    """ontology: where related concepts, expansion and paths are looked up; without one the canonical relations are the graph."""

    def __init__(self, store: Store, embedder: providers.Embedder | None = None, dims: int = 96, reranker: providers.Reranker | None = None, synthesizer: Synthesizer | None = None, ontology: Ontology | None = None, remembered: dict[str, str] | None = None, options: settings.Settings | None = None) -> None:
        self.store, self.dims, self.reranker, self.synthesizer, self.ontology = store, dims, reranker, synthesizer, ontology
        self.embedder = embedder or providers.hashing_embedder(dims)
        self.remembered = remembered or {}
        self.options = options or settings.Settings(settings.Paths("", "", ""))
        self._tables = ontology.tables(store.spark) if ontology is not None else None

    def _edges(self) -> DataFrame:
        """src, relation, dst, weight of the graph that is asked."""
        if self._tables is not None:
            return self._tables["edges"].withColumn("weight", F.lit(0.5))
        return self.store.read("relations").select(F.col("subject_entity_id").alias("src"), F.col("predicate").alias("relation"), F.col("object_entity_id").alias("dst"), F.col("max_confidence").alias("weight"))

    def _entity_edges(self) -> DataFrame:
        """The edges between entities."""
        if self._tables is None:
            return self._edges()
        known = self._tables["nodes"].filter("node_type = 'entity'").select("id")
        return self._edges().join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")

    def _definitions(self, terms: DataFrame) -> DataFrame:
        """entity_id, label, aliases."""
        if self._tables is not None:
            return self._tables["entities"].select("entity_id", "label", "aliases")
        return P.definitions_of(terms, None).select("entity_id", F.lit(None).cast("string").alias("label"), "aliases")

    # status
    def drift(self) -> list[str]:
        return settings.drift(self.remembered, self.store.get("ingest_config")) if self.remembered else []

    def corpus_status(self) -> dict:
        """Counts of files, retrieval roles, chunks and mentions, what is known of the ontology, and settings that have changed.

        Before anything is committed, or where the snapshot of the ontology lacks its counts, the loaded ontology tells them."""
        row = S.status(latest_manifest(self.store.read("corpus_manifest", P.MANIFEST)), self.store.read("chunk_rows", P.CHUNKS), self.store.read("mention_rows", P.MENTIONS)).first().asDict()
        kept = self.store.read("ontology_snapshot").first().asDict() if self.store.exists("ontology_snapshot") else None
        if self.ontology is not None and (kept is None or (kept["source_file_count"] and not kept["coverage_path_count"] and not kept["graph_relation_count"])):
            o = self.ontology
            kept = {"snapshot_hash": o.snapshot_hash, "matcher_term_count": len(o.terms()), "source_file_count": len(o.sources), "entity_count": len(o.entities), "coverage_path_count": len(o.paths), "graph_relation_count": len(o.edges), "validation_issue_count": len(o.issues)}
        samples = [r.message for r in self.store.read("ontology_issues").limit(10).collect()] if self.store.exists("ontology_issues") else []
        return row | {f"ontology_{k}": v for k, v in (kept or {}).items()} | {"ontology_issue_samples": samples, "config_drift_warnings": self.drift()}

    def graph_overview(self) -> dict:
        """Version and time of the last build, and how much there is of everything."""
        known = self.store.get("graph_metadata")
        names = {"relations": "relation_id string", "relation_evidence": "evidence_id string", "claims": E.CLAIMS, "entity_profiles": P.PROFILES, "entity_communities": "entity_id string, community_id int", "community_reports": "community_id int"}
        row = L.counts({t: self.store.read(t, s) for t, s in names.items()}).first().asDict()
        return {"graph_version": int(known.get("graph_version", "0")), "last_build_at": known.get("last_build_at", "never"), "community_algorithm": known.get("community_algorithm", "greedy modularity")} | row

    def graph_status(self) -> dict:
        """The overview and the state of the build that started last."""
        return self.graph_overview() | {"last_build": L.latest(self.store.runs("graph_builds"))}

    def build_preview(self, least_entities: int = 1) -> DataFrame:
        return E.preview(self.store.read("chunk_rows", P.CHUNKS), C.clean_mentions(self.store.read("mention_rows", P.MENTIONS)), self.store.read("claims", E.CLAIMS), least_entities)

    def entity_types(self) -> list[str]:
        if self.ontology is not None:
            return sorted(e["canonical_id"] for e in self.ontology.entities)
        return [r.entity_id for r in self.store.read("entity_profiles", P.PROFILES).select("entity_id").orderBy("entity_id").collect()]

    # search
    def _validate(self, question: str, limit: int, domain: str | None) -> str:
        if not question or not question.strip():
            raise ValueError("the question is empty")
        if not 1 <= limit <= MOST_RESULTS:
            raise ValueError(f"the limit is not in 1..{MOST_RESULTS}")
        if domain is not None:
            if not domain.strip():
                raise ValueError("the domain is empty")
            known = [r.source_domain for r in latest_manifest(self.store.read("corpus_manifest", P.MANIFEST)).filter("lifecycle_status <> 'deleted' and source_domain is not null").select("source_domain").distinct().orderBy("source_domain").collect()]
            if not known:
                raise ValueError("there is no domain yet: nothing has been brought in")
            if domain not in known:
                raise ValueError(f"no domain {domain}; there are {', '.join(known)}")
        return question.strip()

    def expand(self, question: str, terms: DataFrame) -> tuple[list[str], list[str], str]:
        """(entities that the question names, terms of these and of related ones that it lacks, the question with these).

        Related are neighbours in the graph, then entities that extracted relations of the corpus name together with them."""
        o = self.options.expansion
        asked = self.store.spark.createDataFrame([(0, question)], "k int, q string")
        named = M.detect(asked, terms, "k", "q").orderBy("start_char", "end_char", "entity_id").collect()
        seeds = list(dict.fromkeys(r.entity_id for r in named))
        if not seeds:
            return [], [], question
        near = G.expand(self._entity_edges(), seeds, o.hops, o.max_terms) if self.ontology is not None or self.store.exists("relations") else []
        relations = C.clean_relations(self.store.read("extracted_relations", E.RELATIONS))
        corpus = [r.entity_id for r in R.related_entities(relations, seeds, most=o.max_terms).orderBy("rank").collect()]
        order = list(dict.fromkeys([*near, *corpus, *seeds]))
        rows = self.store.spark.createDataFrame([(i, e) for i, e in enumerate(order)], "rank int, entity_id string")
        added = [r.term for r in R.expansion_terms(rows, self._definitions(terms), question, o.max_terms).orderBy("rank").collect()]
        return seeds, added, question + (f"\n\nRelated concepts: {'; '.join(added)}" if added else "")

    def search(self, question: str, terms: DataFrame, domain: str | None = None, limit: int | None = None) -> Found:
        """Dense hits of the expanded question; the best of each source are reranked and fused with the lexical and relation
        rankings, then come the other hits in dense order."""
        o = self.options.retrieval
        limit = o.dense_top_k if limit is None else limit
        question = self._validate(question, limit, domain)
        warnings, chunks = self.drift(), self.store.read("chunk_rows", P.CHUNKS)
        columns = ["chunk_id", "document_id", "source_rel_path", "source_filename", "source_domain", "citation_label", "score_hint", "text", "metadata_json"]
        if chunks.isEmpty():
            return Found(chunks.select(*columns, F.lit(0.0).alias("score"), F.lit(0).alias("rank")), ["nothing has been brought in yet", *warnings])
        seeds, added, expanded = self.expand(question, terms)
        vector = providers.embed_question(self.embedder, expanded, self.options.embedding.query_instruction)
        best = R.nearest(chunks, vector, "chunk_id", "vector", k=MOST_RESULTS, where=None if domain is None else F.col("source_domain") == domain)
        page = best.join(chunks.select(*columns).dropDuplicates(["chunk_id"]), "chunk_id").orderBy("dense_rank").toArrow().to_pylist()  # at most 50 rows
        wanted = max(limit, o.dense_top_k, o.rerank_top_k)
        seen, firsts, at = set(), [], {}
        for r in page:
            if r["source_rel_path"] not in seen:
                seen.add(r["source_rel_path"])
                firsts.append(r)
            at[r["dense_rank"]] = len(seen)
        fetched = R.fetch_size(limit, o.rerank_top_k, at, wanted, MOST_RESULTS)
        page = [r for r in page if r["dense_rank"] <= fetched]
        firsts = [r for r in firsts if r["dense_rank"] <= fetched][: min(wanted, o.rerank_top_k)]
        order, applied, said = providers.rerank(question, [(r["chunk_id"], r["text"]) for r in firsts], self.reranker)
        spark = self.store.spark
        rows = spark.createDataFrame([(r["chunk_id"], i, *(r[c] for c in ("source_filename", "source_rel_path", "citation_label", "score_hint"))) for i, r in enumerate(firsts, 1)], "chunk_id string, dense_rank int, source_filename string, source_rel_path string, citation_label string, score_hint string")
        hint = F.concat_ws(" ", "source_filename", "source_rel_path", "citation_label", F.substring("score_hint", 1, 240))
        rows = rows.withColumn("lexical", X.lexical_score(X.significant_terms(F.lit(question)), hint))
        hit = L.chunks_with_relations(self.store.read("extracted_relations", E.RELATIONS), seeds).withColumn("hit", F.lit(True))
        rows = rows.join(hit, "chunk_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
        if applied:
            rows = rows.join(spark.createDataFrame([(c, i) for i, c in enumerate(order, 1)], "chunk_id string, rerank_rank int"), "chunk_id", "left")
        fused = R.fuse(rows, "chunk_id", "lexical", "hit", "rerank_rank" if applied else None, o.lexical_fusion_weight, o.relation_fusion_weight)
        prefix = [r.chunk_id for r in fused.orderBy("fused_rank").select("chunk_id").collect()]
        by_id = {r["chunk_id"]: r for r in page}
        final = [*prefix, *(r["chunk_id"] for r in page if r["chunk_id"] not in set(prefix))][:limit]
        hits = spark.createDataFrame([tuple(by_id[c][x] for x in columns) + (-by_id[c]["distance"], i) for i, c in enumerate(final, 1)], ", ".join(f"{c} string" for c in columns) + ", score double, rank int")
        return Found(hits, [*said, *warnings], seeds, added, applied)

    def search_corpus(self, question: str, terms: DataFrame, domain: str | None = None, limit: int = 10) -> tuple[DataFrame, list[str]]:
        found = self.search(question, terms, domain, limit)
        return found.hits.orderBy("rank"), found.warnings

    def search_knowledge(self, question: str, terms: DataFrame, domain: str | None = None) -> Answer:
        """An answer by the synthesizer from the best hits, with what the graph knows of the entities asked about."""
        found = self.search(question, terms, domain)
        rows = found.hits.orderBy("rank").limit(self.options.synthesis.max_chunks).collect()  # a page of results
        context = self.graph_prompt(found.matched)
        about = {"reranking_applied": found.reranked, "expansion_applied": bool(found.added), "matched_entity_ids": found.matched, "expansion_terms": found.added, "result_count": found.hits.count(), "graph_context_applied": bool(context)}
        if not rows:
            return Answer("no_results", NO_RESULTS, [], found.warnings, about)
        if len(rows) < MIN_CHUNKS or sum(len(r.text.strip()) for r in rows) < MIN_CHARS:
            return Answer("insufficient_evidence", TOO_LITTLE, [], found.warnings, about)
        citations = [r.citation_label for r in rows]
        if self.synthesizer is None:
            return Answer("synthesis_unavailable", NO_MODEL, citations, [*found.warnings, "no synthesis model is set"], about)
        try:
            text = X.strip_thinking(self.synthesizer(answer_prompt(question, [(r.citation_label, r.text) for r in rows], context)))
        except Exception as problem:  # noqa: BLE001 (any failure of an outside service)
            return Answer("synthesis_unavailable", NO_MODEL, citations, [*found.warnings, f"synthesis failed: {problem}"], about)
        if not text:
            return Answer("synthesis_unavailable", NO_MODEL, citations, [*found.warnings, "the synthesis model gave an empty answer"], about)
        return Answer("answered", text, citations, found.warnings, about)

    def search_knowledge_deep(self, question: str, terms: DataFrame, domain: str | None = None) -> tuple[Answer, dict]:
        """The answer, and what the graph knows of the entities asked about."""
        found = self.search_knowledge(question, terms, domain)
        return found, self.graph_context(found.metadata["matched_entity_ids"])

    def graph_context(self, entities: list[str]) -> dict:
        """level (none, entity or community); profiles of the entities, the highest by PageRank; reports of their communities if
        there are two or more; the surest claims about any of them."""
        o = self.options.graph
        none = {"level": "none", "profiles": [], "reports": [], "claims": []}
        if not entities or not self.store.exists("entity_profiles"):
            return none
        kept = [r.asDict(True) for r in self.store.read("entity_profiles").filter(F.col("entity_id").isin(entities)).orderBy(F.desc("pagerank"), "entity_id").limit(o.max_entity_context).collect()]
        if not kept:
            return none
        groups = sorted({p["community_id"] for p in kept if p["community_id"] is not None})
        reports = [r.asDict(True) for r in self.store.read("community_reports").filter(F.col("community_id").isin(groups)).orderBy("community_id").limit(o.max_community_context).collect()] if len(groups) > 1 and self.store.exists("community_reports") else []
        claims = [r.asDict() for r in L.claims_about(self.store.read("claims", E.CLAIMS), entities, o.max_claim_context).collect()]
        return {"level": "community" if reports else "entity", "profiles": kept, "reports": reports, "claims": claims}

    def graph_prompt(self, entities: list[str]) -> str:
        """The context as a section of a prompt; empty if there is none, or it can't be read."""
        try:
            return context_prompt(self.graph_context(entities))
        except Exception as problem:  # noqa: BLE001 (an answer without it is better than none)
            log.warning("no graph context: %s", problem)
            return ""

    def find_documents_for_concept(self, entity: str, hops: int = 1, limit: int = 10) -> DataFrame:
        L.non_empty(entity, "entity_id")
        around = [entity, *G.expand(self._entity_edges(), [entity], hops, MOST_RESULTS)]
        return R.entity_hits(C.clean_mentions(self.store.read("mention_rows")), C.chunk_sources(self.store.read("chunk_rows")), around, limit)

    # entities
    def related_concepts(self, entity: str) -> DataFrame:
        L.non_empty(entity, "entity_id")
        return G.neighbours(self._edges(), entity, self._tables["nodes"] if self._tables is not None else None)

    def corpus_relations(self, entity: str, limit: int = 50) -> DataFrame:
        return L.relations_about(C.clean_relations(self.store.read("extracted_relations", E.RELATIONS)), L.non_empty(entity, "entity_id"), limit)

    def entity_summary(self, entity: str) -> DataFrame:
        return L.one(self.store.read("entity_profiles", P.PROFILES), "entity_id", L.non_empty(entity, "entity_id"))

    def community_context(self, entity: str) -> DataFrame:
        return self.store.read("community_reports").join(self.entity_summary(entity).select("community_id"), "community_id", "left_semi")

    def similar_entities(self, entity: str, limit: int = 10) -> DataFrame:
        """By distance between mean vectors; the entity's own is taken from its chunks as they are now."""
        L.non_empty(entity, "entity_id")
        mentions = C.clean_mentions(self.store.read("mention_rows", P.MENTIONS)).filter(F.col("entity_id") == entity)
        mine = C.mean_vectors(mentions, self.store.read("chunk_rows", P.CHUNKS), self.dims, least=1).first()
        rows = self.store.read("entity_embeddings", "entity_id string, vector array<double>").filter(F.col("entity_id") != entity)
        return R.nearest(rows, list(mine.vector) if mine else [], "entity_id", "vector", limit, "l2")

    def search_entities(self, text: str, limit: int = 20) -> DataFrame:
        return R.search_profiles(self.store.read("entity_profiles", P.PROFILES), L.non_empty(text, "query"), limit)

    def inspect_evidence(self, relation_id: str) -> DataFrame:
        return L.evidence_of(self.store.read("relation_evidence"), L.non_empty(relation_id, "relation_id"))

    def top_entities(self, metric: str, limit: int = 20) -> DataFrame:
        """metric: pagerank (hubs), betweenness (bridges) or closeness (foundations), or another of the profile."""
        if metric not in ("pagerank", "betweenness", "closeness", "in_degree", "out_degree", "eigenvector"):
            raise ValueError(f"unknown metric: {metric}")
        return L.top(self.store.read("entity_profiles", P.PROFILES), metric, limit)

    def find_path(self, source: str, target: str, most: int = 5) -> dict:
        """The shortest directed path with the relation of each step; empty if there is none, with a note if it is too long."""
        L.non_empty(source, "source"), L.non_empty(target, "target")
        edges = self._edges()
        row = G.shortest_path(edges, source, target, most).first()
        if row is None:
            longer = G.shortest_path(edges, source, target, 4 * most).first() is not None
            return {"path": [], "edges": [], "hops": 0} | ({"note": f"the shortest path has more than {most} steps"} if longer else {})
        path = row.path.split(">")
        return {"path": path, "edges": G.path_edges(edges, path), "hops": len(path) - 1}

    def find_weighted_path(self, source: str, target: str) -> tuple[list[str], float] | None:
        L.non_empty(source, "source"), L.non_empty(target, "target")
        return G.weighted_path(self._edges().withColumn("weight", 1 - X.unit_interval("weight")), source, target)

    # evaluation
    def evaluate(self, cases: DataFrame, terms: DataFrame, k: int = 10, limit: int = 20) -> tuple[DataFrame, DataFrame]:
        """(per case: recall and reciprocal rank at k, one row: their means) of cases (question, expected, domain)."""
        ranked, expected = [], []
        for i, r in enumerate(cases.collect()):  # a hand-written list of questions
            found = self.search(r.question, terms, r.domain, limit)
            ranked += [(i, h["rank"], h.source_rel_path) for h in found.hits.collect()]
            expected += [(i, s) for s in r.expected] or [(i, None)]
        spark = self.store.spark
        per_case = R.evaluate(spark.createDataFrame(ranked, "case int, rank int, source string"), spark.createDataFrame(expected, "case int, source string"), k).fillna(0.0, ["recall", "reciprocal_rank"])
        return per_case, R.evaluation_summary(per_case)


def context_prompt(context: dict) -> str:
    """What the graph knows, as a text for a prompt; empty for no context."""
    if context["level"] == "none":
        return ""
    lines = ["Known about the entities:"]
    lines += [" ".join(x for x in (f"- {p['label']} ({p['entity_type']}):", p["summary"], p["llm_summary"]) if x) for p in context["profiles"]]
    if context["reports"]:
        lines += ["Known about their communities:", *(" ".join(x for x in (f"- Community {r['community_id']} ({r['member_count']} members):", r["summary"], r["llm_summary"]) if x) for r in context["reports"])]
    if context["claims"]:
        lines += ["Claims:", *(f"- [{c['claim_type']}] {c['claim_text']} (confidence: {c['confidence']:.2f})" for c in context["claims"])]
    return "\n".join(lines)


def answer_prompt(question: str, evidence: list[tuple[str, str]], context: str = "") -> str:
    """What a synthesizer is asked: the rules, what the graph knows, the question, and the evidence under its labels."""
    parts = ["Answer from the evidence below alone; say so if it does not suffice."]
    if context:
        parts += ["What is known of the graph may frame the answer; facts come from the evidence.", context]
    return "\n\n".join([*parts, f"Question:\n{question}", "Evidence:\n" + "\n\n".join(f"[{label}]\n{text}" for label, text in evidence)])
