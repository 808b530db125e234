import io
import json

import pytest
from pyspark.sql import functions as F

from folioscope import providers, settings
from folioscope.__main__ import App
from folioscope.api import Tools
from folioscope.operators import extraction as E
from folioscope.operators import pipeline as P
from folioscope.operators.store import Store
from folioscope.server import serve
from folioscope.sources import corpus as files
from folioscope.sources import ontology
from folioscope.streaming.ingest import watch

TERMS = [("story_cue", "canonical_id", "story cue"), ("pace_map", "canonical_id", "pace map"), ("pace_map", "alias", "map of pace")]
TERM_SCHEMA = "entity_id string, term_source string, normalized_term string"
DAY = "2031-01-0{}T00:00:00+00:00".format


@pytest.fixture()
def corpus(tmp_path):
    root = tmp_path / "kb"
    (root / "Play Books" / "one_images").mkdir(parents=True)
    (root / "Play Books" / "one.md").write_text("# One\n\nThe story cue and the pace map go together. " * 20)
    (root / "Play Books" / "one_images" / "page7_x.png").write_bytes(b"png")
    (root / "two.md").write_text("A pace map alone is here. " * 40)
    (root / "three.docling.json").write_text('{"name":"x","texts":[{"text":"Head","label":"section_header","level":1,"prov":[{"page_no":3}]},{"text":"The story cue again, with the pace map.","label":"text"}]}')
    (root / "empty.md").write_text(" \n")
    (root / "skip.txt").write_text("no")
    return root


@pytest.fixture()
def terms(spark):
    return spark.createDataFrame(TERMS, TERM_SCHEMA)


def counted(embedder):
    seen = []

    def embed(texts):
        seen.extend(texts)
        return embedder(texts)

    return embed, seen


def options(**more):
    return P.Options(relation_backends=[providers.offline_relations], predicates=["uses"], **more)


def test_ingest_is_incremental_and_moves_keep_everything(spark, corpus, tmp_path, terms):
    store, o = Store(spark, str(tmp_path / "store")), options()
    first = P.ingest(spark, store, str(corpus), terms, DAY(1), "r1", options=o)
    assert (first["new"], first["deleted"], first["chunks_written"], first["status"]) == (5, 0, 3, "complete_with_warnings")
    assert first["notes"] == ["empty.md: no text"]
    state = {r.source_rel_path: r for r in store.read("corpus_manifest").collect()}
    png = state["Play Books/one_images/page7_x.png"]
    assert (png.retrieval_status, png.parent_source_path, state["empty.md"].lifecycle_status) == ("asset_only", str(corpus / "Play Books" / "one.md"), "failed")
    link = store.read("asset_links").first()
    assert (link.page_no, link.link_method, link.parent_document_id) == (7, "markdown_sibling_images_dir", state["Play Books/one.md"].document_id)
    assert store.read("extracted_relations").count() == 2
    P.extract_claims(store, [providers.offline_claims], "m", DAY(1))
    chunks = {r.source_rel_path: r for r in store.read("chunk_rows").collect()}
    related, claimed = store.read("extracted_relations").count(), store.read("claims").count()
    assert claimed > 2 and P.extract_claims(store, [providers.offline_claims], "m", DAY(1)) == 0
    (corpus / "Play Books" / "one.md").rename(corpus / "moved.md")
    again = P.ingest(spark, store, str(corpus), terms, DAY(2), "r2", options=P.Options(embedder=lambda texts: pytest.fail("embedded again") if texts else []))
    assert (again["new"], again["deleted"], again["moved"], again["unchanged"], again["chunks_written"]) == (1, 1, 1, 4, 0)
    state = {r.source_rel_path: r for r in store.read("corpus_manifest").collect()}
    moved = {r.source_rel_path: r for r in store.read("chunk_rows").collect()}
    old, new = chunks["Play Books/one.md"], moved["moved.md"]
    assert state["moved.md"].document_id == old.document_id and state["moved.md"].chunk_count == 1 and state["Play Books/one.md"].lifecycle_status == "deleted"
    assert (new.chunk_id, list(new.vector), new.source_filename, new.citation_label) == (old.chunk_id, list(old.vector), "moved.md", "moved.md")
    assert store.read("extracted_relations").count() == related and store.read("claims").count() == claimed and store.read("mention_rows").filter(F.col("chunk_id") == new.chunk_id).count() > 0
    assert {r.source_rel_path for r in store.read("claims").collect()} >= {"moved.md"}
    (corpus / "two.md").write_text("Something else, of no map. " * 30)
    (corpus / "three.docling.json").unlink()
    third = P.ingest(spark, store, str(corpus), terms, DAY(3), "r3", options=o)
    assert (third["changed"], third["deleted"]) == (1, 1) and "three.docling.json" not in {r.source_rel_path for r in store.read("chunk_rows").collect()}
    assert [r["run_id"] for r in store.runs()] == ["r1", "r2", "r3"] and store.runs()[0]["files_total"] == 5


def test_texts_that_are_too_long_are_split_and_kept_vectors_are_not_made_again(spark, corpus, tmp_path, terms):
    store = Store(spark, str(tmp_path / "store"))
    P.ingest(spark, store, str(corpus), terms, DAY(1), "r1", options=P.Options(embedder=providers.hashing_embedder(96, most=70)))
    rows = store.read("chunk_rows").filter("source_rel_path = 'two.md'").orderBy("chunk_index").collect()
    assert len(rows) == 4 and [r.chunk_index for r in rows] == list(range(4)) and all(r.token_count <= 70 for r in rows)
    assert [r.chunk_occurrence for r in rows if r.chunk_hash == rows[0].chunk_hash] == list(range(sum(r.chunk_hash == rows[0].chunk_hash for r in rows)))
    store = Store(spark, str(tmp_path / "other"))
    P.ingest(spark, store, str(corpus), terms, DAY(1), "r1")
    (corpus / "two.md").write_text((corpus / "two.md").read_text() + "\n\n# More\n\nA second part that is quite new. " * 9)
    P.ingest(spark, store, str(corpus), terms, DAY(2), "r2", options=P.Options(embedder=lambda texts: pytest.fail("an old text") if any("alone" in t for t in texts) else providers.hashing_embedder(96)(texts)))
    assert store.read("chunk_rows").filter("source_rel_path = 'two.md'").count() == 2
    with pytest.raises(Exception, match="numbers"):
        P.ingest(spark, store, str(corpus), terms, DAY(3), "r3", full=True, options=P.Options(embedder=providers.hashing_embedder(8)))
    assert store.runs()[-1]["status"] == "failed"


def test_graph_and_tools(spark, corpus, tmp_path, terms):
    store = Store(spark, str(tmp_path / "store"))
    assert not store.has_state()
    P.ingest(spark, store, str(corpus), terms, DAY(1), "r1", options=options())
    with pytest.raises(ValueError):
        P.build_graph(store, terms, ["nothing"])
    build = lambda day, **more: P.build_graph(store, terms, claim_backends=[providers.offline_claims], now=DAY(day), run_id=f"g{day}", **more)
    build(1, writers=[lambda system, user: "A text about it." if "Story Cue" in user else ""])
    kept = {r.entity_id: (r.summary, r.llm_summary, r.generated_at) for r in store.read("entity_profiles").collect()}
    assert kept["story_cue"][0].startswith("Story Cue is a  entity in the  domain. It has ") and "Centrality: PageRank 2/2" in kept["story_cue"][0] and "uses (1)" in kept["story_cue"][0]
    assert kept["story_cue"][1] == "A text about it." and kept["pace_map"][1] is None
    build(2)
    assert {r.entity_id: (r.summary, r.llm_summary, r.generated_at) for r in store.read("entity_profiles").collect()} == kept
    build(3, full=True)
    assert store.read("entity_profiles").filter("llm_summary is null").count() == 2
    tools = Tools(store)
    assert tools.graph_overview()["graph_version"] == 1 and tools.graph_status()["last_build"]["status"] == "complete" and tools.build_preview().first().calls == 0
    hits, warnings = tools.search_corpus("How does a story cue work?", terms, limit=5)
    assert [r["rank"] for r in hits.collect()] == [1, 2, 3] and warnings
    seeds, added, text = tools.expand("How does a story cue work?", terms)
    assert seeds == ["story_cue"] and added == ["pace_map", "map of pace", "story_cue"] and text.endswith("Related concepts: pace_map; map of pace; story_cue")
    assert tools.search_knowledge("story cue", terms).status == "synthesis_unavailable"
    tools.synthesizer = lambda prompt: "<think>x</think> Yes." if "Known about the entities" in prompt and "Claims:" in prompt else ""
    answer, context = tools.search_knowledge_deep("story cue", terms)
    assert (answer.status, answer.text, context["level"]) == ("answered", "Yes.", "entity") and answer.metadata["graph_context_applied"]
    assert tools.find_weighted_path("story_cue", "pace_map")[0] == ["story_cue", "pace_map"]
    assert tools.find_path("story_cue", "pace_map") == {"path": ["story_cue", "pace_map"], "edges": [("story_cue", "pace_map", "uses")], "hops": 1}
    assert tools.top_entities("pagerank").first().entity_id == "pace_map" and tools.search_entities("OF PACE").first().entity_id == "pace_map"
    assert tools.similar_entities("story_cue").first().entity_id == "pace_map" and tools.corpus_relations("pace_map").count() == 2
    relation = store.read("relations").first().relation_id
    assert tools.inspect_evidence(relation).count() == 2 and tools.community_context("story_cue").first().member_count == 2
    for bad in ({"question": " "}, {"question": "x", "limit": 51}, {"question": "x", "domain": "none"}, {"question": "x", "domain": " "}):
        with pytest.raises(ValueError):
            tools.search_corpus(terms=terms, **bad)
    cases = spark.createDataFrame([("story cue", ["Play Books/one.md"], None), ("pace map", ["nowhere.md"], None)], "question string, expected array<string>, domain string")
    means = tools.evaluate(cases, terms)[1].first()
    assert means.cases == 2 and means.mean_recall == 0.5 and means.mean_reciprocal_rank > 0
    tools.remembered = {"a": "1"}
    store.put("ingest_config", {"a": "2"}, DAY(1))
    assert tools.drift() == ["a has changed since the last ingest: 2 then, 1 now"] and store.has_state()


def test_a_graph_beyond_the_bound(spark, tmp_path, monkeypatch, terms):
    monkeypatch.setattr(P.G, "BROADCAST_ROWS", 2)
    store = Store(spark, str(tmp_path / "store"))
    rows = [(f"r{i}", "k", "d", "p", a, "uses", b, 0.9, "m", "2031") for i, (a, b) in enumerate(["ab", "bc", "ac", "xy", "yz", "xz"])]
    store.replace("extracted_relations", spark.createDataFrame(rows, E.RELATIONS))
    P.build_graph(store, terms, ["consolidate", "centrality", "communities", "profiles", "reports"])
    assert {r.entity_id: r.community_id for r in store.read("entity_communities").collect()} == dict.fromkeys("abc", 0) | dict.fromkeys("xyz", 1)
    assert store.read("centrality").filter("pagerank > 0 and betweenness is null").count() == 6
    assert {r.community_id: (r.member_count, r.inner_edges) for r in store.read("community_reports").collect()} == {0: (3, 3), 1: (3, 3)}


def test_requests_by_file(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", "d", "p.md", f"Text {i} of the story cue.", ["pace_map", "story_cue"]) for i in range(3)], "chunk_id string, document_id string, source_rel_path string, text string, entity_ids array<string>")
    E.write_requests(E.request_lines(chunks, "task", E.prompt(), "m"), chunks, str(tmp_path / "b"))
    sent = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "b" / "requests")).collect()), key=lambda x: x["custom_id"])
    assert [x["custom_id"] for x in sent] == ["c0", "c1", "c2"] and sent[0]["body"]["messages"][1]["content"].endswith("Entities:\n- pace_map\n- story_cue")
    claim = lambda text: {"response": {"body": {"choices": [{"message": {"content": json.dumps({"claims": [{"claim_text": text, "subject": "story_cue"}]})}}]}}}
    lines = [json.dumps({"custom_id": "c0"} | claim("It is.")), json.dumps({"custom_id": "unknown"} | claim("x")), json.dumps({"custom_id": "c1", "response": {"body": {"choices": []}}}), "{broken", ""]
    (tmp_path / "answers.jsonl").write_text("\n".join(lines))
    raw = E.read_answers(spark, str(tmp_path / "answers.jsonl"))
    got = E.claim_records(raw, chunks, "m", DAY(1)).collect()
    assert [(r.chunk_id, r.claim_text, r.subject_entity_id) for r in got] == [("c0", "It is.", "story_cue")]
    assert tuple(E.batch_counts(spark.read.text(str(tmp_path / "answers.jsonl"))).first()) == (4, 2, 2)
    with pytest.raises(RuntimeError):
        E.write_requests(chunks.limit(0), chunks.limit(0), str(tmp_path / "none"))
    assert E.task_with_vocabulary("t", ["zeta", "alpha"], ["q", "b"]) == "t\n\nKnown entities (2):\n- alpha\n- zeta\n\nKnown predicates (2): b, q"


def test_calls_that_fail_are_tried_again_or_left_out(spark):
    calls, slept = [], []

    def shaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return [[1.0]] * len(texts)

    assert providers.with_retries(shaky, 3, (1, 5), slept.append)(["a"]) == [[1.0]] and slept == [1, 5]
    with pytest.raises(providers.TooLong):
        providers.with_retries(providers.hashing_embedder(8, most=1), 9, (), slept.append)(["a b"])
    rows = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", None)], "k string, u string")

    def backend(system, user):
        if user == "bad":
            raise OSError("down")
        return user.upper()

    assert [tuple(r) for r in providers.ask(rows, "k", "s", "u", [lambda s, u: "", backend]).collect()] == [("a", "GOOD")]
    done = []
    assert providers.in_portions(spark.range(10).select(F.col("id").cast("string").alias("k")), "k", 4, lambda part: part, lambda part: done.append(part.count())) == 3 and sum(done) == 10
    providers.reset_clients()
    seen = []
    assert providers.probe("x", lambda: seen.append(1)) == providers.probe("x", lambda: seen.append(1)) == (True, None) and len(seen) == 1
    assert providers.probe_embedder(providers.hashing_embedder(4), 5)[0] is False and providers.embed_question(lambda t: t, "b", "a ") == "a b"
    assert providers.per_worker("y", list) is providers.per_worker("y", list)


def test_eval_cases(spark, tmp_path):
    (tmp_path / "e.json").write_text('[{"question":"q","expected_source_files":["a.md","z.md"],"domain":null}]')
    paths = spark.createDataFrame([("x/a.md",), ("y/b.md",), ("z/b.md",)], "source_rel_path string")
    assert files.resolve_expected(files.eval_cases(spark, str(tmp_path / "e.json")), paths).first().expected == ["x/a.md", "z.md"]
    (tmp_path / "b.json").write_text('[{"question":"q","expected_source_files":["b.md"],"domain":null}]')
    with pytest.raises(Exception, match="ambiguous"):
        files.resolve_expected(files.eval_cases(spark, str(tmp_path / "b.json")), paths).collect()


TREE = {
    "root.yaml": "_meta:\n  id: root\n  title: The root\n  relationships:\n  - {type: depends_on, target: sub/e.yaml, why: x}\n  - {type: odd, target: nowhere.yaml}\n  - {type: depends_on, target: side}\n  - 7\nfile_relationships: {depends_on: {}}\nentity_relations: {near: {}, far: {}}\nentity_relation_weights: {strong: {}}\n",
    "sub/part.yml": "[cue, hint]\n",
    "sub/side.yaml": "_meta: {id: side}\nkinds: {one: {}}\n",
    "sub/e.yaml": "_meta: {id: play_entities}\nentity_types:\n  story_cue:\n    label: Story cue\n    aliases: !include part.yml\n    parent_entity: Map of pace\n    relates_to: [pace_map, {relation: near, target: missing, weight: weak}, {relation: close, target: STORY CUE}, {target: 3}, 9]\n    taxonomy_mapping: [{taxonomy: side, dimension: size, values: [one, two, 3]}, {taxonomy: side}]\n    maps_to_taxonomy_types: [kind]\n    taxonomy_reference: kinds\n    validate_against_taxonomy: true\n  pace_map: {entity_kind: method, gliner_label: Map of pace, indicators: [pace maps], parent_entity: 4, taxonomy_reference: unknown, validate_against_taxonomy: maybe, maps_to_taxonomy_types: no list}\n",
}


def test_ontology_tree(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in TREE.items():
        (tmp_path / name).write_text(text)
    found = ontology.load(tmp_path, ignore=("part.yml",))
    assert [(t, s) for _, s, t in found.terms()] == [("cue", "alias"), ("hint", "alias"), ("pace maps", "indicator"), ("pace_map", "canonical_id"), ("story_cue", "canonical_id")]
    issues = sorted(k for k, *_ in found.issues)
    assert issues == sorted("invalid_file_relationship unknown_file_relation_type unknown_entity_relation_type unknown_entity_relation_type unknown_entity_relation_weight unresolved_entity_relation_target invalid_entity_relation invalid_entity_relation invalid_taxonomy_mapping invalid_parent_entity invalid_maps_to_taxonomy_types invalid_validate_against_taxonomy".split())
    edges = {(e["src"], e["relation"], e["dst"]) for e in found.edges.values()}
    assert edges >= {("file:root.yaml", "depends_on", "file:sub/e.yaml"), ("file:root.yaml", "depends_on", "file:sub/side.yaml"), ("file:root.yaml", "odd", "external_file:nowhere.yaml")}
    assert {e[1:] for e in edges if e[0] == "story_cue"} == {("parent_entity", "pace_map"), ("relates_to", "pace_map"), ("near", "unresolved_entity:missing"), ("close", "story_cue"), ("maps_to_taxonomy_value", "taxonomy_value:side:size:one"), ("maps_to_taxonomy_value", "taxonomy_value:side:size:two"), ("maps_to_taxonomy_type", "taxonomy_type:side:kind"), ("references_taxonomy", "file:sub/side.yaml"), ("validated_against_taxonomy", "file:sub/side.yaml")}
    assert ("pace_map", "references_taxonomy", "taxonomy_reference:unknown") in edges and found.predicates() == ["close", "near", "parent_entity", "relates_to"]
    tables = found.tables(spark)
    nodes = {r.id: (r.node_type, r.label) for r in tables["nodes"].collect()}
    assert nodes["file:root.yaml"] == ("ontology_file", "The root") and nodes["story_cue"] == ("entity", "Story cue") and nodes["taxonomy_value:side:size:one"] == ("taxonomy_value", "one") and nodes["external_file:nowhere.yaml"] == ("external_file", "nowhere.yaml")
    classes = {r["path"]: r["class"] for r in tables["coverage"].collect()}
    assert (classes["_meta.relationships.*.type"], classes["entity_types.story_cue.aliases.*"], classes["entity_types.story_cue.label"]) == ("graph_input", "matcher_input", "metadata_input")
    assert tables["edges"].count() == len(found.edges) and tables["metadata"].filter("record_kind = 'entity'").count() == 2 and len(found.snapshot_hash) == 64
    assert ontology.load(tmp_path, ignore=("part.yml",)).snapshot_hash == found.snapshot_hash
    (tmp_path / "sub" / "bad.yaml").write_text("entity_types: {x: {aliases: one}}\n")
    with pytest.raises(ValueError):
        ontology.load(tmp_path).terms()


def test_settings_are_checked(tmp_path):
    base = "paths: {corpus_path: kb, ontology_path: yamls, data_path: /data}\n"
    (tmp_path / "config.yaml").write_text(base + "retrieval: {lexical_fusion_weight: 3}\nembedding: {query_instruction: ' '}\n")
    (tmp_path / ".folioscope").write_text("")
    s, file = settings.load(tmp_path)
    assert (s.paths.corpus_path, s.paths.data_path, s.retrieval.lexical_fusion_weight, s.embedding.query_instruction) == (str(tmp_path / "kb"), "/data", 3.0, None)
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert settings.find_root(tmp_path / "a" / "b") == tmp_path == file.parent
    for text, problem in (("x: 1", "unknown key: x"), ("chunking: {chunk_size: 9, chunk_overlap: 9}", "chunk_overlap"), ("models: {embed_backend: hosted}", "hosted"), ("models: {embed_backend: hosted, embed_dims: 5}\nhosted: {dims: 6}", "hosted.dims"), ("models: {embed_dims: many}", "models.embed_dims must be int"), ("reranker: {auto_start: true}", "url"), ("reranker: {auto_start: true, url: 'http://other:1'}", "must be those")):
        (tmp_path / "config.bad.yaml").write_text(base + text)
        with pytest.raises(ValueError, match=problem):
            settings.load(tmp_path, profile="bad")
    for wrong in ({"profile": "a", "path": "b"}, {"profile": "none"}):
        with pytest.raises((ValueError, FileNotFoundError)):
            settings.load(tmp_path, **wrong)
    assert settings.Reranker("http://h:1/", " v1/x").address() == "http://h:1/v1/x" and settings.Reranker().address() is None
    kept = settings.remembered(s)
    assert settings.drift(kept, {}) == [] and settings.drift(kept, kept) == [] and settings.drift(kept, {k: v for k, v in kept.items() if k != "models.embed"}) == ["models.embed was not kept by the last ingest"]


def test_commands_and_server(spark, corpus, tmp_path):
    (tmp_path / "yamls" / "sub").mkdir(parents=True)
    for name, text in TREE.items():
        (tmp_path / "yamls" / name).write_text(text.replace("story_cue:", "story cue:", 1).replace("  pace_map: {", "  pace map: {"))
    (tmp_path / "config.yaml").write_text("paths: {corpus_path: kb, ontology_path: yamls, data_path: data}\nontology: {ignore_names: [part.yml]}\n")
    app = App(str(tmp_path), spark=spark)
    assert app.tools().corpus_status()["ontology_entity_count"] == 2 and app.ingest()["chunks_written"] == 3
    status = app.tools().corpus_status()
    assert (status["searchable"], status["asset_only"], status["ontology_validation_issue_count"], len(status["ontology_issue_samples"])) == (3, 1, len(app.ontology.issues), 10)
    assert app.build_graph(dry_run=True)["calls"] == 3
    (tmp_path / "e.json").write_text('[{"question":"What is a story cue?","expected_source_files":["one.md"],"domain":null}]')
    assert app.prepare_batch()["count"] == 3
    line = {"custom_id": app.store.read("mention_rows").first().chunk_id, "response": {"body": {"choices": [{"message": {"content": '{"claims":[{"claim_text":"So it is."}]}'}}]}}}
    (tmp_path / "answers.jsonl").write_text(json.dumps(line))
    assert app.batch_status(str(tmp_path / "answers.jsonl")) == {"total": 1, "completed": 1, "failed": 0} and app.collect_batch(str(tmp_path / "answers.jsonl")) == {"claims": 1}
    assert app.build_graph()["claims"] > 1 and app.tools().graph_status()["last_build"]["status"] == "complete"
    assert app.evaluate(str(tmp_path / "e.json"))["mean_recall"] == 1.0
    asked = [{"id": 1, "tool": "tools"}, {"id": 2, "tool": "search_corpus", "arguments": {"terms": "story cue", "limit": 2}}, {"id": 3, "tool": "get_related_concepts", "arguments": {"entity_id": "story cue"}}, {"id": 4, "tool": "none"}, {"id": 5, "tool": "search_entities", "arguments": {"query": " "}}]
    out = io.StringIO()
    serve(app, io.StringIO("\n".join(map(json.dumps, asked)) + "\nnot json\n"), out)
    got = [json.loads(line) for line in out.getvalue().splitlines()]
    assert len(got[0]["result"]) == 20 and len(got[1]["result"]) == 2 and got[3]["error"] == "unknown tool: none" and "query is empty" in got[4]["error"] and "error" in got[5]
    assert {r["id"] for r in got[2]["result"]} >= {"taxonomy_type:side:kind", "pace map"}


def test_rerank_and_embedder():
    rows = [("p", "x"), ("q", "y"), ("r", "z")]
    assert providers.rerank("q", rows, lambda q, t: [0.2, 0.3, 0.25]) == (["q", "r", "p"], True, [])
    assert providers.rerank("q", rows, None)[:2] == (["p", "q", "r"], False)
    payload = {"results": [{"index": 2, "relevance_score": 1}, {"index": 9, "relevance_score": 5}, {"index": "1", "relevance_score": 1}, 4, {"index": 0, "relevance_score": 2.5}]}
    assert providers.rerank("q", rows, lambda q, t: payload) == (["p", "r"], True, [])
    assert providers.rerank("q", rows, lambda q, t: {"results": []})[1] is False and providers.rerank("q", rows, lambda q, t: 1 / 0)[2] == ["reranking failed: division by zero"]
    assert providers.hashing_embedder(8)(["", "same"])[1] == providers.hashing_embedder(8)(["same"])[0]


def test_watching_adds_to_a_batch_store(spark, corpus, tmp_path, terms):
    store = Store(spark, str(tmp_path / "store"))
    P.ingest(spark, store, str(corpus), terms, DAY(1), "r1")
    state = lambda: {t: sorted(map(str, store.read(t).drop("last_seen_at", "last_processed_at", "last_committed_at", "chunk_id", "document_id", "vector").collect())) for t in ("chunk_rows", "corpus_manifest")}
    before = state()
    for day in (2, 3):
        watch(spark, str(corpus), store, str(tmp_path / "check"), terms, lambda n, day=day: DAY(day)).awaitTermination()
        assert state() == before
    (corpus / "Play Books" / "new + one.md").write_text("The story cue is new here. " * 9)
    (corpus / "Play Books" / "new.docling.json").write_text('{"name":"y","texts":[{"text":"A pace map of its own","label":"text","prov":[{"page_no":2}]}]}')
    watch(spark, str(corpus), store, str(tmp_path / "check"), terms, lambda n: DAY(4)).awaitTermination()
    rows = {r.source_rel_path: r for r in store.read("chunk_rows").collect()}
    assert len(rows) == 5 and len(rows["Play Books/new + one.md"].vector) == 96 and rows["Play Books/new.docling.json"].citation_label == "Play Books/new.docling.json#page=2"
    assert store.read("mention_rows").filter(F.col("chunk_id") == rows["Play Books/new + one.md"].chunk_id).count() == 9
    again = P.ingest(spark, store, str(corpus), terms, DAY(5), "r5")
    assert (again["unchanged"], again["new"], again["chunks_written"]) == (7, 0, 0)
