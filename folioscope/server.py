"""The tools over standard input and output: a line of JSON in, a line of JSON out, until the input ends.

A request is {"id": ..., "tool": name, "arguments": {...}}; the answer has the same id and a result, or an error. The tool `tools`
lists the names. Settings, session and ontology are loaded once, before the first request."""

from __future__ import annotations

import dataclasses
import json
from typing import IO, Any

from pyspark.sql import DataFrame, Row

MOST_ROWS = 1000


def plain(value: Any) -> Any:
    """A result as JSON can hold it; of a table the first MOST_ROWS rows, as the tools give short lists."""
    if isinstance(value, DataFrame):
        return [plain(r) for r in value.limit(MOST_ROWS).collect()]
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if dataclasses.is_dataclass(value):
        return {f.name: plain(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def tools_of(app: Any) -> dict[str, Any]:
    t, terms = app.tools(), app.terms
    return {
        "corpus_status": t.corpus_status, "get_entity_types": t.entity_types, "get_related_concepts": lambda entity_id: t.related_concepts(entity_id),
        "search_corpus": lambda terms_, domain=None, limit=10: t.search_corpus(terms_, terms, domain, limit)[0], "find_documents_for_concept": lambda entity_id, hops=1, limit=10: t.find_documents_for_concept(entity_id, hops, limit),
        "get_corpus_relations": lambda entity_id, limit=50: t.corpus_relations(entity_id, limit), "get_entity_summary": lambda entity_id: t.entity_summary(entity_id), "get_community_context": lambda entity_id: t.community_context(entity_id),
        "get_similar_entities": lambda entity_id, limit=10: t.similar_entities(entity_id, limit), "search_entities": lambda query, limit=20: t.search_entities(query, limit), "inspect_evidence": lambda relation_id: t.inspect_evidence(relation_id),
        "find_path_between_entities": lambda source, target, max_hops=5: t.find_path(source, target, max_hops), "find_weighted_path": lambda source, target: t.find_weighted_path(source, target),
        "get_hub_entities": lambda limit=20: t.top_entities("pagerank", limit), "find_bridge_entities": lambda limit=20: t.top_entities("betweenness", limit), "find_foundational_entities": lambda limit=20: t.top_entities("closeness", limit),
        "get_entity_graph_stats": t.graph_overview, "get_graph_overview": t.graph_overview, "search_knowledge": lambda question, domain=None: t.search_knowledge(question, terms, domain), "search_knowledge_deep": lambda question, domain=None: t.search_knowledge_deep(question, terms, domain),
    }


def serve(app: Any, lines: IO[str], out: IO[str]) -> None:
    known = tools_of(app)
    for line in lines:
        if not line.strip():
            continue
        answer: dict[str, Any] = {"id": None}
        try:
            asked = json.loads(line)
            answer["id"] = asked.get("id")
            arguments = {("terms_" if k == "terms" else k): v for k, v in (asked.get("arguments") or {}).items()}
            if asked["tool"] == "tools":
                answer["result"] = sorted(known)
            elif asked["tool"] not in known:
                answer["error"] = f"unknown tool: {asked['tool']}"
            else:
                answer["result"] = plain(known[asked["tool"]](**arguments))
        except Exception as problem:  # noqa: BLE001 (a request that fails must not end the server)
            answer["error"] = f"{type(problem).__name__}: {problem}"
        print(json.dumps(answer, default=str), file=out, flush=True)
