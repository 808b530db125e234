"""Reading an ontology of YAML files on the driver (hundreds of small files) into node, edge, term, metadata and issue tables."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from pathlib import Path, PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from folioscope.operators.matching import normalise

# Key paths that feed the graph and the matcher; all others are metadata.
GRAPH_PATHS = [
    r"_meta\.relationships", r"file_relationships", r"entity_relations", r"entity_relation_weights",
    r"entity_types\.[^.]+\.(?:parent_entity|relates_to|taxonomy_mapping|maps_to_taxonomy_types|taxonomy_reference|validate_against_taxonomy)",
]
MATCHER_PATHS = [r"entity_types\.[^.]+\.(?:canonical_id|aliases|indicators)"]


def path_class(path: str) -> str:
    for name, patterns in (("graph_input", GRAPH_PATHS), ("matcher_input", MATCHER_PATHS)):
        if any(re.match(rf"{p}(?:\.|$)", path) for p in patterns):
            return name
    return "metadata_input"


def load_yaml(path: Path) -> Any:
    """One file; `!include other.yaml` takes the place of the value, relative to the file it stands in, to any depth."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def include(loader: Any, node: Any) -> Any:
        if not isinstance(node, yaml.ScalarNode):
            raise TypeError("!include takes one path")
        return load_yaml(path.parent / loader.construct_scalar(node))

    Loader.add_constructor("!include", include)
    return yaml.load(path.read_text(encoding="utf-8"), Loader)  # noqa: S506 (a SafeLoader)


def tagged(value: Any) -> Any:
    """A nested value with the types of its keys written out, so that 1 and "1" hash differently."""
    if isinstance(value, dict):
        return {f"{type(k).__name__}:{k}": tagged(v) for k, v in sorted(value.items(), key=lambda x: (type(x[0]).__name__, str(x[0])))}
    if isinstance(value, (list, tuple)):
        return [tagged(v) for v in value]
    return value if isinstance(value, (str, int, float, bool)) or value is None else str(value)


def key_paths(value: Any, at: str = "") -> Counter:
    """How often each path of keys occurs; a step into a list is `*`."""
    found: Counter = Counter()
    if isinstance(value, dict):
        steps = [(f"{at}.{k}" if at else str(k), v) for k, v in value.items()]
    else:
        steps = [(f"{at}.*" if at else "*", v) for v in value] if isinstance(value, list) else []
    for step, child in steps:
        found[step] += 1
        found += key_paths(child, step)
    return found


def digest(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


@dataclass
class Ontology:
    """What a tree of files says. Edges by their key, of equal keys the last; nodes by their id, in order of first mention."""

    sources: list[tuple[str, str]] = field(default_factory=list)
    entities: list[dict[str, Any]] = field(default_factory=list)
    nodes: dict[str, dict[str, Any]] = field(default_factory=dict)
    edges: dict[str, dict[str, Any]] = field(default_factory=dict)
    issues: list[tuple[str, str, str, str]] = field(default_factory=list)
    paths: Counter = field(default_factory=Counter)
    metadata: list[tuple[str, str, str | None, str]] = field(default_factory=list)
    snapshot_hash: str = ""

    def terms(self) -> list[tuple[str, str, str]]:
        """(entity, source, normalised term): ids, aliases and indicators; no empty term, each once, in order of the term."""
        found = {(t, e["canonical_id"], s) for e in self.entities for s, values in (("canonical_id", [e["canonical_id"]]), ("alias", strings(e, "aliases")), ("indicator", strings(e, "indicators"))) for v in values if (t := normalise(v))}
        return [(e, s, t) for t, e, s in sorted(found)]

    def predicates(self) -> list[str]:
        return sorted({e["relation"] for e in self.edges.values() if e["origin"] == "entity"})

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        make = spark.createDataFrame
        text = lambda v: v if isinstance(v, str) else None
        return {
            "sources": make(self.sources, "path string, hash string"),
            "entities": make([(e["canonical_id"], text(e.get("label")), text(e.get("entity_kind")) or text(e.get("entity_type")) or "", text(e.get("domain")) or "", strings(e, "aliases"), strings(e, "indicators"), e["file"]) for e in self.entities], "entity_id string, label string, kind string, domain string, aliases array<string>, indicators array<string>, file string"),
            "terms": make(self.terms(), "entity_id string, term_source string, normalized_term string"),
            "nodes": make([(k, n["type"], n["label"], n["file"], n["entity"], json.dumps(n["metadata"], sort_keys=True, default=str)) for k, n in self.nodes.items()], "id string, node_type string, label string, file string, entity_id string, metadata_json string"),
            "edges": make([(k, e["src"], e["relation"], e["dst"], e["origin"], e["path"], e["file"], json.dumps(e["metadata"], sort_keys=True, default=str)) for k, e in self.edges.items()], "edge_key string, src string, relation string, dst string, origin string, origin_path string, file string, metadata_json string"),
            "issues": make(self.issues, "kind string, file string, path string, message string"),
            "coverage": make([(p, path_class(p), n) for p, n in sorted(self.paths.items())], "path string, class string, n long"),
            "metadata": make(self.metadata, "record_kind string, file string, entity_id string, payload_json string"),
        }


def strings(entity: dict[str, Any], name: str) -> list[str]:
    """A list of texts of an entity; no list is an error, other values in it are left out."""
    value = entity.get(name)
    if value is None:
        return []
    if not isinstance(value, list):
        raise ValueError(f"{name} must be a list")
    return [v for v in value if isinstance(v, str) and v.strip()]


def required(entity: dict[str, Any], name: str) -> str:
    value = entity.get(name)
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"an entity lacks {name}")
    return value


class Loader:
    """Reads the files in order and collects nodes, edges and what is wrong."""

    def __init__(self, files: dict[str, Any]) -> None:
        self.files, self.out = files, Ontology()
        mappings = {rel: data for rel, data in files.items() if isinstance(data, dict)}
        self.meta = {rel: d["_meta"] if isinstance(d.get("_meta"), dict) else {} for rel, d in mappings.items()}
        self.by_meta_id = {m["id"]: rel for rel, m in self.meta.items() if isinstance(m.get("id"), str) and m["id"].strip()}
        self.mappings = mappings
        self.owners: dict[str, list[str]] = defaultdict(list)
        for rel, d in mappings.items():
            for key in d:
                if isinstance(key, str):
                    self.owners[key].append(rel)
        declared = lambda name: {k for d in mappings.values() if isinstance(d.get(name), dict) for k, v in d[name].items() if isinstance(k, str) and (isinstance(v, dict) or name.endswith("weights"))}
        self.file_kinds, self.entity_kinds, self.weights = declared("file_relationships"), declared("entity_relations"), declared("entity_relation_weights")
        self.named: list[tuple[str, str, dict]] = []  # file, key, payload
        for rel, d in mappings.items():
            if isinstance(d.get("entity_types"), dict):
                for key, payload in d["entity_types"].items():
                    if isinstance(payload, dict):
                        self.named.append((rel, key, payload))
                        self.out.entities.append({"canonical_id": key, **payload, "file": rel, "meta_id": self.meta[rel].get("id")})
        self.ids = {required(e, "canonical_id") for e in self.out.entities}
        self.names: dict[str, str] = {}
        folded: dict[str, set[str]] = defaultdict(set)
        for e in self.out.entities:
            for name in (e["canonical_id"], e.get("gliner_label"), e.get("label")):
                if isinstance(name, str) and name.strip():
                    self.names.setdefault(name, e["canonical_id"])
                    folded[name.casefold()].add(e["canonical_id"])
        for name, found in folded.items():
            if len(found) == 1:
                self.names.setdefault(name, next(iter(found)))

    def issue(self, kind: str, file: str, path: str, message: str) -> None:
        self.out.issues.append((kind, file, path, message))

    def edge(self, file: str, src: str, relation: str, dst: str, origin: str, path: str, metadata: dict, kind: str, target_file: str | None = None, entity: str | None = None, label: str | None = None) -> None:
        """An edge, and its target as a node if it is not one yet."""
        self.out.edges[digest(origin, file, src, relation, dst)] = {"src": src, "relation": relation, "dst": dst, "origin": origin, "path": path, "file": file, "metadata": metadata}
        self.implied.append((dst, {"type": kind, "label": label or dst, "file": target_file, "entity": entity, "metadata": metadata}))

    def target_file(self, file: str, target: str) -> str | None:
        near = str(PurePosixPath(PurePosixPath(file).parent / target))
        return self.by_meta_id.get(target) or next((f for f in (str(PurePosixPath(target)), near) if f in self.files), None)

    def file_links(self, file: str) -> None:
        links = self.meta[file].get("relationships")
        for i, link in enumerate(links if isinstance(links, list) else []):
            path = "_meta.relationships.*"
            if not isinstance(link, dict) or not isinstance(link.get("target"), str) or not isinstance(link.get("type"), str):
                self.issue("invalid_file_relationship", file, f"{path}[{i}]", "A file relation needs a target and a type.")
                continue
            kind, to = link["type"], link["target"]
            if self.file_kinds and kind not in self.file_kinds:
                self.issue("unknown_file_relation_type", file, f"{path}[{i}].type", f"Undeclared type of file relation: {kind}.")
            found = self.target_file(file, to)
            rest = {k: v for k, v in link.items() if k not in ("target", "type")}
            self.edge(file, f"file:{file}", kind, f"file:{found}" if found else f"external_file:{to}", "file_meta", path, rest, "ontology_file" if found else "external_file", found, label=to)

    def entity_link(self, file: str, src: str, relation: str, path: str, name: str, hint: str | None, metadata: dict) -> None:
        found = name if name in self.ids else self.names.get(name) or self.names.get(name.casefold())
        if found is None:
            self.issue("unresolved_entity_relation_target", file, path, f"No entity is called {name}.")
        self.edge(file, src, relation, found or f"unresolved_entity:{name}", "entity", path, metadata, "entity" if found else "unresolved_entity", hint, found, name)

    def entity_links(self, file: str, src: str, payload: dict) -> None:
        at = f"entity_types.{src}"
        parent = payload.get("parent_entity")
        if isinstance(parent, str):
            self.entity_link(file, src, "parent_entity", f"{at}.parent_entity", parent, None, {})
        elif parent is not None:
            self.issue("invalid_parent_entity", file, f"{at}.parent_entity", "A parent is the name of an entity.")
        links = payload.get("relates_to")
        if links is not None and not isinstance(links, list):
            self.issue("invalid_relates_to", file, f"{at}.relates_to", "relates_to is a list.")
        for link in links if isinstance(links, list) else []:
            path = f"{at}.relates_to.*"
            link = {"target": link} if isinstance(link, str) else link
            relation = link.get("relation", "relates_to") if isinstance(link, dict) else None
            if not isinstance(link, dict) or not isinstance(link.get("target"), str) or not isinstance(relation, str):
                self.issue("invalid_entity_relation", file, path, "A relation is a name, or has a target and a relation.")
                continue
            rest = {k: v for k, v in link.items() if k not in ("target", "relation", "target_file")}
            if self.entity_kinds and relation not in self.entity_kinds:
                self.issue("unknown_entity_relation_type", file, f"{path}.relation", f"Undeclared type of relation: {relation}.")
            if self.weights and isinstance(rest.get("weight"), str) and rest["weight"] not in self.weights:
                self.issue("unknown_entity_relation_weight", file, f"{path}.weight", f"Undeclared weight: {rest['weight']}.")
            hint = link.get("target_file")
            self.entity_link(file, src, relation, path, link["target"], hint if isinstance(hint, str) else None, rest)

    def taxonomy_links(self, file: str, src: str, payload: dict) -> None:
        at = f"entity_types.{src}"
        mapping = payload.get("taxonomy_mapping")
        if mapping is not None and not isinstance(mapping, list):
            self.issue("invalid_taxonomy_mapping", file, f"{at}.taxonomy_mapping", "taxonomy_mapping is a list.")
        for item in mapping if isinstance(mapping, list) else []:
            path = f"{at}.taxonomy_mapping.*"
            if not isinstance(item, dict) or not isinstance(item.get("taxonomy"), str) or not isinstance(item.get("dimension"), str) or not isinstance(item.get("values"), list):
                self.issue("invalid_taxonomy_mapping", file, path, "A mapping has a taxonomy, a dimension and a list of values.")
                continue
            rest = {k: v for k, v in item.items() if k not in ("taxonomy", "dimension", "values")}
            for value in [v for v in item["values"] if isinstance(v, str)]:
                known = {"taxonomy": item["taxonomy"], "dimension": item["dimension"], "value": value, **rest}
                self.edge(file, src, "maps_to_taxonomy_value", f"taxonomy_value:{item['taxonomy']}:{item['dimension']}:{value}", "taxonomy_mapping", path, known, "taxonomy_value", self.by_meta_id.get(item["taxonomy"]), label=value)
        kinds = payload.get("maps_to_taxonomy_types")
        if kinds is not None and not isinstance(kinds, list):
            self.issue("invalid_maps_to_taxonomy_types", file, f"{at}.maps_to_taxonomy_types", "maps_to_taxonomy_types is a list.")
        taxonomy = self.taxonomy_of(payload)
        for value in [v for v in kinds if isinstance(v, str)] if isinstance(kinds, list) else []:
            self.edge(file, src, "maps_to_taxonomy_type", f"taxonomy_type:{taxonomy or 'unknown_taxonomy'}:{value}", "taxonomy_type_mapping", f"{at}.maps_to_taxonomy_types.*", {"taxonomy": taxonomy, "value": value}, "taxonomy_type", label=value)
        name = payload.get("taxonomy_reference")
        if name is None:
            return
        if not isinstance(name, str):
            self.issue("invalid_taxonomy_reference", file, f"{at}.taxonomy_reference", "taxonomy_reference is a text.")
            return
        found = self.by_meta_id.get(name) or (self.owners[name][0] if len(self.owners.get(name, [])) == 1 else None)
        to, kind = (f"file:{found}", "ontology_file") if found else (f"taxonomy_reference:{name}", "taxonomy_reference")
        self.edge(file, src, "references_taxonomy", to, "taxonomy_reference", f"{at}.taxonomy_reference", {"taxonomy_reference": name}, kind, found, label=name)
        check = payload.get("validate_against_taxonomy")
        if check is True:
            self.edge(file, src, "validated_against_taxonomy", to, "taxonomy_reference", f"{at}.validate_against_taxonomy", {"taxonomy_reference": name}, kind, found, label=name)
        elif check not in (None, False):
            self.issue("invalid_validate_against_taxonomy", file, f"{at}.validate_against_taxonomy", "validate_against_taxonomy is true or false.")

    @staticmethod
    def taxonomy_of(payload: dict) -> str | None:
        """The taxonomy of the first mapping that names one; else the one that goes with a `..._entities` source id."""
        for item in payload["taxonomy_mapping"] if isinstance(payload.get("taxonomy_mapping"), list) else []:
            if isinstance(item, dict) and isinstance(item.get("taxonomy"), str) and item["taxonomy"].strip():
                return item["taxonomy"]
        source = payload.get("source_meta_id")
        return source.removesuffix("_entities") + "_taxonomy" if isinstance(source, str) and source.endswith("_entities") else None

    def load(self) -> Ontology:
        out = self.out
        self.implied: list[tuple[str, dict]] = []
        lines = []
        for file, data in self.files.items():
            text = json.dumps(tagged(data), sort_keys=True, ensure_ascii=False)
            out.sources.append((file, hashlib.sha256(text.encode()).hexdigest()))
            lines.append((file, text))
            out.paths += key_paths(data)
            meta = self.meta.get(file, {})
            label = next((v for v in (meta.get("title"), meta.get("id")) if isinstance(v, str)), file)
            known = {"file_rel_path": file} | ({k: meta.get(k) for k in ("id", "purpose", "domain", "domain_type")} if meta else {})
            out.nodes[f"file:{file}"] = {"type": "ontology_file", "label": label, "file": file, "entity": None, "metadata": known}
            if isinstance(data, dict):
                out.metadata.append(("file", file, None, json.dumps(data, sort_keys=True, default=str)))
        out.snapshot_hash = hashlib.sha256("\n".join(f"{f} {t}" for f, t in sorted(lines)).encode()).hexdigest()
        for e in out.entities:
            name = e["canonical_id"]
            known = {k: e.get(k) for k in ("entity_kind", "family")} | {"source_meta_id": e["meta_id"]}
            out.nodes[name] = {"type": "entity", "label": e["label"] if isinstance(e.get("label"), str) else name, "file": e["file"], "entity": name, "metadata": known}
            out.metadata.append(("entity", e["file"], name, json.dumps({k: v for k, v in e.items() if k not in ("file", "meta_id")}, sort_keys=True, default=str)))
        for file in self.mappings:
            self.file_links(file)
            for rel, key, payload in self.named:
                if rel == file and key in self.ids:
                    self.entity_links(file, key, payload)
                    self.taxonomy_links(file, key, payload)
        for name, node in self.implied:
            out.nodes.setdefault(name, node)
        return out


def load(root: str | Path, patterns: tuple[str, ...] = ("**/*.yaml", "**/*.yml"), ignore: tuple[str, ...] = ()) -> Ontology:
    """Everything the YAML tree under root says, with what is wrong in it listed as issues instead of raised. Files are read in
    the order of the patterns and their names, each once."""
    root, files = Path(root), {}
    for pattern in patterns:
        for path in sorted(root.glob(pattern)):
            rel = path.relative_to(root).as_posix()
            if path.is_file() and path.name not in ignore and rel not in files:
                files[rel] = load_yaml(path)
    return Loader(files).load()
