"""Settings: one YAML file, checked key by key, with paths relative to it; and what of them a store remembers."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any, get_type_hints

NAME = "config"


@dataclass
class Paths:
    corpus_path: str
    ontology_path: str
    data_path: str


@dataclass
class Models:
    embed: str = "hashing"
    embed_dims: int = 96
    embed_backend: str = "offline"
    llm: str = "offline"
    rerank: str = "none"


@dataclass
class Chunking:
    strategy: str = "hybrid"
    chunk_size: int = 256
    chunk_overlap: int = 50
    min_tokens: int = 20
    tokenizer_backend: str = "words"
    tokenizer_name: str = ""

    def check(self) -> None:
        if self.chunk_size <= 0 or not 0 <= self.chunk_overlap < self.chunk_size or self.min_tokens < 0:
            raise ValueError("chunk_size must be positive, chunk_overlap in 0..chunk_size-1 and min_tokens not negative")
        if self.strategy not in ("hybrid", "hierarchical", "windows"):
            raise ValueError(f"unknown chunking strategy: {self.strategy}")


@dataclass
class Embedding:
    timeout_secs: int = 60
    retry_attempts: int = 3
    retry_backoff: list[int] = field(default_factory=lambda: [1, 2, 4])
    query_instruction: str | None = None

    def check(self) -> None:
        if self.retry_attempts < 1 or self.timeout_secs < 1:
            raise ValueError("retry_attempts and timeout_secs must be positive")
        if self.query_instruction is not None and not self.query_instruction.strip():
            self.query_instruction = None


@dataclass
class Hosted:
    model: str = ""
    dims: int = 1536
    batch_size: int = 512


@dataclass
class OntologyFiles:
    include_globs: list[str] = field(default_factory=lambda: ["**/*.yaml", "**/*.yml"])
    ignore_names: list[str] = field(default_factory=list)


@dataclass
class Corpus:
    ignore_names: list[str] = field(default_factory=list)


@dataclass
class Retrieval:
    dense_top_k: int = 20
    rerank_top_k: int = 20
    lexical_fusion_weight: float = 2.0
    relation_fusion_weight: float = 1.0

    def check(self) -> None:
        if self.dense_top_k < 1 or self.rerank_top_k < 1 or self.lexical_fusion_weight < 0 or self.relation_fusion_weight < 0:
            raise ValueError("top_k must be positive and weights not negative")


@dataclass
class Reranker:
    url: str | None = None
    endpoint: str = "/v1/rerank"
    auto_start: bool = False
    host: str = "127.0.0.1"
    port: int = 8012

    def address(self) -> str | None:
        """Where the service is asked: the endpoint under the url, with one slash between them."""
        return f"{self.url.rstrip('/')}/{self.endpoint.strip().lstrip('/')}" if self.url else None

    def check(self) -> None:
        """A service that is to be started must be the one that is asked."""
        if not self.auto_start:
            return
        if self.url is None:
            raise ValueError("reranker.auto_start needs reranker.url")
        if self.url.split("://")[-1].split("/")[0] != f"{self.host}:{self.port}":
            raise ValueError("reranker.host and reranker.port must be those of reranker.url")


@dataclass
class Expansion:
    hops: int = 1
    max_terms: int = 12


@dataclass
class Extraction:
    min_entity_mentions: int = 2
    max_relations_per_chunk: int = 15
    claim_min_mentions: int = 1
    claim_max_per_chunk: int = 10
    sub_batch_size: int = 500


@dataclass
class Graph:
    min_relation_confidence: float = 0.5
    community_resolution: float = 1.0
    entity_summary_max_chunks: int = 20
    entity_embedding_min_mentions: int = 3
    max_entity_context: int = 5
    max_community_context: int = 3
    max_claim_context: int = 10


@dataclass
class Synthesis:
    max_chunks: int = 8


@dataclass
class Logging:
    level: str = "INFO"
    format: str = "json"


@dataclass
class Settings:
    paths: Paths
    models: Models = field(default_factory=Models)
    chunking: Chunking = field(default_factory=Chunking)
    embedding: Embedding = field(default_factory=Embedding)
    hosted: Hosted | None = None
    corpus: Corpus = field(default_factory=Corpus)
    ontology: OntologyFiles = field(default_factory=OntologyFiles)
    retrieval: Retrieval = field(default_factory=Retrieval)
    reranker: Reranker = field(default_factory=Reranker)
    expansion: Expansion = field(default_factory=Expansion)
    extraction: Extraction = field(default_factory=Extraction)
    graph: Graph = field(default_factory=Graph)
    synthesis: Synthesis = field(default_factory=Synthesis)
    logging: Logging = field(default_factory=Logging)

    def check(self) -> None:
        if self.models.embed_dims < 1:
            raise ValueError("models.embed_dims must be positive")
        if self.models.embed_backend == "hosted":
            if self.hosted is None:
                raise ValueError("models.embed_backend = hosted needs a section `hosted`")
            if self.hosted.dims != self.models.embed_dims:
                raise ValueError("models.embed_dims must be hosted.dims")


def build(kind: type, values: Any, at: str = "") -> Any:
    """A dataclass from a mapping: unknown and missing keys and values of another type are errors that name the key."""
    if not isinstance(values, dict):
        raise ValueError(f"{at or 'the settings'} must be a mapping")
    hints, known = get_type_hints(kind), {f.name: f for f in fields(kind)}
    if unknown := sorted(map(str, set(values) - set(known))):
        raise ValueError(f"unknown key: {at}{unknown[0]}")
    out = {}
    for name, f in known.items():
        if name not in values:
            if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
                raise ValueError(f"missing key: {at}{name}")
            continue
        value, hint = values[name], hints[name]
        kinds = [t for t in getattr(hint, "__args__", [hint]) if t is not type(None)] if not str(hint).startswith("list") else [list]
        optional = "None" in str(hint)
        if dataclasses.is_dataclass(kinds[0]):
            out[name] = None if value is None and optional else build(kinds[0], value, f"{at}{name}.")
        elif value is None and optional:
            out[name] = None
        elif kinds[0] is float and isinstance(value, (int, float)) and not isinstance(value, bool):
            out[name] = float(value)
        elif not isinstance(value, kinds[0]) or (isinstance(value, bool) and kinds[0] is not bool):
            raise ValueError(f"{at}{name} must be {kinds[0].__name__}")
        else:
            out[name] = value
    made = kind(**out)
    if hasattr(made, "check"):
        made.check()
    return made


def find_root(start: str | Path | None = None) -> Path:
    """The nearest folder from `start` upwards that holds the settings file and a folder `folioscope` or a mark `.folioscope`."""
    at = Path(start or ".").resolve()
    for folder in (at, *at.parents):
        if (folder / f"{NAME}.yaml").is_file() and ((folder / "folioscope").is_dir() or (folder / ".folioscope").exists()):
            return folder
    raise FileNotFoundError(f"no folder from {at} upwards holds {NAME}.yaml and a mark")


def load(root: str | Path, profile: str | None = None, path: str | Path | None = None) -> tuple[Settings, Path]:
    """The settings of config.yaml, of config.<profile>.yaml, or of a named file, which is relative to root."""
    import yaml

    if profile is not None and path is not None:
        raise ValueError("give a profile or a file, not both")
    file = Path(root) / (Path(path).expanduser() if path is not None else f"{NAME}.{profile}.yaml" if profile is not None else f"{NAME}.yaml")
    if not file.is_file():
        raise FileNotFoundError(f"no settings file: {file}")
    raw = yaml.safe_load(file.read_text(encoding="utf-8"))
    if not isinstance(raw, dict) or not isinstance(raw.get("paths"), dict):
        raise ValueError("the settings need a mapping `paths`")
    for name in ("corpus_path", "ontology_path", "data_path"):
        value = raw["paths"].get(name)
        if not isinstance(value, str) or not value.strip():
            raise ValueError(f"paths.{name} must be a path")
        if "://" not in value:
            raw["paths"][name] = str((file.parent / Path(value).expanduser()).resolve())
    return build(Settings, raw), file


def remembered(settings: Settings) -> dict[str, str]:
    """The settings that chunks and vectors depend on, as a store keeps them."""
    p, c, m = settings.paths, settings.chunking, settings.models
    out = {f"paths.{k}": getattr(p, k) for k in ("corpus_path", "ontology_path", "data_path")}
    out |= {f"chunking.{k}": str(getattr(c, k)) for k in ("chunk_overlap", "chunk_size", "min_tokens", "strategy", "tokenizer_backend", "tokenizer_name")}
    return out | {"models.embed": m.embed, "models.embed_backend": m.embed_backend, "models.embed_dims": str(m.embed_dims)}


def drift(now: dict[str, str], stored: dict[str, str]) -> list[str]:
    """Warnings where the settings are no longer those that the store was written with; none for a store without any."""
    if not stored:
        return []
    out = []
    for key, value in now.items():
        if key not in stored:
            out.append(f"{key} was not kept by the last ingest")
        elif stored[key] != value:
            out.append(f"{key} has changed since the last ingest: {stored[key]} then, {value} now")
    return out


def set_logging(level: str = "INFO", form: str = "json") -> None:
    """Log lines as JSON objects or plain text, on standard error."""
    import json
    import logging

    class Lines(logging.Formatter):
        def format(self, record: logging.LogRecord) -> str:
            return json.dumps({"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()})

    if form not in ("json", "console"):
        raise ValueError(f"unknown log format: {form}")
    handler = logging.StreamHandler()
    handler.setFormatter(Lines() if form == "json" else logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
    logging.basicConfig(level=level.upper(), handlers=[handler], force=True)
    logging.getLogger("py4j").setLevel("WARNING")
