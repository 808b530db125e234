"""Commands: ingest, status, eval, build-graph, graph-status, prepare-batch, collect-batch, batch-status, serve.

All read the settings file (see settings.py), from --root or the folder it is found in, and print JSON."""

from __future__ import annotations

import argparse
import json
import sys
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession

from folioscope import providers, settings
from folioscope.api import Tools
from folioscope.operators import corpus as C
from folioscope.operators import extraction as E
from folioscope.operators import pipeline as P
from folioscope.operators.store import Store
from folioscope.session import build
from folioscope.sources import corpus as files_of
from folioscope.sources import ontology


class App:
    """Settings, session, ontology and store of one process."""

    def __init__(self, root: str | None = None, profile: str | None = None, config: str | None = None, spark: SparkSession | None = None) -> None:
        self.settings, self.file = settings.load(root or settings.find_root(), profile, config)
        s = self.settings
        for name in ("corpus_path", "ontology_path"):
            path = getattr(s.paths, name)
            if "://" not in path and not Path(path).is_dir():
                raise FileNotFoundError(f"paths.{name} is no folder: {path}")
        settings.set_logging(s.logging.level, s.logging.format)
        self.spark = spark or SparkSession.getActiveSession() or build("folioscope")
        self.ontology = ontology.load(s.paths.ontology_path, tuple(s.ontology.include_globs), tuple(s.ontology.ignore_names))
        self.terms = self.ontology.tables(self.spark)["terms"]
        self.store = Store(self.spark, s.paths.data_path)
        self.embedder = providers.with_retries(providers.hashing_embedder(s.models.embed_dims), s.embedding.retry_attempts, tuple(s.embedding.retry_backoff))
        self.now = datetime.now(timezone.utc).isoformat(timespec="seconds")

    def options(self) -> P.Options:
        s = self.settings
        c = s.chunking
        return P.Options(c.chunk_size, c.chunk_overlap, c.min_tokens, c.strategy, c.tokenizer_backend, c.tokenizer_name or None, s.models.embed_dims, self.embedder, s.models.embed, self.ontology, settings.remembered(s), s.corpus.ignore_names, [providers.offline_relations], "offline", [], s.extraction.min_entity_mentions, s.extraction.max_relations_per_chunk)

    def tools(self) -> Tools:
        return Tools(self.store, self.embedder, self.settings.models.embed_dims, ontology=self.ontology, remembered=settings.remembered(self.settings), options=self.settings)

    def ingest(self, full: bool = False) -> dict:
        works, warning = providers.probe_embedder(self.embedder, self.settings.models.embed_dims)
        if not works:
            raise RuntimeError(f"the embedder is not ready: {warning}")
        return P.ingest(self.spark, self.store, self.settings.paths.corpus_path, self.terms, self.now, f"ingest-{uuid.uuid4().hex[:12]}", full, self.options())

    def build_graph(self, full: bool = False, enrich: bool = False, dry_run: bool = False, phase: str | None = None) -> dict:
        if dry_run:
            return self.tools().build_preview(self.settings.extraction.claim_min_mentions).first().asDict()
        phases = [phase] if phase else [p for p in P.PHASES if enrich or p != "enrichment"]
        s = self.settings
        ran = P.build_graph(self.store, self.terms, phases, self.ontology, [providers.offline_claims], [], self.now, f"graph-{uuid.uuid4().hex[:12]}", full, s.extraction.sub_batch_size, s.extraction.claim_min_mentions, s.graph.min_relation_confidence)
        return {"phases": ran} | self.tools().graph_overview()

    def evaluate(self, file: str) -> dict:
        paths = self.store.read("corpus_manifest", P.MANIFEST).filter("lifecycle_status <> 'deleted' and retrieval_status = 'searchable'").select("source_rel_path")
        cases = files_of.resolve_expected(files_of.eval_cases(self.spark, file), paths)
        per_case, means = self.tools().evaluate(cases, self.terms)
        return means.first().asDict() | {"failing": [r["case"] for r in per_case.filter("reciprocal_rank = 0").orderBy("case").collect()]}

    def _batch(self) -> str:
        return f"{self.settings.paths.data_path}/batch"

    def prepare_batch(self, full: bool = False) -> dict:
        """Request files for the claims of all chunks that have none."""
        mentions = C.clean_mentions(self.store.read("mention_rows", P.MENTIONS))
        chunks = E.qualifying(self.store.read("chunk_rows", P.CHUNKS), mentions, self.settings.extraction.claim_min_mentions)
        chunks = chunks if full else E.todo(chunks, self.store.read("claims", E.CLAIMS))
        E.write_requests(E.request_lines(chunks, E.CLAIM_TASK, E.prompt(), self.settings.models.llm), chunks, self._batch())
        return {"requests": f"{self._batch()}/requests", "count": self.spark.read.text(f"{self._batch()}/requests").count()}

    def collect_batch(self, answers: str) -> dict:
        """Claims from an answer file to the requests prepared last."""
        chunks = self.spark.read.parquet(f"{self._batch()}/chunks")
        rows = E.claim_records(E.read_answers(self.spark, answers), chunks, self.settings.models.llm, self.now, self.settings.extraction.claim_max_per_chunk)
        before = self.store.read("claims", E.CLAIMS).count()
        self.store.insert_or_ignore("claims", rows, "claim_id")
        return {"claims": self.store.read("claims").count() - before}

    def batch_status(self, answers: str) -> dict:
        return E.batch_counts(self.spark.read.text(answers)).first().asDict()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="folioscope", description=__doc__)
    p.add_argument("--root"), p.add_argument("--profile"), p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("ingest").add_argument("--full", action="store_true")
    sub.add_parser("status"), sub.add_parser("graph-status"), sub.add_parser("serve")
    sub.add_parser("eval").add_argument("file")
    g = sub.add_parser("build-graph")
    for flag in ("--full", "--enrich", "--dry-run"):
        g.add_argument(flag, action="store_true")
    g.add_argument("--phase", choices=P.PHASES)
    sub.add_parser("prepare-batch").add_argument("--full", action="store_true")
    for name in ("collect-batch", "batch-status"):
        sub.add_parser(name).add_argument("answers")
    a = p.parse_args(argv)
    app = App(a.root, a.profile, a.config)
    if a.command == "serve":
        from folioscope.server import serve

        serve(app, sys.stdin, sys.stdout)
        return 0
    run = {
        "ingest": lambda: app.ingest(a.full), "status": lambda: app.tools().corpus_status(), "graph-status": lambda: app.tools().graph_status(), "eval": lambda: app.evaluate(a.file), "build-graph": lambda: app.build_graph(a.full, a.enrich, a.dry_run, a.phase),
        "prepare-batch": lambda: app.prepare_batch(a.full), "collect-batch": lambda: app.collect_batch(a.answers), "batch-status": lambda: app.batch_status(a.answers),
    }
    print(json.dumps(run[a.command](), indent=2, sort_keys=True, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
