"""The corpus store: manifest states, change detection, keyed merges, cascades, and the run log.

A store is a folder of Parquet tables. A table is replaced by writing a new version beside the old one and switching a
pointer file last, so a job that dies leaves the old version in place and readers keep what they opened.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as X

#: Tables that lose rows with a source's chunks, by the column that names the chunk.
CHILDREN = {"mention_rows": "chunk_id", "extracted_relations": "chunk_id", "claims": "chunk_id", "relation_evidence": "chunk_id"}
#: Tables that name the source of their rows.
OF_SOURCE = ["extracted_relations", "claims"]


def latest_manifest(rows: DataFrame) -> DataFrame:
    """The newest row per path by last_seen_at, both spellings of UTC read alike; equal times go by the other columns."""
    seen = F.regexp_replace("last_seen_at", "Z$", "+00:00")
    order = [F.col("last_seen_at").desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in ("content_hash", "document_id", "absolute_path", "file_size_bytes", "chunk_count", "lifecycle_status", "last_processed_at", "last_committed_at"))]
    rows = rows.filter("source_rel_path is not null").withColumn("last_seen_at", seen)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("source_rel_path").orderBy(*order))).filter("__n = 1").drop("__n")


def summary(manifest: DataFrame) -> DataFrame:
    live = F.col("lifecycle_status") != "deleted"
    return manifest.agg(
        F.count("*").alias("files"), F.count_if(live).alias("live"), F.count_if(live & (F.col("source_type") != "image_png")).alias("text_files"), F.count_if(live & (F.col("source_type") == "image_png")).alias("assets"),
        F.count_if(F.col("lifecycle_status") == "failed").alias("failed"), F.count_if(live & (F.col("retrieval_status") == "searchable")).alias("searchable"), F.coalesce(F.sum(F.when(live, F.col("chunk_count"))), F.lit(0)).cast("long").alias("chunks"),
    )


def diff(old: DataFrame, scan: DataFrame) -> DataFrame:
    """source_rel_path, change: new, deleted, changed or unchanged, by path and content hash."""
    a, b = old.select("source_rel_path", F.col("content_hash").alias("a"), F.lit(1).alias("in_a")), scan.select("source_rel_path", F.col("content_hash").alias("b"), F.lit(1).alias("in_b"))
    both = a.join(b, "source_rel_path", "full")
    return both.select("source_rel_path", F.when(F.col("in_b").isNull(), "deleted").when(F.col("in_a").isNull(), "new").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed").alias("change"))


def moves(old: DataFrame, scan: DataFrame) -> DataFrame:
    """new_path, old_path: a path that is new with the content of one that is gone, the first such by name."""
    gone = old.join(scan.select("source_rel_path"), "source_rel_path", "left_anti").select(F.col("source_rel_path").alias("old_path"), "content_hash", "source_type")
    new = scan.join(old.select("source_rel_path"), "source_rel_path", "left_anti").select(F.col("source_rel_path").alias("new_path"), "content_hash", "source_type")
    return new.join(gone.groupBy("content_hash", "source_type").agg(F.min("old_path").alias("old_path")), ["content_hash", "source_type"]).select("new_path", "old_path")


def asset_links(live: DataFrame) -> DataFrame:
    """asset_path, parent_path, link_method: the document next to the asset's `_images` folder."""
    assets = live.filter("source_type = 'image_png'").select(F.col("source_rel_path").alias("asset_path"), X.asset_parent_base("source_rel_path").alias("base"))
    for kind, suffix in (("docling_json", ".docling.json"), ("docling_md", ".docling.md"), ("markdown", ".md")):
        assets = assets.join(live.select(F.col("source_rel_path").alias(kind)), F.concat("base", F.lit(suffix)) == F.col(kind), "left")
    method = F.when(F.col("docling_json").isNotNull(), "docling_json").when(F.col("docling_md").isNotNull(), "docling_md").when(F.col("markdown").isNotNull(), "markdown").otherwise("unresolved")
    return assets.select("asset_path", F.coalesce("docling_json", "docling_md", "markdown").alias("parent_path"), method.alias("link_method"))


#: What the link of an asset to its document is called in the store, by the kind of document.
LINK_NAMES = {"docling_json": "docling_sibling_images_dir", "docling_md": "markdown_sibling_images_dir", "markdown": "markdown_sibling_images_dir", "unresolved": "unresolved"}


def asset_records(live: DataFrame, now: str) -> DataFrame:
    """Rows of asset_links: an asset, the document it belongs to, and its page by the name of its file."""
    link = F.create_map(*(F.lit(x) for pair in LINK_NAMES.items() for x in pair))
    parent = live.select(F.col("source_rel_path").alias("parent_path"), F.col("absolute_path").alias("parent_source_path"), F.col("document_id").alias("parent_document_id"))
    own = live.select(F.col("source_rel_path").alias("asset_path"), "source_domain", "content_hash")
    rows = asset_links(live).join(own, "asset_path").join(parent, "parent_path", "left")
    return rows.select("asset_path", F.element_at(F.split("asset_path", "/"), -1).alias("asset_filename"), "source_domain", "parent_source_path", "parent_document_id", X.page_of_stem("asset_path").alias("page_no"), F.lit(None).cast("int").alias("asset_index"), link[F.col("link_method")].alias("link_method"), "content_hash", F.lit(now).alias("last_committed_at"))


def ready(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """source_rel_path of sources that need no rebuild while their content stays: searchable and complete with as many stored
    chunks (stored: source_rel_path, n) as the manifest says, or complete assets."""
    both = manifest.filter("lifecycle_status = 'complete'").join(stored, "source_rel_path", "left")
    return both.filter("retrieval_status = 'asset_only' or (retrieval_status = 'searchable' and chunk_count = n)").select("source_rel_path")


def status(manifest: DataFrame, chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row: files (deleted ones too), text files, assets, how many of each retrieval status, chunks and mentions."""
    live = F.col("lifecycle_status") != "deleted"
    role = lambda name: F.count_if(live & (F.col("retrieval_status") == name)).alias(name)
    out = manifest.select(F.lit(0).alias("part"), "lifecycle_status", "source_type", "retrieval_status")
    for part, rows in ((1, chunks), (2, mentions)):
        out = out.union(rows.select(F.lit(part), *(F.lit(None).cast("string"),) * 3))
    live = live & (F.col("part") == 0)
    return out.agg(F.count_if(F.col("part") == 0).alias("files"), F.count_if(live & (F.col("source_type") != "image_png")).alias("text_files"), F.count_if(live & (F.col("source_type") == "image_png")).alias("assets"), role("searchable"), role("asset_only"), role("not_searchable"), F.count_if(F.col("part") == 1).alias("chunks"), F.count_if(F.col("part") == 2).alias("mentions"))


def without_sources(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """The tables without the chunks of these sources and all that hangs on them."""
    gone = paths.select("source_rel_path").distinct()
    dead = tables["chunk_rows"].join(gone, "source_rel_path", "left_semi").select("chunk_id").distinct()
    out = {t: rows.join(dead.select(F.col("chunk_id").alias(CHILDREN[t])), CHILDREN[t], "left_anti") for t, rows in tables.items() if t in CHILDREN}
    return out | {"chunk_rows": tables["chunk_rows"].join(gone, "source_rel_path", "left_anti")}


def tombstoned(manifest: DataFrame, paths: DataFrame, when: str) -> DataFrame:
    """The manifest with the rows of these paths marked as deleted, without chunks."""
    gone = paths.select("source_rel_path").distinct().withColumn("__gone", F.lit(True))
    out = manifest.join(gone, "source_rel_path", "left")
    for column, value in (("lifecycle_status", F.lit("deleted")), ("retrieval_status", F.lit("not_searchable")), ("chunk_count", F.lit(0)), ("last_committed_at", F.lit(when))):
        out = out.withColumn(column, F.when(F.col("__gone"), value).otherwise(F.col(column)))
    return out.select(*manifest.columns)


def renamed_sources(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """Rows of a table whose source has moved (new_path, old_path), under the new path, with what else names the path."""
    out = rows.join(moved.withColumnRenamed("old_path", "source_rel_path"), "source_rel_path", "left")
    new, is_new = F.col("new_path"), F.col("new_path").isNotNull()
    change = {"source_rel_path": new, "source_filename": F.element_at(F.split(new, "/"), -1), "source_domain": X.source_domain(new), "citation_label": X.moved_citation("citation_label", new), "source_path": F.concat(F.regexp_replace("source_path", F.concat(F.lit(r"\Q"), "source_rel_path", F.lit(r"\E$")), F.lit("")), new)}
    for name in [c for c in ("source_path", "citation_label", "source_filename", "source_domain", "source_rel_path") if c in rows.columns]:
        out = out.withColumn(name, F.when(is_new, change[name]).otherwise(F.col(name)))
    return out.select(*rows.columns)


def stale(reports: DataFrame, communities: DataFrame) -> DataFrame:
    """Reports of communities that no entity belongs to any more."""
    return reports.join(communities.select("community_id").distinct(), "community_id", "left_anti")


def filled_in(rows: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """rows with `column` taken from new (key, column) where that has a value that is not blank."""
    fresh = new.filter(F.trim(column) != "").select(key, F.col(column).alias("__new"))
    return rows.join(fresh, key, "left").withColumn(column, F.coalesce("__new", column)).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"))


def slug(text: str) -> str:
    """A name for a file: what is no letter or digit as hyphens."""
    return re.sub(r"[^A-Za-z0-9]+", "-", text).strip("-")


class Store:
    """Tables under one folder, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def _version(self, table: str) -> str | None:
        pointer = self._path(f"{table}/_current")
        if not self._fs.exists(pointer):
            return None
        stream = self._fs.open(pointer)
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def exists(self, table: str) -> bool:
        return self._version(table) is not None

    def read(self, table: str, schema: str | None = None) -> DataFrame:
        version = self._version(table)
        if version is None:
            if schema is None:
                raise FileNotFoundError(table)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.base}/{table}/{version}")

    def replace(self, table: str, rows: DataFrame) -> None:
        """Write a new version and switch to it; the version before is kept for running readers, older ones go."""
        before, version = self._version(table), f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.base}/{table}/{version}")
        stream = self._fs.create(self._path(f"{table}/_current"), True)
        stream.writeUTF(version)
        stream.close()
        for status in self._fs.listStatus(self._path(table)):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in (before, version):
                self._fs.delete(status.getPath(), True)

    def upsert(self, table: str, rows: DataFrame, key: str) -> None:
        self.replace(table, upsert(self.read(table), rows, key) if self.exists(table) else rows)

    def insert_or_ignore(self, table: str, rows: DataFrame, key: str) -> None:
        self.replace(table, insert_or_ignore(self.read(table), rows, key) if self.exists(table) else rows.dropDuplicates([key]))

    def delete_sources(self, paths: DataFrame, when: str) -> None:
        """Tombstone the manifest rows of the paths and remove their chunks with everything that hangs on these."""
        self._drop_chunks(paths)
        self.replace("corpus_manifest", tombstoned(self.read("corpus_manifest"), paths, when))

    def _drop_chunks(self, paths: DataFrame) -> None:
        tables = {t: self.read(t) for t in (*CHILDREN, "chunk_rows") if self.exists(t)}
        if "chunk_rows" in tables:
            left = without_sources(tables, paths)
            for table in sorted(left, key="chunk_rows".__eq__):  # the chunks last, as the others are found by them
                self.replace(table, left[table])

    def replace_source_chunks(self, chunks: DataFrame, children: dict[str, DataFrame] | None = None, paths: DataFrame | None = None) -> None:
        """All chunks of the given sources, or of those in `chunks`, give way to these, together with what hangs on them."""
        self._drop_chunks(chunks if paths is None else paths)
        for table, rows in {"chunk_rows": chunks, **(children or {})}.items():
            self.replace(table, self.read(table).unionByName(rows, allowMissingColumns=True) if self.exists(table) else rows)

    def move_sources(self, moved: DataFrame, when: str) -> None:
        """What is stored under the old paths (new_path, old_path) is stored under the new ones: chunks with their vectors and
        mentions, relations and claims stay, as chunk ids don't depend on paths. The old paths become tombstones."""
        for table in ("chunk_rows", *OF_SOURCE):
            if self.exists(table):
                self.replace(table, renamed_sources(self.read(table), moved))
        self.replace("corpus_manifest", tombstoned(self.read("corpus_manifest"), moved.select(F.col("old_path").alias("source_rel_path")), when))

    def put(self, table: str, values: dict[str, str], when: str, whole: bool = False) -> None:
        """Keys and values of a small table (key, value, updated_at); `whole` drops all others."""
        rows = self.spark.createDataFrame([(k, v, when) for k, v in values.items()], "key string, value string, updated_at string")
        self.replace(table, rows.coalesce(1)) if whole else self.upsert(table, rows, "key")

    def get(self, table: str) -> dict[str, str]:
        return {r.key: r.value for r in self.read(table, "key string, value string, updated_at string").collect()}

    def has_state(self) -> bool:
        """Whether anything has been committed: an ontology, settings, live files, chunks or mentions."""
        if any(self.exists(t) and not self.read(t).isEmpty() for t in ("ontology_snapshot", "ingest_config", "chunk_rows", "mention_rows")):
            return True
        return self.exists("corpus_manifest") and not self.read("corpus_manifest").filter("lifecycle_status <> 'deleted'").isEmpty()

    def reset(self, tables: list[str]) -> None:
        """Forget tables; ones that don't exist are none."""
        for table in tables:
            self._fs.delete(self._path(table), True)

    def runs(self, kind: str = "runs") -> list[dict]:
        """The last state of every logged run, in order of their start."""
        folder = self._path(kind)
        states: dict[str, dict] = {}
        if self._fs.exists(folder):
            found = sorted(((s.getModificationTime(), s.getPath()) for s in self._fs.listStatus(folder)), key=lambda x: (x[0], x[1].getName()))
            for _, path in found:
                stream = self._fs.open(path)
                text = bytes(stream.readAllBytes()).decode()
                stream.close()
                run = json.loads(text)
                states[run["run_id"]] = states.get(run["run_id"], {}) | run
        return sorted(states.values(), key=lambda r: (r.get("started_at") or "", r["run_id"]))

    def write_json(self, name: str, value: dict) -> str:
        """A small file of indented JSON with sorted keys; its path."""
        stream = self._fs.create(self._path(name), True)
        stream.write(bytearray(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=True), "utf-8"))
        stream.close()
        return f"{self.base}/{name}"

    def log_run(self, run: dict, kind: str = "runs") -> None:
        """One small JSON file per run and state (its status and, while it runs, its phase); the last state of a run counts."""
        path = self._path(f"{kind}/" + "-".join(slug(x) for x in (run["run_id"], run["status"], run.get("phase")) if x) + ".json")
        stream = self._fs.create(path, True)
        stream.writeBytes(json.dumps(run, sort_keys=True))
        stream.close()
