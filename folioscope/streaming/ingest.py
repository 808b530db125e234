"""Watching a corpus folder: each batch of new or changed files goes through the same merge as a batch run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators.pipeline import Options, merge
from folioscope.operators.store import Store
from folioscope.session import materialize
from folioscope.sources import corpus as files_of

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str, store: Store, checkpoint: str, terms: DataFrame, now: Callable[[int], str], options: Options | None = None) -> StreamingQuery:
    """Files that appear under root, or change, replace what is stored of their path: chunks, vectors, mentions and manifest.

    A batch that is repeated after a failure finds its files unchanged and gives the same tables. Files that go are left to the next
    batch run, as a stream never hears of them. now: the time to be written for a batch of this number."""
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(root)

    def add(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by(F.struct("length", "content"), "modificationTime").alias("r")).select("path", "r.*")
        scanned = materialize(files_of.described(newest, root, content=True))
        if not scanned.isEmpty():
            merge(store, scanned, terms, now(number), f"watch-{number}", False, options or Options(), whole=False)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
