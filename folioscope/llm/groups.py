"""Walking over the groups of a stream of Arrow batches that is sorted by a key, and cutting groups that are too large."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Bytes:
    """A binary column; a slice of it, whose values must have equal lengths, is a matrix of bytes."""

    def __init__(self, column: pa.Array) -> None:
        kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)

    def __getitem__(self, part: slice) -> np.ndarray:
        return self.data[self.offsets[part.start] : self.offsets[part.stop]].reshape(part.stop - part.start, -1)


def as_numpy(column: pa.Array) -> np.ndarray | Bytes:
    return Bytes(column) if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else column.to_numpy()


def groups(batches: Iterable[pa.RecordBatch], key: str, columns: list[str], least: int = 2) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of each group of at least `least` rows, one group at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    last = None

    def whole() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(c) for c in zip(*held)) if len(held) > 1 else held[0]

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column(key).to_numpy()
        data = [as_numpy(batch.column(c)) for c in columns]
        edge = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate([[0], edge]), np.append(edge, n)
        wanted = np.flatnonzero((ends - starts >= least) | (starts == 0) | (ends == n))
        for i in wanted.tolist():
            s, e = starts[i], ends[i]
            if held and (i > 0 or keys[s] != last):
                if sum(len(h[0]) for h in held) >= least:
                    yield whole()
                held = []
            part = tuple(x[s:e].copy() for x in data)
            if e == n or held:
                held.append(part)
                last = keys[s]
                if e < n:
                    if sum(len(h[0]) for h in held) >= least:
                        yield whole()
                    held = []
            elif e - s >= least:
                yield part
    if held and sum(len(h[0]) for h in held) >= least:
        yield whole()


def in_blocks(rows: DataFrame, key: str, member: str, size: str, block: int) -> DataFrame:
    """Groups of more than `block` rows cut into blocks by a hash of the member: a row goes to every pair of blocks that its own
    is in, under a key of the pair, with the side it is on (0 within one block, else 1 or 2). size: a column with the number
    of rows of the group where that is above `block`, else null; it is dropped."""
    both = rows.withColumn("__b", F.coalesce(F.ceil(F.col(size) / block), F.lit(1)))
    both = both.withColumn("__home", F.pmod(F.xxhash64(member), "__b")).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__b") - 1)))
    low, high = F.least("__home", "__other"), F.greatest("__home", "__other")
    side = F.when(low == high, 0).when(F.col("__home") == low, 1).otherwise(2).cast("byte")
    return both.withColumn("side", side).withColumn(key, F.when(F.col("__b") > 1, F.xxhash64(key, low, high)).otherwise(F.col(key))).drop(size, "__b", "__home", "__other")
