"""The most similar vectors of every vector, by multiprobe p-stable hashing (problem 5).

A table hashes a unit vector by m functions floor((a.x + b) / w), a drawn from the normal distribution, which is stable
for the Euclidean distance. The cell so named is where near vectors most likely lie; the next likely are cells with some
coordinates moved by one, in the order of the summed squared distances to the walls to be crossed (estimated success). Every
vector visits its own cell and the `probes` - 1 best others in each of `tables` tables, and is both asked for and found
in all of them. In a cell all pairs are compared as blocks of a matrix product over vectors of 16-bit steps; the best of every
cell are merged for each vector. Where the steps leave the k-th place in doubt, the contenders are compared again in
double precision on the vectors as stored. Cells above CELL vectors are split into blocks and every two blocks meet.
`recall` measures what is found against a comparison of a stated part of the vectors with all.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.groups import groups, in_blocks
from folioscope.llm.neardup import mix64
from folioscope.session import broadcast_if_small, materialize

#: Up to this many vectors of a kind share one cell, so that all are compared; 0 to hash at any size.
WHOLE = 2000
#: Vectors asked for at once when the recall is measured.
ASKED = 5_000
CELL = 16_384
#: Cosines closer than this count as undecided until they are computed in double precision.
DOUBT = 2e-5
SALTS = 64


def functions_for(n: int, whole: int) -> int:
    """Hash functions per table for n vectors: more cells as n grows, slowly enough to keep near vectors together."""
    return 0 if n <= whole else max(1, round(0.3 * math.log2(n) + 7.2))


class Hasher:
    """The cells of unit vectors of one kind, most likely first, for each table."""

    def __init__(self, kind: int, dims: int, m: int, tables: int, probes: int, width: float, seed: int) -> None:
        rng = np.random.default_rng([seed, dims, m])
        self.kind, self.m, self.width, self.probes = np.uint64(kind & (2**64 - 1)), m, width, probes
        self.tables = [(rng.standard_normal((dims, m)), rng.uniform(0, width, m), np.uint64(k + 1)) for k in range(tables if m else 1)]
        near = min(8, 2 * m)
        self.moves = [()] + [c for k in (1, 2, 3) for c in itertools.combinations(range(near), k)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.m:
            return np.full((len(x), 1), mix64(np.array([self.kind], np.uint64))[0])
        return np.concatenate([self._cells(x, *t) for t in self.tables], 1)

    def _cells(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, number: np.uint64) -> np.ndarray:
        m, n = self.m, len(x)
        at = (x @ a + b) / self.width
        home = np.floor(at)
        gap = at - home
        score = np.concatenate([gap**2, (1 - gap) ** 2], 1)
        order = np.argsort(score, 1)
        sorted_score = np.take_along_axis(score, order, 1)
        coordinate = order % m
        cost = np.full((n, len(self.moves)), 0.0)
        for c, move in enumerate(self.moves):
            if move:
                cost[:, c] = sorted_score[:, list(move)].sum(1)
                for p, q in itertools.combinations(move, 2):
                    cost[coordinate[:, p] == coordinate[:, q], c] = np.inf
        take = min(self.probes, len(self.moves))
        best = np.argsort(cost, 1)[:, :take]
        weight = mix64(np.arange(1, m + 1, dtype=np.uint64)) | np.uint64(1)
        base = (home.astype(np.int64).view(np.uint64) * weight).sum(1)
        step = np.where(order < m, np.uint64(2**64 - 1), np.uint64(1)) * weight[coordinate]
        cells = np.repeat(base[:, None], take, 1)
        for c, move in enumerate(self.moves):
            rows, slots = np.nonzero(best == c)
            for p in move:
                cells[rows, slots] += step[rows, p]
        return mix64(cells + mix64(np.array([self.kind * np.uint64(31) + number], np.uint64)))


def _unit(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """Per kind in the batch: (kind, rows, unit vectors) of the valid vectors."""
    column = batch.column(at)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    length = column.value_lengths().to_numpy(zero_copy_only=False)
    start = np.cumsum(length) - length
    kinds = batch.column(1).to_numpy()
    found = []
    for kind, dims in sorted(set(zip(kinds.tolist(), length.tolist()))):
        rows = np.flatnonzero((kinds == kind) & (length == dims))
        x = flat[start[rows][:, None] + np.arange(dims)]
        with np.errstate(all="ignore"):
            norm = np.sqrt((x * x).sum(1))
            good = np.isfinite(x).all(1) & np.isfinite(norm) & (norm > 0)
            found.append((kind, dims, rows[good], x[good] / norm[good, None]))
    return found


def _valid(df: DataFrame, key: str, vector: str, model: str, dims: str) -> DataFrame:
    """id (64-bit hash of the key), kind (hash of model and dims), v, key: one row per key with a valid vector, as far as the JVM can tell cheaply."""
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(key).alias("key"), F.col(vector).alias("v"), F.col(model).alias("m"), F.col(dims).alias("d"))
    rows = rows.filter(F.col("key").isNotNull() & F.col("m").isNotNull() & (F.size("v") == F.col("d")) & (F.col("d") > 0)).filter(finite).filter(F.exists("v", lambda x: x != 0))
    return rows.select(F.xxhash64("key").alias("id"), F.xxhash64("m", "d").alias("kind"), "v", "key", "d")


def _surplus(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame] | None:
    """Of vectors that many keys share, the k + 1 smallest keys stand for all in the search. (the other keys, their k answers)."""
    light = rows.select("key", "id", "kind", F.xxhash64("v").alias("h"))
    crowd = light.select("id", "kind", "h").distinct().groupBy("kind", "h").agg(F.count("*").alias("c")).filter(F.col("c") > k + 1)
    crowd = materialize(crowd)
    if crowd.isEmpty():
        return None
    many = light.dropDuplicates(["key"]).join(crowd.select("kind", "h"), ["kind", "h"]).withColumn("salt", F.pmod("id", F.lit(SALTS)))
    first = many.withColumn("r", F.row_number().over(Window.partitionBy("kind", "h", "salt").orderBy("key"))).filter(F.col("r") <= k + 1)
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("kind", "h").orderBy("key"))).filter(F.col("r") <= k + 1)
    first = materialize(first.select("kind", "h", "key", "id", "r"))
    rest = materialize(many.join(first.select("key"), "key", "left_anti").select("kind", "h", "key", "id"))
    answers = rest.select("kind", "h", F.col("key").alias("a")).join(first.filter(F.col("r") <= k).select("kind", "h", F.col("key").alias("b")), ["kind", "h"])
    return rest, answers.select("a", "b")


def nearest(df: DataFrame, key: str, vector: str, model: str, dims: str, k: int = 5, tables: int = 4, probes: int = 3, width: float = 3.0, seed: int = 7, either: bool = False, whole: int = WHOLE) -> DataFrame:
    """(key_a, key_b): key_b is among the k most similar to key_a by cosine, of the same model and dims. With `either`:
    key_a < key_b, once, where either is among the k most similar to the other.

    Left out: null keys, null models, and vectors that are null, of another length than dims, not finite, or zero. A
    repeated key counts once. Equal cosines go to the smaller key. Fewer than k others: all of them. Kinds of up to
    `whole` vectors are answered exactly, larger ones with the recall that the README states. Empty input gives no row."""
    spark = df.sparkSession
    rows = _valid(df, key, vector, model, dims)
    surplus = _surplus(rows, k)
    core = rows.join(surplus[0].select("key"), "key", "left_anti") if surplus else rows
    sizes = {r.kind: r.c for r in rows.groupBy("kind").agg(F.count("*").alias("c")).collect()}  # a row per model and length

    def hashers() -> dict[tuple[int, int], Hasher]:
        return {}

    def cells_of(made: dict, kind: int, d: int, x: np.ndarray) -> np.ndarray:
        if (kind, d) not in made:
            made[kind, d] = Hasher(kind, d, functions_for(sizes.get(kind, 0), whole), tables, probes, width, seed)
        return made[kind, d](x)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = hashers()
        for batch in batches:
            parts = [cells_of(made, kind, d, x).ravel() for kind, d, _, x in _unit(batch, 2) if len(x)]
            if parts:
                cell, c = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(c)], ["cell", "c"])

    slim = core.select("id", "kind", "v")
    full = materialize(slim.mapInArrow(count, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).filter(F.col("c") > CELL))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = hashers()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for kind, d, at, x in _unit(batch, 2):
                if not len(x):
                    continue
                cells = cells_of(made, kind, d, x)
                step = np.abs(x).max(1) / 32767
                small = np.round(x / step[:, None]).astype("<i2")
                who = np.repeat(np.arange(len(x)), cells.shape[1])
                cell = cells.ravel()
                data = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * 2 * d).astype(np.int32).tobytes()), pa.py_buffer(small.tobytes())])
                for s in range(0, len(who), 20_000):
                    w = pa.array(who[s : s + 20_000])
                    yield pa.RecordBatch.from_arrays([pa.array(cell[s : s + 20_000].view(np.int64)), pa.array(ids[at]).take(w), pa.array(step).take(w), data.take(w)], ["cell", "id", "step", "x"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = 2 * k + 2
        for side, ids, step, x in groups(batches, "cell", ["side", "id", "step", "x"]):
            _, first = np.unique(ids, return_index=True)
            n = len(first)
            if n < 2:
                continue
            side, ids = side[first], ids[first]
            unit = x[first].view("<i2").astype(np.float32) * step[first][:, None].astype(np.float32)
            for rows_, cols in [(np.arange(n), np.arange(n))] if not side.any() else [(np.flatnonzero(side == 1), np.flatnonzero(side == 2)), (np.flatnonzero(side == 2), np.flatnonzero(side == 1))]:
                other = unit[cols].T
                for s in range(0, len(rows_) if len(cols) else 0, 1024):
                    r = rows_[s : s + 1024]
                    near = unit[r] @ other
                    near[r[:, None] == cols[None, :] if rows_ is not cols and side.any() else (np.arange(len(r)), r)] = -9
                    take = min(keep, near.shape[1])
                    best = np.argpartition(near, near.shape[1] - take, 1)[:, near.shape[1] - take :]
                    value = np.take_along_axis(near, best, 1)
                    fifth = np.partition(value, max(0, take - k), 1)[:, max(0, take - k)]
                    ok = (value >= fifth[:, None] - DOUBT) & (value > -5)
                    full = ok.all(1) & (near.shape[1] > take)  # more may be as near: take them all
                    ok[full] = False
                    at, which = np.nonzero(ok)
                    more, other_ = np.nonzero(near[full] >= fifth[full, None] - DOUBT)
                    row, col = np.concatenate([at, np.flatnonzero(full)[more]]), np.concatenate([best[at, which], other_])
                    order = np.argsort(row, kind="stable")
                    row, col = row[order], col[order]
                    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(r)))]), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.ListArray.from_arrays(offsets, pa.array(ids[cols[col]])), pa.ListArray.from_arrays(offsets, pa.array(near[row, col]))], ["a", "b", "s"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def best(t: pa.RecordBatch) -> pa.RecordBatch:
            n = t.column("b").value_lengths().to_numpy(zero_copy_only=False)
            a, b, s = np.repeat(t.column("a").to_numpy(), n), t.column("b").flatten().to_numpy(), t.column("s").flatten().to_numpy()
            o = np.lexsort((b, a))
            a, b, s = a[o], b[o], s[o]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            a, b, s = a[new], b[new], s[new]
            o = np.lexsort((-s, a))
            a, b, s = a[o], b[o], s[o]
            begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            size = np.diff(np.append(begin, len(a)))
            rank = np.arange(len(a)) - np.repeat(begin, size)
            edge = np.repeat(s[np.minimum(begin + k - 1, begin + size - 1)], size)
            after = np.repeat(np.where(size > k, s[np.minimum(begin + k, len(s) - 1)], -9), size)
            tied = edge - after < DOUBT
            sure = np.where(tied, s > edge + DOUBT, rank < k)
            open_ = tied & ~sure & (s >= edge - DOUBT)
            left = k - np.repeat(np.add.reduceat(sure.astype(int), begin), size)
            out = sure | open_
            return pa.RecordBatch.from_arrays([pa.array(a[out]), pa.array(b[out]), pa.array(np.where(open_, left, 0)[out], pa.int32())], ["a", "b", "left"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            a = batch.column("a").to_numpy()
            cut = int(np.searchsorted(a, a[-1]))
            if cut:
                yield best(batch.slice(0, cut))
            held = batch.slice(cut)
        if held is not None and held.num_rows:
            yield best(held)

    routed = slim.mapInArrow(visit, "cell long, id long, step double, x binary").withColumn("side", F.lit(0).cast("byte"))
    if not full.isEmpty():
        routed = in_blocks(routed.drop("side").join(broadcast_if_small(full), "cell", "left"), "cell", "id", "c", CELL)
    lists = routed.repartition("cell").sortWithinPartitions("cell").mapInArrow(meet, "a long, b array<long>, s array<float>")
    found = materialize(lists.repartition("a").sortWithinPartitions("a").mapInArrow(merge, "a long, b long, left int"))
    links = found.filter("left = 0").select("a", "b")
    doubt = found.filter("left > 0")
    if not doubt.isEmpty():
        wanted = materialize(doubt.select(F.col("a").alias("id")).union(doubt.select("b")).distinct())
        exact = materialize(core.select("id", "key", F.transform("v", lambda x: x.cast("double")).alias("v")).join(wanted, "id", "left_semi").dropDuplicates(["id"]))
        both = doubt.join(exact.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(exact.select(F.col("id").alias("b"), "key", F.col("v").alias("vb")), "b")
        dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        both = both.withColumn("c", dot("va", "vb") / F.sqrt(dot("va", "va")) / F.sqrt(dot("vb", "vb")))
        place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), "key"))
        links = links.union(both.withColumn("r", place).filter("r <= left").select("a", "b"))
    if either:
        links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    names = core.select("id", "key").repartition("id").dropDuplicates(["id", "key"])
    named = links.join(names.select(F.col("id").alias("a"), F.col("key").alias("ka")), "a").join(names.select(F.col("id").alias("b"), F.col("key").alias("kb")), "b").select("ka", "kb")
    if surplus:
        named = named.union(surplus[1])
    first, second = (F.least("ka", "kb"), F.greatest("ka", "kb")) if either else (F.col("ka"), F.col("kb"))
    return named.select(first.alias("key_a"), second.alias("key_b"))


def recall(df: DataFrame, found: DataFrame, asked: Column, key: str, vector: str, model: str, dims: str, k: int = 5) -> DataFrame:
    """One row: n_asked, n_true, n_found: how many of the k nearest of the vectors for which `asked` holds, by comparison with
    all vectors in double precision, are among the pairs `found` (key_a, key_b).

    The vectors asked for are sent to all others in portions of ASKED, and only the k best of each task come back."""
    rows = _valid(df, key, vector, model, dims).select("key", "kind", F.transform("v", lambda x: x.cast("double")).alias("v"))
    wanted = materialize(rows.join(df.filter(asked).select(F.col(key).alias("key")).distinct(), "key", "left_semi").dropDuplicates(["key"]))
    parts = max(1, -(-wanted.count() // ASKED))
    best = None
    for part in range(parts):
        held = df.sparkSession.sparkContext.broadcast([(r.key, r.kind, np.array(r.v) / np.linalg.norm(r.v)) for r in wanted.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).collect()])  # about ASKED rows

        def near(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            kinds: dict[tuple[int, int], list] = {}
            for name, kind, v in held.value:
                kinds.setdefault((kind, len(v)), []).append((name, v))
            kept: dict[object, dict] = {}
            for batch in batches:
                names = batch.column(0).to_pylist()
                for kind, d, at, x in _unit(batch, 2):
                    if (kind, d) not in kinds or not len(x):
                        continue
                    cosine = np.array([v for _, v in kinds[kind, d]]) @ x.T
                    for (name, _), row in zip(kinds[kind, d], cosine):
                        mine = kept.setdefault(name, {})
                        for j in np.flatnonzero(row >= np.partition(row, -min(k + 2, len(row)))[-min(k + 2, len(row))]).tolist():
                            if names[at[j]] != name:
                                mine[names[at[j]]] = row[j]
                        if len(mine) > 4 * k:
                            kept[name] = dict(sorted(mine.items(), key=lambda e: (-e[1], e[0]))[:k])
            out = [(a, b, c) for a, mine in kept.items() for b, c in sorted(mine.items(), key=lambda e: (-e[1], e[0]))[:k]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["key_a", "key_b", "c"])

        kind = rows.schema["key"].dataType.simpleString()
        lists = rows.mapInArrow(near, f"key_a {kind}, key_b {kind}, c double").dropDuplicates(["key_a", "key_b"])
        best = lists if best is None else best.union(lists)
    place = F.row_number().over(Window.partitionBy("key_a").orderBy(F.desc("c"), "key_b"))
    true = best.withColumn("r", place).filter(F.col("r") <= k).select("key_a", "key_b")
    both = true.join(found.select("key_a", "key_b", F.lit(1).alias("hit")).distinct(), ["key_a", "key_b"], "left")
    return both.agg(F.count_distinct("key_a").alias("n_asked"), F.count("*").alias("n_true"), F.count("hit").alias("n_found"))
