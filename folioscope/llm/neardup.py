"""Near-duplicate texts by a count-vector R-tree (problem 3).

A text is the set of its word sequences (shingles), as 64-bit hashes. The shingles are hashed into DIMS groups; how many
fall into each group is the text's count vector, a point. Two texts can share at most the sum over the groups of the
smaller count, so a pair, or two boxes of points, whose bound lies below the overlap that the similarity asks for is cut.

So that the points need not all meet in one place, they are routed: of the shingles ordered from rare to frequent a
text sends its point under each of the first |A| - ceil(t |A|) + 1. Similar texts meet under at least one of these, and
at the first shingle they have in common the shingles still to come bound the overlap too. Any fixed order is exact;
frequency is only what keeps the meeting points small, and is taken from a table of `counters` counters over all texts.
Shingles that are really sent by more than BLOCK texts are counted one by one where counters are too coarse for that, and
only these have their meeting point split into blocks that meet pairwise. In each meeting point an R-tree of boxes is built
and joined with itself. Surviving pairs are bounded again by count vectors over as many groups as the texts are long, and
then verified on the whole shingle sets. Texts with equal sets share a fingerprint; every text is listed under it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.groups import Bytes, in_blocks
from folioscope.session import broadcast_if_small, materialize

DIMS = 64
#: Counters of the order of shingles, a byte each once they are added up. A table for tens of GB of text; for more, raise it:
#: a coarser order makes meeting points larger, never the result another.
COUNTERS = 1 << 20
#: Counters that travel together.
RANGE = 1024
LEAF = 64
#: A shingle under which more texts than this meet is split into blocks, and pairs of blocks meet.
BLOCK = 8192
#: Shingles are split by their counters, which also count others, as long as this share of all shingles at most is copied by that.
SPARE = 0.1
#: Of the fingerprints in pairs 16 bits each are sent to all tasks, so that only their sets are shuffled; up to 2 to the power of this, 32 MB.
MOST_BITS = 28
#: Texts equal to the byte: up to this many are listed pair by pair, more of them each with the smallest id only.
EXPAND = 1000
WORDS = re.compile(r"[a-z0-9]+")
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * M1
    z = (z ^ (z >> np.uint64(27))) * M2
    return z ^ (z >> np.uint64(31))


class Shingler:
    """Shingle sets of many texts: sorted distinct hashes, one array after the other, with their offsets."""

    def __init__(self, words: int, least: int) -> None:
        self.words, self.least, self.known = words, least, {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that have at least `least` distinct shingles, and the offsets and hashes of their sets."""
        import xxhash

        known, ids, lengths = self.known, [], []
        if len(known) > 500_000:
            known.clear()
        for text in texts:
            found = WORDS.findall(text.lower()) if text else []
            for w in set(found).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            ids += [known[w] for w in found]
            lengths.append(len(found))
        h, n = np.array(ids, np.uint64), np.array(lengths, np.int64)
        row = np.repeat(np.arange(len(n)), n)
        if len(h) < self.words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
        value = np.zeros(len(h) - self.words + 1, np.uint64)
        for k in range(self.words):
            value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - self.words + 1 + k])
        same = row[: len(value)] == row[self.words - 1 :]
        value, owner = value[same], row[: len(same)][same]
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[keep], owner[keep]
        size = np.bincount(owner, minlength=len(n))
        good = size >= self.least
        rows = np.flatnonzero(good)
        return rows, np.concatenate([[0], np.cumsum(size[rows])]).astype(np.int64), value[good[owner]]


def fingerprints(value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 bits for each whole set: two sums of mixed hashes and the size."""
    if len(offsets) < 2:
        return np.zeros(0, np.int64)
    a, b = np.add.reduceat(mix64(value + np.uint64(1)), offsets[:-1]), np.bitwise_xor.reduceat(mix64(value + np.uint64(2)), offsets[:-1])
    return mix64(a + mix64(b + np.diff(offsets).astype(np.uint64))).view(np.int64)


def least_overlap(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Fewest shared shingles with which sets of these sizes reach Jaccard similarity t."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


class Tree:
    """An R-tree over the points of one meeting point: sorted by size, cut into leaves, each with its box."""

    def __init__(self, size: np.ndarray, left: np.ndarray, points: np.ndarray) -> None:
        self.size, self.left, self.points = size, left, points
        starts = np.arange(0, len(size), LEAF)
        self.ends = np.append(starts[1:], len(size))
        self.starts, self.high = starts, np.maximum.reduceat(points, starts, axis=0)
        self.least, self.most = size[starts], size[self.ends - 1]
        self.reach = np.maximum.reduceat(left, starts)

    def join(self, t: float, mine: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs i < j whose bound allows similarity t. mine: side of each point, to pair only across sides."""
        for p in range(len(self.starts)):
            later = np.arange(p, len(self.starts))
            need = least_overlap(self.least[p], self.least[later], t)
            fits = (t * self.least[later] <= self.most[p] + 1e-9) & (np.minimum(self.reach[p], self.reach[later]) >= need)
            fits &= np.minimum(self.high[p], self.high[later]).sum(1) >= need
            a = slice(self.starts[p], self.ends[p])
            for q in later[fits]:
                b = slice(self.starts[q], self.ends[q])
                need = least_overlap(self.size[a, None], self.size[None, b], t)
                ok = np.minimum(self.left[a, None], self.left[None, b]) >= need
                if p == q:
                    ok &= np.tri(len(ok), k=-1, dtype=bool).T
                if mine is not None:
                    ok &= mine[a, None] != mine[None, b]
                i, j = np.nonzero(ok)
                if len(i):
                    pass_ = np.minimum(self.points[a][i], self.points[b][j]).sum(1) >= need[i, j]
                    yield i[pass_] + a.start, j[pass_] + b.start


def coded(count: np.ndarray) -> np.ndarray:
    """Counts as bytes on a scale of 8 steps for each doubling, rounded up."""
    return np.ceil(8 * np.log2(count + 1.0) - 1e-9).clip(0, 255).astype(np.uint8)


def most_of(code: np.ndarray) -> np.ndarray:
    """The largest count that a code stands for."""
    return np.where(code == 255, np.inf, 2.0 ** (code / 8.0) - 1)


def _survey(rows: DataFrame, words: int, least: int, counters: int) -> DataFrame:
    """One row per text with enough shingles: id, fingerprint f, hash d of the text, size n, count vector z; and under a null id,
    numbered by f, the compressed counts of RANGE counters each that a task has added up over its texts."""
    import xxhash

    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, make, id_type = np.zeros(counters, np.uint32), Shingler(words, least), None
        names = ["id", "f", "d", "n", "z"]
        for batch in batches:
            texts, id_type = batch.column(1).to_pylist(), batch.column(0).type
            row, offsets, value = make(texts)
            total += np.bincount((value % np.uint64(counters)).astype(np.int64), minlength=counters).astype(np.uint32)
            mark = pa.array(np.array([xxhash.xxh3_64_intdigest(texts[r]) for r in row.tolist()], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(fingerprints(value, offsets)), mark, pa.array(np.diff(offsets)), pa.array(vectors(value, offsets), pa.binary())], names)
        if id_type is not None:
            parts = total.reshape(-1, RANGE)
            at = np.flatnonzero(parts.any(1))
            packed = [zlib.compress(parts[i].tobytes(), 1) for i in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), id_type), pa.array(at), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.array(packed, pa.binary())], names)

    return rows.mapInArrow(run, f"id {kind}, f long, d long, n long, z binary")


def _order(survey: DataFrame, counters: int) -> np.ndarray:
    """A code per counter: how many shingles of all texts fall into it, rounded up. The table has `counters` bytes for any corpus."""

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(RANGE, np.int64)
        for z in part.column("z"):
            total += np.frombuffer(zlib.decompress(z.as_py()), np.uint32)
        return pa.table({"f": part.column("f")[:1], "z": pa.array([coded(total).tobytes()], pa.binary())})

    out = np.zeros((counters // RANGE, RANGE), np.uint8)
    found = survey.filter("id is null").select("f", "z").groupBy("f").applyInArrow(add, "f long, z binary").toArrow()
    for f, z in zip(found.column("f").to_pylist(), found.column("z").to_pylist()):
        out[f] = np.frombuffer(z, np.uint8)
    return out.ravel()


def stepped(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of counts in steps of 2^scale, rounded up, so that none is above 15, and the scale of each row."""
    scale = np.ceil(np.log2(np.maximum(count.max(1), 15) / 15) - 1e-12).astype(np.int64)
    return (count + (1 << scale)[:, None] - 1) >> scale[:, None], scale


def vectors(value: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The count vector of each whole set, over a power of two of groups, at least half as many as it has shingles: a byte for
    the scale, then half bytes."""
    size = np.diff(offsets)
    dims = DIMS << np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) / 2 / DIMS) - 1e-12)).astype(np.int64)
    out: list[bytes] = [b""] * len(size)
    for d in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == d)
        for s in range(0, len(rows), max(1, 1_000_000 // d)):
            part = rows[s : s + max(1, 1_000_000 // d)]
            at = np.repeat(offsets[part] - np.cumsum(size[part]) + size[part], size[part]) + np.arange(size[part].sum())
            group = (value[at] >> np.uint64(24)) % np.uint64(d)
            count, scale = stepped(np.bincount(np.repeat(np.arange(len(part)), size[part]) * d + group.astype(np.int64), minlength=len(part) * d).reshape(-1, d))
            packed = np.concatenate([scale[:, None], count[:, ::2] << 4 | count[:, 1::2]], 1).astype(np.uint8)
            for r, row in zip(part.tolist(), packed):
                out[r] = row.tobytes()
    return out


def vector_bounds(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Most shingles that the sets of two count vectors can share, pair by pair; the one with more groups is folded."""
    out, la, lb = np.zeros(len(a), np.int64), np.array([len(x) for x in a]), np.array([len(x) for x in b])
    for m, n in sorted(set(zip(la.tolist(), lb.tolist()))):
        rows = np.flatnonzero((la == m) & (lb == n))
        for s in range(0, len(rows), max(1, 4_000_000 // max(m, n))):
            part = rows[s : s + max(1, 4_000_000 // max(m, n))].tolist()
            sides = []
            for x, size in ((a, m), (b, n)):
                raw = np.frombuffer(b"".join(x[i] for i in part), np.uint8).reshape(-1, size)
                count = np.empty((len(part), 2 * size - 2), np.int64)
                count[:, ::2], count[:, 1::2] = raw[:, 1:] >> 4, raw[:, 1:] & 15
                sides.append((count << raw[:, :1].astype(np.int64)).reshape(len(part), -1, 2 * min(m, n) - 2).sum(1))
            out[part] = np.minimum(*sides).sum(1)
    return out


def _points(value: np.ndarray, owner: np.ndarray, sent: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
    """For each shingle sent, the counts per group of it and all later shingles of its text, in half bytes, and their scale.

    At the first shingle that two texts share, none before it is shared, so these counts bound their overlap. Counts above
    15 are kept in steps of 2^scale, rounded up."""
    group = ((value >> np.uint64(24)) % np.uint64(DIMS)).astype(np.int64)
    whole = np.bincount(owner * DIMS + group, minlength=n * DIMS).reshape(n, DIMS)
    large = whole.max(1, initial=0) > 15
    at = np.flatnonzero(sent)
    parts, scales = [], []
    for s in range(0, len(at), 100_000):
        part = at[s : s + 100_000]
        who = owner[part]
        hot = np.zeros((len(part), DIMS), np.int32)
        hot[np.arange(1, len(part)), group[part[:-1]]] = 1
        new = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        gone = np.cumsum(hot, axis=0, dtype=np.int32)
        lead = gone[new]
        if s and owner[at[s - 1]] == who[0]:  # the text began in the part before
            before = at[(owner[at[:s]] == who[0]).nonzero()[0]]
            lead[0] -= np.bincount(group[before], minlength=DIMS).astype(np.int32)
        left = whole[who] - (gone - np.repeat(lead, np.diff(np.append(new, len(part))), axis=0))
        scale, rest = np.zeros(len(part), np.int64), np.flatnonzero(large[who])
        if len(rest):
            left[rest], scale[rest] = stepped(left[rest])
        left = left.astype(np.uint8)
        parts.append(left[:, ::2] << 4 | left[:, 1::2])
        scales.append(scale)
    packed = np.concatenate(parts) if parts else np.zeros((0, DIMS // 2), np.uint8)
    buffers = [None, pa.py_buffer((np.arange(len(packed) + 1) * (DIMS // 2)).astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(packed), buffers), np.concatenate(scales) if scales else np.zeros(0, np.int64)


def unpacked(packed: np.ndarray, scale: np.ndarray) -> np.ndarray:
    point = np.empty((len(packed), DIMS), np.int16 if scale.max(initial=0) <= 10 else np.int32)
    point[:, ::2], point[:, 1::2] = packed >> 4, packed & 15
    if scale.any():
        point <<= scale.astype(point.dtype)[:, None]
    return point


class Router:
    """Where the texts of a batch go: the shingles each is sent under, of the fingerprints that the task has not sent yet."""

    def __init__(self, order: np.ndarray, t: float, words: int, least: int) -> None:
        self.order, self.t, self.make, self.sent = order, t, Shingler(words, least), set()

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, ...] | None:
        row, offsets, value = self.make(texts)
        size = np.diff(offsets)
        if not len(size):
            return None
        mark = fingerprints(value, offsets)
        first = np.unique(mark, return_index=True)[1]
        first = first[[m not in self.sent for m in mark[first].tolist()]]
        if len(self.sent) > 1_000_000:
            self.sent.clear()
        self.sent.update(mark[first].tolist())
        owner = np.repeat(np.arange(len(size)), size)
        often = self.order[(value % np.uint64(len(self.order))).astype(np.int64)]
        turn = np.lexsort((value, often, owner))
        value, often = value[turn], often[turn]
        rank = np.arange(len(value)) - np.repeat(offsets[:-1], size)
        once = np.zeros(len(size), bool)
        once[first] = True
        sent = (rank < (size - np.ceil(self.t * size - 1e-9) + 1)[owner]) & once[owner]
        return row, size, mark, value, often, owner, rank, sent


def _crowds(rows: DataFrame, order, t: float, words: int, least: int) -> DataFrame:
    """k, c: the shingles that more than BLOCK texts are sent under, counted one by one. Only those whose counter promises as many are looked at."""
    open_ = most_of(np.arange(256)) > BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route = Router(order.value, t, words, least)
        for batch in batches:
            if (found := route(batch.column(1).to_pylist())) is not None:
                _, _, _, value, often, _, _, sent = found
                k, c = np.unique(value[sent & open_[often]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], ["k", "c"])

    return rows.mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")).filter(F.col("c") > BLOCK)


def _route(rows: DataFrame, order, t: float, words: int, least: int) -> DataFrame:
    """A row for each meeting point of each text: key, fingerprint, sizes m (shingles, shingles left, scale of the point) and
    packed point. If rows have a label column, it goes along; a text without a label has its fingerprint as one."""
    labelled = "label" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        route = Router(order.value, t, words, least)
        for batch in batches:
            if (found := route(batch.column(1).to_pylist())) is None:
                continue
            row, size, mark, value, _, owner, rank, sent = found
            packed, scale = _points(value, owner, sent, len(size))
            who = owner[sent]
            m = size[who] << 34 | (size[who] - rank[sent]) << 5 | scale
            columns = [pa.array(value[sent].view(np.int64)), pa.array(mark[who]), pa.array(m), packed]
            if labelled:
                label = np.array([g if g is not None else f for g, f in zip(batch.column(2).take(pa.array(row)).to_pylist(), mark.tolist())], np.int64)
                columns.append(pa.array(label[who]))
            yield pa.RecordBatch.from_arrays(columns, ["k", "f", "m", "p", "label"][: len(columns)])

    return rows.mapInArrow(run, "k long, f long, m long, p binary" + (", label long" if labelled else ""))


def _split(routed: DataFrame, crowds: DataFrame) -> DataFrame:
    """Crowded meeting points cut into blocks: a text goes to each pair of blocks that its own is in, with the side it is on.

    crowds: (k, c), how many meet under a shingle; or (at, mask, c), at most how many under any that falls into a counter."""
    if "at" in crowds.columns:
        both = routed.join(broadcast_if_small(crowds), F.col("k").bitwiseAND(F.lit(crowds.first().mask)) == F.col("at"), "left").drop("at", "mask")
    else:
        both = routed.join(broadcast_if_small(crowds), "k", "left")
    return in_blocks(both, "k", "f", "c", BLOCK)


def _meet(routed: DataFrame, t: float, star: bool = False) -> DataFrame:
    """Distinct pairs of fingerprints that survive the bounds; of labelled ones only those with different labels.

    star: at each meeting point a text is paired with one only, the smallest of those it may be similar to."""
    sided, labelled = "side" in routed.columns, "label" in routed.columns

    def leaves(key, f, size, left, scale, side, label, packed) -> tuple[np.ndarray, np.ndarray] | None:
        """Meeting points of up to LEAF texts, each a single leaf: all of a batch at once, neighbour by neighbour."""
        last = np.searchsorted(key, key, side="right")
        point, out, i, d = unpacked(packed, scale), [], np.arange(len(key)), 0
        while True:
            d += 1
            i = i[i + d < last[i]]
            if not len(i):
                break
            j = i + d
            need = least_overlap(size[i], size[j], t)
            ok = (np.minimum(left[i], left[j]) >= need) & (f[i] != f[j])
            if sided:
                ok &= (side[i] == 0) | (side[i] != side[j])
            if labelled:
                ok &= label[i] != label[j]
            a, b, need = i[ok], j[ok], need[ok]
            ok = np.minimum(point[a], point[b]).sum(1) >= need
            out.append((a[ok], b[ok]))
        return pairs_of(f, np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])) if out else None

    def pairs_of(f, i, j) -> tuple[np.ndarray, np.ndarray]:
        if star:
            order = np.lexsort((i, j))
            i, j = i[order], j[order]
            first = np.ones(len(j), bool)
            first[1:] = j[1:] != j[:-1]
            i, j = i[first], j[first]
        return f[i], f[j]

    def tree(f, size, left, scale, side, label, packed) -> tuple[np.ndarray, np.ndarray] | None:
        _, first = np.unique(f, return_index=True)
        pick = first[np.argsort(size[first], kind="stable")]
        f, side, size, label = f[pick], side[pick], size[pick], label[pick]
        found = [(i[ok], j[ok]) for i, j in Tree(size, left[pick], unpacked(packed[pick], scale[pick])).join(t, side if side.any() else None) for ok in [label[i] != label[j] if labelled else slice(None)]]
        return pairs_of(f, np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[tuple[np.ndarray, ...]] = []

        def close(end: bool) -> None:
            """Handle all whole meeting points that are held; the last one waits, unless it is the end."""
            nonlocal held
            columns = [np.concatenate(c) for c in zip(*held)] if len(held) > 1 else list(held[0])
            key = columns[0]
            cut = len(key) if end else int(np.searchsorted(key, key[-1]))
            held = [tuple(c[cut:].copy() for c in columns)] if cut < len(key) else []
            columns = [c[:cut] for c in columns]
            if not cut:
                return
            edge = np.flatnonzero(np.diff(columns[0])) + 1
            starts, ends = np.concatenate([[0], edge]), np.append(edge, cut)
            small = np.repeat((ends - starts > 1) & (ends - starts <= LEAF), ends - starts)
            hits = [leaves(*(c[small] for c in columns))] if small.any() else []
            hits += [tree(*(c[s:e] for c in columns[1:])) for s, e in zip(starts.tolist(), ends.tolist()) if e - s > LEAF]
            found.extend(h for h in hits if h is not None and len(h[0]))

        for batch in batches:
            if not batch.num_rows:
                continue
            key, f, m = (batch.column(c).to_numpy() for c in ("k", "f", "m"))
            side = batch.column("side").to_numpy() if sided else np.zeros(len(key), np.int8)
            label = batch.column("label").to_numpy() if labelled else f
            held.append((key, f, (m >> 34).astype(np.float32), (m >> 5 & (1 << 29) - 1).astype(np.float32), m & 31, side, label, Bytes(batch.column("p"))[0 : len(key)]))
            if key[0] != key[-1] or held[0][0][0] != key[0]:
                close(False)
            else:
                held[-1] = tuple(c.copy() for c in held[-1])
            if sum(len(x[0]) for x in found) > 400_000:
                yield flush(found)
                found.clear()
        if held:
            close(True)
        if found:
            yield flush(found)

    def flush(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        a, b = (np.concatenate(c) for c in zip(*found))
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["fa", "fb"])

    return routed.repartition("k").sortWithinPartitions("k").mapInArrow(run, "fa long, fb long").distinct()


def _bitmap(marks: DataFrame) -> np.ndarray:
    """A bit for each value of the low bits of the fingerprints f: about 16 bits a fingerprint, at most MOST_BITS in all."""
    bits = 1 << min(MOST_BITS, max(16, math.ceil(math.log2(16 * max(1, marks.count())))))
    part = 1 << 13

    def pack(rows: pa.Table) -> pa.Table:
        seen = np.zeros(part, bool)
        seen[rows.column("at").to_numpy()] = True
        return pa.table({"r": rows.column("r")[:1], "z": pa.array([np.packbits(seen, bitorder="little").tobytes()], pa.binary())})

    low = F.col("f").bitwiseAND(F.lit(bits - 1))
    found = marks.select(F.floor(low / part).cast("int").alias("r"), (low % part).cast("int").alias("at")).distinct().groupBy("r").applyInArrow(pack, "r int, z binary").toArrow()
    out = np.zeros((bits // part, part // 8), np.uint8)
    for r, z in zip(found.column("r").to_pylist(), found.column("z").to_pylist()):
        out[r] = np.frombuffer(z, np.uint8)
    return out.ravel()


def _sets(rows: DataFrame, words: int, least: int, bitmap) -> DataFrame:
    """Fingerprint and sorted shingle set of every text with enough shingles whose fingerprint the bitmap may know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, known = Shingler(words, least), bitmap.value
        for batch in batches:
            _, offsets, value = make(batch.column(1).to_pylist())
            mark = fingerprints(value, offsets)
            at = mark & (8 * len(known) - 1)
            sets = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value.view(np.int64)))
            wanted = pa.array((known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0)
            yield pa.RecordBatch.from_arrays([pa.array(mark), sets], ["f", "s"]).filter(wanted)

    return rows.mapInArrow(run, "f long, s array<bigint>")


class Search:
    """The texts of df under the fingerprints of their sets (members: id, f, hash d of the text), and the links among these.

    Null keys, null texts and texts with fewer than `least` distinct shingles are left out; a key that is repeated with equal
    text counts once. Empty input gives two empty tables. counters: size of the table of the order, a power of two."""

    def __init__(self, df: DataFrame, key: str, text: str, t: float, words: int, least: int, counters: int = COUNTERS) -> None:
        if counters < RANGE or counters & (counters - 1):
            raise ValueError(f"counters must be a power of two from {RANGE} on")
        self.t, self.words, self.least = t, words, least
        self.rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
        survey = materialize(_survey(self.rows, words, least, counters))
        self.texts = survey.filter("id is not null")
        self.members = self.texts.select("id", "f", "d").distinct()
        table = _order(survey, counters)
        self.order = df.sparkSession.sparkContext.broadcast(table)
        self.crowds = self._crowds(most_of(table))

    def _crowds(self, most: np.ndarray) -> DataFrame | None:
        """Which shingles to split: by their counters, if that copies next to nothing, else by counting them."""
        crowded = np.flatnonzero(most > BLOCK)
        if not len(crowded):
            return None
        if np.isfinite(most).all() and (most[crowded] * (np.ceil(most[crowded] / BLOCK) - 1)).sum() <= SPARE * most.sum():
            rows = [(int(i), len(most) - 1, int(most[i])) for i in crowded]
            return self.rows.sparkSession.createDataFrame(rows, "at long, mask long, c long")
        crowds = materialize(_crowds(self.rows, self.order, self.t, self.words, self.least))
        return None if crowds.isEmpty() else crowds

    def links(self, labels: DataFrame | None = None, star: bool = False) -> DataFrame:
        """fa < fb, similarity >= t. labels (id, label): only links between texts of different labels. star: not all links,
        but at least one for each text that has any to a smaller one under the same shingle."""
        rows = self.rows if labels is None else self.rows.join(broadcast_if_small(labels), "id", "left").select("id", "text", "label")
        routed = _route(rows, self.order, self.t, self.words, self.least)
        if self.crowds is not None:
            routed = _split(routed, self.crowds)
        pairs = materialize(self._possible(_meet(routed, self.t, star)))
        wanted = materialize(pairs.select(F.col("fa").alias("f")).union(pairs.select("fb")).distinct())
        bitmap = self.rows.sparkSession.sparkContext.broadcast(_bitmap(wanted))
        sets = _sets(self.rows, self.words, self.least, bitmap).join(wanted, "f", "left_semi").dropDuplicates(["f"])
        both = pairs.join(sets.select(F.col("f").alias("fa"), F.col("s").alias("sa")), "fa").join(sets.select(F.col("f").alias("fb"), F.col("s").alias("sb")), "fb")
        links = both.withColumn("o", F.size(F.array_intersect("sa", "sb"))).withColumn("similarity", F.col("o") / (F.size("sa") + F.size("sb") - F.col("o")))
        return materialize(links.filter(F.col("similarity") >= self.t - 1e-12).select("fa", "fb", "similarity"))

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs that the count vectors of the whole sets allow, too."""
        t, of = self.t, self.texts.select("f", "n", "z").dropDuplicates(["f"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                na, nb, a, b = (batch.column(c) for c in ("na", "nb", "za", "zb"))
                ok = vector_bounds(a.to_pylist(), b.to_pylist()) >= least_overlap(na.to_numpy(), nb.to_numpy(), t)
                yield batch.select(["fa", "fb"]).filter(pa.array(ok))

        for side in "ab":
            pairs = pairs.join(of.select(F.col("f").alias(f"f{side}"), F.col("n").alias(f"n{side}"), F.col("z").alias(f"z{side}")), f"f{side}")
        return pairs.mapInArrow(run, "fa long, fb long")


def near_duplicate_pairs(df: DataFrame, key: str, text: str, t: float = 0.8, words: int = 5, least: int = 1, expand: int = EXPAND, counters: int = COUNTERS) -> DataFrame:
    """id_a < id_b of every two texts with similarity >= t, equal ones included. See Search for what is left out.

    Where more than `expand` texts are the same to the byte, they are not written out as all pairs: each is paired with the
    smallest id of them, and that id alone stands for them in pairs with other texts. No other pair is left out."""
    search = Search(df, key, text, t, words, least, counters)
    members, links = search.members, search.links()
    copies = members.groupBy("f", "d").agg(F.count("*").alias("size"), F.min("id").alias("rep")).filter(F.col("size") > expand)
    tagged = materialize(members.join(copies, ["f", "d"], "left"))
    star = tagged.filter("size is not null and id > rep").select(F.col("rep").alias("id_a"), F.col("id").alias("id_b"))
    shown = tagged.filter("size is null or id = rep").select("f", "id")
    equal = shown.alias("a").join(shown.alias("b"), (F.col("a.f") == F.col("b.f")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    cross = links.join(shown.select(F.col("f").alias("fa"), F.col("id").alias("ia")), "fa").join(shown.select(F.col("f").alias("fb"), F.col("id").alias("ib")), "fb").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).filter("id_a < id_b")
    return cross.union(equal).union(star).distinct()


def near_duplicate_groups(df: DataFrame, key: str, text: str, t: float = 0.8, words: int = 5, least: int = 1, counters: int = COUNTERS) -> DataFrame:
    """A row per text: id, group_id (the smallest id that chains of similar texts reach). See Search for what is left out.

    A family of m texts has up to m^2 / 2 links, of which a group needs m - 1. So the texts meet twice: first each is linked
    with one other per meeting point, which joins almost all; then only texts of different groups are paired and verified."""
    search = Search(df, key, text, t, words, least, counters)
    first = search.links(star=True)
    labels = materialize(components(first.select(F.col("fa").alias("a"), F.col("fb").alias("b"))))
    of_id = search.members.join(labels.withColumnRenamed("node", "f"), "f", "left").groupBy("id").agg(F.min(F.coalesce("label", "f")).alias("label"), F.max(F.coalesce("label", "f")).alias("other"))
    second = search.links(materialize(of_id.filter("label = other").select("id", "label").join(labels.select("label").distinct(), "label", "left_semi")))
    merged = first.union(second).select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    named = search.members.join(components(merged).withColumnRenamed("node", "f"), "f", "left").select("id", F.coalesce("label", "f").alias("label"))
    return named.join(named.groupBy("label").agg(F.min("id").alias("group_id")), "label").select("id", "group_id").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component), by alternating large and small stars until nothing changes."""
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        sides = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sides.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        after = materialize(large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small).filter("a <> b").distinct())
        same = after.count() == now.count() and after.join(now, ["a", "b"], "left_anti").isEmpty()
        now = after
        if same:
            break
    roots = now.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()).groupBy("node").agg(F.min("label").alias("label"))
