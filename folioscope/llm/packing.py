"""Filling fixed-capacity containers by pattern packing (problem 6).

Sizes are put into classes of `grain` tokens. All patterns of few classes that exactly fill a container are enumerated;
non-negative least squares fits how often each is used to the histogram of classes over all documents. Classes up to
`filler` stay out of the patterns, for the gaps of the rest. The documents are hashed into blocks of bounded size; each block
uses its share of every pattern, rounded down. A pattern is filled with items of its classes of which the last two are
chosen to add up to the capacity within `slack` tokens; if none do, its items stay. What is left is packed best-fit, largest
first, into the space that remains in open containers or into new ones.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import materialize

BLOCK_ROWS = 50_000


def patterns(units: int, parts: int, smallest: int = 1) -> np.ndarray:
    """Every multiset of at most `parts` classes smallest..units that adds up to `units`, as columns of multiplicities."""
    found: list[list[int]] = []

    def grow(left: int, largest: int, chosen: list[int]) -> None:
        if left == 0:
            found.append(chosen)
        elif len(chosen) < parts:
            room = parts - len(chosen)
            for c in range(min(left, largest), max(smallest - 1, (left - 1) // room), -1):
                grow(left - c, c, [*chosen, c])

    grow(units, units, [])
    out = np.zeros((units + 1, len(found)))
    for j, chosen in enumerate(found):
        for c in chosen:
            out[c, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 500) -> np.ndarray:
    """Least squares of a x = b with x >= 0, by an active set that gains the most promising column in turn."""
    n = a.shape[1]
    x, on = np.zeros(n), np.zeros(n, bool)
    for _ in range(steps):
        gain = a.T @ (b - a @ x)
        gain[on] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= 1e-9 * (1 + np.abs(b).max()):
            break
        on[j] = True
        while True:
            idx = np.flatnonzero(on)
            trial = np.linalg.lstsq(a[:, idx], b, rcond=None)[0]
            if (trial > 0).all():
                x[:] = 0
                x[idx] = trial
                break
            bad = trial <= 0
            ratio = x[idx][bad] / np.maximum(x[idx][bad] - trial[bad], 1e-300)
            x[idx] += ratio.min() * (trial - x[idx])
            on[idx[bad][ratio <= ratio.min()]] = False
            x[~on] = 0
            if not on.any():
                break
        if not on.any():
            break
    return x


class Stock:
    """Items by size, and as a number with a bit for each size that is there."""

    def __init__(self, sizes: np.ndarray) -> None:
        self.items: dict[int, list[int]] = defaultdict(list)
        for i in range(len(sizes) - 1, -1, -1):
            self.items[int(sizes[i])].append(i)
        self.mask = sum(1 << s for s in self.items)

    def most(self, size: int) -> int:
        """The largest size there is up to this one; -1 if there is none."""
        return (self.mask & ((1 << (size + 1)) - 1)).bit_length() - 1 if size >= 0 else -1

    def take(self, size: int) -> int:
        items = self.items[size]
        i = items.pop()
        if not items:
            self.mask &= ~(1 << size)
        return i

    def back(self, size: int, item: int) -> None:
        self.items[size].append(item)
        self.mask |= 1 << size

    def fill(self, chosen: tuple[int, ...], capacity: int, grain: int, slack: int) -> list[int] | None:
        """Items of the classes, largest class first, that fill a container but for `slack`; None leaves the stock as it was."""
        took: list[tuple[int, int]] = []
        room = capacity
        for c in chosen[:-2]:
            size = self.most(c * grain)
            if size <= (c - 1) * grain:
                break
            took.append((size, self.take(size)))
            room -= size
        else:
            best = (slack + 1, 0, 0)
            if len(chosen) == 1:
                last = self.most(room)
                best = min(best, (room - last, 0, last)) if last > 0 else best
            else:
                size = self.most(chosen[-2] * grain)
                while size > (chosen[-2] - 1) * grain and best[0]:
                    last = self.most(room - size)
                    if last > 0 and (last != size or len(self.items[size]) > 1):
                        best = min(best, (room - size - last, size, last))
                    size = self.most(size - 1)
            if best[0] <= slack:
                return [i for _, i in took] + [self.take(s) for s in best[1:] if s]
        for size, i in reversed(took):
            self.back(size, i)
        return None


def pack_block(sizes: np.ndarray, capacity: int, grain: int, columns: list[tuple[tuple[int, ...], int]], slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Container number of each size (0 < size <= capacity), and whether a pattern placed it. columns: patterns as classes,
    with their repeat count."""
    where, placed = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes), bool)
    stock = Stock(sizes)
    free: list[int] = []
    for chosen, repeats in columns:
        for _ in range(repeats):
            took = stock.fill(chosen, capacity, grain, slack)
            if took is None:
                break
            where[took], placed[took] = len(free), True
            free.append(capacity - int(sizes[took].sum()))
    open_at: dict[int, list[int]] = defaultdict(list)
    rooms = 0
    for j, room in enumerate(free):
        open_at[room].append(j)
        rooms |= 1 << room
    for i in np.lexsort((np.arange(len(sizes)), -sizes)).tolist():
        if where[i] >= 0:
            continue
        size = int(sizes[i])
        above = rooms >> size
        if above:
            fits = size + (above & -above).bit_length() - 1
            j = open_at[fits].pop()
            if not open_at[fits]:
                rooms &= ~(1 << fits)
        else:
            j, fits = len(free), capacity
            free.append(capacity)
        where[i] = j
        open_at[fits - size].append(j)
        rooms |= 1 << (fits - size)
    return where, placed


def pack(df: DataFrame, key: str = "doc_id", size: str = "tokens", capacity: int = 1024, grain: int = 16, parts: int = 4, filler: int = 4, slack: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per piece: key, container_id, piece_index, n_pieces, piece_tokens, token_offset, by_pattern.

    Only an item larger than the capacity is divided: into full pieces, each a container of its own, and a rest that is
    packed like an item. A size of 0, null or below goes into a container of its block as a piece of 0 tokens. Rows
    with the same key are one item, of their largest size; a null key counts as a key. No item gives no row.
    """
    if capacity < grain or capacity % grain:
        raise ValueError("capacity must be a multiple of grain")
    items = df.groupBy(F.col(key).alias("__key")).agg(F.greatest(F.coalesce(F.max(size), F.lit(0)), F.lit(0)).cast("long").alias("__n"))
    items = materialize(items).withColumn("__rest", F.when(F.col("__n") <= capacity, F.col("__n")).otherwise(F.col("__n") % capacity))
    histogram = items.groupBy("__rest").agg(F.count("*").alias("c")).collect()  # at most capacity + 1 rows
    total = sum(r.c for r in histogram)
    counts = np.zeros(capacity // grain + 1)
    for r in histogram:
        if r["__rest"] > 0:
            counts[-(-r["__rest"] // grain)] += r.c
    a = patterns(capacity // grain, parts, filler + 1)
    fitted = nnls(a[filler + 1 :], counts[filler + 1 :])
    blocks = max(1, -(-total // block_rows))
    used = sorted(((tuple(int(c) for c in np.repeat(np.arange(len(a)), a[:, j].astype(int)))[::-1], fitted[j] / blocks) for j in np.flatnonzero(fitted >= blocks)), key=lambda x: (-x[1], x[0]))
    columns = [(chosen, int(repeats)) for chosen, repeats in used]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["__n", "__key"], kind="stable", na_position="first").reset_index(drop=True)
        n, rest, block = group["__n"].to_numpy(), group["__rest"].to_numpy(), int(group["__block"].iloc[0])
        full = np.where(n > capacity, n // capacity, 0)
        pieces = full + ((rest > 0) | (n == 0))
        container = np.zeros(len(group), np.int64)
        placed, small = np.zeros(len(group), bool), rest > 0
        if small.any():
            container[small], placed[small] = pack_block(rest[small], capacity, grain, columns, slack)
        nxt = int(container.max()) + 1
        row = np.repeat(np.arange(len(group)), pieces)
        index = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole = index < full[row]
        number = np.where(whole, nxt + np.cumsum(whole) - 1, container[row])
        return pd.DataFrame({"__key": group["__key"].to_numpy()[row], "container_id": (block << 32) + number, "piece_index": index, "n_pieces": pieces[row], "piece_tokens": np.where(whole, capacity, rest[row]), "token_offset": index * capacity, "by_pattern": ~whole & placed[row]})

    kind = df.schema[key].dataType.simpleString()
    blocked = items.withColumn("__block", F.pmod(F.xxhash64(F.lit(6), "__key"), F.lit(blocks)))
    return blocked.groupBy("__block").applyInPandas(run, f"__key {kind}, container_id long, piece_index int, n_pieces int, piece_tokens long, token_offset long, by_pattern boolean").withColumnRenamed("__key", key)
