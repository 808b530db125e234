"""Items that appear together, measured against a fitted bipartite null model (problem 4).

Pairs are counted exactly. The null keeps every item's frequency and every basket's size in expectation: item i is in
basket j with probability x_i y_j / (1 + x_i y_j). Items of the same frequency share x and baskets of the same size
share y, so the model is fitted to two histograms, not to the rows; numbers above FINE are put together in classes that are
a hundredth wide. Under it a pair's count is a sum of binomials, one per basket size, whose upper tail is taken by a lattice
saddle point; false discoveries are controlled over all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import broadcast_if_small, materialize

#: q-values are exact to this step of -log10 p, and everything beyond LAST counts as LAST.
STEP, LAST = 0.01, 1000.0
#: Frequencies and sizes up to this are classes of their own; beyond, a class is a hundredth wide. So there are never more than some 2,500.
FINE = 256
#: A basket of more items than this is cut into blocks, and its pairs into pairs of blocks.
BASKET = 1000
#: Pairs that are scored together.
TOGETHER = 2048


def class_of(n: Column) -> Column:
    return F.when(n <= FINE, n).otherwise(FINE + 1 + F.floor(F.log(n / float(FINE)) / math.log(1.01))).cast("int")


def histogram(rows: DataFrame, number: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per class of the numbers, ascending: the class, the mean number in it, how many rows it has."""
    found = rows.groupBy(class_of(F.col(number)).alias("at")).agg(F.avg(number).alias("mean"), F.count("*").alias("c")).orderBy("at").collect()  # some 2,500 at most
    return np.array([r["at"] for r in found], int), np.array([r["mean"] for r in found], float), np.array([r["c"] for r in found], float)


def fit_null(degrees: np.ndarray, items: np.ndarray, sizes: np.ndarray, baskets: np.ndarray, rounds: int = 100_000, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """x per degree and y per size, so that expected degrees and sizes equal the given ones.

    Goes on until no x moves by more than `tol` of itself, and raises ArithmeticError if `rounds` are not enough."""
    total = float((degrees * items).sum())
    x, y = degrees / math.sqrt(total), sizes / math.sqrt(total)
    for _ in range(rounds):
        new = np.minimum(degrees / (baskets * y / (1 + x[:, None] * y)).sum(1), 1e12)
        y = np.minimum(sizes / ((items * new)[:, None] / (1 + new[:, None] * y)).sum(0), 1e12)
        done = np.max(np.abs(new - x) / new) < tol
        x = new
        if done:
            return x, y
    raise ArithmeticError("the null model does not settle")


def upper_tail(n: np.ndarray, q: np.ndarray, h: np.ndarray) -> np.ndarray:
    """-log10 P(X >= n) for X a sum of Binomial(h_k, q_k), one row of q per n."""
    mean = (q * h).sum(1)
    q = np.clip(q, 1e-300, 1 - 1e-12)
    top = h.sum()
    target = np.minimum(n, top - 1e-6 * top)
    t = np.zeros(len(n))
    high = n > mean
    lo, hi = np.zeros(len(n)), np.full(len(n), 1.0)
    logit = np.log(q) - np.log1p(-q)

    def moments(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(logit + t[:, None], -700, 700)))
        return (p * h).sum(1), (p * (1 - p) * h).sum(1)

    for _ in range(60):
        short = moments(hi)[0] < target
        if not short[high].any():
            break
        hi = np.where(short, hi * 2, hi)
    for _ in range(60):
        t = (lo + hi) / 2
        below = moments(t)[0] < target
        lo, hi = np.where(below, t, lo), np.where(below, hi, t)
    t = (lo + hi) / 2
    var = moments(t)[1]
    cumulant = (np.logaddexp(np.log1p(-q), np.log(q) + t[:, None]) * h).sum(1)
    w = np.sqrt(np.maximum(2 * (t * target - cumulant), 0))
    u = -np.expm1(-t) * np.sqrt(var)
    ok = high & (w > 1e-3) & (u > 1e-6)
    w, u = np.where(ok, w, 1.0), np.where(ok, u, 1.0)
    # log of the normal tail by its continued fraction, good for any w >= 0
    log_phi = -w * w / 2 - 0.5 * math.log(2 * math.pi)
    ratio = np.array([0.5 * math.erfc(v / math.sqrt(2)) / math.exp(-v * v / 2) * math.sqrt(2 * math.pi) if v < 25 else 1 / (v + 1 / (v + 2 / (v + 3 / v))) for v in w])
    mass = np.maximum(ratio + 1 / u - 1 / w, 1e-300)
    p = -(log_phi + np.log(mass)) / math.log(10)
    sd = np.sqrt(np.maximum((q * (1 - q) * h).sum(1), 1e-300))
    near = -np.log10([max(1e-300, 0.5 * math.erfc(z / math.sqrt(2))) for z in np.clip((n - 0.5 - mean) / sd, -30, 30)])
    return np.maximum(np.where(n > top, LAST, np.where(ok, p, near)), 0.0)


def shared_baskets(once: DataFrame) -> DataFrame:
    """item_a < item_b, n_ab of distinct rows (k, i): the rows are joined with themselves on the basket.

    In a basket of more than BASKET items these are hashed into blocks, and every two blocks meet under a key of their own, so
    that no key has more than about 2 BASKET rows. Counts are combined before they are shuffled."""
    sizes = once.groupBy("k").agg(F.count("*").alias("s"))
    large = materialize(sizes.filter(F.col("s") > BASKET))
    if large.isEmpty():
        left, right = once.withColumnRenamed("i", "item_a"), once.select("k", F.col("i").alias("item_b"))
        pairs = left.join(right, (left.k == right.k) & (F.col("item_a") < F.col("item_b")))
    else:
        rows = once.join(broadcast_if_small(large), "k", "left").withColumn("b", F.coalesce(F.ceil(F.col("s") / BASKET), F.lit(1)))
        rows = rows.withColumn("home", F.pmod(F.xxhash64("i"), "b")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)))
        rows = rows.select("k", F.least("home", "other").alias("u"), F.greatest("home", "other").alias("v"), "i", "home")
        left, right = rows.withColumnsRenamed({"i": "x", "home": "h"}), rows.withColumnsRenamed({"i": "y", "home": "g"})
        pairs = left.join(right, ["k", "u", "v"]).filter(F.when(F.col("u") == F.col("v"), F.col("x") < F.col("y")).otherwise((F.col("h") == F.col("u")) & (F.col("g") == F.col("v"))))
        pairs = pairs.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"))
    return pairs.groupBy("item_a", "item_b").agg(F.count("*").alias("n_ab"))


def cooccurrence(rows: DataFrame, basket: str, item: str, min_count: int = 1) -> DataFrame:
    """A row per pair of items that share at least `min_count` baskets: item_a < item_b, n_ab, n_a, n_b, n_baskets,
    lift (against independence), expected_null, surprise (-log10 of the tail), q_value (over all pairs of items).

    A basket counts an item once, however often it is repeated: repeats go before anything is shuffled by basket. Null
    baskets and items are left out. A frequent item stays cheap, a large basket is split. Empty rows give no pair.
    """
    spark = rows.sparkSession
    once = rows.select(F.col(basket).alias("k"), F.col(item).alias("i")).filter("k is not null and i is not null").dropDuplicates(["k", "i"])
    counted = shared_baskets(once).filter(F.col("n_ab") >= min_count)
    freq = materialize(once.groupBy("i").agg(F.count("*").alias("n")))
    at, d, e = histogram(freq, "n")
    _, s, h = histogram(once.groupBy("k").agg(F.count("*").alias("s")), "s")
    n_items, n_baskets = int(e.sum()), int(h.sum())
    of = lambda side: freq.select(F.col("i").alias(f"item_{side}"), F.col("n").alias(f"n_{side}"), class_of(F.col("n")).alias(f"c_{side}"))
    counted = counted.join(of("a"), "item_a").join(of("b"), "item_b")
    x, y = fit_null(d, e, s, h) if len(d) else (d, s)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for begin in range(0, len(whole), TOGETHER):
                pdf = whole.iloc[begin : begin + TOGETHER].reset_index(drop=True)
                odds = []
                for side in "ab":
                    c = np.searchsorted(at, pdf[f"c_{side}"].to_numpy())
                    odds.append((x[c] * pdf[f"n_{side}"].to_numpy() / d[c])[:, None] * y)
                q = odds[0] / (1 + odds[0]) * (odds[1] / (1 + odds[1]))
                pdf["expected_null"], pdf["surprise"] = (q * h).sum(1), np.minimum(upper_tail(pdf["n_ab"].to_numpy(float), q, h), LAST)
                yield pdf[["item_b", "item_a", "n_ab", "n_a", "n_b", "expected_null", "surprise"]]

    kind = rows.schema[item].dataType.simpleString()
    scored = materialize(counted.mapInPandas(run, f"item_b {kind}, item_a {kind}, n_ab long, n_a long, n_b long, expected_null double, surprise double") if len(d) else counted.select("item_b", "item_a", "n_ab", "n_a", "n_b", F.lit(0.0).alias("expected_null"), F.lit(0.0).alias("surprise")))
    scored = scored.withColumn("__bin", F.floor(F.col("surprise") / STEP).cast("int"))
    tested, seen, least, q_of = n_items * (n_items - 1) / 2, 0, [], {}
    for r in scored.groupBy("__bin").agg(F.count("*").alias("c")).orderBy(F.desc("__bin")).collect():  # at most LAST / STEP rows
        seen += r.c
        least.append((r["__bin"], min(1.0, 10 ** (-r["__bin"] * STEP) * tested / seen)))
    best = 1.0
    for b, q in reversed(least):
        best = min(best, q)
        q_of[b] = best
    table = spark.createDataFrame(sorted(q_of.items()), "__bin int, q_value double")
    lift = F.col("n_ab") * F.lit(float(n_baskets)) / (F.col("n_a").cast("double") * F.col("n_b"))
    return scored.join(F.broadcast(table), "__bin").select("item_a", "item_b", "n_ab", "n_a", "n_b", F.lit(n_baskets).cast("long").alias("n_baskets"), lift.alias("lift"), "expected_null", "surprise", "q_value")
