"""Mixing sources to target weights by capped water-filling (problem 7)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.llm.tokens import folded, token_count
from folioscope.session import materialize

#: Hash bins a source is cut into, by which the fractional repetition is drawn.
BINS = 4096


@dataclass
class Share:
    source: str
    target_share: float
    max_repeats: int
    tokens: int
    capacity: int
    falls_short: bool = False
    clamped: bool = False
    epochs: float = 0.0


def water_fill(shares: list[Share], total: float) -> list[Share]:
    """Set epochs so that the mix has `total` tokens, or as many as the caps allow.

    A source whose wanted size exceeds its capacity (tokens x max_repeats) is clamped there; what it lacks goes to the
    free sources in proportion to their targets, again and again until none exceeds its capacity.
    """
    for s in shares:
        s.falls_short = s.capacity < s.target_share * total
    free, want = list(shares), {}
    while free:
        left = total - sum(s.capacity for s in shares if s.clamped)
        weight = sum(s.target_share for s in free)
        want = {s.source: (left * s.target_share / weight if weight > 0 else 0.0) for s in free}
        over = [s for s in free if want[s.source] > s.capacity]
        if not over:
            break
        for s in over:
            s.clamped = True
        free = [s for s in free if not s.clamped]
    for s in shares:
        size = s.capacity if s.clamped else max(0.0, want.get(s.source, 0.0))
        s.epochs = size / s.tokens if s.tokens else 0.0
    return shares


def sized(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Documents of a targeted source: key, folded source, tokens. Other, null and unknown sources are left out."""
    names = targets.select(folded("source").alias("__s"), F.col("source").alias("__source")).dropDuplicates(["__s"])
    rows = documents.select(F.col(key).alias("__key"), folded(source).alias("__s"), token_count(text).cast("long").alias("__tokens"))
    return rows.join(names, "__s").select(F.col("__key").alias(key), F.col("__source").alias("source"), F.col("__tokens").alias("tokens"))


def plan_mix(docs: DataFrame, targets: DataFrame, total: float | None = None) -> list[Share]:
    """The share of every target. One aggregation of docs to a row per target; the targets are a hand-written list."""
    have = docs.groupBy("source").agg(F.sum("tokens").alias("t"))
    rows = targets.join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("t", F.lit(0)).alias("t")).collect()
    shares = [Share(r.source, r.target_share or 0.0, m := max(0, r.max_repeats or 0), r.t, r.t * m) for r in sorted(rows, key=lambda r: r.source or "")]
    return water_fill(shares, sum(s.tokens for s in shares) if total is None else total)


def mix(docs: DataFrame, shares: list[Share], key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Chosen documents with `repeats` >= 1: key, source, tokens, repeats.

    Every document of a source is taken floor(epochs) times. The fraction left is drawn by a seeded hash of the key in
    BINS bins: bins are taken in order while more than half of their tokens fits into the fraction, so the reached size misses
    the wanted one by at most half a bin, whatever the number of documents. Rows with the same key are drawn together. A source
    without documents adds nothing; empty documents give an empty mix.
    """
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s.source, int(s.epochs), (s.epochs - int(s.epochs)) * s.tokens) for s in shares], "source string, whole int, rest double")
    rows = docs.withColumn("__bin", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(BINS)))
    bins = rows.groupBy("source", "__bin").agg(F.sum("tokens").alias("__t"))  # at most BINS rows a source
    upto = Window.partitionBy("source").orderBy("__bin")
    drawn = bins.join(F.broadcast(plan), "source").withColumn("__upto", F.sum("__t").over(upto))
    drawn = drawn.filter(F.col("__upto") - F.col("__t") / 2 <= F.col("rest")).filter("rest > 0").groupBy("source").agg(F.max("__bin").alias("__last"))
    cut = plan.join(drawn, "source", "left").select("source", "whole", F.coalesce("__last", F.lit(-1)).alias("__last"))  # a row per target
    chosen = rows.join(F.broadcast(cut), "source").withColumn("repeats", F.col("whole") + (F.col("__bin") <= F.col("__last")).cast("int"))
    return chosen.filter("repeats > 0").select(key, "source", "tokens", "repeats")


def report(chosen: DataFrame, shares: list[Share]) -> DataFrame:
    """Per target: what was wanted, what the mix reached, and whether the source falls short of its target."""
    spark = chosen.sparkSession
    plan = spark.createDataFrame(
        [(s.source, s.target_share, s.tokens, s.capacity, s.epochs, s.clamped, s.falls_short) for s in shares],
        "source string, target_share double, tokens long, capacity long, epochs double, clamped boolean, falls_short boolean",
    )
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.count("*").alias("mixed_documents"))
    both = materialize(plan.join(got, "source", "left").fillna(0, ["mixed_tokens", "mixed_documents"]))  # a row per target
    total = both.agg(F.sum("mixed_tokens")).first()[0] or 0
    return both.withColumn("reached_share", F.col("mixed_tokens") / float(total) if total else F.lit(0.0))
