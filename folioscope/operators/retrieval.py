"""Ranked retrieval: nearest vectors, diversification, fusion of rankings, and its evaluation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an array column with `width` numbers, none of them null, and these as doubles."""
    length = column.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(np.nan_to_num(length, nan=-1) == width)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)
    return rows, flat


def nearest_rows(rows: DataFrame, query: list[float], key: str, vector: str, k: int = 10, metric: str = "cosine", carry: list[str] = ()) -> DataFrame:
    """key, distance and the `carry` columns of all rows of the k nearest keys of each batch; nothing else leaves its task."""
    q = np.array(query, np.float64)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, *carry)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _matrix(batch.column(1), len(q))
            with np.errstate(all="ignore"):
                d = 1 - (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum())) if metric == "cosine" else ((x - q) ** 2).sum(1)
            good = np.isfinite(d) & np.isfinite(x).all(1)
            at, d = at[good], d[good]
            size = 4 * k
            while True:  # ties at the edge come along; more are looked at if so many rows are repeats of fewer keys
                near = np.flatnonzero(d <= np.partition(d, size - 1)[size - 1]) if size < len(d) else np.arange(len(d))
                names = batch.column(0).take(pa.array(at[near])).to_pylist()
                best: dict = {}
                for name, v in zip(names, d[near].tolist()):
                    if name is not None and v < best.get(name, np.inf):
                        best[name] = v
                if len(best) >= k or len(near) == len(d):
                    break
                size *= 4
            kept = set(sorted(best, key=lambda n: (best[n], n))[:k])
            pick = near[[i for i, n in enumerate(names) if n in kept]] if kept else near[:0]
            out = batch.take(pa.array(at[pick]))
            yield pa.RecordBatch.from_arrays([out.column(0), pa.array(d[pick]), *(out.column(c) for c in carry)], [key, "distance", *carry])

    if not len(q):
        return rows.select(key, F.lit(0.0).alias("distance"), *carry).limit(0)
    names = ", ".join([f"{key} {kinds[key]}", "distance double", *(f"{c} {kinds[c]}" for c in carry)])
    return rows.select(key, vector, *carry).mapInArrow(run, names)


def nearest(rows: DataFrame, query: list[float], key: str, vector: str, k: int = 10, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """The k keys nearest to the query: key, distance (1 - cosine, or squared Euclidean), dense_rank. Rows without a comparable
    vector (another width, null, not finite, or zero for the cosine) are left out; a key that is repeated counts once, ties go
    to the smaller key."""
    rows = rows if where is None else rows.filter(where)
    best = nearest_rows(rows, query, key, vector, k, metric).groupBy(key).agg(F.min("distance").alias("distance")).orderBy("distance", key).limit(k)
    return best.withColumn("dense_rank", F.row_number().over(Window.orderBy("distance", key)))


def first_vector(rows: DataFrame, key: str, vector: str, width: int, group: str | None = None) -> tuple[object, list[float]]:
    """(group, vector): of the group with the most rows of this width (the last of equal ones by name; all rows without a group
    column), the vector of the smallest key that is finite and not zero; empty if there is none. One pass over the rows."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, group) if c}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        sizes: Counter = Counter()
        kind = None
        for batch in batches:
            at, x = _matrix(batch.column(1), width)
            kind = batch.column(0).type
            sizes.update(batch.column(2).to_pylist() if group else [None] * batch.num_rows)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            at, x = at[good], x[good]
            names = batch.column(0).take(pa.array(at)).to_pylist()
            groups = batch.column(2).take(pa.array(at)).to_pylist() if group else [None] * len(names)
            for i, (g, name) in enumerate(zip(groups, names)):
                if name is not None and (g not in best or name < best[g][0]):
                    best[g] = (name, x[i].tolist())
        for g, n in sizes.items():
            name, v = best.get(g, (None, None))
            yield pa.RecordBatch.from_arrays([pa.array([name], kind), pa.array([v], pa.list_(pa.float64())), pa.array([n]), pa.array([g], pa.string())], ["k", "v", "n", "g"])

    found = rows.select(key, vector, *([group] if group else [])).mapInArrow(run, f"k {kinds[key]}, v array<double>, n long, g string")
    first = found.groupBy("g").agg(F.sum("n").alias("n"), F.min(F.struct(F.col("k").isNull(), "k", "v")).alias("b")).orderBy(F.desc("n"), F.desc("g")).first()
    return (first.g, list(first.b.v) if first.b.v else []) if first else (None, [])


def first_per_source(ranked: DataFrame, source: str, rank: str, limit: int) -> DataFrame:
    """The best row of each source, in rank order, at most `limit` sources."""
    place = F.row_number().over(Window.partitionBy(source).orderBy(rank))
    return ranked.withColumn("__p", place).filter("__p = 1").drop("__p").orderBy(rank).limit(limit)


def reciprocal(rank: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(K) + (F.col(rank) if isinstance(rank, str) else rank))


def fuse(ranked: DataFrame, key: str, lexical: str, related: str, rerank: str | None = None, lexical_weight: float = 2.0, relation_weight: float = 1.0) -> DataFrame:
    """Weighted reciprocal rank fusion over dense_rank, the lexical score, relation hits and, if given, rerank positions.

    `ranked` is a short list (a page of results), so its windows run in one task. Without reranking the dense order
    counts a second time; a missing rerank position is the last but one."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    out = ranked.withColumn("lexical_rank", F.row_number().over(Window.orderBy(F.desc(lexical), "dense_rank")))
    out = out.withColumn("relation_rank", F.row_number().over(Window.orderBy(F.when(F.col(related), 0).otherwise(1), "dense_rank")))
    again = F.col("dense_rank") if rerank is None else F.coalesce(F.col(rerank), n + 1)
    out = out.withColumn("fused_score", reciprocal("dense_rank") + lexical_weight * reciprocal("lexical_rank") + reciprocal(again) + relation_weight * reciprocal("relation_rank"))
    return out.withColumn("fused_rank", F.row_number().over(Window.orderBy(F.desc("fused_score"), "dense_rank")))


def merge_prefix(prefix: DataFrame, rest: DataFrame, key: str, prefix_rank: str, rest_rank: str) -> DataFrame:
    """The prefix in its order, then what is left of the rest in its own."""
    left = rest.join(prefix.select(key), key, "left_anti")
    both = prefix.select(key, F.lit(0).alias("__part"), F.col(prefix_rank).alias("__r")).union(left.select(key, F.lit(1), F.col(rest_rank)))
    return both.select(key, F.row_number().over(Window.orderBy("__part", "__r")).alias("rank"))


def entity_hits(mentions: DataFrame, sources: DataFrame, entities: list[str], limit: int = 50) -> DataFrame:
    """Chunks by how many of the asked entities they mention: of the first 4 x limit the first per source, at most `limit`."""
    hits = mentions.filter(F.col("entity_id").isin(entities)).groupBy("chunk_id").agg(F.count_distinct("entity_id").alias("matches"))
    rows = hits.join(sources, "chunk_id").orderBy(F.desc("matches"), "chunk_index", "chunk_id").limit(4 * limit)
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("matches"), "chunk_index", "chunk_id")))
    return first_per_source(ranked, "source_rel_path", "rank", limit).withColumn("score", F.col("matches") / float(len(set(entities))))


def related_entities(relations: DataFrame, seeds: list[str], floor: float = 0.5, most: int = 20) -> DataFrame:
    """Entities that relations of the seeds name, best relation first; only the first 4 x `most` relations are looked at."""
    touching = relations.filter((F.col("confidence") >= floor) & (F.col("subject_entity_id").isin(seeds) | F.col("object_entity_id").isin(seeds)))
    order = [F.desc("confidence"), "relation_id"]
    rows = touching.orderBy(*order).limit(4 * most).withColumn("r", F.row_number().over(Window.orderBy(*order)))
    both = rows.select("r", F.posexplode(F.array("subject_entity_id", "object_entity_id")).alias("p", "entity_id")).filter(~F.col("entity_id").isin(seeds))
    first = both.groupBy("entity_id").agg(F.min(F.col("r") * 2 + F.col("p")).alias("at")).orderBy("at").limit(most)
    return first.select("entity_id", F.row_number().over(Window.orderBy("at")).alias("rank"))


def recall_at(expected: Column, ranked: Column, k: int) -> Column:
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(expected, F.slice(ranked, 1, k))) / F.size(F.array_distinct(expected))).otherwise(0.0)


def reciprocal_rank_at(expected: Column, ranked: Column, k: int) -> Column:
    hits = F.filter(F.transform(F.slice(ranked, 1, k), lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda x: x.isNotNull())
    return F.when(F.size(hits) > 0, F.lit(1.0) / F.array_min(hits)).otherwise(0.0)


def fetch_size(limit: int, rerank_top: int, distinct_sources_at: dict[int, int], wanted: int, most: int = 50) -> int:
    """How many nearest rows a search looks at: it begins with max(limit, rerank_top) and takes `rerank_top` more at a time until
    `wanted` different sources are among them, `most` is reached or no more rows come. distinct_sources_at: rank -> sources up to it."""
    n = min(most, max(limit, rerank_top))
    while distinct_sources_at.get(min(n, max(distinct_sources_at, default=0)), 0) < wanted and n < most and n <= max(distinct_sources_at, default=0):
        n = min(most, n + max(1, rerank_top))
    return n


def search_profiles(profiles: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Entities whose label or one of whose aliases holds the text, whatever its case, by PageRank; % and _ in it stand for any."""
    hit = F.col("label").ilike(f"%{text}%") | F.exists("aliases", lambda a: a.ilike(f"%{text}%"))
    return profiles.filter(hit).orderBy(F.desc("pagerank"), "entity_id").limit(limit)


def deduped(rows: DataFrame, order: str, value: str) -> DataFrame:
    """The first of values that are equal but for case, in the given order: order, value."""
    return rows.groupBy(F.lower(value).alias("__f")).agg(F.min(F.struct(order, value)).alias("r")).select(f"r.{order}", f"r.{value}")


def expansion_terms(entities: DataFrame, definitions: DataFrame, question: str, most: int = 12) -> DataFrame:
    """rank, term: names to add to a question. entities: rank, entity_id, best first. Of each its id, label and aliases count, in
    this order; terms that are equal but for case count once, and those that the question holds already not at all."""
    named = entities.join(definitions, "entity_id")
    names = F.filter(F.concat(F.array("entity_id", "label"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull() & (F.trim(x) != ""))
    rows = named.select("rank", F.posexplode(names).alias("p", "term")).withColumn("at", F.struct("rank", "p"))
    rows = rows.filter(~F.contains(F.lit(question.lower()), F.lower("term")))
    first = deduped(rows, "at", "term").orderBy("at").limit(most)
    return first.select(F.row_number().over(Window.orderBy("at")).alias("rank"), "term")


def evaluate(ranked: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """One row per case: recall and reciprocal rank at k. ranked: case, rank, source; expected: case, source. Of a source the best
    rank counts, and ranks are those among different sources."""
    order = ranked.groupBy("case", "source").agg(F.min("rank").alias("rank"))
    order = order.withColumn("rank", F.row_number().over(Window.partitionBy("case").orderBy("rank", "source")))
    hits = expected.select("case", "source").distinct().join(order.filter(F.col("rank") <= k), ["case", "source"], "left")
    return hits.groupBy("case").agg((F.count("rank") / F.count("source")).alias("recall"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal_rank"))


def evaluation_summary(cases: DataFrame) -> DataFrame:
    """Means over all cases, 0 without any."""
    return cases.agg(F.count("*").alias("cases"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("mean_recall"), F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mean_reciprocal_rank"))
