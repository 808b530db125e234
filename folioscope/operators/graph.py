"""Graph operators over an edge table (src, dst, weight): traversal, centrality, communities, paths.

PageRank, breadth-first search and shortest paths are rounds of joins and scale with the edges. Betweenness and
closeness search from every node in parallel tasks, over adjacency lists that are broadcast, and refuse graphs above
BROADCAST_ROWS edges. Communities by modularity and eigenvectors run on the driver behind the same bound; larger graphs
take label propagation.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import BROADCAST_ROWS, materialize


#: Rounds of PageRank between two looks at how much has moved.
TOGETHER = 4


def ranked(rows: DataFrame, metric: str, key: str, name: str) -> DataFrame:
    """rows with their place by the metric, highest first, ties by key: sorted in ranges, and every range counts on from the one before."""
    parts = materialize(rows.repartitionByRange(F.desc(metric), key).withColumn("__p", F.spark_partition_id()))
    sizes = sorted((r["__p"], r.c) for r in parts.groupBy("__p").agg(F.count("*").alias("c")).collect())  # a row per range
    before, starts = 0, []
    for p, c in sizes:
        starts.append((p, before))
        before += c
    offset = rows.sparkSession.createDataFrame(starts, "__p int, __o long")
    place = F.row_number().over(Window.partitionBy("__p").orderBy(F.desc(metric), key))
    return parts.withColumn("__r", place).join(F.broadcast(offset), "__p").withColumn(name, (F.col("__r") + F.col("__o")).cast("int")).drop("__p", "__r", "__o")


def combined_edges(ontology: DataFrame, relations: DataFrame, floor: float = 0.5) -> DataFrame:
    """src, dst, relation, origin, weight, support: edges of the ontology (src, dst, relation), each of weight 1, and those of the
    corpus by triple, above the confidence floor, with their highest confidence as weight and the number of chunks as support."""
    known = ontology.select("src", "dst", "relation", F.lit("ontology").alias("origin"), F.lit(1.0).alias("weight"), F.lit(None).cast("long").alias("support"))
    triple = ["subject_entity_id", "predicate", "object_entity_id"]
    found = relations.filter(F.col("confidence") >= floor).groupBy(*triple).agg(F.max("confidence").alias("weight"), F.count("*").alias("support"))
    return known.unionByName(found.select(F.col(triple[0]).alias("src"), F.col(triple[2]).alias("dst"), F.col(triple[1]).alias("relation"), F.lit("corpus").alias("origin"), "weight", "support"))


def within_bound(edges: DataFrame) -> bool:
    """Whether the operators that search from every node take the graph."""
    return edges.filter("src <> dst").select("src", "dst").distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def expand(edges: DataFrame, seeds: list[str], hops: int = 1, most: int = 50) -> list[str]:
    """Entities around the seeds in the order of a search outward, neighbours by name, at most `most`; the seeds are left out.

    Only neighbours of the nodes reached so far are brought to the driver, a level at a time."""
    found, level, seen = [], list(seeds), set(seeds)
    for _ in range(hops):
        if not level or len(found) >= most:
            break
        both = edges.select("src", "dst").union(edges.select("dst", "src")).filter(F.col("src").isin(level) & (F.col("src") != F.col("dst")))
        near = both.groupBy("src").agg(F.slice(F.sort_array(F.collect_set("dst")), 1, most + len(seen)).alias("n"))
        around = {r.src: r.n for r in near.collect()}  # at most `most` nodes a level
        after = []
        for node in level:
            for other in around.get(node, []):
                if other not in seen and len(found) < most:
                    seen.add(other)
                    found.append(other)
                    after.append(other)
        level = after
    return found


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the modularity of a partition (id, community) of the graph without directions, loops and parallel edges."""
    pairs = edges.filter("src <> dst").select("src", "dst").distinct()
    at = lambda side: labels.select(F.col("id").alias(side), F.col("community").alias(f"c_{side}"))
    rows = pairs.join(at("src"), "src").join(at("dst"), "dst")
    ends = rows.select(F.explode(F.array("c_src", "c_dst")).alias("c"), ((F.col("c_src") == F.col("c_dst")).cast("int")).alias("i")).groupBy("c").agg(F.count("*").alias("d"), F.sum("i").alias("i"))
    sums = ends.agg((F.sum("d") / 2).alias("m"), (F.sum("i") / 2).alias("inner"), F.sum(F.col("d").cast("double") * F.col("d")).alias("dd"))
    return sums.select((F.col("inner") / F.col("m") - F.col("dd") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Parallel edges count."""
    both = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select("src", F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int | None = None, tol: float = 1e-6) -> DataFrame:
    """id, rank: weights of parallel edges add up, and what has no way out is spread over all nodes.

    Runs until all ranks together move by less than `tol`, or for a given number of rounds. Every round leaves at most
    `damping` of the last one's movement, so it ends. What has no way out need not be spread round by round: it gives every node
    the same, so that without it the limit differs by a factor only, and a given number of rounds is a sum of the flows of all
    rounds, whose weights follow from how much of each flow ends there."""
    flat = materialize(edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")))
    out = flat.groupBy("src").agg(F.sum("w").alias("total")).filter("total > 0")
    step = materialize(flat.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    nodes = materialize(nodes_of(flat))
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    ends = nodes.join(out.withColumnRenamed("src", "id").select("id", F.lit(True).alias("goes")), "id", "left")
    push = lambda rank: step.join(rank.select(F.col("id").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("s")).withColumnRenamed("dst", "id")
    flow, start = damping * F.coalesce("s", F.lit(0.0)), F.lit(1.0 / n)
    if rounds is None:
        rank = materialize(nodes.select("id", start.alias("rank"), F.lit(None).cast("double").alias("was")))
        r = 0
        while r % TOGETHER or not r or rank.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] >= tol:
            rank = materialize(rank.select("id", F.col("rank").alias("was")).join(push(rank), "id", "left").select("id", (start + flow).alias("rank"), "was"))
            r += 1
        total = rank.agg(F.sum("rank")).first()[0]
        return rank.select("id", (F.col("rank") / total).alias("rank"))
    rank = materialize(ends.select("id", "goes", start.alias("rank"), F.array(start).alias("all")))
    for _ in range(rounds):
        rank = materialize(rank.select("id", "goes", "all").join(push(rank), "id", "left").select("id", "goes", flow.alias("rank"), F.concat("all", F.array(flow)).alias("all")))
    stuck = [0.0] * (rounds + 1)
    for row in rank.filter("goes is null").select(F.posexplode("all").alias("j", "x")).groupBy("j").agg(F.sum("x").alias("x")).collect():  # a row per round
        stuck[row.j] = row.x
    share = [1.0]
    for _ in range(rounds):
        share = [1 - damping + damping * sum(a * x for a, x in zip(share, stuck)), *share]
    return rank.select("id", F.aggregate(F.zip_with("all", F.array(*map(F.lit, share)), lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x).alias("rank"))


def hops(edges: DataFrame, seeds: list[str], most: int = 3) -> DataFrame:
    """Nodes within `most` undirected hops of a seed: id, hop."""
    around = materialize(edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct())
    seen = nodes_of(edges).filter(F.col("id").isin(seeds)).withColumn("hop", F.lit(0))
    for h in range(1, most + 1):
        front = seen.filter(F.col("hop") == h - 1).select(F.col("id").alias("src"))
        new = around.join(front, "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("hop", F.lit(h))
        seen = materialize(seen.union(new))
    return seen


def cheapest(edges: DataFrame, source: str, rounds: int | None = None) -> DataFrame:
    """id and cost of the cheapest directed way from the source; `weight` is an edge's cost. Relaxes until no cost changes,
    or only ways of at most `rounds` edges. A cycle of negative cost raises ValueError."""
    flat = materialize(edges.groupBy("src", "dst").agg(F.min("weight").alias("c")))
    best = flat.filter(F.col("src") == source).limit(1).select(F.lit(source).alias("id"), F.lit(0.0).alias("cost"))
    best = front = materialize(best)
    most, r = nodes_of(flat).count() if rounds is None else rounds, 0
    while r < most:
        further = flat.join(front.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.min(F.col("cost") + F.col("c")).alias("new")).withColumnRenamed("dst", "id")
        front = materialize(further.join(best, "id", "left").filter("cost is null or new < cost").select("id", F.col("new").alias("cost")))
        if front.isEmpty():
            return best
        best = materialize(best.union(front).groupBy("id").agg(F.min("cost").alias("cost")))
        r += 1
    if rounds is None and r:
        raise ValueError("a cycle of negative cost")
    return best


def path_edges(edges: DataFrame, path: list[str]) -> list[tuple[str, str, str | None]]:
    """(src, dst, relation) of the steps of a path; of parallel edges the first by name."""
    steps = list(zip(path, path[1:]))
    if not steps:
        return []
    rows = edges.filter(F.struct("src", "dst").isin([F.struct(F.lit(a), F.lit(b)) for a, b in steps])).groupBy("src", "dst").agg(F.min("relation").alias("relation")).collect()  # a row per step
    names = {(r.src, r.dst): r.relation for r in rows}
    return [(a, b, names.get((a, b))) for a, b in steps]


def shortest_path(edges: DataFrame, source: str, target: str, most: int = 5) -> DataFrame:
    """The directed path of fewest edges, of equal ones the first in name order: path, n_hops; empty if there is none within `most`.

    Only each node's first path of its level is carried on, so no round holds more rows than the graph has nodes."""
    flat = materialize(edges.filter("src <> dst").select("src", "dst").distinct())
    level = flat.filter(F.col("src") == source).limit(1).select(F.lit(source).alias("id"), F.array(F.lit(source)).alias("path"))
    seen = level
    for _ in range(most):
        step = flat.join(level.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        level = materialize(step.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        seen = seen.union(level)
    return seen.filter(F.col("id") == target).select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("n_hops"))


def _adjacency(edges: DataFrame) -> tuple[list[str], list[list[int]]]:
    flat = edges.filter("src <> dst").select("src", "dst").distinct()
    rows = flat.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"this operator takes graphs of up to {BROADCAST_ROWS} edges")
    names = sorted({r.id for r in nodes_of(edges).limit(2 * BROADCAST_ROWS).collect()})
    number = {v: i for i, v in enumerate(names)}
    out: list[list[int]] = [[] for _ in names]
    for r in rows:
        out[number[r.src]].append(number[r.dst])
    return names, [sorted(x) for x in out]


def betweenness(edges: DataFrame) -> DataFrame:
    """Share of shortest directed paths through each node, unweighted, normalised: a search from every node, in parallel."""
    spark = edges.sparkSession
    names, ways = _adjacency(edges)
    shared, n = spark.sparkContext.broadcast(ways), len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, near = np.zeros(n), shared.value
        for pdf in batches:
            for s in pdf["s"]:
                depth, paths, before, order = {s: 0}, defaultdict(float, {s: 1.0}), defaultdict(list), []
                queue = deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in near[v]:
                        if w not in depth:
                            depth[w] = depth[v] + 1
                            queue.append(w)
                        if depth[w] == depth[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                owed = defaultdict(float)
                for w in reversed(order):
                    for v in before[w]:
                        owed[v] += paths[v] / paths[w] * (1 + owed[w])
                    if w != s:
                        total[w] += owed[w]
        yield pd.DataFrame({"i": np.arange(n), "b": total})

    scale = (n - 1) * (n - 2) if n > 2 else 1
    label = spark.createDataFrame(list(enumerate(names)), "i long, id string")
    sums = spark.range(n).withColumnRenamed("id", "s").mapInPandas(run, "i long, b double").groupBy("i").agg((F.sum("b") / scale).alias("betweenness"))
    return label.join(sums, "i").select("id", "betweenness")


def closeness(edges: DataFrame) -> DataFrame:
    """Inward closeness, scaled by the share of nodes that reach the node."""
    spark = edges.sparkSession
    names, ways = _adjacency(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    shared, n = spark.sparkContext.broadcast(ways), len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = []
            for s in pdf["s"]:
                depth, queue = {s: 0}, deque([s])
                while queue:
                    v = queue.popleft()
                    for w in shared.value[v]:
                        if w not in depth:
                            depth[w] = depth[v] + 1
                            queue.append(w)
                far, reached = sum(depth.values()), len(depth) - 1
                values.append(reached / far * (reached / (n - 1)) if far else 0.0)
            yield pd.DataFrame({"i": pdf["s"], "closeness": values})

    label = spark.createDataFrame(list(enumerate(names)), "i long, id string")
    return label.join(spark.range(n).withColumnRenamed("id", "s").mapInPandas(run, "i long, closeness double"), "i").select("id", "closeness")


def eigenvector(edges: DataFrame, rounds: int = 500) -> DataFrame:
    """The leading left eigenvector by power iteration, of length 1; all zeros if it doesn't settle."""
    names, ways = _adjacency(edges)
    x = np.full(len(names), 1 / max(1, len(names)) ** 0.5)
    src = np.array([i for i, w in enumerate(ways) for _ in w], int)
    dst = np.array([j for w in ways for j in w], int)
    ok = False
    for _ in range(rounds):
        new = x + np.bincount(dst, x[src], minlength=len(names))
        new /= np.linalg.norm(new) or 1
        ok = bool(np.abs(new - x).max(initial=0) < 1e-9)
        x = new
        if ok:
            break
    return edges.sparkSession.createDataFrame(list(zip(names, (x if ok else x * 0).tolist())), "id string, eigenvector double")


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """id, community: greedy modularity by moving nodes and merging communities until nothing gains, in name order."""
    names, ways = _adjacency(edges)
    n = len(names)
    weight: dict[int, dict[int, float]] = {i: defaultdict(float) for i in range(n)}
    for i, near in enumerate(ways):
        for j in near:
            weight[i][j] += 1.0
            weight[j][i] += 1.0
    member = {i: [i] for i in range(n)}
    while True:
        strength = {i: sum(w.values()) for i, w in weight.items()}
        total = sum(strength.values()) or 1.0
        home = {i: i for i in weight}
        mass = dict(strength)
        moved_ever, moved = False, True
        while moved:
            moved = False
            for i in sorted(weight):
                links: dict[int, float] = defaultdict(float)
                for j, w in weight[i].items():
                    if j != i:
                        links[home[j]] += w
                mass[home[i]] -= strength[i]
                gain = lambda c: links.get(c, 0.0) - resolution * strength[i] * mass[c] / total  # noqa: B023,E731
                best = max(sorted({home[i], *links}), key=lambda c: (gain(c), c == home[i]))
                if gain(best) > gain(home[i]) + 1e-12:
                    home[i], moved, moved_ever = best, True, True
                mass[home[i]] += strength[i]
        if not moved_ever:
            break
        joined: dict[int, dict[int, float]] = {c: defaultdict(float) for c in set(home.values())}
        for i, near in weight.items():
            for j, w in near.items():
                joined[home[i]][home[j]] += w
        members: dict[int, list[int]] = defaultdict(list)
        for i, m in member.items():
            members[home[i]] += m
        weight, member = joined, dict(members)
    groups = sorted(sorted(names[i] for i in m) for m in member.values())
    return edges.sparkSession.createDataFrame([(v, c) for c, g in enumerate(groups) for v in g], "id string, community int")


def communities_of_any_size(edges: DataFrame) -> DataFrame:
    """id, community: by modularity within the bound, beyond it by label propagation, numbered in order of the labels."""
    if within_bound(edges):
        return communities(edges)
    labels = label_propagation(edges)
    sizes = ranked(labels.groupBy("community").agg(F.lit(0).alias("z")), "z", "community", "n")
    return labels.join(sizes.select("community", "n"), "community").select("id", (F.col("n") - 1).alias("community"))


def label_propagation(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """id, community for graphs of any size: every node takes its neighbours' most frequent label, the smallest of equals.

    Runs until no label changes, or for a given number of rounds. As links count both ways, labels settle or come to
    alternate between two states; of those every node takes the smaller label."""
    both = materialize(edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst"))
    labels = materialize(nodes_of(edges).select("id", F.col("id").alias("community"), F.lit(None).cast("string").alias("was")))
    r = 0
    while r != rounds:
        votes = both.join(labels.select(F.col("id").alias("src"), "community"), "src").groupBy("dst", "community").agg(F.count("*").alias("c"))
        best = votes.groupBy("dst").agg(F.min(F.struct(-F.col("c"), "community")).alias("b")).select(F.col("dst").alias("id"), F.col("b.community").alias("new"))
        new = materialize(labels.join(best, "id", "left").select("id", F.coalesce("new", "community").alias("community"), F.col("community").alias("was"), F.col("was").alias("before")))
        labels = new.select("id", "community", "was")
        r += 1
        if rounds is None and new.filter("community <> was").isEmpty():
            break
        if rounds is None and new.filter("before is null or community <> before").isEmpty():
            return new.select("id", F.least("community", "was").alias("community"))
    return labels.select("id", "community")


def weighted_path(edges: DataFrame, source: str, target: str) -> tuple[list[str], float] | None:
    """Cheapest path on the driver, for graphs within the bound; `cheapest` is the form for larger ones."""
    flat = edges.groupBy("src", "dst").agg(F.min("weight").alias("c"))
    rows = flat.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"this operator takes graphs of up to {BROADCAST_ROWS} edges")
    near: dict[str, list[tuple[str, float]]] = defaultdict(list)
    for r in rows:
        near[r.src].append((r.dst, r.c))
    heap, done = [(0.0, [source])], set()
    while heap:
        cost, path = heapq.heappop(heap)
        if path[-1] == target:
            return path, cost
        if path[-1] not in done:
            done.add(path[-1])
            for v, c in near[path[-1]]:
                if v not in done:
                    heapq.heappush(heap, (cost + c, [*path, v]))
    return None


def neighbours(edges: DataFrame, node: str, nodes: DataFrame | None = None) -> DataFrame:
    """id, direction of the edges at a node; with a node table (id, node_type, label) what it says of the other end, too."""
    keep = [c for c in ("relation", "origin", "edge_key") if c in edges.columns and nodes is not None]
    out = edges.filter(F.col("src") == node).select(F.col("dst").alias("id"), F.lit("out").alias("direction"), *keep)
    out = out.union(edges.filter(F.col("dst") == node).select("src", F.lit("in"), *keep))
    return out if nodes is None else out.join(nodes.select("id", "node_type", "label"), "id", "left")
