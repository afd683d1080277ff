"""Graph operators over edge tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that can be reached; edges are columns src and dst.

    Large-star and small-star rounds (Kiveris et al. 2014) shorten paths
    geometrically; each round is written to the checkpoint folder. Nodes without an
    edge are their own component. Nulls and self-loops are ignored. Raises if the
    rounds don't end in max_rounds.
    """
    kept = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")
    )
    state = cut_lineage(kept.dropDuplicates())
    count = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    for _ in range(max_rounds if count.n else 1):
        if not count.n:
            break
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.dropDuplicates()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "u", "m")
        state = small.select(F.col("x").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        state = cut_lineage(state.filter("u <> v").dropDuplicates())
        now = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == (count.n, count.h):
            break
        count = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = state.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    roots = found.select(F.col("component").alias("id"), "component").dropDuplicates()
    labelled = found.union(roots)
    if nodes is None:
        return labelled
    rest = nodes.select("id").filter("id IS NOT NULL").dropDuplicates().join(labelled.select("id"), "id", "left_anti")
    return labelled.union(rest.select("id", F.col("id").alias("component")))


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) with every undirected edge in both directions."""
    one = edges.select("src", "dst", "weight")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, weighted_degree)."""
    return both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"))


def density(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, total_weight, density; 0 with fewer than two nodes."""
    n = both_ways(edges).agg(F.countDistinct("src").alias("nodes")).withColumn("k", F.lit(1))
    m = edges.agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.sum("weight"), F.lit(0)).alias("total_weight")).withColumn("k", F.lit(1))
    value = F.when(F.col("nodes") > 1, 2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    return n.join(m, "k").select("nodes", "edges", "total_weight", F.round(value, 6).alias("density"))


def restricted(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """The edges of which both ends are known nodes."""
    ids = nodes.select(F.col(key).alias("known")).distinct()
    first = edges.join(ids, edges.src == ids.known, "left_semi")
    return first.join(ids, first.dst == ids.known, "left_semi")


def without_isolated(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """The nodes that stand at some edge."""
    ends = edges.select(F.col("src").alias(key)).union(edges.select(F.col("dst").alias(key))).distinct()
    return nodes.join(ends, key, "left_semi")


def top_subgraph(edges: DataFrame, k: int = 100) -> DataFrame:
    """The edges among the k nodes of highest degree."""
    best = degrees(edges).orderBy(F.desc("degree"), "id").limit(k)
    return restricted(edges, best)


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(id, pagerank) over weighted undirected edges; ranks sum to 1.

    Each round is one join on the source and one sum on the target. Every fifth
    round is written to the checkpoint folder, where the change is tested: the rounds end when the sum of changes is
    under the number of nodes times tolerance, or after `rounds`.
    """
    arcs = both_ways(edges)
    out = arcs.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = cut_lineage(arcs.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    nodes = cut_lineage(out.select(F.col("src").alias("id")))
    n = nodes.count()
    if not n:
        return nodes.withColumn("pagerank", F.lit(0.0))
    ranks = nodes.withColumn("pagerank", F.lit(1.0 / n))
    last = ranks
    for i in range(1, rounds + 1):
        sent = shares.join(ranks, shares.src == ranks.id).groupBy("dst").agg(F.sum(F.col("share") * F.col("pagerank")).alias("got"))
        ranks = sent.select(F.col("dst").alias("id"), (F.lit((1 - damping) / n) + damping * F.col("got")).alias("pagerank"))
        if i % 5 == 0:
            ranks = cut_lineage(ranks)
            if tolerance is not None:
                change = ranks.join(last.withColumnRenamed("pagerank", "old"), "id").agg(F.sum(F.abs(F.col("pagerank") - F.col("old")))).first()[0]
                if change < n * tolerance:
                    break
            last = ranks
    return ranks


def eigenvector(edges: DataFrame, rounds: int = 500, tolerance: float = 1e-6) -> DataFrame:
    """(id, eigenvector) by power iteration on the weighted adjacency plus identity, of unit length.

    If the rounds don't settle, degree over the largest degree takes its place.
    """
    arcs = cut_lineage(both_ways(edges).select("src", "dst", F.col("weight").cast("double").alias("weight")))
    nodes = cut_lineage(arcs.select(F.col("src").alias("id")).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("eigenvector", F.lit(0.0))
    x = nodes.withColumn("x", F.lit(1.0 / n**0.5))
    done = 0
    while done < rounds:
        old = x
        for _ in range(4):
            got = arcs.join(x, arcs.src == x.id).select(F.col("dst").alias("id"), (F.col("weight") * F.col("x")).alias("y"))
            x = got.union(x.select("id", F.col("x").alias("y"))).groupBy("id").agg(F.sum("y").alias("x"))
        x = cut_lineage(x)
        length = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
        x = cut_lineage(x.select("id", (F.col("x") / length).alias("x")))
        done += 4
        change = x.join(old.withColumnRenamed("x", "o"), "id").agg(F.sum(F.abs(F.col("x") - F.col("o")))).first()[0]
        if change < n * tolerance:
            return x.select("id", F.col("x").alias("eigenvector"))
    most = degrees(edges).agg(F.max("degree")).first()[0]
    return degrees(edges).select("id", (F.col("degree") / most).alias("eigenvector"))


#: Adjacency that travels with tasks: at most so many edges (about 12 bytes each as arrays).
LOCAL_EDGES = 5_000_000


def _local(edges: DataFrame, limit: int) -> tuple[list, list[dict[int, float]]]:
    """Node names and adjacency of a graph of checked size."""
    if edges.limit(limit + 1).count() > limit:
        raise ValueError(f"graph has more than {limit} edges; raise min weight or take a subgraph")
    rows = edges.select("src", "dst", F.col("weight").cast("double")).collect()
    names = sorted({r[0] for r in rows} | {r[1] for r in rows})
    place = {v: i for i, v in enumerate(names)}
    near: list[dict[int, float]] = [{} for _ in names]
    for a, b, w in rows:
        if a != b:
            near[place[a]][place[b]] = w
            near[place[b]][place[a]] = w
    return names, near


def _dependencies(near: list[dict[int, float]], source: int, cost: str) -> dict[int, float]:
    """Shares of shortest paths from one source that pass each node (Brandes 2001)."""
    import heapq

    length = {"distance": lambda w: w, "none": lambda w: 1.0, "inverse": lambda w: 1.0 / w}[cost]
    best, paths, before, order, settled = {source: 0.0}, {source: 1.0}, {source: []}, [], set()
    queue = [(0.0, source)]
    while queue:
        d, v = heapq.heappop(queue)
        if v in settled:
            continue
        settled.add(v)
        order.append(v)
        for u, w in near[v].items():
            step = d + length(w)
            if u not in best or step < best[u] - 1e-12:
                best[u], paths[u], before[u] = step, paths[v], [v]
                heapq.heappush(queue, (step, u))
            elif u not in settled and abs(step - best[u]) <= 1e-12:
                paths[u] += paths[v]
                before[u].append(v)
    share = dict.fromkeys(order, 0.0)
    for u in reversed(order):
        for v in before[u]:
            share[v] += paths[v] / paths[u] * (1 + share[u])
    share.pop(source)
    return share


class _ByWeight:
    """Arcs of a graph with whole positive weights, by weight and source, for shortest paths a level at a time."""

    def __init__(self, near: list[dict[int, float]], cost: str) -> None:
        n = self.n = len(near)
        src = np.repeat(np.arange(n), [len(x) for x in near])
        dst = np.fromiter((u for x in near for u in x), np.int64, len(src))
        w = np.ones(len(src)) if cost == "none" else np.fromiter((w for x in near for w in x.values()), float, len(src))
        self.weights, kind = np.unique(w.astype(np.int64), return_inverse=True)
        order = np.lexsort((src, kind))
        self.dst = dst[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(kind * n + src, minlength=len(self.weights) * n))]).astype(np.int32)
        member = np.full(n, -1)
        for v in range(n):
            if member[v] < 0:
                todo = [v]
                member[v] = v
                while todo:
                    for u in near[todo.pop()]:
                        if member[u] < 0:
                            member[u] = v
                            todo.append(u)
        self.reach = np.bincount(member, minlength=n)[member]

    @staticmethod
    def fits(near: list[dict[int, float]], cost: str) -> bool:
        """Whether weights are whole and few enough."""
        if cost == "inverse":
            return False
        found = {w for x in near for w in x.values()} if cost == "distance" else {1.0}
        return all(w >= 1 and w == int(w) for w in found) and len(found) * len(near) <= 30_000_000

    def dependencies(self, source: int) -> np.ndarray:
        """Shares of shortest paths from one source that pass each node (Brandes 2001), as `_dependencies`.

        A node at distance d is met from those at distance d - w over arcs of weight w,
        so an arc is only followed while its end isn't nearer.
        """
        import heapq

        paths, met = np.zeros(self.n), np.zeros(self.n, bool)
        paths[source], met[source] = 1.0, True
        level, settled, steps = np.array([source]), 1, []
        due: dict[int, list] = {}
        queue: list[int] = []
        now = 0
        while settled < self.reach[source]:
            for k, w in enumerate(self.weights.tolist()):
                if now + w not in due:
                    due[now + w] = []
                    heapq.heappush(queue, now + w)
                due[now + w].append((k, level))
            while True:
                now = heapq.heappop(queue)
                tails, ends = [], []
                for k, nodes in due.pop(now):
                    first = self.start[k * self.n + nodes]
                    count = self.start[k * self.n + nodes + 1] - first
                    total = int(count.sum())
                    if total:
                        at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)
                        end = self.dst[at]
                        new = ~met[end]
                        ends.append(end[new])
                        tails.append(np.repeat(nodes, count)[new])
                end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
                if len(end):
                    break
            tail = np.concatenate(tails)
            np.add.at(paths, end, paths[tail])
            steps.append((tail, end))
            fresh = np.zeros(self.n, bool)
            fresh[end] = True
            level = np.flatnonzero(fresh)
            met[level] = True
            settled += len(level)
        share = np.zeros(self.n)
        for tail, end in reversed(steps):
            np.add.at(share, tail, paths[tail] / paths[end] * (1 + share[end]))
        share[source] = 0.0
        return share


def betweenness(edges: DataFrame, cost: str = "distance", limit: int = LOCAL_EDGES) -> DataFrame:
    """(id, betweenness), normalised, of an undirected graph of at most `limit` edges.

    Sources are spread over tasks; the adjacency, checked for size, goes with them.
    cost: weight as a path's distance, none, or its inverse. Whole weights are taken a level
    at a time in arrays, others by a queue.
    """
    import pandas as pd

    spark = edges.sparkSession
    names, near = _local(edges, limit)
    n = len(names)
    arrays = _ByWeight.fits(near, cost)
    shared = spark.sparkContext.broadcast(_ByWeight(near, cost) if arrays else near)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0

    def run(frames):
        total = np.zeros(n)
        for frame in frames:
            for s in frame.id:
                if arrays:
                    total += shared.value.dependencies(int(s))
                else:
                    for v, x in _dependencies(shared.value, int(s), cost).items():
                        total[v] += x
        some = np.flatnonzero(total)
        yield pd.DataFrame({"node": some, "part": total[some]}).astype({"node": "int64", "part": "float64"})

    parts = min(max(n, 1), 4 * spark.sparkContext.defaultParallelism)
    sums = spark.range(n).repartition(parts).mapInPandas(run, "node long, part double").groupBy("node").agg(F.sum("part").alias("s"))
    kind = edges.schema["src"].dataType.simpleString()
    labels = spark.createDataFrame(list(enumerate(names)), f"node long, id {kind}")
    return labels.join(sums, "node", "left").select("id", (F.coalesce("s", F.lit(0.0)) * scale).alias("betweenness"))


def _louvain(near: list[dict[int, float]], seed: int) -> list[int]:
    """Communities by repeated local moves and merging (Blondel et al. 2008)."""
    import random

    member = list(range(len(near)))
    graph = [dict(x) for x in near]
    loops = [0.0] * len(graph)
    rng = random.Random(seed)
    while True:
        n = len(graph)
        strength = [sum(graph[v].values()) + 2 * loops[v] for v in range(n)]
        twice = sum(strength) or 1.0
        own, total = list(range(n)), list(strength)
        moved_any = False
        while True:
            moved = False
            order = list(range(n))
            rng.shuffle(order)
            for v in order:
                links: dict[int, float] = {}
                for u, w in graph[v].items():
                    links[own[u]] = links.get(own[u], 0.0) + w
                here = own[v]
                total[here] -= strength[v]
                best, gain = here, links.get(here, 0.0) - total[here] * strength[v] / twice
                for c, w in sorted(links.items()):
                    g = w - total[c] * strength[v] / twice
                    if g > gain + 1e-12:
                        best, gain = c, g
                total[best] += strength[v]
                if best != here:
                    own[v], moved, moved_any = best, True, True
            if not moved:
                break
        if not moved_any:
            return member
        label = {c: i for i, c in enumerate(sorted(set(own)))}
        member = [label[own[m]] for m in member]
        merged: list[dict[int, float]] = [{} for _ in label]
        held = [0.0] * len(label)
        for v in range(n):
            c = label[own[v]]
            held[c] += loops[v]
            for u, w in graph[v].items():
                k = label[own[u]]
                if k == c:
                    held[c] += w / 2
                else:
                    merged[c][k] = merged[c].get(k, 0.0) + w
        graph, loops = merged, held


def communities(edges: DataFrame, seed: int = 42, limit: int = LOCAL_EDGES) -> DataFrame:
    """(id, community) by modularity; communities are numbered by size, the largest 0.

    Graphs of up to `limit` edges are handled whole; larger ones by moves in joins, which
    end in communities of about the same modularity, not in the same ones.
    """
    if edges.limit(limit + 1).count() > limit:
        return _numbered(communities_by_moves(edges, seed))
    names, near = _local(edges, limit)
    found = _louvain(near, seed)
    groups: dict[int, list] = {}
    for name, c in zip(names, found, strict=True):
        groups.setdefault(c, []).append(name)
    ranked = sorted(groups.values(), key=lambda g: (-len(g), min(g)))
    kind = edges.schema["src"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(v, i) for i, g in enumerate(ranked) for v in g], f"id {kind}, community int")


def _numbered(members: DataFrame) -> DataFrame:
    """Communities numbered by size, equal ones by their least member."""
    from pyspark.sql import Window as W

    sizes = cut_lineage(members.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least")))
    per_size = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    before = per_size.select("size", F.coalesce(F.sum("n").over(W.orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.col("before") + F.row_number().over(W.partitionBy("size").orderBy("least")) - 1
    ranks = sizes.join(before, "size").select("community", number.cast("int").alias("number"))
    return members.join(ranks, "community").select("id", F.col("number").alias("community"))


def communities_by_moves(edges: DataFrame, seed: int = 42, rounds: int = 20, levels: int = 10) -> DataFrame:
    """(id, community) by local moves towards modularity, made by joins at any size.

    In a round every node weighs the communities of its neighbours; a random half of
    those that gain by a move make it, so that neighbours don't change places for
    ever. When moves end, communities become the nodes of the next level; levels end
    when one makes no move. A community bears the id of one of its first nodes.
    """
    arcs = both_ways(edges.filter("src <> dst")).groupBy("src", "dst").agg(F.sum(F.col("weight").cast("double")).alias("w"))
    arcs = cut_lineage(arcs)
    twice = arcs.agg(F.sum("w")).first()[0] or 1.0
    members = cut_lineage(arcs.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id")))
    for level in range(levels):
        nodes = cut_lineage(arcs.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
        outer = arcs.filter("src <> dst")
        own = cut_lineage(nodes.select("id", "k", F.col("id").alias("c")))
        moved_any, still = False, 0
        for turn in range(rounds):
            total = own.groupBy("c").agg(F.sum("k").alias("total"))
            held = own.select(F.col("id").alias("dst"), "c")
            links = outer.join(held, "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("w"))
            here = own.select("id", "k", F.col("c").alias("now"))
            weighed = links.join(here, "id").join(total, "c")
            inside = F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)
            gain = F.col("w") - (F.col("total") - inside) * F.col("k") / F.lit(twice)
            best = weighed.withColumn("gain", gain).groupBy("id").agg(
                F.min(F.struct((-F.col("gain")).alias("m"), F.col("c").alias("c"))).alias("best"), F.max(F.when(F.col("c") == F.col("now"), F.col("gain"))).alias("stay")
            )
            left = own.withColumnRenamed("c", "now").join(total.withColumnRenamed("c", "now"), "now").join(best, "id", "left")
            stay = F.coalesce("stay", -(F.col("total") - F.col("k")) * F.col("k") / F.lit(twice))
            takes = (-F.col("best.m") > stay + 1e-12) & (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(level), F.lit(turn)), F.lit(2)) == 0)
            own = cut_lineage(left.select("id", "k", F.when(takes, F.col("best.c")).otherwise(F.col("now")).alias("c"), F.coalesce(takes, F.lit(False)).alias("moved")))
            moves = own.filter("moved").count()
            own = own.drop("moved")
            moved_any, still = moved_any or moves > 0, 0 if moves else still + 1
            if still == 2:
                break
        if not moved_any:
            break
        place = own.select(F.col("id").alias("community"), F.col("c").alias("next"))
        members = cut_lineage(members.join(place, "community").select("id", F.col("next").alias("community")))
        a, b = own.select(F.col("id").alias("src"), F.col("c").alias("x")), own.select(F.col("id").alias("dst"), F.col("c").alias("y"))
        arcs = cut_lineage(arcs.join(a, "src").join(b, "dst").groupBy(F.col("x").alias("src"), F.col("y").alias("dst")).agg(F.sum("w").alias("w")))
    return members


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row, modularity: the share of weight within communities less its expectation."""
    a = members.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = members.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    joined = edges.join(a, "src").join(b, "dst")
    inside = joined.groupBy(F.col("ca").alias("community")).agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inside"))
    total = joined.agg(F.sum("weight").alias("m"))
    strength = degrees(edges).join(members, "id").groupBy("community").agg(F.sum("weighted_degree").alias("d"))
    parts = strength.join(inside, "community", "left").select(F.coalesce("inside", F.lit(0)).alias("inside"), "d").withColumn("k", F.lit(1))
    return parts.join(total.withColumn("k", F.lit(1)), "k").agg(
        F.round(F.sum(F.col("inside") / F.col("m") - (F.col("d") / (2.0 * F.col("m"))) * (F.col("d") / (2.0 * F.col("m")))), 6).alias("modularity")
    )


def community_summary(edges: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(community, size, internal_edges, density, total_appearances, key_figure); nodes(id, appearances)."""
    known = members.join(nodes.select("id", "appearances"), "id", "left").withColumn("appearances", F.coalesce("appearances", F.lit(0)))
    first = F.max(F.struct("appearances", F.col("id"))).alias("top")
    sizes = known.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.sum("appearances").alias("total_appearances"), first)
    a = members.select(F.col("id").alias("src"), "community")
    b = members.select(F.col("id").alias("dst"), F.col("community").alias("other"))
    inside = edges.join(a, "src").join(b, "dst").filter("community = other").groupBy("community").agg(F.count(F.lit(1)).alias("internal_edges"))
    n, m = F.col("size"), F.coalesce("internal_edges", F.lit(0))
    value = F.when(n > 1, 2.0 * m / (n * (n - 1))).otherwise(0.0)
    return sizes.join(inside, "community", "left").select(
        "community", "size", m.alias("internal_edges"), F.round(value, 6).alias("density"), "total_appearances", F.col("top.id").alias("key_figure")
    )


def ego_nodes(edges: DataFrame, egos: DataFrame, depth: int = 1) -> DataFrame:
    """(ego, id, distance): nodes within depth steps of each ego(id)."""
    arcs = both_ways(edges).select("src", "dst")
    seen = egos.select(F.col("id").alias("ego"), "id", F.lit(0).alias("distance")).distinct()
    frontier = seen
    for step in range(1, depth + 1):
        new = frontier.join(arcs, frontier.id == arcs.src).select("ego", F.col("dst").alias("id")).distinct()
        frontier = new.join(seen.select("ego", "id"), ["ego", "id"], "left_anti").withColumn("distance", F.lit(step))
        seen = seen.unionByName(frontier)
    return seen


def ego_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(ego, src, dst, weight): edges of which both ends stand in the ego's network."""
    a = members.select("ego", F.col("id").alias("src"))
    b = members.select("ego", F.col("id").alias("dst"))
    return edges.select("src", "dst", "weight").join(a, "src").join(b, ["ego", "dst"])


def ego_statistics(edges: DataFrame, egos: DataFrame, depth: int = 1) -> DataFrame:
    """(ego, nodes, edges, degree, total_weight, mean_weight, density, clustering) of each ego's network."""
    members = cut_lineage(ego_nodes(edges, egos, depth))
    own = cut_lineage(ego_edges(edges, members))
    size = members.groupBy("ego").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("distance") == 1).alias("degree"))
    links = own.groupBy("ego").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("total_weight"), F.round(F.avg("weight"), 6).alias("mean_weight"))
    near = members.filter("distance = 1").select("ego", "id")
    a, b = near.withColumnRenamed("id", "src"), near.withColumnRenamed("id", "dst")
    triangles = own.join(a, ["ego", "src"]).join(b, ["ego", "dst"]).groupBy("ego").agg(F.count(F.lit(1)).alias("triangles"))
    n, k = F.col("nodes"), F.col("degree")
    return size.join(links, "ego", "left").join(triangles, "ego", "left").select(
        "ego", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), "degree", F.coalesce("total_weight", F.lit(0)).alias("total_weight"), "mean_weight",
        F.round(F.when(n > 1, 2.0 * F.coalesce("edges", F.lit(0)) / (n * (n - 1))).otherwise(0.0), 6).alias("density"),
        F.round(F.when(k > 1, 2.0 * F.coalesce("triangles", F.lit(0)) / (k * (k - 1))).otherwise(0.0), 6).alias("clustering"),
    )


def neighbours(edges: DataFrame, k: int = 20) -> DataFrame:
    """(id, neighbour, weight, place): each node's strongest k neighbours."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return both_ways(edges).withColumn("place", place).filter(F.col("place") <= k).select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "weight", "place")
