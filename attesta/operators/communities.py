"""Hierarchical communities of a weighted graph by modularity (local moves, refinement, contraction)."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import skew
from attesta.functions.lineage import cut
from attesta.operators.graph_tables import connected_components

#: Communities with more members are divided again at the next level.
MAX_SIZE = 10
#: A graph with this many edges or fewer is finished inside one task.
BOUND = 50_000
#: Rounds without any move, though some node would gain by one, after which the search gives up with an error.
IDLE = 100


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, w): one row for each pair of linked nodes, weights added up; self links and weights of 0 or less don't count."""
    pair = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.col("weight").cast("double").alias("w"))
    return pair.where("a <> b AND w > 0").groupBy("a", "b").agg(F.sum("w").alias("w"))


# ---- one small graph in one task -----------------------------------------------------
def _parts(labels: dict, near: dict) -> dict:
    """Connected pieces of each community, named by their least node."""
    out: dict = {}
    for start in sorted(labels):
        if start in out:
            continue
        out[start], open_ = start, [start]
        while open_:
            x = open_.pop()
            for y in near[x]:
                if y not in out and labels[y] == labels[x]:
                    out[y] = start
                    open_.append(y)
    return out


def _divide(rows: pd.DataFrame) -> dict:
    """Community by node of one graph (a, b, w), where a = b holds the weight inside a contracted node."""
    member = {x: x for x in pd.unique(rows[["a", "b"]].to_numpy().ravel())}
    edges = list(zip(rows["a"], rows["b"], rows["w"], strict=True))
    while True:
        near, degree = defaultdict(dict), defaultdict(float)
        for a, b, w in edges:
            degree[a] += w
            degree[b] += w
            if a != b:
                near[a][b] = near[a].get(b, 0.0) + w
                near[b][a] = near[b].get(a, 0.0) + w
        whole = sum(degree.values())
        labels, total = {x: x for x in degree}, dict(degree)
        moved = True
        while moved:
            moved = False
            for x in sorted(degree):
                own, k = labels[x], degree[x]
                inside: dict = defaultdict(float)
                for y, w in near[x].items():
                    inside[labels[y]] += w
                stay = inside.get(own, 0.0) * whole - k * (total[own] - k)
                best, gain = own, 1e-9 * whole
                for c in sorted(inside):
                    if c != own and inside[c] * whole - k * total[c] - stay > gain:
                        best, gain = c, inside[c] * whole - k * total[c] - stay
                if best != own:
                    labels[x], moved = best, True
                    total[own] -= k
                    total[best] += k
        parts = _parts(labels, near)
        if all(x == c for x, c in parts.items()):
            return member
        member = {x: parts[c] for x, c in member.items()}
        folded: dict = defaultdict(float)
        for a, b, w in edges:
            folded[tuple(sorted((parts[a], parts[b])))] += w
        edges = [(a, b, w) for (a, b), w in folded.items()]


def _small(rows: pd.DataFrame) -> pd.DataFrame:
    found = _divide(rows)
    return pd.DataFrame({"node": list(found), "community": list(found.values())})


# ---- large graphs by rounds of moves -------------------------------------------------
def _moved(edges: DataFrame) -> DataFrame:
    """(graph, node, community): a partition in which no node gains by a move, reached from single nodes.

    In each round a coin makes every community a receiver or a giver; a node of a giver picks the receiver it gains
    most with. Moves are admitted in the order of a hash: each must gain even if all earlier candidates have joined its
    receiver and left its giver. So moves of one round hold together, modularity rises with every one of them, the
    first candidate is always admitted, and the rounds end where no node would gain.
    """
    ends = edges.select("graph", F.col("a").alias("node"), "w").unionByName(edges.select("graph", F.col("b").alias("node"), "w"))
    labels = cut(ends.groupBy("graph", "node").agg(F.sum("w").alias("k")).withColumn("c", F.col("node")))
    whole = cut(labels.groupBy("graph").agg(F.sum("k").alias("whole")))
    apart = edges.where("a <> b")
    both = cut(apart.select("graph", F.col("a").alias("node"), F.col("b").alias("other"), "w").unionByName(apart.select("graph", F.col("b").alias("node"), F.col("a").alias("other"), "w")))
    turn, idle = 0, 0
    while True:
        total = labels.groupBy("c").agg(F.sum("k").alias("total"))
        linked = both.join(labels.select(F.col("node").alias("other"), F.col("c").alias("to")), "other").groupBy("graph", "node", "to").agg(F.sum("w").alias("inside"))
        seen = linked.join(labels.drop("graph"), "node").join(total.withColumnRenamed("c", "to").withColumnRenamed("total", "total_to"), "to")
        own = seen.where("to = c").select("node", F.col("inside").alias("inside_own"))
        seen = seen.where("to <> c").join(own, "node", "left").join(total.withColumnRenamed("total", "total_own"), "c").join(whole, "graph")
        stay = F.coalesce("inside_own", F.lit(0.0)) * F.col("whole") - F.col("k") * (F.col("total_own") - F.col("k"))
        gain = F.col("inside") * F.col("whole") - F.col("k") * F.col("total_to") - stay
        seen = seen.withColumn("gain", gain).where(F.col("gain") > 1e-9 * F.col("whole"))
        coin = lambda c: F.pmod(F.xxhash64(F.lit(turn), F.col(c)), F.lit(2))
        fair = (coin("to") == 1) & (coin("c") == 0)
        pick = F.max_by(F.struct("to", "gain"), F.when(fair, F.struct("gain", F.xxhash64("to"), "to")))
        wish = cut(seen.groupBy("graph", "node", "c", "k").agg(pick.alias("pick")).select("graph", "node", "c", "k", F.col("pick.to").alias("to"), F.col("pick.gain").alias("gain")))
        if wish.isEmpty():
            return labels.select("graph", "node", F.col("c").alias("community"))
        place = F.xxhash64(F.lit(turn), "node").bitwiseAND(F.lit((1 << 62) - 1))
        wish = wish.where("to IS NOT NULL").withColumn("place", place)
        queued = skew.running_sum(wish, ["to"], "place", F.col("k"), "joined", block=1 << 46)
        queued = skew.running_sum(queued, ["c"], "place", F.col("k"), "left", block=1 << 46)
        loss = F.col("k") * ((F.col("joined") - F.col("k")) + (F.col("left") - F.col("k")))
        admitted = cut(queued.join(whole, "graph").where(F.col("gain") - loss > 1e-9 * F.col("whole")).select("node", F.col("to").alias("next")))
        turn, idle = turn + 1, idle + 1
        if not admitted.isEmpty():
            idle = 0
            labels = cut(labels.join(admitted, "node", "left").select("graph", "node", "k", F.coalesce("next", "c").alias("c")))
        if idle > IDLE:
            raise RuntimeError(f"communities did not settle: no move was admitted in {IDLE} rounds")


def _contract(edges: DataFrame, community: DataFrame) -> DataFrame:
    name = lambda c: community.select(F.col("node").alias(c), F.col("community").alias(f"of_{c}"))
    joined = edges.join(name("a"), "a").join(name("b"), "b")
    return joined.groupBy("graph", F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).agg(F.sum("w").alias("w"))


def _pendants(edges: DataFrame) -> DataFrame:
    """(graph, node, community): every node, one with a single neighbour and no weight inside under that neighbour's name.

    No partition of most modularity parts such a node from its neighbour, so it needs no move. Of two nodes that only have
    each other the lesser gives the name.
    """
    apart = edges.where("a <> b")
    ends = apart.select("graph", F.col("a").alias("node"), F.col("b").alias("other")).unionByName(apart.select("graph", F.col("b").alias("node"), F.col("a").alias("other")))
    ends = ends.unionByName(edges.where("a = b").select("graph", F.col("a").alias("node"), F.col("b").alias("other")))
    met = cut(ends.groupBy("graph", "node").agg(F.count("*").alias("n"), F.min("other").alias("other")).withColumn("hangs", (F.col("n") == 1) & (F.col("other") != F.col("node"))))
    mutual = met.where("hangs").select("graph", F.col("other").alias("node"), F.col("node").alias("back"))
    paired = met.where("hangs").join(mutual, ["graph", "node"]).where("back = other AND node < other").select("graph", "node", F.lit(True).alias("first"))
    return met.join(paired, ["graph", "node"], "left").select("graph", "node", F.when(F.col("hangs") & F.col("first").isNull(), F.col("other")).otherwise(F.col("node")).alias("community"))


def partition(edges: DataFrame, bound: int = BOUND) -> DataFrame:
    """(graph, node, community) for the edges (graph, a, b, w) of any number of graphs without common nodes.

    In graphs of more than `bound` edges, nodes with one neighbour are laid to it; what stays large is moved, refined to connected
    parts and contracted by Spark jobs over all of them at once until they are small or nothing changes any more; small ones
    go to one task each. Communities are connected and named by their least node.
    """
    edges = cut(edges)
    ends = edges.select("graph", F.col("a").alias("node")).unionByName(edges.select("graph", F.col("b").alias("node"))).distinct()
    wide = edges.groupBy("graph").agg(F.count("*").alias("n")).where(F.col("n") > bound).select("graph")
    large = cut(edges.join(wide, "graph", "left_semi"))
    if large.isEmpty():
        member = cut(ends.withColumn("community", F.col("node")))
    else:
        hung = cut(_pendants(large))
        member = cut(ends.join(hung, ["graph", "node"], "left").select("graph", "node", F.coalesce("community", "node").alias("community")))
        edges = cut(edges.join(wide, "graph", "left_anti").unionByName(_contract(large, hung.drop("graph"))))
    kind = dict(edges.dtypes)["a"]
    done = None
    while True:
        size = cut(edges.groupBy("graph").agg(F.count("*").alias("n")))
        few = edges.join(size.where(F.col("n") <= bound).select("graph"), "graph", "left_semi")
        found = few.groupBy("graph").applyInPandas(_small, f"node {kind}, community {kind}")
        done = found if done is None else done.unionByName(found)
        edges = cut(edges.join(size.where(F.col("n") > bound).select("graph"), "graph", "left_semi"))
        if edges.isEmpty():
            break
        moved = cut(_moved(edges))
        of = moved.select("node", "community")
        inner = edges.where("a <> b").join(of.withColumnRenamed("node", "a"), "a").join(of.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b").where("community = cb")
        parts = connected_components(moved.select(F.col("node").alias("id")), inner.select(F.col("a").alias("source"), F.col("b").alias("target")))
        parts = cut(parts.select(F.col("id").alias("node"), F.col("component").alias("community")).join(moved.select("graph", "node"), "node"))
        changed = parts.where("node <> community").select("graph").distinct()
        final = parts.join(changed, "graph", "left_anti").select("node", "community")
        done = done.unionByName(final)
        parts = parts.join(changed, "graph", "left_semi")
        edges = cut(_contract(edges.join(changed, "graph", "left_semi"), parts))
        up = parts.select(F.col("node").alias("community"), F.col("community").alias("up"))
        member = cut(member.join(up, "community", "left").select("graph", "node", F.coalesce("up", "community").alias("community")))
    last = cut(done).select(F.col("node").alias("community"), F.col("community").alias("up"))
    merged = cut(member.join(last, "community", "left").select("graph", "node", F.coalesce("up", "community").alias("community")))
    least = merged.groupBy("community").agg(F.min("node").alias("least"))
    return merged.join(least, "community").select("graph", "node", F.col("least").alias("community"))


def hierarchy(nodes: DataFrame, edges: DataFrame, max_size: int = MAX_SIZE, bound: int = BOUND) -> DataFrame:
    """(id, level, community, parent): communities of level 0, and of those with more than `max_size` members their divisions.

    nodes(id), edges(source, target, weight). A community of level 0 maximizes modularity in the whole graph; one with too
    many members is divided within its own edges, until all are small enough or don't divide any further. A community is
    named by its level and its least member; parent is null at level 0. Isolated nodes are communities of their own.
    """
    kind = dict(nodes.dtypes)["id"]
    pairs = undirected(edges)
    name = lambda level, c: F.concat(F.lit(f"{level}-"), F.col(c).cast("string"))
    found = partition(pairs.select(F.lit(0).alias("graph"), "a", "b", "w"), bound).select(F.col("node").alias("id"), "community")
    now = cut(nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community")))
    out = now.select("id", F.lit(0).alias("level"), name(0, "community").alias("community"), F.lit(None).cast("string").alias("parent"))
    level = 0
    while True:
        crowded = now.groupBy("community").agg(F.count("*").alias("n")).where(F.col("n") > max_size).select("community")
        crowded = cut(now.join(crowded, "community", "left_semi"))
        of = lambda c: crowded.select(F.col("id").alias(c), F.col("community").alias(f"of_{c}"))
        inner = pairs.join(of("a"), "a").join(of("b"), "b").where("of_a = of_b").select(F.col("of_a").alias("graph"), "a", "b", "w")
        if inner.isEmpty():
            return out
        split = partition(inner, bound).select(F.col("node").cast(kind).alias("id"), F.col("community").alias("next"))
        split = cut(crowded.join(split, "id"))
        whole = split.groupBy("community").agg(F.min("next").alias("lo"), F.max("next").alias("hi")).where("lo <> hi").select("community")
        split = cut(split.join(whole, "community", "left_semi"))
        if split.isEmpty():
            return out
        out = out.unionByName(split.select("id", F.lit(level + 1).alias("level"), name(level + 1, "next").alias("community"), name(level, "community").alias("parent")))
        now, level = split.select("id", F.col("next").alias("community")), level + 1


def sizes(membership: DataFrame) -> DataFrame:
    """(community, level, parent, size)."""
    return membership.groupBy("community", "level", "parent").agg(F.count("*").alias("size"))


def lowest(membership: DataFrame) -> DataFrame:
    """(id, community): each node's community of the lowest level."""
    return membership.groupBy("id").agg(F.min_by("community", "level").alias("community"))
