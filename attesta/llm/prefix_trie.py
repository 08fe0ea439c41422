"""Prefix trie of conversations, rolled up by centroid decomposition of its parent edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.lineage import cut
from attesta.llm.common import broadcast_if_small

#: Turns of a conversation that one task sums up at most, and ids that one piece of a list of ids holds at most.
BLOCK, PIECE_BITS = 4096, 10
#: Components of this weight or less are finished inside a task; a component has no more nodes than weight.
BOUND = 2048
#: Rows that a task finishes together at least, whole components each.
TOGETHER = 50_000
#: Independent sums of 31-bit hashes that name a prefix.
SUMS = 4


def ordered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, digest, bytes): turns numbered from 1 in each conversation, a null turn first, equal turns by digest.

    Null roles and texts are empty; rows without a conversation are left out. Positions come from ranges of the sorted
    rows, with one offset for each conversation and range, so that a conversation of any length is spread over tasks.
    """
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sized = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.octet_length(said(text)).cast("long").alias("bytes"),
        F.unhex(F.md5(F.concat(F.length(said(role)).cast("string"), F.lit(":"), said(role), said(text)).cast("binary"))).alias("digest"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    ranged = sized.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = cut(ranged.select("*", F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("part")))
    pieces = ranged.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("conv_id", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first") + 1).alias("offset"))
    return ranged.join(offsets, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("offset")).alias("pos"), "digest", "bytes")


def grafted(turns: DataFrame, head: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of another: (conv_id, length) and (conv_id, length, depth, digest, bytes).

    `head` and `base` are expressions over conv_id: the first `head` turns of conversation `base` (all of them if it has
    fewer, none if there is no such conversation), then the conversation's own turns after its first `head`.
    `turns` is a result of `ordered_turns`.
    """
    turns = cut(turns)
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    plan = sizes.select("conv_id", "own", head.alias("head"), base.alias("base"))
    plan = plan.join(sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left")
    taken = F.least("head", F.coalesce("there", F.lit(0)))
    plan = cut(plan.select("conv_id", "base", "head", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length")))
    own = turns.join(plan, "conv_id").where("pos > head").withColumn("depth", F.col("pos") - F.col("head") + F.col("taken"))
    lent = turns.withColumnRenamed("conv_id", "base").join(plan, "base").where("pos <= head").withColumn("depth", F.col("pos"))
    columns = ["conv_id", "length", "depth", "digest", "bytes"]
    return plan.select("conv_id", "length"), own.select(columns).unionByName(lent.select(columns))


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, length, depth, bytes, key, parent): names of the prefix that ends at each turn and of the one before it.

    A name is made of sums over (depth, turn) of independent hashes, 124 bits in all, so that blocks of a long
    conversation are summed apart and shifted by the sums of the blocks before them.
    """
    hashed = rows.select(
        "*", F.floor((F.col("depth") - 1) / BLOCK).alias("block"), *[F.xxhash64(F.lit(k), "depth", "digest").bitwiseAND(F.lit((1 << 31) - 1)).alias(f"x{k}") for k in range(SUMS)]
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = hashed.where(F.col("length") > BLOCK).groupBy("conv_id", "block").agg(*[F.sum(f"x{k}").alias(f"t{k}") for k in range(SUMS)])
    shifts = whole.select("conv_id", "block", *[F.sum(f"t{k}").over(before).alias(f"o{k}") for k in range(SUMS)])
    summed = hashed.select("*", *[F.sum(f"x{k}").over(inside).alias(f"s{k}") for k in range(SUMS)]).join(shifts, ["conv_id", "block"], "left")
    here = [F.col(f"s{k}") + F.coalesce(f"o{k}", F.lit(0)) for k in range(SUMS)]
    return summed.select(
        "conv_id", "length", "depth", "bytes", _name(F.col("depth"), here).alias("key"), _name(F.col("depth") - 1, [here[k] - F.col(f"x{k}") for k in range(SUMS)]).alias("parent")
    )


def _settle(part: pd.DataFrame, values: list[str]) -> pd.DataFrame:
    """Subtree sums of whole components at once: centroids are taken out until no node is left."""
    n = len(part)
    at = part.assign(row=np.arange(n), up=part["depth"] - 1)
    joined = at.merge(at[["comp_node", "comp_depth", "depth", "node", "row"]].rename(columns={"depth": "up", "node": "parent_node", "row": "parent"}), "left", ["comp_node", "comp_depth", "up", "parent_node"])
    parent = joined["parent"].fillna(-1).to_numpy(dtype=np.int64)
    depth, weight = part["depth"].to_numpy(), part["weight"].to_numpy().copy()
    worth, sums = part[values].to_numpy(dtype=np.int64), np.zeros((n, len(values)), dtype=np.int64)
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)
    top = np.full(n, -1)
    for level in levels:
        top[level] = np.where(parent[level] < 0, level, top[parent[level]])
    live = np.ones(n, dtype=bool)
    while live.any():
        heavy = by_depth[(live & (2 * weight > weight[top]))[by_depth]]
        centre = np.full(n, -1)
        centre[top[heavy]] = heavy  # the deepest is written last
        centre = np.where(live, centre[top], -1)
        below = np.full(n, -1)
        for level in levels:
            level = level[live[level]]
            up = parent[level]
            below[level] = np.where(up < 0, -1, np.where(up == centre[level], level, below[up]))
        chosen = np.unique(centre[live])
        gathered = np.zeros_like(sums)
        under = live & ((below >= 0) | (centre == np.arange(n)))
        np.add.at(gathered, centre[under], worth[under])
        source, now, first = chosen, chosen, True
        cut_weight = weight[chosen]
        while len(now):
            sums[now] += gathered[source]
            if not first:
                weight[now] -= cut_weight
            inner = parent[now] >= 0
            source, cut_weight, now, first = source[inner], cut_weight[inner], parent[now[inner]], False
        parent[live & (parent >= 0) & (parent == centre)] = -1
        live[chosen] = False
        top = np.where(below >= 0, below, top)
    out = part[["node", "depth"]].copy()
    for i, v in enumerate(values):
        out[v] = sums[:, i] + part[f"sum_{v}"].to_numpy()
    return out


def _settled(small: DataFrame, values: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            held.append(batch)
            if sum(map(len, held)) >= TOGETHER:
                whole = pd.concat(held, ignore_index=True)
                last = (whole["comp_node"] == whole["comp_node"].iat[-1]) & (whole["comp_depth"] == whole["comp_depth"].iat[-1])
                held = [whole[last]]
                if not last.all():
                    yield _settle(whole[~last].reset_index(drop=True), values)
        if held:
            yield _settle(pd.concat(held, ignore_index=True), values)

    sorted_rows = small.repartition("comp_node", "comp_depth").sortWithinPartitions("comp_node", "comp_depth", "depth", "node")
    return sorted_rows.mapInPandas(run, ", ".join(["node long", "depth long", *[f"{v} long" for v in values]]))


def rollup(nodes: DataFrame, paths: DataFrame, values: list[str], bound: int = BOUND) -> DataFrame:
    """(node, depth, *values): every value summed over the subtree of each node, its own included.

    nodes: (node, depth, parent_node, weight, *values), where (node, depth) is unique, node is the least conversation
    that passes, weight adds up the turns of passing conversations from there on, and the one root has parent_node null.
    paths: (conv_id, depth, node, parent_node), the nodes on the way of a conversation, the root left out.

    A component is a connected piece of a tree, named by its top. Each round takes the deepest node that holds more than
    half of the weight of its component as centroid; what hangs under it becomes components of their own, all of half the
    weight or less, and the total of the centroid with all under it is added to the nodes between it and the top. So
    rounds grow with the logarithm of the weight, whatever the depth, and each node gets one row a round. Components
    of `bound` or less, none of which has more nodes than that, are split up in the same way inside one task.
    """
    sums = [f"sum_{v}" for v in values]
    state = ["node", "depth", "parent_node", "comp_node", "comp_depth", "total", "weight", *values, *sums]
    roots = nodes.where("parent_node IS NULL").select(F.col("node").alias("comp_node"), F.col("depth").alias("comp_depth"), F.col("weight").alias("total"))
    first = nodes.crossJoin(F.broadcast(roots))  # one row: all conversations start at the empty sequence
    live = cut(first.select(*state[:7], *values, *[F.lit(0).cast("long").alias(s) for s in sums]))
    finished, small = [], [live.where(F.col("total") <= bound)]
    live = live.where(F.col("total") > bound)
    step = paths.select(F.col("conv_id").alias("of"), F.col("depth").alias("of_depth"), F.col("node").alias("child"), F.col("parent_node").alias("above"))
    while not live.isEmpty():
        heavy = live.where(2 * F.col("weight") > F.col("total")).groupBy("comp_node", "comp_depth").agg(F.max(F.struct("depth", "node", "weight")).alias("c"))
        centres = cut(heavy.select("comp_node", "comp_depth", F.col("c.node").alias("c_node"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")))
        placed = live.join(broadcast_if_small(centres), ["comp_node", "comp_depth"])
        placed = placed.join(step, (F.col("depth") > F.col("c_depth")) & (F.col("of") == F.col("node")) & (F.col("of_depth") == F.col("c_depth") + 1), "left")
        centre = (F.col("node") == F.col("c_node")) & (F.col("depth") == F.col("c_depth"))
        place = F.when(centre, 0).when(F.col("above") == F.col("c_node"), 1).otherwise(2)
        placed = cut(placed.withColumn("place", place).drop("of", "of_depth", "above"))
        under = placed.where("place < 2").groupBy("comp_node", "comp_depth").agg(*[F.sum(v).alias(f"t_{v}") for v in values])
        added = ["c_weight", *[f"t_{v}" for v in values]]
        whole = cut(centres.join(under, ["comp_node", "comp_depth"]))
        inner = whole.join(paths.select("conv_id", "depth", "node"), (F.col("conv_id") == F.col("c_node")) & F.col("depth").between(F.col("comp_depth") + 1, F.col("c_depth") - 1))
        tops = whole.where("comp_depth < c_depth").select(F.col("comp_node").alias("node"), F.col("comp_depth").alias("depth"), *added)
        way = inner.select("node", "depth", *added).unionByName(tops)
        upper = placed.where("place = 2").drop("c_weight").join(way, ["node", "depth"], "left").join(
            broadcast_if_small(whole.select("comp_node", "comp_depth", F.col("c_weight").alias("lost"))), ["comp_node", "comp_depth"]
        )
        upper = upper.withColumn("total", F.col("total") - F.col("lost")).withColumn("weight", F.col("weight") - F.coalesce("c_weight", F.lit(0)))
        for v in values:
            upper = upper.withColumn(f"sum_{v}", F.col(f"sum_{v}") + F.coalesce(f"t_{v}", F.lit(0)))
        lower = placed.where("place = 1").withColumn("comp_node", F.col("child")).withColumn("comp_depth", F.col("c_depth") + 1)
        large = lower.groupBy("comp_node", "comp_depth").agg(F.max("weight").alias("found")).where(F.col("found") > bound)
        lower = lower.join(broadcast_if_small(cut(large)), ["comp_node", "comp_depth"], "left").withColumn("total", F.coalesce("found", F.lit(bound)))
        live = cut(upper.select(state).unionByName(lower.select(state)))
        taken = placed.where("place = 0").join(whole.select("comp_node", "comp_depth", *added[1:]), ["comp_node", "comp_depth"])
        finished.append(cut(taken.select("node", "depth", *[(F.col(f"sum_{v}") + F.col(f"t_{v}")).alias(v) for v in values])))
        small.append(live.where(F.col("total") <= bound))
        live = live.where(F.col("total") > bound)
    out = small[0]
    for more in small[1:]:
        out = out.unionByName(more)
    out = _settled(out, values)
    for more in finished:
        out = out.unionByName(more)
    return out


def ends(members: DataFrame) -> DataFrame:
    """(node, depth, sha256): SHA-256 of the ascending, comma-joined ids of the rows (node, depth, conv_id) of each node.

    Ids are gathered in pieces of a bounded range first; the pieces of a node then pass a running hash one after another,
    so that no list is ever held whole.
    """
    piece = F.expr(f"shiftright(conv_id, {PIECE_BITS})")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = members.groupBy("node", "depth", piece.alias("piece")).agg(joined.alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for batch in batches:
            out = []
            for node, depth, ids in zip(batch["node"], batch["depth"], batch["ids"], strict=True):
                if (node, depth) == now:
                    digest.update(f",{ids}".encode())
                    continue
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (node, depth), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["node", "depth", "sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, digest.hexdigest())], columns=["node", "depth", "sha256"])

    return pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "piece").mapInPandas(run, "node long, depth long, sha256 string")


def trie(conversations: DataFrame, rows: DataFrame, bound: int = BOUND) -> DataFrame:
    """Nodes of the prefix trie: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    conversations: (conv_id, length), one row each; rows: (conv_id, length, depth, digest, bytes), the turns by depth from 1.
    A node is a distinct sequence of first turns, from the empty one, which all conversations pass; conv_id is its least
    member, so (conv_id, depth) names it. n_leaves counts the childless nodes of its subtree, saved_tokens adds up
    (n_convs - 1) times the bytes of the last turn over it; both are rolled up by `rollup`. ends_sha256 covers the
    members that end there. No conversations give no nodes, not even a root.
    """
    named = cut(prefixes(rows))
    root = conversations.agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.sum(F.col("length") + 1).alias("weight")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    top = root.select(
        _name(F.lit(0), [F.lit(0)] * SUMS).alias("key"), F.lit(None).cast("binary").alias("parent"), "node", zero.alias("depth"), "n_convs", zero.alias("bytes"), "weight"
    )
    inner = named.groupBy("key").agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("node"), F.min("depth").cast("long").alias("depth"), F.count("*").alias("n_convs"),
        F.min("bytes").alias("bytes"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
    )
    keyed = cut(inner.unionByName(top))
    children = keyed.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    above = keyed.select(F.col("key").alias("parent"), F.col("node").alias("parent_node"))
    nodes = keyed.join(children, "key", "left").join(above, "parent", "left")
    nodes = cut(nodes.select(
        "key", "node", "depth", "parent_node", "n_convs", "weight", F.coalesce("n_children", zero).alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    ))
    paths = cut(named.select("conv_id", "length", "depth", "key").join(nodes.select("key", "node", "parent_node"), "key").drop("key"))
    values = ["n_leaves", "saved_tokens"]
    sums = rollup(nodes.select("node", "depth", "parent_node", "weight", *values), paths.drop("length"), values, bound)
    empty = conversations.where("length = 0").crossJoin(F.broadcast(root.select("node"))).select("node", zero.alias("depth"), "conv_id")
    last = ends(paths.where("depth = length").select("node", F.col("depth").cast("long").alias("depth"), "conv_id").unionByName(empty))
    out = nodes.drop("weight", *values).join(sums, ["node", "depth"]).join(last, ["node", "depth"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent_node").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha256", F.lit(nothing)).alias("ends_sha256"),
    )
