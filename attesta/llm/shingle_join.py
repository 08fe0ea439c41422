"""Jaccard self-join over word shingles with adaptive multi-match prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.lineage import cut
from attesta.llm.common import broadcast_if_small, lower_ascii, small_batches, texts, words
from attesta.llm.components import components

#: Words in a shingle, and the similarity in percent from which on two sets are linked.
WIDTH, LEAST = 5, 80
#: Tokens that are gathered before they are sent out, and tokens that meet in one range, about.
CHUNK, RANGE = 1 << 19, 1 << 22
#: Longest multiple match that is weighed, and what comparing one token costs next to looking at one posting.
MATCHES, COMPARE = 32, 0.125
#: Sets in a block, as a power of two.
BLOCK_BITS = 8
_MANY = 0xFFFF
_LOW = np.uint64((1 << 48) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, id, w): a digest that texts of the same words share, and a hash of every word of the A-Z-lowered text."""
    split = texts(docs, key, text).select("doc_id", words(lower_ascii(F.col("text"))).alias("w"))
    return split.select("doc_id", F.unhex(F.md5(F.concat_ws(" ", "w").cast("binary"))).alias("id"), F.transform("w", lambda w: F.xxhash64(w)).alias("w"))


def _mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (h ^ w) * _MIX
    return h ^ (h >> np.uint64(31))


def _shingled(flat: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of some texts at once, and where each text's begin; fewer words than `width` are one, no words none."""
    w, size = flat.view(np.uint64), np.diff(bounds)
    h = np.zeros(max(0, len(w) - width + 1), dtype=np.uint64)
    for j in range(width):
        h = _mixed(h, w[j : j + len(h)])
    doc = np.repeat(np.arange(len(size)), size)
    whole = np.arange(len(h)) + width <= bounds[1:][doc[: len(h)]]
    token, doc = h[whole], doc[: len(h)][whole]
    short = np.flatnonzero((size > 0) & (size < width))
    if len(short):
        ends = np.full(len(short), np.uint64(width), dtype=np.uint64) * _MIX + size[short].astype(np.uint64)
        for j in range(width - 1):
            more = size[short] > j
            ends[more] = _mixed(ends[more], w[bounds[short[more]] + j])
        token, doc = np.concatenate([token, ends]), np.concatenate([doc, short])
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    if len(token):
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])])
        token, doc = token[new], doc[new]
    return token, np.searchsorted(doc, np.arange(len(size) + 1))


def set_sizes(hashed: DataFrame, width: int) -> DataFrame:
    """(doc_id, id, n_shingles); id is null for an empty set."""

    @F.pandas_udf("long")
    def count(lists: pd.Series) -> pd.Series:
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
        flat = np.concatenate([np.empty(0, dtype=np.int64), *lists])
        return pd.Series(np.diff(_shingled(flat, bounds, width)[1]))

    return hashed.select("doc_id", "id", count("w").alias("n_shingles")).withColumn("id", F.when(F.col("n_shingles") > 0, F.col("id")))


def _blob(x: np.ndarray, kind: str) -> bytes:
    return x.astype(kind).tobytes()


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of equal values."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, dtype=np.int64)
    return first, np.append(first[1:], len(x)) if len(x) else first


def _sent(ranges: int, width: int):
    """Mapper: sets in chunks; every range gets the tokens that it owns, the chunk's own row says what is left to know.

    A token that several sets of a chunk hold is sent once, as one that repeats.
    """

    def chunk(number: int, ids: list[bytes], sets: list[np.ndarray]) -> Iterator[tuple]:
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        token, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        lane = ((token >> np.uint64(48)) * np.uint64(ranges) >> np.uint64(16)).astype(np.int64)
        token = (token & _LOW) | ((lane.astype(np.uint64) & np.uint64(0x7FFF)) << np.uint64(48))
        order = np.argsort(token, kind="stable")
        token, doc, lane = token[order], doc[order], lane[order]
        first, last = _runs(token)
        count = last - first
        several = count > 1
        owner = np.where(several, _MANY, doc[first])
        held = np.repeat(several, count)
        yield -1 - number, number, b"".join(ids), _blob(sizes, "<i4") + _blob(token[first[several]], "<u8"), _blob(count[several], "<i4") + _blob(doc[held], "<u2"), b""
        token, lane = token[first], lane[first]
        order = np.lexsort((owner, lane))
        token, lane, owner, count = token[order], lane[order], owner[order], count[order]
        for a, b in zip(*_runs(lane), strict=True):
            low = token[a:b] & _LOW
            yield int(lane[a]), number, _blob(low & np.uint64(0xFFFFFFFF), "<u4"), _blob(low >> np.uint64(32), "<u2"), _blob(owner[a:b], "<u2"), _blob(count[a:b][owner[a:b] == _MANY], "<i4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        known: dict[bytes, int] = {}
        sets: list[np.ndarray] = []
        total = 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(zip(*chunk(number, list(known), sets), strict=True))
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["lane", "chunk", "a", "b", "c", "d"])

        for batch in batches:
            lists = batch.column("w")
            bounds = lists.offsets.to_numpy().astype(np.int64)
            flat, bounds = _shingled(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False)), bounds - bounds[0], width)
            for i, name in enumerate(batch.column("id").to_pylist()):
                if bounds[i] == bounds[i + 1] or name in known:
                    continue
                known[name] = len(sets)
                sets.append(flat[bounds[i] : bounds[i + 1]])
                total += len(sets[-1])
                if total >= CHUNK or len(sets) >= _MANY:
                    yield from out()
                    number, total = number + 1, 0
                    known.clear()
                    sets.clear()
        if sets:
            yield from out()

    return run


def _repeated(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Range: sends back to every chunk those of its tokens that more than one set holds, with the number of sightings."""
    names = ["chunk", "a", "b", "c"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def told(lane: int, got: list[tuple]) -> Iterator[pa.RecordBatch]:
        low = np.concatenate([np.frombuffer(x[1], "<u4").astype(np.uint64) | (np.frombuffer(x[2], "<u2").astype(np.uint64) << np.uint64(32)) for x in got])
        owner = np.concatenate([np.frombuffer(x[3], "<u2") for x in got])
        place = np.repeat(np.arange(len(got)), [len(x[3]) // 2 for x in got])
        sight = np.ones(len(low), dtype=np.int64)
        sight[owner == _MANY] = np.concatenate([np.frombuffer(x[4], "<i4") for x in got])
        order = np.argsort(low, kind="stable")
        low, owner, place, sight = low[order], owner[order], place[order], sight[order]
        first, last = _runs(low)
        seen = np.repeat(np.add.reduceat(sight, first), last - first)
        keep = np.flatnonzero(seen > 1)
        keep = keep[np.argsort(place[keep], kind="stable")]
        low, owner, place, seen = low[keep] | (np.uint64(lane & 0x7FFF) << np.uint64(48)), owner[keep], place[keep], seen[keep]
        back = [
            (got[place[a]][0], _blob(low[a:b], "<u8"), _blob(np.minimum(seen[a:b], 0x7FFFFFFF), "<i4"), _blob(owner[a:b], "<u2"))
            for a, b in zip(*_runs(place), strict=True)
        ]
        if back:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*back, strict=True), kinds, strict=True)], names)

    now, got = None, []
    for batch in rows:
        for lane, *rest in zip(*[batch.column(c).to_pylist() for c in ["lane", *names, "d"]], strict=True):
            if lane < 0:  # a chunk's own row passes, marked by a negative chunk
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([-1 - rest[0], *rest[1:4]], kinds, strict=True)], names)
                continue
            if lane != now and got:
                yield from told(now, got)
                got = []
            now = lane
            got.append(tuple(rest))
    if got:
        yield from told(now, got)


def prefix_length(seen: np.ndarray, n: int, overlap: int) -> tuple[int, int]:
    """(matches, length): how many shared prefix tokens to ask for, and how many of the repeated tokens that prefix holds.

    `seen` are the sightings of the repeated tokens of a set of n, rarest first. Sets that share `overlap` tokens share
    at least m of the first n - overlap + m of each in any common order, tokens that nobody else holds come first. A
    prefix costs a look at each of its postings, and a comparison for each set that has m of them: of as many others as
    hold the most frequent token, each holds a token with the share of its sightings, all told by a normal estimate.
    """
    m = np.arange(1, min(MATCHES, overlap) + 1)
    last = len(seen) - overlap + m - 1
    group = max(float(seen[-1]) - 1, 1.0)
    share = np.minimum((seen - 1) / group, 1.0)
    mean, spread = np.cumsum(share)[last], np.sqrt(np.cumsum(share * (1 - share))[last] + 1e-9)
    likely = 1 / (1 + np.exp(np.clip(-1.702 * (mean - m + 0.5) / spread, -50, 50)))
    best = int(np.argmin(np.cumsum(seen)[last] + group * likely * n * COMPARE))
    return best + 1, int(last[best]) + 1


def _kept(least: int):
    """Chunk: sets whose repeated tokens suffice for a link, tokens from the rarest on, and their adaptive prefixes."""

    def finish(own: tuple, back: list[tuple]) -> Iterator[tuple]:
        ids, more, last = own
        k = len(ids) // 16
        sizes, several = np.frombuffer(more, "<i4", k), np.frombuffer(more, "<u8", offset=4 * k)
        counts = np.frombuffer(last, "<i4", len(several))
        holders = np.frombuffer(last, "<u2", offset=4 * len(several))
        if not back:
            return
        token, seen, owner = (np.concatenate([np.frombuffer(x[i], kind) for x in back]) for i, kind in enumerate(["<u8", "<i4", "<u2"]))
        many = owner == _MANY
        sightings = seen[many][np.argsort(token[many])].astype(np.int64)
        token = np.concatenate([token[~many], np.repeat(several, counts)])
        seen = np.concatenate([seen[~many].astype(np.int64), np.repeat(sightings, counts)])
        doc = np.concatenate([owner[~many], holders]).astype(np.int64)
        held = np.bincount(doc, minlength=k)
        need = (least * sizes.astype(np.int64) + 99) // 100
        keep = (held >= need)[doc]
        token, seen, doc = token[keep], seen[keep], doc[keep]
        order = np.lexsort((token, seen, doc))
        token, seen, doc = token[order], seen[order], doc[order]
        for a, b in zip(*_runs(doc), strict=True):
            i = int(doc[a])
            matches, length = prefix_length(seen[a:b], int(sizes[i]), int(need[i]))
            yield ids[16 * i : 16 * i + 16], int(sizes[i]), matches, length, token[a:b].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            rows = list(rows)
            if rows:
                kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "n", "matches", "length", "tokens"])

        now, own, back = None, None, []
        for batch in batches:
            for of, chunk, *rest in zip(*[batch.column(c).to_pylist() for c in ["of", "chunk", "a", "b", "c"]], strict=True):
                if of != now:
                    if own:
                        yield from out(finish(own, back))
                    now, own, back = of, None, []
                if chunk < 0:
                    own = rest
                else:
                    back.append(rest)
        if own:
            yield from out(finish(own, back))

    return run


def candidates(hashed: DataFrame, size_in_bytes: int, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """(id, n, matches, length, tokens): different sets that can have a partner at all, with their adaptive prefixes.

    hashed: a result of `word_hashes`; n is the size of a set, tokens are those of its tokens that other sets hold
    too, from the rarest to the most frequent (ties by token; copies count once in a chunk, and any common order is
    right), of which the first `length` are the prefix and `matches` of them must be shared. A set that shares fewer
    tokens with all others together than a link takes has no partner and is left out. Only tokens and two bytes for their
    owner are shuffled, a token that is frequent in a chunk once, so no token is hot.
    """
    spark = hashed.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = int(min(1 << 16, max(4 * n, -(-size_in_bytes // (6 * RANGE)))))
    blobs = "chunk long, a binary, b binary, c binary"
    sent = hashed.select("id", "w").mapInArrow(_sent(ranges, width), f"lane long, {blobs}, d binary")
    back = sent.repartition(n, "lane").sortWithinPartitions("lane").mapInArrow(_repeated, blobs)
    of = F.when(F.col("chunk") < 0, -1 - F.col("chunk")).otherwise(F.col("chunk"))
    chunks = back.withColumn("of", of).repartition(n, "of").sortWithinPartitions("of")
    kept = chunks.mapInArrow(_kept(least), "id binary, n int, matches int, length int, tokens array<bigint>")
    return kept.dropDuplicates(["id"])


def _linked(n: np.ndarray, matches: np.ndarray, prefixes: list[np.ndarray], tokens: list[np.ndarray], group: np.ndarray, side: np.ndarray | None, least: int) -> list[tuple[int, int]]:
    """Links that connect whatever is linked among the sets of a block, or between two blocks (`side`).

    Shared prefix tokens are counted for all pairs at once; pairs with enough of them are compared, least first, unless
    they are connected already.
    """
    k = len(n)
    token, row = np.concatenate(prefixes), np.repeat(np.arange(k), [len(p) for p in prefixes])
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    shared = np.zeros((k, k), dtype=np.int32)
    for a, b in zip(*_runs(token), strict=True):
        if b - a > 1:
            shared[np.ix_(row[a:b], row[a:b])] += 1
    good = shared >= np.minimum.outer(matches, matches)
    good &= 100 * np.minimum.outer(n, n) >= least * np.maximum.outer(n, n)
    good &= group[:, None] != group[None, :]
    if side is not None:
        good &= side[:, None] != side[None, :]
    left, right = np.nonzero(np.triu(good, 1))
    parent = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    whole: dict[int, np.ndarray] = {}
    links = []
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        a, b = root(int(group[i])), root(int(group[j]))
        if a == b:
            continue
        for x in (i, j):
            if x not in whole:
                whole[x] = np.sort(tokens[x])
        common = len(np.intersect1d(whole[i], whole[j], assume_unique=True))
        if 100 * common >= least * (n[i] + n[j] - common):
            parent[max(a, b)] = min(a, b)
            links.append((i, j))
    return links


def _columns(rows: pd.DataFrame) -> tuple:
    tokens = [np.asarray(t, dtype=np.int64) for t in rows["tokens"]]
    return rows["n"].to_numpy(np.int64), rows["matches"].to_numpy(np.int64), [t[:m] for t, m in zip(tokens, rows["length"], strict=True)], tokens


def _inside(least: int):
    """(id, block, root): sets of each block under the least id that they are linked to inside it."""

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["id"].tolist()
        up = list(range(len(ids)))

        def root(x: int) -> int:
            while up[x] != x:
                x = up[x]
            return x

        for i, j in _linked(*_columns(rows), np.arange(len(ids)), None, least):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
        least_of: dict[int, bytes] = {}
        for i, x in enumerate(ids):
            r = root(i)
            least_of[r] = min(least_of.get(r, x), x)
        return pd.DataFrame({"id": ids, "block": rows["block"], "root": [least_of[root(i)] for i in range(len(ids))]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for block, part in batch.groupby("block", sort=False):
                if held and held[0]["block"].iat[0] != block:
                    yield settle(pd.concat(held, ignore_index=True))
                    held = []
                held.append(part)
        if held:
            yield settle(pd.concat(held, ignore_index=True))

    return run


def _between(least: int):
    """(a, b): links between the sets of two blocks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = {x: i for i, x in enumerate(dict.fromkeys(rows["root"]))}
        side = (rows["block"] == rows["block_a"]).to_numpy()
        ids = rows["id"].tolist()
        found = _linked(*_columns(rows), rows["root"].map(names).to_numpy(), side, least)
        return pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["a", "b"])

    return run


def linked_sets(sets: DataFrame, least: int = LEAST, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(id, root): the least id of its component for every set of `candidates` that shares a prefix token with another.

    Sets that share prefix tokens are brought together in blocks of bounded size and joined there first. What is left
    in different components is linked by stars, each component to the least one under every token that crosses blocks, and
    only then by pairs of those blocks that still have a token in common; so a large group of linked sets costs its
    stars, and no pair of sets is a row before it is a link.
    """
    spark = sets.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings = sets.select("id", F.explode(F.slice("tokens", F.lit(1), F.col("length"))).alias("token"))
    hubs = postings.groupBy("token").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("token", "hub")
    live = cut(postings.join(hubs, "token"))
    near = live.groupBy("id").agg(F.min("hub").alias("near"))
    nearest = live.join(near, "id").groupBy("token").agg(F.min("near").alias("near"))
    label = live.join(nearest, "token").groupBy("id").agg(F.min("near").alias("near"))
    order = ["near", "id"]
    sorted_sets = sets.join(label, "id").repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = cut(sorted_sets.withColumn("block", F.shiftright(F.monotonically_increasing_id(), block_bits)))
    inside = cut(placed.select("id", "n", "matches", "length", "tokens", "block").mapInPandas(_inside(least), "id binary, block long, root binary"))

    def crossing(roots: DataFrame) -> DataFrame:
        """(token, id, block, root) of the tokens that still cross blocks and components."""
        rows = live.select("token", "id").join(roots, "id")
        wide = rows.groupBy("token").agg(F.min("block").alias("b0"), F.max("block").alias("b1"), F.min("root").alias("r0"), F.max("root").alias("r1"))
        return cut(rows.join(wide.where("b0 <> b1 AND r0 <> r1").select("token", F.col("r0").alias("hub_root")), "token"))

    def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
        """`roots` after links (a, b) between roots."""
        up = components(links).select(F.col("id").alias("root"), F.col("root").alias("up"))
        return cut(roots.join(up, "root", "left").select("id", "block", F.coalesce("up", "root").alias("root")))

    roots = inside
    rows = crossing(roots)
    if rows.isEmpty():
        return roots.select("id", "root")
    first = rows.groupBy("token", "root", "hub_root").agg(F.min("id").alias("id"))
    hub = first.where("root = hub_root").select("token", F.col("id").alias("hub"))
    stars = first.where("root <> hub_root").join(hub, "token").select("hub", "hub_root", "id", "root").distinct()
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"t_{c}"))
    common = F.size(F.array_intersect("t_hub", "t_id"))
    alike = 100 * common >= least * (F.col("n_hub") + F.col("n_id") - common)
    stars = stars.join(side("hub"), "hub").join(side("id"), "id").where(alike).select(F.col("hub_root").alias("a"), F.col("root").alias("b"))
    roots = joined(roots, stars)
    rows = crossing(roots)
    held = rows.select("token", "block").distinct()
    pairs = held.withColumnRenamed("block", "block_a").join(held.withColumnRenamed("block", "block_b"), "token").where("block_a < block_b").select("block_a", "block_b").distinct()
    ends = cut(pairs).select("block_a", "block_b", F.explode(F.array("block_a", "block_b")).alias("block"))
    members = placed.select("id", "n", "matches", "length", "tokens").join(rows.select("id", "block", "root").distinct(), "id")
    columns = ["id", "n", "matches", "length", "tokens", "root", "block", "block_a"]
    found = members.join(ends, "block").select(*columns, "block_b").groupBy("block_a", "block_b").applyInPandas(_between(least), "a binary, b binary")
    of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}"))
    links = cut(found).join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    return joined(roots, links).select("id", "root")


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, least: int = LEAST, block_bits: int = BLOCK_BITS, empty: bool = False
) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked by sets of word shingles with 100 |A & B| >= least |A or B|.

    One row for every input row; component_id is the smallest doc_id reachable, the document's own included (null keys
    don't count, unless a component has no other). Texts of the same words share one set, so copies are joined
    once; a null text, or one without words, has an empty set and is linked with nothing, or with `empty` to others like it. Links inside what is connected
    already are not listed. Shingles are told apart by their hashes. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    hashed = word_hashes(docs, key, text)
    own = set_sizes(hashed, width)
    own = cut(own.withColumn("id", F.coalesce("id", F.unhex(F.lit("00")))) if empty else own)
    size = texts(docs, key, text).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    found = linked_sets(cut(candidates(hashed, size, width, least)), least, block_bits)
    least_of = own.where("id IS NOT NULL").groupBy("id").agg(F.min("doc_id").alias("least")).join(found, "id", "left")
    least_of = cut(least_of.select("id", F.coalesce("root", "id").alias("root"), "least"))
    named = least_of.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(least_of.select("id", "root").join(named, "root").drop("root"), "id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def changed_keys(docs: DataFrame, before: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id) whose text differs between the tables, where either has that key once."""
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    once = lambda d, h: texts(d, key, text).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.first(digest).alias(h)).where("n = 1").drop("n")
    return once(docs, "h_now").join(once(before, "h_then"), "doc_id").where("h_now <> h_then").select("doc_id")


def _own_left(now: DataFrame, then: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """(doc_id) of the rows of `now` that have no shingle in common with another row of `then` in their component.

    now(doc_id, w), then(doc_id, w): words of texts; groups(doc_id, component_id).
    """
    shingle = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, width)))
    named = broadcast_if_small(groups.withColumnRenamed("doc_id", "of"))

    def tokens(rows: DataFrame) -> DataFrame:
        held = rows.where("size(w) > 0").join(named, F.col("doc_id").eqNullSafe(F.col("of"))).drop("of")
        return held.select("component_id", "doc_id", F.explode(F.array_distinct(shingle)).alias("h"))

    holders = tokens(then).groupBy("component_id", "h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count_if(F.col("doc_id").isNull()).alias("unnamed"))
    other = (F.col("a") != F.col("doc_id")) | (F.col("b") != F.col("doc_id")) | (F.col("unnamed") > 0)
    left = tokens(now).join(holders, ["component_id", "h"], "left").groupBy("doc_id").agg(F.bool_or(F.coalesce(other, F.lit(False))).alias("shared"))
    return left.where("NOT shared").select("doc_id")


def first_by_both(docs: DataFrame, before: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """`first_of_each`, where documents are copies by their texts in `docs` or by their texts in `before`.

    A near copy of which equal lines were taken out is no longer like its original, though it was. Both joins are made for
    themselves: in one join every changed text would be held against what it was. A document of whose lines some were taken
    stays if nothing that is left of it (no shingle) stood in another document of its component: that is its own. Rows whose key
    is null or repeated are compared by their text in `docs`.
    """
    now = texts(docs, key, text)
    first = cut(jaccard_components(now, "doc_id", "text", width, least, empty=True).where("doc_id <=> component_id").select("doc_id").distinct())
    ids = cut(changed_keys(docs, before, key, text))
    changed = broadcast_if_small(ids)
    then = now.join(changed, "doc_id", "left_anti").unionByName(texts(before, key, text).join(changed, "doc_id", "left_semi"))
    linked = cut(jaccard_components(then, "doc_id", "text", width, least, empty=True).select("doc_id", "component_id").distinct())
    copies = linked.join(ids, "doc_id").where("doc_id <> component_id OR component_id IS NULL").select("doc_id", "component_id")
    groups = cut(linked.join(copies.select("component_id").distinct(), "component_id", "left_semi").select("doc_id", "component_id"))
    split = lambda d: d.select("doc_id", words(lower_ascii(F.col("text"))).alias("w"))
    own = _own_left(split(now.join(broadcast_if_small(copies.select("doc_id")), "doc_id", "left_semi")), split(then), groups, width)
    second = linked.where("doc_id <=> component_id").select("doc_id").unionByName(own).distinct()
    both = first.withColumnRenamed("doc_id", "of").join(second, F.col("of").eqNullSafe(F.col("doc_id"))).select(F.col("of"))
    return docs.join(both, docs[key].eqNullSafe(both["of"]), "left_semi")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """The rows of `docs`, all columns as they are, without those whose component has a smaller key.

    Texts without words are copies of one another here. Rows that repeat the smallest key stay; rows with a null key stay only
    if no other row of the component has a key. An empty table gives an empty one.
    """
    kept = jaccard_components(docs, key, text, width, least, empty=True).where("doc_id <=> component_id").select("doc_id").distinct()
    return docs.join(kept, docs[key].eqNullSafe(kept["doc_id"]), "left_semi")
