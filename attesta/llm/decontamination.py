"""Benchmark decontamination: containment search over size-partitioned MinHash signatures, verified exactly."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.lineage import cut
from attesta.llm.common import broadcast_if_small, let, lower_ascii, texts, words

WIDTH, CONTAINED = 5, 0.8
#: Chance to miss a document that holds the least part of the shortest item that counts as contained.
MISS = 1e-4
CLASSES = 40


def _windows(w: Column, width: int, kind: str, one: Callable[[list[Column]], Column]) -> Column:
    """`one` of every window of `width` words of the array `w`, which is bound first: the optimizer may move this."""
    return let(
        w,
        lambda v: F.when(F.size(v) >= width, F.transform(F.sequence(F.lit(0), F.size(v) - width), lambda i: one([F.get(v, i + k) for k in range(width)])))
        .otherwise(F.array().cast(f"array<{kind}>")),
    )


def shingle_texts(w: Column, width: int) -> Column:
    """Space-joined windows of `width` words of the array column `w`; none if it has fewer."""
    return _windows(w, width, "string", lambda x: F.concat_ws(" ", *x))


def shingle_hashes(w: Column, width: int) -> Column:
    return _windows(w, width, "bigint", lambda x: F.xxhash64(*x))


def bin_load(least_shared: int, miss: float = MISS) -> float:
    """Shingles per bin at which none of `least_shared` shared shingles is the least of its bin with chance `miss`."""
    low, high = 0.0, 16.0
    for _ in range(60):
        mid = (low + high) / 2
        own = (1 - math.exp(-mid)) / mid if mid else 1.0
        low, high = (mid, high) if (1 - own) ** least_shared <= miss else (low, mid)
    return low


def signature(hashes: Column, size_class: Column, load: float) -> Column:
    """Least hash of each bin of a sorted array; the number of bins follows the upper size of the class."""
    if load < 1e-3:
        return hashes
    # A bin is the integer part of hash * bins / 2^64; bins is the class's upper size over the load.
    scale = F.pow(F.lit(2.0), size_class + 1) / F.lit(load) / F.lit(2.0**64)

    def first_of_bins(x: Column) -> Column:
        bin_of = lambda h: F.floor(h.cast("double") * x["scale"])
        pairs = F.arrays_zip(x["h"].alias("h"), F.concat(F.array(F.lit(None).cast("bigint")), x["h"]).alias("before"))
        kept = F.filter(pairs, lambda p: p["h"].isNotNull() & (p["before"].isNull() | (bin_of(p["h"]) != bin_of(p["before"]))))
        return F.transform(kept, lambda p: p["h"])

    return let(F.struct(hashes.alias("h"), scale.alias("scale")), first_of_bins)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", contained: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): documents that hold at least `contained` of an item's distinct shingles.

    Shingles are five words of the A-Z-lowered text; an item of fewer words is one shingle of all its words and is
    looked for among the shingles of that width. Items without words and null texts match nothing, repeated rows of
    documents or items give one pair, and pairs of null keys are left out.

    Documents are partitioned by the power of two of their number of distinct shingles. In each partition hashes fall
    into a number of bins that grows with the partition's size, and the least hash of every bin is the signature; an
    item probes with all its hashes. The load of a bin is chosen so that the shortest item is missed with a chance of
    MISS at most, however long the document is (very short items get bins of one shingle: nothing is missed). Candidate
    pairs are then verified with the shingles themselves. Items are broadcast if they are counted few, else shuffled.
    """
    own = texts(items, item_key, item_text).select(F.col("doc_id").alias("item_id"), words(lower_ascii(F.col("text"))).alias("w")).where(
        "item_id is not null and size(w) > 0"
    )
    own = own.select("item_id", "w", F.least(F.size("w"), F.lit(WIDTH)).alias("width"))
    shapes = own.groupBy("width").agg(F.min(F.size("w")).alias("n")).collect()  # five rows at most
    split = texts(docs, key, text).where("doc_id is not null").select("doc_id", words(lower_ascii(F.col("text"))).alias("w"))
    found = None
    for width, n in sorted(shapes):
        probes = own.where(F.col("width") == width).select("item_id", F.explode(F.array_distinct(shingle_texts(F.col("w"), width))).alias("shingle"))
        # Repeated rows of an item count once.
        probes = probes.distinct()
        sizes = probes.groupBy("item_id").agg(F.count("*").alias("n_item"))
        least = sizes.agg(F.min("n_item")).first()[0]
        load = bin_load(math.ceil(contained * least - 1e-9))
        some = _of_width(split, probes, sizes, width, load, contained)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = split.join(own, F.lit(False)).select("doc_id", "item_id", F.lit(0).cast("bigint").alias("n_shared"), F.lit(0).cast("bigint").alias("n_item"))
    return found


def _of_width(split: DataFrame, probes: DataFrame, sizes: DataFrame, width: int, load: float, contained: float) -> DataFrame:
    hashed = split.select("doc_id", F.sort_array(F.array_distinct(shingle_hashes(F.col("w"), width))).alias("hashes"))
    classed = hashed.select("doc_id", "hashes", F.floor(F.log2(F.size("hashes"))).cast("int").alias("size_class"))
    index = classed.select("doc_id", F.explode(signature(F.col("hashes"), F.col("size_class"), load)).alias("h"))
    # The same hash as that of a document's window: its words, not its text.
    probe = probes.select("item_id", F.split("shingle", " ").alias("w")).select("item_id", F.xxhash64(*[F.get("w", F.lit(k)) for k in range(width)]).alias("h"))
    candidates = cut(index.join(broadcast_if_small(probe), "h").select("doc_id", "item_id").distinct())
    shingles = (
        split.join(broadcast_if_small(candidates.select("doc_id").distinct()), "doc_id", "left_semi")
        .select("doc_id", F.explode(F.array_distinct(shingle_texts(F.col("w"), width))).alias("shingle"))
    )
    shared = (
        shingles.join(broadcast_if_small(probes), "shingle").select("doc_id", "item_id", "shingle").distinct()
        .groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    )
    return (
        shared.join(candidates, ["doc_id", "item_id"], "left_semi").join(broadcast_if_small(sizes), "item_id")
        .where(F.col("n_shared") >= F.lit(contained) * F.col("n_item")).select("doc_id", "item_id", "n_shared", "n_item")
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, columns unchanged, without documents that hold an item; rows with a null key stay."""
    hit = contaminated(docs, items, key, text).select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(hit, docs[key] == hit["__hit"], "left_anti")
