"""SimHash near duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.lineage import cut
from attesta.llm.common import lower_ascii, small_batches, texts, words
from attesta.llm.components import components

BITS = 64
BLOCK = 1 << 16


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[at : at + BLOCK], dtype="<i8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fingerprint long) of every row.

    Words of the A-Z-lowered text in shingles of `width`, repeats included, space-joined, hashed by XXH64 with seed
    42; a bit is set if more than half of the hashes have it. A text with fewer words is one shingle; a null text or
    one without words has fingerprint zero. Hashes are made in the JVM, bits are counted by numpy in Arrow batches.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def majority(hashes: pd.Series) -> pd.Series:
        return pd.Series([_majority(h) for h in hashes], dtype="int64")

    split = texts(docs, key, text).select("doc_id", words(lower_ascii(F.col("text"))).alias("w"))
    n = F.size("w")
    hashes = (
        F.when(n == 0, F.array().cast("array<bigint>"))
        .when(n < width, F.array(F.xxhash64(F.concat_ws(" ", "w"))))
        .otherwise(
            F.transform(
                F.sequence(F.lit(0), n - width),
                lambda i: F.xxhash64(F.concat_ws(" ", *[F.get("w", i + k) for k in range(width)])),
            )
        )
    )
    return split.select("doc_id", majority(hashes).alias("fingerprint"))


def ball_links(prints: DataFrame) -> DataFrame:
    """(a, b): links of distinct fingerprints that hold together all pairs at two or fewer differing bits.

    Every distinct fingerprint emits itself and its 64 neighbours at one bit; two fingerprints at distance two or
    less meet in at least one variant. What arrives at a variant is one word of 64 flags, combined before the
    shuffle, and each of its members lies at one bit or less from it: all are within two bits of each other, so one
    link to the least member keeps the whole set connected and no pairs are enumerated.
    """
    one = F.lit(1).cast("long")
    # Few bytes become many rows here, so the partitions are not left to a merge by size; a hash of its own keeps this
    # exchange apart from the one of distinct().
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = prints.select("fingerprint").distinct().repartition(n, F.xxhash64("fingerprint")).select("fingerprint", F.explode(F.sequence(F.lit(-1), F.lit(BITS - 1))).alias("i"))
    flag = F.when(F.col("i") >= 0, F.expr("shiftleft(1L, i)")).otherwise(F.lit(0).cast("long"))
    met = (
        sent.select(F.col("fingerprint").bitwiseXOR(flag).alias("variant"), flag.alias("flag"))
        .groupBy("variant")
        .agg(F.bit_or("flag").alias("flags"), F.max(F.col("flag") == 0).alias("own"))
        .where(F.bit_count("flags") + F.col("own").cast("int") > 1)
    )
    near = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit("flags", i) == 1),
        lambda i: F.col("variant").bitwiseXOR(F.call_function("shiftleft", one, i)),
    )
    members = met.select(F.concat(F.when(F.col("own"), F.array("variant")).otherwise(F.array().cast("array<bigint>")), near).alias("m"))
    pairs = members.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint long, component_id): documents linked through fingerprints at two or fewer differing bits.

    component_id is the smallest doc_id reachable, the document's own included (null keys don't count, unless a
    component has no other). One row for every input row, repeated rows included; texts without words share the
    fingerprint zero and are linked like any others. An empty table gives an empty one. Equal texts meet in one
    fingerprint before anything is linked, so large groups of copies cost one key.
    """
    own = cut(fingerprints(docs, key, text))
    roots = components(ball_links(own)).select(F.col("id").alias("fingerprint"), "root")
    least = own.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).join(roots, "fingerprint", "left")
    least = cut(least.select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least"))
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(least.select("fingerprint", "root").join(named, "root").drop("root"), "fingerprint").select(
        "doc_id", "fingerprint", "component_id"
    )


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, without those whose component has a smaller key.

    Rows that repeat the smallest key stay; rows with a null key stay only if no other row of the component has a key.
    """
    kept = near_duplicates(docs, key, text).where("doc_id <=> component_id").select("doc_id").distinct()
    return docs.join(kept, docs[key].eqNullSafe(kept["doc_id"]), "left_semi")
