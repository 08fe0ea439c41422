"""Skew-safe building blocks: prefix scans and joins that never put one key into one task.

A window partitioned by a document, paper or ledger key runs as a single task per
key.  When one key holds a large share of all rows that task never finishes, so the
running operators here work in two levels: inside fixed-size position blocks first,
then over one summary row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def _blocked(df: DataFrame, pos: str, block: int) -> DataFrame:
    return df.withColumn("__block", F.floor(F.col(pos) / F.lit(block)).cast("long"))


def _join_blocks(df: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(blocks, [*keys, "__block"], "left").drop("__block")


def carry_last(
    df: DataFrame,
    keys: list[str],
    pos: str,
    values: dict[str, Column],
    *,
    inclusive: bool = True,
    block: int = BLOCK,
) -> DataFrame:
    """Last non-null value at (or strictly before) each row's position, per key."""
    work = _blocked(df, pos, block)
    inside = Window.partitionBy(*keys, "__block").orderBy(pos)
    frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    for name, value in values.items():
        work = work.withColumn(f"__v_{name}", value)
    summary = work.groupBy(*keys, "__block").agg(
        *[
            F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(pos))).alias(f"__s_{n}")
            for n in values
        ]
    )
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        *keys,
        "__block",
        *[F.last(f"__s_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in values],
    )
    for name in values:
        work = work.withColumn(name, F.last(f"__v_{name}", ignorenulls=True).over(frame))
    work = _join_blocks(work, summary, keys)
    for name in values:
        work = work.withColumn(name, F.coalesce(name, f"__c_{name}")).drop(f"__v_{name}", f"__c_{name}")
    return work


def running_sum(
    df: DataFrame, keys: list[str], pos: str, value: Column, out: str, *, block: int = BLOCK
) -> DataFrame:
    """Inclusive running sum of `value` in position order, per key."""
    work = _blocked(df, pos, block).withColumn("__v", value)
    inside = Window.partitionBy(*keys, "__block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        work.groupBy(*keys, "__block")
        .agg(F.sum("__v").alias("__t"))
        .select(*keys, "__block", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__o"))
    )
    work = work.withColumn(out, F.sum("__v").over(inside)).drop("__v")
    return _join_blocks(work, blocks, keys).withColumn(out, F.col(out) + F.col("__o")).drop("__o")


def ordinal(df: DataFrame, keys: list[str], pos: str, out: str, *, start: int = 0, block: int = BLOCK) -> DataFrame:
    """Dense position (`start`, `start`+1, …) in `pos` order, per key."""
    numbered = running_sum(df, keys, pos, F.lit(1), out, block=block)
    return numbered.withColumn(out, (F.col(out) - 1 + start).cast("int"))


def neighbour(df: DataFrame, keys: list[str], ordinal_col: str, values: dict[str, str], offset: int = -1) -> DataFrame:
    """lag/lead by a dense ordinal as an equi-join, so no key is confined to one task."""
    other = df.select(
        *keys,
        (F.col(ordinal_col) - offset).alias(ordinal_col),
        *[F.col(src).alias(dst) for dst, src in values.items()],
    )
    return df.join(other, [*keys, ordinal_col], "left")


def shuffled_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join by a shuffle of both sides.

    Spark estimates a scan by its compressed columns and sees no growth by expressions, generators or copies. Where rows
    grow with the input, its own choice may send millions of them through the driver as a small table.
    """
    return left.join(right.hint("merge"), on, how)


def salted_join(
    large: DataFrame,
    small: DataFrame,
    keys: list[str],
    *,
    spread: list[str],
    buckets: int = 16,
    how: str = "inner",
) -> DataFrame:
    """Equi-join in which each key of `large` is split over `buckets` tasks.

    `small` is replicated `buckets` times; use it for the side with few rows per key.
    """
    left = large.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return shuffled_join(left, right, [*keys, "__salt"], how).drop("__salt")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per key; Spark limits each map task to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
