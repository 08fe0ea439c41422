"""Small pieces that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"
FOLDS = 5


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that no other column of the caller can clash; a null text becomes empty."""
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, GAP, -1), "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is (`lower` does just that where all bytes are ASCII)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), use)[0]


def fold(key: Column) -> Column:
    """Fold 0 is held out; the others are for learning. A null key belongs to none."""
    return F.crc32(key.cast("string").cast("binary")) % FOLDS


def held_out(key: Column) -> Column:
    return F.coalesce(fold(key) == 0, F.lit(False))


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows, so that a run of very long texts stays small in memory; results don't depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Marks a narrow table for broadcast after counting it; a larger one is left to a shuffled join.

    Only for tables whose rows have a fixed, small width; both ways give the same result.
    """
    return F.broadcast(df) if df.count() <= rows else df


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Column names close to `names` that `docs` doesn't have yet."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
