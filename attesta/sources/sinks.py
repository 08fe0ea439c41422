"""Sinks that never overwrite, spreadsheet guards, exports and verified vector storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.lineage import cut
from attesta.operators import vector_index as V
from attesta.sources import publishing as P


def write_new(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, inputs: list[str] | None = None, **options) -> None:
    """Write to a path that must not exist yet and must not touch an input."""
    if inputs and P.overlapping(inputs, [path]):
        raise ValueError(f"output {path} overlaps an input")
    writer = df.write.mode("errorifexists").options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)


def chunk_part(chunks: DataFrame) -> P.Part:
    """Chunks as JSON lines; arrays are also written as JSON text for flat consumers."""
    arrays = [n for n, t in chunks.dtypes if t.startswith("array")]
    return P.Part(chunks.select(*chunks.columns, *[F.to_json(c).alias(f"{c}_json") for c in arrays]), "json")


def write_chunks(chunks: DataFrame, path: str) -> int | None:
    """Publishes the chunks under `path`; None if they are the ones published last."""
    return P.publish(chunks.sparkSession, path, {"chunks": chunk_part(chunks)})


def formula_guard(c: Column | str) -> Column:
    """Prefix text a spreadsheet would read as a formula."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^(?U)\s*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def guarded(df: DataFrame) -> DataFrame:
    return df.select(*[formula_guard(n).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes])


def write_results_csv(results: DataFrame, path: str) -> None:
    write_new(guarded(results), path, "csv", header=True, escape='"')


def result_part(results: DataFrame) -> P.Part:
    """The flat result table as CSV that no spreadsheet reads as formulas."""
    return P.Part(guarded(results), "csv")


def table_parts(tables: dict[str, DataFrame]) -> dict[str, P.Part]:
    """Every graph table as JSON and CSV; nested columns become JSON text in CSV."""
    out = {}
    for name, df in tables.items():
        nested = [n for n, t in df.dtypes if t.startswith(("array", "map", "struct"))]
        flat = df.select(*[F.to_json(n).alias(n) if n in nested else F.col(n) for n in df.columns])
        out |= {f"{name}.json": P.Part(df, "json"), f"{name}.csv": P.Part(flat, "csv")}
    return out


def export_tables(tables: dict[str, DataFrame], folder: str) -> int | None:
    """Publishes all tables in both formats in one step."""
    return P.publish(next(iter(tables.values())).sparkSession, folder, table_parts(tables))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


EXPORTS = ("evidence", "docling", "rag", "results", "checks", "csv")


def export(kind: str, paper: str, parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of one paper for an export kind; csv is the guarded result table."""
    if kind not in EXPORTS:
        raise KeyError(f"unknown export {kind}")
    rows = parts["results" if kind == "csv" else kind].where(F.col("document_id") == paper)
    return guarded(rows) if kind == "csv" else rows


def export_paper(spark: SparkSession, paper: str, parts: dict[str, DataFrame], folder: str, inputs: list[str] | None = None) -> int | None:
    """All export kinds of a paper in one publication; csv is the guarded result table, the others are JSON lines."""
    made = {k: P.Part(export(k, paper, parts), "csv" if k == "csv" else "json") for k in EXPORTS if k == "csv" or k in parts}
    return P.publish(spark, folder, made, inputs)


def store_vectors(spark: SparkSession, incoming: DataFrame, path: str) -> DataFrame:
    """Publish missing vectors after reading them back, and report per index.

    Fails, before anything is visible, when a stored row differs from its input or a key occurs twice in it; rerunning an
    identical load adds nothing, and an empty one gives an empty report.
    """
    if not incoming.groupBy(*V.KEY).count().where("count > 1").isEmpty():
        raise ValueError("repeated keys among the incoming vectors")
    existing = stored_vectors(spark, path)
    existing = spark.createDataFrame([], incoming.schema) if existing is None else existing.select(incoming.columns)
    # The report describes the state before the load, so it is kept apart from the table.
    report = cut(V.storage_report(existing, incoming))
    touched = existing.join(incoming.select("index_id").distinct(), "index_id", "left_semi")
    known = incoming.join(existing.select(*V.KEY), V.KEY, "left_semi")
    if not V.read_back_differences(known, touched).isEmpty():
        raise RuntimeError("stored vectors differ from their input")
    new = cut(V.new_vectors(existing, incoming))
    if not new.isEmpty():
        P.publish(spark, path, {"vectors": P.Part(new, "parquet", ("index_id",))})
    return report


def stored_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """All published vectors under a path."""
    return P.read_all(spark, path, "vectors")
