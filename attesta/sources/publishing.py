"""Publications: several outputs that become visible in one step, or not at all.

A publication is a folder with a manifest. A load writes its parts under a name of its own, reads them back and compares
rows and fingerprints with what it was given, and publishes them with one small file in the manifest. Readers take
files from the manifest only: what an interrupted or refuted load has left is never seen, and nothing that was published
is ever overwritten. A load equal to the last one adds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, load string, part string, format string, layout string, rows long, fingerprint string"
#: Formats and the options that give every row back as it was.
FORMATS = {
    "parquet": ({}, {}),
    "json": ({"ignoreNullFields": "false"}, {}),
    "csv": (
        {"header": "true", "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"},
        {"header": "true", "escape": '"', "nullValue": "\\N", "multiLine": "true"},
    ),
}


@dataclass(frozen=True)
class Part:
    """Rows of one output and the format they are written in; CSV takes flat columns."""

    rows: DataFrame
    format: str = "parquet"
    partition_by: tuple[str, ...] = ()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def overlapping(inputs: list[str], outputs: list[str]) -> list[str]:
    """Output paths equal to, inside or above an input path."""
    clean = lambda p: p.rstrip("/") + "/"
    return [o for o in outputs if any(clean(o).startswith(clean(i)) or clean(i).startswith(clean(o)) for i in inputs)]


def _marks(columns: list[tuple[str, str]]) -> list[Column]:
    """Rows and an order-free fingerprint: the sum of the rows' hashes, nested values as JSON."""
    plain = [F.to_json(F.struct(n)) if t.startswith(("array", "map", "struct")) else F.col(n).cast("string") for n, t in sorted(columns)]
    said = [F.coalesce(c, F.lit("\x00")) for c in plain]
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*said).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("fingerprint")]


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each published part; none where nothing is published."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest") if exists(spark, f"{path}/manifest") else spark.createDataFrame([], MANIFEST)


def _read(spark: SparkSession, path: str, load: str, part: str, kind: str, layout: str) -> DataFrame:
    options = FORMATS[kind][1]
    return spark.read.schema(layout).options(**options).format(kind).load(f"{path}/loads/{load}/{part}")


def versions(spark: SparkSession, path: str) -> list[dict]:
    """Parts of the last version; a manifest has one row for each load and part."""
    rows = [r.asDict() for r in manifest(spark, path).collect()]
    last = max((r["version"] for r in rows), default=-1)
    return [r for r in rows if r["version"] == last]


def stage_load(spark: SparkSession, path: str, parts: Mapping[str, Part]) -> tuple[str, dict[str, dict]]:
    """Writes the parts under a new name and reads them back; nothing is visible yet. (name, marks by part)."""
    load, marks = str(uuid.uuid4()), {}
    for name, part in parts.items():
        if part.format not in FORMATS:
            raise ValueError(f"unknown format {part.format}")
        given = Observation()
        writer = part.rows.observe(given, *_marks(part.rows.dtypes)).write.mode("errorifexists").options(**FORMATS[part.format][0])
        if part.partition_by:
            writer = writer.partitionBy(*part.partition_by)
        writer.format(part.format).save(f"{path}/loads/{load}/{name}")
        layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part.rows.schema.fields)
        back = _read(spark, path, load, name, part.format, layout)
        found = back.agg(*_marks(part.rows.dtypes)).first()
        wanted = given.get
        if (found["rows"], found["fingerprint"]) != (wanted["rows"], wanted["fingerprint"]):
            raise RuntimeError(f"{name}: {found['rows']} rows read back differ from {wanted['rows']} rows written")
        marks[name] = {"format": part.format, "layout": layout, "rows": found["rows"], "fingerprint": found["fingerprint"]}
    return load, marks


def publish(spark: SparkSession, path: str, parts: Mapping[str, Part], inputs: list[str] | None = None) -> int | None:
    """Publishes all parts as the next version and returns its number, or None if they equal the last version."""
    if inputs and overlapping(inputs, [path]):
        raise ValueError(f"output {path} overlaps an input")
    load, marks = stage_load(spark, path, parts)
    last = versions(spark, path)
    if {r["part"]: (r["format"], r["rows"], r["fingerprint"]) for r in last} == {n: (m["format"], m["rows"], m["fingerprint"]) for n, m in marks.items()}:
        return None
    number = max((r["version"] for r in last), default=-1) + 1
    entries = [(number, load, n, m["format"], m["layout"], m["rows"], m["fingerprint"]) for n, m in marks.items()]
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return number


def read_part(spark: SparkSession, path: str, part: str) -> DataFrame:
    """A part of the last version."""
    for r in versions(spark, path):
        if r["part"] == part:
            return _read(spark, path, r["load"], part, r["format"], r["layout"])
    raise KeyError(f"{part} isn't published under {path}")


def read_all(spark: SparkSession, path: str, part: str) -> DataFrame | None:
    """A part of all versions together, for outputs that grow by what each load adds; None if there is none."""
    out = None
    for r in manifest(spark, path).where(F.col("part") == part).orderBy("version").collect():
        rows = _read(spark, path, r["load"], part, r["format"], r["layout"])
        out = rows if out is None else out.unionByName(rows)
    return out
