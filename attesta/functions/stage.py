"""Stages: intermediates that several branches and later queries read, as tables in the shared folder.

A stage is found by a fingerprint of its plan, of the files that the plan reads (paths, lengths, times) and of this
package's code; whoever asks for the same stage again reads the table. It is written under a name of its own and renamed
when it is whole, so a reader never sees a part of it. Plans that read a stage begin at its table: they are built and
scanned without what lies before it.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import cache
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from attesta.functions.lineage import shared_folder


@cache
def code_version() -> str:
    """Digest of the package's source files."""
    root = Path(__file__).resolve().parents[1]
    digest = hashlib.sha256()
    for path in sorted(root.rglob("*.py")):
        digest.update(path.read_bytes())
    return digest.hexdigest()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def input_marks(df: DataFrame) -> list[tuple[str, int, int]]:
    """(path, length, time) of every file in the folders that the plan reads from."""
    spark, out = df.sparkSession, []
    for folder in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}):
        fs, p = _fs(spark, folder)
        out += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)]
    return sorted(out)


def fingerprint(df: DataFrame) -> str:
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    return hashlib.sha256(repr((df.semanticHash(), plan, df.schema.json(), input_marks(df), code_version())).encode()).hexdigest()[:40]


def stage(df: DataFrame) -> DataFrame:
    """The rows of `df` as a table that is written once; columns without a type are kept in memory and on disk instead."""
    spark = df.sparkSession
    if any(t == "void" for _, t in df.dtypes):
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{shared_folder(spark)}/stages/{fingerprint(df)}"
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        own = f"{path}-{uuid.uuid4()}"
        df.write.parquet(own)
        if not fs.rename(_fs(spark, own)[1], p) and not fs.exists(p):
            raise OSError(f"stage {path} could not be put in place")
    return spark.read.schema(df.schema).parquet(path)


def remove_stages(spark: SparkSession) -> bool:
    """Deletes all stages of the shared folder; plans that read them must not be run any more."""
    fs, p = _fs(spark, f"{shared_folder(spark)}/stages")
    return fs.exists(p) and fs.delete(p, True)
