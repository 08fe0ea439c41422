"""Stored inverted index: postings in term buckets, document frequencies, and a manifest that names what counts.

An index is a folder of segments. A load writes its postings and document frequencies under a segment number of its own and
then publishes them with one small file in the manifest; readers take segments from the manifest only, so that nothing
of an interrupted load is visible. A load with the content of an earlier segment adds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.lineage import cut
from attesta.operators import fulltext as T

#: Folders by a hash of the term; a question reads those of its own terms.
BUCKETS = 64
MANIFEST = "segment long, load string, fingerprint string, postings long, chunks long, terms long"


def bucket(term: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each published segment; no rows where there is no index."""
    fs, p = _folder(spark, f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest") if fs.exists(p) else spark.createDataFrame([], MANIFEST)


def append(postings: DataFrame, path: str, buckets: int = BUCKETS) -> bool:
    """Adds the postings of new chunks as a segment; False if an earlier segment holds the same.

    The fingerprint is a sum of hashes of all rows, so that order and partitions don't matter. A chunk that the index
    holds already, with other postings, is refused: an index is never changed.
    """
    spark = postings.sparkSession
    load = str(uuid.uuid4())
    rows = postings.withColumn("bucket", bucket("term", buckets))
    rows.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(16))).sortWithinPartitions("bucket", "index_id", "term", "ordinal").write.partitionBy("bucket").parquet(f"{path}/postings/load={load}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/postings/load={load}")
    written.groupBy("bucket", "index_id", "term").agg(F.count("*").alias("df")).write.partitionBy("bucket").parquet(f"{path}/frequencies/load={load}")
    row = written.agg(
        F.sum(F.xxhash64("index_id", "term", "chunk_id", "ordinal", "positions").cast("decimal(38,0)")).cast("string").alias("fingerprint"),
        F.count("*").alias("postings"), F.count_distinct("index_id", "chunk_id").alias("chunks"), F.count_distinct("index_id", "term").alias("terms"),
    ).first()
    known = manifest(spark, path).select("segment", "load", "fingerprint", "postings").collect()  # one row for each load
    if any((k["fingerprint"], k["postings"]) == (row["fingerprint"], row["postings"]) for k in known):
        return False
    if known and not written.select("index_id", "chunk_id").distinct().join(_read(spark, path, "postings").select("index_id", "chunk_id").distinct(), ["index_id", "chunk_id"], "left_semi").isEmpty():
        raise ValueError("the index holds some of these chunks already")
    segment = max((k["segment"] for k in known), default=-1) + 1
    entry = spark.createDataFrame([(segment, load, row["fingerprint"], row["postings"], row["chunks"], row["terms"])], MANIFEST)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return True


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The published segments' rows of a kind; only their folders are listed."""
    loads = [r["load"] for r in manifest(spark, path).select("load").collect()]
    if not loads:
        raise ValueError(f"no index under {path}")
    return spark.read.option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/load={x}" for x in loads]).drop("load")


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(index_id, term, df) over all segments; a chunk lies in one segment."""
    return _read(spark, path, "frequencies").groupBy("index_id", "term").agg(F.sum("df").alias("df"))


def matching(spark: SparkSession, path: str, questions: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Postings joined with the phrase terms of the questions; only buckets of those terms are read.

    The buckets that occur are taken first, at most as many as there are, so that the scan is pruned whatever the size of the
    questions; Spark's own pruning by the join needs a broadcast.
    """
    wanted = cut(T.phrase_terms(questions).withColumn("bucket", bucket("term", buckets)))
    read = sorted(r["bucket"] for r in wanted.select("bucket").distinct().collect())
    rows = _read(spark, path, "postings").where(F.col("bucket").isin(read) if read else F.lit(False))
    return rows.join(wanted, ["bucket", "index_id", "term"])


def search(spark: SparkSession, path: str, questions: DataFrame, limit: int = 30, buckets: int = BUCKETS) -> DataFrame:
    """As `fulltext.phrase_search`, over the stored index."""
    return T.ranked_chunks(matching(spark, path, questions, buckets), limit)
