"""Vector index: identity, encoding, storage, verification and exact search.

chunks(index_id, chunk_id, ordinal, text, contextualized_text, token_count, …)
vectors(index_id, chunk_id, ordinal, embedding)
queries(index_id, query_id, channel, embedding)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import skew
from attesta.functions.lineage import cut
from attesta.functions.text import has_text, strip

KEY = ["index_id", "chunk_id"]
MAX_K = 50
# Queries that are sent to the vectors at once.
ROUND_QUERIES = 4_096
# Shorter vectors have no direction.
LEAST_NORM = 1e-8
DISTANCE_DIGITS = 9
HIT_SCHEMA = "index_id string, query_id string, channel string, chunk_id string, ordinal long, distance double"


def index_identity(reports: DataFrame, model: str, revision: str, dims: int) -> DataFrame:
    """Stable id of (source, chunks, model, storage format): `r2-` and 24 hex digits.

    reports(document_id, source_sha256, chunks_sha256)
    """
    identity = F.struct(
        F.col("chunks_sha256"),
        F.lit("float32").alias("compute_dtype"),
        F.lit(dims).alias("dimensions"),
        F.lit(1).alias("format_version"),
        F.lit(model).alias("model"),
        F.lit("L2").alias("normalization"),
        F.lit("CLS").alias("pooling"),
        F.lit(revision).alias("revision"),
        F.col("source_sha256"),
    )
    return reports.withColumn("identity", F.to_json(identity)).withColumn(
        "index_id", F.concat(F.lit("r2-"), F.substring(F.sha2("identity", 256), 1, 24))
    )


def chunks_fingerprint(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Order-independent fingerprint of a chunk set, combined on the map side."""
    row = F.xxhash64(*[c for c in chunks.columns if c not in keys])
    return chunks.groupBy(*keys).agg(
        F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(row.cast("decimal(38,0)")).cast("string"), F.bit_xor(row).cast("string")), 256).alias("chunks_sha256")
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / norm(v))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b) / (norm(a) * norm(b))


def encode(chunks: DataFrame, load_encoder: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = 8) -> DataFrame:
    """Batched encoding with a user-supplied encoder, loaded once per task.

    Blank texts are passed through with a null vector and show up in `vector_faults`.
    """
    schema = T.StructType(
        [f for f in chunks.schema.fields] + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load_encoder()
        for frame in batches:
            texts = frame["contextualized_text"].tolist()
            usable = [i for i, t in enumerate(texts) if t and t.strip()]
            out: list = [None] * len(texts)
            for at in range(0, len(usable), batch_size):
                group = usable[at : at + batch_size]
                raw = np.asarray(encoder([texts[i] for i in group]), dtype=np.float32)
                length = np.linalg.norm(raw, axis=1, keepdims=True)
                unit = np.divide(raw, length, out=np.full_like(raw, np.nan), where=length >= 1e-8)
                for i, row in zip(group, unit):
                    out[i] = row
            yield frame.assign(embedding=out)

    return chunks.mapInPandas(run, schema)


def vector_faults(vectors: DataFrame, dims: int) -> DataFrame:
    """Vectors that are missing, of wrong size, not finite, or not of unit length."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    fault = (
        F.when(v.isNull(), "missing_vector")
        .when(F.size(v) != dims, "wrong_dimensions")
        .when(bad, "not_finite")
        .when(F.abs(norm(v) - 1) > 1e-5, "not_unit_length")
    )
    return vectors.withColumn("fault", fault).where(F.col("fault").isNotNull()).select(*KEY, "fault")


def token_mismatches(chunks: DataFrame, counted: DataFrame) -> DataFrame:
    """Chunks whose actual token count differs from the one reported at chunking time."""
    actual = counted.select(*KEY, F.col("token_count").alias("actual_tokens"))
    return chunks.join(actual, KEY).where("NOT token_count <=> actual_tokens").select(*KEY, "token_count", "actual_tokens")


def metadata_json(chunks: DataFrame) -> DataFrame:
    """Every chunk field not stored as its own column, as one JSON document."""
    stored = {"index_id", "chunk_id", "ordinal", "text", "contextualized_text", "token_count"}
    rest = sorted(c for c in chunks.columns if c not in stored)
    return chunks.withColumn("metadata", F.to_json(F.struct(*rest))).drop(*rest)


def vector_stats(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("index_id").agg(
        F.count("*").alias("vectors"), F.min(F.size("embedding")).alias("min_dims"), F.max(F.size("embedding")).alias("max_dims")
    )


# ---- exact search --------------------------------------------------------------------
class _Best:
    """Running k best (distance, ordinal) rows of each query within one task."""

    def __init__(self, queries: int, k: int):
        self.k, self.worst = k, np.full(queries, np.inf)
        self.rows: list[tuple] = [(np.empty(0), np.empty(0, dtype=np.int64), np.empty(0, dtype=object))] * queries

    def add(self, at: np.ndarray, distances: np.ndarray, ordinals: np.ndarray, ids: np.ndarray) -> None:
        """Distances of the queries `at` (rows) to some vectors (columns)."""
        for row, query in zip(distances, at.tolist(), strict=True):
            near = np.flatnonzero(row <= self.worst[query])
            if len(near) > self.k:
                near = near[row[near] <= np.partition(row[near], self.k - 1)[self.k - 1]]
            if not len(near):
                continue
            d, o, c = self.rows[query]
            d, o, c = np.append(d, row[near]), np.append(o, ordinals[near]), np.append(c, ids[near])
            best = np.lexsort((o, d))[: self.k]
            self.rows[query] = d[best], o[best], c[best]
            if len(best) == self.k:
                self.worst[query] = d[best[-1]]


def _unit(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix.astype(np.float64)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return np.round(1.0 - queries @ vectors.T, DISTANCE_DIGITS)


def _prepare(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(n).cast("string") for n in names if n not in ("ordinal", "embedding")],
                     *[F.col(n).cast("long") for n in names if n == "ordinal"],
                     F.col("embedding").cast("array<float>"))


def searchable(vectors: DataFrame) -> Column:
    """Whether a vector has a direction: not null, no null, infinite or NaN element, and not all zero."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & (norm(v) >= LEAST_NORM), F.lit(False))


def search_faults(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(index_id, kind, id, fault) of vectors and queries that `exact_top_k` leaves out.

    A vector is left out if it has no direction or another size than most vectors of its index (of equally frequent
    sizes the larger); a query likewise, measured against its index.
    """
    size = _index_sizes(vectors)
    both = vectors.select(F.col("index_id").cast("string"), F.lit("vector").alias("kind"), F.col("chunk_id").cast("string").alias("id"), F.col("embedding").cast("array<float>")).unionByName(
        queries.select(F.col("index_id").cast("string"), F.lit("query").alias("kind"), F.col("query_id").cast("string").alias("id"), F.col("embedding").cast("array<float>"))
    )
    fault = (
        F.when(F.col("embedding").isNull(), "missing_vector").when(~searchable(both), "no_direction")
        .when(F.size("embedding") != F.col("dims"), "wrong_dimensions")
    )
    return both.join(size, "index_id", "left").select("index_id", "kind", "id", fault.alias("fault")).where("fault is not null")


def _index_sizes(vectors: DataFrame) -> DataFrame:
    sized = vectors.select(F.col("index_id").cast("string"), F.col("embedding").cast("array<float>"))
    counted = sized.where(searchable(sized)).groupBy("index_id", F.size("embedding").alias("dims")).agg(F.count("*").alias("n"))
    return counted.groupBy("index_id").agg(F.max_by("dims", F.struct("n", "dims")).alias("dims"), F.sum("n").alias("vectors"))


class _Round:
    """Questions of one round, by index: unit vectors, and what each question is compared with."""

    def __init__(self, rows: list, key: list[str]):
        self.rows = [tuple(r[c] for c in key) for r in rows]
        self.at: dict[str, np.ndarray] = {}
        self.unit: dict[str, np.ndarray] = {}
        for i, r in enumerate(rows):
            self.at.setdefault(r["index_id"], []).append(i)
        for index, at in self.at.items():
            self.at[index] = np.array(at)
            self.unit[index] = _unit(np.array([rows[i]["embedding"] for i in at], dtype=np.float32))
        if "target" in rows[0]:
            # Distance and ordinal of the wanted chunk of each question.
            self.place = np.array([r["at"] for r in rows], dtype=np.int64)
            self.limit = np.zeros(len(rows))
            for index, at in self.at.items():
                wanted = _unit(np.array([rows[i]["target"] for i in at], dtype=np.float32))
                self.limit[at] = np.round(1.0 - (self.unit[index] * wanted).sum(axis=1), DISTANCE_DIGITS)


def _met(batch: pa.RecordBatch, asked: _Round) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(index, rows of the batch, distances): vectors that have a direction and the size of the questions of their index."""
    lists = batch.column("embedding")
    flat = lists.flatten()
    elements, gaps = flat.to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    sizes = np.diff(ends, prepend=0)
    index = batch.column("index_id").to_pandas()
    for name, rows in index.groupby(index, sort=False).indices.items():
        if name not in asked.unit:
            continue
        dims = asked.unit[name].shape[1]
        rows = rows[sizes[rows] == dims]
        places = (ends[rows] - dims)[:, None] + np.arange(dims)
        vectors = elements[places].astype(np.float64) if len(rows) else np.empty((0, dims))
        length = np.linalg.norm(vectors, axis=1)
        good = np.isfinite(vectors).all(axis=1) & ~gaps[places].any(axis=1) & (length >= LEAST_NORM) if len(rows) else np.empty(0, dtype=bool)
        if good.any():
            yield name, rows[good], _distances(asked.unit[name], vectors[good] / length[good, None])


def _rounds(asked: DataFrame, key: list[str], round_rows: int) -> Iterator[Broadcast]:
    """The questions in rounds of about `round_rows`, by a hash, each broadcast to the vectors where they are."""
    spark = asked.sparkSession
    rounds = max(1, -(-asked.count() // round_rows))
    for i in range(rounds):
        rows = asked.where(F.pmod(F.xxhash64(*key), F.lit(rounds)) == i).collect()
        if rows:
            yield spark.sparkContext.broadcast(_Round(rows, key))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, round_rows: int = ROUND_QUERIES) -> DataFrame:
    """Exact cosine neighbours of each query in its own index: distance, then ordinal.

    Vectors stay where they are read. Queries come to them in rounds of bounded size; a task takes one matrix product
    for each batch of vectors and index, keeps the k best rows of every query, and only these are shuffled: the shuffle
    grows with tasks and queries, not with vectors or rounds. Vectors and queries without a direction or of another size
    than their index are left out and listed by `search_faults`.
    """
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be between 1 and {MAX_K}")
    v = _prepare(vectors, "index_id", "chunk_id", "ordinal", "embedding")
    q = _prepare(queries, "index_id", "query_id", "channel", "embedding")
    asked = cut(q.where(searchable(q)).join(_index_sizes(vectors), "index_id").where("size(embedding) = dims").drop("dims", "vectors"))
    out = None
    for shared in _rounds(asked, ["index_id", "query_id", "channel"], round_rows):
        found = v.mapInArrow(_nearest(shared, k), HIT_SCHEMA)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = v.sparkSession.createDataFrame([], HIT_SCHEMA)
    return skew.top_k(out, ["index_id", "query_id", "channel"], [F.asc("distance"), F.asc("ordinal")], k)


def _nearest(shared: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = _Best(len(asked.rows), k)
        for batch in batches:
            ordinals, ids = batch.column("ordinal").to_numpy(zero_copy_only=False), batch.column("chunk_id").to_numpy(zero_copy_only=False)
            for name, rows, found in _met(batch, asked):
                best.add(asked.at[name], found, ordinals[rows], ids[rows])
        names = [part.split()[0] for part in HIT_SCHEMA.split(", ")]
        kept = [(q, *r) for q, r in zip(asked.rows, best.rows, strict=True) if len(r[0])]
        columns = [[x for q, d, *_ in kept for x in [q[i]] * len(d)] for i in range(3)]
        d, o, c = ([x for r in kept for x in r[i]] for i in (1, 2, 3))
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([*columns, c, o, d], kinds, strict=True)], names)

    return run


def self_neighbours(vectors: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """The first chunk of each index searched in its own index: is it its own neighbour?"""
    first = vectors.groupBy("index_id").agg(F.min_by(F.struct("chunk_id", "embedding"), "ordinal").alias("p"))
    probes = first.select("index_id", F.col("p.chunk_id").alias("query_id"), F.lit("self").alias("channel"), "p.embedding")
    found = exact_top_k(vectors, probes, 1)
    return found.select("index_id", "query_id", "chunk_id", "distance", (F.abs("distance") <= tolerance).alias("passed"))


def distance_cross_check(hits: DataFrame, vectors: DataFrame, queries: DataFrame, tolerance: float = 2e-6) -> DataFrame:
    """Search distances recomputed with column arithmetic."""
    stored = vectors.select(*[F.col(c).cast("string") for c in KEY], F.col("embedding").alias("v"))
    asked = queries.select(*[F.col(c).cast("string") for c in ("index_id", "query_id", "channel")], F.col("embedding").alias("q"))
    again = cosine_distance(F.col("q"), F.col("v"))
    return (
        hits.join(stored, KEY)
        .join(asked, ["index_id", "query_id", "channel"])
        .withColumn("recomputed", again)
        .select("index_id", "query_id", "channel", "chunk_id", "distance", "recomputed",
                (F.abs(F.col("distance") - F.col("recomputed")) <= tolerance).alias("agrees"))
    )


def rank_of(vectors: DataFrame, queries: DataFrame, wanted: DataFrame, round_rows: int = ROUND_QUERIES) -> DataFrame:
    """Full-ranking position of wanted chunks, without ranking the whole index.

    wanted(index_id, query_id, channel, chunk_id). A position is one plus the number of chunks that come earlier: the
    same pass as the search, of which only one count for each task and wanted chunk is shuffled.
    """
    v = _prepare(vectors, "index_id", "chunk_id", "ordinal", "embedding")
    q = _prepare(queries, "index_id", "query_id", "channel", "embedding")
    key = ["index_id", "query_id", "channel"]
    targets = (
        wanted.select(*[F.col(c).cast("string") for c in (*key, "chunk_id")]).join(q, key)
        .join(v.select(*KEY, F.col("ordinal").alias("at"), F.col("embedding").alias("target")), KEY).where("size(embedding) = size(target)")
    )
    out = None
    for shared in _rounds(cut(targets), [*key, "chunk_id"], round_rows):
        found = v.drop("chunk_id").mapInArrow(_earlier(shared), "index_id string, query_id string, channel string, chunk_id string, n long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return wanted.select(*key, "chunk_id", F.lit(1).cast("long").alias("position")).limit(0)
    return out.groupBy(*key, "chunk_id").agg((F.sum("n") + 1).alias("position"))


def _earlier(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        count = np.zeros(len(asked.rows), dtype=np.int64)
        for batch in batches:
            ordinals = batch.column("ordinal").to_numpy(zero_copy_only=False)
            for name, rows, found in _met(batch, asked):
                at, place = asked.at[name], ordinals[rows]
                limit, own = asked.limit[at][:, None], asked.place[at][:, None]
                count[at] += (((found < limit) | ((found == limit) & (place < own))) & (place != own)).sum(axis=1)
        columns = [[r[i] for r in asked.rows] for i in range(4)]
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.string()) for x in columns], pa.array(count)], ["index_id", "query_id", "channel", "chunk_id", "n"])

    return run


def registry_conflicts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Index ids registered before under another identity."""
    old = existing.select("index_id", F.col("identity").alias("existing_identity"))
    return incoming.join(old, "index_id").where("NOT identity <=> existing_identity").select("index_id")


def registry_inserts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return incoming.join(existing.select("index_id"), "index_id", "left_anti")


def new_vectors(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to append: keys not stored yet."""
    return incoming.join(existing.select(*KEY), KEY, "left_anti")


def read_back_differences(expected: DataFrame, stored: DataFrame, atol: float = 1e-7, rtol: float = 1e-6) -> DataFrame:
    """Rows missing, extra or changed after a write, vectors compared element by element."""
    plain = [c for c in expected.columns if c not in (*KEY, "embedding")]
    left = expected.select(*KEY, F.struct(*plain).alias("a"), F.col("embedding").alias("va"))
    right = stored.select(*KEY, F.struct(*plain).alias("b"), F.col("embedding").alias("vb"))
    close = F.forall(
        F.zip_with("va", "vb", lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda ok: F.coalesce(ok, F.lit(False))
    )
    fault = (
        F.when(F.col("b").isNull(), "missing")
        .when(F.col("a").isNull(), "extra")
        .when(~F.col("a").eqNullSafe(F.col("b")), "fields_differ")
        .when(~close, "vector_differs")
    )
    return left.join(right, KEY, "full").withColumn("fault", fault).where(F.col("fault").isNotNull()).select(*KEY, "fault")


def storage_report(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored, new and reused rows per index."""
    seen = existing.select(*KEY, F.lit(1).alias("was"))
    return incoming.join(seen, KEY, "left").groupBy("index_id").agg(
        F.count("*").alias("stored_chunks"),
        F.count_if(F.col("was").isNull()).alias("new_rows"),
        F.count_if(F.col("was").isNotNull()).alias("existing_rows_reused"),
    )


def readiness_violations(reports: DataFrame, chunks: DataFrame) -> DataFrame:
    """Why a chunk set may not be embedded yet.

    reports(index_id, status, violations, chunks); chunks(index_id, chunk_id, contextualized_text, source_refs)
    """
    counted = chunks.groupBy("index_id").agg(
        F.count("*").alias("n"),
        F.count_if(~has_text(F.coalesce("contextualized_text", F.lit(""))) | (F.coalesce(F.size("source_refs"), F.lit(0)) <= 0)).alias("unusable"),
    )
    repeated = (
        chunks.groupBy(*KEY).agg(F.count("*").alias("c")).where("c > 1").select("index_id").distinct().withColumn("dup", F.lit(True))
    )
    rules = F.array_compact(
        F.array(
            F.when((F.col("status") != "ready_for_embedding_review") | (F.col("violations") > 0), F.lit("report_not_ready")),
            F.when(F.coalesce("n", F.lit(0)) != F.col("chunks"), F.lit("chunk_count_differs")),
            F.when(F.col("dup"), F.lit("duplicate_chunk_ids")),
            F.when(F.col("unusable") > 0, F.lit("chunk_without_text_or_source")),
        )
    )
    return (
        reports.join(counted, "index_id", "left").join(repeated, "index_id", "left").select("index_id", F.explode(rules).alias("rule"))
    )
