"""Vector index, full text, fusion, sections and source assembly."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from attesta.functions import skew
from attesta.functions.lineage import shared_folder
from attesta.functions.stage import stage
from attesta.functions.stems import stem_sql
from attesta.operators import fulltext as T
from attesta.operators import questions as Q
from attesta.operators import retrieval as R
from attesta.operators import vector_index as V
from attesta.plans import duck, fixtures as fx, query
from attesta.plans.chunking import asked
from attesta.plans.evidence import D_TEXT, text_items
from attesta.sources import index_store, sinks

DIMS = 64


def vectors(t):
    return t.embeddings.select(F.col("label").cast("string").alias("index_id"), F.col("vec_id").cast("string").alias("chunk_id"),
                               F.col("vec_id").alias("ordinal"), "embedding")


def centroids(t):
    """One query per index: the mean of all its vectors."""
    means = (
        t.embeddings.select(F.col("label").cast("string").alias("index_id"), F.posexplode("embedding").alias("i", "x"))
        .groupBy("index_id", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
        .groupBy("index_id").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("e"))
    )
    return means.select("index_id", F.col("index_id").alias("query_id"), F.lit("query_0").alias("channel"), F.col("e.x").alias("embedding"))


def two_channels(t):
    first = t.embeddings.groupBy(F.col("label").cast("string").alias("index_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return centroids(t).unionByName(first.select("index_id", F.col("index_id").alias("query_id"), F.lit("query_1").alias("channel"),
                                                 F.col("embedding").cast("array<double>").alias("embedding")))


D_VEC = "v AS (SELECT label::VARCHAR AS index_id, vec_id, embedding::DOUBLE[] AS e FROM embeddings)"
D_QUERIES = f"""{D_VEC},
q0 AS (SELECT index_id, 'query_0' AS channel, list(x ORDER BY i)::FLOAT[]::DOUBLE[] AS e FROM (SELECT index_id, i, round(avg(x), 6) AS x FROM
  (SELECT index_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v) GROUP BY ALL) GROUP BY index_id),
q1 AS (SELECT index_id, 'query_1' AS channel, arg_min(e, vec_id) AS e FROM v GROUP BY index_id),
q AS (SELECT * FROM q0 UNION ALL SELECT * FROM q1),
d AS (SELECT q.index_id, q.channel, v.vec_id, round(1 - list_cosine_similarity(q.e, v.e), 9) AS distance FROM q JOIN v USING (index_id)),
hits AS (SELECT *, row_number() OVER (PARTITION BY index_id, channel ORDER BY distance, vec_id) AS rank FROM d QUALIFY rank <= 30)"""


def hits(t, k=30):
    return stage(V.exact_top_k(vectors(t), two_channels(t), k))


query(
    "exact_top_k",
    "E4 E5 J5",
    f"WITH {D_QUERIES} SELECT index_id, channel, vec_id::VARCHAR AS chunk_id, round(distance, 6) AS distance, rank FROM hits",
)(lambda t: hits(t).select("index_id", "channel", "chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank")))

def damaged(t):
    """Every eleventh vector is zero, the next one missing, the next one too short."""
    m = F.col("ordinal") % 11
    return vectors(t).withColumn("embedding", F.when(m == 0, F.transform("embedding", lambda x: x * 0)).when(m == 2, F.slice("embedding", 1, DIMS - 1)).when(m > 2, F.col("embedding")))


query(
    "exact_top_k_of_damaged_vectors",
    "E4",
    f"""WITH {D_QUERIES}, kept AS (SELECT *, row_number() OVER (PARTITION BY index_id, channel ORDER BY distance, vec_id) AS rank FROM d WHERE vec_id % 11 > 2)
SELECT index_id, channel, vec_id::VARCHAR AS chunk_id, round(distance, 6) AS distance, rank FROM kept WHERE rank <= 10""",
)(
    lambda t: V.exact_top_k(damaged(t), two_channels(t), 10).select("index_id", "channel", "chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))
)

query(
    "search_faults",
    "E2 E4",
    """SELECT label::VARCHAR AS index_id, 'vector' AS kind, vec_id::VARCHAR AS id, CASE vec_id % 11 WHEN 0 THEN 'no_direction' WHEN 1 THEN 'missing_vector' ELSE 'wrong_dimensions' END AS fault FROM embeddings WHERE vec_id % 11 < 3
UNION ALL SELECT DISTINCT label::VARCHAR, 'query', label::VARCHAR, 'no_direction' FROM embeddings""",
)(
    lambda t: V.search_faults(damaged(t), two_channels(t).where("channel = 'query_1'").withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(0.0))))
)

query(
    "exact_top_k_tiled",
    "E4",
    f"WITH {D_QUERIES} SELECT index_id, channel, vec_id::VARCHAR AS chunk_id, round(distance, 6) AS distance, rank FROM hits WHERE rank <= 10",
)(
    lambda t: V.exact_top_k(vectors(t), two_channels(t), 10, 5).select("index_id", "channel", "chunk_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))
)

query(
    "l2_normalize",
    "E3",
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS total FROM embeddings",
)(lambda t: t.embeddings.select("vec_id", F.round(F.aggregate(V.l2_normalize(F.col("embedding")), F.lit(0.0), lambda a, x: a + x), 6).alias("total")))


def _hash_encoder():
    """Deterministic stand-in encoder: letter counts folded into 16 buckets."""
    def encode(texts):
        out = np.zeros((len(texts), 16), dtype=np.float32)
        for i, text in enumerate(texts):
            for ch in text:
                out[i, ord(ch) % 16] += 1
        return out
    return encode


query(
    "encode_chunks",
    "E2",
    """WITH c AS (SELECT doc_id, unnest(list_transform(string_split(text, ''), lambda ch: unicode(ch) % 16)) AS b FROM documents),
n AS (SELECT doc_id, b, count(*) AS n FROM c GROUP BY ALL), z AS (SELECT doc_id, sqrt(sum(n * n)) AS z FROM n GROUP BY doc_id)
SELECT doc_id, round(sum(n) / any_value(z), 2) AS total, sum(CASE WHEN b = 0 THEN n ELSE 0 END)::BIGINT > 0 AS has_zero FROM n JOIN z USING (doc_id) GROUP BY doc_id""",
)(
    lambda t: V.encode(t.documents.select("doc_id", F.col("text").alias("contextualized_text")), _hash_encoder, 8).select(
        "doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 2).alias("total"),
        (F.element_at("embedding", 1) > 0).alias("has_zero"))
)

query(
    "vector_faults",
    "E2",
    """SELECT label::VARCHAR AS index_id, vec_id::VARCHAR AS chunk_id, CASE WHEN vec_id % 5 = 0 THEN 'wrong_dimensions' ELSE 'not_unit_length' END AS fault FROM embeddings
WHERE vec_id % 5 = 0 OR vec_id % 7 = 0""",
)(
    lambda t: V.vector_faults(
        vectors(t).withColumn("embedding", F.when(F.col("ordinal") % 5 == 0, F.slice("embedding", 1, 63))
                              .when(F.col("ordinal") % 7 == 0, F.transform("embedding", lambda x: x * 2)).otherwise(F.col("embedding"))), DIMS)
)

query(
    "self_neighbours",
    "E7",
    """SELECT label::VARCHAR AS index_id, min(vec_id)::VARCHAR AS query_id, min(vec_id)::VARCHAR AS chunk_id, true AS passed FROM embeddings GROUP BY label""",
)(lambda t: V.self_neighbours(vectors(t)).drop("distance"))

query(
    "vector_stats",
    "E9",
    "SELECT label::VARCHAR AS index_id, count(*) AS vectors, min(len(embedding))::INT AS min_dims, max(len(embedding))::INT AS max_dims FROM embeddings GROUP BY label",
)(lambda t: V.vector_stats(vectors(t)))

query(
    "distance_cross_check",
    "E10",
    f"WITH {D_QUERIES} SELECT index_id, channel, vec_id::VARCHAR AS chunk_id, true AS agrees FROM hits",
)(lambda t: V.distance_cross_check(hits(t), vectors(t), two_channels(t)).select("index_id", "channel", "chunk_id", "agrees"))

query(
    "rank_of_wanted",
    "J5",
    f"""WITH {D_QUERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY index_id, channel ORDER BY distance, vec_id) AS position FROM d)
SELECT index_id, channel, vec_id::VARCHAR AS chunk_id, position FROM r WHERE vec_id = (SELECT max(x.vec_id) FROM v x WHERE x.index_id = r.index_id)""",
)(
    lambda t: V.rank_of(vectors(t), two_channels(t).withColumn("embedding", F.col("embedding").cast("array<float>")), two_channels(t).select("index_id", "query_id", "channel").join(
        vectors(t).groupBy("index_id").agg(F.max("ordinal").cast("string").alias("chunk_id")), "index_id"))
    .select("index_id", "channel", "chunk_id", "position")
)

STORED = "ordinal % 3 <> 0"


def stored_twice(t):
    """Two thirds of the vectors are stored, then all of them, in a folder of this run; the second report."""
    path = f"{shared_folder(t.spark)}/vectors-{uuid.uuid4()}"
    sinks.store_vectors(t.spark, vectors(t).where(STORED), path)
    return sinks.store_vectors(t.spark, vectors(t), path)


query(
    "store_vectors",
    "A21",
    """SELECT label::VARCHAR AS index_id, count(*) AS stored_chunks, count(*) FILTER (WHERE vec_id % 3 = 0) AS new_rows, count(*) FILTER (WHERE vec_id % 3 <> 0) AS existing_rows_reused FROM embeddings GROUP BY label""",
)(stored_twice)


def chunk_rows(t):
    return vectors(t).withColumn("text", F.concat(F.lit("t"), "chunk_id")).withColumn("token_count", F.length("chunk_id"))


query(
    "registry_upsert",
    "E1 E8",
    """SELECT DISTINCT label::VARCHAR AS index_id, CASE WHEN label % 2 = 0 THEN CASE WHEN label % 4 = 0 THEN 'conflict' ELSE 'kept' END ELSE 'inserted' END AS action FROM embeddings""",
)(
    lambda t: (
        lambda inc, old: inc.select("index_id").join(V.registry_conflicts(old, inc).withColumn("c", F.lit(True)), "index_id", "left")
        .join(V.registry_inserts(old, inc).select("index_id", F.lit(True).alias("i")), "index_id", "left")
        .select("index_id", F.when(F.col("c"), "conflict").when(F.col("i"), "inserted").otherwise("kept").alias("action"))
    )(_identities(t), _old_identities(t))
)


def _identities(t):
    return t.embeddings.select(F.col("label").cast("string").alias("index_id")).distinct().withColumn("identity", F.concat(F.lit("m:"), "index_id"))


def _old_identities(t):
    return _identities(t).where("CAST(index_id AS INT) % 2 = 0").withColumn(
        "identity", F.when(F.col("index_id").cast("int") % 4 == 0, "other").otherwise(F.col("identity")))


query(
    "index_identity",
    "E1",
    """SELECT source AS document_id, concat('r2-', substr(sha256(concat('{"chunks_sha256":"', md5(source), '","compute_dtype":"float32","dimensions":64,"format_version":1,"model":"m","normalization":"L2","pooling":"CLS","revision":"r1","source_sha256":"', sha256(source), '"}')), 1, 24)) AS index_id
FROM documents GROUP BY source""",
)(
    lambda t: V.index_identity(t.documents.select(F.col("source").alias("document_id"), F.sha2("source", 256).alias("source_sha256"),
                                                  F.md5("source").alias("chunks_sha256")).distinct(), "m", "r1", DIMS).select("document_id", "index_id")
)

query(
    "storage_report",
    "A21",
    """SELECT label::VARCHAR AS index_id, count(*) AS stored_chunks, count(*) FILTER (WHERE vec_id % 3 = 0) AS new_rows, count(*) FILTER (WHERE vec_id % 3 <> 0) AS existing_rows_reused FROM embeddings GROUP BY label""",
)(lambda t: V.storage_report(vectors(t).where(STORED), vectors(t)))

query(
    "read_back_differences",
    "A21",
    """SELECT label::VARCHAR AS index_id, vec_id::VARCHAR AS chunk_id, CASE WHEN vec_id % 11 = 0 THEN 'missing' WHEN vec_id % 13 = 0 THEN 'fields_differ' ELSE 'vector_differs' END AS fault
FROM embeddings WHERE vec_id % 11 = 0 OR vec_id % 13 = 0 OR vec_id % 17 = 0""",
)(
    lambda t: V.read_back_differences(
        chunk_rows(t),
        chunk_rows(t).where("ordinal % 11 <> 0").withColumn("text", F.when(F.col("ordinal") % 13 == 0, "x").otherwise(F.col("text")))
        .withColumn("embedding", F.when(F.col("ordinal") % 17 == 0, F.transform("embedding", lambda x: x + F.lit(0.01).cast("float"))).otherwise(F.col("embedding"))))
)

query(
    "token_mismatches",
    "E6",
    "SELECT label::VARCHAR AS index_id, vec_id::VARCHAR AS chunk_id, length(vec_id::VARCHAR)::INT AS token_count, (length(vec_id::VARCHAR) + 1)::INT AS actual_tokens FROM embeddings WHERE vec_id % 10 = 0",
)(lambda t: V.token_mismatches(chunk_rows(t), chunk_rows(t).withColumn("token_count", F.length("chunk_id") + F.when(F.col("ordinal") % 10 == 0, 1).otherwise(0))))

query(
    "metadata_json",
    "E11",
    """SELECT doc_id, concat('{"lang":"', lang, '","n_chars":', n_chars::VARCHAR, '}') AS metadata FROM documents""",
)(
    lambda t: V.metadata_json(t.documents.select(F.lit("x").alias("index_id"), F.col("doc_id").alias("chunk_id"), "text", "lang", "n_chars"))
    .select(F.col("chunk_id").alias("doc_id"), "metadata")
)

query(
    "readiness_violations",
    "A6",
    """WITH r AS (SELECT source, count(*) AS n, sum(CASE WHEN doc_id % 97 = 0 THEN 1 ELSE 0 END) AS bad, CAST(substr(source, 4) AS INT) AS k FROM documents GROUP BY source),
d AS (SELECT DISTINCT source FROM (SELECT source, md5(text) FROM documents GROUP BY ALL HAVING count(*) > 1))
SELECT source AS index_id, 'report_not_ready' AS rule FROM r WHERE k % 3 = 0
UNION ALL SELECT source, 'chunk_count_differs' FROM r WHERE k % 4 = 0
UNION ALL SELECT source, 'duplicate_chunk_ids' FROM d
UNION ALL SELECT source, 'chunk_without_text_or_source' FROM r WHERE bad > 0""",
)(
    lambda t: V.readiness_violations(
        t.documents.groupBy(F.col("source").alias("index_id")).agg(F.count("*").alias("n")).withColumn("k", F.substring("index_id", 4, 9).cast("int")).select(
            "index_id", F.when(F.col("k") % 3 == 0, "validation_failed").otherwise("ready_for_embedding_review").alias("status"), F.lit(0).alias("violations"),
            F.when(F.col("k") % 4 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("chunks")),
        t.documents.select(F.col("source").alias("index_id"), F.md5("text").alias("chunk_id"), F.col("text").alias("contextualized_text"),
                           F.when(F.col("doc_id") % 97 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("r"))).alias("source_refs")))
)

# ---- full text -----------------------------------------------------------------------
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def d_lex(expr: str) -> str:
    return f"""list_filter(list_transform(regexp_extract_all(replace(lower({expr}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+'), lambda w, i: {{'w': w, 'pos': i - 1}}), lambda p: p.w NOT IN ({STOP}))"""


def text_chunks(t):
    return t.documents.select(F.col("source").alias("index_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("ordinal"), F.col("text").alias("contextualized_text"))


def d_post(more: str = "", chunks: str = "documents") -> str:
    """Postings of chunks (source, doc_id, text) by a table of the stems of all different words; `more` adds words of other texts."""
    return f"""lexw AS (SELECT source, doc_id, p.w AS w, p.pos AS pos FROM (SELECT source, doc_id, unnest({d_lex('text')}) AS p FROM {chunks})),
voc AS (SELECT DISTINCT w FROM lexw{more}), {stem_sql('voc')},
post AS (SELECT source AS index_id, doc_id AS chunk_id, stem AS term, pos FROM lexw JOIN stems USING (w))"""


query(
    "fulltext_postings",
    "A22",
    f"WITH {d_post()} SELECT index_id, term, chunk_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM post GROUP BY ALL",
)(lambda t: T.postings(text_chunks(t)).select("index_id", "term", "chunk_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions")))

PHRASES = """SELECT concat('src', CAST(item_id % 20 AS STRING)) AS index_id, item_id AS question_id, text FROM {benchmark}"""


def phrase_questions(t):
    """A word, a pair, a run of three, a pair whose middle word is a stop word, and a word that is part of a pair."""
    words = F.split("text", " ")
    at = lambda i: F.element_at(words, i)
    return t.sql(PHRASES).select("index_id", "question_id", F.array(
        at(1), F.concat_ws(" ", F.slice(words, 2, 2)), F.concat_ws(" ", F.slice(words, 4, 3)), F.concat_ws(" the ", at(7), at(9)), at(3)).alias("keywords"))


D_PHRASES = """SELECT DISTINCT index_id, question_id, phrase FROM (SELECT index_id, question_id, unnest([w[1], array_to_string(w[2:3], ' '), array_to_string(w[4:6], ' '), concat_ws(' the ', w[7], w[9]), w[3]]) AS phrase
  FROM (SELECT concat('src', (item_id % 20)::VARCHAR) AS index_id, item_id AS question_id, string_split(text, ' ') AS w FROM benchmark))"""


def d_search(phrases: str = D_PHRASES, chunks: str = "documents", limit: int = 30) -> str:
    """Covers by comparing all runs of a chunk with one another."""
    return f"""ph AS ({phrases}),
lx AS (SELECT index_id, question_id, phrase, unnest(l) AS p, len(l) AS n, l[1].pos AS base, l[-1].pos - l[1].pos AS reach FROM (SELECT *, {d_lex('phrase')} AS l FROM ph) WHERE len(l) > 0),
{d_post(" UNION SELECT DISTINCT p.w FROM lx", chunks)},
lt AS (SELECT index_id, question_id, phrase, n, reach, stem AS term, p.pos - base AS off FROM lx JOIN stems ON w = p.w),
plc AS (SELECT lt.index_id, question_id, phrase, n, reach, chunk_id, pos, post.pos - off AS st FROM lt JOIN post ON post.index_id = lt.index_id AND post.term = lt.term),
ru AS (SELECT DISTINCT index_id, question_id, chunk_id, st, st + reach AS en FROM (SELECT index_id, question_id, chunk_id, phrase, st, reach FROM plc GROUP BY index_id, question_id, phrase, n, reach, chunk_id, st HAVING count(*) = n)),
cv AS (SELECT * FROM ru a WHERE NOT EXISTS (SELECT 1 FROM ru b WHERE b.question_id = a.question_id AND b.index_id = a.index_id AND b.chunk_id = a.chunk_id AND b.st >= a.st AND b.en <= a.en AND (b.st > a.st OR b.en < a.en))),
ps AS (SELECT DISTINCT index_id, question_id, chunk_id, pos FROM plc),
cn AS (SELECT index_id, question_id, chunk_id, st, en, count(*) AS held FROM cv JOIN ps USING (index_id, question_id, chunk_id) WHERE pos BETWEEN st AND en GROUP BY ALL),
dn AS (SELECT index_id, question_id, chunk_id, round(sum({T.WEIGHT}::DOUBLE / (1 + en - st + 1 - held)), 9) AS score FROM cn GROUP BY ALL),
found AS (SELECT *, row_number() OVER (PARTITION BY index_id, question_id ORDER BY score DESC, chunk_id) AS rank FROM dn QUALIFY rank <= {limit})"""


def _shown(found):
    return found.select("index_id", "question_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


SEARCHED = f"WITH {d_search()} SELECT index_id, question_id, chunk_id, round(score, 6) AS score, rank FROM found"
query("phrase_search", "F1", SEARCHED)(lambda t: _shown(T.phrase_search(stage(T.postings(text_chunks(t))), phrase_questions(t))))


def stored_index(t):
    """Two loads of the documents, the first one repeated, under a folder of its own."""
    path = f"{shared_folder(t.spark)}/index-{uuid.uuid4()}"
    odd = F.col("ordinal") % 2 == 1
    for load in (text_chunks(t).where(odd), text_chunks(t).where(odd), text_chunks(t).where(~odd)):
        index_store.append(T.postings(load), path)
    return path


query("stored_index_search", "A22 F1", SEARCHED)(lambda t: _shown(index_store.search(t.spark, stored_index(t), phrase_questions(t))))
query(
    "stored_index_report",
    "A22",
    f"""WITH {d_post()}, p AS (SELECT chunk_id % 2 AS load, index_id, term, chunk_id FROM post GROUP BY ALL)
SELECT load = 0 AS second, count(*) AS postings, count(DISTINCT chunk_id) AS chunks, count(DISTINCT (index_id, term)) AS terms FROM p GROUP BY load""",
)(lambda t: index_store.manifest(t.spark, stored_index(t)).select((F.col("segment") > 0).alias("second"), "postings", "chunks", "terms"))

# ---- fusion --------------------------------------------------------------------------
def dense(t):
    return hits(t).select(F.col("query_id").alias("question_id"), "channel", "rank", "chunk_id", (1 - F.col("distance")).alias("similarity"))


def lexical_hits(t):
    rows = t.embeddings.join(t.documents, F.col("vec_id") == F.col("doc_id"))
    return R.skew.top_k(rows.select(F.col("label").cast("string").alias("question_id"), F.col("vec_id").cast("string").alias("chunk_id"), "n_chars", "vec_id"),
                        ["question_id"], [F.desc("n_chars"), F.asc("vec_id")], 30)


def flat_channels(df):
    return df.withColumn("channels", F.array_join(F.transform(F.map_entries("channels"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


D_FUSE = f"""{D_QUERIES},
dense AS (SELECT index_id AS question_id, vec_id::VARCHAR AS chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf_score, string_agg(concat(channel, '=', rank::VARCHAR), ',' ORDER BY channel) AS channels,
  max(1 - distance) AS similarity FROM hits GROUP BY ALL),
lex AS (SELECT label::VARCHAR AS question_id, vec_id::VARCHAR AS chunk_id, row_number() OVER (PARTITION BY label ORDER BY n_chars DESC, vec_id) AS rank
  FROM embeddings JOIN documents ON vec_id = doc_id QUALIFY rank <= 30),
outer_hits AS (SELECT question_id, chunk_id, 'vector' AS channel, row_number() OVER (PARTITION BY question_id ORDER BY round(rrf_score, 12) DESC, chunk_id) AS rank, similarity FROM dense
  UNION ALL SELECT question_id, chunk_id, 'full_text', rank, NULL FROM lex),
fused AS (SELECT question_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf_score, string_agg(concat(channel, '=', rank::VARCHAR), ',' ORDER BY channel) AS channels, max(similarity) AS similarity
  FROM outer_hits GROUP BY ALL)"""

query(
    "rank_fusion",
    "F2",
    f"WITH {D_FUSE} SELECT question_id, chunk_id, round(rrf_score, 8) AS rrf_score, channels, round(similarity, 6) AS similarity FROM dense",
)(lambda t: flat_channels(R.fuse(dense(t), ["question_id"])).withColumn("rrf_score", F.round("rrf_score", 8)).withColumn("similarity", F.round("similarity", 6)))


def nested(t):
    return R.nested_fusion(dense(t), lexical_hits(t), ["question_id"])


query(
    "nested_rank_fusion",
    "F3",
    f"""WITH {D_FUSE} SELECT question_id, chunk_id, round(rrf_score, 8) AS rrf_score, channels,
row_number() OVER (PARTITION BY question_id ORDER BY round(rrf_score, 12) DESC, chunk_id) AS rank FROM fused QUALIFY rank <= 40""",
)(lambda t: flat_channels(nested(t)).select("question_id", "chunk_id", F.round("rrf_score", 8).alias("rrf_score"), "channels", F.col("rank").cast("long").alias("rank")))

# ---- sections ------------------------------------------------------------------------
SECTIONS = """SELECT source AS document_id, concat('c', CAST(doc_id AS STRING)) AS chunk_id, doc_id AS ordinal, CAST(1 + doc_id % 40 AS INT) AS page_no,
  concat('#/texts/', CAST(doc_id AS STRING)) AS item_ref,
  CASE doc_id % 8 WHEN 0 THEN '1 Introduction' WHEN 1 THEN 'II. Our Method' WHEN 2 THEN '3.2 Results and ablation' WHEN 3 THEN 'References' WHEN 4 THEN 'Acknowledgements'
    WHEN 5 THEN '5) Limitations' WHEN 6 THEN 'Abstract' ELSE 'Data' END AS heading,
  CASE WHEN doc_id % 16 = 7 THEN concat('Abstract. ', text) ELSE text END AS body FROM {documents}"""


def section_chunks(t):
    c = t.sql(SECTIONS)
    return c.select("document_id", "chunk_id", "ordinal", F.array("heading").alias("headings"), F.array("item_ref").alias("source_refs"), F.array("page_no").alias("pages"),
                    F.concat("heading", F.lit("\n"), "body").alias("contextualized_text"))


def kinds(t):
    return stage(R.with_section_kind(R.chunk_roles(section_chunks(t), R.item_roles(text_items(t)))))


D_ROLE = f"""roles AS (SELECT document_id, item_ref, CASE WHEN label = 'page_header' THEN 'document_metadata'
  WHEN label IN ('text', 'section_header') AND regexp_matches(text, '^(?i)\\s*abstract(\\s*[.:—–-]|\\s*\\n|\\s*$)') THEN 'abstract' END AS role FROM ({D_TEXT}))"""
D_KIND = f"""{D_ROLE}, sc AS ({duck(SECTIONS)}),
kind AS (SELECT s.*, coalesce(r.role, CASE WHEN regexp_matches(body, '^(?i)\\s*abstract(\\s*[.:—–-]|\\s*\\n|\\s*$)') THEN 'abstract' END, CASE heading WHEN '1 Introduction' THEN 'introduction' WHEN 'II. Our Method' THEN 'method' WHEN '3.2 Results and ablation' THEN 'results'
  WHEN 'References' THEN 'references' WHEN 'Acknowledgements' THEN 'backmatter' WHEN '5) Limitations' THEN 'conclusion' WHEN 'Abstract' THEN 'abstract' ELSE 'body' END) AS section_kind
  FROM sc s JOIN roles r ON r.document_id = s.document_id AND r.item_ref = s.item_ref)"""

query("item_roles", "F4 F5", f"WITH {D_ROLE} SELECT document_id, item_ref AS ref, role FROM roles WHERE role IS NOT NULL")(lambda t: R.item_roles(text_items(t)))
query("section_kinds", "F4 F6 F7", f"WITH {D_KIND} SELECT document_id, chunk_id, section_kind FROM kind")(lambda t: kinds(t).select("document_id", "chunk_id", "section_kind"))

PLANS = """SELECT concat('src', CAST(conv_id % 20 AS STRING)) AS document_id, conv_id * 1000 + turn AS question_id, text AS question,
  CASE conv_id % 9 WHEN 0 THEN 'overview' WHEN 1 THEN 'problem' WHEN 2 THEN 'contributions' WHEN 3 THEN 'method' WHEN 4 THEN 'results' WHEN 5 THEN 'references'
   WHEN 6 THEN 'metadata' WHEN 7 THEN 'fact' ELSE 'comparison' END AS intent FROM {conversations} WHERE role = 'user'"""

D_STRUCT = f"""{D_KIND}, pl AS ({duck(PLANS).replace('STRING', 'VARCHAR')}),
pri(intent, section_kind, priority) AS (VALUES ('overview','abstract',0),('overview','introduction',1),('overview','conclusion',2),('problem','abstract',0),('problem','introduction',1),
  ('contributions','abstract',0),('contributions','conclusion',1),('contributions','introduction',2),('method','method',0),('results','results',0),('references','references',0)),
kn AS (SELECT *, row_number() OVER (PARTITION BY document_id, section_kind ORDER BY ordinal) AS kind_no FROM kind),
struct AS (SELECT pl.document_id, pl.question_id, kn.chunk_id, kn.section_kind, (priority * 2 + kind_no)::INT AS place FROM pl JOIN pri USING (intent) JOIN kn ON kn.document_id = pl.document_id AND kn.section_kind = pri.section_kind AND kind_no <= 2)"""

query("structural_candidates", "F8", f"WITH {D_STRUCT} SELECT * FROM struct")(
    lambda t: R.structural_candidates(kinds(t), t.sql(PLANS)).drop("ordinal"))

query(
    "structural_fallback",
    "F8",
    f"""WITH {D_STRUCT}, fr AS (SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY ordinal)::INT AS place FROM kind WHERE ordinal % 3 = 0 AND section_kind = 'body')
SELECT pl.document_id, question_id, chunk_id, 'front_page' AS section_kind, place FROM pl JOIN fr USING (document_id) WHERE intent IN ('overview', 'problem', 'contributions') AND place <= 3""",
)(lambda t: R.structural_candidates(kinds(t).where("section_kind = 'body'").withColumn("pages", F.array((1 + F.col("ordinal") % 3).cast("int"))), t.sql(PLANS)).drop("ordinal"))

query(
    "header_candidates",
    "F9",
    f"""SELECT document_id, concat('docling-item:', item_ref) AS chunk_id, place FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY pos)::INT AS place FROM ({D_TEXT})
WHERE label = 'page_header' AND page_no % 8 = 4 AND length(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) BETWEEN 1 AND 2000 AND NOT regexp_matches(trim(text), '^[0-9]+$')) WHERE place <= 5""",
)(lambda t: R.header_candidates(text_items(t).withColumn("pages", F.array((F.col("page_no") % 8 - 3).cast("int")))).select("document_id", "chunk_id", "place"))


def fused_for_plans(t):
    """Vector hits of two sub-queries and full-text hits of the words of every question, fused."""
    asked_ = t.sql(PLANS).select("document_id", "question_id", "question")
    chunk = t.embeddings.join(t.documents, F.col("vec_id") == F.col("doc_id")).select(
        F.col("source").alias("index_id"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("doc_id").alias("ordinal"), "embedding")
    known = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    conv, turn = F.floor(F.col("question_id") / 1000), F.col("question_id") % 1000
    sub = lambda channel, vec: asked_.select(F.col("document_id").alias("index_id"), F.col("question_id").alias("query_id"), F.lit(channel).alias("channel"), vec.alias("vec_id")).join(known, "vec_id").drop("vec_id")
    # The vectors are read once for every round of questions.
    dense_ = V.exact_top_k(stage(chunk), sub("query_0", conv).unionByName(sub("query_1", conv + turn + 1)), 30)
    dense_ = dense_.select(F.col("index_id").alias("document_id"), F.col("query_id").alias("question_id"), "channel", "rank", "chunk_id", (1 - F.col("distance")).alias("similarity"))
    texts = section_chunks(t).select(F.col("document_id").alias("index_id"), "chunk_id", "ordinal", "contextualized_text")
    words = F.filter(F.split("question", " "), lambda w: F.length(w) > 3)
    text = T.phrase_search(stage(T.postings(texts)), asked_.select(F.col("document_id").alias("index_id"), "question_id", words.alias("keywords")))
    return R.nested_fusion(dense_, text.withColumnRenamed("index_id", "document_id"), ["document_id", "question_id"], None)


D_QUESTION_WORDS = "SELECT DISTINCT document_id AS index_id, question_id, phrase FROM (SELECT document_id, question_id, unnest(string_split(question, ' ')) AS phrase FROM pl) WHERE length(phrase) > 3"
D_FUSED = f"""dv AS (SELECT source AS document_id, concat('c', vec_id) AS chunk_id, vec_id, embedding::DOUBLE[] AS e FROM embeddings JOIN documents ON doc_id = vec_id),
pq AS (SELECT document_id, question_id, 'query_0' AS channel, embedding::DOUBLE[] AS e FROM pl JOIN embeddings ON vec_id = question_id // 1000
  UNION ALL SELECT document_id, question_id, 'query_1', embedding::DOUBLE[] FROM pl JOIN embeddings ON vec_id = question_id // 1000 + question_id % 1000 + 1),
dh AS (SELECT pq.document_id, question_id, channel, chunk_id, row_number() OVER (PARTITION BY question_id, channel ORDER BY round(1 - list_cosine_similarity(pq.e, dv.e), 9), vec_id) AS rank FROM pq JOIN dv USING (document_id) QUALIFY rank <= 30),
vr AS (SELECT document_id, question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 12) DESC, chunk_id) AS rank FROM dh GROUP BY document_id, question_id, chunk_id),
{d_search(D_QUESTION_WORDS, "(SELECT document_id AS source, ordinal AS doc_id, concat(heading, chr(10), body) AS text FROM sc)")},
fz AS (SELECT document_id, question_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM (SELECT * FROM vr UNION ALL SELECT index_id, question_id, concat('c', chunk_id), rank FROM found) GROUP BY ALL)"""

D_CAND = f"""{D_STRUCT}, {D_FUSED},
fu AS (SELECT fz.document_id, fz.question_id, intent, fz.chunk_id, section_kind, rrf FROM fz JOIN pl ON pl.question_id = fz.question_id JOIN kind ON kind.document_id = fz.document_id AND kind.chunk_id = fz.chunk_id),
top AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(rrf, 12) DESC, chunk_id) AS rank FROM fu
  WHERE (intent = 'metadata' OR section_kind <> 'document_metadata') AND (intent = 'references' OR section_kind NOT IN ('references', 'backmatter')) QUALIFY rank <= 40),
cand AS (SELECT coalesce(t.document_id, s.document_id) AS document_id, coalesce(t.question_id, s.question_id) AS question_id, coalesce(t.chunk_id, s.chunk_id) AS chunk_id,
  coalesce(round(t.rrf, 8), 0) AS rrf_score, s.chunk_id IS NOT NULL AS from_section, coalesce(t.rank, 40 + s.place)::INT AS candidate_no
  FROM top t FULL JOIN struct s ON s.question_id = t.question_id AND s.chunk_id = t.chunk_id)"""


def candidates(t):
    return R.assemble_candidates(fused_for_plans(t), kinds(t), t.sql(PLANS), R.structural_candidates(kinds(t), t.sql(PLANS)))


query("candidate_assembly", "F10", f"WITH {D_CAND} SELECT * FROM cand")(
    lambda t: candidates(t).select("document_id", "question_id", "chunk_id", F.round("rrf_score", 8).alias("rrf_score"),
                                   F.map_contains_key("channels", "document_section").alias("from_section"), "candidate_no"))


def positioned(t):
    return t.conversations.select(F.col("conv_id").alias("question_id"), F.col("turn").alias("position"), F.concat(F.lit("c"), "turn").alias("chunk_id"))


query(
    "apply_rerank",
    "F11",
    """WITH s AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 1 AND turn = 0 THEN 1 ELSE turn END AS idx, CASE WHEN conv_id % 5 = 2 AND turn = 1 THEN NULL ELSE (length(text) % 50)::DOUBLE END AS logit FROM conversations),
n AS (SELECT conv_id, count(*) AS n, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY conv_id),
v AS (SELECT s.conv_id, any_value(n) = count(DISTINCT idx) AND min(idx) = 0 AND max(idx) = any_value(n) - 1 AND count(logit) = count(*) AS ok FROM s JOIN n USING (conv_id) GROUP BY s.conv_id)
SELECT s.conv_id AS question_id, s.turn AS position, CASE WHEN ok THEN logit END AS rerank_score, row_number() OVER (PARTITION BY s.conv_id ORDER BY CASE WHEN ok THEN logit END DESC NULLS LAST, s.turn)::INT AS rank,
  CASE WHEN ok THEN 'applied' ELSE 'unavailable' END AS status FROM s JOIN v USING (conv_id)""",
)(
    lambda t: R.apply_rerank(
        positioned(t),
        t.conversations.select(F.col("conv_id").alias("question_id"), F.when((F.col("conv_id") % 3 == 1) & (F.col("turn") == 0), 1).otherwise(F.col("turn")).alias("index"),
                               F.when((F.col("conv_id") % 5 == 2) & (F.col("turn") == 1), float("nan")).otherwise((F.length("text") % 50).cast("double")).alias("logit")),
    ).drop("chunk_id")
)


def assembled(t, k, budget=R.BUDGET):
    costs = section_chunks(t).select("document_id", "chunk_id", R.source_cost(F.col("contextualized_text"), F.col("pages")).alias("cost"))
    ranked = stage(skew.shuffled_join(candidates(t), costs, ["document_id", "chunk_id"]).select("question_id", F.col("candidate_no").alias("rank"), "chunk_id", "cost"))
    structural = R.structural_candidates(kinds(t), t.sql(PLANS)).select("question_id", "place", "chunk_id", "section_kind")
    return R.assemble_sources(ranked, structural, t.sql(PLANS), k, budget)


def d_assembled(k, budget):
    """The greedy choice source by source, as a recursion over each question's ordered sources."""
    return f"""WITH RECURSIVE {D_CAND}, prot AS (SELECT question_id, chunk_id, min(place) AS p FROM (SELECT struct.*, intent, row_number() OVER (PARTITION BY struct.question_id, section_kind ORDER BY place) AS kn
   FROM struct JOIN pl ON pl.question_id = struct.question_id WHERE intent IN ('overview', 'problem', 'contributions', 'metadata')) WHERE intent = 'metadata' OR kn = 1 GROUP BY ALL),
o AS MATERIALIZED (SELECT cand.question_id, cand.chunk_id, row_number() OVER (PARTITION BY cand.question_id ORDER BY p IS NULL, coalesce(p, 0), candidate_no, cand.chunk_id) AS n,
   length(to_json(concat(heading, chr(10), body))::VARCHAR) + length(concat('{{"source_id": "S", "pages": [', page_no, '], "text": }}')) AS size,
   length(to_json(question)::VARCHAR) + length('{{"question": , "sources": []}}') AS frame
  FROM cand JOIN kind ON kind.document_id = cand.document_id AND kind.chunk_id = cand.chunk_id JOIN pl ON pl.question_id = cand.question_id
  LEFT JOIN prot ON prot.question_id = cand.question_id AND prot.chunk_id = cand.chunk_id),
g AS (SELECT question_id, 0::BIGINT AS n, frame AS used, 0 AS taken, NULL::VARCHAR AS chunk_id, false AS fits FROM o WHERE n = 1
  UNION ALL SELECT o.question_id, o.n, CASE WHEN f.fits THEN f.total ELSE g.used END, CASE WHEN f.fits THEN g.taken + 1 ELSE g.taken END, o.chunk_id, f.fits
  FROM g JOIN o ON o.question_id = g.question_id AND o.n = g.n + 1,
  LATERAL (SELECT g.used + o.size + length((g.taken + 1)::VARCHAR) + CASE WHEN g.taken > 0 THEN 2 ELSE 0 END AS total, g.taken < {k} AND g.used + o.size + length((g.taken + 1)::VARCHAR) + CASE WHEN g.taken > 0 THEN 2 ELSE 0 END <= {budget} AS fits) f)
SELECT question_id, (n - 1)::INT AS place, chunk_id, CASE WHEN fits THEN concat('S', taken::VARCHAR) END AS source_id FROM g WHERE n > 0"""


query("source_assembly", "F12", d_assembled(5, R.BUDGET))(lambda t: assembled(t, 5))
query("source_assembly_tight", "F12", d_assembled(8, 9_000))(lambda t: assembled(t, 8, 9_000))


query(
    "second_round_sources",
    "F17",
    """SELECT conv_id AS question_id, concat('c', (turn % 3)::VARCHAR) AS chunk_id, CASE WHEN bool_or(role <> 'user') THEN 1 ELSE 2 END AS round, bool_and(role = 'user') AS newly_added
FROM conversations GROUP BY conv_id, turn % 3""",
)(
    lambda t: (lambda c: R.second_round(c.where("role <> 'user'").drop("role"), c.where("role = 'user'").drop("role")).drop("place"))(
        t.conversations.select(F.col("conv_id").alias("question_id"), F.col("turn").alias("place"), F.concat(F.lit("c"), (F.col("turn") % 3).cast("string")).alias("chunk_id"), "role"))
)

# ---- question plans ------------------------------------------------------------------
WORDED = """SELECT conv_id * 1000 + turn AS question_id, conv_id, turn,
  CASE conv_id % 10 WHEN 0 THEN concat('Please summarize: ', text) WHEN 1 THEN 'Could you please explain the selected research paper briefly?' WHEN 2 THEN concat('Who are the authors of this paper? ', text)
    WHEN 3 THEN concat('What problem does it address and 12k ', text) WHEN 4 THEN concat('How does the approach work? ', text) WHEN 5 THEN concat('List its contributions. ', text)
    WHEN 6 THEN concat('Show the references used. ', text) WHEN 7 THEN 'What is this about?' WHEN 8 THEN 'Tell me what the document is about in simple terms!' ELSE text END AS question
FROM {conversations} WHERE role = 'user'"""


def worded(t):
    return t.sql(WORDED)


D_WORDED = duck(WORDED)
KW_STOP = ", ".join(f"'{w}'" for w in Q.KEYWORD_STOP_WORDS)
D_KW = f"""(SELECT list_slice(list(w ORDER BY i), 1, 12) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i) WHERE lower(w) NOT IN ({KW_STOP}) AND length(w) > 1 GROUP BY w))"""

query(
    "overview_requests",
    "F14",
    f"SELECT question_id, conv_id % 10 IN (1, 7, 8) AS broad FROM ({D_WORDED})",
)(lambda t: worded(t).select("question_id", Q.is_overview_request(F.col("question")).alias("broad")))

query(
    "fallback_plans",
    "F15",
    f"""SELECT question_id, CASE conv_id % 10 WHEN 0 THEN 'overview' WHEN 1 THEN 'overview' WHEN 2 THEN 'metadata' WHEN 3 THEN 'problem' WHEN 4 THEN 'method' WHEN 5 THEN 'contributions' WHEN 6 THEN 'references'
  WHEN 7 THEN 'overview' WHEN 8 THEN 'overview' ELSE 'fact' END AS intent, coalesce(array_to_string({D_KW}, '|'), '') AS keywords
FROM (SELECT *, regexp_extract_all(question, '[\\p{{L}}\\p{{N}}_-]+') AS ws FROM ({D_WORDED}))""",
)(lambda t: Q.fallback_plans(worded(t)).select("question_id", "intent", F.array_join("keywords", "|").alias("keywords")))


def planned(t):
    words = F.split("question", " ")
    return worded(t).select("question_id", "question", F.lit("fact").alias("intent"), F.array("question", F.element_at(words, 1)).alias("search_queries"),
                            F.array(F.element_at(words, 1), F.lit("12K"), F.lit("3.5 million"), F.lit("7 apples")).alias("keywords"))


query(
    "clean_plans",
    "F13",
    f"""SELECT question_id, array_to_string(CASE WHEN question = w THEN [question] ELSE [question, w] END, '|') AS search_queries,
  array_to_string(list_concat([w], CASE WHEN contains(lower(question), '12k') THEN ['12K'] ELSE [] END, ['7 apples']), '|') AS keywords FROM (SELECT *, string_split(question, ' ')[1] AS w FROM ({D_WORDED}))""",
)(lambda t: Q.clean_plans(planned(t)).select("question_id", F.array_join("search_queries", "|").alias("search_queries"), F.array_join("keywords", "|").alias("keywords")))

query(
    "plan_violations",
    "F13",
    f"SELECT question_id, 'search_query_length' AS rule FROM ({D_WORDED}) WHERE length(question) > 75",
)(lambda t: Q.plan_violations(planned(t).withColumn("search_queries", F.array(F.repeat("question", 8)))))

query(
    "plan_novelty",
    "F16",
    f"""SELECT question_id, CASE WHEN conv_id % 2 = 0 THEN 'second try' ELSE '' END AS new_queries, conv_id % 3 = 0 AS intent_changed, conv_id % 2 = 0 OR conv_id % 3 = 0 AS is_new FROM ({D_WORDED})""",
)(
    lambda t: Q.plan_novelty(
        planned(t),
        worded(t).select("question_id", F.when(F.col("conv_id") % 3 == 0, "method").otherwise("fact").alias("intent"),
                         F.when(F.col("conv_id") % 2 == 0, F.array(F.lit(" Second  TRY "))).otherwise(F.array("question")).alias("search_queries"),
                         F.array(F.lit("12k")).alias("keywords")),
    ).select("question_id", F.array_join("new_queries", "|").alias("new_queries"), "intent_changed", "is_new")
)

JOBS = """SELECT conv_id * 1000 + turn AS question_id, conv_id % 7 AS paper_id, CASE WHEN turn >= 2 THEN conv_id * 1000 + turn - 2 END AS context_question_id,
  CASE WHEN (conv_id + turn) % 5 = 0 THEN 'failed' ELSE 'completed' END AS status, substring(text, 1, 40) AS question, text AS answer, turn AS created_at FROM {conversations}"""

query(
    "question_context",
    "F23",
    f"""WITH j AS ({duck(JOBS)}), d AS (SELECT * FROM j WHERE status = 'completed'),
a AS (SELECT j.question_id, j.paper_id, d.question AS q, d.answer AS ans, d.context_question_id AS up FROM j JOIN d ON d.question_id = j.context_question_id AND d.paper_id = j.paper_id)
SELECT question_id, 2 AS place, q AS question, substr(ans, 1, 1800) AS answer FROM a
UNION ALL SELECT a.question_id, 1, d.question, substr(d.answer, 1, 1800) FROM a JOIN d ON d.question_id = a.up AND d.paper_id = a.paper_id""",
)(lambda t: Q.question_context(t.sql(JOBS)))

query(
    "rejected_context",
    "F23",
    f"""WITH j AS ({duck(JOBS)}) SELECT question_id FROM j WHERE context_question_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM j d WHERE d.status = 'completed' AND d.question_id = j.context_question_id)""",
)(lambda t: Q.rejected_context(t.sql(JOBS)))

query(
    "question_history",
    "F24",
    f"""WITH j AS ({duck(JOBS)}) SELECT paper_id, question_id, row_number() OVER (PARTITION BY paper_id ORDER BY created_at DESC, question_id DESC)::INT AS place FROM j QUALIFY place <= 10""",
)(lambda t: Q.history(t.sql(JOBS)).select("paper_id", "question_id", "place"))
