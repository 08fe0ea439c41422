"""Call ledgers, job states and evaluation over events, documents and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from attesta.functions.lineage import shared_folder
from attesta.operators import evaluation as E
from attesta.operators import ledger as L
from attesta.plans import duck, fixtures as fx, query
from attesta.plans.searching import D_QUERIES, hits
from attesta.streaming import jobs as J

D_CALLS = duck(fx.CALLS).replace("STRING", "VARCHAR")


def calls(t):
    return t.sql(fx.CALLS)


query(
    "unresolved_failures",
    "I1",
    f"""WITH c AS ({D_CALLS}), k AS (SELECT *, CASE WHEN call_id % 2 = 0 THEN NULL ELSE concat(logical_hash, '-', (call_id % 40)::VARCHAR) END AS lh FROM c)
SELECT call_id FROM k WHERE status IN ('failed', 'started') AND NOT EXISTS (SELECT 1 FROM k d WHERE d.status IN ('completed', 'cache_hit') AND d.request_hash = k.request_hash)
AND NOT EXISTS (SELECT 1 FROM k d WHERE d.status IN ('completed', 'cache_hit') AND d.lh = k.lh)""",
)(lambda t: L.unresolved_failures(calls(t).withColumn("logical_hash", F.when(F.col("call_id") % 2 != 0, F.concat_ws("-", "logical_hash", (F.col("call_id") % 40).cast("string"))))).select("call_id"))
query(
    "call_usage",
    "I2 A10",
    f"""WITH c AS ({D_CALLS}) SELECT logical_hash, count(*) FILTER (WHERE status <> 'cache_hit') AS real_calls, count(*) FILTER (WHERE status = 'cache_hit') AS cache_hits,
  coalesce(sum(coalesce(used_tokens, reserved_tokens, 0)) FILTER (WHERE status <> 'cache_hit'), 0)::BIGINT AS tokens, count(*) FILTER (WHERE status = 'failed') AS failures,
  string_agg(DISTINCT model, ',' ORDER BY model) AS models, round(sum(seconds) FILTER (WHERE status <> 'cache_hit'), 4) AS elapsed FROM c GROUP BY logical_hash""",
)(lambda t: L.usage(calls(t), ["logical_hash"]).withColumn("elapsed", F.round("elapsed", 4)))
query(
    "exact_duplicates",
    "I3",
    f"WITH c AS ({D_CALLS}) SELECT call_id, row_number() OVER (PARTITION BY request_hash ORDER BY call_id) > 1 AS cache_hit FROM c",
)(lambda t: L.exact_duplicates(calls(t)).select("call_id", "cache_hit"))
query(
    "request_fingerprints",
    "I3 A3",
    """SELECT event_id, sha256(concat('{"event_type":"', event_type, '","props":"', replace(props, '"', '\\"'), '","user_id":', user_id, '}')) AS fingerprint FROM events""",
)(lambda t: t.events.select("event_id", L.request_fingerprint("user_id", "event_type", "props").alias("fingerprint")))

JOB_EVENTS = """SELECT concat('j', CAST(user_id AS STRING)) AS job_id, event_id, ts, event_type AS status, event_type <> 'view' AS has_status,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('stage ', CAST(event_id % 7 AS STRING)) END AS stage, event_id % 3 = 0 AS has_stage,
  value AS done, event_type = 'purchase' AS has_done FROM {events}"""

query(
    "job_states",
    "I5",
    f"""WITH e AS ({duck(JOB_EVENTS).replace('STRING', 'VARCHAR')}),
s AS (SELECT job_id, status FROM e WHERE has_status QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1),
g AS (SELECT job_id, stage FROM e WHERE has_stage QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1),
d AS (SELECT job_id, done FROM e WHERE has_done QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1),
n AS (SELECT job_id, max(ts) AS updated_at, count(*) AS events FROM e GROUP BY job_id)
SELECT n.job_id, status, stage, done, updated_at, events FROM n LEFT JOIN s USING (job_id) LEFT JOIN g USING (job_id) LEFT JOIN d USING (job_id)""",
)(lambda t: L.job_states(t.sql(JOB_EVENTS), ["status", "stage", "done"]))

# The same events as a stream: a file for every three days, some events two files late; a job is a user's day.
STREAM_EVENTS = """SELECT concat('j', CAST(user_id AS STRING), '-', CAST(day(ts) AS STRING)) AS job_id, event_id, ts, event_type AS status, event_type <> 'view' AS has_status,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE concat('stage ', CAST(event_id % 7 AS STRING)) END AS stage, event_id % 3 = 0 AS has_stage, value AS done, event_type = 'purchase' AS has_done,
  least(CAST(floor((day(ts) - 1) / 3) AS INT) + CASE WHEN event_id % 37 = 0 THEN 2 ELSE 0 END, 9) AS file FROM {events}"""
D_STREAM = f"""a AS ({duck(STREAM_EVENTS).replace('STRING', 'VARCHAR')}), m AS (SELECT file, max(max(ts)) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS bound FROM a GROUP BY file),
late AS (SELECT a.* FROM a JOIN m USING (file) WHERE ts < bound), e AS (SELECT a.* FROM a JOIN m USING (file) WHERE bound IS NULL OR ts >= bound)"""


def streamed_jobs(t, fold=True):
    """Files arrive one after another, and both streaming queries (or the first one alone) run over each arrival; the folder of their results."""
    folder = f"{shared_folder(t.spark)}/jobs-{uuid.uuid4()}"
    events = t.sql(STREAM_EVENTS)
    schema = events.drop("file").schema
    for file in range(10):
        events.where(F.col("file") == file).drop("file").write.mode("append").parquet(f"{folder}/arrived")
        J.admit(J.read_events(t.spark, f"{folder}/arrived", schema, None), folder).awaitTermination()
        if fold:
            J.keep_states(J.fold_jobs(J.read_events(t.spark, f"{folder}/admitted", schema, None), finished="purchase"), folder, file < 9).awaitTermination()
    return folder


query(
    "streamed_job_states",
    "I5",
    f"""WITH {D_STREAM},
s AS (SELECT job_id, status FROM e WHERE has_status QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1),
g AS (SELECT job_id, stage FROM e WHERE has_stage QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1),
d AS (SELECT job_id, done FROM e WHERE has_done QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1),
n AS (SELECT job_id, max(ts) AS updated_at, count(*) AS events FROM e GROUP BY job_id)
SELECT n.job_id, status, stage, round(done, 6) AS done, date_trunc('second', updated_at) AS updated, events,
  coalesce(status = 'purchase', false) AND updated_at + INTERVAL 2 HOUR < (SELECT max(ts) FROM e) - INTERVAL 1 HOUR AS closed FROM n LEFT JOIN s USING (job_id) LEFT JOIN g USING (job_id) LEFT JOIN d USING (job_id)""",
)(lambda t: J.latest_states(t.spark, streamed_jobs(t)).select("job_id", "status", "stage", F.round(F.col("done").cast("double"), 6).alias("done"), F.timestamp_seconds(F.floor("updated")).cast("timestamp_ntz").alias("updated"), "events", "closed"))
query("late_job_events", "I5", f"WITH {D_STREAM} SELECT event_id, job_id FROM late")(lambda t: t.spark.read.parquet(f"{streamed_jobs(t, fold=False)}/late").select("event_id", "job_id"))

ATTEMPTS = """SELECT user_id AS question_id, event_id, event_id AS attempt_no, CAST(event_id % 4 AS INT) AS request_attempt,
  CASE event_type WHEN 'error' THEN 429 WHEN 'view' THEN 503 WHEN 'click' THEN 401 WHEN 'signup' THEN 500 END AS status_code, CASE WHEN event_id % 5 = 0 THEN floor(value) END AS retry_after FROM {events}"""
query(
    "retry_plan",
    "I7",
    f"""WITH a AS ({duck(ATTEMPTS)}), d AS (SELECT *, CASE WHEN status_code IN (408, 429, 500, 502, 503, 504) AND request_attempt < 2 THEN coalesce(greatest(retry_after, 0), 4.0 * pow(2, request_attempt)) END AS delay FROM a),
c AS (SELECT *, sum(coalesce(delay, 0)) OVER (PARTITION BY question_id ORDER BY attempt_no) AS cw FROM d)
SELECT event_id, round(cw, 3)::DOUBLE AS cumulative_wait, CASE WHEN status_code IS NULL OR status_code = 401 THEN 'non_retryable' WHEN request_attempt >= 2 THEN 'attempt_limit' WHEN cw > 60 THEN 'wait_budget' ELSE 'wait' END AS decision FROM c""",
)(
    lambda t: L.retry_plan(t.sql(ATTEMPTS).withColumn("retry_after", F.col("retry_after").cast("double")), ["question_id"]).select(
        "event_id", F.round("cumulative_wait", 3).alias("cumulative_wait"), "decision")
)
query(
    "error_classes",
    "I10",
    f"""WITH a AS ({duck(ATTEMPTS)}) SELECT event_id, coalesce(status_code IN (408, 429, 500, 502, 503, 504), false) AS temporary,
  CASE WHEN status_code = 429 THEN 'rate_limited' WHEN status_code IN (500, 503) THEN 'temporarily_unavailable' WHEN status_code = 401 THEN 'access_rejected' ELSE 'request_failed' END AS public_error FROM a""",
)(lambda t: t.sql(ATTEMPTS).select("event_id", L.temporary_error(F.col("status_code")).alias("temporary"), L.public_error(F.col("status_code")).alias("public_error")))
query(
    "retry_after_headers",
    "I7",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN (o_custkey - 500)::DOUBLE WHEN 1 THEN greatest(0, epoch(o_orderdate) - epoch(TIMESTAMP '1997-01-01'))::DOUBLE END AS s0 FROM orders""".replace("(o_custkey - 500)::DOUBLE", "greatest(0, o_custkey - 500)::DOUBLE"),
)(
    lambda t: t.orders.select("o_orderkey", L.retry_after_seconds(
        F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_custkey") - 500).cast("string")).when(
            F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise("soon"),
        F.lit("1997-01-01").cast("timestamp")).alias("s0"))
)
query(
    "redact_text",
    "I8",
    "SELECT doc_id, md5(regexp_replace(replace(replace(text, 'the', '[REDACTED]'), 'an', '[REDACTED]'), '\\x1B\\[[0-?]*[ -/]*[@-~]', '', 'g')) AS text FROM documents",
)(lambda t: t.documents.select("doc_id", F.md5(L.redact(F.col("text"), ["an", "the", ""])).alias("text")))
query(
    "redact_fields",
    "I8",
    "SELECT event_id, '[REDACTED]' AS token, event_type AS kind FROM events",
)(lambda t: t.events.select("event_id", L.redact_fields(F.create_map(F.lit("API_Key"), "props", F.lit("kind"), "event_type")).alias("m")).select("event_id", F.col("m")["API_Key"].alias("token"), F.col("m")["kind"].alias("kind")))
query(
    "stage_progress",
    "I9",
    """SELECT o_orderpriority AS stage, count(*) AS records, count(*) FILTER (WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')) AS done FROM orders GROUP BY o_orderpriority""",
)(lambda t: L.progress(t.orders.select(F.col("o_orderpriority").alias("stage"), F.col("o_orderkey").alias("record_id")), t.lineitem.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("record_id")), ["stage"]))
query(
    "binding_mismatches",
    "I12",
    """SELECT o_orderkey AS question_id, 'document_sha256' AS mismatch FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT o_orderkey, 'index_id' FROM orders WHERE o_orderstatus = 'P'""",
)(
    lambda t: L.binding_mismatches(
        t.orders.select(F.col("o_orderkey").alias("question_id"), F.col("o_custkey").alias("paper_id"), F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise("d").alias("document_sha256"),
                        F.when(F.col("o_orderstatus") == "P", "y").otherwise("i").alias("index_id")),
        t.customer.select(F.col("c_custkey").alias("paper_id"), F.lit("d").alias("document_sha256"), F.lit("i").alias("index_id")), ["document_sha256", "index_id"])
)

# ---- evaluation ----------------------------------------------------------------------
# A case per vector index and mode; the evidence is the index's first and last vectors,
# required to carry the first words of the equally numbered document.
def eval_hits(t):
    docs = t.documents.select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    return hits(t).select(F.col("query_id").alias("case_id"), F.col("channel").alias("mode"), "rank", "chunk_id").join(docs, "chunk_id").withColumn("refs", F.array("chunk_id"))


def ends(t):
    return t.embeddings.groupBy(F.col("label").cast("string").alias("case_id")).agg(F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi"))


def evidence(t):
    e = ends(t).select("case_id", F.posexplode(F.array("lo", "hi")).alias("group_no", "vec_id"))
    docs = t.documents.select(F.col("doc_id").alias("vec_id"), "text")
    return e.join(docs, "vec_id").select("case_id", "group_no", F.col("vec_id").cast("string").alias("ref"), F.array(F.upper(F.substring("text", 1, 12)), F.substring("text", 4, 6)).alias("phrases"))


def cases(t):
    modes = F.explode(F.array(F.lit("query_0"), F.lit("query_1"))).alias("mode")
    return ends(t).select("case_id", F.when(F.col("case_id").cast("int") % 4 == 3, "unsupported").otherwise("answerable").alias("kind"), modes)


def ranks(t):
    return E.group_ranks(cases(t), eval_hits(t), evidence(t))


def runs(t):
    n = F.col("case_id").cast("int")
    return ends(t).select("case_id", F.when(n % 3 == 0, "llm").when(n % 3 == 1, "rules").alias("planner"), F.when(n % 5 == 0, "unavailable").otherwise("applied").alias("reranking"))


D_EVAL = f"""{D_QUERIES},
en AS (SELECT index_id, min(vec_id) AS lo, max(vec_id) AS hi FROM v GROUP BY index_id),
rk AS (SELECT en.index_id AS case_id, m.mode, CASE WHEN en.index_id::INT % 4 = 3 THEN 'unsupported' ELSE 'answerable' END AS kind, a.rank AS r0, b.rank AS r1
  FROM en CROSS JOIN (VALUES ('query_0'), ('query_1')) m(mode) LEFT JOIN hits a ON a.index_id = en.index_id AND a.channel = m.mode AND a.vec_id = en.lo LEFT JOIN hits b ON b.index_id = en.index_id AND b.channel = m.mode AND b.vec_id = en.hi),
ranks AS (SELECT case_id, mode, kind, CASE WHEN r0 IS NOT NULL AND r1 IS NOT NULL THEN greatest(r0, r1) END AS all_rank, least(r0, r1) AS any_rank FROM rk)"""
query("evidence_ranks", "J1 J2", f"WITH {D_EVAL} SELECT case_id, mode, kind, all_rank::INT AS all_rank, any_rank::INT AS any_rank FROM ranks")(ranks)
query(
    "retrieval_metrics",
    "J3",
    f"""WITH {D_EVAL} SELECT mode, count(*) AS answerable, {', '.join(f"round(avg(CASE WHEN {a}_rank <= {k} THEN 1.0 ELSE 0 END), 6)::DOUBLE AS {a}_hit_{k}" for a in ('all', 'any') for k in (1, 5, 10))},
  round(avg(CASE WHEN any_rank <= 10 THEN 1.0::DOUBLE / any_rank ELSE 0 END), 6) AS mrr_10 FROM ranks WHERE kind = 'answerable' GROUP BY mode""",
)(lambda t: (lambda m: m.select(*[F.round(c, 6).alias(c) if c not in ("mode", "answerable") else c for c in m.columns]))(E.retrieval_metrics(ranks(t))))
query(
    "mode_comparison",
    "J6",
    f"""WITH {D_EVAL} SELECT count(DISTINCT case_id) AS cases, count(*) FILTER (WHERE mode = 'query_0' AND any_rank IS NOT NULL) AS query_0, count(*) FILTER (WHERE mode = 'query_1' AND any_rank IS NOT NULL) AS query_1,
  count(DISTINCT case_id) FILTER (WHERE case_id::INT % 3 <> 0) AS planner_fallbacks, count(DISTINCT case_id) FILTER (WHERE case_id::INT % 5 = 0) AS reranker_unavailable FROM ranks""",
)(lambda t: E.mode_comparison(ranks(t), ["query_0", "query_1"], runs(t)))
query(
    "misplaced_terms",
    "J4",
    """WITH n AS (SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) AS body FROM documents), c AS (SELECT item_id, trim(regexp_replace(replace(lower(array_to_string(string_split(text, ' ')[1:4], ' ')), 'ß', 'ss'), '\\s+', ' ', 'g')) AS q FROM benchmark)
SELECT DISTINCT item_id FROM c JOIN n ON contains(body, q)""",
)(
    lambda t: E.misplaced_terms(t.benchmark.select(F.col("item_id").alias("case_id"), F.lit("corpus").alias("document_id"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("term")),
                                t.documents.select(F.lit("corpus").alias("document_id"), F.col("doc_id").cast("string").alias("evidence_id"), "text")).select(F.col("case_id").alias("item_id"))
)
query(
    "unwitnessed_evidence",
    "J4",
    """WITH e AS (SELECT label::VARCHAR AS case_id, min(vec_id) AS lo, max(vec_id) AS hi FROM embeddings GROUP BY label)
SELECT case_id, 0 AS group_no FROM e WHERE lo % 2 = 1 UNION ALL SELECT case_id, 1 FROM e WHERE hi % 2 = 1""",
)(lambda t: E.unwitnessed_evidence(evidence(t), t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.array(F.col("doc_id").cast("string")).alias("refs"))))
query(
    "prefix_differences",
    "J5",
    f"""WITH {D_QUERIES}, r AS (SELECT index_id AS case_id, channel, rank, vec_id FROM hits WHERE rank <= 10)
SELECT coalesce(a.case_id, b.case_id) AS case_id, coalesce(a.rank, b.rank)::INT AS rank, a.vec_id::VARCHAR AS now, b.vec_id::VARCHAR AS before FROM (SELECT * FROM r WHERE channel = 'query_0') a
FULL JOIN (SELECT * FROM r WHERE channel = 'query_1') b ON a.case_id = b.case_id AND a.rank = b.rank WHERE a.vec_id IS DISTINCT FROM b.vec_id""",
)(lambda t: (lambda h: E.prefix_differences(h.where("channel = 'query_0'"), h.where("channel = 'query_1'")))(hits(t).withColumnRenamed("query_id", "case_id")))


def check_nodes(t):
    n = lambda k: F.lit(None).cast(k)
    base = [n("string").alias(c) for c in ("table_label", "row_label", "column_label", "reported_value", "kind", "statement")]
    methods = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("Method").alias("label"), F.col("s_name").alias("name"), *base)
    sets = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("Dataset").alias("label"), F.col("n_name").alias("name"), *base)
    cells_ = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("Measurement").alias("label"), n("string").alias("name"), F.col("p_brand").alias("table_label"), F.col("p_name").alias("row_label"),
                           F.lit("Price").alias("column_label"), F.col("p_partkey").cast("string").alias("reported_value"), n("string").alias("kind"), n("string").alias("statement"))
    found = t.benchmark.select(F.concat(F.lit("b"), "item_id").alias("id"), F.lit("Finding").alias("label"), n("string").alias("name"), *[n("string").alias(c) for c in ("table_label", "row_label", "column_label", "reported_value")],
                               F.lit("result").alias("kind"), F.col("text").alias("statement"))
    return methods.unionByName(sets).unionByName(cells_).unionByName(found)


def check_edges(t):
    return t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target"), F.lit("TRAINED_ON").alias("label"))


def checks(t):
    n = lambda k: F.lit(None).cast(k)
    cols = ("type", "name", "relation", "source", "target", "table", "row", "metric", "value", "finding_kind")

    def make(df, prefix, key, kind, words=None, **values):
        return df.select(F.concat(F.lit(prefix), key).alias("check_id"), F.lit(kind).alias("kind"), *[(values[c] if c in values else n("string")).alias(c) for c in cols],
                         (words if words is not None else n("array<string>")).alias("words"))

    return (
        make(t.supplier, "s", "s_suppkey", "node", type=F.when(F.col("s_suppkey") % 3 == 0, "Dataset").otherwise("Method"), name=F.upper("s_name"))
        .unionByName(make(t.supplier, "e", "s_suppkey", "edge", relation=F.lit("TRAINED_ON"), source=F.col("s_name"), target=F.concat(F.lit("NATION_"), (F.col("s_nationkey") + F.col("s_suppkey") % 2).cast("string"))))
        .unionByName(make(t.part, "p", "p_partkey", "measurement", table=F.col("p_brand"), row=F.col("p_name"), metric=F.lit("price"), value=F.when(F.col("p_partkey") % 5 == 0, "0.1").otherwise(F.col("p_partkey").cast("string"))))
        .unionByName(make(t.benchmark, "b", "item_id", "finding", finding_kind=F.lit("result"), words=F.array(F.when(F.col("item_id") % 2 == 0, F.lower(F.regexp_extract("text", "^[A-Za-z]+", 0))).otherwise("no such words"))))
    )


query(
    "graph_checks",
    "J7 J10",
    """SELECT concat('s', s_suppkey) AS check_id, 'node' AS kind, s_suppkey % 3 <> 0 AS represented, s_suppkey % 3 <> 0 AND s_acctbal >= 0 AS source_linked FROM supplier
UNION ALL SELECT concat('e', s_suppkey), 'edge', s_suppkey % 2 = 0, s_suppkey % 2 = 0 AND s_acctbal >= 0 FROM supplier
UNION ALL SELECT concat('p', p_partkey), 'measurement', p_partkey % 5 <> 0, p_partkey % 5 <> 0 FROM part UNION ALL SELECT concat('b', item_id), 'finding', item_id % 2 = 0, item_id % 2 = 0 FROM benchmark""",
)(
    lambda t: (lambda bad: E.graph_checks(checks(t), check_nodes(t), check_edges(t), check_nodes(t).join(bad, "id", "left_anti"), check_edges(t).join(bad.withColumnRenamed("id", "source"), "source", "left_anti")))(
        t.supplier.where("s_acctbal < 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id")))
)
query(
    "references_retrieved",
    "J8",
    f"""WITH {D_QUERIES}, e AS (SELECT index_id, min(vec_id) AS lo FROM v GROUP BY index_id) SELECT h.index_id AS question_id, channel AS mode, bool_or(vec_id = lo) AS expected_source_found FROM hits h JOIN e USING (index_id) GROUP BY ALL""",
)(lambda t: E.references_retrieved(ends(t).select(F.col("case_id").alias("question_id"), F.array(F.col("lo").cast("string")).alias("expected_refs")), hits(t).select(F.col("query_id").alias("question_id"), F.col("channel").alias("mode"), F.col("chunk_id").alias("ref"))))
query(
    "group_coverage",
    "J9",
    """WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders), c AS (SELECT o_custkey AS case_id, bool_and(o_orderstatus <> 'P' OR o_orderkey % 2 = 0) AS ok,
  bool_and(o_orderkey % 3 <> 0) AS a, bool_and(o_orderkey % 3 = 1) AS d FROM r GROUP BY o_custkey)
SELECT case_id, CASE WHEN ok THEN 'checked' ELSE 'outside_selected_source_scope' END AS status, CASE WHEN ok THEN a END AS all_groups_retrieved, CASE WHEN ok THEN d END AS all_groups_in_direct_sources FROM c""",
)(
    lambda t: E.group_coverage(
        t.orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("group_no"), F.col("o_orderkey").alias("ref")),
        t.orders.where("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("ref"), (F.col("o_orderkey") % 3 == 1).alias("direct")),
        t.orders.where("o_orderstatus <> 'P' OR o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("ref")))
)
query(
    "edge_regression",
    "J10 H14",
    """SELECT s_suppkey AS check_id, 'expected' AS kind, s_suppkey % 2 = 0 AS passed FROM supplier UNION ALL SELECT s_suppkey, 'forbidden', s_suppkey % 3 <> 0 FROM supplier""",
)(
    lambda t: E.edge_regression(
        t.supplier.select(F.col("s_suppkey").alias("check_id"), F.lit("TRAINED_ON").alias("relation"), F.col("s_name").alias("source"), F.col("s_nationkey").cast("string").alias("target"), F.array(F.lit("#/texts/1")).alias("refs")),
        t.supplier.select(F.col("s_suppkey").alias("check_id"), F.when(F.col("s_suppkey") % 3 == 0, "TRAINED_ON").otherwise("BUILT_ON").alias("relation"), F.col("s_name").alias("source"), F.col("s_nationkey").cast("string").alias("target")),
        t.supplier.select(F.lit("TRAINED_ON").alias("label"), F.upper("s_name").alias("source_name"), F.col("s_nationkey").cast("string").alias("target_name"), F.array(F.when(F.col("s_suppkey") % 2 == 0, "#/texts/1").otherwise("#/texts/2")).alias("refs")))
)
query(
    "chunk_contract",
    "J11 D13",
    """WITH d AS (SELECT source AS document_id, doc_id, md5(text) AS chunk_id, n_chars, 1 + doc_id % 40 AS page_no FROM documents)
SELECT document_id, 'duplicate_chunk_id' AS rule, chunk_id AS item FROM d GROUP BY document_id, chunk_id HAVING count(*) > 1
UNION ALL SELECT document_id, 'too_many_tokens', chunk_id FROM d WHERE n_chars > 5000
UNION ALL SELECT document_id, 'page_not_covered', p::VARCHAR FROM (SELECT DISTINCT document_id, unnest(range(1, 42)) AS p FROM d) x WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.document_id = x.document_id AND d.page_no = x.p)
UNION ALL SELECT document_id, 'caption_not_covered', doc_id::VARCHAR FROM d WHERE doc_id % 9 = 0""",
)(
    lambda t: (lambda d: E.chunk_contract(
        d.select("document_id", "chunk_id", F.col("n_chars").alias("tokens"), F.array("page_no").alias("pages"), F.when(F.col("doc_id") % 9 == 0, F.array().cast("array<bigint>")).otherwise(F.array("doc_id")).alias("refs"), "text"),
        d.select("document_id").distinct().select("document_id", F.explode(F.sequence(F.lit(1), F.lit(41))).alias("page_no")), d.select("document_id", F.col("doc_id").alias("ref")), 5000))(
        t.documents.select(F.col("source").alias("document_id"), "doc_id", F.md5("text").alias("chunk_id"), "n_chars", (1 + F.col("doc_id") % 40).alias("page_no"), "text"))
)
