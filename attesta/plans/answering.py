"""Sanitizing, answer validation and citations over conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import answers as A
from attesta.plans import duck, query

# An answer per turn: claim 0 quotes its own source, claim 1 quotes it under another
# source, claim 2 (every fourth conversation) cites a source that was never supplied.
ANSWERS = """SELECT conv_id * 1000 + turn AS answer_id, conv_id, turn, text, substring(text, 1, 40) AS q0, substring(text, 5, 30) AS q1,
  CASE conv_id % 5 WHEN 0 THEN 'answered' WHEN 1 THEN 'partial' WHEN 2 THEN 'insufficient_evidence' WHEN 3 THEN 'maybe' ELSE 'answered' END AS status,
  CASE WHEN conv_id % 2 = 0 THEN '' ELSE 'gap' END AS missing FROM {conversations}"""


def base(t):
    return t.sql(ANSWERS)


def answers(t):
    claim = lambda text, sid, quote: F.struct(
        F.lit(text).alias("text"), F.array(F.struct(F.lit(sid).alias("source_id"), F.col(quote).alias("quote"))).alias("evidence"))
    claims = F.concat(
        F.array(claim("first", "S1", "q0"), claim("second", "S2", "q1")),
        F.when(F.col("conv_id") % 4 == 0, F.array(claim("third", "S9", "q0"))).otherwise(F.array().cast("array<struct<text:string,evidence:array<struct<source_id:string,quote:string>>>>")))
    body = F.to_json(F.struct(F.when(F.col("conv_id") % 7 != 0, F.col("status")).alias("status"), claims.alias("claims"), F.col("missing").alias("missing_information")))
    fenced = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("conv_id") % 11 == 0, F.concat(body, F.lit("}"))).otherwise(body)
    return base(t).select("answer_id", fenced.alias("content"))


def sources(t):
    b = base(t)
    own = b.select("answer_id", F.lit("S1").alias("source_id"), "text")
    opening = b.where("turn = 0").select("conv_id", F.col("text").alias("text"))
    return own.unionByName(b.select("answer_id", "conv_id").join(opening, "conv_id").select("answer_id", F.lit("S2").alias("source_id"), "text"))


SQ = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
ST = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
D_ANS = f"""a AS ({duck(ANSWERS)}),
o AS (SELECT conv_id, text AS opening FROM a WHERE turn = 0),
b AS (SELECT a.*, o.opening, conv_id % 3 <> 0 AND conv_id % 11 = 0 AS broken, conv_id % 7 = 0 AS no_status, conv_id % 4 = 0 AS third,
  length({ST.format('q0')}) >= 16 AS ok0, length({ST.format('q1')}) >= 16 AS ok1 FROM a LEFT JOIN o USING (conv_id)),
sch AS (SELECT answer_id, 'response' AS path, 'invalid_json' AS hint FROM b WHERE broken
  UNION ALL SELECT answer_id, 'status', 'missing_field' FROM b WHERE NOT broken AND no_status
  UNION ALL SELECT answer_id, 'status', 'unknown_value' FROM b WHERE NOT broken AND NOT no_status AND status = 'maybe'
  UNION ALL SELECT answer_id, 'claims.0.evidence.0', 'invalid_quote_object' FROM b WHERE NOT broken AND NOT ok0
  UNION ALL SELECT answer_id, 'claims.1.evidence.0', 'invalid_quote_object' FROM b WHERE NOT broken AND NOT ok1
  UNION ALL SELECT answer_id, 'claims.2.evidence.0', 'invalid_quote_object' FROM b WHERE NOT broken AND third AND NOT ok0),
st AS (SELECT answer_id FROM b WHERE NOT broken AND answer_id NOT IN (SELECT answer_id FROM sch)
  AND (status = 'insufficient_evidence' OR (status = 'partial') <> (missing <> ''))),
qi AS (SELECT answer_id, CASE WHEN opening IS NULL THEN 'unknown_source' ELSE 'quote_mismatch' END AS kind, 'claims.1.evidence.0' AS path, 1 AS claim_index,
    CASE WHEN opening IS NULL THEN 'use_supplied_source_ids' WHEN contains(q1, '...') OR contains(q1, '…') THEN 'split_ellipsis' ELSE 'copy_verbatim' END AS hint
  FROM b WHERE NOT broken AND ok1 AND (opening IS NULL OR NOT contains({SQ.format('opening')}, {SQ.format('q1')}))
  UNION ALL SELECT answer_id, 'unknown_source', 'claims.2.evidence.0', 2, 'use_supplied_source_ids' FROM b WHERE NOT broken AND third AND ok0),
iss AS (SELECT answer_id, 'schema' AS kind, path, NULL::INT AS claim_index, hint FROM sch UNION ALL SELECT answer_id, 'answer_state', 'status', NULL, '' FROM st UNION ALL SELECT * FROM qi)"""

query("parse_answers", "G3", f"WITH {D_ANS} SELECT answer_id, CASE WHEN broken THEN -1 WHEN third THEN 3 ELSE 2 END AS claims FROM b")(
    lambda t: A.parse_answers(answers(t)).select("answer_id", F.coalesce(F.size("answer.claims"), F.lit(-1)).alias("claims")))

query("answer_issues", "G4", f"WITH {D_ANS} SELECT * FROM iss")(lambda t: A.answer_issues(answers(t), sources(t)))

query(
    "retain_cited_claims",
    "G5",
    f"""WITH {D_ANS}, per AS (SELECT answer_id, bool_and(kind IN ('quote_mismatch', 'unknown_source')) AS ok, bool_or(claim_index = 1) AS w1, bool_or(claim_index = 2) AS w2 FROM iss GROUP BY answer_id)
SELECT answer_id, 'partial' AS status, concat_ws(',', 'first', CASE WHEN NOT coalesce(w1, false) THEN 'second' END, CASE WHEN third AND NOT coalesce(w2, false) THEN 'third' END) AS claims,
  CASE WHEN third THEN 3 ELSE 2 END AS original_claims FROM per JOIN b USING (answer_id) WHERE ok""",
)(lambda t: A.retain_cited_claims(answers(t), sources(t)).select("answer_id", "status", F.array_join("claims", ",").alias("claims"), "original_claims"))

query(
    "restore_status",
    "G6",
    f"WITH {D_ANS} SELECT answer_id, CASE WHEN missing <> '' THEN 'partial' ELSE 'answered' END AS status FROM b WHERE NOT broken AND no_status AND ok0 AND ok1",
)(lambda t: A.restore_status(answers(t)))


def plain(t):
    marks = F.when(F.col("conv_id") % 6 == 0, "INSUFFICIENT_EVIDENCE").when(F.col("conv_id") % 6 == 1, F.concat("text", F.lit(" [S1][S2]"))).when(
        F.col("conv_id") % 6 == 2, F.concat("text", F.lit(" [S7] [S1]"))).when(F.col("conv_id") % 6 == 3, F.concat(F.lit("[S1] "), "text")).otherwise(F.col("text"))
    return base(t).select("answer_id", marks.alias("answer"))


query(
    "bracket_citations",
    "G7",
    f"""WITH {D_ANS} SELECT answer_id, CASE conv_id % 6 WHEN 0 THEN 'insufficient_evidence' WHEN 1 THEN CASE WHEN opening IS NULL THEN 'citation_check_failed' ELSE 'model_answer_with_resolvable_citations_not_independent_verification' END
  WHEN 3 THEN 'model_answer_with_resolvable_citations_not_independent_verification' ELSE 'citation_check_failed' END AS answer_status FROM b""",
)(lambda t: A.bracket_citations(plain(t), sources(t)).select("answer_id", "answer_status"))


def record_answers(t):
    return base(t).select("answer_id", F.concat(F.lit("See [Data: Entities ("), F.col("conv_id").cast("string"), F.lit(", 999999); Sources ("), F.col("turn").cast("string"), F.lit(")] and "), "text").alias("answer"))


def record_context(t):
    b = base(t)
    none = lambda k: F.lit(None).cast(k)
    row = lambda cat, cid: b.select("answer_id", F.lit(cat).alias("category"), F.col(cid).cast("string").alias("citation_id"), (F.col("conv_id") % 2 == 0).alias("resolved"),
                                    none("array<string>").alias("refs"), none("array<int>").alias("pages"))
    return row("entities", "conv_id").unionByName(row("sources", "turn"))


query(
    "record_citations",
    "G8",
    f"""WITH {D_ANS} SELECT answer_id, 'entities' AS category, conv_id::VARCHAR AS citation_id, conv_id % 2 = 0 AS resolved FROM b
UNION ALL SELECT answer_id, 'entities', '999999', false FROM b UNION ALL SELECT answer_id, 'sources', turn::VARCHAR, conv_id % 2 = 0 FROM b""",
)(lambda t: A.record_citations(record_answers(t), record_context(t)).select("answer_id", "category", "citation_id", "resolved"))

query("citations_resolved", "G8", "SELECT conv_id * 1000 + turn AS answer_id, false AS all_cited_records_resolved FROM conversations")(
    lambda t: A.citations_resolved(record_answers(t), A.record_citations(record_answers(t), record_context(t))))

# Chunks of the corpus, some carrying a generated description or an altered formula.
DIRTY = """SELECT source AS document_id, concat('c', CAST(doc_id AS STRING)) AS chunk_id, doc_id, substring(text, 1, 24) AS lead, concat('d', CAST(doc_id AS STRING)) AS tail, text FROM {documents}"""


def dirty_chunks(t):
    d = t.sql(DIRTY)
    k = F.col("doc_id")
    body = F.concat_ws(" ", "text", F.when(k % 4 == 1, F.concat(F.lit("GENERATED "), "tail")), F.when(k % 5 == 2, F.concat(F.lit("x^2="), "tail")))
    link = F.when(k % 12 == 5, F.array()).otherwise(F.array(F.struct(F.concat(F.lit("#/pictures/"), k.cast("string")).alias("picture_ref"), F.lit(True).alias("ai_description_included"))))
    none_links = F.array().cast("array<struct<picture_ref:string,ai_description_included:boolean>>")
    return d.select("document_id", "chunk_id", body.alias("contextualized_text"),
                    F.when(k % 4 == 1, F.array(F.lit("extracted_document"), F.lit("ai_description"))).otherwise(F.array(F.lit("extracted_document"))).alias("text_sources"),
                    F.when(k % 4 == 1, link).otherwise(none_links).alias("picture_links"),
                    F.array(F.concat(F.lit("#/pictures/"), k.cast("string")), F.concat(F.lit("#/texts/"), k.cast("string"))).alias("source_refs"))


def cleaned(t):
    d = t.sql(DIRTY)
    k = F.col("doc_id")
    pictures = d.select("document_id", F.concat(F.lit("#/pictures/"), k.cast("string")).alias("picture_ref"),
                        F.when(k % 8 == 1, F.lit("")).otherwise(F.concat(F.lit("GENERATED "), "tail")).alias("description"))
    formulas = d.where(k % 5 == 2).select("document_id", F.concat(F.lit("#/texts/"), k.cast("string")).alias("ref"), F.concat(F.lit(" x2 "), "tail").alias("orig"),
                                         F.concat(F.when(k % 10 == 2, "x^2=").otherwise("y^2="), "tail").alias("text"))
    return A.sanitize_chunks(dirty_chunks(t), pictures, formulas)


D_CLEAN = f"""dd AS ({duck(DIRTY).replace('STRING', 'VARCHAR')}),
cl AS (SELECT *, CASE WHEN doc_id % 5 = 2 AND doc_id % 10 <> 2 THEN 'formula_span_unavailable' WHEN doc_id % 12 = 5 THEN 'ai_content_not_isolable'
   WHEN doc_id % 8 = 1 THEN 'description_span_unavailable' END AS excluded,
  (CASE WHEN doc_id % 4 = 1 AND doc_id % 12 <> 5 AND doc_id % 8 <> 1 THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 10 = 2 THEN 1 ELSE 0 END) AS changes FROM dd)"""

query(
    "sanitize_chunks",
    "G1 D11",
    f"WITH {D_CLEAN} SELECT document_id, chunk_id, coalesce(excluded, '') AS excluded, CASE WHEN excluded IS NULL THEN changes END AS changes FROM cl",
)(
    lambda t: cleaned(t).select("document_id", "chunk_id", F.coalesce("excluded", F.lit("")).alias("excluded"),
                                F.when(F.col("excluded").isNull(), F.size("transformations")).alias("changes"))
)

HITS = """SELECT concat('q', source) AS question_id, source AS document_id, concat('c', CAST(doc_id AS STRING)) AS chunk_id, n_chars AS rank FROM {documents}"""

query(
    "prepared_sources",
    "G1",
    f"""WITH {D_CLEAN}, h AS ({duck(HITS).replace('STRING', 'VARCHAR')}) SELECT question_id, h.chunk_id,
  concat('S', (row_number() OVER (PARTITION BY question_id ORDER BY rank, h.chunk_id))::VARCHAR) AS source_id FROM h JOIN cl ON cl.document_id = h.document_id AND cl.chunk_id = h.chunk_id WHERE excluded IS NULL""",
)(lambda t: A.prepare_sources(t.sql(HITS), cleaned(t)).select("question_id", "chunk_id", "source_id"))

query(
    "excluded_hits",
    "G1",
    f"""WITH {D_CLEAN}, h AS ({duck(HITS).replace('STRING', 'VARCHAR')}) SELECT question_id, h.chunk_id, rank AS retrieval_rank, excluded AS reason FROM h JOIN cl ON cl.document_id = h.document_id AND cl.chunk_id = h.chunk_id WHERE excluded IS NOT NULL""",
)(lambda t: A.excluded_hits(t.sql(HITS), cleaned(t)))


def question_sources(t):
    b = t.conversations
    return b.select(F.col("conv_id").alias("question_id"), F.col("turn").alias("place"), F.concat(F.lit("S"), (F.col("turn") + 1).cast("string")).alias("source_id"),
                    F.array((F.col("turn") + 1).cast("int")).alias("pages"), F.array("role").alias("headings"), F.repeat("text", 40).alias("text"))


query(
    "prompt_payloads",
    "G2",
    """SELECT conv_id AS question_id, sum(length(repeat(replace(replace(text, chr(92), '\\\\'), chr(10), '\\n'), 40)) + length(concat('{"source_id":"S', (turn + 1)::VARCHAR, '","pages":[', (turn + 1)::VARCHAR, '],"text":""}')))
   + count(*) - 1 + length('{"question":"q","sources":[]}') <= 65000 AS within_budget FROM conversations GROUP BY conv_id""",
)(
    lambda t: A.prompt_payloads(t.conversations.select(F.col("conv_id").alias("question_id"), F.lit("q").alias("question")).distinct(), question_sources(t))
    .select("question_id", "within_budget")
)

query(
    "lexical_prompts",
    "G2",
    """SELECT conv_id AS question_id, md5(substr(string_agg(concat('[S', (turn + 1)::VARCHAR, '] PDF pages [', (turn + 1)::VARCHAR, '] | ', role, chr(10), repeat(text, 40)), chr(10) || chr(10) ORDER BY turn), 1, 28000)) AS evidence
FROM conversations GROUP BY conv_id""",
)(lambda t: A.lexical_prompts(question_sources(t)).withColumn("evidence", F.md5("evidence")))
