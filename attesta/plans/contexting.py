"""Contextual chunks over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions.stage import stage
from attesta.operators import contextual as K
from attesta.operators import preparation as P
from attesta.plans import query
from attesta.plans.preparing import D_CRUMB, PIECE, headed

BUDGET = 240


def items(t):
    return stage(P.breadcrumbs(headed(t)).withColumn("pages", F.array((1 + F.col("pos") % 40).cast("int"))))


def chunks(t):
    return stage(K.contextual_chunks(items(t), BUDGET))


# Oracle: cut every item to its room, number the parts, then pack them one after the other.
D_CHUNKS = f"""{D_CRUMB},
ix AS (SELECT document_id, pos, item_ref, label, replace(headings, ' > ', chr(10)) AS path, regexp_extract_all(text, {PIECE}) AS tok FROM cr WHERE label NOT IN ('page_header', 'section_header') AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
sz AS (SELECT *, len(regexp_extract_all(path, {PIECE})) AS ov FROM ix),
pc AS (SELECT *, greatest(1, {BUDGET} - ov) AS room, unnest(range(0, len(tok), greatest(1, {BUDGET} - ov))) AS st FROM sz),
pn AS (SELECT *, least(room, len(tok) - st) AS cost, array_to_string(tok[st + 1 : st + room], '') AS body, row_number() OVER (PARTITION BY document_id ORDER BY pos, st) - 1 AS n FROM pc),
pq AS (SELECT a.document_id, a.n, a.item_ref, a.path, a.ov, a.cost, a.st, a.body, a.pos, b.n IS NULL OR a.path <> b.path AS cut FROM pn a LEFT JOIN pn b ON b.document_id = a.document_id AND b.n = a.n - 1),
fd AS (SELECT document_id, n, ov + cost AS used, 0 AS g FROM pq WHERE n = 0
  UNION ALL SELECT pq.document_id, pq.n, CASE WHEN pq.cut OR fd.used + pq.cost > {BUDGET} THEN pq.ov + pq.cost ELSE fd.used + pq.cost END, CASE WHEN pq.cut OR fd.used + pq.cost > {BUDGET} THEN fd.g + 1 ELSE fd.g END
  FROM fd JOIN pq ON pq.document_id = fd.document_id AND pq.n = fd.n + 1)"""

query(
    "contextual_chunks",
    "D9 D10",
    f"""WITH RECURSIVE {D_CHUNKS}, j AS (SELECT fd.document_id, g, fd.n, path, item_ref, CASE WHEN st = 0 AND fd.n <> min(fd.n) OVER (PARTITION BY fd.document_id, g) THEN concat(chr(10), body) ELSE body END AS body FROM fd JOIN pq ON pq.document_id = fd.document_id AND pq.n = fd.n)
SELECT document_id, concat(document_id, '-', lpad(g::VARCHAR, 5, '0')) AS chunk_id, md5(concat(CASE WHEN any_value(path) <> '' THEN concat(any_value(path), chr(10)) ELSE '' END, string_agg(body, '' ORDER BY n))) AS contextualized_text, count(DISTINCT item_ref)::INT AS items FROM j GROUP BY document_id, g""",
)(lambda t: chunks(t).select("document_id", "chunk_id", F.md5("contextualized_text").alias("contextualized_text"), F.size("source_refs").alias("items")))


def links(t):
    h = headed(t).where("label = 'picture'")
    k = F.col("pos")
    pictures = h.select("document_id", F.col("item_ref").alias("picture_ref"), F.array((1 + k % 40).cast("int")).alias("pages"), F.when(k % 3 != 0, F.col("text")).alias("description"), F.lit("m").alias("created_by"),
                        F.when(k % 5 == 0, "failed").alias("status"), (k % 7 == 0).alias("hit_token_cap"), F.lit(None).cast("boolean").alias("reached_time_budget"))
    captions = h.where("pos % 2 = 0").select("document_id", F.col("item_ref").alias("picture_ref"), F.concat(F.lit("#/texts/"), (k - 20).cast("string")).alias("item_ref"), k.alias("pos"), F.lit("caption").alias("text"))
    return K.picture_links(pictures, captions, include_descriptions=True)


D_LINK = f"""{D_CRUMB}, lk AS (SELECT document_id, pos, item_ref AS picture_ref, pos % 2 = 0 AS cap, pos % 3 <> 0 AS des, pos % 2 <> 0 AND pos % 3 <> 0 AND pos % 5 <> 0 AND pos % 7 <> 0 AS inc FROM it WHERE label = 'picture')"""
query("picture_links", "D11", f"WITH {D_LINK} SELECT document_id, picture_ref, CASE WHEN cap THEN 'extracted_caption' WHEN des THEN 'ai_description' ELSE 'missing' END AS description_source, inc AS ai_description_included FROM lk")(
    lambda t: links(t).select("document_id", "picture_ref", "description_source", "ai_description_included"))
query("excluded_descriptions", "D11", f"WITH {D_LINK} SELECT document_id, picture_ref FROM lk WHERE des AND NOT inc")(lambda t: K.excluded_descriptions(links(t)))
query(
    "formula_texts",
    "D12",
    "SELECT doc_id, md5(CASE WHEN doc_id % 4 IN (1, 2) THEN text ELSE concat(text, '!') END) AS selected_text, doc_id % 4 <> 2 AS is_candidate FROM documents WHERE n_chars > 0".replace("doc_id % 4 IN (1, 2)", "doc_id % 4 = 1 OR doc_id % 4 = 2"),
)(
    lambda t: K.formula_texts(t.documents.select(F.lit("d").alias("document_id"), F.col("doc_id").alias("item_ref"), F.when(F.col("doc_id") % 4 == 2, F.col("text")).when(F.col("doc_id") % 4 == 1, F.col("text")).otherwise(F.concat("text", F.lit("!"))).alias("orig"),
                                               F.when(F.col("doc_id") % 4 == 1, F.lit("")).when(F.col("doc_id") % 4 == 3, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text")), "original").select(F.col("item_ref").alias("doc_id"), F.md5("selected_text").alias("selected_text"), "is_candidate")
)
query(
    "chunk_text_sources",
    "D10",
    f"""WITH RECURSIVE {D_CHUNKS}, lk AS (SELECT document_id, pos, item_ref AS picture_ref, pos % 2 <> 0 AND pos % 3 <> 0 AND pos % 5 <> 0 AND pos % 7 <> 0 AS inc FROM it WHERE label = 'picture'),
j AS (SELECT fd.document_id, g, pq.item_ref, ix.label, coalesce(lk.inc, false) AS inc FROM fd JOIN pq ON pq.document_id = fd.document_id AND pq.n = fd.n JOIN ix ON ix.document_id = fd.document_id AND ix.item_ref = pq.item_ref LEFT JOIN lk ON lk.document_id = fd.document_id AND lk.picture_ref = pq.item_ref)
SELECT document_id, concat(document_id, '-', lpad(g::VARCHAR, 5, '0')) AS chunk_id, concat_ws(',', CASE WHEN bool_or(label <> 'picture') OR NOT bool_or(inc) THEN 'extracted_document' END, CASE WHEN bool_or(inc) THEN 'ai_description' END) AS text_sources FROM j GROUP BY document_id, g""",
)(lambda t: K.with_picture_links(chunks(t), links(t)).select("document_id", "chunk_id", F.array_join("text_sources", ",").alias("text_sources")))
query(
    "chunk_violations",
    "D13",
    f"WITH {D_CRUMB} SELECT DISTINCT document_id, concat('x', document_id) AS document FROM it",
)(lambda t: K.chunk_violations(chunks(t), items(t).withColumn("document_id", F.concat(F.lit("x"), "document_id")), 10_000).where("reason = 'no_chunks_produced'").select(F.substring("document_id", 2, 99).alias("document_id"), F.col("document_id").alias("document")))
query(
    "uncovered_items",
    "D13",
    f"WITH {D_CRUMB} SELECT document_id, label AS kind, item_ref AS ref FROM cr WHERE label IN ('page_header', 'section_header') OR trim(regexp_replace(text, '\\s+', ' ', 'g')) = ''",
)(lambda t: K.uncovered(chunks(t), items(t).select("document_id", F.col("label").alias("kind"), F.col("item_ref").alias("ref"))))
query(
    "chunk_report",
    "D13",
    f"WITH RECURSIVE {D_CHUNKS} SELECT document_id, (max(g) + 1)::BIGINT AS chunks, 'ready_for_embedding_review' AS status FROM fd GROUP BY document_id",
)(lambda t: K.chunk_report(chunks(t), K.chunk_violations(chunks(t), items(t), 10_000)).select("document_id", "chunks", "status"))
