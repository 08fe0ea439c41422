"""Record preparation over the corpus and the derived result grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions.stage import stage
from attesta.operators import preparation as P
from attesta.plans import duck, fixtures as fx, query
from attesta.plans.evidence import D_CELLS, D_ITEMS, D_TEXT, cells, text_items

# Headings: three levels, one of them the bibliography.
HEADED = """SELECT source AS document_id, doc_id AS pos, concat('#/texts/', CAST(doc_id AS STRING)) AS item_ref,
  CASE WHEN (doc_id DIV 20) % 5 = 0 THEN 'section_header' WHEN (doc_id DIV 20) % 10 = 3 THEN 'page_header' WHEN (doc_id DIV 20) % 10 = 7 THEN 'formula'
    WHEN (doc_id DIV 20) % 10 = 8 THEN 'caption' WHEN (doc_id DIV 20) % 10 = 9 THEN 'picture' ELSE 'text' END AS label,
  CAST(1 + (doc_id DIV 100) % 3 AS INT) AS level,
  CASE WHEN (doc_id DIV 20) % 5 = 0 THEN CASE WHEN (doc_id DIV 100) % 7 = 5 THEN '9. References' ELSE concat('Heading ', CAST(doc_id AS STRING)) END
    WHEN (doc_id DIV 20) % 20 = 7 THEN ' ' ELSE text END AS text
FROM {documents}"""
D_HEADED = duck(HEADED).replace("DIV", "//").replace("STRING", "VARCHAR")


def headed(t):
    return t.sql(HEADED)


def captions(t):
    """Each caption belongs to the picture that follows it."""
    rows = headed(t).where("label = 'caption'")
    return rows.select("document_id", F.concat(F.lit("#/texts/"), (F.col("pos") + 20).cast("string")).alias("owner_ref"), "item_ref", "pos")


D_CRUMB = f"""it AS ({D_HEADED}),
lv AS (SELECT *, {', '.join(f"max(CASE WHEN label = 'section_header' AND level = {n} THEN pos END) OVER w AS p{n}, arg_max(CASE WHEN label = 'section_header' AND level = {n} THEN trim(text) END, CASE WHEN label = 'section_header' AND level = {n} THEN pos END) OVER w AS t{n}" for n in (1, 2, 3))}
  FROM it WINDOW w AS (PARTITION BY document_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
cr AS (SELECT *, concat_ws(' > ', t1, CASE WHEN p1 IS NULL OR p1 < p2 THEN t2 END, CASE WHEN (p1 IS NULL OR p1 < p3) AND (p2 IS NULL OR p2 < p3) THEN t3 END) AS headings FROM lv)"""

query("breadcrumbs", "D14", f"WITH {D_CRUMB} SELECT document_id, pos, headings FROM cr")(
    lambda t: P.breadcrumbs(headed(t)).select("document_id", "pos", F.array_join("headings", " > ").alias("headings")))

D_STATUS = f"""{D_CRUMB},
cap AS (SELECT document_id, item_ref, concat('#/texts/', (pos + 20)::VARCHAR) AS owner_ref FROM it WHERE label = 'caption'),
st AS (SELECT cr.*, CASE WHEN label = 'section_header' THEN 'context' WHEN label = 'page_header' OR contains(headings, 'References') THEN 'excluded' WHEN label = 'caption' THEN 'attached'
    WHEN label <> 'picture' AND trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'unresolved' ELSE 'included' END AS status,
  CASE WHEN label = 'section_header' THEN 'heading_breadcrumb' WHEN label = 'page_header' OR contains(headings, 'References') THEN CASE WHEN contains(headings, 'References') THEN 'bibliography' ELSE label END
    WHEN label = 'caption' THEN 'attached_to_owner' WHEN label <> 'picture' AND trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN CASE WHEN label = 'formula' THEN 'empty_original_formula' ELSE 'empty_source_text' END
    ELSE 'serialized_source_content' END AS reason FROM cr)"""


def status(t):
    return stage(P.item_status(headed(t), captions(t)))


query("item_status", "D12 D15 D16", f"WITH {D_STATUS} SELECT document_id, item_ref, status, reason FROM st")(
    lambda t: status(t).select("document_id", "item_ref", "status", "reason"))

D_ACC = f"""{D_STATUS},
acc AS (SELECT st.document_id, st.item_ref, st.label, CASE WHEN st.status = 'attached' THEN CASE WHEN o.item_ref IS NOT NULL THEN 'included' ELSE 'unresolved' END ELSE st.status END AS status,
  CASE WHEN st.status = 'attached' THEN CASE WHEN o.item_ref IS NOT NULL THEN 'serialized_source_content' ELSE 'caption_owner_not_serialized' END ELSE st.reason END AS reason
  FROM st LEFT JOIN cap ON cap.document_id = st.document_id AND cap.item_ref = st.item_ref
  LEFT JOIN (SELECT document_id, item_ref FROM st WHERE label = 'picture' AND status = 'included') o ON o.document_id = cap.document_id AND o.item_ref = cap.owner_ref)"""


def accounted(t):
    made = status(t).where("label = 'picture' AND status = 'included'")
    return P.accounting(status(t), captions(t), made)


query("item_accounting", "D19", f"WITH {D_ACC} SELECT * FROM acc")(accounted)
query("status_counts", "D19", f"WITH {D_ACC} SELECT document_id, status, count(*) AS items FROM acc GROUP BY ALL")(lambda t: P.status_counts(accounted(t)))
query(
    "unresolved_captions",
    "D16",
    f"WITH {D_STATUS} SELECT cap.document_id, cap.owner_ref FROM cap WHERE NOT EXISTS (SELECT 1 FROM it WHERE it.document_id = cap.document_id AND it.item_ref = cap.owner_ref)",
)(lambda t: P.unresolved_captions(headed(t), captions(t).select("document_id", F.col("owner_ref").alias("item_ref"))).select("document_id", F.col("item_ref").alias("owner_ref")))
query(
    "prose_records",
    "D15",
    f"""WITH {D_STATUS} SELECT document_id, item_ref, md5(concat(CASE WHEN headings = '' THEN '' ELSE concat('# ', replace(headings, ' > ', concat(chr(10), chr(10), '# ')), chr(10), chr(10)) END, text)) AS record_text
FROM st WHERE status = 'included' AND label <> 'picture'""",
)(lambda t: P.prose_records(status(t)).select("document_id", "item_ref", F.md5("record_text").alias("record_text")))


def grid_captions(t):
    return t.sql(fx.TABLE_ITEMS).where("kind = 'text'").select("document_id", F.replace("item_ref", F.lit("texts"), F.lit("tables")).alias("item_ref"), F.col("text").alias("caption"))


def titles(t):
    return t.part.select(F.col("p_brand").alias("document_id")).distinct().withColumn("title", F.concat(F.lit("Study of "), "document_id"))


D_GCAP = f"gcap AS (SELECT document_id, replace(item_ref, 'texts', 'tables') AS item_ref, text AS caption FROM ({D_ITEMS}) WHERE kind = 'text')"

query(
    "ambiguous_cells",
    "D17 D24",
    f"""SELECT document_id, item_ref, idx FROM ({D_CELLS}) WHERE NOT (column_header OR row_header OR row_section) AND (col_end - col_start > 1 OR len(regexp_extract_all(text, '[0-9]+ [0-9]+')) > 0)""",
)(lambda t: P.ambiguous_cells(cells(t)))
query(
    "table_grid_lines",
    "D17",
    f"""SELECT document_id, item_ref, r AS row, concat('| ', string_agg(text, ' | ' ORDER BY c, idx), ' |') AS line FROM
(SELECT *, unnest(range(col_start, col_end)) AS c FROM (SELECT *, unnest(range(row_start, row_end)) AS r FROM ({D_CELLS}))) GROUP BY ALL""",
)(lambda t: P.table_grid_lines(cells(t)))
query(
    "missing_cells",
    "D17",
    f"""WITH c AS ({D_CELLS}) SELECT document_id, item_ref, idx FROM c WHERE idx % 8 = 1 AND idx > 8""",
)(lambda t: P.missing_cells(cells(t), P.table_grid_lines(cells(t).where("NOT (idx > 8 AND idx % 8 = 1)"))))
query(
    "table_heads",
    "D17",
    f"""WITH {D_GCAP}, c AS ({D_CELLS}), n AS (SELECT document_id, item_ref, count(*) FILTER (WHERE len(regexp_extract_all(text, '^[0-9]+ [0-9]+$')) > 0) AS ambiguous_cells FROM c GROUP BY ALL)
SELECT document_id, item_ref, ambiguous_cells, concat_ws(chr(10) || chr(10), caption, CASE WHEN ambiguous_cells > 0 THEN 'Table extraction warning: some data cells merge columns or multiple numbers. Do not split those values or guess their metric/dataset assignments.' END) AS head FROM n JOIN gcap USING (document_id, item_ref)""",
)(lambda t: P.table_heads(cells(t), grid_captions(t)))


def figure_parts(t):
    h = headed(t)
    pictures = h.where("label = 'picture'").select("document_id", "item_ref", "pos", F.concat(F.lit("gen "), "item_ref").alias("description"))
    caps = captions(t).join(h.select("document_id", "item_ref", "text"), ["document_id", "item_ref"])
    inner = h.where("label = 'text'").select("document_id", F.concat(F.lit("#/texts/"), ((F.expr("pos DIV 200") + 1) * 200 - 20 + F.col("pos") % 20).cast("string")).alias("owner_ref"), "item_ref", "pos", "text")
    return pictures, caps, inner


query(
    "picture_records",
    "D18",
    f"""WITH {D_STATUS}, pic AS (SELECT document_id, item_ref FROM it WHERE label = 'picture'),
cp AS (SELECT cap.document_id, cap.owner_ref, it.text FROM cap JOIN it USING (document_id, item_ref) WHERE trim(it.text) <> ''),
lb AS (SELECT document_id, concat('#/texts/', ((pos // 200 + 1) * 200 - 20 + pos % 20)::VARCHAR) AS owner_ref, string_agg(text, chr(10) ORDER BY pos) AS labels FROM it WHERE label = 'text' AND trim(text) <> '' GROUP BY ALL)
SELECT pic.document_id, pic.item_ref, md5(concat(coalesce(cp.text, ''), CASE WHEN labels IS NOT NULL THEN concat(chr(10), chr(10), 'Text extracted inside this figure (diagram labels, not prose):', chr(10), labels) ELSE '' END,
  chr(10), chr(10), 'AI-generated description (unverified):', chr(10), 'gen ', pic.item_ref)) AS content
FROM pic LEFT JOIN cp ON cp.document_id = pic.document_id AND cp.owner_ref = pic.item_ref LEFT JOIN lb ON lb.document_id = pic.document_id AND lb.owner_ref = pic.item_ref""",
)(lambda t: P.picture_records(*figure_parts(t), include_descriptions=True).select("document_id", "item_ref", F.md5("content").alias("content")))


def row_lines(t):
    return P.table_rows(cells(t), grid_captions(t), titles(t), t.sql(fx.TABLES))


D_ROWS = f"""{D_GCAP}, c AS ({D_CELLS}),
d AS (SELECT * FROM c WHERE NOT column_header),
sec AS (SELECT document_id, item_ref, row_start, text FROM d WHERE row_section),
ln AS (SELECT d.document_id, d.item_ref, d.row_start AS row, d.idx, d.text,
   concat(CASE WHEN col_end - col_start > 1 THEN 'Unresolved merged cell; do not assign individual metrics' ELSE 'Cell' END, ' [',
     CASE col_start WHEN 0 THEN '-' WHEN 1 THEN concat(document_id, ' / Size ↓') WHEN 2 THEN concat(document_id, ' / Price ↑') ELSE 'Codes' END, ']: ', d.text) AS line FROM d WHERE NOT row_section),
rw AS (SELECT ln.document_id, ln.item_ref, ln.row, arg_min(ln.text, ln.idx) AS row_label, string_agg(line, chr(10) ORDER BY ln.idx) AS lines,
   (SELECT arg_max(sec.text, sec.row_start) FROM sec WHERE sec.document_id = ln.document_id AND sec.item_ref = ln.item_ref AND sec.row_start <= ln.row) AS section FROM ln GROUP BY ALL),
rec AS (SELECT rw.document_id, rw.item_ref, row, concat(item_ref, ':row:', row::VARCHAR) AS record_id, concat('Paper title: Study of ', document_id, chr(10), 'Content: Results table; use its caption and row/column headers.', chr(10), chr(10),
  caption, chr(10), 'Table row context: ', coalesce(section, ''), chr(10), 'Row label: ', row_label, chr(10), lines) AS record_text FROM rw JOIN gcap USING (document_id, item_ref))"""

query("table_row_records", "D21", f"WITH {D_ROWS} SELECT * FROM rec")(lambda t: P.row_records(row_lines(t)))
query(
    "table_row_records_split",
    "D21",
    f"""WITH {D_ROWS} SELECT document_id, item_ref, row, count(*) AS parts FROM ln GROUP BY ALL""",
)(lambda t: P.row_records(row_lines(t), limit=10).groupBy("document_id", "item_ref", "row").agg(F.count("*").alias("parts")))
query(
    "table_header_records",
    "D22",
    f"""WITH {D_GCAP} SELECT document_id, item_ref, concat(item_ref, ':headers') AS record_id, concat('Paper title: Study of ', document_id, chr(10), 'Content: Results table; use its caption and row/column headers.', chr(10), chr(10), caption, chr(10),
  'Column headings: -; ', document_id, '; Codes; Size ↓; Price ↑') AS record_text FROM gcap""",
)(lambda t: P.header_records(cells(t), grid_captions(t), titles(t)))
query(
    "omitted_cells",
    "D22",
    f"""WITH c AS ({D_CELLS}), s AS (SELECT c.*, (SELECT min(x.row_start) FROM c x WHERE x.document_id = c.document_id AND x.item_ref = c.item_ref AND NOT x.row_section AND NOT x.column_header AND x.row_start > c.row_start AND x.row_start % 3 <> 0
    AND (SELECT max(y.row_start) FROM c y WHERE y.row_section AND y.document_id = c.document_id AND y.item_ref = c.item_ref AND y.row_start <= x.row_start) = c.row_start) AS used FROM c WHERE NOT column_header)
SELECT document_id, item_ref, idx FROM s WHERE CASE WHEN row_section THEN used IS NULL AND NOT EXISTS (SELECT 1 FROM s o WHERE o.row_section AND o.text = s.text AND o.document_id = s.document_id AND o.item_ref = s.item_ref AND o.used IS NOT NULL) ELSE row_start % 3 = 0 END""",
)(lambda t: P.omitted_cells(cells(t), P.row_records(row_lines(t)).where("row % 3 <> 0"), P.header_records(cells(t), grid_captions(t), titles(t))))
query(
    "alignment_marks",
    "D24",
    f"""WITH {D_ROWS} SELECT record_id, true AS ambiguous, replace(record_text, concat('headers.', chr(10), chr(10)), concat('headers.', chr(10), 'TABLE_METRIC_ALIGNMENT: ambiguous', chr(10), chr(10))) AS record_text
FROM (SELECT record_id, replace(record_text, 'Size ↓', 'Size ↓↑') AS record_text FROM rec)""",
)(lambda t: P.mark_alignment(P.row_records(row_lines(t)).withColumn("record_text", F.replace("record_text", F.lit("Size ↓"), F.lit("Size ↓↑")))).select("record_id", "ambiguous", "record_text"))


def contents(t):
    return t.documents.select(F.col("source").alias("document_id"), F.concat(F.lit("r"), "doc_id").alias("record_id"), F.concat(F.lit("Paper title: "), "source", F.lit("\n\n")).alias("prefix"), F.col("text").alias("content"))


PIECE = "'\\s*[\\p{L}\\p{N}_]+|\\s*[^\\p{L}\\p{N}_\\s]|\\s+'"
query(
    "token_windows",
    "D20",
    f"""WITH t AS (SELECT source, doc_id, regexp_extract_all(text, {PIECE}) AS tok, 200 - len(regexp_extract_all(concat('Paper title: ', source, chr(10), chr(10)), {PIECE})) AS room FROM documents),
s AS (SELECT *, unnest(range(0, len(tok), greatest(1, room - 40))) AS st FROM t)
SELECT source AS document_id, concat('r', doc_id::VARCHAR, ':part:', (st / (room - 40))::BIGINT::VARCHAR) AS record_id, md5(concat('Paper title: ', source, chr(10), chr(10), array_to_string(tok[st + 1 : st + room], ''))) AS record_text
FROM s WHERE st = 0 OR st - (room - 40) + room < len(tok)""",
)(lambda t: P.token_windows(contents(t), budget=200).select("document_id", "record_id", F.md5("record_text").alias("record_text")))
query(
    "max_record_tokens",
    "D22",
    f"SELECT source AS document_id, max(len(regexp_extract_all(text, {PIECE})))::INT AS max_record_tokens FROM documents GROUP BY source",
)(lambda t: P.max_tokens(contents(t).withColumn("record_text", F.col("content"))))


# Islands: short documents under alternating headings.
ISLAND = """SELECT source AS document_id, CAST(doc_id DIV 20 AS BIGINT) AS n, concat('r', CAST(doc_id AS STRING)) AS record_id, (doc_id DIV 20) % 13 <> 0 AS prose, CAST((doc_id DIV 20) DIV 9 AS STRING) AS heading,
  text AS body FROM {documents}"""


def island_records(t):
    return stage(t.sql(ISLAND).withColumn("headings", F.array("heading")).withColumn("prefix", F.lit("Paper title: x\n\n")))


D_ISLAND = f"""r AS (SELECT *, len(regexp_extract_all(body, {PIECE})) AS size FROM ({duck(ISLAND).replace('DIV', '//').replace('STRING', 'VARCHAR')})),
p AS (SELECT r.*, coalesce(NOT r.prose OR NOT q.prose OR r.heading <> q.heading OR least(r.size, q.size) >= 70
   OR (regexp_matches(lower(q.body), '^(where |and )') AND regexp_matches(r.body, '^[A-Z][A-Za-z0-9 /(),-]{{0,55}}\\.\\s+[A-Z]')), true) AS cut FROM r LEFT JOIN r q ON q.document_id = r.document_id AND q.n = r.n - 1),
f AS (SELECT document_id, n, size + 5 AS used, n AS island FROM p WHERE n = 0
  UNION ALL SELECT p.document_id, p.n, CASE WHEN p.cut OR f.used + p.size > 220 THEN p.size + 5 ELSE f.used + p.size END, CASE WHEN p.cut OR f.used + p.size > 220 THEN p.n ELSE f.island END
  FROM f JOIN p ON p.document_id = f.document_id AND p.n = f.n + 1)"""


def islands(t):
    return P.join_islands(island_records(t), limit=220, small=70)


query(
    "join_islands",
    "D23",
    f"""WITH RECURSIVE {D_ISLAND} SELECT document_id, string_agg(record_id, ',' ORDER BY n) AS parents, md5(concat('Paper title: x', chr(10), chr(10), string_agg(body, chr(10) || chr(10) ORDER BY n))) AS record_text
FROM f JOIN p USING (document_id, n) GROUP BY document_id, island""",
)(lambda t: islands(t).select("document_id", F.array_join("parent_record_ids", ",").alias("parents"), F.md5("record_text").alias("record_text")))
query(
    "merged_provenance",
    "D25",
    f"""WITH RECURSIVE {D_ISLAND}, g AS (SELECT document_id, island, arg_min(record_id, n) AS first_id, count(*) AS k, list_sort(list_distinct(list(n % 3))) AS pages FROM f JOIN p USING (document_id, n) GROUP BY ALL)
SELECT document_id, CASE WHEN k > 1 THEN concat(first_id, ':joined') ELSE first_id END AS record_id, array_to_string(pages, ',') AS pages FROM g""",
)(
    lambda t: P.merged_provenance(islands(t), island_records(t).withColumn("refs", F.array("record_id")).withColumn("pages", F.array(F.col("n") % 3)))
    .select("document_id", "record_id", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))
)
query(
    "parent_coverage",
    "D25",
    f"WITH r AS ({duck(ISLAND).replace('DIV', '//').replace('STRING', 'VARCHAR')}) SELECT document_id, record_id, 'omitted' AS fault FROM r WHERE NOT prose",
)(lambda t: P.parent_coverage(islands(t).where("prose"), island_records(t)))


def batch_chunks(t):
    return t.sql(ISLAND).select("document_id", "n", F.col("record_id").alias("chunk_id"), F.when(F.col("n") % 2 == 0, "even").otherwise("odd").alias("heading"), F.col("body").alias("rendered"))


D_BATCH = f"""r AS (SELECT document_id, n, record_id, CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END AS heading, len(regexp_extract_all(body, {PIECE})) AS cost FROM ({duck(ISLAND).replace('DIV', '//').replace('STRING', 'VARCHAR')})),
f AS (SELECT document_id, heading, n, cost, 0 AS batch, CASE WHEN cost > 110 THEN 999999 ELSE cost END AS used FROM r WHERE n < 2
  UNION ALL SELECT r.document_id, r.heading, r.n, r.cost, CASE WHEN r.cost > 110 OR f.used + r.cost > 110 THEN f.batch + 1 ELSE f.batch END,
    CASE WHEN r.cost > 110 THEN 999999 WHEN f.used + r.cost > 110 THEN r.cost ELSE f.used + r.cost END FROM f JOIN r ON r.document_id = f.document_id AND r.heading = f.heading AND r.n = f.n + 2)"""
query(
    "token_batches",
    "D28",
    f"WITH RECURSIVE {D_BATCH} SELECT document_id, heading, n, cost, batch::BIGINT AS batch, cost > 110 AS oversize FROM f",
)(lambda t: P.token_batches(batch_chunks(t), 110).select("document_id", "heading", "n", F.col("cost").cast("long").alias("cost"), "batch", "oversize"))


def section_rows(t):
    return P.breadcrumbs(headed(t))


query(
    "select_by_heading",
    "D27",
    f"WITH {D_CRUMB} SELECT document_id, item_ref FROM cr WHERE NOT contains(headings, 'References') AND list_contains(string_split(headings, ' > '), 'Heading 200')",
)(lambda t: P.select_by_heading(section_rows(t), ["heading 200"]).select("document_id", "item_ref"))
query(
    "missing_headings",
    "D27",
    f"""WITH {D_CRUMB} SELECT DISTINCT source AS document_id, concat('Heading ', (doc_id + 1)::VARCHAR) AS heading FROM documents d WHERE NOT EXISTS (SELECT 1 FROM it WHERE it.label = 'section_header' AND it.document_id = d.source AND it.text = concat('Heading ', (doc_id + 1)::VARCHAR))""",
)(lambda t: P.missing_headings(section_rows(t), t.documents.select(F.col("source").alias("document_id"), F.concat(F.lit("Heading "), (F.col("doc_id") + 1).cast("string")).alias("heading")).distinct()))
