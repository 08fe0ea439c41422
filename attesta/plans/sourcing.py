"""Sources, catalog and export operators over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from attesta import schemas
from attesta.functions.lineage import shared_folder
from attesta.operators import units as U
from attesta.plans import duck, query
from attesta.plans.evidence import D_TEXT, text_items
from attesta.sources import catalog as C
from attesta.sources import publishing as P
from attesta.sources import readers as R
from attesta.sources import sinks as S

# A layout export per document, as JSON text; every ninth is some other JSON file.
def layouts(t):
    d = t.documents
    text = F.struct(F.concat(F.lit("#/texts/"), "doc_id").alias("self_ref"), F.lit("text").alias("label"), F.col("text").alias("text"),
                    F.array(F.struct((1 + F.col("doc_id") % 3).cast("int").alias("page_no"))).alias("prov"), F.array(F.struct(F.lit("#/texts/x").alias("$ref"))).alias("captions"))
    cell = F.struct(F.col("lang").alias("text"), F.lit(0).alias("start_row_offset_idx"), F.lit(1).alias("end_row_offset_idx"), F.lit(0).alias("start_col_offset_idx"), F.lit(1).alias("end_col_offset_idx"), F.lit(True).alias("column_header"))
    table = F.struct(F.concat(F.lit("#/tables/"), "doc_id").alias("self_ref"), F.lit("table").alias("label"), F.struct(F.lit(1).alias("num_rows"), F.lit(1).alias("num_cols"), F.array(cell).alias("table_cells")).alias("data"))
    page = F.struct((1 + F.col("doc_id") % 3).cast("int").alias("page_no"), F.struct(F.lit(600.0).alias("width"), F.lit(800.0).alias("height")).alias("size"))
    body = F.to_json(F.struct(
        F.when(F.col("doc_id") % 9 == 4, "Other").otherwise("DoclingDocument").alias("schema_name"), F.lit("1.0").alias("version"), F.col("source").alias("name"),
        F.struct(F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit(".pdf"))).alias("filename")).alias("origin"),
        F.create_map(F.lit("1"), page).alias("pages"), F.array(text).alias("texts"), F.array(table).alias("tables")))
    files = d.select(F.concat("doc_id", F.lit(".json")).alias("filename"), F.encode(body, "UTF-8").alias("content"), F.concat(F.lit("d"), "doc_id").alias("sha256"))
    return R.read_layouts(files)


query("read_layouts", "A1", "SELECT concat('d', doc_id) AS document_id, CASE WHEN doc_id % 2 = 0 THEN concat(source, '.pdf') ELSE source END AS source_filename FROM documents WHERE doc_id % 9 <> 4")(
    lambda t: layouts(t)[0].select("document_id", "source_filename"))
query("rejected_layouts", "A1", "SELECT concat(doc_id, '.json') AS filename, 'not_an_exported_layout' AS reason FROM documents WHERE doc_id % 9 = 4")(
    lambda t: layouts(t)[1].select("filename", "reason"))
query(
    "layout_items",
    "A1 B1",
    """SELECT concat('d', doc_id) AS document_id, concat('#/texts/', doc_id) AS item_ref, 'text' AS kind, md5(text) AS text, (1 + doc_id % 3)::INT AS page_no FROM documents WHERE doc_id % 9 <> 4
UNION ALL SELECT concat('d', doc_id), concat('#/tables/', doc_id), 'table', md5(''), NULL FROM documents WHERE doc_id % 9 <> 4""",
)(lambda t: R.layout_items(layouts(t)[0]).select("document_id", "item_ref", "kind", F.md5("text").alias("text"), F.try_element_at("locations", F.lit(1))["page_no"].alias("page_no")))
query("layout_cells", "A1 B5", "SELECT concat('d', doc_id) AS document_id, 0 AS idx, lang AS text, true AS column_header, false AS row_header FROM documents WHERE doc_id % 9 <> 4")(
    lambda t: R.layout_cells(layouts(t)[0]).select("document_id", "idx", "text", "column_header", "row_header"))
query("layout_pages", "A1", "SELECT concat('d', doc_id) AS document_id, (1 + doc_id % 3)::INT AS page_no, 600.0::DOUBLE AS width FROM documents WHERE doc_id % 9 <> 4")(
    lambda t: R.layout_pages(layouts(t)[0]).select("document_id", "page_no", "width"))
query("layout_context", "A1 B9", "SELECT concat('d', doc_id) AS document_id, 'captions' AS role, '#/texts/x' AS ref FROM documents WHERE doc_id % 9 <> 4")(
    lambda t: R.layout_context(layouts(t)[0]).select("document_id", "role", "ref"))
query(
    "bound_sources",
    "A2",
    "SELECT concat('d', doc_id) AS document_id, CASE WHEN doc_id % 2 = 0 AND source LIKE 'src1%' THEN md5(source) END AS source_sha256 FROM documents WHERE doc_id % 9 <> 4",
)(lambda t: R.bind_sources(layouts(t)[0], t.documents.where("source LIKE 'src1%'").select(F.concat("source", F.lit(".pdf")).alias("filename"), F.md5("source").alias("sha256")).distinct()).select("document_id", "source_sha256"))
query(
    "canonical_identity",
    "A3",
    """SELECT r_regionkey, sha256(concat('{"r_name":"', r_name, '","r_regionkey":', r_regionkey, '}')) AS document_id FROM region UNION ALL SELECT n_nationkey + 100, sha256(concat('{"n_name":"', n_name, '","n_nationkey":', n_nationkey, ',"n_regionkey":', n_regionkey, '}')) FROM nation""",
)(lambda t: R.canonical_identity(t.region).select("r_regionkey", "document_id").unionByName(R.canonical_identity(t.nation).select((F.col("n_nationkey") + 100).alias("r_regionkey"), "document_id")))
query(
    "source_profile",
    "A11",
    f"""WITH i AS ({D_TEXT}), l AS (SELECT document_id, string_agg(concat(label, '=', n), ',' ORDER BY label) AS labels FROM (SELECT document_id, label, count(*) AS n FROM i GROUP BY ALL) GROUP BY document_id)
SELECT document_id, count(*) AS texts, 0::BIGINT AS tables, count(*) AS with_provenance, any_value(labels) AS labels FROM i JOIN l USING (document_id) GROUP BY document_id""",
)(
    lambda t: R.source_profile(text_items(t).withColumn("locations", F.array("page_no"))).select(
        "document_id", "texts", "tables", "with_provenance", F.array_join(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("labels"))
)
query("heading_levels", "A11", f"SELECT document_id, level, count(*) AS headings FROM ({D_TEXT.replace('CAST(1 + (doc_id / 10) % 3 AS INT)', 'CAST(1 + doc_id % 3 AS INT)')}) WHERE label = 'section_header' GROUP BY ALL")(
    lambda t: R.heading_levels(text_items(t).withColumn("level", (1 + F.col("pos") % 3).cast("int"))))
def titled(t):
    """A title of more than 500 characters, an empty one, none, and neither title nor name."""
    d = t.documents.select(F.col("source").alias("document_id")).distinct().withColumn("k", F.substring("document_id", 4, 9).cast("int") % 4)
    title = F.when(F.col("k") == 0, F.repeat(F.concat("document_id", F.lit(" ")), 200)).when(F.col("k") == 1, "")
    return d.select("document_id", title.alias("title"), F.when(F.col("k") != 3, F.concat("document_id", F.lit(".pdf"))).alias("name"))


query(
    "document_profile",
    "A12",
    f"""WITH h AS (SELECT document_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS h, min(pos) AS p FROM ({D_TEXT}) WHERE label = 'section_header' AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY p) AS n FROM h QUALIFY n <= 60), g AS (SELECT document_id, md5(string_agg(substr(h, 1, 160), '|' ORDER BY n)) AS headings FROM k GROUP BY document_id)
SELECT source AS document_id, CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN substr(repeat(concat(source, ' '), 200), 1, 500) WHEN 3 THEN 'Selected document' ELSE concat(source, '.pdf') END AS title, coalesce(headings, md5('')) AS headings
FROM (SELECT DISTINCT source FROM documents) LEFT JOIN g ON document_id = source""",
)(lambda t: R.document_profile(titled(t), text_items(t)).select("document_id", "title", F.md5(F.array_join("headings", "|")).alias("headings")))
query(
    "arxiv_identifiers",
    "A13",
    """WITH u AS (SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN concat('https://arxiv.org/abs/2401.', lpad(page_id::VARCHAR, 5, '0'), 'v2') WHEN 1 THEN concat(' arxiv:hep-th/', lpad(page_id::VARCHAR, 7, '0'), ' ') WHEN 2 THEN concat('https://www.arxiv.org/pdf/1912.', lpad(page_id::VARCHAR, 4, '0'), '.pdf')
  WHEN 3 THEN concat('https://arxiv.org/abs/2401.00001?v=', page_id) WHEN 4 THEN concat('2413.', lpad(page_id::VARCHAR, 5, '0')) ELSE url END AS v FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat('2401.', lpad(page_id::VARCHAR, 5, '0'), 'v2') WHEN 1 THEN concat('hep-th/', lpad(page_id::VARCHAR, 7, '0')) WHEN 2 THEN concat('1912.', lpad(page_id::VARCHAR, 4, '0')) END AS arxiv_id,
  CASE page_id % 6 WHEN 3 THEN 'query_or_fragment' WHEN 4 THEN 'invalid_identifier' WHEN 5 THEN 'not_an_https_arxiv_url' END AS reason FROM u""",
)(
    lambda t: R.arxiv_identifiers(
        t.pages.select("page_id", F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("https://arxiv.org/abs/2401."), F.lpad(F.col("page_id").cast("string"), 5, "0"), F.lit("v2")))
                       .when(F.col("page_id") % 6 == 1, F.concat(F.lit(" arxiv:hep-th/"), F.lpad(F.col("page_id").cast("string"), 7, "0"), F.lit(" ")))
                       .when(F.col("page_id") % 6 == 2, F.concat(F.lit("https://www.arxiv.org/pdf/1912."), F.lpad(F.col("page_id").cast("string"), 4, "0"), F.lit(".pdf")))
                       .when(F.col("page_id") % 6 == 3, F.concat(F.lit("https://arxiv.org/abs/2401.00001?v="), F.col("page_id").cast("string")))
                       .when(F.col("page_id") % 6 == 4, F.concat(F.lit("2413."), F.lpad(F.col("page_id").cast("string"), 5, "0"))).otherwise(F.col("url")).alias("v")), "v").select("page_id", "arxiv_id", "reason")
)
query(
    "receipt_faults",
    "A14",
    "SELECT concat(page_id, '.pdf') AS filename, CASE WHEN page_id % 3 = 0 THEN 'not_a_pdf' ELSE 'receipt_mismatch' END AS fault FROM pages WHERE page_id % 3 = 0 OR page_id % 5 = 0",
)(
    lambda t: R.receipt_faults(
        t.pages.select(F.concat("page_id", F.lit(".pdf")).alias("filename"), F.encode(F.concat(F.when(F.col("page_id") % 3 == 0, "<html>").otherwise("%PDF-1.7"), "html"), "UTF-8").alias("content"), F.md5("url").alias("sha256")),
        t.pages.select(F.concat("page_id", F.lit(".pdf")).alias("filename"), F.when(F.col("page_id") % 5 == 0, "x").otherwise(F.md5("url")).alias("sha256"), F.col("page_id").cast("string").alias("arxiv_id")))
)
query(
    "fingerprint_changes",
    "A24",
    "SELECT url AS path, CASE page_id % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'altered' END AS change FROM pages WHERE page_id % 4 <> 3",
)(
    lambda t: (lambda p: R.fingerprint_changes(p.where("page_id % 4 <> 0"), p.where("page_id % 4 <> 1").withColumn("sha256", F.when(F.col("page_id") % 4 == 2, "x").otherwise(F.col("sha256"))), ("page_id", "path")))(
        t.pages.select("page_id", F.col("url").alias("path"), F.sha2("html", 256).alias("sha256")))
)


def manifest(t):
    return t.documents.where("lang = 'en'").select(F.concat(F.lit("p"), "doc_id").alias("paper_id"), F.concat(F.lit("title "), "doc_id").alias("title"), F.concat("source", F.lit("/"), "doc_id", F.lit(".pdf")).alias("source_pdf"), F.concat(F.lit("m"), "doc_id").alias("docling_json"))


def library(t):
    return t.documents.where("lang <> 'en' OR doc_id % 50 = 0").select(F.concat(F.lit("p"), "doc_id").alias("paper_id"), F.concat(F.lit("title "), "doc_id").alias("title"), F.concat("source", F.lit("/"), "doc_id", F.lit(".pdf")).alias("source_pdf"), F.lit(None).cast("string").alias("docling_json"))


def papers(t):
    overrides = t.labels.where("quality = 1").select(F.concat(F.lit("p"), "doc_id").alias("paper_id"), F.concat(F.lit("o"), "doc_id").alias("docling_json"), F.lit("chunks").alias("rag_chunks"))
    return C.catalog(manifest(t), library(t), overrides)


D_CAT = """papers AS (SELECT d.doc_id, concat('p', d.doc_id) AS paper_id, concat('title ', d.doc_id) AS title, concat(source, '/', d.doc_id, '.pdf') AS source_pdf, CASE WHEN quality = 1 THEN concat('o', d.doc_id) WHEN m = 1 THEN concat('m', d.doc_id) END AS docling_json, CASE WHEN quality = 1 THEN 'chunks' END AS rag_chunks
FROM (SELECT doc_id, source, 1 AS m FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, source, 0 FROM documents WHERE lang <> 'en' OR doc_id % 50 = 0) d LEFT JOIN labels USING (doc_id))"""
query("corpus_catalog", "A7", f"WITH {D_CAT} SELECT paper_id, docling_json, rag_chunks FROM papers")(lambda t: papers(t).select("paper_id", "docling_json", "rag_chunks"))
query("duplicate_papers", "A7", "SELECT concat('p', doc_id) AS paper_id, 2::BIGINT AS entries FROM documents WHERE lang = 'en' AND doc_id % 50 = 0")(lambda t: C.duplicate_papers(manifest(t), library(t)))


def listing(t):
    states = t.labels.where("toxic = 0").select(F.concat(F.lit("p"), "doc_id").alias("paper_id"), F.lit("ready").alias("status"))
    files = t.documents.where("doc_id % 3 = 0").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".pdf")).alias("path"))
    return C.library_listing(papers(t), states, files)


query(
    "library_listing",
    "A8",
    f"WITH {D_CAT} SELECT paper_id, docling_json IS NOT NULL AS processed, CASE WHEN toxic = 0 THEN 'ready' ELSE 'not_ready' END AS rag, doc_id % 3 = 0 AS source_available FROM papers LEFT JOIN labels USING (doc_id)",
)(lambda t: listing(t).select("paper_id", "processed", "rag", "source_available"))
query("filter_library", "B25", f"WITH {D_CAT} SELECT paper_id FROM papers WHERE docling_json IS NOT NULL AND contains(concat(title, ' ', source_pdf), '7')")(
    lambda t: U.filter_library(listing(t).withColumn("filename", F.col("source_pdf")), "7", "extracted").select("paper_id"))
query(
    "register_papers",
    "A27",
    "SELECT concat('p', doc_id) AS paper_id, CASE WHEN lang = 'en' THEN 'rejected' ELSE 'inserted' END AS action FROM documents WHERE lang <> 'en' OR doc_id % 50 = 0",
)(lambda t: (lambda r: r[0].select("paper_id", F.lit("inserted").alias("action")).unionByName(r[1].select("paper_id", F.lit("rejected").alias("action"))))(C.register(manifest(t), library(t))))
query(
    "merge_status_fields",
    "A27",
    """SELECT user_id AS paper_id, arg_max(event_type, ts) AS status, arg_max(CASE WHEN event_id % 4 = 0 THEN props END, ts) FILTER (WHERE event_id % 4 = 0) AS error FROM events GROUP BY user_id""",
)(lambda t: C.merge_fields(t.events.select(F.col("user_id").alias("paper_id"), "ts", F.col("event_type").alias("status"), F.when(F.col("event_id") % 4 == 0, F.col("props")).alias("error")), ["status", "error"]))
query(
    "identity_faults",
    "A26",
    """SELECT c_custkey AS paper_id, unnest(list_filter([CASE WHEN c_custkey % 7 = 0 THEN 'layout_missing' END, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 = 0 THEN 'filename_differs' END, CASE WHEN c_custkey % 3 = 0 THEN 'pdf_hash_differs' END, CASE WHEN c_nationkey = 3 THEN 'index_of_other_conversion' END, CASE WHEN c_acctbal < 0 THEN 'annotations_of_other_conversion' END], lambda x: x IS NOT NULL)) AS fault FROM customer""",
)(
    lambda t: (lambda c: C.identity_faults(
        c.select(F.col("c_custkey").alias("paper_id"), F.concat(F.lit("pdfs/"), "c_name").alias("source_pdf"), F.lit("h").alias("source_sha256"), F.concat(F.lit("d"), "c_custkey").alias("document_id")),
        c.where("c_custkey % 7 <> 0").select(F.concat(F.lit("d"), "c_custkey").alias("document_id"), F.when(F.col("c_custkey") % 5 == 0, "x").otherwise(F.col("c_name")).alias("source_filename")),
        c.select(F.col("c_custkey").alias("paper_id"), F.when(F.col("c_acctbal") < 0, "z").otherwise(F.concat(F.lit("d"), "c_custkey")).alias("result_document_id")),
        c.select(F.col("c_custkey").alias("paper_id"), F.when(F.col("c_nationkey") == 3, "z").otherwise(F.concat(F.lit("d"), "c_custkey")).alias("index_document_id"), F.when(F.col("c_custkey") % 3 == 0, "z").otherwise("h").alias("pdf_sha256"))))(t.customer)
)
query(
    "formula_guard",
    "A17",
    "SELECT doc_id, CASE WHEN regexp_matches(text, '^\\s*[=+\\-@]') THEN md5(concat('''', text)) ELSE md5(text) END AS text FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat(' =', text) WHEN 1 THEN concat('-', text) ELSE text END AS text FROM documents)",
)(lambda t: t.documents.select("doc_id", F.md5(S.formula_guard(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" ="), "text")).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("-"), "text")).otherwise(F.col("text")))).alias("text")))
query(
    "export_result_rows",
    "A16 A17 A20",
    "SELECT p_partkey, p_name, concat('''', '+', p_type) AS p_type FROM part WHERE p_brand = 'Brand#7'",
)(lambda t: S.export("csv", "Brand#7", {"results": t.part.select(F.col("p_brand").alias("document_id"), "p_partkey", "p_name", F.concat(F.lit("+"), "p_type").alias("p_type"))}).drop("document_id"))
query("graph_table_counts", "A19", "SELECT 'supplier' AS \"table\", count(*) AS rows FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'lineitem', count(*) FROM lineitem")(
    lambda t: S.table_counts({"supplier": t.supplier, "part": t.part, "lineitem": t.lineitem}))


# ---- publications: written, read back, published in one step, read again ---------------
def folder(t, name):
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4()}"


def chunk_rows(t):
    return t.documents.select(F.col("source").alias("index_id"), F.col("doc_id").cast("string").alias("chunk_id"), "text", F.array("lang", "source").alias("refs"))


def published_chunks(t):
    """Two loads, the second one repeated; a load between them ends before it is published."""
    path, chunks = folder(t, "chunks"), chunk_rows(t)
    versions = [S.write_chunks(chunks.where("length(text) % 2 = 0"), path)]
    P.stage_load(t.spark, path, {"chunks": S.chunk_part(chunks.withColumn("text", F.lit("half")))})
    versions += [S.write_chunks(chunks, path), S.write_chunks(chunks.repartition("chunk_id"), path)]
    found = P.read_part(t.spark, path, "chunks")
    return found.select("chunk_id", F.md5("text").alias("text"), "refs_json", F.lit(",".join(map(str, versions))).alias("versions"))


query(
    "published_chunks",
    "A15 A23",
    """SELECT doc_id::VARCHAR AS chunk_id, md5(text) AS text, concat('["', lang, '","', source, '"]') AS refs_json, '0,1,None' AS versions FROM documents""",
)(published_chunks)


def result_rows(t):
    """Texts with line ends, commas, quotes and formulas, and empty and missing ones."""
    k = F.col("doc_id") % 5
    said = F.when(k == 0, F.concat(F.lit('=1+"a", '), "text")).when(k == 1, "").when(k == 2, F.lit(None)).when(k == 3, F.concat(F.lit("  "), "text", F.lit(" "))).otherwise(F.col("text"))
    return t.documents.select(F.col("doc_id").cast("string").alias("result_id"), F.col("source").alias("document_id"), said.alias("raw"), F.col("n_chars").cast("double").alias("numeric"))


def published_results(t):
    path = folder(t, "results")
    P.publish(t.spark, path, {"results": S.result_part(result_rows(t))})
    return P.read_part(t.spark, path, "results").select("result_id", F.md5("raw").alias("raw"), "numeric")


query(
    "published_results",
    "A16 A17",
    """WITH r AS (SELECT doc_id, n_chars, CASE doc_id % 5 WHEN 0 THEN concat('=1+"a", ', text) WHEN 1 THEN '' WHEN 2 THEN NULL WHEN 3 THEN concat('  ', text, ' ') ELSE text END AS raw FROM documents)
SELECT doc_id::VARCHAR AS result_id, md5(CASE WHEN regexp_matches(raw, '^\\s*[=+\\-@]') THEN concat('''', raw) ELSE raw END) AS raw, n_chars::DOUBLE AS "numeric" FROM r""",
)(published_results)


def published_tables(t):
    path = folder(t, "graph")
    S.export_tables({"suppliers": t.supplier, "parts": t.part, "orders": t.orders.withColumn("refs", F.array("o_custkey"))}, path)
    return P.manifest(t.spark, path).select(F.split("part", "\\.")[0].alias("table"), "format", "rows")


query(
    "published_tables",
    "A19",
    """SELECT "table", format, rows FROM (SELECT 'suppliers' AS "table", count(*) AS rows FROM supplier UNION ALL SELECT 'parts', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders), (VALUES ('json'), ('csv')) f(format)""",
)(published_tables)


def paper_parts(t):
    """One paper is a brand: its units, layout rows, chunks, results and checks."""
    p, brand = t.part, F.col("p_brand").alias("document_id")
    sold = t.lineitem.join(p, F.col("l_partkey") == F.col("p_partkey"))
    return {
        "evidence": p.select(brand, F.col("p_partkey").alias("evidence_id"), F.col("p_name").alias("text")),
        "docling": p.select(brand, F.col("p_type").alias("label")).distinct(),
        "rag": sold.select(brand, "l_orderkey", "l_linenumber", F.array("p_type", "p_name").alias("refs")),
        "results": p.select(brand, "p_partkey", F.concat(F.lit("="), "p_name").alias("raw"), "p_retailprice"),
        "checks": p.where("p_size > 25").select(brand, "p_partkey", F.lit("needs_review").alias("outcome")),
    }


def published_exports(t):
    """All kinds of one paper, read again from the files."""
    path = folder(t, "paper")
    S.export_paper(t.spark, "Brand#7", paper_parts(t), path)
    out = None
    for kind in S.EXPORTS:
        rows = P.read_part(t.spark, path, kind)
        guarded = F.col("raw").startswith("'=") if kind == "csv" else F.lit(False)
        found = rows.agg(F.count("*").alias("rows"), F.count_if(guarded).alias("guarded")).select(F.lit(kind).alias("kind"), "rows", "guarded")
        out = found if out is None else out.unionByName(found)
    return out


query(
    "published_exports",
    "A20",
    """WITH p AS (SELECT * FROM part WHERE p_brand = 'Brand#7') SELECT 'evidence' AS kind, count(*) AS rows, 0::BIGINT AS guarded FROM p UNION ALL SELECT 'docling', count(DISTINCT p_type), 0 FROM p UNION ALL SELECT 'rag', count(*), 0 FROM lineitem JOIN p ON l_partkey = p_partkey
UNION ALL SELECT 'results', count(*), 0 FROM p UNION ALL SELECT 'checks', count(*), 0 FROM p WHERE p_size > 25 UNION ALL SELECT 'csv', count(*), count(*) FROM p""",
)(published_exports)


# ---- records in files: declared schema, damaged lines apart -----------------------------
UNIT_LINE = "document_id string, evidence_id string, text string, page_no int"
CHUNK_LINE = "chunk_id string, contextualized_text string, source_refs array<string>, token_count int"


def damaged(line, key):
    """Every thirteenth line is cut short, of the others every eleventh has a list or a number in the wrong place."""
    cut_short = F.substring(line, F.lit(1), F.length(line) - 2)
    odd = F.concat(F.lit('{"document_id":["x"],"source_refs":7,"completion_calls":7,"k":'), key.cast("string"), F.lit("}"))
    return F.when(key % 13 == 0, cut_short).when(key % 11 == 0, odd).otherwise(line)


def unit_lines(t):
    line = F.to_json(F.struct(F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("source")).alias("document_id"), F.concat(F.lit("u"), "doc_id").alias("evidence_id"), "text", (F.col("doc_id") % 9).cast("int").alias("page_no")))
    return t.documents.select(damaged(line, F.col("doc_id")).alias("value"))


def chunk_lines(t):
    line = F.to_json(F.struct(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.col("text").alias("contextualized_text"), F.array("lang").alias("source_refs"), F.length("text").alias("token_count")))
    return t.documents.select(damaged(line, F.col("doc_id")).alias("value"))


def result_lines(t):
    record = F.struct(F.concat(F.lit("r"), "p_partkey").alias("result_id"), F.col("p_brand").alias("document_id"), F.struct(F.col("p_name").alias("reported")).alias("method"),
                      F.struct(F.col("p_retailprice").cast("string").alias("raw"), F.col("p_retailprice").cast("double").alias("numeric")).alias("value"))
    line = F.to_json(F.struct(F.lit("1").alias("schema_version"), F.col("p_brand").alias("document_id"), F.array(record).alias("records")))
    return t.part.select(damaged(line, F.col("p_partkey")).alias("value"))


def ledger_lines(t):
    call = F.struct(F.when(F.col("value") > 50, "completed").otherwise("failed").alias("status"), F.col("event_type").alias("model"), F.concat(F.lit("h"), "event_id").alias("request_hash"), F.col("user_id").cast("long").alias("reserved_tokens"))
    return t.events.select(damaged(F.to_json(F.struct(F.array(call).alias("completion_calls"))), F.col("event_id")).alias("value"))


LINES = {
    "index": (unit_lines, UNIT_LINE, R.INDEX_FIELDS), "chunks": (chunk_lines, CHUNK_LINE, R.CHUNK_FIELDS),
    "results": (result_lines, schemas.COLLECTION, R.RESULT_FIELDS), "ledger": (ledger_lines, schemas.LEDGER, R.LEDGER_FIELDS),
}


def line_file(t, kind):
    path = folder(t, kind)
    LINES[kind][0](t).write.text(path)
    return path


D_SOUND = "{0} % 13 <> 0 AND {0} % 11 <> 0"
query(
    "read_index_lines",
    "A4",
    f"SELECT source AS document_id, concat('u', doc_id) AS evidence_id, md5(text) AS text, (doc_id % 9)::INT AS page_no FROM documents WHERE {D_SOUND.format('doc_id')} AND doc_id % 7 <> 0",
)(lambda t: R.read_index(t.spark, line_file(t, "index"), UNIT_LINE).withColumn("text", F.md5("text")))
query(
    "read_chunk_lines",
    "A6",
    f"SELECT concat('c', doc_id) AS chunk_id, md5(text) AS text, lang, length(text)::INT AS token_count FROM documents WHERE {D_SOUND.format('doc_id')}",
)(lambda t: R.read_chunks(t.spark, line_file(t, "chunks"), CHUNK_LINE).select("chunk_id", F.md5("contextualized_text").alias("text"), F.col("source_refs")[0].alias("lang"), "token_count"))
query(
    "read_result_lines",
    "A5",
    f"""SELECT p_brand AS document_id, concat('r', p_partkey) AS result_id, p_name AS "method", p_retailprice::DOUBLE AS "numeric" FROM part WHERE {D_SOUND.format('p_partkey')}""",
)(lambda t: R.read_result_lines(t.spark, line_file(t, "results")).select(F.inline("records")).select("document_id", "result_id", F.col("method.reported").alias("method"), F.col("value.numeric").alias("numeric")))
query(
    "read_ledger_lines",
    "A10",
    f"SELECT concat('h', event_id) AS request_hash, CASE WHEN value > 50 THEN 'completed' ELSE 'failed' END AS status, event_type AS model, user_id::BIGINT AS reserved_tokens FROM events WHERE {D_SOUND.format('event_id')}",
)(lambda t: R.read_ledger_lines(t.spark, line_file(t, "ledger")).select("request_hash", "status", "model", "reserved_tokens"))


def quarantined(t):
    """Lines that are no records, by the file they stand in."""
    out = None
    for kind, (_, schema, required) in LINES.items():
        found = R.quarantine(t.spark, line_file(t, kind), schema, required).groupBy("reason").agg(F.count("*").alias("lines"), F.count_distinct("path", "offset").alias("places"))
        found = found.select(F.lit(kind).alias("kind"), "reason", "lines", "places")
        out = found if out is None else out.unionByName(found)
    return out


def _d_damage(kind: str, table: str, key: str, odd: str) -> str:
    return f"SELECT '{kind}' AS kind, CASE WHEN {key} % 13 = 0 THEN 'not_json' WHEN {key} % 11 = 0 THEN '{odd}' END AS reason, {key} AS k FROM {table}"


query(
    "quarantined_lines",
    "A4 A5 A6 A10",
    f"""SELECT kind, reason, count(*) AS lines, count(*) AS places FROM ({_d_damage('index', 'documents', 'doc_id', 'without_evidence_id')} UNION ALL {_d_damage('chunks', 'documents', 'doc_id', 'not_of_the_schema')} UNION ALL {_d_damage('results', 'part', 'p_partkey', 'without_schema_version')}
UNION ALL {_d_damage('ledger', 'events', 'event_id', 'not_of_the_schema')} UNION ALL SELECT 'index', CASE WHEN {D_SOUND.format('doc_id')} THEN 'without_document_id' END, doc_id FROM documents WHERE doc_id % 7 = 0) WHERE reason IS NOT NULL GROUP BY ALL""",
)(quarantined)


def graph_files(t):
    """A graph table of several files, one of which is no Parquet."""
    path = folder(t, "entities")
    t.part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("title")).write.parquet(path)
    t.region.select(F.col("r_name").alias("value")).coalesce(1).write.mode("append").text(path)
    return R.read_graph_table(t.spark, path, "id string, title string")


query("read_graph_files", "A9", "SELECT concat('p', p_partkey) AS id, p_name AS title FROM part")(lambda t: graph_files(t)[0])
query("unreadable_graph_files", "A9", "SELECT 'txt' AS kind, 'no_readable_rows' AS reason, sum(length(r_name) + 1)::BIGINT AS length FROM region")(
    lambda t: graph_files(t)[1].select(F.substring_index("path", ".", -1).alias("kind"), "reason", "length"))
