"""Evidence units and their structural context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attesta.functions.stage import stage
from attesta.operators import units as U
from attesta.plans import duck, fixtures as fx, query


def cells(t):
    """The grid of `fixtures.CELLS` in two scans: one pass over the parts, one over the tables."""

    def cell(idx, top, bottom, left, right, text, header=False, row_header=False, section=False):
        as_col = lambda v: v if not isinstance(v, (int, bool, str)) else F.lit(v)
        return F.struct(
            as_col(idx).cast("int").alias("idx"), as_col(top).cast("int").alias("row_start"),
            as_col(bottom).cast("int").alias("row_end"), F.lit(left).alias("col_start"), F.lit(right).alias("col_end"),
            F.lit(header).alias("column_header"), as_col(row_header).alias("row_header"),
            F.lit(section).alias("row_section"), as_col(text).alias("text"))

    g = t.sql(fx.GRID_BASE)
    key, r, size = F.col("p_partkey"), F.col("r"), F.col("p_size").cast("string")
    code = F.when(key % 5 == 0, F.concat(size, F.lit(" "), key.cast("string"))).otherwise("n/a")
    price = F.concat(F.floor("p_retailprice").cast("int").cast("string"), F.lit(".5"))
    rows = F.array_compact(F.array(
        F.when(F.col("p_size") % 10 == 0,
               cell(key * 8 + 8, r - 1, r, 0, 4, F.concat(F.lit("Group "), "p_name"), section=True)),
        cell(key * 8 + 9, r, r + 1, 0, 1, F.col("p_name"), row_header=key % 3 != 0),
        cell(key * 8 + 10, r, r + 1, 1, 2, size),
        cell(key * 8 + 11, r, r + 1, 2, 3, price),
        cell(key * 8 + 12, r, F.when(key % 7 == 0, r + 2).otherwise(r + 1), 3, 4, code),
    ))
    heads = F.array(
        cell(0, 0, 1, 0, 1, "-", True), cell(1, 0, 1, 1, 3, F.col("document_id"), True), cell(2, 0, 1, 3, 4, "Codes", True),
        cell(3, 1, 2, 1, 2, "Size ↓", True), cell(4, 1, 2, 2, 3, "Price ↑", True))
    return (
        g.select("document_id", "item_ref", F.inline(rows))
        .unionByName(g.select("document_id", "item_ref").distinct().select("document_id", "item_ref", F.inline(heads)))
        .withColumn("bbox", F.lit(None).cast(U.BBOX)))


def grid_items(t):
    place = F.struct(
        F.col("page_no"),
        F.lit(None).cast(U.BBOX).alias("bbox"),
        F.lit("item").alias("granularity"),
        F.lit(None).cast("array<int>").alias("charspan"),
    )
    return t.sql(fx.TABLE_ITEMS).withColumn("locations", F.array(place))


def text_items(t):
    return t.sql(fx.TEXT_ITEMS)


def grid_units(t):
    items = U.item_units(grid_items(t))
    return stage(items.unionByName(U.cell_units(cells(t), items), allowMissingColumns=True))


D_CELLS = duck(fx.CELLS)
D_ITEMS = duck(fx.TABLE_ITEMS)
D_TEXT = duck(fx.TEXT_ITEMS)
CID = "concat(c.item_ref, '::cell:', c.idx::VARCHAR)"
OID = "concat(o.item_ref, '::cell:', o.idx::VARCHAR)"


def _edge_sql(role: str, axis: str, which: str, condition: str) -> str:
    """Pairs of cells that share a column or row of their table; every span is spread over its coordinates."""
    return f"""
WITH cells AS MATERIALIZED ({D_CELLS}), spread AS MATERIALIZED (SELECT *, unnest(range({axis}_start::BIGINT, {axis}_end::BIGINT)) AS place FROM cells),
heads AS MATERIALIZED (SELECT * FROM spread WHERE {which})
SELECT DISTINCT c.document_id, {CID} AS evidence_id, '{role}' AS role, {OID} AS ref, o.idx::BIGINT AS pos
FROM spread c JOIN heads o ON c.document_id = o.document_id AND c.item_ref = o.item_ref AND c.place = o.place WHERE {condition}
"""


query(
    "text_units",
    "B1 B4",
    f"""SELECT document_id, item_ref AS evidence_id, kind, label, length(text)::BIGINT AS n_chars,
       CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'empty_extracted_text' ELSE '' END AS issues
FROM ({D_TEXT})""",
)(
    lambda t: U.item_units(
        text_items(t).withColumn(
            "locations",
            F.array(F.struct("page_no", F.lit(None).cast(U.BBOX).alias("bbox"), F.lit("item").alias("granularity"),
                             F.lit(None).cast("array<int>").alias("charspan"))),
        )
    ).select("document_id", "evidence_id", "kind", "label", F.length("text").cast("long").alias("n_chars"),
             F.array_join("issues", ";").alias("issues"))
)

query(
    "duplicate_item_refs",
    "B2",
    """SELECT source AS document_id, md5(text) AS item_ref, count(*) AS copies FROM documents
GROUP BY source, md5(text) HAVING count(*) > 1""",
)(lambda t: U.duplicate_refs(t.documents.select(F.col("source").alias("document_id"), F.md5("text").alias("item_ref"))))

query(
    "unknown_page_locations",
    "B3",
    f"""SELECT DISTINCT i.document_id, i.item_ref AS evidence_id, i.page_no FROM ({D_TEXT}) i
WHERE NOT EXISTS (SELECT 1 FROM ({D_TEXT}) p WHERE p.label = 'section_header' AND p.document_id = i.document_id AND p.page_no = i.page_no)""",
)(
    lambda t: U.unknown_page_locations(
        text_items(t).select("document_id", F.col("item_ref").alias("evidence_id"),
                             F.array(F.struct("page_no")).alias("locations")),
        text_items(t).where("label = 'section_header'").select("document_id", "page_no"),
    )
)

query(
    "cell_units",
    "B5 B7 B8 B9",
    f"""WITH cells AS ({D_CELLS}), items AS ({D_ITEMS})
SELECT c.document_id, {CID} AS evidence_id, c.text, i.page_no, 'table' AS granularity,
       concat('cell_location_not_resolved',
              CASE WHEN regexp_matches(trim(c.text), '^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)(\\s+[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+))+$') THEN ';multiple_numeric_values' ELSE '' END,
              CASE WHEN NOT c.column_header AND NOT c.row_header AND NOT c.row_section AND (c.row_end - c.row_start > 1 OR c.col_end - c.col_start > 1)
                   THEN ';spanning_data_cell' ELSE '' END) AS issues
FROM cells c JOIN items i ON i.kind = 'table' AND i.document_id = c.document_id AND i.item_ref = c.item_ref""",
)(
    lambda t: U.cell_units(cells(t), U.item_units(grid_items(t))).select(
        "document_id", "evidence_id", "text", F.col("locations")[0]["page_no"].alias("page_no"),
        F.col("locations")[0]["granularity"].alias("granularity"), F.array_join("issues", ";").alias("issues"))
)

query(
    "invalid_cell_spans",
    "B6",
    f"""WITH cells AS ({D_CELLS}), tables AS ({duck(fx.TABLES)})
SELECT c.document_id, {CID} AS evidence_id, 'out_of_bounds' AS reason
FROM cells c JOIN tables t ON t.document_id = c.document_id AND t.item_ref = c.item_ref
WHERE c.row_end > t.num_rows OR c.col_end > t.num_cols""",
)(lambda t: U.invalid_spans(cells(t), t.sql(fx.TABLES)))

query(
    "column_headers",
    "B10",
    _edge_sql("column_headers", "col", "column_header", "o.row_end <= c.row_start"),
)(lambda t: U.column_headers(cells(t)))

query(
    "row_headers",
    "B11",
    _edge_sql("row_headers", "row", "row_header", "o.idx <> c.idx"),
)(lambda t: U.row_headers(cells(t)))

query(
    "row_labels",
    "B12",
    _edge_sql("row_labels", "row", "col_start = 0 AND NOT column_header AND NOT row_section", "o.idx <> c.idx"),
)(lambda t: U.row_labels(cells(t)))

query(
    "row_sections",
    "B13",
    f"""WITH cells AS MATERIALIZED ({D_CELLS}), ends AS (SELECT document_id, item_ref, row_end, max(row_start) AS m FROM cells WHERE row_section GROUP BY ALL),
tops AS MATERIALIZED (SELECT document_id, item_ref, row_end, max(m) OVER (PARTITION BY document_id, item_ref ORDER BY row_end) AS m FROM ends),
near AS MATERIALIZED (SELECT c.document_id, c.item_ref, c.idx, s.m FROM cells c ASOF JOIN tops s ON c.document_id = s.document_id AND c.item_ref = s.item_ref AND c.row_start >= s.row_end)
SELECT c.document_id, {CID} AS evidence_id, 'row_sections' AS role, {OID} AS ref, o.idx::BIGINT AS pos
FROM near c JOIN (SELECT * FROM cells WHERE row_section) o ON c.document_id = o.document_id AND c.item_ref = o.item_ref AND o.row_start = c.m""",
)(lambda t: U.row_sections(cells(t)))

query(
    "table_members",
    "B14",
    f"""SELECT c.document_id, c.item_ref AS evidence_id, 'cells' AS role, {CID} AS ref, c.idx::BIGINT AS pos FROM ({D_CELLS}) c""",
)(lambda t: U.table_members(cells(t)))

query(
    "inherited_captions",
    "B9",
    f"""SELECT c.document_id, {CID} AS evidence_id, i.role, i.ref, i.pos FROM ({D_CELLS}) c
JOIN ({duck(fx.ITEM_CONTEXT)}) i ON i.document_id = c.document_id AND i.item_ref = c.item_ref""",
)(lambda t: U.inherited_context(cells(t), t.sql(fx.ITEM_CONTEXT)))

query(
    "index_integrity",
    "A4 B15",
    f"""WITH cells AS ({D_CELLS}), items AS ({D_ITEMS})
SELECT c.document_id, {CID} AS evidence_id, 'cell_without_table' AS rule FROM cells c
WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.kind = 'table' AND i.page_no >= 40 AND i.document_id = c.document_id AND i.item_ref = c.item_ref)
UNION ALL
SELECT DISTINCT i.document_id, i.item_ref, 'unresolved_context_reference' FROM ({duck(fx.ITEM_CONTEXT)}) i
WHERE NOT EXISTS (SELECT 1 FROM items k WHERE k.page_no >= 40 AND k.document_id = i.document_id AND k.item_ref = i.ref)""",
)(
    lambda t: U.integrity_violations(
        grid_units(t).where("kind = 'table_cell'").unionByName(
            U.item_units(grid_items(t).where("page_no >= 40")), allowMissingColumns=True),
        U.own_context(t.sql(fx.ITEM_CONTEXT)),
        t.sql(fx.GRID_PAGES),
    )
)

query(
    "unit_histogram",
    "B16",
    f"""SELECT document_id, 'table_cell' AS kind, count(*) AS units FROM ({D_CELLS}) GROUP BY document_id
UNION ALL SELECT document_id, kind, count(*) FROM ({D_ITEMS}) GROUP BY document_id, kind""",
)(lambda t: U.kind_histogram(grid_units(t)))

query(
    "issue_histogram",
    "B16",
    f"""WITH c AS ({D_CELLS}), f AS (
SELECT document_id, 'cell_location_not_resolved' AS issue FROM c
UNION ALL SELECT document_id, 'multiple_numeric_values' FROM c WHERE regexp_matches(text, '^[0-9.]+ +[0-9.]+$')
UNION ALL SELECT document_id, 'spanning_data_cell' FROM c WHERE NOT column_header AND NOT row_header AND NOT row_section
  AND (row_end - row_start > 1 OR col_end - col_start > 1))
SELECT document_id, issue, count(*) AS units FROM f GROUP BY ALL""",
)(lambda t: U.issue_histogram(grid_units(t)))


def _rects(t):
    box = F.struct(
        F.col("c_acctbal").alias("l"), (F.col("c_custkey") % 900).cast("double").alias("t"),
        (F.col("c_acctbal") + F.col("c_custkey") % 300).alias("r"), (F.col("c_custkey") % 700).cast("double").alias("b"),
        F.when(F.col("c_custkey") % 2 == 0, "BOTTOMLEFT").otherwise("TOPLEFT").alias("coord_origin"),
    )
    rect = U.display_rect(box, F.lit(6000.0), F.lit(850.0))
    return t.customer.select("c_custkey", *[F.round(rect[s], 6).alias(f"rect_{s}") for s in ("left", "top", "right", "bottom")])


query(
    "display_rectangles",
    "B17",
    """WITH b AS (SELECT c_custkey, least(c_acctbal, c_acctbal + c_custkey % 300) AS l, greatest(c_acctbal, c_acctbal + c_custkey % 300) AS r,
  least(c_custkey % 900, c_custkey % 700)::DOUBLE AS t0, greatest(c_custkey % 900, c_custkey % 700)::DOUBLE AS b0, c_custkey % 2 = 0 AS flip FROM customer),
f AS (SELECT c_custkey, l, r, CASE WHEN flip THEN 850 - b0 ELSE t0 END AS t, CASE WHEN flip THEN 850 - t0 ELSE b0 END AS b FROM b),
v AS (SELECT *, l >= -0.01 AND t >= -0.01 AND r <= 6000.01 AND b <= 850.01 AND r > l AND b > t AS ok FROM f)
SELECT c_custkey, CASE WHEN ok THEN round(greatest(0, l) / 6000, 6) END AS rect_left, CASE WHEN ok THEN round(greatest(0, t) / 850, 6) END AS rect_top,
  CASE WHEN ok THEN round(least(6000, r) / 6000, 6) END AS rect_right, CASE WHEN ok THEN round(least(850, b) / 850, 6) END AS rect_bottom FROM v""",
)(_rects)

query(
    "table_labels",
    "B18",
    f"""SELECT document_id, replace(item_ref, 'texts', 'tables') AS evidence_id, concat('Table ', regexp_extract(text, 'Table ([0-9]+)', 1)) AS table_label
FROM ({D_ITEMS}) WHERE kind = 'text'""",
)(lambda t: U.table_labels(U.item_units(grid_items(t)), U.own_context(t.sql(fx.ITEM_CONTEXT))))

NORM = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\\s+', ' ', 'g'))"

query(
    "locate_quotes",
    "B19 H47",
    f"""SELECT b.item_id AS quote_id, d.doc_id AS evidence_id FROM benchmark b JOIN documents d
ON contains({NORM.format('d.text')}, {NORM.format('b.text')})""",
)(
    lambda t: U.locate_quotes(
        t.benchmark.select(F.lit("corpus").alias("document_id"), F.col("item_id").alias("quote_id"), F.col("text").alias("quote"),
                           F.lit(None).cast("long").alias("source_ref")),
        t.documents.select(F.lit("corpus").alias("document_id"), F.col("doc_id").alias("evidence_id"), "text"),
    ).select("quote_id", "evidence_id")
)

query(
    "locate_short_quotes_at_reference",
    "B19",
    f"""SELECT p.p_partkey AS quote_id, concat(c.item_ref, '::cell:', c.idx::VARCHAR) AS evidence_id
FROM part p JOIN ({D_CELLS}) c ON c.idx = p.p_partkey * 8 + 9
WHERE CASE WHEN length(p.p_name) < 12 THEN length(p.p_name) >= 2 AND lower(p.p_name) = lower(c.text) ELSE contains(lower(c.text), lower(p.p_name)) END""",
)(
    lambda t: U.locate_quotes(
        t.sql(fx.GRID_BASE).select("document_id", F.col("p_partkey").alias("quote_id"), F.col("p_name").alias("quote"),
                                   U.cell_id("item_ref", F.col("p_partkey") * 8 + 9).alias("source_ref")),
        cells(t).select("document_id", U.cell_id("item_ref", "idx").alias("evidence_id"), "text"),
    ).select("quote_id", "evidence_id")
)

query(
    "source_inventory",
    "B20 A11",
    f"""WITH i AS ({D_TEXT})
SELECT document_id, count(DISTINCT page_no) AS pages, count(*) FILTER (WHERE label = 'text') AS chunks,
       count(*) FILTER (WHERE label = 'section_header') AS headings, count(*) FILTER (WHERE label = 'formula') AS formula_regions,
       count(*) FILTER (WHERE label = 'formula' AND trim(text) = '') AS empty_formulas, 0::BIGINT AS table_warnings
FROM i GROUP BY document_id""",
)(
    lambda t: U.inventory(
        text_items(t).withColumn("issues", F.array().cast("array<string>")),
        text_items(t).select("document_id", "page_no"),
        text_items(t).where("label = 'text'"),
    )
)

query(
    "layout_detections",
    "B21",
    f"""SELECT document_id, pos, label, page_no,
  concat(CASE WHEN label = 'page_header' THEN 'PH' ELSE upper(substr(label, 1, 1)) END,
         CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END) AS tag
FROM (SELECT *, row_number() OVER (PARTITION BY document_id, label ORDER BY pos) AS n FROM ({D_TEXT}))""",
)(lambda t: U.layout_detections(text_items(t)))

query(
    "detections_per_page",
    "B21",
    f"SELECT document_id, page_no, label, count(*) AS detections FROM ({D_TEXT}) GROUP BY ALL",
)(lambda t: U.detections_per_page(text_items(t)))


def _pictures(t):
    pictures = t.orders.select(
        F.col("o_orderpriority").alias("document_id"), F.col("o_orderkey").alias("picture_ref"), F.lit(1).alias("page_no"),
        F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("t"), (F.col("o_custkey") % 500).cast("double").alias("r"),
                 F.lit(100.0).alias("b"), F.lit("TOPLEFT").alias("coord_origin")).alias("bbox"))
    captions = (
        t.lineitem.where("l_returnflag = 'R'")
        .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_orderpriority").alias("document_id"), F.col("l_orderkey").alias("picture_ref"),
                F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("pos"),
                F.concat(F.lit(" part "), F.col("l_partkey").cast("string")).alias("text")))
    pages = t.orders.select(F.col("o_orderpriority").alias("document_id")).distinct().select(
        "document_id", F.lit(1).alias("page_no"), F.lit(500.0).alias("width"), F.lit(400.0).alias("height"))
    return U.picture_sources(pictures, captions, pages, 0.1)


query(
    "picture_text_sources",
    "B22",
    """WITH cap AS (SELECT l_orderkey, string_agg(concat('part ', l_partkey::VARCHAR), chr(10)
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS text
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT o_orderpriority AS document_id, o_orderkey AS picture_ref,
  CASE WHEN cap.text IS NOT NULL THEN 'caption_reused' WHEN (o_custkey % 500) * 100.0 / 200000.0 < 0.1 THEN 'skipped' ELSE 'pending' END AS status,
  cap.text AS text, round((o_custkey % 500)::DOUBLE * 100.0 / 200000.0, 5) AS page_area_fraction
FROM orders LEFT JOIN cap ON cap.l_orderkey = o_orderkey""",
)(_pictures)

def captioned(t):
    """Every third text is a picture without words of its own whose captions are the texts before and after it."""
    items = text_items(t).withColumnRenamed("item_ref", "evidence_id").select("document_id", "evidence_id", "pos", "text")
    at = F.row_number().over(Window.partitionBy("document_id").orderBy("pos", "evidence_id"))
    around = Window.partitionBy("document_id").orderBy("pos", "evidence_id")
    bare = F.col("n") % 3 == 0
    return items.withColumn("n", at).select(
        "document_id", "evidence_id", "pos", F.when(bare, F.when(F.col("n") % 2 == 0, "picture").otherwise("text")).otherwise("text").alias("kind"),
        F.when(bare, F.when(F.col("n") % 2 == 0, "picture").otherwise("formula")).otherwise("text").alias("label"), F.when(bare, "").otherwise(F.col("text")).alias("text"),
        F.when(bare & (F.col("n") % 2 == 0), F.array(F.lag("evidence_id").over(around), F.lead("evidence_id").over(around))).otherwise(F.array().cast("array<string>")).alias("captions"),
    )


query(
    "search_captions",
    "B23 B24",
    f"""WITH i AS (SELECT document_id, item_ref AS evidence_id, pos, text, row_number() OVER w AS n, lag(text) OVER w AS l, lead(text) OVER w AS r, lag(item_ref) OVER w AS li, lead(item_ref) OVER w AS ri FROM ({D_TEXT}) WINDOW w AS (PARTITION BY document_id ORDER BY pos, item_ref)),
u AS (SELECT *, CASE WHEN n % 3 <> 0 THEN text WHEN n % 2 = 0 THEN coalesce(nullif(concat_ws(' ', nullif(l, ''), nullif(r, '')), ''), 'Figure · source region') ELSE 'Equation · transcription unavailable' END AS title FROM i)
SELECT document_id, evidence_id, md5(title) AS title, hit_no FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY pos, evidence_id)::INT AS hit_no FROM u WHERE contains(lower(title), 'a')) WHERE hit_no <= 200""",
)(
    lambda t: U.search_units(captioned(t), "a").select("document_id", "evidence_id", F.md5("title").alias("title"), "hit_no")
)
query(
    "search_units",
    "B23 B24",
    f"""SELECT document_id, evidence_id, title, hit_no FROM (SELECT document_id, item_ref AS evidence_id, text AS title,
  row_number() OVER (PARTITION BY document_id ORDER BY pos, item_ref)::INT AS hit_no FROM ({D_TEXT}) WHERE contains(lower(text), 'the')) WHERE hit_no <= 200""",
)(
    lambda t: U.search_units(text_items(t).withColumnRenamed("item_ref", "evidence_id"), "the", ["text"]).select(
        "document_id", "evidence_id", "title", "hit_no")
)
