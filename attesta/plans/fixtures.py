"""Model tables derived from the driver's tables.

The statements are plain SQL understood by both engines, so a registered query and
its oracle start from the same rows while the operators themselves are written twice.
"""

from __future__ import annotations

# A paper per brand, a result table per part type, three grid rows per part: an
# optional section row, the part's own row, and (at the top) two header rows.
GRID_BASE = """
  SELECT p_brand AS document_id, concat('#/tables/', p_type) AS item_ref, p_partkey, p_name, p_size, p_retailprice,
         CAST(p_partkey * 2 + 3 AS INT) AS r
  FROM {part}
"""

CELLS = f"""
WITH g AS ({GRID_BASE}),
heads AS (SELECT document_id, item_ref FROM g GROUP BY document_id, item_ref)
SELECT document_id, item_ref, 0 AS idx, 0 AS row_start, 1 AS row_end, 0 AS col_start, 1 AS col_end,
       true AS column_header, false AS row_header, false AS row_section, '-' AS text FROM heads
UNION ALL SELECT document_id, item_ref, 1, 0, 1, 1, 3, true, false, false, document_id FROM heads
UNION ALL SELECT document_id, item_ref, 2, 0, 1, 3, 4, true, false, false, 'Codes' FROM heads
UNION ALL SELECT document_id, item_ref, 3, 1, 2, 1, 2, true, false, false, 'Size ↓' FROM heads
UNION ALL SELECT document_id, item_ref, 4, 1, 2, 2, 3, true, false, false, 'Price ↑' FROM heads
UNION ALL SELECT document_id, item_ref, CAST(p_partkey * 8 + 8 AS INT), r - 1, r, 0, 4, false, false, true, concat('Group ', p_name)
  FROM g WHERE p_size % 10 = 0
UNION ALL SELECT document_id, item_ref, CAST(p_partkey * 8 + 9 AS INT), r, r + 1, 0, 1, false, p_partkey % 3 <> 0, false, p_name FROM g
UNION ALL SELECT document_id, item_ref, CAST(p_partkey * 8 + 10 AS INT), r, r + 1, 1, 2, false, false, false, CAST(p_size AS STRING) FROM g
UNION ALL SELECT document_id, item_ref, CAST(p_partkey * 8 + 11 AS INT), r, r + 1, 2, 3, false, false, false,
                 concat(CAST(CAST(floor(p_retailprice) AS INT) AS STRING), '.5') FROM g
UNION ALL SELECT document_id, item_ref, CAST(p_partkey * 8 + 12 AS INT), r,
                 CASE WHEN p_partkey % 7 = 0 THEN r + 2 ELSE r + 1 END, 3, 4, false, false, false,
                 CASE WHEN p_partkey % 5 = 0 THEN concat(CAST(p_size AS STRING), ' ', CAST(p_partkey AS STRING)) ELSE 'n/a' END FROM g
"""

TABLES = f"""
WITH g AS ({GRID_BASE})
SELECT document_id, item_ref, CAST(max(r) + 1 AS INT) AS num_rows, 4 AS num_cols FROM g GROUP BY document_id, item_ref
"""

# Captions: a text item per table, on the same page as the table.
TABLE_ITEMS = f"""
WITH g AS ({GRID_BASE}),
h AS (SELECT document_id, item_ref, min(p_partkey) AS k, CAST(max(p_size) AS INT) AS page_no FROM g GROUP BY document_id, item_ref)
SELECT document_id, CAST(k * 2 AS BIGINT) AS pos, replace(item_ref, 'tables', 'texts') AS item_ref, 'text' AS kind, 'caption' AS label,
       concat('Table ', CAST(k AS STRING), '. Sizes and prices on ', document_id, '.') AS text, page_no FROM h
UNION ALL
SELECT document_id, CAST(k * 2 + 1 AS BIGINT), item_ref, 'table', 'table', '', page_no FROM h
"""

ITEM_CONTEXT = f"""
WITH g AS ({GRID_BASE})
SELECT DISTINCT document_id, item_ref, 'captions' AS role, replace(item_ref, 'tables', 'texts') AS ref, CAST(0 AS BIGINT) AS pos FROM g
"""

GRID_PAGES = f"""
WITH g AS ({GRID_BASE})
SELECT DISTINCT document_id, CAST(p_size AS INT) AS page_no, CAST(600 AS DOUBLE) AS width, CAST(800 AS DOUBLE) AS height FROM g
"""

# One claimed result per part, some of them deliberately wrong.
RECORDS = f"""
WITH g AS ({GRID_BASE})
SELECT concat('r', CAST(p_partkey AS STRING)) AS result_id, document_id, item_ref, p_partkey,
       CASE WHEN p_partkey % 11 = 0 THEN concat(p_name, ' x') ELSE p_name END AS method,
       CASE WHEN p_partkey % 13 = 0 THEN 'Brand#99' ELSE document_id END AS dataset,
       'Price' AS metric,
       CASE WHEN p_partkey % 17 = 0 THEN 'lower' ELSE 'higher' END AS direction,
       concat(CAST(CAST(floor(p_retailprice) AS INT) AS STRING), CASE WHEN p_partkey % 19 = 0 THEN '.6' ELSE '.5' END) AS raw_value,
       CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE CAST(floor(p_retailprice) + CASE WHEN p_partkey % 29 = 0 THEN 0.25 ELSE 0.5 END AS DOUBLE) END AS numeric_value,
       concat(item_ref, '::cell:', CAST(CASE WHEN p_partkey % 31 = 0 THEN 99999999 ELSE p_partkey * 8 + 11 END AS STRING)) AS value_ref,
       concat(item_ref, '::cell:', CAST(p_partkey * 8 + 9 AS STRING)) AS method_ref,
       concat(item_ref, '::cell:', CASE WHEN p_partkey % 37 = 0 THEN '3' ELSE '4' END) AS metric_ref,
       CASE WHEN p_partkey % 2 = 0 THEN concat(item_ref, '::cell:1') ELSE replace(item_ref, 'tables', 'texts') END AS dataset_ref,
       CASE WHEN p_partkey % 2 = 0 THEN NULL WHEN p_partkey % 41 = 0 THEN 'not there' ELSE 'Sizes and prices' END AS dataset_quote,
       CASE WHEN p_partkey % 3 = 0 THEN 'needs_review' WHEN p_partkey % 3 = 1 THEN 'human_reviewed' ELSE 'unreviewed' END AS review_status,
       CASE WHEN p_partkey % 6 = 1 THEN 'reviewer' END AS reviewer
FROM g
"""

# The document corpus as text items: `source` is the paper, `doc_id` the item.
TEXT_ITEMS = """
SELECT source AS document_id, doc_id AS pos, concat('#/texts/', CAST(doc_id AS STRING)) AS item_ref, 'text' AS kind,
       CASE WHEN doc_id % 10 = 0 THEN 'section_header' WHEN doc_id % 10 = 3 THEN 'page_header' WHEN doc_id % 10 = 7 THEN 'formula'
            ELSE 'text' END AS label,
       text, lang, n_chars, CAST(1 + doc_id % 40 AS INT) AS page_no, CAST(1 + (doc_id / 10) % 3 AS INT) AS level
FROM {documents}
"""

# Questions: user turns, asked about one of the papers.
QUESTIONS = """
SELECT conv_id * 1000 + turn AS question_id, conv_id, turn, text AS question FROM {conversations} WHERE role = 'user'
"""

# Graph: suppliers and parts as entities, line items as relation occurrences.
GRAPH_ENTITIES = """
SELECT concat('s', CAST(s_suppkey AS STRING)) AS id, s_name AS title, concat('NATION_', CAST(s_nationkey AS STRING)) AS type FROM {supplier}
UNION ALL
SELECT concat('p', CAST(p_partkey AS STRING)), concat(p_name, ' ', CAST(p_partkey AS STRING)), p_type FROM {part}
"""

GRAPH_OCCURRENCES = """
SELECT concat('s', CAST(l_suppkey AS STRING)) AS source, concat('p', CAST(l_partkey AS STRING)) AS target,
       concat('u', CAST(l_orderkey AS STRING)) AS unit_id, CAST(1 AS BIGINT) AS weight
FROM {lineitem}
"""

# Ledger: one provider call per event.
CALLS = """
SELECT event_id AS call_id, ts, CAST(user_id AS STRING) AS logical_hash,
       concat(CAST(user_id AS STRING), '-', props) AS request_hash,
       CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'cache_hit' WHEN 'error' THEN 'failed'
            WHEN 'view' THEN 'started' ELSE 'completed' END AS status,
       CASE WHEN event_type IN ('purchase', 'click') THEN CAST(floor(value * 10) AS BIGINT) END AS used_tokens,
       CAST(floor(value * 12) AS BIGINT) AS reserved_tokens, concat('model-', CAST(user_id % 3 AS STRING)) AS model, value AS seconds
FROM {events}
"""
