"""Attribution checks over the derived result grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions.stage import stage
from attesta.operators import checks as C
from attesta.operators import units as U
from attesta.plans import duck, fixtures as fx, query
from attesta.plans.evidence import D_CELLS, D_ITEMS, cells, grid_items, grid_units


def records(t):
    return t.sql(fx.RECORDS)


def links(t):
    r = records(t)
    part = lambda role, ref, quote=None: r.select(
        "document_id", "result_id", F.lit(role).alias("role"), F.col(ref).alias("evidence_id"),
        (F.col(quote) if quote else F.lit(None).cast("string")).alias("quote"))
    return (
        part("value", "value_ref").unionByName(part("method", "method_ref")).unionByName(part("metric", "metric_ref"))
        .unionByName(part("benchmark", "dataset_ref", "dataset_quote")))


def nested_records(t):
    link = lambda ref, quote=None: F.struct(
        F.col(ref).alias("evidence_id"), (F.col(quote) if quote else F.lit(None).cast("string")).alias("quote"))
    return records(t).select(
        "document_id", "result_id", link("value_ref").alias("value_evidence"), link("method_ref").alias("method_evidence"),
        F.array(link("metric_ref")).alias("metric_evidence"),
        F.struct(F.array(link("dataset_ref", "dataset_quote")).alias("evidence")).alias("benchmark"),
        F.struct(F.array(link("metric_ref")).alias("definition_evidence")).alias("metric"),
        F.array(F.struct(F.lit("split").alias("key"), F.array(link("dataset_ref", "dataset_quote")).alias("evidence"))).alias("conditions"))


def checked(t):
    context = stage(U.full_context(cells(t), t.sql(fx.ITEM_CONTEXT)))
    return C.check_records(records(t), links(t), grid_units(t), context)


def flat(df):
    return df.select("document_id", "result_id", "outcome", F.array_join("errors", ";").alias("errors"),
                     F.array_join("warnings", ";").alias("warnings"))


D_REC = duck(fx.RECORDS)
D_LINKS = """
SELECT document_id, result_id, 'value' AS role, value_ref AS evidence_id, NULL::VARCHAR AS quote FROM rec
UNION ALL SELECT document_id, result_id, 'method', method_ref, NULL FROM rec
UNION ALL SELECT document_id, result_id, 'metric', metric_ref, NULL FROM rec
UNION ALL SELECT document_id, result_id, 'benchmark', dataset_ref, dataset_quote FROM rec
"""
D_UNITS = f"""
SELECT document_id, item_ref AS evidence_id, item_ref, kind, text, page_no FROM ({D_ITEMS})
UNION ALL SELECT c.document_id, concat(c.item_ref, '::cell:', c.idx::VARCHAR), c.item_ref, 'table_cell', c.text, i.page_no
FROM ({D_CELLS}) c JOIN ({D_ITEMS}) i ON i.kind = 'table' AND i.document_id = c.document_id AND i.item_ref = c.item_ref
"""
# The oracle recomputes each rule from the construction of the grid: a price cell sits
# in column 2 under 'Price ↑' (cell 4) and the group header (cell 1) of its own brand.
D_CHECK = f"""
rec AS ({D_REC}), units AS ({D_UNITS}), lk AS ({D_LINKS}),
faults AS (SELECT l.document_id, l.result_id, CASE WHEN u.evidence_id IS NULL THEN concat('unknown_evidence:', l.evidence_id)
     WHEN l.quote IS NOT NULL AND NOT contains(u.text, l.quote) THEN concat('quote_not_found:', l.evidence_id) END AS code
  FROM lk l LEFT JOIN units u ON u.document_id = l.document_id AND u.evidence_id = l.evidence_id),
bad AS (SELECT document_id, result_id, list_sort(list_distinct(list(code))) AS errors FROM faults WHERE code IS NOT NULL GROUP BY ALL),
base AS (SELECT r.*, b.errors AS link_errors, v.text AS vtext, m.text AS mtext, x.text AS xtext, d.text AS dtext
  FROM rec r LEFT JOIN bad b USING (document_id, result_id)
  LEFT JOIN units v ON v.document_id = r.document_id AND v.evidence_id = r.value_ref
  LEFT JOIN units m ON m.document_id = r.document_id AND m.evidence_id = r.method_ref
  LEFT JOIN units x ON x.document_id = r.document_id AND x.evidence_id = r.metric_ref
  LEFT JOIN units d ON d.document_id = r.document_id AND d.evidence_id = r.dataset_ref),
rules AS (SELECT document_id, result_id, link_errors,
  list_filter([
    CASE WHEN raw_value <> vtext THEN 'raw_value_does_not_match_source_unit' END,
    CASE WHEN numeric_value <> vtext::DOUBLE THEN 'numeric_value_mismatch' END,
    CASE WHEN mtext <> method THEN 'method_label_mismatch' END,
    CASE WHEN metric_ref LIKE '%cell:3' THEN 'metric_not_in_value_column' END,
    CASE WHEN metric_ref LIKE '%cell:4' AND direction <> 'higher' THEN 'metric_direction_mismatch' END,
    CASE WHEN NOT regexp_matches(concat(' ', dtext, ' '), concat('[^A-Za-z0-9_]', dataset, '[^A-Za-z0-9_]')) THEN 'dataset_name_not_found_in_evidence' END
  ], lambda x: x IS NOT NULL) AS errors,
  list_filter([
    'cell_location_not_resolved',
    CASE WHEN numeric_value IS NULL THEN 'numeric_value_unresolved' END,
    CASE WHEN p_partkey % 3 = 0 THEN 'method_row_label_inferred' END,
    CASE WHEN metric_ref LIKE '%cell:3' THEN 'metric_header_not_unambiguous' END,
    CASE WHEN dataset = document_id AND p_partkey % 2 = 1 THEN 'dataset_column_header_not_cited' END,
    CASE WHEN review_status = 'needs_review' THEN 'annotation_requests_review' END
  ], lambda x: x IS NOT NULL) AS warnings
  FROM base),
chk AS (SELECT document_id, result_id,
  CASE WHEN link_errors IS NOT NULL THEN link_errors ELSE list_sort(errors) END AS errors,
  CASE WHEN link_errors IS NOT NULL THEN []::VARCHAR[] ELSE list_sort(warnings) END AS warnings FROM rules),
res AS (SELECT *, CASE WHEN len(errors) > 0 THEN 'invalid' WHEN len(warnings) > 0 THEN 'needs_review' ELSE 'evidence_checks_passed' END AS outcome FROM chk)
"""

query(
    "check_records",
    "C2 C3 C4 C5 C6 C7 C8 C9 C10 C11 C12 C14",
    f"WITH {D_CHECK} SELECT document_id, result_id, outcome, array_to_string(errors, ';') AS errors, array_to_string(warnings, ';') AS warnings FROM res",
)(lambda t: flat(checked(t)))

query(
    "record_links",
    "C1",
    f"""WITH rec AS ({D_REC}), lk AS ({D_LINKS})
SELECT document_id, result_id, role, evidence_id, coalesce(quote, '') AS quote, CASE role WHEN 'value' THEN 0 WHEN 'method' THEN 1 WHEN 'metric' THEN 2 ELSE 3 END AS pos FROM lk
UNION ALL SELECT document_id, result_id, 'definition', metric_ref, '', 4 FROM rec
UNION ALL SELECT document_id, result_id, 'condition', dataset_ref, coalesce(dataset_quote, ''), 5 FROM rec""",
)(lambda t: C.record_links(nested_records(t)).withColumn("quote", F.coalesce("quote", F.lit(""))))

query(
    "link_faults",
    "C3",
    f"""WITH rec AS ({D_REC}), units AS ({D_UNITS}), lk AS ({D_LINKS})
SELECT DISTINCT l.document_id, l.result_id, l.evidence_id, CASE WHEN u.evidence_id IS NULL THEN 'unknown_evidence' ELSE 'quote_not_found' END AS fault
FROM lk l LEFT JOIN units u ON u.document_id = l.document_id AND u.evidence_id = l.evidence_id
WHERE u.evidence_id IS NULL OR NOT contains(u.text, l.quote)""",
)(lambda t: C.link_faults(links(t), grid_units(t)))

query(
    "collection_violations",
    "C13",
    f"""WITH rec AS ({D_REC})
SELECT document_id AS collection_id, result_id, 'reviewer_required' AS rule FROM rec WHERE review_status = 'human_reviewed' AND reviewer IS NULL
UNION ALL SELECT document_id, method, 'duplicate_result_id' FROM rec GROUP BY document_id, method HAVING count(*) > 1
UNION ALL SELECT document_id, method, 'reviewer_required' FROM rec WHERE review_status = 'human_reviewed' AND reviewer IS NULL
UNION ALL SELECT document_id, result_id, 'record_of_other_document' FROM rec WHERE dataset <> document_id
UNION ALL SELECT document_id, method, 'record_of_other_document' FROM rec WHERE dataset <> document_id""",
)(
    lambda t: C.collection_violations(
        records(t).select(F.col("document_id").alias("collection_id"), F.col("dataset").alias("collection_document_id"), "document_id",
                          F.explode(F.array("result_id", "method")).alias("result_id"), "numeric_value", "review_status", "reviewer"))
)

query(
    "unknown_fields",
    "C13",
    "SELECT event_id, 'k' AS field FROM events WHERE json_extract(props, '$.k') IS NOT NULL",
)(lambda t: C.unknown_fields(t.events, "props", ["user_id", "ts"], ["event_id"]))

query(
    "flat_results",
    "C15 A16",
    f"""WITH {D_CHECK} SELECT r.document_id, r.result_id, r.method, r.dataset, r.metric, r.raw_value, r.numeric_value, r.direction,
  coalesce(u.page_no::VARCHAR, '') AS pages, r.value_ref AS evidence_id, c.outcome AS check_outcome, r.review_status,
  array_to_string(list_concat(c.errors, c.warnings), ';') AS issues
FROM rec r JOIN res c USING (document_id, result_id) LEFT JOIN units u ON u.document_id = r.document_id AND u.evidence_id = r.value_ref""",
)(lambda t: C.flat_results(records(t), links(t), grid_units(t), checked(t)))

query(
    "outcome_histogram",
    "C16",
    f"""WITH {D_CHECK} SELECT document_id, count(*) FILTER (WHERE outcome = 'invalid') AS invalid, count(*) FILTER (WHERE outcome = 'needs_review') AS needs_review,
  count(*) FILTER (WHERE outcome = 'evidence_checks_passed') AS evidence_checks_passed, bool_or(outcome = 'invalid') AS any_invalid FROM res GROUP BY document_id""",
)(lambda t: C.outcome_histogram(checked(t)))

query(
    "review_queue",
    "C17",
    f"""WITH {D_CHECK} SELECT document_id, result_id, outcome, method FROM res JOIN rec USING (document_id, result_id)
WHERE outcome <> 'evidence_checks_passed' AND contains(lower(concat_ws(' ', method, dataset, metric, raw_value)), 'ring')""",
)(lambda t: C.review_queue(records(t), checked(t), "ring").select("document_id", "result_id", "outcome", "method"))

query(
    "supporting_refs",
    "C18",
    f"WITH rec AS ({D_REC}) SELECT document_id, result_id, concat_ws(';', value_ref, method_ref, metric_ref, dataset_ref) AS refs FROM rec",
)(lambda t: C.supporting_refs(C.record_links(nested_records(t))).withColumn("refs", F.array_join("refs", ";")))

query(
    "comparison_listing",
    "C19",
    f"WITH rec AS ({D_REC}) SELECT document_id, result_id, method, dataset, metric, raw_value AS value, review_status FROM rec",
)(lambda t: C.comparison_listing(records(t)))
