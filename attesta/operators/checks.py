"""Attribution checks of reported results against the evidence they cite.

records(document_id, result_id, method, dataset, metric, direction, raw_value,
        numeric_value, review_status[, bound_document_id])
links(document_id, result_id, role, evidence_id, quote) with the roles value, method,
metric, benchmark, definition and condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text
from attesta.functions.skew import shuffled_join
from attesta.functions.text import header_key, sorted_distinct, strip

DOC = ["document_id"]
REC = ["document_id", "result_id"]
ROLES = ("row_headers", "row_labels", "column_headers", "captions")
# Direction arrows printed next to a metric name.
UP, DOWN = "↑", "↓"


def record_links(nested: DataFrame) -> DataFrame:
    """All evidence links of nested result records with their role."""

    def tagged(role: str, links: Column) -> Column:
        return F.transform(
            links, lambda k: F.struct(F.lit(role).alias("role"), k["evidence_id"].alias("evidence_id"), k["quote"].alias("quote"))
        )

    conditions = F.flatten(F.transform("conditions", lambda c: c["evidence"]))
    every = F.concat(
        tagged("value", F.array("value_evidence")),
        tagged("method", F.array("method_evidence")),
        tagged("metric", F.col("metric_evidence")),
        tagged("benchmark", F.col("benchmark.evidence")),
        tagged("definition", F.coalesce(F.col("metric.definition_evidence"), F.array())),
        tagged("condition", F.coalesce(conditions, F.array())),
    )
    return nested.select(*REC, F.posexplode(every).alias("pos", "k")).select(*REC, "pos", "k.*")


def link_faults(links: DataFrame, units: DataFrame) -> DataFrame:
    """Links to unknown evidence, and quotes absent from the cited text."""
    body = units.select(*DOC, "evidence_id", F.col("text").alias("body"))
    code = F.when(F.col("body").isNull(), "unknown_evidence").when(
        F.col("quote").isNotNull() & ~F.contains("body", "quote"), "quote_not_found"
    )
    return (
        shuffled_join(links, body, [*DOC, "evidence_id"], "left")
        .withColumn("fault", code)
        .where(F.col("fault").isNotNull())
        .select(*REC, "evidence_id", "fault")
        .distinct()
    )


def numbers_equal(cell_text: Column, value: Column) -> Column:
    """Decimal equality; null when either side does not fit the decimal type."""
    return cell_text.try_cast("decimal(38,18)") == value.cast("string").try_cast("decimal(38,18)")


def _link_summary(records: DataFrame, links: DataFrame, units: DataFrame, context: DataFrame) -> DataFrame:
    """One row per record: what its links show, in a single pass over the links."""
    value_refs = links.where("role = 'value'").select(*REC, F.col("evidence_id").alias("value_ref"))
    facts = units.select(
        *DOC, "evidence_id", F.col("text").alias("body"), "kind", "item_ref", "locations", "issues",
        "row_start", "column_header", "row_header", "row_section",
    )
    value = shuffled_join(
        value_refs,
        facts.select(
            *DOC,
            F.col("evidence_id").alias("value_ref"),
            F.struct("body", "kind", "item_ref", "issues", "locations", "column_header", "row_header", "row_section").alias("v"),
        ),
        [*DOC, "value_ref"],
        "left",
    )
    edges = context.where(F.col("role").isin(*ROLES)).select(
        *DOC, F.col("evidence_id").alias("value_ref"), F.col("ref").alias("evidence_id"), F.col("role").alias("rel")
    )
    named = records.select(*REC, "dataset", "metric")
    rows = shuffled_join(shuffled_join(links, value, REC), named, REC)
    rows = shuffled_join(rows, facts.drop("locations", "issues"), [*DOC, "evidence_id"], "left")
    rows = shuffled_join(rows, edges, [*DOC, "value_ref", "evidence_id"], "left")
    is_metric, is_bench = F.col("role") == "metric", F.col("role") == "benchmark"
    whole_table = (F.col("kind") == "table") & (F.col("item_ref") == F.col("v.item_ref"))
    in_column = F.coalesce(F.col("rel") == "column_headers", F.lit(False))
    matched = is_metric & (header_key("body") == header_key("metric"))
    owner = is_bench & in_column & F.coalesce(F.col("column_header"), F.lit(False)) & (
        header_key("body") == header_key("dataset")
    )
    # An edge role may repeat a link row, so "not in the column" is settled per link first.
    per_link = rows.groupBy(*REC, "role", "evidence_id", "quote").agg(
        F.first("v").alias("v"),
        F.first("body").alias("body"),
        F.bool_or(F.col("rel") == "row_headers").alias("in_row_headers"),
        F.bool_or(F.col("rel") == "row_labels").alias("in_row_labels"),
        F.bool_or(in_column).alias("in_column"),
        F.bool_or(in_column | (F.col("rel") == "captions")).alias("associated"),
        F.bool_or(whole_table).alias("whole_table"),
        F.bool_or(matched).alias("matched"),
        F.bool_or(owner).alias("owner"),
        F.bool_or(
            is_bench & text.contains_word(F.lower(F.coalesce("body", F.lit(""))), F.lower("dataset"))
        ).alias("named"),
    )
    method, metric, bench = F.col("role") == "method", F.col("role") == "metric", F.col("role") == "benchmark"
    yes = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return per_link.groupBy(*REC).agg(
        F.first("v").alias("v"),
        F.collect_set(
            F.when(F.col("body").isNull(), F.concat(F.lit("unknown_evidence:"), "evidence_id")).when(
                F.col("quote").isNotNull() & ~F.contains("body", "quote"), F.concat(F.lit("quote_not_found:"), "evidence_id")
            )
        ).alias("link_errors"),
        F.max(F.when(method, F.col("body"))).alias("method_text"),
        yes(method & F.col("in_row_headers")).alias("method_in_headers"),
        yes(method & F.col("in_row_labels")).alias("method_in_labels"),
        yes(metric & F.col("whole_table")).alias("metric_whole_table"),
        yes(metric & ~F.col("in_column") & ~F.coalesce("whole_table", F.lit(False))).alias("metric_elsewhere"),
        yes(metric & F.col("matched")).alias("metric_matched"),
        yes(metric & F.col("matched") & F.contains("body", F.lit(UP))).alias("metric_up"),
        yes(metric & F.col("matched") & F.contains("body", F.lit(DOWN))).alias("metric_down"),
        yes(bench & F.col("named")).alias("dataset_named"),
        yes(bench & F.col("associated")).alias("dataset_associated"),
        yes(F.col("owner")).alias("dataset_owner_cited"),
    )


def _dataset_headers(records: DataFrame, links: DataFrame, units: DataFrame, context: DataFrame) -> DataFrame:
    """Whether the value's table has a header naming the dataset, and one owning its column."""
    values = shuffled_join(links.where("role = 'value'"), records.select(*REC, header_key("dataset").alias("key")), REC)
    cells = units.where("kind = 'table_cell'").select(*DOC, "evidence_id", "item_ref")
    values = shuffled_join(values, cells, [*DOC, "evidence_id"]).select(*REC, "key", "item_ref", F.col("evidence_id").alias("value_ref"))
    headers = units.where("kind = 'table_cell' AND column_header").select(
        *DOC, "item_ref", header_key("text").alias("key"), F.col("evidence_id").alias("ref")
    )
    named = headers.select(*DOC, "item_ref", "key").distinct()
    own = context.where("role = 'column_headers'").select(*DOC, F.col("evidence_id").alias("value_ref"), "ref")
    owned = (
        shuffled_join(values, own, [*DOC, "value_ref"])
        .join(headers, [*DOC, "item_ref", "key", "ref"], "left_semi")
        .select(*REC)
        .distinct()
        .withColumn("dataset_in_column", F.lit(True))
    )
    headed = values.join(named, [*DOC, "item_ref", "key"], "left_semi").select(*REC).distinct().withColumn("dataset_has_header", F.lit(True))
    return shuffled_join(headed, owned, REC, "left")


def check_records(
    records: DataFrame,
    links: DataFrame,
    units: DataFrame,
    context: DataFrame,
    supplied_roles: DataFrame | None = None,
) -> DataFrame:
    """Outcome, errors and warnings of every record.

    `supplied_roles(document_id, role)` names the context roles a producer delivers;
    by default every role is assumed to be present, as in indexes built here.
    """
    summary = _link_summary(records, links, units, context)
    owners = _dataset_headers(records, links, units, context)
    base = shuffled_join(shuffled_join(records, summary, REC, "left"), owners, REC, "left")
    if supplied_roles is None:
        base = base.withColumn("__roles", F.array(*[F.lit(r) for r in ROLES]))
    else:
        base = base.join(supplied_roles.groupBy(*DOC).agg(F.collect_set("role").alias("__roles")), DOC, "left")
    has = lambda role: F.array_contains("__roles", role)
    cell = F.col("v.kind") == "table_cell"
    body = strip(F.col("v.body"))
    single = body.rlike(text.SINGLE_NUMBER)
    same = numbers_equal(body, F.col("numeric_value"))
    number = F.col("numeric_value").isNotNull()
    no_row = ~has("row_headers") & ~has("row_labels")
    in_headers, in_labels = F.col("method_in_headers"), F.col("method_in_labels")
    headed = cell & F.coalesce("dataset_has_header", F.lit(False))
    in_col = F.coalesce("dataset_in_column", F.lit(False))
    wrong_way = (F.col("metric_up") & (F.col("direction") != "higher")) | (
        F.col("metric_down") & (F.col("direction") != "lower")
    )
    header_value = F.col("v.column_header") | F.col("v.row_header") | F.col("v.row_section")
    errors = text.codes(
        (strip("raw_value") != body, "raw_value_does_not_match_source_unit"),
        (number & single & ~same, "numeric_value_mismatch"),
        (cell & header_value, "value_points_to_header"),
        (cell & ~no_row & ~in_headers & ~in_labels, "method_not_in_value_row"),
        (cell & (header_key("method_text") != header_key("method")), "method_label_mismatch"),
        (cell & has("column_headers") & F.col("metric_elsewhere"), "metric_not_in_value_column"),
        (cell & wrong_way, "metric_direction_mismatch"),
        (headed & has("column_headers") & ~in_col, "dataset_not_in_value_column"),
        (~F.col("dataset_named"), "dataset_name_not_found_in_evidence"),
    )
    warnings = text.codes(
        (number & (~single | same.isNull()), "numeric_assignment_requires_review"),
        (~number, "numeric_value_unresolved"),
        (cell & no_row, "method_row_context_missing"),
        (cell & ~no_row & ~in_headers & in_labels, "method_row_label_inferred"),
        (cell & F.col("metric_whole_table"), "metric_requires_table_layout_review"),
        (cell & ~has("column_headers"), "metric_column_context_missing"),
        (cell & ~F.col("metric_matched"), "metric_header_not_unambiguous"),
        (headed & ~has("column_headers"), "dataset_column_context_missing"),
        (headed & has("column_headers") & in_col & ~F.col("dataset_owner_cited"), "dataset_column_header_not_cited"),
        (~cell, "non_table_assignment_not_semantically_checked"),
        (~F.col("dataset_associated"), "dataset_evidence_not_structurally_associated"),
        (F.col("review_status") == "needs_review", "annotation_requests_review"),
    )
    foreign = F.lit(False)
    if "bound_document_id" in records.columns:
        foreign = F.col("bound_document_id") != F.col("document_id")
    none = F.array().cast("array<string>")
    broken = F.size("link_errors") > 0
    found = (
        F.when(foreign, F.array(F.lit("conversion_identity_mismatch"))).when(broken, F.col("link_errors")).otherwise(errors)
    )
    noted = F.when(foreign | broken, none).otherwise(F.concat(warnings, F.coalesce("v.issues", none)))
    outcome = (
        F.when(F.size("errors") > 0, "invalid").when(F.size("warnings") > 0, "needs_review").otherwise("evidence_checks_passed")
    )
    return (
        base.select(*REC, sorted_distinct(found).alias("errors"), sorted_distinct(noted).alias("warnings"))
        .withColumn("outcome", outcome)
    )


def collection_violations(records: DataFrame) -> DataFrame:
    """Contract breaches of a result collection, one row per record and rule.

    records(collection_id, collection_document_id, document_id, result_id, numeric_value,
    review_status, reviewer)
    """
    repeated = (
        records.groupBy("collection_id", "result_id").agg(F.count("*").alias("n")).where("n > 1")
        .select("collection_id", "result_id", F.lit("duplicate_result_id").alias("rule"))
    )
    rules = text.codes(
        (F.col("document_id") != F.col("collection_document_id"), "record_of_other_document"),
        ((F.col("review_status") == "human_reviewed") & (F.coalesce("reviewer", F.lit("")) == ""), "reviewer_required"),
        (F.isnan("numeric_value") | (F.abs("numeric_value") == float("inf")), "non_finite_number"),
    )
    return repeated.unionByName(
        records.select("collection_id", "result_id", F.explode(rules).alias("rule"))
    )


def unknown_fields(raw: DataFrame, json_col: str, allowed: list[str], keys: list[str]) -> DataFrame:
    """Object keys outside a strict contract; JSON parsing alone would drop them silently."""
    extra = F.array_except(F.json_object_keys(json_col), F.array(*[F.lit(a) for a in allowed]))
    return raw.select(*keys, F.explode(extra).alias("field"))


def flat_results(records: DataFrame, links: DataFrame, units: DataFrame, checks: DataFrame) -> DataFrame:
    """One exportable row per record: pages, outcome, review and issues."""
    value = links.where("role = 'value'").select(*REC, "evidence_id")
    places = units.select(*DOC, "evidence_id", F.col("locations.page_no").alias("page_nos"))
    pages = F.array_join(F.transform(sorted_distinct(F.col("page_nos")), lambda p: p.cast("string")), ",")
    placed = shuffled_join(shuffled_join(records, value, REC), places, [*DOC, "evidence_id"], "left")
    return (
        shuffled_join(placed, checks, REC)
        .select(
            *REC,
            "method",
            "dataset",
            "metric",
            "raw_value",
            "numeric_value",
            "direction",
            F.coalesce(pages, F.lit("")).alias("pages"),
            "evidence_id",
            F.col("outcome").alias("check_outcome"),
            "review_status",
            F.array_join(F.concat("errors", "warnings"), ";").alias("issues"),
        )
    )


def outcome_histogram(checks: DataFrame) -> DataFrame:
    return checks.groupBy(*DOC).agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("invalid", "needs_review", "evidence_checks_passed")],
        F.bool_or(F.col("outcome") == "invalid").alias("any_invalid"),
    )


def review_queue(records: DataFrame, checks: DataFrame, needle: str = "") -> DataFrame:
    """Records whose check did not pass, optionally matching a substring."""
    open_ids = checks.where("outcome <> 'evidence_checks_passed'").select(*REC, "outcome")
    label = F.lower(F.concat_ws(" ", "method", "dataset", "metric", "raw_value"))
    return shuffled_join(records.where(F.contains(label, F.lit(needle.lower()))), open_ids, REC)


def supporting_refs(links: DataFrame) -> DataFrame:
    """Evidence references of a record, first occurrence order, no repeats."""
    order = {"value": 0, "method": 1, "metric": 2, "benchmark": 3, "definition": 4, "condition": 5}
    rank = F.coalesce(*[F.when(F.col("role") == r, n) for r, n in order.items()])
    # Dealt by record first: aggregates of structs sort, and a small file would sort all of its links in one task.
    ranked = links.repartition(*REC).groupBy(*REC, "evidence_id").agg(F.min(F.struct(rank.alias("a"), F.coalesce("pos", F.lit(0)).alias("b"))).alias("o"))
    return ranked.groupBy(*REC).agg(
        F.sort_array(F.collect_list(F.struct("o", "evidence_id"))).alias("s")
    ).select(*REC, F.col("s.evidence_id").alias("refs"))


def comparison_listing(records: DataFrame) -> DataFrame:
    """Rows of all papers side by side; comparability is not judged."""
    return records.select(
        *REC, "method", "dataset", "metric", F.col("raw_value").alias("value"), "review_status"
    )
