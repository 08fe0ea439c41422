"""Layout scan, structural context and attribution checks on the small result table."""

import json

import pytest
from pyspark.sql import functions as F

from attesta.operators import checks as C
from attesta.operators import chunks as K
from attesta.operators import units as U
from attesta.sources import readers as R

BOX = {"l": 1.0, "t": 1.0, "r": 2.0, "b": 2.0, "coord_origin": "TOPLEFT"}


def _cell(text, r0, r1, c0, c1, **flags):
    return {"text": text, "start_row_offset_idx": r0, "end_row_offset_idx": r1, "start_col_offset_idx": c0, "end_col_offset_idx": c1, "bbox": BOX, **flags}


def layout(pages=(1,), drop_row_flag=False):
    head = {"column_header": True}
    row = {} if drop_row_flag else {"row_header": True}
    cells = [
        _cell("-", 0, 2, 0, 1, **head), _cell("A", 0, 1, 1, 2, **head), _cell("B", 0, 1, 2, 3, **head),
        _cell("Score ↑", 1, 2, 1, 2, **head), _cell("Score ↑", 1, 2, 2, 3, **head),
        _cell("Baseline", 2, 3, 0, 1, **row), _cell("0.5", 2, 3, 1, 2), _cell("0.5", 2, 3, 2, 3),
        _cell("Ours", 3, 4, 0, 1, **row), _cell("0.5", 3, 4, 1, 2), _cell("0.7 0.8", 3, 4, 2, 3),
    ]
    return {
        "schema_name": "DoclingDocument", "version": "1", "name": "paper", "origin": {"filename": "paper.pdf"},
        "pages": {str(p): {"page_no": p, "size": {"width": 10.0, "height": 20.0}} for p in (1, 2)},
        "texts": [
            {"self_ref": "#/texts/0", "label": "caption", "text": "Table 1: scores on A and B.", "prov": [{"page_no": 1, "bbox": BOX, "charspan": [0, 5]}]},
            {"self_ref": "#/texts/1", "label": "formula", "text": " ", "prov": []},
        ],
        "tables": [{"self_ref": "#/tables/0", "label": "table", "prov": [{"page_no": p, "bbox": BOX} for p in pages], "captions": [{"$ref": "#/texts/0"}],
                    "data": {"num_rows": 4, "num_cols": 3, "table_cells": cells}}],
        "pictures": [],
    }


@pytest.fixture
def load(spark, tmp_path):
    def run(doc, name="a.json"):
        (tmp_path / name).write_text(json.dumps(doc, ensure_ascii=False), encoding="utf-8")
        files = R.scan_files(spark, str(tmp_path), "*.json")
        documents, rejects = R.read_layouts(files)
        items, cells = R.layout_items(documents), R.layout_cells(documents)
        units = U.item_units(items)
        units = units.unionByName(U.cell_units(cells, units), allowMissingColumns=True)
        context = U.full_context(cells, R.layout_context(documents))
        return documents, rejects, units, context, cells

    return run


def _edges(context, unit, role):
    rows = context.where((F.col("evidence_id") == unit) & (F.col("role") == role)).orderBy("pos").collect()
    return [r.ref.split("::cell:")[-1] for r in rows]


def test_units_and_context(spark, load):
    documents, rejects, units, context, cells = load(layout())
    assert rejects.count() == 0 and documents.first().source_filename == "paper.pdf"
    value = "#/tables/0::cell:9"
    assert _edges(context, value, "column_headers") == ["1", "3"]
    assert _edges(context, value, "row_headers") == ["8"]
    assert _edges(context, value, "row_labels") == ["8"]
    assert _edges(context, value, "captions") == ["#/texts/0"]
    assert _edges(context, "#/tables/0", "cells") == [str(i) for i in range(11)]
    by_id = {r.evidence_id: r for r in units.collect()}
    assert by_id["#/tables/0::cell:10"].issues == ["multiple_numeric_values"]
    assert by_id["#/tables/0::cell:9"].locations[0].granularity == "cell"
    assert by_id["#/texts/1"].issues == ["missing_page_provenance", "empty_extracted_text"]
    pages = R.layout_pages(documents)
    assert U.integrity_violations(units, context, pages).count() == 0
    assert U.duplicate_refs(R.layout_items(documents)).count() == 0
    assert U.invalid_spans(cells, R.layout_tables(documents)).count() == 0


def test_two_page_table_keeps_table_granularity(load):
    _, _, units, _, _ = load(layout(pages=(1, 2)))
    cell = units.where("evidence_id = '#/tables/0::cell:9'").first()
    assert [p.granularity for p in cell.locations] == ["table", "table"]
    assert "cell_location_not_resolved" in cell.issues


def test_other_json_is_rejected(load):
    assert load({"schema_name": "Other", "name": "x"})[1].first().reason == "not_an_exported_layout"


def _check(spark, loaded, **change):
    documents, _, units, context, _ = loaded
    doc = documents.first().document_id
    t = "#/tables/0::cell:"
    base = {
        "method": "Ours", "dataset": "A", "metric": "Score", "direction": "higher", "raw_value": "0.5", "numeric_value": 0.5, "review_status": "unreviewed",
        "value": t + "9", "method_ref": t + "8", "metric_ref": t + "3", "dataset_ref": t + "1", "quote": None, "bound": doc,
    }
    base.update(change)
    record = spark.createDataFrame(
        [(doc, "r1", base["method"], base["dataset"], base["metric"], base["direction"], base["raw_value"], base["numeric_value"], base["review_status"], base["bound"])],
        "document_id string, result_id string, method string, dataset string, metric string, direction string, raw_value string, numeric_value double, review_status string, bound_document_id string",
    )
    links = spark.createDataFrame(
        [(doc, "r1", "value", base["value"], None), (doc, "r1", "method", base["method_ref"], None), (doc, "r1", "metric", base["metric_ref"], None), (doc, "r1", "benchmark", base["dataset_ref"], base["quote"])],
        "document_id string, result_id string, role string, evidence_id string, quote string",
    )
    return C.check_records(record, links, units, context).first()


def test_attribution_rules(spark, load):
    loaded = load(layout())
    t = "#/tables/0::cell:"
    good = _check(spark, loaded)
    assert (good.outcome, good.errors, good.warnings) == ("evidence_checks_passed", [], [])
    expected = [
        ({"method_ref": t + "5"}, {"method_not_in_value_row", "method_label_mismatch"}),
        ({"metric_ref": t + "4"}, {"metric_not_in_value_column"}),
        ({"dataset": "B", "dataset_ref": t + "2"}, {"dataset_not_in_value_column"}),
        ({"direction": "lower"}, {"metric_direction_mismatch"}),
        ({"raw_value": "0.6"}, {"raw_value_does_not_match_source_unit"}),
        ({"numeric_value": 0.51}, {"numeric_value_mismatch"}),
        ({"value": t + "8", "raw_value": "Ours", "numeric_value": None}, {"value_points_to_header", "method_not_in_value_row", "metric_not_in_value_column", "dataset_not_in_value_column"}),
        ({"value": t + "77"}, {"unknown_evidence:" + t + "77"}),
        ({"dataset_ref": "#/texts/0", "quote": "not printed"}, {"quote_not_found:#/texts/0"}),
        ({"bound": "other"}, {"conversion_identity_mismatch"}),
        ({"dataset": "Z"}, {"dataset_name_not_found_in_evidence"}),
    ]
    for change, codes in expected:
        row = _check(spark, loaded, **change)
        assert set(row.errors) == codes and row.outcome == "invalid", (change, row.errors)
    merged = _check(spark, loaded, value=t + "10", raw_value="0.7 0.8", numeric_value=0.7, dataset="B", metric_ref=t + "4", dataset_ref=t + "2")
    assert {"numeric_assignment_requires_review", "multiple_numeric_values"} <= set(merged.warnings) and merged.outcome == "needs_review"


def test_missing_row_flags_fall_back_to_labels(spark, load):
    row = _check(spark, load(layout(drop_row_flag=True)))
    assert row.warnings == ["method_row_label_inferred"] and row.outcome == "needs_review"


def test_cell_chunks_spell_out_context(load):
    _, _, units, context, _ = load(layout())
    chunk = K.cell_chunks(units, context).where("evidence_id = '#/tables/0::cell:9'").first()
    assert chunk.content.split("\n") == ["Row: Ours", "Column: A / Score ↑", "Caption: Table 1: scores on A and B.", "Extracted cell: 0.5"]
    assert (chunk.page_start, chunk.page_end) == (1, 1)
    ids = K.cell_chunks(units, context).select("chunk_id")
    assert ids.count() == ids.distinct().count() == 4


def test_display_rect(spark):
    box = spark.createDataFrame([((1.0, 19.0, 3.0, 15.0, "BOTTOMLEFT"),), ((1.0, 1.0, 30.0, 2.0, "TOPLEFT"),)], f"b {U.BBOX}")
    rows = [r.x for r in box.select(U.display_rect(F.col("b"), F.lit(10.0), F.lit(20.0)).alias("x")).collect()]
    assert (rows[0].left, round(rows[0].top, 6), round(rows[0].bottom, 6)) == (0.1, 0.05, 0.25) and rows[1] is None


def test_short_quotes_through_grams(spark):
    import random

    rng = random.Random(4)
    bodies = [("d%d" % (i % 2), f"u{i}", " ".join(rng.choice(["alpha-beta", "gammadelta", "epsilonzeta", "eta", "aaaaaaaaaaaaaa", "alphabet"]) for _ in range(rng.randrange(0, 6)))) for i in range(60)]
    needles = [(d, f"{d}{n}", q, "nowhere") for d in ("d0", "d1") for n, q in enumerate(["Alpha-Beta gammadelta", "gammadelta epsilon", "aaaaaaaaaaaa", "never anywhere", "lpha-beta gam", "epsilonzeta eta"])]
    got = U.locate_quotes(
        spark.createDataFrame(needles, "document_id string, quote_id string, quote string, source_ref string"),
        spark.createDataFrame(bodies, "document_id string, evidence_id string, text string")).collect()
    want = {(q, u) for d, q, n, _ in needles for e, u, b in bodies if d == e and n.lower() in b}
    assert {(r.quote_id, r.evidence_id) for r in got} == want and len(got) == len(want) > 20
