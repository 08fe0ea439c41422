"""Result collections, ledgers, catalog and directory scans."""

import json

import pytest
from pyspark.sql import functions as F

from attesta.operators import checks as C
from attesta.operators import ledger as L
from attesta.sources import readers as R


def _record(**change):
    link = {"evidence_id": "e1", "quote": None}
    record = {
        "result_id": "r1", "document_id": "d" * 64, "method": {"reported": "Ours"}, "role": "main",
        "benchmark": {"dataset": {"reported": "A"}, "evidence": [link]},
        "metric": {"name": {"reported": "Score"}, "direction": "higher", "definition_evidence": []},
        "value": {"raw": "0.5", "numeric": 0.5}, "value_evidence": link, "method_evidence": link, "metric_evidence": [link],
        "conditions": [{"key": "split", "value": "test", "basis": "reported", "evidence": [link]}], "review": {"status": "unreviewed"}, "notes": [],
    }
    return {**record, **change}


def _collection(record):
    return {"schema_version": "1", "document_id": "d" * 64, "run": {"extractor": "x", "created_at": "2024-01-01T00:00:00Z", "configuration": {}}, "records": [record]}


def test_results_are_read_with_a_strict_schema(spark, tmp_path):
    (tmp_path / "ok.json").write_text(json.dumps(_collection(_record())))
    rows = R.read_results(spark, str(tmp_path / "ok.json")).select(F.inline("records"))
    links = C.record_links(rows)
    assert [(r.role, r.evidence_id) for r in links.orderBy("pos").collect()] == [(k, "e1") for k in ("value", "method", "metric", "benchmark", "condition")]
    (tmp_path / "bad.json").write_text(json.dumps(_collection(_record(value={"raw": "0.5", "numeric": "half"}))))
    with pytest.raises(Exception):
        R.read_results(spark, str(tmp_path / "bad.json")).select(F.inline("records")).collect()


def test_ledger_scan_and_unresolved_failures(spark, tmp_path):
    calls = [
        {"status": "failed", "request_hash": "a", "logical_request_hash": "g", "reserved_tokens": 10, "model": "m", "seconds": 1.0},
        {"status": "completed", "request_hash": "b", "logical_request_hash": "g", "usage": {"total_tokens": 7}, "model": "m", "seconds": 2.0},
        {"status": "failed", "request_hash": "c", "reserved_tokens": 5, "model": "m", "seconds": 1.0}, {"status": "cache_hit", "request_hash": "b", "model": "m"},
    ]
    (tmp_path / "calls.json").write_text(json.dumps({"completion_calls": calls, "elapsed_seconds": 4.0}))
    rows = R.read_ledger(spark, str(tmp_path)).withColumnRenamed("logical_request_hash", "logical_hash").withColumn("used_tokens", F.col("usage.total_tokens"))
    assert [r.request_hash for r in L.unresolved_failures(rows).collect()] == ["c"]
    total = L.usage(rows, ["model"]).first()
    assert (total.real_calls, total.cache_hits, total.tokens, total.failures) == (3, 1, 22, 2)


def test_directory_manifest(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"1")
    (tmp_path / "b.bin").write_bytes(b"2")
    before = R.scan_files(spark, str(tmp_path)).select("path", "sha256").collect()
    frozen = spark.createDataFrame(before)
    (tmp_path / "a.bin").write_bytes(b"3")
    (tmp_path / "c.bin").write_bytes(b"4")
    changes = {r.path.rsplit("/", 1)[1]: r.change for r in R.fingerprint_changes(frozen, R.scan_files(spark, str(tmp_path))).collect()}
    assert changes == {"a.bin": "altered", "c.bin": "added"}


def test_arxiv_reasons(spark):
    values = ["2401.00001v2", "arxiv:cs/0101001", "http://arxiv.org/abs/2401.00001", "https://arxiv.org/list/cs", "https://arxiv.org/pdf/2401.00001.pdf", "2401.1"]
    rows = R.arxiv_identifiers(spark.createDataFrame([(v,) for v in values], "v string"), "v").collect()
    assert [(r.arxiv_id, r.reason) for r in rows] == [
        ("2401.00001v2", None), ("cs/0101001", None), (None, "not_an_https_arxiv_url"), (None, "not_an_abs_or_pdf_url"), ("2401.00001", None), (None, "invalid_identifier")]


def test_damaged_lines_are_listed_with_their_place(spark, tmp_path):
    good = [json.dumps({"chunk_id": f"c{i}", "contextualized_text": "é" * i, "source_refs": ["r"]}, ensure_ascii=False) for i in range(40)]
    bad = ['{"chunk_id": "x"', '{"chunk_id": "x", "contextualized_text": "t"}', '{"chunk_id": "x", "contextualized_text": "t", "source_refs": 5}', "[1]"]
    lines = [*good[:10], bad[0], "", *good[10:20], bad[1], bad[2], *good[20:], bad[3]]
    for name, text in (("a.jsonl", "\n".join(lines) + "\n"), ("b.jsonl", "\n".join(reversed(lines)))):
        (tmp_path / name).write_bytes(text.encode())
    schema = "chunk_id string, contextualized_text string, source_refs array<string>"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert sorted(r.chunk_id for r in R.read_chunks(spark, str(tmp_path), schema).collect()) == sorted(f"c{i}" for i in [*range(40), *range(40)])
        found = R.quarantine(spark, str(tmp_path), schema, R.CHUNK_FIELDS).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.reason for r in found) == sorted(["not_json", "without_source_refs", "not_of_the_schema", "not_of_the_schema"] * 2)
    for r in found:
        content = (tmp_path / r.path.rsplit("/", 1)[1]).read_bytes()
        assert content[r.offset :].split(b"\n")[0].decode() == r.value


def test_repeated_load_is_not_confined_to_a_few_tasks(spark, monkeypatch):
    """The load that is repeated is dealt by key over the session's partitions, not over a fixed number of tasks."""
    from attesta.plans import REGISTRY, registered, sourcing  # noqa: F401

    loads, write = [], sourcing.S.write_chunks
    monkeypatch.setattr(sourcing.S, "write_chunks", lambda chunks, path: loads.append(chunks) or write(chunks, path))
    assert {r.versions for r in REGISTRY.queries["published_chunks"](spark, "/root/testdata/sf0.001").collect()} == {"0,1,None"}
    assert "RepartitionByExpression [chunk_id" in loads[2]._jdf.queryExecution().optimizedPlan().toString()
