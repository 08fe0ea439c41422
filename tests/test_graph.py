"""Extraction contracts, relations, components, ledger, streaming and sinks."""

import pytest
from pyspark.sql import functions as F

from attesta.operators import communities as C
from attesta.operators import evaluation as E
from attesta.operators import extraction as X
from attesta.operators import graph_tables as G
from attesta.operators import ledger as L
from attesta.operators import relations as R
from attesta.operators import research as S
from attesta.sources import publishing as P
from attesta.sources import sinks
from attesta.streaming import jobs

ENT = "response_id int, pos int, name string, type string, description string"
REL = "response_id int, pos int, source string, target string, kind string, scope string, description string, evidence string"


def _reason(spark, passage, entities, relation, version=3, previous=None):
    responses = spark.createDataFrame([(1, passage)], "response_id int, source string")
    e = spark.createDataFrame([(1, i, n, t, "d") for i, (n, t) in enumerate(entities)], ENT)
    r = spark.createDataFrame([(1, 0, *relation)], REL)
    checked = X.check_entities(e, responses, version)
    names, conflicts = checked.where("reason IS NULL"), None
    if previous:
        p = spark.createDataFrame([(1, i, n, t, "d") for i, (n, t) in enumerate(previous)], ENT)
        inherited, conflicts = X.inherited_entities(checked, p, responses)
        names = names.unionByName(inherited, allowMissingColumns=True)
    return X.check_relations(r, names, responses, version, conflicts).first().reason


def test_relation_rules(spark):
    M, D, K = ("Net", "Method"), ("Data", "Dataset"), ("Score", "Metric")
    text = "Net is trained on Data.\n\nScore is reported. Net starts from Base and from Core."
    ok = ("Net", "Data", "TRAINED_ON", "method", "d", "Net is trained on Data.")
    assert _reason(spark, text, [M, D], ok) is None
    assert _reason(spark, text, [M], ok) == "endpoint_not_declared"
    assert _reason(spark, text, [M], ok, previous=[D]) is None
    assert _reason(spark, text, [M, D], ok, previous=[("Net", "Tool")]) == "conflicting_endpoint_type"
    assert _reason(spark, text, [M, D], ("Net", "Data", "TRAINED_ON", "method", "d", "never printed here")) == "quote_not_in_source"
    assert _reason(spark, text, [M, ("Base", "Method")], ("Net", "Base", "INITIALIZED_FROM", "method", "d", "Net starts from Base and from Core.")) is None
    assert _reason(spark, text, [M, ("Base", "Method")], ("Net", "Base", "INITIALIZED_FROM", "method", "d", "Net starts from Base and from Core."), 2) == "initialization_not_stated"
    assert _reason(spark, text, [M, K], ("Net", "Score", "USES", "method", "d", "Score is reported.")) == "metric_dependency_subject"
    assert _reason(spark, text, [("Data", "Metric"), K], ("Score", "Data", "DERIVED_FROM", "method", "d", "Score is reported.")) == "metric_derivation_across_paragraphs"
    row = "Row label: Net\nScore 3 Other"
    assert _reason(spark, row, [("Other", "Method"), K], ("Other", "Score", "REPORTS", "evaluation", "d", "Score 3")) == "not_the_row_owner"
    assert _reason(spark, row + "\nTABLE_METRIC_ALIGNMENT: ambiguous", [M, K], ("Net", "Score", "REPORTS", "evaluation", "d", "Score 3")) == "ambiguous_table_alignment"
    gen = "Paper title: Net\nSection: A DATASET GENERATOR\nNet uses Tool"
    assert _reason(spark, gen, [M, ("Tool", "Tool")], ("Net", "Tool", "USES", "method", "d", "Net uses Tool")) == "generator_scope"
    assert _reason(spark, gen, [M, ("Tool", "Tool")], ("Net", "Tool", "USES", "definition", "d", "Net uses Tool")) == "generator_assigned_to_method"


def test_entity_rules_and_tuples(spark):
    responses = spark.createDataFrame([(1, "Net beats Smith et al., 2020 in Table 3 and Fig. 2.")], "response_id int, source string")
    e = spark.createDataFrame([(1, 0, "Net", "Method", "d"), (1, 1, "Smith et al., 2020", "Method", "d"), (1, 2, "Table 3", "Concept", "d"), (1, 3, "beats", "Tool", "a##b"), (1, 4, "absent", "Tool", "d")], ENT)
    checked = X.check_entities(e, responses)
    assert {r.pos: r.reason for r in checked.collect()} == {0: None, 1: "author_year_citation", 2: "document_reference", 3: "delimiter_in_entity", 4: "name_absent_from_source"}
    none = X.check_relations(spark.createDataFrame([], REL), checked.where("reason IS NULL"), responses)
    text = X.serialize(responses, checked.where("reason IS NULL").withColumn("part", F.lit(0)), none).first().canonical
    assert text == '("entity"<|>Net<|>Method<|>d)\n##\n<|COMPLETE|>\n##\n'
    messages = spark.createDataFrame([(1, "assistant", text.replace("Method", "METHOD"))], "response_id int, role string, content string")
    assert [(r.name, r.type) for r in X.declared_in_tuples(messages).collect()] == [("Net", "Method")]


def test_quoted_relations(spark):
    p = spark.createDataFrame(
        [("d", "b", 1, "Net-2", "Method", "BUILT_ON", "Base", "Method", "e"), ("d", "b", 2, "Net", "Method", "BUILT_ON", "Base", "Method", "e"), ("d", "b", 3, "Net-2", "Method", "TRAINED_ON", "Web", "Dataset", "e")],
        "document_id string, batch_id string, rel_id int, subject string, subject_kind string, predicate string, object string, object_kind string, explanation string",
    )
    q = spark.createDataFrame([("d", "b", 1, 0, "u1", "Net-2 is fine-tuned from Base"), ("d", "b", 2, 0, "u1", "Net-2 is fine-tuned from Base"), ("d", "b", 3, 0, "u2", "Net-2 was never trained on Web")], "document_id string, batch_id string, rel_id int, pos int, source_ref string, quote string")
    u = spark.createDataFrame([("d", "u1", "Here Net-2 is fine-tuned  from Base."), ("d", "u2", "Net-2 was never trained on Web")], "document_id string, evidence_id string, text string")
    allowed = spark.createDataFrame([("d", "b", "u1"), ("d", "b", "u2")], "document_id string, batch_id string, ref string")
    rows = {r.rel_id: r for r in R.check_proposals(p, q, u, allowed).collect()}
    assert rows[1].accepted
    assert rows[2].reasons == ["endpoint_names_missing_from_quotations"]
    assert rows[3].reasons == ["negated_training_requires_review"]
    catalog = spark.createDataFrame([("d", "Net-2", "Method")], "document_id string, name string, kind string")
    assert "training_dataset_not_in_named_catalog" in {r.rel_id: r for r in R.check_proposals(p, q, u, allowed, catalog).collect()}[3].reasons


def test_edge_assessment(spark):
    cols = "document_id string, id string, label string, name string, statement string, cell_ref string, reported_value string, row_label string, column_label string, table_label string, experiment_name string, role string, support_status string, linkage string, anchors long"
    row = lambda i, label, name, **k: ("d", i, label, name, None, None, k.get("v"), k.get("row"), k.get("col"), None, k.get("exp"), k.get("role"), k.get("st", "source_linked"), "x", k.get("a", 1))
    nodes = spark.createDataFrame([
        row("p", "ResearchPaper", "Paper", a=0, st="needs_review"), row("m", "Method", "Net", role="proposed"), row("b", "Method", "Base"), row("c", "MethodConfiguration", "Ours", exp="E"),
        row("x", "Experiment", "E"), row("k", "Metric", "Score"), row("v", "Measurement", None, row="Ours", col="Score", exp="E"), row("bad", "Concept", "Oops", st="rejected")], cols)
    edges = spark.createDataFrame([("d", i, s, t, lab) for i, (s, t, lab) in enumerate([
        ("m", "b", "BUILT_ON"), ("p", "m", "DISCUSSES_METHOD"), ("c", "m", "CONFIGURATION_OF"), ("v", "k", "USES_METRIC"), ("v", "c", "FOR_CONFIGURATION"), ("x", "c", "EVALUATES"),
        ("m", "bad", "USES_CONCEPT"), ("m", "k", "TRAINED_ON"), ("x", "v", "REPORTS_MEASUREMENT"), ("b", "m", "BUILT_ON")])], "document_id string, edge_id int, source string, target string, label string")
    anchors = spark.createDataFrame([("d", "m", "u1", "quote_match"), ("d", "b", "u2", "quote_match")], "document_id string, id string, ref string, linkage string")
    units = spark.createDataFrame([("d", "u1", "Net uses the Base backbone"), ("d", "u2", "Base alone")], "document_id string, evidence_id string, text string")
    got = {r.edge_id: r.support_status for r in S.assess_edges(edges, nodes, anchors, units).collect()}
    assert got == {0: "source_linked", 1: "source_linked", 2: "source_linked", 3: "cell_grounded", 4: "cell_grounded", 5: "source_linked", 6: "rejected", 7: "rejected", 8: "cell_grounded", 9: "needs_review"}
    usable, good = S.usable_graph(nodes, S.assess_edges(edges, nodes, anchors, units))
    assert good.count() == 7 and "bad" not in {r.id for r in usable.collect()}


def test_components_on_chain_and_star(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    star = [("hub", f"leaf{i}") for i in range(30)]
    nodes = spark.createDataFrame([(n,) for n in {x for e in chain + star for x in e} | {"alone"}], "id string")
    out = {r.id: r.component for r in G.connected_components(nodes, spark.createDataFrame(chain + star, "source string, target string")).collect()}
    assert {out[f"n{i:03d}"] for i in range(61)} == {"n000"} and {out[f"leaf{i}"] for i in range(30)} == {"hub"} and out["alone"] == "alone"


def test_citation_and_graph_audit(spark):
    e = spark.createDataFrame([("1", "GPT-4", "Tool", ""), ("2", "gpt 4", "Tool", "")], "id string, title string, type string, description string")
    assert [r.key for r in G.alias_collisions(e).collect()] == ["gpt4"]


def test_job_state_keeps_absent_fields_and_takes_nulls(spark, tmp_path):
    rows = [("j", 1, "2024-01-01 00:00:01", "running", True, "s1", True, None, False), ("j", 2, "2024-01-01 00:00:02", None, False, None, True, 5.0, True), ("k", 3, "2024-01-01 00:00:03", "done", True, None, False, None, False)]
    schema = "job_id string, event_id int, ts string, status string, has_status boolean, stage string, has_stage boolean, done double, has_done boolean"
    events = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    want = {"j": ("running", None, 5.0), "k": ("done", None, None)}
    assert {r.job_id: (r.status, r.stage, r.done) for r in L.job_states(events, list(jobs.FIELDS)).collect()} == want
    for i in range(3):
        events.where(F.col("event_id") == i + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = {}
    stream = jobs.job_state_stream(jobs.read_events(spark, str(tmp_path / "in"), events.schema, 1))
    run = jobs.write_states(stream, lambda batch, epoch: seen.update({r.job_id: (r.status, r.stage, r.done) for r in batch.collect()}), str(tmp_path / "ck")).start()
    run.awaitTermination(120)
    assert seen == want


def test_retry_headers_and_redaction(spark):
    df = spark.createDataFrame([("7",), ("-3",), ("Wed, 03 Jan 2024 00:00:10 GMT",), ("soon",), ("inf",)], "h string")
    now = F.lit("2024-01-03 00:00:00").cast("timestamp")
    assert [r.s for r in df.select(L.retry_after_seconds(F.col("h"), now).alias("s")).collect()] == [7.0, 0.0, 10.0, None, None]
    text = spark.createDataFrame([("key abc and abcdef \x1b[31mred",)], "t string").select(L.redact(F.col("t"), ["abc", "abcdef"]).alias("x")).first().x
    assert text == "key [REDACTED] and [REDACTED] red"


def test_sinks_never_overwrite_and_verify(spark, tmp_path):
    df = spark.createDataFrame([(" =1+1", 1), ("plain", 2)], "a string, b int")
    out = str(tmp_path / "csv")
    sinks.write_results_csv(df, out)
    assert sorted(r.a for r in spark.read.option("header", True).option("escape", '"').csv(out).collect())[0].startswith("'")
    with pytest.raises(Exception):
        sinks.write_results_csv(df, out)
    with pytest.raises(ValueError):
        sinks.write_new(df, str(tmp_path / "in" / "sub"), inputs=[str(tmp_path / "in")])
    chunks = spark.createDataFrame([("i", "c", ["a", "b"])], "index_id string, chunk_id string, refs array<string>")
    assert sinks.write_chunks(chunks, str(tmp_path / "jsonl")) == 0
    assert sinks.write_chunks(chunks, str(tmp_path / "jsonl")) is None
    assert P.read_part(spark, str(tmp_path / "jsonl"), "chunks").first().refs_json == '["a","b"]'
    vectors = spark.createDataFrame([("i1", f"c{i}", i, [float(i), 1.0]) for i in range(5)], "index_id string, chunk_id string, ordinal long, embedding array<float>")
    path = str(tmp_path / "vec")
    first = sinks.store_vectors(spark, vectors.where("ordinal < 3"), path).first()
    again = sinks.store_vectors(spark, vectors, path).first()
    assert (first.new_rows, again.new_rows, again.existing_rows_reused) == (3, 2, 3)
    with pytest.raises(RuntimeError):
        sinks.store_vectors(spark, vectors.withColumn("embedding", F.array(F.lit(9.0).cast("float"), F.lit(9.0).cast("float"))), path)
    assert sinks.stored_vectors(spark, path).count() == 5
    sinks.export_tables({"vectors": vectors}, str(tmp_path / "export"))
    assert sorted(P.read_part(spark, str(tmp_path / "export"), "vectors.json").collect()) == sorted(vectors.collect())
    assert P.read_part(spark, str(tmp_path / "export"), "vectors.csv").count() == 5


def test_publication_is_all_or_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    one = spark.createDataFrame([(1, 'a,"b\nc'), (2, None), (3, ""), (4, " x ")], "k int, v string")
    parts = {"a": P.Part(one, "csv"), "b": P.Part(one.withColumn("m", F.array("k")), "json"), "c": P.Part(one, "parquet", ("k",))}
    assert P.publish(spark, path, parts) == 0
    assert P.publish(spark, path, {n: P.Part(p.rows.repartition(3), p.format, p.partition_by) for n, p in parts.items()}) is None
    for part in ("a", "b", "c"):
        assert sorted(map(str, map(tuple, P.read_part(spark, path, part).select("k", "v").collect()))) == sorted(map(str, map(tuple, one.collect())))
    # A load that breaks between its files and the manifest is not seen, nor is one that reads back otherwise.
    P.stage_load(spark, path, {"a": P.Part(one.where("k = 2"), "csv")})
    monkeypatch.setattr(P, "_read", lambda spark, *rest: one.limit(2))
    with pytest.raises(RuntimeError, match="differ"):
        P.publish(spark, path, {"a": P.Part(one.where("k = 1"))})
    monkeypatch.undo()
    assert [r["version"] for r in P.versions(spark, path)] == [0, 0, 0]
    assert P.publish(spark, path, {"a": P.Part(one.where("k = 1"))}) == 1
    assert P.read_part(spark, path, "a").count() == 1
    assert P.read_all(spark, path, "a").count() == 5
    with pytest.raises(KeyError):
        P.read_part(spark, path, "b")
    with pytest.raises(ValueError, match="overlaps"):
        P.publish(spark, path, parts, inputs=[str(tmp_path)])


def test_absent_terms_short_words(spark):
    cases = spark.createDataFrame([("c1", "d", "zebra"), ("c2", "d", "red fox")], "case_id string, document_id string, term string")
    sources = spark.createDataFrame([("d", "u", "A Red  Fox ran")], "document_id string, evidence_id string, text string")
    assert [r.case_id for r in E.misplaced_terms(cases, sources).collect()] == ["c2"]


def _modularity(edges, labels):
    degree, whole = {}, 0
    for a, b, w in edges:
        degree[a], degree[b], whole = degree.get(a, 0) + w, degree.get(b, 0) + w, whole + 2 * w
    total = {}
    for x, k in degree.items():
        total[labels[x]] = total.get(labels[x], 0) + k
    return sum(2 * w for a, b, w in edges if labels[a] == labels[b]) / whole - sum((k / whole) ** 2 for k in total.values())


def _levels(spark, edges, max_size, bound, alone=()):
    nodes = sorted({x for a, b, _ in edges for x in (a, b)} | set(alone))
    found = C.hierarchy(spark.createDataFrame([(x,) for x in nodes], "id string"), spark.createDataFrame(edges, "source string, target string, weight int"), max_size, bound)
    out = {}
    for r in found.collect():
        assert r["id"] not in out.setdefault(r["level"], {})
        out[r["level"]][r["id"]] = r["community"]
    return out


@pytest.mark.parametrize("bound", [0, 1000])
def test_communities_of_joined_cliques(spark, bound):
    clique = lambda c, n: [(f"{c}{i}", f"{c}{j}", 1) for i in range(n) for j in range(i)]
    n = 6 if bound else 3  # rounds of jobs take their time
    edges = clique("a", n) + clique("b", n) + [("a0", "b0", 1)]
    found = _levels(spark, edges, 2 * n, bound, alone=["z"])
    assert found == {0: {**{f"{c}{i}": f"0-{c}0" for c in "ab" for i in range(n)}, "z": "0-z"}}


def test_communities_divide_at_the_next_level(spark):
    clique = lambda c, n: [(f"{c}{i}", f"{c}{j}", 1) for i in range(n) for j in range(i)]
    # In a large graph the four cliques of a ring are one part, in their own graph four.
    far = [(f"f{i}", f"g{i}", 1) for i in range(900)]
    ring = [e for c in "abde" for e in clique(c, 4)] + [(f"{x}0", f"{y}1", 1) for x, y in ("ab", "bd", "de", "ea")]
    found = _levels(spark, ring + far, 10, 5000)
    assert {found[0][f"{c}{i}"] for c in "abde" for i in range(4)} == {"0-a0"}
    assert found[1] == {f"{c}{i}": f"1-{c}0" for c in "abde" for i in range(4)}


def test_communities_of_a_long_path(spark, bound=5000):
    edges = [(f"{i:03}", f"{i + 1:03}", 1) for i in range(499)]
    found = _levels(spark, edges, 1000, bound)[0]
    runs = [found[f"{i:03}"] for i in range(500)]
    assert len(set(runs)) == 1 + sum(a != b for a, b in zip(runs, runs[1:], strict=False))
    assert _modularity(edges, found) > 0.9


def _job(job, event, minute, status=None, stage=None, done=None):
    return (job, event, f"2024-01-01 {minute // 60:02}:{minute % 60:02}:00", status, status is not None, stage, stage is not None, done, done is not None)


def test_finished_jobs_leave_the_state_and_late_events_are_listed(spark, tmp_path):
    schema = "job_id string, event_id int, ts string, status string, has_status boolean, stage string, has_stage boolean, done double, has_done boolean"
    files = [
        [_job("a", 1, 10, "running", "s1"), _job("a", 2, 11, "done", done=1.5), _job("b", 3, 12, "running")],
        [_job("b", 4, 200, stage="s2"), _job("c", 5, 201, "done")],
        [_job("a", 6, 100, "running"), _job("b", 7, 390, "failed", "s3"), _job("c", 8, 170, done=2.0)],
        [_job("a", 9, 400, "running", "s9")],
    ]
    seen, rows = [], []
    folder = str(tmp_path / "stream")
    for i, file in enumerate(files):
        spark.createDataFrame(file, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/arrived")
        events = spark.read.parquet(f"{folder}/arrived").schema
        # Both queries are stopped after each file and go on from their checkpoints.
        jobs.admit(jobs.read_events(spark, f"{folder}/arrived", events, 1), folder).awaitTermination()
        run = jobs.keep_states(jobs.fold_jobs(jobs.read_events(spark, f"{folder}/admitted", events, 1)), folder)
        run.awaitTermination()
        seen.append(run.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
        rows.append({r.job_id: (r.status, r.stage, r.done, r.events, r.closed) for r in jobs.latest_states(spark, folder).collect()})
    assert sorted(r.event_id for r in spark.read.parquet(f"{folder}/late").collect()) == [6]
    admitted = spark.read.parquet(f"{folder}/admitted")
    assert sorted(r.event_id for r in admitted.collect()) == [1, 2, 3, 4, 5, 7, 8, 9]
    # a is closed when the second file has moved the watermark, c by the third; the last event opens a anew.
    assert rows[1]["a"] == ("done", "s1", "1.5", 2, True)
    assert rows[2] == {"a": ("done", "s1", "1.5", 2, True), "b": ("failed", "s3", None, 3, False), "c": ("done", None, "2.0", 2, True)}
    assert rows[3]["a"] == ("running", "s9", None, 1, False)
    assert seen == [2, 2, 1, 2]
    batch = L.job_states(admitted.where("job_id <> 'a'"), list(jobs.FIELDS)).collect()
    assert {r.job_id: (r.status, r.stage, None if r.done is None else str(r.done), r.events) for r in batch} == {k: v[:4] for k, v in rows[2].items() if k != "a"}


def test_edge_evidence_is_told_apart_before_it_is_paired(spark):
    """Edges and quotes of a key make as many pairs as the result has rows; none of them goes through a shuffle."""
    ends = [("d", f"e{i}", f"s{i % 2}", "o", "USES_CONCEPT") for i in range(6)] + [("d", "e0", "s0", "o", "USES_COMPONENT")]
    edges = spark.createDataFrame(ends, "document_id string, edge_id string, source string, target string, label string")
    nodes = spark.createDataFrame([("d", "s0", "Method", "A"), ("d", "s1", "Method", "B"), ("d", "o", "Concept", "C")], "document_id string, id string, label string, name string")
    said = [("d", 0, i, p, "Method", s, "Concept", "C") for i, (p, s) in enumerate([("USES_CONCEPT", "A"), ("USES_COMPONENT", "A"), ("USES_CONCEPT", "B"), ("USES_CONCEPT", "A")])]
    accepted = spark.createDataFrame(said, "document_id string, batch_id int, rel_id int, predicate string, subject_kind string, subject string, object_kind string, object string")
    quotes = spark.createDataFrame([("d", 0, 0, "r", "same"), ("d", 0, 1, "r", "same"), ("d", 0, 2, "r", "same"), ("d", 0, 3, "r", None)], "document_id string, batch_id int, rel_id int, source_ref string, quote string")
    found = R.attach_edge_evidence(edges, nodes, accepted, quotes)
    assert sorted(map(str, found.collect())) == sorted(
        f"Row(document_id='d', edge_id='e{i}', source_ref='r', quote={q!r})" for i in range(6) for q in (["same", None] if i % 2 == 0 else ["same"]))
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Aggregate" in line for line in plan[: next(i for i, line in enumerate(plan) if "Join" in line)])


def test_texts_are_normalized_once_for_both_passes(spark):
    """Passes over the same responses begin at their identity keys; neither plan brings a text to its key again."""
    responses = spark.createDataFrame([(1, "Alpha uses Beta and Gamma."), (2, "Beta alone.")], "response_id long, source string")
    e = "response_id long, pos int, name string, type string, description string"
    current = X.check_entities(spark.createDataFrame([(1, 0, "Alpha", "Tool", "d")], e), responses)
    inherited, _ = X.inherited_entities(current, spark.createDataFrame([(1, 0, "ALPHA", "Tool", "d"), (1, 1, "beta", "Tool", "d"), (2, 0, "Gamma", "Tool", "d")], e), responses)
    assert [(r.response_id, r.key) for r in inherited.collect()] == [(1, "beta")]
    relations = spark.createDataFrame([(1, 0, "Alpha", "Alpha", "OTHER", "method", "d", "Alpha uses")], "response_id long, pos int, source string, target string, kind string, scope string, description string, evidence string")
    checked = X.check_relations(relations, current.where("reason IS NULL"), responses)
    for found in (current, inherited):
        assert "AS source_key" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "AS passage_key" not in checked._jdf.queryExecution().optimizedPlan().toString()
