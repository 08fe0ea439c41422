"""Plans that must not send what grows with the input through the driver or through one task."""

import time

import pytest
from pyspark.sql import functions as F

from attesta.functions import products as PR
from attesta.functions.text import contains_word
from attesta.operators import checks as C
from attesta.operators import chunks as K
from attesta.operators import communities as M
from attesta.operators import graph_tables as G
from attesta.operators import lexical as L
from attesta.operators import preparation as P
from attesta.operators import research as S
from attesta.operators import units as U
from attesta.sources import readers as R
from attesta.streaming import jobs as J


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.fixture(scope="module")
def grid(spark):
    """A table of 200 rows with a header row, read from a file as small as its compressed columns."""
    at = F.col("id")
    row = lambda i, left, text, label: F.struct(
        (at * 4 + i).cast("int").alias("idx"), at.cast("int").alias("row_start"), (at + 1).cast("int").alias("row_end"), F.lit(left).alias("col_start"), F.lit(left + 1).alias("col_end"),
        (at == 0).alias("column_header"), F.lit(label).alias("row_header"), F.lit(False).alias("row_section"), text.alias("text"))
    cells = F.array(row(0, 0, F.concat(F.lit("row "), at.cast("string")), True), row(1, 1, at.cast("string"), False))
    return spark.range(200).select(F.lit("d").alias("document_id"), F.lit("#/tables/0").alias("item_ref"), F.inline(cells)).withColumn("bbox", F.lit(None).cast(U.BBOX))


def test_cells_of_a_row_meet_in_a_shuffle(grid):
    found = U.row_headers(grid)
    assert broadcasts(found) == 0
    assert {(r.evidence_id, r.ref) for r in found.where("pos = 20").collect()} == {("#/tables/0::cell:21", "#/tables/0::cell:20")}
    assert broadcasts(U.row_labels(grid)) == broadcasts(U.column_headers(grid)) == 0


def test_quotes_meet_their_units_in_a_shuffle(spark, grid):
    bodies = grid.select("document_id", U.cell_id("item_ref", "idx").alias("evidence_id"), "text")
    quotes = bodies.select("document_id", F.col("evidence_id").alias("quote_id"), F.col("text").alias("quote"), F.col("evidence_id").alias("source_ref"))
    found = U.locate_quotes(quotes.where("length(quote) > 1"), bodies)
    assert broadcasts(found) == 0
    assert found.where("quote_id <> evidence_id").count() == 0 and found.count() == 200 + 190


def test_short_quotes_pass_a_very_long_text_once(spark):
    """Runs of characters are taken in one pass; by their numbers they would cost the square of a text's length."""
    units = spark.createDataFrame([("d", "long", "é\U0001f600 ab " * 100_000 + "zebra crossing"), ("d", "other", "a zebra crossing here"), ("d", "no", "zebra  line")], "document_id string, evidence_id string, text string")
    quotes = spark.createDataFrame([("d", "q", "Zebra crossing", None), ("d", "s", "\U0001f600 ab é\U0001f600 ab", None)], "document_id string, quote_id string, quote string, source_ref string")
    began = time.perf_counter()
    got = {(r.quote_id, r.evidence_id) for r in U.locate_quotes(quotes.where("quote_id = 'q'"), units).collect()}
    assert got == {("q", "long"), ("q", "other")} and time.perf_counter() - began < 60
    assert {(r.quote_id, r.evidence_id) for r in U.locate_quotes(quotes.where("quote_id = 's'"), units, short=4).collect()} == {("s", "long")}


def test_records_meet_their_evidence_in_a_shuffle(spark, grid):
    place = "array<struct<page_no:int,bbox:string,granularity:string,charspan:array<int>>>"
    units = grid.select("document_id", U.cell_id("item_ref", "idx").alias("evidence_id"), "item_ref", F.lit("table_cell").alias("kind"), "text", F.lit(None).cast(place).alias("locations"),
                        F.array().cast("array<string>").alias("issues"), "row_start", "column_header", "row_header", "row_section")
    data = grid.where("col_start = 1 AND NOT column_header")
    ref = U.cell_id("item_ref", "idx")
    records = data.select("document_id", ref.alias("result_id"), F.lit("m").alias("method"), F.lit("d").alias("dataset"), F.lit("0").alias("metric"), F.lit("higher").alias("direction"),
                          F.col("text").alias("raw_value"), F.col("text").cast("double").alias("numeric_value"), F.lit("ok").alias("review_status"))
    links = data.select("document_id", ref.alias("result_id"), F.lit("value").alias("role"), ref.alias("evidence_id"), F.lit(None).cast("string").alias("quote"))
    checked = C.check_records(records, links, units, U.cell_context(grid))
    # The few named headers of a table may still be sent: their number doesn't grow with its rows.
    assert broadcasts(checked) <= 2
    assert checked.count() == 199
    cited = records.select("document_id", "result_id", F.col("result_id").alias("evidence_id"), F.col("result_id").alias("pos"), "review_status")
    attached = K.attach_results(units.select("document_id", "evidence_id"), cited, checked)
    assert broadcasts(attached) <= 2 and attached.where("size(result_ids) = 1").count() == 199
    assert broadcasts(K.resolve_chunks(units.select("document_id", F.lit("c").alias("chunk_id"), F.array("evidence_id").alias("evidence_ids")), units)) == 0


def test_stars_need_no_moves(spark, monkeypatch):
    """Hubs with many leaves are large graphs that are settled without a round of moves."""
    def refuse(edges):
        raise AssertionError("moved")

    monkeypatch.setattr(M, "_moved", refuse)
    links = [(f"l{h}-{i:03d}", f"h{h}", 10) for h in range(3) for i in range(40)] + [("h0", "h1", 1), ("p", "q", 2)]
    nodes = sorted({x for s, t, _ in links for x in (s, t)})
    edges = spark.createDataFrame(links, "source string, target string, weight int")
    found = M.hierarchy(spark.createDataFrame([(x,) for x in nodes], "id string"), edges, max_size=50, bound=20).collect()
    by = {r.id: r.community for r in found if r.level == 0}
    assert len(found) == len(by) == len(nodes) and by["p"] == by["q"] == "0-p"
    assert all(by[f"l{h}-{i:03d}"] == by[f"h{h}"] == f"0-h{h}" for h in range(3) for i in range(40))


def test_manifests_with_a_shared_path(spark):
    """Files that share a path are told apart by a further key; a file without a hash was there nevertheless."""
    files = "page_id int, path string, sha256 string"
    before = spark.createDataFrame([(1, "u", "a"), (2, "u", "b"), (3, "v", None), (4, "w", None)], files)
    after = spark.createDataFrame([(0, "u", "c"), (2, "u", "x"), (3, "v", "d"), (4, "w", None)], files)
    found = R.fingerprint_changes(before, after, ("page_id", "path")).collect()
    assert sorted((r.path, r.change) for r in found) == [("u", "added"), ("u", "altered"), ("u", "removed"), ("v", "altered")]


def test_names_with_a_common_first_word_meet_few_texts(spark):
    texts = [("d", f"t{i}", f"the item{i}, (the) odd one; the end-{i}") for i in range(40)]
    nodes = [("d", str(i), "x", f"The item{i}") for i in range(40)] + [("d", "a", "x", "odd"), ("d", "b", "x", "(the) odd"), ("d", "c", "x", "the odd"), ("d", "e", "x", "item1 ,"), ("d", "f", "x", "- ")]
    units = spark.createDataFrame(texts, "document_id string, evidence_id string, text string")
    named = spark.createDataFrame(nodes, "document_id string, id string, label string, name string")
    got = {}
    for r in S.mentions(named, units).collect():
        got.setdefault(r.id, set()).add(r.ref)
    assert got == {**{str(i): {f"t{i}"} for i in range(40)}, "a": {t[1] for t in texts}, "b": {t[1] for t in texts}}
    bodies = units.select("document_id", F.col("evidence_id").alias("ref"), F.lower("text").alias("body"))
    # Names of one or two words are settled by postings; signs of a name's ends must stand beside its words, too.
    signs = spark.createDataFrame([("d", k) for k in ("odd one;", "the end-", "(the", ", (the) odd", "one; the", "-1", "one ;")], "document_id string, k string")
    bodies = units.select("document_id", F.col("evidence_id").alias("ref"), F.lower("text").alias("body"))
    for some in (signs, named.where("id < '9z'").select("document_id", F.lower("name").alias("k"))):
        want = some.join(bodies, "document_id").where(contains_word(F.col("body"), F.col("k"))).select("k", "ref")
        assert sorted(map(tuple, S.short_mentions(some, bodies).select("k", "ref").collect())) == sorted(map(tuple, want.collect()))
    assert S.mention_candidates(named.where("id < '9z'").select("document_id", F.lower("name").alias("k")), bodies).count() == 40


def test_jobs_are_folded_in_buckets(spark, tmp_path, monkeypatch):
    """State and calls follow the buckets, not the jobs; every job keeps its own times."""
    monkeypatch.setattr(J, "BUCKETS", 2)
    row = lambda job, event, minute, status: (job, event, f"2024-01-01 {minute // 60:02}:{minute % 60:02}:00", status, True, None, False, None, False)
    first = [row(f"j{i}", i, 5, "done" if i % 2 else "running") for i in range(40)]
    files = [first, [row(f"j{i}", 100 + i, 300, "running") for i in range(4)], [row("z", 200, 600, "running")]]
    for number, file in enumerate(files):
        spark.createDataFrame(file, "job_id string, event_id int, ts string, status string, has_status boolean, stage string, has_stage boolean, done double, has_done boolean").withColumn(
            "ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(str(tmp_path / "arrived"))
        events = J.read_events(spark, str(tmp_path / "arrived"), spark.read.parquet(str(tmp_path / "arrived")).schema, None)
        run = J.keep_states(J.fold_jobs(events), str(tmp_path), number < 2)
        run.awaitTermination()
    assert run.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 2
    got = {r.job_id: (r.status, r.events, r.closed) for r in J.latest_states(spark, str(tmp_path)).collect()}
    # The second batch meets the watermark of the first and open jobs.
    want = {f"j{i}": ("done" if i % 2 else "running", 1, i % 2 == 1) for i in range(4, 40)}
    assert got["z"] == ("running", 1, False) and {k: v for k, v in got.items() if k in want} == want
    assert all(got[f"j{i}"] == ("running", 2, False) for i in range(4))


def test_sources_ranked_by_blocks(spark, monkeypatch):
    """Blocks of any size give the sources of all pairs, with both boosts; ties by order, boosted chunks without a shared term too."""
    words = "alpha beta gamma delta train limitation score metric".split()
    chunks = spark.createDataFrame(
        [("d", f"c{i:02d}", i, " ".join(words[(i * j) % 8] for j in range(1, 6)), ["Limitations" if i % 7 == 0 else "Body"], [f"#/t/{i % 9}"]) for i in range(40)] + [("e", "x", 0, "alpha", ["Body"], ["#/t/0"])],
        "document_id string, chunk_id string, ordinal int, text string, headings array<string>, refs array<string>")
    asked = spark.createDataFrame([("d", 1, "alpha beta"), ("d", 2, "limitations of gamma"), ("d", 3, "no such word, error"), ("d", 4, "of the"), ("e", 5, "alpha"), ("f", 6, "alpha")], "document_id string, question_id int, question string")
    edges = spark.createDataFrame([("d", i, i, "USED_FOR", words[i % 8], "metric", [f"#/t/{i}::cell:1"]) for i in range(20)], "document_id string, edge_id int, edge_pos int, label string, source_text string, target_text string, refs array<string>")
    scores = L.bm25(chunks, asked)
    picked = L.graph_edges_for(asked, edges, 3)
    whole = {name: sorted(L.numbered_sources(found, chunks).collect()) for name, found in (
        ("plain", scores), ("headings", L.heading_boost(scores, asked, chunks)), ("graph", L.add_scores(scores, L.graph_boost(L.graph_edges_for(asked, edges), edges, chunks))))}
    monkeypatch.setattr(PR, "BEST", (3, 2))
    monkeypatch.setattr(PR, "ALL", (4, 1))
    assert {name: sorted(L.ranked_sources(chunks, asked, **more).collect()) for name, more in (("plain", {}), ("headings", {"headings": True}), ("graph", {"edges": edges}))} == whole
    assert sorted(L.graph_edges_for(asked, edges, 3).collect()) == sorted(picked.collect())
    assert {r.question_id for r in scores.collect()} == {1, 2, 5} and L.bm25(chunks, asked).count() == scores.count()
    # What is shuffled is rows of one side or the best of a block, never a pair for each common term.
    assert L.ranked_sources(chunks, asked)._jdf.queryExecution().executedPlan().toString().count("FlatMapCoGroupsInArrow") == 1


def test_the_ledger_reads_its_sources_from_a_stage(spark):
    """The sources of units are found once, not again for every table of the ledger."""
    from attesta.plans import Tables
    from attesta.plans import graphing as GP

    plan = GP.ledger(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "source_record_id" not in plan


def _section_grid(spark):
    """Rows of sections and cells in two tables; sections end late, in ties, or nowhere."""
    import random

    rng = random.Random(5)
    rows = [(d, "#/tables/0", n, top, top + rng.choice([0, 1, 1, 1, 3, 9]) if rng.random() < 0.9 else None, rng.random() < 0.3) for d in "ab" for n, top in enumerate(rng.choices(range(40), k=90))]
    rows += [("a", "#/tables/0", 90, None, 3, True), ("a", "#/tables/0", 91, None, None, False), ("c", "#/tables/0", 0, 5, 6, False), ("c", "#/tables/1", 0, 1, 2, True)]
    return rows, spark.createDataFrame(rows, "document_id string, item_ref string, idx int, row_start int, row_end int, row_section boolean")


def test_sections_are_found_in_one_pass_over_the_cells(spark, monkeypatch):
    rows, cells = _section_grid(spark)
    plan = U.row_sections(cells)._jdf.queryExecution().optimizedPlan().toString()
    # No copies of a table's rows for every bucket, no join of cells.
    assert "__salt" not in plan and "Join" not in plan
    want = set()
    for d, t, i, top, _, _ in rows:
        past = [o for o in rows if o[:2] == (d, t) and o[5] and None not in (o[3], o[4], top) and o[4] <= top]
        want |= {(d, f"{t}::cell:{i}", "row_sections", f"{t}::cell:{o[2]}", o[2]) for o in past if o[3] == max(p[3] for p in past)}
    for block in (65_536, 7, 1):
        monkeypatch.setattr(U.skew, "BLOCK", block)
        found = [tuple(r) for r in U.row_sections(cells).collect()]
        assert len(found) == len(set(found)) and set(found) == want and len(want) > 100


def test_missing_cells_meet_their_lines_in_a_shuffle(spark, grid):
    assert broadcasts(P.missing_cells(grid, P.table_grid_lines(grid.where("idx % 9 > 0")))) == 0
    cells = [(0, 0, 1, "kept"), (1, 0, 1, "lost"), (2, 1, 3, "kept  low"), (3, 1, 3, "lost"), (4, 2, 3, " "), (5, 9, 10, "no line"), (6, 1, 4, "two"), (7, None, None, "nowhere"), (8, 0, 1, "lost"), (8, 0, 1, "lost"), (9, 1, 3, "gone"), (9, 1, 3, "gone")]
    cells = spark.createDataFrame([("d", "t", *c) for c in cells], "document_id string, item_ref string, idx int, row_start int, row_end int, text string")
    lines = spark.createDataFrame([("d", "t", 0, "| kept |"), ("d", "t", 0, "| two lines of a row |"), ("d", "t", 1, "| x |"), ("d", "t", 2, "| kept low |"), ("d", "t", 3, "| two |"), ("d", "u", 1, "| lost |")], "document_id string, item_ref string, row int, line string")
    assert sorted(r.idx for r in P.missing_cells(cells, lines).collect()) == [1, 3, 5, 7, 8, 8, 9, 9]


def test_finished_stars_are_in_no_later_round(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(G, "written", lambda df, name, write=G.written: rounds.append(write(df, name)) or rounds[-1])
    edges = [(f"o{c}-{i}", f"c{c}") for c in range(5) for i in range(40)] + [(f"s{i}", f"s{i + 1}") for i in range(8)]
    nodes = spark.createDataFrame([(x,) for x in sorted({x for e in edges for x in e})], "id string")
    found = {r.id: r.component for r in G.connected_components(nodes, spark.createDataFrame(edges, "source string, target string")).collect()}
    assert found == {x: f"c{x[1]}" if x[0] in "oc" else "s0" for x in found} and len(found) == 5 * 41 + 9
    sizes = [r.count() for r in rounds]
    assert sizes[0] == 208 and max(sizes[1:]) < 20 and sizes[-1] == 0


def test_components_of_any_graph(spark):
    import random

    rng = random.Random(9)
    for n, m in ((60, 20), (60, 45), (60, 70), (8, 60), (5, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(None, 1), (2, None)]
        up = list(range(n))
        for _ in range(n):
            for a, b in edges[:m]:
                up[a] = up[b] = min(up[a], up[b])
        found = G.connected_components(spark.range(n), spark.createDataFrame(edges, "source long, target long"))
        assert sorted(tuple(r) for r in found.select("id", "component").collect()) == list(enumerate(up))
