"""Vector search, fusion, sections, plans, answers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from attesta.functions import stems as ST
from attesta.operators import answers as A
from attesta.operators import contextual as CT
from attesta.operators import fulltext as T
from attesta.operators import questions as Q
from attesta.operators import retrieval as R
from attesta.operators import vector_index as V
from attesta.sources import index_store as IX


def _vectors(spark, n, dims=8, seed=1):
    rng = random.Random(seed)
    rows = [("i%d" % (i % 2), "c%d" % i, i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) + 0.125 for _ in range(dims)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "index_id string, chunk_id string, ordinal long, embedding array<float>")


def test_tiled_search_agrees_with_brute_force(spark):
    rows, vectors = _vectors(spark, 120)
    queries = vectors.where("ordinal < 6").select("index_id", F.col("chunk_id").alias("query_id"), F.lit("q").alias("channel"), "embedding")
    inline = V.exact_top_k(vectors.repartition(5), queries, 7)
    tiles = V.exact_top_k(vectors, queries, 7, 2)

    def dist(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        return round(1 - dot / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5), 9)

    want = {}
    for q in rows[:6]:
        near = sorted((dist(q[3], r[3]), r[2], r[1]) for r in rows if r[0] == q[0])[:7]
        want[q[1]] = [c for _, _, c in near]
    for df in (inline, tiles):
        got = {}
        for r in df.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == want


def test_synthetic_distances(spark):
    v = spark.createDataFrame([("i", "same", 0, [1.0, 0.0]), ("i", "orthogonal", 1, [0.0, 1.0]), ("i", "opposite", 2, [-1.0, 0.0])], "index_id string, chunk_id string, ordinal long, embedding array<float>")
    q = spark.createDataFrame([("i", "q", "c", [2.0, 0.0])], "index_id string, query_id string, channel string, embedding array<float>")
    assert [round(r.distance, 6) for r in V.exact_top_k(v, q, 3).orderBy("rank").collect()] == [0.0, 1.0, 2.0]


def test_vectors_without_direction_are_left_out(spark):
    nan = float("nan")
    v = spark.createDataFrame([("i", "zero", 0, [0.0, 0.0]), ("i", "none", 1, None), ("i", "short", 2, [1.0]), ("i", "nan", 3, [nan, 1.0]), ("i", "near", 4, [1.0, 0.1]), ("i", "same", 5, [1.0, 0.0])], "index_id string, chunk_id string, ordinal long, embedding array<float>")
    q = spark.createDataFrame([("i", "q", "c", [2.0, 0.0]), ("i", "bad", "c", [0.0, 0.0]), ("j", "other", "c", [1.0, 0.0])], "index_id string, query_id string, channel string, embedding array<float>")
    assert [(r.query_id, r.chunk_id) for r in V.exact_top_k(v, q, 2).orderBy("rank").collect()] == [("q", "same"), ("q", "near")]
    faults = {(r.id, r.fault) for r in V.search_faults(v, q).collect()}
    assert faults == {("zero", "no_direction"), ("none", "missing_vector"), ("short", "wrong_dimensions"), ("nan", "no_direction"), ("bad", "no_direction")}


def test_fusion_values_and_zero_similarity(spark):
    hits = spark.createDataFrame([("q", "a", 1, "x", 0.0), ("q", "a", 2, "y", None), ("q", "a", 3, "x", 0.0), ("q", "b", 1, "y", None)], "question_id string, channel string, rank int, chunk_id string, similarity double")
    rows = {r.chunk_id: r for r in R.fuse(hits, ["question_id"]).collect()}
    assert abs(rows["x"].rrf_score - 1 / 61) < 1e-12 and rows["x"].similarity == 0.0
    assert abs(rows["y"].rrf_score - (1 / 62 + 1 / 61)) < 1e-12 and rows["y"].channels == {"a": 2, "b": 1}


def test_section_kinds(spark):
    rows = [
        (None, "Abstract. We show", ["3 Data"], "abstract"), (None, "3 Data\nABSTRACT\nWe", ["3 Data"], "abstract"), (None, "abstract concepts matter", [], "body"),
        (None, "text", ["IV. Experiments"], "results"), (None, "text", ["2.1 Motivation"], "introduction"), ("document_metadata", "x", ["Methods"], "document_metadata"),
        (None, "x", ["7 References"], "references"), (None, "x", ["Ethics statement"], "backmatter"), (None, "x", ["5. Discussion"], "conclusion"), (None, "x", None, "body"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, role string, body string, headings array<string>, want string")
    got = df.select("i", "want", R.section_kind(F.col("role"), F.col("body"), F.col("headings")).alias("kind")).collect()
    assert all(r.kind == r.want for r in got), [r for r in got if r.kind != r.want]


def test_source_budget_skips_and_continues(spark):
    ranked = spark.createDataFrame([("q", 1, "big", "x" * 70000, [1]), ("q", 2, "a", "y" * 30000, [1]), ("q", 3, "b", "é\"" * 20000, [2]), ("q", 4, "c", "small", [2])], "question_id string, rank int, chunk_id string, text string, pages array<int>")
    plans = spark.createDataFrame([("q", "why?", "fact")], "question_id string, question string, intent string")
    structural = spark.createDataFrame([], "question_id string, place int, chunk_id string, section_kind string")
    out = {r.chunk_id: r.source_id for r in R.assemble_sources(ranked, structural, plans, 5).collect()}
    assert out == {"big": None, "a": "S1", "b": None, "c": "S2"}


def test_plans(spark):
    qs = ["Tell me about the paper", "could you please explain this paper in simple terms?", "Tell me about the training data in the paper", "Who published this article?", "What is new here?", "How does it work?"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(qs)], "question_id int, question string")
    rows = Q.fallback_plans(df).orderBy("question_id").collect()
    assert [r.intent for r in rows] == ["overview", "overview", "fact", "metadata", "contributions", "method"]
    assert rows[2].keywords == ["training", "data"]


def _answer(**change):
    value = {"status": "answered", "claims": [{"text": "It works", "evidence": [{"source_id": "S1", "quote": "the method works  well on data"}]}], "missing_information": ""}
    value.update(change)
    return value


def test_answer_validation_and_repair(spark):
    missing = dict(_answer())
    del missing["status"]
    bad = {"text": "Bad", "evidence": [{"source_id": "S1", "quote": "the method ... works on data"}]}
    cases = {
        "ok": json.dumps(_answer()), "fenced": "```json\n" + json.dumps(_answer()) + "\n```", "trailing": json.dumps(_answer()) + " x",
        "unknown": json.dumps(_answer(claims=[{"text": "t", "evidence": [{"source_id": "S7", "quote": "the method works well on"}]}])),
        "ellipsis": json.dumps(_answer(claims=_answer()["claims"] + [bad])), "state": json.dumps(_answer(status="partial")), "no_status": json.dumps(missing),
        "extra": json.dumps(_answer(note="x")), "short": json.dumps(_answer(claims=[{"text": "t", "evidence": [{"source_id": "S1", "quote": "short"}]}])),
    }
    answers = spark.createDataFrame(list(cases.items()), "answer_id string, content string")
    sources = spark.createDataFrame([(k, "S1", "We say the method works\nwell on data.") for k in cases], "answer_id string, source_id string, text string")
    issues = {}
    for r in A.answer_issues(answers, sources).collect():
        issues.setdefault(r.answer_id, set()).add((r.kind, r.hint))
    assert issues == {
        "trailing": {("schema", "invalid_json")}, "unknown": {("unknown_source", "use_supplied_source_ids")}, "ellipsis": {("quote_mismatch", "split_ellipsis")},
        "state": {("answer_state", "")}, "no_status": {("schema", "missing_field")}, "extra": {("schema", "unknown_field")}, "short": {("schema", "invalid_quote_object")},
    }
    kept = {r.answer_id: (r.claims, r.withheld) for r in A.retain_cited_claims(answers, sources).collect()}
    assert kept == {"ellipsis": (["It works"], [1])}
    assert [(r.answer_id, r.status) for r in A.restore_status(answers).collect()] == [("no_status", "answered")]


def test_contextual_chunks_keep_all_text_within_budget(spark):
    rng = random.Random(2)
    items = [("d", i, f"#/texts/{i}", "text", " ".join(rng.choice(["aa", "bbb", "c,"]) for _ in range(rng.randint(1, 60))), ["H%d" % (i // 7)], [1 + i // 5]) for i in range(40)]
    df = spark.createDataFrame(items, "document_id string, pos long, item_ref string, label string, text string, headings array<string>, pages array<int>")
    rows = CT.contextual_chunks(df, 30).orderBy("chunk_no").collect()
    assert all(r.tokens <= 32 for r in rows)
    assert "".join("".join(r.text for r in rows).split()) == "".join("".join(i[4] for i in items).split())
    assert [r.chunk_id for r in rows][:2] == ["d-00000", "d-00001"]


# Published pairs of words and stems.
STEMMED = (
    "consign consign consigned consign consignment consign consistency consist consistently consist consolation consol consolatory consolatori consolidated consolid "
    "consolingly consol consonant conson conspicuously conspicu conspiracy conspiraci conspirators conspir conspiring conspir constable constabl constancy constanc "
    "knackeries knackeri knaves knave kneaded knead kneeling kneel knees knee knitted knit knocker knocker knotted knot happy happi hopping hop hoping hope flies fli "
    "dies die dying die tied tie cried cri by by say say enjoy enjoy luxuriated luxuri generation generat generously generous communism communism relational relat "
    "conditional condit digitizer digit operator oper hopefulness hope callousness callous sensitiviti sensit formative format formalize formal electriciti electr "
    "goodness good revival reviv allowance allow adjustable adjust irritant irrit replacement replac adoption adopt activate activ homologous homolog effective effect "
    "probate probat rate rate cease ceas controll control roll roll proceeding proceed exceeded exceed herring herring only onli skies sky news news is is youth youth"
).split()


def test_published_stems(spark):
    words = STEMMED[::2]
    got = spark.createDataFrame([(words,)], "w array<string>").select(ST.stems(F.col("w")).alias("s")).first().s
    assert list(zip(words, got, strict=True)) == list(zip(words, STEMMED[1::2], strict=True))
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE v AS SELECT unnest(?) AS w", [words])
    assert dict(con.execute(f"WITH {ST.stem_sql('v')} SELECT w, stem FROM stems").fetchall()) == dict(zip(words, STEMMED[1::2], strict=True))


CHUNKS = "index_id string, chunk_id string, ordinal int, contextualized_text string"
ASKED = "index_id string, question_id string, keywords array<string>"


def _ranking(found):
    return [(r.chunk_id, r.score) for r in found.orderBy("question_id", "rank").collect()]


def test_cover_density_differs_from_counting(spark):
    # Three phrases occur in `inner`, but its covers are the two runs that hold no shorter one.
    rows = [("i", "inner", 1, "A trained network. Network training"), ("i", "gap", 2, "state of the art, state in an art"), ("i", "plain", 3, "networks networks networks"),
            ("i", "none", 4, "nothing of that"), ("j", "other", 5, "network")]
    questions = [("i", "q", ["training network", "network", "state of the art", "the of"])]
    chunks, asked = spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(questions, ASKED)
    got = _ranking(T.phrase_search(T.postings(chunks), asked))
    assert got == [("plain", 0.3), ("inner", 0.2), ("gap", round(0.2 / 3, 9))]
    counted = {"inner": 3, "gap": 2, "plain": 3}
    assert sorted(counted, key=lambda c: (-counted[c], [r[1] for r in rows].index(c))) != [c for c, _ in got]


def test_cover_holds_terms_of_other_phrases(spark):
    rows = [("i", "filled", 1, "state art the art"), ("i", "open", 2, "state the the art")]
    questions = [("i", "q", ["state of the art", "art painting"])]
    got = _ranking(T.phrase_search(T.postings(spark.createDataFrame(rows, CHUNKS)), spark.createDataFrame(questions, ASKED)))
    assert got == [("filled", 0.05), ("open", round(0.1 / 3, 9))]


def test_stored_index(spark, tmp_path):
    words = "alpha beta gamma delta searching searched the of".split()
    rng = random.Random(5)
    rows = [("i%d" % (i % 2), f"c{i}", i, " ".join(rng.choices(words, k=30))) for i in range(60)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = spark.createDataFrame([("i0", "a", ["beta gamma", "search"]), ("i1", "b", ["alpha of delta"]), ("i1", "c", ["the"])], ASKED)
    path = f"{tmp_path}/index"
    assert IX.manifest(spark, path).collect() == []
    assert IX.append(T.postings(chunks.where("ordinal < 40")), path, 4)
    before = IX.search(spark, path, asked, buckets=4).collect()
    assert not IX.append(T.postings(chunks.where("ordinal < 40").repartition(3)), path, 4)
    with pytest.raises(ValueError, match="already"):
        IX.append(T.postings(chunks.where("ordinal BETWEEN 39 AND 45")), path, 4)
    # Data of loads that were refused, or never published, is not visible.
    T.postings(chunks).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{path}/postings/load=broken")
    assert IX.search(spark, path, asked, buckets=4).collect() == before
    assert IX.append(T.postings(chunks.where("ordinal >= 40")), path, 4)
    assert [tuple(r) for r in IX.manifest(spark, path).orderBy("segment").select("segment", "chunks").collect()] == [(0, 40), (1, 20)]
    key = ["index_id", "question_id", "rank"]
    assert IX.search(spark, path, asked, buckets=4).orderBy(*key).collect() == T.phrase_search(T.postings(chunks), asked).orderBy(*key).collect()
    want = T.postings(chunks).groupBy("index_id", "term").agg(F.count("*").alias("df"))
    assert sorted(IX.frequencies(spark, path).collect()) == sorted(want.collect())
    plan = IX.matching(spark, path, asked, 4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket")


def test_a_word_is_stemmed_once_for_many_occurrences(spark):
    """Stems come from one small function, not from a chain of conditions for every word of a text."""
    assert [ST.stem(w) for w in STEMMED[0::2]] == STEMMED[1::2]
    found = T.postings(spark.createDataFrame([("i", 1, 1, "Running runs; the runner's 'ponies' yay, by 𝒳s")], "index_id string, chunk_id int, ordinal int, contextualized_text string"))
    assert {r.term: r.positions for r in found.collect()} == {"run": [0, 1], "runner": [3], "poni": [5], "yay": [6], "𝒳s": [8]}
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_pairs_of_common_words_are_not_rows_of_a_shuffle(spark, tmp_path):
    """Words that every question and chunk holds: postings of pairs grow with the product of both sides; only the best of a block may leave it."""
    rng = random.Random(11)
    words = "alpha beta gamma delta epsilon zeta".split()
    chunks = spark.createDataFrame([("i", f"c{i}", i, " ".join(rng.choices(words, k=12))) for i in range(60)], CHUNKS)
    asked = [("i", f"q{i}", rng.sample(words, 3) + [" ".join(rng.sample(words, 2))] * (i % 3 == 0)) for i in range(30)] + [("i", "long", ["alpha the beta", "gamma delta"])]
    questions = spark.createDataFrame(asked, ASKED)
    index, key = T.postings(chunks), ["index_id", "question_id", "rank"]
    found = T.phrase_search(index, questions, 5)
    want = T.ranked_chunks(index.join(T.phrase_terms(questions), ["index_id", "term"]), 5)
    assert found.orderBy(*key).collect() == want.select(*found.columns).orderBy(*key).collect()
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_source_cost_stands_for_the_text(spark):
    texts = spark.createDataFrame([("q", i, f"c{i}", 'a "b"\n' * i, [1, i]) for i in range(1, 9)], "question_id string, rank int, chunk_id string, text string, pages array<int>")
    plans = spark.createDataFrame([("q", "why", "fact")], "question_id string, question string, intent string")
    none = spark.createDataFrame([], "question_id string, place int, chunk_id string, section_kind string")
    costs = texts.select("question_id", "rank", "chunk_id", R.source_cost(F.col("text"), F.col("pages")).alias("cost"))
    assert R.assemble_sources(costs, none, plans, 5, 300).orderBy("place").collect() == R.assemble_sources(texts, none, plans, 5, 300).orderBy("place").collect()


def test_texts_of_pieces_wait_while_they_are_packed(spark):
    """Numbering, headings and packing of pieces read sizes; the cutting of texts is no part of their plan."""
    items = spark.createDataFrame([("d", i, f"#/{i}", "text", "word " * (9 * i), ["H"], [1]) for i in range(1, 9)], "document_id string, pos long, item_ref string, label string, text string, headings array<string>, pages array<int>")
    found = CT.contextual_chunks(items, 30)
    assert "slice(" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.orderBy("chunk_no").collect()
    assert sum(r.text.count("word") for r in rows) == 9 * 36 and all(r.tokens <= 30 for r in rows)
    assert [ref for r in rows for ref in r.source_refs] == sorted(ref for r in rows for ref in r.source_refs)
