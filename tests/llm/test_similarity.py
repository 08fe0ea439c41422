"""Near copies at five-word similarity 0.8 or more, planted and checked against brute force."""

import random

import corpus_pipeline
from attesta.llm import shingle_join


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(rng):
    """Texts of different words, and copies of them in which some words are changed."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = [" ".join(word() for _ in range(rng.choice([3, 30, 120, 400]))) for _ in range(60)]
    for t in list(texts):
        for part in (0.005, 0.015, 0.03, 0.06):
            w = t.split()
            for at in rng.sample(range(len(w)), max(1, round(part * len(w)))):
                w[at] = word()
            texts.append(" ".join(w))
    return [*texts, "", None, texts[5].upper()]


def test_near_copies(spark):
    texts = planted(random.Random(21))
    sets = [shingles(t or "") for t in texts]
    want = list(range(len(texts)))

    def find(x):
        while want[x] != x:
            x = want[x]
        return x

    between = 0
    for i in range(len(texts)):
        for j in range(i):
            s = jaccard(sets[i], sets[j])
            between += 0.8 <= s < 0.95
            if s >= 0.8:
                a, b = sorted((find(i), find(j)))
                want[b] = a
    got = shingle_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), empty=True).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in range(len(texts))}
    assert between > 60


def test_chains_and_hot_groups(spark):
    """Members of one value that are not alike to its hub are compared with one another."""
    w = [f"w{i}" for i in range(200)]
    chain = [" ".join([*w[:200 - 9 * i], *[f"x{i}" for i in range(9 * i)]]) for i in range(8)]
    rows = list(enumerate(chain)) + [(100 + i, " ".join([*w[:100], f"y{i}", *w[101:]])) for i in range(300)]
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0} and len(got) == 308


def test_crowds_below_the_threshold(spark):
    """Texts that share most bands without being copies make few pairs, and the copies among them are found."""
    w = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*w[:45], *[f"z{i}_{k}" for k in range(12)], *w[45:]])) for i in range(200)]
    rows += [(1000 + i, t + " one") for i, t in rows[::10]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.jaccard_components(docs).collect()}
    assert got == {i: i % 1000 for i, _ in rows}


def test_pipeline_stage_drops_near_copies(spark):
    rng = random.Random(22)
    rows = [(i, t or "", "en", "s", len(t or "")) for i, t in enumerate(planted(rng)) if t and len(t.split()) > 20]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    kept = {r["doc_id"] for r in out.collect()}
    sets = {r[0]: shingles(r[1]) for r in rows}
    near = {b for b in sets for a in sets if a < b and 0.8 <= jaccard(sets[a], sets[b]) < 1}
    assert out.columns == docs.columns and len(near) > 60 and not near & kept
    assert {i for i in sets if i < 60} <= kept


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "A  b"), (2, None), (3, " \n"), (4, "c")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in shingle_join.jaccard_components(docs, empty=True).collect()}
    assert got == {(1, 1), (None, 1), (2, 2), (3, 2), (4, 4)}
    assert shingle_join.first_of_each(docs.where("false")).count() == 0


def test_near_copies_that_lost_their_equal_lines_are_found(spark, tmp_path):
    """The line stage leaves only the altered lines of a near copy, which is still dropped; own lines keep their document."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    texts, altered = {}, []
    for i in range(12):
        of = [[word() for _ in range(25)] for _ in range(8)]
        texts[i] = "\n".join(" ".join(x) for x in of)
        if i < 8:
            copy = [list(x) for x in of]
            for k in range(1 + i % 3):
                copy[k][12] = word()
            texts[100 + i] = "\n".join(" ".join(x) for x in copy)
            altered.append(100 + i)
        else:
            texts[100 + i] = texts[i] + "\n" + " ".join(word() for _ in range(20))
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(None, texts[3] + "\nmore of it", "en", "s", 0), (500, "", "en", "s", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    read = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IS NOT NULL")
    left = corpus_pipeline.line_dedup(spark, read, folder).cache()
    sets = {r["doc_id"]: shingles(r["text"]) for r in left.collect()}
    assert all(x in sets and jaccard(sets[x], sets[x - 100]) < 0.8 <= jaccard(shingles(texts[x]), shingles(texts[x - 100])) for x in altered)
    out = corpus_pipeline.near_duplicates(spark, left, folder)
    assert out.columns == left.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(got) == set(sets) - set(altered) and {108, 109, 110, 111} <= set(got)
    assert all(got[i] == r for i, r in {r["doc_id"]: r["text"] for r in left.collect()}.items() if i in got)
    # Nothing was taken out: the same as without the texts as they were.
    named = spark.read.parquet(f"{folder}/documents.parquet")
    assert sorted(map(str, corpus_pipeline.near_duplicates(spark, named, folder).collect())) == sorted(map(str, corpus_pipeline.near_duplicates(spark, named, "").collect()))
    assert corpus_pipeline.near_duplicates(spark, named.where("false"), folder).count() == 0
