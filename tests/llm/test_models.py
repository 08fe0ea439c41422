"""Held-out accuracy of the learned operators, and the pipeline over a small corpus with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attesta.llm import language, quality
from attesta.llm.common import held_out

SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "de": "sch ein ich der ung keit auf zu ver ge".split(), "es": "ción que los ado ar mente el ia ue do".split()}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang, rng.randrange(20, 60)), lang) for i in range(300) for lang in [rng.choice(sorted(SYLLABLES))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.identify(docs, language.learn(docs)).where(held_out(F.col("doc_id")))
    assert out.select(F.avg((F.col("lang") == F.col("language.lang_pred")).cast("int"))).first()[0] > 0.95
    mixed = spark.createDataFrame([(0, "0123 4567 é")], "doc_id long, text string")
    assert language.identify(mixed, {"aa": b"x" * 100, "bb": b"x" * 100}).select("language.rejected").first()[0]


def test_quality_accuracy(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        good = int(i % 3 > 0)
        ls = [sentence(rng, "en", rng.randrange(5, 15)).capitalize() + "." for _ in range(rng.randrange(3, 9))]
        rows.append((i, "\n".join(ls if good else [x.upper().replace(" ", "!! ") for x in ls])))
        labels.append((i, good))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.score(docs, quality.learn(docs, known)).join(known, "doc_id").where(held_out(F.col("doc_id")))
    assert out.where("predicted <> quality").count() == 0


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    texts = {i: "\n".join(sentence(rng, lang, 30) + "." for _ in range(5)) for i in range(60) for lang in [sorted(SYLLABLES)[i % 3]]}
    item, shared = sentence(rng, "en", 25), sentence(rng, "en", 60)
    texts[60], texts[61] = texts[0], texts[0]
    texts[62] = texts[1] + "\n" + item
    for i in (2, 3, 4):
        texts[i] += "\n" + shared
    texts[63], texts[64] = "12 34", None
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, sorted(SYLLABLES)[i % 3], "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, shared


def test_pipeline(spark, corpus):
    folder, texts, shared = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).cache()
        if name != "encode":
            assert out.columns == columns
            docs = out
        kept[name] = {r["doc_id"]: r.asDict() for r in out.collect()}
    assert set(kept["language_id"]) == set(texts) - {63, 64}
    assert set(kept["line_dedup"]) == set(kept["language_id"]) - {60, 61}  # copies of the first document as a whole
    assert sum(shared in r["text"] for r in kept["line_dedup"].values()) == 1
    assert all(kept["line_dedup"][i]["text"] == texts[i] for i in range(5, 60))
    assert all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"].values())
    assert set(kept["near_duplicates"]) == set(kept["line_dedup"])
    assert set(kept["decontaminate"]) == set(kept["near_duplicates"]) - {62}
    assert set(kept["encode"]) == set(kept["decontaminate"])
    assert corpus_pipeline.run(spark, folder).count() == len(kept["encode"])
