"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from attesta.llm import decontamination, language, lines, pieces, quality, rules, secret_scan, sharding, simhash, surrogates

CLASH = ["h", "id", "line", "w", "fingerprint", "shard", "slot", "language", "score", "found", "hashes", "removed", "kept", "private", "key_of_text", "Hash_Of_Text", "s", "l", "k", "t", "ids", "root", "value"]
LONG = " ".join(f"word{i % 977} item" for i in range(20_000)) + "\n" + "x" * 3_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "a plain text of some words\nand a second line of it", "en", "a"), (2, None, None, None), (3, "", "en", None), (None, "no key at all but a text", None, "a"),
        (4, LONG, "de", "b"), (5, " \t\n \n", "de", "b"), (1, "a plain text of some words\nand a second line of it", "en", "a"), (6, "é▁ß \x00 \U0001f600", "fr", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_language(docs, empty):
    d = language.learn(docs)
    out = {r["doc_id"]: r["lang_found"] for r in language.identify(docs, d, into="lang_found").collect()}
    assert out[2]["lang_pred"] == "und" and out[3]["lang_pred"] == "und" and out[5]["score"] == 0
    assert language.keep_identified(docs, d).columns == docs.columns
    assert language.learn(empty) == {} and language.keep_identified(empty, {}).count() == 0
    assert {r[0] for r in language.identify(docs, {}).select("language.lang_pred").collect()} == {"und"}


def test_lines(docs, empty):
    out = lines.deduplicate_lines(docs, into="gone")
    assert out.columns == [*docs.columns, "gone"] and out.count() == 8
    assert {r["doc_id"]: r["text"] for r in out.collect()}[4] == LONG
    assert lines.deduplicate_lines(empty, into="gone").count() == 0


def test_simhash(docs, empty):
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == 8
    by = {r["doc_id"]: r for r in out}
    assert by[2]["fingerprint"] == by[3]["fingerprint"] == by[5]["fingerprint"] == 0 and by[5]["component_id"] == 2
    assert simhash.first_of_each(docs).columns == docs.columns
    assert simhash.near_duplicates(empty).count() == 0 and simhash.first_of_each(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(7, "a plain text of some"), (8, None), (9, ""), (None, "a plain"), (10, "second line"), (10, "second line")], "item_id long, text string").withColumn("h", F.lit(1))
    assert sorted(map(tuple, decontamination.contaminated(docs, items).select("doc_id", "item_id").collect())) == [(1, 7), (1, 10)]
    left = decontamination.remove_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == 6
    assert decontamination.contaminated(empty, items).count() == 0 and decontamination.contaminated(docs, items.where("false")).count() == 0


def test_surrogates(docs, empty):
    out = surrogates.replace_private(docs, "k", into="found_private")
    assert out.columns == [*docs.columns, "found_private"] and out.count() == 8
    assert surrogates.replace_private(empty, "k").count() == 0


def test_row_operators(spark, docs, empty):
    ratios = secret_scan.learn(docs)
    assert secret_scan.scan(docs, ratios).count() == 8 and secret_scan.scan(empty, secret_scan.learn(empty)).count() == 0
    judged = rules.judged(docs)
    assert judged.count() == 8 and judged.where("kept").count() == 0 and rules.keep_good(docs).columns == docs.columns
    assert rules.judged(empty).count() == 0
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    assert {0 <= r["score"] <= 1 for r in quality.score(docs, model).collect()} == {True}
    assert quality.learn(empty, labels) is None and {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(empty, None).count() == 0


def test_shards(docs, empty):
    out = sharding.assign_shards(docs, 3).collect()
    assert len(out) == 8 and sum(r["size"] for r in out) == sum(len((r["text"] or "").encode()) + 8 for r in docs.collect())
    assert sharding.assign_shards(empty, 3).count() == 0


def test_pieces(docs, empty):
    out = pieces.decoded(pieces.encoded(docs)).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(out) == 8 and all(r["decoded"] == texts[r["doc_id"]] for r in out)
    by = {r["doc_id"]: r for r in out}
    assert by[2]["ids"] is None and by[3]["ids"] == [] and by[3]["score"] == 0
    assert pieces.encoded(empty).count() == 0


def test_ids_are_joined_to_texts_a_column_at_a_time():
    """Lists of ids become texts without a Python object for every id; nulls, empty lists and bytes of longer characters as by `decode`."""
    import numpy as np
    import pyarrow as pa
    from attesta.llm import pieces as P

    v = P.Vocabulary(*P.read_vocabulary())
    texts = ["plain words, twice plain", "", None, "\U000133e5 and \u2581 é\n\n x", "a  b", "\x00\x7f"]
    done = [None if t is None else P.encode(t, v, 4)[0].tolist() for t in texts]
    lists = pa.array(done * 2, pa.list_(pa.int32()))
    assert P._decoded(lists, P._plain(v), v).to_pylist() == texts * 2
    assert P._decoded(lists[1:5], P._plain(v), v).to_pylist() == texts[1:5]
    h = np.concatenate([v.hashes, v.hashes + np.uint64(1)])
    at = P._found(h, v)
    assert (at[: len(v.hashes)] == np.arange(len(v.hashes))).all()
    assert all((i < 0) != (x in set(v.hashes.tolist())) for i, x in zip(at[-50:].tolist(), h[-50:].tolist()))
