"""Prefix scans, packing, text keys and quote lookup against brute force."""

import random
import unicodedata

from pyspark.sql import functions as F

from attesta.functions import packing, skew, text
from attesta.operators import chunks as K
from attesta.operators import units as U


def _series(n, seed):
    rng = random.Random(seed)
    return [(("a" if rng.random() < 0.8 else "b"), i, rng.choice([None, None, f"v{i}"]), rng.randint(0, 9)) for i in range(n)]


def test_carry_last_and_running_sum_cross_blocks(spark):
    rows = _series(200, 1)
    df = spark.createDataFrame(rows, "k string, pos long, v string, w int")
    got = skew.carry_last(df, ["k"], "pos", {"last": F.col("v")}, block=16)
    before = skew.carry_last(df, ["k"], "pos", {"prev": F.col("v")}, inclusive=False, block=16)
    sums = skew.running_sum(df, ["k"], "pos", F.col("w"), "total", block=16)
    numbers = skew.ordinal(df, ["k"], "pos", "n", block=16)
    last, total, count, want = {}, {}, {}, {}
    for k, pos, v, w in rows:
        prev = last.get(k)
        last[k] = v if v is not None else prev
        total[k] = total.get(k, 0) + w
        want[pos] = (last[k], prev, total[k], count.get(k, 0))
        count[k] = count.get(k, 0) + 1
    assert {r.pos: r.last for r in got.collect()} == {p: w[0] for p, w in want.items()}
    assert {r.pos: r.prev for r in before.collect()} == {p: w[1] for p, w in want.items()}
    assert {r.pos: r.total for r in sums.collect()} == {p: w[2] for p, w in want.items()}
    assert {r.pos: r.n for r in numbers.collect()} == {p: w[3] for p, w in want.items()}


def _pack(rows, limit):
    out, state = {}, {}
    for k, pos, cost, extra, force, alone in rows:
        group, size = state.get(k, (-1, limit + 1))
        if force or alone or size + cost > limit:
            group, size = group + 1, extra + cost
        else:
            size += cost
        if alone:
            size = limit + 1
        state[k] = (group, size)
        out[(k, pos)] = group
    return out


def test_greedy_groups_match_sequential_packing(spark):
    for seed, limit, block in [(1, 20, 7), (2, 50, 5), (3, 9, 64), (4, 1000, 6), (5, 20, 1)]:
        rng = random.Random(seed)
        rows = [
            (rng.choice("xxy"), i, rng.choice([0, 1, 3, 8, 15]), rng.choice([0, 2]), rng.random() < 0.05, rng.random() < 0.05)
            for i in range(150)
        ]
        df = spark.createDataFrame(rows, "k string, pos long, cost int, extra int, force boolean, alone boolean")
        got = packing.greedy_groups(
            df, ["k"], "pos", F.col("cost"), limit, extra=F.col("extra"), force=F.col("force"), alone=F.col("alone"), block=block
        )
        assert {(r.k, r.pos): r.group_no for r in got.collect()} == _pack(rows, limit), (seed, limit, block)


def test_normalized_matches_python(spark):
    samples = ["  Straße\n Ⅷ  ﬁn ", "plain ASCII", "Élan  VITAL", "ＡＢＣ１", "a b", "†x↑", "İstanbul", "", "ﬀ ß µ"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r.i: r.n for r in df.select("i", text.normalized("s").alias("n")).collect()}
    for i, s in enumerate(samples):
        assert got[i] == " ".join(unicodedata.normalize("NFKC", s).casefold().split()), s


def test_text_spans_are_lossless_in_both_paths(spark):
    rng = random.Random(3)
    texts = ["", "x" * 300, "".join(rng.choice("ab é ") for _ in range(5000)), "word " * 200, "a" * 130 + " " + "b" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    fold = {r.i: r.s for r in df.select("i", K.text_spans(F.col("t"), 128).alias("s")).collect()}
    arrow = {r.i: r.s for r in df.select("i", K._long_spans(128)(F.col("t")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert fold[i] == arrow[i]
        assert "".join(t[s.start : s.end] for s in fold[i]) == t
        assert all(0 < s.end - s.start <= 128 for s in fold[i])


def test_locate_quotes_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "gamma", "delta", "the", "of", "x-ray", "Straße"]
    docs = [(rng.choice(["d1", "d2"]), f"u{i}", " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))) for i in range(60)]
    quotes = []
    for q in range(40):
        doc, ref, body = rng.choice(docs)
        a = rng.randrange(len(body))
        quote = body[a : a + rng.randint(1, 40)].upper()
        quotes.append((doc, q, quote, rng.choice([None, ref, "missing"])))
    u = spark.createDataFrame(docs, "document_id string, evidence_id string, text string")
    q = spark.createDataFrame(quotes, "document_id string, quote_id int, quote string, source_ref string")
    norm = lambda s: " ".join(unicodedata.normalize("NFKC", s).casefold().split())
    known = {(d, e): t for d, e, t in docs}
    want = set()
    for doc, qid, quote, ref in quotes:
        needle = norm(quote)
        if len(needle) < 12:
            if len(needle) >= 2 and (doc, ref) in known and needle == norm(known[(doc, ref)]):
                want.add((qid, ref))
            continue
        pool = [(e, t) for (d, e), t in known.items() if d == doc and (e == ref or (doc, ref) not in known)]
        want |= {(qid, e) for e, t in pool if needle in norm(t)}
    got = {(r.quote_id, r.evidence_id) for r in U.locate_quotes(q, u).collect()}
    assert got == want
