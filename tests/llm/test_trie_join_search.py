"""Prefix trie, shingle join and ranked search against plain brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attesta.llm import prefix_trie, ranked, shingle_join

TURNS = "conv_id long, turn long, role string, text string, extra string, node long"
DOCS = "doc_id long, text string, n int, tokens string, item string"


def head_of(c):
    return zlib.crc32(str(c).encode()) % 9


def plain_trie(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {c: tuple(own.get(c - c % 5, [])[: head_of(c)] + v[head_of(c) :]) for c, v in own.items()}
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    out = set()
    for p, cs in members.items():
        under = [(q, x) for q, x in members.items() if q[: len(p)] == p]
        kids = lambda q: sum(len(r) == len(q) + 1 and r[: len(q)] == q for r in members)
        last = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(p))
        out.add((
            min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids(p), sum(kids(q) == 0 for q, _ in under),
            sum((len(x) - 1) * len(q[-1][1].encode()) for q, x in under if q), hashlib.sha256(last.encode()).hexdigest(),
        ))
    return out


def grown(spark, rows, bound):
    turns = prefix_trie.ordered_turns(spark.createDataFrame(rows, TURNS))
    c = F.col("conv_id")
    got = prefix_trie.trie(*prefix_trie.grafted(turns, F.crc32(c.cast("string").cast("binary")) % 9, c - c % 5), bound=bound)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_turns(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(60), 45):
        for t in range(rng.choice([0, 1, 2, 5, 9, 12])):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["a", "é", "xyz"]), "e", 1))
    return rows


@pytest.mark.parametrize(("seed", "bound"), [(1, 2), (2, 16), (3, 2048)])
def test_trie_matches_brute_force(spark, seed, bound):
    rows = some_turns(seed) + [(7, None, None, None, None, None), (200, None, "user", "a", None, 3), (None, 1, "user", "lost", None, 3)]
    assert grown(spark, rows, bound) == plain_trie(rows)


def test_trie_of_copies_and_of_one_long_chain(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    copies = [(5 * c, t, "user", f"turn {t}", None, None) for c in range(40) for t in range(3)]
    chain = [(1000, t, "user", "same", None, None) for t in range(150)]
    assert grown(spark, copies + chain, 8) == plain_trie(copies + chain)


def test_trie_of_nothing(spark):
    assert grown(spark, [], 4) == set()


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def shingles(text):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain_components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(s), least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def near_texts(seed, families, members):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 9, 40, 120]))]
        for _ in range(members):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = rng.choice([*vocabulary, f"own{rng.random()}"])
            if rng.random() < 0.1:
                w = w + passage
            texts.append(" ".join(w).title() if rng.random() < 0.2 else "  ".join(w))
    texts += ["", None, " \n", "one two", "ONE two", "a a a a a", "a a a a a a a", "one  two three", "x" * 5000]
    rng.shuffle(texts)
    return [(i, t, 1, "t", None) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "families", "members", "bits"), [(1, 12, 12, 2), (2, 3, 60, 3), (3, 25, 5, 8)])
def test_shingle_join_matches_brute_force(spark, monkeypatch, seed, families, members, bits):
    monkeypatch.setattr(shingle_join, "CHUNK", 700)
    rows = near_texts(seed, families, members)
    got = shingle_join.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3), block_bits=bits)
    assert sorted(tuple(r) for r in got.collect()) == plain_components(rows)


def test_shingle_join_with_repeated_and_null_keys(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(4, text, 1, "", ""), (4, text, 1, "", ""), (None, text, 1, "", ""), (None, "quite another text of words", 1, "", ""), (9, text + " end", 1, "", "")]
    got = shingle_join.jaccard_components(spark.createDataFrame(rows, DOCS))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(4, 26, 4), (4, 26, 4), (None, 26, 4), (None, 1, None), (9, 27, 4)]))
    assert shingle_join.jaccard_components(spark.createDataFrame([], DOCS)).collect() == []


def test_prefix_is_lengthened_where_tokens_are_frequent():
    import numpy as np

    rare, hot = np.full(84, 2), np.repeat([3500, 5000], 42)
    assert shingle_join.prefix_length(rare, 100, 80) == (1, 5)
    matches, length = shingle_join.prefix_length(hot, 400, 80)
    assert matches > 3
    assert length == matches + 4


def plain_ranks(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    counts = [(d, Counter(terms(t))) for d, t, *_ in docs]
    some, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    wanted = {}
    for i, t, *_ in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    for i, ws in wanted.items():
        found = []
        for d, c in counts:
            n = sum(c.values())
            m = 100 - 50 + (50 * n * some) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * some + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in ws if c[w])
            if score and d is not None:
                found.append((-score, d))
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [8, 1 << 20])
@pytest.mark.parametrize("terms", [3, 200_000])
def test_ranks_match_brute_force(spark, monkeypatch, cells, terms):
    monkeypatch.setattr(ranked, "CELLS", cells)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", terms)
    rng = random.Random(cells + terms)
    pool = ["Ä", "é1", "the", "THE", "a", "b-c", "x_y", "10", "naïve", "日本", "\x7f", "end."]
    docs = [(i, rng.choice([" ", "\n", ",", "\x00"]).join(rng.choices(pool, k=rng.randrange(0, 40))), 1, "", "") for i in range(60)]
    docs += [(60, None, 1, "", ""), (None, "the the a", 1, "", ""), (3, "the a", 1, "", ""), (61, "long " * 20000 + "naïve", 1, "", "")]
    items = [(i, " ".join(rng.choices(pool, k=rng.randrange(1, 8))), "x") for i in range(7)] + [(7, None, "x"), (None, "the", "x"), (3, "the", "x"), (8, "ï b", "x")]
    got = ranked.ranked(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, "item_id long, text string, score string"), k=5)
    assert sorted(tuple(r) for r in got.collect()) == plain_ranks(docs, items, 5)


def test_ranks_of_nothing(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert ranked.ranked(docs, items).collect() == []
    assert ranked.ranked(spark.createDataFrame([(1, "the", 1, "", "")], DOCS), items.limit(0)).collect() == []
