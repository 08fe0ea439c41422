"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import held_out, small_batches

#: Bounds of what is learned from: rows, and lines of a row (longer texts are scored, not learned from).
FIT_ROWS, FIT_LINES = 4_000, 400
ROUNDS, STEP, RIDGE = 200, 0.1, 1e-3
GOOD = 0.3

# Byte classes: 0 other punctuation, 1 upper, 2 lower, 3 digit, 4 blank, 5 exclamation, 6 symbol, 7 beyond ASCII.
CLASS = np.zeros(256, dtype=np.int64)
for _n, _chars in ((1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"abcdefghijklmnopqrstuvwxyz"), (3, b"0123456789"), (4, b" \t\r\n\x0b\x0c"), (5, b"!?"), (6, b"#*$%&|<>")):
    CLASS[np.frombuffer(_chars, dtype=np.uint8)] = _n
CLASS[128:] = 7
OWN = 14
#: Of these features a line also sees those of the line before and after it.
SEEN = [1, 5, 6, 9, 10]
WIDTH = OWN + 2 * len(SEEN) + 2


@dataclass
class Model:
    """Standardization, emission weights, log transitions [from][to], start, and the line from quality to score."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    start: float
    slope: float
    shift: float


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """One row of WIDTH features for each line of a text, and the bytes of the lines."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    ends = data == 10
    line = np.cumsum(ends) - ends
    n = int(ends.sum()) + 1
    kinds = np.bincount(line * 8 + CLASS[data], minlength=8 * n).reshape(n, 8)[:n].astype(float)
    size = kinds.sum(axis=1)
    x = np.zeros((n, WIDTH))
    x[:, 0] = np.log1p(size)
    x[:, 1:9] = (kinds / np.maximum(size, 1)[:, None])[:, [1, 2, 3, 4, 5, 6, 0, 7]]
    before: set[str] = set()
    for i, raw in enumerate(text.split("\n")):
        w = raw.split()
        if w:
            x[i, 9] = 1 - len(set(w)) / len(w)
            x[i, 10] = sum(map(str.__eq__, w, w[1:])) / len(w)
            x[i, 11] = log(len(raw) / len(w))
            x[i, 12] = len(w) < 3
            x[i, 13] = raw in before
            before.add(raw)
    k = len(SEEN)
    x[1:, OWN : OWN + k] = x[:-1, SEEN]
    x[:-1, OWN + k : OWN + 2 * k] = x[1:, SEEN]
    x[0, -2] = x[-1, -1] = 1
    return x, size + 1


def marginals(emission: np.ndarray, moves: np.ndarray, start: float) -> np.ndarray:
    """P(line is good) of one chain, by log ratios of forward and backward messages."""
    (bb, bg), (gb, gg) = np.exp(moves).tolist()
    e = np.clip(emission, -30, 30).tolist()
    forward, r = [], start + e[0]
    forward.append(r)
    for v in e[1:]:
        g = exp(min(max(r, -30), 30))
        r = v + log((bg + gg * g) / (bb + gb * g))
        forward.append(r)
    out, b = np.empty(len(e)), 0.0
    for i in range(len(e) - 1, -1, -1):
        out[i] = 1 / (1 + exp(-min(max(forward[i] + b, -30), 30)))
        g = exp(min(max(e[i] + b, -30), 30))
        b = log((gb + gg * g) / (bb + bg * g))
    return out


def _chains(emission: np.ndarray, at: np.ndarray, length: np.ndarray, moves: np.ndarray, start: float):
    """Forward and backward log messages of many chains at once; chains are sorted by length, longest first."""
    alpha, beta = np.zeros((len(emission), 2)), np.zeros((len(emission), 2))
    e = np.stack([np.zeros_like(emission), emission], axis=1)
    alpha[at] = e[at] + np.array([0.0, start])
    for t in range(1, int(length[0])):
        i = at[: int((length > t).sum())] + t
        alpha[i] = e[i] + np.logaddexp(alpha[i - 1, 0, None] + moves[0], alpha[i - 1, 1, None] + moves[1])
    for t in range(int(length[0]) - 2, -1, -1):
        i = at[: int((length > t + 1).sum())] + t
        nxt = e[i + 1] + beta[i + 1]
        beta[i] = np.logaddexp(moves[:, 0] + nxt[:, 0, None], moves[:, 1] + nxt[:, 1, None])
    return e, alpha, beta


def fit(samples: list[tuple[int, np.ndarray, np.ndarray]]) -> Model | None:
    """Likelihood ascent (Adam) on chains whose lines all bear the label of their document; None without any."""
    samples = sorted((s for s in samples if len(s[1])), key=lambda s: -len(s[1]))
    if not samples:
        return None
    x = np.concatenate([s[1] for s in samples])
    length = np.array([len(s[1]) for s in samples])
    at = np.concatenate([[0], np.cumsum(length)[:-1]])
    label = np.repeat([s[0] for s in samples], length).astype(int)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.clip((x - mean) / spread, -8, 8)
    inner = np.ones(len(x), dtype=bool)
    inner[at] = False
    i = np.flatnonzero(inner)
    target_moves = np.zeros((2, 2))
    np.add.at(target_moves, (label[i - 1], label[i]), 1)
    p = np.zeros(WIDTH + 1 + 5)  # weights, bias, moves, start
    m, v = np.zeros_like(p), np.zeros_like(p)
    for k in range(1, ROUNDS + 1):
        moves, start = p[WIDTH + 1 : WIDTH + 5].reshape(2, 2), p[-1]
        e, alpha, beta = _chains(z @ p[:WIDTH] + p[WIDTH], at, length, moves, start)
        last = at + length - 1
        whole = np.repeat(np.logaddexp(alpha[last, 0], alpha[last, 1]), length)
        good = np.exp(alpha[:, 1] + beta[:, 1] - whole)
        both = np.exp(alpha[i - 1][:, :, None] + moves[None] + (e[i] + beta[i])[:, None, :] - whole[i][:, None, None])
        rest = label - good
        grad = np.concatenate([z.T @ rest, [rest.sum()], (target_moves - both.sum(axis=0)).ravel(), [rest[at].sum()]]) / len(x) - RIDGE * p
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p + STEP * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    model = Model(mean, spread, p[: WIDTH + 1], p[WIDTH + 1 : WIDTH + 5].reshape(2, 2), float(p[-1]), 1.0, 0.0)
    q = np.array([_logit(document_quality(s[1], s[2], model)) for s in samples])
    y = np.array([s[0] for s in samples], dtype=float)
    a, b = 1.0, 0.0
    for _ in range(500):  # the line that turns quality into a probability
        r = y - 1 / (1 + np.exp(-(a * q + b)))
        a, b = a + 0.05 * float((r * q).mean() - 1e-3 * a), b + 0.5 * float(r.mean())
    model.slope, model.shift = max(a, 1e-3), b
    return model


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return log(p / (1 - p))


def document_quality(x: np.ndarray, size: np.ndarray, model: Model) -> float:
    """Length-weighted mean of the lines' marginals."""
    z = np.clip((x - model.mean) / model.spread, -8, 8)
    return float(np.average(marginals(z @ model.weights[:-1] + model.weights[-1], model.moves, model.start), weights=size))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """A model from at most FIT_ROWS labelled rows outside the held-out fold, in the order of a hash of the key.

    Labels other than 0 and 1, null keys and texts, and texts of more than FIT_LINES lines are not learned from. Line
    features are made in the tasks; the driver gets the features of the sample only.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    known = known.where(F.col("k").isNotNull() & ~held_out(F.col("k"))).withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(FIT_ROWS)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t is not null")
    # One row for each key of the sample, which FIT_ROWS bounds.
    sample = rows.join(F.broadcast(known), "k").where(F.size(F.split("t", "\n", -1)) <= FIT_LINES).dropDuplicates(["k"])

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [line_features(t) for t in batch["t"]]
            yield pd.DataFrame({"h": batch["h"], "y": batch["y"], "x": [m[0].astype("<f4").tobytes() for m in made], "size": [m[1].astype("<f4").tobytes() for m in made]})

    small_batches(docs.sparkSession)
    got = sample.select("h", "y", "t").mapInPandas(features, "h long, y int, x binary, size binary")
    return fit([
        (r["y"], np.frombuffer(r["x"], "<f4").reshape(-1, WIDTH).astype(float), np.frombuffer(r["size"], "<f4").astype(float))
        for r in sorted(got.toLocalIterator(), key=lambda r: (r["h"], r["x"]))
    ])


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_lines, n_good_lines) of every row; whole texts, row by row, without a shuffle.

    A null text counts as an empty one, which is one empty line. Without a model (no labelled row) every score is 0.5.
    Repeated rows give equal rows; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("score double, n_lines long, n_good_lines long")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                x, size = line_features(t or "")
                if model is None:
                    rows.append((0.5, len(x), 0))
                    continue
                z = np.clip((x - model.mean) / model.spread, -8, 8)
                good = marginals(z @ model.weights[:-1] + model.weights[-1], model.moves, model.start)
                q = _logit(float(np.average(good, weights=size)))
                rows.append((1 / (1 + exp(-(model.slope * q + model.shift))), len(x), int((good >= 0.5).sum())))
            yield pd.DataFrame(rows, columns=["score", "n_lines", "n_good_lines"])

    found = docs.select(F.col(key).alias("doc_id"), judge(F.col(text).cast("string")).alias("found")).select("doc_id", "found.*")
    return found.select("doc_id", "score", (F.col("score") >= GOOD).cast("int").alias("predicted"), "n_lines", "n_good_lines")
