"""Secret scan: fixed patterns, and Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import small_batches

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS, ACCESS_CHARS = 12, 18

KINDS = ("assign", "access", "hex", "model")
#: Strings that the models judge, and the words that stand for ordinary identifiers.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ORDINARY = re.compile(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z_-]{3,}(?![A-Za-z0-9])")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Bound of the rows that are learned from, smoothing of each model, and the least log-likelihood ratio per character.
FIT_ROWS, SMOOTH_RANDOM, SMOOTH_ORDINARY, LEAST_RATIO = 20_000, 1.0, 0.05, 0.5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    # A run of hex digits is one match however it is asked for, so the length can stand in the pattern.
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _labelled(text: str) -> Iterator[tuple[int, str]]:
    """Labelled strings of a text: 1 the values that base patterns found, 0 the words outside of them."""
    spans = base_spans(text)
    for start, kind, end in spans:
        value = text[start:end] if kind else ASSIGN.match(text, start)[2]
        yield 1, value
    at = 0
    for start, _, end in [*spans, (len(text), 0, len(text))]:
        for m in ORDINARY.finditer(text, at, max(at, start)):
            yield 0, m[0]
        at = max(at, end)


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text") -> dict[str, float]:
    """Log-likelihood ratios of character pairs (`^` before a first character), random against ordinary.

    Labelled strings come from about FIT_ROWS rows chosen by a hash of their text; each task counts its own pairs, and
    the counts, of which there are at most as many as pairs of the alphabet, are added before they reach the driver.
    """
    total = docs.count()
    share = min(1.0, FIT_ROWS / max(total, 1))
    chosen = docs.select(F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    if share < 1:
        chosen = chosen.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                for label, value in _labelled(t):
                    seen.update((label, a + b) for a, b in zip("^" + value, value))
        yield pd.DataFrame([(label, pair, n) for (label, pair), n in seen.items()], columns=["label", "pair", "n"])

    small_batches(docs.sparkSession)
    summed = chosen.mapInPandas(count, "label int, pair string, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    counts = [Counter(), Counter()]
    for label, pair, n in summed:
        counts[label][pair] += n
    # A random string has as many different pairs as it can: unseen ones cost it less than an ordinary word.
    models = [_logs(counts[0], SMOOTH_ORDINARY), _logs(counts[1], SMOOTH_RANDOM)]
    return {pair: models[1][pair] - models[0][pair] for pair in models[0]}


def _logs(counts: Counter, smooth: float) -> dict[str, float]:
    out = {}
    for a in "^" + ALPHABET:
        whole = sum(counts[a + b] for b in ALPHABET) + smooth * len(ALPHABET)
        out |= {a + b: math.log((counts[a + b] + smooth) / whole) for b in ALPHABET}
    return out


def model_spans(text: str, ratios: dict[str, float], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that touch no base span and are likelier random than ordinary."""
    out = []
    for m in CANDIDATE.finditer(text):
        value = m[0]
        if sum(ratios[a + b] for a, b in zip("^" + value, value)) >= LEAST_RATIO * len(value) and not any(s < m.end() and m.start() < e for s, _, e in taken):
            out.append((m.start(), 3, m.end()))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, ratios: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_model, base_spans, spans) of every row; spans are `kind:start:end` in code points.

    A null text is an empty one and has no spans; repeated rows give equal rows, an empty table an empty one. Spans are
    sorted by start, then kind; the model adds spans and takes none away.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_model long, base_spans string, spans string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for t in batch:
                t = t or ""
                base = base_spans(t)
                more = model_spans(t, ratios, base)
                n = Counter(k for _, k, _ in base)
                rows.append((n[0], n[1], n[2], len(more), _joined(base), _joined(sorted(base + more))))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_model", "base_spans", "spans"])

    return docs.select(F.col(key).alias("doc_id"), find(F.col(text).cast("string")).alias("found")).select("doc_id", "found.*")
