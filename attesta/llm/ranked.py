"""Ranked lexical search: an automaton of all item terms scans the documents, which are never indexed."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import lower_ascii

#: Characters that end a term: all of ASCII but letters and digits.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: What one automaton holds at most: rows (item, term) and bytes of their terms. More items are scanned for in blocks.
BLOCK_TERMS, BLOCK_BYTES = 200_000, 16 << 20
#: Scores held at once in a task: documents times items.
CELLS = 1 << 20
#: Groups in which the lists of the tasks are merged before they meet.
MERGES = 64
#: Every byte as the automaton sees it: letters in lower case, a blank for whatever ends a term.
_SEEN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term): the different terms of each item; rows that share an id are one item, rows without an id none."""
    cleaned = lower_ascii(F.coalesce(F.col(text).cast("string"), F.lit("")))
    split = items.where(F.col(key).isNotNull()).select(F.col(key).alias("item_id"), F.explode(F.split(cleaned, BREAK, -1)).alias("term"))
    return split.where("term <> ''").distinct()


class _Block:
    """Terms of a block of items: automaton, and for each term the items that hold it."""

    def __init__(self, rows: list) -> None:
        self.items = list(dict.fromkeys(r["item_id"] for r in rows))
        place = {x: i for i, x in enumerate(self.items)}
        terms = list(dict.fromkeys(r["term"] for r in rows))
        number = {t: i for i, t in enumerate(terms)}
        held = np.array([(number[r["term"]], place[r["item_id"]]) for r in rows], dtype=np.int64)
        held = held[np.lexsort((held[:, 1], held[:, 0]))]
        self.begins = np.searchsorted(held[:, 0], np.arange(len(terms) + 1))
        self.holders = held[:, 1].copy()
        self.n_terms = len(terms)
        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            self.automaton.add_word(f" {term.encode().decode('latin-1')} ", i)
        self.automaton.make_automaton()

    def counts(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of terms of the text; terms of the block in it, and how often each occurs."""
        seen = text.translate(_SEEN)
        found = Counter(map(itemgetter(1), self.automaton.iter(f" {seen.decode('latin-1')} ")))  # a character stands for a byte
        n = len(found)
        return len(seen.split()), np.fromiter(found.keys(), np.int64, n), np.fromiter(found.values(), np.int64, n)


def _terms_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))


def _statistics(docs: DataFrame, shared: Broadcast) -> dict[int, int]:
    """Documents by term of the block; under -1 the documents that have a term at all, under -2 the terms of all of them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        df, some, total = np.zeros(block.n_terms, dtype=np.int64), 0, 0
        for batch in batches:
            for value in batch.column("text"):
                n, terms, _ = block.counts(value.as_py())
                df[terms] += 1
                some, total = some + (n > 0), total + n
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*held, -1, -2], pa.int64()), pa.array([*df[held], some, total], pa.int64())], ["term", "n"])

    counted = docs.select("text").mapInArrow(scan, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counted.collect()}  # as many rows as the block has terms, and two


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    return found.sort_values(["item", "score", "doc_id"], ascending=[True, False, True], kind="stable").groupby("item", sort=False).head(k)


def _scored(docs: DataFrame, shared: Broadcast, weights: Broadcast, some: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of every task for each item of the block."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, weight = shared.value, weights.value
        wide = len(block.items)
        held, least = pd.DataFrame({"item": [], "doc_id": [], "score": []}), np.zeros(wide, dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), step := max(1, CELLS // wide)):
                part = batch.iloc[at : at + step]
                rows, parts = [], []
                for row, raw in enumerate(part["text"]):
                    n, terms, tf = block.counts(raw)
                    if len(terms):
                        m = 100 - 50 + 50 * n * some // total
                        parts.append((terms, weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))))
                        rows.append(np.full(len(terms), row))
                if not rows:
                    continue
                terms, gains = (np.concatenate(x) for x in zip(*parts, strict=True))
                spans = block.begins[terms + 1] - block.begins[terms]
                ends = np.cumsum(spans)
                slots = np.arange(ends[-1]) - np.repeat(ends - spans, spans) + np.repeat(block.begins[terms], spans)
                score = np.zeros(len(part) * wide, dtype=np.int64)
                np.add.at(score, np.repeat(np.concatenate(rows), spans) * wide + block.holders[slots], np.repeat(gains, spans))
                good = np.flatnonzero(score.reshape(len(part), wide) >= np.maximum(least, 1))
                fresh = pd.DataFrame({"item": good % wide, "doc_id": part["doc_id"].to_numpy()[good // wide], "score": score[good]})
                fresh = fresh[fresh["doc_id"].notna()]
                held = _best(fresh if held.empty else pd.concat([held, fresh]), k)
                full = held.groupby("item")["score"].agg(["size", "min"])
                full = full[full["size"] >= k]
                least[full.index.to_numpy(dtype=np.int64)] = full["min"].to_numpy()
        yield held

    return docs.mapInPandas(scan, f"item int, doc_id {kind}, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, by integer scores over the terms of the item.

    Terms are runs of characters other than ASCII punctuation, blanks and controls, A-Z lower-cased. With N documents
    that have a term, L terms in all of them, n in a document, a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))),
    a document's length measure 50 + 50 n N div L, and a score sums weight * (1e9 tf div (1000 tf + 20 measure)).

    One pass of the automaton counts documents by term, a second one scores; a task keeps its k best documents of each
    item, so that nothing grows with the corpus but the reading of it. The automaton is broadcast: items are cut into
    blocks by a hash of their id, as many as the counted terms and bytes ask for, and each block has its own passes.

    A null text has no terms. Documents without an id count in N, L and df, but can't be ranked. Every row is a
    document of its own, also where ids or texts repeat; equal scores are ordered by id. Rows of one item id are one
    item; items without an id or without terms have no rows, nor has a document at score 0. Empty tables give an empty one.
    """
    spark = docs.sparkSession
    wanted, read = item_terms(items, item_key, item_text), _terms_of(docs, key, text)
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // BLOCK_TERMS), -(-size["bytes"] // BLOCK_BYTES))
    kinds = dict(items.select(F.col(item_key).alias("item_id")).dtypes)["item_id"], dict(read.dtypes)["doc_id"]
    best = spark.createDataFrame([], f"item_id {kinds[0]}, doc_id {kinds[1]}, score long, task int")
    for i in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).orderBy("item_id", "term").collect()
        if not rows:
            continue
        block = _Block(rows)
        shared = spark.sparkContext.broadcast(block)
        known = _statistics(read, shared)
        some, total = known.get(-1, 0), known.get(-2, 0)
        weight = np.array([math.floor(1000 * math.log((2 * some + 2) / (2 * known.get(t, 0) + 1))) for t in range(block.n_terms)], dtype=np.int64)
        found = _scored(read, shared, spark.sparkContext.broadcast(weight), some, total, k)
        names = spark.createDataFrame(list(enumerate(block.items)), f"item int, item_id {kinds[0]}")
        best = best.unionByName(found.withColumn("task", F.spark_partition_id()).join(F.broadcast(names), "item").select("item_id", "doc_id", "score", "task"))
    order = [F.desc("score"), F.col("doc_id")]
    first = F.row_number().over(Window.partitionBy("item_id", "merge").orderBy(*order))
    merged = best.withColumn("merge", F.pmod("task", F.lit(MERGES))).withColumn("rank", first).where(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
