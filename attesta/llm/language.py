"""Language identification by compression against one raw-content dictionary per language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import held_out, small_batches, unused

UNKNOWN = "und"
#: Bounds of what is learned: rows asked for in each language, bytes kept of them, and languages.
FIT_ROWS, FIT_BYTES, FIT_LANGUAGES = 200, 64 << 10, 256
BLOCK = 16 << 10
#: A text of at most SHORT bytes is encoded in up to ROTATIONS rotations, as whole bytes are too coarse a measure for one.
SHORT, ROTATIONS = 256, 16
#: Short matches count in short texts; small tables make the start of each block cheap.
CODER = {"min_match": 4, "strategy": zstandard.STRATEGY_LAZY, "hash_log": 15, "chain_log": 15, "search_log": 3, "window_log": 17}
#: A narrow margin: the best encoding saves less than this share of the second best one.
MARGIN = 0.002
RESULT = "lang_pred string, score double, margin double, rejected boolean"


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """One dictionary per language, the most frequent language first, from a bounded sample of labelled rows outside the held-out fold.

    For each language FIT_ROWS rows in the order of a hash of the key are taken (rows beyond that number never
    leave their tasks) and joined, in lower case and without repeats, up to FIT_BYTES. Rows with null text, null lang or null key are not
    learned from. More than FIT_LANGUAGES languages are an error, which bounds what the driver and the tasks hold.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where(
        "k is not null and l is not null and t is not null"
    )
    rows = rows.where(~held_out(F.col("k"))).select("l", "t", F.xxhash64("k").alias("h"))
    first = Window.partitionBy("l").orderBy("h", "t")
    sample = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= FIT_ROWS).dropDuplicates(["l", "t"])
    # A row can't add more than the whole bound; what lies beyond is never sent to the driver.
    share = sample.select("l", "r", F.substring("t", 1, FIT_BYTES).alias("t"), F.sum(F.octet_length("t")).over(Window.partitionBy("l").orderBy("r")).alias("upto"))
    found: dict[str, bytearray] = {}
    for l, t in share.where(F.col("upto") - F.octet_length("t") < FIT_BYTES).orderBy("l", "r").select("l", "t").toLocalIterator():
        found.setdefault(l, bytearray()).extend(t.lower().encode() + b"\n")
        if len(found) > FIT_LANGUAGES:
            raise ValueError(f"more than {FIT_LANGUAGES} languages")
    frequent = rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(FIT_LANGUAGES)
    return {l: bytes(found[l][:FIT_BYTES]) for l, _ in frequent.collect() if l in found}


def classifier(dictionaries: dict[str, bytes]):
    """A pandas UDF text -> RESULT. Whole texts are encoded in blocks of BLOCK bytes with every dictionary."""
    names = list(dictionaries)

    @F.pandas_udf(RESULT)
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coders = []
        for name in names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, **CODER)
            content.precompute_compress(compression_params=how)
            coders.append(zstandard.ZstdCompressor(dict_data=content, compression_params=how))
        for batch in batches:
            yield pd.DataFrame([_verdict(t, names, coders) for t in batch], columns=["lang_pred", "score", "margin", "rejected"])

    return classify


def _verdict(text: str | None, names: list[str], coders: list) -> tuple[str, float, float, bool]:
    if text is None or not names or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, 0.0, True
    data = text.lower().encode("utf-8", "replace")
    if len(data) <= SHORT:
        blocks = [data[i:] + b" " + data[:i] for i in range(min(len(data), ROTATIONS))]
    else:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    sizes = np.array([sum(len(c.compress(b)) for b in blocks) for c in coders], dtype=float)
    order = np.argsort(sizes, kind="stable")
    best, second = sizes[order[0]], sizes[order[1]] if len(names) > 1 else 2 * sizes[order[0]]
    margin = (second - best) / second
    # Saved bits, as a share of the text, say how sure the choice is.
    odds = np.exp(np.clip((sizes.min() - sizes) / sizes.min() * 100, -60, 0))
    return names[order[0]], float(1 / odds.sum()), float(margin), bool(margin < MARGIN)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", into: str = "language") -> DataFrame:
    """All rows and columns of `docs` plus the struct column `into` (lang_pred, score, margin, rejected).

    A null text and a text without letters are `und`, score 0, rejected. Where the shortest encodings are equally
    long the language that is most frequent among the learned rows is named and the row is rejected, as is any row with a margin under MARGIN. An empty
    table gives an empty one; without any dictionary every row is `und`.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(into, classifier(dictionaries)(F.col(text)))


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """The rows of `docs`, columns unchanged, whose language is not rejected."""
    (into,) = unused(docs, "language")
    return identify(docs, dictionaries, text, into).where(~F.col(f"{into}.rejected")).drop(into)
