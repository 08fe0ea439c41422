"""One query for each operator over its whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import decontamination, language, lines, oracles, pieces, prefix_trie, quality, ranked, rules, secret_scan, sharding, shingle_join, simhash, surrogates
from attesta.llm.common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS = 24


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@_query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs), into="language")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.*")


@_query
def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


@_query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines that are copies of an earlier line, where that line is, and a digest of what stays."""
    left = lines.deduplicate_lines(table(spark, sf_dir, "documents"))
    return left.select(
        "doc_id", F.size("removed").alias("n_removed"), F.col("removed.line_no").alias("removed_lines"),
        F.col("removed.first_doc").alias("first_docs"), F.col("removed.first_line").alias("first_lines"), F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


@_query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.learn(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_model")


@_query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@_query
def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_lines", "n_good_lines")


@_query
def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with surrogates, and what was replaced; the key is a parameter of the operator."""
    left = surrogates.replace_private(table(spark, sf_dir, "documents"), secret="a key of the caller")
    return left.select("doc_id", "text", F.size("private").alias("n_private"), F.col("private.kind").alias("kinds"), F.col("private.surrogate").alias("surrogates"))


@_query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts encoded with their four best segmentations, and decoded again."""
    docs = table(spark, sf_dir, "documents")
    back = pieces.decoded(pieces.encoded(docs))
    return back.select(
        "doc_id", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "score", "nbest", F.md5(F.col("decoded").cast("binary")).alias("decoded_md5")
    )


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of the conversations, each with its first turns taken from the first conversation of its five."""
    c = F.col("conv_id")
    head = F.crc32(c.cast("string").cast("binary")) % 9
    return prefix_trie.trie(*prefix_trie.grafted(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations")), head, c - c % 5))


@_query
def op12_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at a five-word similarity of 0.8 or more."""
    return shingle_join.jaccard_components(table(spark, sf_dir, "documents"))


@_query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


ORACLES["op5_decontamination"] = oracles.decontamination_sql()
ORACLES["op8_quality_rules"] = oracles.rules_sql()
ORACLES["op9_byte_shards"] = oracles.shards_sql(SHARDS)
ORACLES["op13_ranked_search"] = oracles.ranked_sql(50)
ORACLES["op11_prefix_trie"] = oracles.trie_sql()
