"""Corpus catalog: manifest and library, overrides, registration, identity chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import codes

OVERRIDABLE = ("docling_json", "evidence_index", "rag_chunks")


def duplicate_papers(manifest: DataFrame, library: DataFrame) -> DataFrame:
    both = manifest.select("paper_id").unionByName(library.select("paper_id"))
    return both.groupBy("paper_id").agg(F.count("*").alias("entries")).where("entries > 1 OR paper_id IS NULL OR paper_id = ''")


def catalog(manifest: DataFrame, library: DataFrame, overrides: DataFrame) -> DataFrame:
    """All papers with per-paper overrides; a set override field replaces the original."""
    papers = manifest.unionByName(library, allowMissingColumns=True)
    fields = [c for c in overrides.columns if c != "paper_id"]
    o = overrides.select("paper_id", *[F.col(c).alias(f"__{c}") for c in fields])
    joined = papers.join(o, "paper_id", "left")
    for c in fields:
        joined = joined.withColumn(c, F.coalesce(f"__{c}", c) if c in papers.columns else F.col(f"__{c}"))
    return joined.drop(*[f"__{c}" for c in fields])


def library_listing(papers: DataFrame, states: DataFrame, files: DataFrame) -> DataFrame:
    """Papers with derived flags: processed, search status, source available."""
    have = files.select(F.col("path").alias("source_pdf")).distinct().withColumn("__have", F.lit(True))
    return (
        papers.join(states.select("paper_id", F.col("status").alias("rag")), "paper_id", "left").join(have, "source_pdf", "left")
        .withColumn("processed", F.coalesce(F.length("docling_json") > 0, F.lit(False)))
        .withColumn("rag", F.coalesce("rag", F.lit("not_ready")))
        .withColumn("source_available", F.col("__have").isNotNull()).drop("__have")
    )


def register(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inserts, rejects): papers already present are refused."""
    ids = existing.select("paper_id")
    return incoming.join(ids, "paper_id", "left_anti"), incoming.join(ids, "paper_id", "left_semi").select("paper_id")


def merge_fields(changes: DataFrame, fields: list[str], key: str = "paper_id", order: str = "ts") -> DataFrame:
    """Latest set value per field: derived files and search states, later changes win."""
    return changes.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def identity_faults(papers: DataFrame, documents: DataFrame, results: DataFrame, indexes: DataFrame) -> DataFrame:
    """Broken links in a paper's identity chain, one row per broken equality.

    papers(paper_id, source_pdf, source_sha256, document_id); documents(document_id, source_filename);
    results(paper_id, result_document_id); indexes(paper_id, index_document_id, pdf_sha256)
    """
    base = papers.join(documents.select("document_id", "source_filename", F.lit(True).alias("__doc")), "document_id", "left").join(results, "paper_id", "left").join(indexes, "paper_id", "left")
    name = F.element_at(F.split("source_pdf", "/"), -1)
    rules = codes(
        (F.col("__doc").isNull(), "layout_missing"),
        (F.col("source_filename") != name, "filename_differs"),
        (F.col("pdf_sha256") != F.col("source_sha256"), "pdf_hash_differs"),
        (F.col("index_document_id") != F.col("document_id"), "index_of_other_conversion"),
        (F.col("result_document_id") != F.col("document_id"), "annotations_of_other_conversion"),
    )
    return base.select("paper_id", F.explode(rules).alias("fault"))
