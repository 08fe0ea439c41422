"""Quoted relation proposals: checks, batch coverage, upserts, edge evidence, review.

proposals(document_id, batch_id, rel_id, subject, subject_kind, predicate, object, object_kind, explanation)
quotes(document_id, batch_id, rel_id, pos, source_ref, quote)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import skew, text
from attesta.functions.text import contains_word, normalized, sorted_distinct

DOC = ["document_id"]
REL = ["document_id", "batch_id", "rel_id"]
# Object kind and lexical cue of each predicate.
OBJECT_KIND = {"BUILT_ON": "Method", "USES_COMPONENT": "Method", "USES_CONCEPT": "Concept", "TRAINED_ON": "Dataset"}
CUES = {
    "BUILT_ON": r"build|backbone|initializ|fine[\s-]*tun|finetun|instruction[\s-]*tun",
    "TRAINED_ON": r"train|fine[\s-]*tun|finetun",
    "USES_COMPONENT": r"us[ei]|employ|integrat|incorporat|obtain|extract",
    "USES_CONCEPT": r"us[ei]|employ|attention|condition|incorporat|integrat",
}
NEGATED_TRAINING = r"not\s+(?:been\s+)?trained|never\s+trained"
RETRIEVAL = r"retriev|database"
SHORT_QUOTE = 12
LINKED = ("source_linked", "cell_grounded")


def typed_groups(dependencies: DataFrame, training: DataFrame, components: DataFrame, concepts: DataFrame) -> DataFrame:
    """Four typed groups as one proposal table.

    Inputs: (document_id, batch_id, rel_id, subject, object, explanation).
    """
    parts = [
        (dependencies, "BUILT_ON"), (training, "TRAINED_ON"), (components, "USES_COMPONENT"), (concepts, "USES_CONCEPT")
    ]
    rows = [
        df.select(*REL, "subject", F.lit("Method").alias("subject_kind"), F.lit(p).alias("predicate"), "object", F.lit(OBJECT_KIND[p]).alias("object_kind"), "explanation")
        for df, p in parts
    ]
    out = rows[0]
    for part in rows[1:]:
        out = out.unionByName(part)
    return out


def _quote_reasons(quotes: DataFrame, units: DataFrame, allowed: DataFrame) -> DataFrame:
    known = units.select(*DOC, F.col("evidence_id").alias("source_ref"), normalized("text").alias("body"))
    scope = allowed.select("document_id", "batch_id", F.col("ref").alias("source_ref")).distinct().withColumn("__in", F.lit(True))
    needle = F.col("needle")
    found = F.when(F.length(needle) < SHORT_QUOTE, (F.length(needle) >= 2) & (needle == F.col("body"))).otherwise(F.contains("body", needle))
    return (
        quotes.withColumn("needle", normalized("quote"))
        .join(known, [*DOC, "source_ref"], "left").join(scope, ["document_id", "batch_id", "source_ref"], "left")
        .groupBy(*REL)
        .agg(
            F.bool_or(F.col("__in").isNull() | F.col("body").isNull()).alias("outside"),
            F.bool_or(F.col("__in").isNotNull() & F.col("body").isNotNull() & ~found).alias("unquoted"),
            F.array_join(F.array_sort(F.collect_list(F.struct("pos", "quote")))["quote"], " ").alias("joined"),
        )
    )


def check_proposals(proposals: DataFrame, quotes: DataFrame, units: DataFrame, allowed: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Proposals with `accepted` and sorted reasons; nothing is inferred beyond the quotes.

    units(document_id, evidence_id, text); allowed(document_id, batch_id, ref);
    catalog(document_id, name, kind)
    """
    evidence = _quote_reasons(quotes, units, allowed)
    rows = proposals.join(evidence, REL, "left").withColumn("s", normalized("subject")).withColumn("o", normalized("object"))
    rows = rows.withColumn("body", normalized(F.coalesce("joined", F.lit(""))))
    rows = rows.withColumn("__kinds_s", F.lit(None).cast("array<string>")).withColumn("__kinds_o", F.lit(None).cast("array<string>"))
    if catalog is not None:
        kinds = catalog.groupBy(*DOC, normalized("name").alias("k")).agg(F.collect_set("kind").alias("kinds"))
        rows = rows.drop("__kinds_s", "__kinds_o").join(kinds.select(*DOC, F.col("k").alias("s"), F.col("kinds").alias("__kinds_s")), [*DOC, "s"], "left").join(
            kinds.select(*DOC, F.col("k").alias("o"), F.col("kinds").alias("__kinds_o")), [*DOC, "o"], "left"
        )
    expected = F.coalesce(*[F.when(F.col("predicate") == p, F.lit(k)) for p, k in OBJECT_KIND.items()])
    cue = F.coalesce(*[F.when(F.col("predicate") == p, F.col("body").rlike(c)) for p, c in CUES.items()])
    clash = (F.col("__kinds_s").isNotNull() & ~F.array_contains("__kinds_s", F.col("subject_kind"))) | (
        F.col("__kinds_o").isNotNull() & ~F.array_contains("__kinds_o", F.col("object_kind"))
    )
    uncataloged = F.lit(catalog is not None) & (F.col("object_kind") == "Dataset") & ~F.coalesce(F.array_contains("__kinds_o", "Dataset"), F.lit(False))
    training = F.col("predicate") == "TRAINED_ON"
    named = contains_word(F.col("body"), F.col("s"), "-") & contains_word(F.col("body"), F.col("o"), "-")
    reasons = text.codes(
        ((F.col("subject_kind") != "Method") | (F.col("object_kind") != expected), "invalid_endpoint_types"),
        (F.col("s") == F.col("o"), "self_relation"),
        (clash, "endpoint_type_conflicts_with_catalog"),
        (uncataloged, "training_dataset_not_in_named_catalog"),
        (F.coalesce("outside", F.lit(False)), "evidence_outside_supplied_scope"),
        (F.coalesce("unquoted", F.lit(False)), "quote_not_found_at_reference"),
        (~named, "endpoint_names_missing_from_quotations"),
        (~F.coalesce(cue, F.lit(False)), "relationship_cue_missing"),
        (training & F.col("body").rlike(NEGATED_TRAINING), "negated_training_requires_review"),
        (training & F.col("body").rlike(RETRIEVAL), "training_vs_retrieval_ambiguous"),
    )
    return rows.withColumn("reasons", sorted_distinct(reasons)).select(*proposals.columns, "reasons", (F.size("reasons") == 0).alias("accepted"))


def batch_issues(reviews: DataFrame, allowed: DataFrame, quotes: DataFrame) -> DataFrame:
    """Coverage faults of a batch: every supplied item reviewed once, consistently.

    reviews(document_id, batch_id, source_ref, outcome)
    """
    key = ["document_id", "batch_id"]
    repeated = reviews.groupBy(*key, "source_ref").agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit("duplicate_source_reviews").alias("issue"))
    supplied = allowed.select(*key, F.col("ref").alias("source_ref"))
    seen = reviews.select(*key, "source_ref")
    uncovered = supplied.join(seen, [*key, "source_ref"], "left_anti").unionByName(seen.join(supplied, [*key, "source_ref"], "left_anti")).select(
        *key, F.lit("source_review_coverage_mismatch").alias("issue")
    )
    touched = quotes.select(*key, "source_ref").distinct().withColumn("__hit", F.lit(True))
    rows = reviews.join(touched, [*key, "source_ref"], "left")
    mismatch = rows.where((F.col("outcome") == "relations_found") != F.col("__hit").isNotNull()).select(*key, F.concat(F.lit("source_review_relationship_mismatch:"), "source_ref").alias("issue"))
    uncertain = rows.where("outcome = 'uncertain'").select(*key, F.concat(F.lit("uncertain_source:"), "source_ref").alias("issue"))
    return repeated.unionByName(uncovered).unionByName(mismatch).unionByName(uncertain).distinct()


def upsert_catalog(catalog: DataFrame, accepted: DataFrame, quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, evidence): catalog entries plus endpoints of accepted relations.

    catalog(document_id, kind, name, source_ref, quote) with null evidence allowed; the first
    spelling of an identity is kept and evidence rows are added once.
    """
    ends = accepted.select(*REL, F.inline(F.array(
        F.struct(F.col("subject_kind").alias("kind"), F.col("subject").alias("name")), F.struct(F.col("object_kind").alias("kind"), F.col("object").alias("name")))))
    fresh = ends.join(quotes.select(*REL, "source_ref", "quote"), REL).select("document_id", "kind", "name", "source_ref", "quote", F.lit(1).alias("__new"))
    rows = catalog.select("document_id", "kind", "name", "source_ref", "quote", F.lit(0).alias("__new")).unionByName(fresh).withColumn("identity", normalized("name"))
    key = ["document_id", "kind", "identity"]
    entities = rows.groupBy(*key).agg(F.min_by("name", F.struct("__new", "name")).alias("name"), (F.min("__new") == 1).alias("added"))
    evidence = rows.where("quote IS NOT NULL").select(*key, "source_ref", "quote").distinct()
    return entities, evidence


def relation_fields(accepted: DataFrame) -> DataFrame:
    """Distinct subject → object references added by accepted relations."""
    return accepted.select("document_id", "predicate", normalized("subject").alias("subject_key"), normalized("object").alias("object_key")).distinct()


def attach_edge_evidence(edges: DataFrame, nodes: DataFrame, accepted: DataFrame, quotes: DataFrame) -> DataFrame:
    """Quotes of accepted relations on the edges they describe.

    edges(document_id, edge_id, source, target, label); nodes(document_id, id, label, name)
    """
    n = nodes.select("document_id", "id", "label", normalized("name").alias("k"))
    ends = edges.join(n.select("document_id", F.col("id").alias("source"), F.col("label").alias("subject_kind"), F.col("k").alias("s")), ["document_id", "source"]).join(
        n.select("document_id", F.col("id").alias("target"), F.col("label").alias("object_kind"), F.col("k").alias("o")), ["document_id", "target"]
    )
    said = accepted.select(*REL, "predicate", "subject_kind", "object_kind", normalized("subject").alias("s"), normalized("object").alias("o"))
    key = F.struct("predicate", "subject_kind", "object_kind", "s", "o")

    def keyed(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        """One row for each thing and key, with all keys of the thing if there are several."""
        held = rows.groupBy("document_id", *by).agg(F.array_sort(F.collect_set(key)).alias("__all"))
        return held.select("document_id", *by, F.explode("__all").alias("__key"), F.when(F.size("__all") > 1, F.col("__all")).alias(name)).select(
            "document_id", *by, "__key.*", name)

    # A key with many edges and quotes is as many pairs in the result; pairs are told apart before they are made, so none is shuffled.
    own = keyed(ends.withColumnRenamed("label", "predicate"), ["edge_id"], "__own")
    told = keyed(skew.shuffled_join(said, quotes.select(*REL, "source_ref", "quote"), REL), ["source_ref", "quote"], "__told")
    pairs = skew.shuffled_join(own, told, ["document_id", "predicate", "subject_kind", "object_kind", "s", "o"])
    first = F.array_min(F.array_intersect("__own", "__told"))
    return pairs.where(F.col("__own").isNull() | F.col("__told").isNull() | (first == key)).select("document_id", "edge_id", "source_ref", "quote")


def relation_gate(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Whether source-linked relations between entities exist; not a completeness claim."""
    methods = nodes.where("label = 'Method'").select("document_id", F.col("id").alias("source"))
    good = edges.where(F.col("label").isin(*OBJECT_KIND) & F.col("support_status").isin(*LINKED)).join(methods, ["document_id", "source"], "left_semi")
    return nodes.select("document_id").distinct().join(good.groupBy("document_id").agg(F.count("*").alias("n")), "document_id", "left").select(
        "document_id", F.coalesce("n", F.lit(0)).alias("source_linked_domain_relationships"), (F.coalesce("n", F.lit(0)) > 0).alias("passed")
    )


def review_faults(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates without exactly one decision, and decisions for unknown candidates.

    rows(batch_id, candidate_id, …); decisions(batch_id, candidate_id, verdict)
    """
    key = ["batch_id", "candidate_id"]
    counted = decisions.groupBy(*key).agg(F.count("*").alias("n"))
    known = rows.select(*key).withColumn("__k", F.lit(True))
    fault = F.when(F.col("n").isNull(), "omitted").when(F.col("__k").isNull(), "invented").when(F.col("n") > 1, "duplicated")
    return known.join(counted, key, "full").select(*key, fault.alias("fault")).where("fault IS NOT NULL")


def apply_review(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Verdicts of fully covered batches: accepted only when supported."""
    bad = review_faults(rows, decisions).select("batch_id").distinct()
    reviewed = rows.join(bad, "batch_id", "left_anti").join(decisions, ["batch_id", "candidate_id"])
    supported = F.col("verdict") == "supported"
    return reviewed.withColumn("accepted", F.col("accepted") & supported).withColumn(
        "reasons", F.when(supported, F.col("reasons")).otherwise(sorted_distinct(F.concat("reasons", F.array(F.concat(F.lit("semantic_review_"), "verdict")))))
    )
