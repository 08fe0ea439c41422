"""Extraction records of graph builds: validation, inheritance, accounting, serialization.

responses(response_id, source); entities(response_id, pos, name, type, description);
relations(response_id, pos, source, target, kind, scope, description, evidence).
Rejections carry a stable reason code; the first failing rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.stage import stage
from attesta.functions.text import normalized, strip

RESP = ["response_id"]
# Tuple marks of the native format, entity types, relation kinds by rule.
MARKS = ("<|>", "##", "<|COMPLETE|>")
TYPES = ("Method", "Dataset", "Concept", "Metric", "Configuration", "Tool", "Organization")
TRAINING, DEPENDENCY = ("TRAINED_ON", "EVALUATED_ON"), ("BUILT_ON", "INITIALIZED_FROM")
GENERATOR_KINDS = ("USES", "HAS_COMPONENT", "CONSTRUCTED_FROM", "RENDERED_WITH", "GENERATES")
GENERIC_DATASETS = ("training", "evaluation", "our", "the")
CITATION = r"(?i)\bet\s+al\.?\s*,?\s*\d{4}"
STRUCTURE_V2 = r"^(?i)(?:appendix\b|figure\s+\d|table\s+\d|\d+\s+(?:method|experiment)|[a-f0-9]{16,})"
STRUCTURE_V3 = r"^(?i)(?:appendix\b|fig(?:ure)?\.?\s*\d|tab(?:le)?\.?\s*\d|[a-f0-9]{16,})"
ROW_LABEL = r"(?m)^Row label: (.+)$"
PAPER_TITLE = r"(?m)^Paper title: ([^:\n]+)"
GENERATOR_SECTION = r"(?i)Section: .*DATASET GENERATOR"
ALIGNMENT_MARK = "TABLE_METRIC_ALIGNMENT: ambiguous"
DAGGER = "†"
BEGIN, END = "SOURCE_TEXT_BEGIN\n", "\nSOURCE_TEXT_END"
SEPARATOR, COMPLETE = "\n##\n", "<|COMPLETE|>"


def source_passage(messages: Column, markers: tuple[str, ...]) -> Column:
    """Passage of the first message carrying a contract marker, between its text marks."""
    def carries(m: Column) -> Column:
        hit = F.lit(False)
        for mark in markers:
            hit = hit | F.contains(m["content"], F.lit(mark))
        return hit

    content = F.try_element_at(F.filter(messages, carries), F.lit(1))["content"]
    body = F.substring_index(content, BEGIN, -1)
    after = F.substring(content, F.instr(content, BEGIN) + len(BEGIN), F.length(content))
    last = F.length(after) - F.length(F.substring_index(after, END, -1)) - len(END)
    return F.when(F.contains(after, F.lit(END)), F.substring(after, F.lit(1), last)).otherwise(F.when(body.isNotNull(), after))


def native_messages(messages: Column, transport: tuple[str, ...] = ("transport",)) -> Column:
    """Messages of the saved request without those the transport added."""
    return F.filter(messages, lambda m: ~F.coalesce(m["role"].isin(*transport), F.lit(False)))


def _has_mark(c: Column) -> Column:
    hit = F.lit(False)
    for mark in MARKS:
        hit = hit | F.contains(c, F.lit(mark))
    return hit


def _keyed(entities: DataFrame) -> DataFrame:
    return entities.withColumn("key", normalized("name"))


def dataset_aliases(entities: DataFrame) -> DataFrame:
    """(response_id, name, alias): datasets named with a redundant `dataset` suffix."""
    short = strip(F.regexp_replace("name", r"(?i)\s+dataset$", ""))
    return (
        entities.where("type = 'Dataset'").select(*RESP, "name", short.alias("alias"))
        .where("alias <> name").where(~normalized("alias").isin(*GENERIC_DATASETS)).distinct()
    )


def apply_aliases(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relation endpoints under their alias."""
    alias = dataset_aliases(entities)
    e = entities.join(alias, [*RESP, "name"], "left").withColumn(
        "name", F.when(F.col("type") == "Dataset", F.coalesce("alias", "name")).otherwise(F.col("name"))
    ).drop("alias")
    r = relations
    for end in ("source", "target"):
        r = r.join(alias.select(*RESP, F.col("name").alias(end), F.col("alias").alias("__a")), [*RESP, end], "left").withColumn(
            end, F.coalesce("__a", end)
        ).drop("__a")
    return e, r


def entity_reason(name: Column, description: Column, key: Column, source_key: Column, version: int) -> Column:
    reason = F.when(_has_mark(F.concat(name, description)), "delimiter_in_entity").when(
        ~F.contains(source_key, key), "name_absent_from_source"
    )
    if version >= 3:
        return reason.when(name.rlike(CITATION), "author_year_citation").when(name.rlike(STRUCTURE_V3), "document_reference")
    return reason.when(name.rlike(STRUCTURE_V2), "document_reference")


def _source_keys(responses: DataFrame) -> DataFrame:
    """(response_id, source_key): texts are brought to their identity key once for all passes that look names up in them."""
    return stage(responses.select(*RESP, normalized("source").alias("source_key")))


def check_entities(entities: DataFrame, responses: DataFrame, version: int = 3) -> DataFrame:
    """Entities with `key` and `reason` (null when accepted).

    Duplicate identities within one response are all withheld: the identity is ambiguous.
    """
    keyed = _keyed(entities)
    repeated = keyed.groupBy(*RESP, "key").agg(F.count("*").alias("copies"))
    source = _source_keys(responses)
    rows = keyed.join(repeated, [*RESP, "key"]).join(source, RESP)
    rule = entity_reason(F.col("name"), F.col("description"), F.col("key"), F.col("source_key"), version)
    twice = F.when(F.col("copies") > 1, "ambiguous_duplicate_identity")
    reason = F.coalesce(rule, twice) if version >= 3 else F.coalesce(twice, rule)
    return rows.withColumn("reason", reason).drop("copies", "source_key")


def inherited_entities(current: DataFrame, previous: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inherited, conflicts): valid declarations of the earlier pass.

    A declaration is inherited unless the current pass names the identity at all; an
    accepted current identity of another type is a conflict.
    """
    source = _source_keys(responses)
    prior = _keyed(previous).join(source, RESP)
    ok = prior.where(entity_reason(F.col("name"), F.col("description"), F.col("key"), F.col("source_key"), 3).isNull()).drop("source_key")
    accepted = current.where("reason IS NULL").select(*RESP, "key", F.col("type").alias("current_type"))
    conflicts = ok.join(accepted, [*RESP, "key"]).where("type <> current_type").select(*RESP, "key").distinct()
    fresh = ok.join(current.select(*RESP, "key").distinct(), [*RESP, "key"], "left_anti")
    # A later declaration of the same identity replaces an earlier one.
    latest = fresh.groupBy(*RESP, "key").agg(F.max_by(F.struct("name", "type", "description"), "pos").alias("e"), F.min("pos").alias("pos"))
    return latest.select(*RESP, "pos", "e.*", "key"), conflicts


def _joined(relations: DataFrame, names: DataFrame, responses: DataFrame) -> DataFrame:
    known = names.select(*RESP, "key", F.struct("name", "type").alias("e"))
    rows = relations.withColumn("__s", normalized("source")).withColumn("__t", normalized("target"))
    rows = rows.join(known.select(*RESP, F.col("key").alias("__s"), F.col("e").alias("a")), [*RESP, "__s"], "left")
    rows = rows.join(known.select(*RESP, F.col("key").alias("__t"), F.col("e").alias("b")), [*RESP, "__t"], "left")
    # A stage: both passes over the same responses read the same keys.
    text = stage(responses.select(
        *RESP,
        F.col("source").alias("passage"),
        normalized("source").alias("passage_key"),
        normalized(F.replace("source", F.lit("\n\n"), F.lit("\x01"))).alias("paragraph_keys"),
        normalized(F.replace(F.regexp_extract("source", ROW_LABEL, 1), F.lit(DAGGER), F.lit(""))).alias("row_key"),
        normalized(F.regexp_extract("source", PAPER_TITLE, 1)).alias("title_key"),
    ))
    rows = rows.join(text, RESP)
    return rows.withColumn("quote_key", normalized("evidence")).withColumn("subject_key", normalized(F.replace(F.col("a.name"), F.lit(DAGGER), F.lit(""))))


def check_relations(relations: DataFrame, names: DataFrame, responses: DataFrame, version: int = 3, conflicts: DataFrame | None = None) -> DataFrame:
    """Relations with `reason` (null when accepted) and their endpoints' stored names.

    names: accepted (and inherited) entities with `key`.
    """
    rows = _joined(relations, names, responses)
    rows = rows.withColumn("__clash", F.lit(False))
    if conflicts is not None:
        for end in ("__s", "__t"):
            bad = conflicts.select(*RESP, F.col("key").alias(end), F.lit(True).alias("__x"))
            rows = rows.join(bad, [*RESP, end], "left").withColumn("__clash", F.col("__clash") | F.coalesce("__x", F.lit(False))).drop("__x")
    kind, a, b = F.col("kind"), F.col("a"), F.col("b")
    row = F.regexp_extract("passage", ROW_LABEL, 1)
    in_row = row != ""
    dagger = in_row & ~F.contains(row, F.lit(DAGGER)) & F.contains("evidence", F.lit(DAGGER))
    clauses = F.split("quote_key", r"\bfrom\b")
    training = kind.isin(*TRAINING)
    bad_training = training & (~a["type"].isin("Method", "Configuration") | (b["type"] != "Dataset"))
    unnamed_dataset = training & ~F.contains("quote_key", F.col("__t"))
    missing_quote = ~F.contains("passage_key", "quote_key")
    undeclared = a.isNull() | b.isNull()
    if version >= 3:
        tail = F.slice(clauses, F.lit(2), F.greatest(F.size(clauses) - 1, F.lit(0)))
        together = F.exists(F.split("paragraph_keys", "\x01"), lambda p: F.contains(p, F.col("__s")) & F.contains(p, F.col("__t")))
        reports = in_row & (kind == "REPORTS")
        generator = F.col("passage").rlike(GENERATOR_SECTION)
        reason = (
            F.when(F.col("__clash"), "conflicting_endpoint_type")
            .when(undeclared, "endpoint_not_declared")
            .when(F.col("__s") == F.col("__t"), "self_relation")
            .when(missing_quote, "quote_not_in_source")
            .when(_has_mark(F.col("description")), "delimiter_in_relation")
            .when(bad_training, "training_endpoint_types")
            .when(unnamed_dataset, "training_quote_without_dataset")
            .when(kind.isin(*DEPENDENCY) & ~b["type"].isin("Method", "Tool", "Concept"), "dependency_target_type")
            .when((kind == "INITIALIZED_FROM") & ~F.exists(tail, lambda c: F.contains(c, F.col("__t"))), "initialization_not_stated")
            .when((b["type"] == "Metric") & ~kind.isin("REPORTS", "OTHER", "DERIVED_FROM", "USES"), "metric_as_component")
            .when((b["type"] == "Metric") & kind.isin("USES", "DERIVED_FROM") & (a["type"] != "Metric"), "metric_dependency_subject")
            .when((a["type"] == "Metric") & (kind == "DERIVED_FROM") & ~together, "metric_derivation_across_paragraphs")
            .when(reports & F.contains("passage", F.lit(ALIGNMENT_MARK)), "ambiguous_table_alignment")
            .when(reports & ~F.contains("row_key", F.col("subject_key")), "not_the_row_owner")
            .when(reports & (b["type"] != "Metric"), "reports_without_metric")
            .when(dagger, "dagger_on_unmarked_row")
            .when(generator & ~F.col("scope").isin("dataset_construction", "definition"), "generator_scope")
            .when(generator & kind.isin(*GENERATOR_KINDS) & (F.col("title_key") != "") & (F.col("__s") == F.col("title_key")), "generator_assigned_to_method")
        )
    else:
        last = F.element_at(clauses, -1)
        reason = (
            F.when(undeclared, "endpoint_not_declared")
            .when(a["name"] == b["name"], "self_relation")
            .when(missing_quote, "quote_not_in_source")
            .when(bad_training, "training_endpoint_types")
            .when(unnamed_dataset, "training_quote_without_dataset")
            .when(kind.isin(*DEPENDENCY) & (~a["type"].isin("Method", "Concept") | (b["type"] != "Method")), "dependency_endpoint_types")
            .when((b["type"] == "Metric") & ~kind.isin("REPORTS", "OTHER"), "metric_as_component")
            .when(dagger, "dagger_on_unmarked_row")
            .when((kind == "INITIALIZED_FROM") & ((F.size(clauses) < 2) | ~F.contains(last, F.col("__t"))), "initialization_not_stated")
            .when(_has_mark(F.concat(kind, F.lit(": "), "description")), "delimiter_in_relation")
        )
    return rows.withColumn("reason", reason).select(
        *relations.columns, F.col("__s").alias("source_key"), F.col("__t").alias("target_key"),
        F.col("a.name").alias("source_name"), F.col("b.name").alias("target_name"), "reason",
    )


def used_inherited(inherited: DataFrame, kept: DataFrame) -> DataFrame:
    ends = kept.select(*RESP, F.explode(F.array("source_key", "target_key")).alias("key")).distinct()
    return inherited.join(ends, [*RESP, "key"], "left_semi")


def serialize(responses: DataFrame, entities: DataFrame, relations: DataFrame, version: int = 3) -> DataFrame:
    """Canonical tuple text per response: entities, then relations, then the end mark.

    entities(response_id, part, pos, name, type, description) with part 0 for accepted and
    1 for inherited ones; relations are accepted rows of `check_relations`.
    """
    entity = F.concat(F.lit('("entity"<|>'), "name", F.lit("<|>"), "type", F.lit("<|>"), "description", F.lit(")"))
    label = F.concat("kind", F.lit(" ["), "scope", F.lit("]: "), "description") if version >= 3 else F.concat("kind", F.lit(": "), "description")
    relation = F.concat(F.lit('("relationship"<|>'), "source_name", F.lit("<|>"), "target_name", F.lit("<|>"), label, F.lit("<|>1)"))
    rows = entities.select(*RESP, F.col("part").cast("int").alias("part"), "pos", entity.alias("t")).unionByName(
        relations.select(*RESP, F.lit(2).alias("part"), "pos", relation.alias("t"))
    )
    packed = rows.groupBy(*RESP).agg(F.array_sort(F.collect_list(F.struct("part", "pos", "t"))).alias("r"))
    parts = F.concat(F.coalesce("r.t", F.array().cast("array<string>")), F.array(F.lit(COMPLETE)))
    return responses.select(*RESP).join(packed, RESP, "left").select(
        *RESP, F.concat(F.array_join(parts, SEPARATOR), F.lit(SEPARATOR)).alias("canonical")
    )


def declared_in_tuples(messages: DataFrame) -> DataFrame:
    """Entities accepted in earlier assistant tuples. messages(response_id, role, content)"""
    tuples = messages.where("role = 'assistant'").select(*RESP, F.posexplode(F.split("content", "##")).alias("pos", "t"))
    pattern = r'(?s)^\s*\("entity"<\|>(.*?)<\|>(.*?)<\|>(.*)\)\s*$'
    typed = F.coalesce(*[F.when(F.upper(F.trim(F.regexp_extract("t", pattern, 2))) == k.upper(), F.lit(k)) for k in TYPES])
    return tuples.where(F.col("t").rlike(pattern)).select(
        *RESP, "pos", F.trim(F.regexp_extract("t", pattern, 1)).alias("name"), typed.alias("type"), F.trim(F.regexp_extract("t", pattern, 3)).alias("description")
    ).where("type IS NOT NULL")


def accounting(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Raw, accepted and withheld records per response; the two must add up."""
    rows = entities.select(*RESP, F.lit("entity").alias("record_type"), "reason").unionByName(
        relations.select(*RESP, F.lit("relationship").alias("record_type"), "reason")
    )
    return rows.groupBy(*RESP).agg(
        F.count_if(F.col("record_type") == "entity").alias("raw_entities"),
        F.count_if((F.col("record_type") == "entity") & F.col("reason").isNull()).alias("entities"),
        F.count_if(F.col("record_type") == "relationship").alias("raw_relationships"),
        F.count_if((F.col("record_type") == "relationship") & F.col("reason").isNull()).alias("relationships"),
        F.count_if(F.col("reason").isNotNull()).alias("withheld"),
    ).withColumn("all_accounted", F.expr("entities + relationships + withheld = raw_entities + raw_relationships"))


def rejection_histogram(entities: DataFrame, relations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    rows = entities.select(*keys, F.lit("entity").alias("record_type"), "reason").unionByName(
        relations.select(*keys, F.lit("relationship").alias("record_type"), "reason")
    )
    return rows.where("reason IS NOT NULL").groupBy(*keys, "record_type", "reason").agg(F.count("*").alias("records"))


def canonical_mismatches(saved: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Responses whose saved tuples differ from a replay."""
    again = recomputed.select(*RESP, F.col("canonical").alias("again"))
    return saved.join(again, RESP, "left").where("NOT canonical <=> again").select(*RESP)


def replay_candidates(rejected: DataFrame, recovered: DataFrame, graph: DataFrame) -> DataFrame:
    """Relations withheld only for an undeclared endpoint that pass once the earlier pass's
    declarations are in scope, flagged by whether their pair is already in the graph.

    rejected and recovered come from `check_relations`; graph(source, target) holds titles.
    """
    lost = rejected.where("reason = 'endpoint_not_declared'")
    passing = recovered.where("reason IS NULL").select(*RESP, "pos")
    pair = lambda x, y: F.array_sort(F.array(x, y))
    known = graph.select(pair(normalized("source"), normalized("target")).alias("pair")).distinct().withColumn("__in", F.lit(True))
    return (
        lost.join(passing, [*RESP, "pos"], "left_semi").withColumn("pair", pair(F.col("source_key"), F.col("target_key")))
        .join(known, "pair", "left").select(*RESP, "pos", "pair", F.coalesce("__in", F.lit(False)).alias("pair_already_in_graph"))
    )
