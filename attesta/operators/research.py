"""Research records: catalogs, table measurements, nested graphs, assessment, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import skew, text
from attesta.functions.stage import stage
from attesta.functions.text import WORD, contains_word, identity_name, metric_name, normalized, strip
from attesta.operators.units import locate_quotes

DOC = ["document_id"]
NODE = ["document_id", "id"]
# Endpoint kinds allowed per edge label (None: any), cues per method edge,
# row names that stand for the proposed method, titles that are no method names.
PATTERNS = {
    "BUILT_ON": ("Method", "Method"),
    "USES_COMPONENT": ("Method", "Method"),
    "USES_CONCEPT": ("Method", "Concept"),
    "TRAINED_ON": ("Method", "Dataset"),
    "CONFIGURATION_OF": ("MethodConfiguration", "Method"),
    "EVALUATES": ("Experiment", "MethodConfiguration"),
    "EVALUATED_ON": ("Experiment", "Dataset"),
    "REPORTS_MEASUREMENT": ("Experiment", "Measurement"),
    "USES_METRIC": ("Measurement", "Metric"),
    "FOR_CONFIGURATION": ("Measurement", "MethodConfiguration"),
    "REPORTS": (None, "Finding"),
    "HAS_LIMITATION": ("ResearchPaper", "Finding"),
}
EDGE_CUES = {
    "BUILT_ON": r"build|backbone|initializ|fine[\s-]*tun|finetun|instruction[\s-]*tun",
    "TRAINED_ON": r"train",
    "USES_COMPONENT": r"us[ei]|obtain|extract|encoder",
    "USES_CONCEPT": r"condition|attention|generat|context|represent|inject",
}
OWN_ROWS = ("ours", "full model (ours)")
OWN_ROW_PREFIXES = ("w/o ", "w/ ", "ours (")
NO_METHOD = r"^(?i)(quantitative comparison|ablation study|evaluation on)\b"
MENTIONED = ("Method", "Dataset", "Concept", "Metric")
AMBIGUOUS_FLAGS = ("multiple_numeric_values", "spanning_data_cell")
LINKED = ("source_linked", "cell_grounded")
MAX_DESCRIPTION = 4096

# Identity fields and labelled references of the research record tree.
RECORD_TREE = {
    "ResearchPaper": (["title"], {
        "methods": ("DISCUSSES_METHOD", "Method"), "introduced_methods": ("INTRODUCES_METHOD", "Method"),
        "datasets": ("DESCRIBES_DATASET", "Dataset"), "introduced_datasets": ("INTRODUCES_DATASET", "Dataset"),
        "concepts": ("DESCRIBES_CONCEPT", "Concept"), "metrics": ("DEFINES_METRIC", "Metric"),
        "configurations": ("DESCRIBES_CONFIGURATION", "MethodConfiguration"), "experiments": ("HAS_EXPERIMENT", "Experiment"),
        "findings": ("REPORTS", "Finding"), "limitations": ("HAS_LIMITATION", "Finding"),
    }),
    "Method": (["name"], {
        "built_on": ("BUILT_ON", "Method"), "components": ("USES_COMPONENT", "Method"),
        "concepts": ("USES_CONCEPT", "Concept"), "training_datasets": ("TRAINED_ON", "Dataset"),
    }),
    "MethodConfiguration": (["name", "experiment_name"], {"method": ("CONFIGURATION_OF", "Method")}),
    "Experiment": (["name"], {
        "configurations": ("EVALUATES", "MethodConfiguration"), "evaluation_datasets": ("EVALUATED_ON", "Dataset"),
        "findings": ("REPORTS", "Finding"), "measurements": ("REPORTS_MEASUREMENT", "Measurement"),
    }),
    "Measurement": (["table_label", "row_label", "column_label", "experiment_name"], {
        "metric": ("USES_METRIC", "Metric"), "configuration": ("FOR_CONFIGURATION", "MethodConfiguration"),
    }),
    "Dataset": (["name"], {}), "Concept": (["name"], {}), "Metric": (["name"], {}), "Finding": (["statement"], {}),
}


# ---- catalogs ------------------------------------------------------------------------
def canonical_metrics(metrics: DataFrame) -> DataFrame:
    """Cleaned metric names; later spellings of an identity take the first one.

    metrics(paper_id, pos, name)
    """
    cleaned = metrics.withColumn("clean", metric_name("name")).withColumn("identity", identity_name("clean"))
    first = cleaned.groupBy("paper_id", "identity").agg(F.min_by("clean", "pos").alias("canonical"))
    return cleaned.join(first, ["paper_id", "identity"])


def drop_backbone_components(refs: DataFrame) -> DataFrame:
    """Component references that repeat a backbone of the same method are removed.

    refs(paper_id, method, role, name) with the roles built_on and components.
    """
    keyed = refs.withColumn("__k", identity_name("name"))
    backbones = keyed.where("role = 'built_on'").select("paper_id", "method", "__k").distinct().withColumn("role", F.lit("components"))
    return keyed.join(backbones, ["paper_id", "method", "role", "__k"], "left_anti").drop("__k")


def recover_catalog(mentions: DataFrame, fields: list[str]) -> DataFrame:
    """One record per identity from all nested mentions; the first non-empty value wins.

    mentions(paper_id, kind, pos, name, experiment_name, …fields)
    """
    scoped = F.when(F.col("kind") == "MethodConfiguration", identity_name(F.coalesce("experiment_name", F.lit("")))).otherwise("")
    keyed = mentions.withColumn("identity", identity_name("name")).withColumn("scope", scoped)

    def first_filled(f: str) -> Column:
        filled = F.col(f).isNotNull() & ~F.col(f).isin("", "unknown")
        value = F.min_by(f, F.when(filled, F.col("pos")))
        return F.coalesce(value, F.min_by(f, "pos")).alias(f)

    return keyed.groupBy("paper_id", "kind", "identity", "scope").agg(
        F.min_by("name", "pos").alias("name"), *[first_filled(f) for f in fields], F.count("*").alias("mentions")
    )


def merge_sections(records: DataFrame, list_fields: list[str]) -> DataFrame:
    """Section records merged by identity: lists united, descriptions joined up to 4096 characters.

    records(paper_id, kind, identity, section_no, description, …list_fields)
    """
    key = ["paper_id", "kind", "identity"]
    said = (
        records.where(F.length("description") > 0).groupBy(*key, "description").agg(F.min("section_no").alias("at"))
        .groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "description"))).alias("d"))
        .select(*key, F.substring(F.array_join("d.description", " "), 1, MAX_DESCRIPTION).alias("description"))
    )
    lists = None
    for f in list_fields:
        part = records.select(*key, F.explode(f).alias("v")).distinct().groupBy(*key).agg(F.array_sort(F.collect_list("v")).alias(f))
        lists = part if lists is None else lists.join(part, key, "full")
    base = records.groupBy(*key).agg(F.count_distinct("section_no").alias("sections")).join(said, key, "left")
    return base.join(lists, key, "left") if lists is not None else base


# ---- nested records to graph ---------------------------------------------------------
def _fields(schema: T.DataType) -> set[str]:
    return set(schema.names) if isinstance(schema, T.StructType) else set()


def _node_id(document_id: Column, kind: str, x: Column) -> Column:
    parts = [F.coalesce(identity.cast("string"), F.lit("")) for identity in (x[f] for f in RECORD_TREE[kind][0])]
    return F.sha2(F.concat_ws("\x1f", document_id, F.lit(kind), *parts), 256)


def nested_graph(papers: DataFrame, column: str = "paper") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of nested research records, in one pass over the rows.

    papers(document_id, paper struct); a node is identified by its kind and identity fields,
    an edge by its two nodes and label.
    """
    schema = papers.schema[column].dataType
    node_type, edge_type = "array<struct<id:string,label:string,name:string>>", "array<struct<source:string,target:string,label:string>>"
    doc = F.col("document_id")

    def children(x: Column, kind: str, schema: T.StructType):
        for field, (label, child) in RECORD_TREE[kind][1].items():
            if field not in _fields(schema):
                continue
            kind_of = schema[field].dataType
            many = isinstance(kind_of, T.ArrayType)
            struct = kind_of.elementType if many else kind_of
            items = F.coalesce(x[field], F.array().cast(kind_of)) if many else F.when(x[field].isNotNull(), F.array(x[field])).otherwise(F.array().cast(T.ArrayType(kind_of)))
            yield items, label, child, struct

    def nodes(x: Column, kind: str, schema: T.StructType) -> Column:
        own = F.array(F.struct(_node_id(doc, kind, x).alias("id"), F.lit(kind).alias("label"), x[RECORD_TREE[kind][0][0]].cast("string").alias("name"))).cast(node_type)
        parts = [_flat(items, child, struct, nodes) for items, _, child, struct in children(x, kind, schema)]
        return F.concat(own, *parts) if parts else own

    def edges(x: Column, kind: str, schema: T.StructType) -> Column:
        me = _node_id(doc, kind, x)
        parts = [F.array().cast(edge_type)]
        for items, label, child, struct in children(x, kind, schema):
            parts.append(_edges_to(items, me, label, child).cast(edge_type))
            parts.append(_flat(items, child, struct, edges))
        return F.concat(*parts)

    def _flat(items: Column, child: str, struct: T.StructType, walk) -> Column:
        return F.flatten(F.transform(items, lambda c: walk(c, child, struct)))

    def _edges_to(items: Column, me: Column, label: str, child: str) -> Column:
        return F.transform(items, lambda c: F.struct(me.alias("source"), _node_id(doc, child, c).alias("target"), F.lit(label).alias("label")))

    x = F.col(column)
    node_rows = papers.select("document_id", F.inline(nodes(x, "ResearchPaper", schema)))
    edge_rows = papers.select("document_id", F.inline(edges(x, "ResearchPaper", schema)))
    return node_rows.groupBy("document_id", "id").agg(F.min("label").alias("label"), F.min("name").alias("name")), edge_rows.distinct()


# ---- table measurements --------------------------------------------------------------
def cell_contexts(units: DataFrame, context: DataFrame) -> DataFrame:
    """Leaf header and row of each cell: the deepest header level, the first-column labels."""
    cells = units.where("kind = 'table_cell'").select(*DOC, F.col("evidence_id").alias("ref"), "text", "row_end", "col_start", (F.col("col_end") - F.col("col_start")).alias("width"))
    wanted = context.where(F.col("role").isin("column_headers", "row_headers", "row_labels"))
    rows = skew.shuffled_join(wanted, cells, [*DOC, "ref"])
    heads = rows.where("role = 'column_headers'").groupBy(*DOC, "evidence_id").agg(
        F.array_sort(F.collect_set(F.struct("row_end", "ref", "text", "width"))).alias("heads")
    )
    labels = rows.where("role <> 'column_headers' AND col_start = 0").groupBy(*DOC, "evidence_id").agg(
        F.array_sort(F.collect_set(F.struct("ref", "text"))).alias("labels")
    )
    level = F.array_max(F.transform("heads", lambda h: h["row_end"]))
    return skew.shuffled_join(heads, labels, [*DOC, "evidence_id"], "full").withColumn(
        "leaf", F.filter("heads", lambda h: h["row_end"] == level)
    )


def table_measurements(
    units: DataFrame, context: DataFrame, labels: DataFrame, experiment_tables: DataFrame, metrics: DataFrame,
    methods: DataFrame, configurations: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """(measurements, unresolved): numeric cells bound to metric, configuration and experiment.

    labels(document_id, evidence_id, table_label); experiment_tables(document_id, experiment,
    table_label); metrics(document_id, name); methods(document_id, name, proposed);
    configurations(document_id, experiment, name).  Every gate needs exactly one candidate;
    whatever fails is logged with its reason and no number is split or guessed.
    """
    tables = labels.withColumn("k", identity_name("table_label")).select(*DOC, F.col("evidence_id").alias("item_ref"), "table_label", "k")
    claims = experiment_tables.select(*DOC, "experiment", identity_name("table_label").alias("k")).distinct()
    assigned = tables.join(claims, [*DOC, "k"], "left").groupBy(*DOC, "item_ref", "table_label").agg(
        F.count("experiment").alias("n"), F.min("experiment").alias("experiment")
    )
    cells = units.where("kind = 'table_cell'")
    mixed = cells.where(F.arrays_overlap("issues", F.array(*[F.lit(f) for f in AMBIGUOUS_FLAGS]))).select(*DOC, "item_ref").distinct().withColumn("mixed", F.lit(True))
    judged = assigned.join(mixed, [*DOC, "item_ref"], "left").withColumn(
        "reason", F.when(F.col("n") != 1, "table_experiment_assignment_not_unique").when(F.col("mixed"), "ambiguous_table_cells")
    )
    header = F.col("column_header") | F.col("row_header") | F.col("row_section")
    numeric = cells.where(~header & strip("text").rlike(text.SINGLE_NUMBER)).select(*DOC, "item_ref", "evidence_id", strip("text").alias("value"))
    rows = skew.salted_join(numeric, judged.where("reason IS NULL").select(*DOC, "item_ref", "table_label", "experiment"), [*DOC, "item_ref"], spread=["evidence_id"])
    rows = skew.shuffled_join(rows, cell_contexts(units, context), [*DOC, "evidence_id"], "left")
    leaf, label = F.col("leaf")[0], F.col("labels")[0]
    many = (F.size("leaf") != 1) | (leaf["width"] != 1) | (F.size("labels") != 1)
    rows = rows.withColumn("row_label", strip(label["text"])).withColumn("column_label", metric_name(leaf["text"]))
    rows = rows.withColumn("mk", identity_name("column_label")).withColumn("rk", identity_name("row_label"))
    known = metrics.select(*DOC, identity_name("name").alias("mk")).distinct().withColumn("known_metric", F.lit(True))
    configs = configurations.groupBy(*DOC, "experiment", identity_name("name").alias("rk")).agg(F.count("*").alias("configs"))
    by_method = methods.groupBy(*DOC, identity_name("name").alias("rk")).agg(F.min("name").alias("method"))
    proposed = methods.where("proposed").groupBy(*DOC).agg(F.count("*").alias("p"), F.min("name").alias("own_method"))
    rows = (
        rows.join(known, [*DOC, "mk"], "left").join(configs, [*DOC, "experiment", "rk"], "left")
        .join(by_method, [*DOC, "rk"], "left").join(proposed, DOC, "left")
    )
    method = F.coalesce("method", F.when(F.col("rk").isin(*OWN_ROWS) & (F.col("p") == 1), F.col("own_method")))
    usable = (F.col("configs") == 1) | (F.col("configs").isNull() & method.isNotNull())
    reason = (
        F.when(F.col("heads").isNull() | F.col("labels").isNull(), "missing_row_or_column_context")
        .when(many, "non_unique_leaf_header_or_row")
        .when(F.col("known_metric").isNull() & ((F.col("column_label") == "") | F.col("column_label").rlike(r"\d.*\d")), "invalid_metric_header")
        .when(~F.coalesce(usable, F.lit(False)), "configuration_not_unique")
    )
    rows = rows.withColumn("reason", reason)
    direction = F.when(F.contains(leaf["text"], F.lit("↓")), "lower").when(F.contains(leaf["text"], F.lit("↑")), "higher").otherwise("unspecified")
    key = [*DOC, "table_label", "row_label", "column_label", "experiment"]
    made = rows.where("reason IS NULL").groupBy(*key).agg(
        F.min_by(F.struct("evidence_id", "value", direction.alias("direction"), F.coalesce(method, "row_label").alias("method")), "evidence_id").alias("m")
    ).select(*key, "m.*")
    unresolved = judged.where("reason IS NOT NULL").select(*DOC, F.col("item_ref").alias("ref"), "reason").unionByName(
        rows.where("reason IS NOT NULL").select(*DOC, F.col("evidence_id").alias("ref"), "reason")
    )
    return made, unresolved


# ---- assessment ----------------------------------------------------------------------
def mention_candidates(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(document_id, k, ref): texts that hold the first two words of a name `k` side by side, or its only word.

    names(document_id, k), texts(document_id, ref, body). Between whole words of a name and of a text stands the same, so no mention is lost.
    """
    listed = lambda c: F.regexp_extract_all(c, F.lit(rf"({WORD}+)"), F.lit(1))
    sought = names.select(*DOC, "k", F.array_join(F.slice(listed(F.col("k")), 1, 2), " ").alias("word")).where("word <> ''").distinct()
    split = texts.select(*DOC, "ref", listed(F.col("body")).alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.concat_ws(" ", a, b))
    words = split.select(*DOC, "ref", F.explode(F.array_distinct(F.concat("w", pairs))).alias("word")).join(sought.select(*DOC, "word").distinct(), [*DOC, "word"], "left_semi")
    return sought.join(words, [*DOC, "word"]).select(*DOC, "k", "ref")


def _pieces(c: Column) -> tuple[Column, Column]:
    """Words of a text, and what stands before, between and after them."""
    return F.regexp_extract_all(c, F.lit(rf"({WORD}+)"), F.lit(1)), F.split(c, rf"{WORD}+", -1)


def short_mentions(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(document_id, k, ref): texts that name `k`, a name of one or two words, without a look at the texts themselves.

    names(document_id, k), texts(document_id, ref, body) normalized. A posting is a word, or two with what stands between them, and
    the gaps around it; a gap at an end of the text is marked, so that a name's own signs never reach into a word.
    """
    kw, ks = _pieces(F.col("k"))
    sought = names.withColumn("w", kw).withColumn("s", ks).where(F.size("w").isin(1, 2)).select(
        *DOC, "k", F.when(F.size("w") == 1, F.col("w")[0]).otherwise(F.concat(F.get("w", F.lit(0)), F.get("s", F.lit(1)), F.get("w", F.lit(1)))).alias("core"),
        F.col("s")[0].alias("lead"), F.element_at("s", -1).alias("trail")).distinct()
    w, s = _pieces(F.col("body"))
    split = texts.select(*DOC, "ref", w.alias("w"), s.alias("s")).where("size(w) > 0")
    # Normalized texts hold no line ends: one parts the fields of a posting, and marks an end of the text. Strings are told apart by
    # hashes, structs would be compared with one another.
    part, n = F.lit("\n"), F.size("w")
    gap = lambda i: F.get("s", i)
    before = lambda i: F.when(i == 0, F.concat(F.lit("\t"), gap(i))).otherwise(gap(i))
    after = lambda i: F.when(i == n, F.concat(gap(i), F.lit("\t"))).otherwise(gap(i))
    one = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.get("w", i), part, before(i), part, after(i + 1)))
    pair = lambda i: F.concat(F.get("w", i), gap(i + 1), F.get("w", i + 1), part, before(i), part, after(i + 2))
    two = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), pair)).otherwise(F.array().cast("array<string>"))
    told = split.select(*DOC, "ref", F.explode(F.array_distinct(F.concat(one, two))).alias("x")).withColumn("x", F.split("x", "\n"))
    postings = told.select(*DOC, "ref", F.col("x")[0].alias("core"), F.col("x")[1].alias("pre"), F.col("x")[2].alias("post"))
    fits = lambda own, whole, ends: (own == "") | (ends & (F.length(whole) > F.length(own)))
    met = skew.shuffled_join(postings, sought, [*DOC, "core"]).where(
        fits(F.col("lead"), F.col("pre"), F.endswith("pre", F.col("lead"))) & fits(F.col("trail"), F.col("post"), F.startswith("post", F.col("trail"))))
    return met.select(*DOC, "k", "ref").distinct()


def name_mentions(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(document_id, k, ref): texts that hold a name as whole words; only names of more than two words are looked up in the texts."""
    long = names.where(F.size(_pieces(F.col("k"))[0]) > 2)
    found = mention_candidates(long, texts).join(texts, [*DOC, "ref"]).where(contains_word(F.col("body"), F.col("k"))).select(*DOC, "k", "ref")
    return short_mentions(names, texts).unionByName(found)


def mentions(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """Units naming a node as whole words; nodes of one name are looked up once."""
    names = nodes.where(F.length("name") > 0).select(*NODE, normalized("name").alias("k"))
    texts = units.select(*DOC, F.col("evidence_id").alias("ref"), normalized("text").alias("body"))
    return names.join(name_mentions(names.select(*DOC, "k").distinct(), texts), [*DOC, "k"]).select(*NODE, "ref")


def node_anchors(nodes: DataFrame, evidence: DataFrame, units: DataFrame, context: DataFrame, table_labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, refs): groups(document_id, id, grp, linkage) has the strongest kind of source link of each node, refs(document_id, grp, ref)
    the places; nodes that only share a name share a group, so places of a name are listed once.

    evidence(document_id, id, quote, source_ref)
    """
    texts = stage(units.select(*DOC, "evidence_id", normalized("text").alias("body")))
    quotes = evidence.select(*DOC, F.col("id").alias("quote_id"), "quote", "source_ref")
    quoted = locate_quotes(quotes, units, bodies=texts).select(*DOC, F.col("quote_id").alias("id"), F.col("evidence_id").alias("ref")).distinct()
    statements = nodes.where("label = 'Finding'").select(*DOC, F.col("id").alias("quote_id"), F.col("statement").alias("quote"), F.lit(None).cast("string").alias("source_ref"))
    stated = locate_quotes(statements, units, bodies=texts).select(*DOC, F.col("quote_id").alias("id"), F.col("evidence_id").alias("ref"))
    grounded = valid_measurements(nodes, units, context, table_labels).select(*NODE, F.explode("refs").alias("ref"))
    direct = stage(grounded.withColumn("r", F.lit(0)).unionByName(quoted.withColumn("r", F.lit(1))).unionByName(stated.withColumn("r", F.lit(2))).distinct())
    best = direct.groupBy(*NODE).agg(F.min("r").alias("r"))
    linkage = F.element_at(F.array(*[F.lit(x) for x in ("source_cell_assignment", "quote_match", "exact_statement_match")]), F.col("r") + 1)
    own = F.concat(F.lit("n"), "id")
    names = nodes.where(F.col("label").isin(*MENTIONED) & (F.length("name") > 0)).select(*NODE, normalized("name").alias("k"))
    named = stage(skew.shuffled_join(names, best, NODE, "left_anti").distinct())
    found = stage(name_mentions(named.select(*DOC, "k").distinct(), texts.withColumnRenamed("evidence_id", "ref")))
    by_name = skew.shuffled_join(named, found.select(*DOC, "k").distinct(), [*DOC, "k"], "left_semi")
    groups = best.select(*NODE, own.alias("grp"), linkage.alias("linkage")).unionByName(by_name.select(*NODE, F.concat(F.lit("k"), "k").alias("grp"), F.lit("name_match_only").alias("linkage")))
    refs = skew.shuffled_join(direct, best, [*NODE, "r"]).select(*DOC, own.alias("grp"), "ref").distinct().unionByName(found.select(*DOC, F.concat(F.lit("k"), "k").alias("grp"), "ref"))
    return groups, refs


def grouped_anchors(anchors: DataFrame | tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(groups, refs) as of `node_anchors`; plain anchors(document_id, id, ref, linkage) make a group for each node."""
    if isinstance(anchors, tuple):
        return anchors
    own = F.concat(F.lit("n"), "id").alias("grp")
    return anchors.groupBy(*NODE).agg(F.min("linkage").alias("linkage")).select(*NODE, own, "linkage"), anchors.select(*DOC, own, "ref")


def valid_measurements(nodes: DataFrame, units: DataFrame, context: DataFrame, table_labels: DataFrame) -> DataFrame:
    """Measurements whose cell, header, row and table still agree with the source."""
    m = nodes.where("label = 'Measurement'").select(*NODE, "cell_ref", "reported_value", "row_label", "column_label", "table_label")
    cells = units.where("kind = 'table_cell'").select(
        *DOC, F.col("evidence_id").alias("cell_ref"), strip("text").alias("body"), "item_ref", F.arrays_overlap("issues", F.array(*[F.lit(f) for f in AMBIGUOUS_FLAGS])).alias("mixed")
    )
    around = cell_contexts(units, context).withColumnRenamed("evidence_id", "cell_ref")
    named = table_labels.select(*DOC, F.col("evidence_id").alias("item_ref"), F.col("table_label").alias("expected_table"))
    leaf, label = F.col("leaf")[0], F.col("labels")[0]
    ok = (
        (F.col("body") == F.col("reported_value")) & ~F.col("mixed") & (F.size("leaf") == 1) & (leaf["width"] == 1) & (F.size("labels") == 1)
        & (metric_name(leaf["text"]) == F.col("column_label")) & (strip(label["text"]) == F.col("row_label")) & (F.col("expected_table") == F.col("table_label"))
    )
    refs = F.concat(F.array("cell_ref"), F.col("heads.ref"), F.col("labels.ref"))
    return m.join(cells, [*DOC, "cell_ref"]).join(around, [*DOC, "cell_ref"]).join(named, [*DOC, "item_ref"], "left").where(ok).select(*NODE, F.array_distinct(refs).alias("refs"))


def assess_nodes(nodes: DataFrame, anchors: DataFrame | tuple[DataFrame, DataFrame]) -> DataFrame:
    """Support status of each node: rejected, source_linked or needs_review."""
    k = nodes.withColumn("__k", identity_name(F.coalesce("name", F.lit(""))))
    taken = lambda label: k.where(F.col("label") == label).select(*DOC, "__k").distinct().withColumn(f"__{label}", F.lit(True))
    groups, refs = grouped_anchors(anchors)
    links = skew.shuffled_join(groups, refs.groupBy(*DOC, "grp").agg(F.count("*").alias("anchors")), [*DOC, "grp"]).select(*NODE, "linkage", "anchors")
    rows = k.join(taken("Metric"), [*DOC, "__k"], "left").join(taken("Dataset"), [*DOC, "__k"], "left").join(links, NODE, "left")
    label = F.col("label")
    invalid = (
        ((label == "Concept") & F.col("__Metric").isNotNull())
        | ((label == "Method") & (F.col("__Dataset").isNotNull() | F.coalesce(F.col("name"), F.lit("")).rlike(NO_METHOD)))
        | ((label == "Measurement") & ~F.col("linkage").eqNullSafe("source_cell_assignment"))
    )
    status = F.when(invalid, "rejected").when(F.coalesce("anchors", F.lit(0)) > 0, "source_linked").otherwise("needs_review")
    return rows.select(*nodes.columns, status.alias("support_status"), F.coalesce("linkage", F.lit("unresolved")).alias("linkage"), F.coalesce("anchors", F.lit(0)).cast("long").alias("anchors"))


def assess_edges(edges: DataFrame, nodes: DataFrame, anchors: DataFrame | tuple[DataFrame, DataFrame], units: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """Support of each edge by the first applicable rule.

    edges(document_id, edge_id, source, target, label); nodes from `assess_nodes`;
    checked(document_id, edge_id, accepted) for edges carrying their own quotations.
    """
    cols = F.struct("label", "name", "support_status", "anchors", "row_label", "column_label", "experiment_name", "role")
    n = nodes.select(*DOC, "id", cols.alias("n"))
    rows = edges.join(n.select(*DOC, F.col("id").alias("source"), F.col("n").alias("s")), [*DOC, "source"]).join(
        n.select(*DOC, F.col("id").alias("target"), F.col("n").alias("t")), [*DOC, "target"]
    )
    if checked is None:
        rows = rows.withColumn("accepted", F.lit(None).cast("boolean"))
    else:
        rows = rows.join(checked.select(*DOC, "edge_id", "accepted"), [*DOC, "edge_id"], "left")
    s, t, label = F.col("s"), F.col("t"), F.col("label")
    own = nodes.where("label = 'Method' AND role = 'proposed'").groupBy(*DOC).agg(F.count("*").alias("proposed"), F.min("id").alias("own_id"))
    rows = rows.join(own, DOC, "left")
    # Passages of a method naming the target next to a cue, and passages both ends share; told once for all edges between two groups.
    groups, refs = grouped_anchors(anchors)
    refs = refs.distinct()
    sizes = refs.groupBy(*DOC, "grp").agg(F.count("*").alias("n"))
    sized = skew.shuffled_join(groups.select(*NODE, "grp"), sizes, [*DOC, "grp"])
    end = lambda c, g: sized.select(*DOC, F.col("id").alias(c), F.col("grp").alias(g), F.col("n").alias(f"n_{g}"))
    left = skew.shuffled_join(edges.select(*DOC, "edge_id", "source", "target", "label"), end("source", "gs"), [*DOC, "source"])
    ends = skew.shuffled_join(left, end("target", "gt"), [*DOC, "target"])
    # The places of the smaller group are looked for among those of the larger one.
    swap = F.col("n_gs") > F.col("n_gt")
    pairs = ends.select(*DOC, F.when(swap, F.col("gt")).otherwise(F.col("gs")).alias("few"), F.when(swap, F.col("gs")).otherwise(F.col("gt")).alias("many")).distinct()
    met = skew.shuffled_join(pairs.where("few <> many"), refs.withColumnRenamed("grp", "few"), [*DOC, "few"])
    met = skew.shuffled_join(met, refs.withColumnRenamed("grp", "many"), [*DOC, "many", "ref"], "left_semi").select(*DOC, "few", "many").distinct()
    alike = met.unionByName(pairs.where("few = many")).select(*DOC, F.col("few").alias("a"), F.col("many").alias("b"))
    keyed = ends.select(*DOC, "edge_id", F.when(swap, F.col("gt")).otherwise(F.col("gs")).alias("a"), F.when(swap, F.col("gs")).otherwise(F.col("gt")).alias("b"))
    shared = skew.shuffled_join(keyed, alike, [*DOC, "a", "b"]).select(*DOC, "edge_id").distinct().withColumn("shared", F.lit(True))
    methods = nodes.where("label = 'Method'").select(*DOC, F.col("id").alias("source"))
    asked = skew.shuffled_join(left.where(F.col("label").isin(*EDGE_CUES)), methods, [*DOC, "source"], "left_semi")
    asked = skew.shuffled_join(asked, nodes.select(*DOC, F.col("id").alias("target"), normalized(F.coalesce("name", F.lit(""))).alias("tk")), [*DOC, "target"]).where("tk <> ''")
    cues = F.array_compact(F.array(*[F.when(F.col("body").rlike(c), F.lit(p)) for p, c in EDGE_CUES.items()]))
    told = units.select(*DOC, F.col("evidence_id").alias("ref"), normalized("text").alias("body")).withColumn("cues", cues).where("size(cues) > 0")
    sought = skew.shuffled_join(asked.select(*DOC, F.col("gs").alias("grp"), "tk", "label").distinct(), refs, [*DOC, "grp"])
    held = skew.shuffled_join(sought, told, [*DOC, "ref"]).where(F.array_contains("cues", F.col("label")) & F.contains("body", "tk")).select(*DOC, F.col("grp").alias("gs"), "tk", "label").distinct()
    cued = skew.shuffled_join(asked, held, [*DOC, "gs", "tk", "label"]).select(*DOC, "edge_id").distinct().withColumn("cued", F.lit(True))
    rows = rows.join(shared, [*DOC, "edge_id"], "left").join(cued, [*DOC, "edge_id"], "left")
    bad_pattern = F.coalesce(
        *[F.when(label == p, ((s["label"] != a) if a else F.lit(False)) | (t["label"] != b)) for p, (a, b) in PATTERNS.items()], F.lit(False)
    )
    rejected = (s["support_status"] == "rejected") | (t["support_status"] == "rejected") | bad_pattern
    measured = (s["label"] == "Measurement") | (t["label"] == "Measurement")
    m = F.when(s["label"] == "Measurement", s).otherwise(t)
    key = lambda c: F.lower(F.trim(F.translate(F.coalesce(c, F.lit("")), "†‡", "")))
    fits = (
        F.when(label == "USES_METRIC", key(t["name"]) == key(m["column_label"]))
        .when(label == "FOR_CONFIGURATION", (key(t["name"]) == key(m["row_label"])) & t["experiment_name"].eqNullSafe(m["experiment_name"]))
        .when(label == "REPORTS_MEASUREMENT", s["name"].eqNullSafe(m["experiment_name"]))
        .otherwise(F.lit(True))
    )
    row_name = key(s["name"])
    prefix = F.lit(False)
    for p in OWN_ROW_PREFIXES:
        prefix = prefix | row_name.startswith(p)
    owned = (row_name == key(t["name"])) | ((F.col("proposed") == 1) & (F.col("own_id") == F.col("target")) & (row_name.isin(*OWN_ROWS) | prefix))
    linked = lambda cond, reason: F.when(cond, F.struct(F.lit("source_linked").alias("status"), F.lit(reason).alias("reason")))
    open_ = F.struct(F.lit("needs_review").alias("status"), F.lit("source_support_not_resolved").alias("reason"))
    say = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    verdict = (
        F.when(rejected, say("rejected", "invalid_entity_type_or_relationship_pattern"))
        .when(F.col("accepted"), say("source_linked", "exact_relation_quotations_and_lexical_checks"))
        .when(~F.col("accepted"), say("rejected", "relation_quotations_failed"))
        .when(measured & (m["support_status"] == "source_linked") & fits, say("cell_grounded", "exact_value_and_source_cell_context"))
        .when(measured & (m["support_status"] == "source_linked"), say("rejected", "measurement_relationship_context_mismatch"))
        .when(measured, open_)
        .when((s["label"] == "ResearchPaper") & (t["anchors"] > 0), say("source_linked", "paper_record_and_exact_supporting_passage"))
        .when((label == "CONFIGURATION_OF") & (s["anchors"] > 0), F.coalesce(linked(owned, "source_row_and_within_paper_method_identity"), open_))
        .when((label == "EVALUATES") & t["experiment_name"].eqNullSafe(s["name"]) & (t["anchors"] > 0) & (s["anchors"] > 0), say("source_linked", "source_table_row_and_caption"))
        .when(s["label"] == "Method", F.coalesce(linked(F.col("cued"), "target_and_relationship_cue_in_source_passage"), open_))
        .otherwise(F.coalesce(linked(F.col("shared"), "shared_source_passage"), open_))
    )
    return rows.withColumn("v", verdict).select(*DOC, "edge_id", "source", "target", "label", F.col("v.status").alias("support_status"), F.col("v.reason").alias("support_reason"))


def usable_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Linked edges and the nodes they use."""
    good = edges.where(F.col("support_status").isin(*LINKED))
    used = good.select(*DOC, F.explode(F.array("source", "target")).alias("id")).distinct()
    return nodes.where("support_status <> 'rejected'").join(used, NODE, "left_semi"), good


def status_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*DOC, "support_status").agg(F.count("*").alias("n"))


# ---- runs and summaries --------------------------------------------------------------
def combine_faults(runs: DataFrame) -> DataFrame:
    """Why a group of runs may not be combined. runs(group_id, run_id, source_sha256, schema_sha256, status)"""
    facts = runs.groupBy("group_id").agg(
        (F.count_distinct("source_sha256") != 1).alias("a"), (F.count_distinct("schema_sha256") != 1).alias("b"), F.bool_or(F.col("status") == "running").alias("c")
    )
    rules = text.codes((F.col("a"), "different_sources"), (F.col("b"), "different_schemas"), (F.col("c"), "run_not_finished"))
    return facts.select("group_id", F.explode(rules).alias("fault"))


def recovered_batches(batches: DataFrame) -> DataFrame:
    """Failed batches whose references other batches of the group extracted.

    batches(group_id, batch_id, status, refs)
    """
    flat = batches.select("group_id", "batch_id", "status", F.explode("refs").alias("ref"))
    done = flat.where("status = 'extracted'").select("group_id", "ref").distinct().withColumn("__done", F.lit(True))
    failed = flat.where("status <> 'extracted'").join(done, ["group_id", "ref"], "left")
    covered = failed.groupBy("group_id", "batch_id").agg(F.every(F.col("__done").isNotNull()).alias("covered"))
    return batches.join(covered, ["group_id", "batch_id"], "left").withColumn(
        "status", F.when(F.col("covered"), "recovered_by_smaller_batches").otherwise(F.col("status"))
    ).drop("covered")


def section_coverage(chunks: DataFrame, selected: DataFrame, nodes_refs: DataFrame) -> DataFrame:
    """Extraction state and linked nodes per chunk.

    chunks(document_id, chunk_id, refs); selected(document_id, ref); nodes_refs(document_id, id, ref)
    """
    refs = chunks.select(*DOC, "chunk_id", F.explode(F.array_distinct("refs")).alias("ref")).distinct()
    inside = refs.join(selected.distinct(), [*DOC, "ref"], "left_semi").select(*DOC, "chunk_id").distinct().withColumn("__in", F.lit(True))
    linked = refs.join(nodes_refs.select(*DOC, "id", "ref").distinct(), [*DOC, "ref"]).groupBy(*DOC, "chunk_id").agg(F.count_distinct("id").alias("n"))
    return chunks.select(*DOC, "chunk_id").join(inside, [*DOC, "chunk_id"], "left").join(linked, [*DOC, "chunk_id"], "left").select(
        *DOC, "chunk_id", F.when(F.col("__in"), "extracted_in_selected_scope").otherwise("not_attempted").alias("extraction_status"),
        F.coalesce("n", F.lit(0)).alias("source_linked_nodes"),
    )


def run_outcomes(runs: DataFrame) -> DataFrame:
    """Final status of each run from its gates.

    runs(run_id, nodes_beyond_root, edges, relation_gate, needs_review, unresolved, partial, review_complete)
    """
    substantive = (F.col("edges") > 0) & (F.col("nodes_beyond_root") > 0)
    status = (
        F.when(~substantive, "insufficient_extraction")
        .when(F.col("partial"), "partial_document_extraction")
        .when(~F.col("relation_gate"), "insufficient_relationship_extraction")
        .when((F.col("needs_review") > 0) | (F.col("unresolved") > 0), "complete_with_unresolved")
        .otherwise("complete")
    )
    return runs.select("run_id", status.alias("status"), substantive.alias("substantive"), (substantive & F.col("relation_gate") & F.col("review_complete")).alias("gate_passed"))


def contract_outcomes(events: DataFrame) -> DataFrame:
    """Which extraction contract a run really used. events(run_id, requested, source_type, parsed)"""
    dense, direct = F.col("source_type") == "chunk_batch", F.col("source_type") == "chunk"
    f = events.groupBy("run_id", "requested").agg(
        F.bool_or(dense).alias("dense"), F.bool_or(dense & F.col("parsed")).alias("dense_ok"), F.bool_or(direct & F.col("parsed")).alias("direct_ok")
    )
    outcome = (
        F.when(F.col("dense") & ~F.col("dense_ok") & F.col("direct_ok"), "direct_fallback_after_dense_failure")
        .when(F.col("dense_ok"), "dense").when(F.col("direct_ok"), "direct").otherwise(F.concat(F.lit("unresolved_"), "requested"))
    )
    return f.select("run_id", outcome.alias("outcome"))


def understanding(nodes: DataFrame, edges: DataFrame, labels: tuple[str, ...] = ("BUILT_ON", "USES_COMPONENT", "TRAINED_ON")) -> DataFrame:
    """Per method the sorted names it links to, one column per edge label."""
    methods = nodes.where("label = 'Method'").select(*DOC, F.col("id").alias("source"), "name")
    named = edges.where(F.col("label").isin(*labels)).withColumnRenamed("label", "edge_label").join(methods, [*DOC, "source"]).join(
        nodes.select(*DOC, F.col("id").alias("target"), F.col("name").alias("target_name")), [*DOC, "target"]
    ).select(*DOC, "name", "edge_label", "target_name").distinct()
    wide = named.groupBy(*DOC, "name").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("edge_label") == x, F.col("target_name")))).alias(x.lower()) for x in labels]
    )
    return methods.select(*DOC, "name").distinct().join(wide, [*DOC, "name"], "left")
