"""Native graph tables: merging, provenance, payload, audits, components, communities.

entities(id, title, type, description); relationships(id, source, target, description, weight)
with endpoints naming entity titles; links to text units and source records are edge tables:
entity_units(id, unit_id), relation_units(id, unit_id), unit_sources(unit_id, source_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import skew
from attesta.functions.lineage import written
from attesta.functions.text import casefold, normalized

# Names that are citations or document parts rather than entities.
CITATION_NAME = r"(?i)\bet\s+al\.?\s*,?\s*\d{4}"
TABLE_NAME = r"^(?i)tab(?:le)?\.?\s*\d"
STRUCTURE_NAME = r"^(?:Tab\.|Table|Appendix|Figure)\s"
MARKER = r"(?m)^source_record_id:\s*([A-Za-z0-9:_-]+)"


# ---- merging and provenance ----------------------------------------------------------
def merge_relations(occurrences: DataFrame) -> DataFrame:
    """Relation occurrences merged by endpoint pair; the weight counts occurrences."""
    return occurrences.groupBy("source", "target").agg(
        F.sum("weight").alias("weight"), F.count_distinct("unit_id").alias("units")
    )


def merged_units(occurrences: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, unit_id): the text units of merged relations or entities, one row each, since a name may occur in any number of them."""
    return occurrences.select(*keys, "unit_id").distinct()


def merged_descriptions(occurrences: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, description, unit_id, times): the different descriptions of a merged row, each with its first unit and how often it occurs."""
    said = occurrences.where(F.trim(F.coalesce("description", F.lit(""))) != "")
    return said.groupBy(*keys, "description").agg(F.min("unit_id").alias("unit_id"), F.count("*").alias("times"))


def merge_entities(occurrences: DataFrame) -> DataFrame:
    """Entity occurrences merged by title; the most frequent type wins, ties by name."""
    typed = occurrences.groupBy("title", "type").agg(F.count("*").alias("n"))
    return typed.groupBy("title").agg(
        F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("type"), F.sum("n").alias("occurrences")
    )


def drop_orphans(relations: DataFrame, entities: DataFrame, key: str = "title") -> DataFrame:
    """Relations whose two endpoints are entities."""
    names = entities.select(F.col(key).alias("__n")).distinct()
    return relations.join(names, relations["source"] == names["__n"], "left_semi").join(
        names.withColumnRenamed("__n", "__m"), F.col("target") == F.col("__m"), "left_semi"
    )


def replay_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Pairs whose presence or weight differs between a replay and the stored graph."""
    e = expected.select("source", "target", F.col("weight").alias("expected_weight"))
    a = actual.select("source", "target", F.col("weight").alias("actual_weight"))
    return e.join(a, ["source", "target"], "full").where("NOT expected_weight <=> actual_weight")


def unit_sources(units: DataFrame, documents: DataFrame, known: DataFrame) -> DataFrame:
    """Source records of each text unit: markers in its text and its documents.

    units(id, text, document_ids); documents(id, source_id); known(source_id)
    """
    marked = units.select(F.col("id").alias("unit_id"), F.explode(F.regexp_extract_all("text", F.lit(MARKER), F.lit(1))).alias("source_id"))
    owned = units.select(F.col("id").alias("unit_id"), F.explode("document_ids").alias("id")).join(documents, "id").select("unit_id", "source_id")
    return marked.unionByName(owned).distinct().join(known.select("source_id"), "source_id", "left_semi").select("unit_id", "source_id")


def source_ledger(
    sources: DataFrame, entity_units: DataFrame, relation_units: DataFrame, communities: DataFrame, reports: DataFrame
) -> DataFrame:
    """(table, id, source_id) for every native row.

    communities(id, community, unit_id); reports(id, community)
    """
    def via(table: str, links: DataFrame) -> DataFrame:
        return links.join(sources, "unit_id").select(F.lit(table).alias("table"), F.col("id").cast("string").alias("id"), "source_id").distinct()

    direct = sources.select(F.lit("text_units").alias("table"), F.col("unit_id").cast("string").alias("id"), "source_id")
    grouped = communities.join(sources, "unit_id").select("community", F.col("id"), "source_id").distinct()
    by_report = reports.join(grouped.select("community", "source_id").distinct(), "community").select(
        F.lit("community_reports").alias("table"), F.col("id").cast("string").alias("id"), "source_id"
    )
    return (
        direct.unionByName(via("entities", entity_units))
        .unionByName(via("relationships", relation_units))
        .unionByName(grouped.select(F.lit("communities").alias("table"), F.col("id").cast("string").alias("id"), "source_id"))
        .unionByName(by_report)
    )


def resolve_context(context: DataFrame, natives: DataFrame, ledger: DataFrame, source_refs: DataFrame) -> DataFrame:
    """Retrieved context ids resolved to native rows, source records, references and pages.

    context(answer_id, category, table, citation_id); natives(table, citation_id, id);
    source_refs(source_id, ref, page_no)
    """
    cited = context.select("table", "citation_id").distinct().join(natives, ["table", "citation_id"])
    places = (
        cited.join(ledger, ["table", "id"])
        .join(source_refs, "source_id", "left")
        .groupBy("table", "citation_id", "id")
        .agg(F.array_sort(F.collect_set("ref")).alias("refs"), F.array_sort(F.collect_set("page_no")).alias("pages"), F.count_distinct("source_id").alias("sources"))
    )
    return (
        context.join(natives, ["table", "citation_id"], "left")
        .join(places, ["table", "citation_id", "id"], "left")
        .select("answer_id", "category", "citation_id", F.col("id").alias("native_id"), (F.coalesce("sources", F.lit(0)) > 0).alias("resolved"), "refs", "pages")
    )


# ---- degrees, payload, explorer ------------------------------------------------------
def degrees(relations: DataFrame) -> DataFrame:
    ends = relations.select(F.explode(F.array("source", "target")).alias("title"))
    return ends.groupBy("title").agg(F.count("*").alias("degree"))


def with_degree(entities: DataFrame, relations: DataFrame) -> DataFrame:
    return entities.join(degrees(relations), "title", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def name_audit(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Isolates and names that look like citations, tables or document parts."""
    return with_degree(entities, relations).select(
        "id", "title", (F.col("degree") == 0).alias("isolated"), F.col("title").rlike(CITATION_NAME).alias("citation_like"),
        F.col("title").rlike(TABLE_NAME).alias("table_like"), F.col("title").rlike(STRUCTURE_NAME).alias("structure_like"),
    )


def node_payload(entities: DataFrame, relations: DataFrame, membership: DataFrame, ledger: DataFrame, pages: DataFrame, reviews: DataFrame) -> DataFrame:
    """Nodes with degree, lowest-level community, source and page counts, review.

    membership(entity_id, community, level); pages(source_id, page_no); reviews(title, review)
    """
    lowest = membership.groupBy(F.col("entity_id").alias("id")).agg(F.min_by("community", F.struct("level", "community")).alias("community"))
    seen = (
        ledger.where("table = 'entities'").join(pages, "source_id", "left").groupBy("id")
        .agg(F.count_distinct("source_id").alias("sources"), F.min("page_no").alias("first_page"), F.count_distinct("page_no").alias("pages"))
    )
    return (
        with_degree(entities, relations)
        .join(lowest, "id", "left").join(seen, "id", "left").join(reviews, "title", "left")
        .select("id", F.col("title").alias("label"), F.coalesce("type", F.lit("Other")).alias("type"), "degree", "community",
                F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("pages", F.lit(0)).alias("pages"), "first_page", "review")
    )


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("\x1f", F.least(a, b), F.greatest(a, b))


def edge_payload(relations: DataFrame, entities: DataFrame, assertions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Edges with endpoint ids, directed assertions of the same pair, and reviews.

    assertions(source, target, kind, evidence, source_record_id); reviews(key, review)
    """
    ids = entities.groupBy("title").agg(F.max("id").alias("id"))
    claims = assertions.distinct().groupBy(pair_key(F.col("source"), F.col("target")).alias("pair")).agg(F.count("*").alias("assertions"))
    return (
        relations.withColumn("pair", pair_key(F.col("source"), F.col("target")))
        .withColumn("key", relationship_key(F.col("source"), F.col("target"), F.coalesce("description", F.lit(""))))
        .join(ids.select(F.col("title").alias("source"), F.col("id").alias("source_id")), "source", "left")
        .join(ids.select(F.col("title").alias("target"), F.col("id").alias("target_id")), "target", "left")
        .join(claims, "pair", "left").join(reviews, "key", "left")
        .select("id", "source_id", "target_id", F.col("source").alias("source_label"), F.col("target").alias("target_label"), "weight",
                F.coalesce("assertions", F.lit(0)).alias("assertions"), "review")
    )


def edge_assertions(relations: DataFrame, assertions: DataFrame) -> DataFrame:
    """Directed assertions under every edge of their pair: (id, source, target, kind, evidence, source_record_id, forward).

    Rows, not a list in the edge: a pair may be asserted any number of times. `forward` tells whether the assertion has the edge's direction.
    """
    said = assertions.select("source", "target", "kind", "evidence", "source_record_id").distinct().withColumn("pair", pair_key(F.col("source"), F.col("target")))
    ends = relations.select("id", F.col("source").alias("__s"), pair_key(F.col("source"), F.col("target")).alias("pair"))
    return ends.join(said, "pair").select("id", "source", "target", "kind", "evidence", "source_record_id", (F.col("source") == F.col("__s")).alias("forward"))


def slim_evidence(resolved: DataFrame) -> DataFrame:
    """Only the columns a viewer needs from resolved context rows."""
    return resolved.select("answer_id", "category", "citation_id", "native_id", "resolved", "refs", "pages")


def relationship_key(source: Column, target: Column, description: Column) -> Column:
    return F.sha2(F.to_json(F.array(source, target, description)), 256)


def explore(nodes: DataFrame, edges: DataFrame, *, kind: str | None = None, community: str | None = None, needle: str = "") -> tuple[DataFrame, DataFrame]:
    """Visible nodes by type, community and substring, with the edges between them."""
    shown = nodes.where(F.contains(F.lower("label"), F.lit(needle.lower())))
    if kind:
        shown = shown.where(F.col("type") == kind)
    if community is not None:
        shown = shown.where(F.col("community") == community)
    ids = shown.select("id")
    visible = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(
        ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi"
    )
    return shown.orderBy(F.desc("degree"), F.asc("label"), F.asc("id")), visible


#: Rules that one pass over the claims looks for.
GATES = 100


# ---- audits --------------------------------------------------------------------------
def dangling_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    names = entities.select(casefold("title").alias("k")).distinct()
    ends = relations.select("id", F.explode(F.array("source", "target")).alias("end")).select("id", casefold("end").alias("k"))
    return ends.join(names, "k", "left_anti").select("id").distinct()


def unmapped_relations(relations: DataFrame, ledger: DataFrame) -> DataFrame:
    mapped = ledger.where("table = 'relationships'").select("id").distinct()
    return relations.select(F.col("id").cast("string").alias("id")).join(mapped, "id", "left_anti")


def alias_collisions(entities: DataFrame) -> DataFrame:
    """Titles equal once everything but ASCII letters and digits is removed."""
    key = F.regexp_replace(casefold("title"), "[^a-z0-9]", "")
    return entities.groupBy(key.alias("key")).agg(F.count("*").alias("titles"), F.min("title").alias("first_title"), F.max("title").alias("last_title")).where("titles > 1")


def type_histogram(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count("*").alias("entities"))


def viewer_differences(natives: DataFrame, shown: DataFrame) -> DataFrame:
    """Missing, extra and repeated ids between native rows and a viewer's rows."""
    n = natives.select("id").distinct().withColumn("__n", F.lit(True))
    v = shown.groupBy("id").agg(F.count("*").alias("copies"))
    fault = (
        F.when(F.col("copies").isNull(), "missing").when(F.col("__n").isNull(), "extra").when(F.col("copies") > 1, "duplicate")
    )
    return n.join(v, "id", "full").select("id", fault.alias("fault")).where("fault IS NOT NULL")


def wrong_endpoints(relations: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Viewer edges whose endpoint ids do not carry the native endpoint titles."""
    label = nodes.groupBy("id").agg(F.max("label").alias("label"))
    return (
        edges.join(relations.select("id", F.col("source").alias("__s"), F.col("target").alias("__t")), "id")
        .join(label.select(F.col("id").alias("source_id"), F.col("label").alias("__a")), "source_id", "left")
        .join(label.select(F.col("id").alias("target_id"), F.col("label").alias("__b")), "target_id", "left")
        .where("NOT (__a <=> __s) OR NOT (__b <=> __t)")
        .select("id")
    )


def reference_relations(facts: DataFrame, relations: DataFrame, scope: DataFrame) -> DataFrame:
    """Whether a reference fact's endpoint pair exists, inside the selected source scope.

    facts(fact_id, subject, object, refs); scope(ref)
    """
    pairs = relations.select(pair_key(casefold("source"), casefold("target")).alias("pair")).distinct().withColumn("present", F.lit(True))
    inside = facts.select("fact_id", F.explode("refs").alias("ref")).join(scope.select("ref").distinct(), "ref", "left_semi").select("fact_id").distinct().withColumn("in_scope", F.lit(True))
    return (
        facts.withColumn("pair", pair_key(casefold("subject"), casefold("object")))
        .join(pairs, "pair", "left").join(inside, "fact_id", "left")
        .select("fact_id", F.coalesce("in_scope", F.lit(False)).alias("in_scope"),
                F.when(F.col("in_scope"), F.coalesce("present", F.lit(False))).alias("endpoint_pair_present"))
    )


def review_sample(relations: DataFrame, size: int = 24, seed: int = 42) -> DataFrame:
    """Reproducible sample by hash of seed and stable relation text (not of native ids)."""
    key = F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), "source", "target", F.coalesce("description", F.lit(""))), 256)
    return relations.withColumn("sample_key", key).orderBy("sample_key").limit(size)


def coverage(units: DataFrame, sources: DataFrame, requests: DataFrame, records: DataFrame, communities: DataFrame, reports: DataFrame) -> DataFrame:
    """Open points of a graph build: one row per kind and id; empty means complete.

    units(id, text); requests(text_sha256) of successful extractions; records(source_id);
    communities(community); reports(community)
    """
    keyed = units.select(F.col("id").cast("string").alias("id"), F.sha2(F.trim("text"), 256).alias("text_sha256"))
    row = lambda df, kind, col: df.select(F.lit(kind).alias("kind"), F.col(col).cast("string").alias("id")).distinct()
    no_request = row(keyed.join(requests.select("text_sha256").distinct(), "text_sha256", "left_anti"), "unit_without_extraction", "id")
    no_source = row(keyed.join(sources.select(F.col("unit_id").cast("string").alias("id")).distinct(), "id", "left_anti"), "unit_without_source", "id")
    unmapped = row(records.join(sources.select("source_id").distinct(), "source_id", "left_anti"), "unmapped_record", "source_id")
    unreported = row(communities.select("community").distinct().join(reports.select("community").distinct(), "community", "left_anti"), "community_without_report", "community")
    return no_request.unionByName(no_source).unionByName(unmapped).unionByName(unreported)


def rebuild_gates(relations: DataFrame, assertions: DataFrame, names: DataFrame, open_points: DataFrame, rules: DataFrame) -> DataFrame:
    """Named boolean gates of a rebuild, one row per gate.

    rules(gate, kind, source_like, target_like, expected): an assertion of `kind` whose
    normalized endpoints contain the given text must (or must not) exist.
    """
    base = names.agg(
        (~F.coalesce(F.bool_or("citation_like"), F.lit(False))).alias("no_citation_nodes"),
        (~F.coalesce(F.bool_or("table_like"), F.lit(False))).alias("no_table_reference_nodes"),
    )
    ends = assertions.select(pair_key(F.col("source"), F.col("target")).alias("pair")).distinct()
    bare = relations.select("id", pair_key(F.col("source"), F.col("target")).alias("pair")).join(ends, "pair", "left_anti")
    gate = lambda df, name: df.agg((F.count("*") == 0).alias("passed")).select(F.lit(name).alias("gate"), "passed")
    # Rules are named in a configuration: they are read once and looked for together, GATES of them in a pass over the claims.
    claims = assertions.select("kind", normalized("source").alias("s"), normalized("target").alias("t")).distinct()
    known = rules.select("gate", "kind", F.coalesce("source_like", F.lit("")).alias("s"), F.coalesce("target_like", F.lit("")).alias("t"), "expected").collect()
    shape = rules.select("gate", F.lit(True).alias("passed")).schema
    targeted = rules.sparkSession.createDataFrame([], shape)
    for at in range(0, len(known), GATES):
        part = known[at : at + GATES]
        met = [F.coalesce(F.bool_or((F.col("kind") == r["kind"]) & F.contains("s", F.lit(r["s"])) & F.contains("t", F.lit(r["t"]))), F.lit(False)) == F.lit(r["expected"]) for r in part]
        row = claims.agg(*[m.alias(f"m{i}") for i, m in enumerate(met)])
        targeted = targeted.unionByName(row.select(F.inline(F.array(*[F.struct(F.lit(r["gate"]).alias("gate"), F.col(f"m{i}").alias("passed")) for i, r in enumerate(part)]))))
    stacked = base.select(F.inline(F.array(*[F.struct(F.lit(c).alias("gate"), F.col(c).alias("passed")) for c in base.columns])))
    return (
        stacked.unionByName(gate(bare, "all_native_edges_have_assertion_provenance"))
        .unionByName(gate(open_points, "processing_complete")).unionByName(targeted)
    )


# ---- components, local context ------------------------------------------
def _pointers(e: DataFrame) -> DataFrame:
    """(u, v, leaf) of each node with an edge: a leaf points at its only neighbour, a smaller one, others at themselves."""
    least = e.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("top"))
    above = e.select(F.col("v").alias("u"), F.lit(True).alias("above")).distinct()
    leaf = F.col("above").isNull() & (F.col("v") == F.col("top"))
    return skew.shuffled_join(least, above, ["u"], "full").select("u", F.when(leaf, F.col("v")).otherwise(F.col("u")).alias("v"), leaf.alias("leaf"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): smallest id of each weakly connected component.

    Edges lead from the larger to the smaller id. A leaf, whose only neighbour is a smaller one, is never the smallest of
    its component, so it is set aside with that neighbour. What is left goes through a large-star and a small-star step
    (Kiveris et al., 2014), until nothing is left: the number of rounds grows with the logarithm of the graph, not with its
    diameter, and a finished star is in no later round. Every step is a map-side-combined minimum per node plus one equi-join.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        n = both(e) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = n.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = skew.shuffled_join(n, least, ["u"])
        out = joined.where("v > u") if large else joined
        result = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            result = result.unionByName(least.select("u", F.col("m").alias("v")))
        return result.where("u <> v").distinct()

    oriented = edges.where("source <> target").select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v"))
    rounds = [written(oriented, "links")]
    while not rounds[-1].isEmpty():
        e = rounds[-1]
        core = written(skew.shuffled_join(e, _pointers(e).where("NOT leaf").select("u"), ["u"], "left_semi"), "links")
        rounds.append(written(star(star(core, True), False), "links"))
    found = None
    for e in reversed(rounds[1:-1]):
        found = _followed(_pointers(e).select("u", "v"), found)
    at = nodes.select("id")
    if len(rounds) > 1:
        hung = _pointers(rounds[0]).select(F.col("u").alias("id"), F.col("v").alias("__v"))
        at = skew.shuffled_join(at, hung, ["id"], "left").select("id", F.coalesce("__v", "id").alias("v"))
    else:
        at = at.withColumn("v", F.col("id"))
    return _followed(at, found).withColumnRenamed("v", "component")


def _followed(pointers: DataFrame, found: DataFrame | None) -> DataFrame:
    """Pointers whose ends are replaced by what was found for them in later rounds."""
    if found is None:
        return pointers
    ends = found.select(F.col("u").alias("v"), F.col("v").alias("__end"))
    return skew.shuffled_join(pointers, ends, ["v"], "left").select(pointers.columns[0], F.coalesce("__end", "v").alias("v"))


def local_context(entity_hits: DataFrame, relations: DataFrame, entity_units: DataFrame, k_entities: int = 8, k_relations: int = 12, k_units: int = 20) -> DataFrame:
    """Graph context of a question: nearest entities, their strongest relations, their text units.

    entity_hits(question_id, id, title, distance, ordinal); output (question_id, category, id, place).
    """
    ask = ["question_id"]
    chosen = skew.top_k(entity_hits, ask, [F.asc("distance"), F.asc("ordinal")], k_entities, "place")
    ends = chosen.select("question_id", "title")
    touching = (
        relations.join(ends.withColumnRenamed("title", "source"), "source").select("question_id", "id", "weight")
        .unionByName(relations.join(ends.withColumnRenamed("title", "target"), "target").select("question_id", "id", "weight"))
        .groupBy("question_id", "id").agg(F.max("weight").alias("weight"), F.count("*").alias("ends"))
    )
    best = skew.top_k(touching, ask, [F.desc("ends"), F.desc("weight"), F.asc("id")], k_relations, "place")
    units = chosen.select("question_id", "id").join(entity_units, "id").groupBy("question_id", "unit_id").agg(F.count("*").alias("n"))
    top_units = skew.top_k(units, ask, [F.desc("n"), F.asc("unit_id")], k_units, "place")
    pick = lambda df, name, col: df.select("question_id", F.lit(name).alias("category"), F.col(col).alias("id"), "place")
    return pick(chosen, "entities", "id").unionByName(pick(best, "relationships", "id")).unionByName(pick(top_units, "sources", "unit_id"))
