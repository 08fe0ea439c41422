"""Retrieval and graph evaluation.

hits(case_id, mode, rank, chunk_id, text, refs); evidence(case_id, group_no, ref, phrases)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import normalized, squash_casefold
from attesta.operators.units import locate_quotes


def phrases_found(body: Column, phrases: Column) -> Column:
    """All phrases contained in a text, white space and case aside."""
    return F.forall(phrases, lambda p: F.contains(body, p))


def _folded(evidence: DataFrame) -> DataFrame:
    """Evidence with comparison keys for its phrases, folded once per phrase."""
    flat = evidence.select("case_id", "group_no", "ref", F.explode_outer("phrases").alias("p"))
    return flat.groupBy("case_id", "group_no", "ref").agg(F.collect_set(squash_casefold("p")).alias("phrases"))


def matches(hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """Hits satisfying an evidence group: its item is a source and every phrase occurs."""
    by_ref = hits.select("case_id", "mode", "rank", squash_casefold("text").alias("body"), F.explode("refs").alias("ref"))
    return by_ref.join(_folded(evidence), ["case_id", "ref"]).where(phrases_found(F.col("body"), F.col("phrases"))).select(
        "case_id", "mode", "group_no", "rank"
    )


def group_ranks(cases: DataFrame, hits: DataFrame, evidence: DataFrame) -> DataFrame:
    """First matching rank per group; `all` needs every group, `any` needs one.

    cases(case_id, kind, mode)
    """
    first = matches(hits, evidence).groupBy("case_id", "mode", "group_no").agg(F.min("rank").alias("rank"))
    groups = evidence.select("case_id", "group_no").distinct()
    ranked = cases.join(groups, "case_id").join(first, ["case_id", "mode", "group_no"], "left").groupBy("case_id", "mode").agg(
        F.when(F.count("rank") == F.count("*"), F.max("rank")).alias("all_rank"), F.min("rank").alias("any_rank")
    )
    return cases.join(ranked, ["case_id", "mode"], "left")


def retrieval_metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10), depth: int = 10) -> DataFrame:
    """Hit rates and mean reciprocal rank over the answerable cases; hits beyond rank `depth` count for neither."""
    ranks = ranks.withColumns({c: F.when(F.col(c) <= depth, F.col(c)) for c in ("all_rank", "any_rank")})
    within = lambda c, k: F.avg(F.coalesce((F.col(c) <= k).cast("double"), F.lit(0.0)))
    return ranks.where("kind = 'answerable'").groupBy("mode").agg(
        F.count("*").alias("answerable"),
        *[within("all_rank", k).alias(f"all_hit_{k}") for k in ks],
        *[within("any_rank", k).alias(f"any_hit_{k}") for k in ks],
        F.avg(F.coalesce(1.0 / F.col("any_rank"), F.lit(0.0))).alias(f"mrr_{depth}"),
    )


def mode_comparison(ranks: DataFrame, modes: list[str], runs: DataFrame | None = None) -> DataFrame:
    """Cases whose reference was found, side by side per retrieval mode, and how many runs fell back.

    runs(case_id, planner, reranking): a planner other than `llm` is a fallback, a reranking other than `applied` was
    not available; a case without a run counts for both.
    """
    found = ranks.groupBy("case_id").pivot("mode", modes).agg(F.max(F.col("any_rank").isNotNull()))
    counts = [F.count("*").alias("cases"), *[F.count_if(F.col(m)).alias(m) for m in modes]]
    if runs is not None:
        found = found.join(runs.select("case_id", "planner", "reranking"), "case_id", "left")
        counts += [F.count_if(~F.col("planner").eqNullSafe("llm")).alias("planner_fallbacks"), F.count_if(~F.col("reranking").eqNullSafe("applied")).alias("reranker_unavailable")]
    return found.agg(*counts)


def misplaced_terms(cases: DataFrame, sources: DataFrame) -> DataFrame:
    """Terms assumed absent that do occur in the document.

    cases(case_id, document_id, term); sources(document_id, evidence_id, text)
    """
    quotes = cases.select("document_id", F.struct("case_id", "term").alias("quote_id"), F.col("term").alias("quote"), F.lit(None).cast("string").alias("source_ref"))
    found = locate_quotes(quotes, sources, short=1)
    return found.select("quote_id.case_id", "quote_id.term").distinct()


def unwitnessed_evidence(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence groups no indexed chunk satisfies. chunks(chunk_id, text, refs)"""
    owned = chunks.select("chunk_id", F.explode("refs").alias("ref"), squash_casefold("text").alias("body"))
    witnessed = _folded(evidence).join(owned, "ref").where(phrases_found(F.col("body"), F.col("phrases")))
    return evidence.select("case_id", "group_no").distinct().join(witnessed.select("case_id", "group_no").distinct(), ["case_id", "group_no"], "left_anti")


def prefix_differences(current: DataFrame, earlier: DataFrame, k: int = 10) -> DataFrame:
    """Positions within the first k at which two rankings disagree."""
    a = current.where(F.col("rank") <= k).select("case_id", "rank", F.col("chunk_id").alias("now"))
    b = earlier.where(F.col("rank") <= k).select("case_id", "rank", F.col("chunk_id").alias("before"))
    return a.join(b, ["case_id", "rank"], "full").where("NOT now <=> before")


def graph_checks(checks: DataFrame, nodes: DataFrame, edges: DataFrame, usable_nodes: DataFrame, usable_edges: DataFrame) -> DataFrame:
    """Reference checks against the full and the source-linked graph.

    checks(check_id, kind, type, name, source, relation, target, table, row, metric, value,
    finding_kind, words); nodes(id, label, name, table_label, row_label, column_label,
    reported_value, kind, statement); edges(source, target, label)
    """
    full = satisfied(checks, nodes, edges).withColumn("represented", F.lit(True))
    linked = satisfied(checks, usable_nodes, usable_edges).withColumn("source_linked", F.lit(True))
    return (
        checks.select("check_id", "kind").join(full, "check_id", "left").join(linked, "check_id", "left")
        .select("check_id", "kind", F.coalesce("represented", F.lit(False)).alias("represented"), F.coalesce("source_linked", F.lit(False)).alias("source_linked"))
    )


def satisfied(checks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of the checks a graph satisfies, one equi-join per check kind."""
    named = nodes.select("id", F.col("label").alias("type"), normalized("name").alias("k"))
    by_node = checks.where("kind = 'node'").select("check_id", "type", normalized("name").alias("k")).join(named, ["type", "k"], "left_semi")
    ends = edges.join(named.select(F.col("id").alias("source"), F.col("k").alias("s")), "source").join(
        named.select(F.col("id").alias("target"), F.col("k").alias("t")), "target"
    ).select(F.col("label").alias("relation"), "s", "t").distinct()
    by_edge = checks.where("kind = 'edge'").select("check_id", "relation", normalized("source").alias("s"), normalized("target").alias("t")).join(
        ends, ["relation", "s", "t"], "left_semi"
    )
    cells = nodes.where("label = 'Measurement'").select(
        F.col("table_label").alias("table"), F.col("row_label").alias("row"), normalized("column_label").alias("m"), F.col("reported_value").alias("value")
    )
    by_cell = checks.where("kind = 'measurement'").select("check_id", "table", "row", normalized("metric").alias("m"), "value").join(
        cells, ["table", "row", "m", "value"], "left_semi"
    )
    said = nodes.where("label = 'Finding'").select(F.col("kind").alias("finding_kind"), normalized("statement").alias("body"))
    by_finding = checks.where("kind = 'finding'").join(said, "finding_kind").where(phrases_found(F.col("body"), F.col("words"))).select("check_id").distinct()
    ids = by_finding
    for part in (by_node, by_edge, by_cell):
        ids = ids.unionByName(part.select("check_id"))
    return ids.distinct()


def references_retrieved(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Per question and mode, whether an expected reference was retrieved.

    questions(question_id, expected_refs); retrieved(question_id, mode, ref)
    """
    wanted = questions.select("question_id", F.explode("expected_refs").alias("ref"))
    hit = retrieved.join(wanted, ["question_id", "ref"], "left_semi").select("question_id", "mode").distinct().withColumn("found", F.lit(True))
    every = retrieved.select("question_id", "mode").distinct()
    return every.join(hit, ["question_id", "mode"], "left").select("question_id", "mode", F.coalesce("found", F.lit(False)).alias("expected_source_found"))


def group_coverage(groups: DataFrame, retrieved: DataFrame, scope: DataFrame) -> DataFrame:
    """Every required group hit, by any provenance and by direct sources; out of scope skipped.

    groups(case_id, group_no, ref); retrieved(case_id, ref, direct); scope(ref)
    """
    inside = groups.join(scope.select("ref").distinct().withColumn("__in", F.lit(True)), "ref", "left")
    hits = retrieved.groupBy("case_id", "ref").agg(F.bool_or("direct").alias("direct"), F.lit(True).alias("any"))
    per_group = inside.join(hits, ["case_id", "ref"], "left").groupBy("case_id", "group_no").agg(
        F.bool_or(F.coalesce("__in", F.lit(False))).alias("in_scope"),
        F.bool_or(F.coalesce("any", F.lit(False))).alias("any"),
        F.bool_or(F.coalesce("direct", F.lit(False))).alias("direct"),
    )
    per_case = per_group.groupBy("case_id").agg(F.every("in_scope").alias("in_scope"), F.every("any").alias("a"), F.every("direct").alias("d"))
    return per_case.select(
        "case_id", F.when(F.col("in_scope"), "checked").otherwise("outside_selected_source_scope").alias("status"),
        F.when(F.col("in_scope"), F.col("a")).alias("all_groups_retrieved"), F.when(F.col("in_scope"), F.col("d")).alias("all_groups_in_direct_sources"),
    )


def edge_regression(expected: DataFrame, forbidden: DataFrame, edges: DataFrame) -> DataFrame:
    """Expected edges with one of their references present; forbidden edges absent.

    expected and forbidden: (check_id, relation, source, target, refs);
    edges(label, source_name, target_name, refs)
    """
    key = ["relation", "s", "t"]
    have = edges.select(F.col("label").alias("relation"), normalized("source_name").alias("s"), normalized("target_name").alias("t"), F.explode_outer("refs").alias("ref"))
    want = expected.select("check_id", "relation", normalized("source").alias("s"), normalized("target").alias("t"), F.explode("refs").alias("ref"))
    good = want.join(have, [*key, "ref"], "left_semi").select("check_id").distinct().withColumn("hit", F.lit(True))
    bad = forbidden.select("check_id", "relation", normalized("source").alias("s"), normalized("target").alias("t")).join(have, key, "left_semi").select("check_id").distinct().withColumn("hit", F.lit(True))
    left = expected.select("check_id").join(good, "check_id", "left").select("check_id", F.lit("expected").alias("kind"), F.coalesce("hit", F.lit(False)).alias("passed"))
    right = forbidden.select("check_id").join(bad, "check_id", "left").select("check_id", F.lit("forbidden").alias("kind"), (~F.coalesce("hit", F.lit(False))).alias("passed"))
    return left.unionByName(right)


def chunk_contract(chunks: DataFrame, pages: DataFrame, captions: DataFrame, max_tokens: int = 512) -> DataFrame:
    """Broken chunk rules per document: (document_id, rule, item).

    chunks(document_id, chunk_id, tokens, pages, refs, text); pages(document_id, page_no);
    captions(document_id, ref)
    """
    doc = ["document_id"]
    row = lambda df, rule, col: df.select(*doc, F.lit(rule).alias("rule"), F.col(col).cast("string").alias("item"))
    repeated = chunks.groupBy(*doc, "chunk_id").agg(F.count("*").alias("n")).where("n > 1")
    covered_pages = chunks.select(*doc, F.explode("pages").alias("page_no")).distinct()
    covered_refs = chunks.select(*doc, F.explode("refs").alias("ref")).distinct()
    return (
        row(repeated, "duplicate_chunk_id", "chunk_id")
        .unionByName(row(chunks.where(F.col("tokens") > max_tokens), "too_many_tokens", "chunk_id"))
        .unionByName(row(chunks.where(F.contains("text", F.lit("data:image"))), "image_bytes", "chunk_id"))
        .unionByName(row(pages.join(covered_pages, [*doc, "page_no"], "left_anti"), "page_not_covered", "page_no"))
        .unionByName(row(captions.join(covered_refs, [*doc, "ref"], "left_anti"), "caption_not_covered", "ref"))
    )
