"""Evidence sanitizing, answer validation and citation checks.

Message texts are left to the caller; every rule is reported as a stable code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.text import casefold, squash, strip

# Limits of the answer contract.
STATUSES = ("answered", "partial", "insufficient_evidence")
MAX_CLAIMS, MAX_QUOTES, CLAIM_CHARS, QUOTE_CHARS, MISSING_CHARS = 8, 4, 1800, (16, 1200), 2000
PROMPT_CHARS, LEXICAL_PROMPT_CHARS = 65_000, 28_000
ABSTENTION = "INSUFFICIENT_EVIDENCE"
ANSWER = (
    "struct<status:string,claims:array<struct<text:string,evidence:array<struct<source_id:string,quote:string>>>>,"
    "missing_information:string>"
)
CHANGE = "array<struct<action:string,ref:string,original:string,enriched:string>>"


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def sanitize_chunks(chunks: DataFrame, pictures: DataFrame, formulas: DataFrame) -> DataFrame:
    """Author text of each chunk: generated descriptions removed, original formulas restored.

    chunks(document_id, chunk_id, contextualized_text, text_sources, picture_links, source_refs);
    pictures(document_id, picture_ref, description); formulas(document_id, ref, orig, text).
    A chunk whose generated span cannot be isolated is excluded whole, with the reason.
    Works per chunk, so a passage retrieved by many questions is cleaned once.
    """
    key = ["document_id", "chunk_id"]
    links = chunks.select(*key, F.posexplode("picture_links").alias("pos", "k")).where("k.ai_description_included")
    spans = (
        links.select("document_id", "chunk_id", "pos", F.col("k.picture_ref").alias("picture_ref"))
        .join(pictures, ["document_id", "picture_ref"], "left")
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.col("picture_ref").alias("ref"), F.coalesce("description", F.lit("")).alias("description")))).alias("spans"))
    )
    altered = formulas.where("NOT orig <=> text").select(
        "document_id", "ref", strip(F.coalesce("orig", F.lit(""))).alias("original"), strip(F.coalesce("text", F.lit(""))).alias("enriched")
    )
    swaps = (
        chunks.select(*key, F.posexplode("source_refs").alias("pos", "ref"))
        .join(altered, ["document_id", "ref"])
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct("pos", "ref", "original", "enriched"))).alias("swaps"))
    )

    def state(text: Column, why: Column, log: Column) -> Column:
        return F.struct(text.alias("text"), why.cast("string").alias("why"), log.cast(CHANGE).alias("log"))

    def logged(acc: Column, action: str, ref: Column, original: Column, enriched: Column) -> Column:
        entry = F.struct(F.lit(action).alias("action"), ref.alias("ref"), original.alias("original"), enriched.alias("enriched"))
        return F.concat(acc["log"], F.array(entry).cast(CHANGE))

    def drop_span(acc: Column, s: Column) -> Column:
        present = (s["description"] != "") & F.contains(acc["text"], s["description"])
        return (
            F.when(acc["why"].isNotNull(), acc)
            .when(~present, state(acc["text"], F.lit("description_span_unavailable"), acc["log"]))
            .otherwise(
                state(
                    F.replace(acc["text"], s["description"], F.lit("")),
                    _null("string"),
                    logged(acc, "removed_unverified_ai_description", s["ref"], _null("string"), _null("string")),
                )
            )
        )

    def swap(acc: Column, s: Column) -> Column:
        swappable = (s["original"] != "") & (s["enriched"] != "") & F.contains(acc["text"], s["enriched"])
        lost = (s["original"] == "") | ~F.contains(acc["text"], s["original"])
        return (
            F.when(acc["why"].isNotNull(), acc)
            .when(
                swappable,
                state(
                    F.replace(acc["text"], s["enriched"], s["original"]),
                    _null("string"),
                    logged(acc, "used_original_formula_text", s["ref"], s["original"], s["enriched"]),
                ),
            )
            .when(lost, state(acc["text"], F.lit("formula_span_unavailable"), acc["log"]))
            .otherwise(acc)
        )

    marked = F.array_contains("text_sources", "ai_description")
    no_log = F.array().cast(CHANGE)
    joined = chunks.join(spans, key, "left").join(swaps, key, "left")
    start = state(F.col("contextualized_text"), F.when(marked & F.col("spans").isNull(), "ai_content_not_isolable"), no_log)
    first = F.when(marked & F.col("spans").isNotNull(), F.aggregate("spans", start, drop_span)).otherwise(start)
    step1 = joined.withColumn("__a", first)
    again = state(F.col("__a.text"), _null("string"), F.col("__a.log"))
    step2 = step1.withColumn("__b", F.when(F.col("swaps").isNotNull(), F.aggregate("swaps", again, swap)).otherwise(again))
    text = strip(F.col("__b.text"))
    reason = F.coalesce("__b.why", "__a.why", F.when(F.length(text) == 0, "no_text_remains"))
    removed = F.transform(
        F.filter("__b.log", lambda c: c["action"] == "removed_unverified_ai_description"), lambda c: c["ref"]
    )
    return step2.select(
        *key, text.alias("clean_text"), reason.alias("excluded"), F.col("__b.log").alias("transformations"),
        F.array_except("source_refs", removed).alias("clean_refs"),
    )


def prepare_sources(hits: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Hits with clean text, renumbered S1.. per question in rank order."""
    kept = hits.join(cleaned.where("excluded IS NULL"), ["document_id", "chunk_id"])
    # Hits per question are capped by candidate assembly.
    w = Window.partitionBy("question_id").orderBy("rank", "chunk_id")
    return kept.withColumn("source_id", F.concat(F.lit("S"), F.row_number().over(w).cast("string")))


def excluded_hits(hits: DataFrame, cleaned: DataFrame) -> DataFrame:
    return hits.join(cleaned.where("excluded IS NOT NULL"), ["document_id", "chunk_id"]).select(
        "question_id", "chunk_id", F.col("rank").alias("retrieval_rank"), F.col("excluded").alias("reason")
    )


def prompt_payloads(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """Serialized question and sources; oversized payloads are flagged, never truncated."""
    packed = sources.groupBy("question_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "source_id", "pages", "text"))).alias("s")
    )
    context = F.transform("s", lambda x: F.struct(x["source_id"].alias("source_id"), x["pages"].alias("pages"), x["text"].alias("text")))
    payload = F.to_json(F.struct("question", context.alias("sources")))
    return questions.join(packed, "question_id").select("question_id", payload.alias("payload")).withColumn(
        "within_budget", F.length("payload") <= PROMPT_CHARS
    )


def lexical_prompts(sources: DataFrame) -> DataFrame:
    """Evidence block of the lexical path, cut at its documented length."""
    line = F.concat(F.lit("["), "source_id", F.lit("] PDF pages "), F.to_json("pages"), F.lit(" | "), F.array_join("headings", " > "), F.lit("\n"), "text")
    packed = sources.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("s"))
    return packed.select("question_id", F.substring(F.array_join("s.line", "\n\n"), 1, LEXICAL_PROMPT_CHARS).alias("evidence"))


def unfenced(content: Column) -> Column:
    """Answer text without one surrounding code fence."""
    body = strip(content)
    fenced = body.startswith("```") & body.endswith("```")
    inner = strip(F.regexp_replace(F.regexp_replace(body, r"^```(?:json)?\s*", ""), r"```$", ""))
    return F.when(fenced, inner).otherwise(body)


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns evaluated once per row: a generator keeps the optimizer from inlining
    the expressions into each of their many uses."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse_answers(answers: DataFrame) -> DataFrame:
    """answers(answer_id, content) with the parsed value and its root keys; null `answer`
    means invalid JSON."""
    read = _computed(answers, body=unfenced(F.col("content")))
    body = F.col("body")
    # The JSON reader stops after the first value; wrapping exposes trailing text.
    wrapped = [F.concat(F.lit("["), body, F.lit("]")), F.concat(F.lit('{"v":'), body, F.lit("}"))]
    whole = F.try_parse_json(wrapped[0]).isNotNull() & F.try_parse_json(wrapped[1]).isNotNull()
    none = F.array().cast("array<string>")
    return _computed(
        read,
        answer=F.when(whole, F.from_json(body, ANSWER)),
        root_keys=F.coalesce(F.json_object_keys(body), none),
    )


def _trimmed_length(c: Column) -> Column:
    return F.length(strip(c))


def quotes_of(parsed: DataFrame) -> DataFrame:
    claims = parsed.select("answer_id", F.posexplode("answer.claims").alias("claim_index", "claim"))
    return claims.select("answer_id", "claim_index", F.posexplode("claim.evidence").alias("quote_index", "e")).select(
        "answer_id", "claim_index", "quote_index", strip(F.col("e.source_id")).alias("source_id"), strip(F.col("e.quote")).alias("quote")
    )


def _valid_quote() -> Column:
    return F.coalesce(
        F.col("source_id").rlike(r"^S[1-9][0-9]*$") & F.length("quote").between(*QUOTE_CHARS), F.lit(False)
    )


def schema_issues(parsed: DataFrame) -> DataFrame:
    """Structural faults: (answer_id, path, rule)."""
    root = parsed.where("answer IS NOT NULL")
    a = F.col("answer")
    keys = F.col("root_keys")
    absent = lambda name: ~F.array_contains(keys, name)
    fields = ("status", "claims", "missing_information")
    rules = F.array_compact(
        F.array(
            *[F.when(absent(n), F.struct(F.lit(n).alias("path"), F.lit("missing_field").alias("rule"))) for n in fields],
            F.when(~absent("status") & ~F.coalesce(strip(a["status"]).isin(*STATUSES), F.lit(False)), F.struct(F.lit("status").alias("path"), F.lit("unknown_value").alias("rule"))),
            F.when(~absent("claims") & (a["claims"].isNull() | (F.size(a["claims"]) > MAX_CLAIMS)), F.struct(F.lit("claims").alias("path"), F.lit("claim_count").alias("rule"))),
            F.when(~absent("missing_information") & (a["missing_information"].isNull() | (_trimmed_length(a["missing_information"]) > MISSING_CHARS)), F.struct(F.lit("missing_information").alias("path"), F.lit("text_length").alias("rule"))),
        )
    )
    broken = parsed.where("answer IS NULL").select("answer_id", F.lit("response").alias("path"), F.lit("invalid_json").alias("rule"))
    top = root.select("answer_id", F.inline(rules))
    extra = root.select("answer_id", F.explode(F.array_except(keys, F.array(*[F.lit(f) for f in fields]))).alias("path")).withColumn("rule", F.lit("unknown_field"))
    claims = root.select("answer_id", F.posexplode("answer.claims").alias("i", "c"))
    at = F.concat(F.lit("claims."), F.col("i").cast("string"))
    claim_rules = F.array_compact(
        F.array(
            F.when(~F.coalesce(_trimmed_length(F.col("c.text")).between(1, CLAIM_CHARS), F.lit(False)), F.struct(F.concat(at, F.lit(".text")).alias("path"), F.lit("text_length").alias("rule"))),
            F.when(~F.coalesce(F.size("c.evidence").between(1, MAX_QUOTES), F.lit(False)), F.struct(F.concat(at, F.lit(".evidence")).alias("path"), F.lit("quote_count").alias("rule"))),
        )
    )
    per_claim = claims.select("answer_id", F.inline(claim_rules))
    per_quote = quotes_of(root).where(~_valid_quote()).select(
        "answer_id",
        F.concat_ws(".", F.lit("claims"), F.col("claim_index").cast("string"), F.lit("evidence"), F.col("quote_index").cast("string")).alias("path"),
        F.lit("invalid_quote_object").alias("rule"),
    )
    maps = F.from_json("body", "struct<claims:array<map<string,string>>>")["claims"]
    claim_extra = root.select("answer_id", F.posexplode(maps).alias("i", "m")).select(
        "answer_id", F.concat(F.lit("claims."), F.col("i").cast("string")).alias("path"),
        F.explode(F.array_except(F.map_keys("m"), F.array(F.lit("text"), F.lit("evidence")))).alias("x"),
    ).select("answer_id", F.concat_ws(".", "path", "x").alias("path"), F.lit("unknown_field").alias("rule"))
    out = broken
    for part in (top, extra, per_claim, per_quote, claim_extra):
        out = out.unionByName(part.select("answer_id", "path", "rule"))
    return out


def state_issues(parsed: DataFrame, schema: DataFrame) -> DataFrame:
    """Status must agree with claims and missing information; only for schema-valid answers."""
    a = F.col("answer")
    claims = F.size(a["claims"]) > 0
    missing = _trimmed_length(a["missing_information"]) > 0
    status = strip(a["status"])
    wrong = F.when(status == "insufficient_evidence", claims | ~missing).otherwise(
        ~claims | ((status == "partial") != missing)
    )
    return (
        parsed.where("answer IS NOT NULL")
        .join(schema.select("answer_id").distinct(), "answer_id", "left_anti")
        .where(wrong)
        .select("answer_id", F.lit("answer_state").alias("kind"), F.lit("status").alias("path"), _null("int").alias("claim_index"), F.lit("").alias("hint"))
    )


def quote_issues(parsed: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations of unknown sources and quotes absent from the cited text.

    sources(answer_id, source_id, text)
    """
    q = quotes_of(parsed).where(_valid_quote())
    body = sources.select("answer_id", "source_id", F.col("text").alias("body"))
    kind = F.when(F.col("body").isNull(), "unknown_source").when(~F.contains(squash("body"), squash("quote")), "quote_mismatch")
    ellipsis = F.contains("quote", F.lit("...")) | F.contains("quote", F.lit("…"))
    return (
        q.join(body, ["answer_id", "source_id"], "left")
        .withColumn("kind", kind)
        .where("kind IS NOT NULL")
        .select(
            "answer_id",
            "kind",
            F.concat_ws(".", F.lit("claims"), F.col("claim_index").cast("string"), F.lit("evidence"), F.col("quote_index").cast("string")).alias("path"),
            "claim_index",
            F.when(F.col("kind") == "unknown_source", "use_supplied_source_ids").when(ellipsis, "split_ellipsis").otherwise("copy_verbatim").alias("hint"),
        )
    )


def answer_issues(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """All issues of saved answers: (answer_id, kind, path, claim_index, hint)."""
    parsed = parse_answers(answers)
    schema = schema_issues(parsed)
    structural = schema.select("answer_id", F.lit("schema").alias("kind"), "path", _null("int").alias("claim_index"), F.col("rule").alias("hint"))
    return structural.unionByName(state_issues(parsed, schema)).unionByName(quote_issues(parsed, sources))


def retain_cited_claims(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Answers whose only faults are citations: whole invalid claims withheld, the rest partial."""
    parsed = parse_answers(answers)
    issues = answer_issues(answers, sources)
    per = issues.groupBy("answer_id").agg(
        F.every(F.col("kind").isin("quote_mismatch", "unknown_source")).alias("recoverable"),
        F.sort_array(F.collect_set("claim_index")).alias("withheld"),
    )
    kept = F.filter(F.transform("answer.claims", lambda c, i: F.struct(i.alias("i"), c["text"].alias("text"))), lambda c: ~F.array_contains("withheld", c["i"]))
    return (
        parsed.join(per.where("recoverable"), "answer_id")
        .withColumn("kept", kept)
        .where(F.size("kept") > 0)
        .select(
            "answer_id",
            F.lit("partial").alias("status"),
            F.col("kept.text").alias("claims"),
            "withheld",
            F.size("answer.claims").alias("original_claims"),
            F.size("kept").alias("retained_claims"),
        )
    )


def restore_status(answers: DataFrame) -> DataFrame:
    """Absent status rebuilt from claims and missing information; nothing else is touched."""
    parsed = parse_answers(answers)
    keys = F.col("root_keys")
    claims = F.size("answer.claims")
    missing = _trimmed_length(F.col("answer.missing_information")) > 0
    status = F.when((claims > 0) & missing, "partial").when(claims > 0, "answered").when(missing, "insufficient_evidence")
    candidates = (
        parsed.where(F.col("answer").isNotNull() & ~F.array_contains(keys, "status") & F.col("answer.claims").isNotNull() & F.col("answer.missing_information").isNotNull())
        .withColumn("status", status)
        .where("status IS NOT NULL")
    )
    other_faults = schema_issues(candidates).where("path <> 'status'").select("answer_id").distinct()
    return candidates.join(other_faults, "answer_id", "left_anti").select("answer_id", "status")


def bracket_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """`[S1]` citations of a plain-text answer against its sources, or the abstention token."""
    valid = sources.groupBy("answer_id").agg(F.collect_set("source_id").alias("valid"))
    used = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(S\d+)\]"), F.lit(1)))
    unknown = F.array_except("used", F.coalesce("valid", F.array().cast("array<string>")))
    body = strip("answer")
    status = (
        F.when(body == ABSTENTION, "insufficient_evidence")
        .when(F.length(body) == 0, "no_answer_text")
        .when((F.size("used") == 0) | (F.size("unknown") > 0), "citation_check_failed")
        .otherwise("model_answer_with_resolvable_citations_not_independent_verification")
    )
    return (
        answers.join(valid, "answer_id", "left").withColumn("used", used).withColumn("unknown", unknown)
        .select("answer_id", status.alias("answer_status"), F.sort_array("used").alias("used"), F.sort_array("unknown").alias("unknown"))
    )


def record_citations(answers: DataFrame, context: DataFrame) -> DataFrame:
    """`[Data: Entities (1, 2); …]` citations resolved against the selected context rows.

    context(answer_id, category, citation_id, resolved, refs, pages)
    """
    groups = answers.select("answer_id", F.posexplode(F.regexp_extract_all("answer", F.lit(r"(?i)\[Data:\s*([^\]]+)\]"), F.lit(1))).alias("g", "body"))
    named = groups.select("answer_id", "g", F.posexplode(F.regexp_extract_all("body", F.lit(r"([A-Za-z ]+\s*\([^)]*\))"), F.lit(1))).alias("n", "part"))
    cited = named.select(
        "answer_id", "g", "n",
        casefold(strip(F.regexp_extract("part", r"^([A-Za-z ]+)\s*\(", 1))).alias("category"),
        F.posexplode(F.regexp_extract_all(F.regexp_extract("part", r"\(([^)]*)\)", 1), F.lit(r"\b(\d+)\b"), F.lit(1))).alias("i", "citation_id"),
    )
    return cited.join(context, ["answer_id", "category", "citation_id"], "left").select(
        "answer_id", "g", "n", "i", "category", "citation_id", F.coalesce("resolved", F.lit(False)).alias("resolved"), "refs", "pages"
    )


def citations_resolved(answers: DataFrame, citations: DataFrame) -> DataFrame:
    checked = citations.groupBy("answer_id").agg(F.every("resolved").alias("ok"))
    return answers.select("answer_id").join(checked, "answer_id", "left").select(
        "answer_id", F.coalesce("ok", F.lit(False)).alias("all_cited_records_resolved")
    )
