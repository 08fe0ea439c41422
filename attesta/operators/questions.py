"""Question plans, intents, follow-up context and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import skew
from attesta.functions.text import WORD, casefold, squash_casefold

MAX_QUERIES, MAX_KEYWORDS = 4, 12
# Words never used as keywords of a fallback plan.
KEYWORD_STOP_WORDS = (
    "a an the this that paper document please can could would you me tell what does is are it about of to in and how they their"
).split()
# Question patterns per intent, first match wins; `overview` is also
# chosen by the broad-request detector below.
_DOC = (
    r"(?:(?:the|this|that|my|our)\s+)?(?:(?:selected|uploaded|attached)\s+)?(?:research\s+)?"
    r"(?:paper|document|article|study)"
)
_SUFFIX = r"(?: briefly| in (?:simple|plain) (?:terms|english|language))?"
OVERVIEW_REQUESTS = (
    rf"(?:tell(?: me| us)? about|explain|describe|introduce) {_DOC}{_SUFFIX}",
    rf"(?:tell me )?what(?: is| was|'s) {_DOC} about{_SUFFIX}",
    rf"(?:tell me )?what {_DOC} (?:is |was )?about{_SUFFIX}",
    r"what(?: is|'s) this about",
)
POLITE_PREFIX = r"^(?:(?:please|(?:can|could|would) you)\s+)+"
SUBJECT = r"\b(paper|document|article|this)\b"
PUBLISHING = r"\b(publish\w*|publication|submission|revision|authors?|written by)\b"
REFERENCES = r"\b(references|bibliography|papers? (?:do|did|they).*cit|which.*cit)\b"
OVERVIEW = r"\b(gist|overview|summari[sz]e|summary|main ideas?|plain english|explain.*simply)\b"
PROBLEM = r"\b(trying to solve|research problem|motivation|problem.*address)\b"
CONTRIBUTIONS = r"\b(contributions?|novelty|what.*new)\b"
METHOD = r"\b(how.*work|method|approach|pipeline)\b"
BARE_NUMBER = r"^(?i)[\p{Nd}.,]+\s*(?:[kmb]|thousand|million|billion)?$"
U = "(?U)"


def is_overview_request(question: Column) -> Column:
    """Broad requests about the whole document, without swallowing specific subquestions."""
    q = F.regexp_replace(squash_casefold(question), r"^[ ?.!]+|[ ?.!]+$", "")
    q = F.regexp_replace(q, POLITE_PREFIX, "")
    hit = F.lit(False)
    for pattern in OVERVIEW_REQUESTS:
        hit = hit | q.rlike(f"^(?:{pattern})$")
    return hit


def intent_of(question: Column) -> Column:
    q = casefold(question)
    return (
        F.when(q.rlike(U + SUBJECT) & q.rlike(U + PUBLISHING), "metadata")
        .when(q.rlike(U + REFERENCES), "references")
        .when(is_overview_request(question) | q.rlike(U + OVERVIEW), "overview")
        .when(q.rlike(U + PROBLEM), "problem")
        .when(q.rlike(U + CONTRIBUTIONS), "contributions")
        .when(q.rlike(U + METHOD), "method")
        .otherwise("fact")
    )


def keywords_of(question: Column) -> Column:
    words = F.regexp_extract_all(question, F.lit(rf"([\p{{L}}\p{{N}}_-]+)"), F.lit(1))
    kept = F.filter(words, lambda w: ~F.lower(w).isin(KEYWORD_STOP_WORDS) & (F.length(w) > 1))
    return F.slice(F.array_distinct(kept), 1, MAX_KEYWORDS)


def fallback_plans(questions: DataFrame) -> DataFrame:
    """Rule-based plan: intent, the question itself as query, its keywords."""
    q = F.col("question")
    return questions.select(
        *questions.columns, intent_of(q).alias("intent"), F.array(q).alias("search_queries"), keywords_of(q).alias("keywords")
    )


def clean_plans(plans: DataFrame) -> DataFrame:
    """The user's wording always searches too; bare numbers only when the user wrote them."""
    q = F.col("question")
    spoken = F.lower(q)
    return plans.withColumn(
        "search_queries", F.slice(F.array_distinct(F.concat(F.array(q), "search_queries")), 1, MAX_QUERIES)
    ).withColumn(
        "keywords", F.filter("keywords", lambda k: ~k.rlike(BARE_NUMBER) | F.contains(spoken, F.lower(k)))
    )


def plan_violations(plans: DataFrame) -> DataFrame:
    """Plans outside the contract: list sizes and lengths."""
    rules = F.array_compact(
        F.array(
            F.when((F.size("search_queries") < 1) | (F.size("search_queries") > 3), F.lit("search_query_count")),
            F.when(F.exists("search_queries", lambda s: (F.length(s) == 0) | (F.length(s) > 600)), F.lit("search_query_length")),
            F.when(F.size("keywords") > MAX_KEYWORDS, F.lit("keyword_count")),
            F.when(F.exists("keywords", lambda k: (F.length(k) == 0) | (F.length(k) > 80)), F.lit("keyword_length")),
        )
    )
    return plans.select("question_id", F.explode(rules).alias("rule"))


def plan_novelty(previous: DataFrame, recovered: DataFrame) -> DataFrame:
    """What a recovery plan adds: new queries, new keywords, changed intent."""
    def keys(c: str) -> Column:
        return F.transform(c, lambda x: F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " "))))

    old = previous.select(
        "question_id", F.col("intent").alias("old_intent"), keys("search_queries").alias("old_q"), keys("keywords").alias("old_k")
    )
    fresh_q = F.array_except(keys("search_queries"), "old_q")
    fresh_k = F.array_except(keys("keywords"), "old_k")
    changed = F.col("intent") != F.col("old_intent")
    return recovered.join(old, "question_id").select(
        "question_id",
        fresh_q.alias("new_queries"),
        fresh_k.alias("new_keywords"),
        changed.alias("intent_changed"),
        ((F.size(fresh_q) > 0) | (F.size(fresh_k) > 0) | changed).alias("is_new"),
    )


def question_context(jobs: DataFrame, answer_chars: int = 1800) -> DataFrame:
    """At most two prior completed turns of the same paper, oldest first.

    jobs(question_id, paper_id, context_question_id, status, question, answer)
    """
    done = jobs.where("status = 'completed' AND answer IS NOT NULL").select(
        "question_id", "paper_id", "context_question_id", "question", F.substring("answer", 1, answer_chars).alias("answer")
    )

    def renamed(prefix: str) -> DataFrame:
        return done.select(*[F.col(c).alias(f"{prefix}_{c}") for c in done.columns])

    asked = jobs.select("question_id", "paper_id", "context_question_id")
    first = asked.join(
        renamed("a"), (F.col("context_question_id") == F.col("a_question_id")) & (F.col("paper_id") == F.col("a_paper_id"))
    )
    second = first.join(
        renamed("b"), (F.col("a_context_question_id") == F.col("b_question_id")) & (F.col("paper_id") == F.col("b_paper_id")), "left"
    )
    turns = F.filter(
        F.array(
            F.struct(F.lit(1).alias("place"), F.col("b_question").alias("question"), F.col("b_answer").alias("answer")),
            F.struct(F.lit(2).alias("place"), F.col("a_question").alias("question"), F.col("a_answer").alias("answer")),
        ),
        lambda t: t["answer"].isNotNull(),
    )
    return second.select("question_id", F.inline(turns))


def rejected_context(jobs: DataFrame) -> DataFrame:
    """Follow-ups whose context is not a completed answer of the same paper."""
    usable = jobs.where("status = 'completed' AND answer IS NOT NULL").select(
        F.col("question_id").alias("context_question_id"), "paper_id"
    )
    return (
        jobs.where("context_question_id IS NOT NULL")
        .join(usable, ["context_question_id", "paper_id"], "left_anti")
        .select("question_id")
    )


def history(jobs: DataFrame, limit: int = 10) -> DataFrame:
    """Latest questions per paper."""
    return skew.top_k(jobs, ["paper_id"], [F.desc("created_at"), F.desc("question_id")], limit, "place")
