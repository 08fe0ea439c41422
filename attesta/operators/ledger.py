"""Call ledgers, job states, retries, redaction and progress.

calls(call_id, ts, request_hash, logical_hash, status, used_tokens, reserved_tokens, model, seconds)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import skew

SUCCESS = ("completed", "cache_hit")
# Statuses worth retrying, key names never shown, terminal control codes.
RETRYABLE = (408, 429, 500, 502, 503, 504)
HIDDEN_KEYS = ("api_key", "authorization", "password", "pgpassword", "access_token", "secret")
ANSI = r"\x1B\[[0-?]*[ -/]*[@-~]"
REDACTED = "[REDACTED]"
WAIT_BUDGET, MAX_RETRIES, FIRST_DELAY = 60.0, 2, 4.0


def unresolved_failures(calls: DataFrame) -> DataFrame:
    """Failed or started calls never followed by a success for the same request or group."""
    done = calls.where(F.col("status").isin(*SUCCESS))
    by_request = done.select("request_hash").distinct()
    by_group = done.where("logical_hash IS NOT NULL").select("logical_hash").distinct()
    return (
        calls.where(F.col("status").isin("failed", "started"))
        .join(by_request, "request_hash", "left_anti")
        .join(by_group, "logical_hash", "left_anti")
    )


def usage(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Real calls, used or reserved tokens, failures, models and elapsed time."""
    real = F.col("status") != "cache_hit"
    return calls.groupBy(*keys).agg(
        F.count_if(real).alias("real_calls"),
        F.count_if(~real).alias("cache_hits"),
        F.coalesce(F.sum(F.when(real, F.coalesce("used_tokens", "reserved_tokens", F.lit(0)))), F.lit(0)).alias("tokens"),
        F.count_if(F.col("status") == "failed").alias("failures"),
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
        F.sum(F.when(real, F.col("seconds"))).alias("elapsed"),
    )


def request_fingerprint(*fields: str) -> Column:
    """Hash of a request's fields in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def exact_duplicates(calls: DataFrame, order: str = "call_id") -> DataFrame:
    """Flags every repeat of a request after its first occurrence.

    A minimum per request and a join replace a window, so a request repeated billions of
    times is reduced on the map side.
    """
    first = calls.groupBy("request_hash").agg(F.min(order).alias("__first"))
    return calls.join(first, "request_hash").withColumn("cache_hit", F.col(order) > F.col("__first")).drop("__first")


def job_states(events: DataFrame, fields: list[str], key: str = "job_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Latest state of each job: per field the last event that carried it.

    `<field>` holds the value and `has_<field>` its presence: an absent field keeps the
    older value, an explicit null overwrites it.  The same expressions run on a stream.
    """
    return events.groupBy(key).agg(*state_columns(fields, order))


def state_columns(fields: list[str], order: tuple[str, ...] = ("ts", "event_id")) -> list[Column]:
    at = F.struct(*order)
    latest = [F.max_by(F.struct(F.col(f).alias("v")), F.when(F.col(f"has_{f}"), at))["v"].alias(f) for f in fields]
    return [*latest, F.max(order[0]).alias("updated_at"), F.count("*").alias("events")]


def retry_plan(attempts: DataFrame, keys: list[str], order: str = "attempt_no") -> DataFrame:
    """Waits of failed attempts against the shared budget of each question.

    attempts(…keys, attempt_no (per question), request_attempt (0-based), status_code, retry_after).
    A wait is granted while retries remain and the budget still covers it; the first refusal
    of a question ends its waiting.
    """
    retryable = F.col("status_code").isin(*RETRYABLE)
    delay = F.coalesce(F.greatest(F.col("retry_after"), F.lit(0.0)), FIRST_DELAY * F.pow(F.lit(2.0), "request_attempt"))
    wanted = F.when(retryable & (F.col("request_attempt") < MAX_RETRIES), delay)
    summed = skew.running_sum(
        attempts.withColumn("delay", wanted), keys, order, F.coalesce("delay", F.lit(0.0)), "cumulative_wait"
    )
    outcome = (
        F.when(~F.coalesce(retryable, F.lit(False)), "non_retryable")
        .when(F.col("request_attempt") >= MAX_RETRIES, "attempt_limit")
        .when(F.col("cumulative_wait") > WAIT_BUDGET, "wait_budget")
        .otherwise("wait")
    )
    return summed.withColumn("decision", outcome)


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds or an HTTP date; negative waits become zero, unreadable values null."""
    number = header.try_cast("double")
    date = F.try_to_timestamp(F.regexp_replace(header, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.coalesce(number, date.cast("double") - now.cast("double"))
    usable = ~F.isnan(seconds) & (F.abs(seconds) != float("inf"))
    return F.when(usable, F.greatest(F.lit(0.0), seconds))


def redact(text: Column, secrets: list[str]) -> Column:
    """Secrets (longest first) and terminal control sequences removed from a text."""
    for secret in sorted((s for s in secrets if s), key=len, reverse=True):
        text = F.replace(text, F.lit(secret), F.lit(REDACTED))
    return F.regexp_replace(text, ANSI, "")


def redact_fields(fields: Column) -> Column:
    """Values of hidden keys in a string map."""
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).isin(*HIDDEN_KEYS), F.lit(REDACTED)).otherwise(v))


def temporary_error(status: Column, transport_error: Column | None = None) -> Column:
    known = status.isin(*RETRYABLE)
    return F.coalesce(known, transport_error if transport_error is not None else F.lit(False))


def public_error(status: Column, transport_error: Column | None = None) -> Column:
    """Stable public code of a provider error, without payload or credentials."""
    return (
        F.when(status == 429, "rate_limited")
        .when(temporary_error(status, transport_error), "temporarily_unavailable")
        .when(status.isin(401, 403), "access_rejected")
        .when(status == 404, "endpoint_not_found")
        .otherwise("request_failed")
    )


def progress(records: DataFrame, completed: DataFrame, keys: list[str]) -> DataFrame:
    """Records of a selection and how many of them a successful call covered.

    records(…keys, record_id); completed(record_id)
    """
    seen = completed.select("record_id").distinct().withColumn("__done", F.lit(True))
    return records.join(seen, "record_id", "left").groupBy(*keys).agg(
        F.count("*").alias("records"), F.count_if(F.col("__done").isNotNull()).alias("done")
    )


def binding_mismatches(questions: DataFrame, states: DataFrame, hashes: list[str]) -> DataFrame:
    """Questions bound to another document, PDF or index than the stored one."""
    stored = states.select("paper_id", *[F.col(h).alias(f"__{h}") for h in hashes])
    bad = F.array_compact(F.array(*[F.when(~F.col(h).eqNullSafe(F.col(f"__{h}")), F.lit(h)) for h in hashes]))
    return questions.join(stored, "paper_id", "left").select("question_id", F.explode(bad).alias("mismatch"))
