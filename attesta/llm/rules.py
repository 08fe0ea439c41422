"""Quality rules with thresholds from quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.lineage import cut
from attesta.llm.common import broadcast_if_small, words

#: Measures of a text and the least spread taken for each, so that a group of equal values doesn't reject its neighbours.
MEASURES = {"mean_word": 1.0, "symbol_share": 0.05, "dup_line_share": 0.4, "repeat_share": 0.4}
#: A fence lies this many spreads beyond the outer quartile.
REACH = 4.0
#: Groups of fewer rows take the thresholds of their language, and small languages those of all rows.
LEAST_ROWS = 100
ACCURACY = 10_000


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One narrow row per row: doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Words are runs without ASCII white space; n_lines are lines with a word, n_dup_lines those equal to an earlier one;
    n_repeat_words are the words in windows of three words that occur twice or more in the text. All of it is worked
    out inside the row (windows are sorted by a 64-bit hash, equal neighbours repeat), without any shuffle. A null
    text counts as an empty one.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    split = rows.select("*", words(F.col("text")).alias("w"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    window = lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("p"))
    sorted_windows = F.sort_array(F.transform(F.when(F.size("w") > 2, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>")), window))
    found = split.select(
        "doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), sorted_windows.alias("s"),
    )
    same = lambda x, i: (F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"])
    places = F.sort_array(F.transform(F.filter("s", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["p"]))
    covered = F.aggregate(
        places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
    )["n"]
    return found.select("*", covered.cast("long").alias("n_repeat_words")).drop("s")


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def measures(counted: DataFrame) -> DataFrame:
    """The shares of MEASURES and base_failed: under 50 words, or more than half of them repeated."""
    return counted.select(
        "*", _share("word_chars", "n_words").alias("mean_word"), _share("n_symbols", "n_words").alias("symbol_share"),
        _share("n_dup_lines", "n_lines").alias("dup_line_share"), _share("n_repeat_words", "n_words").alias("repeat_share"),
        F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words").alias("base_failed"),
    )


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang, source, n, low and high of each measure) per group, with `depth` 2, per language (1) and for all (0).

    Quartiles come from mergeable quantile sketches of the rows that pass the base rules: each task summarises its rows,
    and summaries are merged per group, per language and over everything, so a hot source is no large group anywhere.
    """
    rolled = measured.where("not base_failed").rollup("lang", "source").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"),
        *[F.percentile_approx(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(ACCURACY)).alias(m) for m in MEASURES],
    )
    fences = []
    for m, least in MEASURES.items():
        low, mid, high = (F.get(m, F.lit(i)) for i in range(3))
        fences += [(low - REACH * F.greatest(mid - low, F.lit(least / REACH))).alias(f"{m}_low"), (high + REACH * F.greatest(high - mid, F.lit(least / REACH))).alias(f"{m}_high")]
    return rolled.select("lang", "source", "n", F.expr("case g when 0 then 2 when 1 then 1 else 0 end").alias("depth"), *fences)


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts, measures, base_failed and kept of every row of `docs`.

    kept is false if the base rules fail or a measure lies beyond the fences of the row's group: its language and
    source if LEAST_ROWS of their rows pass the base rules, else its language, else all rows. Null languages and null
    sources are groups like others. Null and empty texts fail the base rules; repeated rows are judged alike; if no
    row passes the base rules none is kept; an empty table gives an empty one.
    """
    own = cut(measures(counts(docs, key, text, lang, source)))
    limits = cut(thresholds(own).where((F.col("n") >= LEAST_ROWS) | (F.col("depth") == 0)))
    names = [f"{m}_{end}" for m in MEASURES for end in ("low", "high")]
    level = lambda d: limits.where(F.col("depth") == d).select(
        F.col("lang").alias("l"), F.col("source").alias("s"), F.struct(*names).alias(f"limits{d}")
    )
    both = broadcast_if_small(level(2))
    wide = own.join(both, own["lang"].eqNullSafe(both["l"]) & own["source"].eqNullSafe(both["s"]), "left").drop("l", "s")
    one = broadcast_if_small(level(1))
    wide = wide.join(one, wide["lang"].eqNullSafe(one["l"]), "left").drop("l", "s")
    overall = limits.where("depth = 0").select(*names).first()  # one row, or none
    rest = F.struct(*[F.lit(overall[n] if overall else None).cast("double").alias(n) for n in names])
    chosen = wide.select(*own.columns, F.coalesce("limits2", "limits1", rest).alias("limit"))
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & (F.col(m) >= F.col(f"limit.{m}_low")) & (F.col(m) <= F.col(f"limit.{m}_high"))
    return chosen.select(*own.columns, F.coalesce(~F.col("base_failed") & inside, F.lit(False)).alias("kept"))


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of `docs`, columns unchanged, whose key is kept."""
    good = judged(docs, key, text, lang, source).where("kept").select(F.col("doc_id").alias("__good")).distinct()
    return docs.join(good, docs[key].eqNullSafe(good["__good"]), "left_semi")
