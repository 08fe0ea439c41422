"""Column-level text helpers.

Everything stays in the JVM for text whose characters are unaffected by Unicode
compatibility normalisation; only the remaining rows cross to Python, in Arrow
batches, because Spark has no built-in NFKC or full case folding.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters for which NFKC is the identity and lower() equals case
# folding (apart from the sharp s, handled explicitly below).
_PLAIN = (
    r"\t\n\x0B\f\r\x20-\x7E"
    r"¡-§©«¬®°±¶·»¿"
    r"À-ÿ‐‒-―‘-•←-↓€"
)
_PLAIN_ONLY = f"^[{_PLAIN}]*$"

# Stop words and stem prefixes of the lexical tokenizer.
LEXICAL_STOP_WORDS = (
    "what which how are does do is the a an of on in to and with for as can it its this that paper"
).split()
STEM_PREFIXES = ("train", "evaluat", "propagat")

WORD = r"[\p{L}\p{N}_]"
TERM_PATTERN = rf"({WORD}+(?:[-.]{WORD}+)*)"
# Lossless pieces: concatenating the matches restores the text.
PIECE_PATTERN = rf"(\s*{WORD}+|\s*[^\p{{L}}\p{{N}}_\s]|\s+)"
NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
SINGLE_NUMBER = rf"^{NUMBER}$"
MULTIPLE_NUMBERS = rf"^{NUMBER}(?:\s+{NUMBER})+$"


@F.pandas_udf(T.StringType())
def _nfkc_casefold(values: pd.Series) -> pd.Series:
    folded = [v if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split()) for v in values.astype(object).where(values.notna(), None)]
    return pd.Series(folded, dtype=object)


@F.pandas_udf(T.StringType())
def _casefold(values: pd.Series) -> pd.Series:
    return pd.Series([v if v is None else v.casefold() for v in values.astype(object).where(values.notna(), None)], dtype=object)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading and trailing Unicode white space."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def has_text(c: Column | str) -> Column:
    """Whether anything but white space occurs; stops at the first such character."""
    return F.coalesce(col(c).rlike(r"(?U)\S"), F.lit(False))


def squash(c: Column | str) -> Column:
    """Collapse white-space runs to one space and strip."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def _fold_plain(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def casefold(c: Column | str) -> Column:
    c = col(c)
    plain = c.rlike(_PLAIN_ONLY)
    return F.coalesce(F.when(plain, _fold_plain(c)), _casefold(F.when(~plain, c)))


def normalized(c: Column | str) -> Column:
    """Identity key of a text: NFKC, case folding, collapsed white space.

    Plain text holds no white space beyond ASCII, so the cheaper class suffices there.
    """
    c = col(c)
    plain = c.rlike(_PLAIN_ONLY)
    folded = F.trim(F.regexp_replace(_fold_plain(c), r"\s+", " "))
    return F.coalesce(F.when(plain, folded), _nfkc_casefold(F.when(~plain, c)))


def squash_casefold(c: Column | str) -> Column:
    """Comparison key without compatibility normalisation."""
    return casefold(squash(c))


def header_key(c: Column | str) -> Column:
    """Comparison key of a table header: direction arrows removed."""
    return squash_casefold(F.translate(col(c), "↑↓", ""))


def metric_name(c: Column | str) -> Column:
    """Metric label without table-group prefix, arrows and footnote daggers."""
    bare = F.regexp_replace(
        col(c), r"(?i)^(?:(?:reconstruction|generation) quality|physical stability)\s*[-:]\s*", ""
    )
    return strip(F.translate(bare, "↑↓†‡", ""))


def identity_name(c: Column | str) -> Column:
    return F.trim(normalized(F.translate(col(c), "†‡", "")))


def terms(c: Column | str) -> Column:
    """Lexical terms in text order: words, minus stop words, lightly stemmed."""
    words = F.regexp_extract_all(normalized(c), F.lit(TERM_PATTERN), F.lit(1))
    kept = F.filter(words, lambda w: ~w.isin(LEXICAL_STOP_WORDS))

    def stem(w: Column) -> Column:
        branches = F.when(F.lit(False), w)
        for prefix in STEM_PREFIXES:
            branches = branches.when(w.startswith(prefix), F.lit(prefix))
        plural = (F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss")
        return branches.when(plural, F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)

    return F.transform(kept, stem)


def pieces(c: Column | str) -> Column:
    """Default tokenizer: lossless word, symbol and space pieces."""
    return F.regexp_extract_all(col(c), F.lit(PIECE_PATTERN), F.lit(1))


def piece_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(PIECE_PATTERN))


def quote_pattern(name: Column) -> Column:
    """Regex-escape a column value for use inside a pattern."""
    return F.regexp_replace(name, r"([\\\.\[\]\{\}\(\)\*\+\-\?\^\$\|/#&~])", r"\\$1")


def contains_word(text: Column, name: Column, extra: str = "") -> Column:
    """Whole-word containment; `extra` adds characters that also glue words. A pattern is made only where the name occurs at all."""
    guard = rf"[\p{{L}}\p{{N}}_{extra}]"
    pattern = F.concat(F.lit(f"(?<!{guard})"), quote_pattern(name), F.lit(f"(?!{guard})"))
    return F.contains(text, name) & F.regexp_like(text, pattern)


def sorted_distinct(c: Column) -> Column:
    return F.sort_array(F.array_distinct(c))


def codes(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the codes whose condition holds, in the given order."""
    return F.array_compact(
        F.array(*[F.when(cond, code if isinstance(code, Column) else F.lit(code)) for cond, code in pairs])
    )


def runs(items: Column, key: str, value: str) -> Column:
    """The different `key`s of a sorted array of structs, with their values in array order; equal keys stand side by side, so each is a slice."""
    # Bound first, so that the sorting is not repeated for every element wherever the optimizer moves this.
    let = lambda value, use: F.transform(F.array(value), use)[0]
    none = F.array().cast("array<int>")

    def starts(v: Column) -> Column:
        every = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1)).otherwise(none)
        return F.filter(every, lambda i: (i == 0) | (F.get(v, i)[key] != F.get(v, i - 1)[key]))

    def slices(v: Column, first: Column) -> Column:
        n = F.size(first)
        ends = F.when(n > 0, F.concat(F.slice(first, 2, F.greatest(n - 1, F.lit(0))), F.array(F.size(v)))).otherwise(none)
        return F.zip_with(first, ends, lambda a, b: F.struct(F.get(v, a)[key].alias(key), F.transform(F.sequence(a, b - 1), lambda i: F.get(v, i)[value]).alias(value)))

    return let(items, lambda v: let(starts(v), lambda first: slices(v, first)))


def grouped_runs(df: DataFrame, items: str, key: str, value: str, keep: list[str]) -> DataFrame:
    """One row for each different `key` in an array of structs, with its values in array order, without a shuffle."""
    return df.select(*keep, F.inline(runs(F.col(items), key, value)))
