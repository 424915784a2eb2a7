"""Text analysis as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns of the retrieval semantics.
WORD = "[a-zA-Z][a-zA-Z0-9]+"
NUMBER = r"\p{Nd}{2,}"
CJK_BIGRAM = "(?=([一-鿿]{2}))"


def tokenize(text: Column) -> Column:
    """Tokens in order, duplicates kept: lower-cased words, then numbers, then CJK pairs; null gives []."""
    t = F.coalesce(text, F.lit(""))
    return F.concat(
        F.transform(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), F.lower),
        F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)),
        F.regexp_extract_all(t, F.lit(CJK_BIGRAM), F.lit(1)),
    )


def tokenize_unique(text: Column) -> Column:
    """Distinct tokens, first-seen order."""
    return F.array_distinct(tokenize(text))


def joined(breadcrumb: Column) -> Column:
    """Breadcrumb elements with single spaces between; null gives ''."""
    return F.coalesce(F.concat_ws(" ", breadcrumb), F.lit(""))


def round_half_up(x: Column, digits: int) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits on doubles."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def estimate_tokens(text: Column) -> Column:
    """ceil(CJK characters / 1.5 + other characters / 4)."""
    t = F.coalesce(text, F.lit(""))
    cjk = F.regexp_count(t, F.lit("[一-鿿]"))
    return F.ceil(cjk / F.lit(1.5) + (F.char_length(t) - cjk) / F.lit(4.0))


def estimate_tokens_chat(text: Column) -> Column:
    """The chat variant: 0.7 a character, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.char_length(F.coalesce(text, F.lit(""))) * F.lit(0.7)))
