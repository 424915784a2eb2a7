"""Conservative normalization of extracted text, and lookup keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Ligature signs and their letters.
LIGATURES = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")]
DIAERESIS = r"([A-Za-z])\s*¨\s*([A-Za-z])"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


@F.pandas_udf(StringType())
def _lookup(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).strip().casefold().split()))


def repair(text: Column) -> Column:
    """Ligatures spelled out, soft hyphens gone, no-break spaces as spaces, spacing diaereses put on their letters; not yet in NFC."""
    t = F.coalesce(text, F.lit(""))
    for sign, letters in LIGATURES:
        t = F.replace(t, F.lit(sign), F.lit(letters))
    t = F.replace(F.replace(t, F.lit("­"), F.lit("")), F.lit(" "), F.lit(" "))
    return F.regexp_replace(t, DIAERESIS, "$1$2̈")


def _is_ascii(text: Column) -> Column:
    return text.rlike(r"^\p{ASCII}*$")


def normalize_for_search(text: Column) -> Column:
    """The normal form of queries and extracted text; null gives ''. Idempotent. Only what is not ASCII goes through Python (Arrow batches) for NFC."""
    t = repair(text)
    return F.when(_is_ascii(t), t).otherwise(_nfc(F.when(~_is_ascii(t), t)))


def lookup_key(text: Column) -> Column:
    """NFKC, trimmed, case-folded, spaces folded. Only what is not ASCII goes through Python (Arrow batches)."""
    plain = F.lower(F.trim(F.regexp_replace(text, r"[\s\x1c-\x1f]+", " ")))
    return F.when(_is_ascii(text), plain).otherwise(_lookup(F.when(~_is_ascii(text), text)))


def normalization_counts(text: Column) -> dict[str, Column]:
    """How many repairs of each kind a text needs."""
    t = F.coalesce(text, F.lit(""))
    return {
        "ligatures_expanded": F.regexp_count(t, F.lit("[ﬀ-ﬆ]")),
        "soft_hyphens_removed": F.regexp_count(t, F.lit("­")),
        "nonbreaking_spaces_replaced": F.regexp_count(t, F.lit(" ")),
        "spacing_accents_repaired": F.regexp_count(t, F.lit(DIAERESIS)),
    }
