"""Features of a text that the normalisation levels act on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import PUNCTUATION

ASCII_PUNCTUATION = ",.;:!?()[]{}<>\"'"
_CJK = r"[㐀-䶿一-鿿]"
FEATURES = ("trad_only", "fullwidth_digit", "fullwidth_alpha", "cjk_latin_mix", "fullwidth_punct", "ascii_punct", "punct_mixed", "cjk_space", "multi_space", "indent", "emoji")


def _distinct(text: Column, chars: str) -> Column:
    """Count of different characters of a set in a text; the text's own set is a common subexpression of all counts."""
    letters = F.array_distinct(F.split(text, ""))
    return F.size(F.array_intersect(letters, F.array(*map(F.lit, chars))))


def audit(text: Column, traditional: str) -> list[Column]:
    """The 13 features; ``traditional`` has the characters that only traditional script uses."""
    text = F.coalesce(text, F.lit(""))
    flag = lambda c: c.cast("int")
    full, narrow = _distinct(text, "".join(PUNCTUATION)), _distinct(text, ASCII_PUNCTUATION)
    spans = lambda a, b: "".join(chr(c) for c in range(ord(a), ord(b) + 1))
    return [
        F.char_length(text).alias("n_chars"),
        F.size(F.split(text, "\n", -1)).alias("n_lines"),
        (_distinct(text, traditional) if traditional else F.lit(0)).alias("trad_only"),
        _distinct(text, spans("０", "９")).alias("fullwidth_digit"),
        _distinct(text, spans("Ａ", "Ｚ") + spans("ａ", "ｚ")).alias("fullwidth_alpha"),
        flag(text.rlike(_CJK) & text.rlike("[A-Za-z]")).alias("cjk_latin_mix"),
        full.alias("fullwidth_punct"),
        narrow.alias("ascii_punct"),
        flag((full > 0) & (narrow > 0)).alias("punct_mixed"),
        flag(text.rlike(rf"{_CJK}[ \t]{_CJK}")).alias("cjk_space"),
        flag(text.rlike("  |\t")).alias("multi_space"),
        flag(text.rlike(r"(?dm)^[ \t][^\n]*[^\s\n]")).alias("indent"),
        flag(text.rlike(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]")).alias("emoji"),
    ]


def summary(audited: DataFrame) -> DataFrame:
    """Rows (feature, hits, state): texts with a feature, and whether that is blank, sparse (under 3) or ok."""
    hits = audited.agg(*(F.count_if(F.col(f) > 0).alias(f) for f in FEATURES))
    rows = hits.unpivot([], list(FEATURES), "feature", "hits")
    return rows.withColumn("state", F.when(F.col("hits") == 0, "blank").when(F.col("hits") < 3, "sparse").otherwise("ok"))
