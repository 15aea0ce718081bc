"""Character classes and maps of the normalisation rules."""

from __future__ import annotations

import sys
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as Python's ``str.isspace`` has it: 29 code points, more than ``\s`` in Java.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same characters one by one.
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Punctuation and its ASCII counterpart, one character for one.
PUNCTUATION = {
    "，": ",", "。": ".", "、": ",", "；": ";", "：": ":", "！": "!", "？": "?", "（": "(", "）": ")",
    "【": "[", "】": "]", "《": "<", "》": ">", "〈": "<", "〉": ">", "“": '"', "”": '"', "‘": "'", "’": "'",
    "—": "-", "―": "-", "…": ".", "·": ".", "～": "~", "〜": "~",
}

#: Full-width forms and the ideographic space with their ASCII characters.
FULL_WIDTH = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {"\u3000": " "}


def translated(text: Column, mapping: dict[str, str]) -> Column:
    """Each character replaced by the one it maps to; one character for one."""
    return F.translate(text, "".join(mapping), "".join(mapping.values())) if mapping else text


@cache
def fold_tables() -> tuple[dict[str, str], dict[str, str]]:
    """Full case folding beyond ASCII, as one-to-one and one-to-many maps, from the Unicode data of this Python."""
    one, many = {}, {}
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        f = c.casefold()
        if f != c:
            (one if len(f) == 1 else many)[c] = f
    return one, many


def read_pairs(spark: SparkSession, path: str, expected: int | None = None) -> dict[str, str]:
    """Traditional and simplified characters of a CSV table (trad, simp) with a header; a count that isn't met is an error."""
    rows = spark.read.csv(path, header=True, schema="trad string, simp string").collect()
    pairs = {r["trad"]: r["simp"] for r in rows}
    if expected is not None and len(pairs) != expected:
        raise ValueError(f"{path} has {len(pairs)} pairs, not {expected}")
    return pairs


_ICU: dict[str, str] = {}


def icu_pairs(spark: SparkSession) -> dict[str, str]:
    """Traditional to simplified pairs (3400 to 9FFF, one for one) by the ICU library on Spark's class path."""
    if not _ICU:
        chars = [chr(c) for c in range(0x3400, 0xA000)]
        rule = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
        for c, s in zip(chars, rule.transliterate("\n".join(chars)).split("\n"), strict=True):
            if len(s) == 1 and s != c:
                _ICU[c] = s
    return _ICU


def pairs_table(spark: SparkSession, pairs: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(pairs.items()), "trad string, simp string")
