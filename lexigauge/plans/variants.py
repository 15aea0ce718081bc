"""Model outputs made from ground truth by known deviations, to try an evaluation with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import translated


def to_full_width(text: Column) -> Column:
    """ASCII 21 to 7E as full-width forms; spaces stay."""
    return translated(text, {chr(c): chr(c + 0xFEE0) for c in range(0x21, 0x7F)})


def to_traditional(text: Column, pairs: dict[str, str]) -> Column:
    """The inverse of a table of traditional and simplified characters; the last of several wins."""
    return translated(text, {s: t for t, s in pairs.items()})


def flattened(text: Column) -> Column:
    return F.replace(text, F.lit("\n\n"), F.lit("\n"))


def upper_latin(text: Column) -> Column:
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def spaced(text: Column, seed: int, percent: int = 6) -> Column:
    """A space after some ideographs, chosen by a hash of place and text."""
    hit = lambda c, i: c.rlike("[\\u4e00-\\u9fff]") & (F.pmod(F.xxhash64(F.lit(seed), text, i), F.lit(100)) < percent)
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(hit(c, i), F.concat(c, F.lit(" "))).otherwise(c)), "")


def noisy(text: Column, seed: int, permille: int) -> Column:
    """Some ideographs replaced by a box, chosen by a hash of place and text."""
    hit = lambda c, i: c.rlike("[\\u4e00-\\u9fff]") & (F.pmod(F.xxhash64(F.lit(seed), text, i), F.lit(1000)) < permille)
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(hit(c, i), F.lit("□")).otherwise(c)), "")


def generate(samples: DataFrame, pairs: dict[str, str], seed: int = 20260921) -> DataFrame:
    """Rows (model, sample_id, text): five variants of ``samples (sample_id, ref)``."""
    ref = F.col("ref")
    variants = {
        "model_clean": noisy(ref, seed, 5), "model_fullwidth": to_full_width(ref), "model_spacy": spaced(ref, seed), "model_traditional": to_traditional(ref, pairs), "model_flatten": flattened(noisy(ref, seed, 5)),
    }
    rows = F.array(*(F.struct(F.lit(m).alias("model"), t.alias("text")) for m, t in variants.items()))
    return samples.select("sample_id", F.explode(rows).alias("v")).select("v.model", "sample_id", "v.text")
