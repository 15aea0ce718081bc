"""The cumulative normalisation levels P0 to P5 as columns, and their rule registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chars import FULL_WIDTH, PUNCTUATION, WS, WS_CHARS, fold_tables, translated

LEVELS = ("P0", "P1", "P2", "P3", "P4", "P5")
#: The rules that each level adds, and what each rule changes.
LEVEL_RULES = {
    "P0": ("strip",), "P1": ("collapse_ws",), "P2": ("casefold",), "P3": ("fullwidth_to_halfwidth",), "P4": ("punct_unify",), "P5": ("trad_to_simp", "drop_cjk_space"),
}
RULE_KINDS = {
    "strip": "boundary", "collapse_ws": "length", "casefold": "mapping", "fullwidth_to_halfwidth": "mapping", "punct_unify": "mapping", "trad_to_simp": "mapping", "drop_cjk_space": "length",
}
CJK = r"[㐀-䶿一-鿿豈-﫿]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def collapse_ws(text: Column) -> Column:
    return F.regexp_replace(strip(text), f"{WS}+", " ")


def _then(*maps: dict[str, str]) -> dict[str, str]:
    """One map that does what several do in turn."""
    out: dict[str, str] = {}
    for m in maps:
        out = {c: m.get(x, x) for c, x in out.items()} | {c: x for c, x in m.items() if c not in out}
    return out


def casefold(text: Column, *after: dict[str, str]) -> Column:
    """Full case folding, then maps of characters beyond ASCII, all in one pass.

    What folds to several characters is replaced only in texts that have it; no other character folds to one of those.
    """
    one, many = fold_tables()
    folded = translated(text, one)
    for c, f in many.items():
        folded = F.replace(folded, F.lit(c), F.lit(f))
    ascii_only = ~text.rlike(r"[^\x00-\x7f]")
    # a pattern with a class of so many characters takes 2 microseconds a character
    several = F.translate(text, "".join(many), "") != text
    return F.when(ascii_only, F.lower(text)).when(several, translated(folded, _then(*after))).otherwise(translated(text, _then(one, *after)))


def half_width(text: Column) -> Column:
    return translated(text, FULL_WIDTH)


def unify_punctuation(text: Column) -> Column:
    return translated(text, PUNCTUATION)


def simplify(text: Column, pairs: dict[str, str]) -> Column:
    """One pass; a character whose simplified form is itself a key isn't mapped again."""
    return translated(text, pairs)


def drop_cjk_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<={CJK})[ \t]+(?={CJK})", "")


def normalize(text: Column, level: str, pairs: dict[str, str] | None = None) -> Column:
    """Text at a level; null is empty. ``pairs`` maps traditional to simplified characters and is needed at P5."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    at = LEVELS.index(level)
    if at == 5 and pairs is None:
        raise ValueError("P5 needs a table of traditional and simplified characters")
    out = strip(F.coalesce(text.cast("string"), F.lit("")))
    if at >= 1:
        out = collapse_ws(out)
    if at >= 2:
        # an array of one binds the text to a name, so that what it is made of is done once
        out = F.get(F.transform(F.array(out), lambda x: casefold(x, *(FULL_WIDTH, PUNCTUATION, pairs or {})[: at - 2])), 0)
    return drop_cjk_space(out) if at == 5 else out


def rules_table(spark: SparkSession) -> DataFrame:
    """Rows (level, ord, rule, kind), in the order of application."""
    rows = [(level, rule, RULE_KINDS[rule]) for level in LEVELS for rule in LEVEL_RULES[level]]
    return spark.createDataFrame([(a, i, b, c) for i, (a, b, c) in enumerate(rows)], "level string, ord int, rule string, kind string")


def enabled_rules(spark: SparkSession) -> DataFrame:
    """Rows (level, rules): all rules at work at a level, in order."""
    rules = rules_table(spark)
    running = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return rules.withColumn("rules", F.collect_list("rule").over(running)).groupBy("level").agg(F.max_by("rules", "ord").alias("rules"))


def length_rules(spark: SparkSession) -> DataFrame:
    """Rows (level, rules): the rules at work that change a text's length within."""
    running = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rules = rules_table(spark).withColumn("rules", F.collect_list(F.when(F.col("kind") == "length", F.col("rule"))).over(running))
    return rules.groupBy("level").agg(F.max_by("rules", "ord").alias("rules"))


def punctuation_keeps_length() -> bool:
    return all(len(a) == len(b) for a, b in PUNCTUATION.items())
