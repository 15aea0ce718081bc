"""Rankings per group and how stable they are over all groups. All inputs are group scores: models x segmentations x levels rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLACK = 1e-12
MARGIN_THRESHOLD = 1.0
REF_SEG, REF_LEVEL = "para_merge", "P0"


def rank_matrix(scores: DataFrame) -> DataFrame:
    """Rows (seg_mode, level, model, rank, cer_fixed, cer): ranks from 1, ties in the order of names."""
    order = Window.partitionBy("seg_mode", "level").orderBy("cer_fixed", "model")
    return scores.select("seg_mode", "level", "model", F.row_number().over(order).alias("rank"), "cer_fixed", "cer")


def spans(scores: DataFrame) -> DataFrame:
    """Rows (model, span): largest less smallest cer_fixed over the groups."""
    return scores.groupBy("model").agg(F.round(F.max("cer_fixed") - F.min("cer_fixed"), 6).alias("span"))


def ref_order(scores: DataFrame, seg: str = REF_SEG, level: str = REF_LEVEL) -> DataFrame:
    """The reference group's models in order: (ref_rank, model, ref_score, ci_lo, ci_hi)."""
    own = scores.where((F.col("seg_mode") == seg) & (F.col("level") == level))
    # one row per model
    return own.select(F.row_number().over(Window.orderBy("cer_fixed", "model")).alias("ref_rank"), "model", F.col("cer_fixed").alias("ref_score"), "ci_lo", "ci_hi")


def flips(scores: DataFrame) -> DataFrame:
    """Rows (model_a, model_b, flips): groups in which b is better than a, for all ordered pairs."""
    a = scores.select("seg_mode", "level", F.col("model").alias("model_a"), F.col("cer_fixed").alias("a"))
    b = scores.select("seg_mode", "level", F.col("model").alias("model_b"), F.col("cer_fixed").alias("b"))
    return a.join(b, ["seg_mode", "level"]).where("model_a != model_b").groupBy("model_a", "model_b").agg(F.count_if(F.col("b") < F.col("a") - SLACK).alias("flips"))


def overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return (lo_a <= hi_b + SLACK) & (lo_b <= hi_a + SLACK)


def significant(cer_a: Column, lo_a: Column, hi_a: Column, cer_b: Column, lo_b: Column, hi_b: Column) -> Column:
    """Intervals apart, and the rates differ."""
    return ((hi_a < lo_b) | (hi_b < lo_a)) & (F.abs(cer_a - cer_b) > 0)


def margin(gap: Column, span_a: Column, span_b: Column) -> Column:
    both = span_a + span_b
    return F.when(both <= 0, F.lit(float("inf"))).otherwise(F.abs(gap) / both)


def verdict(tied: Column, flipped: Column, value: Column) -> Column:
    return F.when(tied, "TIE").when(flipped > 0, "FRAGILE").when(value < MARGIN_THRESHOLD, "FRAGILE").otherwise("STABLE")


def adjacent_pairs(scores: DataFrame, seg: str = REF_SEG, level: str = REF_LEVEL) -> DataFrame:
    """Each model of the reference order with its successor, and both spans."""
    order, by = ref_order(scores, seg, level), Window.orderBy("ref_rank")
    nxt = {c: F.lead(c).over(by) for c in ("model", "ref_score", "ci_lo", "ci_hi")}
    rows = order.select(
        F.col("ref_rank").alias("rank"), F.col("model").alias("model_a"), nxt["model"].alias("model_b"), F.col("ref_score").alias("cer_a"), nxt["ref_score"].alias("cer_b"),
        F.col("ci_lo").alias("lo_a"), F.col("ci_hi").alias("hi_a"), nxt["ci_lo"].alias("lo_b"), nxt["ci_hi"].alias("hi_b"),
    ).where("model_b is not null")
    span = spans(scores)
    side = lambda x: span.select(F.col("model").alias(f"model_{x}"), F.col("span").alias(f"span_{x}"))
    return rows.join(side("a"), "model_a").join(side("b"), "model_b").withColumn("gap", F.round(F.col("cer_b") - F.col("cer_a"), 6))


def verdicts(scores: DataFrame, seg: str = REF_SEG, level: str = REF_LEVEL) -> DataFrame:
    """A verdict on each pair of neighbours in the reference group; margin is Infinity if neither model moves."""
    pairs = adjacent_pairs(scores, seg, level).join(flips(scores), ["model_a", "model_b"])
    tied = overlap(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b"))
    value = margin(F.col("gap"), F.col("span_a"), F.col("span_b"))
    return pairs.select(
        "rank", "model_a", "model_b", "cer_a", "cer_b", "gap", "span_a", "span_b", F.round(value, 6).alias("margin"), F.col("flips").alias("flipped_groups"),
        tied.cast("int").alias("ci_overlap"), verdict(tied, F.col("flips"), value).alias("verdict"), F.lit(f"{seg}/{level}").alias("ref_group"),
    )


def nearest(scores: DataFrame, seg: str = REF_SEG, level: str = REF_LEVEL) -> DataFrame:
    """Rows (model, neighbour, gap_nearest, before): the closer neighbour in the reference order, the predecessor of equals."""
    by = Window.orderBy("ref_rank")
    near = ref_order(scores, seg, level).select(
        "model", F.lag("model").over(by).alias("p"), F.lead("model").over(by).alias("s"),
        F.round(F.abs(F.col("ref_score") - F.lag("ref_score").over(by)), 6).alias("gp"), F.round(F.abs(F.lead("ref_score").over(by) - F.col("ref_score")), 6).alias("gs"),
    )
    first = F.col("gs").isNull() | (F.col("gp") <= F.col("gs"))
    take = lambda a, b: F.when(F.col("p").isNotNull() & first, F.col(a)).otherwise(F.col(b))
    return near.select("model", take("p", "s").alias("neighbour"), take("gp", "gs").alias("gap_nearest"), (F.col("p").isNotNull() & first).alias("before"))


def stability(scores: DataFrame, seg: str = REF_SEG, level: str = REF_LEVEL, compat: bool = True) -> DataFrame:
    """A row per model: ranks and rates over the groups, and the verdict against its nearest neighbour (N/A without one).

    ``compat`` counts flips from the model to its neighbour even if the neighbour comes first in the reference order;
    without it the pair is taken in that order.
    """
    ranks = rank_matrix(scores).groupBy("model").agg(
        F.count("*").alias("n_groups"), F.min("rank").alias("rank_min"), F.max("rank").alias("rank_max"), (F.max("rank") - F.min("rank")).alias("rank_shift"),
        F.round(F.avg("rank"), 3).alias("rank_mean"), F.round(F.stddev_pop("rank"), 3).alias("rank_std"),
        F.min("cer_fixed").alias("cer_fixed_min"), F.max("cer_fixed").alias("cer_fixed_max"), F.round(F.max("cer_fixed") - F.min("cer_fixed"), 6).alias("cer_fixed_spread"),
        F.min("cer").alias("cer_min"), F.max("cer").alias("cer_max"),
    )
    order, span = ref_order(scores, seg, level), spans(scores)
    other = lambda t, names: t.select(*(F.col(a).alias(b) for a, b in names.items()))
    rows = (
        order.join(nearest(scores, seg, level), "model").join(span, "model")
        .join(other(order, {"model": "neighbour", "ci_lo": "lo_b", "ci_hi": "hi_b"}), "neighbour", "left")
        .join(other(span, {"model": "neighbour", "span": "span_b"}), "neighbour", "left")
    )
    turned = F.lit(False) if compat else F.col("before")
    rows = rows.withColumn("model_a", F.when(turned, F.col("neighbour")).otherwise(F.col("model"))).withColumn("model_b", F.when(turned, F.col("model")).otherwise(F.col("neighbour")))
    rows = rows.join(flips(scores), ["model_a", "model_b"], "left")
    value = margin(F.col("gap_nearest"), F.col("span"), F.col("span_b"))
    tied = overlap(F.col("ci_lo"), F.col("ci_hi"), F.col("lo_b"), F.col("hi_b"))
    judged = F.when(F.col("neighbour").isNull(), "N/A").otherwise(verdict(tied, F.col("flips"), value))
    rows = rows.select("model", F.col("ref_score").alias("ref_cer_fixed"), F.col("ci_lo").alias("ref_ci_lo"), F.col("ci_hi").alias("ref_ci_hi"), "gap_nearest", F.when(F.col("neighbour").isNotNull(), F.round(value, 6)).alias("margin"), judged.alias("verdict"))
    return ranks.join(rows, "model")


def protocol_curve(scores: DataFrame, levels: tuple[str, ...] = ("P0", "P1", "P2", "P3", "P4", "P5")) -> DataFrame:
    """Rows (model, P0..P5, drop): mean cer_fixed over the segmentations at each level."""
    wide = scores.groupBy("model").pivot("level", list(levels)).agg(F.round(F.avg("cer_fixed"), 6))
    return wide.withColumn(f"drop_{levels[0]}_to_{levels[-1]}", F.round(F.col(levels[0]) - F.col(levels[-1]), 6))


def monotonicity(scores: DataFrame) -> DataFrame:
    """Rows (seg_mode, model, from_level, to_level, before, after) where a milder level has a higher cer_fixed."""
    by = Window.partitionBy("seg_mode", "model").orderBy("level")
    rows = scores.select("seg_mode", "model", F.lag("level").over(by).alias("from_level"), F.col("level").alias("to_level"), F.lag("cer_fixed").over(by).alias("before"), F.col("cer_fixed").alias("after"))
    return rows.where(F.col("after") > F.col("before") + SLACK)


def tied_pairs(scores: DataFrame, seg: str = REF_SEG, level: str = REF_LEVEL) -> DataFrame:
    """Rows (model_a, model_b): pairs of a group whose intervals overlap."""
    own = scores.where((F.col("seg_mode") == seg) & (F.col("level") == level)).select("model", "cer_fixed", "ci_lo", "ci_hi")
    a, b = own.alias("a"), own.alias("b")
    both = a.join(b, F.col("a.model") < F.col("b.model"))
    return both.where(overlap(F.col("a.ci_lo"), F.col("a.ci_hi"), F.col("b.ci_lo"), F.col("b.ci_hi"))).select(F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"))


def significant_pairs(scores: DataFrame, seg: str = REF_SEG, level: str = REF_LEVEL) -> DataFrame:
    """Rows (model_a, model_b) of a group whose intervals are apart."""
    own = scores.where((F.col("seg_mode") == seg) & (F.col("level") == level)).select("model", "cer_fixed", "ci_lo", "ci_hi")
    a, b = own.alias("a"), own.alias("b")
    test = significant(*(F.col(f"{x}.{c}") for x in "ab" for c in ("cer_fixed", "ci_lo", "ci_hi")))
    return a.join(b, F.col("a.model") < F.col("b.model")).where(test).select(F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"))


def rank_cells(scores: DataFrame) -> DataFrame:
    """The rank matrix with a column for each model."""
    return rank_matrix(scores).groupBy("seg_mode", "level").pivot("model").agg(F.first("rank"))
