"""Evaluate model outputs against ground truth: scores, ranks, verdicts, stability, curve, checks and metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import LEVELS
from ..functions.segment import SEG_MODES
from ..operators import bootstrap, scoring, stability
from ..sources.readers import read_ground_truth, read_predictions
from ..sources.writers import write_csv, write_json

SCORES = ["seg_mode", "level", "model", "cer", "cer_fixed", "sub_rate", "del_rate", "ins_rate", "ref_len", "ci_lo", "ci_hi", "overflow_samples"]
STABILITY = [
    "model", "n_groups", "rank_min", "rank_max", "rank_shift", "rank_mean", "rank_std", "cer_fixed_min", "cer_fixed_max", "cer_fixed_spread", "cer_min", "cer_max",
    "ref_cer_fixed", "ref_ci_lo", "ref_ci_hi", "gap_nearest", "margin", "verdict",
]


def score(samples: DataFrame, predictions: DataFrame, pairs: dict[str, str], n_boot: int = bootstrap.N_BOOT, seg_modes: Sequence[str] = SEG_MODES, resamples: DataFrame | None = None) -> DataFrame:
    """Group scores with intervals, for ``samples (sample_id, ord, ref)`` and ``predictions (model, sample_id, text)``; ord counts from 0."""
    texts = scoring.with_predictions(samples.select("sample_id", "ord", "ref"), predictions).select("model", "ord", "ref", "text")
    own = scoring.sample_ops(texts, seg_modes, pairs=pairs)
    k = samples.count()
    den = F.greatest(F.lit(1), F.when(F.col("fixed_len") > 0, F.col("fixed_len")).otherwise(F.col("ref_len")))
    rated = own.select(*scoring.KEYS, "ord", F.col("dist").alias("err"), den.alias("den"))
    bounds = bootstrap.grouped_intervals(rated, k, scoring.KEYS, n_boot) if resamples is None else bootstrap.intervals(rated, resamples, scoring.KEYS, n_boot)
    return scoring.group_scores(own).join(bounds, scoring.KEYS).select(SCORES)


def run(
    spark: SparkSession, gt_dir: str, models_dir: str, out_dir: str, pairs: dict[str, str], n_boot: int = bootstrap.N_BOOT, ref_seg: str | None = None, ref_level: str | None = None,
    seg_modes: Sequence[str] | None = None, compat: bool = True, pairs_name: str = "given table",
) -> dict:
    """All results of an evaluation, also written to ``out_dir``; an unknown reference group falls back to the first segmentation or P0."""
    modes = [m for m in (seg_modes or SEG_MODES) if m in SEG_MODES]
    if not modes:
        raise ValueError(f"no segmentation among {seg_modes}")
    samples = read_ground_truth(spark, gt_dir)
    models = read_predictions(spark, models_dir)
    if not models.limit(1).count():
        raise RuntimeError(f"no model outputs in {models_dir}")
    k = samples.count()
    scores = score(samples, models, pairs, n_boot, modes).cache()
    seg = ref_seg if ref_seg in modes else ("para_merge" if "para_merge" in modes and ref_seg is None else modes[0])
    level = ref_level if ref_level in LEVELS else "P0"
    place = F.array_position(F.array(*(F.lit(m) for m in modes)), F.col("seg_mode"))
    result = {"scores": write_csv(scores, f"{out_dir}/scores.csv", [place, "level", "model"])}
    result["ranks"] = write_csv(stability.rank_matrix(scores), f"{out_dir}/rank_matrix.csv", ["seg_mode", "level", "rank"])
    n_models = len({r["model"] for r in result["scores"]})
    result["verdicts"] = write_csv(stability.verdicts(scores, seg, level), f"{out_dir}/verdicts.csv", ["rank"]) if n_models > 1 else []
    result["stability"] = write_csv(stability.stability(scores, seg, level, compat), f"{out_dir}/stability.csv", [F.desc("rank_shift"), "model"], STABILITY)
    result["curve"] = write_csv(stability.protocol_curve(scores), f"{out_dir}/protocol_curve.csv", ["model"])
    violations = [r.asDict() for r in stability.monotonicity(scores).orderBy("seg_mode", "model", "from_level").collect()]
    sources = samples.select(F.array_sort(F.collect_set(F.coalesce("source", F.lit("unknown")))).alias("s")).first()["s"]
    result["meta"] = {
        "n_samples": k, "n_models": n_models, "sample_ids": [r["sample_id"] for r in samples.orderBy("ord").select("sample_id").collect()], "models": sorted({r["model"] for r in result["scores"]}),
        "seg_modes": modes, "seg_modes_all": list(SEG_MODES), "levels": list(LEVELS), "n_groups": len(modes) * len(LEVELS), "primary_metric": "cer_fixed", "bootstrap_n": n_boot, "bootstrap_seed": bootstrap.SEED,
        "trad_backend": pairs_name, "monotonicity_violations": violations, "data_sources": sources, "ref_group": {"seg_mode": seg, "level": level},
        "verdict_rule": {"margin_threshold": stability.MARGIN_THRESHOLD, "margin_formula": "gap / (span_a + span_b)", "ci_level": 0.95, "precedence": ["TIE", "FRAGILE", "STABLE"]},
        "overflow_samples": sum(r["overflow_samples"] for r in result["scores"]),
    }
    scores.unpersist()
    write_json(result["meta"], f"{out_dir}/meta.json")
    return result
