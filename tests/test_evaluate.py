import json
import random

import pytest
from pyspark.sql import functions as F

from lexigauge.operators import bootstrap, layout, scoring, stability
from lexigauge.plans import evaluate, report, variants

PAIRS = {"體": "体", "檢": "检"}


@pytest.fixture
def folders(tmp_path, spark):
    gt, out = tmp_path / "gt", tmp_path / "models"
    gt.mkdir()
    texts = {f"s{i}": f"第{i}段文字，体检报告。\n\n第二段 abc{i}，继续写下去直到结束。" for i in range(6)}
    (gt / "index.json").write_text(json.dumps([{"sample_id": s, "doc_type": "x", "source": "generated", "license": "l"} for s in texts]), encoding="utf-8")
    for s, t in texts.items():
        (gt / f"{s}.md").write_text(t, encoding="utf-8")
    samples = spark.createDataFrame(list(texts.items()), "sample_id string, ref string")
    for r in variants.generate(samples, PAIRS).collect():
        (out / r["model"]).mkdir(parents=True, exist_ok=True)
        if (r["model"], r["sample_id"]) != ("model_clean", "s0"):
            (out / r["model"] / f"{r['sample_id']}.md").write_text(r["text"], encoding="utf-8")
    return str(gt), str(out), str(tmp_path / "result")


def test_run(spark, folders):
    gt, models, out = folders
    result = evaluate.run(spark, gt, models, out, PAIRS, n_boot=40)
    assert len(result["scores"]) == len(result["ranks"]) == 90
    assert len(result["verdicts"]) == 4 and len(result["stability"]) == len(result["curve"]) == 5
    by = {(r["seg_mode"], r["level"], r["model"]): r for r in result["scores"]}
    assert by["whole", "P3", "model_fullwidth"]["cer_fixed"] == 0
    assert by["whole", "P5", "model_traditional"]["cer_fixed"] == 0
    missing = by["whole", "P0", "model_clean"]
    assert missing["del_rate"] > 0.1
    for r in result["verdicts"]:
        assert r["gap"] >= 0 and (r["margin"] < 1 or r["flipped_groups"] == 0) and (r["verdict"] == "TIE") == bool(r["ci_overlap"])
    html = report.build(result, out + "/report.html")
    assert "<svg" in html and "model_spacy" in report.summary(result)
    raw = open(out + "/scores.csv", "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf") and b"\r" not in raw


def test_micro_average_and_intervals(spark):
    rows = spark.createDataFrame([("whole", "P0", "m", "a", 0, 990, 990, 0), ("whole", "P0", "m", "b", 10, 10, 10, 0)], "seg_mode string, level string, model string, sample_id string, dist long, ref_len long, fixed_len long, overflow int")
    assert scoring.group_scores(rows).first()["cer"] == 0.01
    row = scoring.macro_scores(rows).first()
    assert (row["micro"], row["macro"]) == (0.01, 0.5)
    assert bootstrap.picks(2000) == (50, 1950) and bootstrap.picks(200) == (5, 195)
    one = spark.createDataFrame([("m", 0, 1, 2)], "model string, ord int, err long, den long")
    ci = bootstrap.grouped_intervals(one, 1, ["model"], 10).first()
    assert (ci["ci_lo"], ci["ci_hi"]) == (0.0, 0.0)


def test_draws_in_tasks_are_those_of_a_table(spark, monkeypatch):
    k, n_boot, rng = 30, 200, random.Random(bootstrap.SEED)
    rows = [(m, i, (i * 7 + len(m)) % 5, 5 + i % 3) for m in ("a", "bb") for i in range(k)]
    samples = spark.createDataFrame(rows, "model string, ord int, err long, den long")
    for replicates in ([[rng.randrange(k) for _ in range(k)] for _ in range(n_boot)], None):
        if replicates is None:  # counter-based draws
            monkeypatch.setattr(bootstrap, "TWISTER_DRAWS", 0)
            replicates = [x.tolist() for x in bootstrap.draws(k, n_boot)]
            got = []
        else:
            got = sorted(map(tuple, bootstrap.grouped_intervals(samples, k, ["model"], n_boot).collect()))
        table = spark.createDataFrame([(b, i, x.count(i)) for b, x in enumerate(replicates) for i in set(x)], "b int, ord int, mult int")
        want = sorted(map(tuple, bootstrap.intervals(samples, table, ["model"], n_boot).collect()))
        assert not got or got == want
        assert all(0 < lo < hi < 1 for _, lo, hi in want)


def test_one_model_has_no_neighbour(spark):
    scores = spark.createDataFrame([("para_merge", "P0", "m", 0.1, 0.1, 0.05, 0.2)], "seg_mode string, level string, model string, cer double, cer_fixed double, ci_lo double, ci_hi double")
    assert stability.stability(scores).first()["verdict"] == "N/A"
    assert stability.verdicts(scores).count() == 0


def test_reading_order(spark):
    box = lambda x, y, h=10.0: [[x, y], [x + 5, y], [x + 5, y + h], [x, y + h]]
    rows = spark.createDataFrame([("i", [box(50.0, 2.0), box(0.0, 0.0), box(0.0, 30.0)], ["b", "a", "c", "unused"])], "image_id string, boxes array<array<array<double>>>, texts array<string>")
    assert layout.reading_order(rows).select("text", F.col("n_lines")).first() == ("a b\nc", 2)
