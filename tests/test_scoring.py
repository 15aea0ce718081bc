import random
from itertools import zip_longest

import duckdb
import pytest
from pyspark.sql import functions as F

from lexigauge import catalogue
from lexigauge.functions import edit, plain
from lexigauge.functions.edit import certain, count_ops, distance
from lexigauge.functions.normalize import LEVELS, normalize
from lexigauge.functions.segment import SEG_MODES, split_blocks
from lexigauge.operators import scoring

from .test_functions import PAIRS, full_matrix

ODD = [
    None, "", " \r\n ", "a\r\nb", "a\n \n\nb\n\x85\nc", "一段文字很长很长没有结束标点\n\n接着上一段的内容继续写下去。\n\n# 标题\n\n短", "Straße ＡＢＣ，體 檢\n\nİ。甲  乙",
    "the first line without end\n\nthe second line without end\n\nshort one\n\nthe third line ends.\n\n```x\n\n- y", "😀 text\x1cwith odd　spaces", "x" * 13 + "\n\n" + "y" * 13,
]


def test_strings_are_split_and_normalised_as_columns(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    for mode in SEG_MODES:
        found = F.transform(split_blocks(F.col("t"), mode), lambda b: F.array(*(normalize(b, level, PAIRS) for level in LEVELS)))
        for i, got in rows.select("i", found).collect():
            want = plain.at_levels(plain.blocks(ODD[i], mode), PAIRS)
            assert [[b[k] for b in got] for k in range(6)] == want, (mode, ODD[i])


def test_distances_known_without_a_matrix():
    rng, known = random.Random(5), 0
    for _ in range(1500):
        a = "".join(rng.choice("ab😀") for _ in range(rng.randint(0, 8)))
        b = "".join(rng.choice("abAB") if rng.random() < 0.3 else c for c in a if rng.random() < 0.8 or rng.random() < 0.5)
        for r, h in ((a, b), (b, a)):
            want = full_matrix(r, h)
            assert distance(r, h) == want[0] and count_ops(r, h)[:4] == want, (r, h)
            if r and h and r[-1] != h[-1] and certain(r, h):
                known += 1
                assert certain(r, h) == want, (r, h)
    assert known > 200


def test_long_texts_need_no_matrix(monkeypatch):
    def refuse(*_):
        raise AssertionError("a matrix")

    monkeypatch.setattr(edit, "_places", refuse)
    text = "The mother thought that this path\n\nwas the other.  " * 400
    for other in (text.replace("th", "t"), text.replace(" ", "  "), text.upper(), text.replace("\n", " "), "", text + "more", text[:50]):
        assert distance(text, other) == distance(other, text) >= abs(len(text) - len(other))
    for other in (text.replace("th", "t"), text.upper()):
        a, b = text[:1900], other[:1800]
        assert count_ops(a[:1800], a[:1800].upper())[1] == distance(a[:1800], a[:1800].upper())
        assert count_ops(a, a.replace("th", "t"))[2] == a.count("th")


@pytest.mark.parametrize("ops", [False, True])
def test_grid_by_brute_force(spark, ops):
    def worse(t):
        return "".join(rng.choice("ab \n") if rng.random() < 0.1 else c for c in t)

    rng = random.Random(2)
    refs = [t or "" for t in ODD] + ["".join(rng.choice("ab T。\n\n") for _ in range(40)) for _ in range(8)]
    rows = [(m, i, r, h) for i, r in enumerate(refs) for m, h in (("same", r), ("upper", r.upper()), ("none", None), ("spaced", r.replace(" ", "  ")), ("worse", worse(r)))]
    texts = spark.createDataFrame(rows, "model string, sample_id int, ref string, text string")
    got = (scoring.sample_ops if ops else scoring.sample_scores)(texts, pairs=PAIRS).collect()
    assert len(got) == len(rows) * 18 == len({(r["model"], r["sample_id"], r["seg_mode"], r["level"]) for r in got})
    by = {(m, i): (r, h) for m, i, r, h in rows}
    for x in got:
        ref, hyp = (plain.at_levels(plain.blocks(t, x["seg_mode"]), PAIRS) for t in by[x["model"], x["sample_id"]])
        k = LEVELS.index(x["level"])
        r, h = ref[k], hyp[k]
        size = max(len(r), len(h))
        sums = [sum(c) for c in zip((0,) * 4, *(full_matrix(a, b) for a, b in zip(r + [""] * (size - len(r)), h + [""] * (size - len(h)), strict=True)), strict=True)]
        assert (x["ref_len"], x["fixed_len"], x["overflow"]) == (sum(map(len, r)), sum(map(len, ref[0])), 0)
        assert ([x["dist"], x["S"], x["D"], x["I"]] if ops else [x["dist"]]) == sums[: 4 if ops else 1], x


def test_grid_of_some_levels_and_segmentations(spark):
    texts = spark.createDataFrame([("m", 1, "A b\n\nc  d", "a B\n\nc d")], "model string, sample_id int, ref string, text string")
    every = {(r["seg_mode"], r["level"]): r["dist"] for r in scoring.sample_scores(texts).collect()}
    some = {(r["seg_mode"], r["level"]): r["dist"] for r in scoring.sample_scores(texts, ["para"], ["P3", "P1"]).collect()}
    assert some == {k: v for k, v in every.items() if k in (("para", "P1"), ("para", "P3"))} and len(some) == 2
    with pytest.raises(ValueError):
        scoring.sample_scores(texts, ["page"])


def test_guard(spark):
    texts = spark.createDataFrame([("m", 1, "ab" * 1500, "ba" * 1500)], "model string, sample_id int, ref string, text string")
    for guard, dist in ((True, 0), (False, 2)):
        row = scoring.sample_scores(texts, ["whole"], ["P0"], guard=guard).first()
        assert (row["dist"], row["overflow"]) == (dist, 1)


def unguarded(spark, tmp_path, name):
    """Rows of a query on a table with texts beyond the guard, by their keys, held against its SQL."""
    long = "so the weather of the north\nthat they had.\n" * 100
    rows = [(1, long, "src1"), (2, "Short one th", "src0"), (3, None, "src2"), (4, "x" * 2100 + "\nand  more", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    want = con.sql(f"select {', '.join(got.columns)} from ({catalogue.SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    return {(r["seg_mode"], r["level"], r["model"]): r for r in got.collect()}


def test_corpus_cer_measures_long_texts(spark, tmp_path):
    by = unguarded(spark, tmp_path, "corpus_cer")
    assert by["whole", "P0", "upper"]["cer"] > 0.7 and by["whole", "P2", "upper"]["cer"] == 0 and by["whole", "P0", "upper"]["overflow_samples"] == 2


def test_macro_average_measures_long_texts(spark, tmp_path):
    by = unguarded(spark, tmp_path, "corpus_cer_macro_vs_micro")
    assert by["whole", "P0", "upper"]["micro"] > 0.7 and by["whole", "P0", "upper"]["macro"] > 0.6


@pytest.mark.parametrize(("guard", "ops"), [(True, True), (True, False), (False, False)])
def test_blocks_settled_together_are_as_those_one_by_one(monkeypatch, guard, ops):
    """Random texts and models of them, with a guard that some blocks exceed, against a matrix for every pair of blocks."""
    cells = 150 if guard else 10**9
    monkeypatch.setattr(scoring, "MAX_CELLS", cells)
    monkeypatch.setattr(edit, "MAX_CELLS", cells)
    rng = random.Random(11)
    for _ in range(150):
        ref = "".join(rng.choice(("th", "the", "Tall", "Straße", "體 檢", " ", " ", "\n\n", "\n\n", "\n", ".", "\0", "\t")) for _ in range(rng.randint(0, 24)))
        texts = [ref, None, ref.upper(), ref.replace("th", "t"), ref.replace("t", "tt"), ref.replace(" ", "  "), ref.replace("\n", " "), ref.replace("th", "t", 1).upper(), ref.replace("\n\n", "\n"), ref[::-1]]
        grid = scoring._Grid(SEG_MODES, LEVELS, PAIRS, guard, ops)
        for text in texts:
            want = []
            for mode in SEG_MODES:
                rs, hs = (plain.at_levels(plain.blocks(t, mode), PAIRS) for t in (ref, text))
                for r, h in zip(rs, hs, strict=True):
                    sums, far = [0] * 4, 0
                    for i in range(max(len(r), len(h))):
                        a, b = (x[i] if i < len(x) else "" for x in (r, h))
                        over = len(a) * len(b) > cells
                        far |= over and not (ops and a == b)
                        n, m = len(a), len(b)
                        cell = (abs(n - m), 0, max(0, n - m), max(0, m - n)) if over and guard else full_matrix(a, b)
                        sums = [x + y for x, y in zip(sums, cell, strict=True)]
                    want.append((sum(map(len, rs[0])), sum(map(len, r)), int(far), *sums[: 4 if ops else 1]))
            assert [tuple(c) for c in grid.cells(ref, text)] == want, (ref, text)


def refuse_single_pairs(monkeypatch):
    def refuse(*_):
        raise AssertionError("a pair by itself")

    monkeypatch.setattr(scoring, "distance", refuse)
    monkeypatch.setattr(scoring, "count_ops", refuse)
    return "\n\n".join(["The mother thought that this path was the other.", "A Short one th."] * 60)


def test_corpus_cer_settles_paragraphs_at_once(monkeypatch):
    """what the query's models do to a text takes one pass over all paragraphs, and none over the blocks made of them."""
    text = refuse_single_pairs(monkeypatch)
    passes = []
    monkeypatch.setattr(scoring, "together", lambda pairs: passes.append(len(pairs)) or edit.together(pairs))
    grid = scoring._Grid(("para_merge", "para", "whole"), LEVELS, {}, False, False)
    for other in (text, "", text.replace("th", "t"), text.replace(" ", "  "), text.upper()):
        want = [sum(edit.distance(*p) for p in zip_longest(*(plain.blocks(t, mode) for t in (text, other)), fillvalue="")) for mode in grid.modes]
        assert [c[3] for c in grid.cells(text, other)][::6] == want
    assert 0 < len(passes) <= 3


def test_macro_average_settles_whole_texts_by_their_paragraphs(monkeypatch):
    """texts beyond the guard, measured without it, need neither a pair by itself nor a pass of their own."""
    text = refuse_single_pairs(monkeypatch)
    longest = []
    monkeypatch.setattr(scoring, "together", lambda pairs: longest.append(max(len(r) for r, _ in pairs)) or edit.together(pairs))
    grid = scoring._Grid(SEG_MODES, LEVELS, {}, False, False)
    for other in (text.replace("th", "t"), text.upper()):
        cells = list(grid.cells(text, other))
        assert cells[0][2:] == (1, edit.distance(text, other)) and cells[3][3] == edit.distance(text.casefold(), other.casefold())
    assert 0 < max(longest) < 100


def test_overflow_takes_no_distances(spark, monkeypatch, tmp_path):
    """the same overflow as that of scored rows, and nothing measured for it."""
    rng = random.Random(4)
    long = "".join(rng.choice("ab \n") for _ in range(5000))
    rows = [(1, "Ab c\nd", "src0"), (2, long, "src1"), (3, None, "src1"), (4, long + "\n\n" + "x" * 2001, "src0"), (5, "é" * 2001, "src2")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    scored = scoring.sample_scores(catalogue.model_texts(spark, str(tmp_path)), pairs={})
    want = {(r["seg_mode"], r["level"]): (r["o"], r["n"]) for r in scored.groupBy("seg_mode", "level").agg(F.sum("overflow").alias("o"), F.count("*").alias("n")).collect()}
    got = catalogue.QUERIES["overflow_summary"](spark, str(tmp_path))
    assert {(r["seg_mode"], r["level"]): (r["overflow_samples"], r["n"]) for r in got.collect()} == want
    assert want["whole", "P0"][0] > want["para", "P0"][0] > 0 and "dist" not in got._jdf.queryExecution().analyzed().toString()
    refuse_single_pairs(monkeypatch)
    assert [c for (c,) in scoring._Grid(SEG_MODES, LEVELS, PAIRS, True, False).far(long, long[::-1])] == [1] * 6 + [0] * 12


def test_sums_are_those_of_the_samples(spark):
    """a batch gives a row per segmentation, level and model, and the averages over them are those over the samples."""
    rng = random.Random(3)
    refs = [t or "" for t in ODD] + ["".join(rng.choice(("th ", "A", "b. ", "\n\n", "\n")) for _ in range(30)) for _ in range(30)]
    refs.append("ab\n\ncd " * 700)  # beyond the guard
    rows = [(i, r, [("upper", r.upper()), ("spaced", r.replace(" ", "  ")), ("none", None), ("less", r.replace("th", "t"))]) for i, r in enumerate(refs)]
    nested = spark.createDataFrame([*rows, (99, "no model", []), (100, "none", None)], "sample_id int, ref string, texts array<struct<model string, text string>>").repartition(3)
    flat = nested.select("sample_id", "ref", F.explode("texts").alias("m")).select("m.model", "sample_id", "ref", "m.text")
    for guard in (True, False):
        sums, samples = scoring.score_sums(nested, pairs=PAIRS, guard=guard), scoring.sample_scores(flat, pairs=PAIRS, guard=guard)
        for got, want in ((scoring.leaderboard(sums), scoring.group_scores(samples)), (scoring.macro_board(sums), scoring.macro_scores(samples))):
            assert got.dtypes == want.dtypes
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sums.count() <= 3 * 8 * 18 * 4 and sums.where("overflow_samples > 0").count() > 0
    with pytest.raises(ValueError):
        scoring.score_sums(nested, ["page"])


def test_macro_average_sums_in_the_batches(spark, tmp_path):
    """no more rows leave the scoring than a batch has groups, however many documents there are."""
    rows = [(i, f"The path {i} th.\nAnd  {i} more", f"src{i % 3}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert scoring.score_sums(catalogue.ref_texts(spark, str(tmp_path)).coalesce(1), pairs={}, guard=False).count() % 90 == 0
    plan = catalogue.QUERIES["corpus_cer_macro_vs_micro"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_runs_of_spaces_take_no_pass(monkeypatch):
    """paragraphs that are the ref's but for runs of spaces are as far from them as their lengths differ."""

    def refuse(*_):
        raise AssertionError("measured")

    for name in ("together", "distance", "count_ops"):
        monkeypatch.setattr(scoring, name, refuse)
    text = "The mother thought that this path was the other.\n\nAnd a longer one here." * 3
    other = text.replace(" ", "   ")
    for ops in (False, True):
        for ref, hyp in ((text, other), (other, text)):
            cells = scoring._Grid(("para",), LEVELS, {}, False, ops).cells(ref, hyp)
            n = len(hyp) - len(ref)
            assert [c[3:] for c in cells] == [(abs(n), 0, max(0, -n), max(0, n))[: 4 if ops else 1]] + [(0,) * (4 if ops else 1)] * 5


def test_few_partitions_are_dealt_over_the_cores(spark, tmp_path):
    """partitions enough for all cores once leave most of them idle while the last ones run."""
    cores = spark.sparkContext.defaultParallelism
    spark.createDataFrame([(i, "a", "src1") for i in range(100)], "doc_id long, text string, source string").repartition(cores).write.parquet(f"{tmp_path}/documents.parquet")
    assert catalogue.ref_texts(spark, str(tmp_path)).rdd.getNumPartitions() == 4 * cores
    rows = spark.range(10).repartition(4 * cores)
    assert scoring.spread(rows, 4) is rows
