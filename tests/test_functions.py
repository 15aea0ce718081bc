import random

from pyspark.sql import functions as F

from lexigauge.functions import audit, flatten
from lexigauge.functions.chars import fold_tables
from lexigauge.functions.edit import count_ops, distance
from lexigauge.functions.normalize import casefold, collapse_ws, drop_cjk_space, half_width, normalize, punctuation_keeps_length, simplify, unify_punctuation
from lexigauge.functions.segment import align_blocks, split_blocks

PAIRS = {"體": "体", "檢": "检", "報": "报", "問": "问", "題": "题", "與": "与"}


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_levels(spark):
    at = lambda level, text: value(spark, text, lambda t: normalize(t, level, PAIRS))
    assert at("P0", "  甲  乙  ") == "甲  乙"
    assert at("P1", "  甲  乙  ") == "甲 乙"
    assert at("P3", "１２３") == "123"
    assert at("P4", "甲，乙") == "甲,乙"
    assert at("P5", "體檢報告與問題") == "体检报告与问题"
    assert at("P5", "甲 乙 丙") == "甲乙丙"
    assert at("P5", "甲 1 乙") == "甲 1 乙"
    assert at("P0", None) == ""
    assert punctuation_keeps_length()


def test_casefold_is_pythons(spark):
    texts = ["Straße", "ΑΣ", "İstanbul", "ﬁne", "ABC", "Ǆ", "ꭰ", "ŉ"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", casefold(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in rows] == [t.casefold() for t in texts]


def full_matrix(a, b):
    n, m = len(a), len(b)
    d = [[i + j if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    i, j, counts = n, m, [0, 0, 0]
    while i or j:
        if i and j and a[i - 1] == b[j - 1] and d[i][j] == d[i - 1][j - 1]:
            i, j = i - 1, j - 1
        elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
            counts[0], i, j = counts[0] + 1, i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            counts[1], i = counts[1] + 1, i - 1
        else:
            counts[2], j = counts[2] + 1, j - 1
    return (d[n][m], *counts)


def test_edit_operations_are_those_of_a_full_matrix():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert count_ops(a, b)[:4] == full_matrix(a, b), (a, b)
    assert count_ops("x" * 2001, "y" * 2000) == (1, 0, 1, 0, 2001, 2000, True)


def test_blocks(spark):
    text = "一段文字很长很长没有结束标点\n\n接着上一段的内容继续写下去。\n\n# 标题\n\n短"
    assert len(value(spark, text, lambda t: split_blocks(t, "para"))) == 4
    assert len(value(spark, text, lambda t: split_blocks(t, "para_merge"))) == 3
    assert value(spark, " \n ", lambda t: split_blocks(t, "whole")) == []
    pairs = spark.range(1).select(align_blocks(F.array(*map(F.lit, "abc")), F.array(F.lit("x"))).alias("p")).first()["p"]
    assert [tuple(p) for p in pairs] == [("a", "x"), ("b", None), ("c", None)]


def test_flatten(spark):
    plain = lambda text: value(spark, text, flatten.md_to_plain)
    assert plain("# 标题\n\n**粗** 和 `码`") == "标题\n\n粗 和 码"
    assert plain("![图](a.png) [链](b)") == "图 链"
    assert plain("甲\n\n- 乙") == "甲\n乙"
    assert plain("$$x^2$$") == "x^2"
    assert plain("<table><tr><td>a</td><td>b</td></tr></table>") == "a\tb"
    assert plain(None) == ""


def test_audit(spark):
    row = spark.createDataFrame([("體檢１２，甲 乙\n  x☀",)], "t string").select(*audit.audit(F.col("t"), "體檢")).first()
    assert (row["trad_only"], row["fullwidth_digit"], row["fullwidth_punct"], row["cjk_space"], row["indent"], row["emoji"], row["n_lines"]) == (2, 2, 1, 1, 1, 1, 2)


def test_levels_in_one_pass_are_those_in_turn(spark):
    texts = ["ＡＢＣ，Straße", "İ。體 檢", "plain Text", "ŉ１２！報", "　甲　乙　", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    in_turn = drop_cjk_space(simplify(unify_punctuation(half_width(casefold(collapse_ws(F.col("t"))))), PAIRS))
    assert all(r["a"] == r["b"] for r in rows.select(normalize(F.col("t"), "P5", PAIRS).alias("a"), in_turn.alias("b")).collect())


def test_distances_of_long_texts():
    rng = random.Random(9)
    for n, m in ((300, 250), (70, 400), (5, 900)):
        a, b = ("".join(rng.choice("abcd😀体") for _ in range(k)) for k in (n, m))
        assert count_ops(a, b)[:4] == full_matrix(a, b) and distance(a, b) == full_matrix(a, b)[0]
    assert distance("abc", "abc") == 0 and distance("", "ab") == 2 and count_ops("", "ab")[:4] == (2, 0, 0, 2)


def test_truncated_paragraphs(spark):
    merged = lambda text: value(spark, text, lambda t: split_blocks(t, "para_merge"))
    assert merged("the first line without end\n\nthe second line without end\n\nthe third line ends.\n\nthe fourth line starts anew") == [
        "the first line without end\nthe second line without end\nthe third line ends.", "the fourth line starts anew"]
    assert merged(None) == [] and merged("a\r\nb") == ["a\nb"]
    assert len(merged("\n\n".join(["this line of text goes on"] * 20_000))) == 1


def test_casefold_looks_characters_up(spark):
    one, many = fold_tables()
    texts = [f"體 a{c}Z" for c in [*many, *list(one)[::25]]] + ["體" + "".join(many), "體 x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", casefold(F.col("t")).alias("x"), casefold(F.col("t"), {"a": "b"}).alias("y")).collect()
    assert [r["x"] for r in rows] == [t.casefold() for t in texts] and [r["y"] for r in rows] == [t.casefold().replace("a", "b") for t in texts]
    assert "[" + "".join(many)[:3] not in str(casefold(F.col("t")))  # as a class of a pattern they are tried one by one
