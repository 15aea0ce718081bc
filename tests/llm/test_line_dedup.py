"""Line dedup: the tree's cases, and the operator against its SQL on odd rows."""

import random
from hashlib import sha256

import duckdb
import pytest

from lexigauge.llm import line_dedup
from lexigauge.llm.queries import SQL

SCHEMA = "doc_id long, text string"
NAMES = "ann bob cyd dee eve fay gus hal ida jon kay lee mia ned oda pam rex sue tom una".split()


class Lines:
    def __init__(self, seed):
        self.rng = random.Random(seed)

    def __call__(self, n=8):
        return " ".join("".join(self.rng.choice("abcde") for _ in range(5)) for _ in range(n))


def dropped(spark, rows, **how):
    got = line_dedup.drop_recurring_lines(spark.createDataFrame(rows, SCHEMA), **how).collect()
    return {r["doc_id"]: r for r in got}


def test_fields_with_digits(spark):
    line = Lines(5)
    rows = [(i, f"{line()}\nPage {i} of the annual report\n{line()}") for i in range(20)]
    copied = f"{line()}\n{line()}\n{line()}"
    rows += [(100 + i, copied) for i in range(30)] + [(200, None), (201, "")]
    got = dropped(spark, rows)
    assert all(got[i]["n_dropped"] == 1 and "report" not in got[i]["text"] for i in range(20))
    assert all(got[100 + i]["text"] == copied for i in range(30))
    assert got[200]["text"] is None and got[200]["n_lines"] == 0 and got[201]["text"] == "" and got[201]["n_lines"] == 1


def test_a_documents_own_lines_stay(spark):
    line = Lines(6)
    steps = "\n".join(f"Step {i} of the plan\n{line()}" for i in range(12))
    got = dropped(spark, [(0, steps)] + [(k, line(30)) for k in range(1, 30)])
    assert got[0]["text"] == steps and got[0]["n_dropped"] == 0


def test_fixed_blocks_go_whole(spark):
    line = Lines(8)
    footer = "Sent from the old office\nAll rights are kept here\nPlease think before you print"
    rows = [(i, f"{line(50)}\n\nSee our terms of use\n\n{line(50)}") for i in range(20)] + [(100 + i, f"{line()}\n{footer}") for i in range(50)]
    got = dropped(spark, rows)
    assert all(got[i]["n_dropped"] == 1 and "terms" not in got[i]["text"] for i in range(20))
    assert all(got[100 + i]["n_dropped"] == 3 and "\n" not in got[100 + i]["text"] for i in range(50))


def test_near_copies_keep_their_lines(spark):
    line = Lines(9)
    base = [line(20) for _ in range(12)]
    rows = []
    for i in range(60):
        mine = list(base)
        k = i % 12
        words = mine[k].split()
        words[10] = line(1) + str(i)
        mine[k] = " ".join(words)
        rows.append((i, "\n".join(mine)))
    assert all(r["n_dropped"] == 0 for r in dropped(spark, rows).values())


def test_names_generalise_and_depth_matters(spark):
    line = Lines(10)
    rows = [(i, f"{line()}\nUser {name} logged out\n{line()}") for i, name in enumerate(NAMES)]
    assert all(r["n_dropped"] == 1 and "logged" not in r["text"] for r in dropped(spark, rows).values())
    # the second token is compared in a leaf here, the third too
    assert all(r["n_dropped"] == 1 for r in dropped(spark, rows, depth=1).values())
    # two of the leading tokens vary: the parse goes no further, but a shallower tree compares them in its leaf
    rows = [(i, f"{line()}\nUser {a} {b} logged out of it\n{line()}") for i, (a, b) in enumerate(zip(NAMES, NAMES[::-1], strict=True))]
    assert all(r["n_dropped"] == 0 for r in dropped(spark, rows).values())
    assert all(r["n_dropped"] == 1 for r in dropped(spark, rows, depth=1).values())


def test_lines_of_any_length(spark):
    line = Lines(11)
    notice, long = line(41), line(400)
    rows = [(i, f"{line()}\nShare\n{line()}\nRead more\n{line()}\n{notice}\n{line()}\n{long}\n{line()}") for i in range(20)] + [(100 + i, f"{line()}\nSeldom\n{line()}") for i in range(9)]
    got = dropped(spark, rows)
    assert all(got[i]["n_dropped"] == 4 and got[i]["text"].count("\n") == 4 for i in range(20))
    assert all(got[100 + i]["n_dropped"] == 0 for i in range(9))


def test_few_constants_make_no_template(spark):
    line = Lines(12)
    rows = [(i, f"{line()}\nThe {line(1)} of\n{line()}\n{i} {i + 1}\n{line()}") for i in range(40)]
    assert all(r["n_dropped"] == 0 for r in dropped(spark, rows).values())


def test_empty_table_and_repeated_rows(spark):
    line = Lines(13)
    text = f"{line()}\nRead more now\n{line()}"
    got = line_dedup.drop_recurring_lines(spark.createDataFrame([(1, text)] * 12 + [(None, text), (2, " \n\t")], SCHEMA)).collect()
    assert len(got) == 14 and all(r["n_dropped"] == 0 for r in got)
    assert line_dedup.drop_recurring_lines(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("heavy", [False, True])
def test_against_its_sql(spark, monkeypatch, heavy):
    """With and without tables small enough to broadcast whole."""
    if heavy:
        monkeypatch.setattr("lexigauge.llm.shared.BROADCAST_ROWS", 3)
        monkeypatch.setattr("lexigauge.llm.shared.HEAVY_ROWS", 20)
    rng, line = random.Random(3), Lines(4)
    stock = ["Read more", "All rights reserved.", "Page 3 of 9", "Share", "Licensed as it is, without any warranty at all, to all who ask"]
    rows = []
    for i in range(150):
        parts = [line(rng.randint(1, 12)) for _ in range(rng.randint(0, 5))]
        for s in stock:
            if rng.random() < 0.3:
                parts.insert(rng.randint(0, len(parts)), s.replace("3", str(i)))
        if rng.random() < 0.4:
            parts.insert(rng.randint(0, len(parts)), f"Dear {line(1)} we write about your order {i} today")
        rows.append((i, rng.choice(["\n", "\n\n", " \n\t"]).join(parts)))
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(300, None), (301, ""), (302, "\n\n"), (303, "one\vtwo\x0cthree\n " * 20)]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], None if r["text"] is None else sha256(r["text"].encode()).hexdigest()) for r in dropped(spark, rows).values()}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = {r[0]: r[1:] for r in con.execute("select doc_id, n_lines, n_dropped, text_sha256 from (" + SQL["op8_line_dedup"] + ")").fetchall()}
    assert got == want and sum(r[1] for r in want.values()) > 100
