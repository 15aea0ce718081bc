"""Decontamination against brute force over all windows of a text."""

import random
from collections import Counter

from lexigauge.llm import decontaminate

SCHEMA = "doc_id long, text string"


def similarity(x, y):
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    a, b = grams(x), grams(y)
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_against_all_windows(spark):
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdeghinorst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    fill = lambda n: [rng.choice(words) for _ in range(n)]
    items = [fill(rng.choice((3, 15, 22, 30, 40, 59))) for _ in range(24)]
    docs = []
    for i in range(160):
        item = list(rng.choice(items))
        for _ in range(i % 4):  # up to three words changed, left out or put in
            at, how = rng.randrange(len(item)), rng.randrange(3)
            item[at : at + (how < 2)] = [rng.choice(words)] if how != 1 else []
        if i % 7 == 0:
            item = item[len(item) // 2 :] + item[: len(item) // 2]
        docs.append(fill(rng.randint(0, 60)) + item + fill(rng.randint(0, 60)))
    want = set()
    for d, text in enumerate(docs):
        for k, item in enumerate(items):
            n = len(item)
            # windows are cut at the text's ends
            cut = (text[max(0, s) : s + n] for s in range(1 - n, len(text)))
            if any(similarity(w, item) >= 0.75 for w in cut if w and (len(w) >= 5) == (n >= 5)):
                want.add((d, k))
    table = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], SCHEMA)
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    rows = decontaminate.matches(table, benchmark).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 40
    for r in rows:
        assert abs(r["similarity"] - similarity(docs[r["doc_id"]][r["start_word"] : r["start_word"] + r["n_words"]], items[r["item_id"]])) < 1e-9


def test_blocks_find_all_fingerprints_within_the_radius():
    rng = random.Random(32)
    listed = [(at, width, set(decontaminate._changed(width, decontaminate.RADIUS // decontaminate.BLOCKS))) for at, width in decontaminate._blocks()]
    assert sum(width for _, width, _ in listed) == 64 and all(len(masks) == 697 for _, _, masks in listed)
    met = 0
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randint(0, decontaminate.RADIUS)))
        assert any(differ >> at & ((1 << width) - 1) in masks for at, width, masks in listed)
        met += any(rng.getrandbits(64) >> at & ((1 << width) - 1) in masks for at, width, masks in listed)
    assert met < 0.06 * 3000  # of random fingerprints few meet


def test_fingerprints(spark):
    rng = random.Random(33)
    bags = {k: [rng.getrandbits(64) - (1 << 63) for _ in range(rng.randint(1, 50))] for k in range(20)}
    rows = spark.createDataFrame([(k, h) for k, x in bags.items() for h in x], "k long, h long")
    want = {k: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in x) > len(x)) for k, x in bags.items()}
    for most in (50, 1 << 20):
        assert {r["k"]: r["print"] % (1 << 64) for r in decontaminate.simhash(rows, "k", most).collect()} == want


def test_repeated_rows_clashing_names_and_long_texts(spark):
    rng = random.Random(34)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    item = " ".join(word() for _ in range(20))
    long = " ".join(word() for _ in range(20_000)) + " " + item
    rows = [(1, item), (1, item), (2, None), (3, ""), (None, item), (4, long)]
    names = "n long, size long, shingle string, kind string, print string, item_id long"
    table = spark.createDataFrame([(*r, 1, 1, "x", "x", "x", 7) for r in rows], SCHEMA + ", " + names)
    benchmark = spark.createDataFrame([(5, item, "x"), (6, item, "x")], "item_id long, text string, doc_id string")
    got = decontaminate.matches(table, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 5), (1, 6), (4, 5), (4, 6)} and {r["hamming"] for r in got if r["similarity"] == 1} == {0}
    assert sorted(r["doc_id"] is None for r in decontaminate.drop_contaminated(table, benchmark).collect()) == [False, False, True]
