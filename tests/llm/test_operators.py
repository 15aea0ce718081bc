"""Operators against brute force on small tables, and the defined results of odd rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigauge.llm import byte_bpe, chat_format, decontaminate, line_dedup, lm_scoring, near_dedup, quality_rules, sharding, suffix_dedup
from lexigauge.llm.queries import tokenizer
from lexigauge.llm.shared import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, source string"


def lower_words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeghinorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [text(rng.randint(20, 160)) for _ in range(40)]
    base = text(200)
    for k in range(30):  # near copies
        words = base.split()
        for _ in range(k % 6):
            words[rng.randrange(200)] = rng.choice(vocabulary)
        rows.append(" ".join(words))
    passage = text(60)
    rows += [f"{text(30)} {passage} {text(20)}" for _ in range(5)]
    rows += [rows[0]] * 3 + [None, "", "  \n ", "one", "two words", text(5000), "Ünïcode 日本 😀 text " * 3]
    return [(i, t, "s") for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    # an extra column clashes with the operators' own names
    return spark.createDataFrame(corpus, SCHEMA).withColumn("rep", F.lit("x")).cache()


def shingle_set(text):
    w = lower_words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(docs, corpus):
    sets, parent = {i: shingle_set(t) for i, t, _ in corpus}, {i: i for i, _, _ in corpus}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    assert {i: got[i]["component_id"] for i in sets} == {i: find(i) for i in sets}
    assert {i: got[i]["n_shingles"] for i in sets} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_sketches_merge():
    import numpy as np

    a, b = (np.random.Generator(np.random.PCG64(s)).integers(0, 2**64, 300, dtype=np.uint64) for s in (1, 2))
    union = near_dedup.registers(np.union1d(a, b))
    assert (near_dedup.merge(near_dedup.registers(a), near_dedup.registers(b)) == union).all()


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100


def test_language_model(docs, corpus):
    words = {i: lower_words(t) for i, t, _ in corpus}
    one, two = Counter(w for x in words.values() for w in x), Counter(p for x in words.values() for p in zip(x, x[1:], strict=False))
    total = sum(one.values())
    for r in lm_scoring.stupid_backoff(docs, bucket_pairs=2000).collect():
        x = words[r["doc_id"]]
        want = math.log(one[x[0]] / total) if x else 0.0
        want += sum(math.log(two[p] / one[p[0]]) if two[p] >= 2 else math.log(0.4 * one[p[1]] / total) for p in zip(x, x[1:], strict=False))
        assert r["n_words"] == len(x) and abs(r["log_score"] - want) < 1e-4


def test_base_counts():
    texts = ["a b c d e a b c d e", "x\nx\n \n \nx y", "", "#* é|"]
    got = quality_rules.base_counts([t.encode() for t in texts])
    assert got["n_words"].tolist() == [10, 4, 0, 2]
    assert got["n_repeat_words"].tolist() == [10, 0, 0, 0]
    assert got["n_dup_lines"].tolist() == [0, 1, 0, 0]
    assert got["n_symbols"].tolist() == [0, 0, 0, 3]
    assert got["word_chars"].tolist() == [10, 4, 0, 4]


def test_quality_on_held_out_rows(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeiourstln") for _ in range(4))
    make = lambda good: " ".join(word() + ("" if good else rng.choice(["%%%", "$$$"])) for _ in range(40))
    rows = [(i, make(i % 2 == 0), "s") for i in range(300)]
    table = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(200)] + [(None, 1, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(table, labels).collect()}
    assert sum(got[i] == (i % 2 == 0) for i in range(200, 300)) >= 98
    none = quality_rules.quality_rules(table, labels.where("false"))
    assert none.where("not base_failed and not kept").count() == 0


def test_rare_toxic_words_on_held_out_rows(spark):
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdeghinorst") for _ in range(5)) for _ in range(300)]
    bad = ["zuqqaw", "xyvvoj", "kwuzzif", "pjyxxum", "qfowwyk", "vzikkux", "wxajjuz", "fyquvvy"]
    text = lambda *more: " ".join([*(rng.choice(words) for _ in range(40)), *more])
    rows = [(i, text(bad[i // 6]) if i < 48 else text(), "s") for i in range(480)] + [(1000 + i, text(bad[i % 8]), "s") for i in range(24)] + [(2000 + i, text(), "s") for i in range(100)]
    labels = spark.createDataFrame([(i, 1, int(i < 48)) for i in range(480)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA), labels).collect()}
    assert not any(got[1000 + i] for i in range(24)) and all(got[2000 + i] for i in range(100))


def test_decontamination(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [" ".join(word() for _ in range(n)) for n in (15, 30, 45, 3)]
    fill = lambda n: " ".join(word() for _ in range(n))
    rows = [(0, f"{fill(20)} {items[0]}%%% {fill(20)}", "s"), (1, f"{fill(5)}\n{items[1].upper()} {fill(3)}", "s"), (2, fill(80), "s"), (3, items[2].replace(items[2].split()[1], "changed"), "s"), (4, None, "s"), (5, "", "s"), (6, items[3], "s")]
    benchmark = spark.createDataFrame([(10 + i, t) for i, t in enumerate(items)] + [(99, None), (98, " ")], "item_id long, text string")
    table = spark.createDataFrame(rows, SCHEMA)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(table, benchmark).collect()}
    assert got == {(0, 10), (1, 11), (3, 12), (6, 13)}
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(table, benchmark).collect()) == [2, 4, 5]
    assert decontaminate.matches(table, benchmark.where("false")).count() == 0
    assert decontaminate.matches(table.where("false"), benchmark).count() == 0


def test_decontamination_of_swapped_halves(spark):
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    fill = lambda: " ".join(words(50))
    items = [words(n) for n in (40, 60)]
    rows = [(k, f"{fill()} {' '.join(x[len(x) // 2 :] + x[: len(x) // 2])} {fill()}", "s") for k, x in enumerate(items)] + [(2, " ".join(items[0][20:] + items[0][:20]), "s"), (3, fill(), "s")]
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    found = decontaminate.matches(spark.createDataFrame(rows, SCHEMA), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(0, 0), (1, 1), (2, 0)}
    assert {r["hamming"] for r in found if r["start_word"] == (50 if r["doc_id"] < 2 else 0) and r["n_words"] >= 40} == {0}


def test_passages(docs, corpus):
    words = {i: WORD.findall(t or "") for i, t, _ in corpus}
    seen = Counter(tuple(x[k : k + 50]) for x in words.values() for k in range(len(x) - 49))
    want = {(i, p) for i, x in words.items() for k in range(len(x) - 49) if seen[tuple(x[k : k + 50])] > 1 for p in range(k, k + 50)}
    got = {(r["doc_id"], p) for r in suffix_dedup.repeated_passages(docs).collect() for p in range(r["start_word"], r["end_word"])}
    assert got <= want and len(got) >= 0.99 * len(want) and {i for i, _ in got} == {i for i, _ in want}
    assert suffix_dedup.repeated_passages(docs.where("false")).count() == 0


def test_sharding(docs, corpus):
    import zlib

    rows = sharding.shard(docs, 7).collect()
    by = {r["doc_id"]: r for r in rows}
    assert all(r["size"] == len((corpus[i][1] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((corpus[i][1] or "").encode()) for i, r in by.items())
    assert by[0]["shard"] == by[75]["shard"] == by[76]["shard"]
    for s in range(7):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(docs.where("false"), 7).count() == 0


def test_smallest_capacity_is_minimal():
    rng = random.Random(4)
    for _ in range(200):
        sums, k = [rng.randint(1, 9) for _ in range(rng.randint(1, 12))], rng.randint(1, 5)
        best = {}

        def least(i, n):
            if i == len(sums):
                return 0
            if not n:
                return math.inf
            if (i, n) not in best:
                best[i, n] = min(max(sum(sums[i:j]), least(j, n - 1)) for j in range(i + 1, len(sums) + 1))
            return best[i, n]

        assert sharding.smallest_capacity(sums, k) == least(0, k)


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "On Monday, x wrote:\n> how  are you?\nFine"), (1, 2, "user", "> > How are you?\n> Fine\n\nGood"), (1, 3, "user", "> nothing known\nhm"), (2, 0, None, None)]
    got = {(r["conv_id"], r["turn"]): r for r in chat_format.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, t]["reply_to"] for t in range(4)] == [None, 0, 1, None]
    assert [got[1, t]["body"] for t in range(4)] == ["Hello there\nHow are you?", "Fine", "Good", "hm"]
    assert got[1, 2]["thread_root"] == 0 and got[2, 0]["body"] == ""


def test_byte_bpe(docs, corpus):
    import tiktoken

    path, pattern = tokenizer()
    ranks = byte_bpe.read_ranks(path)
    library, own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), byte_bpe.Encoder(ranks, pattern)
    rng = random.Random(6)
    for _ in range(1500):
        text = "".join(rng.choice("aaab eé\n日😀Z1.,#'s") for _ in range(rng.randint(0, 50)))
        assert own.encode(text) == library.encode_ordinary(text) and own.decode(own.encode(text)) == text.encode()
    texts = {i: t or "" for i, t, _ in corpus}
    assert all(r["n_tokens"] == len(library.encode_ordinary(texts[r["doc_id"]])) for r in byte_bpe.encode_digest(docs, path, pattern).collect())
    back = byte_bpe.decode_ids(byte_bpe.encode_ids(docs, path, pattern).select("doc_id", "ids"), path, pattern)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == texts


CLASHING = ["_id", "_key", "_out", "_bad", "_spans", "kept_id", "n_lines", "n_dropped", "kept", "key", "place", "words", "item_id", "component_id"]


def test_nulls_repeated_rows_and_clashing_names(spark):
    text = "a b c d e f g h i j k l"
    docs = spark.createDataFrame([(1, text), (1, text), (2, None), (None, "a text without id"), (3, ""), (4, " \n "), (5, "w " * 3000), (6, text + " m")], "doc_id bigint, text string")
    docs = docs.select("*", *(F.lit("x").alias(c) for c in CLASHING))
    items = spark.createDataFrame([(1, text), (None, "q"), (2, None)], "item_id bigint, text string")
    ids = lambda rows: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows.collect())
    plain = lambda *found: sorted((i is None, i or 0) for i in found)
    assert ids(near_dedup.keep_one(docs)) == plain(1, 1, 2, 3, 4, 5, None)
    assert ids(decontaminate.drop_contaminated(docs, items)) == plain(2, 3, 4, 5, None)
    assert ids(line_dedup.drop_recurring_lines(docs)) == plain(1, 1, 2, 3, 4, 5, 6, None)
    assert ids(suffix_dedup.drop_passages(docs)) == plain(1, 1, 2, 3, 4, 5, 6, None)
    for kept in (near_dedup.keep_one, lambda d: decontaminate.drop_contaminated(d, items), line_dedup.drop_recurring_lines, suffix_dedup.drop_passages):
        assert kept(docs.limit(0)).count() == 0
        assert set(docs.columns) <= set(kept(docs.limit(0)).columns)


def test_an_id_with_two_texts_keeps_both_texts_links(spark):
    rng = random.Random(21)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    a, b = words(80), words(80)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (3, " ".join([*b, "x"])), (4, " ".join([*a, "x"])), (4, " ".join([*a, "x"])), (9, "else")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (3, 1), (4, 1), (4, 1), (9, 9)]
