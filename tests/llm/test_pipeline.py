"""The pipeline against a brute-force version of its stages on a small corpus with planted cases."""

import random
from hashlib import sha256

import duckdb
import tiktoken

import corpus_pipeline
from lexigauge.llm import byte_bpe
from lexigauge.llm.queries import SQL, tokenizer

from .test_decontaminate import similarity
from .test_operators import lower_words, shingle_set


def made(rng):
    """Documents, labels, benchmark items, and the ids that the quality rules reject."""
    words = ["".join(rng.choice("abcdeghinorst") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items, docs, junk = [text(n) for n in (15, 25, 40)], [], set()
    for i in range(150):
        lines = [text(rng.randint(15, 30)) for _ in range(3)]
        if i % 5 == 0:
            lines.insert(rng.randint(0, 3), f"Page {i} of the annual report")
        if i % 50 == 7:
            lines.insert(1, f"{text(8)} {items[i // 50]} {text(8)}")
        docs.append("\n".join(lines))
    docs += [docs[1]] * 2 + [docs[2] + " " + text(1), docs[3].replace("\n", "  ")]
    for _ in range(70):
        junk.add(len(docs))
        docs.append(" ".join(rng.choice(words) + rng.choice(["%%%", "$$$"]) for _ in range(40)))
    for t in (None, "", "too few words", "one line of ten words " * 40):
        junk.add(len(docs))
        docs.append(t)
    labels = [(i, int(i not in junk), 0) for i in range(len(docs)) if i % 6]
    return docs, labels, items, junk


def brute(docs, items, junk):
    kept = {i: t for i, t in enumerate(docs) if i not in junk}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(kept.items()))
    # the SQL gives digests of what is left of a text: find the lines whose removal gives it
    for i, n, digest in con.execute("select doc_id, n_dropped, text_sha256 from (" + SQL["op8_line_dedup"] + ")").fetchall():
        lines = kept[i].split("\n")
        assert n in (0, 1)
        left = ["\n".join(lines[:k] + lines[k + 1 :]) for k in range(len(lines))] if n else [kept[i]]
        kept[i] = next(t for t in left if sha256(t.encode()).hexdigest() == digest)
    sets, root = {i: shingle_set(t) for i, t in kept.items()}, {i: i for i in kept}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if b < a and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    kept = {i: t for i, t in kept.items() if root[i] == i}
    dirty = {i for i, t in kept.items() for x in map(lower_words, items) for w in [lower_words(t)] for s in range(len(w)) if similarity(w[s : s + len(x)], x) >= 0.75}
    return {i: t for i, t in kept.items() if i not in dirty}


def test_run_against_brute_force(spark, tmp_path):
    docs, labels, items, junk = made(random.Random(41))
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(i, t, "en", "s", len(t or "")) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    write(labels, "doc_id long, quality int, toxic int", "labels")
    write(list(enumerate(items)), "item_id long, text string", "benchmark")
    want = brute(docs, items, junk)
    path, pattern = tokenizer()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    digest = lambda t: (ids := library.encode_ordinary(t)) and (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(t.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: digest(t) for i, t in want.items()}
    assert 130 < len(want) < 150 and not {7, 57, 107, 150, 151, 152, 153} & set(want)
    assert not any("annual report" in t for t in want.values())


def test_stages_take_empty_tables_and_keep_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x", 3, "kept", "y")], "doc_id long, text string, n_chars long, _id string, _key string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs.limit(0), docs):
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, rows, str(tmp_path))
            assert out.columns == docs.columns and out.count() == (0 if name == "quality rules" else rows.count())
