"""Stupid-backoff scores of documents under a bigram model of the whole corpus.

A word is scored by log(c(v w) / c(v)) after the word v before it if the pair stands in the corpus at least ``min_count`` times, else
by log(alpha * c(w) / N); a document's first word by log(c(w) / N). N counts all words. A document's score is the sum.

Word counts are a table summed by hash. Word pairs are exploded from the documents and dealt by the hash of the pair into buckets, as many
as the corpus needs for about ``BUCKET_PAIRS`` pairs each; a bucket counts its pairs, joins them to its occurrences and sums per document. Counts of
frequent words (at least N / 2**20, so 2**20 words at most) are sent to the tasks; what needs a rarer word's count is joined to the
word table by hash. Within a bucket, pairs travel sorted and compressed.

Words are hashed to 64 bits (ASCII white space separates, ASCII lower case). Defined cases: null and empty text has no words and the score
0; of repeated rows each gets the same score and each counts in the corpus; an empty table gives no rows; extra columns are ignored.

Bound: a bucket holds all occurrences of its pairs, so one pair that makes up a large part of a corpus far beyond a task's memory would
have to be salted further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage
from .wordhash import Words, chunks, mix, slices

ALPHA, MIN_COUNT = 0.4, 2
BUCKET_PAIRS = 1_000_000
#: Words that are sorted and packed at once.
BLOCK_WORDS = 500_000
FREQUENT_BITS = 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words, _, _ in _blocks(batches):
        h, c = np.unique(words, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["word", "n"])


def _packed(*columns: np.ndarray) -> bytes:
    return pa.compress(b"".join(c.tobytes() for c in columns), codec="zstd", asbytes=True)


class _Frequent:
    """Sorted hashes of the frequent words and their counts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]

    def code(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words, those beyond the end being places in the second array, of rarer words."""
        if not len(self.words):
            rare, at = np.unique(hashes, return_inverse=True)
            return at.astype(np.uint32), rare
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        unknown = self.words[at] != hashes
        rare, place = np.unique(hashes[unknown], return_inverse=True)
        code = at.astype(np.uint32)
        code[unknown] = place + len(self.words)
        return code, rare


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word hashes of about ``BLOCK_WORDS`` words, the row of each, and the rows' ids."""
    words, rows, ids, held = [], [], [], 0
    n_rows = 0
    for part in slices(batches):
        of_part = part.column("doc_id").to_numpy(zero_copy_only=False)
        for first, texts in chunks(part.column("text").to_pylist()):
            found = Words(texts, lower=True)
            words.append(found.hash)
            rows.append(np.repeat(np.arange(n_rows, n_rows + len(texts)), np.diff(found.bounds)))
            ids.append(of_part[first : first + len(texts)])
            n_rows, held = n_rows + len(texts), held + len(found.hash)
            if held >= BLOCK_WORDS:
                yield np.concatenate(words), np.concatenate(rows), np.concatenate(ids)
                words, rows, ids, held, n_rows = [], [], [], 0, 0
    if words:
        yield np.concatenate(words), np.concatenate(rows), np.concatenate(ids)


def _deal(frequent, buckets: int):
    """Packed pairs of each bucket, in the order of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        size = len(known.words)
        for hashes, row, ids in _blocks(batches):
            inner = np.flatnonzero(row[1:] == row[:-1])
            if not len(inner):
                continue
            code, rare = known.code(hashes)
            bucket = (mix(hashes[inner] * _A + hashes[inner + 1] * _B) >> np.uint64(32)) % np.uint64(buckets)
            if size + len(rare) < 1 << 22 and buckets < 1 << 20:
                order = np.argsort((bucket << np.uint64(44)) | (code[inner].astype(np.uint64) << np.uint64(22)) | code[inner + 1])
            else:
                order = np.lexsort((code[inner + 1], code[inner], bucket))
            bucket, inner = bucket[order], inner[order]
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)]
            rows = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                at = inner[a:b]
                docs, own = np.unique(row[at], return_inverse=True)
                parts = []
                for c in (code[at], code[at + 1]):
                    # only the rarer words of this bucket go with it
                    beyond = c >= size
                    used, place = np.unique(c[beyond] - np.uint32(size), return_inverse=True)
                    c[beyond] = place + size
                    parts += [c, rare[used]]
                packed = _packed(np.diff(parts[0], prepend=np.uint32(0)), parts[2], own.astype(np.uint32), parts[1], parts[3], ids[docs])
                rows.append((int(bucket[a]), b - a, len(parts[1]), len(parts[3]), len(docs), packed))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "n", "n_v", "n_w", "n_docs", "packed"])

    return run


def _score(frequent, total: int, alpha: float, min_count: int):
    """Sums of a bucket: (doc_id, word, times, value); word is null, or a rarer word whose log count is due so many times."""

    def run(group: pa.Table) -> pa.Table:
        known = frequent.value
        size = len(known.words)
        vs, ws, docs = [], [], []
        for r in group.to_pylist():
            n, n_v, n_w, n_docs = r["n"], r["n_v"], r["n_w"], r["n_docs"]
            raw = pa.decompress(r["packed"], 12 * n + 8 * (n_v + n_w + n_docs), "zstd", asbytes=True)
            columns, at = [], 0
            for count, kind in ((n, np.uint32), (n, np.uint32), (n, np.uint32), (n_v, np.uint64), (n_w, np.uint64), (n_docs, np.int64)):
                columns.append(np.frombuffer(raw, kind, count, at))
                at += columns[-1].nbytes
            steps, cw, own, rare_v, rare_w, ids = columns
            cv = np.cumsum(steps, dtype=np.uint32)
            vs.append(np.concatenate((known.words, rare_v))[cv])
            ws.append(np.concatenate((known.words, rare_w))[cw])
            docs.append(ids[own])
        v, w, doc = np.concatenate(vs), np.concatenate(ws), np.concatenate(docs)
        _, at, counts = np.unique(mix(v * _A + w * _B), return_inverse=True, return_counts=True)
        count = counts[at]
        kept = count >= min_count
        value = np.where(kept, np.log(count), np.log(alpha) - np.log(total))
        # due: less the log count of the word before, or plus that of the word itself
        due, sign = np.where(kept, v, w), np.where(kept, -1, 1)
        place = np.minimum(np.searchsorted(known.words, due), max(size - 1, 0))
        has = known.words[place] == due if size else np.zeros(len(due), bool)
        value[has] += sign[has] * np.log(known.counts[place[has]])
        ids, own = np.unique(doc, return_inverse=True)
        sums = np.bincount(own, value, len(ids))
        rest = ~has
        doc, due = doc[rest], due[rest]
        _, one, back = np.unique(mix(doc.view(np.uint64) * _A + due * _B), return_index=True, return_inverse=True)
        times = np.bincount(back, sign[rest], len(one)).astype(np.int64)
        one, times = one[times != 0], times[times != 0]
        return pa.table({
            "doc_id": np.concatenate((ids, doc[one])), "word": pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(due[one].view(np.int64))]),
            "times": np.concatenate((np.zeros(len(ids), np.int64), times)), "value": np.concatenate((sums, np.zeros(len(one)))),
        })

    return run


def _first_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of each text's first word, null without one, and its count of words."""
    for part in slices(batches):
        words, counts = [], []
        for _, texts in chunks(part.column("text").to_pylist()):
            found = Words(texts, lower=True)
            n = np.diff(found.bounds)
            first = np.append(found.hash, np.uint64(0))[found.bounds[:-1]].view(np.int64)
            words.append(pa.array(first, mask=n == 0))
            counts.append(n)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.concat_arrays(words), pa.array(np.concatenate(counts), pa.int64())], names=["doc_id", "word", "n_words"])


def stupid_backoff(docs: DataFrame, alpha: float = ALPHA, min_count: int = MIN_COUNT, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """Rows (doc_id, n_words, log_score, mean_log_score) for ``docs (doc_id, text)``."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    words = stage(texts.mapInArrow(_word_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # at most 2**FREQUENT_BITS words reach this count
    rows = words.where(F.col("n") * (1 << FREQUENT_BITS) >= total).toArrow()
    frequent = spark.sparkContext.broadcast(_Frequent(rows.column("word").to_numpy().view(np.uint64), rows.column("n").to_numpy()))
    buckets = max(1, -(-total // bucket_pairs))
    dealt = texts.mapInArrow(_deal(frequent, buckets), "bucket int, n bigint, n_v bigint, n_w bigint, n_docs bigint, packed binary")
    sums = stage(dealt.groupBy("bucket").applyInArrow(_score(frequent, total, alpha, min_count), "doc_id bigint, word bigint, times bigint, value double"), "sums")
    starts = stage(texts.mapInArrow(_first_words, "doc_id bigint, word bigint, n_words bigint"), "starts")
    # a row repeated so often counts in every sum as often
    copies = starts.groupBy("doc_id").agg(F.count("*").alias("copies"), F.max("n_words").alias("n_words"))
    due = sums.where("word is not null").groupBy("word", "doc_id").agg(F.sum("times").alias("times"))
    due = due.unionByName(starts.where("word is not null").select("word", "doc_id", F.lit(1).cast("bigint").alias("times")))
    rare = due.join(words, "word").select("doc_id", (F.col("times") * F.log("n")).alias("value"))
    first = starts.where("word is not null").select("doc_id", F.lit(-float(np.log(max(total, 1)))).alias("value"))
    all_sums = sums.where("word is null").select("doc_id", "value").unionByName(rare).unionByName(first)
    scores = all_sums.groupBy("doc_id").agg(F.sum("value").alias("value"))
    one = copies.join(scores, "doc_id", "left").select("doc_id", F.round(F.coalesce(F.col("value") / F.col("copies"), F.lit(0.0)), 6).alias("log_score"))
    out = starts.select("doc_id", "n_words").join(one, "doc_id")
    return out.select("doc_id", "n_words", "log_score", F.round(F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0), 6).alias("mean_log_score"))
