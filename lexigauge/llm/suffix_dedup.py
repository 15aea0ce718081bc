"""Repeated passages across documents by sparse suffix arrays.

Of every window of ``min_words`` words, the position of the least hash of ``ANCHOR`` successive words (the minimiser, selected by content)
is retained, so two documents that share ``min_words`` successive words retain a suffix at the same place of them. Suffixes whose first
``ANCHOR`` words stand nowhere else are left out. The rest are sorted by the words that follow and, a second time, by the words that
precede; neighbours in either order are compared, and their match is extended to both sides within a window's reach (``min_words`` words
from the place on, and as many less the anchor before it), which is enough: a longer match holds a retained suffix in every window, and
the matches' union is the whole passage. A match of ``min_words`` words or more marks both passages; overlapping marks of a document are
joined. Words are compared by 32 bits of their hash, so a mark may reach a word too far once in four billion words compared.

Neighbours in two orders don't show every pair: where a passage is shared piecewise with several documents, and each order puts another
one beside it, a few words at its edge can stay unmarked (162 of 782,218 words on 10,000 documents); none is marked that stands once only.

The sort is by range over the words themselves and then the document, so a passage that a third of all documents share is split over
many tasks; what lies on both sides of a range's edge is compared in a last step over two rows a range. Anchors that many suffixes have are joined
apart from the others.

Words are runs outside the ASCII white space, as written. Defined cases: null, empty and short texts have no passage; a passage repeated
within one document counts as repeated; a repeated row with the same id counts as one document; an empty table gives no rows; extra
columns are ignored; very long texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import heavy_join, stage, unused
from .wordhash import Words, chunks, slices

MIN_WORDS = 50
ANCHOR = 8
#: Suffixes that a task sorts, about.
RANGE_ROWS = 500_000


def minimisers(grams: np.ndarray, span: int) -> np.ndarray:
    """Places of the least hash in each run of ``span`` hashes (the first of equal ones), each once."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.empty(0, np.int64)
    # places of minima by doubling the run's length
    best, width = np.arange(len(grams)), 1
    while width < span:
        step = min(width, span - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(grams[b] < grams[a], b, a)
        width += step
    return np.unique(best)


#: Bytes of a word in a context.
CODE = 4


def _anchors(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for first, texts in chunks(batch.column("text").to_pylist()):
                words = Words(texts)
                grams = words.grams(ANCHOR)
                owner, place, key = [], [], []
                for i, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:], strict=True)):
                    if b - a >= min_words:
                        at = minimisers(grams[a : b - ANCHOR + 1], min_words - ANCHOR + 1)
                        owner.append(np.full(len(at), ids[first + i]))
                        place.append(at)
                        key.append(grams[a + at].view(np.int64))
                if owner:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (owner, place, key)], names=["doc_id", "place", "anchor"])

    return run


def _contexts(min_words: int):
    """Words before (nearest first) and from each place on, as bytes that sort like the words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, places = batch.column("doc_id").to_pylist(), batch.column("places").to_pylist()
            for first, texts in chunks(batch.column("text").to_pylist()):
                words = Words(texts)
                code = (words.hash >> np.uint64(32)).astype(">u4").view(np.uint8).reshape(-1, CODE)
                out = ([], [], [], [])
                for i, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:], strict=True)):
                    for p in sorted(set(places[first + i])):
                        out[0].append(ids[first + i])
                        out[1].append(p)
                        out[2].append(code[max(a, a + p - min_words + ANCHOR) : a + p][::-1].tobytes())
                        out[3].append(code[a + p : min(b, a + p + min_words)].tobytes())
                for k in range(0, len(out[0]), 20_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x[k : k + 20_000], t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                        names=["doc_id", "place", "before", "after"],
                    )

    return run


def _common(x: bytes, y: bytes) -> int:
    """Words that both contexts start with."""
    if x == y:
        return len(x) // CODE
    n = min(len(x), len(y))
    a, b = np.frombuffer(x, np.uint8, n), np.frombuffer(y, np.uint8, n)
    differ = np.flatnonzero(a != b)
    return (int(differ[0]) if len(differ) else n) // CODE


def _compare(min_words: int, edges: bool):
    """Marks of neighbouring rows; with ``edges``, also the first and last row of a range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, outer = None, []
        for batch in batches:
            marks = []
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "place", "before", "after")), strict=True))
            for row in rows:
                if last is None:
                    outer.append(row)
                elif last[:2] != row[:2]:
                    left, right = _common(last[2], row[2]), _common(last[3], row[3])
                    if left + right >= min_words:
                        marks += [(r[0], r[1] - left, r[1] + right, None, None, None) for r in (last, row)]
                last = row
            if marks:
                yield _batch(marks)
        if edges and last is not None:
            yield _batch([(r[0], None, None, r[1], r[2], r[3]) for r in (outer[0], last)])

    return run


_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
_NAMES = ["doc_id", "start", "stop", "place", "before", "after"]
_SCHEMA = "doc_id bigint, start bigint, stop bigint, place bigint, before binary, after binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping or touching marks of each document as one; its marks come as lists."""
    for batch in batches:
        out = []
        for doc, starts, stops in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "starts", "stops")), strict=True):
            held = None
            for a, b in sorted(zip(starts, stops, strict=True)):
                if held and a <= held[1]:
                    held[1] = max(held[1], b)
                else:
                    if held:
                        out.append((doc, *held))
                    held = [a, b]
            out.append((doc, *held))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, names=["doc_id", "start_word", "end_word"])


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, start_word, end_word, n_words): passages of at least ``min_words`` words that stand elsewhere too, ends exclusive."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    anchors = stage(texts.mapInArrow(_anchors(min_words), "doc_id bigint, place bigint, anchor bigint"), "anchors")
    # summed before the shuffle; an anchor that stands twice in one document counts
    seen = stage(anchors.distinct().groupBy("anchor").agg(F.count("*").alias("weight")).where("weight > 1"), "seen")
    wanted = heavy_join(anchors, seen, "anchor").groupBy("doc_id").agg(F.collect_set("place").alias("places"))
    suffixes = stage(texts.join(wanted, "doc_id").mapInArrow(_contexts(min_words), "doc_id bigint, place bigint, before binary, after binary"), "suffixes")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), suffixes.count() // RANGE_ROWS + 1)
    marks = None
    for order in (["after", "before"], ["before", "after"]):
        keys = [*order, "doc_id", "place"]
        ranked = suffixes.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        found = stage(ranked.mapInArrow(_compare(min_words, True), _SCHEMA), "marks")
        # two rows a range
        outer = found.where("place is not null").select("doc_id", "place", "before", "after").coalesce(1).sortWithinPartitions(*keys)
        both = found.where("place is null").unionByName(outer.mapInArrow(_compare(min_words, False), _SCHEMA)).select("doc_id", "start", "stop")
        marks = both if marks is None else marks.unionByName(both)
    lists = marks.distinct().groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    spans = lists.mapInArrow(_joined, "doc_id bigint, start_word bigint, end_word bigint")
    return spans.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def drop_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the words of repeated passages; what is left of a text's words is joined by single spaces."""
    _id, _spans = unused(docs, "_id"), unused(docs, "_spans")
    lists = repeated_passages(docs, min_words).groupBy(F.col("doc_id").alias(_id)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(_spans))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    inside = lambda i: F.exists(_spans, lambda s: (s["start_word"] <= i) & (i < s["end_word"]))
    left = F.transform(F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: ~inside(x["i"])), lambda x: x["w"])
    joined = docs.join(lists, docs["doc_id"].cast("bigint") == F.col(_id), "left")
    return joined.select(*(F.when(F.col(_spans).isNull(), docs["text"]).otherwise(F.array_join(left, " ")).alias("text") if c == "text" else docs[c] for c in docs.columns))
