"""Benchmark decontamination with SimHash over item-sized windows, all in DataFrame operations.

Fingerprints have 64 bits over the words of a window (ASCII lower case, ASCII punctuation off), each weighted by how often it stands there. A
document is compared with an item through windows of the item's length: every window of that length, wherever the item's words stand in it, that
covers a word shingle of the item is fingerprinted (a window without one has the similarity 0). All windows of all lengths would be over a billion
fingerprints on half a gigabyte, hence this placing; it asks for one shingle only and decides nothing.

Fingerprints of windows and of items of that length meet in multi-index Hamming blocks: 64 bits are cut into ``BLOCKS`` blocks, two fingerprints within
the radius differ in at most radius // BLOCKS bits of at least one block, and an item is listed under every value of a block with so few bits
changed, so all pairs within the radius are found and few others meet. Candidates are verified by the exact weighted Jaccard similarity of
their 5-word shingles (of shorter items: of the whole sequence), of which ``percent`` decides. Every matching window is a row, also those
shifted by a few words.

The corpus is read once for placing, for all shingle lengths; only what shares a shingle with the benchmark goes on, so what is shuffled grows with the
contamination. The items' shingles are broadcast if they are at most ``BROADCAST_ROWS``; beyond that both sides are shuffled. An item takes 697 index
rows a block at the radius of 15. Equal windows of many documents are fingerprinted, looked up and verified once.

Defined cases: null or empty text matches nothing; null or empty items are left out; equal items each match; a repeated row gets the same
result; empty tables match nothing; very long texts and items are taken whole; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import maybe_broadcast, release, stage, unused

SHINGLE = 5
RADIUS, BLOCKS = 15, 4
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Deleted from texts and items, so that marks glued to a passage's words don't hide it.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: Column) -> Column:
    """Words of a text: runs outside the ASCII white space, ASCII lower case without ASCII punctuation; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER + _MARKS, _LOWER), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _hashed(rows: DataFrame, keep: list[str]) -> DataFrame:
    return rows.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))


def _shingles(hashes: str, n: int) -> Column:
    """Hashes of the n-word shingles in order; none if there are fewer words."""
    starts = F.sequence(F.lit(0), F.size(hashes) - n)
    return F.when(F.size(hashes) >= n, F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(n)))))


def _blocks(blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """Shift and width of each block of 64 bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _changed(width: int, most: int) -> list[int]:
    """All masks of so many bits or fewer within a block."""
    return [sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(width), n)]


def simhash(words: DataFrame, key: str, most_words: int) -> DataFrame:
    """Rows (key, print): 64-bit SimHash of the bag of words of each key, from rows (key, h) of its words' hashes.

    Bits are summed several to a number, in lanes wide enough for ``most_words``.
    """
    lane = 16 if most_words < 1 << 16 else 32
    per = 64 // lane
    bit = lambda b: F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1))
    packed = lambda g: sum((F.shiftleft(bit(g * per + k), k * lane) for k in range(1, per)), bit(g * per))
    sums = words.groupBy(key).agg(F.count("*").alias("n"), *(F.sum(packed(g)).alias(f"s{g}") for g in range(64 // per)))
    value = F.lit(0).cast("bigint")
    for b in range(64):
        one = F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint")
        count = F.shiftrightunsigned(f"s{b // per}", b % per * lane).bitwiseAND(F.lit((1 << lane) - 1).cast("bigint"))
        value = value.bitwiseOR(F.when(count * 2 > F.col("n"), one).otherwise(F.lit(0).cast("bigint")))
    return sums.select(key, value.alias("print"))


def _similarity(x: str, y: str) -> tuple[Column, Column]:
    """Weighted shingles that two word sequences share, and those that either has; sequences under the shingle's length are one shingle."""
    each = lambda c: F.coalesce(_shingles(c, SHINGLE), F.array(F.xxhash64(c)))
    a, b = each(x), each(y)
    shared = F.array_intersect(a, b)
    count = lambda seq, h: F.size(F.filter(seq, lambda g: g == h))
    repeats = (F.size(F.array_distinct(a)) < F.size(a)) & (F.size(F.array_distinct(b)) < F.size(b))
    weighted = F.aggregate(shared, F.lit(0), lambda total, h: total + F.least(count(a, h), count(b, h)))
    both = F.when(repeats, weighted).otherwise(F.size(shared))
    return both, F.size(a) + F.size(b) - both


def matches(docs: DataFrame, benchmark: DataFrame, percent: int = 75, radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, item_id, start_word, n_words, hamming, similarity): windows of documents that repeat an item."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), words_of(F.col("text")).alias("words")).where("item_id is not null")
    items = stage(items.select("item_id", "words", F.size("words").alias("n")).where("n > 0"), "items")
    hashed = _hashed(items, ["item_id", "n"])
    sizes = sorted(r["s"] for r in items.select(F.least("n", F.lit(SHINGLE)).alias("s")).distinct().collect())  # SHINGLE values at most
    if not sizes:
        empty = "doc_id bigint, item_id bigint, start_word int, n_words int, hamming int, similarity double"
        return docs.sparkSession.createDataFrame([], empty)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), words_of(F.col("text")).alias("words")).where("doc_id is not null")
    source = _hashed(texts, ["doc_id"])
    listed = F.concat(*(F.transform(F.coalesce(_shingles("hashes", s), F.array().cast("array<bigint>")), lambda h, i: F.struct(F.lit(s).alias("s"), i.alias("place"), h.alias("shingle"))) for s in sizes))  # noqa: B023
    mine = [hashed.where(F.least("n", F.lit(SHINGLE)) == s).select("n", F.lit(s).alias("s"), F.explode(_shingles("hashes", s)).alias("shingle")) for s in sizes]
    lengths = mine[0]
    for more in mine[1:]:
        lengths = lengths.unionByName(more)
    # a window is placed once, whichever items of its length share its shingle
    lengths = maybe_broadcast(stage(lengths.distinct(), "lengths"), BROADCAST_ROWS)
    shared = source.select("doc_id", F.size("hashes").alias("size"), F.explode(listed).alias("x")).select("doc_id", "size", "x.*").join(lengths, ["s", "shingle"])
    starts = F.sequence(F.col("place") + F.col("s") - F.col("n"), "place")
    found = stage(shared.select("doc_id", "n", F.explode(starts).alias("start")).distinct(), "windows")
    hit = maybe_broadcast(found.select("doc_id").distinct(), BROADCAST_ROWS)
    held = source.join(hit, "doc_id", "left_semi").join(found, "doc_id")
    # windows at a text's ends are cut there
    first, end = F.greatest("start", F.lit(0)), F.least(F.col("start") + F.col("n"), F.size("hashes"))
    windows = held.select("doc_id", "start", "n", F.slice("hashes", first + 1, F.greatest(end - first, F.lit(0))).alias("hashes"))
    windows = stage(windows.select("doc_id", "start", "n", "hashes", F.xxhash64("n", "hashes").alias("k1"), F.xxhash64("hashes", "n").alias("k2")), "held")
    release(found)
    # equal windows of many documents are looked at once; their numbers are fixed once they are written
    kinds = stage(windows.groupBy("k1", "k2").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes")).withColumn("kind", F.monotonically_increasing_id()), "kinds")
    placed = stage(windows.select("doc_id", F.greatest("start", F.lit(0)).alias("start_word"), F.size("hashes").alias("n_words"), "k1", "k2").distinct(), "placed")
    release(windows)
    most = items.agg(F.max("n")).first()[0]
    prints = simhash(kinds.select("kind", F.explode("hashes").alias("h")), "kind", most).join(kinds.select("kind", "n"), "kind")
    item_prints = stage(simhash(hashed.select("item_id", F.explode("hashes").alias("h")), "item_id", most).join(items.select("item_id", "n"), "item_id"), "item_prints")
    value = lambda at, width: F.shiftrightunsigned("print", at).bitwiseAND(F.lit((1 << width) - 1))
    left = prints.select("*", F.posexplode(F.array(*(value(*b) for b in _blocks()))).alias("block", "value"))
    near = [F.transform(F.array(*(F.lit(m).cast("bigint") for m in _changed(b[1], radius // BLOCKS))), lambda m: value(*b).bitwiseXOR(m)) for b in _blocks()]  # noqa: B023
    right = item_prints.select("*", F.posexplode(F.array(*near)).alias("block", "values")).select("item_id", "n", F.col("print").alias("item_print"), "block", F.explode("values").alias("value"))
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    # the list of values grows with the benchmark: never broadcast
    near = left.join(right.hint("merge"), ["n", "block", "value"]).where(distance <= radius).select("kind", "item_id", distance.alias("hamming")).distinct()
    pairs = near.join(kinds.select("kind", "k1", "k2", "hashes"), "kind").join(maybe_broadcast(hashed.select("item_id", F.col("hashes").alias("item_hashes")), BROADCAST_ROWS), "item_id")
    both, either = _similarity("hashes", "item_hashes")
    held = pairs.select("k1", "k2", "item_id", "hamming", both.alias("both"), either.alias("either"))
    good = held.where(F.col("both") * 100 >= F.col("either") * percent).select("k1", "k2", "item_id", "hamming", (F.col("both") / F.col("either")).alias("similarity"))
    good = stage(good, "good")
    release(kinds, item_prints)
    return placed.join(good, ["k1", "k2"]).select("doc_id", "item_id", "start_word", "n_words", "hamming", "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` in which no window repeats an item."""
    name = unused(docs, "_bad")
    bad = maybe_broadcast(stage(matches(docs, benchmark, percent, radius).select(F.col("doc_id").alias(name)).distinct(), "bad"), BROADCAST_ROWS)
    return docs.join(bad, docs["doc_id"].cast("bigint") == F.col(name), "left_anti")
