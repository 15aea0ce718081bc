"""Near-duplicate documents by SetSketch: mergeable register sketches, banded, estimated by likelihood, verified.

A document's set holds its distinct 5-word shingles (ASCII lower case; with fewer words, the whole
sequence). Equal sets form a class, numbered when it is staged, and only classes go on, so an id may have several texts. Every register of a sketch is
an exponentially spaced truncated minimum: over the shingles the least of an exponential variate is
taken, and its logarithm to base 1.001 is cut to whole steps; the sketch of a union is the register-wise
maximum. Registers agree with about the Jaccard similarity, so bands of five registers meet for
similar sets: at the threshold a link escapes all 48 bands with probability (1 - 0.75**5)**48 = 2e-6.

Pairs come from bands without listing a band's pairs: members are held against the band's smallest id and its
largest, and the components are closed. Members of bands that still span several components are then joined exactly, by
the rarest of their shingles (two sets over the threshold share one of as many as may be missing and one more), so that no
link is lost, and a passage common to many of them makes no pairs.
Each pair is estimated by maximum likelihood over the registers (far below the threshold it goes), then
confirmed on the full sets.

Defined cases: null or empty text, or one of white space only, has an empty set, is linked with nothing and is
kept; equal texts are linked; a repeated row (same id, same text) gets the same result again; extra columns
of the input are ignored, whatever their names; very long texts are taken whole; an id with several texts has a row and links for each (``keep_one``
keeps all its rows if one is kept); a row without an id is kept; an empty table gives no rows. Components don't depend on the
order in which equal candidates come.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, heavy_join, release, stage, unused
from .wordhash import Words, chunks, mix, sequence_hash

BASE, RATE, TOP = 1.001, 20.0, 65534
BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
#: A pair whose estimated similarity is this far below the threshold isn't verified: over six standard errors.
MARGIN = 0.19

_RNG = np.random.Generator(np.random.PCG64(77))
_XOR = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_MUL = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_BAND_SLOT = _RNG.integers(0, 2**64, ROWS, dtype=np.uint64) | np.uint64(1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """Sketch of a non-empty set of 64-bit hashes: uint16 registers, larger for a smaller minimum."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), 256):
        block = short[i : i + 256, None] ^ _XOR
        block *= _MUL
        np.minimum(low, block.min(axis=0), out=low)
    exponential = -np.log1p(-(low.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)) + TOP // 2, 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    rows = sketch.reshape(BANDS, ROWS).astype(np.uint64)
    return mix((rows + np.uint64(1)) @ _BAND_SLOT + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, run in chunks(texts):
        words = Words(run, lower=True)
        grams = words.grams(5)
        for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
            if b - a >= 5:
                yield np.unique(grams[a : b - 4])
            elif b > a:
                yield sequence_hash(words.hash[a:b])[None]
            else:
                yield np.empty(0, np.uint64)


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (rows of a and b) with known set sizes."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - above - below
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    step = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def fit(j):
        p, q = np.maximum(step(u - v * j), 1e-12), np.maximum(step(v - u * j), 1e-12)
        return above * np.log(p) + below * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        left = fit(low + third) < fit(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sizes, keys, sketches, bands = [], [], [], []
            for found in shingle_sets(part.column("text").to_pylist()):
                sizes.append(len(found))
                keys.append(blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sketch = registers(found) if len(found) else None
                sketches.append(None if sketch is None else sketch.tobytes())
                bands.append(None if sketch is None else band_keys(sketch))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "sketch", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sets = [x.tobytes() for x in shingle_sets(part.column("text").to_pylist())]
            own = [blake2b(x, digest_size=16).digest() == k for x, k in zip(sets, part.column("set_key").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(sets, pa.binary())], names=["rep", "shingles"]).filter(pa.array(own, pa.bool_()))


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            found = [np.frombuffer(x, np.int64) for x in part.column("shingles").to_pylist()]
            counts = [len(x) for x in found]
            columns = [np.repeat(part.column("rep").to_numpy(), counts), np.repeat(counts, counts), np.concatenate(found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rep", "n", "shingle"])


def _plausible(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                a, b = (np.stack([np.frombuffer(x, np.uint16) for x in part.column(c).to_pylist()]) for c in ("sketch_a", "sketch_b"))
                n_a, n_b = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
                keep = pa.array(likely_similarity(a, b, n_a, n_b) >= least)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(keep)

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keep = []
                for x, y in zip(part.column("set_a").to_pylist(), part.column("set_b").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept) for every row of ``docs (doc_id, text)``."""
    sketched = stage(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
            _sketched, "doc_id bigint, n_shingles bigint, set_key binary, sketch binary, bands array<bigint>"
        ),
        "sketches",
    )
    full = sketched.where("n_shingles > 0")
    # numbers of classes are fixed once they are written
    classes = full.groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("weight"), F.first(F.struct("n_shingles", "sketch", "bands")).alias("s"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("rep"), "set_key", "first_id", "weight", "s.*"), "classes")
    base = stage(sketched.select("doc_id", "n_shingles", "set_key"), "base")
    release(sketched)
    reps = classes.where("first_id is not null")
    spread = reps.select("rep", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    members = stage(spread.join(shared, "band"), "members")
    wanted = reps.join(members.select("rep").distinct(), "rep", "left_semi").select(F.col("first_id").alias("doc_id"), "rep", "set_key")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stage(texts.join(wanted, "doc_id").select("rep", "set_key", "text").mapInArrow(_sets, "rep bigint, shingles binary"), "sets")
    counts = sets.agg(F.count("*").alias("n"), F.count_distinct("rep").alias("d")).first()
    if counts["n"] > counts["d"]:  # repeated rows
        sets = stage(sets.dropDuplicates(["rep"]), "sets")
    sketches = reps.select("rep", "sketch", "n_shingles")

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda x, r: x.select(*(F.col(c).alias(n) for c, n in r.items()))
        near = (
            pairs.join(side(sketches, {"rep": "a", "sketch": "sketch_a", "n_shingles": "n_a"}), "a")
            .join(side(sketches, {"rep": "b", "sketch": "sketch_b", "n_shingles": "n_b"}), "b")
            .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
            .mapInArrow(_plausible(percent / 100 - MARGIN), "a bigint, b bigint")
        )
        near = stage(near, "near")  # sketches first: most pairs go before sets are read
        held = near.join(side(sets, {"rep": "a", "shingles": "set_a"}), "a").join(side(sets, {"rep": "b", "shingles": "set_b"}), "b")
        return stage(held.mapInArrow(_verified(percent), "a bigint, b bigint"), "links")

    pairs = stage(
        members.where("rep > low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
        .unionByName(members.where("rep < high").select(F.col("high").alias("a"), F.col("rep").alias("b")))
        .distinct(),
        "pairs",
    )
    links = confirmed(pairs)
    closed = components(links)
    # members of bands that still span several components, with their component so far
    named = members.select("rep", "band").join(closed.withColumnRenamed("id", "rep"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("part"))
    split = named.groupBy("band").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count("*").alias("n")).where("least < most and n > 2").select("band")
    left = stage(named.join(split, "band").select("rep", "part").distinct(), "open")
    # an exact join of them: two sets over the threshold share one of their rarest shingles, as many as may be missing and one more
    rows = sets.join(left.select("rep"), "rep", "left_semi").mapInArrow(_exploded, "rep bigint, n bigint, shingle bigint")
    rows = stage(rows.distinct(), "open_sets")
    common = rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    # shingles that only one member has are its rarest, and match nothing
    held = rows.join(common, "shingle").withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("df", "shingle")) + F.col("n") - F.count("*").over(Window.partitionBy("rep")))
    prefix = held.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).join(left, "rep").select("shingle", "rep", "part", "n", (F.col("n") - F.col("place") + 1).alias("ahead"))
    other = prefix.select("shingle", F.col("rep").alias("b"), F.col("part").alias("part_b"), F.col("n").alias("n_b"), F.col("ahead").alias("ahead_b"))
    # from their first common shingle on, enough are left for the overlap that the threshold asks for
    alike = F.least("ahead", "ahead_b") * (100 + percent) >= (F.col("n") + F.col("n_b")) * percent
    rest = prefix.join(other, "shingle").where((F.col("rep") > F.col("b")) & (F.col("part") != F.col("part_b")) & alike)
    more = confirmed(rest.select(F.col("rep").alias("a"), "b").distinct().join(pairs, ["a", "b"], "left_anti"))
    if more.limit(1).count():
        closed = components(links.unionByName(more))
    named = classes.select("rep", "set_key", "first_id", "weight").join(closed.withColumnRenamed("id", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
    least = named.groupBy("part").agg(F.min("first_id").alias("component_id"), F.count("*").alias("weight"))
    named = stage(heavy_join(named.select("set_key", "part", F.col("weight").alias("copies")), least, "part").select("set_key", "component_id", F.col("copies").alias("weight")), "named")
    release(classes, members, sets, pairs, left, rows)
    out = heavy_join(base.select("doc_id", "n_shingles", "set_key"), named, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of one document of each near-duplicate group, the one with the smallest id."""
    name = unused(docs, "kept_id")
    kept = near_duplicates(docs, percent).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, docs["doc_id"].cast("bigint").eqNullSafe(F.col(name)), "left_semi")
