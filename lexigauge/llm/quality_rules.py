"""Quality rules: base counts of a text, and two calibrated logistic regressions over hashed word and character n-grams.

The models, one for quality and one for toxicity, are trained on labelled rows: hashed word unigrams and bigrams
(runs of letters, digits and non-ASCII characters, ASCII lower case) and character trigrams, as they are present in a text or not.
Of these, the n-grams stay whose presence goes with the label far beyond chance (G-test; no other bound); their weights come from
ridge-penalised logistic regression, and Platt scaling of cross-fitted scores makes probabilities of them. Texts are scored
in Arrow batches against fixed thresholds.

Training reads at most ``max_labelled`` labelled documents (in the order of a hash of the id), a documented bound; everything else
covers whole tables and whole texts. The fit runs in one task on an executor, in memory that grows with the sample.

Defined cases: null or empty text has no words and so fails the base rules; very long texts are taken whole; a label that is null is left out of its model, and of
several labels for a document the lowest quality and highest toxicity count; without labelled rows, or with one class
only, a model gives one probability to all (the class rate) and rejects nothing; repeated rows get the same result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import SEPARATOR, Words, chunks, mix, slices

MAX_LABELLED = 4000
#: Significance of an n-gram: its G statistic must reach this (chance: under one in ten million). Nothing else bounds the n-grams.
LEAST_G = 30.0
#: Toxic words are rare: for toxicity a lower G counts (chance: under one in a hundred thousand).
TOXIC_LEAST_G = 20.0
#: Chosen on held-out folds of sf0.1, figures in the README.
QUALITY_THRESHOLD, TOXIC_THRESHOLD = 0.2, 0.2
SYMBOLS = "#*$%&|<>"

#: Separators of n-gram words: all ASCII but letters and digits.
_PLAIN = np.zeros(256, bool)
_PLAIN[:128] = [not chr(i).isalnum() for i in range(128)]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80
_FILTER_BITS = 20


def _sum_between(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[end] - total[start]


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    words = Words(texts)
    first, last = words.bounds[:-1], words.bounds[1:]
    n_words = last - first
    spans = lambda flags: _sum_between(flags, words.text_start, words.text_end)
    dup = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
        dup[i] = len(lines) - len(set(lines))
    grams = words.grams(5)
    owner = np.repeat(np.arange(len(texts)), n_words)[: len(grams)]
    place = np.arange(len(grams))
    own = place + 5 <= last[owner] if len(grams) else np.zeros(0, bool)
    place, owner = place[own], owner[own]
    keys = grams[own] ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1] if len(ranked) else np.zeros(0, bool)
    twice = place[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]] if len(ranked) else place
    cover = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 5, -1)
    covered = np.cumsum(cover)[:-1] > 0
    return {
        "n_words": n_words,
        "word_chars": spans(_LEAD[words.blob] & ~SEPARATOR[words.blob]),
        "n_symbols": spans(_SYMBOL[words.blob]),
        "n_dup_lines": dup,
        "n_repeat_words": _sum_between(covered, first, last),
    }


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word and character n-grams of some texts, and the text of each."""
    words = Words(texts, lower=True, separator=_PLAIN)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    pairs = words.grams(2)
    inner = owner[1:] == owner[:-1]
    codes = np.frombuffer("\n".join([*(t.decode() for t in texts), ""]).encode("utf-32-le"), np.uint32)
    counts = np.fromiter((len(t.decode()) + 1 for t in texts), np.int64, len(texts))
    of_char = np.repeat(np.arange(len(texts)), counts)
    a = codes.astype(np.uint64)
    three = ((a[:-2] << np.uint64(42)) | (a[1:-1] << np.uint64(21)) | a[2:]) * np.uint64(0x9E3779B97F4A7C15) if len(a) > 2 else a[:0]
    three ^= three >> np.uint64(29)
    within = of_char[:-2] == of_char[2:] if len(a) > 2 else np.zeros(0, bool)
    return np.concatenate((words.hash, pairs[inner], three[within])), np.concatenate((owner, owner[:-1][inner], of_char[:-2][within]))


class Model:
    """Weights of hashed n-grams, a bias, and Platt scaling."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float, slope: float, offset: float, rejects: bool):
        order = np.argsort(hashes)
        self.hashes, self.weights, self.bias, self.slope, self.offset, self.rejects = hashes[order], weights[order], bias, slope, offset, rejects
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def probability(self, grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        score = np.full(n, self.bias)
        if len(self.hashes):
            hit = self.maybe[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
            grams, owner = grams[hit], owner[hit]
            at = np.minimum(np.searchsorted(self.hashes, grams), len(self.hashes) - 1)
            known = self.hashes[at] == grams
            seen = np.unique(owner[known].astype(np.int64) * len(self.hashes) + at[known])
            np.add.at(score, seen // len(self.hashes), self.weights[seen % len(self.hashes)])
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -60, 60)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 300) -> np.ndarray:
    """Ridge-penalised logistic regression by accelerated gradient steps; the last column is the bias, which isn't penalised."""
    v = np.ones(x.shape[1], np.float32)
    for _ in range(15):
        v = x.T @ (x @ (v / np.linalg.norm(v)))
    rate = np.float32(1 / (0.25 * np.linalg.norm(v) + ridge))
    penalty = np.full(x.shape[1], ridge, np.float32)
    penalty[-1] = 0
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -60, 60)))
        new = ahead - rate * (x.T @ (p - y) + penalty * ahead)
        step, ahead, w = float(np.abs(new - w).max()), new + np.float32(k / (k + 3)) * (new - w), new
        if step < 1e-4:
            break
    return w.astype(float)


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make probabilities of scores, with Platt's smoothed targets."""
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -60, 60)))
        g, w = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * score * score).sum() + 1e-6, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-6]])
        d = np.linalg.solve(h, [(g * score).sum() + 1e-6 * (a - 1), g.sum()])
        a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -1, 1)
    return max(float(a), 1e-3), float(b)


class Sample:
    """N-grams of labelled texts that stand in two texts or more (no other can be significant), as numbers into ``hashes``, and the text of each.

    Made from the concatenated distinct hashes of the texts and how many each has.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        ranked = np.sort(grams)
        again = ranked[1:] == ranked[:-1]
        self.hashes = np.unique(ranked[1:][again])
        ids, owners = [], []
        ends = np.cumsum(counts)
        for at in range(0, len(grams), 1 << 18):  # few numbers at a time
            part = grams[at : at + (1 << 18)]
            place = np.searchsorted(self.hashes, part)
            known = np.flatnonzero((place < len(self.hashes)) & (self.hashes[np.minimum(place, max(len(self.hashes) - 1, 0))] == part)) if len(self.hashes) else np.empty(0, np.int64)
            ids.append(place[known].astype(np.int32))
            owners.append(np.searchsorted(ends, at + known, side="right").astype(np.int32))
        self.ids, self.owner, self.n = np.concatenate([np.empty(0, np.int32), *ids]), np.concatenate([np.empty(0, np.int32), *owners]), len(counts)

    def significant(self, y: np.ndarray, rows: np.ndarray, least_g: float) -> np.ndarray:
        """Numbers of the n-grams that go with y in the chosen rows, by the G statistic of their presence."""
        a, b = (np.bincount(self.ids[(rows & (y == side))[self.owner]], minlength=len(self.hashes)).astype(float) for side in (1, 0))
        n1, n0 = float((rows & (y == 1)).sum()), float((rows & (y == 0)).sum())
        rate = (a + b) / (n1 + n0)
        part = lambda seen, want: np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(want, 1e-9)), 0)
        g = 2 * (part(a, n1 * rate) + part(n1 - a, n1 * (1 - rate)) + part(b, n0 * rate) + part(n0 - b, n0 * (1 - rate)))
        return np.flatnonzero(g >= least_g)

    def matrix(self, rows: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Presence of the features in the chosen rows, and a column of ones."""
        column = np.full(len(self.hashes), -1, np.int32)
        column[features] = np.arange(len(features))
        x = np.zeros((int(rows.sum()), len(features) + 1), np.float32)
        x[:, -1] = 1
        hit = np.flatnonzero((column[self.ids] >= 0) & rows[self.owner])
        x[(np.cumsum(rows) - 1)[self.owner[hit]], column[self.ids[hit]]] = 1
        return x


def fit(sample: Sample, y: np.ndarray, labelled: np.ndarray, folds: int = 5, least_g: float = LEAST_G) -> Model:
    """A calibrated model of y from the labelled rows of a sample."""
    own = y[labelled]
    if not len(own) or own.min() == own.max():
        rate = float(own.mean()) if len(own) else 0.5
        return Model(np.empty(0, np.uint64), np.empty(0), 0.0, 1.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))), False)

    def trained(rows: np.ndarray):
        if not 0 < y[rows].sum() < rows.sum():
            return None
        features = sample.significant(y, rows, least_g)
        return features, _logistic(sample.matrix(rows, features), y[rows].astype(np.float32))

    fold = np.cumsum(labelled) % folds
    scores, targets = [], []
    for k in range(folds):
        got = trained(labelled & (fold != k))
        held = labelled & (fold == k)
        if got and held.any():
            scores.append(sample.matrix(held, got[0]) @ got[1])
            targets.append(y[held])
    features, w = trained(labelled)
    slope, offset = _platt(np.concatenate(scores), np.concatenate(targets)) if scores else (1.0, 0.0)
    return Model(sample.hashes[features], w[:-1], float(w[-1]), slope, offset, True)


def labelled_grams(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Rows (id, quality, toxic, grams) of at most so many labelled documents: distinct n-gram hashes of whole texts."""
    chosen = (
        labels.where("doc_id is not null and (quality is not null or toxic is not null)")
        .groupBy(F.col("doc_id").cast("bigint").alias("id"))
        .agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_labelled)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for _, texts in chunks(batch.column("text").to_pylist()):
                grams, owner = _grams(texts)
                cut = np.argsort(owner, kind="stable")
                found += [np.unique(x).tobytes() for x in np.split(grams[cut], np.searchsorted(owner[cut], np.arange(1, len(texts))))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "quality", "toxic")), pa.array(found, pa.binary())], names=["id", "quality", "toxic", "grams"])

    # the sample has at most max_labelled rows of three numbers
    joined = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "id")
    return joined.mapInArrow(run, "id bigint, quality int, toxic int, grams binary")


def _fitted(group: pa.Table) -> pa.Table:
    """Both models of the labelled rows, as rows; the sample's bound holds for this task."""
    group = group.sort_by([("id", "ascending"), ("grams", "ascending")])
    grams = pa.concat_arrays(group.column("grams").chunks)
    edges = np.frombuffer(grams.buffers()[1], np.int32)[grams.offset : grams.offset + len(grams) + 1]
    data = np.frombuffer(grams.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]].view(np.uint64)
    sample = Sample(data, np.diff(edges) // 8)
    out = []
    for name, least_g in (("quality", LEAST_G), ("toxic", TOXIC_LEAST_G)):
        value = np.array([-1 if v is None else int(v > 0) for v in group.column(name).to_pylist()])
        model = fit(sample, value, value >= 0, least_g=least_g)
        out.append((name, model.hashes.tobytes(), model.weights.astype(np.float64).tobytes(), model.bias, model.slope, model.offset, model.rejects))
    return pa.table(dict(zip(("label", "hashes", "weights", "bias", "slope", "shift", "rejects"), zip(*out, strict=True), strict=True)))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[Model, Model]:
    """Models of quality and of toxicity, fitted in one task on the bounded sample; only their weights come to the driver."""
    schema = "label string, hashes binary, weights binary, bias double, slope double, shift double, rejects boolean"
    rows = labelled_grams(docs, labels, max_labelled).groupBy(F.lit(0).alias("all")).applyInArrow(_fitted, schema).collect()
    if not rows:
        none = Sample(np.empty(0, np.uint64), np.empty(0, np.int64))
        return fit(none, np.empty(0), np.empty(0, bool)), fit(none, np.empty(0), np.empty(0, bool))
    quality, toxic = (Model(np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["weights"]), r["bias"], r["slope"], r["shift"], r["rejects"]) for r in sorted(rows, key=lambda r: r["label"]))
    return quality, toxic


_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def score(docs: DataFrame, models: tuple[Model, Model], quality_threshold: float = QUALITY_THRESHOLD, toxic_threshold: float = TOXIC_THRESHOLD) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_quality, p_toxic, kept)."""
    quality, toxic = models

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = []
            for _, texts in chunks(batch.column("text").to_pylist()):
                base = base_counts(texts)
                failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
                grams, owner = _grams(texts)
                good, bad = (m.probability(grams, owner, len(texts)) for m in (quality, toxic))
                kept = ~failed & ((good >= quality_threshold) | (not quality.rejects)) & ((bad < toxic_threshold) | (not toxic.rejects))
                parts.append([*(base[c] for c in _COLUMNS), failed, good, bad, kept])
            columns = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)] if parts else []
            if columns:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *_COLUMNS, "base_failed", "p_quality", "p_toxic", "kept"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in _COLUMNS) + ", base_failed boolean, p_quality double, p_toxic double, kept boolean")


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Train on the labelled rows and score every document."""
    return score(docs, train(docs, labels, max_labelled))


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that pass; the verdict is computed beside each row, without a join."""
    models = train(docs, labels, max_labelled)
    quality, toxic = models
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            masks = []
            for _, texts in chunks(batch.column("text").to_pylist()):
                base = base_counts(texts)
                failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
                grams, owner = _grams(texts)
                good, bad = (m.probability(grams, owner, len(texts)) for m in models)
                masks.append(~failed & ((good >= QUALITY_THRESHOLD) | (not quality.rejects)) & ((bad < TOXIC_THRESHOLD) | (not toxic.rejects)))
            if masks:
                yield batch.filter(pa.array(np.concatenate(masks)))

    return docs.mapInArrow(run, schema)
