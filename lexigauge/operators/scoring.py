"""Scores of models against ground truth, over a grid of segmentations and levels.

A row's blocks are split, aligned, normalised and measured within the row, in Arrow batches, so the only shuffle is the
sum per (seg_mode, level, model), of which a batch gives one row each where sums are all that is asked for. Counts stay integers until the
last division.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain, islice, zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import plain
from ..functions.edit import MAX_CELLS, count_ops, distance, together
from ..functions.normalize import LEVELS, normalize
from ..functions.segment import SEG_MODES, split_blocks

KEYS = ["seg_mode", "level", "model"]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def base_length(text: Column, mode: str) -> Column:
    """Characters of a text's blocks at P0: the denominator that stays the same at all levels."""
    return _total(F.transform(split_blocks(text, mode), lambda b: F.char_length(normalize(b, "P0")).cast("bigint")))


def with_predictions(samples: DataFrame, predictions: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Every sample with every model's text; what a model lacks is empty, so all of it counts as deleted."""
    models = predictions.select("model").distinct() if models is None else models
    grid = samples.crossJoin(F.broadcast(models))  # models: one row each, a handful
    return grid.join(predictions, ["model", "sample_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def spread(rows: DataFrame, each: int = 1) -> DataFrame:
    """Rows dealt over the cluster's cores where the input has fewer partitions than ``each`` for a core; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * cores) if rows.rdd.getNumPartitions() < each * cores else rows


#: Rows scored at once in a task.
SLICE_ROWS = 1024


def _overflow(r: plain.Blocks, h: plain.Blocks) -> int:
    """1 where blocks side by side have more cells than the guard allows, else 0."""
    if r.longest * h.longest <= MAX_CELLS:
        return 0
    return int(any(a * b > MAX_CELLS for a, b in zip(r.sizes, h.sizes, strict=False)))


def differing(r: Sequence[str], h: Sequence[str]) -> list[tuple[str, str]]:
    """Blocks side by side that differ."""
    return [] if r is h else [x for x in zip(r, h, strict=False) if x[0] != x[1]]


class _Grid:
    """Scores of one text after the other in every segmentation and at every level; what belongs to a ref is kept for the texts after it."""

    def __init__(self, modes: Sequence[str], levels: Sequence[str], pairs: dict[str, str], guard: bool, ops: bool):
        self.modes, self.levels, self.rules, self.guard, self.ops = modes, [k for k, level in enumerate(LEVELS) if level in levels], plain.rules(pairs), guard, ops
        self.order = sorted(range(len(modes)), key=lambda i: modes[i] != "para")
        self.ref, self.sides, self.own = None, None, None

    def cells(self, ref: str | None, text: str | None) -> list[tuple[int, ...]]:
        """For each segmentation and level: fixed_len, ref_len, overflow, dist, and S, D and I where they are asked for."""
        if self.sides is None or ref != self.ref:
            self.ref, self.sides, self.own = ref, plain.splits(ref, self.modes, self.rules), None
        if text != ref:
            return self.scored(plain.splits(text, self.modes, self.rules, self.sides))
        if self.own is None:
            self.own = self.scored(self.sides)
        return self.own

    def scored(self, sides: list[plain.Split]) -> list[tuple[int, ...]]:
        """Cells of a text that is split already, against the ref's."""
        known: dict[tuple[str, str], tuple[int, ...]] = {}
        done: dict[tuple[int, int], list] = {}
        settled: dict[int, Sequence[int]] = {}
        # paragraphs first: what settles all of them settles the blocks that are made of them
        for at in self.order:
            r, h = self.sides[at], sides[at]
            key = id(r.levels), id(h.levels)
            if key not in done:
                done[key] = self.measured(r, h, known, settled, self.modes[at] == "para")
        return [c for r, h in zip(self.sides, sides, strict=True) for c in done[id(r.levels), id(h.levels)]]

    def far(self, ref: str | None, text: str | None) -> Iterator[tuple[int]]:
        """For each segmentation and level: overflow alone, which takes lengths only."""
        sides = plain.splits(ref, self.modes, self.rules) if self.sides is None or ref != self.ref else self.sides
        self.ref, self.sides = ref, sides
        for r, h in zip(sides, sides if text == ref else plain.splits(text, self.modes, self.rules, sides), strict=True):
            yield from ((_overflow(r.levels[k], h.levels[k]),) for k in self.levels)

    def measured(self, ref: plain.Split, hyp: plain.Split, known: dict, settled: dict[int, Sequence[int]], first: bool) -> list[tuple[int, ...]]:
        rs, hs = ref.levels, hyp.levels
        out, fixed, before, alike = [], rs[0].total, None, ref.spans == hyp.spans
        for k in self.levels:
            r, h = rs[k], hs[k]
            if before is not None and r is rs[before] and h is hs[before]:
                out.append(out[-1])
                if first and before in settled:
                    settled[k] = settled[before]
            else:
                n, m = r.total, h.total
                swaps, pairs = False, None
                if self.ops:
                    far, pairs = self.over(r, h)
                else:
                    far = _overflow(r, h)
                if r is h:
                    sums = [0] * (4 if self.ops else 1)
                elif not k and rs[1] is hs[1] and (rs[1] is r and hyp.spaced or hs[1] is h and ref.spaced) and first:
                    # one side is the other with runs of spaces as single ones
                    sums = [abs(n - m), 0, max(0, n - m), max(0, m - n)][: 4 if self.ops else 1]
                elif not first and alike and k in settled and k < 5 and (k or ref.even and hyp.even) and not (far and self.guard and settled[k][1]):
                    sums = settled[k][0]
                elif before and k < 5 and self.stays(rs[before], hs[before], r, h, out[-1][3]):
                    sums = out[-1][3:]
                else:
                    if before and k < 5 and known:
                        self.mapped(rs[before], hs[before], r, h, known)
                    sums, swaps = self.summed(r, h, differing(r, h) if pairs is None else pairs, known)
                if first and alike and (swaps or sums[0] == abs(n - m)):
                    settled[k] = sums, swaps
                out.append((fixed, n, far, *sums))
            before = k
        return out

    def over(self, r: plain.Blocks, h: plain.Blocks) -> tuple[int, list[tuple[str, str]]]:
        """Whether blocks side by side that differ go beyond the guard, and those."""
        pairs = differing(r, h)
        r, h = zip(*pairs, strict=True) if pairs else ((), ())
        return _overflow(plain.Blocks(r), plain.Blocks(h)), pairs

    def stays(self, r0: plain.Blocks, h0: plain.Blocks, r: plain.Blocks, h: plain.Blocks, dist: int) -> bool:
        """Whether blocks are all as far apart as their lengths differ, and as long as before: then they stay so where P2 to P4 map single
        characters, which brings no text further from another."""
        if r0.sizes != r.sizes or h0.sizes != h.sizes:
            return False
        # no distances of blocks add up to less than the lengths of all differ
        return dist == abs(r.total - h.total) or dist == sum(abs(a - b) for a, b in zip_longest(r.sizes, h.sizes, fillvalue=0))

    def mapped(self, r0: list[str], h0: list[str], r: list[str], h: list[str], known: dict) -> None:
        """As ``stays``, for the pairs whose distance is kept."""
        for pair, now in zip(zip(r0, h0, strict=False), zip(r, h, strict=False), strict=True):
            n, m = map(len, pair)
            if pair in known and known[pair][0] == abs(n - m) and (n, m) == (len(now[0]), len(now[1])):
                known[now] = known[pair]

    def summed(self, r: plain.Blocks, h: plain.Blocks, pairs: list[tuple[str, str]], known: dict) -> tuple[list[int], bool]:
        """dist, or dist, S, D and I, of the blocks, and whether a bound on all of them allows substitutions only; ``pairs`` are those that differ."""
        drops, adds = sum(r.sizes[len(h) :]), sum(h.sizes[len(r) :])
        if self.guard:
            near = []
            for a, b in pairs:
                n, m = len(a), len(b)
                if n * m > MAX_CELLS:
                    drops, adds = drops + max(0, n - m), adds + max(0, m - n)
                else:
                    near.append((a, b))
            pairs = near
        found = together(pairs) if len(r) == len(h) and pairs and all(len(a) == len(b) for a, b in pairs) else None
        swaps = bool(found)
        own, n = [drops + adds, 0, drops, adds], 4 if self.ops else 1
        return [a + b for a, b in zip(own[:n], found or self.apart(pairs, known), strict=False)], swaps

    def apart(self, pairs: list[tuple[str, str]], known: dict) -> Sequence[int]:
        """Pairs of one length apart from the others; what no bound on all of them settles is halved, down to single pairs."""
        n = 4 if self.ops else 1
        if not pairs:
            return [0] * n
        if len(pairs) == 1:
            pair = pairs[0]
            if pair not in known:
                known[pair] = count_ops(*pair)[:4] if self.ops else (distance(*pair),)
            return known[pair]
        alike = [p for p in pairs if len(p[0]) == len(p[1])]
        if alike and len(alike) < len(pairs):
            parts = alike, [p for p in pairs if len(p[0]) != len(p[1])]
        else:
            found = together(pairs)
            if found:
                return found[:n]
            parts = pairs[: len(pairs) // 2], pairs[len(pairs) // 2 :]
        return [a + b for a, b in zip(*(self.apart(p, known) for p in parts), strict=True)]


def _known_modes(seg_modes: Sequence[str]) -> list[str]:
    for mode in seg_modes:
        if mode not in SEG_MODES:
            raise ValueError(f"unknown segmentation {mode!r}")
    return list(seg_modes)


def _scored(texts: DataFrame, seg_modes: Sequence[str], levels: Sequence[str], pairs: dict[str, str] | None, guard: bool, ops: bool, dist: bool = True) -> DataFrame:
    """Columns of ``texts`` but ref and text, and seg_mode, level, fixed_len, ref_len, overflow, dist, and S, D and I if asked for; a row per cell of the grid.

    Without ``dist``, overflow is all that is found.
    """
    keep = [c for c in texts.columns if c not in ("ref", "text")]
    counts = (["fixed_len", "ref_len", "overflow", "dist"] + ["S", "D", "I"] * ops) if dist else ["overflow"]
    modes, at = _known_modes(seg_modes), [level for level in LEVELS if level in levels]
    names = [*keep, "seg_mode", "level", *counts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, n = _Grid(modes, at, pairs or {}, guard, ops), len(modes) * len(at)
        cells = grid.cells if dist else grid.far
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                rows = [c for ref, text in zip(part.column("ref").to_pylist(), part.column("text").to_pylist(), strict=True) for c in cells(ref, text)]
                if not rows:
                    continue
                place = np.arange(part.num_rows * n)
                own = part.select(keep).take(pa.array(place // n)).columns
                named = [pa.array(modes).take(pa.array(place // len(at) % len(modes))), pa.array(at).take(pa.array(place % len(at)))]
                found = [pa.array(x, pa.int32() if c == "overflow" else pa.int64()) for c, x in zip(counts, zip(*rows, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([*own, *named, *found], names)

    schema = T.StructType([texts.schema[c] for c in keep])
    for c in names[len(keep) :]:
        schema = schema.add(c, "string" if c in ("seg_mode", "level") else "integer" if c == "overflow" else "long")
    return spread(texts).mapInArrow(run, schema)


def sample_scores(texts: DataFrame, seg_modes: Sequence[str] = SEG_MODES, levels: Sequence[str] = LEVELS, pairs: dict[str, str] | None = None, guard: bool = True) -> DataFrame:
    """Rows (model, sample_id, seg_mode, fixed_len, level, dist, ref_len, overflow) of ``texts (model, sample_id, ref, text)``.

    Texts of one ref should stand side by side, then the ref is split and normalised once. Where a level changes neither side, the distance
    of the level before holds. With the guard, blocks of more than ``MAX_CELLS`` cells count the difference of their lengths; without it,
    their distance as all others, and overflow only tells that there are such.
    """
    rows = _scored(texts.select("model", "sample_id", "ref", "text"), seg_modes, levels, pairs, guard, False)
    return rows.select("model", "sample_id", "seg_mode", "fixed_len", "level", "dist", "ref_len", "overflow")


def sample_overflow(texts: DataFrame, seg_modes: Sequence[str] = SEG_MODES, levels: Sequence[str] = LEVELS, pairs: dict[str, str] | None = None) -> DataFrame:
    """Rows (model, sample_id, seg_mode, level, overflow), as ``sample_scores`` has them; lengths tell that, so no distance is computed."""
    return _scored(texts.select("model", "sample_id", "ref", "text"), seg_modes, levels, pairs, True, False, False)


def sample_ops(texts: DataFrame, seg_modes: Sequence[str] = SEG_MODES, levels: Sequence[str] = LEVELS, pairs: dict[str, str] | None = None) -> DataFrame:
    """As ``sample_scores`` with the guard, with S, D and I, and all columns of ``texts`` but ref and text; equal blocks don't overflow."""
    return _scored(texts, seg_modes, levels, pairs, True, True)


SUMS = {"seg_mode": "string", "level": "string", "model": "string", "err": "long", "ref_len": "long", "fixed_len": "long", "overflow_samples": "long", "rates": "double", "n": "long"}


def score_sums(texts: DataFrame, seg_modes: Sequence[str] = SEG_MODES, levels: Sequence[str] = LEVELS, pairs: dict[str, str] | None = None, guard: bool = True) -> DataFrame:
    """Sums of ``sample_scores`` as ``SUMS``, of ``texts (ref, texts array<struct<model, text>>)``: a ref once for all its models, and rows per batch, not per sample.

    err is the sum of dist; ref_len and fixed_len are those that ``group_scores`` divides by, rates are the samples' own over their ref_len. Rows
    of a group have to be added up, as ``leaderboard`` and ``macro_board`` do. Partitions stay as they are.
    """
    modes, at = _known_modes(seg_modes), [level for level in LEVELS if level in levels]
    n = len(modes) * len(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = _Grid(modes, at, pairs or {}, guard, False)
        for batch in batches:
            sums: dict[str | None, np.ndarray] = {}
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                found: dict[str | None, list[tuple[int, ...]]] = {}
                column = part.column("texts")
                each, sizes = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_pylist()
                texts = zip(each.field("model").to_pylist(), each.field("text").to_pylist(), strict=True)
                for ref, size in zip(part.column("ref").to_pylist(), sizes, strict=True):
                    for model, text in islice(texts, size):
                        found.setdefault(model, []).extend(grid.cells(ref, text))
                for model, cells in found.items():
                    fixed, ref_len, far, dist = np.fromiter(chain.from_iterable(cells), np.int64, 4 * len(cells)).reshape(-1, n, 4).transpose(2, 0, 1)
                    ref_len, fixed = np.maximum(ref_len, 1), np.maximum(np.where(fixed > 0, fixed, ref_len), 1)
                    # doubles hold these sums of a batch exactly
                    own = np.array([x.sum(axis=0) for x in (dist, ref_len, fixed, far, dist / ref_len, np.ones_like(dist))])
                    sums[model] = sums[model] + own if model in sums else own
            if sums and n:
                place = np.arange(len(sums) * n)
                keys = [pa.array(modes).take(pa.array(place // len(at) % len(modes))), pa.array(at).take(pa.array(place % len(at))), pa.array(list(sums), pa.string()).take(pa.array(place // n))]
                totals = np.concatenate(list(sums.values()), axis=1)
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array(x if k == 4 else x.astype(np.int64)) for k, x in enumerate(totals))], list(SUMS))

    return texts.select("ref", "texts").mapInArrow(run, ", ".join(map(" ".join, SUMS.items())))


def leaderboard(sums: DataFrame) -> DataFrame:
    """``group_scores`` of sums."""
    return _micro(sums.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("err", "ref_len", "fixed_len", "overflow_samples"))))


def macro_board(sums: DataFrame) -> DataFrame:
    """``macro_scores`` of sums."""
    return sums.groupBy(*KEYS).agg(F.round(F.sum("err") / F.sum("ref_len"), 6).alias("micro"), F.round(F.sum("rates") / F.sum("n"), 6).alias("macro"))


def _micro(sums: DataFrame, ops: Sequence[str] = ()) -> DataFrame:
    names = {"S": "sub_rate", "D": "del_rate", "I": "ins_rate"}
    return sums.select(
        *KEYS,
        F.round(F.col("err") / F.col("ref_len"), 6).alias("cer"),
        F.round(F.col("err") / F.col("fixed_len"), 6).alias("cer_fixed"),
        *(F.round(F.col(c) / F.col("fixed_len"), 6).alias(names[c]) for c in ops),
        "ref_len", "overflow_samples",
    )


def group_scores(samples: DataFrame) -> DataFrame:
    """Micro-averages per (seg_mode, level, model): errors over reference characters, a sample counting for at least one."""
    ref, fixed = F.greatest(F.lit(1), "ref_len"), F.greatest(F.lit(1), F.when(F.col("fixed_len") > 0, F.col("fixed_len")).otherwise(F.col("ref_len")))
    ops = [c for c in ("S", "D", "I") if c in samples.columns]
    sums = samples.groupBy(*KEYS).agg(
        F.sum("dist").alias("err"), F.sum(ref).alias("ref_len"), F.sum(fixed).alias("fixed_len"), F.sum("overflow").alias("overflow_samples"), *(F.sum(c).alias(c) for c in ops)
    )
    return _micro(sums, ops)


def macro_scores(samples: DataFrame) -> DataFrame:
    """Micro-average beside the mean of the samples' own rates, per (seg_mode, level, model)."""
    ref = F.greatest(F.lit(1), "ref_len")
    return samples.groupBy(*KEYS).agg(F.round(F.sum("dist") / F.sum(ref), 6).alias("micro"), F.round(F.avg(F.col("dist") / ref), 6).alias("macro"))
