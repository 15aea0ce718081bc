"""Bootstrap intervals over samples: resamples common to all groups, drawn in each group's task or given as a table."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

N_BOOT, ALPHA, SEED = 2000, 0.05, 20260921
#: Draws in all, up to which they come from Python's Mersenne Twister; beyond, from a counter-based generator.
TWISTER_DRAWS = 1_000_000


@lru_cache(maxsize=1)
def _twisted(k: int, n_boot: int, seed: int) -> np.ndarray:
    rng = random.Random(seed)
    return np.array([[rng.randrange(k) for _ in range(k)] for _ in range(n_boot)], np.int32)


def draws(k: int, n_boot: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """The samples that each replicate draws, the same on every machine; one replicate is held at a time where they are many."""
    if k * n_boot <= TWISTER_DRAWS:
        yield from _twisted(k, n_boot, seed)
    else:
        for b in range(n_boot):
            yield np.random.Generator(np.random.Philox(key=seed, counter=b << 128)).integers(0, k, k)


def grouped_intervals(samples: DataFrame, k: int, keys: list[str], n_boot: int = N_BOOT, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Rows (keys, ci_lo, ci_hi) for ``samples (keys, ord, err, den)``, ord from 0 to k - 1; fewer than two samples give zeros.

    A group's errors and lengths, two numbers a sample, go to one task, which draws its replicates there: nothing is made on
    the driver and no row is made for a draw.
    """
    low, high = picks(n_boot, alpha)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        bounds = (0.0, 0.0)
        if group.num_rows >= 2:
            at = group.column("ord").to_numpy()
            err, den = (np.bincount(at, group.column(c).to_numpy().astype(np.float64), k) for c in ("err", "den"))
            rates = np.sort([err[drawn].sum() / den[drawn].sum() for drawn in draws(k, n_boot, seed)])
            bounds = (float(rates[low]), float(rates[high]))
        return pa.table({**{c: pa.array([v.as_py()]) for c, v in zip(keys, key, strict=True)}, "ci_lo": [bounds[0]], "ci_hi": [bounds[1]]})

    schema = StructType([*(samples.schema[c] for c in keys), *(StructField(c, DoubleType()) for c in ("ci_lo", "ci_hi"))])
    found = samples.groupBy(*keys).applyInArrow(run, schema)
    return found.select(*keys, F.round("ci_lo", 6).alias("ci_lo"), F.round("ci_hi", 6).alias("ci_hi"))


def hashed(spark: SparkSession, k: int, n_boot: int) -> DataFrame:
    """Rows (b, ord, mult): how often replicate b draws sample ord, by an arithmetic rule that SQL can repeat; made on the executors."""
    b, i = F.floor(F.col("id") / k), F.col("id") % k
    pick = (b * 7919 + i * 104729 + b * i * 31) % k
    return spark.range(n_boot * k).select(b.cast("int").alias("b"), pick.cast("int").alias("ord")).groupBy("b", "ord").agg(F.count("*").cast("int").alias("mult"))


def picks(n_boot: int, alpha: float = ALPHA) -> tuple[int, int]:
    """Places, from 0, of the order statistics that bound the interval."""
    return int(alpha / 2 * n_boot), min(n_boot - 1, int((1 - alpha / 2) * n_boot))


def intervals(samples: DataFrame, resamples: DataFrame, keys: list[str], n_boot: int, alpha: float = ALPHA) -> DataFrame:
    """Rows (keys, ci_lo, ci_hi) for ``samples (keys, ord, err, den)``; fewer than two samples give zeros."""
    low, high = picks(n_boot, alpha)
    # resamples: at most n_boot x k rows of three numbers
    rates = samples.join(resamples, "ord").groupBy(*keys, "b").agg((F.sum(F.col("mult") * F.col("err")) / F.sum(F.col("mult") * F.col("den"))).alias("rate"))
    sorted_rates = F.sort_array(F.collect_list("rate"))
    bounds = rates.groupBy(*keys).agg(sorted_rates.alias("r")).select(*keys, F.round(F.get("r", low), 6).alias("lo"), F.round(F.get("r", high), 6).alias("hi"))
    counts = samples.groupBy(*keys).agg(F.count("*").alias("n"))
    few = F.col("n") < 2
    return counts.join(bounds, keys, "left").select(*keys, F.when(few, 0.0).otherwise(F.col("lo")).alias("ci_lo"), F.when(few, 0.0).otherwise(F.col("hi")).alias("ci_hi"))
