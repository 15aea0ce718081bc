"""Staging in the cluster's shared folder, and connected components of link tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIR:
        _LOCAL_DIR[app] = "file://" + tempfile.mkdtemp(prefix="lexigauge-")
    return _LOCAL_DIR[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def release(*staged: DataFrame) -> None:
    """Delete the folders of staged tables that nothing reads any more, all that was made of them being written."""
    for df in staged:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where.getParent(), True)


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; reads no more than one row beyond the bound."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table whose row count was checked; beyond the bound Spark shuffles it."""
    return F.broadcast(df) if bounded(df, rows) else df


#: Rows of a table broadcast whole, and of the heaviest keys broadcast apart.
BROADCAST_ROWS, HEAVY_ROWS = 200_000, 1 << 12


def heavy_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", weight: str = "weight") -> DataFrame:
    """Join to a table with one row a key and, in ``weight``, how many rows of ``left`` have it; ``how`` is inner or left.

    A table of few rows is broadcast. Of a larger one, only the keys that hold a ``HEAVY_ROWS``-th of all weight, at most so many, are broadcast,
    so no key lands whole in one task; rows with other keys are shuffled. Rows with a null key match nothing. The weight column goes.
    """
    if bounded(right, BROADCAST_ROWS):
        return left.join(F.broadcast(right), key, how).drop(weight)
    total = right.agg(F.sum(weight)).first()[0]
    heavy = F.broadcast(right.where(F.col(weight) * HEAVY_ROWS >= total))
    rest = left.join(heavy.select(key), key, "left_anti")
    light = right.where(F.col(weight) * HEAVY_ROWS < total)
    empty = rest.where(F.col(key).isNull()) if how == "left" else None
    parts = left.join(heavy, key).unionByName(rest.where(F.col(key).isNotNull()).join(light, key, how))
    if empty is not None:
        parts = parts.unionByName(empty, allowMissingColumns=True)
    return parts.drop(weight)


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of ``links (a, b)``: rows (id, component), component = smallest id reachable.

    Alternating large-star and small-star rounds; each round is two aggregations and joins on
    node ids, those of many links apart (``heavy_join``), so no component is ever gathered in one task. Rounds grow with the logarithm of
    the component's diameter; the edge table is staged after each. Self links and nulls are ignored.
    """
    edges = stage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct(),
        "edges",
    )

    def mark(e: DataFrame):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    seen = mark(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("weight"))
        large = (
            heavy_join(both.where(F.col("v") > F.col("u")), low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight"))
        small = heavy_join(large, low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, stage(small.unionByName(low.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct(), "edges")
        release(before)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = stage(stars.unionByName(roots.join(stars.select("id"), "id", "left_anti")), "components")
    release(edges)
    return out
