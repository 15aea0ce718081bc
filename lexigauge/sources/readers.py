"""Ground truth, model outputs, manifests, exports and images as DataFrames; only Spark's readers touch the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.segment import unix_lines

INDEX = "sample_id string, doc_type string, source string, sensitive_attrs array<string>, license string"
MANIFEST = "model_name string, engine string, engine_package string, domain string, n_samples int, images_dir string, elapsed_sec double, note string"
IMAGE_SUFFIXES = "*.{png,jpg,jpeg,bmp,webp}"


def _part(k: int) -> Column:
    """The k-th last part of a file's path, decoded."""
    return F.url_decode(F.replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -k), F.lit("+"), F.lit("%2B")))


def read_texts(spark: SparkSession, glob: str) -> DataFrame:
    """Rows (folder, sample_id, text) of the Markdown files at a path pattern, line ends as line feeds."""
    files = spark.read.text(glob, wholetext=True)
    return files.select(_part(2).alias("folder"), F.regexp_replace(_part(1), r"\.md$", "").alias("sample_id"), unix_lines(F.col("value")).alias("text"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Rows of index.json with place ``ord`` and text ``ref``; a sample without a text is an error."""
    index = spark.read.schema(INDEX).option("multiLine", True).json(f"{path}/index.json")
    rows = index.select("*", F.monotonically_increasing_id().alias("ord"))  # one file, one partition: the order of the file
    texts = read_texts(spark, f"{path}/*.md").select("sample_id", F.col("text").alias("ref"))
    missing = [r["sample_id"] for r in rows.join(texts, "sample_id", "left_anti").select("sample_id").limit(5).collect()]
    if missing:
        raise FileNotFoundError(f"no text for {', '.join(missing)} in {path}")
    return rows.join(texts, "sample_id")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Rows (model, sample_id, text): one model per folder."""
    return read_texts(spark, f"{path}/*/*.md").withColumnRenamed("folder", "model")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(f"{path}/*/_manifest.json")


def read_images(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Rows (sample_id, path, content) in the order of names; ``limit`` takes the first ones."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_SUFFIXES).load(path)
    rows = files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("sample_id"), "path", "content").orderBy("path")
    return rows if limit is None else rows.limit(limit)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Rows (sample_id, text) of a JSON object of texts."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("sample_id", "text"))


def changes(export: DataFrame, old: DataFrame) -> DataFrame:
    """Rows (sample_id, text, changed, delta) of an export against the texts it updates; others stay as they are."""
    before = old.select("sample_id", F.col("text").alias("before"))
    both = export.join(before, "sample_id", "left")
    return both.select("sample_id", "text", (~F.col("text").eqNullSafe(F.col("before"))).alias("changed"), (F.char_length("text") - F.coalesce(F.char_length("before"), F.lit(0))).alias("delta"))


def with_images(texts: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that have an image, with it, and those that lack one."""
    return texts.join(images.select("sample_id", "path"), "sample_id"), texts.join(images, "sample_id", "left_anti")


def carriage_returns(spark: SparkSession, path: str, pattern: str = "*.{md,json,csv,py,txt}") -> DataFrame:
    """Rows (path, dirty) of text files below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.contains("value", F.lit("\r")).alias("dirty"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, sha256) of a folder's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (name, state) of two digest tables: only in one, or different."""
    both = a.select("name", F.col("sha256").alias("a")).join(b.select("name", F.col("sha256").alias("b")), "name", "full_outer")
    return both.select("name", F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(F.col("a") != F.col("b"), "differs").alias("state")).where("state is not null")
