"""Model outputs that arrive as files, scored as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.segment import unix_lines
from ..operators.scoring import sample_scores


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """A stream of rows (model, sample_id, text) from new files path/model/sample.md."""
    files = spark.readStream.format("text").option("wholetext", True).load(f"{path}/*/*.md")
    part = lambda k: F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -k))
    return files.select(part(2).alias("model"), F.regexp_replace(part(1), r"\.md$", "").alias("sample_id"), unix_lines(F.col("value")).alias("text"))


def score_stream(outputs: DataFrame, samples: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, seg_modes=("whole", "para", "para_merge"), levels=("P0", "P1", "P2", "P3", "P4")) -> StreamingQuery:
    """Score each batch of new outputs against ``samples (sample_id, ref)`` and hand its sample scores to ``sink``."""

    def batch(rows: DataFrame, number: int) -> None:
        sink(sample_scores(rows.join(samples, "sample_id"), seg_modes, levels), number)

    return outputs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
