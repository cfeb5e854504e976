"""Incremental level-1 aggregation (2.16 / M9).

Level 1 (A1) is a mergeable sum + count, so new attribution files can be folded in as they arrive:
a file-source stream reads the attribution table, every micro-batch writes its partial level-1
aggregate to a folder named by the batch id (overwrite, so a replayed batch rewrites the same output),
and readers merge the partials with one more grouped sum. The checkpoint makes the stream resume where
it stopped after a failure.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlens.operators import aggregate as agg


def run_incremental_level1(spark: SparkSession, attrs_dir: str, out_dir: str, checkpoint: str,
                           positive_only: bool = True, files_per_batch: int = 1) -> None:
    schema = spark.read.parquet(attrs_dir).schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
              .parquet(attrs_dir))

    def per_batch(batch: DataFrame, batch_id: int):
        part = agg.level1(batch, "!sentence", positive_only)
        part.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch={batch_id}"))

    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def merged_level1(spark: SparkSession, out_dir: str) -> DataFrame:
    """Merge the partial aggregates of every batch into the level-1 table."""
    parts = spark.read.parquet(out_dir)
    return parts.groupBy(*agg.LEVEL1_KEYS).agg(F.sum("attr").alias("attr"), F.sum("occurance").alias("occurance"))
