"""Scoring of listing files as they arrive (Structured Streaming).

The reference scores one listing per request from a web form.  Here
requests are files dropped into a folder: a file stream picks them up, each
micro-batch is scored by the stored model (opened once when the stream
starts: pipeline, encoding table, feature types) with the batch scorer,
and written under its batch id.
Re-running a batch after a failure overwrites the same folder, so the sink
is idempotent; progress lives in the checkpoint on shared storage.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.modelling import PREDICTION, StoredModel, load_stored, score


def score_batch_to(sink_dir: str, stored: StoredModel, keep: tuple[str, ...] = ("id",)):
    """foreachBatch body: score one micro-batch and overwrite its folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        scored = score(batch, stored, keep=keep).select(*[c for c in keep], PREDICTION)
        scored.write.mode("overwrite").parquet(os.path.join(sink_dir, f"batch_id={batch_id}"))
    return write


def start_scoring_stream(spark: SparkSession, source_dir: str, schema: StructType, model_dir: str,
                         sink_dir: str, checkpoint_dir: str, source_format: str = "parquet",
                         max_files_per_trigger: int | None = None, available_now: bool = False,
                         keep: tuple[str, ...] = ("id",)) -> StreamingQuery:
    """Start the file-stream scorer; ``available_now`` drains what is there and stops."""
    reader = spark.readStream.schema(schema).format(source_format)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    writer = (reader.load(source_dir).writeStream
              .foreachBatch(score_batch_to(sink_dir, load_stored(spark, model_dir), keep))
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
