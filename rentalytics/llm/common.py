"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: The white space of every word and normalisation rule here: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

# monotonically_increasing_id() holds the row's place in its partition in the low 33 bits.
_PLACE_MASK = (1 << 33) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder, read back: cuts the
    lineage, keeps columns prunable and survives a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of ``df`` has (Spark compares without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def row_key(columns: tuple[str, ...] = ("doc_id", "text")) -> Column:
    """A value both sides of a join can compute for a row: rows that agree in
    ``columns`` share it (and have equal results), others differ (128 bits)."""
    return F.unhex(F.md5(F.concat_ws("\x00", *[
        F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns])))


def in_share(column: str, rows: int, of: int) -> Column:
    """True for about four times ``rows`` of ``of`` rows, by a hash of the
    column: what a bounded sample is taken from, so that no task sends more
    than its part of it."""
    return F.pmod(F.xxhash64(column, F.lit("sample")), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1, 4 * rows / max(of, 1))) + 1)


def broadcast_within(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only where the written table ``df`` has at most
    ``rows`` narrow rows; beyond that Spark picks a shuffle join."""
    return F.broadcast(df) if df.count() <= rows else df


def ranked(df: DataFrame, order: list[Column], rank: str, name: str) -> DataFrame:
    """``df`` written in the global order ``order`` with a 0-based ``rank``.

    One range shuffle: each output partition knows its rows' places, and only
    the row counts of the partitions (one row each) are summed up in order,
    so no task ever sees the whole table.  Rows that tie in ``order`` get
    neighbouring ranks in an arbitrary order: give a total one.
    """
    part, place, before, rank_ = fresh(df, "part", "place_in_part", "rows_before", rank)
    if rank_ != rank:
        raise ValueError(f"the table already has a column {rank}")
    laid = written(
        df.orderBy(*order).select(
            "*", F.spark_partition_id().alias(part),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_MASK)).alias(place)),
        name)
    counts = laid.groupBy(part).agg(F.count(F.lit(1)).alias(before))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(part, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    return (laid.join(F.broadcast(starts), part)  # one row per partition of the layout
            .withColumn(rank, F.col(before) + F.col(place)).drop(part, place, before))


#: Rows that Spark hands to a Python worker at once: texts can be long, so fewer than its default.
ARROW_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` for mapInArrow; the session's Arrow batches get ARROW_ROWS rows at most."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))
    return df


def sized_batches(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches whose texts in ``column`` have about
    ``most`` bytes together; a longer text is a batch of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each begins
    (one offset more than texts); a null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]
