"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is cut into 2**bits cells of near equal row counts, the cells
of a row give its index on the Hilbert curve, and the rows sorted by that
index are cut into runs.  Rows that are close in every dimension are close
on the curve, so a file of a run covers a small range of each dimension and
readers skip files by their min/max statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

DIMENSIONS = ("source", "lang", "size")
BITS = 5
SHARDS = 16
# Accuracy of a number's cell bounds: at most rows / ACCURACY rows away from the exact quantile.
ACCURACY = 10_000


def curve_table(dimensions: int) -> list[int]:
    """The Hilbert curve as a state machine: entry ``state << n | corner`` is
    ``next_state << n | digit``.

    A state is the sub-cube's entry corner and direction.  The digit of a
    corner is the inverse Gray code of the corner, seen from that frame.
    """
    n, full = dimensions, (1 << dimensions) - 1

    def left(x: int, by: int) -> int:
        by %= n
        return ((x << by) | (x >> (n - by))) & full

    def gray(x: int) -> int:
        return x ^ (x >> 1)

    def trailing_ones(x: int) -> int:
        return ((x ^ (x + 1)).bit_length() - 1) % n

    out = []
    for state in range(n << n):
        direction, entry = divmod(state, full + 1)
        for corner in range(full + 1):
            seen = left(corner ^ entry, n - (direction + 1) % n)
            digit = 0
            for shift in range(n):
                digit ^= seen >> shift
            first = gray((digit - 1) & ~1) if digit else 0
            turn = 0 if digit == 0 else trailing_ones(digit if digit & 1 else digit - 1)
            after = ((direction + turn + 1) % n) << n | (entry ^ left(first, direction + 1))
            out.append(after << n | digit)
    return out


def curve_index(cells: list[Column], bits: int) -> Column:
    """Hilbert index (long) of a row whose cell in each dimension is 0 .. 2**bits - 1."""
    n = len(cells)
    corners = []
    for level in range(bits - 1, -1, -1):
        corner = F.lit(0)
        for place, cell in enumerate(cells):
            corner = corner + F.shiftleft(F.shiftright(cell, level).bitwiseAND(F.lit(1)), place)
        corners.append(corner.cast("int"))
    machine = F.array(*[F.lit(x) for x in curve_table(n)])

    def step(acc: Column, corner: Column) -> Column:
        entry = F.element_at(machine, (acc["state"] * F.lit(1 << n) + corner + 1).cast("int"))
        return F.struct(
            (acc["index"] * F.lit(1 << n) + entry.bitwiseAND(F.lit((1 << n) - 1))).cast("long").alias("index"),
            F.shiftright(entry, n).cast("int").alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.array(*corners), start, step)["index"]


def text_cuts(df: DataFrame, column: str, cells: int) -> list[str]:
    """The values of a text column that end its cells of near equal row counts,
    in order, a value once per cell that it ends; nulls do not count.

    Whole values are counted, sorted by ranges and their counts summed up in
    order, so a value that a third of all rows share is one row, and no task
    sees all values.  At most ``cells`` values reach the driver.
    """
    value, n, part, before, upto = "value", "n", "part", "before", "upto"
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(value)).agg(F.count(F.lit(1)).alias(n))
    laid = common.written(counts.orderBy(value).select("*", F.spark_partition_id().alias(part)), "cut_values")
    sums = laid.groupBy(part).agg(F.sum(n).alias(before))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(part, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    total = laid.agg(F.sum(n)).first()[0] or 1
    inside = Window.partitionBy(part).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    running = laid.join(F.broadcast(starts), part).select(value, n, (F.col(before) + F.sum(n).over(inside)).alias(upto))
    ended = F.expr(f"({upto} * {cells}L) div {total}L - (({upto} - {n}) * {cells}L) div {total}L").alias("ended")
    return [r[value] for r in running.select(value, ended).where("ended > 0").orderBy(value).collect()
            for _ in range(r["ended"])][:cells - 1]


def cell_bounds(df: DataFrame, dimensions: tuple[str, ...], cells: int) -> dict[str, list]:
    """Per dimension the bounds of its cells: a row's cell is the number of bounds below its value.

    Text is cut by the counts of its whole values, numbers by approximate quantiles (ACCURACY).
    """
    kinds = dict(df.dtypes)
    numbers = [c for c in dimensions if kinds[c] != "string"]
    steps = [i / cells for i in range(1, cells)]
    bounds = {c: text_cuts(df, c, cells) for c in dimensions if kinds[c] == "string"}
    if numbers:
        cuts = df.agg(*[F.percentile_approx(F.col(c).cast("double"), steps, ACCURACY).alias(f"cut{i}")
                        for i, c in enumerate(numbers)]).first()
        bounds.update((c, own or []) for c, own in zip(numbers, cuts, strict=True))
    return {c: bounds[c] for c in dimensions}


def hilbert_order(df: DataFrame, dimensions: tuple[str, ...], bits: int = BITS) -> Column:
    """The curve index of every row of ``df``; a null is in a dimension's first cell."""
    kinds = dict(df.dtypes)

    def cell(column: str, own: list) -> Column:
        kind = "string" if kinds[column] == "string" else "double"
        value = F.col(column).cast(kind)
        return F.size(F.filter(F.array(*[F.lit(x) for x in own]).cast(f"array<{kind}>"), lambda bound: value > bound))

    cells = [cell(column, own) for column, own in cell_bounds(df, dimensions, 1 << bits).items()]
    # The lambda variable holds the cells: none is evaluated twice.
    index = F.transform(F.array(F.array(*cells)), lambda c: curve_index([F.get(c, F.lit(i)) for i in range(len(cells))], bits))
    return F.get(index, F.lit(0))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """All rows and columns of ``docs`` plus ``size`` (UTF-8 bytes + 1),
    ``hilbert``, ``shard`` and ``slot`` (place in the shard, from 0).

    Law ``rows``: shards are runs of the curve order whose row counts differ
    by one at most.  Rows of one cell are ordered by a hash of doc_id and
    text, then doc_id: a hot source or a large group of equal texts spreads
    over as many tasks as it needs.  Rows equal in all of these are
    interchangeable.  A null text has size 1; null metadata sorts first; no
    rows give no rows; with fewer rows than shards some shards stay empty.
    Columns of ``docs`` with the names of added columns are replaced.
    """
    docs = docs.drop("size", "hilbert", "shard", "slot")
    sized = docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    mix, rank = common.fresh(sized, "mix", "rank")
    keyed = (sized.withColumn("hilbert", hilbert_order(sized, DIMENSIONS, bits))
             .withColumn(mix, F.xxhash64("doc_id", "text")))
    laid = common.ranked(keyed, [F.col("hilbert"), F.col(mix), F.col("doc_id")], rank, "hilbert")
    total = laid.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    # Integer arithmetic: no rounding at any table size.
    shard = F.expr(f"`{rank}` * {shards}L div {max(total, 1)}L").cast("int")
    first = F.expr(f"(cast(shard as long) * {total}L + {shards - 1}L) div {shards}L")
    return laid.withColumn("shard", shard).withColumn("slot", F.col(rank) - first).drop(mix, rank)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The shards as folders ``shard=0`` .. of parquet files in curve order."""
    hilbert_shards(docs, shards).write.partitionBy("shard").parquet(path)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return hilbert_shards(docs).select(
        "doc_id", "size",
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert")
