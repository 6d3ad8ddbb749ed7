"""The trie of all conversation prefixes, with subtree totals by time-forward processing.

A node is a distinct sequence of first turns; its key is the depth and 128 bits
made from all turns up to it (one hash per turn and position, joined by XOR, so
that a conversation cut over many tasks is put together from its parts).

Totals go from the leaves to the root.  The vertices are sorted outside memory
by reverse level order; each takes the messages of its children from a priority
queue that spills to disk, and sends its own total to its parent.  That is done
in shards of neighbouring vertices: what finds no parent in its shard is a
shard root's total.  The shard roots, grouped by the parent they wait for, are
again vertices of a smaller tree, whose totals are found the same way; they
then enter the shards' queues as messages, and a last pass gives whole totals.

Rows without a conv_id belong to no conversation and are left out.  Null role
or text is empty, a null turn comes first, and rows that tie in turn are
ordered by a hash of role and text; repeated rows are repeated turns.  Turns
and texts of any number and length are used whole.  An empty table has no node,
not even a root.  Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
import tempfile
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

# Fixed values of the rebuilding rule: conversations c - c % FAMILY give the first crc32(c) % HEADS turns.
FAMILY = 100
HEADS = 6
#: Vertices of a shard: no more than the first number, and no fewer than the second just to have more tasks.
SHARD_MOST = 1 << 17
SHARD_LEAST = 1 << 13
#: Messages of a shard's queue in memory; the others wait in sorted runs on disk.
QUEUE_ROWS = 100_000
RUN_ROWS = 1000
#: Bytes of joined conversation ids in one row on their way to a node's hash.
PIECE_BYTES = 1 << 16

KEY = ["lv", "x1", "x2", "of"]
PARENT = ["plv", "p1", "p2", "pof"]
_KEY_TYPES = "lv int, x1 long, x2 long, of int"


# --- turns ----------------------------------------------------------------------
def _sequence(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` written in a global order, with the ``part`` and the ``place`` in it of every row."""
    return common.written(
        df.orderBy(*order).select("*", F.spark_partition_id().alias("part"),
                                  F.monotonically_increasing_id().alias("place")), name)


def _running(laid: DataFrame, values: dict[str, tuple[Callable[[Column], Column], Column]],
             join: Callable[[Column, Column], Column]) -> DataFrame:
    """``laid`` with running aggregates along each conversation.

    Windows see a conversation's rows of one part only.  What the parts before
    hold of the conversation that a part begins with is one row per part.
    """
    inside = Window.partitionBy("part", "conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = laid.groupBy("part", "conv_id").agg(*[f(v).alias(n) for n, (f, v) in values.items()])
    carried = totals.select("part", "conv_id", *[f(F.col(n)).over(earlier).alias(f"{n}_before")
                                                 for n, (f, _) in values.items()])
    carried = carried.where(F.col(f"{next(iter(values))}_before").isNotNull())
    return (laid.withColumns({n: f(v).over(inside) for n, (f, v) in values.items()})
            .join(F.broadcast(carried), ["part", "conv_id"], "left")
            .withColumns({n: join(F.col(n), F.coalesce(F.col(f"{n}_before"), F.lit(0))) for n in values})
            .drop(*[f"{n}_before" for n in values]))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, points): each turn by two hashes of role and text, and its code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    return (conversations.where(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"),
                    F.char_length(text).cast("long").alias("points"))
            .select("conv_id", "turn", *[F.conv(F.substring("digest", at, 15), 16, 10).cast("long").alias(n)
                                         for at, n in ((1, "a"), (16, "b"))], "points"))


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after the rebuilding rule.

    The turns have ``lv``, their place from 1 on, the key ``x1, x2`` of the prefix
    that ends with them and ``p1, p2`` of the one before.  A conversation's heads
    are five rows at most; its rows are numbered over all parts that hold it.
    """
    own = common.written(own, "turns")
    convs = own.select("conv_id").distinct().withColumn(
        "h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int"))
    convs = common.written(convs, "conversations")
    first = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "a", "b")
    heads = (own.where(F.col("conv_id") % FAMILY == 0).withColumn("n", F.row_number().over(first))
             .where(F.col("n") < HEADS).withColumnRenamed("conv_id", "family"))
    heads = (convs.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "family")
             .where(F.col("n") <= F.col("h")).select("conv_id", "h", F.lit(0).alias("own"), "turn", "a", "b", "points"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    both = heads.unionByName(own.withColumn("h", h).withColumn("own", F.lit(1)))
    laid = _sequence(both, [F.col("conv_id"), F.col("own"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")], "laid")

    plus, flips = (lambda x, y: x + y), (lambda x, y: x.bitwiseXOR(y))
    counted = _running(laid, {"n_heads": (F.sum, (1 - F.col("own")).cast("long")), "n_own": (F.sum, F.col("own").cast("long"))}, plus)
    kept = (counted.where((F.col("own") == 0) | (F.col("n_own") > F.col("h")))
            .withColumn("lv", (F.col("n_heads") + F.when(F.col("own") == 1, F.col("n_own") - F.col("h")).otherwise(0)).cast("int"))
            .select("part", "place", "conv_id", "lv", "points",
                    F.xxhash64("a", "lv").alias("e1"), F.xxhash64("b", "lv").alias("e2")))
    kept = common.written(kept, "numbered")
    rows = _running(kept, {"x1": (F.bit_xor, F.col("e1")), "x2": (F.bit_xor, F.col("e2"))}, flips)
    rows = rows.select("conv_id", "lv", "x1", "x2", flips(F.col("x1"), F.col("e1")).alias("p1"),
                       flips(F.col("x2"), F.col("e2")).alias("p2"), "points")
    return convs.select("conv_id"), common.written(rows, "rebuilt")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held, strict=True), schema, strict=True)], schema.names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held, strict=True), schema, strict=True)], schema.names)


# --- nodes ----------------------------------------------------------------------
_PIECES = pa.schema([("lv", pa.int32()), ("x1", pa.int64()), ("x2", pa.int64()), ("part", pa.int32()),
                     ("seq", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
_HASHED = pa.schema([("lv", pa.int32()), ("x1", pa.int64()), ("x2", pa.int64()), ("n_ends", pa.int64()),
                     ("ends_sha256", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) rows as rows of joined ids of one node, in order."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def found() -> Iterator[tuple]:
        seq, node, held, size = 0, None, [], 0
        for *key, conv in _rows(batches):
            if held and (key != node or size > PIECE_BYTES):
                yield (*node, part, seq, len(held), ",".join(held))
                seq, held, size = seq + 1, [], 0
            node = key
            held.append(str(conv))
            size += len(held[-1]) + 1
        if held:
            yield (*node, part, seq, len(held), ",".join(held))

    return _batched(found(), _PIECES, 1000)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and order to one hash per node, without holding the ids."""

    def found() -> Iterator[tuple]:
        for node, pieces in groupby(_rows(batches), lambda row: row[:3]):
            digest, n = hashlib.sha256(), 0
            for *_, count, ids in pieces:
                digest.update(f",{ids}".encode() if n else ids.encode())
                n += count
            yield (*node, n, digest.hexdigest())

    return _batched(found(), _HASHED)


def ends(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, n_ends, ends_sha256) of every node where a conversation ends.

    The ids are sorted over all tasks and joined to pieces there, so the task
    that hashes the ids of a node, however many, streams over a few long rows.
    """
    last = rows.groupBy("conv_id").agg(F.max(F.struct("lv", "x1", "x2")).alias("end"))
    node = [F.coalesce(F.col(f"end.{c}"), F.lit(0)).cast("int" if c == "lv" else "long").alias(c) for c in ("lv", "x1", "x2")]
    sorted_ends = convs.join(last, "conv_id", "left").select(*node, "conv_id").orderBy("lv", "x1", "x2", "conv_id")
    pieces = sorted_ends.mapInArrow(_pieces, "lv int, x1 long, x2 long, part int, seq long, n long, ids string")
    return pieces.repartition("lv", "x1", "x2").sortWithinPartitions("lv", "x1", "x2", "part", "seq").mapInArrow(
        _hashed, "lv int, x1 long, x2 long, n_ends long, ends_sha256 string")


def nodes(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """Every node with its key, its parent's key, smallest member, members, own
    share of the totals and the hash of the members that end there."""
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where(F.col("n_convs") > 0).select(
        F.lit(0).alias("lv"), F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"),
        F.lit(None).cast("int").alias("plv"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"),
        "conv_id", "n_convs", F.lit(0).cast("long").alias("points"))
    inner = rows.groupBy("lv", "x1", "x2").agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.max("points").alias("points")).withColumn("plv", F.col("lv") - 1)
    return (inner.unionByName(root).join(ends(convs, rows), ["lv", "x1", "x2"], "left")
            .select("lv", "x1", "x2", F.lit(0).alias("of"), "plv", "p1", "p2", F.lit(0).alias("pof"), "conv_id", "n_convs",
                    F.when(F.col("n_ends") == F.col("n_convs"), 1).otherwise(0).cast("long").alias("leaves"),
                    ((F.col("n_convs") - 1) * F.col("points")).alias("saved"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


# --- time-forward processing ------------------------------------------------------
class SpillingQueue:
    """A priority queue of tuples: beyond ``most`` they wait in sorted runs on disk.

    A run is an unnamed file of the task's own, like a spill of Spark's: it goes
    with the task, and a task that runs again writes its own.
    """

    def __init__(self, most: int):
        self.most, self.heap, self.heads, self.runs = most, [], [], []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            run = tempfile.TemporaryFile()
            self.heap.sort()
            for at in range(0, len(self.heap), RUN_ROWS):
                pickle.dump(self.heap[at:at + RUN_ROWS], run)
            run.seek(0)
            self.heap = []
            self.runs.append(self._read(run))
            self._next(len(self.runs) - 1)

    @staticmethod
    def _read(run) -> Iterator[tuple]:
        with run:
            while True:
                try:
                    yield from pickle.load(run)
                except EOFError:
                    return

    def _next(self, run: int) -> None:
        item = next(self.runs[run], None)
        if item is not None:
            heapq.heappush(self.heads, (item, run))

    def peek(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, run = heapq.heappop(self.heads)
            self._next(run)
            return item
        return heapq.heappop(self.heap)


def _place(key: tuple) -> tuple:
    """Reverse level order: deepest first."""
    return (-key[0], *key[1:])


class Shard:
    """One shard's messages, (place, number, leaves, saved, children, child) each."""

    def __init__(self, queue_rows: int):
        self.queue, self.sent = SpillingQueue(queue_rows), 0

    def send(self, target: tuple, leaves: int, saved: int, children: int, child: tuple | None = None) -> None:
        self.sent += 1  # no two messages compare equal, so what they carry is never compared
        self.queue.push((_place(target), self.sent, leaves, saved, children, child))

    def before(self, place: tuple | None) -> Iterator[tuple]:
        """The messages to targets before ``place`` (None: all): no such vertex came, they belong to other shards."""
        while (head := self.queue.peek()) is not None and (place is None or head[0] < place):
            yield self.queue.pop()

    def at(self, place: tuple) -> Iterator[tuple]:
        while (head := self.queue.peek()) is not None and head[0] == place:
            yield self.queue.pop()


_ROOTS = pa.schema([
    ("kind", pa.string()), ("shard", pa.int32()), ("lv", pa.int32()), ("x1", pa.int64()), ("x2", pa.int64()), ("of", pa.int32()),
    ("glv", pa.int32()), ("g1", pa.int64()), ("g2", pa.int64()), ("gof", pa.int32()), ("conv_id", pa.int64()),
    ("leaves", pa.int64()), ("saved", pa.int64()), ("children", pa.int64())])
_ROOT_TYPES = (f"kind string, shard int, {_KEY_TYPES}, glv int, g1 long, g2 long, gof int, conv_id long, "
               "leaves long, saved long, children long")


def _find_roots(queue_rows: int):
    """First pass: what every group of shard roots sends to the parent that it
    waits for (kind ``group``), and for every vertex the group above it."""

    def groups(number: int, messages: Iterator[tuple]) -> Iterator[tuple]:
        for place, same in groupby(messages, lambda m: m[0]):
            leaves = saved = children = 0
            for _, _, more, save, n, _ in same:
                leaves, saved, children = leaves + more, saved + save, children + n
            yield ("group", number, -place[0], *place[1:], *(None,) * 5, leaves, saved, children)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for number, rows in groupby(_rows(batches), lambda row: row[0]):
            shard, parents = Shard(queue_rows), {}
            for row in rows:
                key, parent, (leaves, saved, conv) = row[1:5], row[5:9], row[9:]
                parents[key] = (parent if parent[0] is not None else None), conv
                yield from groups(number, shard.before(_place(key)))
                for _, _, more, save, _, _ in shard.at(_place(key)):
                    leaves, saved = leaves + more, saved + save
                if parent[0] is not None:
                    shard.send(parent, leaves, saved, 1)
            yield from groups(number, shard.before(None))
            above: dict[tuple, tuple | None] = {}
            for key in reversed(parents):  # parents stand behind their children
                up, conv = parents[key]
                above[key] = above[up] if up in above else up
                yield ("vertex", number, *key, *(above[key] or (None,) * 4), conv, None, None, None)

    return lambda batches: _batched(found(batches), _ROOTS)


_TOTALS = pa.schema([("lv", pa.int32()), ("x1", pa.int64()), ("x2", pa.int64()), ("of", pa.int32()), ("total_leaves", pa.int64()),
                     ("total_saved", pa.int64()), ("children", pa.int64()), ("parent_conv_id", pa.int64())])


def _whole_totals(queue_rows: int):
    """Last pass: other shards' totals are in the queue first, and every vertex's
    totals are given out when its parent takes them, with the parent's conv_id."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, rows in groupby(_rows(batches), lambda row: row[0]):
            shard, outside = Shard(queue_rows), {}

            def roots(messages: Iterator[tuple], outside=outside) -> Iterator[tuple]:
                return ((*m[5], outside[-m[0][0], *m[0][1:]]) for m in messages)

            for row in rows:
                kind, key, parent, (leaves, saved, children, conv) = row[1], row[2:6], row[6:10], row[10:]
                if kind == 0:  # a parent in another shard
                    outside[key] = conv
                elif kind == 1:  # what other shards send to a vertex of this one
                    shard.send(key, leaves, saved, children)
                else:
                    yield from roots(shard.before(_place(key)))
                    for _, _, more, save, n, child in shard.at(_place(key)):
                        leaves, saved, children = leaves + more, saved + save, children + n
                        if child is not None:
                            yield (*child, conv)
                    if parent[0] is None:
                        yield (*key, leaves, saved, children, None)
                    else:
                        shard.send(parent, leaves, saved, 1, (*key, leaves, saved, children))
            yield from roots(shard.before(None))

    return lambda batches: _batched(found(batches), _TOTALS)


def _level_order() -> list[Column]:
    return [F.col("lv").desc(), F.col("x1"), F.col("x2"), F.col("of")]


def totals(vertices: DataFrame, shard_vertices: int | None = None, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """(key, total_leaves, total_saved, children, parent_conv_id) of all ``vertices``: written rows
    of a forest with the columns KEY, PARENT (null at a top; levels grow downwards), conv_id, leaves, saved.

    Shards are runs of vertices by conv_id and level, so a conversation of any
    length is cut into several.  The tree of shard-root groups goes through the
    same function; where it is hardly smaller it is one shard, sorted by Spark
    and queued on disk like any other.
    """
    spark, n = vertices.sparkSession, vertices.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = math.ceil(n / shard_vertices) if shard_vertices else max(math.ceil(n / SHARD_MOST), min(tasks, math.ceil(n / SHARD_LEAST)))
    if shards <= 1:
        return _last_pass(vertices.withColumn("shard", F.lit(0)), None, None, 1, queue_rows)
    vertices = common.written(vertices.repartitionByRange(shards, "conv_id", "lv", "x1", "x2", "of")
                              .withColumn("shard", F.spark_partition_id()), "shards")
    found = common.written(
        vertices.select("shard", *KEY, *PARENT, "leaves", "saved", "conv_id")
        .repartition(shards, "shard").sortWithinPartitions("shard", *_level_order())
        .mapInArrow(_find_roots(queue_rows), _ROOT_TYPES), "shard_roots")
    # A group: the shard roots of one shard that wait for the same parent.  The parent's own shard and group are looked up.
    place = found.where(F.col("kind") == "vertex").select(*KEY, F.col("shard").alias("home"), "glv", "g1", "g2", "gof", "conv_id")
    groups = found.where(F.col("kind") == "group").select(*KEY, "shard", "leaves", "saved", "children")
    groups = common.written(groups.join(place, KEY), "groups")
    if (n_groups := groups.count()) == 0:
        return _last_pass(vertices, None, None, shards, queue_rows)
    ids = F.struct(*KEY, "shard")
    up = F.when(F.col("glv").isNotNull(), F.struct(F.col("glv").alias("lv"), F.col("g1").alias("x1"), F.col("g2").alias("x2"),
                                                   F.col("gof").alias("of"), F.col("home").alias("shard")))
    # A vertex of the tree of groups is named by the parent waited for and a hash of the shard that waits.
    number = {c: F.xxhash64(F.col(f"{c}.x1"), F.col(f"{c}.x2"), F.col(f"{c}.of"), F.col(f"{c}.shard")) for c in ("id", "up")}
    tree = common.written(
        groups.withColumns({"id": ids, "up": up}).select(
            F.col("id.lv").alias("lv"), number["id"].alias("x1"), F.col("id.x2").alias("x2"), F.col("id.shard").alias("of"),
            F.col("up.lv").alias("plv"), F.when(F.col("up").isNotNull(), number["up"]).alias("p1"),
            F.col("up.x2").alias("p2"), F.col("up.shard").alias("pof"),
            "conv_id", "leaves", "saved", "children", "home", *[F.col(c).alias(f"t_{c}") for c in KEY]), "group_tree")
    # Groups that nothing waits for are whole already: they go straight into the group above them.
    above = tree.where(F.col("plv").isNotNull()).select(F.col("plv").alias("lv"), F.col("p1").alias("x1"),
                                                        F.col("p2").alias("x2"), F.col("pof").alias("of"), "leaves", "saved", *[
                                                            F.col(c).alias(f"c_{c}") for c in KEY])
    inner = tree.join(above.select(*KEY).distinct(), KEY, "left_semi")
    outer = tree.join(above.select(*KEY).distinct(), KEY, "left_anti")
    whole = (above.join(outer.select(*[F.col(c).alias(f"c_{c}") for c in KEY]), [f"c_{c}" for c in KEY])
             .groupBy(*KEY).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")))
    inner = common.written(
        inner.join(whole, KEY, "left")
        .withColumns({c: F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0)) for c in ("leaves", "saved")})
        .select(*KEY, *PARENT, "conv_id", "leaves", "saved"), "inner_groups")
    one = shard_vertices or SHARD_MOST
    smaller = totals(inner, one if inner.count() <= n // 2 else n_groups, queue_rows)
    messages = (tree.join(smaller.select(*KEY, "total_leaves", "total_saved"), KEY, "left")
                .groupBy(F.col("home").alias("shard"), *[F.col(f"t_{c}").alias(c) for c in KEY])
                .agg(F.sum(F.coalesce("total_leaves", "leaves")).alias("leaves"),
                     F.sum(F.coalesce("total_saved", "saved")).alias("saved"), F.sum("children").alias("children")))
    outside = groups.select("shard", *KEY, "conv_id")
    return _last_pass(vertices, common.written(messages, "messages"), outside, shards, queue_rows)


def _last_pass(vertices: DataFrame, messages: DataFrame | None, outside: DataFrame | None, shards: int,
               queue_rows: int) -> DataFrame:
    none = {c: F.lit(None).cast("long" if c in ("p1", "p2") else "int") for c in PARENT}
    rows = vertices.select("shard", F.lit(2).alias("kind"), *KEY, *PARENT, "leaves", "saved", F.lit(0).cast("long").alias("children"), "conv_id")
    if messages is not None:
        rows = rows.unionByName(messages.withColumns({"kind": F.lit(1), **none, "conv_id": F.lit(None).cast("long")}))
        nought = {c: F.lit(0).cast("long") for c in ("leaves", "saved", "children")}
        rows = rows.unionByName(outside.withColumns({"kind": F.lit(0), **none, **nought}))
    return common.written(
        rows.repartition(shards, "shard").sortWithinPartitions("shard", "kind", *_level_order())
        .mapInArrow(_whole_totals(queue_rows), f"{_KEY_TYPES}, total_leaves long, total_saved long, children long, parent_conv_id long"),
        "totals")


def trie(conversations: DataFrame, shard_vertices: int | None = None, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """All nodes of the rebuilt conversations' prefixes with their subtree totals."""
    convs, rows = rebuilt(turns(conversations))
    found = common.written(nodes(convs, rows), "nodes")
    return (found.join(totals(found, shard_vertices, queue_rows), KEY)
            .select("conv_id", F.col("lv").cast("long").alias("depth"), "parent_conv_id", "n_convs",
                    F.col("children").alias("n_children"), F.col("total_leaves").alias("n_leaves"),
                    F.col("total_saved").alias("saved_tokens"), "ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(common.table(spark, sf_dir, "conversations"))
