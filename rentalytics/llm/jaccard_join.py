"""Exact n-gram Jaccard join that skips by the relations between sets.

Two documents link when their shingle sets x, y have 9 |x & y| >= 4 (|x| + |y|),
that is a Jaccard similarity of 0.8 or more.  Linked sets share one of the
rarest fifth of their shingles (the prefix) in any common order.

* Equal sets are one class; only one row of a class is looked at further.
* Answers of similar sets are reused: classes with a common min-hash are
  first compared with the most typical set of their group (the leader), one
  pair per class.  A class linked to its leader has the leader's component as
  its answer, and no pair inside a component is looked at again.
* Index lists of the remaining prefix shingles are cut into blocks by set
  size.  The place of a shingle in a set bounds the sizes of its partners
  (all that is left after the first common shingle must suffice), so a set
  visits only the blocks it can have a partner in, and of a list's dominant
  component only the others are paired with it.
* Surviving pairs between components are bounded by how their shingles spread
  over hash ranges (no more can be common than the smaller count of every
  range), and verified exactly on whole sets.  So every link either lies
  inside a component or is found: components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .shingles import shingle_sets

BATCH_BYTES = 2 << 20
# Counters for the shingles' frequency order (1 byte each when it is sent to
# the tasks).  The order only decides how many candidates there are.
COUNTERS_BITS = 20
COUNTERS_ROW = 1 << 14
# Min-hashes of a set; the first KEYS group sets with a leader, and a set is
# compared with the leader only if so many of all agree.  What that leaves
# out, the index finds.
MIN_HASHES = 16
KEYS = 3
LEAST_AGREEING = 10
# Narrow rows up to which a join may broadcast them (about 50 bytes each).
BROADCAST_ROWS = 1_000_000
# Shingles per hash range of a set's spread, about.
RANGE_SHINGLES = 4
# Width of a size block: sizes of one block differ by a tenth.
BLOCK_RATIO = 1.1


def _class(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def _rows(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class and size of every row, then the task's shingle counts."""
    counts = np.zeros(1 << COUNTERS_BITS, np.int32)
    for batch in common.sized_batches(batches, "text", BATCH_BYTES):
        sets = shingle_sets(*common.text_bytes(batch.column("text")))
        if sets:
            places = np.concatenate(sets) >> np.uint64(64 - COUNTERS_BITS)
            counts += np.bincount(places.astype(np.int64), minlength=len(counts)).astype(np.int32)
        n = len(sets)
        yield _rows({
            "doc_id": batch.column("doc_id"), "key": batch.column("key"),
            "n": pa.array([len(s) for s in sets], pa.int32()),
            "cls": pa.array([_class(s) if len(s) else None for s in sets], pa.int64()),
            "part": pa.nulls(n, pa.int32()), "counts": pa.nulls(n, pa.list_(pa.int32()))})
    parts = [p for p in range(len(counts) // COUNTERS_ROW) if counts[p * COUNTERS_ROW:(p + 1) * COUNTERS_ROW].any()]
    n = len(parts)
    yield _rows({
        "doc_id": pa.nulls(n, pa.int64()), "key": pa.nulls(n, pa.binary()), "n": pa.nulls(n, pa.int32()),
        "cls": pa.nulls(n, pa.int64()), "part": pa.array(parts, pa.int32()),
        "counts": pa.array([counts[p * COUNTERS_ROW:(p + 1) * COUNTERS_ROW] for p in parts], pa.list_(pa.int32()))})


SURVEY = "doc_id long, key binary, n int, cls long, part int, counts array<int>"


def _levels(survey: DataFrame) -> np.ndarray:
    """Per counter its total on a logarithmic scale of one byte: 2**COUNTERS_BITS bytes at any input size."""
    slots = survey.where(F.col("part").isNotNull()).select("part", F.posexplode("counts").alias("slot", "n"))
    totals = (slots.where("n > 0").groupBy((F.col("part") * COUNTERS_ROW + F.col("slot")).alias("counter"))
              .agg(F.sum("n").alias("n")).toArrow())
    levels = np.zeros(1 << COUNTERS_BITS, np.uint8)
    levels[totals["counter"].to_numpy()] = np.minimum(np.log2(totals["n"].to_numpy() + 1) * 6, 255)
    return levels


def spread(shingles: np.ndarray) -> np.ndarray:
    """How many shingles are in each of 2**k equal hash ranges, in hash order."""
    bits = max(len(shingles) // RANGE_SHINGLES, 1).bit_length() - 1
    ranges = (shingles >> np.uint64(63 - bits)) >> np.uint64(1)
    return np.minimum(np.bincount(ranges.astype(np.int64), minlength=1 << bits), 65535).astype("<u2")


def most_common(x: np.ndarray, y: np.ndarray) -> int:
    """An upper bound of the common shingles of two sets by their spreads."""
    while len(x) > len(y):
        x = x.reshape(-1, 2).sum(1, dtype=np.int64)
    while len(y) > len(x):
        y = y.reshape(-1, 2).sum(1, dtype=np.int64)
    return int(np.minimum(x, y).sum(dtype=np.int64))


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose spreads leave room for a link."""
    for batch in batches:
        sizes = zip(batch.column("x_n").to_pylist(), batch.column("y_n").to_pylist(), strict=True)
        spreads = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
        room = [9 * most_common(np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")) >= 4 * (n + m)
                for (n, m), (x, y) in zip(sizes, spreads, strict=True)]
        yield batch.select(["u", "v"]).filter(pa.array(room, pa.bool_()))


def _sketch(levels):
    """Per set: its min-hashes, how typical it is, and its prefix, rarest shingle first."""
    seeds = [np.uint64(pow(0xBF58476D1CE4E5B9, k + 1, 1 << 64)) for k in range(MIN_HASHES)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sized_batches(batches, "text", BATCH_BYTES):
            keys, rows = batch.column("key").to_pylist(), []
            for key, s in zip(keys, shingle_sets(*common.text_bytes(batch.column("text"))), strict=True):
                if not len(s):
                    continue
                level = levels.value[s >> np.uint64(64 - COUNTERS_BITS)]
                order = np.argsort((level.astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8)), kind="stable")
                prefix = s[order[:len(s) - (4 * len(s) + 4) // 5 + 1]].view(np.int64)
                least = np.array([(s * k).min() for k in seeds]).view(np.int64)
                rows.append((key, _class(s), len(s), float(level.mean()), least[:KEYS], (least & 0x7F).astype(np.int8),
                             spread(s).tobytes(), prefix))
            if rows:
                kinds = (pa.binary(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int8()),
                         pa.binary(), pa.list_(pa.int64()))
                names = ("key", "cls", "n", "typical", "least", "bytes", "spread", "prefix")
                yield _rows({name: pa.array(col, kind) for name, kind, col in
                             zip(names, kinds, zip(*rows, strict=True), strict=True)})

    return sketch


SKETCH = ("key binary, cls long, n int, typical double, least array<long>, bytes array<tinyint>, spread binary, "
          "prefix array<long>")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of texts whose whole shingle sets link; the sets of the last
    few left texts are kept, as pairs of one leader often follow each other."""
    known: dict[int, np.ndarray] = {}
    for batch in common.sized_batches(batches, "y", BATCH_BYTES):
        lefts = batch.column("u").to_pylist()
        new = {u: row for row, u in enumerate(lefts) if u not in known}
        if len(known) > 64:
            known, new = {}, {u: row for row, u in enumerate(lefts)}
        own = batch.column("x").take(pa.array(list(new.values()), pa.int64()))
        known.update(zip(new, shingle_sets(*common.text_bytes(own)), strict=True))
        links = []
        for u, y in zip(lefts, shingle_sets(*common.text_bytes(batch.column("y"))), strict=True):
            x = known[u]
            links.append(len(np.intersect1d(x, y, assume_unique=True)) * 9 >= (len(x) + len(y)) * 4)
        yield batch.select(["u", "v"]).filter(pa.array(links, pa.bool_()))


def _nodes(pairs: DataFrame, name: str) -> DataFrame:
    ends = pairs.select(F.col("u").alias("cls")).unionByName(pairs.select(F.col("v").alias("cls")))
    return common.broadcast_within(common.written(ends.distinct(), name), BROADCAST_ROWS)


def verified(pairs: DataFrame, classes: DataFrame, keyed: DataFrame) -> DataFrame:
    """The pairs (u, v) of classes that link, as u, v.  What the spreads leave
    is compared on whole sets, made again from the texts of the classes that
    occur: texts are half as large to shuffle as their hashes."""
    sizes = common.written(classes.join(_nodes(pairs, "ends"), "cls").select("cls", "n", "spread"), "spreads")
    one = sizes.select(F.col("cls").alias("u"), F.col("n").alias("x_n"), F.col("spread").alias("x"))
    other = sizes.select(F.col("cls").alias("v"), F.col("n").alias("y_n"), F.col("spread").alias("y"))
    pairs = common.written(pairs.select("u", "v").join(one, "u").join(other, "v").mapInArrow(
        _possible, "u long, v long"), "possible")
    wanted = common.written(classes.join(_nodes(pairs, "nodes"), "cls").select("cls", "key"), "wanted")
    texts = common.written(
        keyed.join(common.broadcast_within(wanted, BROADCAST_ROWS), "key").select("cls", "text"), "texts")
    left = texts.join(pairs.select(F.col("u").alias("cls")).distinct(), "cls", "left_semi").select(
        F.col("cls").alias("u"), F.col("text").alias("x"))
    right = texts.select(F.col("cls").alias("v"), F.col("text").alias("y"))
    both = pairs.select("u", "v").join(right, "v").join(left, "u").select("u", "v", "x", "y")
    return common.written(both.mapInArrow(_linked, "u long, v long").distinct(), "linked")


def leader_pairs(classes: DataFrame) -> DataFrame:
    """(u, v): the most typical class with a min-hash, and every other class
    with it whose size and min-hashes let a link be expected."""
    shared = classes.select("cls", "n", "typical", "bytes", F.posexplode("least").alias("which", "least"))
    leaders = (shared.groupBy("which", "least")
               .agg(F.max(F.struct("typical", "cls", "n", "bytes")).alias("lead"), F.count(F.lit(1)).alias("members"))
               .where("members > 1"))
    agreeing = F.size(F.filter(F.zip_with("bytes", "lead.bytes", lambda a, b: a == b), lambda same: same))
    pairs = shared.join(leaders, ["which", "least"]).where(
        (F.col("cls") != F.col("lead.cls"))
        & (F.least("n", "lead.n") * 5 >= F.greatest("n", "lead.n") * 4) & (agreeing >= LEAST_AGREEING))
    return common.written(pairs.select(F.col("lead.cls").alias("u"), F.col("cls").alias("v")).distinct(), "leader_pairs")


def _block(size):
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(BLOCK_RATIO))).cast("int")


def candidate_pairs(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v): pairs of classes of different components that share a prefix
    shingle at places where a link is possible.

    The bound of a place holds for the first common shingle, and is weaker
    the earlier the place: a pair that fails at its first one fails at all.
    """
    tokens = classes.select("cls", "n", F.posexplode("prefix").alias("place", "shingle"))
    lists = common.written(tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("length"))
                           .where("length > 1").select("shingle"), "lists")
    live = tokens.join(lists, "shingle", "left_semi")
    # Largest partner that what is left of a set, from this shingle on, suffices for.
    most = F.floor((9 * (F.col("n") - F.col("place")) - 4 * F.col("n")) / 4).cast("int")
    placed = live.join(common.broadcast_within(roots, BROADCAST_ROWS), F.col("cls") == F.col("node"), "left").select(
        "shingle", "cls", "n", F.coalesce("root", "cls").alias("comp"), most.alias("most"))
    placed = common.written(placed, "index_lists")
    # A list with one component has its answers; in the others the largest component is not paired with itself.
    shares = placed.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("n"))
    dominant = (shares.groupBy("shingle").agg(F.max(F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"))
                .where("comps > 1").select("shingle", F.col("top.comp").alias("dominant")))
    open_lists = common.written(placed.join(dominant, "shingle").withColumn(
        "minor", F.col("comp") != F.col("dominant")).drop("dominant"), "open_lists")
    upto = F.least("most", F.floor(F.col("n") * 5 / 4).cast("int"))
    probes = open_lists.withColumn("upto", upto).where(F.col("upto") >= F.col("n")).select(
        "shingle", F.when(F.col("minor"), 0).otherwise(1).alias("side"),
        F.explode(F.sequence(_block(F.col("n")), _block(F.col("upto")))).alias("block"),
        F.col("cls").alias("u"), F.col("n").alias("u_n"), F.col("comp").alias("u_comp"), "upto")
    index = open_lists.select(
        "shingle", F.explode(F.when(F.col("minor"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("side"),
        _block(F.col("n")).alias("block"),
        F.col("cls").alias("v"), F.col("n").alias("v_n"), F.col("comp").alias("v_comp"), "most")
    pairs = probes.join(index, ["shingle", "side", "block"]).where(
        (F.col("u_comp") != F.col("v_comp")) & (F.col("v_n") <= F.col("upto")) & (F.col("most") >= F.col("u_n"))
        & ((F.col("u_n") < F.col("v_n")) | ((F.col("u_n") == F.col("v_n")) & (F.col("u") < F.col("v")))))
    return common.written(pairs.select("u", "v").distinct(), "candidate_pairs")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, key (see common.row_key),
    n_shingles, component_id, and ``lead``, the key of the component's first
    document (smallest doc_id, null last).

    A null or empty text has no shingles and is linked with nothing: its
    component is itself.  Fewer than five words are one shingle.  Repeated
    rows are in one component.  component_id is the smallest doc_id that
    links reach, null if none of them has one.  No rows give no rows.
    """
    spark = docs.sparkSession
    keyed = common.small_batches(docs).select("doc_id", common.row_key().alias("key"), "text")
    survey = common.written(keyed.mapInArrow(_survey, SURVEY), "survey")
    levels = spark.sparkContext.broadcast(_levels(survey))
    rows = survey.where(F.col("part").isNull()).select("doc_id", "key", "n", "cls")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    kept = common.written(rows.where("n > 0").groupBy("cls").agg(first.alias("first"), F.count(F.lit(1)).alias("copies")),
                          "classes")
    # Copies leave here: of a class with several rows only its first one's sketch stays.
    several = common.written(kept.where("copies > 1").select(F.col("cls").alias("of"), F.col("first.key").alias("kept_key")),
                             "several")
    sketches = keyed.mapInArrow(_sketch(levels), SKETCH)
    alone = sketches.join(common.broadcast_within(several, BROADCAST_ROWS), F.col("cls") == F.col("of"), "left").where(
        F.col("of").isNull() | (F.col("key") == F.col("kept_key")))
    classes = common.written(alone.select("key", "cls", "n", "typical", "least", "bytes", "spread", "prefix"), "sketches")
    if not several.isEmpty():
        repeated = classes.groupBy("cls").count().where("count > 1")
        if not repeated.isEmpty():  # rows that are equal in doc_id and text
            classes = common.written(classes.dropDuplicates(["cls"]), "sketches")
    by_leader = verified(leader_pairs(classes), classes, keyed)
    roots = components(by_leader)
    links = verified(candidate_pairs(classes, roots), classes, keyed).unionByName(by_leader)
    roots = components(links)
    named = kept.join(roots, F.col("cls") == F.col("node"), "left").select(
        "cls", F.coalesce("root", "cls").alias("comp"), "first")
    leads = named.groupBy("comp").agg(F.min("first").alias("lead"))
    named = named.join(leads, "comp").select("cls", "lead")
    return rows.join(named, "cls", "left").select(
        "doc_id", "key", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("lead.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("lead.key")).otherwise(F.col("key")).alias("lead"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their
    component; of fully repeated rows one stays, texts without words all stay."""
    members = common.written(jaccard_components(docs), "members")
    key, = common.fresh(docs, "link_key")
    left_out = common.written(
        members.where(F.col("key") != F.col("lead")).select(F.col("key").alias(key)).distinct(), "left_out")
    stay = docs.withColumn(key, common.row_key()).join(
        common.broadcast_within(left_out, BROADCAST_ROWS), key, "left_anti")
    repeated = common.written(members.where("n_shingles > 0").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
                              .where("rows > 1").select(F.col("key").alias(key)), "repeated")
    if not repeated.isEmpty():
        once = stay.join(repeated, key, "left_semi").dropDuplicates([key])
        stay = stay.join(repeated, key, "left_anti").unionByName(once)
    return stay.select(*docs.columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (shingle)
      WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles,
       least(w.doc_id, min(r.b)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id
"""
