"""Benchmark decontamination with spaced-seed hashes.

A test item and a document share a passage when ``WINDOW`` tokens in a row
of one face ``WINDOW`` tokens in a row of the other and all but two of them
are equal, place by place.  The seeds are fixed masks that ignore some
places of the window: the places are dealt into four classes and every mask
ignores two of them, so whichever two places differ, one mask sees neither.
Hashes of the masked windows of both sides are joined, and every hit is
verified by comparing the two windows token by token (by 64-bit hashes of the
tokens; the seeds read 31 bits of each).

An item of fewer than ``PASSAGE`` tokens ("yes") is no passage: it stands in
texts by chance.  It matches only a document that consists of its tokens.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 13
# Tokens that an item needs to be looked for inside of documents.
PASSAGE = 5
# One token in so many may differ (0.8 of them are equal), two at most, as the masks guarantee; five agree entirely.
EQUAL_OF = 5
CLASSES = 4
# Words of a document taken together; blocks overlap, so no window is lost.
BLOCK = 4096
# Test hashes (rows of about 200 bytes), or keys of dirty documents, up to which a join may broadcast them.
BROADCAST_ROWS = 400_000

# ASCII punctuation is dropped from tokens; letters compare without case.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def masks(window: int) -> list[tuple[int, ...]]:
    """Places that each mask reads.  Windows that must agree entirely have one mask."""
    if needed(window) == window:
        return [tuple(range(window))]
    return [tuple(p for p in range(window) if p % CLASSES not in pair)
            for pair in combinations(range(CLASSES), 2)]


def needed(window: int) -> int:
    """Equal tokens that make a window a hit: all of up to five, all but one of six to nine, all but two of more."""
    return window - (min(window // EQUAL_OF, 2) if window > EQUAL_OF else 0)


def token_codes(text: Column) -> Column:
    """The text's tokens as 64-bit hashes, in order; null gives none."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), common.SPACES + PUNCTUATION, " " * len(common.SPACES))
    words = F.array_remove(F.split(plain, " "), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _factor(mask: int, place: int) -> int:
    """27 bits, fixed per mask and place: sums of 31 bits of a code times these fit in a long."""
    return pow(48271, 1 + mask * 64 + place, (1 << 31) - 1) >> 4


def windows(df: DataFrame, window: int, place: str) -> DataFrame:
    """``df`` (with an array ``codes``) as one row per window: the other
    columns, ``place`` (first token) and ``w0`` .. of the window's codes."""
    kept = [c for c in df.columns if c != "codes"]
    blocks = df.where(F.size("codes") >= window).select(
        *kept, F.explode(F.sequence(F.lit(0), F.size("codes") - window, F.lit(BLOCK))).alias("at"), "codes")
    blocks = blocks.select(*kept, "at", F.slice("codes", F.col("at") + 1, BLOCK + window - 1).alias("codes"))
    count = F.size("codes") - (window - 1)
    facing = F.arrays_zip(*[F.slice("codes", p + 1, count) for p in range(window)])
    rows = blocks.select(*kept, "at", F.posexplode(facing).alias("step", "w"))
    return rows.select(*kept, (F.col("at") + F.col("step")).alias(place),
                       *[F.col("w").getField(str(p)).alias(f"w{p}") for p in range(window)])


def with_seeds(df: DataFrame, window: int, seed: str) -> DataFrame:
    """Rows of ``windows`` once per mask, with the masked window's hash."""
    hashes = [reduce(add, [F.col(f"w{p}").bitwiseAND(F.lit((1 << 31) - 1)) * F.lit(_factor(m, p)) for p in places])
              for m, places in enumerate(masks(window))]
    return df.withColumn(seed, F.explode(F.array(*hashes)))


def shared_windows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per (document key, item) that share a window: key, item_id,
    n_windows, first and last token place of the hits in the document.

    ``docs`` has key and text, ``benchmark`` item_id and text.  Items with
    fewer than WINDOW tokens are windows of their own length (five tokens
    must agree entirely, of six to nine one may differ); with fewer than
    PASSAGE tokens they match documents of exactly these tokens.  Items and
    documents without tokens (null, empty, punctuation only) match nothing;
    repeated items and rows change nothing; other columns are not read.
    """
    items = common.written(
        benchmark.select("item_id", token_codes(F.col("text")).alias("codes")).where(F.size("codes") > 0), "items")
    lengths = [r[0] for r in items.select(F.least(F.size("codes"), F.lit(WINDOW)).alias("n")).distinct().collect()]
    coded = docs.select("key", token_codes(F.col("text")).alias("codes"))
    whole = common.written(items.where(F.size("codes") < PASSAGE).select("item_id", F.col("codes").alias("item_codes")), "short_items")
    found = [coded.where(F.size("codes") < PASSAGE).join(
        common.broadcast_within(whole, BROADCAST_ROWS), F.col("codes") == F.col("item_codes")).select(
            "key", "item_id", F.lit(0).alias("place"), F.size("codes").alias("end"))]
    for window in sorted(n for n in lengths if n >= PASSAGE):
        own = items.where(F.least(F.size("codes"), F.lit(WINDOW)) == window)
        names = [f"w{p}" for p in range(window)]
        test = with_seeds(windows(own, window, "item_place"), window, "seed").select(
            "seed", "item_id", F.array(*names).alias("item_window")).distinct()
        test = common.broadcast_within(common.written(test, "seeds"), BROADCAST_ROWS)
        hits = with_seeds(windows(coded, window, "place"), window, "doc_seed").join(
            test, F.col("doc_seed") == F.col("seed"))
        same = reduce(add, [F.when(F.col(n) == F.get("item_window", F.lit(p)), 1).otherwise(0)
                            for p, n in enumerate(names)])
        found.append(hits.where(same >= needed(window)).select(
            "key", "item_id", "place", (F.col("place") + window).alias("end")))
    # A window can be hit through several masks and by several windows of an item: places count once.
    hit = reduce(DataFrame.unionByName, found).distinct()
    return hit.groupBy("key", "item_id").agg(
        F.countDistinct("place").alias("n_windows"), F.min("place").alias("first_token"), F.max("end").alias("end_token"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document that shares a window with an item: key, n_items,
    item_id (the smallest), n_windows, first_token, end_token.

    ``docs`` needs doc_id and text; key is common.row_key of them, so repeated
    rows are one row here.  Null and empty texts, and empty tables on either
    side, give no rows; null ids are kept like others.
    """
    keyed = docs.select(common.row_key().alias("key"), "text")
    return common.written(shared_windows(keyed, benchmark).groupBy("key").agg(
        F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("item_id"), F.sum("n_windows").alias("n_windows"),
        F.min("first_token").alias("first_token"), F.max("end_token").alias("end_token")), "contaminated")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (all columns) without the documents that share a window with
    an item.  Null and empty texts stay; repeated rows share their fate;
    columns with the names used here (seed_key, key) come out as they were."""
    key, = common.fresh(docs, "seed_key")
    dirty = contamination(docs, benchmark).select(F.col("key").alias(key))
    return docs.withColumn(key, common.row_key()).join(
        common.broadcast_within(dirty, BROADCAST_ROWS), key, "left_anti").select(*docs.columns)


def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, contaminated, and what it shares."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    dirty = contamination(docs, common.table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", common.row_key().alias("key")).join(dirty, "key", "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id",
        F.coalesce("n_windows", F.lit(0)).alias("n_windows"), "first_token", "end_token")
