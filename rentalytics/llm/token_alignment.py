"""Alignment of two tokenizers' tokens over the bytes of the same text.

A is a byte-level vocabulary, B a piece vocabulary; both cut the bytes of a
space and the text.  Per batch of documents two merge_asof runs, keyed by
document, find for every token start the token of the other side that covers
it.  Of two overlapping tokens the one that begins later begins inside the
other, so the union of both directions is all overlaps.  Places where tokens
of both sides end cut the tokens into groups.

Null and empty texts, and texts that either vocabulary's tokens do not give
back byte by byte, have no tokens: zeros, and groups "".  Texts of any length
are aligned whole.  Repeated rows and ids stay separate rows (each counts as a
document), an empty table gives an empty one, and further columns of the
documents, whatever their names, are not read.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, piece_chunks

#: Chunks that a worker remembers the ids of; its table is emptied when it holds more.
TABLE_CHUNKS = 500_000
BATCH_BYTES = 1 << 20
#: Linked id pairs whose counts are broadcast (under 100 MB); with more the join is a shuffle.
PAIRS_BROADCAST = 1_000_000
#: An id pair as one number: the A id above these bits, the B id below.
B_BITS = 20

ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
           "pairs array<long>, times array<int>")
_NAMES = [field.split()[0] for field in ALIGNED.split(", ")]

# The bytes before a single space between two characters that are neither white space nor a marker are
# cut off by both vocabularies: A's pre-tokenizer begins a word there, and no piece of B crosses it.
# Whatever else stands between two words stays inside a chunk, so every chunk begins with a space.
_CHUNK = re.compile(r"[\s▁]*[^\s▁]+(?:(?! [^\s▁])[\s▁]+[^\s▁]*)*|[\s▁]+")


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable
    ones for themselves, the others for the letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(0x100) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteCoder:
    """Ids of texts by a byte-level vocabulary; a marker of it in a text is plain text."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        letters = _byte_letters()
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for entry, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = bytes(letters[c] for c in entry)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of a space and each text."""
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceSide:
    """The piece vocabulary in the same form; it puts the space before a text itself."""

    def __init__(self, model: str):
        self.coder = piece_chunks.coder(model)
        pieces = self.coder.pieces
        self.bytes = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i)
                      else pieces.id_to_piece(i).replace(piece_chunks.MARKER, " ").encode()
                      for i in range(pieces.get_piece_size())]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.pieces.encode(texts, num_threads=1)


class Chunks:
    """The ids of every chunk seen, by one vocabulary, one after the other."""

    def __init__(self, coder: ByteCoder | PieceSide):
        self.coder, self.sizes = coder, np.array([len(x) for x in coder.bytes])
        self.ids, self.ends, self.whole = array("I"), array("q", [0]), array("b")

    def learn(self, chunks: list[str]) -> None:
        """``whole``: do the tokens' bytes give the chunk back?"""
        for chunk, ids in zip(chunks, self.coder.encode([c[1:] for c in chunks]), strict=True):
            self.ids.extend(ids)
            self.ends.append(len(self.ids))
            self.whole.append(b"".join([self.coder.bytes[i] for i in ids]) == chunk.encode())

    def tokens(self, entries: np.ndarray, counts: np.ndarray) -> Tokens:
        """The tokens of the documents that have ``counts`` of the chunks ``entries`` each."""
        ids, ends = np.frombuffer(self.ids, np.uint32), np.frombuffer(self.ends, np.int64)
        starts, sizes = ends[entries], ends[entries + 1] - ends[entries]
        upto = np.append(0, np.cumsum(sizes))
        got = ids[np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])].astype(np.int64)
        return Tokens(got, np.diff(upto[np.append(0, np.cumsum(counts))]), self.sizes)


class Tokens:
    """One side's tokens of a batch of documents, by places in the batch's bytes."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray):
        self.ids, self.counts = ids, counts
        self.doc = np.repeat(np.arange(len(counts)), counts)
        size = sizes[ids]
        self.ends = np.cumsum(size)
        self.starts = self.ends - size

    def frame(self, name: str) -> pd.DataFrame:
        return pd.DataFrame({"doc": self.doc, "at": self.starts, name: np.arange(len(self.ids))})


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``a`` and ``b`` of all pairs of tokens that share a byte."""
    fa, fb = a.frame("a"), b.frame("b")
    over_a = pd.merge_asof(fa, fb, on="at", by="doc")
    over_b = pd.merge_asof(fb, fa, on="at", by="doc")
    inside = a.starts[over_b.a.to_numpy()] < b.starts  # equal starts are in the other direction
    return (np.concatenate([over_a.a.to_numpy(), over_b.a.to_numpy()[inside]]),
            np.concatenate([over_a.b.to_numpy(), over_b.b.to_numpy()[inside]]))


# What follows an id in a group's text: the next of its side, its group's other side, or the next group.
_AFTER = (",", "|", ";")


@functools.cache
def _written_ids(most: int) -> np.ndarray:
    return np.array([f"{i}{after}" for after in _AFTER for i in range(most)], object)


def _group_texts(a: Tokens, b: Tokens, cuts: np.ndarray) -> list[str]:
    """Per document ``a1,a2|b1;a3|b2,b3``: its groups' ids of both sides."""
    most = int(max(a.ids.max(initial=0), b.ids.max(initial=0))) + 1
    names = _written_ids(1 << most.bit_length())
    last_a, last_b = (np.searchsorted(side.ends, cuts) for side in (a, b))  # the token with which each group ends
    text = np.empty(len(a.ids) + len(b.ids), object)
    for side, last, after, before in ((a, last_a, 1, np.append(0, last_b + 1)), (b, last_b, 2, last_a + 1)):
        group = np.searchsorted(last, np.arange(len(side.ids)))
        code = np.zeros(len(side.ids), np.int64)
        code[last] = after * (1 << most.bit_length())
        text[np.arange(len(side.ids)) + before[group]] = names[side.ids + code]
    ends = np.cumsum(a.counts + b.counts)
    return ["".join(text[start:end])[:-1] for start, end in zip(ends - a.counts - b.counts, ends, strict=True)]


class Aligner:
    """Alignments of texts, with a table of the chunks that a worker has seen."""

    def __init__(self, vocabulary: str, model: str):
        self.coders = ByteCoder(vocabulary), PieceSide(model)
        if not self.coders[1].coder.cut:
            raise ValueError("the piece vocabulary has pieces that cross words")
        self._forget()

    def _forget(self) -> None:
        self.entry: dict[str, int] = {}
        self.sides = [Chunks(coder) for coder in self.coders]

    def _tokens(self, texts: list[str | None]) -> list[Tokens]:
        chunks = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        flat = [c for own in chunks for c in own]
        distinct = set(flat)
        if len(self.entry) + len(distinct) > TABLE_CHUNKS:
            self._forget()
        new = list(distinct.difference(self.entry))
        self.entry.update(zip(new, range(len(self.entry), len(self.entry) + len(new)), strict=True))
        for side in self.sides:
            side.learn(new)
        entries = np.fromiter(map(self.entry.__getitem__, flat), np.int64, len(flat))
        counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
        whole = np.logical_and(*(np.frombuffer(side.whole, np.int8)[entries] for side in self.sides)) if len(flat) else []
        doc = np.repeat(np.arange(len(texts)), counts)
        broken = np.bincount(doc[~np.asarray(whole, bool)], minlength=len(texts)) > 0
        if broken.any():
            entries, counts = entries[~broken[doc]], np.where(broken, 0, counts)
        return [side.tokens(entries, counts) for side in self.sides]

    def __call__(self, texts: list[str | None]) -> dict[str, pa.Array]:
        """The columns of ALIGNED but doc_id, for each text."""
        a, b = self._tokens(texts)
        in_a, in_b = overlaps(a, b)
        cuts = np.intersect1d(a.ends, b.ends, assume_unique=True)
        # One number per document and id pair, so that one plain sort brings equal ones together.
        bits = B_BITS + max(len(self.coders[0].bytes), 1).bit_length()
        links = np.sort(a.doc[in_a] << bits | a.ids[in_a] << B_BITS | b.ids[in_b])
        first = np.flatnonzero(np.diff(links, prepend=-1))
        doc, pair = links[first] >> bits, links[first] & ((1 << bits) - 1)
        upto = np.append(0, np.cumsum(np.bincount(doc, minlength=len(texts)))).astype(np.int32)
        times = np.diff(np.append(first, len(links)))
        return {
            "n_a": pa.array(a.counts), "n_b": pa.array(b.counts),
            "n_groups": pa.array(np.bincount(a.doc[np.searchsorted(a.ends, cuts)], minlength=len(texts))),
            "n_links": pa.array(np.bincount(links >> bits, minlength=len(texts))),
            "groups": pa.array(_group_texts(a, b, cuts), pa.string()),
            "pairs": pa.ListArray.from_arrays(upto, pa.array(pair, pa.int64())),
            "times": pa.ListArray.from_arrays(upto, pa.array(times, pa.int32())),
        }


@functools.cache
def aligner(vocabulary: str, model: str) -> Aligner:
    """One per worker process and pair of vocabulary files."""
    return Aligner(vocabulary, model)


def _aligning(vocabulary: str, model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sized_batches(batches, "text", BATCH_BYTES):
            got = aligner(vocabulary, model)(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *got.values()], _NAMES)

    return run


def aligned(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """One row per document: numbers of tokens, groups and links, the ``groups`` as text,
    and the distinct linked id ``pairs`` (``a << B_BITS | b``) with how often each is linked."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.small_batches(source).mapInArrow(_aligning(vocabulary, model), ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, docs, best) of all linked id pairs: the documents that hold the pair,
    and whether no pair of the same A id is in more.  ``rows`` have ``pairs``,
    distinct per row; every task counts its own rows before the shuffle."""
    counts = common.written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair")
                            .agg(F.count(F.lit(1)).alias("docs")), "pair_counts")
    a_id = F.shiftright("pair", B_BITS)
    most = counts.groupBy(a_id.alias("a")).agg(F.max("docs").alias("most"))
    return (counts.withColumn("a", a_id).join(most, "a")
            .select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))


def linked(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """Per document the alignment's numbers, ``groups_sha256``, and over its links
    ``n_best`` (count is the A id's highest) and ``count_sum`` (of the counts)."""
    rows = common.written(
        aligned(docs, vocabulary, model)
        .withColumn("groups_sha256", F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)))
        .drop("groups").withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = common.written(pair_counts(rows), "best_pairs")
    links = (rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link"))
             .select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times")))
    sums = (links.join(common.broadcast_within(counts, PAIRS_BROADCAST), "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                 F.sum(F.col("times") * F.col("docs")).alias("count_sum")))
    return rows.drop("pairs", "times").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")


def byte_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(common.table(spark, sf_dir, "documents"), byte_vocabulary(), piece_chunks.piece_model())
