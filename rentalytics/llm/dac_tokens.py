"""Token ids in directly addressable codes.

An id is split into 8-bit chunks.  Level 0 has the lowest chunk of every id,
level 1 the next chunk of the ids that need one, and so on; a bitmap per
level says which ids go on, and a rank directory counts its ones up to every
512th bit.  Place i of a level continues at place rank(i) of the next one, so
any id, or run of ids, is read without decoding what stands before it.

Documents are laid out in ascending doc_id order (null last) as segments:
rows of a parquet table in the shared folder, each with the codes of a run
of whole documents and the place where every document ends.
"""

from __future__ import annotations

import os
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import common

CHUNK_BITS = 8
RANK_BITS = 512
SEGMENT_IDS = 1 << 18
END_ID = 1
# Pieces of words whose ids a worker remembers (the memory is emptied when it
# is full), and pieces encoded in one call.
MEMORY_PIECES = 600_000
CALL_PIECES = 1000
BATCH_BYTES = 2 << 20
# The vocabulary's marker between texts, and what all its markers begin with.
BETWEEN = "<|endoftext|>"
MARKER = "<|"
# Letters that the vocabulary's NFC and lower case turn into something that ends in a mark, which closing
# punctuation joins: U+0130 and those that NFC takes apart (nukta letters, presentation forms).
_END_IN_MARK = "".join(f"\\x{{{ord(c):x}}}" for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] == "L"
                       and unicodedata.category(unicodedata.normalize("NFC", c).lower()[-1])[0] == "M")
_TAIL = rf"^(?P<stem>.*(?:[^{_END_IN_MARK}\P{{L}}]|\p{{N}}))(?P<tail>[*$%&#.,!?;:]+)$"
# Capitals before a mark that NFC joins to the small letter only: lower-cased first, such a text has other ids.
_SMALL_ONLY = r"[HJTWY]\p{M}"

LEVELS = "array<struct<codes:binary,more:binary,ranks:binary>>"
SEGMENT = (f"part int, seg int, first_id long, n_ids long, doc_ids array<long>, doc_ends array<long>, levels {LEVELS}")


def encode_levels(ids: np.ndarray) -> list[dict[str, bytes]]:
    """The levels of ``ids`` (unsigned 32-bit); no ids give one empty level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        higher = rest >> CHUNK_BITS
        goes_on = higher > 0
        bits = np.packbits(goes_on, bitorder="little")
        blocks = np.zeros(len(rest) // RANK_BITS + 1, np.int64)
        ends = np.add.reduceat(goes_on.astype(np.int64), np.arange(0, len(rest), RANK_BITS)) if len(rest) else []
        blocks[1:] = np.cumsum(ends)[:len(blocks) - 1]
        levels.append({"codes": (rest & 0xFF).astype(np.uint8).tobytes(), "more": bits.tobytes(),
                       "ranks": blocks.astype("<u4").tobytes()})
        if not goes_on.any():
            return levels
        rest = higher[goes_on]


class Codes:
    """Random access to the ids of one segment's levels."""

    def __init__(self, levels: list[dict[str, bytes]]):
        self.levels = [(np.frombuffer(x["codes"], np.uint8), np.frombuffer(x["more"], np.uint8),
                        np.frombuffer(x["ranks"], "<u4")) for x in levels]

    def rank(self, level: int, place: int) -> int:
        """Ids of the level before ``place`` that go on."""
        _, more, ranks = self.levels[level]
        block = place // RANK_BITS
        bits = np.unpackbits(more[block * RANK_BITS // 8:(place + 7) // 8], bitorder="little")
        return int(ranks[block]) + int(bits[:place - block * RANK_BITS].sum())

    def run(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to before ``end``."""
        ids = np.zeros(end - start, np.uint32)
        which = np.arange(end - start)
        for level, (codes, more, _) in enumerate(self.levels):
            ids[which] |= codes[start:end].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            first = start // 8
            goes_on = np.unpackbits(more[first:(end + 7) // 8], bitorder="little")[start - first * 8:end - first * 8]
            which = which[goes_on.astype(bool)]
            if not len(which):
                break
            start = self.rank(level, start)
            end = start + len(which)
        return ids

    def __getitem__(self, place: int) -> int:
        return int(self.run(place, place + 1)[0])


class WordEncoder:
    """Ids of texts, from the ids of their words.

    The vocabulary lower-cases, and its merges cross neither white space nor
    the place where closing punctuation follows a letter or digit.  So A-Z
    are lower-cased, words are cut into stem and tail there, and every
    distinct piece is encoded once, many in one call with the end marker
    between them.  Texts with a marker of their own, or with capitals whose
    marks join the small letter only, are encoded whole.
    """

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.between = self.tokenizer.token_to_id(BETWEEN)
        self._forget()

    def _forget(self) -> None:
        # Entry 0 has no ids, entry 1 the end id; a piece's entry is its place among the known ones.
        self.known, self.tails = pa.array(["", BETWEEN]), {"": 0}
        self.ids, self.ends = array("I", [END_ID]), array("q", [0, 0, 1])

    def _ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, pieces: pa.Array) -> None:
        self.known = pa.concat_arrays([self.known, pieces])
        for at in range(0, len(pieces), CALL_PIECES):
            own = pieces.slice(at, CALL_PIECES).to_pylist()
            got = np.array([*self._ids_of(BETWEEN.join(own)), self.between], np.uint32)
            cuts = np.flatnonzero(got == self.between)
            self.ends.frombytes((len(self.ids) + cuts - np.arange(len(cuts))).astype(np.int64).tobytes())
            self.ids.frombytes(got[got != self.between].tobytes())

    def _tail_entries(self, pieces: pa.Array) -> np.ndarray:
        """Tails are few: their entries are kept by name."""
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        new = [name for name in names if name not in self.tails]
        self.tails.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self._learn(pa.array(new, pa.string()))
        return np.array([self.tails[name] for name in names], np.int64)[coded.indices.to_numpy()]

    def _entries(self, pieces: pa.Array) -> np.ndarray:
        coded = pieces.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.known)
        numbers = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        new = numbers < 0
        if new.any():
            numbers[new] = len(self.known) + np.arange(new.sum())
            self._learn(coded.dictionary.filter(pa.array(new)))
        return numbers[coded.indices.to_numpy()]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by END_ID, and the number of each text's."""
        texts = pc.fill_null(texts, "")
        whole = pc.or_(pc.match_substring(texts, MARKER), pc.match_substring_regex(texts, _SMALL_ONLY))
        marked = pc.indices_nonzero(whole).to_pylist()
        plain = texts if not marked else pc.if_else(whole, "", texts)
        words = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        coded = words.flatten().dictionary_encode()
        cut = pc.extract_regex(coded.dictionary, _TAIL)
        stems = pc.if_else(cut.is_valid(), pc.struct_field(cut, "stem"), coded.dictionary)
        tails = pc.fill_null(pc.struct_field(cut, "tail"), "")
        if len(self.known) > MEMORY_PIECES:
            self._forget()
        entry = np.stack([self._entries(stems), self._tail_entries(tails)], 1)
        offsets = words.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        which = coded.indices.to_numpy() if len(coded) else np.zeros(0, np.int64)
        run = np.insert(entry[which], offsets[1:], (0, 1), axis=0).ravel()
        ends, ids = np.frombuffer(self.ends, np.int64), np.frombuffer(self.ids, np.uint32)
        starts, sizes = ends[:-1][run], np.diff(ends)[run]
        upto = np.cumsum(sizes)
        got = ids[np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)]
        counts = np.diff(upto[2 * (offsets[1:] + np.arange(len(texts))) + 1], prepend=0)
        if not marked:
            return got, counts
        parts = np.split(got, np.cumsum(counts)[:-1])
        for text in marked:
            parts[text] = np.array([*self._ids_of(texts[text].as_py()), END_ID], np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(vocabulary: str) -> WordEncoder:
    """One per worker process and vocabulary file."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = WordEncoder(vocabulary)
    return _ENCODERS[vocabulary]


def _segments(vocabulary: str, segment_ids: int):
    names = ["part", "seg", "first_id", "n_ids", "doc_ids", "doc_ends", "levels"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
             pa.list_(pa.struct([("codes", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())]))]

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seg, first = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        counts: list[int] = []
        total = 0

        def row() -> pa.RecordBatch:
            nonlocal seg, first, total
            ids = np.concatenate(held)
            values = [part, seg, first, len(ids), list(doc_ids), np.cumsum(counts).tolist(), encode_levels(ids)]
            seg, first, total = seg + 1, first + len(ids), 0
            held.clear(), doc_ids.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

        for batch in common.sized_batches(batches, "text", BATCH_BYTES):
            ids, each = encoder(vocabulary)(batch.column("text"))
            start = 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), each.tolist(), strict=True):
                held.append(ids[start:start + n])
                doc_ids.append(doc_id)
                counts.append(n)
                start, total = start + n, total + n
                if total >= segment_ids:
                    yield row()
        if counts:
            yield row()

    return lay


def write_tokens(docs: DataFrame, path: str, vocabulary: str, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every whole text and write the segments.

    Documents follow each other by doc_id, null last; repeated ids are
    ordered by a hash of the text.  Null and empty texts have the end id
    only.  An empty table writes no segment.
    """
    ordered = docs.select("doc_id", "text").orderBy(
        F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).select("doc_id", "text")
    common.small_batches(ordered).mapInArrow(_segments(vocabulary, segment_ids), SEGMENT).write.parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``: ids of all documents before the segment.
    Only the id counts of the parts (one row each) are summed up in order."""
    segments = common.small_batches(spark.read.schema(SEGMENT).parquet(path))
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))
    return (segments.join(F.broadcast(starts), "part")  # one row per written part
            .withColumn("start", F.col("before") + F.col("first_id")).drop("before"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for segment in batch.to_pylist():
            ends = segment["doc_ends"]
            starts = [0, *ends[:-1]]
            ids = Codes(segment["levels"]).run(0, ends[-1]).astype("<u4")  # every document is wanted: one run
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(segment["doc_ids"], pa.int64()), pa.array(np.array(starts, np.int64) + segment["start"]),
                pa.array(np.array(ends, np.int64) - np.array(starts, np.int64)), pa.array(crcs, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    return read_segments(spark, path).select("start", "doc_ids", "doc_ends", "levels").mapInArrow(
        _digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for segment in batch.to_pylist():
            codes = Codes(segment["levels"])
            got = [codes[p - segment["start"]] for p in segment["places"]]
            yield pa.RecordBatch.from_arrays([pa.array(segment["places"], pa.int64()), pa.array(got, pa.int64())],
                                             ["place", "id"])


def ids_at(spark: SparkSession, path: str, places: list[int]) -> DataFrame:
    """The ids at the given places of the whole token sequence: only the
    segments that hold one are read, and nothing in them is decoded."""
    wanted = F.filter(F.array(*[F.lit(p).cast("long") for p in places]),
                      lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("n_ids")))
    return (read_segments(spark, path).withColumn("places", wanted).where(F.size("places") > 0)
            .select("start", "places", "levels").mapInArrow(_ids, "place long, id long"))


def encoded_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write the segments of ``docs`` in the shared folder and read them back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "dac")
    write_tokens(docs, path, vocabulary)
    return token_digests(spark, path)


def vocabulary_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op10_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(common.table(spark, sf_dir, "documents"), vocabulary_file())
