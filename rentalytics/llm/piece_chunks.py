"""SentencePiece encoding and decoding by a table of distinct chunks.

The normalised text begins with a marker (U+2581) and has one for every space.
No piece of the vocabulary has a marker behind another character (checked when
the model is loaded), so no merge crosses the place where a run of markers
begins.  A text is cut there into marked words; each distinct one is segmented
once per worker, and a text's ids are its words' ids joined by position.

Null and empty texts have the end id only and decode to "".  Texts of any
length are encoded whole.  Repeated rows and ids stay separate rows, an empty
table gives an empty one, and columns other than the text are passed on as
they are: a column of the table that is named like a new one keeps its name and
the new one gets underscores before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MARKER = "▁"
#: Marked words that a worker remembers; its table is emptied when it holds more.
TABLE_WORDS = 400_000
BATCH_BYTES = 2 << 20

_WORD = re.compile(f"[ {MARKER}]+[^ {MARKER}]*")
_CROSSING = re.compile(f"[^{MARKER}]{MARKER}")


class PieceCoder:
    """Ids of texts and texts of ids, by one model file."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_file=model)
        names = (self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size()))
        #: Where a piece crosses into the next word (none of the vocabulary given does), texts are encoded whole.
        self.cut = not any(_CROSSING.search(name) for name in names) and self._only_marks_spaces()
        self.table: dict[str, list[int]] = {}

    def _only_marks_spaces(self) -> bool:
        """The model adds one marker in front, keeps every space and changes no character."""
        tried = " a  b\tc\nééＡ "
        return self.pieces.normalize(tried) == MARKER + tried.replace(" ", MARKER)

    def _learn(self, words: list[str]) -> None:
        # A word's first marker is what the model puts before every text; of the marker alone nothing would be left.
        bare = [w for w in words if len(w) == 1]
        rest = [w for w in words if len(w) > 1]
        self.table.update(zip(rest, self.pieces.encode([w[1:] for w in rest], num_threads=1), strict=True))
        self.table.update((w, [self.pieces.piece_to_id(MARKER)]) for w in bare)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of every text, without an end id."""
        if not self.cut:
            return self.pieces.encode([t or "" for t in texts], num_threads=1)
        words = [_WORD.findall(" " + t) if t else [] for t in texts]
        distinct = set().union(*words)
        if len(self.table) + len(distinct) > TABLE_WORDS:
            self.table = {}
        self._learn([w for w in distinct if w not in self.table])
        found = self.table
        return [[i for w in own for i in found[w]] for own in words]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.pieces.decode(own) for own in ids]


_CODERS: dict[str, PieceCoder] = {}


def coder(model: str) -> PieceCoder:
    """One per worker process and model file."""
    if model not in _CODERS:
        _CODERS[model] = PieceCoder(model)
    return _CODERS[model]


def _encoding(model: str, text: str, ids: str, back: str | None, end_id: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sized_batches(batches, text, BATCH_BYTES):
            pieces = coder(model)
            got = pieces.encode(batch.column(text).to_pylist())
            if end_id:
                got = [[*own, pieces.pieces.eos_id()] for own in got]
            out = [*batch.columns, pa.array(got, pa.list_(pa.int32()))]
            names = [*batch.schema.names, ids]
            if back:
                out.append(pa.array(pieces.decode(got), pa.string()))
                names.append(back)
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def encoded(docs: DataFrame, model: str, text: str = "text", end_id: bool = True, decode: bool = False) -> DataFrame:
    """``docs`` with ``ids``, the piece ids of the whole text, and with ``decode``
    also ``decoded``, the text that the model gives back for them."""
    ids, back = common.fresh(docs, "ids", "decoded")
    fields = [*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())),
              *([T.StructField(back, T.StringType())] if decode else [])]
    return common.small_batches(docs).mapInArrow(
        _encoding(model, text, ids, back if decode else None, end_id), T.StructType(fields))


def _decoding(model: str, ids: str, back: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = coder(model).decode([own or [] for own in batch.column(ids).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             [*batch.schema.names, back])

    return run


def decoded(tokens: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the text of each row's ids (null ids: "")."""
    back, = common.fresh(tokens, "decoded")
    fields = [*tokens.schema.fields, T.StructField(back, T.StringType())]
    return common.small_batches(tokens).mapInArrow(_decoding(model, ids, back), T.StructType(fields))


def piece_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op11_piece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, piece_model(), decode=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
