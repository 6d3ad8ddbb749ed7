"""Quality classifier: a convolutional network over bytes, in numpy.

Bytes are embedded; learned filters look at chunks of CHUNK bytes that
overlap by half and cover the whole document; each filter's largest response
over all chunks is kept, and a logistic unit combines them into one
probability.  The network is trained on a bounded sample of labelled rows
and then scores every document in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CHUNK = 16
STRIDE = 8
EMBEDDING = 8
FILTERS = 32
EPOCHS = 10
STEP_DOCS = 32
RATE = 0.004
# The documented bound of the training sample, per class: labelled rows, and bytes of their
# texts together.  Texts are whole whatever their length; long ones make the sample smaller
# (the one that passes the bound is the last).  Scoring has no bound.
SAMPLE_PER_CLASS = 1500
SAMPLE_BYTES = 6_000_000
# Bytes scored together, and chunks per matrix product.
BATCH_BYTES = 1 << 20
PRODUCT_CHUNKS = 1 << 14


def held_out() -> Column:
    """Rows whose labels are never learnt from (a null id has no label to learn)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def chunk_starts(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of every chunk; a document of any size has one at least."""
    counts = np.maximum(1, -(-(sizes - CHUNK) // STRIDE) + 1)
    firsts = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(sizes)), counts)
    return doc, (np.arange(len(doc)) - firsts[doc]) * STRIDE


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks as rows of byte codes 1 .. 256 (0 beyond the end), and the first chunk of each document."""
    doc, start = chunk_starts(np.diff(offsets))
    places = (offsets[doc] + start)[:, None] + np.arange(CHUNK)
    inside = places < offsets[doc + 1][:, None]
    codes = np.zeros(places.shape, np.int16)
    codes[inside] = data[places[inside]].astype(np.int16) + 1
    return codes, np.flatnonzero(np.diff(doc, prepend=-1))


@dataclass
class Network:
    prior: float = 0.5
    embedding: np.ndarray | None = None
    filters: np.ndarray | None = None
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    shift: float = 0.0
    _moments: dict = field(default_factory=dict, repr=False)

    def responses(self, codes: np.ndarray) -> np.ndarray:
        parts = [self.embedding[codes[i:i + PRODUCT_CHUNKS]].reshape(-1, CHUNK * EMBEDDING) @ self.filters
                 for i in range(0, len(codes), PRODUCT_CHUNKS)]
        return np.concatenate(parts)

    def strongest(self, codes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response in each document and the chunk that gives it, by blocks of chunks."""
        ends = np.append(firsts[1:], len(codes))
        value = np.full((len(firsts), self.filters.shape[1]), -np.inf, np.float32)
        place = np.zeros(value.shape, np.int64)
        for at in range(0, len(codes), PRODUCT_CHUNKS):
            seen = self.responses(codes[at:at + PRODUCT_CHUNKS])
            for d in range(np.searchsorted(ends, at, "right"), np.searchsorted(firsts, at + len(seen))):
                a, b = max(firsts[d] - at, 0), min(ends[d] - at, len(seen))
                best = seen[a:b].argmax(0)
                top = np.take_along_axis(seen[a:b], best[None], 0)[0]
                place[d] = np.where(top > value[d], at + a + best, place[d])
                value[d] = np.maximum(top, value[d])
        return value, place

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of label 1 per document (the training share where nothing could be learnt)."""
        if self.filters is None:
            return np.full(len(offsets) - 1, self.prior)
        codes, firsts = chunks(data, offsets)
        pooled = np.maximum(np.maximum.reduceat(self.responses(codes), firsts) + self.bias, 0)
        return 1 / (1 + np.exp(-(pooled @ self.out + self.shift).astype(np.float64)))


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, prior: float, seed: int = 7) -> Network:
    """Adam on the weighted log loss.  One class only gives the prior as score."""
    net = Network(prior=prior)
    if len(set(labels.tolist())) < 2:
        return net
    rng = np.random.default_rng(seed)
    net.embedding = rng.normal(0, 0.5, (257, EMBEDDING)).astype(np.float32)
    net.embedding[0] = 0
    net.filters = rng.normal(0, 1 / np.sqrt(CHUNK), (CHUNK * EMBEDDING, FILTERS)).astype(np.float32)
    net.bias = np.zeros(FILTERS, np.float32)
    net.out = rng.normal(0, 0.1, FILTERS).astype(np.float32)
    net.shift = float(np.log(prior / (1 - prior)))
    blobs = [t.encode() for t in texts]
    first, second, step = {}, {}, 0

    def move(name: str, gradient) -> None:
        first[name] = 0.9 * first.get(name, 0) + 0.1 * gradient
        second[name] = 0.999 * second.get(name, 0) + 0.001 * gradient * gradient
        by = RATE * (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)
        setattr(net, name, getattr(net, name) - by)

    for _ in range(EPOCHS):
        order = rng.permutation(len(blobs))
        for at in range(0, len(order), STEP_DOCS):
            rows = order[at:at + STEP_DOCS]
            step += 1
            offsets = np.cumsum([0, *(len(blobs[r]) for r in rows)])
            codes, firsts = chunks(np.frombuffer(b"".join(blobs[r] for r in rows), np.uint8), offsets)
            value, best = net.strongest(codes, firsts)
            pooled = np.maximum(value + net.bias, 0)
            chance = 1 / (1 + np.exp(-(pooled @ net.out + net.shift)))
            miss = ((chance - labels[rows]) * weights[rows] / weights[rows].sum()).astype(np.float32)
            back = miss[:, None] * net.out * (pooled > 0)
            picked = codes[best]  # documents x filters x CHUNK
            shown = net.embedding[picked].reshape(*best.shape, CHUNK * EMBEDDING)
            to_filters = np.einsum("df,dfk->kf", back, shown)
            to_bytes = (back[:, :, None] * net.filters.T[None]).reshape(-1, EMBEDDING)
            to_embedding = np.zeros_like(net.embedding)
            np.add.at(to_embedding, picked.reshape(-1), to_bytes)
            to_embedding[0] = 0
            move("out", pooled.T @ miss)
            move("shift", float(miss.sum()))
            move("bias", back.sum(0))
            move("filters", to_filters)
            move("embedding", to_embedding)
    net.embedding, net.filters = net.embedding.astype(np.float32), net.filters.astype(np.float32)
    return net


def train_on(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Network:
    """A network for ``label`` from a sample of the labelled rows that are not held out.

    Rows are taken by a hash of their id, SAMPLE_PER_CLASS rows and about
    SAMPLE_BYTES of each class at most, and weigh as much as their class has in
    all labelled rows.  Null labels, null ids and null texts are ignored; of
    contradicting labels the smallest counts, of rows with one id the shortest
    text.  Without labels, or without documents of them, every score is the prior.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.min(label).alias("label")))
    known = common.written(known, "known_labels")
    counts = {r["label"]: r["count"] for r in known.where(F.col("label").isin(0, 1)).groupBy("label").count().collect()}
    total = sum(counts.values())
    if not total:
        return Network()
    order = F.xxhash64("doc_id")
    sample = None
    for value in sorted(counts):
        some = known.where((F.col("label") == value) & common.in_share("doc_id", SAMPLE_PER_CLASS, counts[value]))
        part = some.orderBy(order, "doc_id").limit(SAMPLE_PER_CLASS)
        sample = part if sample is None else sample.unionByName(part)
    # Of rows with one id the shortest is learnt from, null texts never: 2 * SAMPLE_PER_CLASS narrow rows at most.
    face = F.struct(F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("hash"))
    sizes = (docs.where(F.col("text").isNotNull()).select("doc_id", face.alias("face"))
             .join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("face").alias("face"))
             .orderBy(order, "doc_id").collect())
    held, chosen = dict.fromkeys(counts, 0), []
    for r in sizes:
        if held[r["label"]] < SAMPLE_BYTES:
            held[r["label"]] += r["face"]["bytes"]
            chosen.append((r["doc_id"], r["label"], *r["face"]))
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int, bytes int, hash long")
    faced = docs.select("doc_id", "text", F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("hash"))
    rows = (faced.join(F.broadcast(wanted), ["doc_id", "bytes", "hash"])
            .dropDuplicates(["doc_id"]).orderBy(order, "doc_id").collect())
    values = np.array([r["label"] for r in rows], np.float64)
    if not len(values):
        return Network(prior=counts.get(1, 0) / total)
    shares = {v: counts[v] / max((values == v).sum(), 1) for v in counts}
    weights = np.array([shares[v] for v in values.astype(int)])
    return train([r["text"] for r in rows], values, weights, counts.get(1, 0) / total)


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of every row of ``docs``; a null text counts as empty.

    Repeated rows are scored each and alike; an empty table gives no rows;
    columns but doc_id and text are not read.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sized_batches(batches, "text", BATCH_BYTES):
            got = net.scores(*common.text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    return common.small_batches(docs).select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def accepted(docs: DataFrame, net: Network, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose score is ``least`` or more.

    Null and empty texts have the score of an empty document and share one
    fate; repeated rows are kept or dropped together.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sized_batches(batches, "text", BATCH_BYTES):
            yield batch.filter(pa.array(net.scores(*common.text_bytes(batch.column("text"))) >= least))

    return common.small_batches(docs).mapInArrow(keep, docs.schema)


def op3_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    net = train_on(docs, common.table(spark, sf_dir, "labels"))
    return scored(docs, net).select("doc_id", held_out().alias("held_out"), "score",
                                    F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
