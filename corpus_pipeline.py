"""The training-data pipeline: documents through the stages of STAGES.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rentalytics.llm import byte_cnn, common, dac_tokens, jaccard_join, source_mix, spaced_seeds


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network, trained on the labelled rows, accepts.

    Null and empty texts have the score of an empty document and share one
    fate; repeated rows stay or go together; no documents give none.  Without
    labels nothing can be learnt: every score is 0.5 and every document stays.
    """
    return byte_cnn.accepted(docs, byte_cnn.train_on(docs, common.table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every component of five-word Jaccard links of 0.8 or more.

    The first has the smallest doc_id (null last); of fully repeated rows one
    stays.  Texts without words (null, empty, white) are linked with nothing
    and all stay; no documents give none.
    """
    return jaccard_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item.

    Null and empty texts stay; repeated rows share their fate; without
    documents or items nothing goes.
    """
    return spaced_seeds.clean_documents(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: each row as often as the mix takes it.

    A null source is a source.  Documents without words have size 0 and are
    taken with their hash like others; repeated rows have one hash and are
    taken alike; no documents give none.
    """
    return source_mix.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids in directly addressable codes, read back per document.

    One row per row of the mix: a null or empty text has the end id only,
    repeated rows are written each; no documents give no rows.
    """
    return dac_tokens.encoded_digests(docs, dac_tokens.vocabulary_file())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("token output", tokens),
]

# SQL cannot express the trained classifier and the tokenizer: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written in the shared folder."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
