import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i * 7919 % 5003}" for i in range(20_000))
BASE = " ".join(f"tok{i}" for i in range(120))

# (doc_id, text, lang, source): nulls, empty and white texts, repeated rows, copies, near copies, a very long text.
ROWS = [
    (1, BASE, "en", "a"), (1, BASE, "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \n\t ", "de", "b"),
    (None, "no id but some words here", "en", None), (None, None, None, None), (5, LONG, "fr", "c"),
    (6, BASE.upper(), "en", "a"), (7, BASE + " tail", "en", "b"), (8, BASE.replace(" ", "\n"), "en", "c"),
    (9, "three small words", "es", None), (10, "three small words", "es", "c"), (11, "Été ça œuvre — déjà vu ñ", "fr", "d"),
    (12, BASE.replace("tok60", "changed"), "en", "a"), (13, " ".join(BASE.split()[:60]), "en", "a"),
]
# Names that the operators use themselves.
CLASHING = ("size", "hash", "shard", "slot", "hilbert", "run", "best", "key", "n", "cls", "part", "score", "rank",
            "mix", "times", "seed_key", "link_key", "mix_copy", "place", "before", "spans")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), *[
    T.StructField(c, T.StringType()) for c in ("text", "lang", "source", *CLASHING)]])


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(*r, *(f"{c}{i % 3}" for c in CLASHING)) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4, "doc_id")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return [r.asDict() for r in df.collect()]
