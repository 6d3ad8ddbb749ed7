"""The pipeline stage by stage: each on what its predecessor kept, against brute force."""

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from rentalytics.llm import byte_cnn, common, dac_tokens

from .conftest import SF
from .test_native_operators import brute_mix, brute_shared
from .test_python_operators import brute_components


def rows_of(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def test_every_stage(spark):
    from tokenizers import Tokenizer

    docs = common.table(spark, SF, "documents")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        result = common.written(stage(spark, docs, SF), "stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert result.columns == docs.columns
        out[name], docs = (docs, result), result

    before, after = out["quality classifier"]
    net = byte_cnn.train_on(before, common.table(spark, SF, "labels"))
    good = {r.doc_id for r in byte_cnn.scored(before, net).collect() if r.score >= 0.5}
    assert Counter(rows_of(after)) == Counter(r for r in rows_of(before) if r[0] in good) and after.count() < before.count()

    before, after = out["n-gram Jaccard join"]
    first = {d for d, n, c in brute_components([r[:2] for r in rows_of(before)]) if d == c or n == 0}
    assert sorted(r[0] for r in rows_of(after)) == sorted(first)

    before, after = out["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    dirty = {d for d, _ in brute_shared([r[:2] for r in rows_of(before)], items)}
    assert sorted(r[0] for r in rows_of(after)) == sorted(r[0] for r in rows_of(before) if r[0] not in dirty)

    before, after = out["mixing sources"]
    taken = {d: t // n if n else 0 for d, n, _, _, t in brute_mix(rows_of(before))}
    assert Counter(r[0] for r in rows_of(after)) == Counter({d: n for d, n in taken.items() if n})

    before, after = out["token output"]
    tokenizer = Tokenizer.from_file(dac_tokens.vocabulary_file())
    start = 0
    got = sorted(map(tuple, after.collect()), key=lambda r: r[1])
    for (doc_id, text, _), row in zip(sorted(rows_of(before)), got, strict=True):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert row == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0
