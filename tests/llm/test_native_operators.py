"""Sharding, exact dedup, mixing and decontamination against brute force."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rentalytics.llm import common, digest_tree, hilbert_shards, queries, source_mix, spaced_seeds

from .conftest import ROWS, SF, collected

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_and_only_steps_to_neighbours(n, bits):
    machine, at = hilbert_shards.curve_table(n), {}
    for cell in itertools.product(range(1 << bits), repeat=n):
        index = state = 0
        for level in range(bits - 1, -1, -1):
            entry = machine[state << n | sum((c >> level & 1) << i for i, c in enumerate(cell))]
            index, state = index << n | entry & ((1 << n) - 1), entry >> n
        at[index] = cell
    assert sorted(at) == list(range(1 << n * bits))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1])) == 1 for i in range(len(at) - 1))


def test_curve_index_equals_its_table(spark):
    cells = spark.createDataFrame(list(itertools.product(range(8), repeat=3)), "a int, b int, c int")
    got = [r[0] for r in cells.select(hilbert_shards.curve_index([F.col(c) for c in "abc"], 3)).collect()]
    assert sorted(got) == list(range(512))


def check_shards(rows, shards=16):
    counts = Counter(r["shard"] for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        own = sorted((r["slot"], r["hilbert"]) for r in rows if r["shard"] == s)
        assert [slot for slot, _ in own] == list(range(len(own)))
        assert [h for _, h in own] == sorted(h for _, h in own)
    ends = [(s, [r["hilbert"] for r in rows if r["shard"] == s]) for s in range(shards)]
    full = [(min(h), max(h)) for _, h in ends if h]
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(full))


def test_shards_of_the_documents(spark):
    rows = collected(queries.QUERIES["op1_hilbert_shards"](spark, SF))
    docs = {r["doc_id"]: r["text"] for r in collected(common.table(spark, SF, "documents"))}
    assert len(rows) == len(docs)
    check_shards(rows)
    import zlib
    assert all(r["size"] == len(docs[r["doc_id"]].encode()) + 1 for r in rows)
    assert all(r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode()) for r in rows)


def test_shards_edge_cases(edge_docs, no_docs, tmp_path):
    rows = collected(hilbert_shards.hilbert_shards(edge_docs))
    assert len(rows) == len(ROWS)
    check_shards(rows)
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in rows)
    assert hilbert_shards.hilbert_shards(no_docs).count() == 0
    hilbert_shards.write_shards(edge_docs, str(tmp_path / "shards"))
    assert edge_docs.sparkSession.read.parquet(str(tmp_path / "shards")).count() == len(ROWS)


def test_text_cells_are_cut_by_whole_values(spark):
    names = ["https://alpha.org", "https://beta.org", "https://gamma.org", "arxiv", "books", None, "", "https://beta.org/é"]
    values = [names[min(i % 11, 7)] for i in range(2000)] + ["hot"] * 1000
    rows = spark.createDataFrame([(v,) for v in values], "source string").repartition(5)
    for cells in (4, 32):
        known = sorted((v for v in values if v is not None), key=lambda v: v.encode())
        want = [known[-(-len(known) * i // cells) - 1] for i in range(1, cells)]
        assert hilbert_shards.text_cuts(rows, "source", cells) == want
    assert hilbert_shards.text_cuts(rows.limit(0), "source", 4) == []
    assert hilbert_shards.text_cuts(rows.where("source is null"), "source", 4) == []


def test_sources_with_a_common_prefix_are_pruned_apart(spark):
    names = ["https://alpha.org", "https://beta.org", "https://gamma.org", "arxiv", "books"]
    rows = spark.createDataFrame([(i, f"text {i % 97} " * (i % 23), "en", names[i * 7 % 5]) for i in range(4000)],
                                 "doc_id long, text string, lang string, source string")
    spread = defaultdict(set)
    for r in hilbert_shards.hilbert_shards(rows).select("source", "shard").collect():
        spread[r.source].add(r.shard)
    # A fifth of the rows fills 3.2 shards; the curve may turn to a source again, but none is strewn over most shards.
    assert max(map(len, spread.values())) <= 8


def brute_dedup(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        text = text or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), doc_id is None, doc_id or 0, doc_id))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_dedup(edge_docs, no_docs, fan_in):
    want = brute_dedup([r[:2] for r in ROWS])
    got = collected(digest_tree.exact_dedup(edge_docs, fan_in))
    assert len(got) == len(ROWS)
    digests = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert {(r["text_sha256"], r["keep_id"], r["group_size"]) for r in got} == {
        (d, keep, size) for d, (keep, size) in digests.items()}
    assert sum(r["kept"] for r in got) == len(want)
    assert digest_tree.exact_dedup(no_docs).count() == 0


def brute_mix(rows):
    """rows: (doc_id, text, source) -> Counter of (doc_id, size, source_size, target, taken)."""
    sized = []
    for doc_id, text, source in rows:
        inner = hashlib.md5((text or "").encode()).hexdigest()
        name = "" if doc_id is None else str(doc_id)
        sized.append((doc_id, len(WORD.findall(text or "")), source, int(hashlib.md5(f"{name}:{inner}".encode()).hexdigest()[:15], 16)))
    totals = Counter()
    for _, size, source, _ in sized:
        totals[source] += size
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        free = [s for s in order if s not in capped]
        left = 1.5 * sum(totals.values()) - sum(2 * totals[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if 2 * totals[s] < weight[s] * level}
        if not more:
            break
        capped |= more
    out = Counter()
    for source in order:
        target, size = min(2.0 * totals[source], weight[source] * level) if source not in capped else 2.0 * totals[source], totals[source]
        copies = int(target // size) if size else 0
        rest, upto, extra = target - copies * size, 0, set()
        by_hash = Counter()
        for _, n, s, h in sized:
            if s == source:
                by_hash[h] += n
        for h in sorted(by_hash):
            if upto + by_hash[h] / 2 <= rest:
                extra.add(h)
            upto += by_hash[h]
        for doc_id, n, s, h in sized:
            if s == source:
                out[doc_id, n, size, round(target, 6), n * (copies + (h in extra))] += 1
    return out


def mix_rows(df):
    hashed = common.written(df.select("doc_id", "source", source_mix.word_count(F.col("text")).alias("size"),
                                      source_mix.mix_hash().alias("hash")), "sizes")
    got = source_mix.mixed(hashed, source_mix.mix_thresholds(hashed)).collect()
    return Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["size"] * r["times"]) for r in got)


def test_mix(spark, edge_docs, no_docs):
    docs = common.table(spark, SF, "documents")
    assert mix_rows(docs) == brute_mix([(r.doc_id, r.text, r.source) for r in docs.collect()])
    want = brute_mix([(r[0], r[1], r[3]) for r in ROWS])
    assert mix_rows(edge_docs) == want
    assert not mix_rows(no_docs)
    copies = source_mix.mix_documents(edge_docs)
    assert copies.columns == edge_docs.columns
    words = sum(k[4] * n for k, n in want.items())
    assert copies.select(F.sum(source_mix.word_count(F.col("text")))).first()[0] == words
    assert source_mix.mix_documents(no_docs).count() == 0


def plain_tokens(text):
    cut = str.maketrans(common.SPACES, " " * len(common.SPACES), spaced_seeds.PUNCTUATION)
    return [w for w in (text or "").lower().translate(cut).split(" ") if w]


# Tokens of a window -> how many of them must be equal, place by place.
EQUAL = {5: 5, 6: 5, 7: 6, 8: 7, 9: 8, 10: 8, 11: 9, 12: 10, 13: 11}


def brute_shared(docs, items):
    """Items below five tokens are whole documents; others are windows of up to 13 tokens."""
    out = set()
    for key, text in docs:
        d = plain_tokens(text)
        for item, other in items:
            t = plain_tokens(other)
            w = min(len(t), 13)
            if 0 < w < 5 and d == t or w >= 5 and any(
                    sum(a == b for a, b in zip(d[i:i + w], t[j:j + w])) >= EQUAL[w]
                    for i in range(len(d) - w + 1) for j in range(len(t) - w + 1)):
                out.add((key, item))
    return out


def test_masks_see_every_pair_of_substitutions():
    assert {w: spaced_seeds.needed(w) for w in range(5, 14)} == EQUAL
    for window in range(5, 14):
        allowed = window - EQUAL[window]
        for changed in itertools.combinations(range(window), allowed):
            assert any(not set(changed) & set(places) for places in spaced_seeds.masks(window))


def test_decontamination(spark, no_docs):
    item = " ".join(f"q{i}" for i in range(20))
    words = item.split()

    def changed(*places):
        return " ".join("x" if i in places else w for i, w in enumerate(words))

    docs = [(1, f"before, {item.upper()}! after"), (2, changed(6, 13)), (3, changed(2, 5, 9, 12, 16)), (4, changed(9)),
            (5, None), (6, ""), (7, "a b c d"), (8, "short ITEM, here"), (9, "zero " * 5000 + item), (9, "zero " * 5000 + item),
            (10, " ".join(words[:13])), (11, " ".join(words[:12])), (None, item), (12, "eins zwei drei vier xxx sechs sieben acht"),
            (13, "So: what is the capital of France?"), (14, "what is the size of France"), (15, "Yes!"), (16, "oh yes indeed"), (17, "!?"),
            (18, "one two xxx four five six"), (19, "one xxx three xxx five six")]
    items = [(1, item), (2, "short item here"), (3, None), (4, ""), (5, "eins zwei drei vier fünf sechs sieben acht"), (None, "a b c d"),
             (6, "what is the capital of"), (7, "yes"), (7, "yes"), (8, "one two three four five six"), (9, "..")]
    frame = spark.createDataFrame([(d, t, "kept") for d, t in docs], "doc_id long, text string, key string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    keyed = spark.createDataFrame([(str(i), t) for i, (_, t) in enumerate(docs)], "key string, text string")
    got = {(int(r["key"]), r["item_id"]) for r in spaced_seeds.shared_windows(keyed, bench).collect()}
    assert got == brute_shared([(i, t) for i, (_, t) in enumerate(docs)], items)
    dirty = {k for k, _ in got}
    assert {docs[k][0] for k in dirty} & set(range(13, 20)) == {13, 15, 18}
    clean = spaced_seeds.clean_documents(frame, bench)
    assert clean.columns == frame.columns
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == Counter(
        d for i, d in enumerate(docs) if i not in dirty)
    assert spaced_seeds.clean_documents(frame, bench.limit(0)).count() == len(docs)
    assert spaced_seeds.clean_documents(no_docs, bench).count() == 0


def test_decontamination_of_the_documents(spark):
    docs = common.table(spark, SF, "documents").collect()
    items = common.table(spark, SF, "benchmark").collect()
    want = {d for d, _ in brute_shared([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])}
    got = queries.QUERIES["op8_spaced_seeds"](spark, SF).collect()
    assert len(got) == len(docs) and {r.doc_id for r in got if r.contaminated} == want


@pytest.mark.parametrize("name", ["op2_digest_tree", "op7_source_mix", "op9_jaccard_join"])
def test_sql_oracles(spark, name):
    from checks import compare
    got = compare.rows_of(queries.QUERIES[name](spark, SF).toPandas())
    assert got == compare.rows_of(compare.duck(SF).execute(queries.SQL[name]).df())
