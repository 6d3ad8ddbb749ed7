"""Classifier, scans, extraction, Jaccard join and token output against brute force."""

import hashlib
import html
import itertools
import random
import re
import sys
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rentalytics.llm import (
    byte_cnn,
    common,
    components,
    dac_tokens,
    dom_boost,
    jaccard_join,
    license_scan,
    queries,
    secret_scan,
    shingles,
)

from .conftest import LONG, ROWS, SF, collected

SMALL = "/root/testdata/sf0.01"


# --- classifier ---------------------------------------------------------------
def auc(scores, labels):
    ranks = np.argsort(np.argsort(scores))
    good = labels == 1
    return (ranks[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


def test_quality_on_held_out_rows(spark):
    rows = queries.QUERIES["op3_byte_cnn"](spark, SMALL).toPandas()
    docs = common.table(spark, SMALL, "documents")
    assert sorted(rows.doc_id) == sorted(r[0] for r in docs.select("doc_id").collect())
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(rows.doc_id, rows.held_out))
    labels = common.table(spark, SMALL, "labels").toPandas()
    held = rows[rows.held_out].merge(labels, on="doc_id")
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.9
    assert (held.predicted == (held.score >= 0.5)).all()


def test_held_out_labels_are_never_used(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    flipped = labels.withColumn("quality", F.when(byte_cnn.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = (sorted(map(tuple, byte_cnn.scored(docs, byte_cnn.train_on(docs, x)).collect())) for x in (labels, flipped))
    assert one == other


def test_classifier_edge_cases(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (12, 1), (None, 0), (6, None)], "doc_id long, quality int")
    for known in (labels, labels.where("quality = 1"), labels.limit(0)):
        net = byte_cnn.train_on(edge_docs, known)
        got = byte_cnn.scored(edge_docs, net).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
        assert byte_cnn.scored(no_docs, net).count() == 0
        kept = byte_cnn.accepted(edge_docs, net)
        assert kept.columns == edge_docs.columns and kept.count() == sum(r["score"] >= 0.5 for r in got)


def plain_score(net, text):
    """One document's score, chunk by chunk."""
    raw, best = (text or "").encode(), [-np.inf] * byte_cnn.FILTERS
    for start in range(0, max(len(raw) - byte_cnn.CHUNK, 0) + byte_cnn.STRIDE, byte_cnn.STRIDE):
        chunk = [b + 1 for b in raw[start:start + byte_cnn.CHUNK]]
        chunk += [0] * (byte_cnn.CHUNK - len(chunk))
        seen = np.concatenate([net.embedding[c] for c in chunk]).astype(np.float64)
        best = [max(old, float(seen @ net.filters[:, k])) for k, old in enumerate(best)]
    z = sum(max(b + float(c), 0) * float(o) for b, c, o in zip(best, net.bias, net.out)) + net.shift
    return 1 / (1 + np.exp(-z))


def test_scores_equal_a_plain_computation(spark, edge_docs):
    docs = common.table(spark, SF, "documents")
    net = byte_cnn.train_on(docs, common.table(spark, SF, "labels"))
    texts = [r[1] for r in ROWS if r[1] != LONG] + [r.text for r in docs.limit(10).collect()] + ["é" * 7, "x" * 16, "x" * 17]
    got = net.scores(*common.text_bytes(pa.array(texts, pa.string())))
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-4)
    codes, firsts = byte_cnn.chunks(*common.text_bytes(pa.array([LONG * 3, "short", LONG], pa.string())))
    seen, ends = net.responses(codes), [*firsts[1:], len(codes)]
    value, place = net.strongest(codes, firsts)
    assert len(codes) > 2 * byte_cnn.PRODUCT_CHUNKS
    assert np.array_equal(np.take_along_axis(seen, place, 0), value)
    assert all(np.allclose(value[d], seen[a:b].max(0)) and (place[d] >= a).all() and (place[d] < b).all()
               for d, (a, b) in enumerate(zip(firsts, ends)))


def test_long_texts_are_learnt_from(spark):
    def text(i):
        return " ".join(("fine" if i % 2 else "junk") + str((i * 31 + j * 17) % 97) for j in range(4000))

    docs = spark.createDataFrame([(i, text(i)) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    rows = byte_cnn.scored(docs, byte_cnn.train_on(docs, labels)).collect()
    assert len(text(1)) > 20_000 and all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in rows)


def test_chunks_cover_every_byte():
    for size in (0, 1, 15, 16, 17, 24, 25, 1000):
        data = np.arange(size) % 251
        codes, firsts = byte_cnn.chunks(data.astype(np.uint8), np.array([0, size]))
        seen = np.zeros(size, bool)
        for i, row in enumerate(codes):
            for j, c in enumerate(row):
                place = i * byte_cnn.STRIDE + j
                assert c == (data[place] + 1 if place < size else 0)
                if place < size:
                    seen[place] = True
        assert seen.all() and list(firsts) == [0]


# --- license scan -------------------------------------------------------------
def test_license_spans_equal_alignment_without_index(spark, no_docs):
    gpl, mit = license_scan.TEMPLATES["GPL-3.0"], license_scan.TEMPLATES["MIT"]
    words = mit.split()
    texts = [None, "", "no license here at all", f"x\n{gpl}\ny", gpl.upper().replace(" ", "\n"), " ".join(words[5:]),
             " ".join(words[:40]), " ".join("new" if i % 12 == 3 else w for i, w in enumerate(words)),
             "Été. Released under the MIT License. Licensed under CC BY-NC 4.0.", LONG + " " + mit + " " + gpl, mit, mit,
             "Licensed under the Apache License, Version 2.0"]
    index = license_scan.Index(license_scan.TEMPLATES)
    got = index.scan(*common.text_bytes(pa.array(texts, pa.string())))
    for text, found in zip(texts, got):
        if text and len(text) < 5000:
            data = np.frombuffer(text.encode(), np.uint8)
            doc, *_ = license_scan._words(data, np.array([0, len(data)]))
            everywhere = {(t, d) for t in range(len(index.names)) for d in range(-len(index.words[t]), len(doc) + 1)}
            assert [m for m, *_ in found] == index.matches(doc, everywhere)
    assert [[m.template for m, *_ in f] for f in got] == [
        [], [], [], ["GPL-3.0"], ["GPL-3.0"], ["MIT"], [], ["MIT"], ["MIT-notice", "CC-BY-NC-4.0-notice"], ["MIT", "GPL-3.0"],
        ["MIT"], ["MIT"], ["Apache-2.0-notice"]]
    assert texts[8][got[8][0][1]:got[8][0][2]] == "Released under the MIT License"
    rows = collected(license_scan.license_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [r["n_licenses"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [len(f) for f in got]
    assert license_scan.license_spans(no_docs).count() == 0


def test_neighbouring_licences_keep_their_own_names():
    gpl = " ".join(license_scan.TEMPLATES["GPL-3.0"].split())
    gnu, bsd = "GNU General Public License", license_scan.TEMPLATES["BSD-2-Clause"]
    work, cc = "This work is licensed under the ", "This work is licensed under a Creative Commons "
    names = ("Neither the name of Example Inc. nor the names of its contributors may be used to endorse or promote products derived "
             "from this software without specific prior written permission.")
    advert = ("All advertising materials mentioning features or use of this software must display the following acknowledgement: "
              "This product includes software developed by Example Inc.")
    texts = {
        f"{cc}Attribution-NonCommercial 4.0 International License.": ["CC-BY-NC-4.0"], f"{cc}Attribution 3.0 Unported License.": ["CC-BY-3.0"],
        f"{cc}Attribution-NonCommercial-NoDerivatives 4.0 International License.": ["CC-BY-NC-ND-4.0"],
        f"{cc}Attribution 4.0 International License.": ["CC-BY-4.0"], f"{cc}Attribution 3.0 United States License.": [],
        f"{cc}Attribution-ShareAlike 4.0 International License.": ["CC-BY-SA-4.0"],
        "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0-notice"], "Licensed under CC BY 4.0.": ["CC-BY-4.0-notice"],
        f"{work}{gnu}, version 2.": ["GPL-2.0-notice"], f"{work}{gnu}, version 3.": ["GPL-3.0-notice"],
        f"{work}GNU Affero General Public License, version 3.": ["AGPL-3.0-notice"],
        f"{work}GNU Lesser General Public License, version 2.1.": ["LGPL-2.1-notice"],
        "Released under the BSD License.": [], "Licensed under the Apache License, Version 1.1.": [],
        gpl.replace("version 3", "version 2"): ["GPL-2.0"], gpl.replace("GNU", "GNU Affero"): ["AGPL-3.0"],
        gpl.replace("GNU", "GNU Lesser"): ["LGPL-3.0"], gpl.replace("GNU", "GNU Lesser").replace("version 3", "version 2.1"): ["LGPL-2.1"],
        gpl.replace("either version 3 of the License, or (at your option) any later version", "version 3 of the License"): ["GPL-3.0"],
        gpl.replace("as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
                    "version 2 as published by the Free Software Foundation"): ["GPL-2.0-only"],
        license_scan.TEMPLATES["Apache-2.0"].replace("Apache License", "Educational Community License"): [],
        bsd: ["BSD-2-Clause"], f"{bsd} {names}": ["BSD-3-Clause"], f"{bsd} {advert} {names}": ["BSD-4-Clause"],
    }
    got = license_scan.Index(license_scan.TEMPLATES).scan(*common.text_bytes(pa.array([f"Before it. {t} After it." for t in texts])))
    assert [[m.template for m, *_ in f] for f in got] == list(texts.values())
    whole = license_scan.Index(license_scan.TEMPLATES).scan(*common.text_bytes(pa.array(license_scan.TEMPLATES.values())))
    assert [[m.template for m, *_ in f] for f in whole] == [[t] for t in license_scan.TEMPLATES]


def test_repeated_notices_are_each_found():
    index = license_scan.Index(license_scan.TEMPLATES)
    notices = {k: v for k, v in license_scan.TEMPLATES.items() if len(v.split()) <= 12}
    rng = random.Random(4)
    texts = [" ".join([v + " and" * gap] * n) for v in notices.values() for gap in range(4) for n in (2, 3, 5)]
    texts += [" ".join(rng.choices([*notices.values(), "or"], k=8)) for _ in range(100)]
    for text, found in zip(texts, index.scan(*common.text_bytes(pa.array(texts)))):
        want = sorted((m.start(), k) for k, v in notices.items() for m in re.finditer(re.escape(v.rstrip(".")), text))
        assert [(a, m.template) for m, a, _ in found] == want
    damaged = "Released under this MIT License. Released under the MIT License. Licensed under CC BY-ND 4.0. Licensed with CC BY-NC 4.0."
    found = index.scan(*common.text_bytes(pa.array([damaged])))[0]
    assert [m.template for m, *_ in found] == ["MIT-notice", "MIT-notice", "CC-BY-ND-4.0-notice", "CC-BY-NC-4.0-notice"]


def test_no_cut_or_damaged_notice_is_lost_to_the_index():
    """Every accepted alignment on any diagonal is found through the index: random cuts, replaced, lost and added words."""
    index = license_scan.Index(license_scan.TEMPLATES)
    rng = random.Random(7)
    short = [v.split() for v in license_scan.TEMPLATES.values() if len(v.split()) <= 30]
    long = [v.split() for v in license_scan.TEMPLATES.values() if len(v.split()) > 30]
    texts = ["This project is licensed under the MIT License - see LICENSE.", "// SPDX-License-Identifier: GPL-2.0-or-later"]
    for words in [rng.choice(short) for _ in range(600)] + [rng.choice(long) for _ in range(30)]:
        rate, own = rng.choice((0, 0.1, 0.2)), words[rng.randrange(3):len(words) - rng.randrange(3)]
        own = [w if rng.random() > rate else rng.choice(("other", "", f"{w} more")) for w in own]
        texts.append(" ".join([*rng.sample(("see", "the", "file", "is", "a"), 3), *own, "or", "not"]))
    for text, found in zip(texts, index.scan(*common.text_bytes(pa.array(texts)))):
        doc = license_scan._hashed(text)
        near = {t for t in range(len(index.names)) if np.isin(index.words[t], doc).sum() >= 0.8 * len(index.words[t])}
        everywhere = {(t, d) for t in near for d in range(-len(index.words[t]), len(doc) + 1)}
        lost = {m.template for m in index.matches(doc, everywhere)} - {m.template for m, *_ in found}
        assert not lost, (text, lost)
    assert [[m.template for m, *_ in f] for f in index.scan(*common.text_bytes(pa.array(texts[:2])))] == [["MIT-notice"], ["GPL-2.0-or-later-tag"]]


def test_texts_full_of_notices_take_linear_time():
    index = license_scan.Index({k: license_scan.TEMPLATES[k] for k in ("MIT-notice", "MIT")})
    text = "é Released under the MIT License. " * 12_000
    started = time.process_time()
    found, = index.scan(*common.text_bytes(pa.array([text])))
    assert [a for _, a, _ in found] == [2 + 34 * i for i in range(12_000)] and time.process_time() - started < 60


def test_notices_of_the_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in common.table(spark, SMALL, "documents").collect()}
    notices = {k: v for k, v in license_scan.TEMPLATES.items() if k.endswith("notice")}
    for r in queries.QUERIES["op4_license_scan"](spark, SMALL).collect():
        assert {k for k, v in notices.items() if v in docs[r.doc_id]} == set(filter(None, r.licenses.split(",")))


# --- page extraction ----------------------------------------------------------
def article_text(source):
    inner = re.search(r"<article[^>]*>(.*?)(?:</article>|\Z)", source, re.S)
    blocks = re.split(r"</?(?:h1|p)\b[^>]*>?", inner[1]) if inner else []
    plain = [" ".join(html.unescape(re.sub(r"<[^>]*>?", lambda m: " " if m[0].startswith("<br") else "", b)).split()) for b in blocks]
    return "\n\n".join(b for b in plain if b)


def test_pages(spark):
    pages = {r["page_id"]: r["html"] for r in common.table(spark, SMALL, "pages").collect()}
    got = queries.QUERIES["op5_dom_boost"](spark, SMALL).collect()
    assert len(got) == len(pages)
    assert [r.page_id for r in got if r.text != article_text(pages[r.page_id])] == []
    assert all(r.n_chars == len(r.text) for r in got)


def test_page_furniture_and_broken_markup(spark):
    pages = common.table(spark, SMALL, "pages")
    model = dom_boost.train_on(pages)
    story = "<p>One &amp; two&nbsp;words,\n and more of the story.</p><p>Second <b>bold</b> paragraph of it.</p>"
    want = "One & two words, and more of the story.\n\nSecond bold paragraph of it."
    shapes = {
        f'<body><header><p>Site name</p></header><article>{story}</article><aside><p>See also</p></aside></body>': want,
        f'<body><nav><a href="/">Home</a></nav><article>{story}<div class="ad">Buy now</div></article></body>': want,
        f'<article>{story}</article><form action="/s"><label>Search</label><input></form><section id="comments">'
        '<p>First!</p></section>': want,
        f"<html><script>var a = '<p>no</p>';</script><style>p{{}}</style><article>{story}<!-- gone -->": want,
        f'<article>{story}</article><div class="cookie-notice"><p>We use cookies</p></div><footer>&copy; us</footer>': want,
        "": "", "<div": "", "<article><p>cut o": "cut o",
    }
    rows = spark.createDataFrame([(i, None, s, "x") for i, s in enumerate(shapes)] + [(99, None, None, "x")],
                                 "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in dom_boost.extracted(rows, model).collect()}
    assert [got[i] for i in range(len(shapes))] == list(shapes.values()) and got[99] == ""
    none = pages.limit(0)
    assert dom_boost.extracted(none, dom_boost.train_on(none)).count() == 0


def test_heads_and_raw_elements_end_where_browsers_end_them(spark):
    model = dom_boost.train_on(common.table(spark, SMALL, "pages"))
    story = "<p>One &amp; two words, and more of the story.</p><p>Second <b>bold</b> paragraph of it.</p>"
    want = "One & two words, and more of the story.\n\nSecond bold paragraph of it."
    shapes = {
        f"<html><head><title>t</title><body><nav><a href='/'>Home</a></nav><article>{story}</article></body>": want,
        f"<head><meta charset=utf-8><title>t</title><article>{story}</article>": want,
        f"<head><title>t</title><body><header><p>Site name</p></header><article>{story}</article>": want,
        f"<html><head><title>\u0130\u0130\u0130 \u0130</title></head><body><article>{story}</article></body>": want,
        f"<head><title>\u0130\u0130</title></head><body><article>{story}</article><SCRIPT>var a = 1;</Script ></body>": want,
        f"<article>{story}<script>a = '</scripts>'; b</script></article>": want,
        f"<article>{story}<p>With <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <object data='a'>words</object> in it.</p></article>":
            want + "\n\nWith x=2 and words in it.",
    }
    rows = spark.createDataFrame([(i, None, s) for i, s in enumerate(shapes)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in dom_boost.extracted(rows, model).collect()}
    assert [got[i] for i in range(len(shapes))] == list(shapes.values())


def test_stray_quotes_do_not_open_strings(spark):
    model = dom_boost.train_on(common.table(spark, SMALL, "pages"))
    pairs = [('title="5" wide"', 'class="b"'), ("don't", "title='it'"), ('title=5" wide', 'title = "a > b"'), ('"', "=\" title='x>y'"),
             ("title= 'a'b'", "id=\"x\"'"), ('title=""" /', "title=a'b"), ("title=", '/"/ title')]
    shapes = [f"<article><p {a}>Found words here.</p><p {b}>Next &amp; last.</p></article>" for a, b in pairs]
    rows = spark.createDataFrame([(i, None, s) for i, s in enumerate(shapes)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in dom_boost.extracted(rows, model).collect()}
    assert [got[i] for i in range(len(shapes))] == ["Found words here.\n\nNext & last."] * len(shapes)


def test_article_content_of_all_kinds_is_kept(spark):
    model = dom_boost.train_on(common.table(spark, SMALL, "pages"))
    filler = "Words of the story stand here, and more of them follow. "
    story, plain = f"<p>{filler * 3}</p><p>{filler * 2}</p>", [(filler * 3).strip(), (filler * 2).strip()]
    inside = {
        "<table><tr><th>Year</th><th>Sum</th></tr><tr><td>2001</td><td>17 units</td></tr></table>": ["Year", "Sum", "2001", "17 units"],
        "<pre>x = 1\n  y = 2</pre>": ["x = 1 y = 2"], "<pre><code>call(a, b)</code></pre>": ["call(a, b)"],
        "<ul><li>First thing</li><li>Second thing</li></ul>": ["First thing", "Second thing"],
        "<blockquote><p>Someone said this once.</p></blockquote>": ["Someone said this once."],
        "<figure><img src=a><figcaption>A picture of it</figcaption></figure>": ["A picture of it"],
        "<dl><dt>Term</dt><dd>What it means</dd></dl>": ["Term", "What it means"],
        '<div class="top-story"><p>Inside a wrapper.</p></div>': ["Inside a wrapper."],
        '<p>A <span class="ad">word</span> and a <label>label</label> inside.</p>': ["A word and a label inside."],
    }
    furniture = '<header><p>Site name</p></header><nav><a href="/">Home</a></nav>{}<footer><p>Imprint of us</p></footer>'
    cases = [(f"<article>{story}{own}<p>The end of it, all told.</p></article>", [*plain, *want, "The end of it, all told."])
             for own, want in inside.items()]
    cases += [(f'<div class="top-story"><article>{story}</article></div>', plain), (f'<article><div class="top-story">{story}</div></article>', plain),
              (f'<article class="post has-sidebar">{story}</article>', plain)]
    pages = [f'<body class="page comment-closed">{furniture.format(c)}</body>' for c, _ in cases] + [furniture.format(c) for c, _ in cases]
    rows = spark.createDataFrame([(i, None, s) for i, s in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in dom_boost.extracted(rows, model).collect()}
    assert [pages[i] for i in got if got[i] != "\n\n".join(cases[i % len(cases)][1])] == []


@pytest.mark.parametrize("different", [1, 3, 300])
def test_tables_of_repeated_pages(spark, different):
    pages = [r["html"] for r in common.table(spark, SMALL, "pages").orderBy("page_id").collect()]
    pages = [p.replace("</article>", f"<p>Copy {i}.</p></article>") for i, p in enumerate((pages * 2)[:different])]
    clashing = [f"'{c}' as {c}" for c in ("key", "size", "keep", "hash")]
    rows = spark.range(20_000).selectExpr("id as page_id", f"cast(id % {different} as int) as i", *clashing)
    rows = rows.join(spark.createDataFrame(list(enumerate(pages)), "i int, html string"), "i").withColumn("url", F.lit(None).cast("string"))
    wrong = F.col("text") != F.element_at(F.array(*[F.lit(article_text(p)) for p in pages]), (F.col("page_id") % different + 1).cast("int"))
    got = dom_boost.extracted(rows, dom_boost.train_on(rows)).agg(F.count(F.lit(1)), F.count_if(wrong)).first()
    assert tuple(got) == (20_000, 0)


def test_long_pages_are_learnt_from_and_read(spark):
    page = "<body><nav><a href='/'>Home</a></nav><article>" + "<p>Some words of a long story.</p>" * 40_000 + "</article><footer><p>us</p></footer></body>"
    rows = spark.createDataFrame([(1, None, page)], "page_id long, url string, html string")
    assert len(dom_boost.sample_of(rows)) == 1
    assert dom_boost.extracted(rows, dom_boost.train_on(rows)).first().text == "\n\n".join(["Some words of a long story."] * 40_000)


def test_decoding_never_keeps_below_a_dropped_node():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(2, 9))
        parent = np.array([-1, *(int(rng.integers(i)) for i in range(1, n))])
        depth = np.zeros(n, int)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        odds = rng.normal(0, 2, n)
        odds[0] = 50
        kept = dom_boost.decode(dom_boost.Forest(parent, depth, None), odds)
        keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        best = max((sum(keep[i] if c[i] else drop[i] for i in range(n)), c) for c in itertools.product((0, 1), repeat=n)
                   if all(c[parent[i]] or not c[i] for i in range(1, n)))[1]
        assert kept.tolist() == [bool(b) for b in best]


# --- secrets ------------------------------------------------------------------
def brute_secrets(text):
    spans = []
    for number, rule in enumerate(secret_scan.RULES):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                spans.append((m.start(), number, m.end()))
    return sorted(spans)


def test_secrets(spark, edge_docs, no_docs):
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    texts = [None, "", "token = short", 'Token: "abc123def"', f"é {key} x {key[:15]}", "a" * 23 + " " + "a" * 24, "apikey=ABCDEF api_key : 'xyz_12.'",
             "PASSWORD=hunter22 passwd:secret=abcdef", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "ſecret=abcdefgh",
             LONG + " secret=deadbeefdeadbeefdeadbeef", "to" + "ken=abcdef", "tok", "en=abcdef"]
    got = secret_scan.Scanner().scan(pa.array(texts, pa.string()))
    assert got == [brute_secrets(t) for t in texts]
    assert secret_scan.secret_spans(edge_docs).count() == len(ROWS)
    assert secret_scan.secret_spans(no_docs).count() == 0
    docs = {r["doc_id"]: r["text"] for r in common.table(spark, SMALL, "documents").collect()}
    for r in queries.QUERIES["op6_trigram_secrets"](spark, SMALL).collect():
        spans = brute_secrets(docs[r.doc_id])
        said = ",".join(f"{secret_scan.RULES[k].kind}:{a}:{b}" for a, k, b in spans if k < 3)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))


def test_rules_take_linear_time():
    token = "eyJ" + "a" * 20 + ".eyJ" + "b" * 20 + ".c_d"
    texts = ["eyJ" * 300_000, "eyJ" * 100_000 + ". " + token, "-----BEGIN " * 80_000, "password" + " " * 500_000, "eyJa." * 100_000 + "!"]
    started = time.process_time()
    got = secret_scan.Scanner().scan(pa.array(texts))
    assert time.process_time() - started < 20  # a quadratic rule takes minutes
    kinds = [[secret_scan.RULES[k].kind for _, k, _ in spans if k >= 3] for spans in got]
    assert kinds[0] == kinds[2] == kinds[3] == [] and kinds[1] == ["jwt"]
    assert got[1][-1][0] == len(texts[1]) - len(token) and got[1][-1][2] == len(texts[1])


def holds(query, text):
    if query == secret_scan.ANY:
        return True
    if isinstance(query, str):
        return query in text
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


@pytest.mark.parametrize("pattern,example,other", [
    (r"abc+d?(efg|hij)", "abccefg", "abcd"), (r"(?i:token)=\d{3,}", "TOKEN=123", "tokn"), (r"[ab]cd(x|yz)?w", "bcdyzw", "cdw"),
    (secret_scan.BASE[0].pattern, "api_key = abcdef", "apixkey"), (r"(foo|ba[rz])+qux", "barfooqux", "foobar")])
def test_trigram_queries_hold_on_matches(pattern, example, other):
    query = secret_scan.trigram_query(pattern)
    assert re.search(pattern, example) and query != secret_scan.ANY
    assert holds(query, example.lower()) and not holds(query, other.lower())
    assert secret_scan.trigram_query(r"[0-9a-f]+") == secret_scan.ANY


# --- Jaccard join -------------------------------------------------------------
def shingle_set(text):
    cut = str.maketrans({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(cut))
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return Counter((d, len(sets[i]), min((x for x in least[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))


def joined(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect())


def test_shingle_hashes_are_those_of_the_words():
    texts = ["", " a  b ", "A b c d e", "a B c d e f", "a b c d e f a b c d e", "é ü\x0bx\x0cy z", None, "ab c d e f", "a bc d e f"]
    sets = shingles.shingle_sets(*common.text_bytes(pa.array(texts, pa.string())))
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    assert set(sets[2]) < set(sets[3]) < set(sets[4])
    assert len(set(np.concatenate(sets).tolist())) == len(set().union(*map(shingle_set, texts)))


def test_spreads_bound_the_common_shingles():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**64 - 1, 3000, dtype=np.uint64, endpoint=True)
    for _ in range(60):
        x, y = (np.unique(rng.choice(pool, int(rng.integers(1, 2500)))) for _ in range(2))
        bound = jaccard_join.most_common(jaccard_join.spread(x), jaccard_join.spread(y))
        assert len(np.intersect1d(x, y)) <= bound <= min(len(x), len(y))
        assert jaccard_join.most_common(jaccard_join.spread(x), jaccard_join.spread(x)) == len(x)


def test_jaccard_edge_cases(edge_docs, no_docs):
    assert joined(edge_docs) == brute_components([r[:2] for r in ROWS])
    kept = jaccard_join.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    # One of the copies of the base text; its first half; the long, the short and the accented text; texts without words stay.
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 13, 5, 9, 11, None, None, 2, 3, 4])
    assert jaccard_join.jaccard_components(no_docs).count() == 0


def test_jaccard_on_near_copies(spark):
    """Chains, borderline similarities and a passage that many texts share."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=50))
    rows = []
    for group in range(12):
        text = rng.choices(words, k=rng.choice([7, 30, 60, 120]))
        for _ in range(rng.randint(1, 14)):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
    rows += [(len(rows) + i, " ".join(rng.choices(words, k=k)) + " " + passage) for i, k in enumerate([2, 5, 8, 10, 12, 30, 60, 90] * 3)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert joined(frame) == brute_components(rows)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "u long, v long")).collect()))
    least = {x: x for pair in links for x in pair}
    for _ in range(400):
        for u, v in links:
            least[u] = least[v] = min(least[u], least[v])
    assert {n: r for n, r in least.items() if n in got} == got
    assert all(r == n for n, r in least.items() if n not in got)


# --- token output -------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 5000])
def test_codes_give_random_access(n):
    rng = np.random.default_rng(n)
    ids = rng.choice([0, 1, 255, 256, 300, 49407, 65535, 65536, 2**24, 2**32 - 1], n).astype(np.uint32)
    codes = dac_tokens.Codes(dac_tokens.encode_levels(ids))
    assert codes.run(0, n).tolist() == ids.tolist()
    for place in rng.integers(0, max(n, 1), 30 if n else 0):
        assert codes[int(place)] == ids[place]
        end = int(rng.integers(place, n + 1))
        assert codes.run(int(place), end).tolist() == ids[place:end].tolist()


def test_tokens_round_trip(spark, edge_docs, no_docs, tmp_path):
    from tokenizers import Tokenizer

    vocabulary = dac_tokens.vocabulary_file()
    tokenizer = Tokenizer.from_file(vocabulary)

    def ids_of(text):
        return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]

    odd = [(100, "It's 4.0%!! don't<|endoftext|>x <|STARTOFTEXT|> a.b,c;; 12.5. É.. ﬁ, x—. ''s. i’m"), (101, "A b c é. é ß. İ. Σ."),
           (102, "<|startoftext|>. <|endoftext|>,"), (103, "!?. ?. .a. _. a_. ². ½, ٣. नी. 한국어. 日本。")]
    rows = [r[:2] for r in ROWS] + odd
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = str(tmp_path / "dac")
    dac_tokens.write_tokens(frame, path, vocabulary, segment_ids=500)
    got = sorted((tuple(r) for r in dac_tokens.token_digests(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([d for d, _ in rows if d is not None]) + [None, None]
    start, stream = 0, []
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(ids_of(t))
    for doc_id, at, n, crc in got:
        assert at == start
        match = next(x for x in texts[doc_id] if len(x) == n and zlib.crc32(np.array(x, "<u4").tobytes()) == crc)
        texts[doc_id].remove(match)
        stream += match
        start += n
    places = [0, 1, len(stream) // 2, len(stream) - 1]
    assert {tuple(r) for r in dac_tokens.ids_at(spark, path, places).collect()} == {(p, stream[p]) for p in places}
    assert dac_tokens.encoded_digests(no_docs, vocabulary).count() == 0
    assert dac_tokens.encoded_digests(edge_docs, vocabulary).count() == len(ROWS)


def test_every_letter_before_punctuation_as_in_whole_texts():
    encode = dac_tokens.WordEncoder(dac_tokens.vocabulary_file())
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c)[0] in "LN"]
    marks = [c for c in map(chr, range(0x3100)) if unicodedata.category(c)[0] == "M"]
    texts = [f"{c}{tail}" for tail in (".", ",", "?", "!!") for c in letters]
    texts += [f"x {c}{mark}." for mark in marks for c in "AHJTWYhjtwyÄ\u0915\u09a1"] + ["H\u0308\u0331x T\u0308.", "\u09dc\u0958. a"]
    for at in range(0, len(texts), 20_000):
        some = texts[at:at + 20_000]
        ids, counts = encode(pa.array(some))
        want = [np.array([*x.ids, dac_tokens.END_ID], np.uint32) for x in encode.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        got = np.split(ids, np.cumsum(counts)[:-1])
        assert [t for t, a, b in zip(some, got, want, strict=True) if not np.array_equal(a, b)] == []


def test_tokens_of_the_documents(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(dac_tokens.vocabulary_file())
    start = 0
    got = {r.doc_id: r for r in queries.QUERIES["op10_dac_tokens"](spark, SF).collect()}
    for r in common.table(spark, SF, "documents").orderBy("doc_id").collect():
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        assert tuple(got[r.doc_id]) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
