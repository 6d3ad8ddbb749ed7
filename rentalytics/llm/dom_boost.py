"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

Every block element (and every inline element with a class or id) is a node
with features of its subtree, attributes, depth and siblings.  Gradient-
boosted trees give the odds that a node holds article text.  Decoding takes
the most likely set of nodes in which nothing below a dropped node is kept.

No page is labelled, so the trees learn from a bounded sample of pages that
plain markup rules label (``taught``), each also in a variant with further
page furniture put in and its article wrapped otherwise.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The documented bound of the training sample: different pages, and bytes of all of them together (one page at least).
SAMPLE_PAGES = 300
SAMPLE_BYTES = 30_000_000
VARIANTS = 4
BATCH_BYTES = 2 << 20

# HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title noscript template textarea select iframe svg annotation annotation-xml".split())
# A raw element ends here; positions are those of the page itself, so no lower-cased copy of it is searched.
RAW_END = {tag: re.compile(rf"</{tag}(?=[ \t\n\r\f/>])", re.I | re.A) for tag in RAW}
BLOCKS = tuple(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot "
    "tr td th caption figure figcaption address center details summary hgroup menu dir nav header footer aside form "
    "fieldset legend dialog button hr".split())
BLOCK = frozenset(BLOCKS)
# An element of a key's kind ends when one of its values begins.
ENDED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"},
            "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
# Words of class, id and role attributes, by what they say of an element.
TOKENS = {
    "content": "article content entry main post story text body",
    "menu": "breadcrumb breadcrumbs menu nav navbar navigation pagination pager toc",
    "head": "header masthead topbar top logo",
    "foot": "bottom copyright footer legal",
    "side": "aside rail related sidebar side widget recommended trending",
    "notice": "alert banner consent cookie cookies gdpr modal notice notification overlay popup",
    "advert": "ad ads advert advertisement promo promoted sponsor sponsored",
    "form": "form login newsletter search signup subscribe",
    "comment": "comment comments discussion disqus replies reply respond",
    "share": "share sharing social tags",
}
GROUPS = tuple(TOKENS)
_GROUP = {word: i for i, words in enumerate(TOKENS.values()) for word in words.split()}
DROPPED_TAGS = frozenset("nav header footer aside form fieldset button dialog menu legend".split())
CONTENT_TAGS = frozenset(("article", "main"))
# Classes of these say something of the whole page, and inline elements in the others belong to their sentence.
PAGE_TAGS = frozenset(("html", "body"))
SENTENCES = frozenset("p li dt dd td th h1 h2 h3 h4 h5 h6 blockquote figcaption caption pre".split())
# Parts of a list, table or figure: without words of their own they go with the whole.
PARTS = frozenset("li dt dd thead tbody tfoot tr td th caption figcaption summary".split())
PART_ODDS = 1.0
# In training pages: this element's own tag and classes say nothing of it.
NEUTRAL = "data-training-neutral"

# A quote opens a value only after a name and "="; elsewhere it is a character of a name or value, as in browsers.
_VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\r\f<>"'][^ \t\n\r\f<>]*+)"""
_ATTRIBUTE = rf"""[^ \t\n\r\f/<>][^ \t\n\r\f/<>=]*+(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+{_VALUE}?+)?+"""
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"""
    rf"""|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[ \t\n\r\f/]++|{_ATTRIBUTE})*+)>?""", re.S)
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Za-z]+")


def _groups(attributes: str) -> int:
    found = 0
    for parts in _NAMED.findall(attributes):
        for word in _WORD.findall(" ".join(parts).lower()):
            if word in _GROUP:
                found |= 1 << _GROUP[word]
    return found


@dataclass
class Page:
    """Nodes (parent, tag, attribute groups, neutral in training) in page order and runs of text (block, node, text, in a link)."""

    parents: list[int]
    tags: list[str]
    groups: list[int]
    neutral: list[bool]
    runs: list[tuple[int, int, str, bool]]


def parse(source: str) -> Page:
    """A page's nodes and text; broken and cut-off markup is read as far as it goes."""
    page = Page([-1], ["#page"], [0], [False], [])
    stack, block, linked, at = [0], 0, 0, 0

    def text(upto: int) -> None:
        if upto > at:
            page.runs.append((block, stack[-1], html.unescape(source[at:upto]), linked > 0))

    def push(tag: str, attributes: str) -> None:
        page.parents.append(stack[-1])
        page.tags.append(tag)
        page.groups.append(_groups(attributes) if "=" in attributes and tag not in PAGE_TAGS else 0)
        page.neutral.append(NEUTRAL in attributes)
        stack.append(len(page.tags) - 1)

    while (m := _MARKUP.search(source, at)) is not None:
        text(m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].endswith("/"):
                end = RAW_END[tag].search(source, at)
                at = len(source) if end is None else end.start()
        elif tag == "head":
            continue  # its tags may be left out, and what is not raw or void in it is the body's, as in browsers
        elif tag in VOID:
            page.runs.append((block, stack[-1], " ", False))
            block += tag == "hr"
        elif tag in BLOCK:
            block += 1
            if closing:
                for place in range(len(stack) - 1, 0, -1):
                    if page.tags[stack[place]] == tag:
                        del stack[place:]
                        break
            else:
                for place in range(len(stack) - 1, 0, -1):
                    above = page.tags[stack[place]]
                    if above in BLOCK:
                        if tag in ENDED_BY.get(above, ()):
                            del stack[place:]
                        break
                push(tag, m[3])
        elif closing:
            linked -= tag == "a" and linked > 0
            for place in range(len(stack) - 1, 0, -1):
                above = page.tags[stack[place]]
                if above == tag:
                    del stack[place:]
                if above == tag or above in BLOCK:
                    break
        else:
            linked += tag == "a"
            if page.tags[stack[-1]] not in SENTENCES and _NAMED.search(m[3]):
                push(tag, m[3])
    text(len(source))
    return page


def taught(page: Page) -> np.ndarray:
    """The rules' label of each node: 1 if article text is in it.  Neutral nodes
    have their parent's; what stands in them is judged on its own."""
    drops = sum(1 << i for i, g in enumerate(GROUPS) if g != "content")
    content = 1 << GROUPS.index("content")
    dropped, inside = [], []
    for parent, tag, groups, neutral in zip(page.parents, page.tags, page.groups, page.neutral, strict=True):
        out = not neutral and (tag in DROPPED_TAGS or (groups & drops) > 0)
        dropped.append(out or (parent >= 0 and dropped[parent]))
        inside.append(tag in CONTENT_TAGS or (groups & content) > 0 or (parent >= 0 and inside[parent]))
    some = any(i and not d for i, d in zip(inside, dropped, strict=True))
    labels = np.zeros(len(page.tags), np.int8)
    for _, node, text, _ in page.runs:
        if text.strip() and not dropped[node] and (inside[node] or not some):
            while node >= 0 and not labels[node]:
                labels[node] = 1
                node = page.parents[node]
    return labels


FEATURE_TAGS = ("article main section div p h1 h2 h3 ul ol li table td blockquote pre nav header footer aside form "
                "button label figure dialog span a body").split()
_TAG = {t: i for i, t in enumerate(FEATURE_TAGS)}
PLAIN = 16  # features before the indicators
FEATURES = PLAIN + 2 * len(FEATURE_TAGS) + 2 * len(GROUPS)


def _levels(depth: np.ndarray) -> Iterator[np.ndarray]:
    """Nodes by depth, deepest first."""
    order = np.argsort(-depth, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


@dataclass
class Forest:
    """The nodes of many pages together; parents before children."""

    parent: np.ndarray
    depth: np.ndarray
    x: np.ndarray
    part: np.ndarray | None = None

    def odds(self, model: "Boosted") -> np.ndarray:
        """The model's log odds of each node; a part's speak for keeping it if the whole is kept."""
        return np.where(self.part, PART_ODDS, model.odds(self.x))


def forest(pages: list[Page]) -> Forest:
    sizes = [len(p.tags) for p in pages]
    starts = np.cumsum([0, *sizes[:-1]])
    parent = np.concatenate([np.where(np.array(p.parents) < 0, -1, np.array(p.parents) + s)
                             for p, s in zip(pages, starts.tolist(), strict=True)])
    n = len(parent)
    page_of = np.repeat(np.arange(len(pages)), sizes)
    own, linked, marks, first = (np.zeros(n) for _ in range(4))
    for p, s in zip(pages, starts.tolist(), strict=True):
        done = 0
        for _, node, text, link in p.runs:
            size = len(text.strip())
            own[s + node] += size
            linked[s + node] += size * link
            marks[s + node] += text.count(".") + text.count(",")
            done += size
    depth = np.zeros(n, np.int64)
    for i in range(1, n):  # parents stand before their children
        if parent[i] >= 0:
            depth[i] = depth[parent[i]] + 1
    total, links, points, nodes = own.copy(), linked.copy(), marks.copy(), np.ones(n)
    children = np.bincount(parent[parent >= 0], minlength=n)
    for level in _levels(depth):
        level = level[parent[level] >= 0]
        for values in (total, links, points, nodes):
            np.add.at(values, parent[level], values[level])
    up = np.maximum(parent, 0)
    tag_list = [t for p in pages for t in p.tags]
    tag = np.array([_TAG.get(t, -1) for t in tag_list])
    groups = np.array([g for p in pages for g in p.groups])
    # Place among the siblings, and how many of them have the same tag.
    order = np.lexsort((np.arange(n), up))
    begins = np.r_[True, np.diff(up[order]) != 0] if n else np.zeros(0, bool)
    nth = np.zeros(n)
    nth[order] = np.arange(n) - np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    alike = np.unique(up * 64 + tag + 1, return_inverse=True, return_counts=True)
    same = alike[2][alike[1]]
    before = np.cumsum(own) - own
    page_first = before[starts][page_of] if n else before
    page_total = total[starts][page_of] if n else total
    inherited = groups.copy()
    in_content, in_dropped = (np.fromiter((t in tags for t in tag_list), bool, n) for tags in (CONTENT_TAGS, DROPPED_TAGS))
    for level in reversed(list(_levels(depth))):
        level = level[parent[level] >= 0]
        for values in (inherited, in_content, in_dropped):
            values[level] |= values[parent[level]]
    siblings = np.maximum(children[up], 1)
    x = np.zeros((n, FEATURES), np.float32)
    whole = np.maximum(total, 1)
    for i, values in enumerate((
            depth, np.log1p(own), np.log1p(total), links / whole, np.log1p(nodes), total / nodes,
            total / np.maximum(page_total, 1), np.log1p(siblings), nth / siblings, same / siblings, children,
            (before - page_first) / np.maximum(page_total, 1), points / whole, total / np.maximum(total[up], 1),
            in_content, in_dropped)):
        x[:, i] = values
    known = np.flatnonzero(tag >= 0)
    x[known, PLAIN + tag[known]] = 1
    above = np.flatnonzero(tag[up] >= 0)
    x[above, PLAIN + len(FEATURE_TAGS) + tag[up][above]] = 1
    for i in range(len(GROUPS)):
        x[:, PLAIN + 2 * len(FEATURE_TAGS) + i] = groups >> i & 1
        x[:, PLAIN + 2 * len(FEATURE_TAGS) + len(GROUPS) + i] = inherited >> i & 1
    part = np.fromiter((t in PARTS for t in tag_list), bool, n) & (groups == 0)
    return Forest(parent, depth, x, part)


@dataclass
class Boosted:
    """Trees of fixed depth: split features and bounds level by level, and leaf values."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, bound, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, feature[node]] > bound[node])
            out += leaf[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 16) -> Boosted:
    """Second-order boosting of the log loss on binned features."""
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    model = Boosted(float(np.log(share / (1 - share))), [])
    if len(np.unique(y)) < 2:
        return model
    cuts = np.quantile(x, np.arange(1, bins) / bins, axis=0, method="lower").T  # features x bins - 1
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    width, n_features = bins, x.shape[1]
    cell = np.arange(n_features) * width + binned
    odds = np.full(len(y), model.base)
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-odds))
        slope, bend = y - chance, chance * (1 - chance)
        inner = (1 << depth) - 1
        feature, bound = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            slots = ((node - first)[:, None] * (n_features * width) + cell).ravel()
            sums = [np.bincount(slots, np.repeat(v, n_features), count * n_features * width)
                    .reshape(count, n_features, width).cumsum(2) for v in (slope, bend)]
            g, h = (s[:, :, :-1] for s in sums)
            g_all, h_all = (s[:, :, -1:] for s in sums)
            gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all * g_all / (h_all + 1)
            best = gain.reshape(count, -1).argmax(1)
            better = gain.reshape(count, -1).max(1) > 1e-6
            f, b = best // (width - 1), best % (width - 1)
            feature[first:first + count] = f
            bound[first:first + count] = np.where(better, cuts[f, b], np.inf)
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > bound[node])
        place = node - inner
        leaf = rate * np.bincount(place, slope, 1 << depth) / (np.bincount(place, bend, 1 << depth) + 1)
        model.trees.append((feature, bound, leaf))
        odds += leaf[place]
    return model


def decode(tree: Forest, odds: np.ndarray) -> np.ndarray:
    """Kept nodes: the most likely choice in which a dropped node's whole subtree is dropped."""
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    for level in _levels(tree.depth):  # from the leaves up: each node's best with its subtree
        level = level[tree.parent[level] >= 0]
        np.add.at(keep, tree.parent[level], np.maximum(keep[level], drop[level]))
        np.add.at(drop, tree.parent[level], drop[level])
    kept = keep > drop
    kept |= tree.parent < 0  # the page itself
    for level in reversed(list(_levels(tree.depth))):
        level = level[tree.parent[level] >= 0]
        kept[level] &= kept[tree.parent[level]]
    return kept


def page_text(page: Page, kept: np.ndarray) -> str:
    """The kept text: white space in a block becomes one space, blocks are joined by an empty line."""
    blocks: dict[int, list[str]] = {}
    for block, node, text, _ in page.runs:
        if kept[node]:
            blocks.setdefault(block, []).append(text)
    return "\n\n".join(b for b in (" ".join("".join(parts).split()) for parts in blocks.values()) if b)


# Furniture put into training pages; {} is filled with words of the page.
FURNITURE = (
    '<header class="masthead"><div class="logo">{}</div></header>', "<header><p>{}</p></header>",
    '<div id="header"><p>{}</p></div>', '<nav class="menu"><a href="/a">{}</a> <a href="/b">{}</a></nav>',
    '<ul class="breadcrumbs"><li><a href="/">{}</a></li><li>{}</li></ul>', "<aside><h3>{}</h3><p>{}</p></aside>",
    '<div class="sidebar"><h3>{}</h3><ul><li><a href="/x">{}</a></li></ul></div>',
    '<div class="cookie-notice"><p>{}</p><button>{}</button></div>', '<div role="alert" class="banner">{}</div>',
    '<div class="advert"><p>{}</p></div>', '<div class="ad">{}</div>', '<p class="sponsored">{}</p>',
    '<form action="/s"><label>{}</label><input name="q"><button>{}</button></form>',
    '<div class="newsletter-signup"><p>{}</p></div>', '<div class="share-buttons"><a href="#">{}</a></div>',
    '<section id="comments"><h2>{}</h2><div class="comment"><p>{}</p></div><div class="comment"><p>{}</p></div></section>',
    '<div class="comments"><p>{}</p><p>{}</p></div>', '<div id="footer"><p>{}</p></div>', "<footer><p>{}</p></footer>",
    '<div class="related"><h3>{}</h3><a href="/y">{}</a></div>',
)
# What an article may hold beside paragraphs, and wrappers with misleading words (! is the neutral mark).
CONTENTS = (
    "<table !><thead><tr><th>{}</th><th>{}</th></tr></thead><tbody><tr><td>{}</td><td>{}</td></tr><tr><td>{}</td><td>{}</td></tr></tbody></table>",
    "<table ! class='data related'><tr><td>{}</td><td>{}</td></tr></table>",
    "<table !><caption>{}</caption><tr><th>{}</th><td>{}</td></tr><tr><th>{}</th><td>{}</td></tr><tr><th>{}</th><td>{}</td></tr></table>",
    "<table !><tr><td>{}</td><td>{}</td><td>{}</td></tr><tr><td>{}</td><td>{}</td><td>{}</td></tr><tr><td>{}</td><td>{}</td><td>{}</td></tr></table>", "<pre !><code>{}</code></pre>", "<pre ! class='top'>{}\n  {}</pre>",
    "<ul !><li>{}</li><li>{}</li><li>{}</li></ul>", "<ol ! class='menu'><li>{}</li><li>{}</li></ol>", "<ul !><li><a href='/r'>{}</a></li><li>{}</li></ul>",
    "<blockquote !><p>{}</p></blockquote>", "<blockquote ! class='social'>{}</blockquote>", "<figure !><img src=a><figcaption>{}</figcaption></figure>",
    "<dl !><dt>{}</dt><dd>{}</dd><dt>{}</dt><dd>{}</dd></dl>", "<h2 !>{}</h2><p>{}</p>", "<section !><h3>{}</h3><p>{}</p><p>{}</p></section>",
    "<div ! class='top-story'><p>{}</p><p>{}</p></div>", "<div ! class='top-story'><p>{}</p></div>", "<div ! class='story top'>{}</div>",
    "<div ! class='side-story'><p>{}</p></div>", "<div ! class='text promo'><p>{}</p></div>", "<div ! class='notice'><h3>{}</h3><p>{}</p></div>", "<p ! class='search-term'>{}</p>",
    "<div ! class='side-note'>{}</div>", "<details !><summary>{}</summary><p>{}</p></details>", "<address !>{}</address>", "<p !>{}</p>",
    "<div ! id='header-2'><h2>{}</h2><p>{}</p></div>", "<p ! class='footer-text'>{}</p>", "<div !><p>{}</p><pre>{}</pre><p>{}</p></div>",
)
MISLEADING = (("<article ! class='post has-sidebar comments-open'>", "</article>"), ("<div class='content'><article ! class='top story'>", "</article></div>"),
              ("<main ! class='header-fixed'><article>", "</article></main>"), ("<article ! id='ad-free'><div ! class='top-story'>", "</div></article>"),
              ("<div ! class='page side-layout'><div class='entry'>", "</div></div>"), ("<section ! class='menu-open'><article>", "</article></section>"))
WRAPS = (("<article>", "</article>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"),
         ('<div id="main-content"><div class="post">', "</div></div>"), ('<main role="main">', "</main>"))


def variant(source: str, rng: np.random.Generator) -> str:
    """The page with furniture before, in and after its article, other kinds of
    content in it, and the article in other wrapping."""
    words = re.sub(r"<[^>]*>|&\w+;?", " ", source).split() or ["x"]

    def piece(shapes: tuple[str, ...]) -> str:
        shape = shapes[rng.integers(len(shapes))].replace("!", NEUTRAL)
        while "{}" in shape:
            start = int(rng.integers(len(words)))
            most = 25 if rng.random() < 0.6 else 3
            shape = shape.replace("{}", html.escape(" ".join(words[start:start + 1 + int(rng.integers(most))])), 1)
        return shape

    wraps = WRAPS if rng.random() < 0.6 else MISLEADING
    left, right = (w.replace("!", NEUTRAL) for w in wraps[rng.integers(len(wraps))])
    if rng.random() < 0.2:  # a short article, or one of a few blocks of any kind
        few = "".join(piece(CONTENTS) for _ in range(rng.integers(3))) + piece(("<p>{}</p>", "<p>{}</p><p>{}</p>", "<h1>{}</h1><p>{}</p>"))
        source = re.sub(r"(<article[^>]*>).*?(</article>)", lambda m: m[1] + few + m[2], source, count=1, flags=re.S)
        if rng.random() < 0.3:  # nothing but the article, perhaps cut off
            source = re.search(r"<article.*?</article>|\Z", source, re.S)[0][:None if rng.random() < 0.5 else -len("</p></article>")]
            return source.replace("<article", left + "<article", 1) if rng.random() < 0.5 else source
    inner = "".join(piece(CONTENTS) for _ in range(rng.integers(4)))
    if rng.random() < 0.5:
        inner += piece(FURNITURE) + ("" if rng.random() < 0.5 else piece(CONTENTS))
    source = source.replace("</p><p>", f"</p>{inner}<p>", 1)
    first, last = (piece(CONTENTS) if rng.random() < 0.3 else "" for _ in range(2))
    source = re.sub(r"<article[^>]*>", lambda _: piece(FURNITURE) + left + (piece(FURNITURE) if rng.random() < 0.3 else first), source, count=1)
    return source.replace("</article>", last + right + piece(FURNITURE) + piece(FURNITURE), 1)


def sample_of(pages: DataFrame) -> list[str]:
    """At most SAMPLE_PAGES different pages of at most SAMPLE_BYTES together, the
    first by a hash of the html: only hashes and sizes are sorted, and a table of
    many copies gives the pages that it has.  The first is taken however long it is."""
    key = F.xxhash64("html")
    found = (pages.where(F.octet_length("html") > 0).groupBy(key.alias("key")).agg(F.max(F.octet_length("html")).alias("size"))
             .orderBy("key").limit(SAMPLE_PAGES).collect())
    taken, size = [], 0
    for row in found:
        size += row["size"]
        if taken and size > SAMPLE_BYTES:
            break
        taken.append(row["key"])
    if not taken:
        return []
    rows = pages.select("html", key.alias("key")).where(F.col("key").isin(taken)).groupBy("key").agg(F.min("html").alias("html"))
    return [r["html"] for r in sorted(rows.collect(), key=lambda r: r["key"])]


def train_on(pages: DataFrame, seed: int = 5) -> Boosted:
    """Trees from a bounded sample of the different pages, each also in VARIANTS variants."""
    rng = np.random.default_rng(seed)
    sources = sample_of(pages)
    parsed = [parse(s) for s in sources + [variant(s, rng) for _ in range(VARIANTS) for s in sources]]
    if not parsed:
        return Boosted(0.0, [])
    tree, labels = forest(parsed), np.concatenate([taught(p) for p in parsed]).astype(np.float64)
    return boost(tree.x[~tree.part], labels[~tree.part])


def extracted(pages: DataFrame, model: Boosted) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``.

    The whole html is read; null or empty html, and pages without article
    text, give an empty text; of several articles on a page, nested or not, all
    text is kept.  Repeated rows are returned each, and further columns of any
    name are not read.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sized_batches(batches, "html", BATCH_BYTES):
            parsed = [parse(s or "") for s in batch.column("html").to_pylist()]
            tree = forest(parsed)
            kept = decode(tree, tree.odds(model))
            texts, start = [], 0
            for page in parsed:
                texts.append(page_text(page, kept[start:start + len(page.tags)]))
                start += len(page.tags)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return common.small_batches(pages).select("page_id", "url", "html").mapInArrow(
        extract, "page_id long, url string, text string, n_chars long")


def op5_dom_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return extracted(pages, train_on(pages))
