"""Secret scans with a trigram inverted index.

Every rule's regular expression gives a Boolean query over lower-case
trigrams that any match must contain.  A block of documents is indexed once
(postings: trigram -> documents), each rule's query picks its candidates by
joining postings, and only those are searched with the expression.  A rule
without mandatory trigrams is searched in every document.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as rc
import re._parser as rp
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0  # characters that the group must have; shorter matches are dropped


# The base rules, in their listed order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# Further kinds; their spans stand beside the base ones.
EXTRA = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    # Only where a run of its characters begins: no run is walked through twice.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)
RULES = BASE + EXTRA

ANY = "any"
# Alternatives that are spelt out before a query gives up on a part of the expression.
MOST_STRINGS = 64
BLOCK_BYTES = 4 << 20


def _join(kind: str, parts: list) -> object:
    """("and" | "or", parts) without parts that say nothing."""
    if kind == "or" and ANY in parts:
        return ANY
    parts = list(dict.fromkeys(p for p in parts if p != ANY))
    return ANY if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _spelt(strings: set[str]) -> object:
    """What a text with one of the strings must contain."""
    return _join("or", [_join("and", [s[i:i + 3] for i in range(len(s) - 2)]) if len(s) >= 3 else ANY
                        for s in sorted(strings)])


def _analyse(items) -> tuple[set[str] | None, object]:
    """The strings a piece of an expression can match, if few, and the query of what comes before them."""
    strings, query = {""}, ANY

    def close() -> None:
        nonlocal strings, query
        query, strings = _join("and", [query, _spelt(strings)]), {""}

    open_end = False  # something that cannot be spelt out was passed
    for op, value in items:
        exact, inner = None, ANY
        if op is rc.LITERAL:
            exact = {chr(value).lower()}
        elif op is rc.IN and all(o is rc.LITERAL for o, _ in value):
            exact = {chr(v).lower() for _, v in value}
        elif op is rc.SUBPATTERN:
            exact, inner = _analyse(value[3])
        elif op is rc.BRANCH:
            parts = [_analyse(b) for b in value[1]]
            if all(e is not None for e, _ in parts):
                exact = set().union(*(e for e, _ in parts))
            else:
                inner = _join("or", [q if e is None else _join("and", [q, _spelt(e)]) for e, q in parts])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and value[:2] == (0, 1):
            exact, inner = _analyse(value[2])
            exact, inner = (exact | {""} if exact is not None else None), ANY
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and value[0] >= 1:
            once, inner = _analyse(value[2])
            if once is not None:
                inner = _spelt(once)
        if exact is not None and len(strings) * len(exact) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in exact}
            continue
        close()
        open_end = True
        query = _join("and", [query, inner if exact is None else _spelt(exact)])
    if open_end:
        close()
        return None, query
    return strings, query


def trigram_query(pattern: str) -> object:
    """ANY, a trigram, or ("and" | "or", parts): true of every text the pattern matches in."""
    strings, query = _analyse(rp.parse(pattern, re.ASCII))
    return query if strings is None else _join("and", [query, _spelt(strings)])


def trigrams(query: object) -> set[str]:
    if query == ANY:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _code(trigram: str) -> int:
    a, b, c = trigram.encode()
    return a << 16 | b << 8 | c


class Scanner:
    """The rules, their queries and the trigrams to index."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[[_code(t) for t in set().union(*(trigrams(q) for *_, q in self.rules))]] = True
        self.lower = np.arange(256, dtype=np.int32)
        self.lower[65:91] += 32

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        """Trigram code -> the documents that contain it, ascending."""
        if len(data) < 3:
            return {}
        low = self.lower[data]
        codes = low[:-2] << 16
        codes |= low[1:-1] << 8
        codes |= low[2:]
        place = np.flatnonzero(self.wanted[codes])
        doc = np.searchsorted(offsets, place, "right") - 1
        inside = place + 3 <= offsets[doc + 1]
        pairs = np.unique(np.stack([codes[place[inside]].astype(np.int64), doc[inside]], 1), axis=0)
        keys, starts = np.unique(pairs[:, 0], return_index=True)
        return dict(zip(keys.tolist(), np.split(pairs[:, 1], starts[1:]), strict=True)) if len(keys) else {}

    def candidates(self, query: object, index: dict[int, np.ndarray], docs: int) -> np.ndarray:
        if query == ANY:
            return np.arange(docs)
        if isinstance(query, str):
            return index.get(_code(query), np.zeros(0, np.int64))
        parts = sorted((self.candidates(q, index, docs) for q in query[1]), key=len)
        out = parts[0]
        for part in parts[1:]:
            out = np.intersect1d(out, part, True) if query[0] == "and" else np.union1d(out, part)
        return out

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Per text its spans (start, rule number, end) in code points, ascending."""
        data, offsets = common.text_bytes(texts)
        index = self.postings(data, offsets)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        for number, (rule, expression, query) in enumerate(self.rules):
            for doc in self.candidates(query, index, len(texts)).tolist():
                text = texts[doc].as_py() or ""
                found[doc] += [(m.start(), number, m.end()) for m in expression.finditer(text)
                               if m.end(rule.group) - m.start(rule.group) >= rule.least]
        for spans in found:
            spans.sort()
        return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    base = [r.kind for r in BASE]

    def said(spans) -> str:
        return ",".join(f"{RULES[k].kind}:{a}:{b}" for a, k, b in spans)

    for batch in common.sized_batches(batches, "text", BLOCK_BYTES):
        found = scanner.scan(batch.column("text"))
        own = [[s for s in spans if s[1] < len(base)] for spans in found]
        counts = [pa.array([sum(s[1] == k for s in spans) for spans in own], pa.int64()) for k in range(len(base))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *counts,
             pa.array([hashlib.sha256(said(s).encode()).hexdigest() for s in own], pa.string()),
             pa.array([said(s) for s in found], pa.string())],
            ["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, matches per base kind, the digest
    of the base spans and all spans (kind:start:end by start, then kind).

    Whole texts are searched; null and empty texts have no spans.  Repeated
    rows are reported each, an empty table gives no rows.
    """
    return common.small_batches(docs).select("doc_id", "text").mapInArrow(
        _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op6_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(common.table(spark, sf_dir, "documents"))
