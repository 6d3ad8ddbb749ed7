"""Piece encoding against the library on whole texts; alignment against all pairs of tokens."""

import hashlib
import random
from collections import Counter

import pytest

from rentalytics.llm import common, piece_chunks, queries, token_alignment

from .conftest import LONG, ROWS, SF, collected

LETTERS = " ▁ab\n\t\x00　é<s>|endoftext'd日😀́‍▂ ▀\xa0\x1c\x85"


@pytest.fixture(scope="module")
def odd_texts():
    draw = random.Random(7)
    few = ["".join(draw.choices(LETTERS, k=draw.randrange(30))) for _ in range(3000)]
    any_letter = [chr(c) for c in [*range(1, 0xD800, 7), *range(0xE000, 0x20000, 11)]]
    return [None, "", " ", "  ", "▁", *few, *("".join(draw.choices(any_letter, k=draw.randrange(40))) for _ in range(3000))]


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=piece_chunks.piece_model())


def test_chunks_give_the_ids_of_whole_texts(odd_texts, library, monkeypatch):
    texts = [*odd_texts, LONG, "x" * 30_000, " " * 5000]
    coder = piece_chunks.PieceCoder(piece_chunks.piece_model())
    assert coder.cut and coder.encode(texts) == library.encode([t or "" for t in texts])
    monkeypatch.setattr(piece_chunks, "TABLE_WORDS", 50)  # a table that is emptied all the time
    assert [ids for t in texts for ids in coder.encode([t])] == library.encode([t or "" for t in texts])


def test_pieces_edge_cases(spark, edge_docs, no_docs, library):
    got = collected(piece_chunks.encoded(edge_docs, piece_chunks.piece_model(), decode=True))
    want = Counter((d, t, tuple(library.encode(t or "", add_eos=True))) for d, t, _, _ in ROWS)
    assert Counter((r["doc_id"], r["text"], tuple(r["ids"])) for r in got) == want
    assert all(r["decoded"] == (r["text"] or "") for r in got)
    clash = edge_docs.withColumnRenamed("size", "ids").withColumnRenamed("hash", "decoded")
    kept = piece_chunks.encoded(clash, piece_chunks.piece_model(), decode=True)
    assert kept.columns == [*clash.columns, "_ids", "_decoded"] and kept.count() == len(ROWS)
    back = piece_chunks.decoded(piece_chunks.encoded(edge_docs, piece_chunks.piece_model(), end_id=False),
                                piece_chunks.piece_model())
    assert all(r["decoded"] == (r["text"] or "") for r in collected(back))
    nothing = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r["decoded"] for r in collected(piece_chunks.decoded(nothing, piece_chunks.piece_model()))] == ["", ""]
    assert piece_chunks.encoded(no_docs, piece_chunks.piece_model()).count() == 0


def test_pieces_of_the_documents(spark, library):
    want = set()
    for r in common.table(spark, SF, "documents").collect():
        ids = library.encode(r.text or "", add_eos=True)
        want.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert {tuple(r) for r in queries.QUERIES["op11_piece_chunks"](spark, SF).collect()} == want


# --- alignment ------------------------------------------------------------------
class Brute:
    """Both libraries on whole texts, every token against every token."""

    def __init__(self, library):
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(token_alignment.byte_vocabulary()), library
        self.a.encode_special_tokens = True
        letters = token_alignment._byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in w) for w, i in self.a.get_vocab().items()}

    def b_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    @staticmethod
    def spans(ids, pieces):
        out, at = [], 0
        for i, piece in zip(ids, pieces, strict=True):
            out.append((at, at + len(piece), i))
            at += len(piece)
        return out

    def __call__(self, text):
        """(n_a, n_b, groups, links by id pair)."""
        want = f" {text}".encode()
        a = self.a.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = self.b.encode(text) if text else []
        pieces = [self.a_bytes[i] for i in a], [self.b_bytes(i) for i in b]
        if not text or any(b"".join(own) != want for own in pieces):
            return 0, 0, [], Counter()
        a, b = self.spans(a, pieces[0]), self.spans(b, pieces[1])
        links = Counter((x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1])
        groups, start = [], 0
        for end in sorted({x[1] for x in a} & {y[1] for y in b}):
            groups.append("|".join(",".join(str(t[2]) for t in side if start <= t[0] < end) for side in (a, b)))
            start = end
        return len(a), len(b), groups, links


@pytest.fixture(scope="module")
def brute(library):
    return Brute(library)


def test_overlaps_and_groups(odd_texts, brute, monkeypatch):
    align = token_alignment.Aligner(token_alignment.byte_vocabulary(), piece_chunks.piece_model())
    for most in (500_000, 20):
        monkeypatch.setattr(token_alignment, "TABLE_CHUNKS", most)
        for at in range(0, len(odd_texts), 700):
            texts = odd_texts[at:at + 700]
            rows = zip(*(v.to_pylist() for v in align(texts).values()), strict=True)
            for text, (n_a, n_b, n_groups, n_links, groups, pairs, times) in zip(texts, rows, strict=True):
                a, b, want, links = brute(text)
                assert (n_a, n_b, n_groups, n_links, groups) == (a, b, len(want), sum(links.values()), ";".join(want))
                assert dict(zip(pairs, times, strict=True)) == {x << token_alignment.B_BITS | y: n for (x, y), n in links.items()}
    assert align([])["groups"].to_pylist() == [] and align([None])["groups"].to_pylist() == [""]


def brute_linked(brute, rows):
    found = [(doc, brute(text)) for doc, text in rows]
    counts = Counter(pair for _, (_, _, _, links) in found for pair in links)
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return Counter(
        (doc, n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if counts[p] == most[p[0]]),
         sum(n * counts[p] for p, n in links.items()),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "")
        for doc, (n_a, n_b, groups, links) in found)


@pytest.mark.parametrize("bound", [token_alignment.PAIRS_BROADCAST, 0])
def test_alignment_edge_cases(spark, edge_docs, no_docs, brute, monkeypatch, bound):
    monkeypatch.setattr(token_alignment, "PAIRS_BROADCAST", bound)
    files = token_alignment.byte_vocabulary(), piece_chunks.piece_model()
    small = edge_docs.where("text is null or length(text) < 10000")
    want = brute_linked(brute, [r[:2] for r in ROWS if r[1] != LONG])
    assert Counter(tuple(r) for r in token_alignment.linked(small, *files).collect()) == want
    assert token_alignment.linked(no_docs, *files).count() == 0


def test_alignment_of_the_documents(spark, brute):
    rows = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    short = [r for r in rows if len(r[1] or "") < 3000]
    docs = common.table(spark, SF, "documents").where("text is null or length(text) < 3000")
    files = token_alignment.byte_vocabulary(), piece_chunks.piece_model()
    assert Counter(tuple(r) for r in token_alignment.linked(docs, *files).collect()) == brute_linked(brute, short)
    got = queries.QUERIES["op13_token_alignment"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows) and all(r.n_links >= max(r.n_a, r.n_b) for r in got)
