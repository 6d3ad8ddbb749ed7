"""The prefix trie against one that is built and summed up by hand."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from rentalytics.llm import common, prefix_trie, queries

from .conftest import SF

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    """rows: (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    for own in turns.values():
        own.sort(key=lambda t: (t[0], hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()))
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for conv in sorted(turns):
        h = zlib.crc32(str(conv).encode()) % 6
        path = tuple(t[1:] for t in turns.get(conv - conv % 100, [])[:h] + turns[conv][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
            if d:
                children[path[:d - 1]].add(path[:d])
        ends[path].append(conv)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or int(not children[node])
        saved[node] = sum(saved[c] for c in children[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted(
        (min(convs), len(node), min(members[node[:-1]]) if node else -1, len(convs), len(children[node]), leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, convs in members.items())


def rows_of(frame):
    assert tuple(frame.columns) == COLUMNS
    return sorted(tuple(-1 if v is None else v for v in r) for r in frame.collect())


def drawn(seed, convs, longest, words):
    draw = random.Random(seed)
    rows = []
    for conv in convs:
        for turn in range(draw.randrange(longest)):
            rows.append((conv, draw.choice((turn, turn, turn // 2, None)), draw.choice(("user", "bot", None, "")),
                         draw.choice((None, "", *words))))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("shard_vertices, queue_rows", [(None, 100_000), (40, 3), (7, 1)])
def test_trie_equals_brute_force(spark, shard_vertices, queue_rows):
    rows = drawn(3, [*range(60), *range(230, 260), 300, 301, 1000], 9, ("a", "bc", "đ😀"))
    rows += [(5, 1, "user", "a")] * 3  # repeated rows
    rows += [(300, i, "user", f"t{i % 3}") for i in range(150)]  # one long conversation, and others that leave it
    rows += [(400 + c, i, "user", f"t{i % 3}") for c in range(8) for i in range(20 * c)]
    rows += [(None, 1, "user", "no conversation"), (700, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(prefix_trie.trie(frame, shard_vertices, queue_rows)) == brute(rows)


def test_copies_turnless_conversations_and_empty_tables(spark):
    for rows in ([], [(None, 0, "user", "x")], [(101, 0, "user", "short")], [(c, 0, "u", "same") for c in range(200, 300)]):
        frame = spark.createDataFrame(rows, SCHEMA)
        assert rows_of(prefix_trie.trie(frame)) == brute(rows)


def test_clashing_columns(spark):
    rows = drawn(5, range(20), 6, ("a", "b"))
    names = ("lv", "x1", "x2", "of", "own", "h", "n", "part", "place", "points", "shard", "digest")
    frame = spark.createDataFrame([(*r, *names) for r in rows], SCHEMA + "".join(f", {n} string" for n in names))
    assert rows_of(prefix_trie.trie(frame, 20, 5)) == brute(rows)


def test_queue_gives_all_in_order():
    draw = random.Random(1)
    for most in (1, 2, 10, 1000):
        queue, held, out = prefix_trie.SpillingQueue(most), [], []
        for i in range(3000):
            if held and draw.random() < 0.4:
                assert queue.peek() == min(held)
                out.append(queue.pop())
                held.remove(out[-1])
            else:
                item = (draw.randrange(500), i)
                queue.push(item)
                held.append(item)
        assert [queue.pop() for _ in range(len(held))] == sorted(held) and queue.peek() is None


def test_trie_of_the_conversations(spark):
    rows = [tuple(r) for r in common.table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.QUERIES["op12_prefix_trie"](spark, SF)) == brute(rows)
