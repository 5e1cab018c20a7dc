"""Prefix tries against sets of prefixes, on conversations that share much, over many small parts."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from oracle import assert_agrees, database

from doctree import llm
from doctree.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, size int, l string, key string"


def plain(rebuilt):
    """Nodes of {conv_id: [(role, text), ...]}, one by one."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, of in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(of) - 1) * len(p[-1][1].encode()) if p else 0
    return {
        (min(of), len(p), min(members[p[:-1]]) if p else None, len(of), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, of in members.items()
    }


def rows_of(conversations):
    return [(c, None if k == 0 and c % 3 == 0 else k, role, text, 1, "l", "key") for c, turns in conversations.items() for k, (role, text) in enumerate(turns)]


def made(seed, n=80):
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "assistant", None, "é:"]), rng.choice(["hi", "", None, "é" * 3, "long " * 20]))
    stem = [turn() for _ in range(6)]
    every = {}
    for c in range(n):
        kind = rng.randrange(4)
        every[c * rng.choice([1, 1, 7])] = [stem[: rng.randrange(7)], stem[: rng.randrange(7)] + [turn() for _ in range(rng.randrange(4))], [turn() for _ in range(rng.randrange(1, 5))], list(stem)][kind]
    return every


def filled(turns):
    return [(r or "", t or "") for r, t in turns]


@pytest.mark.parametrize("seed", range(3))
def test_nodes_over_parts_of_any_size(spark, seed):
    every = {c: t for c, t in made(seed).items() if t}
    found = prefix_trie.sequences(spark.createDataFrame(rows_of(every), SCHEMA).repartition(3))
    want = plain({c: filled(t) for c, t in every.items()})
    for part in (1000, 7, 1):
        rows = prefix_trie.nodes(found, part=part, least_parts=1).collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_conversations_that_are_all_alike_are_dealt_over_parts(spark):
    every = {c: [("user", "the same"), ("assistant", "again")] for c in range(50)}
    rows = prefix_trie.nodes(prefix_trie.sequences(spark.createDataFrame(rows_of(every), SCHEMA)), part=4).collect()
    assert {tuple(r) for r in rows} == plain(every)


def test_searches_are_those_of_plain_loops():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64):
        values = rng.integers(0, 5, n).astype(np.int32)
        table = prefix_trie.LeastOf(values)
        at, d = rng.integers(0, n + 1, 200), rng.integers(0, 6, 200)
        assert table.right(at, d).tolist() == [next((k for k in range(a, n) if values[k] < x), n) for a, x in zip(at, d, strict=True)]
        assert table.left(at, d).tolist() == [next((k for k in range(a - 1, -1, -1) if values[k] < x), -1) for a, x in zip(at, d, strict=True)]
        a = rng.integers(0, n, 100)
        b = a + 1 + rng.integers(0, n, 100) % (n - a)
        assert table.least(a, b).tolist() == [values[x:y].min() for x, y in zip(a, b, strict=True)]


def rebuilt(every):
    out = {}
    for c, turns in every.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = every.get(c - c % 5, [])[:h] + turns[h:]
    return out


def test_op12_on_awkward_rows(spark, tmp_path):
    every = {c: t for c, t in made(9).items() if t}
    rows = rows_of(every) + [(None, 1, "user", "of no conversation", 1, "l", "key"), (4001, None, "user", "a", 1, "l", "key"), (4001, 5, "user", "b", 1, "l", "key")]
    every[4001] = [("user", "a"), ("user", "b")]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    found = llm.QUERIES["op12_lcp_prefix_trie"](spark, str(tmp_path)).collect()
    want = plain(rebuilt({c: filled(t) for c, t in every.items()}))
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    frame.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert llm.QUERIES["op12_lcp_prefix_trie"](spark, f"{tmp_path}/none").count() == 0


def test_op12_agrees_with_sql(spark):
    name = "op12_lcp_prefix_trie"
    assert_agrees(spark, database(), llm.QUERIES[name], llm.ORACLE_SQL[name])
