"""Conversation repair against a search over all edits, and over conversations that are spilled."""

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from oracle import assert_agrees, database

from doctree import llm
from doctree.llm import conversation_repair as repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, fault int, again string"
WHITE = "\x20\t\n\x0b\x0c\r"


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows, faults):
    """(cost, audit, repaired rows): the least of all edits, found over suffixes; letters decide ties."""
    legal = re.compile(r"(s?(ua)+)?")

    @functools.cache
    def best(i, last, inserted=0):  # last: initial of the last turn so far, or ''; inserted: turns since the last row
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        name = {"u": "user", "a": "assistant"}
        if i < len(rows):
            role, text = rows[i][1:]
            cost, audit, out = best(i + 1, last)
            found.append((cost + 4, "D" + audit, out))
            if faults[i] in (None, "truncated"):
                more = 3 if faults[i] else 0
                if role[:1] and role[:1] in follow:
                    cost, audit, out = best(i + 1, role[:1])
                    found.append((cost + more, "K" + audit, ((role, text), *out)))
                for c in follow.replace("s", ""):
                    cost, audit, out = best(i + 1, c)
                    found.append((cost + more + 3, "R" + audit, ((name[c], text), *out)))
        for c in follow.replace("s", ""):
            if inserted < 3:
                cost, audit, out = best(i, c, inserted + 1)
                found.append((cost + 3, "I" + audit, ((name[c], ""), *out)))
        return min(found, key=lambda f: f[:2], default=(10**9, "", ()))

    cost, audit, out = best(0, "")
    assert legal.fullmatch("".join(r[:1] for r, _ in out))
    return cost, audit, list(out)


def plain_report(c, rows):
    """rows: (turn, role, text) in order."""
    faults = plain_faults(rows)
    cost, audit, out = plain_repair(rows, faults)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    said = "\n".join(f"{r}:{t}" for r, t in out)
    return (c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def made(seed, n=150):
    rng = random.Random(seed)
    every = defaultdict(list)
    for c in range(n):
        for k in range(rng.randrange(1, 9)):
            turn = rng.choice([k, k, k, k + 1, None])
            every[c].append((turn, rng.choice(["user", "assistant", "system", "user", "assistant", "", "tool", "Über"]), rng.choice([f"t{k}.", f"t{k}!", f"t{k}", "same.", "", " \n", "what?\n "])))
    return {c: ordered(rows) for c, rows in every.items()}


@pytest.mark.parametrize("held", [repair.HELD, 1])
def test_reports_are_those_of_a_search(spark, held, monkeypatch):
    every = made(1)
    every[None] = [(0, "user", "no id."), (1, "assistant", "none.")]
    frame = spark.createDataFrame([(c, *r, 1, "again") for c, rows in every.items() for r in rows], SCHEMA).repartition(4)
    if held == 1:  # every row is spilled; in this process, as workers don't see the patch
        monkeypatch.setattr(repair, "HELD", held)
        got = set()
        for c, rows in every.items():
            now = repair._Conversation(c)
            for row, fault in zip(rows, plain_faults(rows), strict=True):
                now.add((*row, fault))
            got.add(now.report())
            assert now.old_rows.sizes and not now.rows
    else:
        got = {tuple(r) for r in repair.reports(frame).collect()}
    assert got == {plain_report(c, rows) for c, rows in every.items()}


def test_edits_have_the_repaired_texts(spark):
    every = made(2, 40)
    frame = spark.createDataFrame([(c, *r, 1, "again") for c, rows in every.items() for r in rows], SCHEMA).repartition(4)
    got = defaultdict(list)
    for r in repair.edits(frame).orderBy("place").collect():
        got[r.conv_id].append(r)
    for c, rows in every.items():
        faults = plain_faults(rows)
        _, audit, out = plain_repair(rows, faults)
        assert "".join(r.op for r in got[c]) == audit
        assert [(r.role, r.text) for r in got[c] if r.role is not None] == out
        assert [(r.turn, r.fault) for r in got[c] if r.op != "I"] == [(t, f) for (t, *_), f in zip(rows, faults, strict=True)]


def test_a_conversation_over_many_batches(spark):
    n = 9001
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(n)] + [(2, 0, "user", "x" * 3_000_000 + "."), (2, 1, "assistant", "end.")]
    found = {r.conv_id: r for r in repair.reports(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert found[1].audit == "K" * n + "I" and found[1].cost == 3
    want = "\n".join(f"{r}:{t}" for _, _, r, t in rows[:n]) + "\nassistant:"
    assert found[1].repaired_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert found[2].audit == "KK" and found[2].gaps == 0


def damaged(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out[c] += [row] * (2 if k == 3 else 1)
    return out


def test_op13_on_awkward_rows(spark, tmp_path):
    rows = [(c, t, None if r == "tool" else r, None if x == "same." else x) for c, every in made(3, 300).items() for t, r, x in every] + [(None, 3, "user", "no id")]
    frame = spark.createDataFrame([(*r, 1, "again") for r in rows], SCHEMA)
    frame.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = llm.QUERIES["op13_streamed_conversation_repair"](spark, str(tmp_path)).collect()
    after = damaged(rows)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {plain_report(c, ordered(after[c])) if c in after else (c, *empty) for c in {r[0] for r in rows}}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    frame.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert llm.QUERIES["op13_streamed_conversation_repair"](spark, f"{tmp_path}/none").count() == 0


def test_op13_agrees_with_sql(spark):
    name = "op13_streamed_conversation_repair"
    assert_agrees(spark, database(), llm.QUERIES[name], llm.ORACLE_SQL[name])
