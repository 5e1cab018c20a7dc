"""Repair of conversation structure: the cheapest edits that give an optional system turn and pairs of user and assistant.

Rows are dealt by conversation and sorted by turn within a task, which then streams over them once. What it carries from row to
row, over the borders of Arrow batches, is a table of four states (nothing yet, after a system, user or assistant turn), each with
the least cost to get there and its rank among the four by its edits' letters. A step leaves four backpointers, one byte each. At a
conversation's end they are followed back, and its rows are told again with their edits. Rows and backpointers of a
conversation are in memory up to ``HELD`` bytes; those of a larger one are spilled to a file without a name that only this task
reads, so memory is bounded however many turns a conversation has.

Costs: Keep 0, Rerole to user or assistant 3, Insert an empty user or assistant turn 3, Delete 4. Blank and duplicate rows must be
deleted; a truncated row that stays costs 3 more. Of equally cheap edits those whose letters come first count.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doctree.llm.common import CRC_TABLE, crc32_sql, table

#: Bytes of a conversation's rows, and of its backpointers, that are held in memory.
HELD = 8_000_000
#: Rows of an output batch, and their bytes.
OUT_ROWS, OUT_BYTES = 2_000, 4_000_000
#: ASCII white space, and what a text should end with.
BLANKS, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
_TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_LETTERS = "DKR"
_EDIT, _COST = {"K": 0, "R": 3, "D": 4}, 3

Row = tuple  # turn, role, text, fault
States = tuple[tuple[int, int, int], ...]  # (state, cost above the least, rank) of those that can be reached


def _inserted(state: int, n: int) -> int:
    for _ in range(n):
        state = _TURN[state]
    return state


@lru_cache(100_000)
def step(states: States, initial: str, fault: str | None) -> tuple[States, int, bytes]:
    """The states after one more row, what the least of them costs more, and each state's backpointer.

    A backpointer is the state before, the number of turns inserted in between, and the letter's place in ``_LETTERS``,
    two bits each. All strings of edits up to here end with a row's letter and have as many of them, so none begins another:
    they compare by the first difference, which is the order of the states before or the letters since.
    """
    best: dict[int, tuple] = {}
    for state, cost, rank in states:
        for n in range(3):
            between = _inserted(state, n)
            for letter in _LETTERS if fault not in (BLANK, DUPLICATE) else "D":
                after = between if letter == "D" else _TURN[between]
                if letter == "K":
                    own = _INITIAL.get(initial)
                    if own == SYSTEM and between == START:
                        after = SYSTEM
                    elif own != after:
                        continue
                more = _COST * n + _EDIT[letter] + (_COST if fault == TRUNCATED and letter != "D" else 0)
                found = (cost + more, rank, "I" * n + letter, state)
                if after not in best or found < best[after]:
                    best[after] = found
    least = min(b[0] for b in best.values())
    order = {s: k for k, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
    back = bytes(best[s][3] | (len(best[s][2]) - 1) << 2 | _LETTERS.index(best[s][2][-1]) << 4 if s in best else 0 for s in range(4))
    return tuple((s, best[s][0] - least, order[s]) for s in sorted(best)), least, back


def finish(states: States) -> tuple[int, int, int]:
    """(cost above the least so far, state, turns inserted at the end) of the best way to end."""
    ways = [(cost + _COST * n, rank, state, n) for state, cost, rank in states for n in ({START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}[state],)]
    cost, _, state, n = min(ways)
    return cost, state, n


class _Spool:
    """Chunks of bytes in order: in memory up to ``HELD`` bytes, then in a file of this task."""

    def __init__(self) -> None:
        self.file, self.sizes = tempfile.SpooledTemporaryFile(max_size=HELD), []

    def add(self, chunk: bytes) -> None:
        self.file.write(chunk)
        self.sizes.append(len(chunk))

    def chunks(self, backwards: bool = False) -> Iterator[bytes]:
        starts = list(itertools.accumulate(self.sizes, initial=0))[:-1]
        both = list(zip(starts, self.sizes, strict=True))
        for start, size in reversed(both) if backwards else both:
            self.file.seek(start)
            yield self.file.read(size)


class _Conversation:
    """The state of one conversation while its rows come."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.states, self.cost = conv_id, ((START, 0, 0),), 0
        self.rows: list[Row] = []
        self.back, self.held = bytearray(), 0
        self.old_rows: _Spool | None = None
        self.old_back: _Spool | None = None
        self.faults = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0)
        self.first_turn = self.last_turn = self.before = None
        self.turns = self.illegal = 0

    def add(self, row: Row) -> None:
        turn, role, text, fault = row
        self.states, more, back = step(self.states, role[:1], fault)
        self.cost += more
        self.back += back
        self.rows.append(row)
        if fault:
            self.faults[fault] += 1
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        self.held += 200 + len(text) * 2
        if self.held > HELD:
            self.spill()

    def spill(self) -> None:
        if self.old_rows is None:
            self.old_rows, self.old_back = _Spool(), _Spool()
        self.old_rows.add(pickle.dumps(self.rows))
        self.old_back.add(bytes(self.back))
        self.rows, self.back, self.held = [], bytearray(), 0

    def edits(self) -> Iterator[tuple[str, Row | None, str | None]]:
        """(letter, row, role) in order; inserted turns have no row, and those that go no role."""
        cost, state, at_end = finish(self.states)
        self.total = self.cost + cost
        # One byte a row: the turns inserted before it, and its letter; followed back, then read forward.
        said = bytearray()
        for chunk in itertools.chain([self.back], self.old_back.chunks(backwards=True) if self.old_back else []):
            for at in range(len(chunk) - 4, -4, -4):
                pointer = chunk[at + state]
                said.append(pointer >> 2)
                state = pointer & 3
        chunks = itertools.chain(map(pickle.loads, self.old_rows.chunks()) if self.old_rows else [], [self.rows])
        state = START
        for pointer, row in zip(reversed(said), itertools.chain.from_iterable(chunks), strict=True):
            for _ in range(pointer & 3):
                state = _TURN[state]
                yield "I", None, ROLES[state]
            letter = _LETTERS[pointer >> 2]
            if letter == "K":
                state = _INITIAL[row[1][:1]]
                yield letter, row, row[1]
            elif letter == "R":
                state = _TURN[state]
                yield letter, row, ROLES[state]
            else:
                yield letter, row, None
        for _ in range(at_end):
            state = _TURN[state]
            yield "I", None, ROLES[state]

    def report(self) -> tuple:
        digest, first, letters = hashlib.sha256(), True, []
        for letter, row, role in self.edits():
            letters.append(letter)
            if role is not None:
                digest.update(f"{'' if first else chr(10)}{role}:{row[2] if row else ''}".encode())
                first = False
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.total, "".join(letters), digest.hexdigest())

    def edited(self) -> Iterator[tuple]:
        for place, (letter, row, role) in enumerate(self.edits()):
            yield (self.conv_id, place, letter, row[0] if row else None, role, (row[2] if row else "") if role is not None else None, row[3] if row else None)


def _streamed(tell: Callable[[_Conversation], Iterator[tuple]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: ``tell`` for each conversation of rows (conv_id, turn, role, text, fault) that come sorted."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now: _Conversation | None = None
        for batch in batches:
            for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        yield from tell(now)
                    now = _Conversation(conv_id)
                now.add(tuple(row))
        if now is not None:
            yield from tell(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        for row in rows(batches):
            out.append(row)
            size += sum(len(v) for v in row if isinstance(v, str))
            if len(out) >= OUT_ROWS or size > OUT_BYTES:
                yield pack()
                out, size = [], 0
        if out:
            yield pack()

    return run


def faults(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and fault, dealt by conversation and sorted by turn (null first), role and text.

    A row's first fault counts: blank (only white space), duplicate (role and text stand earlier in the conversation), truncated
    (does not end with a mark). Null roles and texts are empty. One shuffle, by conversation, serves both sorts.
    """
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text).repartition("conv_id")
    rows = rows.withColumn("digest", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))))
    again = F.row_number().over(Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first()))
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(bare == "", BLANK).when(F.col("again") > 1, DUPLICATE).when(~F.substring(bare, -1, 1).isin(*ENDS), TRUNCATED)
    found = rows.withColumn("again", again).withColumn("fault", fault)
    ordered = found.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "again")
    return ordered.select("conv_id", "turn", "role", "text", "fault")


def edits(conversations: DataFrame) -> DataFrame:
    """The edits of each conversation (conv_id, turn, role, text), in order of ``place``: op, the turn and fault of its row,
    and the role and text that stand in the repaired conversation.

    ``op`` is K, R, D or I; a deleted row has neither role nor text, an inserted one neither turn nor fault. Rows without a conv_id are
    one conversation. Null roles and texts are empty; rows of equal turn go by role and text, so repeated ones are duplicates. Other
    columns have no effect. Texts are taken whole; no rows, no edits.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("op", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string())])
    return faults(conversations).mapInArrow(_streamed(_Conversation.edited, schema), "conv_id long, place long, op string, turn long, role string, text string, fault string")


def reports(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: gaps in its turns, its rows by fault, illegal neighbours, the edits' cost and letters (audit),
    and the hash of the repaired ``role:text`` lines. Rows are taken as :func:`edits` takes them."""
    names = ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")
    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in names), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    told = "conv_id long, " + "".join(f"{n} long, " for n in names) + "audit string, repaired_sha256 string"
    return faults(conversations).mapInArrow(_streamed(lambda c: iter([c.report()]), schema), told)


def damaged(conversations: DataFrame) -> DataFrame:
    """op13's damage, by crc32 of ``conv_id:turn`` modulo 20 (nulls: one blank): 0 drops a row, 1 empties its text, 2 takes its marks, 3 repeats it, 4 makes it a user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), k.alias("k")).where("k <> 0")
    text: Column = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    times = F.when(F.col("k") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("again")).drop("again")


def op13_streamed_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = reports(damaged(rows))
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    every = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    none = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    columns = [F.coalesce(c, F.lit(none.get(c, 0)).cast("string" if c in none else "long")).alias(c) for c in found.columns[1:]]
    return every.select(F.col("id").alias("conv_id"), *columns)


QUERIES = {"op13_streamed_conversation_repair": op13_streamed_conversation_repair}
ORACLE_SQL = {
    "op13_streamed_conversation_repair": "WITH RECURSIVE "
    + CRC_TABLE
    + """,
m AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    """
    + crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    + r""" % 20 AS k FROM conversations, crc_table),
d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) AS again FROM m WHERE k <> 0),
o AS (SELECT *, left(role, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i FROM d),
f AS MATERIALIZED (
  SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM o),
ins(q, k, q1, said) AS (VALUES
  (0, 0, 0, NULL), (0, 1, 2, 'user:'), (0, 2, 3, 'user:' || chr(10) || 'assistant:'),
  (1, 0, 1, NULL), (1, 1, 2, 'user:'), (1, 2, 3, 'user:' || chr(10) || 'assistant:'),
  (2, 0, 2, NULL), (2, 1, 3, 'assistant:'), (2, 2, 2, 'assistant:' || chr(10) || 'user:'),
  (3, 0, 3, NULL), (3, 1, 2, 'user:'), (3, 2, 3, 'user:' || chr(10) || 'assistant:')),
ops(op, c, q1, q2, more, role) AS (VALUES
  ('D', NULL, 0, 0, 4, NULL), ('D', NULL, 1, 1, 4, NULL), ('D', NULL, 2, 2, 4, NULL), ('D', NULL, 3, 3, 4, NULL),
  ('K', 's', 0, 1, 0, NULL), ('K', 'u', 0, 2, 0, NULL), ('K', 'u', 1, 2, 0, NULL), ('K', 'u', 3, 2, 0, NULL), ('K', 'a', 2, 3, 0, NULL),
  ('R', NULL, 0, 2, 3, 'user'), ('R', NULL, 1, 2, 3, 'user'), ('R', NULL, 3, 2, 3, 'user'), ('R', NULL, 2, 3, 3, 'assistant')),
tr AS MATERIALIZED (SELECT q, k, op, c, q2, 3 * k + more AS more, said, role FROM ins JOIN ops USING (q1)),
dp(conv_id, i, q, cost, audit, said) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, 0, '', CAST(NULL AS VARCHAR) FROM f
  UNION ALL
  SELECT conv_id, i, q2, cost, audit, said FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, q2 ORDER BY cost, audit) AS rank FROM (
      SELECT dp.conv_id, f.i, tr.q2, dp.cost + tr.more + CASE WHEN tr.op <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END AS cost, dp.audit || repeat('I', tr.k) || tr.op AS audit,
        nullif(concat_ws(chr(10), dp.said, tr.said, CASE WHEN tr.op <> 'D' THEN coalesce(tr.role, f.role) || ':' || f.text END), '') AS said
      FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN tr ON tr.q = dp.q AND (tr.c IS NULL OR tr.c = f.c) AND (tr.op = 'D' OR coalesce(f.fault, 'truncated') = 'truncated')))
  WHERE rank = 1),
n AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
e AS (
  SELECT n.*, dp.cost + 3 * ins.k AS cost, dp.audit || repeat('I', ins.k) AS audit, concat_ws(chr(10), dp.said, ins.said) AS said
  FROM n JOIN dp ON dp.conv_id IS NOT DISTINCT FROM n.conv_id AND dp.i = n.n JOIN ins ON ins.q = dp.q AND ins.k = CASE dp.q WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS rank FROM e)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN (SELECT * FROM b WHERE rank = 1) b ON b.conv_id IS NOT DISTINCT FROM ids.conv_id
""",
}
