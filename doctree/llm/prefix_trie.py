"""The trie of conversation prefixes, from sparse tables of least values over sorted LCPs.

Conversations are sequences of turn digests. In sorted order those that share a prefix stand together, and the LCP of
two neighbours is the number of turns that they share. A prefix of depth d that stands at place i reaches left and right
as far as no LCP is below d. A sparse table has the least LCP of every run of 1, 2, 4, ... places, so each end is found by a
binary search of its own, for all prefixes at once; no stack is kept, and no prefix waits for another.

The order is cut into parts by ranges of (sequence, conv_id), which split even conversations that are all alike. A second
sparse table, over the least LCP of each part, says in which part a search ends that leaves its own; there the place is one of
the few that a prefix of that part's first or last conversation asks for, so it comes by a join on (part, depth). Sums and
least ids over an interval are differences of running sums, and looked up like LCPs. Nothing is gathered for a prefix: a
node is one row however many conversations are its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doctree.llm.common import CRC_TABLE, crc32_sql, partition_id, table, written

#: Conversations of a part, and the number of parts at most: what is known of parts goes to all tasks (4 MB at most).
PART = 1 << 17
MOST_PARTS = 1 << 16
DIGEST = 16
_LINED = "part int, at long, conv_id long, len int, lcp int, shared long, leaf int, sizes array<int>, key binary"
_LOCAL = "kind string, part int, l long, d int, ref long, q int, leaves_l long, shared_l long, before long, r long, leaves_r long, shared_r long, conv_id long, ends string"
_EMPTY = hashlib.sha256(b"").hexdigest()


class LeastOf:
    """A sparse table of ``values``: the least of any run in two looks, and how far a run reaches in a binary search."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows, self.n = [values], len(values)
        while 2 << (len(self.rows) - 1) <= self.n:
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least of the values at a to b - 1, which must be one at least."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), self.rows[0].dtype)
        for k in np.unique(level):
            here = level == k
            out[here] = np.minimum(self.rows[k][a[here]], self.rows[k][b[here] - (1 << int(k))])
        return out

    def right(self, start: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The first place from ``start`` on with a value below ``d``, or n."""
        at = start.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            fits = np.flatnonzero(at + (1 << k) <= self.n)
            fits = fits[self.rows[k][at[fits]] >= d[fits]]
            at[fits] += 1 << k
        return at

    def left(self, end: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The last place before ``end`` with a value below ``d``, or -1."""
        at = end.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            fits = np.flatnonzero(at >= 1 << k)
            fits = fits[self.rows[k][at[fits] - (1 << k)] >= d[fits]]
            at[fits] -= 1 << k
        return at - 1


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns (d: digest of role and text, n: UTF-8 bytes of the text), in order.

    Rows go by turn, those without one first, and rows of equal turn by digest. Null roles and texts are empty. Rows
    without a conv_id belong to no conversation. Texts are read once and not shuffled.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col("turn").isNotNull().alias("timed"), "turn", digest.alias("d"), F.octet_length(text).alias("n"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    every = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return every.select("conv_id", F.transform("t", lambda t: F.struct(t["d"].alias("d"), t["n"].alias("n"))).alias("turns"))


def _shared(a: bytes, b: bytes) -> int:
    """The number of digests that two sequences begin with alike."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    if a[: high * DIGEST] == b[: high * DIGEST]:
        return high
    while low < high - 1:
        m = (low + high) // 2
        low, high = (m, high) if a[: m * DIGEST] == b[: m * DIGEST] else (low, m)
    return low


def _lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one part, in order, with the LCP with the row before. Only the first and the last keep their key."""
    part, at, held = partition_id(), 0, None
    schema = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("conv_id", pa.int64()), ("len", pa.int32()), ("lcp", pa.int32()), ("shared", pa.int64()), ("leaf", pa.int32()), ("sizes", pa.list_(pa.int32())), ("key", pa.binary())])
    for batch in batches:
        out = []
        for conv, key, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = [part, at, conv, len(sizes), None, None, None, sizes, key]
            if held is not None:
                row[4] = lcp = _shared(held[8], key)
                row[5] = sum(sizes[:lcp])
                held[6] = int(lcp < held[3])
                out.append([*held[:8], held[8] if held[1] == 0 else None])
            held, at = row, at + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(held, schema, strict=True)], schema=schema)


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part's first row: its LCP with the last of the part before, and the bytes that they share."""
    for batch in batches:
        part, key, before, sizes = (c.to_pylist() for c in batch.columns)
        lcp = [-1 if b is None else _shared(b, k) for b, k in zip(before, key, strict=True)]
        shared = [sum(s[: max(x, 0)]) for s, x in zip(sizes, lcp, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(lcp, pa.int32()), pa.array(shared, pa.int64())], ["part", "lcp0", "shared0"])


class _Parts:
    """What every task knows of all parts: a few numbers each, in order."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: r.part)
        column = lambda name, kind=np.int64: np.array([getattr(r, name) for r in rows], kind)
        self.part, self.lcp0, self.shared0, self.first_len, self.last_len = column("part"), column("lcp0", np.int32), column("shared0"), column("first_len"), column("last_len")
        last_leaf = np.append(self.lcp0[1:] < self.last_len[:-1], True)
        self.last_leaf = last_leaf.astype(np.int64)
        sums = lambda v: np.concatenate([[0], np.cumsum(v)]).astype(np.int64)
        self.starts, self.leaves, self.shared = sums(column("n")), sums(column("leaves") + self.last_leaf), sums(column("shared") + self.shared0)
        self.least_lcp = np.minimum(self.lcp0, np.array([2**31 - 1 if r.lcp is None else r.lcp for r in rows], np.int32))
        self.least_id = column("least_id")
        # Whether a part begins with the very conversation, id apart, that the one before ends with.
        self.same = np.concatenate([[False], (self.lcp0[1:] == self.last_len[:-1]) & (self.lcp0[1:] == self.first_len[1:])])


def _local(known: _Parts, top: LeastOf, top_id: LeastOf, rows: pa.Table) -> pa.Table:
    """All that a part tells: its nodes (those whose prefix is first seen here), and the ends of prefixes that cross its borders."""
    rows = rows.combine_chunks().sort_by("at")
    part = rows.column("part")[0].as_py()
    p = int(np.searchsorted(known.part, part))
    n, start = rows.num_rows, int(known.starts[p])
    number = lambda name: rows.column(name).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
    lcp, size, ids, leaf, shared = number("lcp").astype(np.int32), number("len").astype(np.int64), number("conv_id").astype(np.int64), number("leaf").astype(np.int64), number("shared").astype(np.int64)
    lcp[0], shared[0], leaf[-1] = known.lcp0[p], known.shared0[p], known.last_leaf[p]
    sizes = rows.column("sizes").combine_chunks()
    edges = np.concatenate([[0], np.cumsum(size)])
    upto = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64))])
    leaves = known.leaves[p] + np.concatenate([[0], np.cumsum(leaf)])
    share = known.shared[p] + np.concatenate([[0], np.cumsum(shared)])
    low, low_id = LeastOf(lcp), LeastOf(ids)
    out: list[pa.Table] = []

    def tell(kind: str, count: int, **columns: np.ndarray | list) -> None:
        arrays = {}
        for name, kind_of in (c.split(" ") for c in _LOCAL.split(", ")):
            t = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[kind_of]
            given = {"kind": [kind] * count, "part": np.full(count, p)}.get(name, columns.get(name))
            arrays[name] = pa.nulls(count, t) if given is None else given.cast(t) if isinstance(given, pa.Array) else pa.array(given).cast(t)
        out.append(pa.table(arrays))

    # Candidates: at each place the depths beyond what is shared with the place before.
    new = size - lcp
    i = np.repeat(np.arange(n), new)
    d = (np.arange(len(i)) - np.repeat(np.cumsum(new) - new, new) + lcp[i] + 1).astype(np.int64)
    j, up = low.right(i + 1, d), low.left(i + 1, d - 1)
    # Searches that leave the part to the right end in another one, or behind the last.
    out_right = np.flatnonzero(j == n)
    q = np.full(len(i), -1)
    q[out_right] = top.right(np.full(len(out_right), p + 1), d[out_right])
    least = low_id.least(i, j)
    between = out_right[q[out_right] > p + 1]
    least[between] = np.minimum(least[between], top_id.least(np.full(len(between), p + 1), q[between]))
    # Those that end at a border, or with all, end where part q begins.
    gone = q >= 0
    at_border = gone & (np.append(known.lcp0, -1)[q] < d)
    r, leaves_r, share_r = (np.where(at_border, whole[q], own) for whole, own in ((known.starts, start + j), (known.leaves, leaves[j]), (known.shared, share[j])))
    waits = gone & ~at_border
    null = lambda v: pa.array(v, mask=waits)
    # A parent that begins in an earlier part is named by this part: -1 for the first, and so on.
    ref = np.where(up >= 0, start + up, -p - 1)
    # Members that end at a node stand at its left end.
    begins = np.ones(n, bool)
    begins[1:] = ~((lcp[1:] == size[:-1]) & (lcp[1:] == size[1:]))
    runs = np.flatnonzero(begins)
    ends: list[str | None] = [_EMPTY] * len(i)
    slot = np.cumsum(new) - 1
    alias = [d[(up < 0) & (d > 0)] - 1]
    spanning = []
    words = ids.astype(str).tolist() if n else []
    for a, b in zip(runs.tolist(), [*runs[1:].tolist(), n], strict=True):
        from_before, goes_on = a == 0 and bool(known.same[p]), b == n and p + 1 < len(known.part) and bool(known.same[p + 1])
        text = ",".join(words[a:b])
        if not from_before:
            ends[slot[a]] = None if goes_on else hashlib.sha256(text.encode()).hexdigest()
        if from_before or goes_on:
            spanning.append((-p - 1 if from_before else start + a, int(size[a]), text))
            if from_before:
                alias.append(size[a : a + 1])
    tell("node", len(i), l=start + i, d=d, ref=pa.array(ref, mask=d == 0), q=pa.array(q, mask=~waits), leaves_l=leaves[i], shared_l=share[i + 1], before=upto[edges[i] + np.maximum(d - 1, 0)] - upto[edges[i]], r=null(r), leaves_r=null(leaves_r), shared_r=null(share_r), conv_id=least, ends=ends)
    if spanning:
        tell("ends", len(spanning), ref=[s[0] for s in spanning], d=[s[1] for s in spanning], ends=[s[2] for s in spanning])
    asked = np.unique(np.concatenate(alias))
    tell("alias", len(asked), d=asked, q=top.left(np.full(len(asked), p), asked))
    # Where prefixes of this part's first conversation end, and where those of the next part's begin.
    lowest = int(known.least_lcp[p])
    depth = np.arange(lowest + 1, int(known.lcp0[p]) + 1)
    j = low.right(np.zeros(len(depth), np.int64), depth)
    tell("right", len(depth), d=depth, r=start + j, leaves_r=leaves[j], shared_r=share[j], conv_id=low_id.least(np.zeros(len(depth), np.int64), j))
    if p + 1 < len(known.part):
        depth = np.arange(lowest + 1, int(known.lcp0[p + 1]) + 1)
        tell("left", len(depth), d=depth, l=start + low.left(np.full(len(depth), n), depth))
    return pa.concat_tables(out)


def _joined_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's id lists, which come in order, part by part; only the hash so far is held."""
    held, state = None, None
    said = lambda: pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int32()), pa.array([state.hexdigest()])], ["l", "d", "long_ends"])
    for batch in batches:
        for l, d, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: E741
            if held != (l, d):
                if held is not None:
                    yield said()
                held, state = (l, d), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if held is not None:
        yield said()


def nodes(found: DataFrame, part: int = PART, least_parts: int | None = None) -> DataFrame:
    """Each distinct prefix of the sequences ``found`` (conv_id, turns as :func:`sequences` has them; ids once each).

    conv_id (its smallest member), depth, parent_conv_id (the smallest member of the prefix one turn shorter; the root: null),
    n_convs (members), n_children, n_leaves (childless nodes in its subtree, itself included), saved_tokens (over its
    subtree, the bytes of each node's last text for each member but one), ends_sha256 (of the ids of members that end
    here, ascending, comma-joined). A sequence without turns is a member of the root. No sequences, no rows.
    One sequence is one value: 16 bytes a turn.
    """
    spark = found.sparkSession
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["d"])), ""))
    keyed = written(found.select("conv_id", key.alias("key"), F.col("turns.n").alias("sizes")), "sequences")
    n = keyed.count()
    least = int(spark.conf.get("spark.sql.shuffle.partitions")) if least_parts is None else least_parts
    n_parts = min(MOST_PARTS, max(least, -(-n // part), 1))
    ranged = keyed.repartitionByRange(n_parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    lined = written(ranged.select("conv_id", "key", "sizes").mapInArrow(_lined, _LINED), "lined")
    # At most two rows of each part: their keys are compared across its borders.
    edge = lined.where("key is not null").select("part", "at", "key", "sizes")
    before = F.lag("key").over(Window.orderBy("part", "at"))
    firsts = edge.select("part", "at", "key", before.alias("before"), "sizes").where("at = 0").select("part", "key", "before", "sizes").mapInArrow(_first_rows, "part int, lcp0 int, shared0 long")
    sums = lined.groupBy("part").agg(
        F.count("*").alias("n"), F.min("lcp").alias("lcp"), F.min("conv_id").alias("least_id"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("leaves"), F.coalesce(F.sum("shared"), F.lit(0)).alias("shared"),
        F.min_by("len", "at").alias("first_len"), F.max_by("len", "at").alias("last_len"),
    )
    rows = sums.join(firsts, "part").collect()  # MOST_PARTS at most
    if not rows:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    known = _Parts(rows)
    top, top_id = LeastOf(known.least_lcp), LeastOf(known.least_id)
    local = written(lined.drop("key").groupBy("part").applyInArrow(lambda t: _local(known, top, top_id, t), _LOCAL), "local")
    kind = lambda name, *columns: local.where(F.col("kind") == name).select(*columns)
    right = kind("right", F.col("part").alias("q"), "d", F.col("r").alias("r2"), F.col("leaves_r").alias("leaves2"), F.col("shared_r").alias("shared2"), F.col("conv_id").alias("id2"))
    own = kind("node", "l", "d", "ref", "q", "leaves_l", "shared_l", "before", "r", "leaves_r", "shared_r", "conv_id", "ends")
    late = own.where("q is not null").join(right, ["q", "d"]).withColumns({"r": F.col("r2"), "leaves_r": F.col("leaves2"), "shared_r": F.col("shared2"), "conv_id": F.least("conv_id", "id2")})
    every = own.where("q is null").unionByName(late.select(*own.columns)).select(
        "l", "d", "ref", "conv_id", "ends", (F.col("r") - F.col("l")).alias("n_convs"), (F.col("leaves_r") - F.col("leaves_l")).alias("n_leaves"),
        (F.col("shared_r") - F.col("shared_l") - (F.col("r") - F.col("l") - 1) * F.col("before")).alias("saved_tokens"),
    )
    every = written(every, "nodes")
    alias = kind("alias", (-F.col("part") - 1).cast("long").alias("ref"), "d", "q").join(kind("left", F.col("part").alias("q"), "d", "l"), ["q", "d"]).select("ref", "d", "l")
    alias = written(alias, "alias")
    # A name stands for a parent in one part, so no name has more children than a part has places.
    names = every.select("l", "d", "conv_id", F.col("l").alias("ref")).unionByName(alias.join(every.select("l", "d", "conv_id"), ["l", "d"]).select("l", "d", "conv_id", "ref"))
    parent = names.select("ref", (F.col("d") + 1).alias("d"), F.col("conv_id").alias("parent_conv_id"))
    counts = every.where("ref is not null").groupBy("ref", (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n")).join(names.select("ref", "d", "l"), ["ref", "d"])
    counts = counts.groupBy("l", "d").agg(F.sum("n").alias("n_children"))
    spans = kind("ends", "ref", "d", "part", "ends").join(names.select("ref", "d", "l"), ["ref", "d"]).select("l", "d", "part", "ends")
    spans = spans.repartition("l", "d").sortWithinPartitions("l", "d", "part").select("l", "d", "ends").mapInArrow(_joined_hash, "l long, d int, long_ends string")
    # Two parts have one list in common at most, so there are no more than parts.
    told = every.join(counts, ["l", "d"], "left").join(F.broadcast(written(spans, "ends")), ["l", "d"], "left").join(parent, ["ref", "d"], "left")
    return told.select(
        "conv_id", F.col("d").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends", "long_ends").alias("ends_sha256")
    )


def rebuilt(found: DataFrame) -> DataFrame:
    """``found`` (conv_id, turns) as op12's contract rebuilds it: c begins with the first h turns of c - c % 5, h = crc32(c) % 9."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9)).cast("int")
    base = found.select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("first"))
    both = found.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 5}).join(base, "base", "left")
    first = F.when(F.col("first").isNotNull(), F.slice("first", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(first, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def op12_lcp_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(sequences(table(spark, sf_dir, "conversations")), "conversations")
    return nodes(rebuilt(found))


QUERIES = {"op12_lcp_prefix_trie": op12_lcp_prefix_trie}
ORACLE_SQL = {
    "op12_lcp_prefix_trie": r"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS ts FROM m GROUP BY conv_id),
""" + CRC_TABLE + r""",
hs AS (SELECT conv_id, ts, conv_id - conv_id % 5 AS base, """ + crc32_sql("CAST(conv_id AS VARCHAR)") + r""" % 9 AS h FROM own, crc_table),
re AS (SELECT a.conv_id, list_concat(coalesce(b.ts, [])[1:a.h], a.ts[a.h + 1:]) AS ts FROM hs a LEFT JOIN own b ON b.conv_id = a.base),
pre AS (SELECT conv_id, ts[1:d] AS p, d, len(ts) AS n FROM (SELECT *, unnest(generate_series(0, len(ts))) AS d FROM re)),
node AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256,
    CASE WHEN d > 0 THEN strlen(p[d].t) ELSE 0 END AS bytes
  FROM pre GROUP BY p, d),
kid AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(kid.n, 0) AS n_children FROM node LEFT JOIN kid USING (p, d)),
up AS (SELECT p[1:k] AS p, k AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM (SELECT *, unnest(generate_series(0, d)) AS k FROM full_node) GROUP BY 1, 2)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, a.conv_id AS parent_conv_id, f.n_convs, f.n_children, up.n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_node f JOIN up USING (p, d) LEFT JOIN full_node a ON f.d > 0 AND a.d = f.d - 1 AND a.p = f.p[1:f.d - 1]
""",
}
