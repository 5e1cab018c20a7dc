"""SimHash near-duplicates, linked by multi-index hashing.

A text's fingerprint has a bit where more than half of its shingles' XXH64 have it. Fingerprints with at
most four differing bits are linked, and documents take the smallest id that links reach.

Links are found among distinct fingerprints. A fingerprint is split into segments. If two differ in few bits, then in
one of the segments they differ in fewer still: of m segments with radii that add up to ``DISTANCE + 1 - m``, one is
within its radius, or the differences would be one too many. So every fingerprint is stored under its segments, and
looked up under the points of the small Hamming balls around them. How many segments are best follows from the number
of fingerprints: wide segments have small buckets but large balls (see :func:`segments`).

Each bucket of stored and looked-up fingerprints verifies whole distances and emits only links that join parts which
are not joined yet, so a large group of near copies gives a forest of links, not all of its pairs. A bucket with many
stored fingerprints is cut into slices, which are tasks of their own: a task holds one slice, and what is looked up in it
streams past.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree.llm.common import row_key, slices, table, written

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Rows of buckets that one task takes, on average.
BUCKET_ROWS = 400_000
#: Stored fingerprints that a bucket may have in one task, and how many buckets with more there can be at most.
SLICE, MOST_HOT = 4096, 100_000
#: Pairs that are compared at once within a task.
BLOCK = 1_000_000
#: Pairs that cost as much as a row that is shuffled.
PAIRS_A_ROW = 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number; 0 for a text that is null or has no word."""
    if not text:
        return 0
    words = text.encode("utf-8", "replace").translate(_LOWER).split()  # bytes.split knows ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed = xxhash.xxh64_intdigest
    codes = np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    bits = np.zeros(64, np.int64)
    for part in range(0, len(codes), 65536):
        some = codes[part : part + 65536]
        bits += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    majority = np.flatnonzero(2 * bits > len(codes))
    return sum(1 << int(b) for b in majority)


def fingerprints(text: Column) -> Column:
    """The fingerprint of a text as a signed long with the same bits."""

    def of(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t) for part in slices(texts) for t in part.to_pylist()]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return F.arrow_udf(of, "bigint")(text)


def segments(n: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(width, radius) of each segment, from the highest bit: the cheapest cut for ``n`` fingerprints.

    Most segments have balls of radius 1 or more, whatever ``n`` is: more segments than that would be plain bands. A fingerprint makes a row for each point of its balls, and each row meets n / 2^width stored fingerprints on average.
    """

    def cost(cut: list[tuple[int, int]]) -> float:
        return sum(_ball(w, r) * (1 + n / 2**w / PAIRS_A_ROW) for w, r in cut)

    cuts = []
    for m in range(min(2, distance + 1), min(distance + 1, max(2 * (distance + 1) // 3, 2)) + 1):
        radius = [(distance + 1) // m - 1 + (k < (distance + 1) % m) for k in range(m)]
        width = [64 // m + (k < 64 % m) for k in range(m)]
        cuts.append(list(zip(width, radius, strict=True)))
    return min(cuts, key=cost)


def _ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def _keys(codes: np.ndarray, cut: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(segment, keys, whether they are those stored) for every segment and every point of its ball."""
    low = 64
    for k, (width, radius) in enumerate(cut):
        low -= width
        own = (codes >> np.uint64(low)) & np.uint64((1 << width) - 1)
        yield k, own, True
        for size in range(1, radius + 1):
            for bits in combinations(range(width), size):
                yield k, own ^ np.uint64(sum(1 << b for b in bits)), False


def _bucket_rows(codes: DataFrame, cut: list[tuple[int, int]]) -> DataFrame:
    """bucket, code, stored: the key under which a fingerprint is stored or looked up, with the segment's number."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 20_000):
                signed = batch.column(0).slice(start, 20_000)
                for k, keys, stored in _keys(signed.to_numpy(zero_copy_only=False).view(np.uint64), cut):
                    bucket = pa.array((keys.astype(np.int64) << 8) | k)
                    yield pa.RecordBatch.from_arrays([bucket, signed, pa.array(np.full(len(signed), stored))], ["bucket", "code", "stored"])

    return codes.mapInArrow(rows, "bucket bigint, code bigint, stored boolean")


class Bucket:
    """The stored fingerprints of one bucket, or of a slice of it, and the parts that links have joined so far."""

    def __init__(self, codes: np.ndarray, distance: int) -> None:
        self.codes, self.distance = codes, distance
        self.part = np.arange(len(codes))
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        left, ahead = np.arange(len(codes)), []
        if len(codes) ** 2 <= BLOCK:  # most fingerprints of a bucket are near to none of the others
            left = np.flatnonzero((np.bitwise_count(codes[:, None] ^ codes) <= distance).sum(1) > 1)
        # What a fingerprint reaches is taken from those that are left, so members of a dense group are compared once.
        while len(left) or ahead:
            if not ahead:
                at, left = int(left[0]), left[1:]
                part = at
            else:
                at = ahead.pop()
            near = np.bitwise_count(codes[left] ^ codes[at]) <= distance
            some, left = left[near], left[~near]
            self.part[some] = part
            ahead += some.tolist()
            self.found.append((np.full(len(some), codes[at]), codes[some]))

    def look_up(self, asked: np.ndarray) -> None:
        """Link each of ``asked`` with one fingerprint of every part that it is near to; those parts are one from then on."""
        n = len(self.codes)
        step = max(1, BLOCK // max(n, 1))
        for start in range(0, len(asked) if n else 0, step):
            some = asked[start : start + step]
            near = (np.bitwise_count(some[:, None] ^ self.codes) <= self.distance) & (some[:, None] != self.codes)
            least = np.where(near, self.part, n).min(1)
            most = np.where(near, self.part, -1).max(1)
            hit = np.flatnonzero(most >= 0)
            self.found.append((some[hit], self.codes[near[hit].argmax(1)]))
            for k in hit[least[hit] < most[hit]]:
                parts, at = np.unique(self.part[near[k]], return_index=True)
                self.found.append((np.full(len(parts), some[k]), self.codes[np.flatnonzero(near[k])[at]]))
                self.part[np.isin(self.part, parts)] = parts[0]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate([f[k] for f in self.found]) if self.found else np.zeros(0, np.uint64) for k in range(2))
        self.found = []
        return a, b


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], ["a", "b"])


def _links(rows: DataFrame, distance: int) -> DataFrame:
    """Verified links of partitions that hold each of their buckets whole."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)) for b in batches if len(b)]
        if not parts:
            return
        bucket, code, stored = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.lexsort((code, bucket))
        bucket, code, stored = bucket[order], code[order], stored[order]
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        size = np.diff(edge)
        n_stored = np.add.reduceat(stored.astype(np.int64), edge[:-1])
        left, right = [], []
        # Most buckets have one stored fingerprint, or few: their pairs are made at once.
        for most in (1, 2, 4, 8, 16):
            some = np.flatnonzero((size >= 2) & (n_stored >= 1) & (size <= most * 2) & (size > most))
            for chunk in range(0, len(some), 100_000):
                base, n = edge[some[chunk : chunk + 100_000]], size[some[chunk : chunk + 100_000]]
                for i in range(most * 2):
                    for j in range(most * 2):
                        both = (i < n) & (j < n)
                        a, b = base[both] + i, base[both] + j
                        near = stored[b] & (code[a] != code[b]) & (np.bitwise_count(code[a] ^ code[b]) <= distance)
                        left.append(code[a[near]])
                        right.append(code[b[near]])
        for g in np.flatnonzero((size > 32) & (n_stored >= 1)):
            own = slice(edge[g], edge[g + 1])
            one = Bucket(code[own][stored[own]], distance)
            one.look_up(code[own][~stored[own]])
            a, b = one.links()
            left.append(a)
            right.append(b)
        yield _pairs(np.concatenate(left), np.concatenate(right))

    return rows.mapInArrow(find, "a bigint, b bigint")


def _slice_links(rows: DataFrame, distance: int) -> DataFrame:
    """Verified links of slices (bucket, slice), sorted so that the stored fingerprints of each come first."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stored, one = None, [], None
        for batch in batches:
            own = np.stack([batch.column("bucket").to_numpy(), batch.column("slice").to_numpy()], 1)
            codes, flags = batch.column("code").to_numpy().view(np.uint64), batch.column("stored").to_numpy(zero_copy_only=False)
            new = np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1
            for start, end in zip([0, *new], [*new, len(own)], strict=True):
                if start == end:
                    continue
                if key != tuple(own[start]):
                    if stored:
                        yield _pairs(*Bucket(np.concatenate(stored), distance).links())
                    key, stored, one = tuple(own[start]), [], None
                some, held = codes[start:end], flags[start:end]
                if held.any():
                    stored.append(some[held])
                if not held.all():
                    if one is None:
                        one, stored = Bucket(np.concatenate(stored) if stored else np.zeros(0, np.uint64), distance), []
                    one.look_up(some[~held])
                    yield _pairs(*one.links())
        if stored:
            yield _pairs(*Bucket(np.concatenate(stored), distance).links())

    return rows.mapInArrow(find, "a bigint, b bigint")


def links(codes: DataFrame, distance: int = DISTANCE, most_stored: int = SLICE) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints in ``codes`` (code), enough to reach all that are linked."""
    n = codes.count()
    cut = segments(n, distance)
    rows = _bucket_rows(codes, cut)
    most_stored = max(most_stored, n * len(cut) // MOST_HOT)
    low, keys = 64, []
    for k, (width, _) in enumerate(cut):
        low -= width
        keys.append(F.shiftrightunsigned("code", low).bitwiseAND(F.lit((1 << width) - 1)) * 256 + k)
    # Fewer than MOST_HOT buckets have so many stored fingerprints: their list may be sent to all tasks.
    sizes = codes.select(F.explode(F.array(*keys)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    hot = written(sizes.where(F.col("n") > most_stored), "hot")
    partitions = lambda total: max(1, -(-total // BUCKET_ROWS))
    total = n * sum(_ball(w, r) for w, r in cut)
    if hot.isEmpty():
        return _links(rows.repartition(partitions(total), "bucket"), distance).distinct()
    cold = rows.join(F.broadcast(hot), "bucket", "left_anti").repartition(partitions(total), "bucket")
    slices_of = F.ceil(F.col("n") / F.lit(most_stored)).cast("int")
    own = F.pmod(F.xxhash64("code"), slices_of.cast("long")).cast("int")
    place = lambda k, stored: F.struct(k.alias("slice"), F.lit(stored).alias("stored"))
    held = F.when(F.col("stored"), F.array(place(own, True))).otherwise(F.array().cast("array<struct<slice:int,stored:boolean>>"))
    every = F.transform(F.sequence(F.lit(0), slices_of - 1), lambda k: place(k, False))
    each = rows.join(F.broadcast(hot), "bucket").select("bucket", "code", F.explode(F.concat(held, every)).alias("p")).select("bucket", "code", "p.*")
    count = hot.agg(F.sum(slices_of * slices_of * most_stored)).first()[0]
    sliced = each.repartition(partitions(count), "bucket", "slice").sortWithinPartitions("bucket", "slice", F.desc("stored"))
    return _links(cold, distance).unionByName(_slice_links(sliced, distance)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b), by repeated contraction.

    In each round every node goes to the neighbour, or itself, that comes first in an order by hash; edges
    are renamed and loops go. An order by hash lets a constant share of the nodes go in each round.
    """
    edges = written(edges.select("a", "b").where("a <> b"), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        order = lambda node: F.struct(F.xxhash64(node, F.lit(len(maps))).alias("place"), F.col(node).alias("node"))
        first = both.groupBy("a").agg(F.min(order("b")).alias("low"))
        step = written(first.select(F.col("a").alias("node"), F.least("low", order("a")).alias("low")).select("node", F.col("low.node").alias("root")), f"step{len(maps)}")
        maps.append(step)
        for side in ("a", "b"):
            edges = edges.join(step.select(F.col("node").alias(side), "root"), side).drop(side).withColumnRenamed("root", side)
        edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"edges{len(maps)}")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0]
    for step in maps[1:]:
        out = out.join(step.select(F.col("node").alias("root"), F.col("root").alias("outer")), "root", "left").select("node", F.coalesce("outer", "root").alias("root"))
    return out


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, code, component_id of every row of ``docs``.

    Null, empty and wordless texts have fingerprint 0 and are linked like any other. Rows without an id get
    the smallest id of their component, null if it has none. Repeated rows stay. An empty table gives none.
    """
    coded = written(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("code")), "codes")
    distinct = written(coded.groupBy("code").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = written(components(links(distinct.select("code"))), "roots")
    placed = distinct.join(roots.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code"))
    lowest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    final = placed.select("code", "root").join(lowest, "root").select("code", "component_id")
    return coded.join(final, "code").select("doc_id", "code", "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that with the smallest id, then text.

    Rows without an id stand last. Of rows equal in id and text one stays.
    """
    own_id, own_text = row_key(doc_id, text)
    coded = written(docs.select(F.col(doc_id).alias("d"), own_id, own_text, fingerprints(F.col(text)).alias("code")), "codes")
    by_code = coded.groupBy("code").agg(F.min(F.struct(F.col("d").isNull().alias("none"), "d", "k_text", "k_id")).alias("best"))
    distinct = written(by_code, "distinct")
    roots = components(links(distinct.select("code")))
    placed = distinct.join(roots.withColumnRenamed("node", "code"), "code", "left")
    chosen = placed.groupBy(F.coalesce("root", "code").alias("root")).agg(F.min("best").alias("best"))
    chosen = written(chosen.select(F.col("best.k_id").alias("doctree_id"), F.col("best.k_text").alias("doctree_text")), "chosen")
    keyed = docs.withColumns({"doctree_id": own_id, "doctree_text": own_text})
    kept = keyed.join(chosen, ["doctree_id", "doctree_text"])  # the keys' partitions serve dropDuplicates too
    return kept.dropDuplicates(["doctree_id", "doctree_text"]).select(*docs.columns)


def op7_multi_index_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op7_multi_index_simhash": op7_multi_index_simhash}
ORACLE_SQL: dict[str, str] = {}
