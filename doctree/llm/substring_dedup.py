"""Substring deduplication: words covered by a window of words that starts anywhere else are removed.

A count-min sketch decides which windows are counted exactly. A window is sketched by the hash of its least
eight-word run (the leftmost of equals), so equal windows make equal updates, and neighbouring windows mostly share a
run and with it one update: about one for each fifteen words. The sketch has ``DEPTH`` rows of 2^``WIDTH_BITS`` cells.
Every partition sketches its own texts and keeps only the cells that are not zero, so a partition's sketch is bounded
by its own texts and the width costs nothing. Partition sketches are merged by addition, and a run's estimate is the
least of its cells. It never falls below the true count; of N updates a run that is there once is estimated higher
with a chance of (N / 2^42)^2: under 7 % at 10^12 updates, some 100 TB of text.

The second pass groups only what the sketch can't rule out: windows whose run is estimated at two or more. Neighbouring
windows with the same least run make a unit, which has a fingerprint of all its words. Units that are alike are repeated
as a whole; windows of one unit of each other kind are grouped one by one, by run and fingerprint. These have 128 bits
together: n windows make a false pair with a chance below n^2 / 2^129 (10^-13 at 10^13 windows). No window with
a second occurrence is lost, as its run occurs at both places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree.llm.common import among, row_key, slices, table, written

WINDOW = 35
RUN = 8
DEPTH = 2
WIDTH_BITS = 42
#: Words that a slice of texts can have: 2^31.
PLACE_BITS = 31

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_KEYS = ("substring window", "substring second")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base)]), dtype=np.uint64)[:n]


def _rolling(codes: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A hash of every n consecutive codes, by their places in the run: sums modulo 2^64 of code * base^place."""
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(codes * _powers(base, len(codes)), dtype=np.uint64)])
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    return _mixed((prefix[n:] - prefix[:-n]) * _powers(inverse, len(codes) - n + 1))


class Words:
    """The words of a slice of texts, one after the other: which text has each, and two hashes of each."""

    def __init__(self, texts: list[str | None]) -> None:
        self.by_text = [(t or "").encode("utf-8", "replace").split() for t in texts]
        self.size = np.array([len(w) for w in self.by_text], np.int64)
        self.edge = np.concatenate([[0], np.cumsum(self.size)])
        flat = [w for words in self.by_text for w in words]
        which, distinct = pd.factorize(np.array(flat, object)) if flat else (np.zeros(0, np.int64), np.zeros(0, object))
        self.hashes = []
        for key in _KEYS:
            codes = pd.util.hash_array(distinct.astype(object), hash_key=key, categorize=False) if len(distinct) else np.zeros(0, np.uint64)
            self.hashes.append(codes.astype(np.uint64)[which])

    def windows(self, n: int) -> np.ndarray:
        """Places where a window of n words starts and ends in the same text."""
        total = int(self.edge[-1])
        room = np.repeat(self.edge[1:], self.size) - np.arange(total)
        return room >= n


def _least_runs(words: Words, window: int, run: int) -> np.ndarray:
    """For every place, the place of the least run of the window that starts there (-1: no window does)."""
    total = int(words.edge[-1])
    out = np.full(total, -1, np.int64)
    if total < window:
        return out
    runs = _rolling(words.hashes[0], run, _ODD[0])
    # Upper hash bits and place in one number: the least is the leftmost of the least. The share of bits is
    # fixed, so that equal windows choose alike in every slice.
    packed = (runs >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS) | np.arange(len(runs), dtype=np.uint64)
    width = window - run + 1
    pad = -len(packed) % width
    blocks = np.concatenate([packed, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: len(packed) - width + 1], ahead[width - 1 : len(packed)])
    place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    some = np.flatnonzero(words.windows(window))
    out[some] = place[some]
    return out


def _hashes(words: Words, run: int, places: np.ndarray) -> np.ndarray:
    """The hash of the run at each of ``places``."""
    if not len(places):
        return np.zeros(0, np.int64)
    return _rolling(words.hashes[0], run, _ODD[0])[places].view(np.int64)


def updates(docs: DataFrame, window: int, run: int) -> DataFrame:
    """k_id, k_text, runs of each text that has some: the hashes of its windows' least runs, once for each place."""

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch.column(2)):
                words = Words(part.to_pylist())
                least = _least_runs(words, window, run)
                places = np.unique(least[least >= 0])
                edge = np.searchsorted(places, words.edge)
                runs = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(_hashes(words, run, places)))
                own = [batch.column(i).slice(done, len(part)) for i in range(2)]
                done += len(part)
                yield pa.RecordBatch.from_arrays([*own, runs], ["k_id", "k_text", "runs"]).filter(pa.array(np.diff(edge) > 0))

    return docs.select("k_id", "k_text", "text").mapInArrow(update, "k_id bigint, k_text bigint, runs array<bigint>")


def _cell(run: str, row: int, width_bits: int) -> Column:
    """The cell of a run in a row of the sketch; the row is in the number, so cells of several rows differ."""
    return F.shiftrightunsigned(F.xxhash64(run, F.lit(row)), 64 - width_bits) * DEPTH + row


def estimated_twice(found: DataFrame, depth: int = DEPTH, width_bits: int = WIDTH_BITS) -> DataFrame:
    """k_id, k_text, runs: of each text in ``found`` (k_id, k_text, runs) those runs whose estimate is two or more."""
    each = found.select("k_id", "k_text", F.explode("runs").alias("run"))
    # Tasks add up what their own partition has, which is its sketch, before the shuffle merges them.
    rows = each.select(F.explode(F.array(*(_cell("run", r, width_bits) for r in range(depth)))).alias("cell"))
    cells = written(rows.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "sketch")
    total = found.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0]
    for r in range(depth):
        mine = cells.where(F.pmod("cell", F.lit(depth)) == r)
        each = among(each.withColumn("cell", _cell("run", r, width_bits)), mine, ["cell"], total).drop("cell")
    return each.groupBy("k_id", "k_text").agg(F.collect_set("run").alias("runs"))


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_DOC = "doc_id {kind}, k_id bigint, k_text bigint, n_words bigint, kept_sha256 string, text string, units array<struct<run:bigint,start:int,n:int,print:bigint>>"
_UNIT = pa.struct([("run", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("print", pa.int64())])


def _units(words: Words, window: int, run: int) -> tuple[np.ndarray, ...]:
    """Neighbouring windows with one least run: its hash, their starts, numbers of windows and fingerprints.

    The fingerprint is of all words that the unit's windows cover.
    """
    least = _least_runs(words, window, run)
    places = np.flatnonzero(least >= 0)
    if not len(places):
        return (np.zeros(0, np.int64),) * 4
    new = np.concatenate([[True], (least[places[1:]] != least[places[:-1]]) | (places[1:] != places[:-1] + 1)])
    start = places[new]
    n = np.diff(np.concatenate([np.flatnonzero(new), [len(places)]]))
    hashed = _hashes(words, run, least[start])
    codes, base = words.hashes[1], _ODD[1]
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(codes * _powers(base, len(codes)), dtype=np.uint64)])
    inverse = _powers(np.uint64(pow(int(base), -1, 1 << 64)), len(codes))
    prints = _mixed((prefix[start + n + window - 1] - prefix[start]) * inverse[start]).view(np.int64)
    return hashed, start, n, prints


def _candidates(joined: DataFrame, kind: str, window: int, run: int) -> DataFrame:
    """Per row: the final result where no window is in doubt; else the text, and its units of windows in doubt."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch.column(3)):
                texts = part.to_pylist()
                own = batch.column(4).slice(done, len(part)).to_pylist()
                words = Words(texts)
                hashed, start, n, prints = _units(words, window, run)
                edge = np.searchsorted(start, words.edge)
                size, some = np.zeros(len(texts), np.int64), []
                for k, doubted in enumerate(own):
                    if doubted:
                        at = edge[k] + np.flatnonzero(np.isin(hashed[edge[k] : edge[k + 1]], np.array(doubted, np.int64)))
                        size[k] = len(at)
                        some.append(at)
                at = np.concatenate(some) if some else np.zeros(0, np.int64)
                first = (start[at] - np.repeat(words.edge[:-1], size)).astype(np.int32)
                flat = pa.StructArray.from_arrays([pa.array(hashed[at]), pa.array(first), pa.array(n[at].astype(np.int32)), pa.array(prints[at])], fields=list(_UNIT))
                units = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), flat)
                digests = [None if m else _digest(words.by_text[k]) for k, m in enumerate(size.tolist())]
                kept = [t if m else None for t, m in zip(texts, size.tolist(), strict=True)]
                base = [batch.column(i).slice(done, len(part)) for i in range(3)]
                done += len(part)
                yield pa.RecordBatch.from_arrays([*base, pa.array(words.size), pa.array(digests, pa.string()), pa.array(kept, pa.string()), units], ["doc_id", "k_id", "k_text", "n_words", "kept_sha256", "text", "units"])

    return joined.select("doc_id", "k_id", "k_text", "text", "runs").mapInArrow(find, _DOC.format(kind=kind))


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """k_id, k_text, place, run, print of the windows of the listed ``units`` (start, n, run) of each text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch.column(2)):
                words = Words(part.to_pylist())
                prints = _rolling(words.hashes[1], window, _ODD[1]).view(np.int64)
                units = batch.column(3).slice(done, len(part)).to_pylist()
                owner = np.repeat(np.arange(len(part)), [len(u) for u in units])
                start, n, run = (np.array([u[f] for x in units for u in x], np.int64) for f in ("start", "n", "run"))
                place = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                at = pa.array(done + np.repeat(owner, n))
                where = place + words.edge[np.repeat(owner, n)]
                done += len(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(place.astype(np.int32)), pa.array(np.repeat(run, n)), pa.array(prints[where])], ["k_id", "k_text", "place", "run", "print"])

    return rows.select("k_id", "k_text", "text", "units").mapInArrow(emit, "k_id bigint, k_text bigint, place int, run bigint, print bigint")


def _covered(n: int, ranges: list[dict], window: int) -> np.ndarray:
    """Which of n words are covered by windows; a range has the first of them and how many start one after the other."""
    steps = np.zeros(n + 1, np.int64)
    start = np.array([r["start"] for r in ranges])
    np.add.at(steps, start, 1)
    np.add.at(steps, start + np.array([r["n"] for r in ranges]) + window - 1, -1)
    return np.cumsum(steps[:-1]) > 0


def _finished(rows: DataFrame, kind: str, window: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, left = [], [], []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode("utf-8", "replace").split()
                gone = _covered(len(words), places, window) if places else np.zeros(len(words), bool)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                removed.append(int(gone.sum()))
                left.append(len(words))
                digests.append(_digest(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.select("doc_id", "text", "repeated").mapInArrow(cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, run: int = RUN, width_bits: int = WIDTH_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``.

    A null or empty text has no words; a text of fewer than ``window`` words keeps all. Repeated rows are
    texts like any other: each makes the windows of the others repeated. A row without an id is kept apart
    by its text. Other columns have no effect. An empty table gives an empty one. ``run`` must be at most ``window``.
    """
    kind = dict(docs.dtypes)[doc_id]
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *row_key(doc_id, text))
    keys = ["k_id", "k_text"]
    # a text that is there twice has two rows here, so its runs are counted twice
    doubted = estimated_twice(written(updates(own, window, run), "updates"), DEPTH, width_bits)
    found = written(_candidates(own.join(doubted, keys, "left"), kind, window, run), "candidates")
    units = found.where(F.size("units") > 0).select(*keys, F.explode("units").alias("u")).select(*keys, "u.*")
    # Units that are there twice are repeated as a whole. Of each kind of unit one stands for all; only where
    # several kinds have a run can their windows be equal too, and only there windows are counted one by one.
    kinds = ["run", "n", "print"]
    alike = units.groupBy(*kinds).agg(F.count("*").alias("times"), F.min(F.struct(*keys, "start")).alias("one"))
    alike = written(alike, "kinds")
    total = alike.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    whole = among(units, alike.where("times > 1").select("run", F.col("n"), "print", "times"), kinds, total, "times").select(*keys, "start", "n")
    mixed = alike.groupBy("run").agg(F.count("*").alias("kinds")).where("kinds > 1").select("run")
    wanted = alike.join(mixed, "run").select("one.k_id", "one.k_text", F.struct("one.start", "n", "run").alias("unit"))
    wanted = wanted.groupBy(*keys).agg(F.collect_list("unit").alias("units"))
    # Repeated rows give their windows twice here, rightly so.
    texts = found.where(F.col("text").isNotNull()).select(*keys, "text")
    windows = written(_windows(texts.join(wanted, keys), window), "windows")
    repeated = windows.groupBy("run", "print").agg(F.count("*").alias("times")).where("times > 1").select("run", "print")
    single = windows.join(repeated, ["run", "print"]).select(*keys, F.col("place").alias("start"), F.lit(1).alias("n"))
    hits = whole.unionByName(single).groupBy(*keys).agg(F.collect_set(F.struct("start", "n")).alias("repeated"))
    open_rows = found.where(F.col("kept_sha256").isNull()).select("doc_id", *keys, "text")
    done = found.where(F.col("kept_sha256").isNotNull()).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return done.unionByName(_finished(open_rows.join(hits, keys, "left"), kind, window))


def op3_count_min_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


QUERIES = {"op3_count_min_substring_dedup": op3_count_min_substring_dedup}

_W = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
ORACLE_SQL = {
    "op3_count_min_substring_dedup": rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_W} AS w FROM documents),
win AS (SELECT r, s, array_to_string(w[s:s + 34], ' ') AS k FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS s FROM doc WHERE len(w) >= 35)),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(generate_series(s, s + 34)) AS p FROM win JOIN rep USING (k)),
word AS (SELECT r, w[p] AS x, p FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS p FROM doc)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) AS BIGINT) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (r)
""",
}
