"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are normalised (A-Z to lower case; words are runs of ASCII letters, digits and all other non-ASCII
characters). A document word is hit where ten consecutive words of an item, or a whole item of fewer words, stand.
The automaton's symbols are the digits of word numbers, not characters, and its keys are the items' words cut into
fives: ten consecutive words of an item always have one of these whole. Each text is scanned once. Windows of the text around a match
are looked up among the items' windows, which are there once each, whichever and however many items have them: so what a match costs
does not grow with the items that share a passage. Hits are mapped back to word places, and those to character spans of
the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree.llm.common import slices, table, written

WINDOW = 10
#: One automaton takes items of so many UTF-8 bytes, with which a worker holds about 250 MB (measured, see the README).
#: More items are scanned for in blocks of that size, one after the other.
BLOCK_BYTES = 8_000_000
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
HIT = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"
_HIT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", _SPANS)])

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The same words where A-Z have not been lowered, for places in the original text.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BASE = 128
#: The automaton of the worker's present stage.
_built: dict[str, Machine] = {}


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split()


class Machine:
    """The automaton of a block of items (id, text), and their windows.

    ``flat`` has the numbers of all items' words, with a 0 around each text. ``hashes`` are those of the distinct windows,
    sorted; ``shown`` says where in ``flat`` each stands, and ``who[since[w]:since[w + 1]]`` which items have it, as places in
    the sorted ``ids``. Items of fewer words are keys by themselves, with their items in ``short``.
    """

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.window, self.number = window, {}
        self.step = step = (window + 1) // 2
        self.ids = sorted({item for item, _ in items})
        rank = {item: k for k, item in enumerate(self.ids)}
        flat, starts, owners = [0], [], []
        keys: dict[tuple[int, ...], int] = {}
        self.short: dict[int, list[int]] = {}
        for item, text in items:
            own = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            if not own:
                continue
            if len(own) < window:
                self.short.setdefault(keys.setdefault(tuple(own), len(keys)), []).append(rank[item])
            else:
                for start in range(0, len(own) - step + 1, step):
                    keys.setdefault(tuple(own[start : start + step]), len(keys))
                n = len(own) - window + 1
                starts.append(np.arange(len(flat), len(flat) + n, dtype=np.int32))
                owners.append(np.full(n, rank[item], np.int32))
            flat += [*own, 0]
        self.flat = np.array(flat, np.int32)
        self.size = [len(key) for key in keys]
        self._windows(np.concatenate(starts) if starts else np.zeros(0, np.int32), np.concatenate(owners) if owners else np.zeros(0, np.int32))
        # A node's children are searched one by one, so digits, not numbers, are symbols. Zeros stand for other words.
        self.digits = 1
        while _BASE**self.digits <= len(self.number):
            self.digits += 1
        self.code = ["".join(chr(n // _BASE**d % _BASE + bool(n)) for d in range(self.digits)) for n in range(len(self.number) + 1)]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for key, at in keys.items():
            self.automaton.add_word("".join([self.code[n] for n in key]), at)
        if keys:
            self.automaton.make_automaton()

    def _windows(self, starts: np.ndarray, owners: np.ndarray) -> None:
        """Sort the windows by hash, each once. Hashes that two windows share are replaced by others."""
        self.base = 0x9E3779B97F4A7C15
        while True:
            hashes = self._hashes(self.flat, starts)
            order = np.argsort(hashes, kind="stable")
            hashes, at = hashes[order], starts[order]
            same = hashes[1:] == hashes[:-1]
            pairs = np.flatnonzero(same)
            if all((self.flat[at[pairs] + k] == self.flat[at[pairs + 1] + k]).all() for k in range(self.window)):
                break
            self.base += 2
        first = np.concatenate([np.ones(min(len(at), 1), bool), ~same])
        self.hashes, self.shown = hashes[first], at[first]
        owners = owners[order]
        once = first.copy()
        once[1:] |= owners[1:] != owners[:-1]  # an item's windows follow each other, as the sort is stable
        group = np.cumsum(first) - 1
        self.who = owners[once]
        self.since = np.searchsorted(group[once], np.arange(len(self.hashes) + 1))

    def _hashes(self, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        base = np.uint64(self.base)
        for k in range(self.window):
            out = (out + numbers[starts + k].astype(np.uint64) + np.uint64(1)) * base
            out ^= out >> np.uint64(29)
        return out

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """The number of words, the merged runs of hit words (first, after the last), and the items found, sorted."""
        found = words(text) if text else []
        if not found or not self.size:
            return len(found), [], []
        get = self.number.get
        numbers = [get(w, 0) for w in found]
        code, k = self.code, self.digits
        hits = [(end // k, key) for end, key in self.automaton.iter("".join([code[n] for n in numbers])) if end % k == k - 1]
        if not hits:
            return len(found), [], []
        runs = [(end - self.size[key] + 1, end + 1) for end, key in hits if key in self.short]
        who = [np.array(self.short[key], np.int32) for key in {key for _, key in hits if key in self.short}]
        own = np.array(numbers, np.int32)
        at = np.array([end - self.step + 1 for end, key in hits if self.size[key] == self.step], np.int64)
        around = np.unique(at[:, None] + np.arange(self.step - self.window, 1))
        around = around[(around >= 0) & (around <= len(own) - self.window)]
        if len(around) and len(self.hashes):
            hashes = self._hashes(own, around)
            slot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            fits = self.hashes[slot] == hashes
            around, slot = around[fits], slot[fits]
            fits = np.ones(len(around), bool)
            for n in range(self.window):
                fits &= own[around + n] == self.flat[self.shown[slot] + n]
            runs += [(a, a + self.window) for a in around[fits].tolist()]
            who += [self.who[self.since[w] : self.since[w + 1]] for w in np.unique(slot[fits]).tolist()]
        merged: list[tuple[int, int]] = []
        for a, b in sorted(runs):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        items = np.zeros(len(self.ids), bool)
        for some in who:
            items[some] = True
        return len(found), merged, [self.ids[n] for n in np.flatnonzero(items).tolist()]


def _hits(text: Column, items: list[tuple[str, str]], window: int, spark: SparkSession) -> Column:
    sent = spark.sparkContext.broadcast(items)
    name = hashlib.sha256(repr((window, items)).encode()).hexdigest()

    def machine() -> Machine:
        if name not in _built:
            _built.clear()
            _built[name] = Machine(sent.value, window)
        return _built[name]

    def find(texts: pa.Array) -> pa.Array:
        own, rows = machine(), []
        for part in slices(texts):
            for text in part.to_pylist():
                n, runs, ids = own.scan(text)
                spans = []
                if runs:
                    at = [m.span() for m in _WORD.finditer(text)]
                    spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]
                rows.append({"n_words": n, "n_hit": sum(b - a for a, b in runs), "items": ids, "spans": spans})
        return pa.array(rows, _HIT)

    return F.arrow_udf(find, HIT)(text)


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size; the driver holds one block at a time."""
    block: list[tuple[str, str]] = []
    size = 0
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(text)).where(F.col(text).isNotNull())
    for item, body in rows.toLocalIterator():
        n = len(body.encode("utf-8", "replace"))
        if block and size + n > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item, body))
        size += n
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, into: str = "hits") -> DataFrame:
    """``docs`` with the struct column ``into``: n_words, n_hit, items (sorted as strings), spans (characters of the original).

    A null or empty text has no words; an item without words is in no text; a null item_id counts as the id ''.
    Rows of one item_id are one item. Repeated documents get equal results, texts of any length are scanned whole, and
    other columns stay; a column ``into`` of the input is replaced. An empty table gives an empty one. If the items
    need several automata (see BLOCK_BYTES), every text is scanned with one after the other, each in a job of its own,
    so that no task holds two, and the hits are merged exactly.
    """
    spark, own, first = docs.sparkSession, "doctree_hits", True
    for block in _blocks(benchmark, item_id, item_text):
        if first:
            docs, first = docs.drop(into).withColumn(into, _hits(F.col(text), block, window, spark)), False
        else:
            more = written(docs, "hits").withColumn(own, _hits(F.col(text), block, window, spark))
            docs = more.withColumn(into, _merged(F.array(into, own), F.col(text))).drop(own)
    return docs


def _merged(blocks: Column, text: Column) -> Column:
    def merge(found: pa.Array, texts: pa.Array) -> pa.Array:
        rows = []
        for parts, body in zip(found.to_pylist(), texts.to_pylist(), strict=True):
            spans: list[list[int]] = []
            for start, end in sorted((s["start"], s["end"]) for p in parts for s in p["spans"]):
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(end, spans[-1][1])
                else:
                    spans.append([start, end])
            n_hit = sum(len(_WORD.findall(body[a:b])) for a, b in spans)
            items = sorted({i for p in parts for i in p["items"]})
            rows.append({"n_words": parts[0]["n_words"], "n_hit": n_hit, "items": items, "spans": [{"start": a, "end": b} for a, b in spans]})
        return pa.array(rows, _HIT)

    return F.arrow_udf(merge, HIT)(blocks, text)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with the columns they have.

    Rows with a null or empty text stay; without items every row does. Repeated rows have one fate.
    """
    own = "doctree_found"
    return contamination(docs, benchmark, into=own).where(F.col(f"{own}.n_hit") == 0).drop(own)


def op6_aho_corasick_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op6_aho_corasick_decontamination": op6_aho_corasick_decontamination}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
ORACLE_SQL = {
    "op6_aho_corasick_decontamination": rf"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS k
  FROM item, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(s) WHERE len(w) > 0),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
size AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT d.r, d.s, size.n, array_to_string(d.w[d.s:d.s + size.n - 1], ' ') AS k
  FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS s FROM doc WHERE len(w) > 0) d, size WHERE d.s + size.n - 1 <= len(d.w)),
hit AS (SELECT occ.r, occ.s, occ.n, win.item_id FROM occ JOIN win USING (n, k)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
""",
}
