"""Token counts of whole texts without token ids: pieces are counted once for each distinct pre-token.

A byte-level tokenizer first cuts a text into pre-tokens and then merges bytes within each of them, so a text's tokens
are the sum of its pre-tokens' pieces. Each document becomes its pre-tokens with their frequencies; the distinct
pre-tokens of all documents are run through the tokenizer once; the two are joined and summed.

Pre-tokens that very many documents have are few: so many of the most frequent ones as ``MOST_SENT`` allows go to all tasks, and
their rows are summed where they stand. Only the rows of the others are shuffled by pre-token, and none of these has more
than some ``1 / MOST_SENT`` of all rows.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctree.llm.common import partition_id, slices, table, written

VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens that are sent to all tasks, and the bytes that one of these may have: 13 MB at most.
MOST_SENT = 200_000
SENT_BYTES = 64
#: Chunks whose pre-tokens a worker remembers.
MOST_CHUNKS = 200_000
#: Characters of a text that are cut at once.
SEGMENT = 1_000_000
#: More tokens than this are over the limit.
LIMIT = 1024

# A blank before something else always begins a pre-token, so chunks that begin there can be cut by themselves.
_CHUNK = re.compile(r" (?=\S)")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ž"
#: Chunks of these characters are cut here, by the tokenizers' fixed pattern; all others by the library.
_PLAIN = re.compile(f"[ -~\\n{_LETTERS}]*")
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(4)
def _tokenizer(path: str):
    """The tokenizer, and a pattern of the strings that it takes out of a text before anything else (None: it has none).

    Raises ValueError where counts of pre-tokens would not add up: other pre-tokenizers, normalizers, or added tokens that
    look at what stands around them.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    cut = said["pre_tokenizer"] or {}
    if cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space") or said["normalizer"]:
        raise ValueError(f"{path}: needs a byte-level tokenizer without a normalizer and without a prefix blank")
    added = said["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in added):
        raise ValueError(f"{path}: added tokens with blanks, or that depend on their neighbours, are not supported")
    names = sorted((re.escape(t["content"]) for t in added), key=len, reverse=True)
    return Tokenizer.from_file(path), re.compile("(" + "|".join(names) + ")") if names else None


_seen: dict[str, dict[str, tuple[str, ...]]] = {}


def _pre_tokens(chunk: str, path: str) -> tuple[str, ...]:
    if _PLAIN.fullmatch(chunk):
        return tuple(_PARTS.findall(chunk))
    cut = _tokenizer(path)[0].pre_tokenizer.pre_tokenize_str(chunk)
    return tuple(chunk[a:b] for _, (a, b) in cut)


def _chunks(text: str) -> Iterator[str]:
    """The chunks of a text, which begin at blanks; a long text is cut segment by segment."""
    at = 0
    while at < len(text):
        found = _CHUNK.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
        upto = found.start() if found else len(text)
        first, *others = _CHUNK.split(text[at:upto])
        if first:
            yield first
        yield from (" " + p for p in others)
        at = upto


def frequencies(text: str, path: str) -> Counter[str]:
    """How often each pre-token stands in ``text``; a string that the tokenizer takes out is one of its own."""
    special = _tokenizer(path)[1]
    parts = special.split(text) if special and special.search(text) else [text]
    found: Counter[str] = Counter(parts[1::2])
    known = _seen.setdefault(path, {})
    if len(known) > MOST_CHUNKS:
        known.clear()
    for part in parts[0::2]:
        for chunk, n in Counter(_chunks(part)).items():
            cut = known.get(chunk)
            if cut is None:
                cut = _pre_tokens(chunk, path)
                if len(chunk) <= SENT_BYTES:
                    known[chunk] = cut
            for token in cut:
                found[token] += n
    return found


def _row_frequencies(docs: DataFrame, keep: list[str], text: str, path: str) -> DataFrame:
    own = [T.StructField("doctree_row", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("times", T.ArrayType(T.LongType()))]
    names = [*keep, *(f.name for f in own)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = partition_id() << 33
        for batch in batches:
            at = 0
            for part in slices(batch.column(len(keep))):
                offsets, tokens, times, size = [0], [], [], []
                for value in part.to_pylist():
                    found = frequencies(value or "", path)
                    tokens += found.keys()
                    times += found.values()
                    offsets.append(len(tokens))
                    size.append(len((value or "").encode()))
                n = len(size)
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values) for values in (pa.array(tokens, pa.string()), pa.array(times, pa.int64()))]
                rows = pa.array(np.arange(row, row + n), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, n) for i in range(len(keep))), rows, pa.array(size, pa.int64()), *lists], names)
                at += n
                row += n

    kept = docs.select(*keep)
    return docs.select(*keep, F.col(text).alias("doctree_text")).mapInArrow(run, T.StructType([*kept.schema.fields, *own]))


def _pieces(distinct: DataFrame, path: str) -> DataFrame:
    """``distinct`` (token, docs) with pieces: each pre-token goes through the tokenizer once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _tokenizer(path)[0]
        for batch in batches:
            coded = whole.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(e) for e in coded], pa.int64())], ["token", "docs", "pieces"])

    return distinct.select("token", "docs").mapInArrow(run, "token string, docs long, pieces long")


def counted(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` with n_bytes (UTF-8) and n_tokens of its whole text.

    ``n_tokens`` is what the tokenizer at ``path`` gives for the text as a whole, without added begin, end or padding. A null
    text counts as empty: no bytes, no tokens. Repeated rows stay, each with its counts; an empty table gives an empty one.
    Other columns have no effect; columns named n_bytes or n_tokens may not be kept. A text of any length is taken whole, but its
    distinct pre-tokens must fit in a task.
    """
    if set(keep) & {"n_bytes", "n_tokens", "tokens", "times", "doctree_row"}:
        raise ValueError("the names of results cannot be kept")
    path = path or tokenizer_path()
    rows = written(_row_frequencies(docs, keep, text, path), "frequencies", compression="zstd")
    each = rows.select("doctree_row", F.inline(F.arrays_zip(F.col("tokens").alias("token"), F.col("times").alias("times"))))
    pieces = written(_pieces(each.groupBy("token").agg(F.count("*").alias("docs")), path), "pieces", compression="zstd")
    # The most frequent ones, down to a power of two of documents that leaves few enough.
    level = F.floor(F.log2("docs")).cast("int")
    short = F.octet_length("token") <= SENT_BYTES
    levels = pieces.where(short).groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()  # 64 rows at most
    least, room = 64, most_sent
    for k, n in sorted(levels, reverse=True):
        room -= n
        if room < 0:
            break
        least = k
    sent = F.broadcast(pieces.where(short & (level >= least)).select("token", "pieces"))
    rest = pieces.where(~short | (level < least)).select("token", "pieces")
    n = F.sum(F.col("times") * F.col("pieces")).alias("n_tokens")
    common = each.join(sent, "token").groupBy("doctree_row").agg(n)
    rare = each.join(sent.select("token"), "token", "left_anti").join(rest, "token").groupBy("doctree_row").agg(n)
    total = common.unionByName(rare).groupBy("doctree_row").agg(F.sum("n_tokens").alias("n_tokens"))
    found = rows.select("doctree_row", *keep, "n_bytes").join(total, "doctree_row", "left")
    return found.select(*keep, "n_bytes", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))


def op11_pre_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counted(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


QUERIES = {"op11_pre_token_counts": op11_pre_token_counts}
#: The vocabulary has no SQL form; tests hold the query against the tokenizer on whole texts.
ORACLE_SQL: dict[str, str] = {}
