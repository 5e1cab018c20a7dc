"""Best-fit packing of tokenised documents into sequences of a fixed length, by hierarchical residual packing.

Documents become token ids (each with an end token), and those longer than a sequence are cut into pieces.
Full pieces are sequences of their own. All others are dealt over partitions; each packs its pieces best-fit
in decreasing order and emits the bins that are nearly full. Underfull bins become items of the next
round, in which several partitions merge into one, and so on up the tree. Of the bins of one partition at
most one is half full or less, so where a round saves no bin, what is left to merge are those few: they are the
only items of the rounds that follow, until a single partition has packed them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree.llm.common import partition_id, slices, table, written

LENGTH = 2048
END = 0
VOCABULARY = "word_bpe_49k.json"
#: Items that one partition packs in memory; about 60 MB of Python.
ITEMS = 60_000
#: Partitions that merge into one from a round to the next.
FAN_IN = 8
#: Words whose ids a worker remembers in each of two generations; about 40 MB each.
MOST_WORDS = 200_000
#: A bin with so few places left is done.
NEARLY_FULL = 4

# Words of these characters have no contraction, mark or letter whose normal form depends on its neighbours.
_PLAIN = "^[!-~À-ÖØ-öø-įĲ-ňŊ-ž]+$"
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\sa-z0-9ß-öø-ž]+|\n")


@lru_cache(4)
def _tokenizer(path: str):
    """The tokenizer, a light copy that takes normalised parts between blanks, and which ids end a part."""
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_file(path)
    light = Tokenizer(whole.model)  # one model in memory; no normalizer, and no special tokens
    light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    vocabulary = whole.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
    return whole, light, ends


#: By vocabulary: the ids of words seen lately, and of those before them.
_seen: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}


def word_ids(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of each word, one after the other, and how many each has. Equal to tokenizing the words by themselves.

    Common words come back in every slice, so their ids are remembered.
    """
    young, old = _seen.get(path, ({}, {}))
    names = words.to_pylist()
    found = [young.get(w) for w in names]
    missing = [k for k, ids in enumerate(found) if ids is None]
    for k in missing:
        found[k] = old.get(names[k])
    new = [k for k in missing if found[k] is None]
    ids, counts = _encoded(words.take(pa.array(new, pa.int64())), path)
    raw, edge = ids.tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
    for k, a, b in zip(new, edge, edge[1:], strict=False):
        found[k] = raw[a:b]
    young.update((names[k], found[k]) for k in missing)
    _seen[path] = (young, old) if len(young) <= MOST_WORDS else ({}, young)
    return np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4


def _encoded(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    whole, light, ends = _tokenizer(path)
    plain = pc.and_not(pc.match_substring_regex(words, _PLAIN), pc.match_substring(words, "<|"))
    is_fast = plain.to_numpy(zero_copy_only=False)
    # All plain words are cut into parts at once, a line feed after each.
    found = _PARTS.findall("".join(w + "\n" for w in words.filter(plain).to_pylist()).lower())
    word_ends = np.array([k for k, part in enumerate(found) if part == "\n"], np.int64)
    parts = [part for part in found if part != "\n"]
    encoded = [np.array(e.ids, np.uint32) for e in light.encode_batch_fast([" ".join(parts[i : i + 256]) for i in range(0, len(parts), 256)], add_special_tokens=False)]
    ids = np.concatenate(encoded) if encoded else np.zeros(0, np.uint32)
    after = np.concatenate([[0], np.flatnonzero(ends[ids]) + 1])  # where each part's ids end
    counts = np.zeros(len(words), np.int64)
    counts[is_fast] = np.diff(after[np.concatenate([[0], word_ends - np.arange(len(word_ends))])])
    slow = np.flatnonzero(~is_fast)
    rest = [np.array(e.ids, np.uint32) for e in whole.encode_batch_fast(words.take(pa.array(slow)).to_pylist(), add_special_tokens=False)]
    counts[slow] = [len(r) for r in rest]
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(starts[-1], np.uint32)
    out[np.repeat(is_fast, counts)] = ids
    for k, r in zip(slow.tolist(), rest, strict=True):
        out[starts[k] : starts[k + 1]] = r
    return out, counts


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, each text with END, and the number that each text has.

    The tokenizer never joins across ASCII white space, so it runs once for each distinct word.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = pc.list_flatten(split)
    some = pc.not_equal(flat, "")
    owner = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)[some.to_numpy(zero_copy_only=False)]
    coded = flat.filter(some).dictionary_encode()
    ids, counts = word_ids(coded.dictionary, path)
    # END is a word more, behind the last of each text.
    ids, counts = np.append(ids, np.uint32(END)), np.append(counts, 1)
    n_words = np.bincount(owner, minlength=len(texts))
    which = np.insert(coded.indices.to_numpy(zero_copy_only=False), np.cumsum(n_words), len(counts) - 1)
    size = counts[which]
    upto = np.cumsum(size)
    last = np.cumsum(n_words + 1) - 1
    total = np.diff(upto[last], prepend=0)
    source = np.cumsum(counts) - counts
    # Each id's source by its word's offset; the narrow type halves what a slice takes.
    shift = (source[which] - (upto - size)).astype(np.int32)
    return ids[np.repeat(shift, size) + np.arange(int(size.sum()), dtype=np.int32)], total


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece. A null text is empty and has the end token only."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch.column(1), 3_000_000):
                ids, total = token_ids(part, path)
                n = -(-total // length)
                owner = np.repeat(np.arange(len(part)), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * length
                size = np.minimum(total[owner] - start, length)
                raw = memoryview(ids.astype("<u4").tobytes())
                begin = (np.cumsum(total) - total)[owner] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(begin.tolist(), size.tolist(), strict=True)]
                names = batch.column(0).slice(done, len(part)).take(pa.array(owner))
                done += len(part)
                yield pa.RecordBatch.from_arrays([names, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """The bin and offset of each item, taken in the given order, and the fill of each bin.

    Open bins are kept by the room they have; bit r of ``rooms`` says whether one has room r.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fills, bins, offsets = 0, [], [], []
    for n in lengths:
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            k = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            k, room = len(fills), capacity
            fills.append(0)
        bins.append(k)
        offsets.append(fills[k])
        fills[k] += n
        if room > n:
            open_bins[room - n].append(k)
            rooms |= 1 << (room - n)
    return bins, offsets, fills


def _round(items: DataFrame, level: int, partitions: int, capacity: int) -> DataFrame:
    """(item, bin, shift, fill) of ``items`` (item, length): one best-fit packing in each partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not len(rows):
            return
        item, length = rows.column("item").to_numpy(), rows.column("length").to_numpy()
        order = np.lexsort((item, -length))
        bins, shifts, fills = best_fit(length[order].tolist(), capacity)
        base = (level << 56) | (partition_id() << 32)
        yield pa.RecordBatch.from_arrays([pa.array(item[order]), pa.array(np.array(bins, np.int64) + base), pa.array(shifts, pa.int64()), pa.array(np.array(fills, np.int64)[bins])], ["item", "bin", "shift", "fill"])

    return items.select("item", "length").repartition(partitions, "item").mapInArrow(pack, "item bigint, bin bigint, shift bigint, fill bigint")


def packed(found: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """``found`` (with length) plus sequence_id and offset. ``found`` must give equal rows each time it is read.

    Repeated rows are items of their own. An empty table gives an empty one.
    """
    numbered = written(found.withColumn("item", F.monotonically_increasing_id()), "pieces")
    items = numbered.where(F.col("length") < capacity).select("item", "length")
    count = items.count()
    partitions, level = max(1, -(-count // ITEMS)), 1
    rounds = []
    while count:
        done = written(_round(items, level, partitions, capacity), f"round{level}")
        rounds.append(done)
        made = done.groupBy("bin").agg(F.max("fill").alias("length")).withColumnRenamed("bin", "item")
        under = made.where(F.col("length") < capacity - NEARLY_FULL)
        left = under.count()  # bins that could still take something
        if partitions == 1:
            break
        if left == count:  # no bin was saved
            under = made.where(2 * F.col("length") <= capacity)
            left = under.count()
        partitions = max(1, -(-left // ITEMS), -(-partitions // FAN_IN))
        items, count, level = under, left, level + 1
    out = numbered.withColumn("bin", F.col("item")).withColumn("offset", F.lit(0).cast("long")).drop("item")
    for done in rounds:
        step = done.select(F.col("item").alias("bin"), F.col("bin").alias("outer_bin"), "shift")
        out = out.join(step, "bin", "left").withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0))).withColumn("bin", F.coalesce("outer_bin", "bin")).drop("outer_bin", "shift")
    return out.withColumnRenamed("bin", "sequence_id")


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``.

    A null text is empty: its document is the end token alone. Texts are taken whole, however long; only those beyond ``length`` tokens
    are cut. Repeated rows, also of one id, are documents of their own, each with its pieces; pieces of equal length tie and go where
    their partition's order puts them. Other columns have no effect. An empty table gives no pieces.
    """
    return packed(pieces(docs, path or tokenizer_path(), doc_id, text, length), length).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_hierarchical_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op4_hierarchical_best_fit_packing": op4_hierarchical_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
