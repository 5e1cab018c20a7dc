"""Sharding by sampled splitters: shards of near equal bytes.

Rows are ordered by a key: the hash of the text, so that equal texts stand together. A sample of keys, in
which a row's chance goes with its size, gives quantile boundaries, and rows are range-partitioned between
them. Ranges that are overfull all the same are subdivided at their heavy keys: such a text's copies become
a range of their own, and copies that together exceed a share of a shard are dealt over several ranges
by row, whatever their ids. Ranges, whose sizes are then known exactly, are put into shards: the largest first,
always into the emptiest shard.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doctree.llm.common import table, written

SHARDS = 16
#: Ranges a shard is made of on average, from few rows to many: a range has a million rows until there are MOST_RANGES. With the
#: sampled keys of a range, these bound what the driver holds: 8 MB of keys for each 32,768 ranges.
RANGES, MOST_RANGES = 64, 2048
RANGE_ROWS = 1_000_000
SAMPLES = 32
#: Copies of one text stay in one shard up to this share of a shard's bytes.
GROUP_SHARE = 0.5


def _between(key: Column, splitters: np.ndarray) -> Column:
    def place(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(splitters, keys.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    return F.arrow_udf(place, "int")(key)


def _splitters(rows: DataFrame, total: int, ranges: int) -> np.ndarray:
    """Quantile boundaries of a sample of about ranges * SAMPLES keys, drawn by size. Hashes of rows decide, so reruns of the
    table draw alike, and a row that is repeated is drawn in proportion."""
    chance = F.lit(float(ranges * SAMPLES)) * F.col("size") / F.lit(float(max(total, 1)))
    luck = F.pmod(F.xxhash64("row", "key", F.lit("sample")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    # What a row has above chance 1 is its weight; below, all drawn rows weigh alike.
    drawn = rows.where(luck < chance).select("key", F.greatest(chance, F.lit(1.0)).alias("weight")).toArrow()
    if not len(drawn):
        return np.zeros(0, np.int64)
    keys, weight = (drawn.column(c).to_numpy() for c in ("key", "weight"))
    order = np.argsort(keys, kind="stable")
    keys, upto = keys[order], np.cumsum(weight[order])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)
    return np.unique(keys[at])


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs``.

    A row's size is its text's UTF-8 bytes plus 1; a null text has size 1 and the checksum of an empty one.
    Slots are gapless from 0 in each shard, in order of key, id and checksum; repeated rows get slots of their own.
    An empty table gives an empty one.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows, "rows")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = shards * min(MOST_RANGES, max(RANGES, n // (shards * RANGE_ROWS)))
    ranged = written(rows.withColumn("range", _between(F.col("key"), _splitters(rows, total, ranges))), "ranged")
    target = total / ranges
    # A key of over a quarter of a range's target is heavy; fewer than 4 * ranges keys can be.
    sizes = ranged.groupBy("range").agg(F.sum("size").alias("bytes"))
    overfull = sizes.where(F.col("bytes") > 2 * target).select("range")
    heavy = ranged.join(F.broadcast(overfull), "range", "left_semi").groupBy("range", "key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > target / 4)
    pieces = F.ceil(F.col("bytes") / F.lit(max(GROUP_SHARE * total / shards, 1.0)))
    parts = F.when(F.col("bytes") > F.lit(GROUP_SHARE * total / shards), F.ceil(pieces * 8)).otherwise(F.lit(1)).cast("int")
    heavy = heavy.select("key", parts.alias("parts"))
    split = ranged.join(F.broadcast(heavy), "key", "left")
    part = F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts").cast("long")))
    # A heavy key is a range of its own, numbered by the key; the others share the range of their place.
    split = split.select("doc_id", "size", "text_crc32", "key", "range", F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(F.col("key")).alias("own"), part.alias("part"))
    split = written(split, "split")
    found = split.groupBy("range", "own", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    placed = _assigned([(r.bytes, r.n, r.range, r.own, r.part) for r in found], shards)
    schema = "range int, own bigint, part bigint, shard int, base bigint"
    places = docs.sparkSession.createDataFrame(placed, schema)
    order = Window.partitionBy("range", "own", "part").orderBy("key", F.col("doc_id").asc_nulls_first(), "text_crc32")
    out = split.withColumn("n", F.row_number().over(order) - 1).join(F.broadcast(places), ["range", "own", "part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("n")).alias("slot"))


def _assigned(found: list[tuple[int, int, int, int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """The shard of each range and its rows' first slot there: largest ranges first, into the emptiest shard."""
    load = [(0, s) for s in range(shards)]
    in_shard: dict[int, list[tuple[int, int, int, int]]] = {s: [] for s in range(shards)}
    for size, n, place, own, part in sorted(found, key=lambda r: (-r[0], r[2:])):
        least, s = heapq.heappop(load)
        in_shard[s].append((place, own, part, n))
        heapq.heappush(load, (least + size, s))
    out = []
    for s, members in in_shard.items():
        base = 0
        for place, own, part, n in sorted(members):
            out.append((place, own, part, s, base))
            base += n
    return out


def op10_sampled_splitter_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_sampled_splitter_sharding": op10_sampled_splitter_sharding}
ORACLE_SQL: dict[str, str] = {}
