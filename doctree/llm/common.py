"""Helpers that the training-data operators share: the shared folder, row keys, text slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree.session import shared_dir, written  # noqa: F401

#: ASCII white space, as the contracts' word pattern ``[^\x20\x09-\x0D]+`` has it.
SPACES = "[\\x20\\x09-\\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two longs that tell rows apart by id and text. Rows alike in both are alike in every result."""
    return [F.xxhash64(F.col(doc_id)).alias("k_id"), F.xxhash64(F.col(text)).alias("k_text")]


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text, modulo 3, is 1. A row without an id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def slices(texts: pa.Array, most: int = 1_000_000) -> Iterator[pa.Array]:
    """Runs of ``texts`` of about ``most`` bytes at most (one longer text is a run of its own)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(size):
        if total + n > most and i > start:
            yield texts.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(size):
        yield texts.slice(start)
    pa.default_memory_pool().release_unused()


#: Rows that one key may have in one task in any case.
LEAST_HOT = 100_000


def among(rows: DataFrame, found: DataFrame, keys: list[str], total: int, times: str = "n", most_hot: int = 100_000) -> DataFrame:
    """The ``rows`` whose ``keys`` are in ``found`` (keys, once each, and ``times``: how many rows have them).

    Keys that have over ``total / most_hot`` rows are dealt over several tasks, by a salt. There are ``most_hot`` of them
    at most, so their list may be sent to all tasks.
    """
    limit = max(LEAST_HOT, total // most_hot)
    salts = F.ceil(F.col(times) / F.lit(limit)).cast("int")
    hot = found.where(F.col(times) > limit).select(*keys, salts.alias("doctree_salts"))
    if hot.isEmpty():
        return rows.join(found.select(*keys), keys, "left_semi")
    salt = F.pmod(F.xxhash64(*rows.columns), F.coalesce("doctree_salts", F.lit(1)).cast("long")).cast("int")
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("doctree_salt", salt)
    other = found.select(*keys, F.explode(F.sequence(F.lit(0), salts - 1)).alias("doctree_salt"))
    return salted.join(other, [*keys, "doctree_salt"], "left_semi").select(*rows.columns)


#: CRC-32 in DuckDB, which has no function for it: a common table with the values of all bytes, and an expression over it.
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crcs)"""


def crc32_sql(text: str) -> str:
    """The CRC-32 of an ASCII ``text``, in a query that also reads crc_table."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])), 4294967295)"


def partition_id() -> int:
    return TaskContext.get().partitionId()
