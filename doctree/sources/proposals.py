"""Proposal records (pull requests) and the choice of the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REPO = "struct<name:string,owner:struct<login:string>>"
SCHEMA = f"number int, title string, body string, state string, merged_at timestamp, updated_at timestamp, base struct<ref:string,repo:{_REPO}>, head struct<ref:string,sha:string,repo:{_REPO}>"
BRANCH = "proposal/"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records with a declared schema, one JSON value each (or an array of them) in a file."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def current(found: DataFrame) -> DataFrame:
    """For each base repository the open proposal updated last, else the one merged last. Ties go to the higher number.

    Proposals come from branches of a repository that still exists; closed ones that were not merged don't count.
    """
    some = found.where(F.startswith("head.ref", F.lit(BRANCH)) & F.col("head.repo").isNotNull())
    is_open = F.col("state") == "open"
    at = F.when(is_open, F.col("updated_at")).otherwise(F.col("merged_at"))
    ranked = some.withColumn("at", at).where(F.col("at").isNotNull())
    repo = F.concat_ws("/", "base.repo.owner.login", "base.repo.name")
    # A maximum needs no sort of a repository's proposals, however many there are.
    return ranked.groupBy(repo.alias("repo")).agg(F.max(F.struct(is_open.alias("is_open"), "at", "number", "title", F.col("head.ref").alias("ref"))).alias("p")).select("repo", "p.number", "p.title", "p.ref", "p.is_open")
