"""What jobs on several machines need: the package on every executor, and tables in a folder that all share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
PLAN_STATS = "spark.sql.cbo.planStats.enabled"

_shipped: set[str] = set()
_written: list[tuple[SparkSession, str, str | None]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing (tests on one machine) a temporary folder takes its place; on a
    cluster without the setting this raises, as no folder is known to be shared there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="doctree-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` computed once, as Parquet in the shared folder, and read again: this cuts its lineage.

    ``options`` are the writer's, such as compression. The table lives until the :func:`tables` block that it was written in ends, or until the process does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/doctree/{uuid.uuid4().hex}/{name}"
    df.write.options(**options).parquet(path)
    _written.append((spark, path, None))
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, n: int, *by: str, **options: str) -> DataFrame:
    """As :func:`written`, as a table of ``n`` buckets: what is joined, grouped or ordered by columns that ``by`` is among is not shuffled again.

    Its rows are counted, as files are a small part of what their rows take in memory: judged by files, large tables would pass the driver on their way to all tasks.
    """
    spark = df.sparkSession
    own = uuid.uuid4().hex
    path, title = f"{shared_dir(spark)}/doctree/{own}/{name}", f"doctree_{own}"
    df.repartition(n, *by).write.options(**options).bucketBy(n, *by).option("path", path).saveAsTable(title, format="parquet")
    _written.append((spark, path, title))
    spark.sql(f"ANALYZE TABLE {title} COMPUTE STATISTICS")
    return spark.table(title)


@contextlib.contextmanager
def tables() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Owns the tables written inside: they are deleted at the end, so results must be saved by then.

    A long-running driver runs each of its jobs in such a block, and the shared folder does not fill up. The block's value
    writes as :func:`written` does, but for the block around this one: such tables stay.
    """
    mark = len(_written)

    def keep(df: DataFrame, name: str) -> DataFrame:
        nonlocal mark
        found = written(df, name)
        _written.insert(mark, _written.pop())
        mark += 1
        return found

    try:
        yield keep
    finally:
        drop_written(mark)


@atexit.register
def drop_written(mark: int = 0) -> None:
    """Delete the tables that :func:`written` left since ``mark``; frames that read them are of no use after that."""
    while len(_written) > mark:
        spark, path, title = _written.pop()
        if spark.sparkContext._jsc is None:
            continue
        if title:
            spark.sql(f"DROP TABLE IF EXISTS {title}")
        target = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    # Texts may be long: smaller Arrow batches bound what a batch takes in the JVM and in Python.
    if spark.conf.get(ARROW_ROWS) == "10000":  # Spark's default
        spark.conf.set(ARROW_ROWS, "2000")
    # Longer methods are never compiled to machine code, so Spark had better not fuse so many steps.
    spark.conf.set(HUGE_METHOD, "8000")
    # Tables dealt by corpus meet as they are, whatever else their joins ask for.
    spark.conf.set(CO_PARTITION, "false")
    # They are as large as their rows, not as their files.
    spark.conf.set(PLAN_STATS, "true")
    root = Path(__file__).parent
    target = os.path.join(tempfile.mkdtemp(prefix="doctree-"), "doctree_src.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
