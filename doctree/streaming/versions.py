"""New versions as a stream: ingest what lands, publish whole versions that pass the gate, diff them, and serve the last good one.

Documents land under a commit: ``commit_id``, and ``commit_docs``, the number of documents that it has. A commit may land in several
files and batches, or again; it is complete when all its documents are there, and only then is it looked at. It is then judged as a
whole and settled: published, quarantined, or superseded where its version already has a later commit. What lands of a settled commit
later is not even kept. So a version is what its last complete commit has, with what that one moved and without what it removed.

Sources that know no commits leave these columns out (or null). Then a version is all that has landed of it, judged again whenever
more lands; of what a uuid or a number stands for, the last batch counts, so moves are seen but removals are not.

Below ``target``, tables grow by batch, and nothing is overwritten but by a rerun of its own batch:

* ``landed`` has the documents, dealt by commit into ``BUCKETS`` folders for each batch, and ``landings`` says which commit landed when:
  a batch reads the folders of the commits that it touches, not the history,
* ``judged`` and ``commits`` have the verdict on each complete commit,
* ``published`` has the good versions of each batch, whole, and ``digests`` what a comparison needs of each of their documents,
* ``diffs`` has what each published version changed, and ``pairs`` against which one; a version whose base is replaced is compared again, and
* ``manifest`` says which versions a batch has published. It is written last, so a version shows all at once or not at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from doctree import schema
from doctree.functions import text
from doctree.operators import diff, tree

KEYS = list(schema.KEYS)
COMMIT = [*KEYS, "commit_id"]
#: A version with fewer documents or characters is not published.
LEAST_DOCS = 1
LEAST_CHARS = 100
#: Folders of a batch that commits, or the corpora of digests, are dealt into; only those that have rows exist.
BUCKETS = 1024
_COMMITS = "corpus_id string, version_id string, commit_id string, committed_at timestamp, status string, batch_id int"
_LANDINGS = "corpus_id string, version_id string, commit_id string, bucket int, batch_id int"
_MANIFEST = "corpus_id string, version_id string, commit_id string, committed_at timestamp, batch_id int"
_DIFFS = "corpus_id string, version_id string, uuid string, base_doc_no string, base_name string, head_doc_no string, head_name string, change string, status string, base_id string, batch_id int"
_PAIRS = "corpus_id string, version_id string, base_id string, base_batch int, head_batch int, batch_id int"
_DIGESTS = "corpus_id string, version_id string, uuid string, doc_no string, name string, body binary, links binary, bucket int, batch_id int"


def ingest(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """Documents of landed versions (with committed_at), each file once. Late versions come through as any others."""
    return spark.readStream.schema(row_schema).parquet(path)


def gate(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The versions with their documents, those that are in the tree, characters, and whether they are good.

    A good version is not too small, and its tree has all its documents: none stands where no collection takes it.
    """
    counts = docs.groupBy(*KEYS).agg(F.count("*").alias("n_docs"), F.sum(F.length(F.coalesce("body", F.lit("")))).alias("n_chars"), F.max("committed_at").alias("committed_at"))
    out = tree.edges(docs).where("collection is null").groupBy(*KEYS).agg(F.count("*").alias("n_out"))
    found = counts.join(out, KEYS, "left").withColumn("n_tree", F.col("n_docs") - F.coalesce("n_out", F.lit(0))).drop("n_out")
    return found.withColumn("good", (F.col("n_docs") >= least_docs) & (F.col("n_chars") >= least_chars) & (F.col("n_docs") == F.col("n_tree")))


def count_atoms(spark: SparkSession, path: str) -> int:
    """The number of atom files below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "document.md").load(path).count()


def _put(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _table(spark: SparkSession, path: str, row_schema: str | StructType) -> DataFrame:
    """What a table has, which is nothing before it is first written."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], row_schema)
    return spark.read.schema(row_schema).parquet(path)


def _kept(rows: DataFrame, path: str, batch_id: int) -> DataFrame:
    """``rows`` written as a batch's partition of a table, and read again."""
    marked = rows.withColumn("batch_id", F.lit(batch_id))
    _put(marked, path, "batch_id")
    return rows.sparkSession.read.schema(marked.schema).parquet(path).where(F.col("batch_id") == batch_id).drop("batch_id")


def _folders(spark: SparkSession, path: str, places: DataFrame, row_schema: str | StructType) -> DataFrame:
    """The rows in those folders (bucket, batch_id) of a table that ``places`` names: only these are listed and read."""
    found = sorted((r.bucket, r.batch_id) for r in places.select("bucket", "batch_id").distinct().collect())
    if not found:
        return spark.createDataFrame([], row_schema)
    return spark.read.schema(row_schema).option("basePath", path).parquet(*(f"{path}/bucket={b}/batch_id={n}" for b, n in found))


def _bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")


def _standing(rows: DataFrame) -> DataFrame:
    """(COMMIT, batch_id, row) of the landed ``rows`` that count: the last batch's of each uuid and of each number, equal ones once.

    Different forms of a document in one batch stay beside each other. Bodies are not looked at, only their digests.
    """
    keys = rows.select(*COMMIT, F.when(F.col("uuid") != "", F.col("uuid")).alias("uuid"), "doc_no", "digest", "batch_id", "row")
    once = keys.groupBy(*COMMIT, "uuid", "doc_no", "digest", "batch_id").agg(F.min("row").alias("row"))
    same = lambda *c: [F.col(f"o.{k}").eqNullSafe(F.col(f"l.{k}")) for k in (*COMMIT, *c)]
    for key in ("uuid", "doc_no"):
        last = once.where(F.col(key).isNotNull()).groupBy(*COMMIT, key).agg(F.max("batch_id").alias("last"))
        once = once.alias("o").join(last.alias("l"), [*same(key), F.col("o.batch_id") < F.col("l.last")], "left_anti")
    return once.select(*COMMIT, "batch_id", "row")


def publisher(target: str, base_version: str | None = None, **limits: int) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: judge the commits that a batch completes, publish the good ones below ``target``, and diff them.

    A version that fails goes to ``quarantine`` and keeps what was published of it before. Diffs compare with ``base_version``, or
    with the version of the corpus that was committed before. A batch that runs again after a failure writes the same partitions again.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        for name, kind in (("commit_id", "string"), ("commit_docs", "long")):
            if name not in batch.columns:
                batch = batch.withColumn(name, F.lit(None).cast(kind))
        mark = F.lit(batch_id).alias("batch_id")
        settled = _table(spark, f"{target}/commits", _COMMITS).where((F.col("batch_id") < batch_id) & F.col("commit_id").isNotNull())
        fresh = batch.join(settled.select(*COMMIT).distinct(), COMMIT, "left_anti")
        digest = F.xxhash64(*(c for c in batch.columns if c not in ("committed_at",))).alias("digest")
        placed = fresh.select("*", digest, _bucket(*COMMIT)).repartition("bucket").sortWithinPartitions("bucket", *COMMIT)
        _put(placed.select("*", F.monotonically_increasing_id().alias("row"), mark), f"{target}/landed", "bucket", "batch_id")
        whole_schema = placed.select(*batch.columns, "digest", F.lit(0).cast("long").alias("row"), "bucket", mark).schema
        _put(fresh.select(*COMMIT, _bucket(*COMMIT), mark).distinct(), f"{target}/landings", "batch_id")
        landings = _table(spark, f"{target}/landings", _LANDINGS).where(F.col("batch_id") <= batch_id)
        touched = landings.where(F.col("batch_id") == batch_id).select(*COMMIT)
        if touched.isEmpty():
            return
        null_safe = lambda a, b, *more: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in (*COMMIT, *more)]
        places = landings.alias("a").join(touched.alias("t"), null_safe("a", "t"), "left_semi")
        every = _folders(spark, f"{target}/landed", places, whole_schema).alias("a").join(touched.alias("t"), null_safe("a", "t"), "left_semi")
        standing = _standing(every)
        wanted = every.groupBy(*COMMIT).agg(F.max("commit_docs").alias("commit_docs"), F.max("committed_at").alias("committed_at"))
        counts = standing.groupBy(*COMMIT).agg(F.count("*").alias("n"))
        done = counts.alias("a").join(wanted.alias("w"), null_safe("a", "w")).where("commit_docs is null or n = commit_docs").select(*(F.col(f"a.{c}") for c in COMMIT), "committed_at")
        done = _kept(done, f"{target}/complete", batch_id)
        if done.isEmpty():
            return
        # Of the commits of a version the last counts, among those of this batch and what is published.
        known = _table(spark, f"{target}/manifest", _MANIFEST).where((F.col("batch_id") < batch_id) & F.col("commit_id").isNotNull())
        at = F.struct("committed_at", "commit_id")
        last = done.groupBy(*KEYS).agg(F.max(at).alias("last")).join(known.groupBy(*KEYS).agg(F.max(at).alias("known")), KEYS, "left")
        last = last.where(F.col("known").isNull() | (F.col("last") > F.col("known"))).select(*KEYS, "last.commit_id")
        rows = standing.alias("s").join(last.alias("a"), null_safe("s", "a"), "left_semi")
        whole = every.alias("e").join(rows.alias("s"), null_safe("e", "s", "batch_id", "row"), "left_semi").drop("bucket", "batch_id", "row", "digest")
        whole = _kept(whole, f"{target}/candidates", batch_id)
        judged = _kept(gate(whole, **limits).join(last, KEYS), f"{target}/judged", batch_id)
        good = judged.where("good").select(*KEYS)
        out = _kept(whole.join(good, KEYS, "left_semi"), f"{target}/published", batch_id)
        _kept(whole.join(good, KEYS, "left_anti"), f"{target}/quarantine", batch_id)
        told = done.alias("a").join(judged.alias("j"), null_safe("a", "j"), "left")
        status = F.when(F.col("j.good").isNull(), "superseded").when(F.col("j.good"), "published").otherwise("quarantined")
        _put(told.select(*(F.col(f"a.{c}") for c in COMMIT), F.col("a.committed_at"), status.alias("status"), mark), f"{target}/commits", "batch_id")
        _put(digests(out).select("*", _bucket("corpus_id"), mark), f"{target}/digests", "bucket", "batch_id")
        manifest = judged.where("good").drop("good").select("*", mark)
        _diff(spark, target, manifest, batch_id, base_version)
        _put(manifest, f"{target}/manifest", "batch_id")

    return publish


def publish_stream(docs: DataFrame, target: str, checkpoint: str, base_version: str | None = None, **limits: int) -> StreamingQuery:
    """Run what has landed through the gate, then stop."""
    return docs.writeStream.foreachBatch(publisher(target, base_version, **limits)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def published(spark: SparkSession, target: str) -> DataFrame:
    """The documents of all published versions, each as the last batch that published it has it."""
    manifest = _table(spark, f"{target}/manifest", _MANIFEST)
    last = manifest.groupBy(*KEYS).agg(F.max("batch_id").alias("batch_id"))
    if manifest.isEmpty():  # what has landed has a schema even while nothing is published
        rows = spark.createDataFrame([], spark.read.parquet(f"{target}/landed").drop("bucket", "row", "digest").schema)
    else:
        rows = spark.read.parquet(f"{target}/published")
    return rows.join(last, [*KEYS, "batch_id"], "left_semi").drop("batch_id", "commit_id", "commit_docs")


def latest_good(found: DataFrame) -> DataFrame:
    """Each corpus' last published version, by its commit."""
    last = found.groupBy("corpus_id").agg(F.max(F.struct("committed_at", "version_id")).alias("v"))
    return last.select("corpus_id", "v.version_id")


def digests(docs: DataFrame) -> DataFrame:
    """What a comparison needs of each document: uuid, number, name, and digests of its body (body), also without numbers in links (links)."""
    found = body_digests()
    return docs.select(*KEYS, F.when(F.col("uuid") != "", F.col("uuid")).alias("uuid"), "doc_no", "name", *(c.alias(n) for n, c in found.items()))


def body_digests() -> dict[str, Column]:
    """The digests of a body that :func:`digests` has, by name."""
    own = lambda c: F.unhex(F.md5(c))
    return {"body": own(F.col("body")), "links": own(text.normalized_body("body"))}


def compared(heads: DataFrame, bases: DataFrame) -> DataFrame:
    """J9, D1 to D3 on digests: ``heads`` and ``bases`` as :func:`digests` has them, both keyed by the head's version.

    Equal to :func:`diff.classify` of the documents, but bodies are neither read nor told: uuid, number and name of both sides, change, status.
    """
    there, gone = compared_parts(heads, bases)
    return there.unionByName(gone)


def compared_parts(heads: DataFrame, bases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`compared` of what heads have, and of what they have not: two joins that leave rows where they are, as a full one would not."""
    side = lambda d, n: d.select(*KEYS, "uuid", *(F.col(c).alias(f"{n}_{c}") for c in ("doc_no", "name", "body", "links")))
    base, head = side(bases, "base").where("uuid is not null"), side(heads, "head")
    same, alike = (F.col(f"base_{c}").eqNullSafe(F.col(f"head_{c}")) for c in ("body", "links"))
    there = head.join(base, [*KEYS, "uuid"], "left").withColumn("change", diff.change_of(same, alike))
    gone = base.join(head.select(*KEYS, "uuid"), [*KEYS, "uuid"], "left_anti").withColumns({"head_doc_no": F.lit(None).cast("string"), "head_name": F.lit(None).cast("string"), "change": F.lit("Deleted")})
    columns = [*KEYS, "uuid", "base_doc_no", "base_name", "head_doc_no", "head_name", "change"]
    return tuple(d.select(*columns).withColumn("status", F.expr(diff.STATUS)) for d in (there, gone))


def _diff(spark: SparkSession, target: str, manifest: DataFrame, batch_id: int, base_version: str | None) -> None:
    """The changes of the versions that this batch publishes (``manifest``), and of those whose base it publishes, one partition for each batch;
    a corpus' first version has none."""
    before = _table(spark, f"{target}/manifest", _MANIFEST).where(F.col("batch_id") < batch_id)
    one = lambda d: d.select(*KEYS, "committed_at", "batch_id")
    new = one(manifest).withColumn("new", F.lit(True))
    rest = one(before).join(new, KEYS, "left_anti").groupBy(*KEYS).agg(F.max(F.struct("batch_id", "committed_at")).alias("m")).select(*KEYS, "m.committed_at", "m.batch_id", F.lit(False).alias("new"))
    every = new.unionByName(rest.join(new.select("corpus_id").distinct(), "corpus_id", "left_semi"))
    if base_version is None:
        order = Window.partitionBy("corpus_id").orderBy("committed_at", "version_id")
        pairs = every.withColumns({"base_id": F.lag("version_id").over(order), "base_batch": F.lag("batch_id").over(order)})
    else:
        base = every.where(F.col("version_id") == base_version).select("corpus_id", F.col("version_id").alias("base_id"), F.col("batch_id").alias("base_batch"))
        pairs = every.join(base, "corpus_id").where("version_id <> base_id")
    # A version is compared again when its base is replaced or another version has become it.
    last = _paired(spark, target, batch_id - 1).select(*KEYS, F.col("base_id").alias("old_id"), F.col("base_batch").alias("old_batch"))
    stale = ~(F.col("base_id").eqNullSafe(F.col("old_id")) & F.col("base_batch").eqNullSafe(F.col("old_batch")))
    pairs = pairs.join(last, KEYS, "left").where((F.col("new") & F.col("base_id").isNotNull()) | stale)
    pairs = _kept(pairs.select(*KEYS, "base_id", "base_batch", F.col("batch_id").alias("head_batch")), f"{target}/pairs", batch_id).where("base_id is not null")
    if pairs.isEmpty():
        return
    bucket = _bucket("corpus_id")
    news = pairs.select(*KEYS, F.col("head_batch").alias("batch_id"))
    heads = _folders(spark, f"{target}/digests", news.select(bucket, "batch_id"), _DIGESTS).join(news, [*KEYS, "batch_id"], "left_semi")
    olds = _folders(spark, f"{target}/digests", pairs.select(bucket, F.col("base_batch").alias("batch_id")), _DIGESTS)
    named = pairs.select("corpus_id", F.col("base_id").alias("version_id"), F.col("base_batch").alias("batch_id"), F.col("version_id").alias("head_id"))
    bases = olds.join(named, [*KEYS, "batch_id"]).withColumn("version_id", F.col("head_id")).drop("head_id")
    found = compared(heads, bases).join(pairs.select(*KEYS, "base_id"), KEYS)
    _put(found.withColumn("batch_id", F.lit(batch_id)), f"{target}/diffs", "batch_id")


def _paired(spark: SparkSession, target: str, batch_id: int) -> DataFrame:
    """The pairs that were compared last, up to a batch: each version's base (base_id, null if it has none any more) and the batches of both. Unfinished batches do not count."""
    whole = _table(spark, f"{target}/manifest", _MANIFEST).where(F.col("batch_id") <= batch_id).select("batch_id").distinct()
    found = _table(spark, f"{target}/pairs", _PAIRS).join(whole, "batch_id", "left_semi")
    last = found.groupBy(*KEYS).agg(F.max("batch_id").alias("batch_id"))
    return found.join(last, [*KEYS, "batch_id"])


def diffs(spark: SparkSession, target: str) -> DataFrame:
    """What each published version changed against its base (base_id), as both were published last."""
    last = _table(spark, f"{target}/manifest", _MANIFEST).agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]
    pairs = _paired(spark, target, last).select(*KEYS, "batch_id")
    return _table(spark, f"{target}/diffs", _DIFFS).join(pairs, [*KEYS, "batch_id"], "left_semi").drop("batch_id")


def diff_publisher(base: DataFrame, target: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over heads that land whole: the changes of each against ``base``, one partition for each batch.

    All versions of a batch, however many, are compared in one job: each version of a corpus is a corpus of its own to
    the comparison. Heads that land in parts are compared by :func:`publisher`, once they are complete.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        one = F.struct("corpus_id", "version_id").alias("corpus_id")
        head = batch.select(one, *(c for c in batch.columns if c not in KEYS))
        heads = batch.select("corpus_id", "version_id").distinct()
        mine = base.drop("version_id").join(heads, "corpus_id")
        mine = mine.select(one, *(c for c in base.columns if c not in KEYS))
        found = diff.classify(mine, head).withColumns({"version_id": F.col("corpus_id.version_id"), "corpus_id": F.col("corpus_id.corpus_id"), "batch_id": F.lit(batch_id)})
        _put(found, target, "batch_id")

    return write
