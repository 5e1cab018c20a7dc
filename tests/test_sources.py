"""Files, archives, texts, JSON and streams."""

import io
import os
import subprocess
import sys
import tarfile

import pytest
from pyspark.sql import functions as F

from doctree.operators import diff, order, quality, search, tree
from doctree.sources import atoms, monolith, proposals, tree_json
from doctree.streaming import versions

U = [f"{i:08d}-0000-0000-0000-000000000000" for i in range(12)]
TEXT = f"""stray words
# A.0 - Preamble [Scope]  <!-- UUID: {U[0]} -->

First "body".

## A.0.1 - Rules [Article]  <!-- UUID: {U[1]} -->

### A.0.1.1 - Definitions: all [Section]  <!-- UUID:  -->

# comment in a body
 indented

#### A.0.1.1.0.3.1 - Note [Annotation]  <!-- UUID: {U[3]} -->

See [A.0.1 - Rules]({U[1]}).

#### NR-1 - Later [Needed Research]  <!-- UUID: {U[4]} -->

**Content**:

Some research.
"""


def raw(spark, text=TEXT):
    return spark.createDataFrame([("c", "v", text)], "corpus_id string, version_id string, text string")


def test_reading_a_text(spark):
    for body in (TEXT, TEXT.replace("\n", "\r\n")):
        rows = monolith.read(raw(spark, body)).orderBy("pos").collect()
        assert [(r.doc_no, r.level, r.doc_type, r.uuid) for r in rows] == [("A.0", 1, "Scope", U[0]), ("A.0.1", 2, "Article", U[1]), ("A.0.1.1", 3, "Section", None), ("A.0.1.1.0.3.1", 4, "Annotation", U[3]), ("NR-1", 4, "Needed Research", U[4])]
        assert rows[0].body == 'First "body".' and rows[1].body == "" and rows[2].body == "# comment in a body\n indented" and rows[2].name == "Definitions: all"
    assert monolith.preamble(raw(spark)).first().preamble == "stray words\n"
    assert monolith.read(raw(spark, "no titles")).count() == 0


def test_atoms_round_trip_through_files_and_archives(spark, tmp_path):
    files = atoms.from_monolith(raw(spark)).collect()
    blobs = {}
    for r in files:
        folder = tmp_path / "content" / "/".join(r.folder)
        folder.mkdir(parents=True)
        (folder / "document.md").write_text(r.blob)
        blobs["content/" + "/".join(r.folder) + "/document.md"] = r.blob
    found = atoms.read(spark, str(tmp_path / "content"), "c", "v")
    assert found.where("_corrupt is not null").count() == 0
    assert {tuple(r.folder): r.name for r in found.collect()}[("A", "0", "1", "1")] == "Definitions: all"
    docs = {r.doc_no: r for r in atoms.to_docs(found).collect()}
    want = {r.doc_no: r for r in monolith.read(raw(spark)).collect()}
    assert {n: (r.name, r.doc_type, r.body) for n, r in docs.items()} == {n: (r.name, r.doc_type, r.body) for n, r in want.items()}
    assert docs["NR-1"].target_no == "A.0.1.1.0.3.1"
    with tarfile.open(tmp_path / "c@v.tar.gz", "w:gz") as out:
        for name, blob in {**blobs, "content/A/readme.txt": "no"}.items():
            data = blob.encode()
            member = tarfile.TarInfo("repo/" + name)
            member.size = len(data)
            out.addfile(member, io.BytesIO(data))
    from_tar = atoms.read_tars(spark, str(tmp_path / "c@v.tar.gz"))
    assert {(r.corpus_id, r.version_id, tuple(r.folder), r.blob) for r in from_tar.collect()} == {("c", "v", tuple(r.folder), r.blob) for r in files}


def _tar(path, entries, mode="w", form=tarfile.PAX_FORMAT):
    with tarfile.open(path, mode, format=form) as out:
        for name, data in entries:
            member = tarfile.TarInfo(name)
            member.type = tarfile.DIRTYPE if data is None else tarfile.REGTYPE
            member.size = len(data or b"")
            out.addfile(member, io.BytesIO(data or b""))


@pytest.mark.parametrize("form", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT, tarfile.USTAR_FORMAT])
@pytest.mark.parametrize("most", [order.MOST_IN_TASK, 1])
def test_archives_are_read_in_splits(spark, tmp_path, form, most):
    """Any size of member, with and without line feeds, long names, an archive inside an archive, several splits."""
    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w") as out:
        member = tarfile.TarInfo("content/Z/document.md")
        member.size = 3
        out.addfile(member, io.BytesIO(b"in\n"))
    deep = "/".join(str(k) * 3 for k in range(25 if form == tarfile.USTAR_FORMAT else 40))
    entries = [("repo", None), ("repo/content", None), ("repo/content/A/document.md", "é\n\nline\n".encode()), ("repo/content/B/document.md", b""), ("repo/content/C/document.md", b"no end")]
    entries += [(f"repo/content/{deep}/document.md", b"deep\n"), ("repo/content/inner.tar", inner.getvalue()), ("repo/content/D/document.md", b"\n"), ("repo/content/E/document.md", b"\xff\n"), ("repo/document.md", b"no")]
    entries += [(f"repo/content/{k}/document.md", (f"# {k} ustar\n" * k * 7 + "x" * (k * 53 % 700)).encode()) for k in range(30)] + [("repo/content/A/document.md", b"again")]
    for name, mode in (("c@v.tar", "w"), ("c@w.tar.gz", "w:gz"), ("d.tar.bz2", "w:bz2"), ("d@x.tgz", "w:gz"), ("d@y.tar.xz", "w:xz")):
        _tar(tmp_path / name, entries, mode, form)
    _tar(tmp_path / "none@v.tar", [], "w", form)
    want = sorted((tuple(n.removeprefix("repo/content/").split("/")[:-1]), b.decode("utf-8", "replace")) for n, b in entries if b is not None and n.startswith("repo/content/") and n.endswith("/document.md"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        got = {}
        for r in atoms.read_tars(spark, str(tmp_path), most=most).collect():
            got.setdefault((r.corpus_id, r.version_id), []).append((tuple(r.folder), r.blob))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert set(got) == {("c", "v"), ("c", "w"), ("d", "base"), ("d", "x"), ("d", "y")}
    for rows in got.values():
        assert sorted(rows) == want


def test_broken_archives_fail(spark, tmp_path):
    _tar(tmp_path / "good.tar", [("content/A/document.md", b"line\n" * 500)])
    whole = (tmp_path / "good.tar").read_bytes()
    for name, data in (("text.tar", b"no archive\n" * 100), ("cut.tar", whole[:1500]), ("two.tar", whole + whole)):
        folder = tmp_path / name[:-4]
        folder.mkdir()
        (folder / name).write_bytes(data)
        with pytest.raises(Exception, match="no archive|ends inside|no header"):
            atoms.read_tars(spark, str(folder)).collect()


def test_written_archives_are_read_by_others(spark, tmp_path):
    from doctree.sources import archives

    rows = [(1, "c/content", "A/document.md", "é\n"), (1, "c/content", "B/document.md", ""), (1, "d/content", "A/document.md", "x" * 1024), (2, "c", "z" * 100, "end")]
    archives.write(spark.createDataFrame(rows, "part int, prefix string, name string, content string"), str(tmp_path / "out"), ["part"])
    got = []
    for path in (tmp_path / "out").rglob("*.txt"):
        with tarfile.open(path) as archive:
            got += [(int(path.parent.name[5:]), m.name, archive.extractfile(m).read().decode()) for m in archive]
    assert sorted(got) == sorted((p, f"{a}/{b}", c) for p, a, b, c in rows)
    back = archives.members(spark, str(tmp_path / "out"), lambda name: ~name.endswith("B/document.md"))
    assert sorted((r.name, r.content) for r in back.collect()) == sorted((f"{a}/{b}", c) for _, a, b, c in rows if b != "B/document.md")


def test_malformed_atoms(spark):
    good = "---\nid: u\ndocNo: A.1\nname: N: x\ntype: Scope\ndepth: 1\nchildType: c\n---\n\n# A.1 - N [Scope]\nbody"
    cases = [good, good.replace("---\n", "", 1), good.replace("depth: 1\n", ""), good.replace("type: Scope", "type: Scope\ntargets: none"), "---\nid: u\n", ""]
    frame = spark.createDataFrame([("c", "v", [str(i)], b) for i, b in enumerate(cases)], "corpus_id string, version_id string, folder array<string>, blob string")
    rows = atoms.parse(frame).orderBy("folder").collect()
    assert rows[0].name == "N: x" and rows[0].content == "body" and rows[0]._corrupt is None
    assert [r._corrupt for r in rows[1:]] == ["no frontmatter", "missing depth", "targets are no list", "no frontmatter", "no frontmatter"] and rows[1].doc_no is None
    with pytest.raises(Exception, match="missing depth|no frontmatter|targets are no list"):
        atoms.parse(frame, "strict").collect()
    assert spark.createDataFrame([(p,) for p in ("content\\A\\1\\document.md", "x/document.md")], "p string").where(atoms.is_atom_path("p")).count() == 1


def test_extras(spark):
    rows = [("Scenario", "Text\n\n**Description**:\n\n d1\n d2 \n\n**Other**:\n\n**Finding**:\n\n"), ("Scenario", "no labels"), ("Core", "**Finding**:\n\nx"), ("Needed Research", "**Content**:\n\na\n**Content**:\n\nb")]
    frame = spark.createDataFrame([("c", "v", *r) for r in rows], "corpus_id string, version_id string, doc_type string, body string")
    got = {(r.doc_type, r.body): (r.content, r.extras) for r in atoms.extras(frame).collect()}
    assert got[rows[0]] == ("Text", {"scenario_description": " d1\n d2 \n\n**Other**:", "scenario_finding": "", "scenario_additional_guidance": ""})
    assert got[rows[1]] == ("no labels", None) and got[rows[2]] == (rows[2][1], None) and got[rows[3]] == ("", {"needed_research_content": "b"})


def tree_docs(spark):
    rows = [("A.1", "Scope", "s", U[0], None), ("A.1.1", "Article", "a", U[1], None), ("A.1.1.2", "Section", "List Of Prime Agent Artifacts", U[2], None), ("A.1.1.2.1", "Core", "agent", U[3], None), ("A.1.1.10", "Section", "x", U[4], None), ("A.1.1.10.7.1", "Core", "deep", U[5], None), ("NR-2", "Needed Research", "n2", U[6], "A.1.1"), ("NR-10", "Needed Research", "n10", U[7], "A.1.1"), ("NR-3", "Needed Research", "lost", U[8], "A.9")]
    return spark.createDataFrame([("c", "v", n, t, name, u, target, "body") for n, t, name, u, target in rows], "corpus_id string, version_id string, doc_no string, doc_type string, name string, uuid string, target_no string, body string")


def test_tree(spark):
    docs = tree_docs(spark)
    order = [r.doc_no for r in tree.positions(docs).orderBy("position").collect()]
    assert order == ["A.1", "A.1.1", "NR-2", "NR-10", "A.1.1.2", "A.1.1.2.1", "A.1.1.10", "A.1.1.10.7.1", "NR-3"]
    edges = {r.doc_no: (r.parent_no, r.collection) for r in tree.edges(docs).collect()}
    assert edges["A.1.1.2.1"] == ("A.1.1.2", "agent_scope_database") and edges["A.1.1.10.7.1"] == ("A.1.1.10", "sections_and_primary_docs")
    assert edges["NR-2"] == ("A.1.1", "needed_research") and "NR-3" not in edges and "A.1" not in edges
    assert [r.doc_no for r in tree.depth_guard(tree.edges(docs), 2).orderBy("doc_no").collect()] == ["A.1.1.10.7.1", "A.1.1.2.1"]
    circle = spark.createDataFrame([("c", "v", "x", "y"), ("c", "v", "y", "x"), ("c", "v", "z", "r")], "corpus_id string, version_id string, doc_no string, parent_no string")
    assert {r.doc_no for r in tree.depth_guard(circle).collect()} == {"x", "y"}
    assert {r.doc_no: r.n_descendants for r in tree.descendant_counts(docs).collect()} == {"A.1": 5, "A.1.1": 4, "A.1.1.2": 1, "A.1.1.10": 1}


def test_json(spark):
    docs = tree_docs(spark)
    back = tree_json.read(tree_json.write(docs))
    paths = {r.d: r.path for r in back.select(F.try_variant_get("node", "$.doc_no", "string").alias("d"), "path").collect()}
    assert paths["A.1"] == "$.0" and paths["NR-10"] == "$.0.articles.0.needed_research.1" and paths["A.1.1.2.1"] == "$.0.articles.0.sections_and_primary_docs.0.agent_scope_database.0"
    assert tree_json.issues(tree_json.write(docs.where("doc_no <> 'NR-3'"))).count() == 0


def test_search(spark):
    docs = atoms.extras(tree_docs(spark)).join(tree.positions(tree_docs(spark)), ["corpus_id", "version_id", "doc_no"])
    hits = search.search(docs, ["a.1.1.10", " AGENT ", "body", "  "]).collect()
    by = {}
    for r in hits:
        by.setdefault(r["query"], []).append((r.doc_no, r.matched_field))
    assert by["a.1.1.10"] == [("A.1.1.10", "doc_no"), ("A.1.1.10.7.1", "doc_no")] and set(by["agent"]) == {("A.1.1.2", "name"), ("A.1.1.2.1", "name")} and len(by["body"]) == 9 and len(by) == 3


def test_many_queries_are_found_by_posting_lists(spark, monkeypatch):
    docs = atoms.extras(tree_docs(spark)).join(tree.positions(tree_docs(spark)), ["corpus_id", "version_id", "doc_no"])
    asked = ["a.1.1.10", " AGENT ", "body", "  ", "b", "dy", "a", "nowhere", "a.9", "agentx", "b\x00"] + [f"q{k}" for k in range(30)]
    few = sorted(search.search(docs, asked).collect(), key=str)
    monkeypatch.setattr(search, "FEW", 3)
    assert sorted(search.search(docs, asked).collect(), key=str) == few and len({r["query"] for r in few}) > 4
    assert sorted(search.candidates(docs, spark.createDataFrame([(q,) for q in ("body", "dy")], "query string"), 0).collect()) == sorted(search.candidates(docs, spark.createDataFrame([(q,) for q in ("body", "dy")], "query string")).collect())


def test_proposals(spark, tmp_path):
    repo = '{"name": "r", "owner": {"login": "o"}}'
    one = lambda n, state, ref, updated, merged="null", head=repo: f'{{"number": {n}, "title": "t{n}", "state": "{state}", "updated_at": "{updated}", "merged_at": {merged}, "base": {{"ref": "main", "repo": {repo}}}, "head": {{"ref": "{ref}", "sha": "s", "repo": {head}}}}}'
    merged = [one(1, "closed", "proposal/a", "2024-01-01T00:00:00Z", '"2024-03-01T00:00:00Z"'), one(2, "closed", "proposal/b", "2024-05-01T00:00:00Z"), one(3, "open", "fix/c", "2024-06-01T00:00:00Z"), one(4, "open", "proposal/d", "2024-07-01T00:00:00Z", head="null")]
    path = tmp_path / "p.json"
    path.write_text("[" + ",".join(merged) + "]")
    assert [r.number for r in proposals.current(proposals.read(spark, str(path))).collect()] == [1]
    path.write_text("[" + ",".join([*merged, one(5, "open", "proposal/e", "2023-01-01T00:00:00Z")]) + "]")
    assert [(r.repo, r.number) for r in proposals.current(proposals.read(spark, str(path))).collect()] == [("o/r", 5)]


VERSION = "corpus_id string, version_id string, doc_no string, doc_type string, name string, uuid string, target_no string, body string, committed_at timestamp"


class Stream:
    """Lands versions in a folder, runs the stream over what is new, and reads what is published."""

    def __init__(self, spark, path, **limits):
        self.spark, self.path, self.limits = spark, str(path), {"least_chars": 10, "least_docs": 2, **limits}

    def land(self, docs, version, day="2024-01-01"):
        docs.withColumn("version_id", F.lit(version)).withColumn("committed_at", F.lit(day).cast("timestamp")).write.mode("append").parquet(f"{self.path}/in")

    def run(self):
        stream = versions.ingest(self.spark, f"{self.path}/in", VERSION)
        versions.publish_stream(stream, f"{self.path}/out", f"{self.path}/checkpoint", **self.limits).awaitTermination()
        return versions.published(self.spark, f"{self.path}/out")

    def counts(self):
        return {r.version_id: r["count"] for r in self.run().groupBy("version_id").count().collect()}


def test_versions_stream(spark, tmp_path):
    docs, stream = tree_docs(spark), Stream(spark, tmp_path)
    stream.land(docs, "v1")
    assert stream.counts() == {"v1": 9}
    stream.land(docs, "v1")
    stream.land(docs, "v2", "2024-01-02")
    stream.land(docs.limit(1), "bad", "2024-01-03")
    published = stream.run()
    assert {r.version_id: r["count"] for r in published.groupBy("version_id").count().collect()} == {"v1": 9, "v2": 9}
    assert [r.version_id for r in versions.latest_good(published).collect()] == ["v2"]
    assert spark.read.parquet(f"{tmp_path}/out/quarantine").count() == 1
    versions.diff_publisher(docs, str(tmp_path / "diff"))(published.where("version_id = 'v2'").select("corpus_id", "version_id", "doc_no", "name", "uuid", "body"), 0)
    assert {r.change for r in spark.read.parquet(str(tmp_path / "diff")).collect()} == {"same"}


def test_a_version_over_several_batches_is_published_whole(spark, tmp_path):
    docs, stream = tree_docs(spark), Stream(spark, tmp_path, least_docs=3)
    for part, want in ((docs.where("doc_no in ('A.1', 'A.1.1')"), {}), (docs.where("doc_no like 'A.1.1.%'"), {"v1": 6}), (docs.where("doc_no like 'NR%'"), {"v1": 9})):
        stream.land(part, "v1")
        assert stream.counts() == want
    more = docs.limit(1).withColumns({"doc_no": F.lit("A.1.1.11"), "doc_type": F.lit("Section"), "uuid": F.lit(U[9])})
    stream.land(more.unionByName(docs.where("doc_no = 'A.1'").withColumn("body", F.lit("new body"))), "v1")
    found = stream.run()
    assert found.count() == 10 and found.where("doc_no = 'A.1'").first().body == "new body"


def test_late_versions_and_many_of_them_are_published(spark, tmp_path):
    docs, stream = tree_docs(spark).where("doc_no in ('A.1', 'A.1.1')").drop("version_id"), Stream(spark, tmp_path, least_chars=1)
    many = docs.crossJoin(spark.range(1500).select(F.concat(F.lit("v"), "id").alias("version_id"))).withColumn("committed_at", F.lit("2024-06-01").cast("timestamp"))
    many.repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
    assert len(stream.counts()) == 1500
    stream.land(docs, "late", "2022-01-01")
    found = stream.counts()
    assert len(found) == 1501 and found["late"] == 2


def test_a_version_with_documents_outside_its_tree_is_not_published(spark, tmp_path):
    docs, stream = tree_docs(spark), Stream(spark, tmp_path)
    stream.land(docs, "v1")
    stream.land(docs.withColumn("doc_type", F.when(F.col("doc_no") == "A.1.1.10", "Scenario").otherwise(F.col("doc_type"))).withColumn("doc_no", F.when(F.col("doc_no") == "A.1.1.10", "A.1.1.1.10").otherwise(F.col("doc_no"))), "v2")
    assert stream.counts() == {"v1": 9}
    assert {(r.version_id, r.n_docs, r.n_tree) for r in spark.read.parquet(f"{tmp_path}/out/judged").where("not good").collect()} == {("v2", 9, 8)}


class Commits(Stream):
    """As Stream, under commits."""

    def land(self, docs, version, commit, size, day="2024-01-01"):
        docs = docs.withColumns({"commit_id": F.lit(commit), "commit_docs": F.lit(size).cast("long")})
        super().land(docs, version, day)

    def run(self):
        stream = versions.ingest(self.spark, f"{self.path}/in", VERSION + ", commit_id string, commit_docs long")
        versions.publish_stream(stream, f"{self.path}/out", f"{self.path}/checkpoint", **self.limits).awaitTermination()
        return versions.published(self.spark, f"{self.path}/out")

    def status(self):
        return sorted((r.commit_id, r.status) for r in self.spark.read.parquet(f"{self.path}/out/commits").collect())

    def batches(self, table):
        return sorted(r.batch_id for r in self.spark.read.parquet(f"{self.path}/out/{table}").select("batch_id").distinct().collect())


def without_body(rows):
    return sorted((r.uuid or "", r.base_doc_no or "", r.head_doc_no or "", r.base_name or "", r.head_name or "", r.change, r.status or "") for r in rows)


def test_a_commit_is_published_when_it_is_complete_and_once(spark, tmp_path):
    docs, stream = tree_docs(spark), Commits(spark, tmp_path)
    parts = [docs.where("doc_no in ('A.1', 'A.1.1')"), docs.where("doc_no like 'A.1.1.%'"), docs.where("doc_no like 'NR%'")]
    for part, want in zip(parts, ({}, {}, {"v1": 9}), strict=True):
        stream.land(part, "v1", "c1", 9)
        assert stream.counts() == want
    before = stream.batches("landings"), stream.batches("published")
    stream.land(docs, "v1", "c1", 9)  # seen: it is not even kept
    assert stream.counts() == {"v1": 9} and (stream.batches("landings"), stream.batches("published")) == before
    assert stream.status() == [("c1", "published")]


def test_a_later_commit_replaces_moves_and_removals_and_an_earlier_one_does_not(spark, tmp_path):
    docs, stream = tree_docs(spark), Commits(spark, tmp_path)
    stream.land(docs, "v1", "c1", 9, "2024-01-05")
    assert stream.counts() == {"v1": 9}
    moved = docs.where("doc_no <> 'NR-3'").withColumn("doc_no", F.when(F.col("doc_no") == "A.1.1.10", "A.1.1.11").when(F.col("doc_no") == "A.1.1.10.7.1", "A.1.1.11.7.1").otherwise(F.col("doc_no")))
    moved = moved.withColumn("target_no", F.regexp_replace("target_no", "10$", "11"))
    stream.land(moved, "v1", "c2", moved.count(), "2024-01-06")
    found = {r.doc_no: r.uuid for r in stream.run().collect()}
    assert found == {r.doc_no: r.uuid for r in moved.collect()} and "A.1.1.10" not in found and "NR-3" not in found
    stream.land(docs, "v1", "c0", 9, "2024-01-01")
    assert {r.doc_no for r in stream.run().collect()} == set(found)
    assert stream.status() == [("c0", "superseded"), ("c1", "published"), ("c2", "published")]


def test_one_document_over_is_not_a_complete_commit_and_a_repeated_one_is(spark, tmp_path):
    docs, stream = tree_docs(spark), Commits(spark, tmp_path)
    stream.land(docs, "v1", "c1", 8)
    stream.land(docs, "v2", "c2", 9)
    stream.land(docs, "v2", "c2", 9)
    stream.land(docs.limit(1), "v3", "c3", 1)
    assert stream.counts() == {"v2": 9} and stream.status() == [("c2", "published"), ("c3", "quarantined")]


def test_a_head_over_several_batches_gives_one_diff(spark, tmp_path):
    docs, stream = tree_docs(spark), Commits(spark, tmp_path)
    stream.land(docs, "main", "c1", 9)
    stream.run()
    head = docs.where("doc_no <> 'NR-3'").withColumn("body", F.when(F.col("doc_no") == "A.1.1", "new").otherwise(F.col("body"))).withColumn("name", F.when(F.col("doc_no") == "A.1", "Other").otherwise(F.col("name"))).cache()
    for k in range(3):
        stream.land(head.where(F.expr(f"crc32(cast(doc_no as binary)) % 3 = {k}")), "head", "c2", head.count(), "2024-02-01")
        stream.run()
    found = versions.diffs(spark, f"{tmp_path}/out").collect()
    assert {(r.version_id, r.base_id) for r in found} == {("head", "main")}
    assert without_body(found) == without_body(diff.classify(docs, head).collect())
    assert sum(r.change == "Deleted" for r in found) == 1


def test_a_head_is_compared_again_when_its_base_is_replaced(spark, tmp_path):
    docs, stream = tree_docs(spark), Commits(spark, tmp_path)
    stream.land(docs.where("doc_no <> 'NR-3'"), "main", "c1", 8, "2024-01-01")
    stream.run()
    head = docs.withColumn("body", F.when(F.col("doc_no") == "A.1.1", "new").otherwise(F.col("body")))
    stream.land(head, "head", "c3", 9, "2024-01-04")
    stream.run()
    assert sum(r.change == "Inserted" for r in versions.diffs(spark, f"{tmp_path}/out").collect()) == 1
    stream.land(docs, "main", "c2", 9, "2024-01-02")
    stream.run()
    found = versions.diffs(spark, f"{tmp_path}/out").collect()
    assert {(r.version_id, r.base_id) for r in found} == {("head", "main")}
    assert without_body(found) == without_body(diff.classify(docs, head).collect())
    stream.land(docs, "main", "c4", 9, "2024-01-05")  # now head is the first, and main follows it
    stream.run()
    assert {(r.version_id, r.base_id) for r in versions.diffs(spark, f"{tmp_path}/out").collect()} == {("main", "head")}


def test_a_batch_reads_what_it_touches(spark, tmp_path):
    docs = tree_docs(spark).drop("version_id")
    stream = Commits(spark, tmp_path)
    many = docs.crossJoin(spark.range(300).select(F.concat(F.lit("v"), "id").alias("version_id")))
    many.withColumns({"commit_id": F.col("version_id"), "commit_docs": F.lit(9).cast("long"), "committed_at": F.lit("2024-06-01").cast("timestamp")}).write.mode("append").parquet(f"{tmp_path}/in")
    assert len(stream.counts()) == 300
    stream.land(docs.where("doc_no = 'A.1'"), "new", "n1", 9)
    stream.run()
    stream.land(docs.where("doc_no <> 'A.1'"), "new", "n1", 9)
    stream.run()
    out = f"{tmp_path}/out"
    landings = spark.read.parquet(f"{out}/landings").where("commit_id = 'n1'")
    read = versions._folders(spark, f"{out}/landed", landings, spark.read.parquet(f"{out}/landed").schema)
    assert landings.count() == 2 and read.count() == 9 and spark.read.parquet(f"{out}/landed").count() == 2709


def test_moves_are_seen_without_commits_too(spark, tmp_path):
    docs, stream = tree_docs(spark), Stream(spark, tmp_path)
    stream.land(docs, "v1")
    stream.run()
    stream.land(docs.where("doc_no = 'A.1.1.2.1'").withColumn("doc_no", F.lit("A.1.1.2.5")), "v1")
    assert sorted(r.doc_no for r in stream.run().collect()) == sorted({r.doc_no for r in docs.collect()} - {"A.1.1.2.1"} | {"A.1.1.2.5"})


def test_every_version_of_a_batch_is_compared(spark, tmp_path):
    schema = "corpus_id string, doc_no string, name string, uuid string, body string"
    base = spark.createDataFrame([("c", "A.1", "S", U[0], "x"), ("c", "A.2", "T", U[1], "y"), ("d", "A.1", "S", U[0], "z")], schema)
    head = spark.range(1005).select(F.lit("c").alias("corpus_id"), F.concat(F.lit("v"), "id").alias("version_id"), F.lit("A.1").alias("doc_no"), F.lit("S").alias("name"), F.lit(U[0]).alias("uuid"), F.when(F.col("id") % 2 == 0, "x").otherwise("w").alias("body"))
    versions.diff_publisher(base, str(tmp_path / "diff"))(head.repartition(1), 7)
    found = spark.read.parquet(str(tmp_path / "diff"))
    got = {(r.corpus_id, r.change): r.n for r in found.groupBy("corpus_id", "change").agg(F.countDistinct("version_id").alias("n")).collect()}
    assert got == {("c", "same"): 503, ("c", "substantive"): 502, ("c", "Deleted"): 1005}


def test_suppression(spark):
    rows = [("c", "v", 1, "t", "A.1", U[0], ["", "x"]), ("c", "v", 4, "t", "A.2", U[1], ["", f"**Label**: {U[0]}", "y"])]
    docs = spark.createDataFrame(rows, "corpus_id string, version_id string, line bigint, title string, doc_no string, uuid string, rows array<string>")
    found = spark.createDataFrame([("c", "v", "V6", line, no, "") for line, no in ((2, "A.1"), (3, "A.1"), (5, "A.2"), (6, "A.2"), (7, "A.2"))], "corpus_id string, version_id string, rule_id string, line bigint, doc_no string, detail string")
    assert sorted(r.line for r in quality.suppress(found, docs, spark.createDataFrame([(U[0],)], "uuid string")).collect()) == [5, 7]


def test_parents_without_uuids_and_notes_on_notes(spark):
    rows = [("A.1", "Scope", "s", U[0], None), ("A.1.1", "Article", "a", "", None), ("A.1.1.1", "Section", "x", U[2], None), ("NR-1", "Needed Research", "n", U[3], "A.1.1.1"), ("NR-3", "Needed Research", "n", U[4], "NR-2"), ("NR-2", "Needed Research", "n", U[5], "NR-1")]
    rows += [("NR-8", "Needed Research", "n", U[6], "NR-9"), ("NR-9", "Needed Research", "n", U[7], "NR-8"), ("NR-7", "Needed Research", "n", U[8], "A.9"), ("NR-6", "Needed Research", "n", U[9], "NR-7"), ("A.1.1.1.9", "Annotation", "malformed", U[10], None)]
    docs = spark.createDataFrame([("c", "v", *r, "body") for r in rows], "corpus_id string, version_id string, doc_no string, doc_type string, name string, uuid string, target_no string, body string")
    edges = {r.doc_no: (r.parent_no, r.collection) for r in tree.edges(docs).collect()}
    assert edges == {"A.1.1": ("A.1", "articles"), "A.1.1.1": ("A.1.1", "sections_and_primary_docs"), **{f"NR-{k}": ("A.1.1.1", "needed_research") for k in (1, 2, 3)}}
    assert {r.doc_no: r.level for r in tree.structural_levels(docs).collect()} == {"A.1": 1, "A.1.1": 2, "A.1.1.1": 3, "A.1.1.1.9": 4, "NR-1": 4, "NR-2": 5, "NR-3": 6, "NR-7": 1, "NR-6": 2, "NR-8": 1, "NR-9": 1}
    order = [r.doc_no for r in tree.positions(docs).orderBy("position").collect()]
    assert order == ["A.1", "A.1.1", "A.1.1.1", "NR-1", "NR-2", "NR-3", "A.1.1.1.9", "NR-7", "NR-6", "NR-8", "NR-9"]
    assert {r.doc_no for r in tree.attach_by_target(docs).where("orphan").collect()} == {"NR-7"}


def test_deep_trees_are_read_and_written_whole(spark):
    numbers = ["A.1", "A.1.1", "A.1.1.1", *(".".join(["A.1.1.1"] + ["1"] * k) for k in range(1, 58))]
    rows = [("c", "v", n, "Scope" if i == 0 else "Article" if i == 1 else "Section" if i == 2 else "Core", "n", f"u{i}", None, "b") for i, n in enumerate(numbers)]
    docs = spark.createDataFrame(rows, "corpus_id string, version_id string, doc_no string, doc_type string, name string, uuid string, target_no string, body string")
    back = tree_json.read(tree_json.write(docs))
    assert back.count() == 60 and {r.d for r in back.select(F.try_variant_get("node", "$.doc_no", "string").alias("d")).collect()} == set(numbers)
    assert {r.doc_no for r in tree.depth_guard(tree.edges(docs)).collect()} == set(numbers[51:])


def test_last_wins_and_links_to_repeated_uuids(spark):
    rows = [("A.1", "s", U[0], f"see [x]({U[1].upper()}) and [y]({U[2]})"), ("A.1.9", "b", U[1], ""), ("A.1.10", "c", U[1], "")]
    docs = spark.createDataFrame([("c", "v", n, "Scope" if n == "A.1" else "Article", name, u, None, body) for n, name, u, body in rows], "corpus_id string, version_id string, doc_no string, doc_type string, name string, uuid string, target_no string, body string")
    assert {(r.text, r.target_no) for r in search.resolved_links(docs).collect()} == {("x", "A.1.10"), ("y", None)}


def test_normalised_export(spark):
    rows = [("A.1", "Scope", "S", U[0], None, " “quoted” \n• point "), ("A.1.2", "Article", "B", U[1], None, ""), ("A.1.1", "Article", " ", U[2], None, "gone"), ("A.1.1.1", "Section", "gone too", U[3], None, "x"), ("NR-1", "Needed Research", "N", U[4], "A.1.2", "Why\n\n**Content**:\n\n“this”"), ("A.1.2.1", "Section", "C", None, None, "")]
    docs = spark.createDataFrame([("c", "v", *r) for r in rows], "corpus_id string, version_id string, doc_no string, doc_type string, name string, uuid string, target_no string, body string")
    (row,) = monolith.write_normalized(docs).collect()
    want = ["# A.1 - S [Scope]  <!-- UUID: %s -->" % U[0], "", '"quoted" \n- point', "", "## A.1.2 - B [Article]  <!-- UUID: %s -->" % U[1], "", "### NR-1 - N [Needed Research]  <!-- UUID: %s -->" % U[4], "", "Why", "", "**Content**:", "", '"this"', "", "### A.1.2.1 - C [Section]  <!-- UUID:  -->", ""]
    assert row.text == "\n".join(want)


def test_texts_in_parts_and_files(spark, tmp_path):
    docs = tree_docs(spark)
    (whole,) = monolith.write(docs).collect()
    parts = monolith.parts(docs, 200).orderBy("part").collect()
    assert len(parts) > 2 and "\n".join(r.text for r in parts) == whole.text
    monolith.write_files(docs, str(tmp_path / "texts"), 200)
    back = monolith.read(monolith.read_files(spark, str(tmp_path / "texts")))
    assert {(r.corpus_id, r.version_id, r.doc_no, r.body) for r in back.collect()} == {("c", "v", r.doc_no, "body") for r in docs.collect()}


def test_running_sums_over_ranges(spark):
    rows = [(f"g{k % 3}", k, k % 5) for k in range(500)]
    got = order.running(spark.createDataFrame(rows, "g string, k bigint, v bigint").repartition(7), ["g"], ["k"], "v", "upto").collect()
    sums = {}
    for g, k, v in rows:
        sums[g] = sums.get(g, 0) + v
        assert (g, k, v, sums[g]) in {tuple(r) for r in got if r.k == k}


def test_text_functions(spark):
    from doctree.functions import text

    frame = spark.createDataFrame([("The other the", "0000000A000000000000000000000000", [("a", "1"), ("b", "2"), ("a", "3")])], "t string, u string, p array<struct<key:string,value:string>>")
    row = frame.select(text.highlight_spans("t", "THE").alias("s"), text.bare_uuid("u").alias("u"), text.normalized_uuid("u").alias("n"), text.mapping_of(text.mapping_json(F.col("p"))).alias("m"), text.guarded("t", 3).alias("g"), text.content_hash("t").alias("h"), text.shown_value(F.lit(None).cast("string")).alias("v"), text.shown_list(F.array(F.lit("x"), F.lit("y"))).alias("l")).first()
    assert [tuple(s) for s in row.s] == [(0, 3), (5, 3), (10, 3)] and row.m == {"a": "3", "b": "2"} and row.g == "The" and len(row.h) == 40 and (row.v, row.l) == ("-", "x, y")
    assert row.u == "0000000a000000000000000000000000" and row.n == "0000000a-0000-0000-0000-000000000000"


def test_atoms_are_counted(spark, tmp_path):
    for name in ("A/1/document.md", "A/document.md", "A/readme.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert versions.count_atoms(spark, str(tmp_path)) == 2


def test_owned_tables_are_deleted(spark):
    from doctree import session

    with session.tables():
        kept = session.written(spark.range(3), "numbers")
        path = kept.inputFiles()[0].removeprefix("file://")
        assert kept.count() == 3
    assert not os.path.exists(path)


def test_optional_parts_may_be_missing(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['ahocorasick'] = None; sys.path.insert(0, %r); import __spark_entry__ as e; q = e.queries(); assert 'preorder' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q" % root
    subprocess.run([sys.executable, "-c", code], check=True)


def test_carried_values_and_sums_are_the_same_over_ranges(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice("aab"), k, rng.choice([None, rng.randrange(9)]), rng.randrange(5)) for k in range(600)]
    frame = spark.createDataFrame(rows, "g string, k int, v int, w int").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        for own in (False, True):
            got = [
                {tuple(r) for r in order.carried(frame, ["g"], ["k"], last={"l": F.col("v")}, greatest={"m": F.struct("v", "w")}, own=own, most=most).collect()} for most in (10_000, 250, 1)
            ]
            want = set()
            for g, k, v, w in rows:
                before = [r for r in rows if r[0] == g and (r[1] < k or own and r[1] == k)]
                want.add((g, k, v, w, next((r[2] for r in reversed(before) if r[2] is not None), None), max(((-1 if r[2] is None else r[2], r[3]) for r in before), default=None)))
            as_pairs = lambda rows: {(*r[:5], None if r[5] is None else (-1 if r[5][0] is None else r[5][0], r[5][1])) for r in rows}
            assert all(as_pairs(g) == want for g in got)
        sums = [{tuple(r) for r in order.running(frame, ["g"], ["k"], "w", "s", most=most).collect()} for most in (10_000, 250, 1)]
        assert sums[0] == sums[1] == sums[2] == {(g, k, v, w, sum(r[3] for r in rows if r[0] == g and r[1] <= k)) for g, k, v, w in rows}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_corpus_over_many_ranges(spark):
    """J5, J8, W1 of one corpus that is dealt over some 50 ranges agree with those of one task."""
    rows = [("c", "v", k, 1 + (k * 7) % 6, f"A.{k}", "Needed Research" if k % 3 == 0 else "Core") for k in range(500)]
    docs = spark.createDataFrame(rows, "corpus_id string, version_id string, line bigint, level int, doc_no string, doc_type string")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        for found in (lambda most: tree.attach_positional(docs, "line", most), lambda most: quality.shallower(docs, most=most)):
            assert sorted(found(1).collect()) == sorted(found(10_000).collect())
        nearest = {r.line: r.above for r in quality.shallower(docs, most=1).collect()}
        assert all(nearest[k] == next((r[3] for r in reversed(rows[:k]) if r[3] < level), None) for _, _, k, level, *_ in rows)
        text = "\n".join(f"stray\n# A.{k} - N [Scope]  <!-- UUID: {U[0]} -->\n\nbody {k}" for k in range(300))
        lines = monolith.lines(raw(spark, text))
        assert sorted(monolith.owned(lines, 1).collect(), key=str) == sorted(monolith.owned_lines(raw(spark, text)).collect(), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_titles_of_any_level_are_shallower(spark):
    """A title of level 6 stands above one of level 7."""
    rows = [("c", "v", k, level, f"NR-{k}", "Needed Research") for k, level in enumerate([3, 4, 6, 7, 9, 8])]
    docs = spark.createDataFrame(rows, "corpus_id string, version_id string, line bigint, level int, doc_no string, doc_type string")
    assert [r.above for r in quality.shallower(docs).orderBy("line").collect()] == [None, 3, 4, 6, 7, 7]
    assert {(r.line, r.detail) for r in quality.note_levels(docs).collect()} >= {(3, "6"), (4, "6"), (5, "6")}


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_a_text_read_in_splits(spark, tmp_path, end):
    """S4, S5 of a file that several tasks read are those of the text as one value."""
    text = (TEXT + "".join(f"\n# A.{k} - N {k} [Scope]  <!-- UUID: {U[k % 12]} -->\n\n" + f"line of {k}\n\n" * (k % 5) + "end" for k in range(1, 400))).replace("\n", end)
    folder = tmp_path / "corpus_id=c" / "version_id=v"
    folder.mkdir(parents=True)
    (folder / "text.md").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        for most in (order.MOST_IN_TASK, 1):
            lines = monolith.read_lines(spark, str(tmp_path), most)
            columns = ["corpus_id", "version_id", "title", "level", "doc_no", "name", "doc_type", "uuid", "body"]
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
            assert sorted(lines.collect()) == sorted(monolith.lines(raw(spark, text)).select(*lines.columns).collect())
            assert sorted(monolith.documents(lines, most).select(*columns).collect(), key=str) == sorted(monolith.read(raw(spark, text)).select(*columns).collect(), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_tables_of_a_block_go_and_what_it_keeps_stays(spark):
    from doctree import session

    rows = spark.range(3)
    with session.tables():
        with session.tables() as keep:
            inner = session.written(rows, "inner")
            outer = keep(inner.withColumn("twice", F.col("id") * 2), "outer")
            more = session.written(outer, "more")
            paths = [d.inputFiles()[0] for d in (inner, outer, more)]
        there = [os.path.exists(p.removeprefix("file:").replace("//", "/")) for p in paths]
        assert there == [False, True, False] and outer.count() == 3
    assert not os.path.exists(paths[1].removeprefix("file:").replace("//", "/"))
