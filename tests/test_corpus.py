"""The derived corpora: what is written of them, and what is read without being written."""

import os

import pytest
from oracle import SF, database, rows_of
from pyspark.sql import functions as F

from doctree import plans, session
from doctree.operators import diff, tree
from doctree.plans import corpus as corpora
from doctree.plans import diff_queries, mark_queries, quality_queries, search_queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("version", ["base", "head", "dirty"])
def test_documents_are_those_of_the_sql(spark, version):
    got, want = corpora.streamed(spark, SF, version), database().sql(f"WITH RECURSIVE {corpora.corpus_sql(version)} SELECT * FROM docs")
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())
    keys = corpora.keys(spark, SF, version)
    assert rows_of(keys.columns, keys.collect()) == rows_of(keys.columns, got.select(*keys.columns).collect())


def test_what_needs_no_bodies_writes_none(spark):
    steps = diff_queries.versions(spark, SF)
    for rows in (steps.base, steps.head, steps.changes, steps.living, steps.scopes):
        assert not [c for c in rows.columns if "body" in c]
    # Bodies are looked up for what was edited, not for all documents.
    assert 0 < steps.edited.count() < steps.changes.count() / 2


def _exchanges(df):
    df.collect()
    return str(df._jdf.queryExecution().executedPlan().toString()).split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_what_is_within_a_corpus_is_not_shuffled_again(spark):
    session.ship(spark)
    docs = corpora.keys(spark, SF)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _exchanges(tree.lineage(docs).groupBy("corpus_id", "doc_no").count()) == 0
        assert _exchanges(diff.living_ancestors(corpora.numbered(spark, SF), corpora.numbered(spark, SF, "head"))) == 0
        assert _exchanges(diff_queries.versions(spark, SF).there.join(docs.select("corpus_id", "uuid", "k"), ["corpus_id", "uuid"])) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("version", ["base", "head"])
def test_digests_of_long_texts_are_those_of_the_bodies(spark, version):
    length = {"n_chars": F.length("body"), "crc": F.crc32(F.col("body"))}
    want = corpora.streamed(spark, SF, version).select("corpus_id", "uuid", *(c.alias(n) for n, c in length.items()))
    got = corpora.digested(spark, SF, version, length).select(*want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.collect())


def _unbroadcast(spark, count):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_scopes_are_worked_out_within_their_corpus(spark):
    session.ship(spark)
    v = diff_queries.versions(spark, SF)
    assert v.scopes.count() and v.living.count()
    assert _unbroadcast(spark, lambda: _exchanges(diff.scope_nodes(v.scopes, v.there, v.living))) == 0


def test_numbers_are_assigned_within_their_corpus(spark):
    session.ship(spark)
    docs = corpora.keys(spark, SF)
    assert _unbroadcast(spark, lambda: _exchanges(tree.assign_numbers(docs))) == 0


def test_bodies_of_edited_documents_are_looked_up_once(spark):
    session.ship(spark)
    v = diff_queries.versions(spark, SF)
    assert v.there.count()
    # Rows without bodies are dealt by text, and so are the texts.
    assert _unbroadcast(spark, lambda: _exchanges(diff_queries.Steps(spark, SF).edited)) == 2
    got, both = v.edited.select("corpus_id", "uuid", "base_body", "head_body"), ["corpus_id", "uuid"]
    body = lambda version: corpora.streamed(spark, SF, version).select(*both, F.col("body").alias(f"{version}_body"))
    want = got.select(*both).join(body("base"), both).join(body("head"), both).select(*got.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.collect())


@pytest.mark.parametrize("name", ["body_marks", "xref_links", "xref_unresolved", "xref_scope_class"])
def test_long_texts_are_not_read_for_each_section(spark, name):
    session.ship(spark)
    assert not [f for f in plans.QUERIES[name](spark, SF).inputFiles() if "documents.parquet" in f]


def test_sections_without_their_text_have_what_a_null_body_gives(spark, tmp_path):
    for name in corpora.TABLES:
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        (rows.where("doc_id <> 3") if name == "documents" else rows).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    marked = {"crc": F.crc32(F.coalesce("body", F.lit("")))}
    want = corpora.streamed(spark, str(tmp_path)).select("corpus_id", "uuid", marked["crc"].alias("crc"))
    assert corpora.streamed(spark, str(tmp_path)).where("body is null").count()
    got = corpora.digested(spark, str(tmp_path), "base", marked).select(*want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.collect())


@pytest.mark.parametrize("name, most", [("expand_to_targets", 0), ("depth_guard", 0), ("last_number_of_uuid", 0), ("edges_of_faulty_corpora", 0), ("export_order", 1), ("node_paths", 0), ("hierarchy", 0), ("nearest_existing_ancestor", 0)])
def test_trees_are_walked_within_their_corpus(spark, name, most):
    # Rows are placed from a plain table, which is shuffled once.
    session.ship(spark)
    assert _unbroadcast(spark, lambda: _exchanges(plans.QUERIES[name](spark, SF))) <= most


def test_a_number_of_a_note_and_of_another_document_has_both_keys(spark):
    note = "Needed Research"
    rows = [("A.1", "Scope", None), ("NR-1", note, "A.1"), ("NR-1", "Core", None), (None, note, "A.1"), (None, "Core", None)]
    docs = spark.createDataFrame([("c", "v", no, kind, "x", str(k), target) for k, (no, kind, target) in enumerate(rows)], "corpus_id string, version_id string, doc_no string, doc_type string, name string, uuid string, target_no string")
    assert sorted(str(r.doc_no) for r in tree.emit_keys(docs).collect()) == ["A.1", "NR-1", "NR-1", "None"]


def test_what_files_compress_well_does_not_pass_the_driver(spark):
    session.ship(spark)
    rows = spark.range(400_000).select((F.col("id") % 100).alias("corpus_id"), F.lit("a title that all rows have").alias("title"), F.lit("a body").alias("body"))
    found = session.dealt(rows, "rows", 4, "corpus_id")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) == 10 << 20
    plan = found.join(found.select("corpus_id", F.col("title").alias("other")), "corpus_id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", ["change_classes", "doc_spans", "truncated_text"])
def test_only_sections_meet_long_texts(spark, name):
    # What is within a corpus is joined where it is, however many long texts there are.
    session.ship(spark)
    diff_queries._derived.clear()
    assert _unbroadcast(spark, lambda: _exchanges(plans.QUERIES[name](spark, SF))) == 0
    assert _unbroadcast(spark, lambda: _exchanges(corpora.digested(spark, SF, "head", {"chars": F.length("body")}))) == 0


def test_places_of_dealt_rows_need_no_shuffle(spark):
    session.ship(spark)
    assert _unbroadcast(spark, lambda: _exchanges(tree.positions(corpora.keys(spark, SF), corpora.keeper(spark, SF)))) == 0


@pytest.mark.parametrize("name", ["search_hits", "atom_files", "duplicate_uuids"])
def test_whole_corpora_are_not_written_with_their_bodies(spark, name, monkeypatch):
    # Sections repeat the texts of documents, so such tables are many times what was read.
    session.ship(spark)
    monkeypatch.setattr(corpora, "corpus", None)
    for module in (search_queries, quality_queries, mark_queries):
        monkeypatch.setattr(module, "corpus", None, raising=False)
    assert plans.QUERIES[name](spark, SF).count()
