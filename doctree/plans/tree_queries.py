"""Queries on numbers and hierarchy, over the derived corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree.functions import numbers
from doctree.operators import tree
from doctree.plans import sql
from doctree.plans.corpus import keeper, keys, numbered, with_docs, with_every
from doctree.plans.registry import query

KEYS = tree.KEYS
K = sql.K


@query(f"""{with_docs()}, p AS (SELECT *, {sql.PARENT} AS parent_no, {sql.DEPTH} AS depth FROM docs)
SELECT p.corpus_id, p.doc_type, p.depth, count(*) AS n, count(*) FILTER (p.parent_no IS NOT NULL AND d.doc_no IS NULL) AS n_orphans
FROM p LEFT JOIN docs d ON d.corpus_id = p.corpus_id AND d.version_id = p.version_id AND d.doc_no = p.parent_no GROUP BY 1, 2, 3""")
def docs_by_type_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by type and depth, with those whose parent is missing."""
    found = tree.parents(tree.keyed(keys(spark, sf_dir)))
    depth = numbers.semantic_depth("doc_no", "doc_type")
    orphan = F.col("parent_no").isNotNull() & F.col("parent_type").isNull()
    return found.groupBy("corpus_id", "doc_type", depth.alias("depth")).agg(F.count("*").alias("n"), F.count_if(orphan).alias("n_orphans"))


@query(f"{with_docs()} SELECT corpus_id, doc_no, {sql.PARENT} AS parent_no FROM docs")
def parent_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir).select("corpus_id", "doc_no", numbers.parent_no("doc_no", "doc_type").alias("parent_no"))


@query(f"{with_docs()} SELECT corpus_id, doc_no, {sql.DEPTH} AS depth FROM docs")
def semantic_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir).select("corpus_id", "doc_no", numbers.semantic_depth("doc_no", "doc_type").alias("depth"))


@query(f"{with_docs()} SELECT corpus_id, doc_no, CASE WHEN doc_type = 'Needed Research' THEN 6 ELSE least(6, greatest(1, {sql.DEPTH})) END AS level FROM docs")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir).select("corpus_id", "doc_no", numbers.heading_level("doc_no", "doc_type").alias("level"))


@query(rf"""{with_docs()} SELECT corpus_id, doc_no, CASE WHEN doc_no LIKE 'NR-%' THEN 'Needed Research' WHEN regexp_matches(doc_no, '\.var\d+$') THEN 'Scenario Variation'
  WHEN regexp_matches(doc_no, '\.0\.3\.\d+$') THEN 'Annotation' WHEN regexp_matches(doc_no, '\.0\.6\.\d+$') THEN 'Active Data' WHEN regexp_matches(doc_no, '\.0\.4\.\d+\.1\.\d+$') THEN 'Scenario'
  WHEN regexp_matches(doc_no, '\.0\.4\.\d+$') THEN 'Action Tenet' ELSE coalesce(['Scope', 'Article', 'Section'][len(string_split(doc_no, '.')) - 1], 'Core') END AS inferred_type, doc_type FROM docs""")
def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir).select("corpus_id", "doc_no", numbers.inferred_type("doc_no").alias("inferred_type"), "doc_type")


@query(f"{with_docs()}, {sql.UP} SELECT corpus_id, doc_no, ancestor_no, ancestor_uuid, distance FROM anc")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.lineage(keys(spark, sf_dir)).select("corpus_id", "doc_no", "ancestor_no", "ancestor_uuid", "distance")


@query(f"{with_docs()}, {sql.UP} SELECT corpus_id, ancestor_no AS doc_no, count(*) AS n_descendants FROM anc GROUP BY 1, 2")
def descendant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.descendant_counts(keys(spark, sf_dir)).select("corpus_id", "doc_no", "n_descendants")


@query(f"""{with_docs()}, {sql.UP}, a AS (SELECT corpus_id, doc_no, string_agg(ancestor_uuid, '/' ORDER BY distance DESC) AS p FROM anc GROUP BY 1, 2)
SELECT d.corpus_id, d.doc_no, coalesce(a.p || '/', '') || d.uuid AS path FROM docs d LEFT JOIN a USING (corpus_id, doc_no)""")
def node_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.paths(keys(spark, sf_dir)).select("corpus_id", "doc_no", F.array_join("path", "/").alias("path"))


@query(f"""{with_docs()}, {sql.UP}, t AS (SELECT corpus_id, uuid AS given, doc_no FROM docs WHERE doc_type = 'Action Tenet' UNION ALL SELECT corpus_id, doc_no, doc_no FROM docs WHERE doc_type = 'Annotation')
SELECT t.corpus_id, t.given, t.doc_no, anc.ancestor_no AS open_no FROM t JOIN anc USING (corpus_id, doc_no)""")
def expand_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to open for a target that is given by uuid (tenets) or by number (annotations)."""
    docs = keys(spark, sf_dir)
    # One reading for both, as a union of them would be shuffled.
    by = F.when(F.col("doc_type") == "Action Tenet", F.col("uuid")).otherwise(F.col("doc_no"))
    given = docs.where("doc_type in ('Action Tenet', 'Annotation')").select("corpus_id", by.alias("given"))
    one = docs.select("corpus_id", "doc_no", F.explode(F.array("uuid", "doc_no")).alias("given"))
    found = given.join(one, ["corpus_id", "given"])
    return found.join(tree.lineage(docs), ["corpus_id", "doc_no"]).select("corpus_id", "given", "doc_no", F.col("ancestor_no").alias("open_no"))


@query(f"""{with_docs()}, {sql.UP}, {sql.DBS}, {sql.EDGES}
SELECT corpus_id, parent_no, string_agg(doc_no, ' ' ORDER BY coalesce(collection_ord, 99), sibling_ord, doc_no) AS children FROM edges GROUP BY 1, 2""")
def child_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.child_lists(tree.edges(keys(spark, sf_dir), keeper(spark, sf_dir))).select("corpus_id", "parent_no", F.array_join("children", " ").alias("children"))


@query(f"{with_docs()}, {sql.UP}, {sql.DBS}, {sql.EDGES}, {sql.PATHS} SELECT corpus_id, doc_no FROM tree WHERE len(key) > 5")
def depth_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9, with a limit that some documents pass."""
    keep = keeper(spark, sf_dir)
    return tree.depth_guard(tree.edges(keys(spark, sf_dir), keep), 4, keep).select("corpus_id", "doc_no")


@query(f"""{with_every(where="NOT (doc_type = 'Section' AND k % 5 = 0)")}, {sql.UP}
SELECT d.corpus_id, d.doc_no, arg_min(ancestor_no, distance) AS ancestor_no FROM docs d LEFT JOIN anc USING (corpus_id, doc_no) GROUP BY 1, 2""")
def nearest_existing_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, after every fifth section is taken away."""
    docs = keys(spark, sf_dir).where("not (doc_type = 'Section' and k % 5 = 0)")
    return tree.nearest_ancestor(docs).select("corpus_id", "doc_no", "ancestor_no")


@query(f"{with_docs()}, {sql.UP}, {sql.DBS}, {sql.EDGES} SELECT corpus_id, parent_no, doc_no, parent_database, database, collection, sibling_ord FROM edges")
def edges_with_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.edges(keys(spark, sf_dir), keeper(spark, sf_dir)).select("corpus_id", "parent_no", "doc_no", "parent_database", "database", "collection", "sibling_ord")


@query(f"{with_docs()}, {sql.UP}, {sql.DBS} SELECT corpus_id, doc_no FROM agent")
def agent_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.agents(keys(spark, sf_dir)).select("corpus_id", "doc_no")


@query(f"""{with_docs()}, {sql.UP}, {sql.DBS}, {sql.EDGES}
SELECT corpus_id, parent_no, e.collection, count(*) AS n, label, label_ord FROM edges e JOIN {sql.values([(c, label, i + 1) for i, (c, label) in enumerate(tree.schema.SUPPORTING_LABELS.items())], 'collection, label, label_ord')} s USING (collection) GROUP BY ALL""")
def supporting_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.supporting_groups(tree.edges(keys(spark, sf_dir), keeper(spark, sf_dir))).select("corpus_id", "parent_no", "collection", "n", "label", "label_ord")


@query(f"""{with_docs()}, {sql.UP}, {sql.DBS}, {sql.EDGES}, b AS (SELECT DISTINCT corpus_id, parent_no AS doc_no FROM edges WHERE collection IN ('scopes', 'articles', 'sections_and_primary_docs', 'agent_scope_database'))
SELECT d.corpus_id, d.doc_no, b.doc_no IS NOT NULL AS is_branch FROM docs d LEFT JOIN b USING (corpus_id, doc_no)""")
def leaf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keys(spark, sf_dir)
    return tree.leaves(docs, tree.edges(docs, keeper(spark, sf_dir))).select("corpus_id", "doc_no", "is_branch")


@query(f"""{with_docs()}, {sql.EMIT}
SELECT corpus_id, doc_no, last_value(CASE WHEN doc_type <> 'Needed Research' THEN doc_no END IGNORE NULLS) OVER (PARTITION BY corpus_id ORDER BY position) AS parent_no
FROM docs JOIN pos USING ({K}, doc_no) QUALIFY doc_type = 'Needed Research'""")
def nr_positional_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keys(spark, sf_dir)
    keep = keeper(spark, sf_dir)
    placed = tree.keyed(docs).join(tree.positions(docs, keep), [*KEYS, "doc_no"])
    return tree.attach_positional(placed, "position", keep=keep).select("corpus_id", "doc_no", "parent_no")


@query(f"""{with_docs()} SELECT n.corpus_id, n.doc_no, n.target_no, t.uuid AS target_uuid, row_number() OVER (PARTITION BY n.corpus_id, n.target_no ORDER BY CAST(substr(n.doc_no, 4) AS BIGINT)) AS nr_ord
FROM docs n LEFT JOIN docs t ON t.corpus_id = n.corpus_id AND t.doc_no = n.target_no WHERE n.doc_type = 'Needed Research'""")
def nr_target_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.attach_by_target(keys(spark, sf_dir)).select("corpus_id", "doc_no", "target_no", "target_uuid", "nr_ord")


@query(f"""{with_every(where="NOT (doc_type = 'Section' AND k % 5 = 0)")}
SELECT n.corpus_id, n.doc_no, n.target_no FROM docs n ANTI JOIN docs t ON t.corpus_id = n.corpus_id AND t.doc_no = n.target_no WHERE n.doc_type = 'Needed Research'""")
def orphan_nrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keys(spark, sf_dir).where("not (doc_type = 'Section' and k % 5 = 0)")
    return tree.attach_by_target(docs).where("orphan").select("corpus_id", "doc_no", "target_no")


@query(f"{with_docs()}, {sql.EMIT} SELECT corpus_id, doc_no, position FROM pos")
def preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.positions(keys(spark, sf_dir), keeper(spark, sf_dir)).select("corpus_id", "doc_no", "position")


@query(f"{with_docs()}, {sql.UP}, {sql.DBS}, {sql.EDGES}, {sql.PATHS} SELECT corpus_id, doc_no, row_number() OVER (PARTITION BY corpus_id ORDER BY key) AS position FROM tree")
def export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees flattened in order of export, research notes before other children."""
    return tree.flattened(keys(spark, sf_dir), keeper(spark, sf_dir)).select("corpus_id", "doc_no", "position")


@query(f"""{with_docs("dirty")}, {sql.UP}, {sql.DBS}, {sql.EDGES} SELECT corpus_id, parent_no, doc_no, parent_database, database, collection, sibling_ord FROM edges""")
def edges_of_faulty_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5, where parents have no uuid, numbers are malformed, and types are unknown."""
    return tree.edges(keys(spark, sf_dir, "dirty"), keeper(spark, sf_dir)).select("corpus_id", "parent_no", "doc_no", "parent_database", "database", "collection", "sibling_ord")


@query(f"""{with_every(where="NOT (doc_type IN ('Section', 'Article') AND k % 5 = 0) AND NOT (doc_type = 'Article' AND length(name) % 2 = 0)")}, {sql.UP}, {sql.DBS}, {sql.EDGES} SELECT corpus_id, parent_no, doc_no, collection FROM edges""")
def edges_over_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5, after sections and articles are taken away: what they held hangs on what is above them."""
    docs = keys(spark, sf_dir).where("not (doc_type in ('Section', 'Article') and k % 5 = 0) and not (doc_type = 'Article' and length(name) % 2 = 0)")
    return tree.edges(docs, keeper(spark, sf_dir)).select("corpus_id", "parent_no", "doc_no", "collection")


@query(f"""{with_docs()}, {sql.UP}, {sql.DBS}, {sql.EDGES} SELECT corpus_id, 'primary' AS view, parent_no, doc_no, collection,
  row_number() OVER (PARTITION BY corpus_id, parent_no ORDER BY {sql.SIBLING}, doc_no) AS place FROM edges WHERE collection IN ('scopes', 'articles', 'sections_and_primary_docs', 'agent_scope_database')
UNION ALL SELECT corpus_id, 'supporting', parent_no, doc_no, collection, CAST(label_ord AS BIGINT) FROM edges JOIN {sql.values([(c, i + 1) for i, c in enumerate(tree.schema.SUPPORTING_LABELS)], 'collection, label_ord')} s USING (collection)""")
def navigation_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children in navigation, and supporting documents with the order of their kind."""
    found = tree.edges(keys(spark, sf_dir), keeper(spark, sf_dir))
    one = lambda rows, name, place: rows.select("corpus_id", F.lit(name).alias("view"), "parent_no", "doc_no", "collection", F.col(place).cast("long").alias("place"))
    return one(tree.primary_view(found), "primary", "place").unionByName(one(tree.supporting_view(found), "supporting", "label_ord"))


@query(f"""{with_docs("dirty")}, {sql.EMIT}, {sql.LAST_UUID} SELECT corpus_id, uuid, doc_no FROM last_uuid""")
def last_number_of_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which number a uuid stands for, the last in reading order where several documents have it."""
    docs = keys(spark, sf_dir, "dirty")
    placed = docs.join(tree.emit_keys(docs, keeper(spark, sf_dir)), [*KEYS, "doc_no"])
    return tree.last_wins(placed.withColumn("place", F.struct("key", "doc_no")), "uuid", "doc_no", "place").select("corpus_id", "uuid", "doc_no")


@query(rf"""{with_docs()}, c AS (SELECT corpus_id, doc_no, regexp_extract_all(regexp_replace(doc_no, '^[A-Za-z]+\.', ''), '\d+|\D+') AS c FROM docs)
SELECT corpus_id, doc_no, row_number() OVER (PARTITION BY corpus_id ORDER BY list_transform(c, lambda x: {{'k': CASE WHEN regexp_matches(x, '^\d') THEN 1 WHEN regexp_matches(x, '^[A-Za-z]') THEN 2 ELSE 0 END,
  'n': {{'l': length(ltrim(regexp_extract(x, '^\d+'), '0')), 'd': ltrim(regexp_extract(x, '^\d+'), '0')}}, 's': CASE WHEN regexp_matches(x, '^\d') THEN '' ELSE lower(x) END}}), doc_no) AS place FROM c""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in natural order, one window for each corpus."""
    order = tree.Window.partitionBy("corpus_id").orderBy(numbers.natural_key("doc_no").asc_nulls_last(), "doc_no")
    return numbered(spark, sf_dir).select("corpus_id", "doc_no", F.row_number().over(order).cast("long").alias("place"))


@query(f"""{with_docs()} SELECT corpus_id, doc_no, row_number() OVER (PARTITION BY corpus_id ORDER BY {sql.SIBLING.replace("regexp_replace(doc_no, '^NR-', 'NR.')", 'doc_no')}, doc_no) AS place FROM docs""")
def segment_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = tree.Window.partitionBy("corpus_id").orderBy(numbers.segment_key("doc_no"), "doc_no")
    return numbered(spark, sf_dir).select("corpus_id", "doc_no", F.row_number().over(order).cast("long").alias("place"))


@query(f"""{with_docs()}, {sql.UP}, {sql.CHAIN}, n AS (SELECT d.corpus_id, d.doc_no, least(6, 1 + count(anc.doc_no)) AS level FROM docs d LEFT JOIN anc USING (corpus_id, doc_no) WHERE d.doc_type <> 'Needed Research' GROUP BY 1, 2)
SELECT * FROM n UNION ALL SELECT c.corpus_id, c.doc_no, least(6, coalesce(n.level, 0) + len(c.chain)) FROM chain c LEFT JOIN n ON n.corpus_id = c.corpus_id AND n.doc_no = c.root_no""")
def structural_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.structural_levels(keys(spark, sf_dir)).select("corpus_id", "doc_no", "level")


_FAMILY = "CASE WHEN doc_type IN ('Annotation', 'Action Tenet', 'Scenario', 'Scenario Variation', 'Active Data') THEN doc_type ELSE 'primary' END"


@query(f"""{with_docs()}, {sql.UP}, p AS (SELECT *, {sql.PARENT} AS pn, {_FAMILY} AS fam FROM docs WHERE doc_type <> 'Needed Research'),
t AS (SELECT corpus_id, doc_no, coalesce(MAP {{'Annotation': '.0.3.', 'Action Tenet': '.0.4.', 'Scenario': '.1.', 'Scenario Variation': '.var', 'Active Data': '.0.6.'}}[fam], '.')
  || CAST(row_number() OVER (PARTITION BY corpus_id, pn, fam ORDER BY {sql.SIBLING}) - CASE WHEN pn IS NULL THEN 1 ELSE 0 END AS VARCHAR) AS tail FROM p),
u AS (SELECT anc.corpus_id, anc.doc_no, distance, tail FROM anc JOIN t ON t.corpus_id = anc.corpus_id AND t.doc_no = anc.ancestor_no UNION ALL SELECT corpus_id, doc_no, 0, tail FROM t)
SELECT corpus_id, doc_no, 'A' || string_agg(tail, '' ORDER BY distance DESC) AS new_no FROM u GROUP BY 1, 2
UNION ALL SELECT corpus_id, doc_no, 'NR-' || CAST(row_number() OVER (PARTITION BY corpus_id ORDER BY CAST(substr(doc_no, 4) AS BIGINT)) AS VARCHAR) FROM docs WHERE doc_type = 'Needed Research'""")
def assigned_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.assign_numbers(keys(spark, sf_dir)).select("corpus_id", "doc_no", "new_no")


@query(f"""{with_every(where="NOT (k >= 0 AND k % 7 = 0)")},
s AS (SELECT corpus_id, doc_no, {sql.PARENT} AS pn, {_FAMILY} AS fam, doc_type, CAST(regexp_extract(doc_no, '(\\d+)$', 1) AS BIGINT) AS n FROM docs WHERE doc_type <> 'Needed Research'),
b AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY corpus_id, pn, fam ORDER BY n, doc_no), CASE WHEN doc_type = 'Scope' THEN -1 ELSE 0 END) AS before FROM s)
SELECT corpus_id, doc_no, n, before FROM b WHERE n <> before + 1""")
def sibling_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = numbered(spark, sf_dir).where("not (k >= 0 and k % 7 = 0)")
    return tree.sibling_gaps(docs).select("corpus_id", "doc_no", "n", "before")
