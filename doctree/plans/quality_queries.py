"""Queries of the validation rules, over the corpora with faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree import schema
from doctree.functions import text
from doctree.operators import order, quality, tree
from doctree.plans import sql
from doctree.plans.corpus import corpus, corpus_sql, digested, keeper, keys, streamed, with_docs
from doctree.plans.registry import query
from doctree.session import written
from doctree.sources import monolith

KEYS = tree.KEYS
K = sql.K
_parsed: dict[tuple[str, str], DataFrame] = {}
_lined: dict[tuple[str, str], DataFrame] = {}


def _fault(m: int) -> Column:
    return (F.col("k") >= 0) & (F.col("k") % m == 0)


def lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_no, uuid, note_level, line) of :func:`parsed`: lines are counted over keys and sizes, no body is shuffled or written for them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _lined:
        return _lined[key]
    keep, body = keeper(spark, sf_dir), F.coalesce("body", F.lit(""))
    docs = digested(spark, sf_dir, "dirty", {"n_feeds": F.length(body) - F.length(F.replace(body, F.lit("\n")))})
    # Faulty versions have repeated numbers, so positions come from the key and the uuid.
    among = keys(spark, sf_dir, "dirty")
    placed = tree.emit_keys(among.dropDuplicates([*KEYS, "doc_no"]), keep).join(monolith.noted_levels(among, keep), [*KEYS, "doc_no"], "left")
    n = F.col("n_feeds") + 3 + F.when(_fault(53), 0).when(_fault(59), 2).otherwise(1)
    sized = docs.select(*KEYS, "doc_no", "uuid", n.alias("n")).join(placed, [*KEYS, "doc_no"])
    ends = order.running(sized, KEYS, ["key", "doc_no", "uuid"], "n", "end", keep=keep)
    _lined[key] = keep(ends.select(*KEYS, "doc_no", "uuid", "note_level", (F.col("end") - F.col("n") + 1).alias("line")), "lined")
    return _lined[key]


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faulty corpora as parsed documents: some titles have a wrong level or one blank too few, some bodies too few or too many blank lines."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _parsed:
        return _parsed[key]
    docs, lines = corpus(spark, sf_dir, "dirty"), lined(spark, sf_dir)
    fault, body = _fault, F.coalesce("body", F.lit(""))
    found = docs.join(lines, [*KEYS, "doc_no", "uuid"]).withColumn("level", monolith.level_of() + F.when(fault(31), 1).otherwise(0))
    title = text.heading_line(F.col("level"), F.col("doc_no"), F.col("name"), F.col("doc_type"), F.col("uuid"))
    title = F.when(fault(61), F.replace(title, F.lit("  <!--"), F.lit(" <!--"))).otherwise(title)
    blank = F.when(fault(53), "").when(fault(59), "\n\n").otherwise("\n")
    rows = F.split(F.concat(blank, body, F.lit("\n")), "\n")
    _parsed[key] = written(found.select(*KEYS, "doc_no", "doc_type", "name", "uuid", "target_no", "level", title.alias("title"), rows.alias("rows"), "line"), "parsed")
    return _parsed[key]


_PARSED = f"""{with_docs('dirty')}, {sql.LEV}, {sql.EMIT_KEYS},
one AS (SELECT DISTINCT ON ({K}, doc_no) {K}, doc_no, key FROM akey),
par0 AS (SELECT {', '.join('lev.' + c for c in (*KEYS, 'doc_no', 'doc_type', 'name', 'uuid', 'target_no'))}, one.key, level + CASE WHEN k >= 0 AND k % 31 = 0 THEN 1 ELSE 0 END AS level, k,
  string_split(CASE WHEN k >= 0 AND k % 53 = 0 THEN '' WHEN k >= 0 AND k % 59 = 0 THEN chr(10) || chr(10) ELSE chr(10) END || coalesce(body, '') || chr(10), chr(10)) AS rows FROM lev JOIN one USING ({K}, doc_no)),
par AS MATERIALIZED (SELECT *, CAST(sum(1 + len(rows)) OVER (PARTITION BY {K} ORDER BY key, doc_no, uuid) - len(rows) AS BIGINT) AS line FROM par0),
good AS (SELECT * FROM par WHERE NOT (k >= 0 AND k % 61 = 0))"""
_OUT = ["corpus_id", "rule_id", "line", "doc_no", "detail"]
_KNOWN = "(" + ", ".join(f"'{t}'" for t in schema.TYPE_DATABASE) + ")"
_SQL: dict[str, str] = {
    "issues_title": "SELECT corpus_id, 'V1' AS rule_id, line, doc_no, '' AS detail FROM par WHERE k >= 0 AND k % 61 = 0",
    "issues_level": f"""SELECT corpus_id, 'V2' AS rule_id, line, doc_no, '' AS detail FROM good WHERE doc_type NOT IN {_KNOWN} UNION ALL SELECT corpus_id, 'V3', line, doc_no, '' FROM good WHERE level > 6
UNION ALL SELECT corpus_id, 'V4', line, doc_no, CAST(w AS VARCHAR) FROM (SELECT g.*, CASE WHEN doc_type = 'Needed Research' THEN coalesce(least(6, 1 + (SELECT arg_max(p.level, p.line) FROM good p WHERE p.corpus_id = g.corpus_id AND p.line < g.line AND p.level < g.level)), 6)
  ELSE least(6, greatest(1, {sql.DEPTH})) END AS w FROM good g) WHERE level <> w""",
    "issues_parent": f"""SELECT corpus_id, 'V5' AS rule_id, line, doc_no, pn AS detail FROM (SELECT g.*, {sql.PARENT} AS pn, min(line) OVER (PARTITION BY corpus_id) AS f FROM good g) c
WHERE pn IS NOT NULL AND line > f AND NOT EXISTS (SELECT 1 FROM good p WHERE p.corpus_id = c.corpus_id AND p.doc_no = c.pn AND p.line < c.line)""",
    "issues_nesting": f"""SELECT corpus_id, 'V20' AS rule_id, line, doc_no, pt || ' > ' || doc_type AS detail FROM (
SELECT c.corpus_id, c.line, c.doc_no, c.doc_type, arg_max(p.doc_type, p.line) AS pt FROM (SELECT *, {sql.PARENT} AS pn FROM good) c JOIN good p ON p.corpus_id = c.corpus_id AND p.doc_no = c.pn AND p.line < c.line GROUP BY 1, 2, 3, 4)
WHERE pt IN {_KNOWN} AND doc_type IN {_KNOWN} AND doc_type <> 'Needed Research' AND (pt, doc_type) NOT IN {sql.values([(p, c) for p, f in schema.ALLOWED_NESTING.items() for c in f], 'p, c')}""",
    "issues_blank": r"""SELECT corpus_id, 'V6' AS rule_id, line + 1 AS line, doc_no, '' AS detail FROM good WHERE regexp_matches(rows[1], '\S')
UNION ALL SELECT corpus_id, 'V7', line + 2, doc_no, '' FROM good WHERE NOT regexp_matches(rows[1], '\S') AND len(rows) > 2 AND NOT regexp_matches(rows[2], '\S')""",
    "issues_extras": f"""SELECT corpus_id, rule_id, line, doc_no, detail FROM (WITH need AS (SELECT doc_type, list(label ORDER BY o) AS need FROM {sql.values([(t, v, i) for t, f in schema.EXTRA_FIELDS.items() for i, v in enumerate(f.values())], 'doc_type, label, o')} GROUP BY 1),
  r AS (SELECT good.*, need, unnest(rows) AS x, generate_subscripts(rows, 1) AS i FROM good JOIN need USING (doc_type)),
  lb AS (SELECT *, regexp_extract(x, '^\\*\\*(.+?)\\*\\*:\\s*$', 1) AS label FROM r),
  ag AS (SELECT corpus_id, line, doc_no, any_value(need) AS need, list(label ORDER BY i) FILTER (label <> '') AS all_labels FROM lb GROUP BY 1, 2, 3),
  ag2 AS (SELECT *, list_filter(coalesce(all_labels, []), lambda y: list_contains(need, y)) AS act FROM ag)
  SELECT corpus_id, 'V8' AS rule_id, line + i AS line, doc_no, label AS detail FROM lb WHERE label <> '' AND NOT list_contains(need, label)
  UNION ALL SELECT corpus_id, 'V9', line + i + 1, doc_no, label FROM lb WHERE label <> '' AND i < len(rows) AND regexp_matches(rows[i + 1], '\\S')
  UNION ALL SELECT corpus_id, 'V10', line, doc_no, array_to_string(act, ', ') FROM ag2 WHERE act <> list_filter(need, lambda y: list_contains(act, y))
  UNION ALL SELECT corpus_id, 'V11', line, doc_no, unnest(list_filter(need, lambda y: NOT list_contains(coalesce(all_labels, []), y))) FROM ag2)""",
    "issues_number": r"""SELECT corpus_id, rule_id, line, doc_no, '' AS detail FROM (SELECT *, CASE WHEN doc_type = 'Needed Research' THEN CASE WHEN NOT regexp_matches(doc_no, '^NR-\d+$') THEN 'V12' END WHEN doc_no NOT LIKE 'A.%' THEN 'V13'
  WHEN doc_type IN ('Core', 'Type Specification', 'Active Data Controller') THEN CASE WHEN regexp_matches(regexp_replace(doc_no, '^A\.0\.', 'A.x.'), '\.0\.') THEN 'V14' END
  WHEN doc_type = 'Annotation' THEN CASE WHEN NOT regexp_matches(doc_no, '\.0\.3\.\d+$') THEN 'V15' END WHEN doc_type = 'Action Tenet' THEN CASE WHEN NOT regexp_matches(doc_no, '\.0\.4\.\d+$') THEN 'V16' END
  WHEN doc_type = 'Scenario' THEN CASE WHEN NOT regexp_matches(doc_no, '\.1\.\d+$') THEN 'V17' END WHEN doc_type = 'Scenario Variation' THEN CASE WHEN NOT regexp_matches(doc_no, '\.var\d+$') THEN 'V18' END
  WHEN doc_type = 'Active Data' THEN CASE WHEN NOT regexp_matches(doc_no, '\.0\.6\.\d+$') THEN 'V19' END END AS rule_id FROM good) WHERE rule_id IS NOT NULL""",
    "issues_uuid": rf"""SELECT corpus_id, 'V21' AS rule_id, line, doc_no, '' AS detail FROM good WHERE coalesce(uuid, '') = ''
UNION ALL SELECT corpus_id, 'V22', line, doc_no, uuid FROM good WHERE uuid <> '' AND NOT regexp_full_match(uuid, '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}')
UNION ALL SELECT corpus_id, 'V23', line, doc_no, CAST(f AS VARCHAR) FROM (SELECT *, min(line) OVER (PARTITION BY {K}, uuid) AS f FROM good WHERE regexp_full_match(uuid, '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}')) WHERE line > f""",
}
_ALL = " UNION ALL ".join(f"SELECT * FROM ({q})" for q in _SQL.values())


def _rule(name: str):
    return query(f"{_PARSED} {_SQL[name]}")


def _rows(spark: SparkSession, sf_dir: str, *rules: str) -> DataFrame:
    return quality.row_rules(parsed(spark, sf_dir)).where(F.col("rule_id").isin(*rules)).select(*_OUT)


@_rule("issues_title")
def issues_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "V1")


@_rule("issues_level")
def issues_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = quality.note_levels(quality.titles(parsed(spark, sf_dir)))
    return _rows(spark, sf_dir, "V2", "V3", "V4").unionByName(notes.select(*_OUT))


@_rule("issues_parent")
def issues_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.parent_rules(quality.titles(parsed(spark, sf_dir))).where("rule_id = 'V5'").select(*_OUT)


@_rule("issues_nesting")
def issues_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.parent_rules(quality.titles(parsed(spark, sf_dir))).where("rule_id = 'V20'").select(*_OUT)


@_rule("issues_blank")
def issues_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "V6", "V7")


@_rule("issues_extras")
def issues_extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "V8", "V9", "V10", "V11")


@_rule("issues_number")
def issues_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, *(f"V{k}" for k in range(12, 20)))


@_rule("issues_uuid")
def issues_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, "V21", "V22").unionByName(quality.repeated_uuids(quality.titles(parsed(spark, sf_dir))).select(*_OUT))


@query(f"{_PARSED}, every AS ({_ALL}) SELECT corpus_id, rule_id, count(*) AS n, CASE WHEN rule_id = 'V21' THEN 'warning' ELSE 'error' END AS severity, min(line) AS first_line FROM every GROUP BY 1, 2")
def issues_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.issues(parsed(spark, sf_dir))
    return found.groupBy("corpus_id", "rule_id", "severity").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


@query(f"{_PARSED}, every AS ({_ALL}) SELECT corpus_id, count(*) FILTER (rule_id <> 'V21') AS errors, count(*) FILTER (rule_id = 'V21') AS warnings, count(*) FILTER (rule_id <> 'V21') = 0 AS passed FROM every GROUP BY 1")
def issue_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdict(quality.issues(parsed(spark, sf_dir))).select("corpus_id", "errors", "warnings", "passed")


@query(f"""{_PARSED}, every AS ({_ALL}), sup AS (SELECT corpus_id, doc_no, line AS t, len(rows) AS n FROM par WHERE uuid IN (SELECT uuid FROM docs WHERE doc_type = 'Section')),
named AS (
  SELECT DISTINCT corpus_id, line FROM (SELECT corpus_id, line + i AS line, unnest(regexp_extract_all(x, '[0-9a-f]{{8}}(?:-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}')) AS u FROM (SELECT corpus_id, line, unnest(rows) AS x, generate_subscripts(rows, 1) AS i FROM par))
  WHERE u IN (SELECT uuid FROM docs WHERE doc_type = 'Section'))
SELECT corpus_id, rule_id, count(*) AS n FROM every e WHERE NOT EXISTS (SELECT 1 FROM sup WHERE sup.corpus_id = e.corpus_id AND e.line BETWEEN t AND t + n)
  AND NOT EXISTS (SELECT 1 FROM named WHERE named.corpus_id = e.corpus_id AND named.line = e.line) GROUP BY 1, 2""")
def issues_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12, V24, with the sections' uuids as the list to suppress."""
    docs = parsed(spark, sf_dir)
    uuids = streamed(spark, sf_dir, "dirty").where("doc_type = 'Section'")
    return quality.suppress(quality.issues(docs), docs, uuids).groupBy("corpus_id", "rule_id").agg(F.count("*").alias("n"))


@query(f"""{_PARSED}, every AS ({_ALL}) SELECT corpus_id, rule_id, line, doc_no, detail, row_number() OVER (PARTITION BY corpus_id ORDER BY line, CAST(substr(rule_id, 2) AS INTEGER), doc_no, detail) AS place FROM every""")
def issues_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O6."""
    return quality.ordered(quality.issues(parsed(spark, sf_dir))).select(*_OUT, "place")


#: Parsed documents of which some are gone, some have another's number, and some stand at the end.
_GONE = "doc_type = 'Scope' OR (doc_type = 'Article' AND length(name) % 2 = 0) OR (doc_type = 'Section' AND line % 13 = 0)"
_NUMBER = "CASE WHEN doc_type = 'Annotation' AND line % 50 = 0 THEN regexp_replace(doc_no, '[.]0[.]3[.][0-9]+$', '') ELSE doc_no END"
_LINE = "CASE WHEN doc_type IN ('Needed Research', 'Core') AND line % 3 = 0 THEN line + 100000 ELSE line END"


@query(f"""WITH RECURSIVE pd AS MATERIALIZED ({_PARSED} SELECT * FROM par),
docs AS MATERIALIZED (SELECT {K}, {_NUMBER} AS doc_no, doc_type, target_no, {_LINE} AS line FROM pd WHERE NOT ({_GONE})), {sql.EMIT},
noted AS (SELECT c.corpus_id, c.doc_no, p.doc_no AS root_no FROM chain c LEFT JOIN (SELECT DISTINCT corpus_id, doc_no FROM plain) p ON p.corpus_id = c.corpus_id AND p.doc_no = c.root_no),
pp AS (SELECT corpus_id, doc_no, line, last_value(CASE WHEN doc_type <> 'Needed Research' THEN doc_no END IGNORE NULLS) OVER (PARTITION BY corpus_id ORDER BY line) AS parent_no, doc_type FROM docs),
pn AS (SELECT pp.*, root_no FROM pp JOIN noted USING (corpus_id, doc_no) WHERE doc_type = 'Needed Research'),
asked AS (SELECT corpus_id, doc_no, line, {sql.PARENT} AS parent_no FROM docs WHERE doc_type <> 'Needed Research'),
placed AS (SELECT d.corpus_id, d.doc_no, line, key, max(key) OVER (PARTITION BY d.corpus_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS furthest FROM docs d JOIN (SELECT DISTINCT * FROM akey) a USING ({K}, doc_no))
SELECT corpus_id, 'S1' AS rule_id, line, doc_no, CAST(f AS VARCHAR) AS detail FROM (SELECT *, min(line) OVER (PARTITION BY corpus_id, doc_no) AS f FROM docs) WHERE line > f
UNION ALL SELECT corpus_id, 'S2', line, doc_no, root_no FROM pn WHERE root_no IS NOT NULL AND parent_no IS DISTINCT FROM root_no
UNION ALL SELECT corpus_id, 'S3', line, doc_no, '' FROM pn WHERE root_no IS NULL
UNION ALL SELECT corpus_id, 'S3', line, doc_no, parent_no FROM asked a WHERE parent_no IS NOT NULL AND NOT EXISTS (SELECT 1 FROM plain p WHERE p.corpus_id = a.corpus_id AND starts_with(a.doc_no, p.doc_no || '.'))
UNION ALL SELECT corpus_id, 'S4', line, doc_no, '' FROM placed WHERE key < furthest""")
def structure_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique numbers, notes first, no orphans, documents in order."""
    docs = parsed(spark, sf_dir).where(f"not ({_GONE})").withColumns({"doc_no": F.expr(_NUMBER), "line": F.expr(_LINE)})
    return quality.structure_rules(docs).select(*_OUT)


@query(f"{_PARSED} SELECT corpus_id, doc_no, uuid, line, f AS first_line FROM (SELECT *, min(line) OVER (PARTITION BY {K}, uuid) AS f FROM par WHERE regexp_full_match(uuid, '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}')) WHERE line > f")
def duplicate_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_uuids(lined(spark, sf_dir)).select("corpus_id", "doc_no", "uuid", "line", "first_line")


@query(f"""{with_docs()}, b AS (SELECT corpus_id, doc_type, count(*) AS n_raw, count(*) FILTER (NOT (doc_type = 'Annotation' AND k % 7 = 0)) AS n_tree FROM docs GROUP BY 1, 2), t AS (SELECT * FROM b UNION ALL SELECT corpus_id, 'total', CAST(sum(n_raw) AS BIGINT), CAST(sum(n_tree) AS BIGINT) FROM b GROUP BY 1)
SELECT corpus_id, doc_type, n_raw, n_tree, n_raw = n_tree AND n_raw >= 1 AS agrees FROM t""")
def completeness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: the corpus against a tree that lost some annotations."""
    docs = keys(spark, sf_dir)
    return quality.completeness(docs, docs.where("not (doc_type = 'Annotation' and k % 7 = 0)"))


@query(f"""{with_docs()}, keep AS (SELECT corpus_id, doc_no FROM docs WHERE NOT (doc_type = 'Section' AND k % 5 = 0))

SELECT corpus_id, doc_no, doc_type FROM docs WHERE doc_type = 'Section' AND k % 5 = 0
UNION ALL SELECT d.corpus_id, d.doc_no, d.doc_type FROM docs d ANTI JOIN keep ON keep.corpus_id = d.corpus_id AND keep.doc_no = d.target_no WHERE d.doc_type = 'Needed Research'""")
def not_emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that do not hang on the tree once every fifth section is gone: those, and the notes on them."""
    docs = keys(spark, sf_dir)
    kept = docs.where("not (doc_type = 'Section' and k % 5 = 0)")
    notes = tree.attach_by_target(kept).where("not orphan").select(*KEYS, "doc_no")
    return quality.not_emitted(docs, kept.where("doc_type <> 'Needed Research'").select(*KEYS, "doc_no").unionByName(notes)).select("corpus_id", "doc_no", "doc_type")


@query(f"""{with_docs()}, {corpus_sql('head', 'h')} 
SELECT DISTINCT corpus_id, uuid, 'first' AS side FROM docs ANTI JOIN h USING (corpus_id, uuid) WHERE uuid <> ''
UNION ALL SELECT DISTINCT corpus_id, uuid, 'second' FROM h ANTI JOIN docs USING (corpus_id, uuid) WHERE uuid <> ''""")
def uuid_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.uuid_difference(keys(spark, sf_dir), keys(spark, sf_dir, "head"))
