"""Validation rules as issue tables, and audits of completeness.

Rules read parsed documents: corpus_id, version_id, line (of the title), title, level, doc_no, name, doc_type,
uuid, and rows (the lines below the title). What a document shows by itself is judged in one pass, as an array of
issues; rules that look at other documents are equi-joins or windows. ``issues`` is their union.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctree import schema
from doctree.functions import numbers, text
from doctree.operators import order, ranges, tree
from doctree.session import written
from doctree.sources import monolith

KEYS = list(schema.KEYS)
WARNINGS = ("V21",)
LABEL = r"^\*\*(.+?)\*\*:\s*$"
_ISSUE = "array<struct<rule_id:string,line:bigint,detail:string>>"


def _issue(found: DataFrame, rule: str | Column, line: Column | None = None, detail: Column | None = None) -> DataFrame:
    rule_id = F.lit(rule) if isinstance(rule, str) else rule
    return found.select(*KEYS, rule_id.alias("rule_id"), (F.col("line") if line is None else line).cast("long").alias("line"), "doc_no", (F.lit("") if detail is None else detail).alias("detail"))


def titles(docs: DataFrame) -> DataFrame:
    """The documents whose title holds against the strict pattern; only these are judged by the other rules."""
    return docs.where(F.col("title").rlike(monolith.STRICT))


def _one(rule: str | Column, line: Column | None = None, detail: Column | None = None) -> Column:
    rule_id = F.lit(rule) if isinstance(rule, str) else rule
    return F.struct(rule_id.alias("rule_id"), (F.col("line") if line is None else line).cast("long").alias("line"), (F.lit("") if detail is None else detail).cast("string").alias("detail"))


def _number_rule() -> Column:
    """One rule at most for each document."""
    n, t = F.col("doc_no"), F.col("doc_type")
    return (
        F.when(t == "Needed Research", F.when(~n.rlike(r"^NR-\d+$"), "V12"))
        .when(~n.startswith("A."), "V13")
        .when(t.isin("Core", "Type Specification", "Active Data Controller"), F.when(n.rlike(r"(?<!^A)\.0\."), "V14"))
        .when(t == "Annotation", F.when(~n.rlike(r"\.0\.3\.\d+$"), "V15"))
        .when(t == "Action Tenet", F.when(~n.rlike(r"\.0\.4\.\d+$"), "V16"))
        .when(t == "Scenario", F.when(~n.rlike(r"\.1\.\d+$"), "V17"))
        .when(t == "Scenario Variation", F.when(~n.rlike(r"\.var\d+$"), "V18"))
        .when(t == "Active Data", F.when(~n.rlike(r"\.0\.6\.\d+$"), "V19"))
    )


def _label_rules() -> Column:
    """V8 to V11 on the types with extra fields: unknown labels, no blank line after one, wrong order, missing ones."""
    needs = F.create_map(*(x for t, f in schema.EXTRA_FIELDS.items() for x in (F.lit(t), F.array(*(F.lit(v) for v in f.values())))))
    need = needs[F.col("doc_type")]
    labels = F.filter(F.transform("rows", lambda x, i: F.struct(i.alias("i"), F.regexp_extract(x, LABEL, 1).alias("label"), F.get("rows", i + 1).alias("after"))), lambda s: s["label"] != "")
    unknown = F.transform(F.filter(labels, lambda s: ~F.array_contains(need, s["label"])), lambda s: _one("V8", F.col("line") + s["i"] + 1, s["label"]))
    tight = F.transform(F.filter(labels, lambda s: s["after"].isNotNull() & ~text.is_blank(s["after"])), lambda s: _one("V9", F.col("line") + s["i"] + 2, s["label"]))
    seen = F.transform(labels, lambda s: s["label"])
    actual = F.filter(seen, lambda x: F.array_contains(need, x))
    expected = F.filter(need, lambda x: F.array_contains(seen, x))
    sorting = F.when(actual != expected, F.array(_one("V10", None, F.array_join(actual, ", ")))).otherwise(F.array().cast(_ISSUE))
    gone = F.transform(F.filter(need, lambda x: ~F.array_contains(seen, x)), lambda x: _one("V11", None, x))
    return F.when(need.isNotNull(), F.concat(unknown, tight, sorting, gone)).otherwise(F.array().cast(_ISSUE))


def row_rules(docs: DataFrame) -> DataFrame:
    """V1 to V4 (but for notes), V6 to V19, V21, V22: what each document shows by itself, all in one pass."""
    strict = F.col("title").rlike(monolith.STRICT)
    looks = F.col("title").rlike(r"^#+\s") & F.contains("title", F.lit("UUID"))
    wanted = numbers.heading_level("doc_no", "doc_type")
    row = lambda i: F.get("rows", F.lit(i))
    u = F.coalesce("uuid", F.lit(""))
    single = F.array_compact(
        F.array(
            F.when(~F.col("doc_type").isin(*schema.TYPE_DATABASE), _one("V2")),
            F.when(F.col("level") > 6, _one("V3")),
            F.when((F.col("doc_type") != "Needed Research") & (F.col("level") != wanted), _one("V4", None, wanted)),
            F.when(row(0).isNotNull() & ~text.is_blank(row(0)), _one("V6", F.col("line") + 1)),
            F.when(text.is_blank(row(0)) & row(1).isNotNull() & text.is_blank(row(1)) & (F.size("rows") > 2), _one("V7", F.col("line") + 2)),
            F.when(_number_rule().isNotNull(), _one(_number_rule())),
            F.when(text.is_blank(u), _one("V21")),
            F.when(~text.is_blank(u) & ~text.valid_uuid(u), _one("V22", None, u)),
        )
    )
    bad = F.when(looks, F.array(_one("V1"))).otherwise(F.array().cast(_ISSUE))
    every = F.when(strict, F.concat(single, _label_rules())).otherwise(bad)
    return docs.select(*KEYS, "doc_no", F.explode(every).alias("i")).select(*KEYS, "i.rule_id", "i.line", "doc_no", "i.detail")


def shallower(docs: DataFrame, most: int = order.MOST_IN_TASK) -> DataFrame:
    """Each document with the level of the nearest earlier title of a smaller level. One carried value for each level that titles have, no self-join."""
    levels = [r[0] for r in docs.where("level is not null").select("level").distinct().orderBy("level").collect()][:-1]
    seen = {f"s{k}": F.when(F.col("level") == k, F.struct("line", "level")) for k in levels}
    if not seen:
        return docs.withColumn("above", F.lit(None).cast("int"))
    found = order.carried(docs, KEYS, ["line"], last=seen, most=most)
    none = F.lit(None).cast("struct<line:bigint,level:int>")
    nearest = F.greatest(none, none, *(F.when(F.col("level") > k, F.col(f"s{k}")) for k in levels))
    return found.withColumn("above", nearest["level"]).drop(*seen)


def note_levels(docs: DataFrame) -> DataFrame:
    """V4 for research notes: one level below the nearest shallower title before them."""
    found = shallower(docs.select(*KEYS, "line", "level", "doc_no", "doc_type")).where("doc_type = 'Needed Research'")
    found = found.withColumn("wanted", F.coalesce(F.least(F.lit(6), F.col("above") + 1), F.lit(6)))
    return _issue(found.where("level <> wanted"), "V4", detail=F.col("wanted").cast("string"))


def earlier_parents(docs: DataFrame) -> DataFrame:
    """Documents with a parent number, and the latest earlier document with that number (null: none)."""
    child = docs.withColumn("parent_no", numbers.parent_no("doc_no", "doc_type")).where(F.col("parent_no").isNotNull())
    # Occurrences of one number stand in one window with the children that ask for it: no range join.
    asks = child.select(*KEYS, F.col("parent_no").alias("no"), "line", "doc_no", "doc_type", F.lit(True).alias("ask"))
    has = docs.select(*KEYS, F.col("doc_no").alias("no"), "line", "doc_no", "doc_type", F.lit(False).alias("ask"))
    before = Window.partitionBy(*KEYS, "no").orderBy("line", F.col("ask").desc())
    found = asks.unionByName(has).withColumn("parent_type", F.last(F.when(~F.col("ask"), F.col("doc_type")), ignorenulls=True).over(before))
    return found.where("ask").drop("ask").withColumnRenamed("no", "parent_no")


def parent_rules(docs: DataFrame) -> DataFrame:
    """The parent must come earlier (but for the first document), and its type must allow the child's."""
    first = docs.groupBy(*KEYS).agg(F.min("line").alias("first_line"))
    found = earlier_parents(docs).join(first, KEYS)
    missing = _issue(found.where(F.col("parent_type").isNull() & (F.col("line") > F.col("first_line"))), "V5", detail=F.col("parent_no"))
    both_known = F.col("parent_type").isin(*schema.TYPE_DATABASE) & F.col("doc_type").isin(*schema.TYPE_DATABASE)
    allowed = schema.allowed_nesting(docs.sparkSession)
    pairs = found.where(both_known & (F.col("doc_type") != "Needed Research")).join(allowed, ["parent_type", "doc_type"], "left_anti")
    return missing.unionByName(_issue(pairs, "V20", detail=F.concat_ws(" > ", "parent_type", "doc_type")))


def repeated_uuids(docs: DataFrame) -> DataFrame:
    """The first occurrence of a uuid is fine."""
    return _issue(duplicate_uuids(docs), "V23", detail=F.col("first_line").cast("string"))


def duplicate_uuids(docs: DataFrame) -> DataFrame:
    """A3: later documents with the uuid of an earlier one, and that one's line. A joined minimum, so a uuid that a third of all rows share is no one task's window."""
    valid = docs.where(text.valid_uuid("uuid"))
    first = valid.groupBy(*KEYS, "uuid").agg(F.min("line").alias("first_line"))
    return valid.join(first, [*KEYS, "uuid"]).where("line > first_line")


def uuid_forms(docs: DataFrame) -> DataFrame:
    """uuids that have no normal form, with or without hyphens."""
    bad = docs.where((F.col("uuid") != "") & text.normalized_uuid("uuid").isNull())
    return _issue(bad, "F14", detail=F.col("uuid"))


def issues(docs: DataFrame) -> DataFrame:
    """All issues with severity."""
    # What the other rules need of the documents whose title holds; the strict pattern is matched once for all of them.
    good = written(titles(docs).select(*KEYS, "line", "level", "doc_no", "doc_type", "uuid"), "titles")
    rules = [row_rules(docs), *(rule(good) for rule in (note_levels, parent_rules, repeated_uuids))]
    return reduce(DataFrame.unionByName, rules).withColumn("severity", F.when(F.col("rule_id").isin(*WARNINGS), "warning").otherwise("error"))


def ordered(found: DataFrame) -> DataFrame:
    """Issues with place, their order in a corpus version: by line, then by rule, then by what they say."""
    by_rule = found.withColumn("rule_no", F.expr("cast(substr(rule_id, 2) as int)"))
    return order.placed(by_rule, KEYS, ["line", "rule_no", "doc_no", "detail"], "place").drop("rule_no")


def structure_rules(docs: DataFrame) -> DataFrame:
    """Rules of the numbering's description that the title rules don't have; ``docs`` also has target_no.

    S1: a number that an earlier document has. S2: a research note that does not follow what its targets lead to
    (other children stand between). S3: a note whose targets lead nowhere, or a document without any ancestor.
    S4: a document that stands behind one that should follow it. W6: gaps among siblings, which is not one of these, as
    :func:`tree.sibling_gaps`.
    """
    first = docs.groupBy(*KEYS, "doc_no").agg(F.min("line").alias("first_line"))
    again = _issue(docs.join(first, [*KEYS, "doc_no"]).where("line > first_line"), "S1", detail=F.col("first_line").cast("string"))
    noted = tree.notes(docs).select(*KEYS, "doc_no", "root_no")
    plain = docs.where("doc_type <> 'Needed Research'").select(*KEYS, F.col("doc_no").alias("root_no"), F.lit(True).alias("there")).distinct()
    noted = noted.join(plain, [*KEYS, "root_no"], "left").select(*KEYS, "doc_no", F.when(F.col("there"), F.col("root_no")).alias("root_no"))
    before = tree.attach_positional(docs.select(*KEYS, "doc_no", "doc_type", "line"), "line").select(*KEYS, "doc_no", "line", "parent_no")
    placed = before.join(noted, [*KEYS, "doc_no"])
    astray = _issue(placed.where("root_no is not null and (parent_no is null or parent_no <> root_no)"), "S2", detail=F.col("root_no"))
    lost = _issue(placed.where("root_no is null"), "S3")
    roots = docs.where("doc_type <> 'Needed Research'").select(*KEYS, "doc_no", "line", numbers.parent_no("doc_no", "doc_type").alias("parent_no")).where("parent_no is not null")
    known = tree.lineage_keys(docs).join(plain.select(*KEYS, F.col("root_no").alias("ancestor_no")), [*KEYS, "ancestor_no"], "left_semi").select(*KEYS, "doc_no").distinct()
    alone = _issue(roots.join(known, [*KEYS, "doc_no"], "left_anti"), "S3", detail=F.col("parent_no"))
    keyed = docs.select(*KEYS, "doc_no", "line").join(tree.emit_keys(docs).dropDuplicates([*KEYS, "doc_no"]), [*KEYS, "doc_no"])
    late = _issue(order.carried(keyed, KEYS, ["line", "doc_no"], greatest={"furthest": F.col("key")}).where("key < furthest"), "S4")
    return reduce(DataFrame.unionByName, [again, astray, lost, alone, late])


def suppress(found: DataFrame, docs: DataFrame, uuids: DataFrame) -> DataFrame:
    """Issues without those in the lines of documents whose uuid is in ``uuids`` (uuid), or on lines that name one.

    A document's lines run from its title to its last row, which has the line after a title too. Spans are covered by dyadic
    intervals, so this is an equi-join however long they are.
    """
    listed = uuids.select("uuid").distinct()
    span = docs.select(*KEYS, "uuid", F.col("line").alias("from_line"), (F.col("line") + F.size("rows") + 1).alias("after_line"))
    gone = span.join(listed, "uuid", "left_semi").drop("uuid")
    in_span = ranges.points_in(found.select(*KEYS, "line").distinct(), gone, KEYS, "line", "from_line", "after_line")
    lines = docs.select(*KEYS, "line", F.posexplode(F.concat(F.array("title"), "rows")).alias("at", "content"))
    named = lines.select(*KEYS, (F.col("line") + F.col("at")).alias("line"), F.explode(F.regexp_extract_all("content", F.lit(f"({text.UUID})"), F.lit(1))).alias("uuid"))
    on_line = named.join(listed, "uuid", "left_semi").select(*KEYS, "line")
    return found.join(in_span.unionByName(on_line).distinct(), [*KEYS, "line"], "left_anti").select(*found.columns)


def verdict(found: DataFrame) -> DataFrame:
    """Each corpus version's errors and warnings; it fails if it has an error."""
    return found.groupBy(*KEYS).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")).withColumn("passed", F.col("errors") == 0)


def completeness(raw: DataFrame, tree: DataFrame) -> DataFrame:
    """A1, A2, U4: documents by type on both sides, with totals, and whether they agree (and are there at all)."""
    count = lambda d, name: d.groupBy("corpus_id", "doc_type").agg(F.count("*").alias(name))
    both = count(raw, "n_raw").join(count(tree, "n_tree"), ["corpus_id", "doc_type"], "full_outer").na.fill(0)
    total = both.rollup("corpus_id", "doc_type").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_tree").alias("n_tree")).where(F.col("corpus_id").isNotNull())
    return total.select("corpus_id", F.coalesce("doc_type", F.lit("total")).alias("doc_type"), "n_raw", "n_tree", ((F.col("n_raw") == F.col("n_tree")) & (F.col("n_raw") >= 1)).alias("agrees"))


def not_emitted(docs: DataFrame, emitted: DataFrame) -> DataFrame:
    """Documents that the walk of the tree does not reach."""
    return docs.join(emitted.select(*KEYS, "doc_no"), [*KEYS, "doc_no"], "left_anti").select(*KEYS, "doc_no", "doc_type")


def uuid_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Uuids that are on one side only."""
    one = lambda x, y, side: x.select("corpus_id", "uuid").where("uuid <> ''").distinct().join(y.select("corpus_id", "uuid"), ["corpus_id", "uuid"], "left_anti").withColumn("side", F.lit(side))
    return one(a, b, "first").unionByName(one(b, a, "second"))
