"""Numbers and text functions against the cases that define them."""

import pytest
from pyspark.sql import functions as F

from doctree.functions import numbers, text


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "no,kind,parent,depth",
    [
        ("A.1", "Scope", None, 1),
        ("A.1.2", "Article", "A.1", 2),
        ("A.1.2.3", "Section", "A.1.2", 3),
        ("A.1.2.3.0.3.1", "Annotation", "A.1.2.3", 4),
        ("A.1.2.3.0.4.1", "Action Tenet", "A.1.2.3", 4),
        ("A.1.2.3.0.4.1.1.2", "Scenario", "A.1.2.3.0.4.1", 5),
        ("A.1.2.3.0.4.1.1.2.var1", "Scenario Variation", "A.1.2.3.0.4.1.1.2", 6),
        ("A.1.2.3.4.0.6.1", "Active Data", "A.1.2.3.4", 5),
        ("NR-5", "Needed Research", None, None),
        ("A.1.2.3.9", "Annotation", None, 4),
        ("A.1.2.3.4.5.6.7", "Core", "A.1.2.3.4.5.6", 7),
    ],
)
def test_parent_and_depth(spark, no, kind, parent, depth):
    frame = spark.createDataFrame([(no, kind)], "n string, t string")
    row = frame.select(numbers.parent_no("n", "t").alias("p"), numbers.semantic_depth("n", "t").alias("d"), numbers.heading_level("n", "t").alias("l")).first()
    assert (row.p, row.d) == (parent, depth)
    assert row.l == (6 if depth is None else min(6, max(1, depth)))


def test_prefixes_and_keys(spark):
    rows = ["A.1", "A.1.2", "A.1.10", "A.1.2.1", "A.1.var1", "A.2"]
    frame = spark.createDataFrame([(r,) for r in reversed(rows)], "n string")
    assert [r.n for r in frame.orderBy(numbers.segment_key("n")).collect()] == ["A.1", "A.1.2", "A.1.2.1", "A.1.10", "A.1.var1", "A.2"]
    got = {r.n: r.p for r in frame.select("n", numbers.prefixes("n").alias("p")).collect()}
    assert got["A.1.2.1"] == ["A", "A.1", "A.1.2"] and got["A.1"] == ["A"]


def test_natural_order(spark):
    frame = spark.createDataFrame([("A.1.10",), ("",), ("A.1.2",), ("B.1.2",), (None,), ("A.1",)], "n string")
    got = [r.n for r in frame.orderBy(numbers.natural_key("n").asc_nulls_last(), "n").collect()]
    assert got[:4] == ["A.1", "A.1.2", "B.1.2", "A.1.10"] and set(got[4:]) == {"", None}


@pytest.mark.parametrize(
    "function,given,want",
    [
        (text.normalized_content, "“a” • b", '"a" - b'),
        (text.trim_blank_lines, "\n  \n  x\n\n y \n \n", "  x\n\n y "),
        (text.trim_blank_lines, " \n ", ""),
        (text.trim_blank_lines, "x", "x"),
        (text.slugify, " Über -- A b/C! ", "ber-a-bc"),
        (text.safe_file_name, 'a/b:c*"d"', "a_b_c__d_"),
        (text.normalized_uuid, "8650A58401F845D6882BC14EAB9879C4", "8650a584-01f8-45d6-882b-c14eab9879c4"),
        (text.normalized_uuid, "nope", None),
        (text.uuid_lookup_key, "NoPe", "nope"),
        (text.yaml_quote, 'a "b" c\\d', '"a \\"b\\" c\\\\d"'),
        (text.yaml_unquote, '"a \\"b\\" c\\\\d"', 'a "b" c\\d'),
        (text.yaml_quote, "plain", "plain"),
        (text.parse_targets, "[ a, b ,]", ["a", "b"]),
        (text.parse_targets, "a, b", None),
        (text.parse_targets, "[]", []),
        (text.normalized_body, "see [A.1.2 - Name](u) and [**A.1 - N**](v) x", "see [Name](u) and [**N**](v) x"),
        (text.strip_links, "a [b](c) d", "a b d"),
        (text.label_group_key, "A–b  C", "a b c"),
        (text.list_markers, "◦ a\n • b", "- a\n - b"),
        (text.inline_code_repair, "`code\n`", "`code`"),
    ],
)
def test_text(spark, function, given, want):
    assert one(spark, function("a"), a=given) == want


def test_links_formulas_and_snippets(spark):
    links = one(spark, text.links("a"), a="[x](8650a584-01f8-45d6-882b-c14eab9879c4) [y](https://e.org) [z](#top)")
    assert [(x.text, x.kind) for x in links] == [("x", "uuid"), ("y", "external"), ("z", "other")]
    math = one(spark, text.math_spans("a"), a="costs $5 or $10, but $x+y$ and $$z$$")
    assert math.display == ["z"] and math.inline == ["x+y"]
    body = "a" * 100 + "needle" + "b" * 200
    cut = one(spark, text.snippet("a", "Needle", 150), a=body)
    assert cut.startswith("...") and cut.endswith("...") and "needle" in cut and len(cut) == 156
    assert one(spark, text.snippet("a", "Needle", 150), a="short") == "short"
    assert one(spark, text.highlights("a", "a.b"), a="A.B axb a.b") == 2
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_prefixes_of_odd_numbers_are_not_cut_out_of_segments(spark):
    rows = spark.createDataFrame([("A.1.2",), ("A",), ("",), ("A.",), (".A",), ("A..1",), (None,)], "n string")
    found = rows.select(numbers.prefixes("n").alias("p"), numbers.prefixes("n", own=True).alias("o"))
    assert [(r.p, r.o) for r in found.collect()] == [
        (["A", "A.1"], ["A", "A.1", "A.1.2"]), ([], ["A"]), ([], [""]), (["A"], ["A", "A."]), ([""], ["", ".A"]), (["A", "A."], ["A", "A.", "A..1"]), ([], [])
    ]
    assert "split(" not in found._jdf.queryExecution().executedPlan().toString()
