"""Nested JSON of whole trees: written in one walk from tables, read level by level into rows, and checked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctree import schema
from doctree.operators import tree
from doctree.session import written
from doctree.sources import atoms

KEYS = list(schema.KEYS)
BASE = ("type", "doc_no", "name", "uuid", "content")


def trees(docs: DataFrame) -> DataFrame:
    """(corpus_id, version_id, root_no, json), one nested object for each root.

    Documents stand in order of export. What opens a node (a comma, or its collection's name and bracket) and what closes
    it and those above it follows from its neighbours' depths, so every body is read and moved once, whatever the
    depth. Extra fields of a body stand as fields of their own.
    """
    keys = tree.tree_keys(docs, tree.edges(docs))
    walk = Window.partitionBy(*KEYS, "root_no").orderBy("key", "doc_no")
    depth, last = F.size("key"), F.element_at("key", -1)
    after = F.coalesce(F.lead(depth).over(walk), F.lit(0))
    # A second collection follows the end of the one before, however deep the nodes between were.
    first = F.when(F.lag(depth).over(walk) >= depth, F.concat(F.lit('],"'), last["collection"], F.lit('":['))).otherwise(F.concat(F.lit(',"'), last["collection"], F.lit('":[')))
    opening = F.when(depth == 0, "").when(last["o"] == 1, first).otherwise(",")
    closing = F.when(after > depth, "").otherwise(F.concat(F.lit("}"), F.repeat(F.lit("]}"), depth - after)))
    closing = F.when(F.lead(depth).over(walk).isNull(), F.concat(F.lit("}"), F.repeat(F.lit("]}"), depth))).otherwise(closing)
    frame = keys.withColumns({"at": F.row_number().over(walk), "opening": opening, "closing": closing})
    full = atoms.extras(docs.withColumn("body", F.coalesce("body", F.lit(""))))
    own = F.to_json(F.struct(F.col("doc_type").alias("type"), "doc_no", "name", "uuid", "content"), {"ignoreNullFields": "false"})
    more = F.when(F.size("extras") > 0, F.concat(F.lit(","), F.substring(F.to_json("extras"), F.lit(2), F.length(F.to_json("extras")) - 2))).otherwise("")
    own = F.concat(F.substring(own, F.lit(1), F.length(own) - 1), more)
    pieces = frame.join(full.select(*KEYS, "doc_no", own.alias("own")), [*KEYS, "doc_no"])
    packed = pieces.groupBy(*KEYS, "root_no").agg(F.array_sort(F.collect_list(F.struct("at", F.concat("opening", "own", "closing").alias("piece")))).alias("p"))
    return packed.select(*KEYS, "root_no", F.array_join("p.piece", "").alias("json"))


def write(docs: DataFrame) -> DataFrame:
    """(corpus_id, version_id, json), an array of all trees of a corpus version; see :func:`trees` for large ones."""
    roots = trees(docs).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(tree.sibling_key("root_no").alias("o"), "root_no", "json"))).alias("r"))
    return roots.select(*KEYS, F.concat(F.lit("["), F.array_join("r.json", ","), F.lit("]")).alias("json"))


def _kind(v: Column) -> Column:
    """object, array, string, null or another scalar type."""
    s = F.lower(F.schema_of_variant(v))
    return F.when(s.startswith("object"), "object").when(s.startswith("array"), "array").when(s == "string", "string").when(s == "void", "null").otherwise(s)


def read(raw: DataFrame) -> DataFrame:
    """One row for each node of ``raw`` (corpus_id, version_id, json): path, parent_path, database, collection, node (a variant).

    Wrong types survive, as nodes stay variants. ``database`` is that of the collection a node stands in, null for roots.
    Levels are read until none has children, however deep the trees are: one narrow step each.
    """
    value = F.try_parse_json("json")
    top = raw.select(*KEYS, value.alias("v")).where(F.col("v").isNotNull() & (_kind(F.col("v")) == "array"))
    null = F.lit(None).cast("string")
    level = top.select(*KEYS, F.posexplode(F.variant_get("v", "$", "array<variant>")).alias("i", "node")).select(
        *KEYS, F.concat(F.lit("$."), F.col("i").cast("string")).alias("path"), null.alias("parent_path"), null.alias("collection"), "i", "node"
    )
    out: list[DataFrame] = []
    while True:
        level = written(level.withColumn("node_json", F.to_json("node")).drop("node"), f"level{len(out)}").withColumn("node", F.parse_json("node_json")).drop("node_json")
        out.append(level)
        if level.isEmpty():
            break
        known = F.try_variant_get("node", "$.type", "string").isin(*schema.TYPE_DATABASE)
        arrays = F.array(*(F.struct(F.lit(c).alias("c"), F.try_variant_get("node", f"$.{c}", "array<variant>").alias("a")) for c in schema.COLLECTIONS))
        each = level.where((_kind(F.col("node")) == "object") & F.coalesce(known, F.lit(False))).select(*KEYS, F.col("path").alias("parent_path"), F.explode(arrays).alias("s"))
        kids = each.where(F.col("s.a").isNotNull()).select(*KEYS, "parent_path", F.col("s.c").alias("collection"), F.posexplode("s.a").alias("i", "node"))
        level = kids.select(*KEYS, F.concat_ws(".", "parent_path", "collection", F.col("i").cast("string")).alias("path"), "parent_path", "collection", "i", "node")
    database = F.create_map(*(F.lit(x) for pair in schema.COLLECTIONS.items() for x in pair))
    return reduce(DataFrame.unionByName, out).withColumn("database", database[F.col("collection")])


def issues(raw: DataFrame) -> DataFrame:
    """(rule_id, path, detail) of what is wrong with texts and nodes. All rules of a node are one pass over it.

    Which child collections a node may have follows from the database of the collection that it stands in; roots have
    none, so any goes there. K13: a child whose type belongs to another database than its collection.
    """
    texts = raw.select(*KEYS, F.try_parse_json("json").alias("v"))
    rule = F.when(F.col("v").isNull(), "K1").when(_kind(F.col("v")) != "array", "K2")
    whole = texts.select(*KEYS, rule.alias("rule_id"), F.lit("$").alias("path"), F.lit("").alias("detail")).where("rule_id is not null")
    one = lambda rule_id, path, detail: F.struct(F.lit(rule_id).alias("rule_id"), path.alias("path"), detail.alias("detail"))
    path, none = F.col("path"), F.lit("")
    nodes = read(raw).withColumn("kind", _kind(F.col("node"))).withColumn("type", F.try_variant_get("node", "$.type", "string"))
    nodes = nodes.withColumn("keys", F.when(F.col("kind") == "object", F.json_object_keys(F.to_json("node"))))
    known = F.col("type").isin(*schema.TYPE_DATABASE)
    kind_of = lambda c: _kind(F.try_variant_get("node", f"$.{c}", "variant"))
    has = lambda c: F.array_contains("keys", c)
    missing = F.transform(F.array_except(F.array(*(F.lit(b) for b in BASE)), "keys"), lambda x: one("K6", path, x))
    fields = {"doc_no": ("string",), "name": ("string",), "uuid": ("string", "null"), "content": ("string",)}
    typed = [F.when(has(c) & ~kind_of(c).isin(*kinds), one("K7", path, F.lit(c))) for c, kinds in fields.items()]
    extra_of = F.create_map(*(x for t, f in schema.EXTRA_FIELDS.items() for x in (F.lit(t), F.array(*(F.lit(k) for k in f)))))
    own_extras = F.coalesce(extra_of[F.col("type")], F.array().cast("array<string>"))
    extras = sorted({k for f in schema.EXTRA_FIELDS.values() for k in f})
    bad_extra = [F.when(F.array_contains(own_extras, c) & has(c) & ~kind_of(c).isin("string", "null"), one("K8", path, F.lit(c))) for c in extras]
    collections = F.array(*(F.lit(c) for c in schema.COLLECTIONS))
    allowed = F.concat(F.array(*(F.lit(b) for b in BASE)), own_extras, collections)
    unexpected = F.transform(F.array_except("keys", allowed), lambda x: one("K9", path, x))
    may = F.create_map(*(x for db, f in schema.ALLOWED_COLLECTIONS.items() for x in (F.lit(db), F.array(*(F.lit(c) for c in f)).cast("array<string>"))))
    held = F.array_intersect("keys", collections)
    forbidden = F.when(F.col("database").isNotNull(), F.transform(F.array_except(held, may[F.col("database")]), lambda x: one("K10", path, x)))
    no_array = [F.when(has(c) & (kind_of(c) != "array"), one("K11", F.concat_ws(".", path, F.lit(c)), F.lit(c))) for c in schema.COLLECTIONS]
    type_database = F.create_map(*(F.lit(x) for pair in schema.TYPE_DATABASE.items() for x in pair))
    agent = F.col("database").eqNullSafe(F.lit(schema.AGENT_DATABASE)) & F.col("type").isin("Core", "Active Data Controller")
    other = F.when(F.col("database").isNotNull() & ~agent & (type_database[F.col("type")] != F.col("database")), one("K13", path, F.col("type")))
    empty = F.array().cast("array<struct<rule_id:string,path:string,detail:string>>")
    good = F.concat(missing, F.array_compact(F.array(*typed, *bad_extra, *no_array, other)), unexpected, F.coalesce(forbidden, empty))
    no_object = F.when(F.col("parent_path").isNull(), one("K3", path, none)).otherwise(one("K12", path, none))
    found = (
        F.when(F.col("kind") != "object", F.array(no_object))
        .when(F.col("type").isNull(), F.array(one("K4", path, none)))
        .when(~known, F.array(one("K5", path, F.col("type"))))
        .otherwise(good)
    )
    return whole.unionByName(nodes.select(*KEYS, F.explode(found).alias("i")).select(*KEYS, "i.*"))
