"""Hierarchy operators over document tables: parents, ancestors, edges, paths, order.

Every operator takes and returns DataFrames keyed by corpus_id and version_id. Ancestors of a number are its
proper dotted prefixes, so lineage is an equi-join on exploded prefixes; only keys are exploded, never bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctree import schema
from doctree.functions import numbers
from doctree.operators import order
from doctree.operators.order import Keep
from doctree.session import written

KEYS = list(schema.KEYS)
# ``keep`` writes a step and reads it again. Documents that are dealt by corpus had better have their steps dealt alike.


def keyed(docs: DataFrame) -> DataFrame:
    """What hierarchy joins need of each document."""
    return docs.select(*KEYS, "doc_no", "doc_type", "name", "uuid")


def parents(docs: DataFrame) -> DataFrame:
    """Each document with parent_no by its type, and the parent's uuid and type (null: an orphan or a root)."""
    child = docs.withColumn("parent_no", numbers.parent_no("doc_no", "doc_type"))
    parent = keyed(docs).select(*KEYS, F.col("doc_no").alias("parent_no"), F.col("uuid").alias("parent_uuid"), F.col("doc_type").alias("parent_type"), F.col("name").alias("parent_name"))
    return child.join(parent, [*KEYS, "parent_no"], "left")


def lineage(docs: DataFrame) -> DataFrame:
    """(doc_no, ancestor_no, ancestor_uuid, distance) for each existing ancestor of each document."""
    up = docs.select(*KEYS, "doc_no", F.posexplode(numbers.prefixes("doc_no")).alias("at", "ancestor_no"), F.size(numbers.segments("doc_no")).alias("n"))
    there = docs.select(*KEYS, F.col("doc_no").alias("ancestor_no"), F.col("uuid").alias("ancestor_uuid"))
    return up.join(there, [*KEYS, "ancestor_no"]).select(*KEYS, "doc_no", "ancestor_no", "ancestor_uuid", (F.col("n") - F.col("at") - 1).alias("distance"))


def nearest_ancestor(docs: DataFrame) -> DataFrame:
    """Each document and its longest existing proper prefix that has a uuid (null if there is none)."""
    found = lineage(docs).where(F.col("ancestor_uuid").isNotNull() & (F.col("ancestor_uuid") != ""))
    best = found.groupBy(*KEYS, "doc_no").agg(F.min(F.struct("distance", "ancestor_no", "ancestor_uuid")).alias("b"))
    return docs.select(*KEYS, "doc_no").join(best.select(*KEYS, "doc_no", "b.ancestor_no", "b.ancestor_uuid"), [*KEYS, "doc_no"], "left")


def descendant_counts(docs: DataFrame) -> DataFrame:
    """The number of documents below each document that has some. Counts are combined before the shuffle."""
    return lineage(docs).groupBy(*KEYS, F.col("ancestor_no").alias("doc_no")).agg(F.count("*").alias("n_descendants"))


def attach_positional(docs: DataFrame, place: str, most: int = order.MOST_IN_TASK, keep: Keep = written) -> DataFrame:
    """Research notes with the number of the nearest document of another type before them, by ``place`` (a column). The number is carried from range to range in large corpora."""
    target = F.when(F.col("doc_type") != "Needed Research", F.col("doc_no"))
    found = order.carried(docs, KEYS, [place], last={"parent_no": target}, most=most, keep=keep)
    return found.where(F.col("doc_type") == "Needed Research")


def climbed(links: DataFrame, keep: Keep = written) -> DataFrame:
    """(node, top, steps) of ``links`` (node, up, steps, an array), each node once.

    ``top`` is the first node above that has no link of its own, and ``steps`` are those of all nodes on the way, from the
    top down. Jumps double, so a chain of a thousand links takes ten joins. A node on a circle or below one has a null
    top and its own steps.
    """
    has = links.select(*KEYS, F.col("node").alias("up"), F.lit(True).alias("more"))
    state = links.join(has, [*KEYS, "up"], "left").select(*KEYS, "node", "up", "steps", F.coalesce("more", F.lit(False)).alias("more"))
    state, rounds = keep(state, "climb0"), 0
    largest = state.groupBy(*KEYS).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    while 2**rounds <= largest and not state.where("more").isEmpty():
        ahead = state.select(*KEYS, F.col("node").alias("up"), F.col("up").alias("next"), F.col("steps").alias("before"), F.col("more").alias("further"))
        moved = state.where("more").join(ahead, [*KEYS, "up"])
        moved = moved.select(*KEYS, "node", F.col("next").alias("up"), F.concat("before", "steps").alias("steps"), F.col("further").alias("more"))
        rounds += 1
        state = keep(moved.unionByName(state.where("not more")), f"climb{rounds}")
    circle = F.slice("steps", -1, 1)
    return state.select(*KEYS, "node", F.when(~F.col("more"), F.col("up")).alias("top"), F.when(F.col("more"), circle).otherwise(F.col("steps")).alias("steps"))


def note_number(doc_no: str = "doc_no") -> Column:
    """Sort key of a research note's own number; that of 0 where it has none."""
    return numbers.value_key(F.regexp_extract(doc_no, r"^NR-(\d+)$", 1))


def notes(docs: DataFrame, keep: Keep = written) -> DataFrame:
    """Research notes with root_no, the number that their targets lead to, and chain, the sort keys of the notes on the way and their own.

    A note on a note leads where that one does; root_no need not exist. Notes that have each other as targets lead nowhere.
    """
    own = F.struct(F.lit(-1).alias("k"), note_number().alias("n"), F.col("doc_no").alias("s"))
    some = docs.where(F.col("doc_type") == "Needed Research").groupBy(*KEYS, "doc_no").agg(F.max("target_no").alias("target_no"))
    found = climbed(some.select(*KEYS, F.col("doc_no").alias("node"), F.col("target_no").alias("up"), F.array(own).alias("steps")), keep)
    return found.select(*KEYS, F.col("node").alias("doc_no"), F.col("top").alias("root_no"), F.col("steps").alias("chain"))


def attach_by_target(docs: DataFrame) -> DataFrame:
    """Research notes with target_uuid, in order of number at their target; a note whose target is missing is an orphan."""
    found = docs.where(F.col("doc_type") == "Needed Research").select(*KEYS, "doc_no", "uuid", "target_no")
    target = docs.groupBy(*KEYS, F.col("doc_no").alias("target_no")).agg(F.min(F.coalesce("uuid", F.lit(""))).alias("target_uuid"))
    rank = F.row_number().over(Window.partitionBy(*KEYS, "target_no").orderBy(note_number(), "doc_no"))
    return found.join(target, [*KEYS, "target_no"], "left").withColumn("nr_ord", rank).withColumn("orphan", F.col("target_uuid").isNull())


def agents(docs: DataFrame, root_name: str = schema.AGENT_ROOT_NAME) -> DataFrame:
    """H8: numbers of cores and controllers below a document of the given name: its children, and what such children have below."""
    seeds = docs.where(F.col("name") == root_name).select(*KEYS, F.col("doc_no").alias("ancestor_no"))
    some = docs.where(F.col("doc_type").isin("Core", "Active Data Controller"))
    return lineage_keys(some).join(seeds, [*KEYS, "ancestor_no"], "left_semi").select(*KEYS, "doc_no").distinct()


def lineage_keys(docs: DataFrame) -> DataFrame:
    """(doc_no, ancestor_no) for all proper prefixes, whether or not documents have them."""
    return docs.select(*KEYS, "doc_no", F.explode(numbers.prefixes("doc_no")).alias("ancestor_no"))


def databases(docs: DataFrame, root_name: str = schema.AGENT_ROOT_NAME) -> DataFrame:
    """The documents' keys with the database that each belongs to."""
    own = keyed(docs).join(schema.types(docs.sparkSession), "doc_type", "left")
    agent = agents(docs, root_name).withColumn("agent", F.lit(True))
    return own.join(agent, [*KEYS, "doc_no"], "left").withColumn("database", F.when(F.col("agent"), schema.AGENT_DATABASE).otherwise(F.col("database"))).drop("agent")


def edges(docs: DataFrame, keep: Keep = written) -> DataFrame:
    """parent_no, doc_no, collection and sibling order; a pair that no collection takes has a null collection.

    Parents come from numbers: the exact parent, with or without a uuid, or the nearest existing document above it where
    it is missing. A number without a parent's is a root. Research notes hang on the document that their targets lead to,
    as notes have no children.
    """
    # Written, as parents, children and what looks further up come of it.
    base = keep(databases(docs).select(*KEYS, "doc_no", "doc_type", "database"), "databases")
    plain = base.where(F.col("doc_type") != "Needed Research")
    parent = plain.groupBy(*KEYS, F.col("doc_no").alias("parent_no")).agg(F.min("database").alias("parent_database"))
    exact = numbers.parent_no("doc_no", "doc_type")
    child = plain.select(*KEYS, "doc_no", "database", exact.alias("parent_no")).where("parent_no is not null").distinct()
    noted = notes(docs, keep).select(*KEYS, "doc_no", F.lit("Needed Research").alias("database"), F.col("root_no").alias("parent_no"))
    columns = [*KEYS, "parent_no", "doc_no", "parent_database", "database"]
    # Joined by themselves, as a union would be shuffled for it.
    there = child.join(parent, [*KEYS, "parent_no"]).select(*columns).unionByName(noted.join(parent, [*KEYS, "parent_no"]).select(*columns))
    # Only what has lost its parent looks further up.
    up = child.join(parent, [*KEYS, "parent_no"], "left_anti").select(*KEYS, "doc_no", "database", F.posexplode(numbers.prefixes("parent_no")).alias("at", "parent_no"))
    near = up.join(parent, [*KEYS, "parent_no"]).groupBy(*KEYS, "doc_no", "database").agg(F.max(F.struct("at", "parent_no", "parent_database")).alias("p"))
    # Dealt before siblings get their sort keys, which take more than the rows.
    found = keep(there.unionByName(near.select(*KEYS, "p.parent_no", "doc_no", "p.parent_database", "database")), "edges")
    found = found.join(schema.allowed_collections(docs.sparkSession), ["parent_database", "database"], "left")
    siblings = Window.partitionBy(*KEYS, "parent_no", "collection").orderBy(sibling_key("doc_no"))
    return found.withColumn("sibling_ord", F.row_number().over(siblings)).select(*columns, "collection", "collection_ord", "sibling_ord")


def tree_keys(docs: DataFrame, found: DataFrame, keep: Keep = written) -> DataFrame:
    """(doc_no, root_no, key) of every document; sorting by sibling_key(root_no), root_no, key walks the trees in order of export.

    Children come in order of their collection (research notes first), then of their number. Documents of ``found``'s
    edges are below their root; all others are roots with an empty key.
    """
    step = F.struct(F.coalesce("collection_ord", F.lit(99)).alias("c"), F.col("sibling_ord").alias("o"), F.coalesce("collection", F.lit("unmapped")).alias("collection"))
    below = climbed(found.select(*KEYS, F.col("doc_no").alias("node"), F.col("parent_no").alias("up"), F.array(step).alias("steps")), keep)
    own = docs.select(*KEYS, "doc_no").distinct().join(below.withColumnRenamed("node", "doc_no"), [*KEYS, "doc_no"], "left")
    empty = F.array().cast("array<struct<c:int,o:int,collection:string>>")
    return own.select(*KEYS, "doc_no", F.coalesce("top", "doc_no").alias("root_no"), F.when(F.col("top").isNotNull(), F.col("steps")).otherwise(empty).alias("key"))


def flattened(docs: DataFrame, keep: Keep = written) -> DataFrame:
    """(doc_no, position) in order of export, from 1."""
    key = tree_keys(docs, edges(docs, keep), keep).withColumn("key", F.struct(sibling_key("root_no").alias("r"), "root_no", "key"))
    return order.placed(key, KEYS, ["key", "doc_no"], keep=keep).drop("key", "root_no")


def sibling_key(doc_no: Column | str) -> Column:
    """Order among siblings, research notes by their number."""
    column = F.col(doc_no) if isinstance(doc_no, str) else doc_no
    return numbers.segment_key(F.regexp_replace(column, "^NR-", "NR."))


def paths(docs: DataFrame) -> DataFrame:
    """H7: the node keys from the root to each document, the uuid of each or else its number."""
    key = F.coalesce(F.when(F.col("ancestor_uuid") != "", F.col("ancestor_uuid")), F.col("ancestor_no"))
    up = lineage(docs).groupBy(*KEYS, "doc_no").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("at"), key.alias("key")))).alias("up"))
    own = docs.select(*KEYS, "doc_no", F.coalesce(F.when(F.col("uuid") != "", F.col("uuid")), F.col("doc_no")).alias("own"))
    joined = own.join(up, [*KEYS, "doc_no"], "left")
    above = F.coalesce(F.col("up.key"), F.array().cast("array<string>"))
    return joined.select(*KEYS, "doc_no", F.concat(above, F.array("own")).alias("path"))


def child_lists(found: DataFrame) -> DataFrame:
    """Each parent with its children in order of collection, then number."""
    one = F.struct(F.coalesce("collection_ord", F.lit(99)).alias("c"), F.col("sibling_ord").alias("o"), F.col("doc_no"))
    return found.groupBy(*KEYS, "parent_no").agg(F.sort_array(F.collect_list(one)).alias("c")).select(*KEYS, "parent_no", F.col("c.doc_no").alias("children"))


def hierarchy(docs: DataFrame) -> DataFrame:
    """H6: the children of each document, in order of number, by the nearest ancestor that has a uuid; the row without a parent_no has the roots.

    A document without a number is a root.
    """
    near = nearest_ancestor(docs).select(*KEYS, F.col("ancestor_no").alias("parent_no"), F.struct(sibling_key("doc_no").alias("o"), "doc_no").alias("c"))
    return near.groupBy(*KEYS, "parent_no").agg(F.sort_array(F.collect_list("c")).alias("c")).select(*KEYS, "parent_no", F.col("c.doc_no").alias("children"))


def supporting_groups(found: DataFrame) -> DataFrame:
    """The number of supporting children of each parent by kind, with label and order; kinds without children have no row."""
    return supporting_view(found).groupBy(*KEYS, "parent_no", "collection", "label", "label_ord").agg(F.count("*").alias("n"))


def primary_view(found: DataFrame) -> DataFrame:
    """The edges of navigation, to children in the primary collections, in natural order of their numbers (place)."""
    natural = Window.partitionBy(*KEYS, "parent_no").orderBy(numbers.natural_key("doc_no").asc_nulls_last(), "doc_no")
    return found.where(F.col("collection").isin(*schema.PRIMARY_COLLECTIONS)).withColumn("place", F.row_number().over(natural))


def supporting_view(found: DataFrame) -> DataFrame:
    """The edges to supporting documents, with the label of their kind and its order."""
    label = F.create_map(*(F.lit(x) for pair in schema.SUPPORTING_LABELS.items() for x in pair))
    place = F.array_position(F.array(*(F.lit(c) for c in schema.SUPPORTING_LABELS)), F.col("collection"))
    return found.where(F.col("collection").isin(*schema.SUPPORTING_LABELS)).withColumns({"label": label[F.col("collection")], "label_ord": place.cast("int")})


def last_wins(rows: DataFrame, key: str, value: str, place: str) -> DataFrame:
    """(key, value) maps in which the last of equal keys, in order of ``place``, counts. Null and empty keys don't."""
    some = rows.where(F.coalesce(F.col(key).cast("string") != "", F.lit(False)))
    return some.groupBy(*KEYS, key).agg(F.max_by(value, place).alias(value))


def leaves(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Each document and whether it has children in a primary collection."""
    branch = found.where(F.col("collection").isin(*schema.PRIMARY_COLLECTIONS)).select(*KEYS, F.col("parent_no").alias("doc_no")).distinct().withColumn("is_branch", F.lit(True))
    return docs.select(*KEYS, "doc_no").join(branch, [*KEYS, "doc_no"], "left").withColumn("is_branch", F.coalesce("is_branch", F.lit(False)))


def depth_guard(found: DataFrame, most: int = 50, keep: Keep = written) -> DataFrame:
    """H9: documents more than ``most`` edges below a root, and those on circles or below them.

    Such a document has an ancestor ``most + 1`` steps up. Jumps of 1, 2, 4, ... steps are composed to that
    number, in as many joins as it has binary digits, twice.
    """
    jump = keep(found.select(*KEYS, "doc_no", F.col("parent_no").alias("up")).distinct(), "jump")
    reach, left = None, most + 1
    while left:
        ahead = jump.select(*KEYS, F.col("doc_no").alias("up"), F.col("up").alias("next"))
        if left & 1:
            reach = jump if reach is None else reach.join(ahead, [*KEYS, "up"]).select(*KEYS, "doc_no", F.col("next").alias("up"))
        left >>= 1
        if left:
            jump = jump.join(ahead, [*KEYS, "up"]).select(*KEYS, "doc_no", F.col("next").alias("up"))
    return reach.select(*KEYS, "doc_no").distinct()


def emit_keys(docs: DataFrame, keep: Keep = written) -> DataFrame:
    """The key of reading order. A document stands before its research notes, and those before what is below it.

    Each step of a number is (0 a document, 1 a folder without one, 2 no integer; its value; its text). Notes
    take the key of what their targets lead to and (-1, number) for each note on the way; notes without a target stand last.
    """
    plain = docs.where(F.col("doc_type") != "Needed Research").select(*KEYS, "doc_no").distinct()
    steps = plain.select(*KEYS, "doc_no", F.posexplode(numbers.prefixes("doc_no", own=True)).alias("at", "step_no"))
    there = plain.select(*KEYS, F.col("doc_no").alias("step_no"), F.lit(True).alias("there"))
    last = F.element_at(numbers.segments("step_no"), -1)
    digits = last.rlike(r"^\d+$")
    kind = F.when(~digits, 2).when(F.col("there"), 0).otherwise(1)
    step = F.struct("at", F.struct(kind.alias("k"), numbers.value_key(F.when(digits, last).otherwise("")).alias("n"), last.alias("s")).alias("step"))
    keys = steps.join(there, [*KEYS, "step_no"], "left").groupBy(*KEYS, "doc_no").agg(F.sort_array(F.collect_list(step)).alias("a")).select(*KEYS, "doc_no", F.col("a.step").alias("key"))
    far = F.array(F.struct(F.lit(9).alias("k"), numbers.value_key(F.lit("")).alias("n"), F.lit("").alias("s")))
    target = keys.select(*KEYS, F.col("doc_no").alias("root_no"), F.col("key").alias("target_key"))
    noted = notes(docs, keep).join(target, [*KEYS, "root_no"], "left").select(*KEYS, "doc_no", F.concat(F.coalesce("target_key", far), "chain").alias("note_key"))
    # Both are joined with their documents, as a union of them would be shuffled. A number may be a note's and another document's.
    found = docs.select(*KEYS, "doc_no").distinct().join(keys, [*KEYS, "doc_no"], "left").alias("d")
    same = [F.col(f"d.{c}") == F.col(f"n.{c}") for c in KEYS] + [F.col("d.doc_no").eqNullSafe(F.col("n.doc_no"))]
    found = found.join(noted.alias("n"), same, "left")
    return found.select(*(F.col(f"d.{c}") for c in (*KEYS, "doc_no")), F.explode(F.array_compact(F.array("key", "note_key"))).alias("key"))


def positions(docs: DataFrame, keep: Keep = written) -> DataFrame:
    """(doc_no, position) in reading order, from 1."""
    return order.placed(emit_keys(docs, keep), KEYS, ["key", "doc_no"], keep=keep).drop("key")


def structural_levels(docs: DataFrame) -> DataFrame:
    """H4: 1 + existing ancestors, 6 at most; a note is one below its target, note or not, and 1 without one."""
    plain = docs.where(F.col("doc_type") != "Needed Research")
    n = lineage(plain).groupBy(*KEYS, "doc_no").agg(F.count("*").alias("n"))
    level = plain.select(*KEYS, "doc_no").join(n, [*KEYS, "doc_no"], "left").select(*KEYS, "doc_no", F.least(F.lit(6), 1 + F.coalesce("n", F.lit(0))).cast("int").alias("level"))
    target = level.select(*KEYS, F.col("doc_no").alias("root_no"), F.col("level").alias("t"))
    own = F.least(F.lit(6), F.coalesce("t", F.lit(0)) + F.size("chain")).cast("int")
    return level.unionByName(notes(docs).join(target, [*KEYS, "root_no"], "left").select(*KEYS, "doc_no", own.alias("level")))


#: What a type's number puts between its parent's number and its own index, and the index' first value.
INFIX = {"Annotation": ".0.3.", "Action Tenet": ".0.4.", "Scenario": ".1.", "Scenario Variation": ".var", "Active Data": ".0.6."}


def assign_numbers(docs: DataFrame) -> DataFrame:
    """New numbers (doc_no, new_no) that leave no gaps, level by level; scopes count from 0, notes run through a corpus.

    Siblings keep their order, and all primary types share one sequence. The number of levels bounds the
    joins; each is on the parent's old number.
    """
    own = parents(docs).select(*KEYS, "doc_no", "doc_type", F.when(F.col("parent_uuid").isNotNull(), F.col("parent_no")).alias("parent_no"))
    family = F.when(F.col("doc_type").isin(*INFIX), F.col("doc_type")).otherwise("primary")
    plain = own.where(F.col("doc_type") != "Needed Research").withColumn("family", family)
    siblings = Window.partitionBy(*KEYS, "parent_no", "family").orderBy(sibling_key("doc_no"))
    plain = plain.withColumn("index", F.row_number().over(siblings) - F.when(F.col("parent_no").isNull(), 1).otherwise(0))
    infix = F.create_map(*(F.lit(x) for pair in INFIX.items() for x in pair))
    tail = F.concat(F.coalesce(infix[F.col("family")], F.lit(".")), F.col("index").cast("string"))
    plain = plain.withColumn("tail", tail).select(*KEYS, "doc_no", "parent_no", "tail")
    # Every document joins with the tails of all its ancestors at once: its new number is theirs in order.
    up = lineage(docs.where(F.col("doc_type") != "Needed Research")).select(*KEYS, "doc_no", "ancestor_no", "distance")
    above = up.join(plain.select(*KEYS, F.col("doc_no").alias("ancestor_no"), "tail"), [*KEYS, "ancestor_no"])
    tails = above.groupBy(*KEYS, "doc_no").agg(F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("at"), "tail"))).alias("t"))
    # Their own tails are joined, as a union with those above would be shuffled.
    mine = plain.groupBy(*KEYS, "doc_no").agg(F.sort_array(F.collect_list("tail")).alias("own"))
    over = F.coalesce(F.array_join("t.tail", ""), F.lit(""))
    numbered = mine.join(tails, [*KEYS, "doc_no"], "left").select(*KEYS, "doc_no", F.concat(F.lit("A"), over, F.array_join("own", "")).alias("new_no"))
    noted = docs.where(F.col("doc_type") == "Needed Research").select(*KEYS, "doc_no")
    running = F.row_number().over(Window.partitionBy(*KEYS).orderBy(sibling_key("doc_no")))
    return numbered.unionByName(noted.select(*KEYS, "doc_no", F.concat(F.lit("NR-"), running.cast("string")).alias("new_no")))


def sibling_gaps(docs: DataFrame) -> DataFrame:
    """Numbered siblings whose last number is not one more than the one before (or than the first expected)."""
    own = docs.where(F.col("doc_type") != "Needed Research").select(*KEYS, "doc_no", "doc_type", numbers.parent_no("doc_no", "doc_type").alias("parent_no"))
    family = F.when(F.col("doc_type").isin(*INFIX), F.col("doc_type")).otherwise("primary")
    n = F.regexp_extract("doc_no", r"(\d+)$", 1).try_cast("bigint")
    siblings = Window.partitionBy(*KEYS, "parent_no", "family").orderBy("n", "doc_no")
    own = own.withColumn("family", family).withColumn("n", n).withColumn("before", F.coalesce(F.lag("n").over(siblings), F.when(F.col("doc_type") == "Scope", F.lit(-1)).otherwise(F.lit(0)).cast("bigint")))
    return own.where(F.col("n") != F.col("before") + 1).select(*KEYS, "doc_no", "n", "before")
