"""What changed between two versions of a corpus, and the edit scopes that the changes fall into.

``base`` and ``head`` are document tables of one version each; results are keyed by corpus_id. Documents match
by uuid. All lineage tests are equi-joins on exploded number prefixes.
"""

from __future__ import annotations

import difflib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctree.functions import numbers, text
from doctree.operators import ranges

KEY = "corpus_id"


def _side(docs: DataFrame, name: str) -> DataFrame:
    return docs.select(KEY, F.when(F.col("uuid") != "", F.col("uuid")).alias("uuid"), *(F.col(c).alias(f"{name}_{c}") for c in ("doc_no", "name", "body")))


def classify(base: DataFrame, head: DataFrame) -> DataFrame:
    """Each uuid of either version with its change and its status.

    change: Inserted, Deleted, substantive, xref_only (bodies that differ in the numbers inside links), number_only, same.
    status: Inserted, Deleted, Edited (body or name differ) or null. A document of head without a uuid matches none
    and counts as substantive; one of base without is not known to be deleted.
    """
    both = _side(base, "base").where("uuid is not null").join(_side(head, "head"), [KEY, "uuid"], "full_outer")
    same = F.col("base_body").eqNullSafe(F.col("head_body"))
    alike = text.normalized_body("base_body").eqNullSafe(text.normalized_body("head_body"))
    return both.withColumn("change", change_of(same, alike)).withColumn("status", F.expr(STATUS))


def change_of(same: Column, alike: Column) -> Column:
    """The change of a row with uuid and number and name of both sides; ``same`` and ``alike`` say whether its bodies are
    equal, as they are and but for the numbers inside links."""
    same_name = F.col("base_name") == F.col("head_name")
    return (
        F.when(F.col("head_doc_no").isNull(), "Deleted")
        .when(F.col("uuid").isNull(), "substantive")
        .when(F.col("base_doc_no").isNull(), "Inserted")
        .when(same & same_name, F.when(F.col("base_doc_no") == F.col("head_doc_no"), "same").otherwise("number_only"))
        .when(alike & same_name, "xref_only")
        .otherwise("substantive")
    )


#: D3: the status of a change.
STATUS = "CASE WHEN change IN ('Inserted', 'Deleted') THEN change WHEN change IN ('substantive', 'xref_only') THEN 'Edited' END"


def _ancestors(rows: DataFrame, number: str) -> DataFrame:
    return rows.select("*", F.posexplode(numbers.prefixes(number)).alias("at", "ancestor_no"))


def living_ancestors(base: DataFrame, head: DataFrame) -> DataFrame:
    """Each deleted uuid whose base ancestors have one that head still has, with the nearest one's uuid and number in head."""
    # Of the numbers that share a uuid the least counts.
    alive = head.where("uuid <> ''").groupBy(KEY, F.col("uuid").alias("ancestor_uuid")).agg(F.min("doc_no").alias("head_no"))
    gone = base.where("uuid <> ''").select(KEY, "uuid", "doc_no").join(alive.select(KEY, F.col("ancestor_uuid").alias("uuid")), [KEY, "uuid"], "left_anti")
    there = base.where("uuid <> ''").select(KEY, F.col("doc_no").alias("ancestor_no"), F.col("uuid").alias("ancestor_uuid"))
    up = _ancestors(gone, "doc_no").join(there, [KEY, "ancestor_no"]).join(alive, [KEY, "ancestor_uuid"])
    return up.groupBy(KEY, "uuid", "doc_no").agg(F.max(F.struct("at", "ancestor_uuid", "head_no")).alias("a")).select(KEY, "uuid", "doc_no", "a.ancestor_uuid", "a.head_no")


def changed_numbers(changes: DataFrame, living: DataFrame) -> DataFrame:
    """Numbers in head of what changed, and of the nearest living ancestors of what was deleted."""
    # Each side is made distinct by itself, as a union of both would be shuffled for it.
    own = changes.where(F.col("change").isin("Inserted", "substantive")).select(KEY, F.col("head_doc_no").alias("doc_no")).where("doc_no <> ''").distinct()
    above = living.select(KEY, F.col("head_no").alias("doc_no")).where("doc_no <> ''").distinct()
    return own.unionByName(above.join(own, [KEY, "doc_no"], "left_anti"))


def stats(changes: DataFrame, living: DataFrame) -> DataFrame:
    """A4: new, modified, removed, renumbered and total for each corpus, and number_only besides.

    ``total`` also counts living ancestors of deleted documents that did not change themselves.
    """
    count = lambda name: F.count_if(F.col("change") == name)
    own = changes.groupBy(KEY).agg(count("Inserted").alias("new"), count("substantive").alias("modified"), count("Deleted").alias("removed"), count("xref_only").alias("renumbered"), count("number_only").alias("number_only"))
    changed = changes.where(F.col("change").isin("Inserted", "substantive")).select(KEY, F.col("head_doc_no").alias("head_no"))
    more = living.select(KEY, "head_no").distinct().join(changed, [KEY, "head_no"], "left_anti").groupBy(KEY).agg(F.count("*").alias("more"))
    return own.join(more, KEY, "left").withColumn("total", F.col("new") + F.col("modified") + F.coalesce("more", F.lit(0))).drop("more")


def renumbered(changes: DataFrame) -> DataFrame:
    """D13."""
    return changes.where("change = 'xref_only' and base_doc_no <> head_doc_no").select(KEY, F.col("base_doc_no").alias("old_no"), F.col("head_doc_no").alias("new_no"), F.col("head_name").alias("title"))


def scope_roots(changed: DataFrame) -> DataFrame:
    """Changed numbers without a changed one above them."""
    above = _ancestors(changed, "doc_no").join(changed.select(KEY, F.col("doc_no").alias("ancestor_no")), [KEY, "ancestor_no"], "left_semi").select(KEY, "doc_no").distinct()
    return changed.join(above, [KEY, "doc_no"], "left_anti")


def edit_scopes(roots: DataFrame, head: DataFrame) -> DataFrame:
    """The roots of the scopes, with name, order and slug.

    Two or more roots below one parent give way to the parent, if head has it and no other root lies below it. A root
    above another one is dropped then; what it covers and the other does not is in no scope (see ``uncovered``).
    """
    own = roots.withColumn("parent_no", F.coalesce(numbers.dotted_parent("doc_no"), F.lit("")))
    size = own.groupBy(KEY, "parent_no").agg(F.count("*").alias("n"), F.min(numbers.segment_key("doc_no")).alias("group_key"))
    below = _ancestors(roots, "doc_no").groupBy(KEY, F.col("ancestor_no").alias("parent_no")).agg(F.count("*").alias("n_below"))
    there = head.select(KEY, F.col("doc_no").alias("parent_no"), F.lit(True).alias("there")).distinct()
    groups = size.join(below, [KEY, "parent_no"], "left").join(there, [KEY, "parent_no"], "left")
    groups = groups.withColumn("up", (F.col("n") > 1) & F.coalesce(F.col("there"), F.lit(False)) & (F.coalesce("n_below", F.lit(0)) == F.col("n")))
    joined = own.join(groups.select(KEY, "parent_no", "group_key", "up"), [KEY, "parent_no"])
    grouped = joined.select(KEY, F.when(F.col("up"), F.col("parent_no")).otherwise(F.col("doc_no")).alias("root_no"), "group_key").distinct()
    covering = _ancestors(grouped, "root_no").select(KEY, F.col("ancestor_no").alias("root_no")).distinct()
    kept = grouped.join(covering, [KEY, "root_no"], "left_anti")
    # Of the documents that share a number the one with the least uuid counts, then that with the least name.
    heads = head.groupBy(KEY, F.col("doc_no").alias("root_no")).agg(F.min(F.struct("uuid", "name")).alias("d")).select(KEY, "root_no", "d.name", "d.uuid")
    named = kept.join(heads, [KEY, "root_no"])
    order = [F.col("group_key"), numbers.segment_key("root_no")]
    slug = named.withColumn("slug", text.slugify("name")).withColumn("rank", F.row_number().over(Window.partitionBy(KEY, "slug").orderBy(*order)))
    slug = slug.withColumn("slug", F.when(F.col("rank") > 1, F.concat_ws("-", "slug", F.col("rank").cast("string"))).otherwise(F.col("slug")))
    # A counted slug may equal a name's own; the later one is counted once more.
    again = F.row_number().over(Window.partitionBy(KEY, "slug").orderBy("rank", *order))
    slug = slug.withColumn("again", again).withColumn("slug", F.when(F.col("again") > 1, F.concat_ws("-", "slug", F.col("again").cast("string"))).otherwise(F.col("slug")))
    return slug.select(KEY, "root_no", "name", "uuid", "slug")


def in_scopes(docs: DataFrame, scopes: DataFrame, number: str = "doc_no") -> DataFrame:
    """Rows of ``docs`` with the scope (root_no) that they are in; scopes do not overlap."""
    roots = scopes.select(KEY, "root_no")
    each = docs.select("*", F.explode(numbers.prefixes(number, own=True)).alias("root_no"))
    return each.join(roots, [KEY, "root_no"])


def uncovered(changed: DataFrame, scopes: DataFrame) -> DataFrame:
    """Changed numbers that are in no scope, as a covering root was dropped."""
    return changed.join(in_scopes(changed, scopes).select(KEY, "doc_no"), [KEY, "doc_no"], "left_anti")


def scope_labels(scopes: DataFrame, head: DataFrame) -> DataFrame:
    """root_no, label and detail. Scopes of equal names get the shortest list of names above them that no other of them has, or their number."""
    group = scopes.withColumn("group_name", text.label_group_key("name"))
    group = group.withColumn("n", F.count("*").over(Window.partitionBy(KEY, "group_name")))
    names = head.groupBy(KEY, F.col("doc_no").alias("ancestor_no")).agg(F.min("name").alias("above"))
    up = _ancestors(group.where("n > 1"), "root_no").join(names, [KEY, "ancestor_no"])
    chains = up.groupBy(KEY, "root_no", "group_name").agg(F.sort_array(F.collect_list(F.struct((-F.col("at")).alias("o"), "above"))).alias("c"))
    steps = chains.select(KEY, "root_no", "group_name", F.posexplode(F.transform("c", lambda s: s["above"])).alias("d", "x"), F.col("c.above").alias("chain"))
    steps = steps.withColumn("candidate", F.slice("chain", F.lit(1), F.col("d") + 1))
    alone = steps.withColumn("m", F.count("*").over(Window.partitionBy(KEY, "group_name", "d", "candidate"))).where("m = 1")
    best = alone.groupBy(KEY, "root_no").agg(F.min(F.struct("d", "candidate")).alias("b")).select(KEY, "root_no", F.array_join("b.candidate", " / ").alias("detail"))
    joined = group.join(best, [KEY, "root_no"], "left")
    return joined.select(KEY, "root_no", F.col("name").alias("label"), F.when(F.col("n") == 1, "").otherwise(F.coalesce("detail", "root_no")).alias("detail"))


def scope_lineage(scopes: DataFrame, head: DataFrame) -> DataFrame:
    """The documents above each scope's root, from the top (step 0)."""
    there = head.select(KEY, F.col("doc_no").alias("ancestor_no"), F.col("name").alias("title"))
    return _ancestors(scopes.select(KEY, "root_no"), "root_no").join(there, [KEY, "ancestor_no"]).select(KEY, "root_no", F.col("at").alias("step"), "ancestor_no", "title")


def scope_siblings(scopes: DataFrame, head: DataFrame, changed: DataFrame) -> DataFrame:
    """Unchanged documents with the root's parent number, and whether they stand before the root."""
    parent = scopes.select(KEY, "root_no", numbers.dotted_parent("root_no").alias("parent_no"))
    other = head.select(KEY, "doc_no", numbers.dotted_parent("doc_no").alias("parent_no")).join(changed, [KEY, "doc_no"], "left_anti")
    found = parent.join(other, [KEY, "parent_no"]).where("doc_no <> root_no")
    return found.select(KEY, "root_no", "doc_no", (numbers.segment_key("doc_no") < numbers.segment_key("root_no")).alias("before"))


def scope_nodes(scopes: DataFrame, changes: DataFrame, living: DataFrame) -> DataFrame:
    """Documents of each scope with status, and whether they show: changed, or above something changed or deleted.

    A deleted document belongs to the scope of its nearest living ancestor and shows there.
    """
    head = changes.where("head_doc_no is not null").select(KEY, F.col("head_doc_no").alias("doc_no"), "uuid", "status")
    nodes = in_scopes(head, scopes).select(KEY, "root_no", "doc_no", "uuid", "status")
    gone = in_scopes(living.select(KEY, "uuid", "doc_no", "head_no"), scopes, "head_no")
    # What is above a change and what is above a deletion are looked up one after the other: their union would be shuffled.
    above = lambda rows, number, name: rows.select(KEY, "root_no", F.explode(numbers.prefixes(number, own=True)).alias("doc_no")).distinct().withColumn(name, F.lit(True))
    out = nodes
    for marked in (above(nodes.where("status is not null"), "doc_no", "over_change"), above(gone, "head_no", "over_gone")):
        out = out.join(marked, [KEY, "root_no", "doc_no"], "left")
    out = out.withColumn("visible", F.coalesce("over_change", "over_gone", F.lit(False))).drop("over_change", "over_gone")
    return out.unionByName(gone.select(KEY, "root_no", "doc_no", "uuid", F.lit("Deleted").alias("status"), F.lit(True).alias("visible")))


def scope_summary(scopes: DataFrame, changes: DataFrame, changed: DataFrame) -> DataFrame:
    """A5: edited and new documents of each scope, and the sentence that says so."""
    new = changes.where("change = 'Inserted'").select(KEY, F.col("head_doc_no").alias("doc_no"), F.lit(1).alias("is_new"))
    counts = in_scopes(changed.join(new, [KEY, "doc_no"], "left"), scopes).groupBy(KEY, "root_no").agg(F.count("*").alias("n"), F.count("is_new").alias("new"))
    counts = counts.select(KEY, "root_no", (F.col("n") - F.col("new")).alias("edited"), "new")
    part = lambda c, what: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {what} document"), F.when(F.col(c) != 1, "s").otherwise("")))
    said = F.concat_ws(", ", part("edited", "edited"), part("new", "new"))
    return counts.withColumn("summary", F.when(said == "", "Changes in this scope").otherwise(said))


def roundtrip(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether the texts (corpus_id, version_id, text) of two sides are equal, with the number of lines that differ and the first of them.

    Texts whose digests agree are equal; only the others are cut into lines, which are compared by their numbers.
    """
    keys = [KEY, "version_id"]
    side = lambda d, n: d.select(*keys, F.col("text").alias(f"text_{n}"))
    both = side(a, "a").join(side(b, "b"), keys, "full_outer")
    equal = F.coalesce(F.sha2("text_a", 256) == F.sha2("text_b", 256), F.lit(False))
    both = both.withColumn("equal", equal)
    cut = lambda n: F.split(F.coalesce(F.col(f"text_{n}"), F.lit("")), "\n")
    pairs = both.where("not equal").select(*keys, F.posexplode(F.arrays_zip(cut("a").alias("a"), cut("b").alias("b"))).alias("at", "l"))
    differ = pairs.where(~F.col("l.a").eqNullSafe(F.col("l.b"))).groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct((F.col("at") + 1).alias("line"), F.col("l.a"), F.col("l.b"))).alias("first"))
    found = both.select(*keys, "equal").join(differ, keys, "left")
    return found.select(*keys, "equal", F.coalesce("n", F.lit(0)).alias("n_differing"), F.col("first.line").alias("first_line"), F.col("first.a").alias("first_a"), F.col("first.b").alias("first_b"))


def proposal_title(title: str, branch: str):
    """D19, as a column: the title, or the branch's last part in words."""
    words = F.initcap(F.replace(F.element_at(F.split(F.col(branch), "/"), -1), F.lit("-"), F.lit(" ")))
    return F.coalesce(F.when(~text.is_blank(title), F.col(title)), words)


def paragraphs(changes: DataFrame) -> DataFrame:
    """Paragraphs of edited documents, aligned by place: equal, insert, delete or replace."""
    edited = changes.where("change in ('substantive', 'xref_only') and base_doc_no is not null")
    cut = lambda c: F.filter(F.transform(F.split(text.normalized_body(F.coalesce(F.col(c), F.lit(""))), "\n\n"), text.trimmed), lambda p: p != "")
    both = edited.select(KEY, "uuid", cut("base_body").alias("old"), cut("head_body").alias("new"))
    each = both.select(KEY, "uuid", F.posexplode(F.arrays_zip("old", "new")).alias("place", "p")).select(KEY, "uuid", "place", "p.old", "p.new")
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") == F.col("new"), "equal").otherwise("replace")
    return each.withColumn("op", op)


_TOKEN = re.compile(text.TOKEN)
#: Equal runs of so few tokens that are no white space join the changes around them.
SHORT_RUN = 3


def token_ops(old: str, new: str) -> list[tuple[str, str, str]]:
    """Steps (op, old text, new text). Changes with only short equal runs between them are one replacement."""
    a, b = _TOKEN.findall(old), _TOKEN.findall(new)

    def keeps(op: tuple) -> bool:
        return op[0] == "equal" and sum(not t.isspace() for t in a[op[1] : op[2]]) > SHORT_RUN

    out = []
    for kept, run in itertools.groupby(difflib.SequenceMatcher(None, a, b).get_opcodes(), keeps):
        ops = list(run)
        changed = [k for k, op in enumerate(ops) if op[0] != "equal"]
        if not kept and len(changed) > 1:
            first, last = ops[changed[0]], ops[changed[-1]]
            ops[changed[0] : changed[-1] + 1] = [("replace", first[1], last[2], first[3], last[4])]
        out += [(op, "".join(a[i:j]), "".join(b[k:m])) for op, i, j, k, m in ops]
    return out


def line_ops(old: str, new: str) -> list[tuple[str, str, str]]:
    a, b = (t.split("\n") if t else [] for t in (old, new))
    out = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b).get_opcodes():
        for n in range(max(j - i, m - k)):
            out.append((op, a[i + n] if i + n < j else "", b[k + n] if k + n < m else ""))
    return out


def fine_diff(pairs: DataFrame, kind: str = "token") -> DataFrame:
    """Steps (seq, op, old_text, new_text) of rows with ``old`` and ``new``; lines or tokens.

    Only pass what differs: paragraphs labelled replace, names that changed. Each pair is diffed in one Python
    call over Arrow batches, as difflib's matching has no form in expressions.
    """
    keys = [c for c in pairs.columns if c not in ("old", "new", "op")]
    schema = ", ".join(f"{c} {t}" for c, t in pairs.select(*keys).dtypes)
    ops = token_ops if kind == "token" else line_ops

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, steps = [], []
            for i, (old, new) in enumerate(zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True)):
                for seq, step in enumerate(ops(old or "", new or "")):
                    at.append(i)
                    steps.append((seq, *step))
            own = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keys))]
            cols = [pa.array([s[k] for s in steps], t) for k, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*own, *cols], [*keys, "seq", "op", "old_text", "new_text"])

    return pairs.select(*keys, "old", "new").mapInArrow(run, f"{schema}, seq int, op string, old_text string, new_text string")


def hunks(diffs: DataFrame) -> DataFrame:
    """0-based ranges [first, after) of changed new lines in each row's ``diff``; a count of 0 changes none."""
    pattern = r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    start, count = (F.regexp_extract_all("diff", F.lit(pattern), F.lit(i)) for i in (1, 2))
    keys = [c for c in diffs.columns if c != "diff"]
    each = diffs.select(*keys, F.explode(F.arrays_zip(start.alias("s"), count.alias("c"))).alias("h"))
    first = F.col("h.s").cast("bigint") - 1
    return each.select(*keys, first.alias("first"), (first + F.when(F.col("h.c") == "", 1).otherwise(F.col("h.c").try_cast("bigint"))).alias("after")).where("after > first")


def touched(spans: DataFrame, changed: DataFrame) -> DataFrame:
    """Documents (doc_no, line_start, line_end, 0-based) whose lines overlap a changed range [first, after).

    They overlap where one begins in the other. Both are looked up by dyadic intervals, so a range of any length is a few dozen rows.
    """
    own = spans.select(KEY, "doc_no", "line_start", (F.col("line_end") + 1).alias("line_after"))
    begin = ranges.points_in(own, changed, [KEY], "line_start", "first", "after")
    hold = ranges.ranges_with(own, changed.where("after > first"), [KEY], "first", "line_start", "line_after")
    return begin.unionByName(hold).select(KEY, "doc_no").distinct()
