"""Whole-corpus markdown: one text with every document in reading order, read into and written from document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree import schema
from doctree.functions import numbers, text
from doctree.operators import order, tree
from doctree.operators.order import Keep
from doctree.session import written

KEYS = list(schema.KEYS)
# The title lines of the format.
#: A title line: hashes, number, name, type, uuid. Blanks don't cross lines, and line ends are line feeds only.
TITLE = r"^(#+)[^\S\n]+(\S+)[^\S\n]+-[^\S\n]+(.*?)[^\S\n]+\[(.+?)\][^\S\n]+<!--[^\S\n]*UUID:[^\S\n]*([a-fA-F0-9-]*)[^\S\n]*-->[^\S\n]*$"
#: The validator's stricter form: a name, and exactly two blanks before the comment.
STRICT = r"(?i)^(#+)\s+(\S+)\s+-\s+(.+?)\s+\[(.+?)\]\s{2}<!--\s*UUID:\s*([a-f0-9-]*)\s*-->$"


def title_fields(line: Column | str, pattern: str = TITLE) -> dict[str, Column]:
    """Level, doc_no, name, doc_type and uuid (empty: null) of a title line."""
    column = F.col(line) if isinstance(line, str) else line
    part = lambda i: F.regexp_extract(column, pattern, i)
    return {"level": F.length(part(1)), "doc_no": part(2), "name": part(3), "doc_type": part(4), "uuid": F.when(part(5) != "", part(5))}


def read(raw: DataFrame) -> DataFrame:
    """One row for each document of each ``raw`` (corpus_id, version_id, text), in order of pos.

    A body is what stands between a title line and the next, without blank lines at its ends. Text before the
    first title belongs to no document. Each text is split within its row: no shuffle, no window over lines.
    """
    plain = F.replace("text", F.lit("\r\n"), F.lit("\n"))
    parts = raw.select(*KEYS, F.posexplode(F.split(plain, "(?md)(?=" + TITLE + ")")).alias("pos", "part"))
    line = F.substring_index("part", "\n", 1)
    docs = parts.withColumn("title", line).where(F.col("title").rlike(TITLE)).withColumns(title_fields("title"))
    body = F.when(F.instr("part", "\n") > 0, F.substr("part", F.instr("part", "\n") + 1)).otherwise("")
    return docs.withColumn("body", text.trim_blank_lines(body)).drop("part")


def preamble(raw: DataFrame) -> DataFrame:
    """Text before the first title of each corpus, as an issue would report it; blank ones don't count."""
    first = F.element_at(F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "(?md)(?=" + TITLE + ")", 2), 1)
    return raw.select(*KEYS, first.alias("preamble")).where(~F.col("preamble").rlike(TITLE.replace("^", r"\A(?d)(?m)", 1)) & ~text.is_blank("preamble"))


def lines(raw: DataFrame) -> DataFrame:
    """Line (from 1) and its text."""
    return raw.select(*KEYS, F.posexplode(F.split("text", "\r?\n")).alias("at", "content")).select(*KEYS, (F.col("at") + 1).alias("line"), "content")


def owned_lines(raw: DataFrame) -> DataFrame:
    """Each line with the line of the title that it stands under (null before the first)."""
    return owned(lines(raw))


def owned(found: DataFrame, most: int = order.MOST_IN_TASK) -> DataFrame:
    """W1 of lines (line, content), which may come from texts that are no one value."""
    title = F.when(F.col("content").rlike(TITLE), F.col("line"))
    return order.carried(found, KEYS, ["line"], last={"owner_line": title}, own=True, most=most)


def read_lines(spark: SparkSession, path: str, most: int = order.MOST_IN_TASK) -> DataFrame:
    """S5 for texts beyond one value: the lines of files below ``path``, in folders by corpus and version.

    A file is read in splits by as many tasks; a line's place follows from its file, the split that it is in and its order there.
    The files of one folder follow each other by name.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select(F.col("corpus_id").cast("string"), F.col("version_id").cast("string"), F.regexp_replace("value", r"\r$", "").alias("content"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    return order.placed(rows, KEYS, ["file", "split", "at"], "line", most).drop("file", "split", "at")


def documents(found: DataFrame, most: int = order.MOST_IN_TASK) -> DataFrame:
    """S4 of lines (line, content): equal to :func:`read` of the whole text but for pos, which is the title's line. Only a document's own lines come together."""
    rows = owned(found, most).where("owner_line is not null")
    packed = rows.groupBy(*KEYS, "owner_line").agg(F.sort_array(F.collect_list(F.struct("line", "content"))).alias("l"))
    each = packed.select(*KEYS, F.col("owner_line").alias("pos"), F.element_at("l.content", 1).alias("title"), F.array_join(F.slice("l.content", F.lit(2), F.size("l")), "\n").alias("body"))
    return each.withColumns(title_fields("title")).withColumn("body", text.trim_blank_lines(F.col("body")))


def noted_levels(docs: DataFrame, keep: Keep = written) -> DataFrame:
    """H3: (doc_no, note_level) of research notes: one below their target, note or not, 6 at most and where targets lead nowhere."""
    own = docs.where("doc_type <> 'Needed Research'").withColumn("level", numbers.heading_level("doc_no", "doc_type"))
    target = own.groupBy(*KEYS, F.col("doc_no").alias("root_no")).agg(F.min("level").alias("target_level"))
    noted = tree.notes(docs, keep).join(target, [*KEYS, "root_no"], "left")
    return noted.select(*KEYS, "doc_no", F.coalesce(F.least(F.lit(6), F.col("target_level") + F.size("chain")), F.lit(6)).alias("note_level"))


def level_of() -> Column:
    """The heading level of a document with note_level."""
    return F.when(F.col("doc_type") == "Needed Research", F.col("note_level")).otherwise(numbers.heading_level("doc_no", "doc_type"))


def levels(docs: DataFrame) -> DataFrame:
    """H3: documents with level. Numbers of notes are those of no other documents, so one join serves all."""
    return docs.join(noted_levels(docs), [*KEYS, "doc_no"], "left").withColumn("level", level_of()).drop("note_level")


def _keys(docs: DataFrame, keep: Keep = written) -> DataFrame:
    """(doc_no, position, note_level): what a document's place and title need that other documents tell."""
    return tree.positions(docs, keep).join(noted_levels(docs, keep), [*KEYS, "doc_no"], "left")


def _title() -> Column:
    return text.heading_line(F.col("level"), F.col("doc_no"), F.col("name"), F.col("doc_type"), F.col("uuid"))


def _block() -> Column:
    body = F.coalesce("body", F.lit(""))
    return F.concat("title", F.lit("\n"), F.when(body != "", F.concat(F.lit("\n"), body, F.lit("\n"))).otherwise(""))


def blocks(docs: DataFrame) -> DataFrame:
    """Documents with their position in reading order, title line and block of text."""
    placed = docs.join(_keys(docs), [*KEYS, "doc_no"]).withColumn("level", level_of()).drop("note_level")
    return placed.withColumn("title", _title()).withColumn("block", _block())


def _ends(docs: DataFrame, size: Column, name: str, among: DataFrame | None = None, keep: Keep = written) -> DataFrame:
    """(doc_no, position, note_level, n, ``name``): the running sum of ``size`` (n) in reading order. No body is shuffled, only sizes."""
    keys = keep(_keys(docs if among is None else among, keep), "keys")
    sizes = docs.join(keys, [*KEYS, "doc_no"]).withColumn("level", level_of()).withColumn("title", _title())
    sizes = sizes.groupBy(*KEYS, "doc_no", "position", "note_level").agg(F.sum(size).cast("long").alias("n"))
    return order.running(sizes, KEYS, ["position"], "n", name, keep=keep)


def _feeds(column: str) -> Column:
    return F.length(column) - F.length(F.replace(F.col(column), F.lit("\n")))


def body_lines() -> dict[str, Column]:
    """What :func:`spans` needs of a body, by name."""
    return {"bodied": F.coalesce("body", F.lit("")) != "", "feeds": _feeds("body")}


def spans(docs: DataFrame, among: DataFrame | None = None, keep: Keep = written) -> DataFrame:
    """The first and last line of each document in its corpus' text, from 1. Documents have a body, or its :func:`body_lines`.

    ``among`` has the same documents, where these are had without bodies; their order comes of it.
    """
    shaped = docs.withColumns(body_lines()).drop("body") if "body" in docs.columns else docs
    found = _ends(shaped, _feeds("title") + 2 + F.when(F.col("bodied"), F.col("feeds") + 2).otherwise(0), "line_end", among, keep)
    return found.select(*KEYS, "doc_no", (F.col("line_end") - F.col("n") + 1).alias("line_start"), "line_end")


def write(docs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One text for each corpus version (or other group): blocks in reading order, joined by line feeds.

    A text is one value, so a group must be smaller than 2 GB; see :func:`parts` for larger ones.
    """
    keys = [*KEYS, *(by or [])]
    return joined(blocks(docs), keys)


def parts(docs: DataFrame, most: int = 16_000_000) -> DataFrame:
    """(corpus_id, version_id, part, text): the text of each corpus version in parts of about ``most`` characters.

    Parts begin at a title, so :func:`read` takes each by itself; parts in their order, joined by line feeds, are the
    whole text. Parts are worked out and joined apart from each other, so a corpus may have any size.
    """
    long = F.length(F.coalesce("body", F.lit("")))
    shaped = docs.withColumn("long", long).drop("body")
    ends = _ends(shaped, F.length("title") + 2 + F.when(F.col("long") > 0, F.col("long") + 2).otherwise(0), "end")
    part = ends.select(*KEYS, "doc_no", "position", "note_level", F.expr(f"cast((end - n) div {most} as int)").alias("part"))
    found = docs.join(part, [*KEYS, "doc_no"]).withColumn("level", level_of()).withColumn("title", _title()).withColumn("block", _block())
    return joined(found.select(*KEYS, "part", "position", "block"), [*KEYS, "part"])


def write_files(docs: DataFrame, path: str, most: int = 16_000_000) -> None:
    """The parts of all texts as files below ``path``, in folders by corpus and version; :func:`read_files` reads them."""
    found = parts(docs, most)
    found.repartitionByRange(*KEYS, "part").sortWithinPartitions(*KEYS, "part").select(*KEYS, "text").write.mode("overwrite").partitionBy(*KEYS).option("lineSep", "\n").text(path)


def joined(found: DataFrame, keys: list[str]) -> DataFrame:
    packed = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("position", "block"))).alias("b"))
    return packed.select(*keys, F.array_join("b.block", "\n").alias("text"))


def without_stubs(docs: DataFrame) -> DataFrame:
    """P5: documents without those that have no name, and without what hangs below such."""
    found = tree.edges(docs)
    flags = docs.groupBy(*KEYS, "doc_no").agg(F.max(text.is_blank(F.coalesce("name", F.lit("")))).alias("stub"))
    steps = found.join(flags, [*KEYS, "doc_no"]).select(*KEYS, F.col("doc_no").alias("node"), F.col("parent_no").alias("up"), F.array("stub").alias("steps"))
    below = tree.climbed(steps).join(flags.select(*KEYS, F.col("doc_no").alias("top"), F.col("stub").alias("top_stub")), [*KEYS, "top"], "left")
    gone = below.where(F.exists("steps", lambda x: x) | F.coalesce("top_stub", F.lit(False))).select(*KEYS, F.col("node").alias("doc_no"))
    return docs.join(gone.unionByName(flags.where("stub").select(*KEYS, "doc_no")).distinct(), [*KEYS, "doc_no"], "left_anti")


def normalized_blocks(docs: DataFrame) -> DataFrame:
    """doc_no, root_no, position (in order of export) and block of each document that is no stub (P5).

    A block is the title, the content with plain quotes and bullets (F1), and each extra field under its label; a
    blank line stands after each of them.
    """
    from doctree.sources import atoms

    kept = written(without_stubs(docs), "kept")
    found = tree.edges(kept)
    parent = kept.groupBy(*KEYS, F.col("doc_no").alias("parent_no")).agg(F.min(numbers.heading_level("doc_no", "doc_type")).alias("parent_level"))
    up = found.select(*KEYS, "doc_no", "parent_no").join(parent, [*KEYS, "parent_no"], "left").select(*KEYS, "doc_no", "parent_level")
    keys = tree.tree_keys(kept, found)
    places = order.placed(keys.withColumn("key", F.struct(tree.sibling_key("root_no").alias("r"), "root_no", "key")), KEYS, ["key", "doc_no"]).drop("key")
    full = atoms.extras(kept.withColumn("body", F.coalesce("body", F.lit("")))).join(up, [*KEYS, "doc_no"], "left").join(places, [*KEYS, "doc_no"])
    level = F.when(F.col("doc_type") == "Needed Research", F.coalesce(F.least(F.lit(6), F.col("parent_level") + 1), F.lit(6))).otherwise(numbers.heading_level("doc_no", "doc_type"))
    title = text.heading_line(level, F.col("doc_no"), F.col("name"), F.col("doc_type"), F.col("uuid"))
    fields = F.create_map(*(x for t, f in schema.EXTRA_FIELDS.items() for x in (F.lit(t), F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in f.items())))))
    plain = lambda c: text.normalized_content(text.trimmed(c))
    value = lambda f: F.concat(F.lit("**"), f["v"], F.lit("**:\n\n"), plain(F.coalesce(F.element_at("extras", f["k"]), F.lit(""))), F.lit("\n"))
    extra = F.when(F.size("extras") > 0, F.concat(F.array_join(F.transform(fields[F.col("doc_type")], value), "\n"), F.lit("\n")))
    content = F.when(~text.is_blank("content"), F.concat(plain("content"), F.lit("\n\n")))
    block = F.concat(title, F.lit("\n\n"), F.coalesce(content, F.lit("")), F.coalesce(extra, F.lit("")))
    # The last line's end comes from joining the blocks.
    return full.select(*KEYS, "doc_no", "root_no", "position", F.substring(block, F.lit(1), F.length(block) - 1).alias("block"))


def write_normalized(docs: DataFrame, by_root: bool = False) -> DataFrame:
    """One text for each corpus version, or for each root of one."""
    return joined(normalized_blocks(docs), [*KEYS, "root_no"] if by_root else KEYS)


def per_scope(docs: DataFrame) -> DataFrame:
    """One text for each root document, with a file name from its number and name; notes go with what they lead to."""
    found = blocks(docs).join(tree.notes(docs).select(*KEYS, "doc_no", F.col("root_no").alias("noted_no")), [*KEYS, "doc_no"], "left")
    root = F.concat_ws(".", F.slice(F.split(F.coalesce("noted_no", "doc_no"), r"\."), 1, 2))
    found = found.withColumn("root_no", root)
    names = docs.where(F.size(numbers.segments("doc_no")) == 2).select(*KEYS, F.col("doc_no").alias("root_no"), text.safe_file_name(F.concat("doc_no", F.lit(" - "), "name")).alias("file_name"))
    return joined(found.join(names, [*KEYS, "root_no"]), [*KEYS, "file_name"])


def truncated(docs: DataFrame, most: int = 4, keep: Keep = written) -> DataFrame:
    """The documents at depth ``most`` or less whose ancestors are too; a note counts one below what its targets lead to."""
    kept, notes = truncated_parts(docs, most, keep)
    return kept.unionByName(notes)


def truncated_parts(docs: DataFrame, most: int = 4, keep: Keep = written) -> tuple[DataFrame, DataFrame]:
    """:func:`truncated` without notes, and its notes: apart, rows stay where they are."""
    depth = numbers.semantic_depth("doc_no", "doc_type")
    plain = docs.where("doc_type <> 'Needed Research'").withColumn("depth", depth)
    deep = plain.where(F.col("depth") > most).select(*KEYS, F.col("doc_no").alias("ancestor_no"))
    below = tree.lineage_keys(docs).join(deep, [*KEYS, "ancestor_no"], "left_semi").select(*KEYS, "doc_no").distinct()
    kept = plain.where(F.col("depth") <= most).join(below, [*KEYS, "doc_no"], "left_anti")
    targets = kept.where(F.col("depth") < most).select(*KEYS, F.col("doc_no").alias("root_no"))
    noted = tree.notes(docs, keep).join(targets, [*KEYS, "root_no"], "left_semi").select(*KEYS, "doc_no")
    return kept.drop("depth"), docs.where("doc_type = 'Needed Research'").join(noted, [*KEYS, "doc_no"], "left_semi")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw texts (corpus_id, version_id, text) from the files of :func:`write_files`; each file begins at a title."""
    found = spark.read.text(path, wholetext=True)
    return found.select(F.col("corpus_id").cast("string"), F.col("version_id").cast("string"), F.col("value").alias("text"))
