"""Line deduplication with a log-template tree of fixed depth, by DataFrame operations only.

A line's fields that vary (what has a digit, an address or a mail address) become ``<*>``. The tree's levels are the
number of tokens, the leading tokens, and two more tokens: those of the line's other (place, token) pairs that most
lines of its branch have. So a leaf is one key, and families of lines that start alike stand in different leaves.
Two templates are recognised:

* the line itself with its fields generalised, and
* the leaf's own: at each place the token that most of the leaf's distinct lines share, or ``<*>`` where none
  is shared by half of them. It holds if enough places are constant, and a line belongs to it if enough of its
  places agree.

A line that keeps too few tokens when its fields go, such as a row of a table, is compared as it stands.

A line is dropped where its template is there in several documents, from every document that has it. Copies count as
one document, or they would drop each other's lines: documents of equal text, documents that are nothing but the same
recurring templates, and near copies, which have little besides (see :func:`copies`). A document with more of its own counts by
itself, however much of it is boilerplate. Whether a copy as a whole should go is not judged here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctree.llm.common import LEAST_HOT, SPACES, row_key, table, written
from doctree.llm.simhash import components

#: Leading tokens that make a branch, with the number of tokens, and further tokens that make a leaf of it.
DEPTH, FURTHER = 3, 2
#: Documents that must have a template.
LEAST_DOCS = 6
#: Share of a template's places that must be constant, and of a line's that must agree.
SIMILAR = 0.7
#: Tokens that a generalised line must keep, besides the share ``SIMILAR``.
LEAST_KEPT = 3
#: Near copies have so many recurring lines or more, which make up four fifths of their words, and are linked by those that have half
#: the words of their heaviest, or more.
RECURRING, COPIED, HEAVY = 3, 0.8, 0.5
FIELD = "<*>"
#: Tables of up to so many rows, and values in their arrays, are sent to all tasks, by way of the driver, which holds some 100 bytes for each; others are joined by shuffling.
MOST_SENT = 100_000
#: A token with a digit, an address or a mail address; it is tried at a token's start only.
_FIELDS = "(?<![^\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D]*?(?:[0-9@]|://))[^\\x20\\x09-\\x0D]+"


def lines(docs: DataFrame, text: str = "text", depth: int = DEPTH) -> DataFrame:
    """k_id, k_text, place, line, h, g, size, branch of each line with a word. Lines end with a line feed.

    ``line`` has single blanks, and is generalised if enough of its tokens stay; h and g are two hashes that stand for it
    (96 bits), size is its number of tokens, and branch stands for its size and leading tokens.
    """
    # Most texts have neither fields nor odd blanks; one look at the text spares their lines the patterns.
    body = F.col(text)
    fields = body.rlike("[0-9@]") | F.contains(body, F.lit("://"))
    blanks = reduce(lambda x, y: x | y, (F.contains(body, F.lit(c)) for c in ("  ", "\t", "\r", "\x0b", "\x0c")))
    # What is said of whole texts stands in a projection of its own, or it would be worked out for each line.
    whole = docs.where(body.isNotNull()).select(*row_key(text=text), fields.alias("fields"), blanks.alias("blanks"), F.split(body, "\n").alias("lines"))
    each = whole.select("k_id", "k_text", "fields", "blanks", F.posexplode("lines").alias("place", "raw"))
    bare = F.trim(F.when(F.col("blanks"), F.regexp_replace("raw", SPACES, " ")).otherwise(F.col("raw")))
    each = each.select("k_id", "k_text", "fields", "place", bare.alias("bare")).where("bare <> ''")
    size = F.length("bare") - F.length(F.replace("bare", F.lit(" "))) + 1
    general = F.when(F.col("fields"), F.regexp_replace("bare", _FIELDS, FIELD)).otherwise(F.col("bare"))
    each = each.withColumns({"size": size, "general": general})
    kept = F.col("size") - F.size(F.filter(F.split("general", " "), lambda t: t == FIELD))
    enough = kept >= F.greatest(F.lit(LEAST_KEPT), F.ceil(F.lit(SIMILAR) * F.col("size")))
    line = F.when(F.col("general") == F.col("bare"), F.col("bare")).when(enough, F.col("general")).otherwise(F.col("bare"))
    each = each.select("k_id", "k_text", "place", "size", line.alias("line")).withColumns({"h": F.xxhash64("line"), "g": F.hash("line")})
    return each.withColumn("branch", F.xxhash64("size", F.substring_index("line", " ", depth)))


def leaves(members: DataFrame, depth: int = DEPTH, further: int = FURTHER) -> DataFrame:
    """``members`` (h, g, branch, size, line) with leaf: a hash of the branch and the line's ``further`` best pairs in it.

    A pair is a token and its place behind the leading ones; the best has most lines of the branch, then the first place.
    """
    tokens = F.slice(F.split("line", " "), F.lit(depth + 1), F.greatest(F.col("size") - depth, F.lit(0)))
    pairs = members.select("h", "g", "branch", F.posexplode(tokens).alias("at", "token"))
    counts = pairs.groupBy("branch", "at", "token").agg(F.count("*").alias("m"))
    ranked = found(pairs, counts, ["branch", "at", "token"]).groupBy("h", "g").agg(F.sort_array(F.collect_list(F.struct((-F.col("m")).alias("m"), "at", "token"))).alias("best"))
    best = F.sort_array(F.transform(F.slice("best", 1, further), lambda b: F.struct(b["at"], b["token"])))
    leaf = members.join(ranked.select("h", "g", best.alias("best")), ["h", "g"]).withColumn("leaf", F.xxhash64("branch", "best"))
    return leaf.drop("best")


def templates(each: DataFrame, least_docs: int = LEAST_DOCS, depth: int = DEPTH, similar: float = SIMILAR) -> DataFrame:
    """(h, g, leaf) of the generalised lines whose template recurs; leaf is null where the line itself is the template.

    ``each`` are lines as :func:`lines` has them. Only what branches that several lines share hold is read as text.
    """
    by_text = each.select("h", "g", "branch", "size", "k_text").distinct()
    distinct = written(by_text.groupBy("h", "g", "branch", "size").agg(F.count("*").alias("texts")), "lines")
    exact = distinct.where(F.col("texts") >= least_docs).select("h", "g", F.lit(None).cast("long").alias("leaf"))
    # Branches that could have a leaf with a template: several lines that are longer than the leading tokens, and enough texts.
    grown = distinct.where(F.col("size") > depth).groupBy("branch").agg(F.count("*").alias("n"), F.sum("texts").alias("texts"))
    grown = written(grown.where((F.col("n") > 1) & (F.col("texts") >= least_docs)).select("branch"), "branches")
    some = each.where(F.col("size") > depth).join(F.broadcast(grown) if grown.count() <= MOST_SENT else grown, "branch")
    members = written(some.groupBy("h", "g").agg(*(F.first(c).alias(c) for c in ("branch", "size", "line"))), "members")
    members = written(leaves(members, depth), "leaves")
    places = members.select("leaf", "size", F.posexplode(F.split("line", " ")).alias("at", "token"))
    n = members.groupBy("leaf").agg(F.count("*").alias("n"))
    shared = places.groupBy("leaf", "size", "at", "token").agg(F.count("*").alias("m"))
    shared = found(shared, n, ["leaf"]).where(F.col("m") * 2 > F.col("n"))
    own = shared.groupBy("leaf", "size").agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("constant"))
    own = own.where(F.size("constant") >= F.greatest(F.lit(depth + 1), F.ceil(F.lit(similar) * F.col("size")))).select("leaf", "constant")
    agree = F.size(F.filter("constant", lambda c: F.get("tokens", c["at"]) == c["token"]))
    fitting = found(members, own, ["leaf"]).where("constant is not null").withColumn("tokens", F.split("line", " ")).where(agree >= F.lit(similar) * F.col("size")).select("h", "g", "leaf")
    fitting = written(fitting, "fitting")
    counted = found(by_text, fitting, ["h", "g"]).where("leaf is not null").select("leaf", "k_text").distinct().groupBy("leaf").agg(F.count("*").alias("texts"))
    general = found(fitting, counted, ["leaf"]).where(F.col("texts") >= least_docs).select("h", "g", "leaf")
    return exact.unionByName(general)


def _template(gone: DataFrame) -> DataFrame:
    """(h, g, t): the template that stands for each line of ``gone``, the leaf's own where it has one."""
    return gone.groupBy("h", "g").agg(F.coalesce(F.max("leaf"), F.xxhash64("h", "g")).alias("t"))


def copies(each: DataFrame, own: DataFrame) -> DataFrame:
    """(k_text, root) of the texts that are copies of others, or could be; root is the same within a group.

    ``own`` (k_text, t, size, lines) are the recurring templates of each text with the words and the number of its lines that have
    them. What is judged is what is no template: a text with ``RECURRING`` such lines or more that has a fifth or less of its words
    besides is a near copy of those that have the same heavy templates. Each such text links its heavy templates, and a
    group is what is linked; so copies that have lost one of them, each another, are one group still. Links are between
    templates: texts are not paired. A text with fewer recurring lines is a copy if it has nothing else, of those that have the same.
    """
    words = each.groupBy("k_text").agg(F.sum("size").alias("words"))
    told = own.groupBy("k_text").agg(F.sum("size").alias("told"), F.sum("lines").alias("lines"), F.max("size").alias("most"), F.sort_array(F.collect_list(F.struct("t", "size"))).alias("all"))
    told = told.join(words, "k_text").where(F.col("told") >= F.lit(COPIED) * F.col("words"))
    few = F.col("lines") < RECURRING
    alone = F.when(few & (F.col("told") == F.col("words")), F.xxhash64("all.t"))
    heavy = F.filter("all", lambda x: x["size"] >= F.lit(HEAVY) * F.col("most"))["t"]
    told = written(told.select("k_text", F.when(~few, heavy).alias("heavy"), alone.alias("alone")).where("heavy is not null or alone is not null"), "told")
    first = F.element_at("heavy", 1)
    # Far fewer than texts: pairs of templates that some text has among its heavy ones.
    pairs = told.where("heavy is not null").select(first.alias("a"), F.explode("heavy").alias("b")).where("a <> b").distinct()
    groups = written(components(pairs).select(F.col("node").alias("t"), F.col("root").alias("group")), "groups")
    near = told.where("heavy is not null").select("k_text", first.alias("t"))
    root = lambda kind, c: F.xxhash64(F.lit(kind), c).alias("root")
    near = found(near, groups, ["t"]).select("k_text", root("near", F.coalesce("group", "t")))
    return near.unionByName(told.where("alone is not null").select("k_text", root("alone", F.col("alone"))))


def weight(table: DataFrame) -> int:
    """The number of rows, and of values in their arrays: what a table takes where it is held whole."""
    arrays = [F.greatest(F.size(c), F.lit(0)) for c, kind in table.dtypes if kind.startswith("array")]
    return table.agg(F.coalesce(F.sum(reduce(lambda x, y: x + y, arrays, F.lit(1))), F.lit(0))).first()[0] if arrays else table.count()


def found(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` left-joined with a ``table`` that has each of ``keys`` once. A short table goes to all tasks, so that keys which many rows share do
    not matter; beyond that, those that are shared most go to all tasks, and only the others' rows are shuffled by key."""
    table = written(table, "table")
    if weight(table) <= MOST_SENT:
        return rows.join(F.broadcast(table), keys, "left")
    n = rows.groupBy(*keys).agg(F.count("*").alias("doctree_n")).where(F.col("doctree_n") > LEAST_HOT)
    # Each has over LEAST_HOT rows: a hundred-thousandth as many as rows at most.
    hot = F.broadcast(written(table.join(n, keys, "left_semi"), "hot"))
    return rows.join(hot, keys, "inner").unionByName(rows.join(hot, keys, "left_anti").join(table, keys, "left"))


def recurring(each: DataFrame, least_docs: int = LEAST_DOCS, **limits: float) -> DataFrame:
    """(h, g) of the lines whose template so many documents have, copies counted as one."""
    stands = written(_template(written(templates(each, least_docs, **limits), "templates")), "stands")
    own = found(each, stands, ["h", "g"]).where("t is not null").groupBy("k_text", "t").agg(F.sum("size").alias("size"), F.count("*").alias("lines"))
    own = written(own, "own")
    groups = written(copies(each, own), "copies")
    # A line counts by its leaf's template and, if it recurs by itself, as it is.
    grouped = own.join(groups, "k_text", "left").select("t", F.coalesce("root", "k_text").alias("root"))
    by_template = grouped.distinct().groupBy("t").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs).select("t")
    return found(stands, by_template.withColumn("often", F.lit(True)), ["t"]).where("often").select("h", "g")


def dropped(docs: DataFrame, text: str = "text", depth: int = DEPTH, **limits: float) -> DataFrame:
    """k_id, k_text, places (of the lines to drop, from 0) of each text that has some to drop."""
    each = written(lines(docs, text, depth), "each")
    gone = written(recurring(each, depth=depth, **limits), "recurring")
    # Lines of one template, however many documents have it, are dealt by text here.
    marked = found(each.select("k_id", "k_text", "place", "h", "g"), gone.withColumn("gone", F.lit(True)), ["h", "g"]).where("gone")
    return marked.groupBy("k_id", "k_text").agg(F.collect_set("place").alias("places"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **limits: float) -> DataFrame:
    """All rows of ``docs`` with all their columns, lines dropped from ``text``, plus ``dropped_lines``, their number.

    A null text stays null. Repeated rows, and rows of equal id and text, lose the same lines; copies of a text count
    as one document when templates are counted. Lines without a word always stay. Lines and texts of any length are
    taken whole. A column ``dropped_lines`` of the input is replaced. An empty table gives an empty one.
    """
    own = "doctree_"
    places = dropped(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), **limits)
    places = written(places, "places").select(*(F.col(c).alias(own + c) for c in ("k_id", "k_text", "places")))
    a, b = row_key(doc_id, text)
    keyed = docs.drop("dropped_lines").withColumns({own + "k_id": a, own + "k_text": b}).join(places, [own + "k_id", own + "k_text"], "left")
    gone = F.coalesce(F.col(own + "places"), F.array().cast("array<int>"))
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    out = keyed.withColumn(text, F.when(F.size(gone) == 0, F.col(text)).otherwise(kept)).withColumn("dropped_lines", F.size(gone))
    return out.select(*(c for c in docs.columns if c != "dropped_lines"), "dropped_lines")


def op5_log_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = deduplicated(docs)
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    return found.select(
        "doc_id",
        (n + F.col("dropped_lines")).cast("long").alias("n_lines"),
        F.col("dropped_lines").cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


QUERIES = {"op5_log_template_line_dedup": op5_log_template_line_dedup}

ORACLE_SQL = {
    "op5_log_template_line_dedup": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
raw AS (SELECT r, text AS h, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM d WHERE text IS NOT NULL),
bare AS (SELECT r, h, p, trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS bare FROM raw),
gener AS (SELECT *, regexp_replace(bare, '[^\x20\x09-\x0D]*([0-9]|://|@)[^\x20\x09-\x0D]*', '<*>', 'g') AS general FROM bare),
l AS (
  SELECT r, h, p, CASE WHEN len(string_split(general, ' ')) - len(list_filter(string_split(general, ' '), lambda t: t = '<*>')) >= greatest(3, ceil(0.7 * len(string_split(general, ' ')))) THEN general ELSE bare END AS line
  FROM gener),
ids AS (SELECT text AS h, min(r) AS t FROM d WHERE text IS NOT NULL GROUP BY text),
e AS (SELECT r, t, p, line, string_split(line, ' ') AS w, len(string_split(line, ' ')) AS size, array_to_string(string_split(line, ' ')[1:3], ' ') AS lead FROM l JOIN ids USING (h) WHERE line <> ''),
u AS (SELECT line, any_value(w) AS w, any_value(size) AS size, any_value(lead) AS lead, count(DISTINCT t) AS texts FROM e GROUP BY line),
exact AS (SELECT line FROM u WHERE texts >= 6),
branch AS (SELECT size, lead FROM u WHERE size > 3 GROUP BY size, lead HAVING count(*) > 1 AND sum(texts) >= 6),
mem AS (SELECT u.line, u.w, size, lead FROM u JOIN branch USING (size, lead)),
tok AS (SELECT line, size, lead, unnest(w) AS t, generate_subscripts(w, 1) AS a FROM mem),
cnt AS (SELECT size, lead, a, t, count(*) AS m FROM tok WHERE a > 3 GROUP BY size, lead, a, t),
best AS (SELECT line, list({'a': a, 't': t} ORDER BY a) AS best FROM (SELECT line, a, t, row_number() OVER (PARTITION BY line ORDER BY m DESC, a) AS k FROM tok JOIN cnt USING (size, lead, a, t)) WHERE k <= 2 GROUP BY line),
leaf AS (SELECT mem.line, w, size, {'s': size, 'l': lead, 'b': best} AS leaf FROM mem JOIN best USING (line)),
con AS (
  SELECT leaf, size, a, t FROM (SELECT leaf, size, unnest(w) AS t, generate_subscripts(w, 1) AS a FROM leaf) JOIN (SELECT leaf, count(*) AS n FROM leaf GROUP BY leaf) USING (leaf)
  GROUP BY leaf, size, n, a, t HAVING count(*) * 2 > n),
gr AS (SELECT leaf FROM con GROUP BY leaf, size HAVING count(*) >= greatest(4, ceil(0.7 * size))),
fit AS (SELECT m.line, m.leaf FROM leaf m JOIN gr USING (leaf) JOIN con c USING (leaf) WHERE m.w[c.a] = c.t GROUP BY m.line, m.leaf, m.size HAVING count(*) >= 0.7 * m.size),
gen AS (SELECT line, leaf FROM fit JOIN (SELECT leaf, count(DISTINCT e.t) AS texts FROM e JOIN fit USING (line) GROUP BY leaf) USING (leaf) WHERE texts >= 6),
stands AS (
  SELECT line, {'leaf': leaf, 'line': CASE WHEN leaf IS NULL THEN line END} AS t FROM (SELECT line FROM exact UNION SELECT line FROM gen) LEFT JOIN gen USING (line)),
tids AS (SELECT t, row_number() OVER () AS i FROM (SELECT DISTINCT t FROM stands)),
weighed AS (SELECT e.t AS k, s.t AS t, sum(size) AS size, count(*) AS lines FROM e JOIN stands s USING (line) GROUP BY e.t, s.t),
words AS (SELECT t AS k, sum(size) AS words FROM e GROUP BY t),
told AS (SELECT k, sum(size) AS told, sum(lines) AS lines, list(i ORDER BY i) AS every, any_value(words) AS words FROM weighed JOIN words USING (k) JOIN tids USING (t) GROUP BY k HAVING sum(size) >= 0.8 * any_value(words)),
heavy AS (
  SELECT k, i, row_number() OVER (PARTITION BY k ORDER BY i) AS rank FROM (SELECT weighed.k, i, weighed.size, max(weighed.size) OVER (PARTITION BY weighed.k) AS most FROM weighed JOIN told USING (k) JOIN tids USING (t) WHERE told.lines >= 3)
  WHERE size >= 0.5 * most),
edge AS (SELECT DISTINCT x.i AS a, y.i AS b FROM heavy x JOIN heavy y USING (k) WHERE x.rank = 1 AND y.rank > 1),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
walk(i, root) AS (SELECT a, a FROM both_ways UNION SELECT b.b, walk.root FROM walk JOIN both_ways b ON b.a = walk.i WHERE walk.root < b.b),
comp AS (SELECT i, min(root) AS root FROM walk GROUP BY i),
root AS (
  SELECT k, 'near ' || coalesce(comp.root, heavy.i) AS root FROM heavy LEFT JOIN comp USING (i) WHERE rank = 1
  UNION ALL SELECT k, 'alone ' || CAST(every AS VARCHAR) FROM told WHERE lines < 3 AND told = words),
own AS (SELECT k, t FROM weighed),
often AS (SELECT t FROM own LEFT JOIN root USING (k) GROUP BY t HAVING count(DISTINCT coalesce(root, CAST(k AS VARCHAR))) >= 6),
gone AS (SELECT line FROM stands SEMI JOIN often USING (t)),
mark AS (SELECT e.*, g.line IS NOT NULL AS gone FROM e LEFT JOIN gone g USING (line)),
per AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_gone FROM mark GROUP BY r),
kept AS (SELECT raw.r, string_agg(raw.x, chr(10) ORDER BY raw.p) AS t FROM raw LEFT JOIN mark ON mark.r = raw.r AND mark.p = raw.p WHERE NOT coalesce(mark.gone, false) GROUP BY raw.r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_gone, 0) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN per USING (r) LEFT JOIN kept USING (r)
""",
}
