"""Column functions on names, bodies, links and identifiers. Lengths are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifiers, links, labels and tokens as the corpora's format has them.
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
LINK = r"\[([^\]]+)\]\(([^)]+)\)"
LABEL = r"^\*\*(.+?)\*\*:\s*$"
TOKEN = r"\[[^\]]*\]\([^)]*\)|[^\s\[\]();,.:'\"]+|[();,.:'\"]+|\s+"


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def trimmed(c: Column | str) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def is_blank(c: Column | str) -> Column:
    return ~_c(c).rlike(r"(?U)\S")


def normalized_content(c: Column | str) -> Column:
    """straight quotes, and hyphens for bullets."""
    return F.translate(_c(c), "“”•", '""-')


def trim_blank_lines(c: Column | str) -> Column:
    """without blank lines at both ends; the first line's indentation stays."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"(?U)\A(?:[^\S\n]*\n)+", ""), r"(?U)(?:\n[^\S\n]*)+\z|\A\s+\z", "")


def list_markers(c: Column | str) -> Column:
    """odd bullets at a line's start become hyphens."""
    return F.regexp_replace(_c(c), r"(?m)^([ \t]*)[◦•][ \t]*", "$1- ")


def inline_code_repair(c: Column | str) -> Column:
    """a closing backtick alone on the next line goes back to its code."""
    return F.regexp_replace(_c(c), r"(`[^`\n]+)\n[ \t]*`", "$1`")


def math_spans(c: Column | str) -> Column:
    """display ($$..$$) and inline ($..$) formulas; a dollar before a digit is money."""
    display = F.regexp_extract_all(_c(c), F.lit(r"(?s)\$\$(.+?)\$\$"), F.lit(1))
    rest = F.regexp_replace(_c(c), r"(?s)\$\$.+?\$\$", "")
    inline = F.regexp_extract_all(rest, F.lit(r"\$(?![\d\s])([^$\n]+?)\$(?!\d)"), F.lit(1))
    return F.struct(display.alias("display"), inline.alias("inline"))


def links(c: Column | str) -> Column:
    """F8: array of (text, href, kind) with kind uuid, external or other."""
    text = F.regexp_extract_all(_c(c), F.lit(LINK), F.lit(1))
    href = F.regexp_extract_all(_c(c), F.lit(LINK), F.lit(2))
    kind = lambda h: F.when(h.rlike(f"^{UUID}$"), "uuid").when(h.rlike("^(?i)https?://"), "external").otherwise("other")
    return F.zip_with(text, href, lambda t, h: F.struct(t.alias("text"), h.alias("href"), kind(h).alias("kind")))


def strip_links(c: Column | str) -> Column:
    """F9."""
    return F.regexp_replace(_c(c), LINK, "$1")


def snippet(c: Column | str, query: str, most: int = 150) -> Column:
    """``most`` characters around the first match, with ellipses where text is left out."""
    plain, q = strip_links(c), query.strip().lower()
    at = F.locate(q, F.lower(plain)) - 1 if q else F.lit(-1)
    n = F.length(plain)
    wanted = F.greatest(F.lit(0), at - F.lit((most - len(q)) // 2))
    start = F.when(wanted + most > n, F.greatest(F.lit(0), n - most)).otherwise(wanted)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), trimmed(F.substring(plain, start + 1, F.lit(most))), F.when(start + most < n, "...").otherwise(""))
    return F.when(n <= most, plain).when(at < 0, F.concat(trimmed(F.substring(plain, 1, most)), F.lit("..."))).otherwise(cut)


def _literal(query: str) -> str:
    return "".join("\\" + x if not x.isalnum() and not x.isspace() else x for x in query.strip())


def highlights(c: Column | str, query: str) -> Column:
    """how often the query stands in the text, whatever the case."""
    return F.regexp_count(_c(c), F.lit("(?i)" + _literal(query))) if query.strip() else F.lit(0)


def highlight_spans(c: Column | str, query: str) -> Column:
    """array of (start, length) of the query's places in the text, from 0, whatever the case; they do not overlap."""
    n = len(query.strip())
    if not n:
        return F.array().cast("array<struct<start:int,length:int>>")
    before = F.split(_c(c), "(?i)" + _literal(query), -1)
    gaps = F.slice(before, F.lit(1), F.greatest(F.size(before) - 1, F.lit(0)))
    ends = F.aggregate(gaps, F.array().cast("array<int>"), lambda acc, g: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(g) + n)))
    return F.transform(ends, lambda e: F.struct((e - n).alias("start"), F.lit(n).alias("length")))


def slugify(c: Column | str) -> Column:
    """F12."""
    bare = F.regexp_replace(trimmed(F.lower(_c(c))), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\s+", "-"), "-+", "-"), "^-+|-+$", "")


def safe_file_name(c: Column | str) -> Column:
    """F13."""
    return F.regexp_replace(_c(c), r'[/\\:*?"<>|]', "_")


def normalized_uuid(c: Column | str) -> Column:
    """lower case with hyphens; null for what is no UUID with or without them."""
    bare = F.lower(F.replace(_c(c), F.lit("-"), F.lit("")))
    cut = F.concat_ws("-", *(F.substring(bare, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), cut)


def bare_uuid(c: Column | str) -> Column:
    """lower case without hyphens; null for what is no UUID."""
    return F.replace(normalized_uuid(c), F.lit("-"), F.lit(""))


def uuid_lookup_key(c: Column | str) -> Column:
    return F.coalesce(normalized_uuid(c), F.lower(_c(c)))


def valid_uuid(c: Column | str) -> Column:
    """P9."""
    return _c(c).rlike(f"^{UUID}$")


def yaml_quote(c: Column | str) -> Column:
    """double quotes where the name has a character that YAML could read otherwise."""
    escaped = F.replace(F.replace(_c(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(_c(c).rlike("[\"'&:#{}\\[\\]!|>%@`]"), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(_c(c))


def yaml_unquote(c: Column | str) -> Column:
    t = trimmed(c)
    inner = F.substring(t, F.lit(2), F.length(t) - 2)
    plain = F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when((F.length(t) >= 2) & t.startswith('"') & t.endswith('"'), plain).otherwise(t)


def parse_targets(c: Column | str) -> Column:
    """``[a, b]`` as an array; null for what is no list."""
    t = trimmed(c)
    items = F.filter(F.transform(F.split(F.substring(t, F.lit(2), F.length(t) - 2), ","), trimmed), lambda x: x != "")
    return F.when(t.startswith("[") & t.endswith("]"), items)


def heading_line(level: Column, doc_no: Column, name: Column, doc_type: Column, uuid: Column) -> Column:
    """the title line, with two blanks before the comment."""
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "), doc_no, F.lit(" - "), name, F.lit(" ["), doc_type, F.lit("]  <!-- UUID: "), F.coalesce(uuid, F.lit("")), F.lit(" -->"))


def normalized_body(c: Column | str) -> Column:
    """Links without their target's number, and plain blanks, so that renumbering does not count as an edit."""
    plain = F.replace(_c(c), F.lit("\u00a0"), F.lit(" "))
    return F.regexp_replace(plain, r"\[(\*{0,2})([A-Z][\d.]+)\s*-\s*([^\]]+?)\1\]\(([^)]+)\)", r"[$1$3$1]($4)")


def label_group_key(c: Column | str) -> Column:
    """F22."""
    return trimmed(F.regexp_replace(F.regexp_replace(F.lower(_c(c)), "[-‐-―]+", " "), r"\s+", " "))


def node_id(uuid: Column, doc_no: Column, path: Column) -> Column:
    """F25."""
    return F.coalesce(F.when(uuid != "", uuid), F.when(doc_no != "", doc_no), path)


def child_type(c: Column | str) -> Column:
    """the frontmatter's child type."""
    found = {"Article": "articles", "Active Data": "active_data", "Annotation": "annotations", "Scenario": "tenets", "Scenario Variation": "tenets", "Needed Research": "needed_research"}
    return F.coalesce(F.create_map(*(F.lit(x) for p in found.items() for x in p))[_c(c)], F.lit("sections_and_primary_docs"))


def frontmatter_depth(doc_no: Column, doc_type: Column) -> Column:
    n = F.size(F.split(doc_no, r"\."))
    return F.when(doc_type == "Needed Research", 2).when((doc_type == "Scope") | F.element_at(F.split(doc_no, r"\."), -1).startswith("var"), n - 1).otherwise(n)


def mapping_json(pairs: Column) -> Column:
    """F16: an array of (key, value) structs as a JSON object; of equal keys the last counts."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.to_json(F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))))


def mapping_of(c: Column | str) -> Column:
    """F16: the map from a JSON object of strings; null for what is none."""
    return F.from_json(_c(c), "map<string,string>")


def guarded(c: Column | str, most: int = 1_000_000) -> Column:
    """at most so many characters, for renderers that must not be given more. Nothing here that reads bodies uses it."""
    return F.substring(_c(c), 1, most)


def content_hash(c: Column | str) -> Column:
    """F23."""
    return F.sha1(_c(c).cast("binary"))


def shown_value(c: Column | str) -> Column:
    """an extra field's value as it is shown: ``-`` for none."""
    return F.coalesce(_c(c), F.lit("-"))


def shown_list(c: Column | str) -> Column:
    """a list of values, joined; ``-`` for none."""
    return F.coalesce(F.array_join(_c(c), ", "), F.lit("-"))
