"""Column functions on document numbers such as ``A.1.2.0.3.1``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffix that a supporting type adds to its parent's number.
SUFFIX = {
    "Scenario Variation": r"\.var\d+$",
    "Annotation": r"\.0\.3\.\d+$",
    "Action Tenet": r"\.0\.4\.\d+$",
    "Scenario": r"\.1\.\d+$",
    "Active Data": r"\.0\.6\.\d+$",
}
#: All that supporting types have added to a number, one after the other, and each of these.
_SUFFIXES = r"(?<=.)(?:\.var\d+|\.0\.[346]\.\d+|(?<=\.0\.4\.\d{1,99})\.1\.\d+)+$"
_ONE_SUFFIX = r"\.var\d+|\.0\.[346]\.\d+|\.1\.\d+"


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def segments(doc_no: Column | str) -> Column:
    return F.split(_c(doc_no), r"\.")


def prefixes(doc_no: Column | str, own: bool = False) -> Column:
    """The proper dotted prefixes from the shortest on; with ``own``, the number itself too."""
    number = _c(doc_no)
    n = F.length(number) - F.length(F.replace(number, F.lit("."))) + (1 if own else 0)
    # The number is not cut into segments for each of them.
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.call_function("substring_index", number, F.lit("."), i))).otherwise(F.array().cast("array<string>"))


def dotted_parent(doc_no: Column | str) -> Column:
    """The number without its last segment; null for one segment."""
    parts = segments(doc_no)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "."))


def parent_no(doc_no: Column | str, doc_type: Column | str) -> Column:
    """The parent's number by type. Null for research notes, for roots, and where a supporting type's suffix is missing."""
    number, kind = _c(doc_no), _c(doc_type)
    out = F.when(kind == "Needed Research", F.lit(None).cast("string"))
    for name, suffix in SUFFIX.items():
        out = out.when(kind == name, F.when(number.rlike("." + suffix), F.regexp_replace(number, suffix, "")))
    return out.otherwise(F.when(F.size(segments(number)) > 2, dotted_parent(number)))


def inferred_type(doc_no: Column | str) -> Column:
    number = _c(doc_no)
    depth = F.size(segments(number)) - 1
    return (
        F.when(number.startswith("NR-"), "Needed Research")
        .when(number.rlike(r"\.var\d+$"), "Scenario Variation")
        .when(number.rlike(r"\.0\.3\.\d+$"), "Annotation")
        .when(number.rlike(r"\.0\.6\.\d+$"), "Active Data")
        .when(number.rlike(r"\.0\.4\.\d+\.1\.\d+$"), "Scenario")
        .when(number.rlike(r"\.0\.4\.\d+$"), "Action Tenet")
        .when(depth == 1, "Scope")
        .when(depth == 2, "Article")
        .when(depth == 3, "Section")
        .otherwise("Core")
    )


def semantic_depth(doc_no: Column | str, doc_type: Column | str) -> Column:
    """Levels below the root. A supporting document is one below its parent, whose type is inferred from its number."""
    number, kind = _c(doc_no), _c(doc_type)
    first = F.when(kind.isin(*SUFFIX), parent_no(number, kind))
    bare = F.regexp_replace(first, _SUFFIXES, "")
    n = F.size(F.regexp_extract_all(F.regexp_extract(first, _SUFFIXES, 0), F.lit(_ONE_SUFFIX), F.lit(0)))
    supporting = F.when(~bare.startswith("NR-"), n + F.size(segments(bare)))
    depth = F.when(first.isNotNull(), supporting).otherwise(F.size(segments(number)) - 1)
    return F.when(kind != "Needed Research", depth)


def heading_level(doc_no: Column | str, doc_type: Column | str) -> Column:
    depth = semantic_depth(doc_no, doc_type)
    return F.when(depth.isNull(), 6).otherwise(F.least(F.lit(6), F.greatest(F.lit(1), depth)))


def segment_key(doc_no: Column | str) -> Column:
    """Sort key by segments: integers in order of value before text."""
    return F.transform(segments(doc_no), segment_struct)


def value_key(digits: Column) -> Column:
    """Sort key of a string of digits by its value, however long: the number of digits without leading zeros, then these."""
    bare = F.ltrim(digits, F.lit("0"))
    return F.struct(F.length(bare).alias("l"), bare.alias("d"))


def segment_struct(part: Column) -> Column:
    digits = part.rlike(r"^\d+$")
    return F.struct((~digits).cast("int").alias("k"), value_key(F.when(digits, part).otherwise("")).alias("n"), part.alias("s"))


def natural_key(doc_no: Column | str) -> Column:
    """Sort key of natural order: a leading ``letters.`` does not count, digits sort by value. Null (sort it last) if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(_c(doc_no), F.lit("")), r"(?U)^\s+|\s+$", ""), r"^[A-Za-z]+\.", "")
    chunks = F.regexp_extract_all(bare, F.lit(r"(\d+|\D+)"), F.lit(1))

    def key(chunk: Column) -> Column:
        digits = chunk.rlike(r"^\d")
        kind = F.when(digits, 1).when(chunk.rlike(r"^[\p{L}]"), 2).otherwise(0)
        return F.struct(kind.alias("k"), value_key(F.when(digits, chunk).otherwise("")).alias("n"), F.when(digits, "").otherwise(F.lower(chunk)).alias("s"))

    return F.when(bare != "", F.transform(chunks, key))
