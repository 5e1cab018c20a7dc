"""Quality rules with adaptive thresholds, by DataFrame operations only.

Each text has four measures. For each language and source, the measures of its passable texts go into quantile
sketches, which merge by addition, from tasks to sources, from sources to languages, and from those to all texts.
A sketch is a histogram of bounded size: a value keeps its seven highest bits, so buckets are a 64th of their value
wide at most, a quantile read from a sketch is at most 1/64 below the exact one, and a sketch of values up to 2^63
has 64 * 58 buckets at most, whatever the number of texts. Thresholds are read from the sketches' medians and
tails in place of fixed cutoffs; each text is then joined with those of its source, of its language where the
source has few texts, or of all texts where the language has few.

Everything is counted in integers, so the same rows always give the same thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doctree.llm.common import SPACES, table, written

#: The base rules: fewer words fail; so do texts more than half of whose words lie in repeated windows.
LEAST_WORDS = 50
MOST_REPEATED = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: measure: whether too little of it fails too
MEASURES = {
    "symbols": False,  # symbols for each 1000 characters of words
    "repeats": False,  # words in repeated windows for each 1000 words
    "lines": False,  # repeated lines for each 1000 lines with a word
    "length": True,  # a word's length, in tenths of a character
}
#: Highest bits of a value that its bucket keeps.
BITS = 7
#: How many times the way from the median to the tail a threshold lies beyond the tail.
BEYOND = 2
#: Sketches of fewer texts give no thresholds of their own.
LEAST_TEXTS = 100
#: Working columns have this prefix, which no column of the input may have.
OWN = "doctree_"


def _repeat_words(frame: DataFrame) -> DataFrame:
    """``frame`` (words) with n_repeat_words: windows are sorted with their places, so equal ones are neighbours."""
    words, windows, starts = OWN + "words", OWN + "windows", OWN + "starts"
    window = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - F.lit(WINDOW - 1), F.lit(0))),
        lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")),
    )
    frame = frame.withColumn(windows, F.sort_array(window))

    def twice(e: Column, k: Column) -> Column:
        return F.coalesce(F.get(windows, k - 1)["w"] == e["w"], F.lit(False)) | F.coalesce(F.get(windows, k + 1)["w"] == e["w"], F.lit(False))

    frame = frame.withColumn(starts, F.sort_array(F.transform(F.filter(windows, twice), lambda e: e["i"])))
    steps = F.transform(starts, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - x, F.lit(WINDOW))))
    return frame.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)).drop(windows, starts)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed.

    A null text has no words. All counts are of the whole text. Columns of these names are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words, lines = OWN + "words", OWN + "lines"
    out = docs.withColumns(
        {
            words: F.filter(F.split(body, SPACES), lambda w: w != ""),
            lines: F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")),
            "word_chars": F.length(F.translate(body, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        }
    ).drop(text)
    out = out.withColumns({"n_words": F.size(words).cast("long"), "n_lines": F.size(lines).cast("long"), "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")}).drop(lines)
    out = _repeat_words(out).drop(words)
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def _values() -> dict[str, Column]:
    """The value of each measure, an integer; ratios are cut down."""
    return {
        "symbols": F.expr("n_symbols * 1000 div greatest(word_chars, 1)"),
        "repeats": F.expr("n_repeat_words * 1000 div greatest(n_words, 1)"),
        "lines": F.expr("n_dup_lines * 1000 div greatest(n_lines, 1)"),
        "length": F.expr("word_chars * 10 div greatest(n_words, 1)"),
    }


def bucket(value: Column) -> Column:
    """The least value of a value's bucket: its ``BITS`` highest bits."""
    low = F.greatest(F.length(F.bin(value)) - F.lit(BITS), F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the merged sketches of the rows that pass the base rules."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(c.cast("long")).alias("bucket")) for m, c in _values().items())))
    return rows.where(~F.col("base_failed")).select(F.col(OWN + "lang").alias("lang"), F.col(OWN + "source").alias("source"), each.alias("m")).groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def thresholds(merged: DataFrame) -> DataFrame:
    """(level, lang, source, texts, bounds) from sketches; bounds maps a measure to its least and greatest value.

    Level 0 is a source of a language, 1 a language, 2 all texts; the lower levels' counts add up to the upper's. A
    quantile is the least bucket that at least that share of the texts does not exceed. The tail is the 95th
    percentile, or the 99th where the 95th is the median itself (measures that most texts have nothing of); the
    greatest value lies ``BEYOND`` times the way from the median to the tail beyond the tail, and one bucket at least.
    The least value is the mirror image, from the 5th or 1st percentile.
    """
    level = merged.select(F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("level"), "*")
    level = level.select("level", F.when(F.col("level") < 2, F.col("lang")).alias("lang"), F.when(F.col("level") < 1, F.col("source")).alias("source"), "measure", "bucket", "n")
    counts = level.groupBy("level", "lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))
    # A sketch has a bounded number of buckets, so its window does too.
    group = Window.partitionBy("level", "lang", "source", "measure")
    counts = counts.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "texts": F.sum("n").over(group)})
    quantile = lambda k: F.min(F.when(100 * F.col("upto") >= k * F.col("texts"), F.col("bucket"))).alias(f"q{k}")
    q = counts.groupBy("level", "lang", "source", "measure").agg(F.max("texts").alias("texts"), *(quantile(k) for k in (1, 5, 50, 95, 99)))
    high = F.when(F.col("q95") > F.col("q50"), F.col("q95")).otherwise(F.col("q99"))
    low = F.when(F.col("q5") < F.col("q50"), F.col("q5")).otherwise(F.col("q1"))
    width = lambda c: F.greatest(F.lit(1), F.expr(f"{c} div {2 ** (BITS - 1)}"))
    q = q.withColumns({"high": high, "low": low})
    most = F.col("high") + F.greatest(BEYOND * (F.col("high") - F.col("q50")), width("high"))
    least = F.col("low") - F.greatest(BEYOND * (F.col("q50") - F.col("low")), width("low"))
    both = [m for m, two_sided in MEASURES.items() if two_sided]
    bounds = F.struct(F.when(F.col("measure").isin(both), least).alias("least"), most.alias("most"))
    q = q.select("level", "lang", "source", "texts", F.struct("measure", bounds.alias("b")).alias("e"))
    return q.groupBy("level", "lang", "source").agg(F.max("texts").alias("texts"), F.map_from_entries(F.collect_list("e")).alias("bounds"))


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_TEXTS) -> DataFrame:
    """The rows of ``docs`` with all columns but the text, the measures (see :func:`measured`), ``bounds`` and ``kept``.

    A row is kept if it passes the base rules and no measure lies beyond its thresholds. Null languages and sources
    are those of the name ''. Where all texts fail the base rules there are no thresholds. Repeated rows count each
    time; ties in a measure fall into one bucket. Columns named as an output column are replaced, and those
    whose name begins with ``doctree_lang`` or ``doctree_source`` are overwritten and dropped; all others stay. An empty table gives an empty one.
    """
    named = docs.withColumns({OWN + "lang": F.coalesce(F.col(lang), F.lit("")), OWN + "source": F.coalesce(F.col(source), F.lit(""))})
    rows = written(measured(named, text), "measured")
    found = written(thresholds(sketches(rows)), "thresholds")
    every = found.where("level = 2").first()  # one row, of four measures
    by_lang = found.where((F.col("level") == 1) & (F.col("texts") >= least)).select("lang", F.col("bounds").alias("of_lang"))
    by_source = found.where("level = 0").join(by_lang, "lang", "left")
    own = F.coalesce(F.when(F.col("texts") >= least, F.col("bounds")), "of_lang").alias("bounds")
    # One row for each source of a language. Their number is not proven to be small: Spark chooses the join by size.
    by_source = by_source.select(F.col("lang").alias(OWN + "lang"), F.col("source").alias(OWN + "source"), own)
    out = rows.drop("bounds", "kept").join(by_source, [OWN + "lang", OWN + "source"], "left")
    if every:
        entry = lambda b: F.struct(F.lit(b.least).cast("long").alias("least"), F.lit(b.most).cast("long").alias("most"))
        rest = F.create_map(*(x for m, b in every.bounds.items() for x in (F.lit(m), entry(b))))
        out = out.withColumn("bounds", F.coalesce("bounds", rest))
    kept = ~F.col("base_failed")
    for name, value in _values().items():
        b = F.col("bounds")[name]
        kept &= F.coalesce(value >= b["least"], F.lit(True)) & F.coalesce(value <= b["most"], F.lit(True))
    return out.withColumn("kept", kept).drop(OWN + "lang", OWN + "source")


def op2_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op2_adaptive_quality_rules": op2_adaptive_quality_rules}

ORACLE_SQL = {
    "op2_adaptive_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT r, s, w[s] || ' ' || w[s + 1] || ' ' || w[s + 2] AS k FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS s FROM d WHERE len(w) >= 3)),
rep AS (SELECT r, k FROM win GROUP BY r, k HAVING count(*) > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT win.r, unnest(generate_series(s, s + 2)) AS p FROM win JOIN rep USING (r, k)) GROUP BY r),
f AS (
  SELECT d.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cov ON cov.r = d.r),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols * 1000 // greatest(word_chars, 1) AS symbols,
    n_repeat_words * 1000 // greatest(n_words, 1) AS repeats, n_dup_lines * 1000 // greatest(n_lines, 1) AS lines, word_chars * 10 // greatest(n_words, 1) AS length FROM f),
v AS (UNPIVOT (SELECT r, lang, source, base_failed, symbols, repeats, lines, length FROM g) ON symbols, repeats, lines, length INTO NAME measure VALUE value),
m AS (SELECT lang, source, measure, (value >> greatest(length(bin(value)) - 7, 0)) << greatest(length(bin(value)) - 7, 0) AS bucket FROM v WHERE NOT base_failed),
lv AS (SELECT 0 AS level, lang, source, measure, bucket FROM m UNION ALL SELECT 1, lang, NULL, measure, bucket FROM m UNION ALL SELECT 2, NULL, NULL, measure, bucket FROM m),
c AS (SELECT level, lang, source, measure, bucket, count(*) AS n FROM lv GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS texts FROM c),
q AS (
  SELECT level, lang, source, measure, max(texts) AS texts, min(bucket) FILTER (100 * upto >= texts) AS q1, min(bucket) FILTER (100 * upto >= 5 * texts) AS q5,
    min(bucket) FILTER (100 * upto >= 50 * texts) AS q50, min(bucket) FILTER (100 * upto >= 95 * texts) AS q95, min(bucket) FILTER (100 * upto >= 99 * texts) AS q99
  FROM u GROUP BY level, lang, source, measure),
t AS (SELECT *, CASE WHEN q95 > q50 THEN q95 ELSE q99 END AS high, CASE WHEN q5 < q50 THEN q5 ELSE q1 END AS low FROM q WHERE level = 2 OR texts >= 100),
b AS (
  SELECT level, lang, source, measure, high + greatest(2 * (high - q50), 1, high // 64) AS most,
    CASE WHEN measure = 'length' THEN low - greatest(2 * (q50 - low), 1, low // 64) ELSE -1 END AS least FROM t),
i AS (
  SELECT v.r, bool_and(coalesce(value BETWEEN coalesce(b0.least, b1.least, b2.least) AND coalesce(b0.most, b1.most, b2.most), true)) AS inside FROM v
  LEFT JOIN b AS b0 ON b0.level = 0 AND b0.lang = v.lang AND b0.source = v.source AND b0.measure = v.measure
  LEFT JOIN b AS b1 ON b1.level = 1 AND b1.lang = v.lang AND b1.measure = v.measure
  LEFT JOIN b AS b2 ON b2.level = 2 AND b2.measure = v.measure GROUP BY v.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept FROM g JOIN i USING (r)
""",
}
