"""Points in ranges as equi-joins, whatever the ranges' length.

A range [first, after) is the union of few dyadic intervals, [i * 2^k, (i + 1) * 2^k): two of each length at most. A point is in one
dyadic interval of each length. So a point is in a range where one of its intervals is one of the range's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths up to 2^LEVELS; places must be smaller.
LEVELS = 40
_NODE = ["doctree_level", "doctree_node"]


def cover(rows: DataFrame, first: str, after: str) -> DataFrame:
    """``rows`` with the dyadic intervals (doctree_level, doctree_node) of their range, one row each; empty ranges give none."""
    left, right = f"shiftright({first} + shiftleft(1L, k) - 1, k)", f"shiftright({after}, k)"
    node = "named_struct('doctree_level', k, 'doctree_node', {})"
    each = f"""flatten(transform(sequence(0, {LEVELS}), k -> array(
      CASE WHEN {left} < {right} AND {left} % 2 = 1 THEN {node.format(left)} END,
      CASE WHEN {left} + {left} % 2 < {right} AND {right} % 2 = 1 THEN {node.format(right + ' - 1')} END)))"""
    return rows.select("*", F.inline(F.filter(F.expr(each), lambda n: n.isNotNull())))


def _points(rows: DataFrame, point: str, levels: list[int]) -> DataFrame:
    return rows.select("*", F.explode(F.array(*(F.lit(k) for k in levels))).alias(_NODE[0])).withColumn(_NODE[1], F.expr(f"shiftright({point}, {_NODE[0]})"))


def _both(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, first: str, after: str) -> tuple[DataFrame, DataFrame]:
    covers = cover(ranges, first, after)
    levels = sorted(r[0] for r in covers.select(_NODE[0]).distinct().collect())  # LEVELS + 1 at most
    return _points(points, point, levels or [0]), covers


def points_in(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, first: str, after: str) -> DataFrame:
    """The ``points`` that are in some range of their group, each as often as it is there times the lengths that say so (take distinct ones)."""
    asked, covers = _both(points, ranges.select(*keys, first, after).distinct(), keys, point, first, after)
    return asked.join(covers.select(*keys, *_NODE).distinct(), [*keys, *_NODE], "left_semi").drop(*_NODE)


def ranges_with(ranges: DataFrame, points: DataFrame, keys: list[str], point: str, first: str, after: str) -> DataFrame:
    """The ``ranges`` that have some point of their group in them, repeated as :func:`points_in` repeats points."""
    asked, covers = _both(points.select(*keys, point).distinct(), ranges, keys, point, first, after)
    return covers.join(asked.select(*keys, *_NODE).distinct(), [*keys, *_NODE], "left_semi").drop(*_NODE)
