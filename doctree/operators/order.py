"""Places, running sums and carried values in order, without a task that takes a whole large group.

Groups that fit in a task are dealt by hash, and a window over each does the work: one shuffle. Rows of larger groups are dealt
by ranges of the order; a window works within a range, and what the ranges before it come to is added, or carried into
it. So a group of any size is spread over tasks, and small groups share one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctree.session import written

#: Writes a step and reads it again, as ``written`` does.
Keep = Callable[[DataFrame, str], DataFrame]

_OWN = "doctree_"
_PART = _OWN + "part"
#: Rows of a group that one task may take.
MOST_IN_TASK = 1_000_000


def _dealt(rows: DataFrame, by: list[str], most: int, small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame], keep: Keep) -> DataFrame:
    """``small`` of the rows of groups of at most ``most`` rows, and ``large`` of the others'. Where ``keep`` deals rows by the group, ``small`` needs no shuffle."""
    # Written first, as sizes and ranges would compute the rows again.
    base = keep(rows, "rows")
    # There are few of them: each has over ``most`` rows.
    big = written(base.groupBy(*by).agg(F.count("*").alias(_OWN + "n")).where(F.col(_OWN + "n") > most).select(*by), "large")
    if big.isEmpty():
        return small(base)
    return small(base.join(F.broadcast(big), by, "left_anti")).unionByName(large(base.join(F.broadcast(big), by, "left_semi")))


def _ranged(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return written(rows.repartitionByRange(*by, *order).withColumn(_PART, F.spark_partition_id()), "ranged")


def _before(by: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)


def running(rows: DataFrame, by: list[str], order: list[str], value: str, name: str, most: int = MOST_IN_TASK, keep: Keep = written) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of its group ``by`` up to its own, in ``order``, which must be total."""
    upto = lambda *keys: F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).cast("long")

    def large(some: DataFrame) -> DataFrame:
        ranged, before = _ranged(some, by, order), _OWN + "before"
        # A group has at most one row for each range here.
        sums = ranged.groupBy(*by, _PART).agg(F.sum(value).alias(before))
        sums = sums.withColumn(before, F.coalesce(F.sum(before).over(_before(by)), F.lit(0)))
        found = ranged.withColumn(name, upto(*by, _PART)).join(sums, [*by, _PART])
        return found.withColumn(name, (F.col(name) + F.col(before)).cast("long")).drop(_PART, before)

    return _dealt(rows, by, most, lambda some: some.withColumn(name, upto(*by)), large, keep)


def placed(rows: DataFrame, by: list[str], order: list[str], name: str = "position", most: int = MOST_IN_TASK, keep: Keep = written) -> DataFrame:
    """``rows`` with ``name``: their place in their group, from 1."""
    one = _OWN + "one"
    return running(rows.withColumn(one, F.lit(1)), by, order, one, name, most, keep).drop(one)


def carried(
    rows: DataFrame, by: list[str], order: list[str], last: dict[str, Column] | None = None, greatest: dict[str, Column] | None = None, own: bool = False, most: int = MOST_IN_TASK, keep: Keep = written
) -> DataFrame:
    """``rows`` with the last value that is not null (``last``) and the greatest value (``greatest``) of each given column over the
    rows before it in its group, in ``order``; with ``own``, over its own row too. Null where there is none.

    Each range's rows are scanned by themselves; the value that a range ends with is handed on to the ranges after it.
    """
    columns = {**(last or {}), **(greatest or {})}
    value = {n: f"{_OWN}value_{n}" for n in columns}
    rows = rows.withColumns({value[n]: c for n, c in columns.items()})

    def within(*keys: str) -> dict[str, Column]:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        return {n: (F.last(value[n], ignorenulls=True) if n in (last or {}) else F.max(value[n])).over(before) for n in columns}

    def large(some: DataFrame) -> DataFrame:
        ranged = _ranged(some, by, order)
        at = F.struct(*order)
        ends = ranged.groupBy(*by, _PART).agg(*(F.max_by(v, F.when(F.col(v).isNotNull(), at)).alias(v) if n in (last or {}) else F.max(v).alias(v) for n, v in value.items()))
        hand = {f"{_OWN}before_{n}": (F.last(v, ignorenulls=True) if n in (last or {}) else F.max(v)).over(_before(by)) for n, v in value.items()}
        ends = ends.select(*by, _PART, *(c.alias(n) for n, c in hand.items()))
        found = ranged.withColumns(within(*by, _PART)).join(ends, [*by, _PART])
        joined = {n: F.coalesce(n, f"{_OWN}before_{n}") if n in (last or {}) else F.greatest(n, f"{_OWN}before_{n}") for n in columns}
        return found.withColumns(joined).drop(_PART, *hand)

    return _dealt(rows, by, most, lambda some: some.withColumns(within(*by)), large, keep).drop(*value.values())
