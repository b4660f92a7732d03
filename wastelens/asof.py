"""The reporting clock.

Every operator that needs "today" or "now" takes it from an :class:`AsOf`: an explicit value, or
the latest value found in a frame. The latter is read once, on first use, and is a literal from
then on: one column scan serves every bound of every query of a warehouse, and date predicates
with literals prune month directories and Parquet row groups at planning time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class AsOf:
    def __init__(self, value: dt.date | dt.datetime | None = None, frame: DataFrame | None = None):
        if (value is None) == (frame is None):
            raise ValueError("give either a value or a one-row, one-column frame")
        self._value = value
        self._frame = frame
        self._kind: T.DataType | None = None

    @classmethod
    def latest(cls, df: DataFrame, column: Column | str) -> AsOf:
        column = F.col(column) if isinstance(column, str) else column
        return cls(frame=df.agg(F.max(column).alias("as_of")))

    def get(self, fn: Callable[[Column], Column] = lambda d: d) -> Column:
        """``fn`` applied to the clock, usable in any expression. An empty source gives null."""
        if self._frame is not None:
            self._value, self._kind = self._frame.first()[0], self._frame.schema[0].dataType
            self._frame = None
        clock = F.lit(self._value)
        return fn(clock.cast(self._kind) if self._kind is not None else clock)


def days_before(n: int) -> Callable[[Column], Column]:
    return lambda d: F.date_sub(d, n)


def days_after(n: int) -> Callable[[Column], Column]:
    return lambda d: F.date_add(d, n)


def today(d: Column) -> Column:
    return d


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def year_start(d: Column) -> Column:
    return F.trunc(d, "year")


def in_period(
    df: DataFrame,
    as_of: AsOf,
    first: Callable[[Column], Column] | None = None,
    last: Callable[[Column], Column] | None = None,
    before: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Keep rows with ``first <= fecha <= last`` and ``fecha < before``; each bound is optional.

    Frames whose stored column is a timestamp expose it as ``momento``; the bounds are then
    put on that column, so that they reach the Parquet scan instead of a cast of it. Facts stored
    by month carry ``mes``; the same bounds then also skip whole directories.
    """
    stored = "momento" if "momento" in df.columns else "fecha"
    kind = df.schema[stored].dataType
    month = F.col("mes").cast("string") if "mes" in df.columns else None
    if first is not None:
        df = df.filter(F.col(stored) >= as_of.get(lambda d: first(d).cast(kind)))
        if month is not None:
            df = df.filter(month >= as_of.get(lambda d: F.date_format(first(d), "yyyy-MM")))
    for bound in (last, before):
        if bound is None:
            continue
        limit = (lambda d: F.date_add(last(d), 1)) if bound is last else before
        df = df.filter(F.col(stored) < as_of.get(lambda d: limit(d).cast(kind)))
        if month is not None:
            df = df.filter(month <= as_of.get(lambda d: F.date_format(limit(d), "yyyy-MM")))
    return df


def trailing(df: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """Rows dated ``as_of - days`` or later. No upper bound: later-dated rows count."""
    return in_period(df, as_of, first=days_before(days))


def previous(df: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """Rows of the half-open period before the trailing one."""
    return in_period(df, as_of, first=days_before(2 * days), before=days_before(days))
