"""Window helpers: all frames share one partitioning and order, so a plan sorts each panel once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

HORIZONS = (1, 3, 7, 14, 21)


#: What parts the rows of a window: the symbol, and in a panel that is cut by time its slice.
_PARTS: ContextVar[tuple[str, ...]] = ContextVar("parts", default=("symbol",))


@contextmanager
def windows_by(*parts: str) -> Iterator[None]:
    """Windows made within part their rows by these columns."""
    before = _PARTS.set(parts)
    try:
        yield
    finally:
        _PARTS.reset(before)


def by_day() -> WindowSpec:
    """A symbol's rows in order of day; made when asked for, as it needs a session."""
    return Window.partitionBy(*_PARTS.get()).orderBy("d")


def roll(n: int):
    """The last n rows, this one included."""
    return by_day().rowsBetween(-(n - 1), 0)


def past(n: int):
    """The n rows before this one."""
    return by_day().rowsBetween(-n, -1)


def ahead(first: int, last: int):
    return by_day().rowsBetween(first, last)


def with_least(value: Column, x: Column, frame, least: int) -> Column:
    """value where the frame has at least so many non-null x."""
    return F.when(F.count(x).over(frame) >= least, value)


def zscore(x: Column, n: int, least: int) -> Column:
    """(x - mean) / sample deviation over the last n rows; null on a flat or short frame."""
    return with_least(F.try_divide(x - F.avg(x).over(roll(n)), F.stddev_samp(x).over(roll(n))), x, roll(n), least)


def change(x: str, n: int) -> Column:
    return F.try_divide(F.col(x), F.lag(x, n).over(by_day())) - 1


def forward(x: str, first: int, last: int) -> Column:
    """Relative change of x between two rows ahead."""
    return F.try_divide(F.lead(x, last).over(by_day()), F.lead(x, first).over(by_day())) - 1


def filled(x: str) -> Column:
    """The last non-null value up to this row."""
    return F.last(x, ignorenulls=True).over(by_day().rowsBetween(Window.unboundedPreceding, 0))


def is_true(c: Column) -> Column:
    """Comparisons with missing values count as false."""
    return F.coalesce(c, F.lit(False))


def usable(x: Column) -> Column:
    """Neither missing nor not-a-number; Spark holds the latter greater than any number, so comparisons need this guard."""
    return x.isNotNull() & ~F.isnan(x)


def rounded(*names: str, to: int = 6) -> list[Column]:
    return [F.round(n, to).alias(n) for n in names]


def symbol_pair(symbol: str, quote: str = "USDT") -> Column:
    """BTCUSDT becomes BTC/USDT."""
    return F.regexp_replace(symbol, f"^(.+){quote}$", f"$1/{quote}")
