"""A historical replay: days in order, each seeing only what was known on it, with a clock that survives restarts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.state import read_json, write_json


KEPT_ERRORS = 100


def known_on(df: DataFrame, day: date, column: str = "d") -> DataFrame:
    """Rows up to the day, itself included; on a scan partitioned by the column, later partitions are not read."""
    return df.where(F.col(column) <= F.lit(day))


def advance(clock: str | Path, start: date, end: date, daily: Callable[[date], bool | None], weekly: Callable[[date], None] | None = None, days: int = 30, failures: int = 8) -> dict:
    """Run at most `days` days from where the clock stands; the clock is saved after each of them.

    daily may return True to halt until somebody answers; its day is then done.  A day that raises is passed over and noted with its
    error under `errors` (the last KEPT_ERRORS of them), and so many of them in a row halt too.  Status: running, halted, failing or finished.
    """
    state = read_json(clock, {"next": start.isoformat(), "week": None, "failed": 0, "status": "running"})
    if state["status"] == "halted":
        return state
    state["status"] = "running"
    for _ in range(days):
        day = date.fromisoformat(state["next"])
        if day > end:
            state["status"] = "finished"
            break
        try:
            asks = bool(daily(day))
            state["failed"] = 0
        except Exception as e:  # one bad day must not end years of replay; it stays on record
            asks, state["failed"] = False, state["failed"] + 1
            state["errors"] = [*state.get("errors", []), {"day": day.isoformat(), "error": f"{type(e).__name__}: {e}"}][-KEPT_ERRORS:]
        if weekly and (state["week"] is None or (day - date.fromisoformat(state["week"])).days >= 7):
            weekly(day)
            state["week"] = day.isoformat()
        state["next"] = (day + timedelta(days=1)).isoformat()
        state["status"] = "halted" if asks else "failing" if state["failed"] >= failures else "running"
        write_json(clock, state)
        if state["status"] != "running":
            break
    write_json(clock, state)
    return state


def answered(clock: str | Path) -> None:
    """Let a halted replay go on."""
    write_json(clock, {**read_json(clock, {}), "status": "running"})


def to_completion(clock: str | Path, start: date, end: date, daily: Callable[[date], bool | None], weekly: Callable[[date], None] | None = None, chunks: int = 1500) -> dict:
    """Chunk after chunk until the end, a halt or too many failures."""
    state = {}
    for _ in range(chunks):
        state = advance(clock, start, end, daily, weekly)
        if state["status"] != "running":
            break
    return state
