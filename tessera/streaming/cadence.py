"""Jobs that recur: what is due, each by itself, with the last runs kept in a document; and job lists that resume where they failed."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from pathlib import Path

from tessera.sources.state import read_json, write_json

EVERY = {"hourly": timedelta(hours=1), "daily": timedelta(days=1), "weekly": timedelta(days=7)}


def is_due(cadence: str, last: datetime | None, now: datetime) -> bool:
    """Whether a job of that cadence is due; a monthly one once a calendar month."""
    if last is None:
        return True
    return (now.year, now.month) != (last.year, last.month) if cadence == "monthly" else now - last >= EVERY[cadence]


def run_due(document: str | Path, jobs: dict[str, tuple[str, Callable[[], None]]], now: datetime) -> dict[str, str | None]:
    """Run the jobs (name: cadence, function) that are due; by name the error, or None.  A job that fails is due again at once."""
    state, out = read_json(document, {}), {}
    for name, (cadence, job) in jobs.items():
        last = state.get(name)
        if not is_due(cadence, datetime.fromisoformat(last) if last else None, now):
            continue
        try:
            job()
            out[name], state[name] = None, now.isoformat()
        except Exception as e:  # the other jobs must run; the caller gets the error
            out[name] = f"{type(e).__name__}: {e}"
        write_json(document, state)
    return out


def run_steps(document: str | Path, steps: dict[str, Callable[[], None]]) -> None:
    """Run steps in order, each once until all are done: a step that raises ends the run, and the next run starts with it."""
    done = read_json(document, [])
    for name, step in steps.items():
        if name not in done:
            step()
            done.append(name)
            write_json(document, done)
    write_json(document, [])
