"""Live tests as a stream: one open test for each candidate and coin, opened by a firing and closed by its horizon.

Rows are bars of a coin with a flag whether a candidate fired on it.  They come in any order within the watermark's delay, so they
are parked in state, with an event-time timer each, and taken up in order of time once the watermark has passed them.  State is
keyed by (candidate, coin) and holds the open test and what is parked; a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PARKED = "ts timestamp, close double, high double, low double, fired boolean"
OPEN = "opened timestamp, price double, sign int, horizon int, bars int, top double, bottom double"
OUT = "candidate string, coin string, opened timestamp, entry_price double, status string, closed timestamp, forward_return double, mfe double, mae double"
#: Session settings that a stateful query of this kind needs.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class LiveTests(StatefulProcessor):
    def __init__(self, horizons: dict[str, int], signs: dict[str, int]):
        self.horizons, self.signs = horizons, signs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parked, self.open = handle.getListState("parked", PARKED), handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for p in rows:
            if len(p):
                self.parked.appendList(list(p[["ts", "close", "high", "low", "fired"]].itertuples(index=False, name=None)))
                for ts in p["ts"].unique():
                    self.handle.registerTimer(int(pd.Timestamp(ts).timestamp() * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        rows = sorted(self.parked.get(), key=lambda r: r[0]) if self.parked.exists() else []
        ready = [r for r in rows if pd.Timestamp(r[0]) <= upto]
        if not ready:  # another timer of the same watermark took them
            return
        self.parked.clear()
        if len(ready) < len(rows):
            self.parked.put(rows[len(ready) :])
        held = self.open.get() if self.open.exists() else None
        out = []
        for ts, close, high, low, fired in ready:
            held, told = self.step(key, held, ts, close, high, low, fired)
            out += told
        if held is None:
            self.open.clear()
        else:
            self.open.update(tuple(held))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def step(self, key, held, ts, close, high, low, fired):
        """The open test after one bar, and what is told of it.  A test that a bar closes can be followed by one that the same bar opens."""
        candidate, coin = key
        out = []
        if held is not None:
            opened, price, sign, horizon, bars, top, bottom = held
            bars, top, bottom = bars + 1, max(top, high), min(bottom, low)
            held = (opened, price, sign, horizon, bars, top, bottom)
            if bars >= horizon:
                moved = lambda x: sign * (x / price - 1)
                best, worst = (top, bottom) if sign > 0 else (bottom, top)
                out.append((candidate, coin, opened, price, "closed", ts, moved(close), moved(best), abs(moved(worst))))
                held = None
        if held is None and fired:
            held = (ts, close, self.signs[candidate], self.horizons[candidate], 0, float("-inf"), float("inf"))
            out.append((candidate, coin, ts, close, "open", None, None, None, None))
        return held, out

    def close(self) -> None:
        pass


def live_tests(bars: DataFrame, horizons: dict[str, int], signs: dict[str, int], late: str = "1 day") -> DataFrame:
    """A row for each test that opens, and one when it closes: on the bar `horizon` rows after the one that fired.

    bars: a stream of candidate, coin, ts, close, high, low, fired, one row a bar and candidate; horizons (in bars) and signs: by candidate.
    The session needs SETTINGS.  Rows later than `late` are left out, as everywhere behind a watermark.
    """
    keyed = bars.select("candidate", "coin", "ts", "close", "high", "low", "fired").withWatermark("ts", late).groupBy("candidate", "coin")
    return keyed.transformWithStateInPandas(LiveTests(horizons, signs), OUT, "Append", "EventTime")
