"""Questions that wait for an answer for a time, as a stream: each ends answered or expired, once.

State is keyed by (queue, id).  A question sets an event-time timer for the end of its time; an answer within it ends the question, wherever
the two rows stand in the stream.  What an answer finds ended already is not told again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HELD = "asked timestamp, answered timestamp, ended boolean"
OUT = "queue string, id string, asked timestamp, outcome string, at timestamp"


class Pending(StatefulProcessor):
    def __init__(self, keep_seconds: int):
        self.keep = pd.Timedelta(seconds=keep_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", HELD)

    def told(self, key, asked, outcome: str, at) -> pd.DataFrame:
        return pd.DataFrame([(*key, asked, outcome, at)], columns=[c.split()[0] for c in OUT.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked, answered, ended = self.held.get() if self.held.exists() else (None, None, False)
        known = asked
        for p in rows:
            for ts, kind in zip(p["ts"], p["kind"]):
                if kind == "asked":
                    asked = ts if asked is None else min(asked, ts)
                elif kind == "answered":
                    answered = ts if answered is None else min(answered, ts)
        if asked is not None and asked != known:
            self.handle.registerTimer(int((pd.Timestamp(asked) + self.keep).timestamp() * 1000))
        if not ended and asked is not None and answered is not None and asked <= answered <= pd.Timestamp(asked) + self.keep:
            ended = True
            yield self.told(key, asked, "answered", answered)
        self.held.update((asked, answered, ended))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        asked, answered, ended = self.held.get() if self.held.exists() else (None, None, True)
        if not ended and asked is not None:
            yield self.told(key, asked, "expired", pd.Timestamp(asked) + self.keep)
        self.held.clear()

    def close(self) -> None:
        pass


def pending(rows: DataFrame, keep_seconds: int, late: str = "1 hour") -> DataFrame:
    """queue, id, asked, outcome (answered, expired) and when.  rows: a stream of queue, id, ts, kind (asked, answered); a question is asked once.

    The session needs `live_tests.SETTINGS`.
    """
    keyed = rows.select("queue", "id", "ts", "kind").withWatermark("ts", late).groupBy("queue", "id")
    return keyed.transformWithStateInPandas(Pending(keep_seconds), OUT, "Append", "EventTime")
