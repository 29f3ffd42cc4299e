"""Messages, the paged source and the replay."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.sources.paged import PagedReader, paged_source
from tessera.streaming import replay


def test_message_parts(spark):
    line = " ".join(f"<b>word{i}</b>" for i in range(200))
    texts = ["", "short", "a\n\nb", ("para " * 12 + "\n\n") * 5, ("line " * 15 + "\n") * 9, line, "x" * 450, None]
    got = [r.p for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(text.message_parts(F.col("t"), 100).alias("p")).collect()]
    assert got[0] == [] and got[1] == ["short"] and got[2] == ["a\n\nb"] and got[-1] is None
    for t, parts in zip(texts[:-1], got, strict=False):
        assert all(len(p) <= 100 for p in parts) and "".join(parts).replace("\n", "") == t.replace("\n", "")
    assert all(p.count("<b>") == p.count("</b>") for p in got[5]) and [len(p) for p in got[6]] == [100, 100, 100, 100, 50]
    assert len(got[3]) == 5


def test_described(spark):
    df = spark.sql("SELECT array(named_struct('indicator', 'rsi_14d', 'op', '<', 'threshold', 30.0D, 'within_days', 3), named_struct('indicator', 'shock_zscore', 'op', '>=', 'threshold', 1.5D, 'within_days', 0)) AS c, 'long' AS d")
    assert df.select(text.described(F.col("c"), F.col("d"))).first()[0] == "long when rsi 14d below 30.00 within 3 days and shock zscore at least 1.50"


def turns(reader, start, end):
    """What the tasks of a batch read, by symbol."""
    return {p.symbol: [r[1] for r in reader.read(p)] for p in reader.partitions({"until": start}, {"until": end})}


def test_paged_reader_keeps_cursors(tmp_path):
    """B fails on its second page and keeps the first, C on its first; both go on where they stand, once they can."""
    broken = {"B": 9, "C": 0}

    def fetch(symbol, since, limit):
        if since >= broken.get(symbol, 10**9):
            raise OSError
        return [(symbol, t, t / 2) for t in range(0, 100, 2) if t >= since][:limit]

    reader = PagedReader(fetch, ["A", "B", "C"], str(tmp_path / "log"), 0, 5, 100, lambda: 61)
    assert reader.initialOffset() == {"until": 0} and reader.latestOffset() == {"until": 61}
    first = turns(reader, 0, 61)
    assert first == {"A": list(range(0, 61, 2)), "B": list(range(0, 10, 2)), "C": []}
    assert turns(reader, 0, 61) == first  # the same batch again, after a restart
    broken.clear()
    assert turns(reader, 0, 61) == first  # though now it could read more
    assert turns(reader, 61, 80) == {"A": list(range(62, 80, 2)), "B": list(range(10, 80, 2)), "C": list(range(0, 80, 2))}
    broken["A"] = 0
    with pytest.raises(OSError):  # a noted batch that cannot be read whole must not pass
        turns(reader, 61, 80)


def test_paged_turns_are_bounded(tmp_path):
    fetch = lambda s, since, limit: [(s, t) for t in range(since, 1000)][:limit]
    reader = PagedReader(fetch, ["A"], str(tmp_path), 0, 10, 3, lambda: 0)
    assert turns(reader, 0, 500)["A"] == list(range(30)) and turns(reader, 500, 600)["A"] == list(range(30, 60))


def test_paged_source_streams(spark, tmp_path):
    """Each symbol is read by a task of its own; a restart goes on from the checkpoint."""
    import os

    clock = tmp_path / "now"

    def rows(symbol, since, limit):
        return [(symbol, t, float(os.getpid())) for t in range(0, 50, 2) if t >= since][:limit]

    def run(now: int) -> None:
        clock.write_text(str(now))
        stream = spark.readStream.format("paged_bars").load().select("symbol", "ts", "close")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()

    spark.dataSource.register(paged_source("paged_bars", "symbol string, ts long, close double", rows, ["A", "B", "C"], str(tmp_path / "log"), 0, 7, clock=lambda: int(clock.read_text())))
    run(21)
    run(99)
    seen = spark.read.parquet(str(tmp_path / "out"))
    assert [tuple(r) for r in seen.groupBy("symbol").count().orderBy("symbol").collect()] == [(s, 25) for s in "ABC"]
    assert seen.select("symbol", "ts").distinct().count() == 75 and all(int(r.close) != os.getpid() for r in seen.select("close").distinct().collect())


def test_replay_resumes_halts_and_finishes(tmp_path):
    clock, seen, weeks = tmp_path / "clock.json", [], []
    step = lambda d: seen.append(d) or d == date(2020, 1, 5)
    state = replay.to_completion(clock, date(2020, 1, 1), date(2020, 3, 10), step, weeks.append)
    assert state["status"] == "halted" and seen[-1] == date(2020, 1, 5)
    assert replay.advance(clock, date(2020, 1, 1), date(2020, 3, 10), step)["status"] == "halted" and len(seen) == 5
    replay.answered(clock)
    assert replay.to_completion(clock, date(2020, 1, 1), date(2020, 3, 10), step, weeks.append)["status"] == "finished"
    assert seen == sorted(set(seen)) and len(seen) == 70 and [(b - a).days for a, b in zip(weeks, weeks[1:], strict=False)] == [7] * 9


def test_replay_stops_after_failures(tmp_path):
    def broken(_):
        raise ValueError

    state = replay.advance(tmp_path / "c.json", date(2020, 1, 1), date(2020, 3, 10), broken)
    assert state["status"] == "failing" and state["next"] == "2020-01-09"
    assert [e["day"] for e in state["errors"]] == [f"2020-01-0{k}" for k in range(1, 9)] and state["errors"][0]["error"] == "ValueError: "


@pytest.mark.parametrize(("day", "n"), [(date(2020, 1, 1), 1), (date(2020, 1, 3), 3), (date(2019, 1, 1), 0)])
def test_known_on(spark, day, n):
    assert replay.known_on(spark.sql("SELECT explode(sequence(DATE '2020-01-01', DATE '2020-01-05')) AS d"), day).count() == n
