"""Live-test operators in batch form: scans, one open test a key, due tests, queues, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.spacing import spaced


def fired_within(df: DataFrame, fired: Column, rows: int) -> Column:
    """Whether it fired in the last so many rows of the symbol, this one included."""
    return F.coalesce(F.max(fired.cast("int")).over(Window.partitionBy("symbol").orderBy("ts").rowsBetween(-(rows - 1), 0)), F.lit(0)) == 1


def scan(hits: DataFrame, open_tests: DataFrame, dropped: DataFrame, since: Column, until: Column) -> DataFrame:
    """candidate, coin, first_ts: what fired in (since, until], without pairs that have an open test and candidates that were dropped."""
    fired = hits.where((F.col("ts") > since) & (F.col("ts") <= until)).groupBy("candidate", "coin").agg(F.min("ts").alias("first_ts"))
    return fired.join(open_tests.select("candidate", "coin").distinct(), ["candidate", "coin"], "left_anti").join(dropped.select("candidate").distinct(), "candidate", "left_anti")


def resolve(open_tests: DataFrame, bars: DataFrame, today: Column) -> DataFrame:
    """Open tests (candidate, coin, entry_d, entry_price, horizon, sign) that are due, with what happened: status, close_d, forward_return, mfe, mae.

    A test is due when its horizon has passed by the calendar; it closes on the bar `horizon` rows after its entry's, and stays open
    while there is no such bar by today.  Each test meets its bars by equi-joins on (coin, row).
    """
    placed = bars.where(F.col("d") <= today).withColumn("loc", F.row_number().over(Window.partitionBy("symbol").orderBy("d")))
    start = placed.select(F.col("symbol").alias("coin"), F.col("d").alias("entry_d"), F.col("loc").alias("entry_loc"))
    asked = open_tests.where(F.date_diff(today, F.col("entry_d")) >= F.col("horizon")).join(start, ["coin", "entry_d"], "left")
    steps = asked.withColumn("loc", F.explode_outer(F.sequence(F.col("entry_loc") + 1, F.col("entry_loc") + F.col("horizon"))))
    met = steps.join(placed.select(F.col("symbol").alias("coin"), "loc", "d", "high", "low", "close"), ["coin", "loc"], "left")
    key = ["candidate", "coin", "entry_d", "entry_price", "horizon", "sign"]
    last = F.max_by(F.struct("d", "close"), "loc")
    whole = met.groupBy(*key).agg(F.count("close").alias("n"), last.alias("last"), F.max("high").alias("top"), F.min("low").alias("bottom"))
    done, moved = F.col("n") == F.col("horizon"), lambda x: F.col("sign") * (F.try_divide(x, F.col("entry_price")) - 1)
    best, worst = (F.when((F.col("sign") > 0) == F.lit(good), F.col("top")).otherwise(F.col("bottom")) for good in (True, False))
    told = lambda x: F.when(done, x)
    return whole.select("candidate", "coin", "entry_d", F.when(done, "closed").otherwise("open").alias("status"), told(F.col("last.d")).alias("close_d"), told(moved(F.col("last.close"))).alias("forward_return"), told(moved(best)).alias("mfe"), told(F.abs(moved(worst))).alias("mae"))


def one_open_per_key(days: DataFrame, key: str | list[str], lasts: int) -> DataFrame:
    """key, opened: the days that open a test, each `lasts` days or more after the one before it."""
    return spaced(days, [key] if isinstance(key, str) else key, lasts).withColumnRenamed("d", "opened")


def ledger(exits: DataFrame, seen: DataFrame, now: Column, keep_days: int = 365) -> tuple[DataFrame, DataFrame]:
    """Exits (coin, exit_d) that the ledger lacks, and the ledger with them and without what is older than it keeps."""
    new = exits.select("coin", "exit_d").distinct().join(seen, ["coin", "exit_d"], "left_anti")
    return new, seen.unionByName(new).where(F.date_diff(now, F.col("exit_d")) <= keep_days)


def promoted(parked: DataFrame, testable: DataFrame, day: Column, modulus: int = 7) -> DataFrame:
    """The oldest parked proposal (label, proposed_at) that is due today and testable, at most one; ties by label."""
    ready = rota_due(parked, "label", day, modulus).join(testable.where("testable").select("label"), "label", "left_semi")
    return ready.orderBy("proposed_at", "label").limit(1)


def horizon_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """candidate, was, horizon of those whose horizon is new or another one."""
    both = now.select("candidate", "horizon").join(before.select("candidate", F.col("horizon").alias("was")), "candidate", "left")
    return both.where(F.col("horizon").isNotNull() & ~F.col("horizon").eqNullSafe(F.col("was"))).select("candidate", "was", "horizon")


def effective_count(live: Column, prior: Column, static: Column) -> Column:
    """What confirms a candidate: tests since it was written down; a static one has only its live tests."""
    return F.when(static, live).otherwise(live + F.coalesce(prior, F.lit(0)))


def losing_streak(tests: DataFrame, key: str, order: list[str], least: int = 2) -> DataFrame:
    """key, streak: how many of the latest closed tests in a row lost, if at least `least`."""
    last_win = tests.where("forward_return >= 0").groupBy(key).agg(F.max(F.struct(*order)).alias("w"))
    since = tests.join(last_win, key, "left").where(F.col("w").isNull() | (F.struct(*order) > F.col("w")))
    return since.groupBy(key).agg(F.count(F.lit(1)).alias("streak")).where(F.col("streak") >= least)


def label_slot(label: Column, modulus: int = 7) -> Column:
    """A label's place in a rota: the first 32 bits of its SHA-256."""
    return F.conv(F.substring(F.sha2(label, 256), 1, 8), 16, 10).cast("long") % modulus


def ordinal(day: Column) -> Column:
    """Days since 1 January of the year 1, that being day 1."""
    return F.date_diff(day, F.lit("1970-01-01").cast("date")) + 719163


def rota_due(df: DataFrame, label: str, day: Column, modulus: int = 7) -> DataFrame:
    return df.where((ordinal(day) + label_slot(F.col(label), modulus)) % modulus == 0)


def milestone(count: Column, last: Column, step: int = 20) -> Column:
    """The multiple of the step that is newly reached, or null."""
    reached = (F.floor(count / step) * step).cast("long")
    return F.when((reached >= step) & (reached > last), reached)


def checkpoint(tests: DataFrame, *by: str) -> DataFrame:
    """Raw and baseline-adjusted win rates of closed tests, mean excess and excursions."""
    excess = F.col("forward_return") - F.col("baseline_return")
    return tests.where("status = 'closed'").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("forward_return") > 0).cast("double")).alias("win_rate"), F.avg((excess > 0).cast("double")).alias("adjusted_win_rate"), F.avg(excess).alias("mean_excess"), F.avg("mfe").alias("mean_mfe"), F.avg("mae").alias("mean_mae"))


def first_fired(df: DataFrame, fired: Column, since: Column, until: Column) -> DataFrame:
    """symbol, first_ts: the earliest firing in (since, until]; windows in `fired` see the whole history."""
    return df.withColumn("__hit", fired).where(F.col("__hit") & (F.col("ts") > since) & (F.col("ts") <= until)).groupBy("symbol").agg(F.min("ts").alias("first_ts"))


def tests_opened(hits: DataFrame, hours: DataFrame, days: DataFrame, lookback: int, horizon: int) -> DataFrame:
    """candidate, coin, entry_d, entry_price, horizon, backdated: the test of each pair that is put to the test now.

    hits: candidate, symbol, ts of hours that fired, over the whole history; hours: symbol, ts; days: bars; every candidate of hits meets every symbol of hours.  A
    pair that fired within `lookback` days of the symbol's last hour enters at the open of the first day after its earliest such hour, if there is
    one yet; one that did not enters at the last day's close.
    """
    last = hours.groupBy("symbol").agg(F.max("ts").alias("last"))
    recent = hits.join(last, "symbol").where(F.col("ts") >= F.col("last") - F.make_dt_interval(F.lit(lookback)))
    first = recent.groupBy("candidate", "symbol").agg(F.min("ts").alias("since"))
    asked = hits.select("candidate").distinct().join(last.select("symbol"), F.lit(True)).join(first, ["candidate", "symbol"], "left")
    newest = days.groupBy("symbol").agg(F.max_by(F.struct("d", F.col("close").alias("price")), "d").alias("newest"))
    later = F.when(F.col("d").cast("timestamp") > F.col("since"), F.struct("d", F.col("open").alias("price")))
    met = asked.where("since IS NOT NULL").join(days.select("symbol", "d", "open"), "symbol").groupBy("candidate", "symbol").agg(F.min_by(later, F.when(later.isNotNull(), F.col("d"))).alias("bar"))
    whole = asked.join(met, ["candidate", "symbol"], "left").join(newest, "symbol").withColumn("backdated", F.col("since").isNotNull())
    entry = F.when(F.col("backdated"), F.col("bar")).otherwise(F.col("newest"))
    return whole.withColumn("entry", entry).where("entry IS NOT NULL").select("candidate", F.col("symbol").alias("coin"), F.col("entry.d").alias("entry_d"), F.col("entry.price").alias("entry_price"), F.lit(horizon).alias("horizon"), "backdated")


def first_bar_from(bars: DataFrame, days: DataFrame) -> DataFrame:
    """symbol, day, d, open: each symbol's first bar on or after each day, null after the last; one sort a symbol, no range join."""
    marks = bars.select("symbol").distinct().join(days.select(F.col("d").alias("day")).distinct(), F.lit(True))
    both = bars.select("symbol", "d", F.struct("d", "open").alias("bar"), F.lit(None).cast("date").alias("day")).unionByName(marks.select("symbol", F.col("day").alias("d"), F.lit(None).cast("struct<d:date,open:double>").alias("bar"), "day"))
    later = Window.partitionBy("symbol").orderBy("d").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    return both.withColumn("first", F.first("bar", ignorenulls=True).over(later)).where("day IS NOT NULL").select("symbol", "day", "first.d", "first.open")


def covered_by_release(bars: DataFrame, releases: DataFrame, days: int) -> DataFrame:
    """bars with `covered`: a release lies at most so many days back; release days are spread out, so the join is one of equals."""
    near = releases.select(F.explode(F.sequence(F.lit(0), F.lit(days))).alias("o"), F.col("d").alias("r")).select(F.date_add("r", F.col("o")).alias("d")).distinct().withColumn("covered", F.lit(True))
    return bars.join(near, "d", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
