"""The registry of candidates: status logs, names that people type, queues of signals, costs, releases of late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import slices
from tessera.operators.bitmaps import pairs


def appended(log: Column, entry: Column, keep: int = 104) -> Column:
    """The log with one entry more; the oldest fall out beyond the limit."""
    longer = F.array_append(log, entry)
    return F.slice(longer, F.greatest(F.lit(1), F.size(longer) - keep + 1), F.lit(keep))


def latest_status(history: DataFrame) -> DataFrame:
    """candidate, status, at: the last entry of each log that has one."""
    last = F.try_element_at("status_log", F.lit(-1))
    return history.where(F.size("status_log") > 0).select("candidate", last["status"].alias("status"), last["at"].alias("at"))


def prune_due(history: DataFrame, now: Column, years: float = 2.0, again_days: int = 180) -> DataFrame:
    """candidate, years: long tracked, never accepted, not dropped, not asked about of late."""
    tracked = F.date_diff(now, F.col("first_tracked_at")) / 365.25
    accepted = F.exists("status_log", lambda e: e["status"] == "accepted")
    asked = F.coalesce(F.date_diff(now, F.col("last_asked_at")) < again_days, F.lit(False))
    return history.where((tracked >= years) & ~F.col("dropped") & ~accepted & ~asked).select("candidate", tracked.alias("years"))


def short_id(name: Column, digits: int = 4) -> Column:
    return F.substring(F.sha2(name, 256), 1, digits)


def resolve(asked: DataFrame, known: DataFrame) -> DataFrame:
    """query, name, matches: the exact name, else the one that differs in case only, else the only one of that short id.

    name is null where nothing fits, or where a short id fits several; of several names that differ in case the greatest counts.
    """
    q = asked.select("query", F.trim("query").alias("__q")).distinct()
    exact = known.select(F.col("name").alias("__q"), F.col("name").alias("__exact")).distinct()
    folded = known.groupBy(F.lower("name").alias("__low")).agg(F.max("name").alias("__folded"))
    ids = known.groupBy(short_id(F.col("name")).alias("__low")).agg(F.count_distinct("name").alias("__n"), F.max("name").alias("__only"))
    found = q.join(exact, "__q", "left").withColumn("__low", F.lower("__q")).join(folded, "__low", "left").join(ids, "__low", "left")
    named = F.coalesce("__exact", "__folded")
    return found.select("query", F.coalesce(named, F.when(F.col("__n") == 1, F.col("__only"))).alias("name"), F.when(named.isNotNull(), F.lit(1)).otherwise(F.coalesce("__n", F.lit(0))).cast("long").alias("matches"))


def active_signals(signals: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """The first unexpired signal of each coin and direction, which is the one consumed."""
    live = signals.where(F.col("pushed_at") + F.make_dt_interval(hours=F.lit(hours)) > now)
    w = Window.partitionBy("coin", "direction").orderBy("pushed_at", "id")
    return live.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def replied_codes(replies: DataFrame, codes: DataFrame) -> DataFrame:
    """reply_id, code, candidate: every code in a reply, with what it stands for (null: nothing)."""
    each = replies.select("reply_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b(\d{4}-\d{4})\b"))).alias("code"))
    return each.join(codes, "code", "left").select("reply_id", "code", "candidate")


CACHE_WRITE, CACHE_READ = 1.25, 0.10  # of the list price of input


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls with the columns of prices but `prefix`: those of the longest prefix of the model's name, null where none fits."""
    priced = [c for c in prices.columns if c != "prefix"]
    prefixes = prices.select(F.struct(F.length("prefix").alias("n"), *priced).alias("p"), "prefix")
    best = calls.select("model").distinct().join(prefixes, F.startswith("model", "prefix")).groupBy("model").agg(F.max("p").alias("p"))
    return calls.join(best.select("model", *[F.col(f"p.{c}").alias(c) for c in priced]), "model", "left")


def usage(calls: DataFrame) -> DataFrame:
    """label (null: all), calls, cost, per_call, cache_ratio of priced calls (input, output, cache_write, cache_read; price_in, price_out a million).

    A model without a price counts tokens and costs nothing.
    """
    million = lambda n, p: F.col(n) / 1e6 * F.coalesce(p, F.lit(0.0))
    cost = million("input", F.col("price_in")) + million("cache_write", F.col("price_in") * CACHE_WRITE) + million("cache_read", F.col("price_in") * CACHE_READ) + million("output", F.col("price_out"))
    n = F.count(F.lit(1))
    read = F.sum("cache_read")
    return calls.withColumn("__cost", cost).rollup("label").agg(n.alias("calls"), F.sum("__cost").alias("cost"), (F.sum("__cost") / n).alias("per_call"), F.try_divide(read, read + F.sum("cache_write")).alias("cache_ratio"))


def cooccurrence(hits: DataFrame) -> DataFrame:
    """a, b, both, only_a, only_b for each pair of labels that share a firing."""
    return pairs(hits).select("a", "b", "both", (F.col("n_a") - F.col("both")).alias("only_a"), (F.col("n_b") - F.col("both")).alias("only_b"))


def digest(tests: DataFrame, since: Column) -> DataFrame:
    """One row: opened, resolved and open tests; this period's and all time's positive share, mean and excursions' ratio."""
    closed = F.col("status") == "closed"
    recent = closed & (F.col("close_d") >= since)
    share = lambda c: F.avg(F.when(c, (F.col("forward_return") > 0).cast("double")))
    mean = lambda c, x: F.avg(F.when(c, x))
    return tests.agg(
        F.count_if(F.col("entry_d") >= since).alias("opened"), F.count_if(recent).alias("resolved"), F.count_if(F.col("status") == "open").alias("still_open"),
        share(recent).alias("positive"), mean(recent, F.col("forward_return")).alias("mean"), F.try_divide(mean(recent, F.col("mfe")), mean(recent, F.abs("mae"))).alias("ratio"),
        F.count_if(closed).alias("resolved_ever"), share(closed).alias("positive_ever"), mean(closed, F.col("forward_return")).alias("mean_ever"),
    )


def confirmation_rows(tests: DataFrame, known: DataFrame, rows: int = 8) -> DataFrame:
    """candidate, confirmed, needed, powered, trend, status: the candidates of the most confirming tests, dropped ones left out.

    known: candidate, prior, static, dropped, status, sd.  Of equal counts the later name comes first.
    """
    from tessera.operators.live import effective_count
    from tessera.operators.walkforward import required_n

    own = tests.where("status = 'closed'").groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("forward_return") > 0).cast("double")).alias("trend"))
    met = own.join(known, "candidate").where(~F.coalesce("dropped", F.lit(False)))
    counted = met.withColumns({"confirmed": effective_count(F.col("n"), F.col("prior"), F.col("static")), "needed": required_n(F.col("sd"))})
    return counted.orderBy(F.col("confirmed").desc(), F.col("candidate").desc()).limit(rows).select("candidate", "confirmed", "needed", F.coalesce(F.col("confirmed") >= F.col("needed"), F.lit(False)).alias("powered"), "trend", "status")


def top_with_note(df: DataFrame, *order: Column, rows: int = 15) -> DataFrame:
    """The first rows in the order, with `place`, `left_out` (how many more there are)."""
    w = Window.orderBy(*order)
    return df.withColumns({"place": F.row_number().over(w), "left_out": F.greatest(F.lit(0), F.count(F.lit(1)).over(Window.partitionBy()) - rows)}).where(F.col("place") <= rows)


SECTIONS = {"accepted": 1, "watch": 2, "insufficient_data": 3, "error": 4, "rejected": 5, "dropped": 6}


def status_report(battery: DataFrame) -> DataFrame:
    """section, place, n, names, never: candidates by status, dropped ones apart; those without an event are only counted."""
    section = F.when(F.coalesce("dropped", F.lit(False)), "dropped").otherwise(F.col("status"))
    place = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    rows = battery.withColumn("section", section).groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.col("candidate")))).alias("names"), F.count_if(F.coalesce("n", F.lit(0)) == 0).alias("never"))
    return rows.withColumn("place", place[F.col("section")])


def details(row: dict, words: str | None = None) -> str:
    """What a person wants to know of one candidate, a line a fact; `row` has the columns of a battery."""
    shown = lambda x, form: "n/a" if x is None or x != x else format(x, form)
    lines = [
        f"{row['candidate']}: {row['status']}", f"fires when {words}" if words else None, f"why not accepted: {row['reason']}" if row.get("reason") else None,
        f"trades: {row.get('n') or 0}, sortino {shown(row.get('sortino'), '.2f')}, won {shown(row.get('win_rate'), '.0%')}",
        f"pattern: excess {shown(row.get('excess'), '+.2%')}, p {shown(row.get('p'), '.3f')}, excursions {shown(row.get('ratio'), '.2f')}",
        f"largest share of a symbol {shown(row.get('by_symbol_share'), '.0%')}, of a year {shown(row.get('by_year_share'), '.0%')}", f"held for {row['horizon']} days" if row.get("horizon") else None, f"power needs {shown(row.get('required_n'), '.0f')} events",
    ]
    return "\n".join(x for x in lines if x)


def prune_digest(coded: DataFrame) -> DataFrame:
    """section (drop, then keep), code, line of each candidate that is asked about; coded: candidate, code, advice, advice_reason."""
    return coded.select(F.when(F.col("advice") == "drop", 1).otherwise(2).alias("place"), F.col("advice").alias("section"), "code", F.concat_ws(": ", F.concat_ws(" ", "code", F.col("candidate").cast("string")), "advice_reason").alias("line"))


def yearly_prune(history: DataFrame, advice: DataFrame, now: Column, last_year: int | None) -> DataFrame:
    """Candidates to drop in the first look of a calendar year: due ones whose advice is to; none in a year that was looked at."""
    due = prune_due(history, now).select("candidate").join(advice.where("advice = 'drop'").select("candidate"), "candidate", "left_semi")
    return due.where(F.lit(last_year is None) | (F.year(now) > F.lit(last_year or 0)))


def described_triggers(tests: DataFrame, static: DataFrame, dynamic: DataFrame) -> DataFrame:
    """tests with `words`: of the static family that the candidate's name starts with, else of its specification, else that there is none."""
    family = F.regexp_extract("candidate", "^([a-z]+[0-9]+)_", 1)
    met = tests.withColumn("__family", family).join(static.select(F.col("family").alias("__family"), F.col("words").alias("__s")), "__family", "left").join(dynamic.select("candidate", F.col("words").alias("__d")), "candidate", "left")
    return met.withColumn("words", F.coalesce("__s", "__d", F.lit("no definition found"))).drop("__family", "__s", "__d")


def retention(messages: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """Messages with `fate`: deleted while they are young enough, else too_old."""
    return messages.withColumn("fate", F.when(F.col("sent_at") + F.make_dt_interval(hours=F.lit(hours)) > now, "deleted").otherwise("too_old"))


def recent_releases(vintage: DataFrame, since: Column, until: Column) -> DataFrame:
    """series, published, period, value, prior: for each day of a release in the range, the two latest periods as known on it.

    The greatest period so far is a running maximum, and so is the second one: of the lesser of each period and the greatest before it.  A release
    day takes both from the last first print up to it, and each period's value from the revision that held on the day.
    """
    first = vintage.groupBy("series", "period").agg(F.min("realtime_start").alias("known"))
    w = Window.partitionBy("series").orderBy("known", "period")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    ranked = first.withColumns({"latest": F.max("period").over(upto), "__other": F.when(F.max("period").over(before).isNotNull(), F.least("period", F.max("period").over(before)))}).withColumn("second", F.max("__other").over(upto))
    at = lambda c: F.col(c).cast("timestamp").alias("t")
    known = ranked.groupBy(F.col("series").alias("symbol"), at("known")).agg(F.max("latest").alias("latest"), F.max("second").alias("second"))
    days = vintage.where(F.col("realtime_start").between(since, until)).select(F.col("series").alias("symbol"), F.col("realtime_start").alias("published"), at("realtime_start")).distinct()
    asked = slices.carried(known, days, "latest", "second").withColumnRenamed("symbol", "series").drop("t")
    ends = F.lead("realtime_start").over(Window.partitionBy("series", "period").orderBy("realtime_start"))
    held = vintage.select("series", "period", "value", F.col("realtime_start").alias("starts"), ends.alias("ends"))

    def with_value(df: DataFrame, period: str, name: str) -> DataFrame:
        of = held.select("series", F.col("period").alias(period), F.col("value").alias(name), "starts", "ends")
        holds = (F.col("starts") <= F.col("published")) & (F.col("ends").isNull() | (F.col("ends") > F.col("published")))
        met = df.join(of, ["series", period]).where(holds).select("series", "published", name)
        return df.join(met, ["series", "published"], "left")

    return with_value(with_value(asked, "latest", "value"), "second", "prior").select("series", "published", F.col("latest").alias("period"), "value", "prior")


def number_text(value: Column, signed: bool = False) -> Column:
    """A figure at a scale that can be read: thousands, whole numbers, or two digits."""
    sign = F.when(value >= 0, "+").otherwise("") if signed else F.lit("")
    text = F.when(F.abs(value) >= 10_000, F.concat(F.format_number(value / 1000, 0), F.lit("k"))).when((F.abs(value) >= 100) | (value % 1 == 0), F.format_number(value, 0))
    return F.concat(sign, text.otherwise(F.regexp_replace(F.format_number(value, 2), r"\.?0+$", "")))


def market_return(bars: DataFrame, days: DataFrame, h: int, direction: str = "long") -> DataFrame:
    """day, market: over symbols, the mean, signed as the direction is, of the first open on or after the day to the close h bars on.

    bars meets days as a union in one sort a symbol; symbols that lack bars do not count.
    """
    w = Window.partitionBy("symbol").orderBy("d")
    ahead = bars.select("symbol", "d", "open", F.lead("close", h).over(w).alias("exit"))
    marks = bars.select("symbol").distinct().join(days.select(F.col("d").alias("day")).distinct(), F.lit(True))
    both = ahead.select("symbol", "d", F.struct("open", "exit").alias("bar"), F.lit(None).cast("date").alias("day")).unionByName(marks.select("symbol", F.col("day").alias("d"), F.lit(None).cast("struct<open:double,exit:double>").alias("bar"), "day"))
    later = Window.partitionBy("symbol").orderBy("d").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    entry = both.withColumn("first", F.first("bar", ignorenulls=True).over(later)).where("day is not null and first.open > 0 and first.exit is not null")
    sign = 1 if direction == "long" else -1
    return entry.groupBy("day").agg(F.avg(sign * (F.col("first.exit") / F.col("first.open") - 1)).alias("market"))
