"""Events and their outcomes: next-bar entries, excursions, barriers, baskets, episodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.series import HORIZONS, ahead, by_day, forward, is_true, usable
from tessera.operators.spacing import spaced

FEE = 0.002
MULTIPLES = (0.6, 0.8, 1.0, 1.2, 1.5)
SHOCK = 2.0


def regime(z: str = "shock_zscore") -> Column:
    return F.when(F.col(z) >= SHOCK, "shock").otherwise("normal")


def path_frame(most: int) -> Column:
    """The (high, low) of the bars after the entry's, which is the next one, up to one past the longest horizon."""
    return F.collect_list(F.struct("high", "low")).over(ahead(2, most + 2))


def build_events(df: DataFrame, trigger: Column, direction: str = "long", horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """A row for each bar that triggers: entry on the next one, excursions over the h bars after the entry's.

    df: a panel with inputs and shock_zscore.  Windows run over all bars; the trigger filters last.  Bars
    whose longest horizon is not complete give no event.
    """
    price = F.lead("open", 1).over(by_day())
    columns = {"entry_price": price, "regime": regime(), "fired": is_true(trigger), "path": path_frame(max(horizons))}
    for h in horizons:
        top, bottom = F.max("high").over(ahead(2, 1 + h)), F.min("low").over(ahead(2, 1 + h))
        best, worst = (top, bottom) if direction == "long" else (bottom, top)
        sign = 1 if direction == "long" else -1
        columns |= {f"mfe_{h}": sign * (F.try_divide(best, price) - 1), f"mae_{h}": sign * (F.try_divide(worst, price) - 1), f"fwd_{h}": sign * forward("close", 1, 1 + h)}
    kept = df.withColumns(columns).where(F.col("fired") & (F.col("loc") + 1 + max(horizons) < F.col("n_rows")) & (F.col("entry_price") > 0))
    return kept.select("symbol", F.col("d").alias("trigger_d"), (F.col("loc") + 1).alias("entry_loc"), "entry_price", "path", "regime", F.year("d").alias("period"), *[f"{k}_{h}" for h in horizons for k in ("mfe", "mae", "fwd")])


def long_form(events: DataFrame, *keep: str, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """A row for each event and horizon: h, mfe, mae, fwd, and the columns to keep."""
    rows = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"mfe_{h}").alias("mfe"), F.col(f"mae_{h}").alias("mae"), F.col(f"fwd_{h}").alias("fwd")) for h in horizons])
    return events.select("symbol", "trigger_d", "entry_loc", "period", *keep, F.explode(rows).alias("x")).select("symbol", "trigger_d", "entry_loc", "period", *keep, "x.*")


def anchors(events: DataFrame, *by: str) -> DataFrame:
    """Mean excursions of each horizon: h, mfe_anchor, mae_anchor."""
    return long_form(events, *by).groupBy(*by, "h").agg(F.avg("mfe").alias("mfe_anchor"), F.avg(F.abs("mae")).alias("mae_anchor"))


def bucket_for(elapsed: Column, horizons: tuple[int, ...] = HORIZONS) -> Column:
    """The first horizon that is not passed, or null."""
    return F.array_min(F.filter(F.array(*map(F.lit, horizons)), lambda h: h >= elapsed))


def barrier_prices(price: Column, sign: Column, favourable: Column, adverse: Column) -> tuple[Column, Column]:
    """Target and stop of a trade; sign 1 for a long one, -1 for a short one."""
    return price * (1 + sign * favourable), price * (1 - sign * adverse)


def per_bar(levels: Column, name: str) -> Column:
    """The level of each bar after an entry: that of the first horizon that its distance does not pass.  levels: ascending array of (h, mfe, mae)."""
    before = lambda k: F.when(k > 0, F.get(levels, k - 1)["h"]).otherwise(0)
    return F.flatten(F.transform(levels, lambda x, k: F.array_repeat(x[name], (x["h"] - before(k)).cast("int"))))


def first_passages(path: Column, price: Column, sign: Column, bounds: Column, multiples: tuple[float, ...] | list[Column], target: bool) -> Column:
    """For each multiple the first bar, from 1, that reaches the target (or the stop) at bound times multiple; 0 if none does.

    bounds: of each bar (`per_bar`); the bars past them reach nothing.
    """
    side = sign if target else -sign
    bars = F.slice(path, 1, F.size(bounds))
    met = F.slice(bounds, 1, F.size(bars))

    def first(m: Column) -> Column:
        level = lambda bound: price * (1 + side * (bound * m))
        reached = lambda bar, bound: F.when(side > 0, bar["high"] >= level(bound)).otherwise(bar["low"] <= level(bound))
        return F.array_position(F.zip_with(bars, met, reached), F.lit(True))

    return F.array(*[first(F.lit(m) if isinstance(m, float) else m) for m in multiples])


def timed_out(path: Column, price: Column, sign: Column) -> Column:
    """The net return of a trade that ends at the middle of its last bar's range."""
    last = F.element_at(path, -1)
    return sign * ((last["high"] + last["low"]) / 2 / price - 1) - FEE


def ended(up: Column, down: Column, tp: Column, sl: Column, gain: Column, loss: Column, middle: Column) -> tuple[Column, Column]:
    """Outcome and net return of a trade whose target is first reached on bar `up` and its stop on bar `down` (0: never); a bar's stop counts before its target."""
    stopped, won = (down > 0) & ((up == 0) | (down <= up)), up > 0
    outcome = F.when(stopped, "loss").when(won, "win").otherwise("timeout")
    return outcome, F.when(stopped, -(loss * sl) - FEE).when(won, gain * tp - FEE).otherwise(middle)


def trade(path: Column, price: Column, sign: Column, levels: Column, tp: Column, sl: Column) -> Column:
    """(outcome, net) of a trade under one setting.

    Without a hit by the longest horizon the trade ends at the bar past it, or the last one, at the middle of its range.
    The path is at hand as an array, so no bars are joined.
    """
    ups, downs = per_bar(levels, "mfe"), per_bar(levels, "mae")
    up, down = (first_passages(path, price, sign, b, [m], target)[0] for b, m, target in ((ups, tp, True), (downs, sl, False)))
    at = lambda bounds, k: F.get(bounds, k.cast("int") - 1)
    outcome, net = ended(up, down, tp, sl, at(ups, up), at(downs, down), timed_out(path, price, sign))
    return F.struct(outcome.alias("outcome"), net.alias("net"))


def first_bars(events: DataFrame, levels: DataFrame, by: list[str], event: list[str], tps: tuple[float, ...], sls: tuple[float, ...]) -> DataFrame:
    """by, event, fold, middle, and of each multiple the first bar, from 1, that reaches the target (up_i) or the stop (down_j), null if none does.

    A row a bar meets the levels of its distance in each later fold, and the least bar of an event and fold is found before anything is shuffled.
    """
    path, price, sign = (F.col(c) for c in ("path", "entry_price", "sign"))
    of_bar = levels.select(*by, "fold", F.posexplode(F.arrays_zip(per_bar(F.col("levels"), "mfe").alias("gain"), per_bar(F.col("levels"), "mae").alias("loss"))).alias("o", "x")).select(*by, "fold", (F.col("o") + 1).alias("o"), "x.gain", "x.loss")
    bars = events.select(*by, *event, "period", "entry_price", "sign", timed_out(path, price, sign).alias("middle"), F.posexplode("path").alias("o", "bar"))
    rows = bars.select(*by, *event, "period", "entry_price", "sign", "middle", (F.col("o") + 1).alias("o"), "bar.high", "bar.low").join(of_bar, [*by, "o"]).where("period < fold")

    def first(bound: str, m: float, side: Column) -> Column:
        level = price * (1 + side * (F.col(bound) * m))
        return F.min(F.when(F.when(side > 0, F.col("high") >= level).otherwise(F.col("low") <= level), F.col("o")))

    ups = [first("gain", m, sign).alias(f"up_{i}") for i, m in enumerate(tps)]
    downs = [first("loss", m, -sign).alias(f"down_{j}") for j, m in enumerate(sls)]
    return rows.groupBy(*by, *event, "fold").agg(F.max("middle").alias("middle"), *ups, *downs)


def grid_results(events: DataFrame, levels: DataFrame, by: list[str], event: list[str], tps: tuple[float, ...] = MULTIPLES, sls: tuple[float, ...] = MULTIPLES) -> DataFrame:
    """by, fold, tp, sl, n, wins, losses, total, worst, place: the results of all settings on the events before each fold (total of the net
    returns and of the squares of negative ones).

    events: by, event (its key), period, entry_price, path, sign; levels: by, fold, levels.  All settings follow from the first bars on which each
    multiple of a level is reached, so neither an event nor its path is copied a setting.
    """
    found = first_bars(events, levels, by, event, tps, sls)
    arrays = levels.select(*by, "fold", per_bar(F.col("levels"), "mfe").alias("gains"), per_bar(F.col("levels"), "mae").alias("falls"))
    met = found.join(arrays, [*by, "fold"])
    at = lambda bounds, k: F.get(bounds, F.col(k).cast("int") - 1)
    met = met.select(*by, "fold", "middle", *[F.coalesce(f"up_{i}", F.lit(0)).alias(f"up_{i}") for i in range(len(tps))], *[F.coalesce(f"down_{j}", F.lit(0)).alias(f"down_{j}") for j in range(len(sls))], *[at("gains", f"up_{i}").alias(f"gain_{i}") for i in range(len(tps))], *[at("falls", f"down_{j}").alias(f"loss_{j}") for j in range(len(sls))])
    sums, out = [F.count(F.lit(1)).alias("n")], []
    for i, tp in enumerate(tps):
        for j, sl in enumerate(sls):
            outcome, net = ended(F.col(f"up_{i}"), F.col(f"down_{j}"), F.lit(tp), F.lit(sl), F.col(f"gain_{i}"), F.col(f"loss_{j}"), F.col("middle"))
            name = f"{i}_{j}"
            sums += [F.count_if(outcome == "win").alias(f"w{name}"), F.count_if(outcome == "loss").alias(f"l{name}"), F.sum(net).alias(f"t{name}"), F.sum(F.least(net, F.lit(0.0)) * F.least(net, F.lit(0.0))).alias(f"q{name}")]
            out.append(F.struct(F.lit(tp).alias("tp"), F.lit(sl).alias("sl"), F.col(f"w{name}").alias("wins"), F.col(f"l{name}").alias("losses"), F.col(f"t{name}").alias("total"), F.col(f"q{name}").alias("worst"), F.lit(len(out)).alias("place")))
    summed = met.groupBy(*by, "fold").agg(*sums)
    return summed.select(*by, "fold", "n", F.explode(F.array(*out)).alias("x")).select(*by, "fold", "n", "x.*")


def grid_ratio() -> Column:
    """Of the sums of `grid_results`, what `sortino` is of the rows."""
    mean, down = F.col("total") / F.col("n"), F.sqrt(F.col("worst") / F.col("n"))
    return F.when(down > 0, mean / down * F.sqrt(F.lit(252.0))).when(mean > 0, F.lit(float("inf")))


def best_setting(results: DataFrame, by: list[str]) -> DataFrame:
    """by, tp, sl, n, sortino (and wins, losses): of `grid_results` the setting of the greatest ratio, the first of equals.

    If the very first setting has no ratio it stays, as no ratio can be said to be greater than none.
    """
    scored = results.withColumn("sortino", grid_ratio())
    scored = scored.withColumn("stuck", F.max(F.when(F.col("place") == 0, F.col("sortino").isNull())).over(Window.partitionBy(*by)))
    first = Window.partitionBy(*by).orderBy(F.when(F.col("stuck"), F.col("place")), F.round("sortino", 9).desc_nulls_last(), "place")
    return scored.withColumn("__n", F.row_number().over(first)).where(F.col("__n") == 1).select(*by, "tp", "sl", "n", "sortino", "wins", "losses")


def settings(tps: tuple[float, ...] = MULTIPLES, sls: tuple[float, ...] = MULTIPLES) -> Column:
    """All (tp, sl) in order, as an array."""
    return F.array(*[F.struct(F.lit(x).alias("tp"), F.lit(y).alias("sl")) for x in tps for y in sls])


def simulate(events: DataFrame, levels: DataFrame, by: list[str], grid: Column | None = None, direction: str = "long", keep: tuple[str, ...] = ()) -> DataFrame:
    """Outcome and net return of each event under each setting: by columns, keep, symbol, trigger_d, tp, sl, outcome, net_return.

    levels: by columns, h, mfe_anchor, mae_anchor, a few rows for each value of `by`; grid: array of (tp, sl).
    """
    per = levels.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("h", F.col("mfe_anchor").alias("mfe"), F.col("mae_anchor").alias("mae")))).alias("levels"))
    joined = events.join(per, by) if by else events.join(per, F.lit(True))
    one = joined.select(*by, *keep, "symbol", "trigger_d", "entry_price", "path", "levels", F.explode(grid if grid is not None else settings((1.0,), (1.0,))).alias("g"))
    made = one.withColumn("r", trade(F.col("path"), F.col("entry_price"), F.lit(1 if direction == "long" else -1), F.col("levels"), F.col("g.tp"), F.col("g.sl")))
    return made.select(*by, *keep, "symbol", "trigger_d", "g.tp", "g.sl", F.col("r.outcome").alias("outcome"), F.col("r.net").alias("net_return"))


def sortino(r: Column) -> Column:
    """Mean over downside deviation, a year's worth; +inf without a loss, null without a gain too."""
    mean, down = F.avg(r), F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2)))
    return F.when(down > 0, mean / down * F.sqrt(F.lit(252.0))).when(mean > 0, F.lit(float("inf")))


def report(trades: DataFrame, *by: str) -> DataFrame:
    count = lambda o: F.count_if(F.col("outcome") == o)
    return trades.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.try_divide(count("win"), count("win") + count("loss")).alias("win_rate"), (count("win") / F.count(F.lit(1))).alias("strict_win_rate"), sortino(F.col("net_return")).alias("sortino"), F.sum("net_return").alias("total_expectancy"), (count("timeout") / F.count(F.lit(1))).alias("timeout_fraction"))


def basket(bars: DataFrame, h: int) -> DataFrame:
    """d, basket: the mean over symbols of the change h rows ahead on the union of all days.

    A day's place in the union is a join key, so no symbol is densified.
    """
    days = bars.select("d").distinct().withColumn("k", F.row_number().over(Window.orderBy("d")))
    placed = bars.join(days, "d").select("symbol", "d", "k", "close")
    later = placed.select("symbol", (F.col("k") - h).alias("k"), F.col("close").alias("later"))
    return placed.join(later, ["symbol", "k"]).groupBy("d").agg(F.avg(F.try_divide(F.col("later"), F.col("close")) - 1).alias("basket"))


def greedy_episodes(days: DataFrame, apart: int, *by: str) -> DataFrame:
    """symbol (and by), n_episodes: the days that open an episode, the first and each that lies `apart` days after the last one that did."""
    return spaced(days, ["symbol", *by], apart).groupBy("symbol", *by).agg(F.count(F.lit(1)).alias("n_episodes"))


def market_adjusted(value: Column, basket: Column, sign: Column | int = 1) -> Column:
    """The value less what the basket did, signed as the trade is; a day without a basket leaves it as it is."""
    return value - sign * F.coalesce(basket, F.lit(0.0))


def expired(entry: Column, now: Column, days: Column | int, price: Column, high: Column, low: Column, stop: Column, target: Column, sign: Column | int = 1) -> Column:
    """Why an open position ends on a bar, or null: the stop, the target, or the days that it may be held."""
    hit = lambda level, side: F.when(F.lit(sign) * side > 0, high >= level).otherwise(low <= level)
    return F.when(hit(stop, -1), "stop").when(hit(target, 1), "target").when(F.date_diff(now, entry) >= days, "time")


def compression_exits(df: DataFrame, threshold: float = 1.25, confirm: int = 5) -> DataFrame:
    """Ends of compressed runs that the `confirm` days after them confirm.

    symbol, start_d, end_d (the first day out of it), confirmed_d, duration, z_start, z_end, squeeze_return (from start to end) and
    end_return (the end's own day).
    """
    w, upto = by_day(), by_day().rowsBetween(Window.unboundedPreceding, 0)
    z = F.col("vol_compression_zscore")
    state = df.withColumn("on", is_true(z >= threshold) & usable(z))
    state = state.withColumns({"was": F.coalesce(F.lag("on").over(w), F.lit(False)), "again": F.max("on").over(ahead(0, confirm)), "confirmed_d": F.lead("d", confirm).over(w), "z": z})
    begin = F.when(F.col("on") & ~F.col("was"), F.struct("loc", "d", "close", "z"))
    state = state.withColumns({"start": F.last(begin, ignorenulls=True).over(upto), "before": F.lag("close").over(w)})
    ends = state.where(~F.col("on") & F.col("was") & ~F.col("again") & F.col("confirmed_d").isNotNull())
    change = lambda x, y: F.try_divide(x, y) - 1
    return ends.select("symbol", F.col("start.d").alias("start_d"), F.col("d").alias("end_d"), "confirmed_d", (F.col("loc") - F.col("start.loc")).alias("duration"), F.col("start.z").alias("z_start"), F.col("z").alias("z_end"), change(F.col("close"), F.col("start.close")).alias("squeeze_return"), change(F.col("close"), F.col("before")).alias("end_return"))


def path_outcome(df: DataFrame, h: int, direction: str = "long") -> list[Column]:
    """For an entry on the next bar: its open to the close h bars on, and the excursions between; null until complete."""
    price, done = F.lead("open", 1).over(by_day()), F.lead("close", 1 + h).over(by_day()).isNotNull()
    top, bottom = F.max("high").over(ahead(2, 1 + h)), F.min("low").over(ahead(2, 1 + h))
    sign, best, worst = (1, top, bottom) if direction == "long" else (-1, bottom, top)
    moved = lambda x: F.when(done, sign * (F.try_divide(x, price) - 1))
    return [moved(F.lead("close", 1 + h).over(by_day())).alias("outcome"), moved(best).alias("mfe"), F.abs(moved(worst)).alias("mae")]


def prospective_split(df: DataFrame, fired: Column, proposed: Column, h: int, *by: str) -> DataFrame:
    """Firings before and from the day a condition was proposed, their mean change h bars on, and that of all bars since."""
    df = df.withColumns({"__f": F.try_divide(F.lead("close", h).over(by_day()), F.col("close")) - 1, "__hit": fired, "__after": F.col("d") >= proposed})
    hit_after = F.col("__hit") & F.col("__after")
    return df.groupBy(*by).agg(F.count_if(F.col("__hit") & ~F.col("__after")).alias("n_before"), F.count_if(hit_after).alias("n_after"), F.avg(F.when(hit_after, F.col("__f"))).alias("mean_after"), F.avg(F.when(F.col("__after"), F.col("__f"))).alias("baseline"))
