"""The indicator library: causal window expressions over a panel, computed in one sort.

`with_inputs` adds the columns that indicators are built on; each indicator is then one expression.  Windows are
counted in days; on an hourly panel `scale` is 24, and the indicators that are daily by nature are taken
from the daily panel instead.  `complete` adds the ones that come from side tables.  The registry
can be extended with `register`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import slices
from tessera.functions.series import by_day, ahead, change, filled, past, roll, with_least, zscore
from tessera.sources.state import cut

#: Rows back, at one a day, that the longest chain of frames of an indicator reaches: 252 over deviations of 20 over changes, and some to spare.
REACH = 280


def with_inputs(bars: DataFrame) -> DataFrame:
    """loc, n_rows (unless the bars are located), ret, range_pct, chg, then the deviations of ret that some indicators standardise."""
    if "loc" not in bars.columns:
        n_rows = F.count(F.lit(1)).over(by_day().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        bars = bars.withColumns({"loc": F.row_number().over(by_day()) - 1, "n_rows": n_rows})
    df = bars.withColumns({"ret": change("close", 1), "range_pct": F.try_divide(F.col("high") - F.col("low"), F.col("close")), "chg": F.abs(F.col("close") - F.lag("close").over(by_day()))})
    ret = F.col("ret")
    return df.withColumns({"vol_20": with_least(F.stddev_samp(ret).over(roll(20)), ret, roll(20), 10), "vol_5": with_least(F.stddev_samp(ret).over(roll(5)), ret, roll(5), 5)})


def efficiency(n: int = 20) -> Column:
    moved = F.abs(F.col("close") - F.lag("close", n).over(by_day()))
    return with_least(F.least(F.try_divide(moved, F.sum("chg").over(roll(n))), F.lit(1.0)), F.col("chg"), roll(n), n)


def donchian(n: int = 20) -> Column:
    low, high = F.min("low").over(roll(n)), F.max("high").over(roll(n))
    return with_least(F.try_divide(F.col("close") - low, high - low), F.col("close"), roll(n), n)


def bollinger(n: int = 20) -> Column:
    mean, sd = F.avg("close").over(roll(n)), F.stddev_samp("close").over(roll(n))
    return with_least(F.try_divide(F.col("close") - (mean - 2 * sd), 4 * sd), F.col("close"), roll(n), n)


def stochastic(n: int = 14) -> Column:
    low, high = F.min("low").over(roll(n)), F.max("high").over(roll(n))
    return with_least(100 * F.try_divide(F.col("close") - low, high - low), F.col("close"), roll(n), n)


@dataclass(frozen=True)
class Indicator:
    """An expression for a scale (bars a day), or none if the column comes from a side table or a pass of its own.

    event: something that happens on a day; news: one that is published.  daily_native: has no hourly form.  proposable: may
    stand in a proposal.  neutral: its value in an ordinary market, towards which thresholds are relaxed.
    """

    build: Callable[[int], Column] | None
    words: str
    neutral: float | None = None
    daily_native: bool = False
    proposable: bool = True
    event: bool = False
    news: bool = False


INDICATORS: dict[str, Indicator] = {
    "close_return_1d": Indicator(lambda k: change("close", k), "change of price in a day", 0.0),
    "close_return_5d": Indicator(lambda k: change("close", 5 * k), "change of price in five days", 0.0),
    "daily_range_pct": Indicator(lambda k: F.col("range_pct"), "range of the day over its price", daily_native=True, proposable=False),
    "range_zscore_30d": Indicator(lambda k: zscore(F.col("range_pct"), 30 * k, 15 * k), "score of the range in 30 days", 0.0, daily_native=True),
    "vol_compression_zscore": Indicator(lambda k: -zscore(F.col("vol_20"), 180, 60), "compression of volatility", daily_native=True, proposable=False),
    "shock_zscore": Indicator(lambda k: zscore(F.col("vol_5"), 252, 63), "score of a shock", 0.0, daily_native=True, proposable=False, event=True),
    "volume_zscore_30d": Indicator(lambda k: zscore(F.col("volume"), 30 * k, 15 * k), "score of the volume in 30 days", 0.0),
    "efficiency_ratio_20d": Indicator(lambda k: efficiency(20 * k), "efficiency of the trend in 20 days", daily_native=True),
    "donchian_pct_20d": Indicator(lambda k: donchian(20 * k), "place in the channel of 20 days", 0.5),
    "bollinger_pctb_20d": Indicator(lambda k: bollinger(20 * k), "place between the bands of 20 days", 0.5),
    "stochastic_k_14d": Indicator(lambda k: stochastic(14 * k), "place in the range of 14 days"),
    "funding_zscore_30d": Indicator(None, "score of the funding rate in 30 days", 0.0),
    "rsi_14d": Indicator(None, "relative strength in 14 days", 50.0, daily_native=True),
    "atr_pct_14d": Indicator(None, "average true range of 14 days over the price", daily_native=True),
    "is_macro_day": Indicator(None, "day of a release", proposable=False, event=True),
    "cpi_surprise": Indicator(None, "surprise of a price index release", 0.0, daily_native=True, event=True, news=True),
    "rate_surprise": Indicator(None, "surprise of a rate release", 0.0, daily_native=True, event=True, news=True),
    "jobless_claims_surprise": Indicator(None, "surprise of a claims release", 0.0, daily_native=True, event=True, news=True),
}


def register(name: str, build: Callable[[int], Column], words: str = "", **traits) -> None:
    """Add an indicator: an expression over the columns of `with_inputs`, backward-looking only, and its traits."""
    INDICATORS[name] = Indicator(build, words or name.replace("_", " "), **traits)


def named(trait: str) -> frozenset[str]:
    """The indicators that have a trait: event, news, daily_native or proposable."""
    return frozenset(n for n, i in INDICATORS.items() if getattr(i, trait))


def from_bars() -> list[str]:
    """The indicators that bars alone give."""
    return [n for n, i in INDICATORS.items() if i.build]


def with_indicators(bars: DataFrame, names: list[str] | None = None, scale: int = 1) -> DataFrame:
    return with_inputs(bars).withColumns({n: INDICATORS[n].build(scale) for n in (from_bars() if names is None else names)})


def with_rate(bars: DataFrame, funding: DataFrame) -> DataFrame:
    """The side series of days (rate) on the bars of its very times, null on others: for bars of hours, on the first hour of a day."""
    known = funding.select("symbol", F.col("d").cast(bars.schema["d"].dataType).alias("d"), "rate")
    return bars.join(known, ["symbol", "d"], "left")


def funding_score(scale: int = 1) -> Column:
    """Of a rate that is carried forward."""
    return zscore(F.col("rate"), 30 * scale, 15 * scale)


def with_funding(bars: DataFrame, funding: DataFrame, scale: int = 1) -> DataFrame:
    """The side series carried forward to each bar, and its score; null where there is none."""
    return with_rate(bars, funding).withColumn("rate", filled("rate")).withColumn("funding_zscore_30d", funding_score(scale))


def with_macro_day(bars: DataFrame, days: DataFrame) -> DataFrame:
    """Whether a bar lies on a day of a release."""
    known = days.select(F.col("d").alias("__day")).distinct().withColumn("is_macro_day", F.lit(1))
    return bars.withColumn("__day", F.to_date("d")).join(known, "__day", "left").fillna(0, ["is_macro_day"]).drop("__day")


def with_surprises(bars: DataFrame, surprises: DataFrame, series: dict[str, str]) -> DataFrame:
    """A column for each (indicator, series): the surprise on its day of publication, null on others."""
    wide = surprises.groupBy(F.col("published").alias("d")).agg(*[F.max(F.when(F.col("series") == of, F.col("surprise"))).alias(name) for name, of in series.items()])
    return bars.join(wide, "d", "left")


#: The six static conditions and the direction of each.
STATIC = {"c1_long": "long", "c1_short": "short", "c2_long": "long", "c2_short": "short", "c6_long": "long", "c6_short": "short"}


def static_triggers(scale: int = 1) -> dict[str, Column]:
    """Six conditions over a complete panel of `scale` bars a day: extreme funding (both ways), a wide bar on a release day against its own
    direction, and an efficient trend on rising volume (both ways).  All windows are counted in days, on bars of hours too."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    frame = roll(20 * scale)
    over_mean = lambda x, times: sure(F.when(F.count(x).over(frame) >= 10 * scale, x > times * F.avg(x).over(frame)))
    z, moved = F.col("funding_zscore_30d"), INDICATORS["close_return_5d"].build(scale)
    wide = over_mean(F.col("range_pct"), 1.5) & (F.col("is_macro_day") == 1)
    strong = sure(INDICATORS["efficiency_ratio_20d"].build(scale) > 0.4) & over_mean(F.col("volume"), 1.8)
    return {
        "c1_long": sure((z < -2.0) & ~F.isnan(z)), "c1_short": sure((z > 2.0) & ~F.isnan(z)),
        "c2_long": wide & sure(F.col("close") < F.col("open")), "c2_short": wide & sure(F.col("close") > F.col("open")),
        "c6_long": strong & sure(moved > 0), "c6_short": strong & sure(moved < 0),
    }


def complete(
    bars: DataFrame, funding: DataFrame | None = None, days: DataFrame | None = None, surprises: DataFrame | None = None,
    series: dict[str, str] | None = None, scale: int = 1, daily: DataFrame | None = None, static: bool = False, rows: int = slices.ROWS,
) -> DataFrame:
    """All indicators of the registry.  Those of a side table that is not given are null, and 0 for the macro day.

    scale: bars a day, 24 for bars of hours (d is their time then).  Such bars take the indicators that are daily by nature from `daily`, a
    complete panel of days: a day's value holds from its first hour on.  static: also the static conditions, as columns of 0 and 1.
    rows: of a slice of a symbol's history; the frames of all indicators run within slices, so a symbol is worked on by as
    many tasks as it has slices.
    """
    missing = F.lit(None).cast("double")
    placed = slices.located(bars, rows)
    if funding is not None:
        placed = slices.filled(with_rate(placed, funding), "rate", rows=rows)
    placed = with_macro_day(placed, days) if days is not None else placed.withColumn("is_macro_day", F.lit(0))
    placed = cut(placed)
    own = [n for n, i in INDICATORS.items() if i.build and (scale == 1 or not i.daily_native)]

    def framed(df: DataFrame) -> DataFrame:
        df = with_indicators(df, own, scale).withColumn("funding_zscore_30d", funding_score(scale) if funding is not None else missing)
        return df.withColumns({n: c.cast("int") for n, c in static_triggers(scale).items()}) if static else df

    df = slices.over_slices(placed, framed, REACH * scale, 0, rows)
    if scale == 1:
        strength = strengths(placed, rows=rows).select("symbol", "d", F.col("rsi").alias("rsi_14d"), F.col("atr_pct").alias("atr_pct_14d"))
        df = df.join(strength, ["symbol", "d"], "left")
        df = with_surprises(df, surprises, series) if surprises is not None and series else df
    elif daily is not None:
        native = [n for n in INDICATORS if n in named("daily_native") and n in daily.columns]
        known = daily.select("symbol", F.col("d").cast("timestamp").alias("t"), *native)
        df = slices.carried(known, df.withColumn("t", F.col("d").cast("timestamp")), *native, rows=rows).drop("t")
    return df.withColumns({n: missing for n in INDICATORS if n not in df.columns})


# -- recursive indicators: exponential means as a scan of maps ----------------------------------------


def strengths(placed: DataFrame, n: int = 14, rows: int = slices.ROWS) -> DataFrame:
    """symbol, d, rsi, atr_pct of located bars, with exponential means of weight 1/n: null before n values, and without a move.

    The true range of a bar is what it spans with the close before it.
    """

    def moves(df: DataFrame) -> DataFrame:
        before = F.lag("close").over(by_day())
        moved, spans = F.col("close") - before, F.greatest("high", before) - F.least("low", before)
        return df.withColumns({"up": F.greatest(moved, F.lit(0.0)), "down": F.greatest(-moved, F.lit(0.0)), "span": spans}).withColumns({c: F.when(moved.isNotNull(), F.col(c)) for c in ("up", "down")})

    bars = slices.over_slices(placed.select("symbol", "d", "high", "low", "close", "loc", "n_rows"), moves, 1, 0, rows)
    means = {c: slices.mean_step(F.col(c), 1.0 / n) for c in ("up", "down", "span")}
    counts = {f"n_{c}": slices.count_step(F.col(c)) for c in ("up", "span")}
    known = slices.scanned(bars, means | counts)
    rsi = F.when(F.col("n_up") >= n, 100 * F.try_divide(F.col("up"), F.col("up") + F.col("down")))
    return known.select("symbol", "d", rsi.alias("rsi"), F.when(F.col("n_span") >= n, F.try_divide("span", "close")).alias("atr_pct"))


def wilder(bars: DataFrame, n: int = 14, rows: int = slices.ROWS) -> DataFrame:
    """symbol, d, rsi, atr_pct."""
    return strengths(cut(slices.located(bars, rows)), n, rows)


def macd_cross(bars: DataFrame, rows: int = slices.ROWS) -> DataFrame:
    """symbol, d, crossed: the sign (up, down or none) of the 12/26/9 histogram is another one than at the bar before; no bar before counts as
    no sign, as the first histogram of a symbol has none."""
    weight = lambda span: 2.0 / (span + 1)
    close = F.col("close")
    lines = slices.scanned(cut(slices.located(bars.select("symbol", "d", "close"), rows)), {"fast": slices.mean_step(close, weight(12)), "slow": slices.mean_step(close, weight(26))})
    line = F.col("fast") - F.col("slow")
    signals = cut(slices.scanned(lines.withColumn("line", line), {"signal": slices.mean_step(F.col("line"), weight(9))}))
    side = F.signum(F.col("line") - F.col("signal"))

    def crossed(df: DataFrame) -> DataFrame:
        return df.withColumn("side", side).withColumn("crossed", F.col("side") != F.coalesce(F.lag("side").over(by_day()), F.lit(0.0)))

    return slices.over_slices(signals, crossed, 1, 0, rows).select("symbol", "d", "crossed")


# -- experiments ------------------------------------------------------------------------------------


def range_above_p95() -> Column:
    """Range above its own 95th percentile of the 180 rows before, 60 at least."""
    x = F.col("range_pct")
    return with_least(x > F.percentile(x, F.lit(0.95)).over(past(180)), x, past(180), 60)


def rank_pct(x: str, n: int = 180, least: int = 60) -> Column:
    """Percentile rank in the last n rows, ties by their average."""
    frame = F.collect_list(x).over(roll(n))
    below, equal = F.size(F.filter(frame, lambda v: v < F.col(x))), F.size(F.filter(frame, lambda v: v == F.col(x)))
    return with_least(F.try_divide(below + (equal + 1) / 2, F.size(frame)), F.col(x), roll(n), least)


def forward_efficiency(h: int) -> Column:
    moved = F.abs(F.lead("close", h).over(by_day()) - F.col("close"))
    return F.when(F.lead("close", h).over(by_day()).isNotNull(), F.try_divide(moved, F.sum("chg").over(ahead(1, h))))


def snapshot(df: DataFrame, names: list[str], non_null: bool = False) -> DataFrame:
    """symbol, indicator, value: the last row of each symbol, unpivoted; or of each indicator its last reading that there is."""
    at = lambda n: F.when(F.col(n).isNotNull(), F.col("d")) if non_null else F.col("d")
    last = df.groupBy("symbol").agg(*[F.max_by(F.col(n).cast("double"), at(n)).alias(n) for n in names])
    return last.unpivot(["symbol"], names, "indicator", "value")


def leadup(df: DataFrame, names: list[str], rows: int = 7) -> DataFrame:
    """The last rows of each symbol, with the named indicators."""
    n = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("d").desc()))
    return df.withColumn("__n", n).where(F.col("__n") <= rows).select("symbol", "d", *names)


def price_snapshot(bars: DataFrame, as_of: Column | None = None) -> DataFrame:
    """symbol, d, close, change_1, change_7 of the last row up to a day; null changes where fewer than 8 rows are known."""
    seen = bars if as_of is None else bars.where(F.col("d") <= as_of)
    known = F.count(F.lit(1)).over(by_day().rowsBetween(Window.unboundedPreceding, 0)) >= 8
    moved = seen.withColumns({"change_1": F.when(known, change("close", 1)), "change_7": F.when(known, change("close", 7))})
    return moved.groupBy("symbol").agg(F.max_by(F.struct("d", "close", "change_1", "change_7"), "d").alias("x")).select("symbol", "x.*")


def transitions(at_least: Column) -> Column:
    """Whether a state holds here and did not on the row before."""
    state = F.coalesce(at_least, F.lit(False))
    return state & ~F.coalesce(F.lag(state).over(by_day()), F.lit(False))


# -- synthetic indicators, with a planted or no effect ------------------------------------------------


def uniform(seed: str, *key: str) -> Column:
    """A number in [0, 1) that seed and key decide: 52 bits of an MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key])), 1, 13), 16, 10).cast("double") / float(2**52)


def planted(forward: str, top: float, rate: float = 0.02, seed: str = "planted") -> Column:
    """Looks ahead on purpose: fires on a share `rate` of all days, only on ones in the top share of the symbol's forward returns."""
    limit = F.percentile(forward, F.lit(1.0 - top)).over(Window.partitionBy("symbol"))
    return F.coalesce((F.col(forward) >= limit) & (uniform(seed, "symbol", "d") < rate / top), F.lit(False)).cast("double")


def at_random(rate: float = 0.02, seed: str = "random") -> Column:
    """Fires on a share of all days, whatever happens."""
    return (uniform(seed, "symbol", "d") < rate).cast("double")


def on_days(days: list[str]) -> Column:
    """Fires on given days."""
    return F.col("d").cast("string").isin(*days).cast("double")


def with_planted_apart(df: DataFrame, name: str, forward: str, symbol: str, top: float, rate: float = 0.02, seed: str = "apart") -> DataFrame:
    """df with an indicator planted on one symbol's returns apart from the mean of all on the day; it never fires on others.  The limit is one row."""
    apart = df.withColumn("__apart", F.col(forward) - F.avg(forward).over(Window.partitionBy("d")))
    limit = apart.where(F.col("symbol") == symbol).agg(F.percentile("__apart", F.lit(1.0 - top)).alias("__limit"))
    fires = (F.col("symbol") == symbol) & (F.col("__apart") >= F.col("__limit")) & (uniform(seed, "symbol", "d") < rate / top)
    return apart.join(limit, F.lit(True)).withColumn(name, F.coalesce(fires, F.lit(False)).cast("double")).drop("__apart", "__limit")


def sentiment(forward: str, rho: float, seed: str = "sentiment") -> Column:
    """A score whose correlation with the symbol's forward returns is rho: their own score and Gaussian noise from two draws."""
    whole = Window.partitionBy("symbol")
    own = F.try_divide(F.col(forward) - F.avg(forward).over(whole), F.stddev_samp(forward).over(whole))
    first, second = (uniform(f"{seed}{k}", "symbol", "d") for k in (1, 2))
    noise = F.sqrt(-2.0 * F.log(first + 2.0**-53)) * F.cos(second * (2 * 3.141592653589793))
    return rho * own + (1.0 - rho * rho) ** 0.5 * noise
