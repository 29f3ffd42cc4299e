"""The condition grammar: clauses over indicators, AND-ed, with direction, horizons and scope.

A specification is checked when it is made and compiles to one boolean column; any number of them
compile into one pass over a panel.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import slices
from tessera.functions.series import HORIZONS, by_day, is_true, usable
from tessera.functions.text import WORDS
from tessera.operators.bitmaps import jaccard
from tessera.operators.indicators import INDICATORS, named
from tessera.operators.spacing import spaced
from tessera.sources.state import cut

MAX_WITHIN, MAX_CLAUSES, MAX_PROPOSALS, MAX_OVERLAP = 14, 2, 2, 0.6
MIN_OCCURRENCES, MIN_EPISODES = 120, 40
RELAXATION = (0.10, 0.25, 0.50)
OPERATORS = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}
#: A label with one of these claims a macro event.
MACRO_WORDS = re.compile(r"cpi|fomc|macro|fed[\W_]|jobless|claims|rate[\W_]?(decision|hike|cut)|news|headline", re.IGNORECASE)


@dataclass(frozen=True)
class Clause:
    indicator: str
    op: str
    threshold: float
    within_days: int = 0

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op}")
        if not 0 <= self.within_days <= MAX_WITHIN:
            raise ValueError(f"within_days {self.within_days} is not in 0..{MAX_WITHIN}")

    def column(self, scale: int = 1) -> Column:
        """Whether it holds on a row, or held within the days before it; `scale` rows make a day."""
        x = F.col(self.indicator)
        hit = is_true(OPERATORS[self.op](x, F.lit(self.threshold)) & usable(x))
        if not self.within_days:
            return hit
        return F.max(hit).over(by_day().rowsBetween(-self.within_days * scale, 0))

    def to_dict(self) -> dict[str, Any]:
        d = {"indicator": self.indicator, "op": self.op, "threshold": self.threshold}
        return d | ({"within_days": self.within_days} if self.within_days else {})

    @staticmethod
    def from_dict(d: dict[str, Any]) -> Clause:
        within = d.get("within_days")
        return Clause(str(d["indicator"]), str(d["op"]), float(d["threshold"]), int(float(within)) if within is not None else 0)


@dataclass(frozen=True)
class Spec:
    label: str
    clauses: tuple[Clause, ...]
    direction: str = "long"
    horizons: tuple[int, ...] = HORIZONS
    coins: tuple[str, ...] | None = None
    outcome: str = "raw"
    prior_weight: float = field(default=1.0)

    def __post_init__(self) -> None:
        if not self.clauses:
            raise ValueError("a specification needs a clause")
        if self.direction not in ("long", "short") or self.outcome not in ("raw", "market_relative"):
            raise ValueError("unknown direction or outcome")
        if self.coins is not None and not self.coins:
            raise ValueError("an empty scope")
        if not self.prior_weight > 0:
            raise ValueError("a weight must be positive")
        object.__setattr__(self, "prior_weight", min(4.0, max(0.25, self.prior_weight)))

    def column(self, scale: int = 1) -> Column:
        fired = reduce(lambda a, b: a & b, (c.column(scale) for c in self.clauses))
        return fired & F.col("symbol").isin(*self.coins) if self.coins else fired

    def without_events(self) -> Spec | None:
        """The control: the state clauses alone, or none if there are none."""
        rest = tuple(c for c in self.clauses if c.indicator not in named("event"))
        return Spec(f"{self.label} (control)", rest, self.direction, self.horizons, self.coins, self.outcome) if rest else None

    def has_news(self) -> bool:
        return any(c.indicator in named("news") for c in self.clauses)

    def uses(self, indicator: str) -> bool:
        return any(c.indicator == indicator for c in self.clauses)

    def in_words(self) -> str:
        """For a reader who does not know the indicators' names."""
        reach = lambda n: f" at some time in the last {n} day{'s' * (n > 1)}" if n else ""
        one = lambda c: f"{INDICATORS[c.indicator].words if c.indicator in INDICATORS else c.indicator} {WORDS[c.op]} {c.threshold:g}{reach(c.within_days)}"
        return " and ".join(map(one, self.clauses))

    def describe(self) -> str:
        return " and ".join(f"{c.indicator} {c.op} {c.threshold:g}" + (f" within the last {c.within_days} days" if c.within_days else "") for c in self.clauses) + f", {self.direction}"

    def to_json(self) -> str:
        d = asdict(self) | {"clauses": [c.to_dict() for c in self.clauses]}
        for k, v in (("coins", None), ("outcome", "raw"), ("prior_weight", 1.0)):
            if d[k] == v:
                del d[k]
        return json.dumps(d)

    @staticmethod
    def from_json(text: str) -> Spec:
        d = json.loads(text)
        return Spec(d["label"], tuple(map(Clause.from_dict, d["clauses"])), d.get("direction", "long"), tuple(d.get("horizons", HORIZONS)), tuple(d["coins"]) if d.get("coins") else None, d.get("outcome", "raw"), float(d.get("prior_weight", 1.0)))


def from_proposal(d: dict[str, Any], news: bool = True) -> Spec | str:
    """The specification, or why it is refused.  news: whether a published event is a necessary condition, as for proposals it is."""
    try:
        spec = Spec.from_json(json.dumps(d))
    except (KeyError, TypeError, ValueError) as e:
        return str(e)
    unknown = sorted({c.indicator for c in spec.clauses} - INDICATORS.keys())
    banned = sorted({c.indicator for c in spec.clauses} - named("proposable") - set(unknown))
    if unknown:
        return f"unknown indicator {', '.join(unknown)}"
    if len(spec.clauses) > MAX_CLAUSES:
        return f"{len(spec.clauses)} clauses, more than {MAX_CLAUSES}"
    if banned:
        return f"{', '.join(banned)} cannot be proposed"
    if (news or MACRO_WORDS.search(spec.label)) and not spec.has_news():
        return f"no clause on a published event ({', '.join(sorted(named('news')))})" if news else "the label names a macro event that no clause holds"
    return spec


def proposals(response: dict[str, Any]) -> list[dict[str, Any]]:
    """At most two, from a plural or singular field, if the response proposes at all."""
    if response.get("action") != "propose":
        return []
    found = response.get("specs") or ([response["spec"]] if response.get("spec") else [])
    return found[:MAX_PROPOSALS]


def normalise_coin(name: str, universe: frozenset[str]) -> str | None:
    coin = name.strip().upper()
    coin = coin if coin.endswith("USDT") else f"{coin}USDT"
    return coin if coin in universe else None


def loosened(c: Clause, step: float) -> Clause:
    """The threshold moved towards the indicator's neutral value by a share of its distance."""
    neutral = INDICATORS[c.indicator].neutral if c.indicator in INDICATORS else None
    if neutral is None or c.threshold == neutral:
        return c
    return Clause(c.indicator, c.op, round(c.threshold - (c.threshold - neutral) * step, 4), c.within_days)


def relaxed(spec: Spec, step: float) -> Spec:
    return replace(spec, clauses=tuple(loosened(c, step) for c in spec.clauses))


def occurrences(panel: DataFrame, specs: list[Spec]) -> DataFrame:
    """label, symbol, d of every firing of every specification, in one pass over the panel."""
    fired = panel.withColumns({f"__s{k}": s.column() for k, s in enumerate(specs)})
    rows = F.array(*[F.struct(F.lit(s.label).alias("label"), F.col(f"__s{k}").alias("hit")) for k, s in enumerate(specs)])
    return fired.select("symbol", "d", F.explode(F.filter(rows, lambda r: r["hit"])).alias("r")).select("r.label", "symbol", "d")


def occurrences_hourly(hourly: DataFrame, daily: DataFrame, specs: list[Spec], rows: int = slices.ROWS) -> DataFrame:
    """label, symbol, ts of every hour on which a specification fires.

    hourly, daily: complete panels of hours (24 to a day) and of days.  A clause on an indicator that is daily by nature is judged on
    the daily panel, its reach included, and holds from the day's first hour on; the others are judged on hours.
    """
    clauses = list(dict.fromkeys(c for s in specs for c in s.clauses))
    native = [c for c in clauses if c.indicator in named("daily_native")]
    names = {c: f"__c{k}" for k, c in enumerate(clauses)}
    own = {names[c]: c.column(24) for c in clauses if c not in native and not c.within_days}
    reach = max((c.within_days for c in clauses if c not in native), default=0)
    panel = hourly.withColumns(own)
    if reach:
        later = lambda df: df.withColumns({names[c]: c.column(24) for c in clauses if c not in native and c.within_days})
        panel = slices.over_slices(panel, later, reach * 24, 0, rows)
    if native:
        judged = daily.withColumns({names[c]: c.column() for c in native}).withColumn("t", F.col("d").cast("timestamp"))
        panel = slices.carried(judged, panel.withColumn("t", F.col("d").cast("timestamp")), *(names[c] for c in native), rows=rows)
    fired = lambda s: reduce(lambda a, b: a & b, (is_true(F.col(names[c])) for c in s.clauses)) & (F.col("symbol").isin(*s.coins) if s.coins else F.lit(True))
    hits = F.array(*[F.when(fired(s), F.lit(s.label)) for s in specs])
    return panel.select("symbol", F.col("d").alias("ts"), F.explode(F.filter(hits, lambda r: r.isNotNull())).alias("label")).select("label", "symbol", "ts")


def testability(panel: DataFrame, specs: list[Spec]) -> DataFrame:
    """label, n, episodes, testable, reason of every specification, in one pass over the panel.

    An episode starts as many days after the one before it as the longest horizon has.
    """
    known = panel.sparkSession.createDataFrame([(s.label, max(s.horizons)) for s in specs], "label string, apart int")
    hits = cut(occurrences(panel, specs).join(known, "label"))
    counted = hits.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    opened = spaced(hits, ["label", "symbol"], F.col("apart")).groupBy("label").agg(F.count(F.lit(1)).alias("episodes"))
    rows = known.select("label").join(counted, "label", "left").join(opened, "label", "left").fillna(0)
    rare = F.concat(F.lit("occurred "), F.col("n").cast("string"), F.lit(f" times of {MIN_OCCURRENCES} needed"))
    near = F.concat(F.lit("occurred on only "), F.col("episodes").cast("string"), F.lit(f" separate occasions of {MIN_EPISODES} needed"))
    reason = F.when(F.col("n") < MIN_OCCURRENCES, rare).when(F.col("episodes") < MIN_EPISODES, near)
    return rows.select("label", "n", "episodes", reason.isNull().alias("testable"), reason.alias("reason"))


def relax_until_testable(panel: DataFrame, specs: list[Spec]) -> dict[str, tuple[Spec, float] | None]:
    """By label the specification, with the least relaxation that makes it testable and that step; None where none does.

    All steps of all specifications are counted in one pass; only their counts are looked at, never an outcome.
    """
    steps = (0.0, *RELAXATION)
    asked = {f"{k}/{x}": (s, relaxed(s, x), x) for k, s in enumerate(specs) for x in steps}
    good = {r.label for r in testability(panel, [replace(v, label=key) for key, (_, v, _) in asked.items()]).where("testable").select("label").collect()}
    return {s.label: next(((asked[f"{k}/{x}"][1], x) for x in steps if f"{k}/{x}" in good), None) for k, s in enumerate(specs)}


def distinct_proposals(panel: DataFrame, specs: list[Spec]) -> tuple[list[Spec], dict[str, str]]:
    """The first of those that fire on the same days, and for each that is dropped the label it repeats; one job for all pairs."""
    same = {(r.a, r.b) for r in jaccard(occurrences(panel, specs)).where(F.col("jaccard") > MAX_OVERLAP).collect()}
    kept: list[Spec] = []
    dropped: dict[str, str] = {}
    for s in specs:
        clash = next((k.label for k in kept if (k.label, s.label) in same or (s.label, k.label) in same), None)
        if clash is None:
            kept.append(s)
        else:
            dropped[s.label] = clash
    return kept, dropped


def enumerate_specs(events: list[Clause], states: list[Clause], withins: list[int]) -> list[Spec]:
    """Every event clause with every state clause, reach and direction."""
    return [Spec(f"{e.indicator}{e.op}{e.threshold:g}|{s.indicator}{s.op}{s.threshold:g}|{w}|{d}", (Clause(e.indicator, e.op, e.threshold, w), s), d) for e, s, w, d in product(events, states, withins, ("long", "short"))]
