"""From what a model or a person proposes to what is tested: checked, counted, relaxed, parked or told apart."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.events import prospective_split
from tessera.plans import grammar as G
from tessera.plans.grammar import Spec, named
from tessera.sources import state

CLAUSES = "array<struct<indicator:string,op:string,threshold:double,within_days:int>>"
SPEC = f"struct<label:string,direction:string,clauses:{CLAUSES}>"


def proposed(response: Column, most: int = G.MAX_PROPOSALS) -> Column:
    """The proposals in a JSON answer, at most so many: of its plural or its singular field, none unless it proposes."""
    doc = F.from_json(response, f"action string, specs array<{SPEC}>, spec {SPEC}")
    several = F.when(F.size(F.coalesce(doc["specs"], F.array())) > 0, doc["specs"]).when(doc["spec"].isNotNull(), F.array(doc["spec"]))
    return F.when(doc["action"] == "propose", F.slice(several, 1, most))


def normal_coin(name: Column, universe: list[str], quote: str = "USDT") -> Column:
    """The universe's symbol for a coin however it is written, or null."""
    upper = F.upper(F.trim(name))
    full = F.when(F.endswith(upper, F.lit(quote)), upper).otherwise(F.concat(upper, F.lit(quote)))
    return F.when(full.isin(*universe), full)


@dataclass
class Admitted:
    """testable: may be tested now; parked: too rare yet; refused: why; changed: by how much thresholds were relaxed; repeats: of which."""

    testable: list[Spec] = field(default_factory=list)
    parked: list[Spec] = field(default_factory=list)
    refused: dict[str, str] = field(default_factory=dict)
    changed: dict[str, float] = field(default_factory=dict)
    repeats: dict[str, str] = field(default_factory=dict)


def admit(panel: DataFrame, found: list[dict[str, Any]], news: bool = True) -> Admitted:
    """Check each proposal, drop those that fire on an earlier one's days, relax what is too rare, park what stays so."""
    out, specs = Admitted(), []
    for k, d in enumerate(found):
        spec = G.from_proposal(d, news)
        if isinstance(spec, str):
            out.refused[str(d.get("label", k))] = spec
        else:
            specs.append(spec)
    if not specs:
        return out
    specs, out.repeats = G.distinct_proposals(panel, specs)
    for label, made in G.relax_until_testable(panel, specs).items():
        if made is None:
            out.parked.append(next(s for s in specs if s.label == label))
        else:
            out.testable.append(made[0])
            out.changed |= {label: made[1]} if made[1] else {}
    return out


def park(parked: DataFrame, specs: list[Spec], on: date) -> DataFrame:
    """parked (label, spec, proposed_at) with the specifications that it lacks."""
    new = parked.sparkSession.createDataFrame([(s.label, s.to_json(), on) for s in specs], "label string, spec string, proposed_at date")
    return state.insert_missing(parked, new, ["label"])


DOCUMENT = "label string, direction string, outcome string, prior_weight double, clauses array<struct<indicator:string,op:string,threshold:double,within_days:double>>"


def refusal(text: Column, news: bool = False) -> Column:
    """Why a document is not a specification, by the rules that `Spec` and `Clause` hold (numbers are numbers, not texts), or null.

    news: a clause on a published event is a necessary condition too.
    """
    d = F.from_json(text, DOCUMENT)
    within = lambda c: F.floor(F.coalesce(c["within_days"], F.lit(0.0)))
    every = lambda good: F.forall(d["clauses"], lambda c: F.coalesce(good(c), F.lit(False)))
    rules = [
        (d["label"].isNotNull(), "no label"),
        (F.size(d["clauses"]) > 0, "no clause"),
        (every(lambda c: c["indicator"].isNotNull() & c["threshold"].isNotNull()), "a clause without an indicator or threshold"),
        (every(lambda c: c["op"].isin(*G.OPERATORS)), "unknown operator"),
        (every(lambda c: (F.coalesce(c["within_days"], F.lit(0.0)) >= 0) & (within(c) <= G.MAX_WITHIN)), f"within_days is not in 0..{G.MAX_WITHIN}"),
        (F.coalesce(d["direction"], F.lit("long")).isin("long", "short"), "unknown direction"),
        (F.coalesce(d["outcome"], F.lit("raw")).isin("raw", "market_relative"), "unknown outcome"),
        (F.coalesce(d["prior_weight"], F.lit(1.0)) > 0, "a weight must be positive"),
    ]
    if news:
        rules.append((F.exists(d["clauses"], lambda c: c["indicator"].isin(*sorted(named("news")))), "no clause on a published event"))
    first = F.when(F.coalesce(~rules[0][0], F.lit(True)), rules[0][1])
    for holds, why in rules[1:]:
        first = first.when(F.coalesce(~holds, F.lit(True)), why)
    return first


def is_valid(text: Column) -> Column:
    return refusal(text).isNull()


def off_thesis(registry: DataFrame, news: bool = True) -> DataFrame:
    """candidate, reason: the entries (candidate, spec) that are no longer tested, so that none vanishes without a word."""
    return registry.select("candidate", refusal(F.col("spec"), news).alias("reason")).where("reason IS NOT NULL")


def context_names(registry: DataFrame) -> DataFrame:
    """One row: the accepted candidates, and those that were tested and are not, which are not to be proposed again without new evidence."""
    names = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("candidate"))))
    accepted = F.col("status").eqNullSafe("accepted")
    return registry.agg(names(accepted).alias("accepted"), names(~accepted).alias("not_accepted"))


def valid_registry(registry: DataFrame, new: DataFrame) -> DataFrame:
    """registry (candidate, spec) with new entries in place of old ones; specifications that are no longer valid are skipped."""
    return state.upsert(registry, new, ["candidate"]).where(is_valid(F.col("spec")))


def registered(panel: DataFrame, spec: Spec, proposed_at: date, horizon: int) -> dict[str, Any]:
    """What is written down when a proposal is accepted for testing: the specification, its horizon, and how often it fired since it was proposed."""
    split = prospective_split(panel, spec.column(), F.lit(proposed_at), horizon).first()
    return {"spec": replace(spec).to_json(), "horizon": horizon, "prior_confirmations": split["n_after"], "proposed_at": proposed_at.isoformat()}
