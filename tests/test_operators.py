"""Golden literals, causality, and the rules that SQL on the tables does not reach."""

from __future__ import annotations

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import events as E
from tessera.operators import indicators as I  # noqa: E741
from tessera.operators import live, walkforward
from tessera.plans import grammar as G
from tessera.sources import state


def panel(spark, closes, symbol="A", **other):
    n = len(closes)
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(n)]
    frame = pd.DataFrame({"symbol": symbol, "d": days, "open": closes, "high": [c * 1.01 for c in closes], "low": [c * 0.99 for c in closes], "close": closes, "volume": 1000.0}).assign(**other)
    return spark.createDataFrame(frame, "symbol string, d date, open double, high double, low double, close double, volume double")


def walk(n, seed=42):
    return (100 * np.cumprod(1 + np.random.default_rng(seed).normal(0, 0.02, n))).tolist()


def test_indicators_do_not_look_ahead(spark):
    closes = walk(320)
    full, cut = (I.with_indicators(panel(spark, c)).select("d", *I.from_bars()).toPandas().set_index("d").sort_index() for c in (closes, closes[:260]))
    for name in I.from_bars():
        pd.testing.assert_series_equal(full[name].iloc[:260], cut[name], check_exact=False, rtol=1e-9)


def test_entry_is_the_next_bar_and_its_own_range_does_not_count(spark):
    df = I.with_indicators(panel(spark, [100.0] * 20, high=[500.0 if k == 6 else 101.0 for k in range(20)], low=99.0))
    one = E.build_events(df, F.col("loc") == 5, horizons=(1, 3)).collect()
    assert len(one) == 1 and one[0].entry_loc == 6 and one[0].mfe_1 < 0.5
    assert E.build_events(df, F.col("loc") == 19, horizons=(1, 3)).count() == 0
    short = E.build_events(df, F.col("loc") == 5, "short", (1, 3)).first()
    assert math.isclose(short.mfe_1, 0.01) and math.isclose(short.mae_1, -0.01)


def test_lagged_clause(spark):
    df = I.with_indicators(panel(spark, [100.0] * 5 + [80.0] + [100.0] * 6))
    for within, want in ((0, "000001000000"), (3, "000001111000")):
        fired = df.select("d", G.Clause("close_return_1d", "<", -0.1, within).column().alias("f")).orderBy("d").collect()
        assert "".join(str(int(r.f)) for r in fired) == want


def test_sortino(spark):
    rows = [("gain", x) for x in (0.01, 0.02, 0.03)] + [("flat", 0.0), ("flat", 0.0), ("mixed", 0.02), ("mixed", -0.01)]
    got = {r.k: r.s for r in spark.createDataFrame(rows, "k string, r double").groupBy("k").agg(E.sortino(F.col("r")).alias("s")).collect()}
    assert got["gain"] == math.inf and got["flat"] is None
    assert math.isclose(got["mixed"], 0.005 / math.sqrt(0.0001 / 2) * math.sqrt(252))


def test_benjamini_hochberg_published_example(spark):
    p = [0.0001, 0.0004, 0.0019, 0.0095, 0.0201, 0.0278, 0.0298, 0.0344, 0.0459, 0.3240, 0.4262, 0.5719, 0.6528, 0.7590, 1.0]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(p)] + [(90, None), (91, float("nan"))], "k int, p double")
    assert {r.k for r in walkforward.benjamini_hochberg(df).collect() if r.survives} == {0, 1, 2, 3}


def test_weighted_family_is_scale_free_and_ignores_bad_weights(spark):
    p = [0.001, 0.02, 0.03, 0.04, 0.20, 0.30, 0.40, 0.50]
    frame = lambda w: spark.createDataFrame(list(zip(range(8), p, w, strict=True)), "k int, p double, w double")
    kept = lambda w: {r.k for r in walkforward.benjamini_hochberg(frame(w), weight="w").collect() if r.survives}
    plain = {r.k for r in walkforward.benjamini_hochberg(frame([1.0] * 8)).collect() if r.survives}
    assert kept([1.0] * 8) == kept([7.0] * 8) == kept([None, 0.0, -1.0, float("nan"), None, None, None, None]) == plain
    assert 1 in kept([0.5, 4.0] + [0.5] * 6)


def test_concentration_and_power(spark):
    rows = [("x", "A", 0.01)] * 9 + [("x", "B", -0.01)] + [("y", s, 0.01) for s in "ABCD"] + [("z", "A", -0.1)]
    got = {r.k: r for r in walkforward.concentration(spark.createDataFrame(rows, "k string, g string, v double"), ["k"], "g", "v").collect()}
    assert got["x"].concentrated and got["x"].dominant == "A" and not got["y"].concentrated and got["z"].concentrated is None
    n = spark.range(1).select(walkforward.required_n(F.lit(0.30)).alias("a"), walkforward.required_n(F.lit(0.06)).alias("b"), walkforward.required_n(F.lit(0.0)).alias("c")).first()
    assert math.isclose(n.a / n.b, 25) and n.c is None


def test_bootstrap_tells_a_planted_edge_from_noise(spark):
    rng = np.random.default_rng(1)
    pool = rng.normal(0, 0.03, 900)
    observed = spark.createDataFrame([("edge", float(x) + 0.02, 9) for x in pool[:200]] + [("noise", float(x), 9) for x in pool[200:400]], "candidate string, value double, block int")
    base = spark.createDataFrame([(c, 0, pool.tolist()) for c in ("edge", "noise")], "candidate string, chunk int, base array<double>")
    got = {r.candidate: r for r in walkforward.bootstrap_p(observed, base, 500).collect()}
    assert got["edge"].significant and not got["noise"].significant
    whole, parts = walkforward.block_bootstrap_means([pool], 50, 9, np.arange(20)), [walkforward.block_bootstrap_means([pool], 50, 9, np.arange(k, 20, 3)) for k in range(3)]
    assert all((whole[k::3] == parts[k]).all() for k in range(3))  # however the replicates are split


def test_blocks_are_contiguous_and_chunks_drawn_by_length():
    """With one block to a replicate its mean tells where it lies; short chunks give whole chunks."""
    chunks = [np.arange(100.0), np.arange(1000.0, 1004.0)]
    means = walkforward.block_bootstrap_means(chunks, 10, 10, np.arange(4000))
    long = means[means < 100]
    assert set((long * 2 % 2).tolist()) == {1.0} and long.min() == 4.5 and long.max() == 94.5  # ten in a row from 0..99
    share = sum(len(c) for c in chunks[1:]) / 104
    assert abs((means > 90.0001).mean() - (long > 90.0001).sum() / 4000 - share) < 0.02
    assert math.isclose(walkforward.block_bootstrap_means(chunks, 100_000, 3, np.arange(3)).mean(), np.concatenate(chunks).mean(), rel_tol=0.1)
    plain = [np.mean([x for x in chunks[0]][s : s + 10]) for s in range(91)]
    assert set(np.round(long, 9)) <= set(np.round(plain, 9))


def test_specifications_round_trip_and_are_checked():
    spec = G.Spec("x", (G.Clause("volume_zscore_30d", ">=", 1.0, 3), G.Clause("cpi_surprise", "<", 0.0)), coins=("A",), outcome="market_relative", prior_weight=9.0)
    assert G.Spec.from_json(spec.to_json()) == spec and spec.prior_weight == 4.0
    assert [c.indicator for c in spec.without_events().clauses] == ["volume_zscore_30d"] and G.Spec("y", (G.Clause("cpi_surprise", "<", 0.0),)).without_events() is None
    assert [G.Clause.from_dict({"indicator": "a", "op": "<", "threshold": "1.5", "within_days": w}).within_days for w in (None, 2.0, "3")] == [0, 2, 3]
    for bad in (lambda: G.Clause("a", "<", 1.0, 500), lambda: G.Spec("x", ()), lambda: G.Spec("x", spec.clauses, coins=()), lambda: G.Spec("x", spec.clauses, prior_weight=0)):
        with pytest.raises(ValueError):
            bad()
    proposal = lambda *names, label="p": G.from_proposal({"label": label, "clauses": [{"indicator": n, "op": "<", "threshold": 1} for n in names]})
    for refused, why in ((("nothing",), "unknown"), (("is_macro_day",), "cannot be proposed"), (("rsi_14d",), "published event"), (("rsi_14d", "cpi_surprise", "rate_surprise"), "3 clauses"), ((), "needs a clause")):
        assert why in proposal(*refused)
    for names in (("cpi_surprise",), ("rsi_14d", "rate_surprise"), ("atr_pct_14d", "jobless_claims_surprise"), ("funding_zscore_30d", "cpi_surprise")):
        assert isinstance(proposal(*names), G.Spec)
    assert "macro event" in G.from_proposal({"label": "after the CPI", "clauses": [{"indicator": "rsi_14d", "op": "<", "threshold": 1}]}, news=False)
    assert "relative strength in 14 days below 30" in G.Spec("r", (G.Clause("rsi_14d", "<", 30.0, 3),)).in_words() and "last 3 days" in G.Spec("r", (G.Clause("rsi_14d", "<", 30.0, 3),)).in_words()
    assert len(G.proposals({"action": "propose", "specs": [1, 2, 3]})) == 2 and G.proposals({"action": "wait", "spec": 1}) == []
    assert G.normalise_coin(" btc", frozenset({"BTCUSDT"})) == "BTCUSDT" and G.normalise_coin("x", frozenset()) is None
    assert G.loosened(G.Clause("volume_zscore_30d", ">=", 2.0), 0.25).threshold == 1.5


def test_state_tables_and_documents(spark, tmp_path):
    state.write_json(tmp_path / "a" / "x.json", {"k": [1, None]})
    assert state.read_json(tmp_path / "a" / "x.json", None) == {"k": [1, None]} and state.read_json(tmp_path / "none", 7) == 7
    with pytest.raises(ValueError):
        state.write_json(tmp_path / "a" / "x.json", {"k": float("nan")})
    assert state.read_json(tmp_path / "a" / "x.json", None) == {"k": [1, None]} and len(list((tmp_path / "a").iterdir())) == 1
    base, new = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(map(tuple, state.upsert(base, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, state.insert_missing(base, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_streams(spark, tmp_path):
    from tessera.streaming import jobs

    folder = f"{tmp_path}/in"
    rows = [(k, dt.datetime(2024, 1, 1, k % 48 // 2, (k % 2) * 30) + dt.timedelta(days=k // 48), "a", float(k)) for k in range(96)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(folder)
    stream = lambda: spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(folder)

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    bars = run(jobs.hourly_bars(stream()), "bars_stream").orderBy("ts").collect()
    assert len(bars) > 40 and (bars[0].open, bars[0].close, bars[0].volume) == (0.0, 1.0, 2)
    assert run(jobs.ledger(stream().select(F.lit("a").alias("symbol"), F.date_trunc("day", "ts").alias("exit_ts"))), "ledger_stream").count() == 2


def test_live_rules(spark):
    days = spark.createDataFrame([("A", dt.date(2024, 1, 1) + dt.timedelta(k)) for k in (0, 3, 6, 7, 8, 15)], "symbol string, d date")
    assert [r.opened.day for r in live.one_open_per_key(days, "symbol", 7).orderBy("opened").collect()] == [1, 8, 16]
    assert E.greedy_episodes(days, 7).first().n_episodes == 3
    m = spark.createDataFrame([(19, 0), (20, 0), (45, 20), (45, 40)], "c long, last long").select(live.milestone(F.col("c"), F.col("last")).alias("m")).collect()
    assert [r.m for r in m] == [None, 20, 40, None]


def test_every_candidate_is_explained(spark):
    import __spark_entry__ as entry

    sf, queries = "/root/testdata/sf0.01", entry.queries()
    reasons = {r.candidate: r.reason for r in queries["wf_explain"](spark, sf).collect()}
    status = {r.candidate: r.status for r in queries["wf_classify"](spark, sf).collect()}
    assert reasons.keys() == status.keys()
    assert all((reasons[k] is None) == (status[k] == "accepted") for k in status)
    assert {"only n of more than 20 events" if r.startswith("only ") else r for r in reasons.values() if r} == {
        "only n of more than 20 events", "no trade result", "pattern test did not run", "no positive group", "one symbol carries it", "one year carries it",
        "no excess return", "not better than its baseline", "adverse moves outweigh favourable ones",
    }


def test_a_wrong_direction_is_told_before_significance(spark):
    row = spark.range(1).select(walkforward.explain(F.lit(30), F.lit(1.0), F.lit(True), F.lit(False), F.lit(False), F.lit(False), F.lit(-0.1), F.lit(2.0)).alias("r")).first()
    assert row.r == "no excess return"


def test_snapshot_has_every_indicator(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["ind_snapshot_unpivot"](spark, "/root/testdata/sf0.001").collect()
    assert {r.indicator for r in rows} == set(I.INDICATORS)
    assert len(rows) == len(I.INDICATORS) * len({r.symbol for r in rows})


def test_not_a_number_holds_no_clause_and_passes_no_gate(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, k + 1), x) for k, x in enumerate((1.0, float("nan"), None, -1.0))], "symbol string, d date, x double")
    hit = df.orderBy("d").select(G.Clause("x", ">", 0.0).column().alias("a"), G.Clause("x", "<", 0.0).column().alias("b")).collect()
    assert [(r.a, r.b) for r in hit] == [(True, False), (False, False), (False, False), (False, True)]
    gates = lambda **k: [F.lit(k.get(n, v)) for n, v in dict(n=30, sortino=1.0, ok=True, by_symbol=False, by_year=False, significant=True, excess=0.1, ratio=2.0).items()]
    told = lambda **k: spark.range(1).select(walkforward.classify(*gates(**k)).alias("s")).first().s
    nan = float("nan")
    assert [told(), told(ratio=nan), told(sortino=nan), told(excess=nan), told(sortino=math.inf)] == ["accepted", "watch", "rejected", "rejected", "accepted"]


def test_trades_in_both_directions(spark):
    """Entry 100, target 5 %, stop 3 %: mirrored for a short; the stop counts first; later horizons have levels of their own."""
    bars = lambda *x: [{"high": h, "low": l} for h, l in x]  # noqa: E731, E741
    quiet = [(101.0, 99.0)] * 4
    cases = [(bars(*quiet, (106.0, 99.0), *quiet), "win", "loss"), (bars(*quiet, (101.0, 96.0), *quiet), "loss", "timeout"), (bars((106.0, 96.0)), "loss", "loss"), (bars((101.0, 94.0)), "loss", "win"), (bars((104.0, 99.0)), "timeout", "loss"), (bars(*quiet), "timeout", "timeout")]
    df = spark.createDataFrame([(k, p) for k, (p, _, _) in enumerate(cases)], "k int, path array<struct<high:double,low:double>>")
    levels = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(0.05).alias("mfe"), F.lit(0.03).alias("mae")) for h in (1, 7)])
    for sign, place in ((1, 1), (-1, 2)):
        got = {r.k: r.r for r in df.select("k", E.trade(F.col("path"), F.lit(100.0), F.lit(sign), levels, F.lit(1.0), F.lit(1.0)).alias("r")).collect()}
        assert [got[k].outcome for k in range(len(cases))] == [c[place] for c in cases], sign
        assert math.isclose(got[2].net, -0.03 - 0.002) and math.isclose(got[5].net, -0.002)
    one = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(m).alias("mfe"), F.lit(0.5).alias("mae")) for h, m in ((1, 0.05), (3, 0.5))])
    later = spark.range(1).select(E.trade(F.array(*[F.struct(F.lit(h).alias("high"), F.lit(99.0).alias("low")) for h in (101.0, 110.0, 101.0, 101.0)]), F.lit(100.0), F.lit(1), one, F.lit(1.0), F.lit(1.0)).alias("r")).first().r
    assert later.outcome == "timeout"  # 110 passes the first horizon's target on a bar of the second


def test_a_first_setting_without_a_ratio_sticks(spark):
    rows = [("a", 0.6, 0.6, 0.0), ("a", 0.6, 0.8, 0.01), ("a", 0.6, 0.8, -0.005), ("b", 0.6, 0.6, -0.01), ("b", 1.0, 0.6, 0.02), ("b", 1.0, 0.6, -0.01), ("b", 1.0, 0.8, 0.02), ("b", 1.0, 0.8, -0.01)]
    place = {x: n for n, x in enumerate((0.6, 0.8, 1.0))}
    sums = [(f, tp, sl, len(v), sum(v), sum(min(x, 0.0) ** 2 for x in v), 5 * place[tp] + place[sl]) for (f, tp, sl), v in {k: [x for *q, x in rows if tuple(q) == k] for k in {tuple(r[:3]) for r in rows}}.items()]
    results = spark.createDataFrame(sums, "f string, tp double, sl double, n long, total double, worst double, place int").withColumns({"wins": F.lit(0), "losses": F.lit(0)})
    got = {r.f: (r.tp, r.sl) for r in E.best_setting(results, ["f"]).collect()}
    assert got == {"a": (0.6, 0.6), "b": (1.0, 0.6)}


def test_study_uses_outcome_weight_direction_and_scope(spark):
    """Against plain Python over the same events: out-of-sample values, baselines of both kinds, relative outcomes, errors apart."""
    from tessera.plans import study
    from tessera.sources import panels

    sf = "/root/testdata/sf0.01"
    bars = panels.bars_1d(spark, sf)
    volume = G.Clause("volume_zscore_30d", ">=", 1.0)
    specs = [G.Spec("raw", (volume,)), G.Spec("rel", (volume,), outcome="market_relative"), G.Spec("short", (volume,), "short"), G.Spec("one", (volume,), coins=("A",), prior_weight=4.0), G.Spec("bad", (G.Clause("nothing", ">", 0.0),)), G.Spec("never", (G.Clause("close_return_1d", ">", 1e9),))]
    rows = {r.candidate: r.asDict() for r in study.run(bars, specs, reps=200).collect()}
    assert rows["bad"]["status"] == "error" and "nothing" in rows["bad"]["reason"]
    assert rows["never"]["status"] == "insufficient_data" and rows["never"]["n"] == 0
    assert rows["raw"]["n"] == rows["raw"]["n_outcomes"] == rows["rel"]["n"] > 50
    assert not math.isclose(rows["raw"]["mean"], rows["rel"]["mean"], rel_tol=1e-3)
    assert math.isclose(rows["rel"]["baseline_mean"], 0.0, abs_tol=0.5 * abs(rows["raw"]["baseline_mean"]))
    assert rows["short"]["mean"] < 0 < rows["raw"]["mean"] and rows["one"]["by_symbol"] is False and rows["one"]["weight"] == 4.0
    panel = I.complete(bars)
    e = study.evidence(panel, specs[:1])
    chosen = {r.fold: r.h for r in e.chosen.collect()}
    close = {}
    for r in bars.orderBy("symbol", "d").collect():
        close.setdefault(r.symbol, []).append(r.close)
    for r in e.outcomes.collect():
        h = chosen[r.period]
        assert math.isclose(r.value, close[r.symbol][r.entry_loc + h] / close[r.symbol][r.entry_loc] - 1, rel_tol=1e-9)
    text = walkforward.significance_text({**rows["raw"]})
    assert "p = " in text and "ordinary returns" in text and walkforward.significance_text({"p": None}).startswith("The pattern could not")
    from tessera.operators import registry as R

    assert "fires when volume" in R.details(rows["raw"], "volume is high") and "n/a" in R.details(rows["never"])


def test_redundant_proposals_are_told(spark):
    from tessera.plans import admission
    from tessera.sources import panels

    panel = I.with_indicators(panels.bars_1d(spark, "/root/testdata/sf0.01"))
    of = lambda label, t, op=">=": {"label": label, "direction": "long", "clauses": [{"indicator": "volume_zscore_30d", "op": op, "threshold": t}]}
    specs = [G.Spec.from_json(__import__("json").dumps(of(*x))) for x in (("a", 1.0), ("b", 1.05), ("c", 2.2), ("d", -1.0, "<"), ("e", -1.0, "<="))]
    kept, dropped = G.distinct_proposals(panel, specs)
    days = {}
    for r in G.occurrences(panel, specs).collect():
        days.setdefault(r.label, set()).add((r.symbol, r.d))
    want, repeats = [], {}
    for s in specs:
        mine = days.get(s.label, set())
        clash = next((k for k in want if mine | days.get(k, set()) and len(mine & days.get(k, set())) / len(mine | days.get(k, set())) > 0.6), None)
        repeats |= {s.label: clash} if clash else {}
        want += [] if clash else [s.label]
    assert [s.label for s in kept] == want and dropped == repeats and repeats
    got = admission.admit(panel, [of("a", 1.0), of("b", 1.05), of("rare", 3.4), of("never", 90.0), {"label": "none", "clauses": []}], news=False)
    assert [s.label for s in got.testable][0] == "a" and got.repeats == {"b": "a"} and [s.label for s in got.parked] == ["never"] and "none" in got.refused
    parked = admission.park(spark.createDataFrame([], "label string, spec string, proposed_at date"), got.parked, dt.date(2020, 1, 1))
    assert admission.park(parked, got.parked, dt.date(2021, 1, 1)).count() == 1
    registry = spark.createDataFrame([("x", specs[0].to_json())], "candidate string, spec string")
    assert {r.candidate for r in admission.valid_registry(registry, spark.createDataFrame([("y", "{}"), ("z", specs[1].to_json())], "candidate string, spec string")).collect()} == {"x", "z"}
    base = json.loads(specs[0].to_json())
    clause = base["clauses"][0]
    tries = [base, {**base, "clauses": []}, {**base, "direction": "up"}, {**base, "outcome": "none"}, {**base, "prior_weight": 0}, {**base, "coins": ["A"]}] + [{**base, "clauses": [clause, {**clause, **x}]} for x in ({"op": "=="}, {"within_days": 15}, {"within_days": -1}, {"within_days": 14}, {"threshold": None}, {"indicator": None})]
    told = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(tries)] + [(99, None), (98, "no json")], "k int, spec string").select("k", admission.is_valid(F.col("spec")).alias("ok")).collect()
    assert {r.k for r in told if r.ok} == {0, 5, 9}
    assert admission.registered(panel.where("symbol = 'A'"), specs[0], dt.date(1996, 1, 1), 7)["prior_confirmations"] > 0


def test_exact_rank_test_and_tail(spark):
    import itertools

    from tessera.operators import stats

    for n1, n2 in ((3, 4), (5, 2)):
        us = [sum(sum(1 for y in range(n1 + n2) if y not in of and y < x) for x in of) for of in itertools.combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            assert math.isclose(stats.exact_mann_whitney(u, n1, n2), sum(x >= u for x in us) / len(us))
    z = spark.createDataFrame([(x,) for x in (-3.0, -0.5, 0.0, 1.0, 2.5)], "z double").select("z", stats.normal_tail(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - 0.5 * math.erfc(r.z / math.sqrt(2))) < 2e-7 for r in z)


def test_files_locks_and_cadence(spark, tmp_path):
    import os

    from tessera.sources import files
    from tessera.streaming import cadence

    (tmp_path / "f.csv").write_text("timestamp,rate\n2020-01-01 00:00:00,1\n2020-01-01 08:00:00,3\n2020-01-02 00:00:00,5\n")
    assert [(r.symbol, r.d.day, r.rate) for r in files.daily_means(spark, str(tmp_path / "f.csv"), "A").orderBy("d").collect()] == [("A", 1, 2.0), ("A", 2, 5.0)]
    assert files.daily_means(spark, str(tmp_path / "none.csv"), "A") is None
    (tmp_path / "v.csv").write_text("date,realtime_start,CPI\n2020-01-01,2020-02-14,7.5\n2020-01-01,2020-03-14,.\n")
    assert [tuple(r)[0::3] for r in files.vintages(spark, {"cpi": str(tmp_path / "v.csv"), "x": str(tmp_path / "none.csv")}).orderBy("realtime_start").collect()] == [("cpi", 7.5), ("cpi", None)]
    assert files.release_dates(spark, str(tmp_path / "v.csv"), "2020-02-20") == (dt.date(2020, 3, 14),) and files.release_dates(spark, "/none.csv") == ()
    files.write_csv(spark.createDataFrame([("a", float("nan")), ("b", 1.5)], "k string, x double"), str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "out"), header=True).collect())) == [("a", None), ("b", "1.5")]
    report = {(r.symbol, r.kind): (r.rows, r.error) for r in files.fan_out(spark, {("A", "1d"): lambda: 3, ("A", "1h"): lambda: 0, ("B", "1d"): lambda: 1 // 0}).collect()}
    assert report[("A", "1h")] == (0, None) and report[("B", "1d")][0] is None and "ZeroDivision" in report[("B", "1d")][1]
    import json
    import socket
    import time

    held = lambda host, pid, seconds: (tmp_path / "lock").write_text(json.dumps({"host": host, "pid": pid, "until": time.time() + seconds}))
    with state.lock(tmp_path / "lock"):
        assert json.loads((tmp_path / "lock").read_text())["pid"] == os.getpid()
    assert not (tmp_path / "lock").exists()
    for host, pid in ((socket.gethostname(), 1), ("elsewhere", 999999999)):  # a live process here; one elsewhere, of which only the lease is known
        held(host, pid, 60)
        with pytest.raises(state.Locked), state.lock(tmp_path / "lock"):
            pass
    for host, pid, seconds in ((socket.gethostname(), 999999999, 60), ("elsewhere", 7, -1)):  # one that is gone; a lease that has ended
        held(host, pid, seconds)
        with state.lock(tmp_path / "lock"):
            pass
    (tmp_path / "lock").write_text("torn")
    with state.lock(tmp_path / "lock"):
        pass
    seen: list[str] = []
    jobs = {"h": ("hourly", lambda: seen.append("h")), "w": ("weekly", lambda: 1 // 0), "m": ("monthly", lambda: seen.append("m"))}
    at = lambda day, hour: dt.datetime(2020, 1, day, hour)
    first = cadence.run_due(tmp_path / "c.json", jobs, at(31, 0))
    assert first["h"] is None and "ZeroDivision" in first["w"]
    again = cadence.run_due(tmp_path / "c.json", jobs, at(31, 0) + dt.timedelta(minutes=30))
    assert list(again) == ["w"] and set(cadence.run_due(tmp_path / "c.json", jobs, at(31, 0) + dt.timedelta(hours=25))) == {"h", "w", "m"} and seen == ["h", "m", "h", "m"]
    steps = {"a": lambda: seen.append("a"), "b": lambda: seen.append("b") if "fixed" in seen else 1 // 0, "c": lambda: seen.append("c")}
    with pytest.raises(ZeroDivisionError):
        cadence.run_steps(tmp_path / "s.json", steps)
    seen.append("fixed")
    cadence.run_steps(tmp_path / "s.json", steps)
    assert seen[-4:] == ["a", "fixed", "b", "c"]
