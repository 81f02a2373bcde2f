"""Maximin races under many labellings, caps, targets, presets and forecasts from what was known, against plain Python."""

import datetime as dt
import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import inference, maximin, search, walkforward

NAMES = ["A | Reference", "A | Value", "B | Reference"]


def months(n):
    return [dt.date(2000 + i // 12, i % 12 + 1, 28) for i in range(n)]


def market(spark, n=40, seed=1):
    rng = random.Random(seed)
    rets = {s: [rng.gauss(0.01, 0.05) for _ in range(n)] for s in NAMES}
    rows = [(s, m, r) for s in NAMES for m, r in zip(months(n), rets[s], strict=True)]
    return rets, walkforward.positions(spark.createDataFrame(rows, "series string, month date, ret double"))


def labels_of(n, arms, seed=2):
    rng = random.Random(seed)
    return {a: [rng.choice("XYZ") for _ in range(n)] for a in arms}


def plain_race(rets, labels, candidates, allowed, warmup, refit, window, least=3, bps=10.0):
    n, out = len(next(iter(rets.values()))), {}
    for rule, names in allowed.items():
        held, months_ = None, []
        for hi in range(warmup, n, refit):
            lo = max(0, hi - window) if window else 0
            where = defaultdict(list)
            for i in range(lo, hi):
                where[labels[i]].append(i)
            where = {k: v for k, v in where.items() if len(v) >= least}
            if len(where) < 2:
                continue
            floor = {p: min(np.mean([sum(w * rets[s][i] for s, w in candidates[p].items()) for i in v]) for v in where.values()) for p in names}
            best = min(floor, key=lambda p: (-round(floor[p], 12), p))
            w = candidates[best]
            turn = 0.0 if held is None else sum(abs(w.get(s, 0) - held.get(s, 0)) for s in NAMES) / 2
            for i in range(hi, min(hi + refit, n)):
                months_.append((i, sum(x * rets[s][i] for s, x in w.items()) - (bps / 1e4 * turn if i == hi else 0)))
            held = w
        out[rule] = months_
    return out


@pytest.mark.parametrize("window", [None, 15])
def test_maximin_race_equals_a_plain_one(spark, window):
    rets, placed = market(spark)
    labels = labels_of(40, [0, 1, 2])
    parts = 4
    candidates = {"-".join(map(str, c)): {s: k / parts for s, k in zip(NAMES, c, strict=True) if k} for c in itertools.product(range(parts + 1), repeat=3) if sum(c) == parts}
    allowed = {"all": list(candidates), "capped": [p for p, w in candidates.items() if max(w.values()) <= 0.5]}
    table = search.compositions(spark, NAMES, parts)
    arms = spark.createDataFrame([(a, m, s) for a, own in labels.items() for m, s in zip(months(40), own, strict=True)], "rep int, month date, state string")
    rules = spark.createDataFrame([(r, p) for r, names in allowed.items() for p in names], "rule string, portfolio string")
    schedule = walkforward.refit_schedule(placed, 12, 6, window)
    race = maximin.regime_race(placed, schedule, arms, table, rules, walkforward.equal_weights(placed, schedule), (), ("rep",)).collect()
    got = defaultdict(list)
    for r in sorted(race, key=lambda r: r.month):
        got[r.rep, r.rule].append(r.net)
    for a, own in labels.items():
        for rule, want in plain_race(rets, own, candidates, allowed, 12, 6, window).items():
            assert np.allclose(got[a, rule], [v for _, v in want], atol=1e-12)
        assert np.allclose(got[a, "1/N"], got[0, "1/N"], atol=0)  # the control uses no labels


def test_placebo_labels_keep_what_they_should(spark):
    n, own = 30, labels_of(30, [0])[0]
    states = spark.createDataFrame(list(zip(months(n), own, strict=True)), "month date, state string")
    rows = maximin.placebo_labels(states, replicates=5).collect()
    arms = defaultdict(dict)
    for r in rows:
        arms[r.arm, r["mode"], r.rep][r.month] = r.state
    assert len(arms) == 11 and list(arms["real", "none", -1][m] for m in months(n)) == own
    for (arm, mode, _), found in arms.items():
        line = [found[m] for m in months(n)]
        assert sorted(line) == sorted(own)
        if mode == "circular":
            assert line != own and any(line == own[k:] + own[:k] for k in range(n))
    assert inference.permutation_verdict(spark.createDataFrame([("real", "none", "r", "m", 1.0)] + [("placebo", "iid", "r", "m", float(v)) for v in (0, 1, 2)], "arm string, mode string, rule string, metric string, value double")).first().p == 0.75


def test_caps_of_many_presets(spark):
    table = search.compositions(spark, NAMES, 4).withColumn("menu", F.lit("m"))
    groups = spark.createDataFrame([(NAMES[0], "zone", "n", 0.5), (NAMES[0], "zone", "s", 0.5), (NAMES[1], "zone", "n", 1.0), (NAMES[2], "zone", "s", 1.0), (NAMES[1], "kind", "v", 1.0)], "series string, dim string, category string, share double")
    caps = spark.createDataFrame([("p", "series", 0.5), ("q", "zone", 0.5), ("q", "kind", 0.25), ("r", "series", 0.2)], "preset string, dim string, cap double")
    got = {(r.preset, r.portfolio): r.at_cap for r in search.inside_caps(table, caps, groups, ("menu",)).collect()}
    for c in itertools.product(range(5), repeat=3):
        if sum(c) == 4:
            a, v, b = (k / 4 for k in c)
            p = "-".join(map(str, c))
            assert (("p", p) in got) == (max(a, v, b) <= 0.5) and got.get(("p", p), max(a, v, b) == 0.5) == (max(a, v, b) == 0.5)
            assert (("q", p) in got) == (max(a / 2 + v, a / 2 + b) <= 0.5 and v <= 0.25)
    bad = search.cap_problems(table, caps, groups, ("menu",)).collect()
    assert {(r.preset, r.dim, r.n) for r in bad} == {("q", "kind", 1), ("r", "series", 3)}
    with pytest.raises(ValueError, match="cannot hold"):
        search.within_caps(table, {"series": 0.2})


def test_paths_of_candidates(spark):
    rets, placed = market(spark)
    table = search.compositions(spark, NAMES, 3)
    got = {r.portfolio: r for r in search.candidate_paths(table, placed).collect()}
    assert len(got) == 10
    for p, r in got.items():
        w = [int(k) / 3 for k in p.split("-")]
        level = np.cumprod(1 + sum(x * np.array(rets[s]) for x, s in zip(w, NAMES, strict=True)))
        assert np.isclose(r.cagr, level[-1] ** (12 / 40) - 1) and np.isclose(r.max_drawdown, (level / np.maximum.accumulate(level) - 1).min())
    assert search.candidate_paths(table, placed.filter(F.col("series") != NAMES[2])).count() == 4


def test_forecasts_use_only_what_was_known(spark):
    rng = random.Random(3)
    g, i = [0.0], [0.0]
    for _ in range(69):
        g.append(0.8 * g[-1] + rng.gauss(0, 1))
        i.append(0.8 * i[-1] + rng.gauss(0, 1))
    name = lambda a, b: {(1, 1): "Reflation", (0, 1): "Stagflation", (0, 0): "Deflationary bust", (1, 0): "Goldilocks"}[a > 0, b > 0]
    rows = [(m, a, b, name(a, b)) for m, a, b in zip(months(70), g, i, strict=True)]
    of = lambda r: spark.createDataFrame(r, "month date, growth_score double, inflation_score double, state string")
    near = {(r.t, r.rank): (r.u, r.distance, r.outcome) for r in search.asof_analogs(of(rows), k=5).collect()}
    cut = {(r.t, r.rank): (r.u, r.distance, r.outcome) for r in search.asof_analogs(of(rows[:50]), k=5).collect()}
    assert cut and all(near[key] == v for key, v in cut.items())  # months that come later change nothing
    f = {}
    for t in range(9, 70):
        v = [(x[t] - x[t - 6]) / 6 for x in (g, i)]
        before = [(x[t - 3] - x[t - 9]) / 6 for x in (g, i)]
        f[t + 1] = np.array([g[t], i[t], *v, v[0] - before[0], v[1] - before[1]])
    for t in (30, 45, 70):
        sd = np.std([f[u] for u in f if u <= t], axis=0, ddof=1)
        order = sorted((round(float(np.linalg.norm((f[t] - f[u]) / sd)), 9), u) for u in f if u <= t - 3)[:5]
        assert [near[t, k][0] for k in range(1, 6)] == [u for _, u in order]
    trend = {r.t: r.state for r in search.momentum_forecast(of(rows)).collect()}
    assert all(trend[t + 1] == name(g[t] + (g[t] - g[t - 6]) / 2, i[t] + (i[t] - i[t - 6]) / 2) for t in range(6, 70))
    record = {r.method: r for r in search.outlook_backtest(of(rows)).collect()}
    assert set(record) == {"persistence", "markov", "analog", "momentum"} and len({r.n for r in record.values()}) == 1
    assert record["persistence"].turns_caught == 0 and all(0 <= r.brier <= 2 for r in record.values())
