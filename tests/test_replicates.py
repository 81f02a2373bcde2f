"""Bootstraps by running sums, pairs by cells, paths by folds: against plain loops over drawn months."""

import datetime as dt
import math
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.operators import covariance, inference, paths, performance, regression, replicates


def months(n):
    return [dt.date(1990 + i // 12, i % 12 + 1, 28) for i in range(n)]


def drawn_months(seed, rep, n, b):
    out = []
    for k in range(-(-n // b)):
        at = int(md5(f"{seed}|{rep}|{k}".encode()).hexdigest()[:8], 16) % n
        out += [(at + o) % n for o in range(b)]
    return out[:n]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 45), st.integers(0, 5), st.integers(0, 9))
def test_sums_of_blocks_are_those_of_the_drawn_months(n, b, seed, first):
    x = np.random.default_rng(n).normal(size=(n, 2))
    begins = replicates.starts(seed, first, 3, n, b)
    sums = replicates.block_sums(x, begins, b)
    where = replicates.places(begins, n, b)
    counts = replicates.month_counts(seed, first + 3, n, b)
    assert (counts[0] == 1).all() and (counts.sum(axis=1) == n).all()
    for r in range(3):
        want = drawn_months(seed, first + r, n, b)
        assert where[r].tolist() == want and np.allclose(sums[r].sum(axis=0), x[want].sum(axis=0))
        assert all(counts[first + r + 1, t] == c for t, c in Counter(want).items())
        assert np.allclose(sums[r], [x[want[k * b : (k + 1) * b]].sum(axis=0) for k in range(-(-n // b))])


def returns_of(spark, n=50, seed=3, names=("a", "b", "1/N")):
    rng = np.random.default_rng(seed)
    rets = {s: rng.normal(0.01, 0.04, n) for s in names}
    return rets, spark.createDataFrame([(s, m, float(v)) for s in names for m, v in zip(months(n), rets[s], strict=True)], "series string, month date, ret double")


def frame_of(spark, n=50, seed=8):
    rng = np.random.default_rng(seed)
    f = {c: rng.normal(0, 0.03, n) for c in ("mkt_rf", "hml")}
    return f, spark.createDataFrame([(m, float(a), float(b), 0.001) for m, a, b in zip(months(n), f["mkt_rf"], f["hml"], strict=True)], "month date, mkt_rf double, hml double, rf double")


def fit(y, z, lags):
    inverse = np.linalg.inv(z.T @ z)
    coef = inverse @ z.T @ y
    g = (z @ inverse[0]) * (y - z @ coef)
    var = g @ g + sum(2 * (1 - j / (lags + 1)) * (g[j:] @ g[:-j]) for j in range(1, lags + 1))
    return coef[0], math.sqrt(var) if var > 0 else math.nan


def test_sharpe_draws_equal_a_plain_bootstrap(spark):
    rets, table = returns_of(spark)
    pairs = spark.createDataFrame([("a", "1/N"), ("b", "1/N")], "x_name string, y_name string")
    rows = inference.pair_rows(table, pairs)
    gaps = inference.sharpe_gaps(rows)
    delta = {r.x_name: r.delta for r in gaps.collect()}
    got = {(r.x_name, r.seed, r.rep): r.t for r in inference.sharpe_draws(rows, gaps, 300, (7, 8)).collect()}
    n, b = 50, replicates.length_of(50)
    for name in ("a", "b"):
        for seed, rep in ((7, 0), (8, 1), (7, 257), (8, 299)):
            at = drawn_months(seed, rep, n, b)
            x, y = rets[name][at], rets["1/N"][at]
            d = x.mean() / x.std() - y.mean() / y.std()
            w = [(x * x).mean() / x.std() ** 3, -(y * y).mean() / y.std() ** 3, -x.mean() / (2 * x.std() ** 3), y.mean() / (2 * y.std() ** 3)]
            u = sum(k * (v - v.mean()) for k, v in zip(w, (x, y, x * x, y * y), strict=True))
            whole = n // b
            var = sum(u[k * b : (k + 1) * b].sum() ** 2 for k in range(whole)) / b / whole / n
            assert np.isclose(got[name, seed, rep], (d - delta[name]) / math.sqrt(var))


def test_alpha_bootstrap_equals_a_plain_one(spark):
    rets, table = returns_of(spark)
    f, frame = frame_of(spark)
    z = np.column_stack([np.ones(50), f["mkt_rf"], f["hml"]])
    got = {r.series: r for r in regression.alpha_bootstrap(table, frame, ["mkt_rf", "hml"], replicates=300).collect()}
    b = replicates.length_of(50)
    for name in ("a", "b"):
        y = rets[name] - rets["1/N"]
        a0 = fit(y, z, 0)[0]
        draws = np.array([np.linalg.lstsq(z[at], y[at], rcond=None)[0][0] for at in (drawn_months(7, r, 50, b) for r in range(300))])
        p = (1 + (np.abs(draws - draws.mean()) >= abs(a0)).sum()) / 301
        assert np.isclose(got[name].alpha_ann, 12 * a0) and np.isclose(got[name].p_boot, p) and got[name].used == 300


def test_romano_wolf_equals_a_plain_step_down(spark):
    rets, table = returns_of(spark)
    f, frame = frame_of(spark)
    models = {"one": ["mkt_rf"], "two": ["mkt_rf", "hml"], "none": []}
    z = {m: np.column_stack([np.ones(50), *(f[c] for c in names)]) for m, names in models.items()}
    cells = [(s, m) for s in ("a", "b") for m in models]
    lags = max(1, int(4 * 0.5 ** (2 / 9)))
    seen = {(s, m): fit(rets[s] - rets["1/N"], z[m], lags) for s, m in cells}
    t0 = {c: a / e for c, (a, e) in seen.items()}
    stars = defaultdict(list)
    for rep in range(200):
        at = drawn_months(7, rep, 50, 6)
        for s, m in cells:
            a, e = fit((rets[s] - rets["1/N"])[at], z[m][at], lags)
            stars[s, m].append((a - seen[s, m][0]) / e)
    got = {(r.series, r.model): r for r in regression.romano_wolf(table, frame, models, replicates=200).collect()}
    order = sorted(cells, key=lambda c: -abs(t0[c]))
    before = 0.0
    for k, c in enumerate(order):
        most = np.nanmax(np.abs([stars[o] for o in order[k:]]), axis=0)
        before = max(before, (1 + (most >= abs(t0[c])).sum()) / 201)
        r = got[c]
        assert np.isclose(r.t, t0[c]) and np.isclose(r.p_rw, before) and r.months == 50
        assert np.isclose(r.p_single, (1 + (np.abs(stars[c]) >= abs(t0[c])).sum()) / 201)
        low, high = np.percentile(stars[c], [2.5, 97.5])
        assert np.isclose(r.ci_lo_ann, 12 * (seen[c][0] - high * seen[c][1])) and np.isclose(r.ci_hi_ann, 12 * (seen[c][0] - low * seen[c][1])) and r.ci_lo_ann <= r.alpha_ann <= r.ci_hi_ann
        assert np.isclose(r.mde80_boot_ann, 12 * (np.percentile(np.abs(stars[c]), 95) + 0.8416 * np.std(stars[c])) * seen[c][1]) and np.isclose(r.mde80_ann, 12 * 2.8 * seen[c][1])


def test_too_many_lags_and_regions_are_errors(spark):
    f, frame = frame_of(spark)
    with pytest.raises(ValueError, match="lags"):
        regression.hac_ols(frame, (), "mkt_rf", ["hml"], 13)


def shrunk_dr2(x):
    t, n = x.shape
    d = x - x.mean(axis=0)
    s = d.T @ d / t
    sd = np.sqrt(np.diag(s))
    root, off = np.outer(sd, sd), ~np.eye(n, dtype=bool)
    r = (s / root)[off].mean()
    target = np.where(off, r * root, s)
    pi = (d**2).T @ (d**2) / t - s * s
    theta = np.where(off, np.outer(1 / sd, sd) * ((d**3).T @ d / t - np.diag(s)[:, None] * s), 0)
    gamma = ((s - target) ** 2).sum()
    delta = np.clip((pi[off].sum() - r * theta.sum()) / gamma / t, 0, 1) if gamma > 1e-18 else 0.0
    cov = delta * target + (1 - delta) * s
    return sd.sum() ** 2 / cov.sum(), delta


def test_bets_of_each_replicate_equal_a_dense_shrinkage(spark):
    rets, table = returns_of(spark, 40, 5, ("a", "b", "c", "d", "e"))
    both = table.withColumn("menu", F.lit("all")).unionByName(table.filter("series IN ('a', 'b', 'c')").withColumn("menu", F.lit("three")))
    got = {(r.menu, r.rep): r for r in covariance.dr2_draws(both.repartition(3), ("menu",), 60).collect()}
    for menu, names in (("all", "abcde"), ("three", "abc")):
        x = np.column_stack([rets[s] for s in names])
        for rep in (-1, 0, 7, 59):
            at = list(range(40)) if rep < 0 else drawn_months(7, rep, 40, replicates.length_of(40))
            want, delta = shrunk_dr2(x[at])
            assert np.isclose(got[menu, rep].dr2, want) and np.isclose(got[menu, rep].delta, delta)
    one = covariance.dr2_bootstrap(both, "menu", "three", "all", 60).first()
    a, b = (np.array([got[m, r].dr2 for r in range(60)]) for m in ("three", "all"))
    d = b - a
    tail = min((d - d.mean() >= abs(one.delta)).mean(), (d - d.mean() <= -abs(one.delta)).mean())
    assert one.used == 60 and np.isclose(one.ci_delta_lo, np.percentile(d, 2.5)) and np.isclose(one.ci_a_hi, np.percentile(a, 97.5)) and np.isclose(one.p, max(2 * tail, 1 / 61))


@pytest.mark.parametrize("chunk", [1, 2, 64])
def test_pairs_by_cells_are_all_pairs_once(spark, chunk):
    rng = np.random.default_rng(2)
    rows = [(f"s{i}", m, float(rng.normal())) for i in range(9) for k, m in enumerate(months(30)) if (k * 7 + i) % 4 or i < 3]
    table = spark.createDataFrame(rows, "series string, month date, ret double").withColumn("month", F.last_day("month"))
    values = defaultdict(dict)
    for s, m, v in rows:
        values[s][m.replace(day=1)] = v
    got = performance.pair_arrays(table, chunk=chunk).collect()
    assert sorted((r.i, r.j) for r in got) == sorted((a, b) for a in values for b in values if a < b)
    for r in performance.corr_pairs(table, complete=False).collect():
        both = sorted(values[r.i].keys() & values[r.j].keys())
        assert r.n == len(both) and np.isclose(r.corr, np.corrcoef([values[r.i][m] for m in both], [values[r.j][m] for m in both])[0, 1])
    flat = performance.pair_self_join(table).collect()
    assert len(flat) == sum(len(values[a].keys() & values[b].keys()) for a in values for b in values if a < b)
    assert all(values[r.i][r.month.replace(day=1)] == r.x and values[r.j][r.month.replace(day=1)] == r.y for r in flat)


def test_many_series_make_all_pairs(spark):
    n = 400
    table = spark.range(n).selectExpr("concat('s', id) AS series", "explode(sequence(0, 5)) AS k", "id").selectExpr("series", "last_day(add_months(DATE '2000-01-01', k)) AS month", "sin(id * 7 + k * k) AS ret")
    rows = performance.corr_pairs(table, complete=False)
    assert rows.agg(F.count("*"), F.countDistinct("i", "j")).first()[:2] == (n * (n - 1) // 2,) * 2


def chain(spark, n=60):
    line = [("A" if i % 10 < 6 else "B", m) for i, m in enumerate(months(n))]
    moves = spark.createDataFrame([("A", "A", 0.8), ("A", "B", 0.2), ("B", "A", 0.5), ("B", "B", 0.5)], "from_state string, to_state string, p double")
    return line, spark.createDataFrame([*line, ("C", dt.date(1999, 1, 28))], "state string, month date"), moves


def test_paths_draw_months_of_their_state(spark):
    line, states, moves = chain(spark)
    drawn = paths.state_block_arrays(states.filter("state <> 'C'"), moves, None, 400, 60).collect()
    state = {i + 1: s for i, (s, _) in enumerate(line)}
    changes, kept, on = Counter(), Counter(), 0
    for r in drawn:
        assert len(r.path) == 60 and state[r.path[0]] == line[-1][0]
        for a, b in zip(r.path, r.path[1:]):
            changes[state[a]] += state[a] != state[b]
            kept[state[a]] += 1
            on += b == a + 1
    assert abs(changes["A"] / kept["A"] - 0.2) < 0.02 and abs(changes["B"] / kept["B"] - 0.5) < 0.02 and on > 0.3 * sum(kept.values())
    share = paths.state_block_paths(states, moves, {"A": 0.7, "B": 0.3, "C": 5.0}, 300, 60).join(paths.month_positions(states), "pos").agg(F.avg((F.col("state") == "A").cast("double")), F.max((F.col("state") == "C").cast("int"))).first()
    assert abs(share[0] - 0.7) < 0.05 and share[1] == 0  # a state of one month is never drawn
    with pytest.raises(ValueError):
        paths.state_block_arrays(states, moves, {"A": 0.0})


def test_outcomes_of_paths_at_every_horizon(spark):
    rng = np.random.default_rng(9)
    rets = {"x": rng.normal(0.01, 0.05, 30), "y": rng.normal(0, 0.1, 30)}
    placed = spark.createDataFrame([(s, i + 1, float(v)) for s, r in rets.items() for i, v in enumerate(r) if s == "x" or i != 4], "series string, pos int, ret double")
    walks = {t: rng.integers(1, 31, 36 if t else 20).tolist() for t in range(20)}
    table = spark.createDataFrame([(t, k + 1, p) for t, w in walks.items() for k, p in enumerate(w)], "trial long, period int, pos int")
    got = {(r.series, r.years, r.trial): r for r in paths.path_outcomes(paths.path_arrays(table), placed, (1, 2, 3)).collect()}
    assert {k[1:] for k in got} == {(y, t) for t, w in walks.items() for y in (1, 2, 3) if 12 * y <= len(w)}
    for (s, y, t), r in got.items():
        own = np.array([rets[s][p - 1] for p in walks[t][: 12 * y] if s == "x" or p != 5])
        level = np.cumprod(1 + own)
        assert r.months == len(own) and np.isclose(r.growth, level[-1]) and np.isclose(r.max_drawdown, (level / np.maximum.accumulate(level) - 1).min())
    whole = {r.series: r for r in paths.path_summary(table, placed).collect()}
    ends = [np.prod([1 + rets["x"][p - 1] for p in w]) ** (12 / len(w)) - 1 for w in walks.values()]
    assert np.isclose(whole["x"].cagr_p25, np.percentile(ends, 25)) and whole["x"].n_trials == 20 and np.isclose(whole["x"].prob_loss, np.mean(np.array(ends) < 0))
