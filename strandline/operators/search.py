"""Candidate portfolios scored and picked as tables, nearest past months, and the outlook's record.

The search looks at a given table of candidates: it is as fine as that table and no solver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .exposure import effective_bets, look_through, risk_contributions
from .macro import STATES, state_label
from .panel import exclude_band_join

OBJECTIVES = ("return", "risk", "diversification", "floor")


def compositions(spark: SparkSession, series: list[str], parts: int) -> DataFrame:
    """portfolio, series, weight: every way to deal ``parts`` equal parts to the series."""
    rows = spark.range(1).select(F.array().cast("array<int>").alias("a"), F.lit(parts).alias("left"))
    for _ in series[:-1]:
        rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("left")))).select(F.array_append("a", F.col("x")).alias("a"), (F.col("left") - F.col("x")).alias("left"))
    dealt = rows.select(F.array_append("a", F.col("left")).alias("a"))
    names = F.array(*(F.lit(s) for s in series))
    flat = dealt.select(F.array_join("a", "-").alias("portfolio"), F.explode(F.arrays_zip(names.alias("series"), F.col("a").alias("n"))).alias("c"))
    return flat.filter("c.n > 0").select("portfolio", "c.series", (F.col("c.n") / parts).alias("weight"))


def candidate_scores(candidates: DataFrame, means: DataFrame, cov: DataFrame, lookup: DataFrame, state_means: DataFrame, importance: dict[str, float]) -> DataFrame:
    """portfolio, raw return, risk (less the yearly volatility), diversification (effective bets) and floor (worst state's mean), their scores and the total.

    A score is where a value stands between the worst (0) and best (100) of all candidates, 100 where they are the same;
    the total weighs scores by ``importance``. ``means`` has series, mean_ret; a candidate counts in a state where all it holds has a mean.
    """
    gain = candidates.join(means.select("series", "mean_ret"), "series").groupBy("portfolio").agg(F.sum(F.col("weight") * F.col("mean_ret")).alias("return"))
    risk = risk_contributions(candidates, cov).groupBy("portfolio").agg((-F.sum("contribution") * F.sqrt(F.lit(12.0))).alias("risk"))
    bets = effective_bets(look_through(candidates, lookup)).select("portfolio", F.col("effective_bets").alias("diversification"))
    held = candidates.withColumn("_n", F.count("*").over(W.partitionBy("portfolio")))
    by_state = held.join(state_means.select("state", "series", "mean_ret"), "series").groupBy("portfolio", "state").agg(F.sum(F.col("weight") * F.col("mean_ret")).alias("m"), F.count("*").alias("k"), F.max("_n").alias("n"))
    floor = by_state.filter("k = n").groupBy("portfolio").agg(F.min("m").alias("floor"))
    raw = reduce(lambda a, b: a.join(b, "portfolio"), [gain, risk, bets, floor])
    ends = raw.agg(*(f(c).alias(f"{n}_{c}") for c in OBJECTIVES for f, n in ((F.min, "lo"), (F.max, "hi"))))
    spread = lambda c: F.col(f"hi_{c}") - F.col(f"lo_{c}")
    score = {c: F.when(spread(c) < 1e-15, 100.0).otherwise(100 * (F.col(c) - F.col(f"lo_{c}")) / spread(c)) for c in OBJECTIVES}
    total = sum(importance.values())
    scored = raw.crossJoin(F.broadcast(ends)).select("portfolio", *OBJECTIVES, *(v.alias(f"score_{c}") for c, v in score.items()))  # one row
    return scored.withColumn("total", reduce(lambda a, b: a + b, [F.col(f"score_{c}") * (w / total) for c, w in importance.items()]))


def largest_holdings(candidates: DataFrame, groups: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, portfolio, dim, held: the most that a candidate holds of one series (dim "series") and of one category of each grouping.

    ``groups`` has series, dim, category, share, such as zones through countries or factors.
    """
    one = candidates.select(*by, "portfolio", F.lit("series").alias("dim"), F.col("series").alias("category"), F.col("weight").alias("held"))
    if groups is not None:
        more = candidates.join(groups.select("series", "dim", "category", "share"), "series").groupBy(*by, "portfolio", "dim", "category").agg(F.sum(F.col("weight") * F.col("share")).alias("held"))
        one = one.unionByName(more)
    return one.groupBy(*by, "portfolio", "dim").agg(F.max("held").alias("held"))


def cap_problems(candidates: DataFrame, caps: DataFrame, groups: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, preset, dim, cap, n of the caps (preset, dim, cap, and ``by`` if it has them) that cannot hold 100 % in a menu's n series or categories."""
    names = candidates.select(*by, "series").distinct()
    sizes = names.groupBy(*by).agg(F.count("*").alias("n")).withColumn("dim", F.lit("series"))
    if groups is not None:
        kinds = names.join(groups.select("series", "dim", "category").distinct(), "series")
        sizes = sizes.unionByName(kinds.groupBy(*by, "dim").agg(F.countDistinct("category").alias("n")))
    return caps.join(sizes, [*(c for c in by if c in caps.columns), "dim"]).filter(F.col("cap") * F.col("n") < 1 - 1e-9).select(*by, "preset", "dim", "cap", "n")


def inside_caps(candidates: DataFrame, caps: DataFrame, groups: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, preset, portfolio, at_cap: the candidates inside all caps of each preset (preset, dim, cap, and ``by`` if it has them), for all presets in one pass.

    at_cap tells that something stands at its cap. A grouping that a candidate holds nothing of is no bound.
    """
    shared = [c for c in by if c in caps.columns]
    bounds = caps.groupBy(*shared, "preset").agg(F.map_from_entries(F.collect_list(F.struct("dim", "cap"))).alias("caps"))
    held = largest_holdings(candidates, groups, by).groupBy(*by, "portfolio").agg(F.map_from_entries(F.collect_list(F.struct("dim", "held"))).alias("held"))
    both = held.join(bounds, shared) if shared else held.join(F.broadcast(bounds))  # a row for each preset
    room = F.transform(F.map_entries("caps"), lambda c: c["value"] - F.coalesce(F.try_element_at("held", c["key"]), F.lit(0.0)))
    rows = both.withColumn("room", F.array_min(room)).filter(F.col("room") >= -1e-9)
    return rows.select(*by, "preset", "portfolio", (F.col("room") <= 1e-9).alias("at_cap"))


def within_caps(candidates: DataFrame, caps: dict[str, float], groups: DataFrame | None = None) -> DataFrame:
    """portfolio, at_cap: candidates that hold no more than ``caps["series"]`` of a series nor ``caps[dim]`` of a category of each grouping ``dim``.

    at_cap tells that something stands at its cap. Caps that cannot hold 100 % together are an error.
    """
    table = candidates.sparkSession.createDataFrame([("caps", d, float(c)) for d, c in caps.items()], "preset string, dim string, cap double")
    if bad := cap_problems(candidates, table, groups).limit(1).collect():
        raise ValueError(f"a cap of {bad[0]['cap']:.0%} on {bad[0]['n']} of {bad[0]['dim']} cannot hold 100 %")
    if not caps:
        return candidates.select("portfolio").distinct().withColumn("at_cap", F.lit(False))
    return inside_caps(candidates, table, groups).drop("preset")


def candidate_paths(candidates: DataFrame, panel: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, portfolio, cagr, max_drawdown of every candidate at constant weights over the months of the panel (``by``, series, month, ret).

    A series is one array of returns, a candidate one fold over the arrays it holds; the drawdown is of the compounded
    returns, without a base. Candidates with a series that the panel lacks are left out; the panel's months must be complete.
    """
    arrays = panel.filter("ret IS NOT NULL").groupBy(*by, "series").agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "ret"))), lambda s: s["ret"]).alias("r"))
    held = candidates.join(arrays, [*by, "series"], "left").groupBy(*by, "portfolio").agg(F.collect_list(F.struct("weight", "r")).alias("held"), F.max(F.size("r")).alias("t"), F.count_if(F.col("r").isNull()).alias("lacks"))
    blended = F.aggregate("held", F.array_repeat(F.lit(0.0), F.col("t")), lambda acc, h: F.zip_with(acc, h["r"], lambda a, r: a + h["weight"] * r))
    return held.filter("lacks = 0").withColumn("path", blended).select(*by, "portfolio", *folded("path", "t"))


def folded(path: str, months: str) -> list[Column]:
    """cagr and max_drawdown of an array of monthly returns."""

    def step(acc: Column, r: Column) -> Column:
        level = acc["level"] * (1 + r)
        peak = F.greatest(acc["peak"], level)
        return F.struct(level.alias("level"), peak.alias("peak"), F.least(acc["worst"], level / peak - 1).alias("worst"))

    end = F.aggregate(path, F.struct(F.lit(1.0).alias("level"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst")), step)
    return [(F.pow(end["level"], 12.0 / F.col(months)) - 1).alias("cagr"), end["worst"].alias("max_drawdown")]


def pick_candidate(scores: DataFrame, allowed: DataFrame, by: str = "total", least: dict[str, float] | None = None, paths: DataFrame | None = None) -> DataFrame:
    """The allowed candidate with the best total, or with ``by="floor"`` the best worst state; ``least`` sets hard targets on raw values.

    With ``paths`` (of :func:`candidate_paths`) targets may be on cagr and max_drawdown (at -0.2: no deeper than 20 %) too, each
    missed by 0.0001 at most. Ties go to the first by name; no row where no candidate is left.
    """
    rows = scores.join(allowed, "portfolio")
    rows = rows if paths is None else rows.join(paths, "portfolio")
    for name, value in (least or {}).items():
        rows = rows.filter(F.col(name) >= value - (1e-4 if name in ("cagr", "max_drawdown") else 0))
    return rows.orderBy(F.desc(F.round(by, 12)), "portfolio").limit(1)


def profiles(scores: DataFrame, presets: DataFrame, caps: DataFrame, candidates: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """preset, menu, objective, best, value, twin, twin_value, price, at_cap, problem: every preset's best candidate inside its caps and its best without them.

    ``presets`` has preset, menu, objective and one importance for each of ``OBJECTIVES``; the objective "total" weighs the candidates'
    scores (menu, portfolio, score_...) by the importances, "floor" is the worst state's mean. price is what the caps cost. A preset whose caps cannot
    hold 100 % or leave no candidate has no best and says so in ``problem``; one without caps has its twin. One grouping picks for all presets at once.
    """
    weighed = reduce(lambda a, b: a + b, [F.col(f"importance_{c}") * F.col(f"score_{c}") for c in OBJECTIVES])
    total = weighed / reduce(lambda a, b: a + b, [F.col(f"importance_{c}") for c in OBJECTIVES])
    bounds = caps.select("preset", "dim", "cap").unionByName(presets.select("preset", F.lit("series").alias("dim"), F.lit(1.0).alias("cap")))
    bounds = bounds.groupBy("preset", "dim").agg(F.min("cap").alias("cap")).join(presets.select("preset", "menu"), "preset")
    good = inside_caps(candidates, bounds, groups, ("menu",)).select("menu", "preset", "portfolio", "at_cap")
    value = F.round(F.when(F.col("objective") == "floor", F.col("floor")).otherwise(total), 12)
    rows = scores.join(presets, "menu").withColumn("value", value).filter("value IS NOT NULL").join(good, ["menu", "preset", "portfolio"], "left")
    inside, order = F.col("at_cap").isNotNull(), F.struct((-F.col("value")).alias("v"), F.col("portfolio").alias("p"))
    picked = rows.groupBy("preset", "menu", "objective").agg(
        F.min_by("portfolio", F.when(inside, order)).alias("best"), F.max(F.when(inside, F.col("value"))).alias("value"), F.min_by("at_cap", F.when(inside, order)).alias("at_cap"), F.min_by("portfolio", order).alias("twin"), F.max("value").alias("twin_value")
    )
    bad = cap_problems(candidates, bounds, groups, ("menu",)).groupBy("menu", "preset").agg(F.concat(F.lit("caps below 100 %: "), F.array_join(F.array_sort(F.collect_set("dim")), ", ")).alias("problem"))
    told = picked.join(bad, ["menu", "preset"], "left").withColumn("problem", F.coalesce("problem", F.when(F.col("best").isNull(), "no candidate inside the caps")))
    return told.select("preset", "menu", "objective", "best", "value", "twin", "twin_value", (F.col("twin_value") - F.col("value")).alias("price"), "at_cap", "problem")


def analog_features(states: DataFrame, m: int = 6, a: int = 3) -> DataFrame:
    """month, pos, state and six features in units of their population deviation: both scores, their velocities over ``m`` months and the change of those over ``a``."""
    w = W.orderBy("month")  # a row for each month
    rows = states.select("month", "state", "growth_score", "inflation_score", F.row_number().over(w).alias("pos"))
    for axis in ("growth", "inflation"):
        rows = rows.withColumn(f"v_{axis}", (F.col(f"{axis}_score") - F.lag(f"{axis}_score", m).over(w)) / m)
        rows = rows.withColumn(f"a_{axis}", F.col(f"v_{axis}") - F.lag(f"v_{axis}", a).over(w))
    names = [f"{p}{axis}{s}" for p, s in (("", "_score"), ("v_", ""), ("a_", "")) for axis in ("growth", "inflation")]
    known = rows.filter("a_growth IS NOT NULL")
    sd = known.agg(*(F.nullif(F.stddev_pop(c), F.lit(0.0)).alias(f"sd_{c}") for c in names))
    scaled = known.crossJoin(F.broadcast(sd))  # one row
    return scaled.select("month", "pos", "state", *((F.col(c) / F.coalesce(f"sd_{c}", F.lit(1.0))).alias(f"f{i}") for i, c in enumerate(names)))


def analogs(states: DataFrame, k: int = 20, band: int = 6, h: int = 3, queries: DataFrame | None = None) -> DataFrame:
    """month, rank, analog, distance, outcome: the ``k`` nearest other months, more than ``band`` away, and the state ``h`` months after each.

    Months whose outcome is not known yet are no analogs. ``queries`` (month) are the months asked for; all by default.
    """
    w = W.orderBy("month")
    rows = analog_features(states).join(states.select("month", F.lead("state", h).over(w).alias("outcome")), "month")
    f = [f"f{i}" for i in range(6)]
    asked = rows if queries is None else rows.join(queries.select("month").distinct(), "month", "left_semi")
    pairs = exclude_band_join(rows.join(asked.select("month", F.lit(True).alias("is_query")), "month", "left").withColumn("is_query", F.coalesce("is_query", F.lit(False))), band, ["month", "outcome", *f])
    distance = F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(c) - F.col(f"o_{c}"), 2) for c in f]))
    near = pairs.filter("o_outcome IS NOT NULL").withColumn("distance", distance)
    place = F.row_number().over(W.partitionBy("month").orderBy(F.round("distance", 9), "o_pos"))
    return near.withColumn("rank", place).filter(F.col("rank") <= k).select("month", "rank", F.col("o_month").alias("analog"), "distance", F.col("o_outcome").alias("outcome"))


def analog_outlook(found: DataFrame) -> DataFrame:
    """month, state, p: shares of the analogs' outcomes."""
    n = F.count("*").over(W.partitionBy("month"))
    return found.withColumn("_n", n).groupBy("month", F.col("outcome").alias("state"), "_n").agg((F.count("*") / F.col("_n")).alias("p")).drop("_n")


def known_features(states: DataFrame, m: int = 6, a: int = 3, least: int = 12) -> DataFrame:
    """month, pos, state, f (six features) and sd (their sample deviations over what was known in that month), for months that know ``least`` others.

    The features are both scores, their velocities over ``m`` months and the change of those over ``a``; a deviation of zero counts as 1.
    """
    w = W.orderBy("month")  # a row for each month
    rows = states.select("month", "state", "growth_score", "inflation_score", F.row_number().over(w).alias("pos"))
    for axis in ("growth", "inflation"):
        rows = rows.withColumn(f"v_{axis}", (F.col(f"{axis}_score") - F.lag(f"{axis}_score", m).over(w)) / m)
        rows = rows.withColumn(f"a_{axis}", F.col(f"v_{axis}") - F.lag(f"v_{axis}", a).over(w))
    names = [f"{p}{axis}{s}" for p, s in (("", "_score"), ("v_", ""), ("a_", "")) for axis in ("growth", "inflation")]
    known = rows.filter("a_growth IS NOT NULL AND a_inflation IS NOT NULL")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    scaled = known.select("month", "pos", "state", F.array(*names).alias("f"), F.array(*(F.coalesce(F.nullif(F.stddev_samp(c).over(so_far), F.lit(0.0)), F.lit(1.0)) for c in names)).alias("sd"), F.count("*").over(so_far).alias("_k"))
    return scaled.filter(F.col("_k") > least).drop("_k")


def asof_analogs(states: DataFrame, k: int = 20, h: int = 3, m: int = 6, a: int = 3, least: int = 12) -> DataFrame:
    """t, rank, u, distance, outcome: for each month (its number t) the ``k`` nearest months u whose state ``h`` months on was known at t.

    Features are scaled by deviations known at t, so nothing later enters. Ties go to the earlier month. The earlier months of a month travel as one array,
    so the search is one pass over months and no join; a month has at most as many earlier ones as the calendar.
    """
    w = W.orderBy("pos")  # a row for each month
    rows = known_features(states, m, a, 0).join(states.select("month", F.lead("state", h).over(W.orderBy("month")).alias("outcome")), "month")
    past = F.collect_list(F.struct("pos", "f", "outcome")).over(w.rangeBetween(W.unboundedPreceding, -h))
    gap = lambda p: F.sqrt(F.aggregate(F.zip_with(F.zip_with("f", p["f"], lambda x, y: x - y), "sd", lambda d, s: d / s), F.lit(0.0), lambda acc, z: acc + z * z))
    near = F.transform("past", lambda p: F.struct(F.round(gap(p), 9).alias("d"), p["pos"].alias("u"), gap(p).alias("distance"), p["outcome"].alias("outcome")))
    asked = rows.withColumn("past", past).filter(F.size("past") >= least)
    ranked = asked.select(F.col("pos").alias("t"), F.posexplode(F.slice(F.array_sort(near), 1, k)).alias("rank", "n"))
    return ranked.select("t", (F.col("rank") + 1).alias("rank"), "n.u", "n.distance", "n.outcome")


def momentum_forecast(states: DataFrame, h: int = 3, m: int = 6) -> DataFrame:
    """t, state: where both scores stand ``h`` months on if they keep their velocity over the last ``m`` months; the state by their signs."""
    w = W.orderBy("month")  # a row for each month
    ahead = lambda c: F.col(c) + h * (F.col(c) - F.lag(c, m).over(w)) / m
    rows = states.select(F.row_number().over(w).alias("t"), ahead("growth_score").alias("g"), ahead("inflation_score").alias("i"))
    return rows.filter("g IS NOT NULL AND i IS NOT NULL").select("t", state_label(F.col("g") > 0, F.col("i") > 0).alias("state"))


def _moves_known(rows: DataFrame) -> DataFrame:
    """t, a, b, q: shares of the moves from state a to b among those seen before month t, by running counts."""
    w = W.partitionBy("a", "b").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    grid = rows.select("t", "state", "next", F.explode(F.array(*map(F.lit, STATES))).alias("a")).withColumn("b", F.explode(F.array(*map(F.lit, STATES))))
    seen = F.sum(((F.col("state") == F.col("a")) & (F.col("next") == F.col("b"))).cast("int")).over(w)
    counts = grid.withColumn("n", F.coalesce(seen, F.lit(0))).withColumn("all", F.sum("n").over(W.partitionBy("t", "a")))
    return counts.filter("n > 0").select("t", "a", "b", (F.col("n") / F.col("all")).alias("q"))


def outlook_backtest(states: DataFrame, h: int = 3, warmup: int = 24, k: int = 20, m: int = 6, a: int = 3, least: int = 12) -> DataFrame:
    """method, n, hit_rate, brier, turns, turns_caught of forecasts of the state ``h`` months on, each from what was known: persistence, Markov, analog, momentum.

    The chain counts the moves up to the month and is taken h steps from the month's state; a state not left yet stays. The analogs'
    forecast is the shares of their outcomes. The Brier score sums squared errors over the four states; turns are the months whose state changes, and
    turns_caught the share of them that the method's call foresaw. All methods are rated on the months that all of them forecast.
    """
    w = W.orderBy("month")  # a row for each month
    rows = states.select("month", "state", F.row_number().over(w).alias("t"), F.lead("state", 1).over(w).alias("next"), F.lead("state", h).over(w).alias("outcome"))
    near = asof_analogs(states, k, h, m, a, least)
    shares = near.groupBy("t", F.col("outcome").alias("a")).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("t"))).drop("n")
    trend = momentum_forecast(states, h, m).select("t", F.col("state").alias("a"), F.lit(1.0).alias("p"))
    asked = rows.filter((F.col("t") > warmup) & F.col("outcome").isNotNull()).select("t", "state", "outcome")
    asked = asked.join(shares.select("t").distinct(), "t", "left_semi").join(trend.select("t"), "t", "left_semi")
    chain = _moves_known(rows)
    now = asked.select("t", F.col("state").alias("a"), F.lit(1.0).alias("p"))
    for _ in range(h):
        step = now.join(chain, ["t", "a"], "left").select("t", F.coalesce("b", "a").alias("a"), (F.col("p") * F.coalesce("q", F.lit(1.0))).alias("p"))
        now = step.groupBy("t", "a").agg(F.sum("p").alias("p"))
    grid = asked.withColumn("a", F.explode(F.array(*map(F.lit, STATES))))
    forecasts = {"persistence": asked.select("t", F.col("state").alias("a"), F.lit(1.0).alias("p")), "markov": now, "analog": shares, "momentum": trend}
    every = reduce(DataFrame.unionByName, [p.select("t", "a", "p").withColumn("method", F.lit(name)) for name, p in forecasts.items()])
    methods = F.explode(F.array(*map(F.lit, forecasts)))
    filled = grid.withColumn("method", methods).join(every, ["method", "t", "a"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    is_so: Column = (F.col("a") == F.col("outcome")).cast("double")
    best = F.max_by("a", F.struct(F.round("p", 12), F.col("a")))
    by_month = filled.groupBy("method", "t", "state", "outcome").agg(F.sum(F.pow(F.col("p") - is_so, 2)).alias("brier"), best.alias("call"))
    hit, turn = (F.col("call") == F.col("outcome")).cast("double"), F.col("state") != F.col("outcome")
    return by_month.groupBy("method").agg(F.count("*").alias("n"), F.avg(hit).alias("hit_rate"), F.avg("brier").alias("brier"), F.count_if(turn).alias("turns"), F.avg(F.when(turn, hit)).alias("turns_caught"))
