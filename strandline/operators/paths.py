"""History drawn again month by month, state by state, and what series and portfolios would have made of it.

A path is one array of positions; draws are md5 of seed, trial and period, so they are the same in any engine. History
is one row (positions by state and moves between states), paths are as many as asked for: neither grows with the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .panel import checked_weights
from .performance import dense

#: A state of fewer months is never drawn.
LEAST_MONTHS = 3
#: Sets of paths that a series is dealt over.
PARTS = 16


def month_positions(states: DataFrame) -> DataFrame:
    """month, state, pos: the months of the history, numbered from 1."""
    return states.select("month", "state", F.row_number().over(W.orderBy("month")).alias("pos"))  # a row for each month


def _history(states: DataFrame, transitions: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """One row: each state by name with its chance to stay, the running sum of its chances to go to each state, and its positions; the running chances of the first state."""
    seen = month_positions(states)
    last = seen.agg(F.max_by("state", "pos").alias("now"))  # one row
    own = seen.groupBy("state").agg(F.array_sort(F.collect_list("pos")).alias("places")).filter(F.size("places") >= LEAST_MONTHS)
    p = transitions.select(F.col("from_state").alias("state"), F.col("to_state").alias("to"), F.coalesce("p", F.lit(0.0)).alias("p"))
    stay = own.join(p.filter("state = to").select("state", F.col("p").alias("stay")), "state", "left").withColumn("stay", F.coalesce("stay", F.lit(0.0)))
    if weights is None:
        to = own.select(F.col("state").alias("to"))
        moves = stay.select("state").crossJoin(to).join(p, ["state", "to"], "left").withColumn("w", F.when(F.col("state") == F.col("to"), 0.0).otherwise(F.coalesce("p", F.lit(0.0))))  # states times states
        moves = moves.withColumn("w", F.when(F.sum("w").over(W.partitionBy("state")) > 0, F.col("w")).otherwise(1.0))
    else:
        given = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)) if weights else F.create_map(F.lit(""), F.lit(0.0))
        share = stay.select(F.col("state").alias("to"), (F.coalesce(F.try_element_at(given, F.col("state")), F.lit(0.0)).cast("double") * (1 - F.col("stay"))).alias("w"))
        moves = stay.select("state").crossJoin(share)  # states times states
    order = W.partitionBy("state").orderBy("to").rowsBetween(W.unboundedPreceding, 0)
    running = moves.withColumn("c", F.sum("w").over(order) / F.sum("w").over(W.partitionBy("state")))
    cum = running.groupBy("state").agg(F.transform(F.array_sort(F.collect_list(F.struct("to", "c"))), lambda e: e["c"]).alias("cum"))
    rows = stay.join(cum, "state").agg(F.array_sort(F.collect_list(F.struct("state", "stay", "cum", "places"))).alias("states"))
    return rows.crossJoin(last)  # one row each


def state_block_arrays(states: DataFrame, transitions: DataFrame, weights: dict[str, float] | None = None, trials: int = 2000, months: int = 120, seed: int = 42) -> DataFrame:
    """trial, path: arrays of ``months`` positions of historical months (of :func:`month_positions`), one state's spell after another.

    In each month the state is left with the chance that ``transitions`` (from_state, to_state, p) give. Without ``weights`` a path begins in the last state and
    moves by the other chances of its state (to any state alike where there are none); ``weights`` by state draw each spell's state so that
    the states' shares of months tend to them, and at least one must be positive on a state that has months. Within a spell history runs on month by month while its state lasts, then goes on at a
    random month of the state.
    """
    given = sum(v for v in (weights or {}).values())
    if weights is not None and given <= 0:
        raise ValueError("none of the states has a weight")
    hexes = lambda t: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"), t.cast("string")).cast("binary"))
    part = lambda h, at: F.conv(F.substring(h, at, 8), 16, 10).cast("double") / float(1 << 32)
    draws = F.transform(F.sequence(F.lit(1), F.lit(months)), lambda t: F.struct(t.alias("t"), part(hexes(t), 1).alias("move"), part(hexes(t), 9).alias("place")))
    rows = states.sparkSession.range(trials).withColumn("draws", draws).crossJoin(F.broadcast(_history(states, transitions, weights)))  # one row
    if weights is not None:
        rows = rows.withColumn("states", F.when(F.forall(F.col("states")[0]["cum"], lambda c: c.isNotNull()), F.col("states")).otherwise(F.raise_error(F.lit("none of the weighted states has months"))))
    index = F.array_position(F.transform("states", lambda s: s["state"]), F.col("now")).cast("int")
    first = F.when(index > 0, index - 1).otherwise(0)

    def drawn(cum: Column, u: Column) -> Column:
        return F.least(F.size(F.filter(cum, lambda c: c <= u)), F.size(cum) - 1)

    def step(acc: Column, d: Column) -> Column:
        here = F.get(F.col("states"), acc["s"])
        stays = (d["t"] > 1) & (d["move"] < here["stay"])
        begin = first if weights is None else drawn(here["cum"], d["move"])
        leave = drawn(here["cum"], (d["move"] - here["stay"]) / (1 - here["stay"]))
        s = F.when(d["t"] == 1, begin).when(stays, acc["s"]).otherwise(leave)
        places = F.get(F.col("states"), s)["places"]
        runs_on = stays & F.array_contains(places, acc["pos"] + 1)
        pos = F.when(runs_on, acc["pos"] + 1).otherwise(F.get(places, F.floor(d["place"] * F.size(places)).cast("int")))
        return F.struct(s.alias("s"), pos.alias("pos"), F.array_append(acc["path"], pos).alias("path"))

    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("pos"), F.array().cast("array<int>").alias("path"))
    return rows.select(F.col("id").alias("trial"), F.aggregate("draws", start, step)["path"].alias("path"))


def state_block_paths(states: DataFrame, transitions: DataFrame, weights: dict[str, float] | None = None, trials: int = 2000, months: int = 120, seed: int = 42) -> DataFrame:
    """trial, period, pos of :func:`state_block_arrays`, a row for each month."""
    rows = state_block_arrays(states, transitions, weights, trials, months, seed)
    return rows.select("trial", F.posexplode("path").alias("period", "pos")).select("trial", (F.col("period") + 1).alias("period"), "pos")


def path_arrays(paths: DataFrame) -> DataFrame:
    """trial, path from rows trial, period, pos."""
    return paths.groupBy("trial").agg(F.transform(F.array_sort(F.collect_list(F.struct("period", "pos"))), lambda p: p["pos"]).alias("path"))


def path_outcomes(paths: DataFrame, placed: DataFrame, years: tuple[int, ...] | None = None) -> DataFrame:
    """series, years, trial, months, growth, max_drawdown of every series (series, pos, ret) on every path (trial, path), after each number of ``years``; years is null for the whole path.

    A path counts for the horizons that it is long enough for. Months that a series lacks are skipped. The drawdown is
    of the compounded returns, without a base. Series and sets of paths are dealt over the cluster; the paths, as many as were asked for, are sent to all.
    """
    ends = placed.filter("ret IS NOT NULL").groupBy("series").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("m"), F.col("ret").alias("v")))).alias("e"))
    arrays = ends.select("series", dense("e", F.lit(1), F.element_at("e", -1)["m"]).alias("r")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = paths.select("trial", "path", F.pmod("trial", F.lit(PARTS)).cast("int").alias("_part"))
    both = arrays.repartition(parts, "series", "_part").join(F.broadcast(asked), "_part")  # trials times periods numbers, whatever the data
    seen = F.transform("path", lambda pos: F.get(F.col("r"), pos - 1))
    rows = both.select("series", "trial", seen.alias("seen"))
    if years:
        long_enough = F.filter(F.array(*(F.lit(y) for y in years)), lambda y: 12 * y <= F.size("seen"))
        rows = rows.withColumn("years", F.explode(long_enough)).withColumn("seen", F.slice("seen", F.lit(1), 12 * F.col("years")))
    else:
        rows = rows.withColumn("years", F.lit(None).cast("int"))
    rows = rows.withColumn("known", F.filter("seen", lambda r: r.isNotNull())).filter(F.size("known") > 0)

    def step(acc: Column, ret: Column) -> Column:
        level = acc["level"] * (1 + ret)
        peak = F.greatest(acc["peak"], level)
        return F.struct(level.alias("level"), peak.alias("peak"), F.least(acc["worst"], level / peak).alias("worst"))

    start = F.struct(F.lit(1.0).alias("level"), F.lit(0.0).alias("peak"), F.lit(1.0).alias("worst"))
    folded = rows.select("series", "years", "trial", F.size("known").alias("months"), F.aggregate("known", start, step).alias("f"))
    return folded.select("series", "years", "trial", "months", F.col("f.level").alias("growth"), (F.col("f.worst") - 1).alias("max_drawdown"))


def path_summary(paths: DataFrame, placed: DataFrame, years: tuple[int, ...] | None = None) -> DataFrame:
    """series, (years,) n_trials, percentiles of yearly growth (5, 25, 50, 75, 95) and drawdown (5, 50, 95) and the share of losses over paths (trial, period, pos; or trial, path).

    ``placed`` (series, pos, ret) are series or portfolios on the months that the paths draw; see :func:`path_outcomes`.
    """
    rows = path_outcomes(paths if "path" in paths.columns else path_arrays(paths), placed, years)
    rows = rows.withColumn("cagr", F.pow("growth", 12.0 / F.col("months")) - 1)
    cells = [F.percentile("cagr", F.lit(q / 100)).alias(f"cagr_p{q}") for q in (5, 25, 50, 75, 95)] + [F.percentile("max_drawdown", F.lit(q / 100)).alias(f"maxdd_p{q}") for q in (5, 50, 95)]
    keys = ["series", "years"] if years else ["series"]
    return rows.groupBy(*keys).agg(F.count("*").alias("n_trials"), *cells, F.avg((F.round("growth", 12) < 1).cast("double")).alias("prob_loss"))


def portfolio_cones(paths: DataFrame, weights: DataFrame, panel: DataFrame, months: DataFrame, years: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """portfolio, years and the columns of :func:`path_summary` for portfolios (portfolio, series, weight) at constant weights, on paths as long as the longest horizon.

    Weights must name series of the panel and add up to one; months (month, pos) where a portfolio's series are not all there are skipped.
    """
    good = checked_weights(weights, panel)
    held = good.withColumn("_n", F.count("*").over(W.partitionBy("portfolio")))
    rows = held.join(panel.filter("ret IS NOT NULL").select("series", "month", "ret"), "series").join(months.select("month", "pos"), "month")
    blended = rows.groupBy("portfolio", "pos").agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"), F.count("*").alias("_k"), F.max("_n").alias("_n")).filter("_k = _n")
    return path_summary(paths, blended.select(F.col("portfolio").alias("series"), "pos", "ret"), years).withColumnRenamed("series", "portfolio")
