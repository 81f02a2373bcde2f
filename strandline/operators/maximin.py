"""The rule that maximises the worst state's mean, raced under real and scrambled labels.

Keys: ``by`` names races with panels of their own (menus), ``arm`` names labellings of one history (the real one, replicates
of scrambled ones). The panel and the schedule are never copied for an arm: labels meet returns once, in sums over segments of
months that refits share, so the work grows with arms times months and not with arms times refits times months.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .inference import realised_floor, scramble_states
from .walkforward import BPS, walk_forward

#: Pieces into which a menu's candidates are dealt, so that no task scores all of them for a refit.
PIECES = 32


def placebo_labels(states: DataFrame, modes: tuple[str, ...] = ("circular", "iid"), replicates: int = 40, seed: int = 12345) -> DataFrame:
    """arm, mode, rep and all columns of states: the real labels (mode "none", rep -1) and ``replicates`` scrambled ones of each mode."""
    real = states.withColumns({"arm": F.lit("real"), "mode": F.lit("none"), "rep": F.lit(-1)})
    arms = [scramble_states(states, m, replicates, seed).withColumns({"arm": F.lit("placebo"), "mode": F.lit(m)}) for m in modes]
    return reduce(DataFrame.unionByName, arms, real)


def _segments(schedule: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(``by``, pos, seg), (``by``, refit, seg): runs of positions that no training window begins or ends inside, and each refit's runs."""
    w = W.partitionBy(*by).orderBy("lo")
    edges = schedule.select(*by, F.explode(F.array(F.col("train_lo"), F.col("train_hi") + 1)).alias("lo")).distinct()
    runs = edges.select(*by, "lo", (F.lead("lo").over(w) - 1).alias("hi"), F.row_number().over(w).alias("seg"))
    places = runs.filter("hi IS NOT NULL").select(*by, "seg", F.explode(F.sequence("lo", "hi")).alias("pos"))
    ends = schedule.select(*by, "refit", "train_lo", (F.col("train_hi") + 1).alias("_end"))
    first, last = (runs.select(*by, F.col("lo").alias(c), F.col("seg").alias(a)) for c, a in (("train_lo", "_a"), ("_end", "_b")))
    spans = ends.join(first, [*by, "train_lo"]).join(last, [*by, "_end"])
    return places, spans.select(*by, "refit", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)).alias("seg"))


def state_means_at_refits(placed: DataFrame, schedule: DataFrame, labels: DataFrame, by: tuple[str, ...] = (), arm: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """``by``, ``arm``, refit, state, series, mean_ret, n over each refit's training months, for states with ``least`` of them.

    ``labels`` has ``arm``, month, state; months without a label add nothing.
    """
    places, spans = _segments(schedule, by)
    rows = placed.select(*by, "series", "pos", "month", "ret").join(places, [*by, "pos"]).join(labels.select(*arm, "month", "state"), "month")
    sums = rows.groupBy(*by, *arm, "seg", "state", "series").agg(F.sum("ret").alias("s"), F.count("ret").alias("k"))
    whole = sums.join(spans, [*by, "seg"]).groupBy(*by, *arm, "refit", "state", "series").agg(F.sum("k").alias("n"), F.sum("s").alias("s"))
    return whole.filter(F.col("n") >= least).select(*by, *arm, "refit", "state", "series", (F.col("s") / F.col("n")).alias("mean_ret"), "n")


def maximin_weights(candidates: DataFrame, allowed: DataFrame, means: DataFrame, by: tuple[str, ...] = (), arm: tuple[str, ...] = (), least_states: int = 2) -> DataFrame:
    """``by``, ``arm``, rule, refit, portfolio, floor, series, w: each rule's candidate with the best worst-state mean at each refit.

    ``candidates`` has ``by``, portfolio, series, weight; ``allowed`` has ``by``, rule, portfolio, the candidates inside a rule's caps; ``means`` has
    ``by``, ``arm``, refit, state, series, mean_ret. A state counts for a candidate where all it holds has a mean; a
    refit with fewer than ``least_states`` states is skipped. Ties go to the first by name.
    """
    rules = allowed.groupBy(*by, "portfolio").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    packed = candidates.groupBy(*by, "portfolio").agg(F.collect_list(F.struct("series", "weight")).alias("held")).join(rules, [*by, "portfolio"])
    dealt = packed.withColumn("_piece", F.pmod(F.hash("portfolio"), F.lit(PIECES)))
    by_state = means.groupBy(*by, *arm, "refit", "state").agg(F.map_from_entries(F.collect_list(F.struct("series", "mean_ret"))).alias("m"))
    asked = by_state.groupBy(*by, *arm, "refit").agg(F.collect_list("m").alias("states")).filter(F.size("states") >= least_states)
    parts = int(means.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # little data and much work: not to be put into few tasks
    asked = asked.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1)))).repartition(parts, *by, *arm, "refit", "_piece")
    value = F.transform("states", lambda m: F.aggregate("held", F.lit(0.0), lambda acc, h: acc + h["weight"] * m[h["series"]]))
    known = F.filter(value, lambda v: v.isNotNull())
    scored = dealt.join(asked, [*by, "_piece"]).withColumn("_v", known).filter(F.size("_v") >= least_states).withColumn("floor", F.array_min("_v"))
    each = scored.select(*by, *arm, "refit", "portfolio", "floor", F.explode("rules").alias("rule"))
    best = F.min_by(F.struct("portfolio", "floor"), F.struct((-F.round("floor", 12)).alias("v"), F.col("portfolio").alias("p")))
    picked = each.groupBy(*by, *arm, "rule", "refit").agg(best.alias("b")).select(*by, *arm, "rule", "refit", "b.portfolio", "b.floor")
    return picked.join(candidates.select(*by, "portfolio", "series", F.col("weight").alias("w")), [*by, "portfolio"])


def with_control(weights: DataFrame, control: DataFrame, by: tuple[str, ...] = (), arm: tuple[str, ...] = ()) -> DataFrame:
    """The arms' weights and, in every arm, the weights of a rule that uses no labels (``control``: ``by``, rule, refit, series, w)."""
    keys = [*by, *arm, "rule", "refit", "series", "w"]
    arms = weights.select(*arm, "refit").distinct().join(control, "refit")
    return weights.select(*keys).unionByName(arms.select(*keys))


def regime_race(
    placed: DataFrame, schedule: DataFrame, labels: DataFrame, candidates: DataFrame, allowed: DataFrame, control: DataFrame | None = None, by: tuple[str, ...] = (), arm: tuple[str, ...] = (), least: int = 3, bps: float = BPS, adjust=None
) -> DataFrame:
    """``by``, ``arm``, rule, month, refit, gross, turnover, net: the maximin rules refitted and raced, with costs, under every labelling.

    ``adjust`` may change the training means of all arms and refits at once, as an anchored estimator does.
    """
    means = state_means_at_refits(placed, schedule, labels, by, arm, least)
    weights = maximin_weights(candidates, allowed, means if adjust is None else adjust(means), by, arm)
    every = weights if control is None else with_control(weights, control, by, arm)
    return walk_forward(every, placed, schedule, by, bps, arm)


def race_record(race: DataFrame, states: DataFrame, keys: tuple[str, ...], least: int = 3) -> DataFrame:
    """``keys``, metric, value: the yearly Sharpe ratio net of costs, and the realised floor, the worst mean of a real state of ``least`` months.

    Floors are always those of the real ``states``: scrambled labels would grade themselves.
    """
    net = race.withColumn("ret", F.col("net"))
    sharpe = net.groupBy(*keys).agg((F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * F.sqrt(F.lit(12.0))).alias("value")).withColumn("metric", F.lit("sharpe"))
    floor = realised_floor(net, states, keys, least).withColumnRenamed("floor", "value").withColumn("metric", F.lit("floor"))
    return sharpe.select(*keys, "metric", "value").unionByName(floor.select(*keys, "metric", "value"))
