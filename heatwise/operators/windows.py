"""History and within-race features as window columns. A race is a group; an entity has a history of races.

Histories order by (date, race, post), so the order is total, and every frame ends before the current row: nothing leaks. Rows without an
entity have no history; callers keep them apart (`split_null_entities`) lest they all meet in one partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def history(entity: str | Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*([entity] if isinstance(entity, str) else entity)).orderBy(*order)


def prior(w: WindowSpec, n: int | None = None) -> WindowSpec:
    """The n rows before the current one, or all."""
    return w.rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def race(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def split_null_entities(df: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(entity).isNotNull()), df.where(F.col(entity).isNull())


def field_size(given: Column, r: WindowSpec) -> Column:
    return F.coalesce(given, F.count("*").over(r))


def win_label(finish: Column) -> Column:
    return (finish == 1).cast("int")


def finish_pct(finish: Column, size: Column) -> Column:
    return finish / size


def lag1(c: Column, w: WindowSpec) -> Column:
    return F.lag(c, 1).over(w)


def delta_prior(c: Column, w: WindowSpec) -> Column:
    return F.lag(c, 1).over(w) - F.lag(c, 2).over(w)


def ewm_prior(c: Column, w: WindowSpec, alpha: float = 0.4, depth: int = 64, ignore_null: bool = False) -> Column:
    """Exponentially weighted mean of earlier values. A missing value still ages the weights, unless ignore_null.

    The frame is bounded: what lies `depth` rows back weighs (1 - alpha) ** depth.
    """
    values = F.collect_list(F.struct(c.cast("double").alias("v"))).over(prior(w, depth))
    if ignore_null:
        values = F.filter(values, lambda x: x["v"].isNotNull())
    return ewm(values, alpha)


def ewm(values: Column, alpha: float) -> Column:
    """The weighted mean of an array of structs with `v`, oldest first."""
    keep = 1 - alpha
    top = F.aggregate(values, F.lit(0.0), lambda a, x: a * keep + F.coalesce(x["v"], F.lit(0.0)))
    low = F.aggregate(values, F.lit(0.0), lambda a, x: a * keep + F.when(x["v"].isNotNull(), 1.0).otherwise(0.0))
    return F.when(low > 0, top / low)


def with_ewm_prior(df: DataFrame, name: str, c: Column, w: WindowSpec, alpha: float = 0.4) -> DataFrame:
    """df with the exponentially weighted mean of all earlier values; a missing value ages the weights.

    Missing values after the last one age all weights alike, so the mean is that of the row of the last value, however far back. There the own value weighs
    1 and what lies 64 rows back 6e-15 at most (alpha 0.4), so the frame loses nothing that a double could hold.
    """
    depth = math.ceil(math.log(1e-14) / math.log(1 - alpha))
    upto = ewm(F.collect_list(F.struct(c.cast("double").alias("v"))).over(w.rowsBetween(1 - depth, Window.currentRow)), alpha)
    out = df.withColumn(f"_{name}", F.when(c.isNotNull(), upto))
    return out.withColumn(name, F.last(f"_{name}", ignorenulls=True).over(prior(w))).drop(f"_{name}")


def roll_max_prior(c: Column, w: WindowSpec, n: int = 6) -> Column:
    return F.max(c).over(prior(w, n))


def roll_mean_prior(c: Column, w: WindowSpec, n: int = 6) -> Column:
    return F.avg(c).over(prior(w, n))


def n_prior_starts(w: WindowSpec) -> Column:
    return F.row_number().over(w) - 1


def days_since_prev(day: Column, w: WindowSpec) -> Column:
    return F.datediff(day, F.lag(day, 1).over(w))


def field_z(c: Column, r: WindowSpec, least: int = 1) -> Column:
    """Population z-score in the race. Without spread, or with fewer than `least` values, it is 0 for every row."""
    sd = F.stddev_pop(c).over(r)
    flat = sd.isNull() | (sd == 0) | (F.count(c).over(r) < least)
    return F.when(flat, 0.0).otherwise((c - F.avg(c).over(r)) / sd)


def field_z_min2(c: Column, r: WindowSpec) -> Column:
    return field_z(c, r, 2)


def _ranked(keys: Sequence[str], c: Column, descending: bool) -> Column:
    return F.rank().over(Window.partitionBy(*keys).orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last()))


def field_rank(c: Column, keys: Sequence[str], descending: bool = True) -> Column:
    """1 for the best; ties share the least rank; a missing value has none."""
    return F.when(c.isNotNull(), _ranked(keys, c, descending))


def field_pct(c: Column, keys: Sequence[str]) -> Column:
    """Mean rank, lowest first, over the number of values."""
    ties = F.count(c).over(Window.partitionBy(*keys, c))
    return F.when(c.isNotNull(), (_ranked(keys, c, False) + (ties - 1) / 2) / F.count(c).over(Window.partitionBy(*keys)))


def field_delta(c: Column, r: WindowSpec) -> Column:
    return c - F.avg(c).over(r)


def pace_pressure(c: Column, r: WindowSpec) -> Column:
    return F.stddev_samp(c).over(r)


def pace_z(c: Column, r: WindowSpec) -> Column:
    sd = F.stddev_samp(c).over(r)
    return F.when(sd.isNull() | (sd == 0), 0.0).otherwise((c - F.avg(c).over(r)) / sd)


def pace_per_row(q1: Column, q2: Column, distance: Column, beaten_q1: Column, beaten_q2: Column) -> dict[str, Column]:
    return {"first_call_pace": F.try_divide(q1, distance * 0.25), "second_call": q2 - q1, "beaten_change": beaten_q2 - beaten_q1}


def pace_pressure_index(mean_margin: Column, r: WindowSpec, margin: float = 1.5) -> Column:
    return F.sum(F.when(mean_margin <= margin, 1).otherwise(0)).over(r)


def recent_pace_summary(beaten_q1: Column, beaten_q2: Column, final: Column, w: WindowSpec, n: int = 5) -> dict[str, Column]:
    p = prior(w, n)
    return {"mean_margin": F.avg(beaten_q1).over(p), "early_speed": -F.avg(beaten_q1).over(p), "late_kick": F.avg(beaten_q2 - final).over(p), "n_rows": F.count("*").over(p)}


def with_recent_speed(df: DataFrame, c: Column, w: WindowSpec, n: int = 6) -> DataFrame:
    """df with ewm (over the whole history, see with_ewm_prior), best of the last n rows, last, delta and n_figures of earlier rows."""
    out = with_ewm_prior(df, "ewm", c, w)
    return out.withColumns({"best": roll_max_prior(c, w, n), "last": lag1(c, w), "delta": delta_prior(c, w), "n_figures": F.count(c).over(prior(w))})


def modal_value(values: Column, unknown: str = "unknown") -> Column:
    """The most frequent known value of an array that starts with the most recent; of equally frequent ones the most recent."""
    known = F.filter(values, lambda v: v.isNotNull() & (v != unknown))
    scored = F.transform(F.array_distinct(known), lambda v: F.struct(F.size(F.filter(known, lambda x: x == v)).alias("n"), (-F.array_position(known, v)).alias("at"), v.alias("v")))
    return F.array_max(scored)["v"]


def recent(c: Column, w: WindowSpec, n: int) -> Column:
    """The last n values before the row, most recent first, missing ones included."""
    return F.transform(F.reverse(F.collect_list(F.struct(c.alias("v"))).over(prior(w, n))), lambda x: x["v"])


def class_trajectory(claim: Column, purse: Column, kind: Column, w: WindowSpec, n: int = 4) -> dict[str, Column]:
    """Class today against the last n races: claiming prices where today and some of them have one, else purses; and the usual kind of race against today's."""
    p = prior(w, n)
    change = F.when(claim.isNotNull() & F.avg(claim).over(p).isNotNull(), claim - F.avg(claim).over(p)).otherwise(purse - F.avg(purse).over(p))
    usual = modal_value(recent(kind, w, n))
    step = F.when(usual.isNull() | (usual == kind), "same").otherwise(F.concat(usual, F.lit("->"), kind))
    return {"class_change": change, "dropping": F.coalesce(change < 0, F.lit(False)), "type_change": step}


def continuity(rider: Column, won: Column, w: WindowSpec, n: int = 6) -> dict[str, Column]:
    """Today's rider in the last n races: same as last time, rides in a row up to now, rides and share of wins."""
    past = F.reverse(F.collect_list(F.struct(rider.alias("r"), won.alias("y"))).over(prior(w, n)))
    same = F.transform(past, lambda x: F.coalesce(x["r"] == rider, F.lit(False)))
    other = F.array_position(same, F.lit(False)).cast("int")
    mine = F.filter(past, lambda x: x["r"] == rider)
    wins = F.aggregate(mine, F.lit(0.0), lambda a, x: a + F.coalesce(x["y"], F.lit(0)))
    return {
        "same_rider": F.coalesce(F.lag(rider, 1).over(w) == rider, F.lit(False)),
        "streak": F.when(other > 0, other - 1).otherwise(F.size(same)),
        "rides": F.size(mine),
        "win_rate": F.try_divide(wins, F.size(mine)),
    }


def race_softmax(score: Column, r: WindowSpec, temperature: float = 1.0) -> Column:
    e = F.exp((score - F.max(score).over(r)) / temperature)
    return e / F.sum(e).over(r)


def normalise_in_race(c: Column, r: WindowSpec) -> Column:
    return F.try_divide(c, F.sum(c).over(r))


def cusum(df: DataFrame, z: str, key: Sequence[str], order: Sequence[str], k: float = 0.5, h: float = 4.0, two_sided: bool = True) -> DataFrame:
    """Page's sums in closed form: with P the running sum of z - k, S = P - min(0, least P so far). The first alarm is latched; high wins a tie."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(*key)
    out = df.withColumns({"_up": F.sum(F.col(z) - k).over(w), "_down": F.sum(-F.col(z) - k).over(w), "step": F.row_number().over(Window.partitionBy(*key).orderBy(*order))})
    out = out.withColumns({"s_high": F.col("_up") - F.least(F.lit(0.0), F.min("_up").over(w)), "s_low": F.col("_down") - F.least(F.lit(0.0), F.min("_down").over(w)) if two_sided else F.lit(0.0)})
    hit = F.when(F.col("s_high") > h, F.struct("step", F.lit(0).alias("side"))).when(F.col("s_low") > h, F.struct("step", F.lit(1).alias("side")))
    first = F.min(hit).over(everything)
    return out.withColumns({"alarm_step": first["step"], "direction": F.when(first["side"] == 0, "high").when(first["side"] == 1, "low")}).drop("_up", "_down")


def prior_sequence(fields: dict[str, Column], w: WindowSpec, n: int = 30) -> tuple[Column, Column]:
    """The last n tokens before the row, oldest first, and how many places of n are padding."""
    tokens = F.collect_list(F.struct(*[c.alias(k) for k, c in fields.items()])).over(prior(w, n))
    return tokens, n - F.size(tokens)


def plackett_luce_step(chance: Column, p: Column, used: Column) -> Column:
    """Chance of an order so far, times that of the next runner among those left."""
    return chance * F.try_divide(p, 1 - used)
