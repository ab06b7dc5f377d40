"""Scores, reports and rates as aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import log_loss_term
from . import rows


def race_violations(df: DataFrame, keys: Sequence[str], entity: str, finish: str, score: str) -> DataFrame:
    """Races with more than one winner or an entity twice: their rows get score 0 and the reasons. NULL keys group together."""
    winners = F.sum((F.col(finish) == 1).cast("int")).over(Window.partitionBy(*keys))
    per = df.groupBy(*keys, entity).agg(F.count("*").alias("_n")).where("_n > 1")
    per = per.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(entity)), 1, 3).alias("repeated"))
    on = [df[k].eqNullSafe(F.col(f"_{k}")) for k in keys]
    per = per.select(*[F.col(k).alias(f"_{k}") for k in keys], "repeated")
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = df.withColumn("winners", F.coalesce(winners, F.lit(0))).join(per, cond, "left").drop(*[f"_{k}" for k in keys])
    bad = (F.col("winners") > 1) | F.col("repeated").isNotNull()
    return out.withColumns({"violation": bad, score: F.when(bad, 0.0).otherwise(F.col(score))})


# Weights of the checks of a source.
DATASET_WEIGHTS = {"date": 0.15, "track": 0.15, "finish": 0.2, "horse": 0.15, "distance": 0.1, "odds": 0.1, "span": 0.05, "races": 0.05, "duplicates": 0.05}


def dataset_score(df: DataFrame, mapping: dict[str, str], day: str, race: Sequence[str], weights: dict[str, float] = DATASET_WEIGHTS, least: float = 0.7) -> DataFrame:
    """One row: each check, the weighted score and whether it passes. Columns must not be empty, dates span a year, races be 1,000 and full-row duplicates under 5 %."""
    columns = [k for k in weights if k not in ("span", "races", "duplicates")]
    one = df.agg(
        *[(F.count(mapping[k]) > 0).alias(k) if k in mapping else F.lit(False).alias(k) for k in columns],
        (F.datediff(F.max(day), F.min(day)) >= 365).alias("span"),
        (F.count_distinct(F.struct(*race)) >= 1000).alias("races"),
    )
    one = one.crossJoin(duplicate_rate(df).select((F.col("duplicate_rate") < 0.05).alias("duplicates")))  # one row by one row
    score = sum((F.coalesce(F.col(k), F.lit(False)).cast("double") * v for k, v in weights.items()), F.lit(0.0))
    return one.withColumn("score", F.round(score, 4)).withColumn("passed", F.col("score") >= least)


def duplicate_rate(df: DataFrame) -> DataFrame:
    """Share of rows that repeat another in full."""
    each = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return each.agg(F.sum("_n").alias("n_rows"), F.round(1 - F.count("*") / F.sum("_n"), 6).alias("duplicate_rate"))


def jurisdiction_guess(df: DataFrame, track: str, order: Sequence[str], rules: dict[str, str], n: int = 20) -> DataFrame:
    """The first rule that any of the first n tracks matches."""
    head = df.where(F.col(track).isNotNull()).orderBy(*order).select(track).limit(n)
    seen = head.agg(*[F.bool_or(F.col(track).rlike(p)).alias(k) for k, p in rules.items()])
    out = None
    for k in rules:
        out = F.when(F.col(k), k) if out is None else out.when(F.col(k), k)
    return seen.select(F.coalesce(out, F.lit("unknown")).alias("jurisdiction"))


def dedup_report(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"), (F.count(key) - F.count_distinct(key)).alias("leaked"))


def quality_histogram(df: DataFrame, score: str) -> DataFrame:
    s = F.col(score)
    part = lambda a, b: F.sum(F.when((s >= a) & (s < b), 1).otherwise(0))
    return df.agg(F.count(s).alias("n"), F.round(F.avg(s), 6).alias("mean"), F.min(s).alias("least"), F.max(s).alias("most"), part(0, 0.6).alias("below_60"), part(0.6, 0.8).alias("to_80"), part(0.8, 0.9).alias("to_90"), part(0.9, 9).alias("from_90"))


def audit_rollup(new: DataFrame, old_keys: DataFrame, key: str, source: str, day: str, rejected: str) -> DataFrame:
    """Per source: rows in, rejected, already there, added, and the dates they span. Counts are of the source's own rows."""
    known = old_keys.select(F.col(key).alias("_key")).distinct().withColumn("_old", F.lit(True))
    rows = new.join(known, new[key] == F.col("_key"), "left")
    out, old = F.col(rejected), F.coalesce(F.col("_old"), F.lit(False))
    return rows.groupBy(source).agg(F.count("*").alias("n_in"), F.sum(out.cast("int")).alias("n_rejected"), F.sum((~out & old).cast("int")).alias("n_known"), F.sum((~out & ~old).cast("int")).alias("n_added"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def tracks_from_races(df: DataFrame, track: str, jurisdiction: str, surface: str) -> DataFrame:
    return df.groupBy(track, jurisdiction).agg(F.array_sort(F.collect_set(F.coalesce(F.col(surface), F.lit("unknown")))).alias("surfaces"))


def export_summary(df: DataFrame, by: str, day: str, horse: str, race: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n_rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count_distinct(horse).alias("n_horses"), F.count_distinct(race).alias("n_races"))


#: Fewest starts of a rate of its own, by level.
MIN_STARTS = {"jockey": 10, "trainer": 10, "pair": 5}


def empirical_bayes_rates(df: DataFrame, levels: dict[str, Sequence[str]], label: str, alpha: float = 30.0, min_starts: dict[str, int] = MIN_STARTS, n_rows: int | None = None) -> DataFrame:
    """Shrunk rates (wins + alpha * prior) / (starts + alpha) at each level. The first level is the prior of the others and must be among their keys' tables.

    Rows are grouped once by all keys, and those groups by each level's, in partitions of bounded rows (n_rows: how many df has; counted if not given).
    Result: level, its keys (others NULL), starts, wins, rate.
    """
    first = next(iter(levels))
    keys = list(dict.fromkeys(k for cols in levels.values() for k in cols))
    base = list(levels[first])
    n_rows = df.count() if n_rows is None else n_rows
    one = rows.dealt(df.select(*keys, F.col(label).alias("_y")), n_rows, *keys)
    finest = one.groupBy(*keys).agg(F.count("_y").alias("starts"), F.sum("_y").alias("wins"))

    def at(level: str) -> DataFrame:
        s = list(dict.fromkeys([*base, *levels[level]]))
        # The prior has few groups, so tasks add up their own first; of the others a task would hold more with each row.
        groups = finest if len(s) == len(keys) else (finest if level == first else rows.dealt(finest, n_rows, *s)).groupBy(*s).agg(F.coalesce(F.sum("starts"), F.lit(0)).alias("starts"), F.sum("wins").alias("wins"))
        return groups.select(F.lit(level).alias("level"), *[F.col(k) if k in s else F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys], "starts", "wins")

    agg = reduce(DataFrame.unionByName, [at(level) for level in levels])
    prior = at(first).select(*[F.col(b).alias(f"_{b}") for b in base], (F.col("wins") / F.col("starts")).alias("_prior"))
    on = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in base]
    out = agg.join(prior, on, "left").drop(*[f"_{b}" for b in base])
    least = F.create_map(*[F.lit(x) for kv in min_starts.items() for x in kv])[F.col("level")]
    rate = F.when(F.col("level") == first, F.col("_prior")).otherwise((F.col("wins") + alpha * F.col("_prior")) / (F.col("starts") + alpha))
    return out.where(least.isNull() | (F.col("starts") >= least)).select("level", *keys, "starts", "wins", rate.alias("rate"))


def calibration_bin(p: Column, bins: int = 15) -> Column:
    """Equal widths; a value on an edge goes up, 1 into the last."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def reliability_bins(df: DataFrame, p: str, y: str, bins: int = 15) -> DataFrame:
    """A row per bin, empty ones included."""
    each = df.groupBy(calibration_bin(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(each, "bin", "left").select("bin", (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"), F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "mean_y")


def ece(df: DataFrame, p: str, y: str, bins: int = 15) -> DataFrame:
    each = df.groupBy(calibration_bin(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg(p) - F.avg(y)).alias("gap"))
    return each.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss(p: Column, y: Column) -> Column:
    return F.avg(log_loss_term(p, y))


def auc(df: DataFrame, p: str, y: str) -> DataFrame:
    """Rank statistic over distinct scores with their counts: ties count half. NULL if there is one class only.

    Scores are counted first and summed up by ranges of 1/4096 of [0, 1], so no window runs over rows.
    """
    each = df.groupBy(F.col(p).alias("p")).agg(F.sum(F.col(y)).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    each = each.withColumn("range", F.floor(F.col("p") * 4096))
    ranges = each.groupBy("range").agg(F.sum("neg").alias("neg"))
    before = ranges.select("range", F.coalesce(F.sum("neg").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("range").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("inside", inside).join(F.broadcast(before), "range")  # 4,097 rows at most for probabilities
    s = each.agg(F.sum(F.col("pos") * (F.col("below") + F.col("inside") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return s.select(F.try_divide(F.col("u"), F.col("pos") * F.col("neg")).alias("auc"))


def race_top1_accuracy(df: DataFrame, race: str, score: str, label: str, post: str) -> DataFrame:
    """Share of races with a winner whose best score won; of equal scores the least post counts."""
    best = df.groupBy(race).agg(F.max_by(label, F.struct(F.col(score), -F.col(post))).alias("hit"), F.max(label).alias("won"))
    return best.where("won = 1").agg(F.count("*").alias("n_races"), F.avg("hit").alias("top1"))


def backtest_summary(candidates: DataFrame, by: str = "bet_type") -> DataFrame:
    return candidates.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct("race").alias("n_races"), F.avg("edge").alias("mean_edge"), F.sum("edge").alias("sum_edge"), F.avg("ev").alias("mean_ev"), F.sum("ev").alias("sum_ev"))


def card_rollup(portfolios: DataFrame, card: str) -> DataFrame:
    """Per card: recommendations, sum of returns, stake up to 1, and the largest risk."""
    return portfolios.groupBy(card).agg(F.array_sort(F.flatten(F.collect_list("bets"))).alias("bets"), F.sum("expected_return").alias("expected_return"), F.least(F.lit(1.0), F.sum("stake")).alias("stake"), F.max("var").alias("var"), F.max("cvar").alias("cvar"))


def parse_confidence(entries: DataFrame, race: Sequence[str], header: Sequence[str], n_history: str) -> DataFrame:
    """Per race: 0.4 * share of header fields that are there + 0.6 * share of entries with a history."""
    head = sum((F.max(F.col(h).isNotNull().cast("int")) for h in header), F.lit(0)) / len(header)
    return entries.groupBy(*race).agg((0.4 * head + 0.6 * F.avg((F.col(n_history) > 0).cast("int"))).alias("confidence"))


def var_cvar(df: DataFrame, keys: Sequence[str], pnl: str, alpha: float = 0.05, approximate: bool = False, refine: bool = False) -> DataFrame:
    """Value at risk, -quantile(pnl, alpha), and the mean of losses at least as large. refine finds the same quantile in several passes, for keys with more different values than a task holds."""
    if refine:
        from .quantiles import exact_quantile

        cut = exact_quantile(df, keys, pnl, alpha).withColumnRenamed("quantile", "_q")
    else:
        cut = df.groupBy(*keys).agg((F.percentile_approx(pnl, alpha, 10_000) if approximate else F.percentile(pnl, alpha)).alias("_q"))
    tail = df.join(cut, list(keys)).where(F.col(pnl) <= F.col("_q") + 1e-9)  # an interpolated quantile may miss the value it stands for by rounding
    return tail.groupBy(*keys).agg((-F.max("_q")).alias("var"), (-F.avg(pnl)).alias("cvar"))


def fit_scaler(tokens: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and deviation of each column over tokens; a deviation up to 1e-6 counts as 1."""
    stats = [F.avg(c).alias(f"{c}_mean") for c in columns] + [F.when(F.stddev_pop(c) > 1e-6, F.stddev_pop(c)).otherwise(1.0).alias(f"{c}_sd") for c in columns]
    return tokens.agg(*stats)


def apply_scaler(tokens: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = tokens.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd") for c in columns}).drop(*stats.columns)


def residual_fit(df: DataFrame, anchor: str, columns: Sequence[str]) -> DataFrame:
    """Slope, intercept and mean of each score on the anchor, missing scores at their mean; one row. They stay as fitted."""
    mean = df.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns])
    full = df.crossJoin(F.broadcast(mean)).withColumns({c: F.coalesce(F.col(c), F.col(f"{c}_mean")) for c in columns})
    return full.agg(*[f(F.col(c), F.col(anchor)).alias(f"{c}_{n}") for c in columns for n, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept))], *[F.first(f"{c}_mean").alias(f"{c}_mean") for c in columns])


def residuals(df: DataFrame, fit: DataFrame, anchor: str, columns: Sequence[str]) -> DataFrame:
    out = df.crossJoin(F.broadcast(fit))
    left = {f"{c}_residual": F.coalesce(F.coalesce(F.col(c), F.col(f"{c}_mean")) - (F.col(f"{c}_slope") * F.col(anchor) + F.col(f"{c}_intercept")), F.lit(0.0)) for c in columns}
    return out.withColumns(left).drop(*fit.columns)


def status_counts(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def card_identity(races: DataFrame, card: str, number: str, day: str, track: str) -> DataFrame:
    """The first known date and track of a card, in order of races."""
    return races.groupBy(card).agg(F.min_by(day, F.when(F.col(day).isNotNull(), F.col(number))).alias("card_date"), F.min_by(track, F.when(F.col(track).isNotNull(), F.col(number))).alias("card_track"))


def drift_report(steps: DataFrame, keys: Sequence[str], z: str) -> DataFrame:
    """Over the rows of cusum: how many, the alarm, where and which way, final and largest sums, mean residual."""
    last = lambda c: F.max_by(c, "step")
    return steps.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.col("alarm_step").isNotNull()).alias("alarm"), F.max("alarm_step").alias("alarm_step"), F.max("direction").alias("direction"), last("s_high").alias("final_high"), last("s_low").alias("final_low"), F.max("s_high").alias("max_high"), F.max("s_low").alias("max_low"), F.avg(z).alias("mean_z"))
