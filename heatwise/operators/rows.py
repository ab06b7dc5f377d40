"""Mapping, validation, filters, joins, sorts and merges of tables."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pricing, units

#: Tables up to so many rows are broadcast by the joins below.
BROADCAST_ROWS = 500_000

TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    f.__name__: f
    for f in (units.metres_to_furlongs, units.uk_distance_to_furlongs, units.text_distance_to_furlongs, units.kg_to_lbs, units.stones_to_lbs, units.odds_to_decimal, units.sp_to_decimal, units.uk_going_to_condition, units.hk_going_to_condition, units.time_to_seconds, units.clock_to_minutes, units.first_int, units.first_number, units.money, units.coerce_date)
}
COERCE: dict[str, Callable[[Column], Column]] = {"int": units.coerce_int, "double": units.coerce_float, "date": units.coerce_date, "string": units.coerce_str}


#: Rows that a task groups or sorts where their number is known.
TASK_ROWS = 250_000


def dealt(df: DataFrame, n_rows: int, *keys: str) -> DataFrame:
    """df in partitions by keys of about TASK_ROWS of its n_rows rows where shuffles as they are set would make larger ones."""
    n = -(-n_rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def apply_field_map(df: DataFrame, spec: dict[str, dict], keep: Sequence[str] = ()) -> DataFrame:
    """One projection from a spec of canonical field -> {column | const, transform, type}; what is absent becomes NULL."""
    out = [F.col(c) for c in keep]
    for field, s in spec.items():
        if "const" in s:
            c = F.lit(s["const"])
        elif s.get("column") in df.columns:
            c = F.col(s["column"])
        else:
            c = F.lit(None).cast("string")
        if "transform" in s:
            if s["transform"] not in TRANSFORMS:
                raise KeyError(f"no transform {s['transform']!r}; known: {', '.join(sorted(TRANSFORMS))}")
            c = TRANSFORMS[s["transform"]](c)
        kind = s.get("type", "string")
        out.append((COERCE[kind](c.cast("string")) if "transform" not in s else c.cast(kind)).alias(field))
    return df.select(*out)


def resolve_columns(columns: Sequence[str], rules: dict[str, dict]) -> dict[str, str]:
    """Canonical field -> source column, from names alone: exact aliases in order first, then a pattern that must match the whole name, minus a block list. A column serves once."""
    low, used, out = {c.lower().strip(): c for c in columns}, set(), {}
    for field, r in rules.items():
        hit = next((low[a] for a in r.get("aliases", ()) if a in low and low[a] not in used), None)
        if hit:
            out[field] = hit
            used.add(hit)
    for field, r in rules.items():
        if field not in out and r.get("pattern"):
            hit = next((c for k, c in low.items() if c not in used and re.fullmatch(r["pattern"], k) and k not in r.get("blocked", ())), None)
            if hit:
                out[field] = hit
                used.add(hit)
    return out


def split_valid(df: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required fields, and the others with their reasons."""
    reasons = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(f"missing {c}")) for c in required]))
    marked = df.withColumn("reasons", reasons)
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def flatten_result(df: DataFrame, structs: Sequence[str]) -> DataFrame:
    """Fields of nested structs as columns with the struct's name in front."""
    out = []
    for f in df.schema.fields:
        out += [F.col(f"{f.name}.{g}").alias(f"{f.name}_{g}") for g in f.dataType.names] if f.name in structs else [F.col(f.name)]
    return df.select(*out)


def quality_score(df: DataFrame, hard: dict[str, Column], soft: dict[str, tuple[Column, float]]) -> DataFrame:
    """A hard failure scores 0 and only the first is named; else 1 less the penalties of what fails, at least 0, to four places."""
    first = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in hard.items()], F.lit(None).cast("string"))
    failed = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, (bad, _) in soft.items()]))
    lost = sum((F.when(F.coalesce(bad, F.lit(False)), p).otherwise(0.0) for bad, p in soft.values()), F.lit(0.0))
    return df.withColumns({"quality": F.when(first.isNotNull(), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - lost), 4)), "issues": F.when(first.isNotNull(), F.array(first)).otherwise(failed)})


# The columns a result cannot do without, in order of precedence; what the absence of others costs; and ranges: column, least, most, cost.
NEEDED = {"race_date": "race_race_date", "track_code": "race_track_code", "horse_name": "horse_name_normalized", "finish_position": "finish_position", "race_number": "race_race_number", "distance_furlongs": "race_distance_furlongs", "surface": "race_surface", "jurisdiction": "race_jurisdiction"}
WANTED = {"odds": ("odds_final", 0.10), "speed figure": ("speed_figure", 0.10), "jockey": ("jockey_name_normalized", 0.05), "weight": ("weight_lbs", 0.05), "final time": ("fraction_finish_sec", 0.10)}
RANGES = {"finish_position": ("finish_position", 1, 30, 0.15), "odds": ("odds_final", 1, None, 0.15), "distance": ("race_distance_furlongs", 2, 20, 0.20), "weight": ("weight_lbs", 95, 145, 0.10)}


def result_quality(df: DataFrame) -> DataFrame:
    """quality_score() by the default rules for flat results. Columns may be of any type or absent, which counts as missing; a value that is no number is out of its range. A finish position counts by its whole part."""

    def text(name: str) -> Column:
        c = F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")
        return F.when((F.trim(c) != "") & (F.lower(F.trim(c)) != "nan"), F.trim(c))

    def outside(name: str, least: float, most: float | None) -> Column:
        v = units.number(text(name))
        v = F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)) if name == "finish_position" else v
        inside = (v >= least) if most is None else v.between(least, most)
        return text(name).isNotNull() & ~F.coalesce(inside, F.lit(False))

    hard = {f"missing {what}": text(name).isNull() for what, name in NEEDED.items()}
    soft = {f"missing {what}": (text(name).isNull(), cost) for what, (name, cost) in WANTED.items()}
    soft |= {f"implausible {what}": (outside(name, least, most), cost) for what, (name, least, most, cost) in RANGES.items()}
    return quality_score(df, hard, soft)


def accept_reject(df: DataFrame, score: str = "quality", least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(F.col(score) >= least, F.lit(False))
    return df.where(ok), df.where(~ok)


def training_filter(df: DataFrame, score: str, size: str, finish: str, jurisdiction: str, least: float = 0.6, min_field: int = 4, allowed: Sequence[str] = ()) -> DataFrame:
    out = df.where((F.col(score) >= least) & (F.coalesce(F.col(size), F.lit(min_field)) >= min_field) & F.col(finish).isNotNull())
    return out.where(F.col(jurisdiction).isin(*allowed)) if allowed else out


def rolling_window_slice(df: DataFrame, day: str, as_of: dt.date, years: int) -> DataFrame:
    """The years before as_of, which is left out; a 29 February goes back to 28 February."""
    if years <= 0:
        raise ValueError("years must be positive")
    end = F.lit(as_of).cast("date")
    return df.where((F.col(day) >= F.add_months(end, -12 * years)) & (F.col(day) < end))


def odds_cap(df: DataFrame, race: str, odds: str, cap: float, clamp: bool = False) -> DataFrame:
    """Races with usable odds. Odds above the cap are missing, or with clamp the cap itself; a missing price, or one of 1 or less (with clamp: below 1), drops its race."""
    o = F.col(odds)
    new = F.when(o >= 1, F.least(o, F.lit(float(cap)))) if clamp else F.when((o <= cap) & (o > 1), o)
    out = df.withColumn(odds, new)
    return out.withColumn("_ok", F.count(odds).over(Window.partitionBy(race)) == F.count("*").over(Window.partitionBy(race))).where("_ok").drop("_ok")


def column_gate(df: DataFrame, columns: Sequence[str], min_rows: int = 5000, min_share: float = 0.001) -> DataFrame:
    """Per column whether it has enough values to train on."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_values"), F.col("_n").alias("n_rows")) for c in columns]))
    return one.select(stack.alias("s")).select("s.*").withColumn("enough", (F.col("n_values") >= min_rows) & (F.col("n_values") >= min_share * F.col("n_rows")))


def neutral_fallback(df: DataFrame, scores: Sequence[str], market: str, neutral: float = 0.5) -> DataFrame:
    """Missing scores become neutral; a missing market score becomes the mean, with a mark."""
    mean = df.agg(F.avg(market).alias("_mean"))
    out = df.crossJoin(F.broadcast(mean))  # one row
    return out.withColumns({**{c: F.coalesce(F.col(c), F.lit(neutral)) for c in scores}, f"{market}_missing": F.col(market).isNull().cast("int"), market: F.coalesce(F.col(market), F.col("_mean"))}).drop("_mean")


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: str = "sample") -> DataFrame:
    """A share of whole races, alike in every run: by hash of the key, so no race is torn apart."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.where(u < fraction)


# Joins


def merge_bundle(fact: DataFrame, dim: DataFrame, key: str, suffix: str = "_dim") -> DataFrame:
    """Left join; a name that both have gets the suffix on the dimension's side."""
    renamed = dim.select(*[F.col(c).alias(f"{c}{suffix}" if c in fact.columns and c != key else c) for c in dim.columns])
    return fact.join(if_small(renamed), key, "left")


def star_export(results: DataFrame, inner: Sequence[tuple[DataFrame, str]], left: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    out = results
    for dim, key in inner:
        out = out.join(dim, key)
    for dim, key in left:
        out = out.join(dim, key, "left")
    return out


def resolve_keys(rows: DataFrame, dim: DataFrame, key: str, value: str) -> DataFrame:
    return rows.join(dim.select(key, value), key, "left")


def insert_if_absent(new: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The rows to append: one for each key that the table has not."""
    return dedup_first(new, [key], new.columns).join(table.select(key), key, "left_anti")


def hierarchical_lookup(df: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str]]], default: float, name: str = "rate") -> DataFrame:
    """The rate of the first table, in order, that has the row's keys; a rate of 0 is a rate."""
    out, found = df, []
    for i, (t, keys) in enumerate(tables):
        out = out.join(if_small(t.select(*keys, F.col("rate").alias(f"_r{i}"))), list(keys), "left")
        found.append(F.col(f"_r{i}"))
    return out.withColumn(name, F.coalesce(*found, F.lit(default))).drop(*[f"_r{i}" for i in range(len(found))])


def connections_score(df: DataFrame, rates: DataFrame, levels: Mapping[str, Sequence[str]], default: float, name: str = "chance") -> DataFrame:
    """The shrunken rate of the narrowest level (most keys, then as listed) that knows the row's connections; rates has a column level."""
    order = sorted(levels, key=lambda k: -len(levels[k]))
    return hierarchical_lookup(df, [(rates.where(F.col("level") == k).select(*levels[k], "rate"), levels[k]) for k in order], default, name)


def join_features(df: DataFrame, features: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """df with the columns of feature tables that have one row for each key; rows without features keep nulls, and a feature takes the place of a column of its name."""
    out = df
    for t, keys in features:
        out = out.drop(*[x for x in t.columns if x not in keys]).join(if_small(t), list(keys), "left")
    return out


def history_desc(df: DataFrame, entity: str, order: Sequence[str], name: str = "nth") -> DataFrame:
    """df with each row's place in its entity's history, 1 for the most recent."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(entity).orderBy(*[F.desc(x) for x in order])))


def attach_odds(candidates: DataFrame, odds: DataFrame) -> DataFrame:
    return candidates.join(odds, ["race", "bet_type", "selection"])


def ordered_tuples(runners: DataFrame, race: str, runner: str, p: str, k: int) -> DataFrame:
    """All ordered choices of k different runners of a race with their chances: race, selection, chance."""
    one = runners.select(F.col(race).alias("race"), F.col(runner).alias("runner"), F.col(p).alias("p"))
    out = one.select("race", F.array("runner").alias("selection"), F.col("p").alias("used"), F.col("p").alias("chance"))
    for _ in range(k - 1):
        nxt = one.select(F.col("race").alias("_race"), F.col("runner").alias("_runner"), F.col("p").alias("_p"))
        out = out.join(nxt, F.col("race") == F.col("_race")).where(~F.array_contains("selection", F.col("_runner")))
        out = out.select("race", F.concat("selection", F.array("_runner")).alias("selection"), (F.col("used") + F.col("_p")).alias("used"), (F.col("chance") * F.try_divide(F.col("_p"), 1 - F.col("used"))).alias("chance"))
    return out.drop("used")


def prior_history(today: DataFrame, past: DataFrame, entity: str, day: str, keep: Sequence[str], n: int = 10) -> DataFrame:
    """For each row of today the n latest earlier rows of its entity, as an array with the most recent first, empty where there are none.

    The past is reduced to n rows a day, then to n rows up to each day; a row of today takes those of the last day before its own. So no row holds
    more than n of the past, and neither side is joined with the other. Rows of the past without a day are left out.
    """
    fields = F.struct(F.col(day), *[F.col(c) for c in keep])
    on_day = past.where(F.col(day).isNotNull()).groupBy(entity, day).agg(F.slice(F.sort_array(F.collect_list(fields), asc=False), 1, n).alias("_d"))
    last_days = Window.partitionBy(entity).orderBy(day).rowsBetween(1 - n, Window.currentRow)
    known = on_day.select(entity, day, F.slice(F.flatten(F.reverse(F.collect_list("_d").over(last_days))), 1, n).alias("_past"))
    row = F.struct(*[F.col(c) for c in today.columns])
    both = known.withColumn("_row", F.lit(None).cast(today.select(row.alias("r")).schema["r"].dataType))
    both = both.unionByName(today.select(entity, day, F.lit(None).cast(known.schema["_past"].dataType).alias("_past"), row.alias("_row")))
    before = Window.partitionBy(entity).orderBy(F.unix_date(day)).rangeBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("history", F.coalesce(F.last("_past", ignorenulls=True).over(before), F.array().cast(known.schema["_past"].dataType)))
    return out.where("_row IS NOT NULL").select("_row.*", "history")


def join_outcomes(recs: DataFrame, outcomes: DataFrame) -> DataFrame:
    return recs.join(outcomes.select("race", "finishing_order"), "race")


def cross_levels(df: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Each row with each of at most twelve levels."""
    return df.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in risk_grid(levels)])))


def risk_grid(levels: Sequence[float]) -> list[float]:
    out = sorted(set(levels))
    if not 1 <= len(out) <= 12 or not all(0 < x <= 1 for x in out):
        raise ValueError("one to twelve different levels in (0, 1] are needed")
    return out


def expand_scenarios(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("scenario", F.explode(F.sequence(F.lit(1), F.lit(n))))


def skip_registered(sources: DataFrame, registry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sources.join(registry, list(keys), "left_anti")


# Sorts, limits, sets


def export_order(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*columns)


def rank_candidates(df: DataFrame, ev: str = "ev") -> DataFrame:
    """Rank within the race: best value first, then the selection, so that the order is total."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("race").orderBy(F.desc(ev), "bet_type", "selection")))


def first_races(df: DataFrame, race: str, n: int) -> DataFrame:
    keys = df.select(race).distinct().orderBy(race).limit(n)
    return df.join(F.broadcast(keys), race, "left_semi")  # n rows


def report_sample(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top1(df: DataFrame, race: str, score: str, post: str) -> DataFrame:
    return df.groupBy(race).agg(F.max_by(post, F.struct(F.col(score), -F.col(post))).alias("best"), F.max(score).alias("best_score"))


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def merge_star(batch: DataFrame, tables: dict[str, tuple[DataFrame, Sequence[str]]], priority: Column) -> dict[str, DataFrame]:
    """For each table what is to be appended: rows of the batch projected to its columns, the first by priority for each key (its first column), without keys that are there. A second run adds nothing. Rows without a key are skipped."""
    out = {}
    for name, (table, columns) in tables.items():
        key = columns[0]
        new = dedup_first(batch.where(F.col(key).isNotNull()).withColumn("_p", priority), [key], ["_p", *columns[1:]]).select(*columns)
        out[name] = new.join(table.select(key), key, "left_anti")
    return out


def log_outcomes(new: DataFrame, table: DataFrame) -> DataFrame:
    """Outcomes to append: valid orders (not empty, nobody twice), first one for a race, races that are not there; with the first three, -1 where there are fewer."""
    order = F.col("finishing_order")
    ok = new.where((F.size(order) > 0) & (F.size(F.array_distinct(order)) == F.size(order)))
    three = F.slice(F.concat(order, F.array_repeat(F.lit(-1).cast(new.schema["finishing_order"].dataType.elementType), 3)), 1, 3)
    first = dedup_first(ok, ["race"], ["settled_at", F.col("finishing_order")])
    return first.join(table.select("race"), "race", "left_anti").withColumns({"winner": three[0], "second": three[1], "third": three[2]})


def time_split(df: DataFrame, day: str, share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Rows up to and after the date quantile; a date is never torn."""
    at = df.agg(F.percentile(F.unix_date(day), 1 - share).alias("_cut"))
    both = df.crossJoin(F.broadcast(at))  # one row
    return both.where(F.unix_date(day) <= F.col("_cut")).drop("_cut"), both.where(F.unix_date(day) > F.col("_cut")).drop("_cut")


def three_way_time_split(df: DataFrame, day: str, test: float = 0.1, calib: float = 0.1) -> DataFrame:
    """A column `part`: train, calib or test, by two date quantiles."""
    at = df.agg(F.percentile(F.unix_date(day), 1 - test - calib).alias("_a"), F.percentile(F.unix_date(day), 1 - test).alias("_b"))
    d = F.unix_date(day)
    return df.crossJoin(F.broadcast(at)).withColumn("part", F.when(d <= F.col("_a"), "train").when(d <= F.col("_b"), "calib").otherwise("test")).drop("_a", "_b")


def settle_bets(recs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """A bet wins if its selection begins the finishing order; too few finishers lose it. Odds at settlement count where they are given."""
    odds = F.coalesce(F.col("settlement_odds"), F.col("odds")) if "settlement_odds" in recs.columns else F.col("odds")
    out = join_outcomes(recs, outcomes)
    won = (F.size("finishing_order") >= F.size("selection")) & (F.expr("slice(finishing_order, 1, size(selection))") == F.col("selection"))
    out = out.withColumn("won", F.coalesce(won, F.lit(False)))
    payout = F.when(F.col("won"), F.col("stake") * odds).otherwise(0.0)
    return out.withColumns({"payout": payout, "pnl": payout - F.col("stake")})


def pnl_series(settled: DataFrame, at: str, since: Column | None = None) -> DataFrame:
    return (settled if since is None else settled.where(F.col(at) >= since)).orderBy(at, "race", "selection")


def ev_candidates(probs: DataFrame, odds: DataFrame, min_edge: float = 0.05, k: float = 0.25, cap: float = 0.03, takeout: dict[str, float] | None = None) -> DataFrame:
    """Bets worth placing: edge p - 1/odds of at least min_edge, and with a pool still so at the odds after our stake. odds may have `pool`; what the pool keeps goes by bet_type, where takeout has a track's own shares."""
    both = attach_odds(probs, odds)
    pool = F.col("pool") if "pool" in both.columns else F.lit(None).cast("double")
    both = both.withColumn("edge", F.col("p") - 1 / F.col("odds")).where((F.col("odds") > 1) & (F.col("edge") >= min_edge))
    both = both.withColumn("stake", pricing.bet_cap(pricing.kelly_fraction(F.col("edge"), F.col("odds"), k), cap))
    both = both.withColumns({"impact": pool.isNotNull(), "odds": pricing.post_bet_odds(F.col("odds"), F.col("stake") * pool, pool, pricing.takeout_of(F.col("bet_type"), takeout))})
    both = both.withColumn("edge", F.col("p") - 1 / F.col("odds")).where(F.col("edge") >= min_edge)
    return both.withColumns({"ev": pricing.expected_value(F.col("p"), F.col("odds")), "stake": pricing.bet_cap(pricing.kelly_fraction(F.col("edge"), F.col("odds"), k), cap)})


# Orders of finish


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on its parts alone."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def place_show_prob(runners: DataFrame, race: str, runner: str, p: str) -> DataFrame:
    """Chances to finish in the first two and three; in a field too small for a pair or a triple they are 1.

    A field is gathered once, and the sums over who comes before run inside the row: no pairs or triples become rows.
    """
    field = F.array_sort(F.collect_list(F.struct(F.col(runner).alias("r"), F.col(p).alias("p"))))
    races = runners.groupBy(F.col(race).alias("race")).agg(field.alias("_f"))

    def sum_over(others: Column, of) -> Column:
        return F.aggregate(others, F.lit(0.0), lambda a, x: a + of(x))

    def second(me: Column) -> Column:
        return sum_over(F.filter("_f", lambda j: j["r"] != me["r"]), lambda j: j["p"] * F.try_divide(me["p"], 1 - j["p"]))

    def third(me: Column) -> Column:
        others = F.filter("_f", lambda j: j["r"] != me["r"])
        return sum_over(others, lambda j: F.try_divide(j["p"], 1 - j["p"]) * sum_over(F.filter(others, lambda k: k["r"] != j["r"]), lambda k: k["p"] * F.try_divide(me["p"], 1 - j["p"] - k["p"])))

    each = F.transform("_f", lambda me: F.struct(me["r"].alias("runner"), me["p"].alias("p"), second(me).alias("second"), third(me).alias("third")))
    out = races.withColumn("_n", F.size("_f")).select("race", "_n", F.explode(each).alias("e"))
    place = F.when(F.col("_n") < 2, 1.0).otherwise(F.col("e.p") + F.col("e.second"))
    show = F.when(F.col("_n") < 3, 1.0).otherwise(F.col("e.p") + F.col("e.second") + F.col("e.third"))
    return out.select("race", "e.runner", F.coalesce(place, F.lit(1.0)).alias("place"), F.coalesce(show, F.lit(1.0)).alias("show"))


def sample_orders(runners: DataFrame, race: str, runner: str, strength: str, n: int, seed: str = "orders", shape: int = 1, style: str | None = None, rho: float = 0.0) -> DataFrame:
    """race, scenario, runner, rank for n scenarios. Finishing times are gamma with a whole-number shape and the strength as rate: sums of exponentials, shape 1 being Plackett and Luce's model.

    With a style column, runners of a style share a normal factor of weight sqrt(rho); times are exponential then. Draws are hashes of race, runner, scenario
    and seed, so a rerun or another partitioning gives the same orders.
    """
    s = expand_scenarios(runners, n)
    u = lambda *x: uniform(F.lit(seed), F.col(race), F.col("scenario"), *x)
    if style is None:
        draw = sum((-F.log(u(F.col(runner), F.lit(i))) for i in range(shape)), F.lit(0.0))
    else:
        normal = lambda a, b: F.sqrt(-2 * F.log(a)) * F.cos(2 * 3.141592653589793 * b)
        common = normal(u(F.lit("style"), F.col(style), F.lit(0)), u(F.lit("style"), F.col(style), F.lit(1)))
        own = normal(u(F.col(runner), F.lit(0)), u(F.col(runner), F.lit(1)))
        z = (rho**0.5) * common + ((1 - rho) ** 0.5) * own
        draw = -F.log1p(-normal_cdf(z))
    s = s.withColumn("_t", draw / F.col(strength))
    rank = F.row_number().over(Window.partitionBy(race, "scenario").orderBy("_t", runner))
    return s.select(F.col(race).alias("race"), "scenario", F.col(runner).alias("runner"), rank.alias("rank"))


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, within 1.5e-7: an expression, so no row leaves the JVM."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    erf = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)
    return pricing.clip(F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2), 1e-12, 1 - 1e-12)


def finishing_orders(samples: DataFrame, depth: int) -> DataFrame:
    """race, scenario, finishing_order: the first `depth` runners."""
    first = samples.where(F.col("rank") <= depth)
    return first.groupBy("race", "scenario").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "runner"))), lambda x: x["runner"]).alias("finishing_order"))


def tally_topk(orders: DataFrame, k: int, scenarios: int) -> DataFrame:
    """race, selection, share: how often each beginning of k runners came."""
    return orders.groupBy("race", F.slice("finishing_order", 1, k).alias("selection")).agg((F.count("*") / scenarios).alias("share"))
