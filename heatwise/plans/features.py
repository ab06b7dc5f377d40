"""Window operators over the contest view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scans
from ..operators import windows as W
from .base import HIST, RUN, query, r6, runners

KEY = ["race", "post"]


def _ready() -> None:
    """Windows and shared columns: they need a session, so they are made when the first query runs."""
    global H, R, PACE, RECENT, CLASS, CONT, SEQ
    H = W.history("entity", ["day", "race", "post"])
    R = W.race("race")
    PACE = W.pace_per_row(c("q"), c("q") + c("tax"), c("disc"), c("tax"), c("disc"))
    RECENT = W.recent_pace_summary(c("tax"), c("disc"), c("tax"), H)
    CLASS = W.class_trajectory(c("claim"), c("purse"), c("kind"), H)
    CONT = W.continuity(c("jockey"), c("win"), H)
    SEQ = W.prior_sequence({"figure": c("figure"), "finish": c("finish"), "gap": c("odds")}, H)


def _over(name: str, columns, select_sql: str, tail: str = "", prepare=lambda df: df):
    """Register a query that shows columns over the runners, with its SQL."""

    @query(name, f"{RUN}{tail} SELECT race, post, {select_sql} FROM run")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _ready()
        return prepare(runners(spark, sf_dir)).select(*KEY, *[v.alias(k) for k, v in columns().items()])

    return run


def weighted(df: DataFrame) -> DataFrame:
    return W.with_ewm_prior(df, "weighted", F.col("figure"), H)


def recent_speed(df: DataFrame) -> DataFrame:
    return W.with_recent_speed(df, F.col("figure"), H)


c = F.col
_over("W01_field_size", lambda: {"field_size": W.field_size(F.when(c("race") % 2 == 0, 5), R).cast("long")}, "coalesce(CASE WHEN race % 2 = 0 THEN 5 END, count(*) OVER (PARTITION BY race)) AS field_size")
_over("W02_labels", lambda: {"y": W.win_label(c("finish")), "finish_pct": F.round(W.finish_pct(c("finish"), F.count("*").over(R)), 6)}, "CASE WHEN finish = 1 THEN 1 ELSE 0 END AS y, round(finish / count(*) OVER (PARTITION BY race), 6) AS finish_pct")
_over("W03_lag_delta", lambda: {"last": W.lag1(c("figure"), H), "delta": W.delta_prior(c("figure"), H)}, f"lag(figure) OVER ({HIST}) AS last, lag(figure) OVER ({HIST}) - lag(figure, 2) OVER ({HIST}) AS delta")
_over(
    "W04_ewm_prior", lambda: {"ewm": F.round("weighted", 6)},
    f"""round(list_reduce(list_prepend(0e0, list_transform(list(figure) OVER p, lambda x: coalesce(x, 0e0))), lambda a, x: a * 0.6 + x)
 / nullif(list_reduce(list_prepend(0e0, list_transform(list(figure) OVER p, lambda x: CASE WHEN x IS NULL THEN 0e0 ELSE 1e0 END)), lambda a, x: a * 0.6 + x), 0), 6) AS ewm""",
    prepare=weighted,
)
_over("W05_roll_prior", lambda: {"best": W.roll_max_prior(c("figure"), H), "mean": F.round(W.roll_mean_prior(c("figure"), H), 6)}, f"max(figure) OVER p AS best, round(avg(figure) OVER p, 6) AS mean")
_over("W06_prior_starts", lambda: {"n_prior": W.n_prior_starts(H).cast("long")}, f"row_number() OVER ({HIST}) - 1 AS n_prior")
_over("W07_days_since", lambda: {"gap": W.days_since_prev(c("day"), H).cast("long")}, f"date_diff('day', lag(day) OVER ({HIST}), day) AS gap")
Z = "CASE WHEN coalesce(stddev_pop(figure) OVER r, 0) = 0 {more} THEN 0 ELSE round((figure - avg(figure) OVER r) / stddev_pop(figure) OVER r, 6) END"
_over("W08_field_z", lambda: {"z": F.round(W.field_z(c("figure"), R), 6)}, Z.format(more="") + " AS z")
_over("W09_field_z_min2", lambda: {"z": F.round(W.field_z_min2(c("figure"), R), 6)}, Z.format(more="OR count(figure) OVER r < 2") + " AS z")
_over("W10_field_rank", lambda: {"best": W.field_rank(c("figure"), ["race"]).cast("long"), "least": W.field_rank(c("figure"), ["race"], False).cast("long")}, "CASE WHEN figure IS NOT NULL THEN rank() OVER (PARTITION BY race ORDER BY figure DESC NULLS LAST) END AS best, CASE WHEN figure IS NOT NULL THEN rank() OVER (PARTITION BY race ORDER BY figure NULLS LAST) END AS least")
_over("W11_field_pct", lambda: {"pct": F.round(W.field_pct(c("figure"), ["race"]), 6)}, "CASE WHEN figure IS NOT NULL THEN round((rank() OVER (PARTITION BY race ORDER BY figure NULLS LAST) + (count(figure) OVER (PARTITION BY race, figure) - 1) / 2) / count(figure) OVER (PARTITION BY race), 6) END AS pct")
_over("W12_field_delta", lambda: {"delta": F.round(W.field_delta(c("figure"), R), 6)}, "round(figure - avg(figure) OVER r, 6) AS delta")
_over("W13_pace_pressure", lambda: {"pressure": F.round(W.pace_pressure(c("q"), R), 6), "z": F.round(W.pace_z(c("q"), R), 6)}, "round(stddev_samp(q) OVER r, 6) AS pressure, CASE WHEN coalesce(stddev_samp(q) OVER r, 0) = 0 THEN 0 ELSE round((q - avg(q) OVER r) / stddev_samp(q) OVER r, 6) END AS z")
_over("W14_pace_per_row", lambda: {k: F.round(v, 6) for k, v in PACE.items()}, "CASE WHEN disc = 0 THEN NULL ELSE round(q / (disc * 0.25), 6) END AS first_call_pace, round((q + tax) - q, 6) AS second_call, round(disc - tax, 6) AS beaten_change")
_over("W15_pressure_index", lambda: {"n_front": W.pace_pressure_index(c("tax") * 20, R).cast("long")}, "CAST(sum(CASE WHEN tax * 20 <= 1.5 THEN 1 ELSE 0 END) OVER r AS BIGINT) AS n_front")
_over("W16_recent_pace", lambda: {k: F.round(v, 6) if k != "n_rows" else v for k, v in RECENT.items()}, "round(avg(tax) OVER p5, 6) AS mean_margin, round(-avg(tax) OVER p5, 6) AS early_speed, round(avg(disc - tax) OVER p5, 6) AS late_kick, count(*) OVER p5 AS n_rows")
_over("W17_recent_speed", lambda: {"ewm": F.round("ewm", 6)} | {k: c(k) for k in ("best", "last", "delta", "n_figures")}, f"""round(list_reduce(list_prepend(0e0, list_transform(list(figure) OVER p, lambda x: coalesce(x, 0e0))), lambda a, x: a * 0.6 + x)
 / nullif(list_reduce(list_prepend(0e0, list_transform(list(figure) OVER p, lambda x: CASE WHEN x IS NULL THEN 0e0 ELSE 1e0 END)), lambda a, x: a * 0.6 + x), 0), 6) AS ewm,
 max(figure) OVER (HISTORY ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS best, lag(figure) OVER ({HIST}) AS last, lag(figure) OVER ({HIST}) - lag(figure, 2) OVER ({HIST}) AS delta, count(figure) OVER (HISTORY ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_figures""", prepare=recent_speed)
_over(
    "W18_class_trajectory", lambda: {"class_change": F.round(CLASS["class_change"], 4), "dropping": CLASS["dropping"], "type_change": CLASS["type_change"]},
    """round(CASE WHEN claim IS NOT NULL AND avg(claim) OVER p4 IS NOT NULL THEN claim - avg(claim) OVER p4 ELSE purse - avg(purse) OVER p4 END, 4) AS class_change,
 coalesce(CASE WHEN claim IS NOT NULL AND avg(claim) OVER p4 IS NOT NULL THEN claim - avg(claim) OVER p4 ELSE purse - avg(purse) OVER p4 END < 0, false) AS dropping,
 CASE WHEN usual IS NULL OR usual = kind THEN 'same' ELSE usual || '->' || kind END AS type_change""",
    """, hist AS (SELECT *, list(CASE WHEN kind <> 'unknown' THEN kind END) OVER (PARTITION BY entity ORDER BY day, race, post ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS ks FROM run),
 run2 AS (SELECT *, list_reverse(list_filter(ks, lambda x: x IS NOT NULL)) AS kn FROM hist),
 run3 AS (SELECT *, list_sort(list_transform(list_distinct(kn), lambda v: {'n': len(list_filter(kn, lambda x: x = v)), 'a': -list_position(kn, v), 'v': v}), 'DESC')[1].v AS usual FROM run2)""",
)
_over(
    "W19_continuity", lambda: {"same_rider": CONT["same_rider"], "streak": CONT["streak"].cast("long"), "rides": CONT["rides"].cast("long"), "win_rate": F.round(CONT["win_rate"], 6)},
    f"""coalesce(lag(jockey) OVER ({HIST}) = jockey, false) AS same_rider,
 CASE WHEN past IS NULL THEN 0 WHEN list_position(list_transform(past, lambda x: x.r = jockey), false) > 0 THEN list_position(list_transform(past, lambda x: x.r = jockey), false) - 1 ELSE len(past) END AS streak,
 coalesce(len(list_filter(past, lambda x: x.r = jockey)), 0) AS rides,
 CASE WHEN len(list_filter(past, lambda x: x.r = jockey)) > 0 THEN round(len(list_filter(past, lambda x: x.r = jockey AND x.y = 1)) / len(list_filter(past, lambda x: x.r = jockey)), 6) END AS win_rate""",
    """, run2 AS (SELECT *, list_reverse(list({'r': jockey, 'y': win}) OVER (PARTITION BY entity ORDER BY day, race, post ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)) AS past FROM run)""",
)
_over("W20_race_softmax", lambda: {"p": F.round(W.race_softmax(c("q") / 10, R), 6)}, "round(exp(q / 10 - max(q / 10) OVER r) / sum(exp(q / 10 - 0)) OVER r * exp(max(q / 10) OVER r), 6) AS p")
_over("W21_normalise", lambda: {"p": F.round(W.normalise_in_race(1 / c("odds"), R), 6)}, "round((1 / odds) / sum(1 / odds) OVER r, 6) AS p")
_over("W23_prior_sequence", lambda: {"n_tokens": F.size(SEQ[0]).cast("long"), "padding": SEQ[1].cast("long"), "oldest": F.get(SEQ[0], 0)["finish"].cast("long"), "newest": F.get(SEQ[0], F.size(SEQ[0]) - 1)["finish"].cast("long")}, "count(*) OVER p30 AS n_tokens, 30 - count(*) OVER p30 AS padding, first_value(finish) OVER p30 AS oldest, lag(finish) OVER (PARTITION BY entity ORDER BY day, race, post) AS newest")


def _finish() -> None:
    """Frames of the SQL twins by their short names."""
    from .base import SQL

    for name, sql in SQL.items():
        if not name.startswith("W"):
            continue
        depth = 6 if name == "W05_roll_prior" else "UNBOUNDED"
        h = "PARTITION BY entity ORDER BY day, race, post"
        source = "run3" if "run3 AS" in sql else "run2" if "run2 AS" in sql else "run"
        sql = sql.replace("HISTORY ROWS", f"{h} ROWS")
        if sql.endswith(" FROM run"):
            sql = sql[: -len(" FROM run")] + f" FROM {source} WINDOW r AS (PARTITION BY race), p AS ({h} ROWS BETWEEN {depth} PRECEDING AND 1 PRECEDING), p4 AS ({h} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), p5 AS ({h} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), p30 AS ({h} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"
        SQL[name] = sql


_finish()


def events_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .base import table

    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", ((F.col("value") - 50) / 25).alias("z"))


@query(
    "W22_cusum",
    """WITH e AS (SELECT event_id, user_id, ts, (value - 50) / 25 AS z FROM events),
 s AS (SELECT *, row_number() OVER w AS step, sum(z - 0.5) OVER w AS up, sum(-z - 0.5) OVER w AS down FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 t AS (SELECT *, up - least(0, min(up) OVER w) AS hi, down - least(0, min(down) OVER w) AS lo FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 a AS (SELECT user_id, min(step * 2 + CASE WHEN hi > 4 THEN 0 ELSE 1 END) AS f FROM t WHERE hi > 4 OR lo > 4 GROUP BY user_id)
 SELECT event_id, step, round(hi, 6) AS s_high, round(lo, 6) AS s_low, f // 2 AS alarm_step, CASE WHEN f % 2 = 0 THEN 'high' WHEN f % 2 = 1 THEN 'low' END AS direction FROM t LEFT JOIN a USING (user_id)""",
)
def w22(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.cusum(events_z(spark, sf_dir), "z", ["user_id"], ["ts", "event_id"])
    return out.select("event_id", c("step").cast("long"), r6(c("s_high"), "s_high"), r6(c("s_low"), "s_low"), c("alarm_step").cast("long"), "direction")


ONE = """WITH e AS (SELECT event_id, ts, (value - 50) / 25 AS z FROM events),
 s AS (SELECT *, row_number() OVER w AS step, sum(z - 0.5) OVER w AS up, sum(-z - 0.5) OVER w AS down FROM e WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 t AS (SELECT *, up - least(0, min(up) OVER w) AS hi, down - least(0, min(down) OVER w) AS lo FROM s WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 a AS (SELECT min(step * 2 + CASE WHEN hi > 4 THEN 0 ELSE 1 END) AS f FROM t WHERE hi > 4 OR lo > 4)
 SELECT event_id, step, round(hi, 6) AS s_high, round(lo, 6) AS s_low, f // 2 AS alarm_step, CASE WHEN f % 2 = 0 THEN 'high' WHEN f % 2 = 1 THEN 'low' END AS direction FROM t, a"""


@query("W22_cusum_one_stream", ONE)
def w22_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one stream, which no task holds as a whole."""
    out = scans.cusum_ranges(events_z(spark, sf_dir), "z", [], ["ts", "event_id"])
    return out.select("event_id", "step", r6(c("s_high"), "s_high"), r6(c("s_low"), "s_low"), "alarm_step", "direction")


@query(
    "W24_plackett_luce_step",
    f"""{RUN}, p AS (SELECT race, post, q, q / sum(q) OVER (PARTITION BY race) AS p, coalesce(sum(q) OVER (PARTITION BY race ORDER BY post ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(q) OVER (PARTITION BY race) AS used FROM run)
 SELECT race, post, round(CASE WHEN 1 - used <> 0 THEN p / (1 - used) END, 6) AS chance FROM p""",
)
def w24(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum("q").over(W.race("race"))
    used = F.coalesce(F.sum("q").over(Window.partitionBy("race").orderBy("post").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / total
    return runners(spark, sf_dir).select(*KEY, r6(W.plackett_luce_step(F.lit(1.0), F.col("q") / total, used), "chance"))
