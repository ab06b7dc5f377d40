"""Table operators over the contest view, each with its SQL twin."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import outcomes as X
from ..operators import rows as O
from ..operators import windows as W
from .base import RUN, SQL, query, r6, runners, table

c = F.col
SCORED = f"{RUN}, sc AS (SELECT *, exp(q / 10 - 5) / sum(exp(q / 10 - 5)) OVER (PARTITION BY race) AS p FROM run)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runners(spark, sf_dir).withColumn("p", W.race_softmax(c("q") / 10, W.race("race")))


# Aggregates


@query("A01_race_violations", f"""{RUN}, v AS (SELECT race, post, entity, CASE WHEN finish <= 1 + (race % 7 = 0)::INT THEN 1 ELSE 2 END AS f FROM run),
 d AS (SELECT race, count(*) AS k FROM (SELECT race, entity FROM v GROUP BY race, entity HAVING count(*) > 1) GROUP BY race)
 SELECT v.race, post, CAST(sum(CASE WHEN f = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY v.race) AS BIGINT) AS winners, (sum(CASE WHEN f = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY v.race) > 1 OR k IS NOT NULL) AS violation,
 CASE WHEN sum(CASE WHEN f = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY v.race) > 1 OR k IS NOT NULL THEN 0e0 ELSE 1e0 END AS score FROM v LEFT JOIN d USING (race)""")
def a01(spark, sf_dir):
    r = runners(spark, sf_dir).select("race", "post", "entity", F.when(c("finish") <= 1 + (c("race") % 7 == 0).cast("int"), 1).otherwise(2).alias("f"), F.lit(1.0).alias("score"))
    return A.race_violations(r, ["race"], "entity", "f", "score").select("race", "post", "winners", "violation", "score")


MAPPED = {"horse": "entity", "track": "track", "date": "day", "finish": "finish", "distance": "q", "odds": "odds"}


@query("A02_dataset_score", f"""{RUN}, s AS (SELECT date_diff('day', min(day), max(day)) >= 365 AS span, count(DISTINCT race) >= 1000 AS races FROM run),
 d AS (SELECT 1 - count(*) / sum(n) < 0.05 AS dup FROM (SELECT entity, track, day, finish, q, odds, race, count(*) AS n FROM run GROUP BY ALL))
 SELECT span, races, dup AS duplicates, round(0.85 + span::INT * 0.05 + races::INT * 0.05 + dup::INT * 0.05, 4)::DOUBLE AS score, 0.85 + span::INT * 0.05 + races::INT * 0.05 + dup::INT * 0.05 >= 0.7 AS passed FROM s, d""")
def a02(spark, sf_dir):
    r = runners(spark, sf_dir).select("entity", "track", "day", "finish", "q", "odds", "race")
    return A.dataset_score(r, MAPPED, "day", ["race"]).select("span", "races", "duplicates", "score", "passed")


@query("A03_jurisdiction_guess", "SELECT CASE WHEN bool_or(regexp_matches(n_name, '^A')) THEN 'a' WHEN bool_or(regexp_matches(n_name, '^U')) THEN 'u' ELSE 'unknown' END AS jurisdiction FROM (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 20)")
def a03(spark, sf_dir):
    return A.jurisdiction_guess(table(spark, sf_dir, "nation"), "n_name", ["n_nationkey"], {"a": "^A", "u": "^U"})


@query("A04_dedup_report", "SELECT count(*) AS n_rows, count(DISTINCT l_partkey) AS n_keys, count(l_partkey) - count(DISTINCT l_partkey) AS leaked FROM lineitem")
def a04(spark, sf_dir):
    return A.dedup_report(table(spark, sf_dir, "lineitem"), "l_partkey")


@query("A05_quality_histogram", "SELECT count(s) AS n, round(avg(s), 6) AS mean, min(s) AS least, max(s) AS most, sum((s < 0.6)::INT)::BIGINT AS below_60, sum((s >= 0.6 AND s < 0.8)::INT)::BIGINT AS to_80, sum((s >= 0.8 AND s < 0.9)::INT)::BIGINT AS to_90, sum((s >= 0.9)::INT)::BIGINT AS from_90 FROM (SELECT l_quantity / 50 AS s FROM lineitem)")
def a05(spark, sf_dir):
    return A.quality_histogram(table(spark, sf_dir, "lineitem").select((c("l_quantity") / 50).alias("s")), "s")


@query("A06_audit_rollup", f"""{RUN}, o AS (SELECT DISTINCT entity FROM run WHERE day < DATE '1995-06-01')
 SELECT track, count(*) AS n_in, sum((q > 45)::INT)::BIGINT AS n_rejected, sum((q <= 45 AND o.entity IS NOT NULL)::INT)::BIGINT AS n_known, sum((q <= 45 AND o.entity IS NULL)::INT)::BIGINT AS n_added, min(day) AS first_day, max(day) AS last_day FROM run LEFT JOIN o USING (entity) GROUP BY track""")
def a06(spark, sf_dir):
    r = runners(spark, sf_dir)
    return A.audit_rollup(r.withColumn("bad", c("q") > 45), r.where("day < DATE '1995-06-01'"), "entity", "track", "day", "bad")


@query("A07_tracks", "SELECT o_orderpriority AS track, o_orderstatus AS jurisdiction, list_sort(list(DISTINCT l_linestatus)) AS surfaces FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def a07(spark, sf_dir):
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    r = line.join(orders, c("l_orderkey") == c("o_orderkey")).select(c("o_orderpriority").alias("track"), c("o_orderstatus").alias("jurisdiction"), "l_linestatus")
    return A.tracks_from_races(r, "track", "jurisdiction", "l_linestatus")


@query("A08_export_summary", f"{RUN} SELECT track, count(*) AS n_rows, min(day) AS first_day, max(day) AS last_day, count(DISTINCT entity) AS n_horses, count(DISTINCT race) AS n_races FROM run GROUP BY track")
def a08(spark, sf_dir):
    return A.export_summary(runners(spark, sf_dir), "track", "day", "entity", "race")


LEVELS = {"jurisdiction": ["track"], "jockey": ["track", "jockey"], "trainer": ["track", "trainer"], "pair": ["track", "jockey", "trainer"]}


@query("A09_empirical_bayes", f"""{RUN}, b AS (SELECT track, count(*) AS n, sum(win) AS w FROM run GROUP BY track),
 a AS (SELECT 'jurisdiction' AS level, track, NULL::BIGINT AS jockey, NULL::BIGINT AS trainer, n AS starts, w AS wins FROM b
 UNION ALL SELECT 'jockey', track, jockey, NULL, count(*), sum(win) FROM run GROUP BY track, jockey HAVING count(*) >= 10
 UNION ALL SELECT 'trainer', track, NULL, trainer, count(*), sum(win) FROM run GROUP BY track, trainer HAVING count(*) >= 10
 UNION ALL SELECT 'pair', track, jockey, trainer, count(*), sum(win) FROM run GROUP BY track, jockey, trainer HAVING count(*) >= 5)
 SELECT level, track, jockey, trainer, starts, wins::BIGINT AS wins, round(CASE WHEN level = 'jurisdiction' THEN w / n ELSE (wins + 30 * (w / n)) / (starts + 30) END, 6) AS rate FROM a JOIN b USING (track)""")
def a09(spark, sf_dir):
    return A.empirical_bayes_rates(runners(spark, sf_dir), LEVELS, "win", n_rows=table(spark, sf_dir, "lineitem").count()).withColumn("rate", F.round("rate", 6))


@query("A10_modal_value", f"""{RUN}, h AS (SELECT race, post, list_reverse(list_filter(list(CASE WHEN kind <> 'unknown' THEN kind END) OVER (PARTITION BY entity ORDER BY day, race, post ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL)) AS kn FROM run)
 SELECT race, post, list_sort(list_transform(list_distinct(kn), lambda v: {{'n': len(list_filter(kn, lambda x: x = v)), 'a': -list_position(kn, v), 'v': v}}), 'DESC')[1].v AS usual FROM h""")
def a10(spark, sf_dir):
    return runners(spark, sf_dir).select("race", "post", W.modal_value(W.recent(c("kind"), W.history("entity", ["day", "race", "post"]), 8)).alias("usual"))


BINS = "least(floor(p * 15), 14)::INT"


@query("A11_ece", f"{SCORED} SELECT round(sum(n * g) / sum(n), 6) AS ece FROM (SELECT count(*) AS n, abs(avg(p) - avg(win)) AS g FROM sc GROUP BY {BINS})")
def a11(spark, sf_dir):
    return A.ece(scored(spark, sf_dir), "p", "win").select(r6(c("ece"), "ece"))


@query("A12_reliability_bins", f"{SCORED}, b AS (SELECT {BINS} AS bin, count(*) AS n, avg(p) AS mp, avg(win) AS my FROM sc GROUP BY 1) SELECT r::INT AS bin, round(r / 15, 6) AS low, round((r + 1) / 15, 6) AS high, coalesce(n, 0) AS n, round(mp, 6) AS mean_p, round(my, 6) AS mean_y FROM range(15) t(r) LEFT JOIN b ON bin = r")
def a12(spark, sf_dir):
    return A.reliability_bins(scored(spark, sf_dir), "p", "win").select("bin", *[r6(c(x), x) for x in ("low", "high")], c("n").cast("long"), *[r6(c(x), x) for x in ("mean_p", "mean_y")])


@query("A13_brier_log_loss", f"{SCORED} SELECT round(avg((p - win) * (p - win)), 6) AS brier, round(avg(-(win * ln(greatest(1e-7, least(1 - 1e-7, p))) + (1 - win) * ln(1 - greatest(1e-7, least(1 - 1e-7, p))))), 6) AS loss FROM sc")
def a13(spark, sf_dir):
    return scored(spark, sf_dir).agg(r6(A.brier(c("p"), c("win")), "brier"), r6(A.log_loss(c("p"), c("win")), "loss"))


@query("A14_auc", f"{RUN}, e AS (SELECT q / 50 AS p, sum(win) AS pos, sum(1 - win) AS neg FROM run GROUP BY 1) SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM e)")
def a14(spark, sf_dir):
    return A.auc(runners(spark, sf_dir).select((c("q") / 50).alias("p"), "win"), "p", "win").select(r6(c("auc"), "auc"))


@query("A15_race_top1", f"{RUN}, b AS (SELECT race, win, row_number() OVER (PARTITION BY race ORDER BY q DESC, post) AS n FROM run) SELECT count(*) AS n_races, round(avg(win), 6) AS top1 FROM b WHERE n = 1")
def a15(spark, sf_dir):
    return A.race_top1_accuracy(runners(spark, sf_dir), "race", "q", "win", "post").select("n_races", r6(c("top1"), "top1"))


CAND = f"{SCORED}, ca AS (SELECT race, post, CASE WHEN post % 2 = 0 THEN 'win' ELSE 'exacta' END AS bet_type, p, 1 / p * (1 + (q % 4) / 10) AS odds FROM sc), cb AS (SELECT *, p - 1 / odds AS edge, p * odds - 1 AS ev FROM ca)"


def candidates(spark, sf_dir):
    s = scored(spark, sf_dir).select("race", "post", F.when(c("post") % 2 == 0, "win").otherwise("exacta").alias("bet_type"), "p", (1 / c("p") * (1 + (c("q") % 4) / 10)).alias("odds"))
    return s.withColumns({"edge": c("p") - 1 / c("odds"), "ev": c("p") * c("odds") - 1})


@query("A16_backtest_summary", f"{CAND} SELECT bet_type, count(*) AS n, count(DISTINCT race) AS n_races, round(avg(edge), 6) AS mean_edge, round(sum(edge), 4) AS sum_edge, round(avg(ev), 6) AS mean_ev, round(sum(ev), 4) AS sum_ev FROM cb GROUP BY bet_type")
def a16(spark, sf_dir):
    return A.backtest_summary(candidates(spark, sf_dir)).select("bet_type", "n", "n_races", r6(c("mean_edge"), "mean_edge"), F.round("sum_edge", 4).alias("sum_edge"), r6(c("mean_ev"), "mean_ev"), F.round("sum_ev", 4).alias("sum_ev"))


@query("A17_card_rollup", f"{RUN} SELECT trainer AS card, count(*) AS n_bets, round(sum(disc), 6) AS expected_return, round(least(1, sum(tax)), 6) AS stake, max(q) AS var, max(price) AS cvar FROM run GROUP BY 1")
def a17(spark, sf_dir):
    p = runners(spark, sf_dir).select(c("trainer").alias("card"), F.array("post").alias("bets"), c("disc").alias("expected_return"), c("tax").alias("stake"), c("q").alias("var"), c("price").alias("cvar"))
    return A.card_rollup(p, "card").select("card", F.size("bets").cast("long").alias("n_bets"), r6(c("expected_return"), "expected_return"), r6(c("stake"), "stake"), "var", "cvar")


@query("A18_parse_confidence", f"{RUN} SELECT race, round(0.4 * (max((claim IS NOT NULL)::INT) + max((figure IS NOT NULL)::INT)) / 2 + 0.6 * avg((q > 10)::INT), 6) AS confidence FROM run GROUP BY race")
def a18(spark, sf_dir):
    r = runners(spark, sf_dir).withColumn("n", F.when(c("q") > 10, 1).otherwise(0))
    return A.parse_confidence(r, ["race"], ["claim", "figure"], "n").withColumn("confidence", F.round("confidence", 6))


@query("A19_var_cvar", f"{RUN}, z AS (SELECT track, (disc - 0.05) * q AS pnl FROM run), k AS (SELECT track, quantile_cont(pnl, 0.05) AS v FROM z GROUP BY track) SELECT track, round(-v, 6) AS var, round(-avg(pnl), 6) AS cvar FROM z JOIN k USING (track) WHERE pnl <= v + 1e-9 GROUP BY track, v")
def a19(spark, sf_dir):
    z = runners(spark, sf_dir).select("track", ((c("disc") - 0.05) * c("q")).alias("pnl"))
    return A.var_cvar(z, ["track"], "pnl").select("track", r6(c("var"), "var"), r6(c("cvar"), "cvar"))


@query("A19_var_cvar_refined", SQL["A19_var_cvar"])
def a19_refined(spark, sf_dir):
    """The same tail with a quantile that is found in passes over histograms."""
    z = runners(spark, sf_dir).select("track", ((c("disc") - 0.05) * c("q")).alias("pnl"))
    return A.var_cvar(z, ["track"], "pnl", refine=True).select("track", r6(c("var"), "var"), r6(c("cvar"), "cvar"))


@query("A20_scaler", f"{RUN}, s AS (SELECT avg(figure) AS m, stddev_pop(figure) AS d FROM run) SELECT race, post, round((figure - m) / d, 6) AS figure FROM run, s")
def a20(spark, sf_dir):
    r = runners(spark, sf_dir).select("race", "post", "figure")
    return A.apply_scaler(r, A.fit_scaler(r, ["figure"]), ["figure"]).withColumn("figure", F.round("figure", 6))


@query("A21_residual_fit", f"{RUN}, m AS (SELECT avg(figure) AS f FROM run), l AS (SELECT race, post, q, coalesce(figure, f) AS y FROM run, m), k AS (SELECT regr_slope(y, q) AS a, regr_intercept(y, q) AS b FROM l) SELECT race, post, round(y - (a * q + b), 5) AS rest FROM l, k")
def a21(spark, sf_dir):
    r = runners(spark, sf_dir).select("race", "post", "q", "figure")
    return A.residuals(r, A.residual_fit(r, "q", ["figure"]), "q", ["figure"]).select("race", "post", F.round("figure_residual", 5).alias("rest"))


@query("A22_status_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def a22(spark, sf_dir):
    return A.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("A23_card_identity", f"{RUN}, f AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY post) AS n FROM run WHERE claim IS NOT NULL) SELECT DISTINCT run.race, f.claim AS card_date, first_value(run.kind) OVER (PARTITION BY run.race ORDER BY run.post) AS card_track FROM run LEFT JOIN f ON f.race = run.race AND n = 1")
def a23(spark, sf_dir):
    return A.card_identity(runners(spark, sf_dir), "race", "post", "claim", "kind")


@query("A24_drift_report", """WITH e AS (SELECT event_id, user_id, ts, (value - 50) / 25 AS z FROM events),
 s AS (SELECT *, row_number() OVER w AS step, sum(z - 0.5) OVER w AS up, sum(-z - 0.5) OVER w AS down FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 t AS (SELECT *, up - least(0, min(up) OVER w) AS hi, down - least(0, min(down) OVER w) AS lo FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT user_id, count(*) AS n, bool_or(hi > 4 OR lo > 4) AS alarm, min(step) FILTER (hi > 4 OR lo > 4) AS alarm_step, round(arg_max(hi, step), 6) AS final_high, round(max(hi), 6) AS max_high, round(max(lo), 6) AS max_low, round(avg(z), 6) AS mean_z FROM t GROUP BY user_id""")
def a24(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", ((c("value") - 50) / 25).alias("z"))
    d = A.drift_report(W.cusum(e, "z", ["user_id"], ["ts", "event_id"]), ["user_id"], "z")
    return d.select("user_id", "n", "alarm", c("alarm_step").cast("long"), *[r6(c(x), x) for x in ("final_high", "max_high", "max_low", "mean_z")])


# Mapping and filters


@query("P01_apply_field_map", "SELECT o_orderkey AS id, o_orderpriority AS track, NULL::VARCHAR AS surface, 'JP' AS jurisdiction, round(o_totalprice / 201.168, 4) AS distance, CAST(trunc(o_totalprice) AS INTEGER) AS purse FROM orders")
def p01(spark, sf_dir):
    spec = {"track": {"column": "o_orderpriority"}, "surface": {"column": "nowhere"}, "jurisdiction": {"const": "JP"}, "distance": {"column": "o_price", "transform": "metres_to_furlongs", "type": "double"}, "purse": {"column": "o_price", "type": "int"}}
    return O.apply_field_map(table(spark, sf_dir, "orders").withColumn("o_price", c("o_totalprice").cast("decimal(18,2)").cast("string")), spec, ["o_orderkey"]).withColumnRenamed("o_orderkey", "id")


@query("P02_resolve_columns", "SELECT o_orderkey AS race_no, o_totalprice AS purse, o_orderdate AS date FROM orders")
def p02(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = O.resolve_columns(orders.columns, {"race_no": {"aliases": ["race", "o_orderkey"]}, "purse": {"pattern": r".*price", "blocked": ["base_price"]}, "date": {"pattern": r".*date"}})
    return orders.select(*[c(v).alias(k) for k, v in found.items()])


@query("P02_automatic_map", """SELECT 'T' || l_orderkey AS race_track_code, CAST(l_shipdate AS DATE) AS race_race_date, 'Horse ' || l_partkey AS horse_name_display, l_linenumber::INT AS finish_position, l_suppkey % 7 + 1e0 AS odds_final,
 (8 * 14 + l_linenumber)::DOUBLE AS weight_lbs, round((1000 + l_suppkey) / 201.168, 4) AS race_distance_furlongs, 60e0 + l_linenumber AS fraction_finish_sec FROM lineitem""")
def p02_automatic(spark, sf_dir):
    """A table whose columns have misspelt, swapped and misleading names, mapped by names and values: ids and a `position` of words are passed over."""
    from ..operators import mapping

    text = lambda x: c(x).cast("string")
    raw = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("T"), text("l_orderkey")).alias("Track Cdoe"), F.date_format("l_shipdate", "yyyy/MM/dd").alias("race-dat"), text("l_partkey").alias("horse_id"), F.concat(F.lit("Horse "), text("l_partkey")).alias("HORSE"), c("l_returnflag").alias("position"),
        text("l_linenumber").alias("Finish_Positon"), F.concat(text("l_suppkey") % 7, F.lit("/1")).alias("SP"), F.concat(F.lit("8-"), text("l_linenumber")).alias("Weight"), text("l_extendedprice").alias("birth_date"), (1000 + c("l_suppkey")).alias("dist"), F.concat(F.lit("1:0"), text("l_linenumber")).alias("time"),
    )
    raw = raw.withColumn("SP", F.regexp_replace("SP", r"\.0", ""))
    return O.apply_field_map(raw, mapping.automatic_map(raw))


@query("P03_split_valid", f"{RUN} SELECT race, post, list_filter([CASE WHEN claim IS NULL THEN 'missing claim' END, CASE WHEN figure IS NULL THEN 'missing figure' END], lambda x: x IS NOT NULL) AS reasons FROM run WHERE claim IS NULL OR figure IS NULL")
def p03(spark, sf_dir):
    return O.split_valid(runners(spark, sf_dir), ["claim", "figure"])[1].select("race", "post", "reasons")


@query("P04_flatten", "SELECT o_orderkey, o_totalprice AS race_purse, o_orderstatus AS race_kind FROM orders")
def p04(spark, sf_dir):
    return O.flatten_result(table(spark, sf_dir, "orders").select("o_orderkey", F.struct(c("o_totalprice").alias("purse"), c("o_orderstatus").alias("kind")).alias("race")), ["race"])


HARD = "CASE WHEN q < 3 THEN 'short' WHEN finish > 6 THEN 'finish' END"
QUALITY = f"{RUN}, ql AS (SELECT race, post, {HARD} AS hard, 1 - CASE WHEN claim IS NULL THEN 0.1 ELSE 0 END - CASE WHEN figure IS NULL THEN 0.15 ELSE 0 END - CASE WHEN odds > 10 THEN 0.2 ELSE 0 END AS s FROM run), qq AS (SELECT race, post, CASE WHEN hard IS NOT NULL THEN 0e0 ELSE round(greatest(0, s), 4)::DOUBLE END AS quality, hard FROM ql)"


def quality(spark, sf_dir):
    hard = {"short": c("q") < 3, "finish": c("finish") > 6}
    soft = {"claim": (c("claim").isNull(), 0.1), "figure": (c("figure").isNull(), 0.15), "odds": (c("odds") > 10, 0.2)}
    return O.quality_score(runners(spark, sf_dir), hard, soft)


@query("P05_quality_score", f"{QUALITY} SELECT race, post, quality, CASE WHEN hard IS NOT NULL THEN hard END AS hard FROM qq")
def p05(spark, sf_dir):
    return quality(spark, sf_dir).select("race", "post", "quality", F.when(c("quality") == 0, c("issues")[0]).alias("hard"))


RESULT = {
    "race_race_date": ("day", "day"), "race_track_code": ("CASE WHEN post = 7 THEN ' ' ELSE track END",) * 2, "horse_name_normalized": ("CAST(entity AS STRING)", "CAST(entity AS VARCHAR)"), "finish_position": ("finish * 5",) * 2, "race_race_number": ("race % 12",) * 2,
    "race_distance_furlongs": ("CASE WHEN q > 2 THEN q / 2 END",) * 2, "race_surface": ("kind",) * 2, "race_jurisdiction": ("style",) * 2, "odds_final": ("CASE WHEN q % 11 <> 0 THEN odds - 1 END",) * 2, "speed_figure": ("figure",) * 2, "jockey_name_normalized": ("CASE WHEN jockey % 4 = 0 THEN '' ELSE 'j' END",) * 2,
    "weight_lbs": ("CASE WHEN q % 13 <> 0 THEN 90 + q * 1.5 END",) * 2, "fraction_finish_sec": ("claim",) * 2,
}


@query("P05_result_quality", f"""{RUN}, x AS (SELECT race, post, {", ".join(f"{b} AS {k}" for k, (_, b) in RESULT.items())} FROM run),
 m AS (SELECT race, post, CASE WHEN trim(race_track_code) = '' THEN 'missing track_code' WHEN race_distance_furlongs IS NULL THEN 'missing distance_furlongs' END AS hard,
  list_filter([CASE WHEN odds_final IS NULL THEN 'missing odds' END, CASE WHEN speed_figure IS NULL THEN 'missing speed figure' END, CASE WHEN jockey_name_normalized = '' THEN 'missing jockey' END, CASE WHEN weight_lbs IS NULL THEN 'missing weight' END, CASE WHEN fraction_finish_sec IS NULL THEN 'missing final time' END,
   CASE WHEN finish_position > 30 THEN 'implausible finish_position' END, CASE WHEN odds_final < 1 THEN 'implausible odds' END, CASE WHEN race_distance_furlongs NOT BETWEEN 2 AND 20 THEN 'implausible distance' END, CASE WHEN weight_lbs NOT BETWEEN 95 AND 145 THEN 'implausible weight' END], lambda i: i IS NOT NULL) AS soft FROM x)
 SELECT race, post, CASE WHEN hard IS NOT NULL THEN 0 ELSE round(greatest(0, 1 - list_sum(list_transform(list_append(soft, ''), lambda i: CASE i WHEN '' THEN 0 WHEN 'missing odds' THEN 0.1e0 WHEN 'missing speed figure' THEN 0.1e0 WHEN 'missing jockey' THEN 0.05e0 WHEN 'missing weight' THEN 0.05e0 WHEN 'missing final time' THEN 0.1e0 WHEN 'implausible finish_position' THEN 0.15e0 WHEN 'implausible odds' THEN 0.15e0 WHEN 'implausible distance' THEN 0.2e0 ELSE 0.1e0 END))), 4) END AS quality,
  CASE WHEN hard IS NOT NULL THEN hard ELSE array_to_string(soft, '; ') END AS issues FROM m""")
def p05_result(spark, sf_dir):
    """Results scored by the default rules: eight needed columns, five wanted ones, four ranges."""
    rows = runners(spark, sf_dir).select("race", "post", *[F.expr(a).alias(k) for k, (a, _) in RESULT.items()])
    return O.result_quality(rows).select("race", "post", "quality", F.array_join("issues", "; ").alias("issues"))


@query("P06_accept_reject", f"{QUALITY} SELECT race, post, quality FROM qq WHERE quality >= 0.8")
def p06(spark, sf_dir):
    return O.accept_reject(quality(spark, sf_dir), least=0.8)[0].select("race", "post", "quality")


@query("P07_training_filter", f"{RUN} SELECT race, post FROM run WHERE q / 50 >= 0.6 AND coalesce(figure, 4) >= 4 AND track IN ('1-URGENT', '2-HIGH')")
def p07(spark, sf_dir):
    r = runners(spark, sf_dir).withColumn("score", c("q") / 50)
    return O.training_filter(r, "score", "figure", "finish", "track", allowed=["1-URGENT", "2-HIGH"]).select("race", "post")


@query("P08_rolling_window", f"{RUN} SELECT race, post, day FROM run WHERE day >= DATE '1994-02-28' AND day < DATE '1996-02-29'")
def p08(spark, sf_dir):
    return O.rolling_window_slice(runners(spark, sf_dir), "day", dt.date(1996, 2, 29), 2).select("race", "post", "day")


@query("P09_odds_cap", f"{RUN} SELECT race, post, odds FROM run QUALIFY max(odds) OVER (PARTITION BY race) <= 12 AND min(odds) OVER (PARTITION BY race) > 1")
def p09(spark, sf_dir):
    return O.odds_cap(runners(spark, sf_dir), "race", "odds", 12.0).select("race", "post", "odds")


@query("P12_column_gate", f"{RUN} SELECT 'claim' AS col, count(claim) AS n_values, count(*) AS n_rows, count(claim) >= 3000 AS enough FROM run UNION ALL SELECT 'figure', count(figure), count(*), count(figure) >= 3000 FROM run")
def p12(spark, sf_dir):
    return O.column_gate(runners(spark, sf_dir), ["claim", "figure"], 3000).withColumnRenamed("column", "col")


@query("P13_neutral_fallback", f"{RUN} SELECT race, post, coalesce(claim, 0.5) AS claim, round(coalesce(figure, avg(figure) OVER ()), 6) AS figure, (figure IS NULL)::INT AS figure_missing FROM run")
def p13(spark, sf_dir):
    return O.neutral_fallback(runners(spark, sf_dir), ["claim"], "figure").select("race", "post", "claim", r6(c("figure"), "figure"), "figure_missing")


@query("P14_sample_fraction", f"{RUN} SELECT race, post FROM run WHERE ('0x' || substr(md5('sample|' || race), 1, 8))::BIGINT / 4294967296.0 < 0.3")
def p14(spark, sf_dir):
    return O.sample_fraction(runners(spark, sf_dir), "race", 0.3).select("race", "post")


# Joins


@query("J01_merge_bundle", "SELECT n.*, r.r_name AS r_name, r.r_regionkey AS region_seen FROM nation n LEFT JOIN region r ON n_regionkey = r_regionkey")
def j01(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("key", c("n_regionkey"))
    r = table(spark, sf_dir, "region").select(c("r_regionkey").alias("key"), "r_name", c("r_regionkey").alias("n_regionkey"))
    return O.merge_bundle(n, r, "key").withColumnRenamed("n_regionkey_dim", "region_seen").drop("key")


@query("J02_star_export", "SELECT l_orderkey, l_linenumber, l_extendedprice, o_custkey, p_brand, s_name, c_mktsegment FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN customer ON o_custkey = c_custkey")
def j02(spark, sf_dir):
    t = lambda n, k, to, *cols: table(spark, sf_dir, n).select(c(k).alias(to), *cols)
    line = t("lineitem", "l_orderkey", "ok", "l_linenumber", "l_extendedprice", c("l_partkey").alias("pk"), c("l_suppkey").alias("sk"))
    out = O.star_export(line, [(t("orders", "o_orderkey", "ok", "o_custkey"), "ok"), (t("part", "p_partkey", "pk", "p_brand"), "pk")], [(t("supplier", "s_suppkey", "sk", "s_name"), "sk"), (t("customer", "c_custkey", "o_custkey", "c_mktsegment"), "o_custkey")])
    return out.select(c("ok").alias("l_orderkey"), "l_linenumber", "l_extendedprice", "o_custkey", "p_brand", "s_name", "c_mktsegment")


@query("J03_resolve_keys", "SELECT o_orderkey, o_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j03(spark, sf_dir):
    return O.resolve_keys(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey", "c_name").select("o_orderkey", "o_custkey", "c_name")


@query("J04_insert_if_absent", "SELECT l_partkey AS k, min(l_suppkey) AS v FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY 1")
def j04(spark, sf_dir):
    new = table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("k"), c("l_suppkey").alias("v"))
    return O.insert_if_absent(new, table(spark, sf_dir, "part").where("p_size < 25").select(c("p_partkey").alias("k")), "k")


@query("J06_hierarchical_lookup", f"""{RUN}, pr AS (SELECT jockey, trainer, avg(win) AS r FROM run GROUP BY 1, 2 HAVING count(*) >= 3), jo AS (SELECT jockey, avg(win) AS r FROM run GROUP BY 1 HAVING count(*) >= 60)
 SELECT race, post, round(coalesce(pr.r, jo.r, 0.1), 6) AS rate FROM run LEFT JOIN pr USING (jockey, trainer) LEFT JOIN jo USING (jockey)""")
def j06(spark, sf_dir):
    r = runners(spark, sf_dir)
    rate = lambda keys, n: r.groupBy(*keys).agg(F.avg("win").alias("rate"), F.count("*").alias("n")).where(c("n") >= n).drop("n")
    return O.hierarchical_lookup(r, [(rate(["jockey", "trainer"], 3), ["jockey", "trainer"]), (rate(["jockey"], 60), ["jockey"])], 0.1).select("race", "post", r6(c("rate"), "rate"))


@query("J05_join_features", f"""{RUN}, g AS (SELECT race, count(*) AS field, sum(tax) AS race_tax FROM run GROUP BY race), e AS (SELECT entity, count(*) AS starts FROM run WHERE win = 1 GROUP BY entity)
 SELECT race, post, field, round(race_tax, 6) AS race_tax, starts FROM run LEFT JOIN g USING (race) LEFT JOIN e USING (entity)""")
def j05(spark, sf_dir):
    r = runners(spark, sf_dir)
    field = r.groupBy("race").agg(F.count("*").alias("field"), F.sum("tax").alias("race_tax"))
    wins = r.where("win = 1").groupBy("entity").agg(F.count("*").alias("starts"))
    out = O.join_features(r.select("race", "post", "entity"), [(field, ["race"]), (wins, ["entity"])])
    return out.select("race", "post", "field", r6(c("race_tax"), "race_tax"), "starts")


EB = SQL["A09_empirical_bayes"].replace(" SELECT level, track, jockey, trainer, starts,", ", eb AS (SELECT level, track, jockey, trainer, starts,") + ")"


@query("M05_connections", f"""{EB} SELECT race, post, round(coalesce(p.rate, j.rate, t.rate, g.rate, 0.1), 6) AS chance FROM run
 LEFT JOIN (SELECT * FROM eb WHERE level = 'pair') p ON p.track = run.track AND p.jockey = run.jockey AND p.trainer = run.trainer
 LEFT JOIN (SELECT * FROM eb WHERE level = 'jockey') j ON j.track = run.track AND j.jockey = run.jockey
 LEFT JOIN (SELECT * FROM eb WHERE level = 'trainer') t ON t.track = run.track AND t.trainer = run.trainer
 LEFT JOIN (SELECT * FROM eb WHERE level = 'jurisdiction') g ON g.track = run.track""")
def m05(spark, sf_dir):
    r = runners(spark, sf_dir)
    return O.connections_score(r, A.empirical_bayes_rates(r, LEVELS, "win", n_rows=table(spark, sf_dir, "lineitem").count()), LEVELS, 0.1, "chance").select("race", "post", r6(c("chance"), "chance"))


@query("J08_ordered_tuples", f"{SCORED} SELECT a.race, [a.post, b.post] AS selection, round(CASE WHEN 1 - a.p <> 0 THEN a.p * b.p / (1 - a.p) END, 6) AS chance FROM sc a JOIN sc b ON a.race = b.race AND a.post <> b.post")
def j08(spark, sf_dir):
    return O.ordered_tuples(scored(spark, sf_dir), "race", "post", "p", 2).withColumn("chance", F.round("chance", 6))


@query("J09_prior_history", f"""{RUN}, t AS (SELECT * FROM run WHERE day >= DATE '1997-01-01'), h AS (SELECT t.race, t.post, p.day AS pd, p.race AS pr, p.post AS pp, row_number() OVER (PARTITION BY t.race, t.post ORDER BY p.day DESC, p.race DESC, p.post DESC) AS n FROM t JOIN run p ON p.entity = t.entity AND p.day < t.day)
 SELECT t.race, t.post, count(pr) AS n_past, max(CASE WHEN n = 1 THEN pr END) AS last_race FROM t LEFT JOIN h ON h.race = t.race AND h.post = t.post AND n <= 5 GROUP BY t.race, t.post""")
def j09(spark, sf_dir):
    r = runners(spark, sf_dir)
    out = O.prior_history(r.where("day >= DATE '1997-01-01'").select("race", "post", "entity", "day"), r, "entity", "day", ["race", "post"], 5)
    return out.select("race", "post", F.size("history").cast("long").alias("n_past"), F.get("history", 0)["race"].alias("last_race"))


@query("J11_cross_levels", f"{RUN} SELECT race, post, level FROM run CROSS JOIN (SELECT unnest([0.05e0, 0.1e0, 0.3e0]) AS level)")
def j11(spark, sf_dir):
    return O.cross_levels(runners(spark, sf_dir).select("race", "post"), [0.3, 0.05, 0.1, 0.1])


@query("J12_expand_scenarios", "SELECT o_orderkey, s::INT AS scenario FROM orders CROSS JOIN range(1, 6) t(s)")
def j12(spark, sf_dir):
    return O.expand_scenarios(table(spark, sf_dir, "orders").select("o_orderkey"), 5)


@query("J13_skip_registered", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j13(spark, sf_dir):
    return O.skip_registered(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), table(spark, sf_dir, "orders").select(c("o_custkey").alias("c_custkey")), ["c_custkey"])


# Sorts, limits, sets


@query("L02_rank_candidates", f"{CAND} SELECT race, post, row_number() OVER (PARTITION BY race ORDER BY round(ev, 9) DESC, bet_type, [post]) AS rank FROM cb")
def l02(spark, sf_dir):
    return O.rank_candidates(candidates(spark, sf_dir).withColumns({"selection": F.array("post"), "ev": F.round("ev", 9)})).select("race", "post", c("rank").cast("long"))


@query("L03_history_desc", f"{RUN} SELECT entity, race, post, row_number() OVER (PARTITION BY entity ORDER BY day DESC, race DESC, post DESC) AS nth FROM run")
def l03(spark, sf_dir):
    return O.history_desc(runners(spark, sf_dir), "entity", ["day", "race", "post"]).select("entity", "race", "post", c("nth").cast("long").alias("nth"))


@query("L04_first_races", f"{RUN} SELECT race, post FROM run WHERE race IN (SELECT DISTINCT race FROM run ORDER BY race LIMIT 50)")
def l04(spark, sf_dir):
    return O.first_races(runners(spark, sf_dir), "race", 50).select("race", "post")


@query("L05_top1", f"{RUN} SELECT race, arg_max(post, q * 1000 - post) AS best, max(q) AS best_score FROM run GROUP BY race")
def l05(spark, sf_dir):
    return O.top1(runners(spark, sf_dir), "race", "q", "post")


@query("L01_export_order", f"{RUN} SELECT day, track, race, post FROM run")
def l01(spark, sf_dir):
    return O.export_order(runners(spark, sf_dir).select("day", "track", "race", "post"), "day", "track", "race", "post")


@query("U01_union_races", f"{RUN} SELECT race, post, 'a' AS source FROM run WHERE race % 2 = 0 UNION ALL SELECT race, post, 'b' FROM run WHERE race % 2 = 1")
def u01(spark, sf_dir):
    r = runners(spark, sf_dir)
    return r.where("race % 2 = 0").select("race", "post", F.lit("a").alias("source")).unionByName(r.where("race % 2 = 1").select(F.lit("b").alias("source"), "post", "race"))


@query("U02_dedup_first", f"{RUN} SELECT entity, race, post FROM run QUALIFY row_number() OVER (PARTITION BY entity ORDER BY track DESC, day, race, post) = 1")
def u02(spark, sf_dir):
    return O.dedup_first(runners(spark, sf_dir), ["entity"], [F.desc("track"), "day", "race", "post"]).select("entity", "race", "post")


@query("U03_merge_star", f"{RUN} SELECT jockey AS id, max(track) AS top FROM run WHERE jockey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) GROUP BY 1")
def u03(spark, sf_dir):
    r = runners(spark, sf_dir).select(c("jockey").alias("id"), c("track").alias("top"))
    have = table(spark, sf_dir, "supplier").where("s_nationkey < 5").select(c("s_suppkey").alias("id"), F.lit("x").alias("top"))
    return O.merge_star(r, {"jockeys": (have, ["id", "top"])}, F.expr("-ascii(top)"))["jockeys"]


@query("U04_duplicate_rate", "SELECT count(*) AS n_rows, round(1 - count(DISTINCT (l_partkey, l_suppkey)) / count(*), 6) AS duplicate_rate FROM lineitem")
def u04(spark, sf_dir):
    return A.duplicate_rate(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"))


@query("U05_distinct_races", f"{RUN} SELECT DISTINCT day, track FROM run")
def u05(spark, sf_dir):
    return runners(spark, sf_dir).select("day", "track").distinct()


OUT = f"{RUN}, ou AS (SELECT race, list(post ORDER BY finish) AS o FROM run WHERE finish <= 4 GROUP BY race)"


def outcomes(spark, sf_dir, n: int = 4):
    f = runners(spark, sf_dir).where(c("finish") <= n)
    return f.groupBy("race").agg(F.transform(F.array_sort(F.collect_list(F.struct("finish", "post"))), lambda x: x["post"]).alias("finishing_order")).withColumn("settled_at", F.lit("1999-01-01").cast("timestamp"))


@query("U07_log_outcomes", f"{OUT} SELECT race, coalesce(o[1], -1) AS winner, coalesce(o[2], -1) AS second, coalesce(o[3], -1) AS third FROM ou WHERE race % 3 <> 0")
def u07(spark, sf_dir):
    have = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(c("o_orderkey").alias("race"))
    o = outcomes(spark, sf_dir)
    return O.log_outcomes(o.unionByName(o), have).select("race", "winner", "second", "third")


# Splits


@query("M01_time_split", f"{RUN}, k AS (SELECT quantile_cont(date_diff('day', DATE '1970-01-01', day), 0.9) AS v FROM run) SELECT race, post FROM run, k WHERE date_diff('day', DATE '1970-01-01', day) > v")
def m01(spark, sf_dir):
    return O.time_split(runners(spark, sf_dir), "day")[1].select("race", "post")


@query("M02_three_way_split", f"{RUN}, k AS (SELECT quantile_cont(date_diff('day', DATE '1970-01-01', day), 0.8) AS a, quantile_cont(date_diff('day', DATE '1970-01-01', day), 0.9) AS b FROM run) SELECT race, post, CASE WHEN date_diff('day', DATE '1970-01-01', day) <= a THEN 'train' WHEN date_diff('day', DATE '1970-01-01', day) <= b THEN 'calib' ELSE 'test' END AS part FROM run, k")
def m02(spark, sf_dir):
    return O.three_way_time_split(runners(spark, sf_dir), "day").select("race", "post", "part")


# Orders, prices, settlement


@query("R01_enumerate_exotics", f"{SCORED} SELECT a.race, [a.post, b.post, d.post] AS selection, round(CASE WHEN 1 - a.p <> 0 AND 1 - (a.p + b.p) <> 0 THEN a.p * (b.p / (1 - a.p)) * (d.p / (1 - (a.p + b.p))) END, 6) AS chance FROM sc a JOIN sc b ON a.race = b.race AND a.post <> b.post JOIN sc d ON a.race = d.race AND d.post <> a.post AND d.post <> b.post")
def r01(spark, sf_dir):
    return O.ordered_tuples(scored(spark, sf_dir), "race", "post", "p", 3).withColumn("chance", F.round("chance", 6))


@query("R02_place_show", f"""{SCORED}, t AS (SELECT a.race, a.post AS x, b.post AS y, a.p * b.p / (1 - a.p) AS ch, a.p + b.p AS used FROM sc a JOIN sc b ON a.race = b.race AND a.post <> b.post),
 two AS (SELECT race, runner, sum(ch) AS place FROM (SELECT race, unnest([x, y]) AS runner, ch FROM t) GROUP BY ALL),
 three AS (SELECT race, runner, sum(ch) AS third FROM (SELECT t.race, unnest([x, y, sc.post]) AS runner, ch * sc.p / (1 - used) AS ch FROM t JOIN sc ON t.race = sc.race AND sc.post <> x AND sc.post <> y) GROUP BY ALL)
 SELECT sc.race, sc.post AS runner, round(coalesce(place, 1), 5) AS place, round(coalesce(third, 1), 5) AS "show" FROM sc LEFT JOIN two ON two.race = sc.race AND two.runner = sc.post LEFT JOIN three ON three.race = sc.race AND three.runner = sc.post""")
def r02(spark, sf_dir):
    return O.place_show_prob(scored(spark, sf_dir), "race", "post", "p").select("race", "runner", F.round("place", 5).alias("place"), F.round("show", 5).alias("show"))


UNI = "(('0x' || substr(md5('orders|' || race || '|' || s || '|' || post || '|0'), 1, 8))::BIGINT + 0.5) / 4294967296.0"
SAMPLES = f"{RUN}, sm AS (SELECT race, s::INT AS scenario, post AS runner, row_number() OVER (PARTITION BY race, s ORDER BY -ln({UNI}) / q, post) AS rank FROM run CROSS JOIN range(1, 6) t(s))"


def samples(spark, sf_dir):
    return O.sample_orders(runners(spark, sf_dir).select("race", "post", "q"), "race", "post", "q", 5)


@query("R03_sample_orders", f"{SAMPLES} SELECT * FROM sm")
def r03(spark, sf_dir):
    return samples(spark, sf_dir).withColumn("rank", c("rank").cast("long"))


@query("R06_tally_topk", f"{SAMPLES}, o AS (SELECT race, scenario, list(runner ORDER BY rank) AS o FROM sm WHERE rank <= 2 GROUP BY race, scenario) SELECT race, o AS selection, count(*) / 5 AS share FROM o GROUP BY race, o")
def r06(spark, sf_dir):
    return O.tally_topk(O.finishing_orders(samples(spark, sf_dir), 2), 2, 5)


@query("R07_ev_candidates", f"{CAND}, k AS (SELECT *, least(greatest(0, (edge * odds - (1 - edge)) / odds) * 0.25, 0.03) AS stake FROM cb WHERE odds > 1 AND edge >= 0.02) SELECT race, post, bet_type, round(edge, 6) AS edge, round(ev, 6) AS ev, round(stake, 6) AS stake FROM k")
def r07(spark, sf_dir):
    cand = candidates(spark, sf_dir).withColumn("selection", F.array("post"))
    out = O.ev_candidates(cand.select("race", "post", "bet_type", "selection", "p"), cand.select("race", "bet_type", "selection", "odds"), 0.02)
    return out.select("race", "post", "bet_type", *[r6(c(x), x) for x in ("edge", "ev", "stake")])


#: Bets to win on each runner, and what each winner leaves of them.
BETS = f"{SCORED}, py AS (SELECT a.race, a.post, b.post AS winner, b.p AS chance, a.tax AS stake, CASE WHEN a.post = b.post THEN a.odds - 1 ELSE -1 END AS payoff FROM sc a JOIN sc b ON a.race = b.race)"


def bets(spark, sf_dir):
    return runners(spark, sf_dir).select("race", "post", F.array("post").alias("selection"), "odds", c("tax").alias("stake"))


def chances(spark, sf_dir):
    return scored(spark, sf_dir).select("race", c("post").alias("runner"), "p")


@query("R08_payoffs", f"{BETS} SELECT race, post, winner, round(chance, 9) AS chance, round(payoff, 6) AS payoff FROM py")
def r08(spark, sf_dir):
    out = X.payoffs(bets(spark, sf_dir), X.outcome_tree(chances(spark, sf_dir), bets(spark, sf_dir)))
    return out.select("race", "post", F.element_at("finishing_order", 1).alias("winner"), F.round("chance", 9).alias("chance"), r6(c("payoff"), "payoff"))


def _risk(outcomes: str, alpha: float = 0.05) -> str:
    """Tail of a table ol(race, pnl, chance): outcomes from the worst on until they hold alpha of the chance."""
    return f"{outcomes}, tl AS (SELECT race, round(pnl, 12) AS pnl, sum(chance) AS chance FROM ol GROUP BY ALL), cu AS (SELECT *, sum(chance) OVER (PARTITION BY race ORDER BY pnl) - chance < {alpha} - 1e-12 AS worst FROM tl), ri AS (SELECT race, sum(pnl * chance) AS expected_return, -max(CASE WHEN worst THEN pnl END) AS var, -sum(CASE WHEN worst THEN pnl * chance END) / sum(CASE WHEN worst THEN chance END) AS cvar FROM cu GROUP BY race)"


RISK = _risk(f"{BETS}, ol AS (SELECT race, sum(stake * payoff) AS pnl, any_value(chance) AS chance FROM py GROUP BY race, winner)")


@query("R09_portfolio_risk", f"{RISK} SELECT race, round(expected_return, 9) AS expected_return, round(var, 9) AS var, round(cvar, 9) AS cvar FROM ri")
def r09(spark, sf_dir):
    return X.portfolio_risk(chances(spark, sf_dir), bets(spark, sf_dir)).select("race", *[F.round(x, 9).alias(x) for x in ("expected_return", "var", "cvar")])


#: Bets of one, two and three runners: each to win, the two next to each other by post in both orders, and each with the two before it.
EXOTICS = f"""{SCORED}, xb AS (SELECT race, [post] AS sel, tax AS stake, odds FROM sc UNION ALL SELECT race, [post, post - 1], tax / 2, odds * 3 FROM sc WHERE post > 1
 UNION ALL SELECT race, [post - 1, post], tax / 2, odds * 4 FROM sc WHERE post > 1 UNION ALL SELECT race, [post, post - 2, post - 1], tax / 4, odds * 9 FROM sc WHERE post > 2),
 fo AS (SELECT a.race, list_filter([a.post, b.post, d.post], lambda x: x IS NOT NULL) AS o, a.p * coalesce(b.p / (1 - a.p), 1) * coalesce(d.p / (1 - (a.p + b.p)), 1) AS chance
  FROM sc a LEFT JOIN sc b ON a.race = b.race AND b.post <> a.post LEFT JOIN sc d ON d.race = a.race AND d.post <> a.post AND d.post <> b.post),
 ol AS (SELECT fo.race, o, any_value(chance) AS chance, sum(CASE WHEN o[1:len(sel)] = sel THEN stake * (odds - 1) ELSE -stake END) AS pnl FROM fo JOIN xb USING (race) GROUP BY fo.race, o)"""


def exotic_bets(spark, sf_dir):
    s = scored(spark, sf_dir).select("race", "post", "odds", c("tax").alias("stake"))
    kinds = [(0, ["post"], 1, 1), (1, ["post", "post - 1"], 2, 3), (1, ["post - 1", "post"], 2, 4), (2, ["post", "post - 2", "post - 1"], 4, 9)]
    bet = lambda chosen, part, times: F.struct(F.array(*[F.expr(x) for x in chosen]).alias("selection"), (c("stake") / part).alias("stake"), (c("odds") * times).alias("odds"))
    # All of a runner from one pass over the view, which a union would make once for each kind.
    return s.select("race", F.explode(F.filter(F.array(*[F.when(c("post") > least, bet(*kind)) for least, *kind in kinds]), lambda b: b.isNotNull())).alias("b")).select("race", "b.*")


@query("R09_portfolio_risk_exotics", f"{_risk(EXOTICS, 0.2)} SELECT race, round(expected_return, 9) AS expected_return, round(var, 9) AS var, round(cvar, 9) AS cvar FROM ri")
def r09_exotics(spark, sf_dir):
    """Bets of one to three runners of a race together, over all its finishing orders."""
    return X.portfolio_risk(chances(spark, sf_dir), exotic_bets(spark, sf_dir), 0.2).select("race", *[F.round(x, 9).alias(x) for x in ("expected_return", "var", "cvar")])


CAPPED = f"{RISK}, t AS (SELECT race, sum(tax) AS stake, count(*) AS n_bets FROM sc GROUP BY race), k AS (SELECT race, level, n_bets, least(1, stake) AS stake, expected_return / greatest(1, stake) AS er, cvar / greatest(1, stake) AS cv FROM ri JOIN t USING (race) CROSS JOIN (SELECT unnest([0.02e0, 0.05e0, 0.1e0, 0.15e0]) AS level))"


@query("R11_pareto_frontier", f"{CAPPED} SELECT race, level, n_bets, round(stake * CASE WHEN cv > level THEN level / cv ELSE 1 END, 9) AS stake, round(least(cv, level), 9) AS cvar FROM k")
def r11(spark, sf_dir):
    out = X.risk_capped_allocation(chances(spark, sf_dir), bets(spark, sf_dir), [0.02, 0.05, 0.1, 0.15])
    return out.select("race", "level", "n_bets", F.round("stake", 9).alias("stake"), F.round("cvar", 9).alias("cvar"))


@query("R13_settle_bets", f"{OUT} SELECT run.race, post, o[1] = post AS won, round(CASE WHEN o[1] = post THEN tax * odds ELSE 0 END - tax, 9) AS pnl FROM run JOIN ou USING (race)")
def r13(spark, sf_dir):
    return O.settle_bets(bets(spark, sf_dir), outcomes(spark, sf_dir)).select("race", "post", "won", F.round("pnl", 9).alias("pnl"))


@query("R10_capped_allocation", f"{CAPPED} SELECT race, n_bets, round(stake * CASE WHEN cv > 0.15 THEN 0.15e0 / cv ELSE 1 END, 9) AS stake, round(er * CASE WHEN cv > 0.15 THEN 0.15e0 / cv ELSE 1 END, 9) AS expected_return FROM k WHERE level = 0.15")
def r10(spark, sf_dir):
    out = X.risk_capped_allocation(chances(spark, sf_dir), bets(spark, sf_dir), [0.15])
    return out.select("race", "n_bets", F.round("stake", 9).alias("stake"), F.round("expected_return", 9).alias("expected_return"))


@query("J07_attach_odds", f"{CAND}, b AS (SELECT race, post, p FROM ca) SELECT b.race, b.post, ca.bet_type, round(b.p, 6) AS p, round(ca.odds, 6) AS odds FROM b JOIN ca ON b.race = ca.race AND b.post = ca.post WHERE ca.odds > 2")
def j07(spark, sf_dir):
    """Chances meet the odds of the same selection; selections without odds go."""
    cand = candidates(spark, sf_dir).withColumn("selection", F.array("post"))
    out = O.attach_odds(cand.select("race", "post", "bet_type", "selection", "p"), cand.where("odds > 2").select("race", "bet_type", "selection", "odds"))
    return out.select("race", "post", "bet_type", r6(c("p"), "p"), r6(c("odds"), "odds"))


@query("J10_join_outcomes", f"{OUT} SELECT run.race, post, len(o) AS n_finishers, o[1] AS first FROM run JOIN ou USING (race)")
def j10(spark, sf_dir):
    out = O.join_outcomes(bets(spark, sf_dir), outcomes(spark, sf_dir))
    return out.select("race", "post", F.size("finishing_order").cast("long").alias("n_finishers"), F.get("finishing_order", F.lit(0)).alias("first"))


@query("R14_pnl_series", f"{OUT} SELECT run.race, post, round(CASE WHEN o[1] = post THEN tax * odds ELSE 0 END - tax, 9) AS pnl FROM run JOIN ou USING (race) WHERE day >= DATE '1996-01-01'")
def r14(spark, sf_dir):
    b = bets(spark, sf_dir).join(runners(spark, sf_dir).select("race", "post", "day"), ["race", "post"])
    return O.pnl_series(O.settle_bets(b, outcomes(spark, sf_dir)), "day", F.lit("1996-01-01").cast("date")).select("race", "post", F.round("pnl", 9).alias("pnl"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often does the runner with the best prior form win its race?"""
    h, r = W.history("entity", ["day", "race", "post"]), W.race("race")
    f = runners(spark, sf_dir).withColumns({"size": W.field_size(F.lit(None), r), "last": W.lag1(c("figure"), h), "form": W.roll_mean_prior(c("figure"), h)})
    f = f.withColumns({"z": W.field_z(c("form"), r), "rank": W.field_rank(c("form"), ["race"]), "edge": W.field_delta(c("form"), r)})
    f = f.withColumn("p", W.race_softmax(F.coalesce("z", F.lit(0.0)), r))
    return A.race_top1_accuracy(f, "race", "p", "win", "post").select("n_races", r6(c("top1"), "top1"))


FLAGSHIP = f"""{RUN}, f AS (SELECT *, avg(figure) OVER (PARTITION BY entity ORDER BY day, race, post ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS form FROM run),
 z AS (SELECT race, post, win, CASE WHEN coalesce(stddev_pop(form) OVER r, 0) = 0 THEN 0 ELSE coalesce((form - avg(form) OVER r) / stddev_pop(form) OVER r, 0) END AS z FROM f WINDOW r AS (PARTITION BY race)),
 b AS (SELECT race, win, row_number() OVER (PARTITION BY race ORDER BY round(z, 9) DESC, post) AS n FROM z) SELECT count(*) AS n_races, round(avg(win), 6) AS top1 FROM b WHERE n = 1"""
query("flagship_prior_form", FLAGSHIP)(flagship)
