"""Models, streams, cards and files over the given tables. Where SQL can express a query it has a twin; fits and draws are checked by their rows and by tests."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cards as C
from ..operators import jobs
from ..operators import models as M
from ..operators import rows as O
from ..operators import star as R
from ..operators import windows as W
from ..sources import files as S
from ..sources import registry
from ..sources.files import scratch, stored
from ..streaming import streams as T
from .base import RUN, dealt, query, r6, runners, table
from .tables import OUT, bets, candidates, outcomes, scored

c = F.col


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there and read its rows."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, name)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of the files of a table. Times without a zone become instants, as watermarks need."""
    schema = table(spark, sf_dir, name).schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return df.withColumns({f.name: c(f.name).cast("timestamp") for f in schema if f.dataType.simpleString() == "timestamp_ntz"})


FEATURES = ["last", "form", "gap", "z", "rank"]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, r = W.history("entity", ["day", "race", "post"]), W.race("race")
    f = runners(spark, sf_dir).withColumns({"last": W.lag1(c("figure"), h), "form": W.roll_mean_prior(c("figure"), h), "gap": W.days_since_prev(c("day"), h).cast("double")})
    f = f.withColumns({"z": W.field_z(c("form"), r), "rank": W.field_rank(c("form"), ["race"]).cast("double")})
    # Splits, fits and scores read them a dozen times.
    return stored(f.select("race", "post", "day", "odds", "win", *FEATURES), "features")


@query("M03_speed_form")
def m03(spark, sf_dir):
    train, val = O.time_split(features(spark, sf_dir), "day")
    return M.score_win_model(M.fit_win_model(train, val, FEATURES, "win", 5, 3), val, FEATURES, "speed").select("race", "post", "win", "speed")


PACE = ["last", "gap"]


@query("M04_pace_scenario")
def m04(spark, sf_dir):
    """Rows without all pace columns score 0.5."""
    train, val = O.time_split(features(spark, sf_dir), "day")
    model = M.fit_gated(train, val, PACE, "win", 5, 3, min_rows=1000)
    return M.score_gated(model, val, PACE, "pace").select("race", "post", "win", "pace")


@query("M06_market_prior")
def m06(spark, sf_dir):
    train, val = O.time_split(features(spark, sf_dir), "day")
    return M.market_prior(val, train, "odds", "race", "win").select("race", "post", "market")


def staked(spark, sf_dir) -> DataFrame:
    return features(spark, sf_dir).withColumns({"size": F.count("*").over(W.race("race")).cast("double"), "price": 1 / c("odds")})


@query("M07_stacker")
def m07(spark, sf_dir):
    """Trees over the form score, what market and rank add to it, and the field size."""
    train, val = O.time_split(staked(spark, sf_dir).withColumns({"speed": 1 / (1 + c("rank")), "share": c("price")}), "day")
    stacker = M.fit_stacker(train, val, ["share", "speed", "z"], ["size"], "win", 5, 3)
    return stacker.score(val, "stacked").select("race", "post", "win", "stacked")


def roles() -> jobs.Roles:
    return jobs.Roles("race", "post", "day", "odds", "win", FEATURES, PACE, ["size"])


@query("M11_rolling_retrain")
def m11(spark, sf_dir):
    """Retrained on the seven years before 1999 if the events show drift; how chances do on the newest tenth before and after calibration."""
    return jobs.rolling_retrain(staked(spark, sf_dir), roles(), dt.date(1999, 1, 1), 7, t06(spark, sf_dir), 4, 3, 1000)[1]


@query("R15_score_card")
def r15(spark, sf_dir):
    """Cards of the newest tenth of the dates: chances, bets and a stake plan for each level."""
    parts = O.three_way_time_split(staked(spark, sf_dir), "day")
    train, calib, new = (parts.where(c("part") == p).drop("part") for p in ("train", "calib", "test"))
    bundle = jobs.fit_bundle(train, calib, roles(), 4, 3, 1000)
    return jobs.score_card(new, bundle, [0.05, 0.1, 0.2], 0.05)[1]


@query("S12_load_models", f"{RUN}, k AS (SELECT quantile_cont(date_diff('day', DATE '1970-01-01', day), 0.9) AS v FROM run) SELECT race, post, true AS same, true AS neutral, 'lineitem' AS data_source FROM run, k WHERE date_diff('day', DATE '1970-01-01', day) > v")
def s12(spark, sf_dir):
    """A whole ensemble, saved and loaded: every score of the newest tenth is what it was before, and without the optional parts the scores stay neutral."""
    parts = O.three_way_time_split(staked(spark, sf_dir), "day")
    train, calib, new = (parts.where(c("part") == p).drop("part") for p in ("train", "calib", "test"))
    bundle, root = jobs.fit_bundle(train, calib, roles(), 3, 2, 1000), scratch(spark, "bundle")
    made = spark.createDataFrame([("ensemble", "lineitem", dt.datetime(1999, 1, 1), False)], S.PROVENANCE)
    jobs.save_bundle(bundle, root, made)
    loaded, provenance = jobs.load_bundle(spark, root)
    bare = replace(loaded, speed=None, pace=None, market=None)
    before, after = (b.score(new).select("race", "post", *[c(x).alias(f"{x}{n}") for x in ("speed", "pace_score", "market", "stacked", "calibrated")]) for b, n in ((bundle, ""), (loaded, "_after")))
    without = bare.score(new).select("race", "post", ((c("speed") == 0.5) & (c("pace_score") == 0.5) & (c("market") == 0.5) & c("calibrated").isNotNull()).alias("neutral"))
    same = [F.coalesce(c(x) == c(f"{x}_after"), F.lit(False)) for x in ("speed", "pace_score", "market", "stacked", "calibrated")]
    out = before.join(after, ["race", "post"]).join(without, ["race", "post"]).select("race", "post", (same[0] & same[1] & same[2] & same[3] & same[4]).alias("same"), "neutral")
    return out.crossJoin(provenance.select("data_source"))  # one row


@query("M08_calibrate")
def m08(spark, sf_dir):
    train, val = O.time_split(scored(spark, sf_dir), "day")
    out = M.calibrate(train, "p", "win", "platt")(val).withColumnRenamed("calibrated", "platt")
    return M.calibrate(train, "p", "win", "isotonic")(out).select("race", "post", "p", "platt", c("calibrated").alias("isotonic"))


@query("M09_auto_select")
def m09(spark, sf_dir):
    parts = O.three_way_time_split(scored(spark, sf_dir), "day")
    fit, hold, test = (parts.where(c("part") == p) for p in ("train", "calib", "test"))
    chosen = M.calibrate_auto(fit.drop("part"), "p", "win", hold.drop("part"))
    return chosen(test).select("race", "post", "calibrated", F.lit(chosen.method).alias("method"))


@query("M10_calibration_report")
def m10(spark, sf_dir):
    train, val = O.time_split(scored(spark, sf_dir), "day")
    return M.calibration_report(M.calibrate(train, "p", "win", "isotonic")(val), "p", "calibrated", "win")


@query("M12_plackett_luce_fit")
def m12(spark, sf_dir):
    """Strength of suppliers from the finishing orders of all races."""
    r = runners(spark, sf_dir).select(c("race").alias("order_id"), c("finish").alias("position"), c("jockey").alias("item"))
    return M.fit_plackett_luce(r)


@query("M13_stern_shape")
def m13(spark, sf_dir):
    r = runners(spark, sf_dir).select("race", c("post").alias("runner"), c("q").alias("v"))
    return M.fit_stern_shape(r, outcomes(spark, sf_dir, 2), (1, 2), 20)


@query("M14_infer_strengths")
def m14(spark, sf_dir):
    return M.infer_strengths(scored(spark, sf_dir).select("race", c("post").alias("runner"), "p")).select("race", "runner", "v")


@query("R04_stern_orders")
def r04(spark, sf_dir):
    return O.sample_orders(runners(spark, sf_dir).select("race", "post", "q"), "race", "post", "q", 5, shape=2)


@query("R05_copula_orders")
def r05(spark, sf_dir):
    return O.sample_orders(runners(spark, sf_dir).select("race", "post", "q", "style"), "race", "post", "q", 5, style="style", rho=0.3)


@query("R12_backtest")
def r12(spark, sf_dir):
    from ..operators.aggregates import backtest_summary

    usable = O.odds_cap(candidates(spark, sf_dir).withColumn("selection", F.array("post")), "race", "odds", 200.0)
    renormed = usable.withColumn("p", W.normalise_in_race(c("p"), W.race("race")))
    return backtest_summary(O.ev_candidates(renormed.select("race", "bet_type", "selection", "p"), usable.select("race", "bet_type", "selection", "odds"), 0.02))


# Streams


@query("T01_stream_ingest", "SELECT o_orderkey::VARCHAR AS key, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 0")
def t01(spark, sf_dir):
    """Arriving orders are mapped, scored and merged into a table by key. A second stream over the same files adds nothing."""
    spec = {"key": {"column": "o_orderkey"}, "price": {"column": "o_totalprice", "type": "double"}, "status": {"column": "o_orderstatus"}}
    score = lambda df: O.quality_score(df, {"done": c("status") == "F", "free": c("price") <= 0}, {"unknown": (c("status").isNull(), 0.2)})
    out = scratch(spark, "ingested")
    for _ in range(2):
        q = T.stream_ingest(stream_of(spark, sf_dir, "orders"), spec, score, out, "key", scratch(spark, "ingest")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out).select("key", "price")


def flat_lines(line: DataFrame) -> DataFrame:
    """Lines as flat results: orders are races, parts run in them. Some lack a surface, a horse, odds or a jockey, some races have several winners."""
    k, n = c("l_orderkey"), c("l_linenumber")
    return line.select(
        F.concat(F.lit("T"), k.cast("string")).alias("track"), F.date_add(F.lit("2000-01-01").cast("date"), (k % 700).cast("int")).alias("day"), (1 + k % 12).alias("number"), (5 + k % 4).cast("double").alias("furlongs"),
        F.when(k % 17 != 0, F.when(k % 2 == 0, "turf").otherwise("dirt")).alias("surface"), F.when(c("l_quantity") % 13 != 0, F.concat(F.lit("Horse "), c("l_partkey").cast("string"))).alias("horse"),
        F.when(c("l_suppkey") % 9 != 0, F.concat(F.lit("Rider "), c("l_suppkey").cast("string"))).alias("rider"), F.when(k % 10 == 0, 1).otherwise(n).alias("place"),
        F.when(n % 5 != 0, 1 + c("l_extendedprice") / 5000).alias("price"), (90 + c("l_quantity")).alias("weight"),
    )


FLAT = {
    "race_track_code": {"column": "track"}, "race_race_date": {"column": "day"}, "race_race_number": {"column": "number", "type": "int"}, "race_distance_furlongs": {"column": "furlongs", "type": "double"},
    "race_surface": {"column": "surface"}, "race_jurisdiction": {"const": "us"}, "horse_name_display": {"column": "horse"}, "horse_name_normalized": {"column": "horse"}, "jockey_name_display": {"column": "rider"},
    "jockey_name_normalized": {"column": "rider"}, "finish_position": {"column": "place", "type": "int"}, "odds_final": {"column": "price", "type": "double"}, "weight_lbs": {"column": "weight", "type": "double"},
}
FLAT_SQL = """WITH f AS (SELECT DISTINCT l_orderkey AS race, CASE WHEN l_quantity % 13 <> 0 THEN l_partkey END AS horse, CASE WHEN l_suppkey % 9 <> 0 THEN l_suppkey END AS rider, CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE l_linenumber END AS finish,
 CASE WHEN l_linenumber % 5 <> 0 THEN l_extendedprice END AS odds, 90 + l_quantity AS weight FROM lineitem)"""


@query("U03_star_counts", f"""{FLAT_SQL}, w AS (SELECT * FROM f WHERE race % 17 <> 0), n AS (SELECT count(DISTINCT race) AS races, count(DISTINCT horse) AS horses, count(DISTINCT rider) AS jockeys, 0 AS trainers, count(DISTINCT (race, horse)) FILTER (horse IS NOT NULL) AS race_results FROM w),
 t AS (SELECT count(*) FILTER (l_orderkey % 17 = 0) AS a, count(*) FILTER (l_orderkey % 17 <> 0 AND l_quantity % 13 = 0) AS b, count(*) FILTER (l_orderkey % 17 <> 0 AND l_quantity % 13 <> 0) AS c FROM lineitem)
 SELECT batch, what, CASE batch WHEN 'first' THEN n ELSE again END AS n FROM (VALUES ('first'), ('second')) b(batch), (SELECT 'races' AS what, races AS n, 0 AS again FROM n UNION ALL SELECT 'horses', horses, 0 FROM n UNION ALL SELECT 'jockeys', jockeys, 0 FROM n
 UNION ALL SELECT 'trainers', trainers, 0 FROM n UNION ALL SELECT 'race_results', race_results, 0 FROM n UNION ALL SELECT 'no surface', a, a FROM t UNION ALL SELECT 'no horse', b, b FROM t UNION ALL SELECT 'known', c - race_results, c FROM t, n)""")
def u03_star(spark, sf_dir):
    """The whole star from flat lines, twice: rows that each table got, rows left out by reason, rows whose result was known. The second run adds none."""
    flat = O.apply_field_map(flat_lines(table(spark, sf_dir, "lineitem")), FLAT)
    star = R.Star(spark, scratch(spark, "star"))
    R.load(star, flat, "first")
    R.load(star, flat, "second")
    counts = F.map_concat("inserted", "skipped", F.create_map(F.lit("known"), "n_duplicate"))
    return star.records().select("batch", F.explode(counts).alias("what", "n"))


@query("T01_stream_star", f"""{FLAT_SQL}, s AS (SELECT *, round(0.8 - CASE WHEN odds IS NULL THEN 0.1 ELSE 0 END - CASE WHEN rider IS NULL THEN 0.05 ELSE 0 END - CASE WHEN weight NOT BETWEEN 95 AND 145 THEN 0.1 ELSE 0 END, 4)::DOUBLE AS quality,
 sum((finish = 1)::INT) OVER (PARTITION BY race) AS winners, count(*) OVER (PARTITION BY race, horse) AS same FROM f WHERE race % 17 <> 0), b AS (SELECT *, max(CASE WHEN horse IS NOT NULL THEN same END) OVER (PARTITION BY race) AS twice FROM s)
 SELECT 'T' || race AS track, 'Horse ' || horse AS horse, finish, quality FROM b WHERE horse IS NOT NULL AND quality >= 0.6 AND winners <= 1 AND coalesce(twice, 1) <= 1""")
def t01_star(spark, sf_dir):
    """Arriving lines become a star whose races are judged as a whole. A second stream over the same files adds nothing."""
    root = scratch(spark, "star")
    for name in ("first", "second"):
        T.stream_star(flat_lines(stream_of(spark, sf_dir, "lineitem")), FLAT, root, name, scratch(spark, "star-log")).trigger(availableNow=True).start().awaitTermination()
    star = R.Star(spark, root)
    out = star.results().join(star.read("races").select("race_key", "track"), "race_key").join(star.read("horses").select("horse_key", c("name").alias("horse")), "horse_key")
    return out.select("track", "horse", c("finish").cast("long").alias("finish"), "quality")


@query("T04_stream_settle", """SELECT l_orderkey AS race, l_linenumber AS post, l_linenumber = 1 + o_orderkey % 3 AS won, round(CASE WHEN l_linenumber = 1 + o_orderkey % 3 THEN 1 + l_extendedprice / 5000 ELSE 0 END - 1, 9) AS pnl
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= l_shipdate AND o_orderdate <= l_shipdate + INTERVAL 60 DAY""")
def t04(spark, sf_dir):
    """Lines are bets at their ship date, orders are outcomes at their order date; those settle that come within sixty days."""
    line = stream_of(spark, sf_dir, "lineitem")
    bet = line.select(c("l_orderkey").alias("race"), F.array(c("l_linenumber").cast("long")).alias("selection"), F.lit(1.0).alias("stake"), (1 + c("l_extendedprice") / 5000).alias("odds"), c("l_shipdate").alias("placed"))
    done = stream_of(spark, sf_dir, "orders").select(c("o_orderkey").alias("race"), F.array(1 + c("o_orderkey") % 3).alias("finishing_order"), c("o_orderdate").alias("settled"))
    out = drained(T.stream_settle(bet, done, "placed", "settled", "60 days"), "settled")
    return out.select("race", F.get("selection", F.lit(0)).cast("int").alias("post"), "won", F.round("pnl", 9).alias("pnl"))


@query("T02_stream_outcomes", "SELECT count(DISTINCT user_id) AS n_keys, count(DISTINCT user_id) AS n_rows FROM events")
def t02(spark, sf_dir):
    first = T.stream_outcomes(stream_of(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "3650 days")
    return drained(first, "outcomes").agg(F.count_distinct("user_id").alias("n_keys"), F.count("*").alias("n_rows"))


CUSUM = """WITH e AS (SELECT event_id, user_id, ts, (value - 50) / 25 AS z FROM events),
 s AS (SELECT *, row_number() OVER w AS step, sum(z - 0.5) OVER w AS up, sum(-z - 0.5) OVER w AS down FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 t AS (SELECT *, up - least(0, min(up) OVER w) AS hi, down - least(0, min(down) OVER w) AS lo FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 a AS (SELECT user_id, min(step * 2 + CASE WHEN hi > 4 THEN 0 ELSE 1 END) AS f FROM t WHERE hi > 4 OR lo > 4 GROUP BY user_id)"""


def detected(spark, sf_dir) -> DataFrame:
    """The detector's rows, from a stream of the events."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        e = stream_of(spark, sf_dir, "events").select("user_id", "event_id", "ts", ((c("value") - 50) / 25).alias("z"))
        return drained(T.stream_cusum(e, "user_id"), "cusum")
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


@query("T03_stream_cusum", f"""{CUSUM}
 SELECT event_id, step, round(hi, 6) AS s_high, round(lo, 6) AS s_low, CASE WHEN step >= f // 2 THEN f // 2 END AS alarm_step, CASE WHEN step >= f // 2 THEN CASE WHEN f % 2 = 0 THEN 'high' ELSE 'low' END END AS direction FROM t LEFT JOIN a USING (user_id)""")
def t03(spark, sf_dir):
    return detected(spark, sf_dir).select("event_id", "step", r6(c("s_high"), "s_high"), r6(c("s_low"), "s_low"), "alarm_step", "direction")


@query("T05_stream_calibration", """SELECT w AS start, least(floor(value / 100 * 15), 14)::INT AS bin, count(*) AS n, round(avg(value / 100), 6) AS mean_p, round(avg((event_type = 'click')::INT), 6) AS mean_y
 FROM events, LATERAL (SELECT unnest(range(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS w) GROUP BY 1, 2""")
def t05(spark, sf_dir):
    """A stream that rewrites its whole result with each batch, as the last windows stay open."""
    e = stream_of(spark, sf_dir, "events").select("ts", (c("value") / 100).alias("p"), (c("event_type") == "click").cast("int").alias("y"))
    out = scratch(spark, "calibration")
    windows = T.stream_calibration(e, "ts", "p", "y").writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    windows.option("checkpointLocation", scratch(spark, "calibration-log")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(c("w.start").cast("timestamp_ntz").alias("start"), "bin", "n", r6(c("mean_p"), "mean_p"), r6(c("mean_y"), "mean_y"))


@query("T06_drift_flag", f"{CUSUM} SELECT count(*) > 0 AS triggered, min(ts) AS since FROM t JOIN a USING (user_id) WHERE step >= f // 2")
def t06(spark, sf_dir):
    """Whether any detector of the stream has raised its alarm, and since when."""
    return T.drift_flag(detected(spark, sf_dir), "ts").withColumn("since", c("since").cast("timestamp_ntz"))


# Cards and text


def card_table(spark, sf_dir) -> DataFrame:
    r = runners(spark, sf_dir)
    past = F.array(F.struct(c("day"), c("finish").cast("int").alias("finish"), c("figure")))
    e = r.groupBy("trainer", "race").agg(F.array_sort(F.collect_list(F.struct(c("post").cast("int").alias("post"), c("entity").cast("string").alias("horse"), c("jockey").cast("string").alias("jockey"), c("odds"), F.when(c("figure").isNotNull(), past).otherwise(F.array().cast("array<struct<day:date,finish:int,figure:double>>")).alias("history")))).alias("entries"), F.first("q").alias("q"))
    return e.groupBy(c("trainer").alias("card")).agg(F.array_sort(F.collect_list(F.struct(c("race").alias("number"), F.lit(0.7).alias("confidence"), "entries"))).alias("races"))


@query("P15_nested_cards", f"{RUN} SELECT trainer AS card, race AS number, count(*) AS n_entries, count(figure) AS n_past FROM run GROUP BY 1, 2")
def p15(spark, sf_dir):
    """Down to rows, up again, and counted."""
    again = C.nest_card(C.unnest_card(card_table(spark, sf_dir), "card"), "card")
    r = again.select("card", F.explode("races").alias("r"))
    past = F.aggregate("r.entries", F.lit(0).cast("long"), lambda a, e: a + F.coalesce(F.size(e["history"]), F.lit(0)))
    return r.select("card", "r.number", F.size("r.entries").cast("long").alias("n_entries"), past.alias("n_past"))


@query("P10_enough_data", f"{RUN} SELECT race, count(figure) >= 4 AS enough FROM run GROUP BY race")
def p10(spark, sf_dir):
    r = card_table(spark, sf_dir).select(F.explode("races").alias("r"))
    return r.select(c("r.number").alias("race"), C.has_enough_data(c("r.entries"), c("r.confidence")).alias("enough"))


@query("P11_hydrate_card", f"{RUN}, pr AS (SELECT race, post, q / sum(q) OVER (PARTITION BY race) AS mp, (1 / odds) / sum(1 / odds) OVER (PARTITION BY race) AS kp FROM run) SELECT run.race, run.post, round(mp - kp, 6) AS edge FROM run LEFT JOIN pr ON run.race = pr.race AND run.post = pr.post")
def p11(spark, sf_dir):
    r, w = runners(spark, sf_dir), W.race("race")
    probs = r.select("race", "post", W.normalise_in_race(c("q"), w).alias("model_prob"), W.normalise_in_race(1 / c("odds"), w).alias("market_prob"))
    return C.hydrate_card(r.select("race", "post", "entity"), probs).select("race", "post", r6(c("edge"), "edge"))


@query("X01_segment_blocks", r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
 b AS (SELECT *, sum(regexp_matches(line, '^The ')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM l) SELECT doc_id, block::BIGINT AS block, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM b WHERE block > 0 GROUP BY 1, 2""")
def x01(spark, sf_dir):
    b = C.segment_blocks(table(spark, sf_dir, "documents"), "doc_id", "text", "^The ")
    return b.groupBy("doc_id", c("block").cast("long")).agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars")).withColumnRenamed("CAST(block AS BIGINT)", "block")


def _program(spark, sf_dir) -> DataFrame:
    """Race cards as text, written from the contest view: one document per trainer."""
    r = runners(spark, sf_dir)
    line = F.concat_ws("\n", F.format_string("%d. Horse %d", "post", "entity"), F.format_string("Jockey: Rider %d", "jockey"), F.format_string("Weight: %d", c("q").cast("long")), F.format_string("Odds: %d-1", c("q").cast("long")), F.format_string("%s T%d %d %d a b c d", c("day").cast("string"), "jockey", "finish", c("q").cast("long")))
    race = r.groupBy("trainer", "race").agg(F.concat_ws("\n", F.concat(F.lit("Race "), c("race").cast("string")), F.lit("6 Furlongs Turf Claiming 2001-02-03"), F.lit("Purse: $12,000"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("post", line.alias("l")))), lambda x: x["l"]), "\n")).alias("t"))
    return _documents(race, LINES * table(spark, sf_dir, "lineitem").count())


#: Lines of text that a runner has, about.
LINES = 6


def _documents(race: DataFrame, n_lines: int) -> DataFrame:
    """Texts of races, one after another by trainer. Their lines are sorted and read where documents are made, so documents are dealt by the number of lines."""
    race = dealt(race.withColumnRenamed("trainer", "doc"), "doc", n_lines)
    return race.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("race", "t"))), lambda x: x["t"]), "\n").alias("body"))


def _blocks(spark, sf_dir) -> DataFrame:
    return C.segment_blocks(_program(spark, sf_dir), "doc", "body", r"^Race \d+$")


RUNNER = r"(?m)^(\d+)\. (.+)$"


@query("X02_extract_header", f"{RUN} SELECT trainer AS doc, count(DISTINCT race) AS n, 6e0 AS distance, 'claiming' AS race_type, 12000e0 AS purse, 'turf' AS surface FROM run GROUP BY trainer")
def x02(spark, sf_dir):
    return C.extract_header(_blocks(spark, sf_dir), "doc").groupBy("doc", "distance", "race_type", "purse", "surface").agg(F.count("*").alias("n"))


@query("X02_full_header", f"""{RUN} SELECT DISTINCT trainer AS doc, race, CASE race % 3 WHEN 0 THEN 6e0 WHEN 1 THEN 8.5e0 ELSE 5.5e0 END AS distance, CASE WHEN race % 2 = 0 THEN 'turf' ELSE 'dirt' END AS surface, CASE WHEN race % 5 = 0 THEN 'unknown' WHEN race % 2 = 0 THEN 'firm' ELSE 'muddy' END AS condition,
 CASE WHEN race % 7 > 0 THEN 'SAR' END AS track, CASE WHEN race % 7 > 0 THEN DATE '2001-01-01' + (race % 300)::INT END AS day, CASE WHEN race % 4 = 0 THEN 1000e0 * (1 + race % 40) END AS claiming_price, CASE WHEN race % 4 = 1 THEN 1 + race % 3 END AS grade, 12000e0 AS purse FROM run""")
def x02_full(spark, sf_dir):
    """Headers whose fields vary by race; some have no track, date, condition, price or grade."""
    k = c("race")
    first = F.when(k % 7 > 0, F.concat(F.lit("SAR Saratoga "), F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), (k % 300).cast("int")), "M/d/yyyy"))).otherwise("Anywhere")
    length = F.when(k % 3 == 0, "6 Furlongs").when(k % 3 == 1, "1 1/16 Miles").otherwise("5½f")
    ground = F.concat_ws(" ", length, F.when(k % 2 == 0, "Turf").otherwise("Dirt"), F.when(k % 5 != 0, F.when(k % 2 == 0, "(FIRM)").otherwise("Muddy")))
    kind = F.when(k % 4 == 0, F.format_string("Claiming Price: $%,d", 1000 * (1 + k % 40))).when(k % 4 == 1, F.concat(F.lit("Stakes, Grade "), F.element_at(F.array(F.lit("I"), F.lit("2"), F.lit("iii")), (1 + k % 3).cast("int")))).otherwise("Allowance")
    race = runners(spark, sf_dir).select("trainer", "race").distinct().withColumn("t", F.concat_ws("\n", F.concat(F.lit("Race "), k.cast("string")), first, ground, kind, F.lit("Purse: $12,000")))
    docs = _documents(race, LINES * table(spark, sf_dir, "orders").count())
    blocks = C.segment_blocks(docs, "doc", "body", r"^Race \d+$")
    names = blocks.where(c("line").rlike(r"^Race \d+$")).select("doc", "block", F.regexp_extract("line", r"(\d+)", 1).cast("long").alias("race"))
    return C.extract_header(blocks, "doc").join(names, ["doc", "block"]).select("doc", "race", "distance", "surface", "condition", "track", "day", "claiming_price", c("grade").cast("long").alias("grade"), "purse")


@query("X03_extract_entries", f"{RUN} SELECT trainer AS doc, dense_rank() OVER (PARTITION BY trainer ORDER BY race) AS block, post, 'Horse ' || entity AS name, 'Rider ' || jockey AS jockey, CAST(q AS DOUBLE) AS weight, CASE WHEN q >= 0 THEN q + 1e0 END AS odds FROM run")
def x03(spark, sf_dir):
    e = C.extract_entries(_blocks(spark, sf_dir), "doc", RUNNER)
    return e.select("doc", c("block").cast("long"), c("post").cast("long"), "name", "jockey", "weight", "odds").toDF("doc", "block", "post", "name", "jockey", "weight", "odds")


@query("X03_entry_flags", f"{RUN} SELECT trainer AS doc, dense_rank() OVER (PARTITION BY trainer ORDER BY race) AS block, post, 'Horse ' || entity AS name, CASE post % 4 WHEN 0 THEN [] WHEN 1 THEN ['L'] WHEN 2 THEN ['B'] ELSE ['B', 'L'] END AS flags FROM run")
def x03_flags(spark, sf_dir):
    """Runners with letters behind their names."""
    post = F.regexp_extract("line", r"^(\d+)\. ", 1).try_cast("int") % 4
    marks = F.concat(c("line"), F.lit(" ["), F.when(post == 1, "L").when(post == 2, "B").when(post == 3, "LLB").otherwise(""), F.lit("]"))
    blocks = _blocks(spark, sf_dir).withColumn("line", F.when(c("line").rlike(r"^\d+\. "), marks).otherwise(c("line")))
    return C.extract_entries(blocks, "doc", r"(?m)^(\d+)\. (.+?) \[\w*\]$").select("doc", c("block").cast("long").alias("block"), c("post").cast("long").alias("post"), "name", "flags")


@query("X04_extract_history", f"{RUN} SELECT trainer AS doc, day, 'T' || jockey AS track, finish, CAST(q AS DOUBLE) AS figure FROM run")
def x04(spark, sf_dir):
    return C.extract_history(_blocks(spark, sf_dir), "doc", RUNNER).select("doc", "day", "track", c("finish").cast("long").alias("finish"), "figure")


@query("X05_cards_from_json", f"{RUN} SELECT race, track, count(*) FILTER (q > 5) AS n_entries, max(odds) FILTER (q > 5 AND odds <= 10) AS most_odds, CASE WHEN race % 2 = 0 THEN 'turf' ELSE 'unknown' END AS surface FROM run GROUP BY race, track")
def x05(spark, sf_dir):
    r = runners(spark, sf_dir)
    e = F.struct(F.when(c("q") > 5, c("post").cast("string")).otherwise("x").alias("post"), F.lit("h").alias("horse"), F.when(c("odds") <= 10, c("odds").cast("string")).otherwise("5000").alias("odds"))
    j = r.groupBy("race", "track").agg(F.collect_list(e).alias("entries"))
    body = F.to_json(F.struct("track", F.lit("2020-01-02").alias("card_date"), F.array(F.struct(F.lit("1").alias("number"), F.when(c("race") % 2 == 0, "Turf").otherwise("sand").alias("surface"), "entries")).alias("races")))
    out = C.cards_from_json_text(j.select("race", F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone {}")).alias("body")), "body")
    return out.select("race", "track", F.size(c("races")[0]["entries"]).cast("long").alias("n_entries"), F.array_max(F.transform(c("races")[0]["entries"], lambda x: x["odds"])).alias("most_odds"), c("races")[0]["surface"].alias("surface"))


def json_cards(spark, sf_dir) -> DataFrame:
    """Orders as race cards in JSON within words: braces in the words and in names, values out of range, runners without a post, a second object behind the first."""
    r = runners(spark, sf_dir)
    text = lambda x: x.cast("string")
    past = F.struct(F.date_format(c("day"), "M/d/yyyy").alias("race_date"), F.lit("bel").alias("track_code"), F.when(c("q") > 20, "30").otherwise("6").alias("distance_furlongs"), text(c("post")).alias("post_position"), text(c("q")).alias("speed_figure"))
    e = F.struct(
        F.concat(F.lit('Horse "'), text(c("entity")), F.lit('" }{')).alias("horse_name"), F.when(c("q") > 5, text(c("post"))).otherwise("none").alias("post_position"), F.when(c("odds") <= 10, text(c("odds"))).otherwise("5000").alias("morning_line_odds"),
        (90 + c("q")).alias("weight_lbs"), F.when(c("figure").isNotNull(), F.array(past)).alias("pp_lines"),
    )
    j = r.groupBy("race", "track", "purse").agg(F.collect_list(e).alias("entries"))
    card = F.struct((1 + c("race") % 24).alias("race_number"), F.lit("2020-01-02").alias("race_date"), F.lit("sar").alias("track_code"), F.lit("8").alias("distance_furlongs"), F.when(c("race") % 2 == 0, "Turf").otherwise("sand").alias("surface"), F.lit("Maiden Claiming").alias("race_type"), F.format_string("$%,.2f", "purse").alias("purse_usd"), (c("race") % 5).alias("grade"), "entries")
    return j.select("race", F.concat(F.lit("A 5\" card {draft}: "), F.to_json(F.struct(F.array(card).alias("races"))), F.lit(' and {"races": []} too }')).alias("body"))


@query("X05_full_cards", f"""{RUN} SELECT race, 1 + race % 24 AS number, CASE WHEN race % 2 = 0 THEN 'turf' ELSE 'unknown' END AS surface, round(purse, 2) AS purse, CASE WHEN race % 5 BETWEEN 1 AND 3 THEN race % 5 END AS grade, count(*) FILTER (q > 5) AS n_entries,
 count(*) FILTER (q > 5 AND figure IS NOT NULL AND q <= 20) AS n_past, max(odds) FILTER (q > 5 AND odds <= 10) AS most_odds, count(*) FILTER (q > 5 AND q <= 55) AS n_weights,
 round(0.4 + 0.6 * CASE WHEN count(*) FILTER (q > 5) = 0 THEN 0 ELSE count(*) FILTER (q > 5 AND figure IS NOT NULL AND q <= 20) / count(*) FILTER (q > 5) END, 3) AS confidence,
 min(day) FILTER (q > 5 AND figure IS NOT NULL AND q <= 20) AS first_past FROM run WHERE race % 24 < 20 GROUP BY race, purse""")
def x05_full(spark, sf_dir):
    from ..operators.jsoncards import full_cards_from_json_text

    # Of an inner explode Spark infers a filter on the races, for which it would make them again.
    r = full_cards_from_json_text(json_cards(spark, sf_dir), "body").select("race", F.explode_outer("races").alias("r")).where("r IS NOT NULL")
    e = c("r.entries")
    past = F.flatten(F.transform(e, lambda x: x["history"]))
    count = lambda x: F.size(x).cast("long")
    return r.select(
        "race", c("r.number").cast("long").alias("number"), "r.surface", "r.purse", c("r.grade").cast("long").alias("grade"), count(e).alias("n_entries"), count(past).alias("n_past"), F.array_max(F.transform(e, lambda x: x["odds"])).alias("most_odds"),
        count(F.filter(e, lambda x: x["weight"].between(95, 145))).alias("n_weights"), c("r.confidence").alias("confidence"), F.array_min(F.transform(past, lambda x: x["race_date"])).alias("first_past"),
    )


# Files


@query("S01_csv_source", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus FROM orders")
def s01(spark, sf_dir):
    path = scratch(spark, "csv")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").write.option("header", True).csv(path)
    return S.read_csv_source(spark, path)


@query("S02_bundle", "SELECT o_orderkey::VARCHAR AS run_id, o_custkey::VARCHAR AS race_id, o_orderpriority AS name, c_name AS name_dim FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def s02(spark, sf_dir):
    path = scratch(spark, "bundle")
    table(spark, sf_dir, "orders").select(c("o_orderkey").alias("run_id"), c("o_custkey").alias("race_id"), c("o_orderpriority").alias("name")).write.option("header", True).csv(f"{path}/runs")
    table(spark, sf_dir, "customer").select(c("c_custkey").alias("race_id"), c("c_name").alias("name")).write.option("header", True).csv(f"{path}/races")
    return registry.read_source(spark, "runs_and_races", path).select("run_id", "race_id", "name", "name_dim")


@query("L06_largest_file", "SELECT n_name AS name FROM nation")
def l06(spark, sf_dir):
    """Of a folder with the names of nations and of regions, the larger file."""
    path = scratch(spark, "files")
    table(spark, sf_dir, "nation").select(c("n_name").alias("name")).coalesce(1).write.option("header", True).csv(path)
    table(spark, sf_dir, "region").select(c("r_name").alias("name")).coalesce(1).write.option("header", True).mode("append").csv(path)
    return S.read_csv_source(spark, path, largest=True)


@query("S04_cards", f"{RUN} SELECT trainer::VARCHAR AS source, race AS number, count(*) AS n_entries, round(sum(odds), 9) AS sum_odds FROM run GROUP BY 1, 2")
def s04(spark, sf_dir):
    path = scratch(spark, "cards")
    card_table(spark, sf_dir).select(c("card").cast("string").alias("source"), "races").write.json(path)
    r = S.read_cards(spark, path).select("source", F.explode("races").alias("r"))
    odds = F.aggregate("r.entries", F.lit(0.0), lambda a, e: a + e["odds"])
    return r.select("source", c("r.number").cast("long").alias("number"), F.size("r.entries").cast("long").alias("n_entries"), F.round(odds, 9).alias("sum_odds"))


@query("S07_create_tables", "SELECT DISTINCT l_suppkey::VARCHAR AS jockey_key FROM lineitem")
def s07(spark, sf_dir):
    """Made twice and filled twice: nothing is lost and nothing doubled."""
    root = scratch(spark, "star")
    for _ in range(2):
        S.create_tables(spark, root)
        have = spark.read.schema(S.STAR["jockeys"]).parquet(f"{root}/jockeys")
        new = table(spark, sf_dir, "lineitem").select(c("l_suppkey").cast("string").alias("jockey_key"), F.lit("x").alias("name"), F.lit("us").alias("jurisdiction"))
        O.insert_if_absent(new, have, "jockey_key").write.mode("append").parquet(f"{root}/jockeys")
    return spark.read.schema(S.STAR["jockeys"]).parquet(f"{root}/jockeys").select("jockey_key")


@query("S09_report", "SELECT count(*) AS n_rows, max(l_quantity) AS most FROM lineitem")
def s09(spark, sf_dir):
    path = scratch(spark, "report")
    S.write_report(table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n_rows"), F.max("l_quantity").alias("most")), path)
    return spark.read.schema("n_rows long, most double").json(path)


@query("D03_field_map", "SELECT o_orderkey::VARCHAR AS key, 'us' AS jurisdiction, o_totalprice AS purse, CAST(NULL AS VARCHAR) AS weather FROM orders")
def d03(spark, sf_dir):
    maps = registry.FieldMaps()
    maps.load("orders", json.dumps({"key": {"column": "o_orderkey"}, "jurisdiction": {"const": "us"}, "purse": {"column": "o_totalprice", "type": "double"}, "weather": {"column": "absent"}}))
    return maps.apply(table(spark, sf_dir, "orders"), "orders")


@query("S03_training_table", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS l_shipdate, CASE WHEN l_quantity % 7 <> 0 THEN l_quantity END AS l_quantity FROM lineitem")
def s03(spark, sf_dir):
    path = scratch(spark, "training")
    S.write_parquet(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.when(c("l_quantity") % 7 != 0, c("l_quantity")).otherwise(float("nan")).alias("l_quantity"), "l_returnflag"), path, ["l_returnflag"])
    return S.read_training_table(spark, path, "l_shipdate", ["l_quantity"]).drop("l_returnflag")


@query("S06_rejects", f"{RUN} SELECT race, post, len(list_filter([claim IS NULL, figure IS NULL], lambda x: x)) AS n FROM run WHERE claim IS NULL OR figure IS NULL")
def s06(spark, sf_dir):
    path = scratch(spark, "rejects")
    S.write_rejects(O.split_valid(runners(spark, sf_dir), ["claim", "figure"])[1].select("race", "post", "reasons"), path)
    return spark.read.schema("race long, post long, reasons array<string>").json(path).select("race", "post", F.size("reasons").cast("long").alias("n"))


@query("S08_register_dataset", "SELECT DISTINCT source, 'documents' AS file, lang AS version FROM documents")
def s08(spark, sf_dir):
    root = scratch(spark, "star")
    S.create_tables(spark, root)
    new = table(spark, sf_dir, "documents").select("source", F.lit("documents").alias("file"), c("lang").alias("version"))
    S.register_dataset(spark, root, new)
    S.register_dataset(spark, root, new)  # adds nothing
    return spark.read.schema(S.STAR["datasets"]).parquet(f"{root}/datasets").select("source", "file", "version")


@query("S10_provenance", "SELECT 'speed' AS model, count(*)::VARCHAR AS data_source, false AS synthetic FROM lineitem")
def s10(spark, sf_dir):
    path = scratch(spark, "provenance")
    S.write_provenance(table(spark, sf_dir, "lineitem").agg(F.count("*").cast("string").alias("data_source")).select(F.lit("speed").alias("model"), "data_source", F.lit("2020-01-01").cast("timestamp").alias("trained_at"), F.lit(False).alias("synthetic")), path)
    return S.read_provenance(spark, path).select("model", "data_source", "synthetic")


@query("S11_drift_flag", f"{CUSUM} SELECT count(*) > 0 AS triggered FROM a")
def s11(spark, sf_dir):
    path = scratch(spark, "drift")
    S.write_drift_flag(t06(spark, sf_dir), path)
    return S.read_drift_flag(spark, path).select("triggered")
