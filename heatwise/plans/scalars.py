"""Column functions over expressions of the given tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pricing as P
from ..functions import text as T
from ..functions import units as U
from .base import RUN, query, runners, table

c = F.col
LINES = "l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, CAST(l_quantity AS BIGINT) AS q, l_extendedprice AS price"


def _ready() -> None:
    """Shared columns: they need a session, so they are made when the first query runs."""
    global q, k2, going, ratios, odds, pool
    q, k2 = c("q"), c("k2")
    going = F.when(q % 3 == 0, "Standard to Slow").when(q % 3 == 1, "Good to Firm").otherwise("Soft")
    ratios = P.fraction_ratios(q.cast("double"), (k2 - 1).cast("double"), c("price"))
    odds = k2 + 1.5
    pool = F.when(k2 != 1, c("price"))


def _lines(name: str, columns, sql: str):
    """A query over line items: columns from k1..k4, q (a whole number) and price."""

    @query(name, f"WITH l AS (SELECT {LINES} FROM lineitem) SELECT k1, k2, k3, k4, q, price, {sql} FROM l")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _ready()
        line = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("k1"), c("l_linenumber").alias("k2"), c("l_partkey").alias("k3"), c("l_suppkey").alias("k4"), c("l_quantity").cast("long").alias("q"), c("l_extendedprice").alias("price"))
        return line.select("*", *[v.alias(k) for k, v in columns().items()])


def s(x) -> F.Column:
    return x.cast("string")


_lines("F01_metres_to_furlongs", lambda: {"f": U.metres_to_furlongs(s(q * 100)), "bad": U.metres_to_furlongs(F.lit("x"))}, "round(q * 100 / 201.168, 4) AS f, CAST(NULL AS DOUBLE) AS bad")
_lines("F02_uk_distance", lambda: {"f": U.uk_distance_to_furlongs(F.concat(s(k2), F.lit("m"), s(q % 8), F.lit("f "), s(q), F.lit("y"))), "n": U.uk_distance_to_furlongs(s(q)), "z": U.uk_distance_to_furlongs(F.lit("0f"))}, "round(k2 * 8 + q % 8 + q / 220, 4) AS f, CAST(q AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS z")
_lines("F03_text_distance", lambda: {"a": U.text_distance_to_furlongs(F.concat(s(k2), F.lit(" 1/"), s(q), F.lit(" Miles"))), "b": U.text_distance_to_furlongs(F.concat(F.lit("About "), s(q), F.lit("½f"))), "y": U.text_distance_to_furlongs(F.concat(F.lit("1 Mile "), s(q), F.lit(" Yards"))), "w": U.text_distance_to_furlongs(F.concat(s(q), F.lit("¾ miles"))), "x": U.text_distance_to_furlongs(F.concat(s(q * 11), F.lit(" yards")))}, "round((q + 0.75e0) * 8, 4) AS w, round(q / 20, 4) AS x, round((k2 + 1.0 / q) * 8, 4) AS a, q + 0.5e0 AS b, round(8 + q / 220, 4) AS y")
_lines("F04_kg_to_lbs", lambda: {"lbs": U.kg_to_lbs(s(q - 10))}, "CASE WHEN q > 10 THEN round((q - 10) / 0.45359237e0, 2) END AS lbs")
_lines("F05_stones_to_lbs", lambda: {"lbs": U.stones_to_lbs(F.concat(s(k2), F.lit("-"), s(q % 14)))}, "CAST(k2 * 14 + q % 14 AS DOUBLE) AS lbs")
_lines("F06_odds_to_decimal", lambda: {"o": U.odds_to_decimal(F.concat(s(q), F.lit("/"), s(k2 - 1))), "e": U.odds_to_decimal(F.lit(" evens ")), "n": U.odds_to_decimal(s(q - 5))}, "CASE WHEN k2 > 1 THEN round(q / (k2 - 1) + 1, 4) END AS o, 2e0 AS e, CASE WHEN q > 5 THEN CAST(q - 5 AS DOUBLE) END AS n")
_lines("F07_card_odds", lambda: {"n": U.card_odds_to_decimal(s(q * 30)), "o": U.card_odds_to_decimal(F.concat(s(q), F.lit("-"), s(k2)))}, "CASE WHEN q * 30 <= 1001 THEN CAST(q * 30 AS DOUBLE) END AS n, round(q / k2 + 1, 4) AS o")
_lines("F08_sp_to_decimal", lambda: {"o": U.sp_to_decimal(F.concat(s(q), F.lit("/"), s(k2), F.lit("F"))), "e": U.sp_to_decimal(F.lit("EvensF"))}, "round(q / k2 + 1, 4) AS o, 2e0 AS e")
GOING = "CASE WHEN q % 3 = 0 THEN 'Standard to Slow' WHEN q % 3 = 1 THEN 'Good to Firm' ELSE 'Soft' END"
_lines("F09_going_to_surface", lambda: {"surface": U.going_to_surface(going, k2 == 1)}, "CASE WHEN k2 = 1 OR q % 3 = 0 THEN 'synthetic' ELSE 'turf' END AS surface")
# All pairs of ground words, with three ways to join them.
GROUNDS = ["Firm", "Good", "Soft", "Heavy", "Yielding", "Standard", "Fast", "Slow"]
JOINS = [" to ", ", ", " (in places) "]


def _ground() -> F.Column:
    pick = lambda of, at: F.element_at(F.array(*map(F.lit, of)), (at + 1).cast("int"))
    return F.concat(pick(GROUNDS, c("k3") % 8), pick(JOINS, q % 3), pick(GROUNDS, c("k4") % 8))


GROUND = f"lower({GROUNDS}[(k3 % 8 + 1)::INT] || {JOINS}[(q % 3 + 1)::INT] || {GROUNDS}[(k4 % 8 + 1)::INT])"
_lines("F10_uk_going", lambda: {"condition": U.uk_going_to_condition(_ground())}, f"CASE WHEN starts_with({GROUND}, 'standard') THEN 'fast' WHEN contains({GROUND}, 'heavy') THEN 'heavy' WHEN contains({GROUND}, 'soft') AND NOT contains({GROUND}, 'good') THEN 'soft' WHEN contains({GROUND}, 'good') AND (contains({GROUND}, 'soft') OR contains({GROUND}, 'firm')) THEN 'good' WHEN contains({GROUND}, 'firm') THEN 'fast' WHEN contains({GROUND}, 'good') THEN 'good' ELSE {GROUND} END AS condition")
_lines("F11_hk_going", lambda: {"condition": U.hk_going_to_condition(_ground())}, f"CASE WHEN contains({GROUND}, 'heavy') THEN 'heavy' WHEN contains({GROUND}, 'soft') THEN 'soft' WHEN contains({GROUND}, 'yielding') THEN CASE WHEN contains({GROUND}, 'good') THEN 'good' ELSE 'yielding' END WHEN contains({GROUND}, 'good') THEN 'good' WHEN contains({GROUND}, 'fast') THEN 'fast' ELSE {GROUND} END AS condition")
_lines("F13_time_to_seconds", lambda: {"t": U.time_to_seconds(F.concat(s(k2), F.lit(":"), F.lpad(s(q), 2, "0"), F.lit(".25"))), "u": U.time_to_seconds(F.concat(F.lit(":"), s(q), F.lit(".5"))), "n": U.time_to_seconds(s(q - 3))}, "k2 * 60 + q + 0.25e0 AS t, q + 0.5e0 AS u, CASE WHEN q > 3 THEN CAST(q - 3 AS DOUBLE) END AS n")
_lines("F14_clock_to_minutes", lambda: {"m": U.clock_to_minutes(F.concat(s(k2 * 5), F.lit(":"), F.lpad(s(q), 2, "0")))}, "CASE WHEN k2 * 5 < 24 AND q < 60 THEN CAST(k2 * 300 + q AS INTEGER) END AS m")
_lines("F15_first_number", lambda: {"i": U.first_int(F.concat(F.lit("no "), s(q), F.lit(" of 9"))), "d": U.first_number(F.concat(F.lit("up -"), s(q), F.lit(".5 x"))), "m": U.money(F.concat(F.lit("$1,"), F.lpad(s(q), 3, "0")))}, "CAST(q AS INTEGER) AS i, -(q + 0.5e0) AS d, CAST(1000 + q AS DOUBLE) AS m")
_lines("F16_fx_to_usd", lambda: {"gbp": U.fx_to_usd(s(q), 1.27), "hkd": U.fx_to_usd(s(q * 10), 0.128)}, "round(q * 1.27e0, 2) AS gbp, round(q * 10 * 0.128e0, 2) AS hkd")
_lines("F21_coerce", lambda: {"i": U.coerce_int(F.concat(s(q), F.lit(".9"))), "f": U.coerce_float(F.when(k2 == 1, "NaN").otherwise(s(q))), "d": U.coerce_date(F.when(k2 == 1, "2020-02-30").otherwise(F.concat(F.lit("2020/01/"), F.lpad(s(q % 28 + 1), 2, "0")))), "t": U.coerce_str(F.when(k2 == 1, "  ").otherwise(" a "))}, "CAST(q AS INTEGER) AS i, CASE WHEN k2 <> 1 THEN CAST(q AS DOUBLE) END AS f, CASE WHEN k2 <> 1 THEN DATE '2020-01-01' + CAST(q % 28 AS INTEGER) END AS d, CASE WHEN k2 <> 1 THEN 'a' END AS t")
_lines("F22_is_missing", lambda: {"a": U.is_missing(F.when(k2 == 1, "  ").when(k2 == 2, F.lit(None)).otherwise("x")), "b": U.is_missing(F.when(k2 == 1, F.lit(float("nan"))).otherwise(c("price")), True)}, "k2 <= 2 AS a, k2 = 1 AS b")
_lines("F24_implied_prob", lambda: {"p": F.round(P.implied_prob(q - 5), 6)}, "CASE WHEN q > 5 THEN round(1 / (q - 5), 6) END AS p")
_lines("F25_layoff_fitness", lambda: {"fit": F.round(P.layoff_fitness(F.when(k2 != 1, q * 3 - 10)), 6)}, "CASE WHEN k2 = 1 THEN 0.6 WHEN q * 3 - 10 <= 30 THEN 1 ELSE round(exp(-(ln(2) / 60) * (q * 3 - 40)), 6) END AS fit")
_lines("F26_validate_ranges", lambda: {"broken": P.validate_ranges({"few": q >= 10, "many": q <= 40, "unknown": F.lit(None).cast("boolean")})}, "list_filter([CASE WHEN q < 10 THEN 'few' END, CASE WHEN q > 40 THEN 'many' END], lambda x: x IS NOT NULL) AS broken")
_lines("F27_fractions", lambda: {"a": F.round(ratios[0], 6), "b": F.round(ratios[1], 8), "early": P.early_speed(q), "late": P.late_kick(q, k2)}, "CASE WHEN k2 > 1 THEN round(q / (k2 - 1), 6) END AS a, round((k2 - 1 - q) / price, 8) AS b, -q AS early, q - k2 AS late")
_lines("F28_expected_value", lambda: {"ev": F.round(P.expected_value(q / 50, k2 + 1.5), 6)}, "round(q / 50 * (k2 + 1.5e0) - 1, 6) AS ev")
_lines("F29_kelly", lambda: {"edge": F.round(P.kelly_fraction(q / 50, odds), 6), "prob": F.round(P.kelly_fraction(q / 50, odds, basis="prob"), 6), "capped": F.round(P.bet_cap(P.kelly_fraction(q / 50, odds)), 6)}, "round(greatest(0, (q / 50 * (k2 + 1.5e0) - (1 - q / 50)) / (k2 + 1.5e0)) * 0.25, 6) AS edge, round(greatest(0, (q / 50 * (k2 + 0.5e0) - (1 - q / 50)) / (k2 + 0.5e0)) * 0.25, 6) AS prob, round(least(greatest(0, (q / 50 * (k2 + 1.5e0) - (1 - q / 50)) / (k2 + 1.5e0)) * 0.25, 0.03), 6) AS capped")
_lines("F30_post_bet_odds", lambda: {"after": F.round(P.post_bet_odds(odds, (q - 1).cast("double"), pool, 0.17), 6), "backed": F.round(P.inferred_pool_share(odds, pool, 0.17), 4), "takeout": P.takeout_of(F.when(k2 == 1, "Trifecta").when(k2 == 2, "exacta").when(k2 == 3, "odd").otherwise("place"))}, "CASE k2 WHEN 1 THEN 0.25e0 WHEN 2 THEN 0.21e0 ELSE 0.17e0 END AS takeout, round(CASE WHEN k2 = 1 OR q <= 1 THEN k2 + 1.5e0 ELSE 0.83e0 * (price + q - 1) / (0.83e0 * price / (k2 + 1.5e0) + q - 1) END, 6) AS after, CASE WHEN k2 <> 1 THEN round(0.83e0 * price / (k2 + 1.5e0), 4) END AS backed")
_lines("F31_logit_loss", lambda: {"logit": F.round(P.clip_logit(q / 50), 5), "loss": F.round(P.log_loss_term(q / 50, k2 % 2), 6)}, "round(ln(greatest(1e-9, least(1 - 1e-9, q / 50)) / (1 - greatest(1e-9, least(1 - 1e-9, q / 50)))), 5) AS logit, round(-(k2 % 2 * ln(greatest(1e-7, least(1 - 1e-7, q / 50))) + (1 - k2 % 2) * ln(1 - greatest(1e-7, least(1 - 1e-7, q / 50)))), 6) AS loss")
_lines("F32_bernoulli_z", lambda: {"z": F.round(P.bernoulli_z(q / 50, k2 % 2), 6)}, "round(greatest(-5, least(5, (k2 % 2 - q / 50) / sqrt(greatest(q / 50 * (1 - q / 50), 1e-4)))), 6) AS z")
_lines("F33_pnl_z", lambda: {"z": F.round(P.pnl_z(F.lit(0.1), q - 20.0, k2.cast("double"), F.when(k2 != 2, q / 60), odds), 6)}, "round(greatest(-5, least(5, (q - 20 - 0.1e0 * k2) / greatest(CASE WHEN k2 <> 2 THEN k2 * sqrt(greatest(q / 60 * (1 - q / 60), 1e-4)) * (k2 + 1.5e0) ELSE k2 END, 1e-4))), 6) AS z")


@query("F12_map_code", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'fast' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS code, CASE o_orderstatus WHEN 'F' THEN 'fast' WHEN 'O' THEN 'open' ELSE 'unknown' END AS card FROM orders")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = {"f": "fast", "o": "open"}
    return table(spark, sf_dir, "orders").select("o_orderkey", U.map_code(c("o_orderstatus"), codes).alias("code"), U.map_code(c("o_orderstatus"), codes, "unknown").alias("card"))


@query("F17_normalize_name", r"SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(trim(c_name || ' (IRE) É-1')), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) AS name FROM customer")
def f17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.normalize_name(F.concat("c_name", F.lit(" (IRE) É-1"))).alias("name"))


@query("F18_normalize_text", r"SELECT doc_id, regexp_replace(replace(strip_accents(text), 'ß', 'ß'), ' {3,}', '  ', 'g') AS clean FROM documents")
def f18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(c("text")).alias("clean"))


@query("F19_clean_name", r"SELECT c_custkey, trim(regexp_replace('  ' || c_name || '   x **', '\s+', ' ', 'g').regexp_replace('\*+$', '')) AS name, 'O''Brien-Smith''S Boy' AS caps, trim(regexp_replace(c_name || '  a ', '\s+', ' ', 'g')) AS spaced FROM customer")
def f19(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = c("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", T.clean_name(F.concat(F.lit("  "), n, F.lit("   x **"))).alias("name"), T.clean_name(F.lit("O'BRIEN-SMITH'S  BOY*")).alias("caps"), T.collapse_ws(F.concat(n, F.lit("  a "))).alias("spaced"))


@query("F20_race_type", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'maiden_claiming' WHEN '2-HIGH' THEN 'graded_stakes' WHEN '3-MEDIUM' THEN 'claiming' ELSE 'unknown' END AS kind FROM orders")
def f20(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = c("o_orderpriority")
    words = F.when(p == "1-URGENT", "Maiden Claiming 10k").when(p == "2-HIGH", "Grade 1 Stakes").when(p == "3-MEDIUM", "CLAIMING").otherwise("match race")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.race_type(words).alias("kind"))


@query("F23_keys", f"""{RUN} SELECT race, post, sha256(upper(trim(track)) || '|' || strftime(day, '%Y-%m-%d') || '|' || CAST(race % 12 AS VARCHAR) || '|' || CAST(CAST(q AS DOUBLE) AS VARCHAR) || '|' || lower(style)) AS race_key,
 sha256('horse ' || CAST(entity AS VARCHAR) || '|' || CASE WHEN entity % 2 = 0 THEN '2015' ELSE 'unknown' END || '|' || 'USA') AS horse_key, sha256('rider ' || CAST(jockey AS VARCHAR) || '|unknown') AS person_key FROM run""")
def f23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runners(spark, sf_dir).select("race", "post", T.race_key(c("track"), c("day"), c("race") % 12, c("q"), c("style")).alias("race_key"), T.horse_key(F.concat(F.lit("Horse "), s(c("entity"))), F.when(c("entity") % 2 == 0, 2015), F.lit("usa")).alias("horse_key"), T.person_key(F.concat(F.lit("Rider "), s(c("jockey"))), F.lit(None).cast("string")).alias("person_key"))


@query("F34_days_between", f"{RUN} SELECT race, post, q <= 6.5 AS sprint, date_diff('day', DATE '1995-01-01', day) AS gap FROM run")
def f34(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runners(spark, sf_dir).select("race", "post", P.is_sprint(c("q")).alias("sprint"), P.days_between(c("day"), F.lit("1995-01-01").cast("date")).cast("long").alias("gap"))


@query("F35_source_format", "SELECT doc_id, CASE WHEN contains(left(text, 2000), 'the ') THEN 'english' WHEN contains(left(text, 2000), 'der ') THEN 'german' ELSE 'unknown' END AS format FROM documents")
def f35(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.source_format(c("text"), [("the ", "english"), ("der ", "german")]).alias("format"))


@query("F36_list_to_json", "SELECT c_custkey, to_json([c_mktsegment, c_name])::VARCHAR AS js FROM customer")
def f36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.list_to_json(F.array("c_mktsegment", "c_name")).alias("js"))
