"""Edge rules that the shared tables do not reach."""

import datetime as dt
import itertools
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from heatwise.functions import pricing, text, units
from heatwise.operators import cards, jobs, models, outcomes, quantiles, rows, scans
from heatwise.operators import windows as W
from heatwise.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, want", [("1m4f 110y", 12.5), ("7f", 7.0), ("0f", None), ("", None), ("6.5", 6.5), ("abc", None)])
def test_uk_distance(spark, given, want):
    assert one(spark, units.uk_distance_to_furlongs(F.lit(given))) == want


@pytest.mark.parametrize("given, want", [("1 1/16 Miles", 8.5), ("5½f", 5.5), ("About 6 Furlongs", 6.0), ("1 Mile 70 Yards", 8.3182)])
def test_text_distance(spark, given, want):
    assert one(spark, units.text_distance_to_furlongs(F.lit(given))) == want


@pytest.mark.parametrize("given, want", [("5/2", 3.5), ("EVS", 2.0), ("3/0", None), ("-1", None), (None, None)])
def test_odds(spark, given, want):
    assert one(spark, units.odds_to_decimal(F.lit(given).cast("string"))) == want


def test_text(spark):
    assert one(spark, text.normalize_text(F.lit("café ‘x’    y\x07"))) == "cafe 'x'  y"
    assert one(spark, text.clean_name(F.lit("SEA  BISCUIT*"))) == "Sea Biscuit"


def test_null_stays_null(spark):
    assert one(spark, pricing.bernoulli_z(F.lit(None).cast("double"), F.lit(1))) is None
    assert one(spark, pricing.clip_logit(F.lit(None).cast("double"))) is None


def test_ewm_ages_over_nulls(spark):
    values = [1.0, None, 3.0, 4.0, None, 6.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumn("k", F.lit(1))
    got = [r["x"] for r in df.withColumn("x", W.ewm_prior(F.col("v"), Window.partitionBy("k").orderBy("i"))).orderBy("i").collect()]
    want = pd.Series(values).ewm(alpha=0.4).mean().shift()
    assert got[0] is None
    assert np.allclose(got[1:], want[1:])


def test_field_z_of_equal_values_is_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, None)], "r int, v double")
    assert {r["z"] for r in df.select(W.field_z(F.col("v"), W.race("r")).alias("z")).collect()} == {0.0}


def test_cusum_equals_recursion(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(0.2, 1, 200)
    df = spark.createDataFrame([(i, float(x), 1) for i, x in enumerate(z)], "i int, z double, k int")
    got = W.cusum(df, "z", ["k"], ["i"]).orderBy("i").toPandas()
    hi = lo = 0.0
    for x, a, b in zip(z, got["s_high"], got["s_low"], strict=True):
        hi, lo = max(0, hi + x - 0.5), max(0, lo - x - 0.5)
        assert abs(hi - a) < 1e-9 and abs(lo - b) < 1e-9


def test_leap_day_slice(spark):
    days = [dt.date(2019, 2, 27), dt.date(2019, 2, 28), dt.date(2020, 2, 28), dt.date(2020, 2, 29)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = {r["d"] for r in rows.rolling_window_slice(df, "d", dt.date(2020, 2, 29), 1).collect()}
    assert got == {dt.date(2019, 2, 28), dt.date(2020, 2, 28)}
    with pytest.raises(ValueError):
        rows.rolling_window_slice(df, "d", dt.date(2020, 2, 29), 0)


def test_tuples_sum_to_one_and_places_to_two(spark):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate([0.4, 0.3, 0.2, 0.1])], "race int, r int, p double")
    total = rows.ordered_tuples(df, "race", "r", "p", 3).agg(F.sum("chance").alias("s"), F.count("*").alias("n")).first()
    assert total["n"] == 24 and abs(total["s"] - 1) < 1e-9
    place = rows.place_show_prob(df, "race", "r", "p").agg(F.sum("place").alias("a"), F.sum("show").alias("b")).first()
    assert abs(place["a"] - 2) < 1e-9 and abs(place["b"] - 3) < 1e-9


def test_samples_follow_strengths(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([4.0, 3.0, 2.0, 1.0])], "race int, r int, v double")
    for kind in ({}, {"style": "v", "rho": 0.0}):
        s = rows.sample_orders(df, "race", "r", "v", 4000, **kind)
        won = {r["runner"]: r["n"] / 4000 for r in s.where("rank = 1").groupBy("runner").agg(F.count("*").alias("n")).collect()}
        assert all(abs(won[i] - w) < 0.04 for i, w in enumerate([0.4, 0.3, 0.2, 0.1]))


def every_outcome(field, bets, alpha):
    """Expected return, value at risk and tail mean over all whole finishing orders of a race."""
    pnl = []
    for order in itertools.permutations(field):
        chance, left = 1.0, 1.0
        for x in order:
            chance, left = chance * (field[x] / left if left > 1e-12 else 0.0), left - field[x]
        pnl.append((sum(s * (o - 1) if list(order[: len(sel)]) == sel else -s for sel, o, s in bets), chance))
    worst, held = [], 0.0
    for v, chance in sorted(pnl):
        if held >= alpha - 1e-12 and v > worst[-1][0] + 1e-12:
            break
        worst.append((v, chance))
        held += chance
    return sum(v * c for v, c in pnl), -worst[-1][0], -sum(v * c for v, c in worst) / sum(c for _, c in worst)


@pytest.mark.parametrize("alpha", [0.05, 0.3])
def test_tail_over_all_orders(spark, alpha):
    fields = {1: {0: 0.4, 1: 0.3, 2: 0.2, 3: 0.07, 4: 0.03}, 2: {0: 0.9, 7: 0.1}, 3: {5: 1.0}, 4: {0: 0.25, 1: 0.25, 2: 0.25, 3: 0.25}}
    bets = {1: [([0], 3.5, 0.3), ([1], 4.5, 0.2), ([1, 0], 9.0, 0.1), ([0, 1, 2], 12.0, 0.05), ([0, 1, 2], 11.0, 0.05), ([4, 9], 5.0, 0.1)], 2: [([7], 15.0, 0.2), ([0, 7, 3], 4.0, 0.1)], 3: [([5], 1.2, 1.0)], 4: [([0], 4.4, 0.1), ([2, 1], 20.0, 0.1)]}
    runners = spark.createDataFrame([(r, x, p) for r, f in fields.items() for x, p in f.items()] + [(9, 1, 1.0)], "race int, runner int, p double")
    placed = spark.createDataFrame([(r, *b) for r, x in bets.items() for b in x] + [(8, [1], 2.0, 1.0)], "race int, selection array<int>, odds double, stake double")
    tree = outcomes.outcome_tree(runners, placed).groupBy("race").agg(F.sum("chance").alias("c"), F.count("*").alias("n")).collect()
    assert sorted(r["race"] for r in tree) == [1, 2, 3, 4] and all(abs(r["c"] - 1) < 1e-9 for r in tree)
    got = {r["race"]: r[1:] for r in outcomes.portfolio_risk(runners, placed, alpha).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    for race, values in got.items():
        assert values == pytest.approx(every_outcome(fields[race], bets[race], alpha), abs=1e-9)
    assert outcomes.portfolio_risk(runners, placed.limit(0)).count() == 0 == outcomes.portfolio_risk(runners.limit(0), placed).count()


def test_cap_holds_and_return_grows_with_level(spark):
    field = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.4, 0.3, 0.2, 0.1])], "race int, runner int, p double")
    bets = spark.createDataFrame([(1, [0], 3.5, 0.3), (1, [1], 4.5, 0.3)], "race int, selection array<int>, odds double, stake double")
    got = outcomes.risk_capped_allocation(field, bets, [0.05, 0.2, 0.6]).orderBy("level").collect()
    assert all(g["cvar"] <= g["level"] + 1e-9 for g in got)
    assert got[0]["expected_return"] <= got[1]["expected_return"] <= got[2]["expected_return"]


def test_plackett_luce_recovers_strengths(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.4, 0.3, 0.2, 0.1])], "race int, r int, v double")
    s = rows.sample_orders(df, "race", "r", "v", 1500)
    got = models.fit_plackett_luce(s.select(F.col("scenario").alias("order_id"), F.col("rank").alias("position"), F.col("runner").alias("item")), 20)
    assert all(abs(r["strength"] - [0.4, 0.3, 0.2, 0.1][r["item"]]) < 0.05 for r in got.collect())


def test_plackett_luce_of_many_items(spark):
    orders = spark.range(150_000).selectExpr("id div 3 AS order_id", "cast(id % 3 + 1 AS int) AS position", "id AS item")
    got = models.fit_plackett_luce(orders, 1)
    # By hand: from equal strengths a round gives 3, 1.2 and 0 (to 1e-9) shares to first, second and last.
    top = got.groupBy(F.expr("item % 3").alias("k")).agg(F.count("*").alias("n"), F.sum("strength").alias("s")).orderBy("k").collect()
    assert [r["n"] for r in top] == [50_000] * 3 and all(abs(r["s"] - w) < 1e-6 for r, w in zip(top, (3 / 4.2, 1.2 / 4.2, 0), strict=True))


def test_merge_adds_nothing_twice(spark):
    batch = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "k string, v int")
    first = rows.merge_star(batch, {"t": (batch.limit(0), ["k", "v"])}, F.lit(0))["t"]
    assert sorted(map(tuple, first.collect())) == [("a", 1), ("b", 1)]
    assert rows.merge_star(batch, {"t": (first, ["k", "v"])}, F.lit(0))["t"].isEmpty()


def test_outcomes_reject_repeats_and_pad(spark):
    new = spark.createDataFrame([(1, [3, 3]), (2, []), (3, [7])], "race int, finishing_order array<int>").withColumn("settled_at", F.lit("2020-01-01").cast("timestamp"))
    got = rows.log_outcomes(new, new.limit(0)).collect()
    assert [(r["race"], r["winner"], r["second"], r["third"]) for r in got] == [(3, 7, -1, -1)]


def test_json_card_in_words(spark):
    t = 'Sure! {"track": "X", "card_date": "2020-01-02", "races": [{"number": "1", "surface": "Moon", "entries": [{"post": "1", "horse": "A", "odds": "9999"}, {"post": "x", "horse": "B", "odds": "2"}]}]} and {more}'
    r = cards.cards_from_json_text(spark.createDataFrame([(t,), (None,), ("no card",)], "t string"), "t").collect()
    assert r[0]["races"][0]["surface"] == "unknown" and [(e["post"], e["odds"]) for e in r[0]["races"][0]["entries"]] == [(1, None)]
    assert r[1]["races"] is None and r[2]["races"] is None


def test_missing_provenance_is_synthetic(spark, tmp_path):
    assert files.read_provenance(spark, f"{tmp_path}/none").first()["synthetic"]
    assert not files.read_drift_flag(spark, f"{tmp_path}/none").first()["triggered"]


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1


def test_ewm_reaches_back_over_any_number_of_nulls(spark):
    values = [2.0, 5.0] + [None] * 150 + [1.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").withColumn("k", F.lit(1))
    got = [r["x"] for r in W.with_ewm_prior(df, "x", F.col("v"), Window.partitionBy("k").orderBy("i")).orderBy("i").collect()]
    want = pd.Series(values).ewm(alpha=0.4).mean().shift()
    assert got[0] is None
    assert np.allclose(got[1:], want[1:])


def test_prior_history_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    past = [(int(rng.integers(3)), dt.date(2020, 1, 1 + int(rng.integers(12))), i) for i in range(60)] + [(1, None, 99)]
    today = [(int(rng.integers(4)), dt.date(2020, 1, 1 + int(rng.integers(14))), i) for i in range(30)] + [(1, None, 98), (None, dt.date(2020, 1, 9), 97)]
    p, t = (spark.createDataFrame(x, "e int, d date, n int") for x in (past, today))
    got = {r["n"]: [tuple(h) for h in r["history"]] for r in rows.prior_history(t, p, "e", "d", ["n"], 4).collect()}
    for e, d, n in today:
        want = sorted(((pd_, pn) for pe, pd_, pn in past if pe == e and pd_ and d and pd_ < d), reverse=True)[:4]
        assert got[n] == want


@pytest.mark.parametrize("field", [1, 2, 3, 5])
def test_place_and_show_equal_enumeration(spark, field):
    import itertools

    p = np.arange(1, field + 1) / sum(range(1, field + 1))
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(p)], "race int, r int, p double")
    got = {r["runner"]: (r["place"], r["show"]) for r in rows.place_show_prob(df, "race", "r", "p").collect()}
    for me in range(field):
        for n, at in ((2, 0), (3, 1)):
            want = 0.0
            for pick in itertools.permutations(range(field), n):
                chance, used = 1.0, 0.0
                for x in pick:
                    chance, used = chance * p[x] / (1 - used) if used < 1 else 0.0, used + p[x]
                want += chance * (me in pick)
            assert np.isclose(got[me][at], want if field >= n else 1.0)


def training(spark, n=600):
    rng = np.random.default_rng(3)
    out = []
    for i in range(n):
        a, b = rng.normal(), rng.normal()
        out.append((i // 6, i % 6, dt.date(2018, 1, 1) + dt.timedelta(days=i), 2.0 + abs(b) * 3, int(a + rng.normal() > 0.8), float(a), None if i % 5 == 0 else float(b), 6.0))
    return spark.createDataFrame(out, "race int, post int, day date, odds double, win int, a double, b double, size double")


def test_stacker_scores_a_row_alike_in_any_company(spark):
    df = training(spark).withColumns({"s": 1 / (1 + F.exp(-F.col("a"))), "m": 1 / F.col("odds")})
    stacker = models.fit_stacker(df, df, ["s", "m", "b"], ["size"], "win", 3, 2)
    whole = {(r["race"], r["post"]): r["x"] for r in stacker.score(df, "x").collect()}
    some = stacker.score(df.where("race < 3"), "x").collect()
    assert len(some) == 18 and all(whole[r["race"], r["post"]] == r["x"] for r in some)
    assert all(0 <= x <= 1 for x in whole.values())


def test_gated_model_is_neutral_without_its_columns(spark):
    df = training(spark)
    assert models.fit_gated(df, df, ["a", "b"], "win", 2, 2, min_rows=5000) is None
    model = models.fit_gated(df, df, ["a", "b"], "win", 2, 2, min_rows=100)
    got = models.score_gated(model, df, ["a", "b"], "x")
    assert {r["x"] for r in got.where("b IS NULL").collect()} == {0.5}
    assert got.where("b IS NOT NULL").select("x").distinct().count() > 2
    assert {r["x"] for r in models.score_gated(None, df, ["a", "b"], "x").collect()} == {0.5}


def test_card_scoring_and_retraining(spark):
    from heatwise.operators import jobs

    df, r = training(spark), jobs.Roles("race", "post", "day", "odds", "win", ["a"], ["a", "b"], ["size"])
    calm = spark.createDataFrame([(False,)], "triggered boolean")
    none, report = jobs.rolling_retrain(df, r, dt.date(2020, 1, 1), 2, calm)
    assert none is None and [x["stage"] for x in report.collect()] == ["skipped"]
    bundle, report = jobs.rolling_retrain(df, r, dt.date(2020, 1, 1), 2, None, 2, 2, 50)
    assert {x["stage"] for x in report.collect()} == {"before", "after"}
    chances, plans = jobs.score_card(df.where("race >= 90"), bundle, [0.1, 0.3], 0.05)
    assert all(np.isclose(x["s"], 1) for x in chances.groupBy("race").agg(F.sum("p").alias("s")).collect())
    for x in plans.collect():
        assert x["cvar"] <= x["level"] + 1e-9 and x["stake"] <= 1


def test_registries_tell_what_they_know(spark):
    from heatwise.sources import registry

    maps = registry.FieldMaps()
    with pytest.raises(ValueError, match="needs a column or a constant.*no transform 'x'"):
        maps.load("m", '{"a": {}, "b": {"column": "q", "transform": "x"}}')
    maps.load("m", '{"a": {"column": "q", "type": "int"}}')
    with pytest.raises(KeyError, match="known: m"):
        maps.get("n")
    with pytest.raises(KeyError, match="runs_and_races"):
        registry.read_source(spark, "n", "/nowhere")


def test_a_required_model_must_be_there(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="stacker"):
        files.load_models(spark, str(tmp_path), ["stacker"], ["pace"])


def pooled(points):
    """Isotonic fit of (score, label) by pooling neighbours that fall, in one go over all different scores."""
    blocks = []
    for x, ys in itertools.groupby(sorted(points), key=lambda p: p[0]):
        ys = [y for _, y in ys]
        blocks.append([sum(ys), len(ys), [x]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + n, blocks[-1][2] + xs]
    return {x: total / n for total, n, xs in blocks for x in xs}


def test_isotonic_fit_of_unrounded_scores(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.random(20_000), 7)
    p[:8000] = rng.choice(p[:500], 8000)
    points = list(zip(p.tolist(), (rng.random(len(p)) < p**2).astype(float).tolist()))
    df = spark.createDataFrame(points, "p double, y double").repartition(7)
    want = pooled(points)
    got = models.calibrate(df, "p", "y", "isotonic")(df).select("p", "calibrated").distinct().collect()
    assert len(got) == len(want) and all(abs(r["calibrated"] - want[r["p"]]) < 1e-9 for r in got)


def test_hold_out_modes_of_calibration(spark):
    rng = np.random.default_rng(6)
    p = rng.random(6000)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(p, rng.random(6000) < p**3))], "i int, p double, y double")
    parts = [df.where("i < 4000"), df.where("i >= 4000")]
    for chosen in (models.calibrate_auto(parts[0], "p", "y", parts[1]), models.calibrate_auto(df, "p", "y", by=["i"])):
        assert chosen.method in ("platt", "isotonic")
        again = models.calibrate(df, "p", "y", chosen.method)  # fitted on all rows, the hold-out too
        both = again(df).select("i", F.col("calibrated").alias("a")).join(chosen(df), "i")
        assert both.where("abs(a - calibrated) > 1e-12").count() == 0
    true = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(p[:60], rng.random(60) < p[:60]))], "i int, p double, y double")
    assert models.calibrate_auto(true, "p", "y").method in ("identity", "platt", "isotonic")


def test_bundle_without_parts(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows_ = [(i // 8, i % 8, dt.date(2020, 1, 1) + dt.timedelta(days=i // 40), float(1 + rng.random() * 9), int(i % 8 == rng.integers(8)), float(rng.random()), 8.0) for i in range(1600)]
    df = spark.createDataFrame(rows_, "race int, post int, day date, odds double, win int, form double, size double")
    r = jobs.Roles("race", "post", "day", "odds", "win", ["form"], ["form"], ["size"])
    bundle, root = jobs.fit_bundle(df.where("race < 150"), df.where("race >= 150"), r, 2, 2, 100), f"file://{tmp_path}/b"
    with pytest.raises(FileNotFoundError):
        jobs.load_bundle(spark, root)
    jobs.save_bundle(bundle, root, spark.createDataFrame([("m", "s", None, False)], files.PROVENANCE))
    shutil.rmtree(tmp_path / "b" / "speed")
    shutil.rmtree(tmp_path / "b" / "provenance")
    loaded, provenance = jobs.load_bundle(spark, root)
    assert loaded.roles == jobs.Roles("race", "post", "day", "odds", "win", ["form"], ["form"], ["size"], ["speed", "pace_score", "market"])
    assert loaded.speed is None and loaded.pace is not None and provenance.first()["synthetic"]
    assert loaded.score(df).where("speed = 0.5 and calibrated between 0 and 1").count() == 1600
    shutil.rmtree(tmp_path / "b" / "stacker")
    with pytest.raises(FileNotFoundError, match="stacker"):
        jobs.load_bundle(spark, root)


@pytest.mark.parametrize("key", [[], ["k"]])
def test_cusum_in_ranges(spark, key):
    rng = np.random.default_rng(8)
    rows_ = [([None, 1, 2, 2, 2][i % 5], i, None if i > 5 and i % 17 == 0 else float(z)) for i, z in enumerate(rng.normal(0.1, 1, 3000))]
    df = spark.createDataFrame(rows_, "k int, i int, z double").repartition(5)
    got, want = (x.orderBy("i").collect() for x in (scans.cusum_ranges(df, "z", key, ["i"], ranges=13), W.cusum(df, "z", key, ["i"])))
    assert len(got) == len(want) == 3000
    for a, b in zip(got, want):
        assert (a["i"], a["step"], a["alarm_step"], a["direction"]) == (b["i"], b["step"], b["alarm_step"], b["direction"])
        assert a["s_high"] == pytest.approx(b["s_high"], abs=1e-9) and a["s_low"] == pytest.approx(b["s_low"], abs=1e-9)
    assert scans.cusum_ranges(df.limit(0), "z", key, ["i"]).count() == 0


@pytest.mark.parametrize("alpha", [0.05, 0.5])
def test_exact_quantiles(spark, alpha):
    rng = np.random.default_rng(10)
    values = [(1, float(v)) for v in rng.normal(0, 1, 9000)] + [(2, float(v)) for v in np.round(rng.exponential(1, 3000), 1)] + [(None, float(v)) for v in np.exp(rng.normal(0, 80, 2000))]
    values += [(3, 7.0)] * 2000 + [(4, None), (5, 1.0), (5, None), (5, 2.0), (6, -1.7e308), (6, 1.7e308), (6, 0.0)]
    df = spark.createDataFrame(values, "k int, v double").repartition(5)
    want = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("v", alpha).alias("q")).collect()}
    got = {r["k"]: r["quantile"] for r in quantiles.exact_quantile(df, ["k"], "v", alpha, bins=64, few=2).collect()}
    assert got == want
    assert quantiles.exact_quantile(df, [], "v", alpha).first()["quantile"] == df.agg(F.percentile("v", alpha).alias("q")).first()["q"]
