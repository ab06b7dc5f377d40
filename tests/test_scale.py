"""What one task holds does not grow with the tables."""

from heatwise.plans import base

SF = "/root/testdata/sf0.001"


def rows_of_a_task(df):
    return max(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


def test_a_task_sorts_a_bounded_part_of_the_contest_view(spark, monkeypatch):
    whole = base.runners(spark, SF)
    want = sorted(tuple(r) for r in whole.select("race", "post", "finish").collect())
    monkeypatch.setattr(base, "TASK_ROWS", 300)
    got = base.runners(spark, SF)
    assert sorted(tuple(r) for r in got.select("race", "post", "finish").collect()) == want
    assert len(want) > 4 * 900 and rows_of_a_task(got) < 900


def test_a_fit_reads_its_rows_once(spark):
    from pyspark.sql import functions as F

    from heatwise.operators import models

    read = spark.sparkContext.accumulator(0)

    def counted(rows):
        for r in rows:
            read.add(1)
            yield r

    rows = [(i % 7 / 7, None if i % 5 == 0 else float(i % 3), int(i % 7 > 3)) for i in range(400)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).mapPartitions(counted), "a double, b double, y int")
    model = models.fit_win_model(df, df.where("a > 0.5"), ["a", "b"], "y", 3, 2)
    assert read.value == 800  # for training and for validation
    assert models.score_win_model(model, df, ["a", "b"], "s").agg(F.count("s")).first()[0] == 400
    read.value = 0
    models.auto_select(df, df, "a", "y")
    assert read.value == 800


def test_draws_of_fits_are_no_rows(spark):
    """Draws run inside the row of a race; strengths are those of plain draws."""
    from pyspark.sql import functions as F

    from heatwise.operators import models, rows

    target = spark.createDataFrame([(r, i, p) for r in range(20) for i, p in enumerate((0.5, 0.3, 0.2), 1)], "race long, runner long, p double")
    out = models.infer_strengths(target, 10, 1)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    won = rows.sample_orders(target.withColumn("v", F.col("p")), "race", "runner", "v", 10, seed="fit0", shape=2).where("rank = 1").groupBy("race", "runner").count()
    want = {(r["race"], r["runner"]): r["p"] * (r["p"] / ((r["n"] + 0.5) / 11)) ** 0.5 for r in target.join(won, ["race", "runner"], "left").select("race", "runner", "p", F.coalesce("count", F.lit(0)).alias("n")).collect()}
    got = {(r["race"], r["runner"]): r["v"] for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    orders = target.where("runner < 3").groupBy("race").agg(F.sort_array(F.collect_list("runner")).alias("finishing_order"))
    assert "Window" not in models.fit_stern_shape(target.select("race", "runner", F.col("p").alias("v")), orders, (1, 2), 5)._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_dealt_by_their_lines(spark, monkeypatch):
    from heatwise.plans import flows

    monkeypatch.setattr(base, "TASK_ROWS", 2000)
    assert rows_of_a_task(flows._blocks(spark, SF)) < 8000


def test_outcomes_of_a_race_are_no_rows(spark):
    """Trees grow in the row of a race: one join, of races. Odd fields and bets give what plain rows of outcomes do."""
    from pyspark.sql import functions as F

    from heatwise.operators import outcomes
    from heatwise.plans import tables

    plan = tables.r09_exotics(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3  # each table's view has one of its own
    runners = spark.createDataFrame([(r, x, p) for r in range(40) for x, p in ((1, 0.5), (2, 0.2), (2, 0.2), (None, 0.1), (3, None))], "race int, runner int, p double")
    sold = [([1], 2.0, 0.5), ([2, 1], 4.0, 0.25), ([1, None], 9.0, 0.1), ([2, 1, 3], 90.0, 0.1), ([], 2.0, 0.1), (None, 2.0, 0.1), ([3], None, 0.1)]
    bets = spark.createDataFrame([(r, *b) for r in range(40) for b in sold] + [(None, [1], 2.0, 1.0)], "race int, selection array<bigint>, odds double, stake double")
    tree = outcomes.outcome_tree(runners, bets)
    first = {tuple(r["finishing_order"]): (r["chance"], r["won"]) for r in tree.where("race = 7").collect()}
    # Nothing can follow 2, 1 in a field of 0.5 and twice 0.2 but 3, which has no chance.
    assert set(first) == {(1, 2), (1, 3), (2, 3), (2, 1, 3), (3,)} and first[1, 2] == (0.2, 1.0) and first[2, 1, 3] == (0.0, 10.0)
    assert tree.where("finishing_order = array(1, 2)").count() == 80
    pnl = tree.select("race", (F.col("won") - 1.25).alias("pnl"), "chance")
    for alpha in (0.0, 0.3):
        want = {r["race"]: r for r in outcomes.tail_risk(pnl, ["race"], alpha).collect()}
        got = outcomes.portfolio_risk(runners, bets, alpha).collect()
        assert len(got) == 40 == len(want)
        for r in got:
            assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-12) for x, y in zip(r[1:], want[r["race"]][1:], strict=True))


def test_races_grow_in_step_up_to_a_bound(monkeypatch):
    import pyarrow as pa

    from heatwise.operators import outcomes

    monkeypatch.setattr(outcomes, "IN_STEP", 50)
    batch = pa.record_batch({"field": [[1] * n for n in (2, 3, 30, 2, 5)], "bets": [[1] * n for n in (4, 5, 40, 1, 9)]})
    assert [len(x) for x in outcomes._in_step(batch)] == [2, 1, 2]


def test_groups_of_rates_are_dealt_by_their_rows(spark, monkeypatch):
    from heatwise.operators import aggregates, rows

    df = spark.range(3000).selectExpr("cast(id % 2 AS string) AS track", "CASE WHEN id % 11 > 0 THEN id % 40 END AS jockey", "id div 2 AS trainer", "cast(id % 7 = 0 AS int) AS win")
    levels = {"jurisdiction": ["track"], "jockey": ["track", "jockey"], "trainer": ["track", "trainer"], "pair": ["track", "jockey", "trainer"]}
    least = {"jockey": 10, "trainer": 1, "pair": 1}
    rates = lambda **more: aggregates.empirical_bayes_rates(df, levels, "win", min_starts=least, **more)
    want = sorted(map(str, rates().collect()))
    monkeypatch.setattr(rows, "TASK_ROWS", 300)
    got = rates(n_rows=3000)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all(any("RepartitionByExpression" in x and k in x and x.rstrip().endswith(", 10") for x in plan.splitlines()) for k in ("jockey", "trainer"))
    assert sorted(map(str, got.collect())) == want
    # By hand: 3000 / 2 starts of a track, 1 in 7 won; 3000 pairs, none of two rows.
    assert sum("level='jurisdiction'" in x and "starts=1500" in x for x in want) == 2 and sum("level='pair'" in x for x in want) == 3000


def test_strengths_of_many_items_keep_bounded_partitions(spark, monkeypatch):
    from heatwise.operators import models, rows

    made = spark.sparkContext.accumulator(0)

    def counted(part):
        for r in part:
            made.add(1)
            yield r

    data = [(i // 5, i % 5 + 1, i * 7919 % 97 if i % 13 else None) for i in range(2000)]
    orders = spark.createDataFrame(spark.sparkContext.parallelize(data, 2).mapPartitions(counted), "order_id int, position int, item int")
    want = {r["item"]: r["strength"] for r in models.fit_plackett_luce(orders, 4).collect()}
    assert made.value == 2000  # once, whatever the rounds
    monkeypatch.setattr(rows, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(rows, "TASK_ROWS", 100)
    got = {r["item"]: r["strength"] for r in models.fit_plackett_luce(orders, 4).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_strengths_settle(spark):
    """Rounds go on until strengths stand still, however many items share them."""
    import numpy as np
    from pyspark.sql import functions as F

    from heatwise.operators import models
    from heatwise.plans import flows

    rng = np.random.default_rng(3)
    data = [(r, k + 1, int(i)) for r in range(600) for k, i in enumerate(rng.permutation(40)[:4] if r % 5 else rng.permutation(40)[:2])]
    orders = spark.createDataFrame(data, "order_id int, position int, item int")
    asked = {}
    fit, models.fit_plackett_luce = models.fit_plackett_luce, lambda df, **more: asked.update(more) or df
    try:
        flows.m12(spark, SF)
    finally:
        models.fit_plackett_luce = fit
    v = {r["item"]: r["strength"] for r in models.fit_plackett_luce(orders, **asked).collect()}
    assert len(v) == 40 and abs(sum(v.values()) - 1) < 1e-9
    d, wins = dict.fromkeys(v, 0.0), dict.fromkeys(v, 0)
    for r in range(600):
        field = [i for o, _, i in data if o == r]
        for k in range(len(field) - 1):
            wins[field[k]] += 1
            for i in field[k:]:
                d[i] += 1 / sum(v[j] for j in field[k:])
    assert all(abs(wins[i] / (v[i] * d[i]) - 1) < 1e-5 for i in v)  # another round would move none


def test_strengths_meet_exact_shares(spark):
    """Shares that strengths imply, by a plain integral, are the targets; odd fields keep their rows."""
    import numpy as np

    from heatwise.operators import models
    from heatwise.plans import flows

    fields = {1: [1.0], 2: [0.7, 0.3], 3: [0.5, 0.3, 0.15, 0.05], 4: [0.05] * 20, 5: [0.6, None, 0.4], 6: [1.0, 0.0], 7: [None]}
    target = spark.createDataFrame([(r, i, p) for r, ps in fields.items() for i, p in enumerate(ps)] + [(None, 0, 1.0)], "race long, runner long, p double")
    asked = []
    fit, models.infer_strengths = models.infer_strengths, lambda df, *more, **named: asked.append((more, named)) or df.withColumn("v", df["p"])
    try:
        flows.m14(spark, SF)
    finally:
        models.infer_strengths = fit
    got = models.infer_strengths(target, *asked[0][0], **asked[0][1])
    assert got.columns == ["race", "runner", "p", "v"] and got.count() == target.count()
    by = {}
    for r in got.collect():
        by.setdefault(r["race"], {})[r["runner"]] = r["v"]
    t = np.arange(0, 200, 0.002)[1:]
    for race, ps in fields.items():
        assert [by[race][i] is None for i in range(len(ps))] == [p is None for p in ps]
        v = np.array([by[race][i] for i, p in enumerate(ps) if p is not None])
        if race in (2, 3, 4, 5):
            assert abs(v.sum() - 1) < 1e-12
            still = np.prod([np.exp(-x * t) * (1 + x * t) for x in v], 0)
            share = [(x * x * t / (1 + x * t) * still).sum() * 0.002 for x in v]
            assert np.abs(np.array(share) - [p for p in ps if p is not None]).max() < 1e-5
    for n, shape in ((170, 2), (30, 4)):  # many nodes, and steps of the logarithm
        v = np.random.default_rng(n).dirichlet(np.ones(n))[None]
        few, models.FEW_NODES = models.FEW_NODES, 500
        models._nodes.cache_clear()
        want, models.FEW_NODES = models.win_shares(v, shape), 4
        models._nodes.cache_clear()
        assert np.abs(models.win_shares(v, shape) - want).max() < 1e-9 and abs(want.sum() - 1) < 1e-9
        models.FEW_NODES = few
        models._nodes.cache_clear()


def test_isotonic_fits_get_bounded_partitions(spark, monkeypatch):
    """MLlib makes as many ranges as it gets partitions, and holds each as objects in a task."""
    from heatwise.operators import models, rows

    parts, fit = [], models.IsotonicRegression.fit
    monkeypatch.setattr(models.IsotonicRegression, "fit", lambda self, df: parts.append(df.rdd.getNumPartitions()) or fit(self, df))
    monkeypatch.setattr(rows, "TASK_ROWS", 100)
    df = spark.createDataFrame([(i // 5, 1.5 + i * 37 % 1009 / 100, i * 37 % 1009 / 1009, int(i % 3 == 0)) for i in range(2000)], "race int, odds double, p double, y int")
    got = models.MarketPrior.fit(df, "odds", "race", "y")(df)
    cal = models.calibrate(df, "p", "y", "isotonic")(df)
    assert parts == [20, 20]
    monkeypatch.setattr(rows, "TASK_ROWS", 10_000)
    assert sorted(r["market"] for r in got.collect()) == sorted(r["market"] for r in models.MarketPrior.fit(df, "odds", "race", "y")(df).collect())
    assert sorted(r["calibrated"] for r in cal.collect()) == sorted(r["calibrated"] for r in models.calibrate(df, "p", "y", "isotonic")(df).collect())
    assert max(parts[2:]) <= 4
