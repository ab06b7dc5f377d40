"""Win models, calibration and order-model fits with MLlib and aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..functions import pricing
from ..sources.files import stored
from . import aggregates, rows, windows


def with_missing_flags(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{f}_missing": F.col(f).isNull().cast("double") for f in features} | {f: F.col(f).cast("double") for f in features})


def fit_win_model(train: DataFrame, val: DataFrame, features: Sequence[str], label: str, rounds: int = 20, depth: int = 4, seed: int = 1) -> PipelineModel:
    """Boosted trees that stop when the validation rows no longer gain. Missing values are imputed and flagged."""
    both = with_missing_flags(train, features).withColumn("_val", F.lit(False)).unionByName(with_missing_flags(val, features).withColumn("_val", F.lit(True)), allowMissingColumns=True)
    # Every stage of the fit reads its input again, the trees several times, so what they need is made once.
    both = stored(both.select(*features, *[f"{f}_missing" for f in features], "_val", F.col(label).cast("double").alias("_y")), "fit")
    filled = [f"{f}_filled" for f in features]
    stages = [Imputer(inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled + [f"{f}_missing" for f in features], outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol="_y", validationIndicatorCol="_val", maxIter=rounds, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(both)


def score_win_model(model: PipelineModel, df: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    out = model.transform(with_missing_flags(df, features))
    return out.withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def fit_gated(train: DataFrame, val: DataFrame, columns: Sequence[str], label: str, rounds: int = 20, depth: int = 4, min_rows: int = 5000, min_share: float = 0.001) -> PipelineModel | None:
    """A win model on rows that have all the columns; None where one of them has too few values to train on."""
    if not rows.column_gate(train, columns, min_rows, min_share).agg(F.bool_and("enough").alias("ok")).first()["ok"]:
        return None
    return fit_win_model(train.dropna(subset=list(columns)), val.dropna(subset=list(columns)), columns, label, rounds, depth)


def score_gated(model: PipelineModel | None, df: DataFrame, columns: Sequence[str], name: str, neutral: float = 0.5) -> DataFrame:
    """The model's score on rows that have all the columns, neutral elsewhere."""
    if model is None:
        return df.withColumn(name, F.lit(neutral))
    has = F.array_compact(F.array(*[F.col(c).cast("double") for c in columns]))
    return score_win_model(model, df, columns, name).withColumn(name, F.when(F.size(has) == len(columns), F.col(name)).otherwise(neutral))


class Stacker:
    """Boosted trees over one score, what the others add to it, and further columns. The lines of the residuals stay as fitted, so a row's score does not depend on the rows it is scored with."""

    def __init__(self, lines: DataFrame, model: PipelineModel, scores: Sequence[str], meta: Sequence[str]):
        self.lines, self.model, self.scores, self.meta = lines, model, list(scores), list(meta)

    @staticmethod
    def columns(scores: Sequence[str], meta: Sequence[str]) -> list[str]:
        return [scores[0], *[f"{s}_residual" for s in scores[1:]], *meta]

    def score(self, df: DataFrame, name: str) -> DataFrame:
        out = aggregates.residuals(df, self.lines, self.scores[0], self.scores[1:])
        return score_win_model(self.model, out, self.columns(self.scores, self.meta), name).select(*df.columns, name)


def fit_stacker(train: DataFrame, val: DataFrame, scores: Sequence[str], meta: Sequence[str], label: str, rounds: int = 20, depth: int = 3) -> Stacker:
    """The first score is the anchor; of the others only what a straight line on the anchor leaves is used."""
    lines = aggregates.residual_fit(train, scores[0], list(scores[1:]))
    frozen = train.sparkSession.createDataFrame([lines.first()], lines.schema)
    parts = [aggregates.residuals(df, frozen, scores[0], list(scores[1:])) for df in (train, val)]
    return Stacker(frozen, fit_win_model(*parts, Stacker.columns(scores, meta), label, rounds, depth), scores, meta)


class MarketPrior:
    """Implied chances, normalised in the race, mapped to win rates by isotonic regression."""

    def __init__(self, model: IsotonicRegressionModel, odds: str, race: str):
        self.model, self.odds, self.race = model, odds, race

    def implied(self) -> Column:
        return windows.normalise_in_race(F.when(F.col(self.odds) > 0, 1 / F.col(self.odds)), windows.race(self.race))

    @classmethod
    def fit(cls, fit_on: DataFrame, odds: str, race: str, label: str) -> MarketPrior:
        out = cls(None, odds, race)
        train = fit_on.withColumn("_m", out.implied()).where("_m IS NOT NULL").select(F.col("_m").alias("_f"), F.col(label).cast("double").alias("_y"))
        # Equal scores are pooled, which changes no fit; MLlib pools violators in ranges, and then the blocks that are left. It holds
        # a range as objects in a task and makes as many ranges as it gets partitions, so these must have bounded rows.
        train = rows.dealt(train, fit_on.count(), "_f").groupBy("_f").agg(F.avg("_y").alias("_y"), F.count("*").cast("double").alias("_w"))
        out.model = IsotonicRegression(featuresCol="_f", labelCol="_y", weightCol="_w", predictionCol="market").fit(train)
        return out

    def __call__(self, df: DataFrame) -> DataFrame:
        """df with `market`; without odds NULL."""
        scored = self.model.transform(df.withColumn("_m", self.implied()).withColumn("_f", F.coalesce("_m", F.lit(0.0))))
        return scored.withColumn("market", F.when(F.col("_m").isNotNull(), F.col("market"))).drop("_m", "_f")


def market_prior(df: DataFrame, fit_on: DataFrame, odds: str, race: str, label: str) -> DataFrame:
    return MarketPrior.fit(fit_on, odds, race, label)(df)


class Calibration:
    """Adds `calibrated` to a table with the score p: by a logistic curve through its log-odds (platt), by an isotonic one, or as it is (identity)."""

    def __init__(self, method: str, p: str, curve: tuple[float, float] | None = None, model: IsotonicRegressionModel | None = None):
        self.method, self.p, self.curve, self.model = method, p, curve, model

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.method == "isotonic":
            return self.model.transform(df.withColumn("_p", F.col(self.p))).drop("_p")
        if self.method == "platt":
            a, b = self.curve
            return df.withColumn("calibrated", 1 / (1 + F.exp(-(a * pricing.clip_logit(F.col(self.p)) + b))))
        return df.withColumn("calibrated", F.col(self.p))


def calibrate(fit_on: DataFrame, p: str, label: str, method: str) -> Calibration:
    """Fit platt or isotonic on the different scores, each with its rate and weight; identity needs no fit."""
    if method == "identity":
        return Calibration(method, p)
    train = fit_on.where(F.col(p).isNotNull())
    if method == "isotonic":  # in ranges of bounded rows, see MarketPrior.fit
        train = rows.dealt(train.select(p, label), fit_on.count(), p)
    train = train.groupBy(F.col(p).alias("_p")).agg(F.avg(label).alias("_m"), F.count("*").cast("double").alias("_w"))
    if method == "isotonic":
        return Calibration(method, p, model=IsotonicRegression(featuresCol="_p", labelCol="_m", weightCol="_w", predictionCol="calibrated").fit(train))
    both = F.array(F.struct(F.lit(1.0).alias("y"), (F.col("_m") * F.col("_w")).alias("w")), F.struct(F.lit(0.0).alias("y"), ((1 - F.col("_m")) * F.col("_w")).alias("w")))
    part = train.select(pricing.clip_logit(F.col("_p")).alias("_l"), F.explode(both).alias("s")).select("_l", "s.y", "s.w").where("w > 0")
    x = VectorAssembler(inputCols=["_l"], outputCol="_x")
    model = LogisticRegression(featuresCol="_x", labelCol="y", weightCol="w", regParam=0.0).fit(x.transform(part))
    return Calibration(method, p, (float(model.coefficients[0]), float(model.intercept)))


def auto_select(fit_on: DataFrame, holdout: DataFrame, p: str, label: str) -> str:
    """Isotonic only if its calibration error beats Platt's by 0.001; identity unless the winner beats the raw scores on both that error and Brier's score."""
    fit_on, holdout = (stored(df.select(p, label), "calibration") for df in (fit_on, holdout))  # each is read for every method
    seen = {}
    for m in ("identity", "platt", "isotonic"):
        out = calibrate(fit_on, p, label, m)(holdout).withColumn("_y", F.col(label).cast("double"))
        brier = out.agg(aggregates.brier(F.col("calibrated"), F.col("_y")).alias("b")).first()["b"]
        seen[m] = (aggregates.ece(out, "calibrated", "_y").first()["ece"], brier)
    best = "isotonic" if seen["isotonic"][0] + 0.001 < seen["platt"][0] else "platt"
    raw = seen["identity"]
    return best if seen[best][0] < raw[0] - 0.001 and seen[best][1] < raw[1] - 1e-4 else "identity"


def calibrate_auto(df: DataFrame, p: str, label: str, holdout: DataFrame | None = None, by: Sequence[str] = (), seed: int = 42, least: int = 100) -> Calibration:
    """The method that auto_select() prefers, fitted again on all rows.

    It is chosen on the caller's hold-out, such as the newest dates; without one on a fifth of the rows, by a hash of the columns `by` (all columns, if none
    are given) and the seed; and with fewer than `least` rows on the rows it was fitted on.
    """
    if holdout is not None:
        fit, held, whole = df, holdout, df.unionByName(holdout)
    elif df.limit(least).count() < least:
        fit = held = whole = df
    else:
        fifth = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in (by or df.columns)]), F.lit(5)) == 0
        fit, held, whole = df.where(~fifth), df.where(fifth), df
    return calibrate(whole, p, label, auto_select(fit, held, p, label))


def calibration_report(df: DataFrame, p: str, calibrated: str, label: str) -> DataFrame:
    """Before and after: calibration error, Brier's score, log loss."""
    out = None
    for name, col in (("before", p), ("after", calibrated)):
        one = df.agg(aggregates.brier(F.col(col), F.col(label)).alias("brier"), aggregates.log_loss(F.col(col), F.col(label)).alias("log_loss"))
        one = one.crossJoin(aggregates.ece(df, col, label)).withColumn("stage", F.lit(name))  # one row by one row
        out = one if out is None else out.unionByName(one)
    return out


def fit_plackett_luce(orders: DataFrame, rounds: int = 500, tol: float = 1e-7) -> DataFrame:
    """Strengths (item, strength, summing to 1) from orders (order_id, position, item) by Hunter's minorise-maximise steps, until none moves by tol of the mean strength.

    Each step: an item's places before the last, over the sum, over the choices it was part of, of one over the strength still in the race.
    """
    from pyspark.sql import Window

    after = Window.partitionBy("order_id").orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sofar = Window.partitionBy("order_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max("position").over(Window.partitionBy("order_id"))
    # Orders are made once; where strengths are too many to broadcast, both joins and windows keep partitions of bounded rows.
    data = stored(orders.select("order_id", "position", "item").withColumn("chosen", (F.col("position") < last).cast("int")), "orders")
    n_rows = data.count()
    wins = data.where("item IS NOT NULL").groupBy("item").agg(F.sum("chosen").alias("wins"))
    # Strengths are a table, written each round, so that nothing but totals comes to the driver.
    wins = stored(wins, "order-wins")
    n_items = wins.count()
    if n_items <= rows.BROADCAST_ROWS:
        return _fit_few(data, wins, n_rows, rounds, tol)
    strength = wins.select("item", "wins", F.lit(1.0 / n_items).alias("v"))
    for _ in range(rounds):
        step = rows.dealt(data, n_rows, "item").join(rows.dealt(strength.select("item", "v"), n_rows, "item"), "item")
        step = rows.dealt(step, n_rows, "order_id")
        step = step.withColumn("rest", F.sum("v").over(after)).withColumn("share", F.sum(F.when(F.col("chosen") == 1, 1 / F.col("rest")).otherwise(0.0)).over(sofar))
        new = strength.join(step.groupBy("item").agg(F.sum("share").alias("d")), "item")
        new = stored(new.select("item", "wins", F.col("v").alias("old"), F.when(F.col("d") > 0, (F.col("wins") + 1e-9) / F.col("d")).otherwise(F.col("v")).alias("v")), "order-strengths")
        total = new.agg(F.sum("v").alias("total")).first()["total"]
        change = new.agg(F.max(F.abs(F.col("v") / total - F.col("old"))).alias("change")).first()["change"]
        strength = new.select("item", "wins", (F.col("v") / total).alias("v"))
        if change * n_items < tol:
            break
    return strength.select("item", F.col("v").alias("strength"))


def _fit_few(data: DataFrame, wins: DataFrame, n_rows: int, rounds: int, tol: float) -> DataFrame:
    """The fit where strengths fit a broadcast. An order is gathered once, with numbers for items, and rounds run over arrays: only strengths and their sums travel."""
    spark, known = data.sparkSession, wins.toArrow()
    n = known.num_rows
    won, v = known["wins"].to_numpy().astype(float), np.full(n, 1.0 / max(n, 1))
    number = spark.createDataFrame(pa.table({"item": known["item"], "_i": pa.array(np.arange(n, dtype=np.int32))}), StructType([wins.schema["item"], StructField("_i", IntegerType())]))
    named = rows.dealt(data.join(F.broadcast(number), "item").select("order_id", F.struct("position", "_i", "chosen").alias("x")), n_rows, "order_id")
    field = named.groupBy("order_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    field = stored(field.select(F.col("x._i").alias("i"), F.col("x.chosen").alias("chosen")), "order-fields")

    def sums(v: np.ndarray) -> np.ndarray:
        def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d = np.zeros(n)
            for batch in batches:
                size = pc.list_value_length(batch.column("i")).to_numpy()
                i, chosen = (batch.column(x).flatten().to_numpy() for x in ("i", "chosen"))
                begin = np.cumsum(size) - size
                order, width = np.repeat(np.arange(len(size)), size), int(size.max(initial=0))
                place = np.arange(len(i)) - begin[order]
                # In tables of one row for an order: what is still in the race sums from the end on.
                left = np.zeros((len(size), width))
                left[order, place] = v[i]
                rest = np.cumsum(left[:, ::-1], 1)[:, ::-1][order, place]
                share = np.zeros((len(size), width))
                share[order, place] = np.where(chosen == 1, 1 / rest, 0.0)
                d += np.bincount(i, np.cumsum(share, 1)[order, place], n)
            some = np.flatnonzero(d)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(d[some])], names=["i", "d"])

        got = field.mapInArrow(on, "i int, d double").groupBy("i").agg(F.sum("d").alias("d")).toArrow()
        out = np.zeros(n)
        out[got["i"].to_numpy()] = got["d"].to_numpy()
        return out

    for _ in range(rounds if n else 0):
        d, old = sums(v), v
        v = np.where(d > 0, (won + 1e-9) / np.where(d > 0, d, 1.0), v)
        v = v / v.sum()
        if np.abs(v - old).max() * n < tol:
            break
    return spark.createDataFrame(pa.table({"item": known["item"], "strength": pa.array(v)}), StructType([wins.schema["item"], StructField("strength", DoubleType())]))


def infer_strengths(target: DataFrame, scenarios: int | None = None, rounds: int = 100, shape: int = 2, tol: float = 1e-6) -> DataFrame:
    """Strengths of gamma finishing times whose win shares meet target (race, runner, p), for all races at once: v * sqrt(target / implied), again and again.

    Implied shares are exact, a race goes on until each is within tol of its target, and its strengths sum to 1; a runner whose p is NULL or NaN has none.
    With scenarios, shares are those of so many draws, for all the rounds.
    """
    # A field is gathered once, and rounds run inside the row: no draw becomes a row.
    if scenarios is None:
        return _meet_shares(target, rounds, shape, tol)
    v = target.withColumn("v", F.col("p"))
    out = v.groupBy("race").agg(F.collect_list(F.struct(*v.columns)).alias("_field"))
    for i in range(rounds):
        out = out.withColumn("_field", _strength_round(F.col("_field"), f"fit{i}", scenarios, shape))
    # Of an inner explode Spark infers a filter, for which it would run the rounds again.
    return out.select(F.explode_outer("_field").alias("r")).where("r IS NOT NULL").select("r.*")


#: The least strength, and the least chance that counts.
LEAST = 1e-12
FEW_NODES = 80


@cache
def _nodes(n: int, shape: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and logarithms of weights for fields of n runners, see win_shares()."""
    need = n * (shape - 1) // 2 + 2
    if need <= FEW_NODES:
        nodes, weights = np.polynomial.laguerre.laggauss(need)
        return nodes, np.log(np.maximum(weights, 1e-300))
    at = np.arange(-16.0, np.log(60.0 * shape + 14.0 * np.sqrt(n * shape)), 0.1)
    return np.exp(at), at + np.log(0.1) - np.exp(at)


def win_shares(v: np.ndarray, shape: int) -> np.ndarray:
    """Chances to win of fields (rows) of strengths v that sum to 1, if finishing times are gamma of a whole shape.

    Runner i wins at x with density v^shape x^(shape-1) / (shape-1)! e^-x times the others' sums over k < shape of (v x)^k / k!: a polynomial under e^-x, whose
    integral is exact at enough Gauss-Laguerre nodes. Beyond FEW_NODES, x runs in equal steps of its logarithm.
    """
    nodes, log_weight = _nodes(v.shape[1], shape)
    out = np.zeros(v.shape)
    for x, w in zip(nodes, log_weight, strict=True):
        vx, term, still = v * x, np.ones(v.shape), np.ones(v.shape)
        for k in range(1, shape):
            term = term * vx / k
            still += term
        # term is the density's (v x)^(shape-1) / (shape-1)! by now; the product is at most e^x.
        whole = np.exp(w) * still.prod(1) if len(nodes) <= FEW_NODES else np.exp(w + np.log(still).sum(1))
        out += v * term / still * whole[:, None]
    return out


def _meet(p: np.ndarray, rounds: int, shape: int, tol: float) -> np.ndarray:
    """Strengths of fields (rows) whose win shares are p."""
    v = np.maximum(p, LEAST)
    v /= v.sum(1, keepdims=True)
    if shape == 1:  # shares are strengths
        return v
    goal, some = v.copy(), np.arange(len(v))
    for _ in range(rounds):
        share = win_shares(v[some], shape)
        far = np.abs(share - goal[some]).max(1) >= tol
        some, share = some[far], share[far]
        if not len(some):
            break
        new = np.maximum(v[some] * np.sqrt(goal[some] / np.maximum(share, LEAST)), LEAST)
        v[some] = new / new.sum(1, keepdims=True)
    return v


def _meet_shares(target: DataFrame, rounds: int, shape: int, tol: float) -> DataFrame:
    names = target.columns

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, flat = pc.list_value_length(batch.column("_field")).to_numpy(), batch.column("_field").flatten()
            p, race = flat.field("p").cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)
            v = np.full(len(p), np.nan)
            has = np.flatnonzero(~np.isnan(p))
            n = np.bincount(race[has], minlength=len(size))
            begin = np.cumsum(n) - n
            for k in np.unique(n[n > 0]):
                at = has[begin[n == k][:, None] + np.arange(k)]
                v[at] = _meet(p[at], rounds, shape, tol)
            yield pa.RecordBatch.from_arrays([*[flat.field(c) for c in names], pa.array(v, from_pandas=True)], names=[*names, "v"])

    field = target.groupBy("race").agg(F.collect_list(F.struct(*names)).alias("_field")).select("_field")
    return field.mapInArrow(on, StructType([*target.schema.fields, StructField("v", DoubleType())]))


def _strength_round(field: Column, seed: str, scenarios: int, shape: int) -> Column:
    """A field with its strengths after one round."""
    one = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  f of a value that is made once

    def after(field: Column) -> Column:
        winners = F.transform(F.sequence(F.lit(1), F.lit(scenarios)), lambda s: F.array_min(_times(field, seed, s, shape))["runner"])
        implied = lambda won, r: (F.size(F.filter(won, lambda w: w == r["runner"])) + 0.5) / (scenarios + 1.0)
        return one(winners, lambda won: F.transform(field, lambda r: r.withField("v", r["v"] * F.sqrt(r["p"] / implied(won, r)))))

    return one(field, after)


def _times(field: Column, seed: str, scenario: Column, shape: int) -> Column:
    """Finishing times of a field in a scenario, as sample_orders() draws them: an array of (t, runner)."""
    draw = lambda r: sum((-F.log(rows.uniform(F.lit(seed), F.col("race"), scenario, r["runner"], F.lit(i))) for i in range(shape)), F.lit(0.0))
    return F.transform(field, lambda r: F.struct((draw(r) / r["v"]).alias("t"), r["runner"].alias("runner")))


def fit_stern_shape(runners: DataFrame, orders: DataFrame, shapes: Sequence[int] = (1, 2, 3, 4), scenarios: int = 100) -> DataFrame:
    """Log-likelihood of the observed first two under each shape, with a floor of 1/(2n): shape, loglik, best. orders: race, finishing_order."""
    seen = orders.select("race", F.slice("finishing_order", 1, 2).alias("selection"))
    # A field is gathered once and its draws run inside the row, so only races are shuffled; all shapes take one pass.
    field = runners.groupBy("race").agg(F.collect_list(F.struct("runner", "v")).alias("_field"))
    both = seen.join(field, "race", "left")

    def loglik(shape: int) -> Column:
        first = lambda s: F.transform(F.slice(F.array_sort(_times(F.col("_field"), f"shape{shape}", s, shape)), 1, 2), lambda x: x["runner"])
        came = F.size(F.filter(F.sequence(F.lit(1), F.lit(scenarios)), lambda s: first(s) == F.col("selection")))
        return F.sum(F.log(F.greatest(F.coalesce(F.when(F.col("_field").isNotNull(), came) / scenarios, F.lit(0.0)), F.lit(1 / (2 * scenarios)))))

    one = both.agg(*[loglik(s).alias(f"l{s}") for s in shapes])
    each = one.select(F.array(*[F.struct(F.lit(s).alias("shape"), F.col(f"l{s}").alias("loglik")) for s in shapes]).alias("e"))
    best = F.array_sort("e", lambda a, b: F.when(a["loglik"] > b["loglik"], -1).when(a["loglik"] < b["loglik"], 1).otherwise(0))
    return each.select(F.get(best, F.lit(0))["shape"].alias("best"), F.explode("e").alias("e")).select("e.shape", "e.loglik", (F.col("e.shape") == F.col("best")).alias("best"))
