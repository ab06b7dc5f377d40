"""Whole jobs: train a bundle of models on a window of time, score cards with it, and turn the chances into stakes."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.files import stored
from . import models, outcomes, rows, windows


@dataclass(frozen=True)
class Roles:
    """Names of columns. `pace` are the columns without which there is no pace score, `meta` go to the stacker beside the scores."""

    race: str
    runner: str
    day: str
    odds: str
    label: str
    features: Sequence[str]
    pace: Sequence[str]
    meta: Sequence[str]
    scores: Sequence[str] = ("speed", "pace_score", "market")


@dataclass(frozen=True)
class Bundle:
    roles: Roles
    speed: PipelineModel | None
    pace: PipelineModel | None
    market: models.MarketPrior | None
    stacker: models.Stacker
    calibration: models.Calibration

    def score(self, df: DataFrame) -> DataFrame:
        """df with the scores of the models, `stacked` and `calibrated`."""
        out = self.stacker.score(_sub_scores(df, self.roles, self.speed, self.pace, self.market), "stacked")
        return self.calibration(out)


def _sub_scores(df: DataFrame, r: Roles, speed: PipelineModel | None, pace: PipelineModel | None, market: models.MarketPrior | None) -> DataFrame:
    """Scores of the models; one that is not there scores 0.5 everywhere, and a market that is not there counts as missing."""
    out = df.withColumn("speed", F.lit(0.5)) if speed is None else models.score_win_model(speed, df, r.features, "speed")
    out = models.score_gated(pace, out, r.pace, "pace_score")
    out = out.withColumn("market", F.lit(None).cast("double")) if market is None else market(out)
    return rows.neutral_fallback(out, ["speed", "pace_score"], "market").withColumn("market", F.coalesce("market", F.lit(0.5)))


def save_bundle(bundle: Bundle, root: str, provenance: DataFrame) -> None:
    """Write all parts with MLlib's writers, provenance beside them, and last the card that names the parts: without it there is no bundle, so one that was cut short is never loaded."""
    spark, r, cal = provenance.sparkSession, bundle.roles, bundle.calibration
    parts = {"speed": bundle.speed, "pace": bundle.pace, "market": bundle.market and bundle.market.model, "stacker": bundle.stacker.model, "calibration": cal.model}
    for name, model in parts.items():
        if model is not None:
            model.write().overwrite().save(f"{root}/{name}")
    bundle.stacker.lines.write.mode("overwrite").parquet(f"{root}/stacker_lines")
    files.write_provenance(provenance, f"{root}/provenance")
    card = {"roles": {f.name: v if isinstance(v := getattr(r, f.name), str) else list(v) for f in fields(r)}, "parts": [n for n, m in parts.items() if m is not None], "calibration": {"method": cal.method, "p": cal.p, "curve": cal.curve}}
    spark.createDataFrame([(json.dumps(card),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/card")


def load_bundle(spark: SparkSession, root: str) -> tuple[Bundle, DataFrame]:
    """A saved bundle and its provenance. Stacker and calibration must be there; speed, pace and market may have been taken away, and score as missing then. Provenance that is missing or unreadable counts as synthetic."""
    if not files.exists(spark, f"{root}/card"):
        raise FileNotFoundError(f"no saved bundle in {root}")
    card = json.loads(spark.read.text(f"{root}/card").first()["value"])
    r = Roles(**card["roles"])
    there = {n: n in card["parts"] and files.exists(spark, f"{root}/{n}") for n in ("speed", "pace", "market", "stacker", "calibration")}
    cal = card["calibration"]
    lost = [n for n in ("stacker", "calibration") if not there[n] and (n == "stacker" or cal["method"] == "isotonic")]
    if lost:
        raise FileNotFoundError(f"no saved {', '.join(lost)} in {root}")
    speed, pace = (PipelineModel.load(f"{root}/{n}") if there[n] else None for n in ("speed", "pace"))
    market = models.MarketPrior(IsotonicRegressionModel.load(f"{root}/market"), r.odds, r.race) if there["market"] else None
    stacker = models.Stacker(spark.read.parquet(f"{root}/stacker_lines"), PipelineModel.load(f"{root}/stacker"), r.scores, r.meta)
    curve = cal["curve"] and tuple(cal["curve"])
    calibration = models.Calibration(cal["method"], cal["p"], curve, IsotonicRegressionModel.load(f"{root}/calibration") if there["calibration"] else None)
    return Bundle(r, speed, pace, market, stacker, calibration), files.read_provenance(spark, f"{root}/provenance")


def fit_bundle(train: DataFrame, calib: DataFrame, r: Roles, rounds: int = 20, depth: int = 4, min_rows: int = 5000) -> Bundle:
    """The sub-models and the stacker learn from train, with early stopping on calib; calibration is fitted on calib."""
    speed = models.fit_win_model(train, calib, r.features, r.label, rounds, depth)
    pace = models.fit_gated(train, calib, r.pace, r.label, rounds, depth, min_rows)
    market = models.MarketPrior.fit(train, r.odds, r.race, r.label)
    parts = [stored(_sub_scores(df, r, speed, pace, market), "scores") for df in (train, calib)]
    stacker = models.fit_stacker(*parts, r.scores, r.meta, r.label, rounds, min(depth, 3))
    return Bundle(r, speed, pace, market, stacker, models.calibrate(stacker.score(parts[1], "stacked"), "stacked", r.label, "isotonic"))


def rolling_retrain(table: DataFrame, r: Roles, as_of: dt.date, years: int, drift: DataFrame | None = None, rounds: int = 20, depth: int = 4, min_rows: int = 5000) -> tuple[Bundle | None, DataFrame]:
    """Train on the years before as_of, unless a drift flag is given and not set. Returns the bundle and a report.

    Report: stage (before or after calibration, on the newest tenth of the dates), brier, log_loss, ece, n_test; a skipped run reports one row, stage 'skipped'.
    """
    spark = table.sparkSession
    if drift is not None and not drift.first()["triggered"]:
        return None, spark.createDataFrame([("skipped", None, None, None, 0)], "stage string, brier double, log_loss double, ece double, n_test long")
    parts = stored(rows.three_way_time_split(rows.rolling_window_slice(table, r.day, as_of, years), r.day), "window")
    train, calib, test = (parts.where(F.col("part") == p).drop("part") for p in ("train", "calib", "test"))
    bundle = fit_bundle(train, calib, r, rounds, depth, min_rows)
    out = stored(bundle.score(test).withColumn("_y", F.col(r.label).cast("double")), "tested")
    n = out.agg(F.count("*").alias("n_test"))
    report = models.calibration_report(out, "stacked", "calibrated", "_y").crossJoin(n)  # by one row
    return bundle, report.select("stage", "brier", "log_loss", "ece", "n_test")


def score_card(cards: DataFrame, bundle: Bundle, levels: Sequence[float], min_edge: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Chances of all runners of all cards, and a stake plan of each race for each level of tail loss.

    Chances: race, runner, p (sums to 1 in a race), odds. Plans are those of risk_capped_allocation; races without a bet of enough edge have none.
    """
    r = bundle.roles
    floor = F.greatest(F.col("calibrated"), F.lit(1e-6))
    scored = bundle.score(cards).select(F.col(r.race).alias("race"), F.col(r.runner).alias("runner"), F.col(r.odds).alias("odds"), floor.alias("_c"))
    chances = stored(scored.select("race", "runner", "odds", windows.normalise_in_race(F.col("_c"), windows.race("race")).alias("p")), "chances")
    bets = chances.select("race", F.lit("win").alias("bet_type"), F.array("runner").alias("selection"), "p", "odds")
    worth = rows.ev_candidates(bets.drop("odds"), bets.drop("p"), min_edge)
    return chances, outcomes.risk_capped_allocation(chances, worth, levels)
