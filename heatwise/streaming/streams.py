"""Structured Streaming forms of ingestion, outcomes, settlement and drift. Each has a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import aggregates, rows, star
from ..sources.files import exists


def stream_ingest(source: DataFrame, spec: dict[str, dict], score: Callable[[DataFrame], DataFrame], table: str, key: str, checkpoint: str):
    """Map and score arriving rows and append those that pass and whose key the table has not. A replayed batch adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        good, _bad = rows.accept_reject(score(rows.apply_field_map(df, spec)))
        have = df.sparkSession.read.parquet(table) if exists(df.sparkSession, table) else good.limit(0)
        rows.insert_if_absent(good, have, key).write.mode("append").parquet(table)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def stream_star(source: DataFrame, spec: dict[str, dict], root: str, name: str, checkpoint: str):
    """Map arriving rows to flat results and merge them into a star; races that get rows are scored again as a whole.

    name belongs to the checkpoint: a batch that is replayed after a stop has the same name and number, and is applied once. See star.ingest.
    """

    def batch(df: DataFrame, n: int) -> None:
        star.ingest(star.Star(df.sparkSession, root), rows.apply_field_map(df, spec), f"{name}-{n}")

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def stream_outcomes(source: DataFrame, key: str, at: str, delay: str = "7 days") -> DataFrame:
    """The first outcome of each race within the watermark. Later repeats are for insert_if_absent at the sink."""
    return source.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


class Cusum(StatefulProcessor):
    """Page's two sums for a key over rows in order of time. The first alarm stays until the key changes epoch.

    Rows wait until the key has seen a time `delay` later, so that rows that come in another order within it are put in place; with no delay those of a
    batch are applied with it. A row that comes behind what was applied already is late: it is given out with that mark and leaves the sums alone, so
    rows on time have what a batch over them would give. State is the sums, the last row applied, and the rows of the delay.
    """

    def __init__(self, k: float = 0.5, h: float = 4.0, delay: float = 0.0):
        self.k, self.h, self.delay = k, h, pd.Timedelta(seconds=delay)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sums", "high double, low double, n long, step long, side string, top timestamp, at timestamp, event long")
        self.wait = handle.getListState("wait", "event_id long, ts timestamp, z double")

    def handleInputRows(self, key: Any, batches: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        high, low, n, step, side, top, at, event = self.state.get() if self.state.exists() else (0.0, 0.0, 0, -1, "", None, None, None)
        top, at = (None if t is None else pd.Timestamp(t) for t in (top, at))
        kept = [pd.DataFrame(list(self.wait.get()), columns=["event_id", "ts", "z"])] if self.wait.exists() else []
        for pdf in batches:
            pdf = pdf[["event_id", "ts", "z"]]
            late = pd.Series(False, index=pdf.index) if at is None else (pdf["ts"] < at) | ((pdf["ts"] == at) & (pdf["event_id"] <= event))
            if late.any():
                marks = (n, high, low, step if step > 0 else None, side or None, True)
                yield pd.DataFrame([(key[0], e, t, *marks) for e, t in zip(pdf["event_id"][late], pdf["ts"][late], strict=True)], columns=CUSUM_COLUMNS)
            kept.append(pdf[~late])
        rows = pd.concat([p for p in kept if len(p)] or [pd.DataFrame({"event_id": [], "ts": pd.to_datetime([]), "z": []})]).sort_values(["ts", "event_id"])
        if len(rows):
            top = rows["ts"].iloc[-1] if top is None else max(top, rows["ts"].iloc[-1])
            ready = rows["ts"] <= top - self.delay
            out = []
            for e, t, z in zip(rows["event_id"][ready], rows["ts"][ready], rows["z"][ready], strict=True):
                n += 1
                high, low = max(0.0, high + z - self.k), max(0.0, low - z - self.k)
                if step < 0 and (high > self.h or low > self.h):
                    step, side = n, "high" if high > self.h else "low"
                out.append((key[0], e, t, n, high, low, step if step > 0 else None, side or None, False))
                at, event = t, int(e)
            if out:
                yield pd.DataFrame(out, columns=CUSUM_COLUMNS)
            held = [(int(e), t.to_pydatetime(), float(z)) for e, t, z in zip(rows["event_id"][~ready], rows["ts"][~ready], rows["z"][~ready], strict=True)]
            if held:
                self.wait.put(held)
            elif kept and self.wait.exists():
                self.wait.clear()
        self.state.update((high, low, n, step, side, None if top is None else top.to_pydatetime(), None if at is None else at.to_pydatetime(), event))

    def close(self) -> None:
        pass


CUSUM_COLUMNS = ["key", "event_id", "ts", "step", "s_high", "s_low", "alarm_step", "direction", "late"]


def stream_cusum(source: DataFrame, key: str, k: float = 0.5, h: float = 4.0, delay: float = 0.0) -> DataFrame:
    """source: key, event_id, ts, z. delay in seconds is how long rows wait for earlier ones. Needs the RocksDB state store. An epoch in the key restarts a detector."""
    schema = "key string, event_id long, ts timestamp, step long, s_high double, s_low double, alarm_step long, direction string, late boolean"
    return source.withColumn("_key", F.col(key).cast("string")).groupBy("_key").transformWithStateInPandas(Cusum(k, h, delay), schema, "Append", "None")


def stream_settle(recs: DataFrame, outcomes: DataFrame, rec_at: str, out_at: str, within: str = "10 days") -> DataFrame:
    """Bets joined with outcomes that come within a time after them; both sides have watermarks, so state is bounded."""
    r = recs.withWatermark(rec_at, within).alias("r")
    o = outcomes.withWatermark(out_at, within).alias("o")
    on = (F.col("r.race") == F.col("o.race")) & (F.col(f"o.{out_at}") >= F.col(f"r.{rec_at}")) & (F.col(f"o.{out_at}") <= F.col(f"r.{rec_at}") + F.expr(f"INTERVAL {within}"))
    both = r.join(o, on).select("r.*", "o.finishing_order")
    won = F.expr("slice(finishing_order, 1, size(selection))") == F.col("selection")
    both = both.withColumn("won", F.coalesce(won & (F.size("finishing_order") >= F.size("selection")), F.lit(False)))
    payout = F.when(F.col("won"), F.col("stake") * F.col("odds")).otherwise(0.0)
    return both.withColumns({"payout": payout, "pnl": payout - F.col("stake")})


def stream_calibration(source: DataFrame, at: str, p: str, y: str, size: str = "7 days", slide: str = "1 day", delay: str = "1 day", bins: int = 15) -> DataFrame:
    """Per sliding window and bin: counts, means and squared error, from which calibration error follows. Works on a stream or a table."""
    b = aggregates.calibration_bin(F.col(p), bins)
    return source.withWatermark(at, delay).groupBy(F.window(at, size, slide).alias("w"), b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"), F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))


def drift_flag(alarms: DataFrame, at: str) -> DataFrame:
    """One row: whether any detector has an alarm, and since when."""
    return alarms.where(F.col("alarm_step").isNotNull()).agg((F.count("*") > 0).alias("triggered"), F.min(at).alias("since"))
