"""Running sums over streams that are too long for one task: scans in two levels, over ranges of the order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored
from .rows import if_small


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Equal in all names; right has them with a _ in front. Nulls are equal."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[f"_{n}"]) for n in names], F.lit(True))


def cusum_ranges(df: DataFrame, z: str, key: Sequence[str], order: Sequence[str], k: float = 0.5, h: float = 4.0, ranges: int | None = None) -> DataFrame:
    """windows.cusum() in ranges of (key, order), so that a key, or a stream without one, is the work of many tasks.

    A range is known by its sum and the least of its running sums. Two neighbours make one range: sums add up, and the least is that of the first or the
    first's sum with the least of the second. What comes before a range is a window over one row for each range; the rows of a range then need only
    their own running sums. A missing z changes no sum. Rows that share key and order lie in one range, in no certain sequence.
    """
    key, order = list(key), list(order)
    dealt = df.repartitionByRange(ranges, *key, *order) if ranges else df.repartitionByRange(*key, *order)
    # The number of a row's range must not change when a task runs again, so it is written.
    rows = stored(dealt.withColumn("_range", F.spark_partition_id()), "cusum-ranges")
    own = [*key, "_range"]
    w = Window.partitionBy(*own).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    z_ = F.col(z)
    local = rows.withColumns({"_up": F.sum(F.coalesce(z_ - k, F.lit(0.0))).over(upto), "_down": F.sum(F.coalesce(-z_ - k, F.lit(0.0))).over(upto), "_step": F.row_number().over(w).cast("long")})
    local = local.withColumns({"_least_up": F.min("_up").over(upto), "_least_down": F.min("_down").over(upto)})
    # The running sums of a range end in its sum, so one row for each range comes from partial aggregates.
    total = local.groupBy(*own).agg(F.max_by("_up", "_step").alias("up"), F.max_by("_down", "_step").alias("down"), F.min("_up").alias("least_up"), F.min("_down").alias("least_down"), F.max("_step").alias("n"))
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumns({f"before_{x}": F.coalesce(F.sum(x).over(before), F.lit(0)) for x in ("up", "down", "n")})
    total = total.withColumns({f"low_{x}": F.coalesce(F.least(F.lit(0.0), F.min(F.col(f"before_{x}") + F.col(f"least_{x}")).over(before)), F.lit(0.0)) for x in ("up", "down")})
    carried = total.select(*[F.col(c).alias(f"_{c}") for c in own], *[f"{a}_{x}" for a in ("before", "low") for x in ("up", "down")], "before_n")
    out = local.join(if_small(carried), _same(local, carried, own))

    def sums(x: str) -> Column:
        return F.col(f"before_{x}") + F.col(f"_{x}") - F.least(F.col(f"low_{x}"), F.col(f"before_{x}") + F.col(f"_least_{x}"))

    out = out.select(*[local[c] for c in df.columns], (F.col("before_n") + F.col("_step")).alias("step"), sums("up").alias("s_high"), sums("down").alias("s_low"))
    hit = F.when(F.col("s_high") > h, F.struct("step", F.lit(0).alias("side"))).when(F.col("s_low") > h, F.struct("step", F.lit(1).alias("side")))
    first = out.groupBy(*key).agg(F.min(hit).alias("_hit"))
    first = first.select(*[F.col(c).alias(f"_{c}") for c in key], "_hit")
    latched = out.join(if_small(first), _same(out, first, key), "left") if key else out.crossJoin(F.broadcast(first))  # one row without a key
    return latched.select(*[out[c] for c in out.columns], F.col("_hit.step").alias("alarm_step"), F.when(F.col("_hit.side") == 0, "high").when(F.col("_hit.side") == 1, "low").alias("direction"))
