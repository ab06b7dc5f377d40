"""Exact quantiles by key with a fixed number of counts for a key, however many values it has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored
from .rows import if_small

#: Bins of a histogram, and values that are few enough to be sorted at once.
BINS, FEW = 1024, 4096


def _magnitude(c: Column) -> Column:
    """Grows with c over all doubles: the logarithm of its size, which is above -745, with its sign."""
    return F.when(c == 0, 0.0).otherwise(F.signum(c) * (F.log(F.abs(c)) + 746))


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, alpha: float, bins: int = BINS, few: int = FEW) -> DataFrame:
    """keys and `quantile`, which is what percentile(value, alpha) gives, bit by bit; keys without values have NULL.

    The two order statistics beside the place alpha * (n - 1) are looked for. A pass counts the values between the bounds of each in bins, and the bin with
    the statistic, narrowed to the least and largest value in it, has the next bounds; few values, or one alone, end the search. So a key costs bins counts
    a pass and few rows at the end. A pass narrows the bounds about a thousandfold; values that are spread evenly take two or three.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    known = rows.where("_v is not null")
    place = (F.col("_n") - 1) * F.lit(float(alpha))
    bounds = known.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    open_ = stored(bounds.withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1)))).select(*keys, "_side", "_lo", "_hi", F.when(F.col("_side") == 0, F.floor(place)).otherwise(F.ceil(place)).alias("_rank"), F.col("_n").alias("_held")), "quantile-bounds")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]

    def inside(b: DataFrame) -> DataFrame:
        """Values between the bounds of the statistics that are still looked for."""
        on = (F.col("r._v") >= F.col("b._lo")) & (F.col("r._v") <= F.col("b._hi"))
        for s in same:
            on &= s
        return known.alias("r").join(if_small(b).alias("b"), on).select("b.*", F.col("r._v").alias("_v"))

    found = []
    while True:
        done = (F.col("_lo") == F.col("_hi")) | (F.col("_held") <= few)
        found.append(open_.where(done))
        open_ = open_.where(~done)
        if open_.isEmpty():
            break
        # Even bins of the values, and every other pass of their logarithms, for values of many magnitudes. Halves keep the difference of the bounds finite.
        scale = _magnitude if len(found) % 2 == 0 else (lambda c: c / 2)
        low, high = scale(F.col("_lo")), scale(F.col("_hi"))
        bin_ = F.coalesce(F.least(F.floor(F.try_divide(scale(F.col("_v")) - low, high - low) * bins), F.lit(bins - 1)), F.lit(0))
        each = inside(open_).groupBy(*keys, "_side", "_rank", bin_.alias("_bin")).agg(F.count("*").alias("_held"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_held").over(Window.partitionBy(*keys, "_side").orderBy("_bin"))  # at most `bins` rows
        narrow = each.withColumn("_upto", upto).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_held")))
        open_ = stored(narrow.select(*keys, "_side", "_lo", "_hi", (F.col("_rank") - (F.col("_upto") - F.col("_held"))).alias("_rank"), "_held"), "quantile-bounds")
    ends = found[0]
    for f in found[1:]:
        ends = ends.unionByName(f)
    one = ends.where("_lo = _hi").select(*keys, "_side", F.col("_lo").alias("_v"))
    at = F.row_number().over(Window.partitionBy(*keys, "_side").orderBy("_v")) - 1
    some = inside(ends.where("_lo < _hi")).withColumn("_at", at).where("_at = _rank").select(*keys, "_side", "_v")
    both = one.unionByName(some).groupBy(*keys).agg(F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_a"), F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_b"))
    sizes = rows.groupBy(*keys).agg(F.count("_v").alias("_n"))
    on = F.lit(True)
    for k in keys:
        on &= F.col(f"s.{k}").eqNullSafe(F.col(f"q.{k}"))
    out = sizes.alias("s").join(both.alias("q"), on, "left").select("s.*", "_a", "_b")
    quantile = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.ceil(place) - place) * F.col("_a") + (place - F.floor(place)) * F.col("_b"))
    return out.select(*keys, quantile.alias("quantile"))
