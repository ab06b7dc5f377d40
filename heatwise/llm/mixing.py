"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, own_name, small, word_count

#: Source tables up to so many rows are broadcast; larger ones are joined by key.
MAX_SOURCES = 50_000
ROWS_A_BUCKET = 2000
MAX_BUCKETS = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """From one row (skey, source_size) per source: its weight by order of skey, and its target.

    The weights share `share` times all sizes; a target stops at `cap` times its source's size and
    the excess goes to the others by weight. With sources in order of cap/weight the capped ones
    are a prefix, so one running sum finds the level at which no target is above its cap. One row
    per source passes through one task, never one per document.
    """
    everything = Window.partitionBy()
    by_room = Window.orderBy("room", "skey")
    upto = by_room.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(Window.orderBy("skey")) - 1) % len(weights) + 1)
    s = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    s = s.withColumn("room", F.col("most") / F.col("weight"))
    s = s.withColumns({
        "spent": F.coalesce(F.sum("most").over(upto), F.lit(0.0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)),
        "all": F.sum("source_size").over(everything) * float(share),
    })
    s = s.withColumn("level", (F.col("all") - F.col("spent")) / F.col("open"))
    # The first source, in order of room, whose level does not exceed its room sets the level for it and all after it.
    level = F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "skey", "level"))).over(everything)
    s = s.withColumn("found", level)
    free = F.col("found").isNotNull() & (F.struct("room", "skey") >= F.struct("found.room", "found.skey"))
    return s.select("skey", "source_size", F.when(free, F.col("found.level") * F.col("weight")).otherwise(F.col("most")).alias("target"))


def systematic_mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", carry: bool = False) -> DataFrame:
    """How many copies of each document a mix takes: prefix sums of expected copies, one random offset a source, a copy for each integer boundary crossed.

    docs: doc_id, text, source. One row per input row: doc_id, size, source_size, target, copies,
    taken (= copies * size); with carry, the input's columns as well (they win over clashing names,
    which then get the prefix mix_). Documents of a source are ordered by size class, so that
    taken words come near the target; a prefix sum has two levels (buckets of a source, then rows of
    a bucket), so that a hot source is spread over many tasks. Null texts have size 0; null sources
    are one source, last in order; an empty table gives an empty result; repeated rows count each.
    """
    src = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    size = word_count(F.col("text"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    light = cut(docs.select("doc_id", src.alias("skey"), size.alias("size"), key.alias("h")), "mix-sizes")
    buckets = max(1, min(MAX_BUCKETS, light.count() // ROWS_A_BUCKET))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumns({"klass": F.floor(F.sqrt("size") * 4), "part": F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % buckets})

    at = ["skey", "klass", "part"]
    counts = placed(light).groupBy(*at).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    counts = cut(counts, "mix-buckets")
    targets = source_targets(counts.groupBy("skey").agg(F.sum("words").alias("source_size")), weights, share, cap)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), "skey")), 1, 8), 16, 10).cast("double") / 4294967296.0
    targets = targets.withColumns({"rate": F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0), "offset": offset})
    before = F.coalesce(F.sum("n").over(Window.partitionBy("skey").orderBy("klass", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before).drop("n", "words")
    counts = counts.join(small(targets, MAX_SOURCES), "skey")
    if carry:
        rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", src.alias("skey"), size.alias("size"), key.alias("h"))
    else:
        rows = light
    rows = placed(rows).join(counts, at)
    # Equal rows are alike, so their order does not matter; reruns agree.
    rank = F.row_number().over(Window.partitionBy(*at).orderBy("size", "h", "doc_id")) + F.col("before")
    upto = lambda r: F.floor(F.col("rate") * r + F.col("offset"))
    rows = rows.withColumn("rank", rank).withColumn("copies", (upto(F.col("rank")) - upto(F.col("rank") - 1)).cast("long"))
    out = {c: F.col(c) for c in ("size", "source_size", "target", "copies")} | {"taken": F.col("copies") * F.col("size")}
    if not carry:
        return rows.select("doc_id", *[v.alias(k) for k, v in out.items()])
    return rows.select("row.*", *[v.alias(mix_name(docs, k)) for k, v in out.items()])


def mix_name(docs: DataFrame, name: str) -> str:
    """The name of a column of the mix beside the columns of docs: with as many mix_ before it as it takes to clash with none."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"mix_{name}"
    return name


def emit_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of docs as many times as the mix takes it, with the columns of docs."""
    mixed = systematic_mix(docs, carry=True, **options)
    copies, one = F.col(mix_name(docs, "copies")), own_name(mixed, "copy")
    return mixed.where(copies > 0).withColumn(one, F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(*docs.columns)
