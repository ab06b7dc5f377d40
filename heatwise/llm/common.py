"""Shared helpers of the training-data operators: shared storage, checked broadcasts, batches."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 1_500_000
#: Rows with texts that go to a Python worker at once.
TEXTS_A_BATCH = 500
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, the checkpoint folder that was set on the context, else one in the warehouse, which they share too."""
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    root = context.getConf().get("spark.checkpoint.dir") or (have.get() if have.isDefined() else None)
    if root is None:
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        if re.match("file:|/", root) and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return re.sub("^file:/+", "file:///", root).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Names of the folders that cut() made: forget() deletes no others.
_MADE: set[str] = set()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to shared storage and read it again: lineage ends here, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    _MADE.add(path.rsplit("/", 1)[-1])
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, n: int = TEXTS_A_BATCH) -> Iterator[None]:
    """Arrow batches of at most n rows for what runs inside: for wide rows, so that a batch stays small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def forget(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more: what was made of them has been cut itself. Other tables stay as they are.

    Spark drops the shuffle files of queries that are over when the driver collects its garbage, so that is asked for as well.
    """
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            name = folder.rsplit("/", 1)[-1]
            if name in _MADE:
                _MADE.discard(name)
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
    tables[0].sparkSession._jvm.System.gc()


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows, else df as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def without(df: DataFrame, ids: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """The rows of df whose doc_id is not in ids, a table that is read more than once. Nulls are equal here. Up to max_rows ids are broadcast."""
    name = own_name(df, "gone")
    gone = small(ids.select(F.col("doc_id").alias(name)), max_rows)
    return df.join(gone, df["doc_id"].eqNullSafe(gone[name]), "left_anti")


def own_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod5(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)).cast("int")


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut Arrow batches where the text of the column reaches the limit; a longer text is a slice of its own. Null texts come as empty ones."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        if text.null_count:
            text = text.fill_null("")
        lengths = pc.binary_length(text).to_numpy(zero_copy_only=False)
        at, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(at, i - at), text.slice(at, i - at)
                at, held = i, 0
            held += int(n)
        if at < len(lengths):
            yield batch.slice(at), text.slice(at)
