"""Readers and writers of files, all through Spark."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import merge_bundle

CARD_SCHEMA = "source string, card_date date, track string, races array<struct<number:int,distance:double,surface:string,confidence:double,entries:array<struct<post:int,horse:string,jockey:string,odds:double,history:array<struct<day:date,finish:int,figure:double>>>>>>"
#: The star schema: each table's key comes first.
STAR = {
    "datasets": "dataset_key string, source string, file string, version string, n_in long, n_rejected long, n_known long",
    "tracks": "track_key string, track string, jurisdiction string, surfaces array<string>",
    "races": "race_key string, track_key string, race_date date, race_number int, distance double, surface string",
    "horses": "horse_key string, name string, foaling_year int, country string",
    "jockeys": "jockey_key string, name string, jurisdiction string",
    "trainers": "trainer_key string, name string, jurisdiction string",
    "race_results": "result_key string, race_key string, horse_key string, jockey_key string, trainer_key string, post int, finish int, odds double, quality double",
}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in storage that all executors share: the checkpoint folder, else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to shared storage and read back: its lineage ends there, and lost executors cost no more than a read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv_source(spark: SparkSession, path: str, largest: bool = False) -> DataFrame:
    """All columns as text, so that types do not depend on the file; of a folder all files, or the largest only."""
    df = spark.read.option("header", True).csv(path)
    if largest:
        files = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("n")).distinct()
        best = files.agg(F.max_by("f", F.struct("n", "f")).alias("f")).first()["f"]
        df = df.where(F.col("_metadata.file_path") == best)
    return df


def read_bundle(spark: SparkSession, path: str, fact: str, dim: str, key: str) -> DataFrame:
    """Files of facts and of one dimension in one folder, joined: all facts stay, a clashing name gets a suffix on the dimension's side."""
    return merge_bundle(read_csv_source(spark, f"{path}/{fact}"), read_csv_source(spark, f"{path}/{dim}"), key)


def save_models(models: dict[str, PipelineModel | None], root: str) -> None:
    for name, model in models.items():
        if model is not None:
            model.write().overwrite().save(f"{root}/{name}")


def load_models(spark: SparkSession, root: str, required: Sequence[str], optional: Sequence[str] = ()) -> dict[str, PipelineModel | None]:
    """Saved models by name; an optional one that is not there is None, a required one is an error that names all missing."""
    there = {n: exists(spark, f"{root}/{n}") for n in [*required, *optional]}
    missing = [n for n in required if not there[n]]
    if missing:
        raise FileNotFoundError(f"no saved model {', '.join(missing)} in {root}")
    return {n: PipelineModel.load(f"{root}/{n}") if ok else None for n, ok in there.items()}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_training_table(spark: SparkSession, path: str, day: str, numbers: Sequence[str]) -> DataFrame:
    """Dates without a time of day; numeric columns as numbers, NaN as NULL."""
    df = spark.read.parquet(path)
    value = lambda c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double"))
    return df.withColumns({day: F.to_date(day), **{c: value(c) for c in numbers}})


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CARD_SCHEMA).json(path, multiLine=False)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    (df.write.partitionBy(*by) if by else df.write).parquet(path)


def write_rejects(df: DataFrame, path: str) -> None:
    """One JSON line per row."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def create_tables(spark: SparkSession, root: str) -> None:
    """Empty tables of the star schema where there are none."""
    for name, schema in STAR.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def register_dataset(spark: SparkSession, root: str, new: DataFrame) -> None:
    """Append sources (source, file, version) that are not registered."""
    key = F.sha2(F.concat_ws("|", "source", "file", "version"), 256)
    have = spark.read.schema(STAR["datasets"]).parquet(f"{root}/datasets")
    rows = new.select(key.alias("dataset_key"), "source", "file", "version").dropDuplicates(["dataset_key"]).join(have.select("dataset_key"), "dataset_key", "left_anti")
    rows = rows.select("*", *[F.lit(None).cast("long").alias(c) for c in ("n_in", "n_rejected", "n_known")])
    rows.write.mode("append").parquet(f"{root}/datasets")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


PROVENANCE = "model string, data_source string, trained_at timestamp, synthetic boolean"


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """One row; what is missing or unreadable counts as synthetic."""
    default = spark.createDataFrame([(None, None, None, True)], PROVENANCE)
    try:
        found = spark.read.schema(PROVENANCE).json(path).where(F.col("model").isNotNull())
        found = found.withColumn("synthetic", F.coalesce("synthetic", F.lit(True)))
        return default if found.isEmpty() else found.limit(1)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return default


def write_provenance(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


DRIFT = "triggered boolean, since timestamp, updated timestamp"


def write_drift_flag(df: DataFrame, path: str) -> None:
    df.select("triggered", "since", F.current_timestamp().alias("updated")).write.mode("append").parquet(path)


def read_drift_flag(spark: SparkSession, path: str) -> DataFrame:
    """The last state; not triggered where there is none."""
    default = spark.createDataFrame([(False, None, None)], DRIFT)
    try:
        last = spark.read.schema(DRIFT).parquet(path).orderBy(F.desc("updated")).limit(1)
        return default if last.isEmpty() else last
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return default
