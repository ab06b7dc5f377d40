"""The contest view of the star schema, in Spark and as SQL, and the registry of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of the contest view that one task sorts. What its windows and draws hold is a fixed multiple of that, so it must not grow with the tables.
TASK_ROWS = 250_000


def dealt(df: DataFrame, key: str, n_rows: int) -> DataFrame:
    """df in partitions by key of about TASK_ROWS rows where shuffles as they are set would make larger ones."""
    n = -(-n_rows // TASK_ROWS)
    return df.repartition(n, key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line: race (order), post, entity (part), jockey (supplier), trainer (customer), day, figure (some are missing), finish, win, odds, claim, purse, calls of the race."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n_rows = line.count()  # from the files' footers
    r = dealt(line, "l_orderkey", n_rows).join(dealt(orders, "o_orderkey", n_rows), F.col("l_orderkey") == F.col("o_orderkey"))
    post = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE)).cast("long")
    q = F.col("l_quantity")
    r = r.select(
        F.col("l_orderkey").alias("race"), post.alias("post"), F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("jockey"), F.col("o_custkey").alias("trainer"),
        F.to_date("l_shipdate").alias("day"), F.when(q % 7 != 0, q).alias("figure"), q.alias("q"), F.col("l_extendedprice").alias("price"), (1 + F.col("l_extendedprice") / 5000).alias("odds"),
        F.col("l_tax").alias("tax"), F.col("l_discount").alias("disc"), F.col("o_totalprice").alias("purse"), F.when(q % 3 == 0, F.col("l_extendedprice")).alias("claim"),
        F.when(q % 5 == 0, "unknown").otherwise(F.col("l_returnflag")).alias("kind"), F.col("o_orderpriority").alias("track"), F.col("l_linestatus").alias("style"),
    )
    return r.withColumn("finish", F.row_number().over(Window.partitionBy("race").orderBy(F.desc("price"), "post")).cast("long")).withColumn("win", (F.col("finish") == 1).cast("int"))


#: The same as common table expressions; a query goes on with a comma or a SELECT.
RUN = """WITH run0 AS (SELECT l_orderkey AS race, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS post,
 l_partkey AS entity, l_suppkey AS jockey, o_custkey AS trainer, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_quantity % 7 <> 0 THEN l_quantity END AS figure, l_quantity AS q,
 l_extendedprice AS price, 1 + l_extendedprice / 5000 AS odds, l_tax AS tax, l_discount AS disc, o_totalprice AS purse, CASE WHEN l_quantity % 3 = 0 THEN l_extendedprice END AS claim,
 CASE WHEN l_quantity % 5 = 0 THEN 'unknown' ELSE l_returnflag END AS kind, o_orderpriority AS track, l_linestatus AS style
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
run1 AS (SELECT *, row_number() OVER (PARTITION BY race ORDER BY price DESC, post) AS finish FROM run0),
run AS (SELECT *, CASE WHEN finish = 1 THEN 1 ELSE 0 END AS win FROM run1)"""

HIST = "PARTITION BY entity ORDER BY day, race, post"


def r6(c, name: str):
    """Rounded to six places for comparison with SQL."""
    return F.round(c, 6).alias(name)
