"""Op logs: the one input of the engine, and those that the test tables stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADERS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
OPS = T.StructType(
    [
        T.StructField("op_id", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("world", T.StringType()),
        T.StructField("verb", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("headers", HEADERS),
    ]
)


def assert_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df, if it has the columns of schema with their types."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = {f.name for f in schema if have.get(f.name) != f.dataType.simpleString()}
    if wrong:
        raise ValueError(f"missing or of another type: {sorted(wrong)}")
    return df


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A stored op log."""
    return assert_schema(spark.read.schema(OPS).parquet(path), OPS)


def utc_ms(ts: Column) -> Column:
    """A timestamp without zone as text to the millisecond."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _headers(value: Column) -> Column:
    return F.array(F.struct(F.lit("x-kind").alias("name"), value.alias("value")))


def events_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """home/u/<user_id>: sign-ups and purchases replace, views and clicks append, errors delete."""
    return events_ops_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def events_ops_of(e: DataFrame) -> DataFrame:
    """The ops of an events table or of a stream of its rows."""
    kind = F.col("event_type")
    verb = F.when(kind.isin("signup", "purchase"), "replace").when(kind.isin("view", "click"), "append").otherwise("delete")
    return e.select(
        F.col("event_id").alias("op_id"),
        utc_ms(F.col("ts")).alias("timestamp"),
        F.concat(F.lit("home/u/"), F.col("user_id").cast("string")).alias("world"),
        verb.alias("verb"),
        F.coalesce("props", F.lit("")).alias("body"),
        F.lit("application/json").alias("content_type"),
        _headers(kind).alias("headers"),
    )


def documents_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lib/src/<source>: each document replaces the one before."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        F.col("doc_id").alias("op_id"),
        F.lit("2024-01-01T00:00:00.000Z").alias("timestamp"),
        F.concat(F.lit("lib/src/"), F.col("source")).alias("world"),
        F.lit("replace").alias("verb"),
        F.coalesce("text", F.lit("")).alias("body"),
        F.lit("text/plain").alias("content_type"),
        _headers(F.coalesce("lang", F.lit("und"))).alias("headers"),
    )


def conversations_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tmp/chat/<conv_id>: turn 0 replaces, later turns append; these worlds live in memory."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("op_id"),
        F.lit("2024-01-01T00:00:00.000Z").alias("timestamp"),
        F.concat(F.lit("tmp/chat/"), F.col("conv_id").cast("string")).alias("world"),
        F.when(F.col("turn") == 0, "replace").otherwise("append").alias("verb"),
        F.coalesce("text", F.lit("")).alias("body"),
        F.lit("text/plain").alias("content_type"),
        _headers(F.lit("chat")).alias("headers"),
    )


def orders_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """var/orders/<o_custkey>: each order replaces the customer's last."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.col("o_orderkey").alias("op_id"),
        utc_ms(F.col("o_orderdate")).alias("timestamp"),
        F.concat(F.lit("var/orders/"), F.col("o_custkey").cast("string")).alias("world"),
        F.lit("replace").alias("verb"),
        F.concat_ws("|", F.col("o_orderstatus"), F.col("o_orderpriority")).alias("body"),
        F.lit("text/plain").alias("content_type"),
        _headers(F.coalesce("o_orderstatus", F.lit(""))).alias("headers"),
    )
