"""Mutation logs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sequence numbers of one generation of the events log; stands in for the byte limit of a memtable.
GENERATION = 2048


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of one PUT or DELETE for each event, in the order of event_id, with its generation."""
    return log_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def log_of(events: DataFrame) -> DataFrame:
    deleted = F.col("event_type") == "error"
    key = F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit(":"), F.lpad(F.get_json_object("props", "$.k"), 3, "0"))
    return events.select(
        F.col("event_id").alias("seq"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"),
        F.when(deleted, "DELETE").otherwise("PUT").alias("op"),
        key.alias("key"),
        F.when(deleted, "").otherwise(F.concat_ws("|", "event_type", F.col("value").cast("string"))).alias("value"),
        F.lit(None).cast("array<string>").alias("keys"),
        F.lit(None).cast("array<string>").alias("values"),
        F.floor(F.col("event_id") / GENERATION).alias("gen"),
    )


def lineitem_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of one BATCH_PUT for each order; its entries by ship date, part, supplier and price."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    item = F.struct(
        "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice",
        F.concat_ws(":", F.lit("o"), "l_orderkey", "l_linenumber").alias("k"),
        F.concat_ws("|", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long")).alias("v"),
    )
    one = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return one.select(
        F.col("l_orderkey").alias("seq"), F.lit(0).cast("long").alias("ts"), F.lit("BATCH_PUT").alias("op"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"),
        F.transform("items", lambda x: x["k"]).alias("keys"), F.transform("items", lambda x: x["v"]).alias("values"),
    )
