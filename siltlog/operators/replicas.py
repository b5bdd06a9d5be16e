"""Replicas of a log: what a backup holds, how far it is behind, and where it differs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltlog.functions.keys import record_bytes
from siltlog.operators.state import live


def difference(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(side, key, value) of live pairs that only one side has; empty when both hold the same."""
    a, b = live(primary), live(replica)
    return a.exceptAll(b).withColumn("side", F.lit("primary")).unionByName(b.exceptAll(a).withColumn("side", F.lit("replica")))


def status(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """One row: last sequences of both sides, entries pending, and the time from the oldest pending entry to the newest."""
    p = primary.agg(F.max("seq").alias("primary_seq"), F.max("ts").alias("_now"))
    r = replica.agg(F.max("seq").alias("replica_seq"), F.count("*").alias("applied"))
    both = p.join(r, F.lit(True))
    behind = primary.join(F.broadcast(r.select("replica_seq")), F.col("seq") > F.coalesce("replica_seq", F.lit(-1)))
    pending = behind.agg(F.count("*").alias("pending"), F.min("ts").alias("_oldest"))
    out = both.join(pending, F.lit(True))
    return out.select("primary_seq", "replica_seq", "applied", "pending", F.coalesce(F.col("_now") - F.col("_oldest"), F.lit(0)).cast("long").alias("lag_ms"), (F.col("pending") == 0).alias("caught_up"))


def metrics(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """One row from two logs: records and bytes that the replica applied and that are pending, and the time from its last
    record to the primary's."""
    size = record_bytes(*(F.col(c) for c in ("op", "key", "value", "keys", "values")))
    done = replica.agg(F.count("*").alias("applied"), F.coalesce(F.sum(size), F.lit(0)).alias("applied_bytes"), F.max("seq").alias("_seq"), F.max("ts").alias("_then"))
    behind = primary.join(F.broadcast(done.select("_seq")), F.col("seq") > F.coalesce("_seq", F.lit(-1)))
    pending = behind.agg(F.count("*").alias("pending"), F.coalesce(F.sum(size), F.lit(0)).alias("pending_bytes"))
    now = primary.agg(F.max("ts").alias("_now"))
    # three tables of one row each
    both = done.join(pending, F.lit(True)).join(now, F.lit(True))
    return both.select("applied", "applied_bytes", "pending", "pending_bytes", (F.col("_now") - F.col("_then")).alias("backup_lag_ms"))
