"""Streams into logs and from log to log.

Each query has a checkpoint, so a restart goes on where the last one ended; a micro-batch that is repeated writes to
the same folder again, so no record comes twice. Recency is the record's sequence number, never its time: there is
no watermark and nothing is late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.operators.mutations import LOG_SCHEMA
from siltlog.sources.folders import work_dir
from siltlog.sources.tables import log_of
from siltlog.store import Store


def into_log(stream: DataFrame, log_dir: str, checkpoint: str, every: str | None = None):
    """Starts appending a stream of log records to log_dir, all that is there and then no more, or `every` so often.

    One folder for each micro-batch, overwritten if the batch is repeated.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.select(*(c.split()[0] for c in LOG_SCHEMA.split(", "))).write.mode("overwrite").parquet(f"{log_dir}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_log(spark: SparkSession, log_dir: str) -> DataFrame:
    """All records of a log folder, without the numbers of their batches."""
    return spark.read.schema(LOG_SCHEMA).option("basePath", log_dir).parquet(f"{log_dir}/batch=*").select(*(c.split()[0] for c in LOG_SCHEMA.split(", ")))


def log_stream(spark: SparkSession, log_dir: str, files_at_once: int = 1000) -> DataFrame:
    """New records of a log folder as a stream; files_at_once bounds a micro-batch and so paces the source."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", "true").parquet(log_dir)


def replicate(spark: SparkSession, primary_dir: str, replica_dir: str, checkpoint: str, every: str | None = None):
    """Follows the primary's log into the replica's. Records keep their sequence numbers; none is dropped while the
    replica is away, since the checkpoint remembers how far it came."""
    return into_log(log_stream(spark, primary_dir), replica_dir, checkpoint, every)


def catch_up(primary: Store, replica: Store, name: str = "replica") -> int:
    """Applies to a replica what its primary's durable log holds behind the replica's position; the number of records.

    The position is kept in the replica's own log, so nothing is applied twice or left out, whoever is restarted. The
    primary keeps its log as far back as the follower of that name has come. A replica that has nothing yet gets the
    primary's runs too.
    """
    replica.follow(primary.identity())
    records = primary.log_after(replica.source_seq)
    applied = replica.apply_log(records) if records is not None else 0
    primary.follower_came(name, replica.source_seq)
    return applied


def follow(primary: Store, replica: Store, checkpoint: str, name: str = "replica", every: str | None = None):
    """Starts a query that catches up whenever there are new files in the primary's log, or once with all that is there.

    The stream tells that there is more; what is read follows from the replica's position, so the order and the
    repetition of micro-batches don't matter.
    """
    catch_up(primary, replica, name)
    files = primary.spark.readStream.schema(LOG_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{primary.path}/log")
    writer = files.writeStream.foreachBatch(lambda _, __: catch_up(primary, replica, name)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ingested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream of log records into a log of its own, and that log."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    target, checkpoint = (work_dir(spark, name, keep=False) for name in ("ingest", "ingest-state"))
    into_log(log_of(stream).drop("gen"), target, checkpoint).awaitTermination()
    return read_log(spark, target)


def live_counts(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A stateful view: the last record of each key so far, in update mode; state grows with the number of keys."""
    winner = F.max(F.struct("seq", "value", (F.col("op") == "DELETE").alias("deleted"))).alias("w")
    last = stream.groupBy("key").agg(winner).select("key", "w.seq", "w.value", "w.deleted")
    return last.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
