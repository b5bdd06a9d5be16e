"""The mutation log: its schema, its entries one by one, and what makes a request valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_SCHEMA = "seq long, ts long, op string, key string, value string, keys array<string>, values array<string>"
ENTRY_SCHEMA = "seq long, pos int, ts long, key string, value string, deleted boolean"
OPERATIONS = ("PUT", "DELETE", "BATCH_PUT")


def entries(log: DataFrame) -> DataFrame:
    """(seq, pos, ts, key, value, deleted): one row for each key that a record writes, later rows of a batch later.

    Records with an empty or null key write nothing; an empty value is a value. Batches are expanded where they lie,
    without a shuffle.
    """
    single = log.where(F.col("op").isin("PUT", "DELETE")).select("seq", F.lit(0).alias("pos"), "ts", "key", F.when(F.col("op") == "PUT", F.col("value")).otherwise(F.lit("")).alias("value"), (F.col("op") == "DELETE").alias("deleted"))
    batch = log.where(F.col("op") == "BATCH_PUT").select("seq", "ts", F.posexplode(F.arrays_zip(F.col("keys").alias("k"), F.col("values").alias("v"))).alias("pos", "pair"))
    batch = batch.select("seq", "pos", "ts", F.col("pair.k").alias("key"), F.col("pair.v").alias("value"), F.lit(False).alias("deleted"))
    return single.unionByName(batch).where(F.length("key") > 0)


def put_fault(key: Column, value: Column) -> Column:
    """Why a put is refused, null if it isn't: the key must be a text of one character at least, the value not null."""
    return F.when(key.isNull() | (key == ""), F.lit("invalid key")).when(value.isNull(), F.lit("invalid value"))


def validated_puts(requests: DataFrame) -> DataFrame:
    """requests (key, value) with status 200 or 400 and the reason."""
    fault = put_fault(F.col("key"), F.col("value"))
    return requests.withColumn("status", F.when(fault.isNull(), 200).otherwise(400)).withColumn("reason", fault)


def validated_batches(requests: DataFrame) -> DataFrame:
    """requests (keys, values) with status, bad_index (the first entry at fault, else -1) and accepted.

    A batch is taken whole or not at all. It is refused if it is empty, if its arrays differ in length, or for its
    first invalid entry. accepted counts all entries of a batch that is taken, repeated keys too.
    """
    pairs = F.arrays_zip(F.col("keys").alias("k"), F.col("values").alias("v"))
    faults = F.transform(pairs, lambda p: put_fault(p["k"], p["v"]).isNotNull())
    first = F.array_position(faults, True) - 1
    sound = (F.size("keys") > 0) & (F.size("keys") == F.size("values"))
    out = requests.withColumn("bad_index", F.when(sound, first).otherwise(-1).cast("long"))
    ok = sound & (F.col("bad_index") < 0)
    return out.withColumn("status", F.when(ok, 200).otherwise(400)).withColumn("accepted", F.when(ok, F.size("keys")).otherwise(0).cast("long"))
