"""What the operators share: the folder for written tables, and reading the tables."""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset a local session (as in tests) gets a folder of its own; on a cluster that is an error,
    since a folder of the driver's machine would not be seen by the executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="siltlog-", dir=_made("/tmp/checkpoints"))
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _made(path: str) -> str:
    os.makedirs(path, exist_ok=True)
    return path


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The rows of df, written as Parquet in the shared folder, in parts by the columns `by`, and read back: lineage ends there.

    The table survives lost executors and goes when the session's file systems close.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    system, target = _at(spark, path)
    system.deleteOnExit(target)
    back = spark.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Removes tables, as `written` gave them, that nothing reads any more."""
    for df in tables:
        system, target = _at(df.sparkSession, df._written)
        system.delete(target, True)


def swept(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done: it does so when the driver's JVM collects garbage, which
    may be long after they were needed last."""
    spark.sparkContext._jvm.System.gc()


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """`name`, or the first of name_2, name_3 and so on that is no column yet; columns are told apart as Spark does, without case."""
    taken = {c.lower() for c in columns}
    return next(n for k in itertools.count(1) if (n := name if k == 1 else f"{name}_{k}").lower() not in taken)


def salted(keys: list[str], salts: int):
    """A salt from the row's own columns, the same whenever the row is computed again."""
    return F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int")


def held_out(doc_id, parts: int, rest: int):
    """Whether crc32 of the id as text leaves that remainder; rows without an id are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % parts == rest, F.lit(False))


#: Characters of all texts that a model is fitted on at most: what the driver holds.
TRAIN_CHARS = 64_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, parts: int, rest: int, rows: int, chars: int = TRAIN_CHARS) -> list[tuple[str, int]]:
    """(text, label) of at most `rows` labels that are not held out, the same ones whenever it is asked.

    Where their texts have more than `chars` characters in all, the longest of them are left out.

    Labels are chosen by the hash of their doc_id, so that no more than `rows` narrow rows are broadcast to the scan of
    the texts. Null labels and ids take no part; of several labels of a document the largest holds, of several texts the
    least; null texts are empty.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), parts, rest))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # one row for each chosen id, however often an id is repeated, before their sizes are summed and any reaches the driver
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    found = written(found.withColumn("size", F.length("text")), "sample")
    sizes = found.select("size", F.sum("size").over(Window.orderBy("size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)).alias("sum"), "doc_id")
    last = sizes.where(F.col("sum") <= chars).agg(F.max(F.struct("size", "doc_id")).alias("last")).first()["last"]
    if last is None:
        return []
    kept = found.where((F.col("size") < last["size"]) | (F.col("size") == last["size"]) & (F.col("doc_id") <= last["doc_id"])).select("doc_id", "text", "label").toArrow()
    return [(text, label) for _, text, label in sorted(zip(*(kept.column(name).to_pylist() for name in ("doc_id", "text", "label")), strict=True))]
