"""Last-writer-wins state over entries, and what is read from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltlog.functions.keys import sort_key


def latest(entries: DataFrame) -> DataFrame:
    """The last entry of each key by (seq, pos), tombstones too; time stamps don't count.

    The maximum of a struct is taken before the shuffle, so that a key with very many versions sends one row for each
    task. A filter on the key passes below it to the scan.
    """
    winner = F.max(F.struct("seq", "pos", "ts", "value", "deleted")).alias("w")
    return entries.groupBy("key").agg(winner).select("key", "w.seq", "w.pos", "w.ts", "w.value", "w.deleted")


def live(entries: DataFrame) -> DataFrame:
    """(key, value) of keys whose last entry isn't a tombstone; tombstones go only after the last writer has won."""
    return latest(entries).where(~F.col("deleted")).select("key", "value")


def tombstones(entries: DataFrame) -> DataFrame:
    return latest(entries).where("deleted").select("key", "seq")


def get(entries: DataFrame, key: str) -> str | None:
    """The value of one key, None for an absent or deleted one. The filter reaches the scan."""
    row = live(entries.where(F.col("key") == key)).first()
    return row["value"] if row else None


def multi_get(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, status, value) for each probe (key): 200 with the value, 404 for absent and deleted keys."""
    found = probes.join(live(entries), "key", "left")
    return found.select("key", F.when(F.col("value").isNotNull(), 200).otherwise(404).alias("status"), "value")


def in_range(entries: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Entries of keys from start to end, both included, in UTF-16 order; None leaves a side open.

    Over tables with a stored sort_key the bounds are binary literals that Parquet statistics prune by. Otherwise plain
    comparisons go along where they mean the same: for bounds of characters below the surrogates any key that they
    exclude starts differently in either order.
    """
    stored = "sort_key" in entries.columns
    place = F.col("sort_key") if stored else sort_key(F.col("key"))
    for bound, keep, plain in ((start, place.__ge__, F.col("key").__ge__), (end, place.__le__, F.col("key").__le__)):
        if bound is not None:
            entries = entries.where(keep(F.lit(bytearray(bound.encode("utf-16-be", "surrogatepass")))))
            if not stored and all(ord(c) < 0xD800 for c in bound):
                entries = entries.where(plain(bound))
    return entries


def range_scan(entries: DataFrame, start: str | None, end: str | None, limit: int | None = None, after: str | None = None) -> DataFrame:
    """Live (key, value) pairs from start to end in ascending key order, the first `limit` of them, behind `after` only.

    The range is applied below the last writer, the limit above the tombstones. Start behind end gives nothing. For
    the next page `after` is the last key of the page before.
    """
    entries = in_range(entries, start, end)
    if after is not None:
        entries = in_range(entries, after).where(F.col("key") != after)
    found = live(entries).orderBy(sort_key(F.col("key")))
    return found if limit is None else found.limit(limit)
