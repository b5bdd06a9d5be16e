"""Sorted immutable runs: flushing, their statistics, sparse offsets, pruning, merging and compaction."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from siltlog.functions import bloom
from siltlog.functions.keys import MEMORY_HEAD, entry_bytes, memory_bytes, sort_key
from siltlog.operators.state import latest
from siltlog.sources.folders import written

#: A Bloom filter of up to so many bits and hash functions is held whole by a task.
WHOLE_BITS, WHOLE_HASHES = 1 << 20, 16
#: Probes of a cell, runs of a group and bits of their filters in all, as a task meets them.
CELL_PROBES, GROUP_RUNS, GROUP_BITS = 1 << 14, 512, 1 << 25
#: Pairs of probe and run, and keys, of a cell of a floor lookup, about.
CELL_PAIRS, CELL_ROWS = 1 << 23, 1 << 16


def flush(entries: DataFrame, generation: str = "gen") -> DataFrame:
    """The last entry of each key within each generation, tombstones kept: what each run holds."""
    winner = F.max(F.struct("seq", "pos", "ts", "value", "deleted")).alias("w")
    return entries.groupBy(generation, "key").agg(winner).select(generation, "key", "w.seq", "w.pos", "w.ts", "w.value", "w.deleted")


def generations_by_bytes(entries: DataFrame, limit: int) -> DataFrame:
    """entries with `gen`, where a generation ends once its live bytes come to `limit`.

    The bytes of a generation shrink and grow as its keys are overwritten, and a new one starts from nothing, so the
    border is a fold over the log in its order. It runs over one sorted stream and holds the keys of one generation.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes: dict[str, int] = {}
        total, gen = 0, 0
        for batch in batches:
            out = []
            for key, value in zip(batch["key"], batch["value"], strict=True):
                size = len(key.encode()) + len(value.encode()) + MEMORY_HEAD
                total += size - sizes.get(key, 0)
                sizes[key] = size
                out.append(gen)
                if total >= limit:
                    sizes, total, gen = {}, 0, gen + 1
            yield batch.assign(gen=out)

    from pyspark.sql.types import LongType, StructType

    ordered = entries.repartition(1).sortWithinPartitions("seq", "pos")
    return ordered.mapInPandas(fold, StructType(list(entries.schema.fields)).add("gen", LongType()))


def run_meta(runs: DataFrame, generation: str = "gen") -> DataFrame:
    """One row for each run: its number, entries, first and last key in UTF-16 order, tombstones and bytes."""
    place = F.struct(sort_key(F.col("key")).alias("s"), "key")
    return runs.groupBy(generation).agg(
        F.count("*").alias("entry_count"),
        F.min(place)["key"].alias("first_key"),
        F.max(place)["key"].alias("last_key"),
        F.sum(F.col("deleted").cast("long")).alias("tombstones"),
        F.sum(entry_bytes(F.col("key"), F.col("value"))).alias("data_bytes"),
        F.sum(memory_bytes(F.col("key"), F.col("value"))).alias("memory_bytes"),
        F.max("seq").alias("max_seq"),
    ).select((F.col(generation) + 1).cast("long").alias("file_number"), "entry_count", "first_key", "last_key", "tombstones", "data_bytes", "memory_bytes", "max_seq")


def sparse_index(runs: DataFrame, interval: int = 10, generation: str = "gen") -> DataFrame:
    """Of every run's sorted entries the first and each `interval`-th after it, with the byte offset where it starts.

    A run is cut into ranges of its keys, however large it is: entries are numbered within a range, and what lies
    before a range is a sum over narrow rows, one for each range.
    """
    size = entry_bytes(F.col("key"), F.col("value"))
    dealt = runs.select(F.col(generation).alias("run"), "key", sort_key(F.col("key")).alias("place"), size.alias("bytes")).repartitionByRange("run", "place")
    dealt = written(dealt.withColumn("range", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy("run", "range").agg(F.count("*").alias("_entries"), F.sum("bytes").alias("_bytes"))
    earlier = Window.partitionBy("run").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("run", "range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_entries", "_bytes")))
    along = Window.partitionBy("run", "range").orderBy("place")
    numbered = dealt.withColumns({"entry": F.row_number().over(along) - 1, "offset": F.sum("bytes").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")})
    # Spark broadcasts the ranges if they are below its own limit
    found = numbered.join(before, ["run", "range"]).select(
        (F.col("run") + 1).cast("long").alias("file_number"),
        "key",
        (F.col("entry") + F.col("_entries")).cast("long").alias("entry"),
        (F.col("offset") + F.col("_bytes")).cast("long").alias("offset"),
    )
    return found.where(F.col("entry") % interval == 0)


def index_floor(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, file_number, floor_key, offset): for each probe (key) and run the last indexed key up to it, and where a read begins.

    Before a run's first key that is its beginning, with no floor key. Probes and the index entries of all runs are cut
    into cells of their keys, where probes are numbered: an entry is the floor of the probes from its own number to that
    of its run's next entry. What a run begins a cell with is its last entry of the cells before. So probes meet runs
    only as the result's rows are made, of which nothing is shuffled or written.
    """
    asked = probes.select("key").distinct().select(F.lit(None).cast("long").alias("file_number"), "key", F.lit(None).cast("long").alias("offset"))
    both = written(index.select("file_number", "key", "offset").unionByName(asked).withColumn("place", sort_key(F.col("key"))), "index")
    files = both.where("file_number IS NOT NULL").select("file_number").distinct()  # a catalogue
    rows, count = both.count(), files.count()
    cells = max(1, -(-rows * count // CELL_PAIRS), -(-rows // CELL_ROWS))

    along = Window.partitionBy("cell").orderBy("place", F.col("file_number").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    dealt = both.repartitionByRange(cells, "place").withColumn("cell", F.spark_partition_id())
    dealt = written(dealt.withColumn("number", F.count_if(F.col("file_number").isNull()).over(along).cast("int")), "cells")
    keys = dealt.where("file_number IS NULL").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("number", "key")))["key"].alias("keys"))
    own = dealt.where("file_number IS NOT NULL").select("file_number", "cell", "place", "number", F.col("key").alias("floor_key"), "offset")

    earlier = Window.partitionBy("file_number").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ends = own.groupBy("file_number", "cell").agg(F.max(F.struct("place", "floor_key", "offset")).alias("_end"))
    every = files.select("file_number", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    begins = every.join(ends, ["file_number", "cell"], "left").withColumn("_before", F.max("_end").over(earlier))
    begins = begins.select("file_number", "cell", F.lit(None).cast("binary").alias("place"), F.lit(0).alias("number"), "_before.floor_key", "_before.offset")
    steps = own.unionByName(begins).withColumn("next", F.lead("number").over(Window.partitionBy("file_number", "cell").orderBy("place")))
    steps = steps.where("next IS NULL OR next > number").drop("place").repartition(cells, "cell")
    probed = F.slice("keys", F.col("number") + 1, F.coalesce("next", F.size("keys")) - F.col("number"))
    met = steps.join(keys.repartition(cells, "cell").hint("merge"), "cell")
    return met.select(F.explode(probed).alias("key"), "file_number", "floor_key", F.coalesce("offset", F.lit(0)).alias("offset"))


def bloom_params(meta: DataFrame, rate: float = 0.01) -> DataFrame:
    """Bits and hash functions of each run's Bloom filter."""
    sized = meta.select("file_number", "entry_count", bloom.bits(F.col("entry_count"), rate).alias("num_bits"))
    return sized.withColumn("num_hashes", bloom.hashes(F.col("entry_count"), F.col("num_bits")).cast("long"))


def bloom_bits(runs: DataFrame, params: DataFrame, generation: str = "gen") -> DataFrame:
    """(file_number, num_bits, num_hashes, byte, value): the bytes of each run's Bloom filter that aren't 0, bits from the lowest on.

    Bits meet byte by byte, so a filter of any size is made without one task holding it. Keys of a run of common size are
    brought together first, where most of its bytes are then made; those of a large run are dealt by their hash.
    """
    keyed = runs.select((F.col(generation) + 1).cast("long").alias("file_number"), bloom.fnv1a(F.col("key")).alias("a"), bloom.djb2(F.col("key")).alias("b"))
    bits = keyed.join(params.select("file_number", "num_bits", "num_hashes"), "file_number")
    bits = bits.repartition("file_number", F.col("a") % (F.floor(F.col("num_bits") / WHOLE_BITS) + 1))
    bits = bits.select("file_number", "num_bits", "num_hashes", F.explode(bloom._positions(F.col("a"), F.col("b"), F.col("num_bits"), F.col("num_hashes"))).alias("bit"))
    value = F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("bit") % 8).cast("int")))
    return bits.groupBy("file_number", "num_bits", "num_hashes", F.floor(F.col("bit") / 8).alias("byte")).agg(value.alias("value"))


def bloom_probe(filters: DataFrame, params: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, file_number, might_contain) for each probe (key) and run, from the filters' bytes.

    A key is hashed once, whatever the number of runs. Filters of common size are held whole as words, and a cell of
    probes meets a group of runs, so a pair moves nothing. A filter that no task should hold, as of a large run, is asked
    position by position, byte by byte.
    """
    hashed = probes.select("key").where(F.col("key").isNotNull()).distinct().select("key", bloom.fnv1a(F.col("key")).alias("a"), bloom.djb2(F.col("key")).alias("b"))
    hashed = written(hashed, "probes")
    params = written(params.select("file_number", "num_bits", "num_hashes"), "params")
    filters = written(filters.select("file_number", "byte", "value"), "filters")
    whole = (F.col("num_bits") <= WHOLE_BITS) & (F.col("num_hashes") <= WHOLE_HASHES)
    held = params.where(whole)
    size = params.agg(F.count_if(~whole).alias("large"), F.count_if(whole).alias("runs"), F.sum(F.when(whole, F.col("num_bits"))).alias("bits"), F.max(F.when(whole, F.col("num_hashes"))).alias("hashes")).first()
    found = []
    if size["runs"]:
        found.append(_probe_whole(filters, held, hashed, size))
    if size["large"] or not found:
        found.append(_probe_bytes(filters, params.where(~whole), hashed))
    return reduce(DataFrame.unionByName, found)


def _probe_whole(filters: DataFrame, params: DataFrame, hashed: DataFrame, size: Row) -> DataFrame:
    cells = -(-hashed.count() // CELL_PROBES) or 1
    groups = max(-(-size["runs"] // GROUP_RUNS), -(-size["bits"] // GROUP_BITS))
    words = filters.join(params, "file_number", "left_semi").select(
        "file_number",
        F.floor(F.col("byte") / 8).alias("word"),
        F.call_function("shiftleft", F.col("value").cast("long"), (F.col("byte") % 8 * 8).cast("int")).alias("bits"),
    )
    blank = params.select("file_number", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("num_bits") - 1) / 64))).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = words.unionByName(blank).groupBy("file_number", "word").agg(F.bit_or("bits").alias("bits"))
    made = words.groupBy("file_number").agg(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("bits")).join(params, "file_number")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    made = made.withColumns({"group": F.pmod("file_number", F.lit(groups)).cast("int"), "cell": every(cells)}).repartition(cells * groups, "cell", "group")
    asked = hashed.withColumns({"cell": F.pmod(F.xxhash64("key"), F.lit(cells)).cast("int"), "group": every(groups)}).repartition(cells * groups, "cell", "group")

    def is_set(i: int) -> Column:
        at = (F.col("a") + F.col("b") * i).bitwiseAND(F.lit(0xFFFFFFFF)) % F.col("num_bits")
        word = F.get("bits", F.shiftright(at, 6).cast("int"))
        return (F.col("num_hashes") <= i) | (F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)

    might = reduce(Column.__and__, (is_set(i) for i in range(size["hashes"])))
    return made.join(asked.hint("merge"), ["cell", "group"]).select("key", "file_number", might.alias("might_contain"))


def _probe_bytes(filters: DataFrame, params: DataFrame, hashed: DataFrame) -> DataFrame:
    asked = hashed.join(F.broadcast(params))
    asked = asked.select("key", "file_number", F.explode(bloom._positions(F.col("a"), F.col("b"), F.col("num_bits"), F.col("num_hashes"))).alias("bit"))
    asked = asked.withColumns({"byte": F.floor(F.col("bit") / 8), "mask": F.call_function("shiftleft", F.lit(1), (F.col("bit") % 8).cast("int"))})
    met = asked.join(filters, ["file_number", "byte"], "left")
    return met.groupBy("key", "file_number").agg(F.bool_and(F.coalesce(F.col("value").bitwiseAND(F.col("mask")) > 0, F.lit(False))).alias("might_contain"))


def overlapping(meta: DataFrame, ranges: DataFrame) -> DataFrame:
    """(range_id, file_number) of runs whose keys may lie in a range (start, end); the others are never opened.

    Both sides are catalogues, some rows for each run and for each request.
    """
    m = meta.select("file_number", sort_key(F.col("first_key")).alias("_low"), sort_key(F.col("last_key")).alias("_high"))
    r = ranges.select("range_id", sort_key(F.col("start")).alias("_start"), sort_key(F.col("end")).alias("_end"))
    return r.join(m, (F.col("_low") <= F.col("_end")) & (F.col("_high") >= F.col("_start")) & (F.col("_start") <= F.col("_end"))).select("range_id", "file_number")


def merge(runs: DataFrame, keep_tombstones: bool = False) -> DataFrame:
    """One row for each key over all runs, the newest by sequence; tombstones hide older values and then go."""
    merged = latest(runs)
    return merged if keep_tombstones else merged.where(~F.col("deleted"))


def compaction_stats(runs: DataFrame) -> DataFrame:
    """runs_in, entries_read, entries_written and entries_removed of merging all runs into one without tombstones."""
    read = runs.agg(F.countDistinct("gen").alias("runs_in"), F.count("*").alias("entries_read"))
    wrote = merge(runs).agg(F.count("*").alias("entries_written"))
    # two tables of one row each
    return read.join(wrote, F.lit(True)).withColumn("entries_removed", F.col("entries_read") - F.col("entries_written"))
