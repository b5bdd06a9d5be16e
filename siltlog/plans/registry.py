"""Queries over the driver's tables, by name, and the SQL that states their results."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.functions import bloom
from siltlog.functions.keys import entry_encoded, memory_bytes, record_bytes
from siltlog.operators import mutations, replicas, runs, state
from siltlog.plans.sql import SQL
from siltlog.sources import binary, http, tcp
from siltlog.sources.folders import work_dir, written
from siltlog.sources.tables import events_log, lineitem_batches
from siltlog.store import Store, StoreConfig
from siltlog.streaming import ingest

RANGE = ("user:000010", "user:000099:099")
FLUSH_BYTES = 100 * 1024


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the events log, with the generation of their record."""
    log = events_log(spark, d)
    return log.select("seq", F.lit(0).alias("pos"), "ts", "key", "value", (F.col("op") == "DELETE").alias("deleted"), "gen")


def _last_gen(entries: DataFrame) -> DataFrame:
    return F.broadcast(entries.agg(F.max("gen").alias("_last")))  # one row


def _flushed(entries: DataFrame) -> DataFrame:
    """All generations but the last, which is still in memory."""
    return entries.join(_last_gen(entries), F.col("gen") < F.col("_last")).drop("_last")


def _tail(entries: DataFrame) -> DataFrame:
    return entries.join(_last_gen(entries), F.col("gen") == F.col("_last")).drop("_last")


def put_overwrite(spark: SparkSession, d: str) -> DataFrame:
    winner = F.max(F.struct("seq", "pos", "value", "deleted"))
    found = _entries(spark, d).groupBy("key").agg(F.count("*").alias("versions"), winner.alias("w"))
    return found.select("key", "versions", "w.seq", F.when(F.col("w.deleted"), "DELETE").otherwise("PUT").alias("op"), "w.value")


def live_state(spark: SparkSession, d: str) -> DataFrame:
    return state.live(_entries(spark, d))


def tombstones(spark: SparkSession, d: str) -> DataFrame:
    return state.tombstones(_entries(spark, d))


def _probes(spark: SparkSession, d: str) -> DataFrame:
    """One key for each customer, some of which are in the log."""
    customers = spark.read.parquet(f"{d}/customer.parquet")
    key = F.concat(F.lit("user:"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit(":"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"))
    return customers.select(key.alias("key")).distinct()


def multi_get(spark: SparkSession, d: str) -> DataFrame:
    return state.multi_get(_entries(spark, d), _probes(spark, d))


def batch_put(spark: SparkSession, d: str) -> DataFrame:
    return state.live(mutations.entries(lineitem_batches(spark, d)))


def range_scan(spark: SparkSession, d: str) -> DataFrame:
    return state.range_scan(_entries(spark, d), *RANGE)


def range_limit(spark: SparkSession, d: str) -> DataFrame:
    return state.range_scan(_entries(spark, d), *RANGE, limit=25)


def range_inverted(spark: SparkSession, d: str) -> DataFrame:
    return state.range_scan(_entries(spark, d), "user:000099", "user:000010")


def range_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of the range: 25 keys behind the last one of the first."""
    entries = _entries(spark, d)
    first = state.range_scan(entries, *RANGE, limit=25).agg(F.max("key").alias("key")).first()["key"]
    return state.range_scan(entries, *RANGE, limit=25, after=first)


def validate_put(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    key = F.when(F.col("user_id") % 11 == 0, F.lit(None)).when(F.col("user_id") % 7 == 0, F.lit("")).otherwise(F.col("user_id").cast("string"))
    value = F.when(F.col("event_type") != "error", F.col("value").cast("string"))
    return mutations.validated_puts(events.select("event_id", key.alias("key"), value.alias("value"))).select("event_id", "status", "reason")


def validate_batch(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    item = F.struct(
        "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice",
        F.concat_ws(":", F.lit("o"), "l_orderkey", "l_linenumber").alias("k"),
        F.concat_ws("|", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long")).alias("v"),
        (F.col("l_returnflag") == "R").alias("bad"),
    )
    one = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    requests = one.select("l_orderkey", F.transform("items", lambda x: x["k"]).alias("keys"), F.transform("items", lambda x: F.when(~x["bad"], x["v"])).alias("values"))
    return mutations.validated_batches(requests).select("l_orderkey", "status", "bad_index", "accepted")


def wal_bytes(spark: SparkSession, d: str) -> DataFrame:
    log = events_log(spark, d).drop("gen").unionByName(lineitem_batches(spark, d))
    size = record_bytes(*(F.col(c) for c in ("op", "key", "value", "keys", "values")))
    return log.groupBy("op").agg(F.count("*").alias("records"), F.sum(size).alias("bytes"))


def binary_log(spark: SparkSession, d: str) -> DataFrame:
    """Both logs as bytes with checksums, and read from them again."""
    log = events_log(spark, d).drop("gen").unionByName(lineitem_batches(spark, d))
    back = binary.decode_log(binary.encode_log(log))
    return back.select("seq", "op", "key", "value", F.size("keys").cast("long").alias("entries")).withColumn("entries", F.when(F.col("op") == "BATCH_PUT", F.col("entries")).otherwise(0))


def flush_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.flush(_entries(spark, d)).select("gen", "key", "value", "deleted", "seq")


def flush_by_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Runs by the byte limit: an order-dependent fold over the log."""
    return runs.run_meta(runs.flush(runs.generations_by_bytes(_entries(spark, d).drop("gen"), FLUSH_BYTES)))


def run_meta(spark: SparkSession, d: str) -> DataFrame:
    return runs.run_meta(runs.flush(_entries(spark, d)))


def entry_bytes(spark: SparkSession, d: str) -> DataFrame:
    return run_meta(spark, d).select("file_number", "data_bytes", "memory_bytes")


def entry_encoding(spark: SparkSession, d: str) -> DataFrame:
    """The digest of every run entry's bytes."""
    flushed = runs.flush(_entries(spark, d))
    return flushed.select("gen", "key", F.sha2(entry_encoded(*(F.col(c) for c in ("key", "value", "ts", "deleted"))), 256).alias("entry_sha256"))


def sparse_index(spark: SparkSession, d: str) -> DataFrame:
    return runs.sparse_index(runs.flush(_entries(spark, d)))


def sparse_floor(spark: SparkSession, d: str) -> DataFrame:
    return runs.index_floor(sparse_index(spark, d), _probes(spark, d))


def bloom_hashes(spark: SparkSession, d: str) -> DataFrame:
    keys = state.latest(_entries(spark, d)).select("key")
    return keys.select("key", bloom.fnv1a(F.col("key")).alias("fnv1a"), bloom.djb2(F.col("key")).alias("djb2"))


def bloom_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The non-zero bytes of every run's filter."""
    flushed = runs.flush(_entries(spark, d))
    return runs.bloom_bits(flushed, runs.bloom_params(runs.run_meta(flushed)))


def bloom_probe(spark: SparkSession, d: str) -> DataFrame:
    params = bloom_params(spark, d)
    return runs.bloom_probe(bloom_bytes(spark, d), params, _probes(spark, d))


def bloom_params(spark: SparkSession, d: str) -> DataFrame:
    return runs.bloom_params(run_meta(spark, d))


def run_pruning(spark: SparkSession, d: str) -> DataFrame:
    nation = spark.read.parquet(f"{d}/nation.parquet")
    user = lambda x: F.concat(F.lit("user:"), F.lpad(x.cast("string"), 6, "0"))
    ranges = nation.select(F.col("n_nationkey").alias("range_id"), user(F.col("n_nationkey") * 8).alias("start"), user(F.col("n_nationkey") * 8 + F.col("n_regionkey")).alias("end"))
    return runs.overlapping(run_meta(spark, d), ranges)


def merge_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.merge(runs.flush(_entries(spark, d))).select("key", "value")


def compaction(spark: SparkSession, d: str) -> DataFrame:
    return runs.compaction_stats(runs.flush(_entries(spark, d)))


def wal_tail(spark: SparkSession, d: str) -> DataFrame:
    return _tail(_entries(spark, d)).select("seq", F.when(F.col("deleted"), "DELETE").otherwise("PUT").alias("op"), "key", "value")


def wal_replay(spark: SparkSession, d: str) -> DataFrame:
    """Flushed runs and the tail of the log together give the state as it was."""
    entries = _entries(spark, d)
    flushed = runs.flush(_flushed(entries))
    return runs.merge(flushed.unionByName(_tail(entries).select(*flushed.columns))).select("key", "value")


def store_stats(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d)
    memory = state.latest(_tail(entries)).agg(F.count("*").alias("memtable_entries"), F.sum(memory_bytes(F.col("key"), F.col("value"))).alias("memtable_bytes"))
    meta = runs.run_meta(runs.flush(_flushed(entries)))
    held = meta.agg(F.count("*").alias("run_count"), F.sum("entry_count").alias("run_entries"), F.sum("data_bytes").alias("run_bytes"), F.max("max_seq").alias("flushed_seq"))
    return memory.join(held, F.lit(True))


def replica_state(spark: SparkSession, d: str) -> DataFrame:
    """What a replica holds that has applied all generations but the last, with the primary's sequence numbers."""
    return state.latest(_flushed(_entries(spark, d))).where(~F.col("deleted")).select("key", "value", F.col("seq").alias("source_seq"))


def replication_status(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d)
    return replicas.status(entries, _flushed(entries))


def replication_metrics(spark: SparkSession, d: str) -> DataFrame:
    log = events_log(spark, d)
    return replicas.metrics(log, _flushed(log))


def replica_store(spark: SparkSession, d: str) -> DataFrame:
    """The events' puts written to a store in two parts, a replica that caught up after each, and what the replica holds.

    The keys of the first three generations go in as one DataFrame, the rest behind a flush of the primary.
    """
    entries = _entries(spark, d)
    parts = [state.live(entries.where(p)) for p in ("gen < 3", "gen >= 3")]
    path = work_dir(spark, "replicated", keep=False)
    with Store(spark, f"{path}/primary", StoreConfig(compact=False)) as primary, Store(spark, f"{path}/replica", StoreConfig(read_only=True, compact=False)) as replica:
        for part in parts:
            primary.write(part)
            ingest.catch_up(primary, replica)
            primary.flush()
        return written(replica.live(), "replica")


def _in_three(log: DataFrame) -> DataFrame:
    last = F.broadcast(log.agg(F.max("gen").alias("_last")))  # one row
    return log.join(last, F.lit(True)).withColumn("part", F.floor(F.col("gen") * 3 / (F.col("_last") + 1))).drop("_last")


def _applied(spark: SparkSession, d: str, path: str, each) -> None:
    """A store that takes the events' log in three parts, opened anew for each; `each` is called with it and the part's number."""
    log = _in_three(events_log(spark, d))
    for part in range(3):
        with Store(spark, path, StoreConfig(read_only=True, compact=False)) as store:
            store.apply_log(log.where(F.col("part") == part))
            each(store, part)


def store_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """What a store holds that was flushed, flushed and merged, and then recovered from its runs and its log."""
    path = work_dir(spark, "lifecycle", keep=False)
    _applied(spark, d, path, lambda store, part: (store.flush(), store.compact()) if part < 2 else None)
    with Store(spark, path) as store:
        return written(store.live(), "lifecycle")


def store_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The runs that a store's last snapshot names, one for each part of the log."""
    path = work_dir(spark, "manifest", keep=False)
    _applied(spark, d, path, lambda store, _: store.flush())
    with Store(spark, path) as store:
        text = lambda x: bytes.fromhex(x).decode("utf-16-be")
        rows = [(r["number"], r["entries"], text(r["low"]), text(r["high"]), r["bytes"], store.seq) for r in store.snapshot["runs"]]
    return spark.createDataFrame(rows, "file_number long, entry_count long, first_key string, last_key string, data_bytes long, seq long")


def store_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Probes of a store that has two runs and a log behind them."""
    path = work_dir(spark, "lookup", keep=False)
    _applied(spark, d, path, lambda store, part: store.flush() if part < 2 else None)
    with Store(spark, path) as store:
        return written(store.multi_get(_probes(spark, d)), "lookup")


def _nations(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    """A catalogue of a few rows."""
    nation = spark.read.parquet(f"{d}/nation.parquet").collect()
    return [(f"nation:{r['n_nationkey']:02d}", f"{r['n_name']}|{r['n_regionkey']}") for r in nation]


def tcp_put(spark: SparkSession, d: str) -> DataFrame:
    """The nations put over TCP by several clients at a time."""
    pairs = _nations(spark, d)
    with Store(spark, work_dir(spark, "tcp", keep=False)) as store:
        server = tcp.serve(store)
        threading.Thread(target=server.serve_forever, daemon=True).start()

        def send(part: list[tuple[str, str]]) -> None:
            client = tcp.Client(*server.server_address, timeout=None)
            client.stream_put(part)
            client.end()

        with ThreadPoolExecutor(8) as pool:
            list(pool.map(send, (pairs[i::8] for i in range(8))))
        server.shutdown()
        server.server_close()
        return written(store.live(), "tcp")


def http_requests(spark: SparkSession, d: str) -> DataFrame:
    """The answers to a GET for each nation, put in one batch, after those of the first region were deleted and the others of the second put again."""
    pairs = _nations(spark, d)
    with Store(spark, work_dir(spark, "http", keep=False)) as store, ThreadPoolExecutor(8) as pool:
        ask = lambda x: http.answer(store, x[0], x[1], json.dumps(x[2]).encode() if len(x) > 2 else b"")
        ask(("POST", "/batch-put", {"entries": [{"key": k, "value": v} for k, v in pairs]}))
        list(pool.map(ask, [("DELETE", f"/delete/{k}") for k, v in pairs if v.endswith("|0")] + [("POST", "/put", {"key": k, "value": "again"}) for k, v in pairs if v.endswith("|1")]))
        rows = [(k, status, body.get("value")) for (k, _), (status, body) in zip(pairs, pool.map(ask, [("GET", f"/get/{quote(k, safe='')}") for k, _ in pairs]), strict=True)]
    return spark.createDataFrame(rows, "key string, status int, value string")


def replica_diff(spark: SparkSession, d: str) -> DataFrame:
    entries = _entries(spark, d)
    return replicas.difference(entries, _flushed(entries)).select("side", "key", "value")


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The events ingested by a stream into a log, and the state of that log."""
    return state.live(mutations.entries(ingest.ingested_events(spark, d)))


_QUERIES = (
    put_overwrite, live_state, tombstones, multi_get, batch_put, range_scan, range_limit, range_inverted, range_page, validate_put, validate_batch, wal_bytes, binary_log, entry_bytes, entry_encoding,
    flush_runs, flush_by_bytes, run_meta, sparse_index, sparse_floor, bloom_params, bloom_hashes, bloom_bytes, bloom_probe, run_pruning, merge_runs, compaction, wal_tail, wal_replay, store_stats, replica_state,
    replication_status, replication_metrics, replica_diff, replica_store, stream_ingest,
    store_lifecycle, store_manifest, store_lookup, tcp_put, http_requests,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in SQL.items() if sql}
