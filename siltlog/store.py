"""A store of one keyspace over Spark: put, read, delete, key-range read and batch put.

Everything lies in one folder. Records go to `log` in batches that are written whole; `runs` holds sorted runs; a
snapshot names the runs that count and the last sequence number in them. A snapshot is a small file with the next
number, written last, so what a half-done flush or compaction left behind is never read. Recency is the sequence
number of a record and its place in a batch, kept in the runs too.

Threads may share a store. Writes are logged one after another and committed in groups; flushes and compactions run in
the background, one at a time, and writes go on meanwhile. Log folders and runs that a new snapshot made needless are
deleted by the maintenance after the next, so a read that began before still finds them.

A job for each key is slow: write with batch_put or `write`, read with multi_get or read_key_range.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.functions.keys import LONGEST_KEY, MEMORY_HEAD, js_text, record_bytes, sort_key
from siltlog.operators import mutations, runs, state
from siltlog.sources.binary import encode
from siltlog.sources.folders import Folder

RUN_SCHEMA = "key string, sort_key binary, seq long, pos int, ts long, value string, deleted boolean"
#: A record of a replica's log also tells the sequence number that it had at the primary.
LOG_SCHEMA = f"{mutations.LOG_SCHEMA}, source_seq long"
_RECORD = [c.split()[0] for c in LOG_SCHEMA.split(", ")]


@dataclass(frozen=True)
class StoreConfig:
    """sync: "always" writes each record at once, "group" what has come within group_ms or group_size records, whichever
    is first, "manual" on sync() only. But for "manual" a put returns when its record is durable.
    compaction_seconds: how often a thread looks for runs to merge; 0 leaves that to flushes."""

    memtable_bytes: int = 4 * 1024 * 1024
    sync: str = "group"
    group_size: int = 100
    group_ms: int = 100
    sparse_index_interval: int = 10
    bloom_rate: float = 0.01
    compaction_threshold: int = 4
    compaction_seconds: float = 60.0
    compact: bool = True
    read_only: bool = False

    def __post_init__(self):
        if not 1 <= self.sparse_index_interval <= 1000:
            raise ValueError("sparse_index_interval must be from 1 to 1000")
        if not 0 < self.bloom_rate < 1:
            raise ValueError("bloom_rate must be between 0 and 1")
        if self.sync not in ("always", "group", "manual"):
            raise ValueError("sync must be always, group or manual")


def _number(name: str) -> int:
    return int(name.split("=")[1])


class Store:
    """Open with Store(spark, path); one writer at a time. Use it as a context manager or close() it.

    The first write takes the store's lease; a store that had it before is refused its next write.
    """

    def __init__(self, spark: SparkSession, path: str, config: StoreConfig = StoreConfig(), clock: Callable[[], int] = lambda: int(time.time() * 1000)):
        self.spark, self.path, self.config, self.clock = spark, path.rstrip("/"), config, clock
        folder = lambda name: Folder(spark, f"{self.path}/{name}")
        self._snapshots, self._logs, self._runs, self._leases, self._followers, self._primary = map(folder, ("snapshots", "log", "runs", "leases", "followers", "primary"))
        self._lock = threading.RLock()
        self._maintenance = ThreadPoolExecutor(1, thread_name_prefix="siltlog-maintenance")
        self._flushing: Future | None = None
        self._compacting: Future | None = None
        self._timer: threading.Timer | None = None
        self._lease: str | None = None
        self._needless: set[str] = set()
        self.snapshot = self._load()
        self._pending: list[tuple] = []
        self._futures: list[Future] = []
        self._sizes: dict[str, int] = {}
        self._unflushed = 0
        self._listeners: list[Callable[[Iterable[tuple]], None]] = []
        self.stats = {"compactions": 0, "entries_written": 0, "entries_removed": 0, "last_ms": 0}
        self.applied = {"records": 0, "bytes": 0, "last_ms": None}
        self._open = True
        self.seq, self.source_seq = self.snapshot["max_seq"], self.snapshot.get("source_seq", -1)
        tail = self._tail()
        if tail is not None:
            last = tail.agg(F.max("seq").alias("seq"), F.max("source_seq").alias("source")).first()
            self.seq = max(self.seq, -1 if last["seq"] is None else last["seq"])
            self.source_seq = max(self.source_seq, -1 if last["source"] is None else last["source"])
            size = F.octet_length("key") + F.octet_length("value") + MEMORY_HEAD
            sizes = state.latest(mutations.entries(tail)).select("key", size.alias("size"))
            self._unflushed = sizes.agg(F.sum("size")).first()[0] or 0
            if self._unflushed < config.memtable_bytes:  # else a flush is due at the next write, and sizes begin anew
                self._sizes = {r["key"]: r["size"] for r in sizes.toLocalIterator()}
        self._scheduler: threading.Timer | None = None
        self._look_for_runs()

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # snapshots

    def _load(self) -> dict:
        names = [n for n in self._snapshots.names() if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return {"version": 0, "runs": [], "next_run": 1, "max_seq": -1, "source_seq": -1}
        return json.loads(self._snapshots.read(names[-1]))

    def _commit(self, **changes) -> None:
        """The file first: where it can't be written the store stays at its old snapshot."""
        new = {**self.snapshot, **changes, "version": self.snapshot["version"] + 1}
        self._snapshots.write(f"{new['version']:012d}.json", json.dumps(new))
        self.snapshot = new

    def _log_names(self) -> list[tuple[str, int]]:
        """Folders of the log and the last sequence number that each may hold."""
        names = [n for n in self._logs.names() if n.startswith("first=")]
        return [(n, _number(names[i + 1]) - 1 if i + 1 < len(names) else 1 << 62) for i, n in enumerate(names)]

    def _tail(self) -> DataFrame | None:
        """Records of the log behind the last flush."""
        upto = self.snapshot["max_seq"]
        names = [f"{self.path}/log/{n}" for n, last in self._log_names() if last > upto]
        if not names:
            return None
        return self.spark.read.schema(LOG_SCHEMA).parquet(*names).where(F.col("seq") > upto)

    # writing

    def _check(self) -> None:
        if not self._open:
            raise RuntimeError("the store is closed")

    def _hold_lease(self) -> None:
        """One writer at a time: the holder of the latest lease. Called under the lock."""
        names = [n for n in self._leases.names() if not n.startswith(".")]
        if self._lease is None:
            name = f"{int(names[-1].split('-')[0]) + 1 if names else 1:012d}-{uuid.uuid4().hex}"
            self._leases.write(name, str(self.clock()))
            self._lease = name
            for old in names:
                self._leases.delete(old)
            names = [n for n in self._leases.names() if not n.startswith(".")]
        if not names or names[-1] != self._lease:
            raise RuntimeError("another writer has taken this store over")

    def _append(self, op: str, key=None, value=None, keys=None, values=None) -> Future:
        self._check()
        if self.config.read_only:
            raise PermissionError("a replica takes no writes of its own")
        return self._log(op, key, value, keys, values, None)

    def _log(self, op, key, value, keys, values, source_seq) -> Future:
        with self._lock:
            self._check()
            self.seq += 1
            done: Future = Future()
            self._pending.append((self.seq, self.clock(), op, key, value, keys, values, source_seq))
            self._futures.append(done)
            for k, v in [(key, value or "")] if keys is None else zip(keys, values, strict=True):
                size = len(k.encode()) + len(v.encode()) + MEMORY_HEAD
                self._unflushed += size - self._sizes.get(k, 0)
                self._sizes[k] = size
            if self.config.sync == "always" or self.config.sync == "group" and len(self._pending) >= self.config.group_size:
                self.sync()
            elif self.config.sync == "group" and self._timer is None:
                self._timer = threading.Timer(self.config.group_ms / 1000, self._group_is_due)
                self._timer.daemon = True
                self._timer.start()
            if self._unflushed >= self.config.memtable_bytes:
                self._flush_soon()
            return done

    def _group_is_due(self) -> None:
        try:
            self.sync()
        except Exception:  # noqa: BLE001  the waiting writers were told
            return

    @staticmethod
    def _valid(key, value="") -> tuple[str, str]:
        if not isinstance(key, str) or not key or len(key.encode()) > LONGEST_KEY:
            raise ValueError("a key must be a text of 1 to 65535 bytes")
        if value is None:
            raise ValueError("a value must not be null")
        return key, js_text(value)

    def _durable(self, done: Future) -> None:
        if self.config.sync != "manual":
            done.result()

    def put(self, key: str, value) -> None:
        """Returns when the record is durable, but with sync "manual"."""
        self._durable(self.put_soon(key, value))

    def put_soon(self, key: str, value) -> Future:
        """Returns at once; the result is there when the record is durable, or the error why it isn't."""
        return self._append("PUT", *self._valid(key, value))

    def delete(self, key: str) -> None:
        """Writes a tombstone, whether or not the key is there."""
        self._durable(self._append("DELETE", self._valid(key)[0]))

    def batch_put(self, pairs: Iterable[tuple[str, object]]) -> int:
        """Takes all pairs in one record, or none if one is at fault; the number of pairs, repeated keys too."""
        checked = [self._valid(k, v) for k, v in pairs]
        if checked:
            self._durable(self._append("BATCH_PUT", keys=[k for k, _ in checked], values=[v for _, v in checked]))
        return len(checked)

    def write(self, pairs: DataFrame) -> int:
        """Puts a DataFrame (key, value) of any size: it is numbered and logged by the executors.

        Of repeated keys the one with the greatest value wins, as rows of a DataFrame have no order.
        """
        self._check()
        if self.config.read_only:
            raise PermissionError("a replica takes no writes of its own")
        if not pairs.where(mutations.put_fault(F.col("key"), F.col("value")).isNotNull()).isEmpty():
            raise ValueError("a key or value is null or empty")
        one = pairs.groupBy("key").agg(F.max("value").alias("value"))
        none = F.lit(None).cast("array<string>")
        with self._lock:
            # one sequence number for the job: its keys are different, so no order among them is needed
            rows = one.select(F.lit(self.seq + 1).alias("seq"), F.lit(self.clock()).alias("ts"), F.lit("PUT").alias("op"), "key", "value", none.alias("keys"), none.alias("values"), F.lit(None).cast("long").alias("source_seq"))
            return self._log_rows(rows, self.seq + 1, self.seq + 1)["records"]

    def _log_rows(self, rows: DataFrame, first: int, last: int) -> dict:
        """Logs records with sequence numbers from first to last, written by the executors; their number and bytes."""
        with self._lock:
            self.sync()
            self._hold_lease()
            path = f"{self.path}/log/first={first:020d}"
            # a folder of that name can only be what an append left half done
            rows.select(*_RECORD).write.mode("overwrite").parquet(path)
            self.seq = last
            written = self.spark.read.schema(LOG_SCHEMA).parquet(path)
            one = lambda k, v: F.octet_length(k) + F.octet_length(F.coalesce(v, F.lit(""))) + MEMORY_HEAD
            pairs = F.aggregate(F.arrays_zip(F.col("keys").alias("k"), F.col("values").alias("v")), F.lit(0), lambda n, p: n + one(p["k"], p["v"]))
            live = F.coalesce(one(F.col("key"), F.col("value")), F.lit(0)) + F.coalesce(pairs, F.lit(0))
            size = record_bytes(*(F.col(c) for c in ("op", "key", "value", "keys", "values")))
            added = written.agg(F.count("*").alias("records"), F.sum(size).alias("bytes"), F.sum(live).alias("live")).first()
            self._unflushed += added["live"] or 0
            self._tell(lambda: (tuple(r) for r in written.select(*_RECORD[:7]).orderBy("seq").toLocalIterator()))
            if self._unflushed >= self.config.memtable_bytes:
                self._flush_soon()
            return added.asDict()

    def on_append(self, listener: Callable[[Iterable[tuple]], None]) -> None:
        """Calls listener with the records of each batch after it is written, those of `write` as an iterator over what
        executors hold; its errors don't reach the writer."""
        self._listeners.append(listener)

    def _tell(self, records: Callable[[], Iterable[tuple]]) -> None:
        for listener in self._listeners:
            try:
                listener(records())
            except Exception:  # noqa: BLE001  a follower's fault is not the writer's
                continue

    def sync(self) -> None:
        """Writes pending records to the log, all or none, and tells those who wait for them."""
        with self._lock:
            if self._timer is not None:
                self._timer.cancel()
                self._timer = None
            if not self._pending:
                return
            records, futures = self._pending, self._futures
            try:
                self._hold_lease()
                self.spark.createDataFrame(records, LOG_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/first={records[0][0]:020d}")
            except BaseException as e:
                # the records stay pending, and a later sync may still write them
                self._futures = []
                for f in futures:
                    f.set_exception(e)
                raise
            self._pending, self._futures = [], []
            for f in futures:
                f.set_result(None)
            self._tell(lambda: [r[:7] for r in records])

    # maintenance

    def flush(self) -> None:
        """Writes what is behind the last snapshot as a sorted run, tombstones too, and lets the log begin after it.

        Waits for a flush that is under way, then for its own; merges runs where there are enough.
        """
        self._check()
        running = self._flushing
        if running is not None:
            running.exception()
        self._flush_soon().result()
        if self.config.compact and len(self.snapshot["runs"]) >= self.config.compaction_threshold:
            self.compact()

    def _flush_soon(self) -> Future:
        """The flush that is under way, or a new one: what comes meanwhile is counted anew."""
        with self._lock:
            if self._flushing is None or self._flushing.done():
                self.sync()
                held, self._unflushed, self._sizes = self._unflushed, 0, {}
                self._flushing = self._maintenance.submit(self._flush, self.seq, held)
            return self._flushing

    def _flush(self, upto: int, held: int) -> None:
        try:
            tail = self._tail()
            tail = tail.where(F.col("seq") <= upto) if tail is not None else None
            if tail is None or tail.isEmpty():
                self._vacuum()
                return
            source = tail.agg(F.max("source_seq")).first()[0]
            run = self._write_run(state.latest(mutations.entries(tail)))
            with self._lock:
                source_seq = max(self.snapshot.get("source_seq", -1), -1 if source is None else source)
                self._commit(runs=[*self.snapshot["runs"], *run], max_seq=upto, source_seq=source_seq)
        except BaseException:
            with self._lock:
                self._unflushed += held
            raise
        self._vacuum()

    def _write_run(self, entries: DataFrame) -> list[dict]:
        with self._lock:
            self._hold_lease()
            number = self.snapshot["next_run"]
            self.snapshot = {**self.snapshot, "next_run": number + 1}
        path = f"{self.path}/runs/run={number:05d}"
        entries = entries.withColumn("sort_key", sort_key(F.col("key")))
        count = entries.count()
        if not count:
            return []
        # the filter's size follows from the entries; without it Parquet takes a megabyte for each row group
        sorted_ = entries.select(*(c.split()[0] for c in RUN_SCHEMA.split(", "))).repartitionByRange("sort_key").sortWithinPartitions("sort_key")
        writer = sorted_.write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", count).option("parquet.bloom.filter.fpp#key", self.config.bloom_rate)
        writer.parquet(path)
        ends = self.spark.read.schema(RUN_SCHEMA).parquet(path).agg(F.min("sort_key").alias("low"), F.max("sort_key").alias("high"), F.sum(F.octet_length("key") + F.octet_length("value") + 15).alias("bytes")).first()
        return [{"number": number, "entries": count, "low": bytes(ends["low"]).hex(), "high": bytes(ends["high"]).hex(), "bytes": ends["bytes"], "created": self.clock()}]

    def compact(self) -> dict | None:
        """Merges all runs into one without tombstones and without what was overwritten; None below two runs.

        If nothing is left the snapshot has no runs. One merge runs at a time: a second caller gets the first one's result.
        """
        self._check()
        return self._compact_soon().result()

    def _compact_soon(self) -> Future:
        with self._lock:
            if self._compacting is None or self._compacting.done():
                self._compacting = self._maintenance.submit(self._compact)
            return self._compacting

    def _compact(self) -> dict | None:
        old = self.snapshot["runs"]
        if len(old) < 2:
            return None
        began = time.time()
        kept = self._write_run(runs.merge(self._read_runs(old)))
        with self._lock:
            numbers = {r["number"] for r in old}
            self._commit(runs=[*kept, *(r for r in self.snapshot["runs"] if r["number"] not in numbers)])
        self._vacuum()
        written = sum(r["entries"] for r in kept)
        removed = sum(r["entries"] for r in old) - written
        self.stats = {"compactions": self.stats["compactions"] + 1, "entries_written": self.stats["entries_written"] + written, "entries_removed": self.stats["entries_removed"] + removed, "last_ms": int((time.time() - began) * 1000)}
        return {"runs_in": len(old), "entries_read": written + removed, "entries_written": written, "entries_removed": removed}

    def _look_for_runs(self) -> None:
        """At the start and then every compaction_seconds: merges runs where there are enough."""
        if not (self._open and self.config.compact and self.config.compaction_seconds > 0):
            return
        if len(self.snapshot["runs"]) >= self.config.compaction_threshold:
            self._compact_soon()
        self._scheduler = threading.Timer(self.config.compaction_seconds, self._look_for_runs)
        self._scheduler.daemon = True
        self._scheduler.start()

    def _vacuum(self, all_: bool = False) -> None:
        """Deletes the log folders and runs that no snapshot needs and that were needless a maintenance ago already.

        The log stays as far back as a follower has not come. Runs that a flush or merge left half done go too.
        """
        with self._lock:
            came = [int(n.rsplit("-", 1)[1]) for n in self._last_of_followers().values()]
            upto = min([self.snapshot["max_seq"], *came])
            current = {r["number"] for r in self.snapshot["runs"]}
            needless = {f"log/{n}" for n, last in self._log_names() if last <= upto or last == 1 << 62 and self.seq <= upto}
            needless |= {f"runs/{n}" for n in self._runs.names() if n.startswith("run=") and _number(n) < self.snapshot["next_run"] and _number(n) not in current}
            gone = needless if all_ else needless & self._needless
            for name in gone:
                kind, n = name.split("/")
                (self._logs if kind == "log" else self._runs).delete(n)
            self._needless = needless - gone

    def _read_runs(self, which: list[dict]) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(*(f"{self.path}/runs/run={r['number']:05d}" for r in which))

    # reading

    def _entries(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Entries of the runs that may hold keys from start to end, and of all records not flushed yet."""
        low, high = ("" if x is None else x.encode("utf-16-be", "surrogatepass").hex() for x in (start, end))
        columns = ["seq", "pos", "ts", "key", "value", "deleted"]
        parts = []
        with self._lock:
            chosen = [r for r in self.snapshot["runs"] if (start is None or r["high"] >= low) and (end is None or r["low"] <= high)]
            if chosen:
                parts.append(state.in_range(self._read_runs(chosen), start, end).select(*columns))
            tail = self._tail()
            if tail is not None:
                parts.append(state.in_range(mutations.entries(tail), start, end).select(*columns))
            if self._pending or not parts:
                parts.append(state.in_range(mutations.entries(self.spark.createDataFrame(self._pending, LOG_SCHEMA)), start, end).select(*columns))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def live(self) -> DataFrame:
        self._check()
        return state.live(self._entries())

    def get(self, key: str) -> str | None:
        self._check()
        return state.get(self._entries(key, key), key)

    def multi_get(self, probes: DataFrame) -> DataFrame:
        """(key, status, value) for a DataFrame of keys."""
        self._check()
        return state.multi_get(self._entries(), probes)

    def range(self, start: str | None = None, end: str | None = None, limit: int | None = None, after: str | None = None) -> DataFrame:
        """Live pairs from start to end, both included; None leaves a side open. after: behind that key only, the last one of the page before."""
        self._check()
        return state.range_scan(self._entries(start if after is None else max(start or "", after, key=lambda k: k.encode("utf-16-be", "surrogatepass")), end), start, end, limit, after)

    def read_key_range(self, start: str, end: str, limit: int | None = None) -> Iterator[tuple[str, str]]:
        for row in self.range(start, end, limit).toLocalIterator():
            yield row["key"], row["value"]

    def get_stats(self) -> dict:
        self._check()
        return {"memtable_bytes": self._unflushed, "pending": len(self._pending), "flushing": self._flushing is not None and not self._flushing.done(), "runs": len(self.snapshot["runs"]), "run_entries": sum(r["entries"] for r in self.snapshot["runs"]), "version": self.snapshot["version"], "seq": self.seq, "compaction": self.stats}

    # replication

    def identity(self) -> str:
        """A name for this store that replicas know it by, made at the first question."""
        folder = Folder(self.spark, f"{self.path}/identity")
        if not folder.exists("id"):
            folder.write("id", uuid.uuid4().hex)
        return folder.read("id")

    def follow(self, primary: str) -> None:
        """Binds this replica to a primary by its identity; another one is refused from then on."""
        if not self._primary.exists("id"):
            self._primary.write("id", primary)
        if self._primary.read("id") != primary:
            raise PermissionError("this replica follows another primary")

    def apply_replicated(self, op: str, key=None, value=None, keys=None, values=None, source_seq: int | None = None) -> int:
        """Logs a primary's record under a sequence number of this store's own; one that was applied before changes nothing."""
        with self._lock:
            self._check()
            if source_seq is not None:
                if source_seq <= self.source_seq:
                    return self.seq
                self.source_seq = source_seq
            seq = self.seq + 1
            self._log(op, key, value, keys, values, source_seq)
            size = len(encode(seq, 0, op, key, value, keys, values))
            self.applied = {"records": self.applied["records"] + 1, "bytes": self.applied["bytes"] + size, "last_ms": self.clock()}
            return seq

    def log_after(self, seq: int) -> DataFrame | None:
        """Durable records behind a sequence number, None if there are none.

        Where the log doesn't reach back so far, a follower that has nothing yet (seq below 0) gets the entries of the
        runs instead, tombstones too, as records; for any other that is an error.
        """
        self.snapshot = max(self.snapshot, self._load(), key=lambda x: x["version"])
        names = []
        for n, last in self._log_names():
            if last > seq:
                if not Folder(self.spark, f"{self.path}/log/{n}").exists("_SUCCESS"):
                    break
                names.append(n)
        parts, upto = [], seq
        if self.snapshot["max_seq"] > seq and (not names or _number(names[0]) > seq + 1):
            if seq >= 0:
                raise RuntimeError(f"the log no longer reaches back to {seq}")
            upto, none = self.snapshot["max_seq"], F.lit(None).cast("array<string>")
            if self.snapshot["runs"]:
                kept = state.latest(self._read_runs(self.snapshot["runs"]))
                parts.append(kept.select("seq", "ts", F.when(F.col("deleted"), "DELETE").otherwise("PUT").alias("op"), "key", F.when(~F.col("deleted"), F.col("value")).alias("value"), none.alias("keys"), none.alias("values")))
        if names:
            log = self.spark.read.schema(LOG_SCHEMA).parquet(*(f"{self.path}/log/{n}" for n in names))
            parts.append(log.where(F.col("seq") > upto).select(*_RECORD[:7]))
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def apply_log(self, records: DataFrame) -> int:
        """Logs a primary's records, of any number, in their order; the number of those that weren't applied before.

        Numbers here are those of the primary, moved up by as much as keeps them behind all that is here.
        """
        with self._lock:
            self._check()
            new = records.where(F.col("seq") > self.source_seq)
            ends = new.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
            if ends["low"] is None:
                return 0
            self.sync()
            up = max(0, self.seq + 1 - ends["low"])
            rows = new.select((F.col("seq") + up).alias("seq"), *_RECORD[1:7], F.col("seq").alias("source_seq"))
            added = self._log_rows(rows, ends["low"] + up, ends["high"] + up)
            self.source_seq = ends["high"]
            self.applied = {"records": self.applied["records"] + added["records"], "bytes": self.applied["bytes"] + (added["bytes"] or 0), "last_ms": self.clock()}
            return added["records"]

    def _last_of_followers(self) -> dict[str, str]:
        """The last report of each follower: its name and how far it came, as `name-seq`."""
        return {n.rsplit("-", 1)[0]: n for n in self._followers.names() if not n.startswith(".")}

    def follower_came(self, name: str, seq: int) -> None:
        """Remembers how far a follower has come; the log behind that is kept for it."""
        before = self._last_of_followers().get(name)
        new = f"{name}-{max(seq, 0):020d}"
        if before != new:
            self._followers.write(new, "")
            if before is not None:
                self._followers.delete(before)

    def replication_status(self) -> dict:
        """The role, and how far what was applied or passed on lies behind."""
        now = self.clock()
        if self.config.read_only:
            last = self.applied["last_ms"]
            return {"role": "backup", "source_seq": self.source_seq, "applied": self.applied["records"], "bytes": self.applied["bytes"], "lag_ms": None if last is None else now - last}
        came = {name: int(n.rsplit("-", 1)[1]) for name, n in self._last_of_followers().items()}
        return {"role": "primary", "seq": self.seq, "followers": came, "pending": {name: max(0, self.seq - x) for name, x in came.items()}}

    def close(self) -> None:
        """Pending records are written and maintenance is waited for; what isn't flushed comes back from the log."""
        if self._open:
            try:
                self.sync()
            finally:
                self._open = False
                if self._scheduler is not None:
                    self._scheduler.cancel()
                self._maintenance.shutdown(wait=True)
            if self._lease is not None:
                self._vacuum(all_=True)
