"""The store against a plain dictionary, and across restarts, flushes and compactions."""

import random
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest

from siltlog.operators import state
from siltlog.sources import http, tcp
from siltlog.store import Store, StoreConfig
from siltlog.streaming import ingest


def contents(store):
    return {r["key"]: r["value"] for r in store.live().collect()}


def test_put_get_overwrite_delete(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/s", StoreConfig(sync="manual")) as s:
        s.put("user:1", "Alice")
        s.put("user:1", "Alice Updated")
        s.put("empty", "")
        s.put("gone", 1.0)
        s.delete("gone")
        s.delete("never there")
        assert contents(s) == {"user:1": "Alice Updated", "empty": ""}
        assert s.get("gone") is None and s.get("empty") == ""
        with pytest.raises(ValueError):
            s.put("", "x")
        with pytest.raises(ValueError):
            s.batch_put([("a", "1"), ("b", None)])
        with pytest.raises(TypeError):
            s.put("k", {"a": 1})
        assert "a" not in contents(s)
    with pytest.raises(RuntimeError):
        s.get("user:1")


def test_batch_range_limit_and_restart(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    with Store(spark, path) as s:
        assert s.batch_put([(f"rng:{i:03d}", f"R-{i}") for i in range(1, 31)] + [("rng:001", "again")]) == 31
        assert s.batch_put([]) == 0
        s.delete("rng:005")
        assert [k for k, _ in s.read_key_range("rng:005", "rng:015", 5)] == [f"rng:{i:03d}" for i in range(6, 11)]
        assert list(s.read_key_range("rng:015", "rng:005")) == []
        seq = s.seq
    with Store(spark, path) as s:
        assert s.seq == seq and s.get("rng:001") == "again" and len(contents(s)) == 29
        s.flush()
        assert s.get_stats()["runs"] == 1
    with Store(spark, path) as s:
        assert s.seq == seq and len(contents(s)) == 29


def test_random_log_equals_a_dictionary(spark, tmp_path):
    rnd, model = random.Random(5), {}
    s = Store(spark, f"file://{tmp_path}/s", StoreConfig(sync="manual", compaction_threshold=3))
    for step in range(4):
        for _ in range(40):
            key = f"k{rnd.randrange(25)}"
            if rnd.random() < 0.3:
                s.delete(key)
                model.pop(key, None)
            elif rnd.random() < 0.2:
                pairs = [(f"k{rnd.randrange(25)}", f"b{rnd.randrange(99)}") for _ in range(4)]
                s.batch_put(pairs)
                model.update(pairs)
            else:
                model[key] = f"v{rnd.randrange(99)}"
                s.put(key, model[key])
        if step < 3:
            s.flush()
        assert contents(s) == model
    assert s.stats["compactions"] == 1
    s.close()


def test_compaction_of_tombstones_only_leaves_nothing(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", StoreConfig(compact=False))
    s.put("a", "1")
    s.flush()
    s.delete("a")
    s.flush()
    assert s.compact() == {"runs_in": 2, "entries_read": 2, "entries_written": 0, "entries_removed": 2}
    assert s.get_stats()["runs"] == 0 and contents(s) == {} and s.compact() is None
    s.put("a", "2")
    assert contents(s) == {"a": "2"}


def test_half_done_flush_is_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    s = Store(spark, path, StoreConfig(sync="always"))
    s.put("a", "1")
    commit = s._commit
    s._commit = lambda **_: (_ for _ in ()).throw(OSError("crash"))
    with pytest.raises(OSError):
        s.flush()
    s._commit = commit
    again = Store(spark, path)
    assert contents(again) == {"a": "1"} and again.get_stats()["runs"] == 0
    again.flush()
    assert contents(again) == {"a": "1"} and again.get_stats()["runs"] == 1


def test_keys_in_code_unit_order(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/s", StoreConfig(compact=False)) as s:
        keys = ["a:1", "a:10", "a:2", "￮", "\U0001f600", "a/b", "a+b", "a%b"]
        s.batch_put([(k, k) for k in keys])
        expected = sorted(keys, key=lambda k: k.encode("utf-16-be"))
        assert [r["key"] for r in s.range().collect()] == expected
        s.flush()
        assert [r["key"] for r in s.range().collect()] == expected
        assert [k for k, _ in s.read_key_range("\U0001f600", "￮")] == ["\U0001f600", "￮"]


def test_write_a_dataframe_and_replicate(spark, tmp_path):
    primary = Store(spark, f"file://{tmp_path}/p")
    replica = Store(spark, f"file://{tmp_path}/r", StoreConfig(read_only=True))
    seen = []
    primary.on_append(seen.extend)
    primary.on_append(lambda records: 1 / 0)
    assert primary.write(spark.createDataFrame([("x", "1"), ("x", "3"), ("y", "2")], "key string, value string")) == 2
    primary.put("z", "4")
    primary.delete("y")
    for seq, _, op, key, value, keys, values in seen:
        replica.apply_replicated(op, key, value, keys, values)
    replica.sync()
    assert contents(primary) == contents(replica) == {"x": "3", "z": "4"}
    assert len(seen) == 4 and replica.applied["records"] == 4
    with pytest.raises(PermissionError):
        replica.put("q", "1")


def test_a_put_is_durable_when_it_returns(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    s = Store(spark, path)
    s.put("a", "1")  # by the timer
    assert Store(spark, path).get("a") == "1" and not s._pending
    with ThreadPoolExecutor(8) as pool:  # writers that wait together share commits
        list(pool.map(lambda k: s.put(f"k{k}", k), range(40)))
    assert len([n for n, _ in s._log_names()]) < 30
    soon = [s.put_soon(f"m{k}", k) for k in range(100)]
    assert all(f.result(20) is None for f in soon)
    again = Store(spark, path)  # without a close, as after a crash
    assert len(contents(again)) == 141
    again.put("b", "2")
    with pytest.raises(RuntimeError, match="taken this store over"):
        s.put("c", "3")
    assert contents(Store(spark, path)).keys() == contents(again).keys()


def test_a_failed_append_is_told_and_tried_again(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    hold = s._hold_lease
    s._hold_lease = lambda: (_ for _ in ()).throw(OSError("away"))
    with pytest.raises(OSError):
        s.put("a", "1")
    s._hold_lease = hold
    s.put("b", "2")
    assert contents(Store(spark, s.path)) == {"a": "1", "b": "2"}


def test_a_snapshot_that_cant_be_written_changes_nothing(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", StoreConfig(sync="always"))
    s.put("a", "1")
    write = s._snapshots.write
    s._snapshots.write = lambda *_: (_ for _ in ()).throw(OSError("full"))
    with pytest.raises(OSError):
        s.flush()
    assert (s.snapshot["version"], s.snapshot["runs"], s.get_stats()["memtable_bytes"]) == (0, [], 51)
    s._snapshots.write = write
    s.flush()
    assert s.snapshot["version"] == 1 and contents(s) == {"a": "1"}


def test_flushes_in_the_background_and_sizes_after_a_restart(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    config = StoreConfig(sync="manual", memtable_bytes=2000, compact=False)
    s = Store(spark, path, config)
    for k in range(100):
        s.put(f"flush:{k:05d}", "x" * 20)
    s.close()
    assert s.snapshot["runs"] and s.get_stats.__self__.snapshot["max_seq"] > 0
    again = Store(spark, path, StoreConfig(sync="manual", compact=False))
    assert len(contents(again)) == 100
    again.put("one", "1")
    again.sync()
    once = again.get_stats()["memtable_bytes"]
    third = Store(spark, path, StoreConfig(sync="manual", compact=False))
    third.put("one", "2")  # overwrites what was logged before the restart
    assert third.get_stats()["memtable_bytes"] == once


def test_the_scheduler_merges_runs_one_merge_at_a_time(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    with Store(spark, path, StoreConfig(compact=False)) as s:
        for k in range(4):
            s.put("a", k)
            s.flush()
        (tmp_path / "s/runs/run=00000").mkdir()  # what a merge left half done
        both = [s._compact_soon(), s._compact_soon()]
        assert both[0] is both[1] or both[0].done()
        assert both[0].result()["entries_removed"] == 3
    assert sorted(p.name for p in (tmp_path / "s/runs").iterdir()) == ["run=00005"] and not [p for p in (tmp_path / "s/log").iterdir() if p.name.startswith("first=")]
    with Store(spark, path, StoreConfig(compact=False)) as s:
        for k in range(4):
            s.put("b", k)
            s.flush()
    with Store(spark, path, StoreConfig(compaction_seconds=0.2)) as s:
        for _ in range(100):
            if s.stats["compactions"]:
                break
            time.sleep(0.2)
        assert s.get_stats()["runs"] == 1 and contents(s) == {"a": "3", "b": "3"}


def test_a_replica_catches_up(spark, tmp_path):
    open_ = lambda name, **kw: Store(spark, f"file://{tmp_path}/{name}", StoreConfig(compact=False, **kw))
    primary, replica = open_("p"), open_("r", read_only=True)
    primary.put("a", "1")
    primary.batch_put([("b", "1"), ("b", "2"), ("c", "3")])
    primary.flush()
    primary.flush()
    primary.delete("a")
    assert ingest.catch_up(primary, replica) == 4  # two live keys and one of them deleted later: three from runs, one logged
    assert contents(replica) == contents(primary) == {"b": "2", "c": "3"} and ingest.catch_up(primary, replica) == 0
    # the log is kept for a follower that is away
    primary.put("repl:1", "Hello from primary")
    primary.write(spark.createDataFrame([("x", "1"), ("y", "2")], "key string, value string"))
    primary.flush()
    primary.delete("c")
    primary.flush()
    primary.flush()
    replica.close()
    replica = open_("r", read_only=True)  # its position comes back from its own log
    assert ingest.catch_up(primary, replica) == 4
    assert contents(replica) == contents(primary) == {"b": "2", "repl:1": "Hello from primary", "x": "1", "y": "2"}
    assert replica.source_seq == primary.seq and primary.replication_status()["pending"] == {"replica": 0}
    replica.flush()
    assert open_("r", read_only=True).source_seq == primary.seq
    assert replica.replication_status()["applied"] == 4 and replica.replication_status()["bytes"] > 0
    with pytest.raises(PermissionError):
        ingest.catch_up(open_("other"), replica)


def test_a_stream_follows_the_primary(spark, tmp_path):
    primary, replica = Store(spark, f"file://{tmp_path}/p"), Store(spark, f"file://{tmp_path}/r", StoreConfig(read_only=True))
    for k in range(3):
        primary.put(f"multi:{k:03d}", f"V-{k}")
        ingest.follow(primary, replica, f"file://{tmp_path}/state").awaitTermination()
        assert contents(replica) == contents(primary)


def rows_read(df):
    """Rows that the scan of a plan without a shuffle gave."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_run_prunes_by_filter_and_key(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/s", StoreConfig(sync="manual", compact=False)) as s:
        s.write(spark.range(0, 40_000, 2).selectExpr("concat('k', lpad(id, 6, '0')) AS key", "'v' AS value"))
        s.flush()
        run = s._read_runs(s.snapshot["runs"])
        # inside the range of keys, but not there: the Bloom filter skips the row group; a key that is there reads it
        assert rows_read(run.where("key = 'k012345'")) == 0 < rows_read(run.where("key = 'k012346'"))
        plan = state.in_range(run, "k000100", "k000200")._jdf.queryExecution().toString()
        assert "GreaterThanOrEqual(sort_key" in plan and "LessThanOrEqual(sort_key" in plan
        assert rows_read(state.in_range(run, "x", "y")) == 0


def test_pages(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/s", StoreConfig(sync="manual")) as s:
        s.batch_put([(f"rng:{i:03d}", i) for i in range(30)])
        pages, after = [], None
        while page := [r["key"] for r in s.range("rng:002", "rng:027", 7, after).collect()]:
            pages.append(len(page))
            after = page[-1]
        assert pages == [7, 7, 7, 5] and after == "rng:027"
        assert http.answer(s, "GET", "/range?start=rng:002&end=rng:027&limit=2&after=rng:009")[1]["results"] == [{"key": "rng:010", "value": "10"}, {"key": "rng:011", "value": "11"}]


def test_tcp_puts(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/s") as s:
        server = tcp.serve(s)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        client = tcp.Client(*server.server_address)
        assert client.stream_put([(f"tcp:{i:04d}", f"TcpVal-{i}") for i in range(5)]) == 5
        assert len(contents(Store(spark, s.path))) == 5  # acknowledged means durable
        with pytest.raises(RuntimeError, match="key"):
            client.put("", "x")
        with pytest.raises(RuntimeError, match="unexpected operation 2"):
            client._ask(tcp.Message(tcp.ACK))
        client.put("é🙂", "")
        client.end()
        server.shutdown()
        server.server_close()
        assert s.get("é🙂") == ""


def test_http_contract(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/s") as s:
        ask = lambda m, t, b=b"": http.answer(s, m, t, b)
        assert ask("GET", "/health")[1]["status"] == "ok"
        assert ask("POST", "/put", b'{"key": "a/b+c", "value": true}') == (200, {"success": True})
        assert ask("GET", "/get/a%2Fb+c") == (200, {"key": "a/b+c", "value": "true"})
        assert ask("POST", "/put", b'{"value": 1}')[0] == 400
        assert ask("POST", "/put", b"nonsense")[0] == 500
        assert ask("POST", "/put", b"null")[0] == 500 and ask("POST", "/batch-put", b"[1]")[0] == 400
        assert ask("POST", "/batch-put", b'{"entries": []}')[0] == 400
        assert ask("POST", "/batch-put", b'{"keys": ["a"], "values": []}')[0] == 400
        assert "index 1" in ask("POST", "/batch-put", b'{"entries": [{"key": "a", "value": 1}, {"key": "", "value": 1}]}')[1]["error"]
        assert ask("POST", "/batch-put", b'{"keys": ["k1", "k2"], "values": [1.0, ""]}') == (200, {"success": True, "count": 2})
        assert ask("GET", "/range?start=k1&end=k9&limit=1x") == (200, {"count": 1, "results": [{"key": "k1", "value": "1"}]})
        assert ask("GET", "/range?start=k1&end=k9&limit=0")[0] == 400 and ask("GET", "/range?start=&end=a")[0] == 400
        assert ask("DELETE", "/delete/k1") == (200, {"success": True})
        assert ask("GET", "/get/k1")[0] == 404 and ask("GET", "/nowhere")[0] == 404
        assert ask("GET", "/replication/status") == (200, {"enabled": False})
