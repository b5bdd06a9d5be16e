"""Log records as bytes, Bloom filters, flush borders, validation and streams."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltlog.functions.bloom import BloomFilter
from siltlog.functions.keys import js_text
from siltlog.operators import mutations, replicas, runs, state
from siltlog.sources import binary, tcp
from siltlog.store import StoreConfig
from siltlog.streaming import ingest

TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=20)


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 1 << 40), TEXT.filter(bool), TEXT, st.lists(st.tuples(TEXT.filter(bool), TEXT), max_size=4))
def test_records_come_back(seq, key, value, pairs):
    records = [(seq, 1, "PUT", key, value, None, None), (seq + 1, 2, "DELETE", key, None, None, None), (seq + 2, 3, "BATCH_PUT", None, None, [k for k, _ in pairs], [v for _, v in pairs])]
    data = b"".join(binary.encode(*r) for r in records)
    assert list(binary.decode(data)) == records
    assert list(binary.decode(data[:-1])) == records[:2]
    broken = bytearray(data)
    broken[len(binary.encode(*records[0])) + 9] ^= 1
    assert list(binary.decode(bytes(broken))) == records[:1]


def test_record_sizes_agree_with_the_expression(spark):
    from pyspark.sql import functions as F

    from siltlog.functions.keys import record_bytes

    rows = [(1, 0, "PUT", "kéy", "v", None, None), (2, 0, "DELETE", "k", None, None, None), (3, 0, "BATCH_PUT", None, None, ["a", "b"], ["", "🙂"])]
    got = spark.createDataFrame(rows, mutations.LOG_SCHEMA).select(record_bytes(*(F.col(c) for c in ("op", "key", "value", "keys", "values")))).collect()
    assert [r[0] for r in got] == [len(binary.encode(*r)) for r in rows]


def test_run_entries_come_back(spark):
    from pyspark.sql import functions as F

    from siltlog.functions.keys import entry_encoded

    rows = [("kéy", "v🙂", 1 << 40, False), ("k", "", 0, True)]
    data = b"".join(binary.encode_entry(*r) for r in rows)
    *first, at = binary.decode_entry(data)
    assert tuple(first) == rows[0] and binary.decode_entry(data, at) == (*rows[1], len(data))
    got = spark.createDataFrame(rows, "key string, value string, ts long, deleted boolean").select(entry_encoded(*(F.col(c) for c in ("key", "value", "ts", "deleted")))).collect()
    assert b"".join(bytes(r[0]) for r in got) == data
    with pytest.raises(ValueError):
        binary.decode_entry(data[:4])


def test_binary_log_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(binary.encode(1, 1, "PUT", "k", "1") + b"\0\0")
    (tmp_path / "b.log").write_bytes(binary.encode(2, 2, "PUT", "k", "2"))
    (tmp_path / "c.txt").write_bytes(b"other")
    log = binary.read_binary_log(spark, f"file://{tmp_path}")
    assert [tuple(r) for r in state.live(mutations.entries(log)).collect()] == [("k", "2")]


def test_bloom_filter_has_no_false_negatives():
    f = BloomFilter(500)
    for i in range(500):
        f.add(f"key:{i}🙂")
    assert f.k == 7 and all(f.might_contain(f"key:{i}🙂") for i in range(500))
    assert sum(f.might_contain(f"other:{i}") for i in range(2000)) < 60


def test_bloom_bytes_and_hashes(spark):
    from pyspark.sql import functions as F

    from siltlog.functions import bloom

    f = BloomFilter(3)
    assert f.stats() == {"num_bits": 29, "num_hashes": 7, "bytes": 4} and f.to_bytes()[:8] == b"\0\0\0\x1d\0\0\0\x07"
    f.add("a")
    back = BloomFilter.from_bytes(f.to_bytes())
    assert back.to_bytes() == f.to_bytes() and back.might_contain("a") and not back.might_contain("b")
    # published vectors of 32-bit FNV-1a; djb2 worked out by hand: 5381 * 33 ^ 97
    keys = ["", "a", "foobar", "é🙂", "user:000001:002"]
    got = spark.createDataFrame([(k,) for k in keys], "key string").select("key", bloom.fnv1a(F.col("key")), bloom.djb2(F.col("key")), bloom.positions(F.col("key"), F.lit(29), F.lit(7))).collect()
    found = {r[0]: tuple(r)[1:] for r in got}
    assert [found[k][0] for k in keys[:3]] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968] and found["a"][1] == 5381 * 33 ^ 97
    assert all(list(found[k][2]) == f.positions(k) for k in keys)


def test_bloom_probe_hashes_a_key_once_and_holds_common_filters_whole(spark, monkeypatch):
    keys = [[f"k{gen}:{i}é🙂" for i in range(40 if gen < 5 else 700)] for gen in range(6)]
    df = spark.createDataFrame([(gen, k) for gen, some in enumerate(keys) for k in some], "gen int, key string")
    params = runs.bloom_params(df.groupBy((F.col("gen") + 1).cast("long").alias("file_number")).agg(F.count("*").alias("entry_count")))
    probes = [k for some in keys for k in some[::9]] + [f"other:{i}" for i in range(300)] + [""]
    asked = spark.createDataFrame([(p,) for p in [*probes, probes[0], None]], "key string")
    expected = set()
    for gen, some in enumerate(keys):
        f = BloomFilter(len(some))
        for k in some:
            f.add(k)
        expected |= {(p, gen + 1, f.might_contain(p)) for p in probes}
    for whole_bits in (1 << 20, 1000, 1):  # all runs' filters held whole; all but the large run's; none
        monkeypatch.setattr(runs, "WHOLE_BITS", whole_bits)
        monkeypatch.setattr(runs, "CELL_PROBES", 100)
        monkeypatch.setattr(runs, "GROUP_RUNS", 2)
        found = runs.bloom_probe(runs.bloom_bits(df, params), params, asked)
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(expected) and set(got) == expected
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "conv(" not in plan  # no hash beside a pair of probe and run


def test_sparse_index_and_floor_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keys = [f"k{i:05d}" for i in range(0, 3000, 3)]
        df = spark.createDataFrame([(0, k, "v" * (len(k) + i % 7)) for i, k in enumerate(keys)], "gen int, key string, value string")
        index = runs.sparse_index(df)
        offsets, at = {}, 0
        for i, k in enumerate(keys):
            offsets[k] = (i, at)
            at += len(k) + len(k) + i % 7 + 15
        assert sorted((r["key"], r["entry"], r["offset"]) for r in index.collect()) == [(k, *offsets[k]) for k in keys[::10]]
        probes = ["a", "k00000", "k00029", "k00030", "k01234", "k02999", "z"]
        got = {r["key"]: (r["floor_key"], r["offset"]) for r in runs.index_floor(index, spark.createDataFrame([(p,) for p in probes], "key string")).collect()}
        for p in probes:
            floor = max((k for k in keys[::10] if k <= p), default=None)
            assert got[p] == (floor, offsets[floor][1] if floor else 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("pairs", [1 << 23, 900])
def test_floor_lookup_writes_no_pair_of_probe_and_run(spark, monkeypatch, pairs):
    rnd = random.Random(5)
    alphabet = [f"k{i:04d}" for i in range(400)] + ["é", "\uffee", "🙂", "🙂a", ""]
    index = {run: sorted(rnd.sample(alphabet, size), key=lambda k: k.encode("utf-16-be")) for run, size in ((1, 90), (2, 1), (5, 30), *((run, 2) for run in range(6, 40)))}
    entries = [(run, k, 7 * i) for run, some in index.items() for i, k in enumerate(some)]
    probes = [None, "", "a", "z", "\uffff", "🙂b", *alphabet[::3]]
    made = []
    monkeypatch.setattr(runs, "written", lambda df, name, keep=runs.written: made.append(keep(df, name)) or made[-1])
    monkeypatch.setattr(runs, "CELL_PAIRS", pairs, raising=False)
    found = runs.index_floor(spark.createDataFrame(entries, "file_number long, key string, offset long"), spark.createDataFrame([(p,) for p in [*probes, "a"]], "key string"))
    got = [tuple(r) for r in found.select("key", "file_number", "floor_key", "offset").collect()]
    expected = set()
    for run, some in index.items():
        for p in set(probes):
            i = -1 if p is None else sum(k.encode("utf-16-be") <= p.encode("utf-16-be") for k in some) - 1
            expected.add((p, run, some[i], 7 * i) if i >= 0 else (p, run, None, 0))
    assert len(got) == len(expected) and set(got) == expected
    assert all(df.count() <= len(entries) + len(set(probes)) for df in made)


def test_frames_come_back():
    import io

    messages = [tcp.Message(tcp.PUT, "é", ""), tcp.Message(tcp.ACK), tcp.Message(tcp.ACK, status=tcp.FAILED, text="why"), tcp.Message(tcp.END), tcp.Message(tcp.ERROR, text="x")]
    stream = io.BytesIO(b"".join(map(tcp.encode, messages)) + b"\0\0")
    assert [tcp.read(stream) for _ in messages] == messages and tcp.read(stream) is None
    # fixed bytes of a put, an acknowledgement and an end
    assert tcp.encode(tcp.Message(tcp.PUT, "k", "vv")) == b"\0\0\0\x0a\x01\0\x01k\0\0\0\x02vv"
    assert (tcp.encode(messages[1]), tcp.encode(messages[3])) == (b"\0\0\0\x02\x02\0", b"\0\0\0\x01\x03")
    for bad in (b"\x01\0\x05k", b"\x09", b"\x02"):
        with pytest.raises(ValueError):
            tcp.decode(bad)


def test_flush_border_is_a_fold(spark):
    rnd = random.Random(3)
    rows = [(i, 0, i, f"k{rnd.randrange(30)}", "x" * rnd.randrange(60), False) for i in range(400)]
    df = spark.createDataFrame(rows, mutations.ENTRY_SCHEMA)
    got = {r["seq"]: r["gen"] for r in runs.generations_by_bytes(df, 1500).collect()}
    live, gen, expected = {}, 0, {}
    for seq, _, _, k, v, _ in rows:
        live[k] = len(k) + len(v) + 49
        expected[seq] = gen
        if sum(live.values()) >= 1500:
            live, gen = {}, gen + 1
    assert got == expected


def test_entries_and_last_writer(spark):
    log = spark.createDataFrame(
        [(1, 9, "PUT", "a", "1", None, None), (2, 1, "BATCH_PUT", None, None, ["a", "b", "a", ""], ["2", "3", "4", "5"]), (3, 0, "DELETE", "b", None, None, None), (4, 0, "DELETE", "absent", None, None, None), (5, 0, "PUT", "", "x", None, None)],
        mutations.LOG_SCHEMA,
    )
    e = mutations.entries(log)
    assert sorted(tuple(r) for r in state.live(e).collect()) == [("a", "4")]
    assert sorted(r["key"] for r in state.tombstones(e).collect()) == ["absent", "b"]
    assert state.get(e, "b") is None and state.get(e, "a") == "4"
    assert [r["key"] for r in runs.merge(e, keep_tombstones=True).orderBy("key").collect()] == ["a", "absent", "b"]


def test_validation(spark):
    got = mutations.validated_batches(spark.createDataFrame([(["a"], ["1"]), (["a", ""], ["1", "2"]), (["a"], ["1", "2"]), ([], []), (["a", "b"], ["1", None])], "keys array<string>, values array<string>"))
    assert [(r["status"], r["bad_index"], r["accepted"]) for r in got.collect()] == [(200, -1, 1), (400, 1, 0), (400, -1, 0), (400, -1, 0), (400, 1, 0)]
    for bad in ({"sparse_index_interval": 0}, {"bloom_rate": 1.0}, {"sync": "never"}):
        with pytest.raises(ValueError):
            StoreConfig(**bad)
    assert [js_text(x) for x in (1.0, 1.5, True, 7, "t")] == ["1", "1.5", "true", "7", "t"]


def test_stream_restarts_and_replicates(spark, tmp_path):
    source, primary, replica = (f"file://{tmp_path}/{x}" for x in ("source", "primary", "replica"))
    rows = [(i, i, "DELETE" if i % 7 == 0 else "PUT", f"k{i % 20}", None if i % 7 == 0 else str(i), None, None) for i in range(200)]
    put = lambda part: spark.createDataFrame(part, mutations.LOG_SCHEMA).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(mutations.LOG_SCHEMA).parquet(source)
    put(rows[:120])
    ingest.into_log(stream(), primary, f"file://{tmp_path}/c1").awaitTermination()
    ingest.replicate(spark, primary, replica, f"file://{tmp_path}/c2").awaitTermination()
    put(rows[120:])
    ingest.into_log(stream(), primary, f"file://{tmp_path}/c1").awaitTermination()
    a, b = ingest.read_log(spark, primary), ingest.read_log(spark, replica)
    assert (a.count(), b.count()) == (200, 120)
    status = replicas.status(mutations.entries(a), mutations.entries(b)).first()
    assert (status["pending"], status["caught_up"]) == (80, False)
    ingest.replicate(spark, primary, replica, f"file://{tmp_path}/c2").awaitTermination()
    b = ingest.read_log(spark, replica)
    assert b.count() == 200 and replicas.difference(mutations.entries(a), mutations.entries(b)).count() == 0
    seen = []
    ingest.live_counts(ingest.log_stream(spark, primary), lambda df, _: seen.extend(df.collect()), f"file://{tmp_path}/c3").awaitTermination()
    assert {r["key"]: r["value"] for r in seen if not r["deleted"]} == {r["key"]: r["value"] for r in state.live(mutations.entries(a)).collect()}


def test_command_line():
    from siltlog.__main__ import config, parser

    made = config(parser().parse_args(["--path", "p", "--sync=always", "--memtable-bytes", "9", "--no-compaction", "--replica"]))
    assert made == StoreConfig(memtable_bytes=9, sync="always", compact=False, read_only=True)
    assert config(parser().parse_args(["--path", "p", "--follow=q"])).read_only
