"""Exact removal of repeated byte strings across a corpus.

Every window of LENGTH bytes picks an anchor, the K bytes in it with the least hash, which depends on the window's
bytes alone: equal windows have equal anchors. Neighbouring windows with one anchor make a context. Contexts meet by
the 64 bits of their anchor's hash; anchors that occur once are done. Among the contexts of an anchor equal ones are
settled by another 64 bits, of both sums over the whole context: all windows of all but the first are repeats. Different contexts around one anchor go, with their bytes,
through the interval expansion of `repeats`, which finds all windows that begin earlier. Where an anchor has MANY
different contexts or more, as at the edges of a passage in a large part of all documents, no single task could hold
them, and its windows meet one by one by two independent hashes of 64 bits instead. Equal contexts of a task are settled before they are shuffled.
"""

from __future__ import annotations


import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltlog.llm.common import table, written
from siltlog.llm.repeats import later_windows

NAME = "op8_suffix"
LENGTH, ANCHOR = 100, 32
#: Different contexts of an anchor, in a task or in all, from which its windows are taken one by one: what the transform
#: holds of an anchor has less than so many contexts of at most 2 * LENGTH - ANCHOR bytes.
MANY = 2048
#: Bytes of contexts in one transform at least, but for the last; whole anchors go together.
UNIT_BYTES = 1 << 19
STEP_BYTES = 1 << 20
#: Buckets for each shuffle partition, so that hashing them to partitions comes out even; and bytes of input for each,
#: by Spark's own estimate, since a task holds the entries of one bucket at a time.
BUCKETS_PER_PARTITION, BUCKET_BYTES = 16, 4 << 20
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
ENTRY = np.dtype([("key", "<u8"), ("ctx", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("lo", "<u4"), ("off", "u1"), ("run", "u1")])
CONTEXT, WINDOW, NOTICE, MARK = 0, 1, 2, 3


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[0]
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base, np.uint64)]))


class Hashes:
    """Hashes of any stretch of data, two sums of powers each."""

    BASES = (0x100000001B3, 0x5851F42D4C957F2D)

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums, self.inverse = [], []
        wide = data.astype(np.uint64) + np.uint64(1)
        for base in self.BASES:
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(wide * _powers(base, n))]))
            self.inverse.append(_powers(pow(base, -1, 1 << 64), n))

    def both(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits: a hash of each sum, which know nothing of each other."""
        n = (high - low).astype(np.uint64) * _ODD[1]
        a, b = (_mix(_mix((s[high] - s[low]) * inv[low]) + n) for s, inv in zip(self.sums, self.inverse, strict=True))
        return a, b

    def of(self, low: np.ndarray, high: np.ndarray, seed: np.ndarray | int = 0) -> np.ndarray:
        """64 bits of both sums."""
        a, b = ((s[high] - s[low]) * inv[low] for s, inv in zip(self.sums, self.inverse, strict=True))
        return _mix(_mix(a) + b * _ODD[1] + np.asarray(seed).astype(np.uint64) * _ODD[0] + (high - low).astype(np.uint64))


def contexts(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """(owner, lo, hi, anchor, key) of the contexts of texts that lie in data at `starts`: windows lo..hi have that anchor."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, np.zeros(0, np.uint64)
    h, m, base = data.astype(np.uint64) + np.uint64(1), 1, 0xD6E8FEB86659FD93
    while m < ANCHOR:
        h = h[:-m] * np.uint64(pow(base, m, 1 << 64)) + h[m:]
        m *= 2
    h = _mix(h)
    bits = np.uint64(max(20, int(n).bit_length()))
    low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    span = LENGTH - ANCHOR + 1
    m = 1
    while 2 * m <= span:
        low = np.minimum(low[:-m], low[m:])
        m *= 2
    low = np.minimum(low[: len(low) - (span - m)], low[span - m :])
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [n]])))[: len(anchor)]
    at = np.flatnonzero(np.arange(len(anchor)) - starts[owner] + LENGTH <= lengths[owner])
    if not len(at):
        return none, none, none, none, np.zeros(0, np.uint64)
    anchor = anchor[at]
    first = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(anchor) != 0)])
    last = np.concatenate([first[1:], [True]])
    anchor = anchor[first]
    return owner[at[first]], at[first], at[last], anchor, h[anchor]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in arrays that are sorted by keys."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def settle(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries sorted by key, ctx and place; and which of them aren't the first of their key and ctx (nor the same place)."""
    e = e[np.lexsort((e["lo"], e["th"], e["doc"], e["ctx"], e["key"]))]
    new = _groups(e["key"], e["ctx"])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(e) else np.zeros(0, np.int64)
    later = (e["doc"] != e["doc"][head]) | (e["th"] != e["th"][head]) | (e["lo"] != e["lo"][head])
    return e, later


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow column of texts without nulls, as they lie there, and where each text starts."""
    wide = texts.type == pa.large_string()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def entries(data: np.ndarray, cuts: np.ndarray, docs: np.ndarray, ths: np.ndarray) -> np.ndarray:
    """Entries of all contexts of the texts data[cuts[i]:cuts[i + 1]]."""
    out = [np.zeros(0, ENTRY)]
    at, n = 0, len(docs)
    while at < n:
        end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + STEP_BYTES, side="right")) - 1)
        part, starts = data[cuts[at] : cuts[end]], cuts[at:end] - cuts[at]
        owner, lo, hi, anchor, key = contexts(part, starts, np.diff(cuts[at : end + 1]))
        if len(lo):
            e = np.zeros(len(lo), ENTRY)
            e["key"], e["ctx"] = key, Hashes(part).of(lo, hi + LENGTH, anchor - lo)
            e["doc"], e["th"] = docs[at + owner], ths[at + owner]
            e["lo"], e["off"], e["run"] = lo - starts[owner], anchor - lo, hi - lo
            out.append(e)
        at = end
    return np.concatenate(out)


def windows_of(data: np.ndarray, doc: int, th: int, lo: int, run: int) -> np.ndarray:
    """The windows lo..lo + run of a text, each as an entry whose key and ctx are two independent hashes of the window."""
    at = np.arange(run + 1)
    hashes = Hashes(data[lo : lo + run + LENGTH])
    w = np.zeros(run + 1, ENTRY)
    w["key"], w["ctx"] = hashes.both(at, at + LENGTH)
    w["doc"], w["th"], w["lo"] = doc, th, lo + at
    return w


def _many(e: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Of entries sorted by key: which belong to a key with MANY different contexts or more."""
    if not len(e):
        return np.zeros(0, bool)
    new = _groups(e["key"])
    group = np.cumsum(new) - 1
    return np.bincount(group, ~later)[group] >= MANY


def _rows(kind: int, e: np.ndarray, buckets: int, by: np.ndarray):
    """(bucket, kind, bytes) for each bucket that has entries, columns one after another so that they compress."""
    if not len(e):
        return
    b = (by % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    e, b = e[order], b[order]
    cuts = np.append(np.flatnonzero(_groups(b)), len(b))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(b[i]), kind, packed(e[i:j])


def packed(e: np.ndarray) -> bytes:
    return len(e).to_bytes(4, "little") + b"".join(np.ascontiguousarray(e[name]).tobytes() for name in ENTRY.names)


def unpacked(blob: bytes) -> np.ndarray:
    n, at = int.from_bytes(blob[:4], "little"), 4
    e = np.zeros(n, ENTRY)
    for name in ENTRY.names:
        kind = ENTRY[name]
        e[name] = np.frombuffer(blob, kind, n, at)
        at += n * kind.itemsize
    return e


def _place_hash(e: np.ndarray) -> np.ndarray:
    return _mix(e["doc"].astype(np.uint64) * _ODD[0] + e["th"].astype(np.uint64))


def scan(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, kind, blob) rows of all contexts of docs (doc, th, text), settled within each batch."""

    def run(batches):
        for batch in batches:
            docs_, ths = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, cuts = _bytes_of(batch.column(2))
            e, later = settle(entries(data, cuts, docs_, ths))
            if not len(e):
                continue
            many = _many(e, later)
            rows = [*_rows(MARK, e[later], buckets, _place_hash(e[later]))]
            keep = e[~later & ~many]
            rows += _rows(CONTEXT, keep, buckets, keep["key"])
            hot = e[~later & many]
            del e, keep
            if len(hot):
                of = {(int(d), int(t)): i for i, (d, t) in enumerate(zip(docs_, ths, strict=True))}
                cut = lambda x: data[cuts[of[x]] : cuts[of[x] + 1]]
                w = [windows_of(cut((int(x["doc"]), int(x["th"]))), x["doc"], x["th"], int(x["lo"]), int(x["run"])) for x in hot]
                w, again = settle(np.concatenate(w))
                rows += _rows(MARK, w[again], buckets, _place_hash(w[again]))
                w = w[~again]
                rows += _rows(WINDOW, w, buckets, w["key"])
                notice = hot[_groups(hot["key"])]
                rows += _rows(NOTICE, notice, buckets, notice["key"])
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.binary())], names=["bucket", "kind", "blob"])

    return docs.mapInArrow(run, "bucket int, kind int, blob binary")


#: what: MARK, WINDOW (key and ctx are the window's hash), CONTEXT to be taken window by window, or UNIT for the transform.
UNIT = 4
OUT = "what int, key long, ctx long, doc long, th long, lo long, run int"


def _out(what: int, e: np.ndarray):
    for at in range(0, len(e), 50_000):
        x = e[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(x), what, np.int32)), pa.array(x["key"].view("<i8") if x["key"].flags.c_contiguous else x["key"].copy().view("<i8")), pa.array(x["ctx"].copy().view("<i8")), pa.array(x["doc"].copy()), pa.array(x["th"].copy()), pa.array(x["lo"].astype(np.int64)), pa.array(x["run"].astype(np.int32))],
            names=["what", "key", "ctx", "doc", "th", "lo", "run"],
        )


def by_bucket(batches):
    """For each bucket of rows (bucket, kind, blob) sorted by bucket: its entries by kind. One bucket is held at a time."""
    bucket, held = None, {}
    for batch in batches:
        for at, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if at != bucket:
                if held:
                    yield {k: np.concatenate(x) for k, x in held.items()}
                bucket, held = at, {}
            held.setdefault(kind, []).append(unpacked(blob.as_py()))
    if held:
        yield {k: np.concatenate(x) for k, x in held.items()}


def meet(found: DataFrame, partitions: int) -> DataFrame:
    """OUT rows: what is settled when all contexts of an anchor, and all windows of a hash, have met in a bucket."""

    def run(batches):
        for by in by_bucket(batches):
            all_of = lambda kind: by.pop(kind, np.zeros(0, ENTRY))  # noqa: B023, E731
            yield from _out(MARK, all_of(MARK))
            w, later = settle(all_of(WINDOW))
            yield from _out(MARK, w[later])
            yield from _out(WINDOW, w[~later])
            notices = np.unique(all_of(NOTICE)["key"])
            e, later = settle(all_of(CONTEXT))
            if not len(e):
                continue
            yield from _out(MARK, e[later])
            many = _many(e, later) | np.isin(e["key"], notices)
            yield from _out(CONTEXT, e[~later & many])
            new = _groups(e["key"])
            group = np.cumsum(new) - 1
            several = np.bincount(group, ~later)[group] > 1
            yield from _out(UNIT, e[~later & several & ~many])

    return found.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, OUT)


#: What is cut out of texts: the bytes of contexts (UNIT), or windows by their hash (WINDOW, no body).
CUT = "what int, key long, ctx long, doc long, th long, lo long, body binary"


def cut_out(wanted: DataFrame) -> DataFrame:
    """CUT rows of texts (doc, th, text, wanted: what, key, lo, run)."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in CUT.split(", ")]

    def run(batches):
        out: list[tuple] = []
        for batch in batches:
            for doc, th, text, asked in zip(*(batch.column(i) for i in range(4)), strict=True):
                data, doc, th = np.frombuffer(text.as_buffer(), np.uint8), doc.as_py(), th.as_py()
                for x in asked.as_py():
                    lo, n = x["lo"], x["run"]
                    if x["what"] == UNIT:
                        out.append((UNIT, x["key"], 0, doc, th, lo, data[lo : lo + n + LENGTH].tobytes()))
                    else:
                        w = windows_of(data, doc, th, lo, n)
                        out += zip(itertools.repeat(WINDOW), w["key"].view("<i8").tolist() if w["key"].flags.c_contiguous else w["key"].copy().view("<i8").tolist(), w["ctx"].copy().view("<i8").tolist(), w["doc"].tolist(), w["th"].tolist(), w["lo"].tolist(), itertools.repeat(None))
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return wanted.mapInArrow(run, CUT)


def _same_bytes(rows: list[tuple]):
    """(doc, th, lo, run) lists of the windows in contexts `rows` (CUT) that begin earlier in the order of places."""
    rows.sort(key=lambda r: (r[3], r[4], r[5]))
    data = np.frombuffer(b"\xfe".join([*(r[6] for r in rows), b""]) + b"\xff", np.uint8)
    lengths = np.array([len(r[6]) for r in rows])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    inside = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    valid = inside + LENGTH <= np.repeat(lengths, np.diff(np.append(starts, len(data))))
    at = np.flatnonzero(later_windows(data, valid, LENGTH))
    if not len(at):
        return [], [], [], []
    which = np.searchsorted(starts, at, side="right") - 1
    first = _groups(which, at - np.arange(len(at)))
    who = which[first].tolist()
    lo = at[first] - starts[who] + np.array([rows[i][5] for i in who])
    return [rows[i][3] for i in who], [rows[i][4] for i in who], lo.tolist(), (at[np.append(first[1:], True)] - at[first]).tolist()


def transform(cut: DataFrame, partitions: int) -> DataFrame:
    """(doc, th, lo, run) of repeats: contexts anchor by anchor through the transform, windows by their hashes."""

    def run(batches):
        rows: list[tuple] = []
        window, earliest, size = None, None, 0
        out: tuple[list, ...] = ([], [], [], [])

        def done():
            nonlocal rows, size
            if len(rows) > 1:
                for column, more in zip(out, _same_bytes(rows), strict=True):
                    column += more
            rows, size = [], 0

        def batch_of():
            columns = [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["doc", "th", "lo", "run"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                what, key, ctx, doc, th, lo, body = row
                if what == WINDOW:  # sorted by hash and place: the first of a hash is the earliest
                    place = (doc, th, lo)
                    if window != (key, ctx):
                        window, earliest = (key, ctx), place
                    elif place != earliest:
                        for column, x in zip(out, (*place, 0), strict=True):
                            column.append(x)
                    continue
                if size >= UNIT_BYTES and key != rows[-1][1]:
                    done()
                rows.append(row)
                size += len(body)
            if len(out[0]) > 20_000:
                yield batch_of()
        done()
        yield batch_of()

    ordered = cut.repartition(partitions, "what", "key", "ctx").sortWithinPartitions("what", "key", "ctx", "doc", "th", "lo")
    return ordered.mapInArrow(run, "doc long, th long, lo long, run int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, th, lo, run): runs of windows, run + 1 of them from byte lo on, that also begin earlier; docs has doc, th and text."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # an estimate of the plan, from the sizes of files; it changes no result
    estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = min(1 << 30, max(BUCKETS_PER_PARTITION * partitions, estimate // BUCKET_BYTES))
    met = written(meet(scan(docs.select("doc", "th", "text"), buckets), partitions), "met", "what")
    wanted = met.where(F.col("what").isin(UNIT, CONTEXT)).groupBy("doc", "th").agg(F.collect_list(F.struct("what", "key", "lo", "run")).alias("wanted"))
    # rows of one document that are repeated give their contexts twice, which is harmless: they have one place
    # all columns are carried along: the texts are then dealt out just as for the caller's own join, once for both
    cut = cut_out(docs.join(wanted, ["doc", "th"]).select("doc", "th", "text", "wanted", *(c for c in docs.columns if c not in ("doc", "th", "text"))))
    singles = met.where(F.col("what") == WINDOW).select("what", "key", "ctx", "doc", "th", "lo", F.lit(None).cast("binary").alias("body"))
    found = transform(cut.unionByName(singles), partitions)
    return met.where(F.col("what") == MARK).select("doc", "th", "lo", "run").unionByName(found)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that stay), n_removed and n_spans of every row.

    A byte goes if a string of LENGTH bytes over it also starts earlier: at a smaller doc_id, or earlier in the same
    document; strings are those of the input and never cross documents. Null and short texts lose nothing. Rows that
    share doc_id and text are one document and fare alike; texts that share a doc_id are told apart and ordered by 64 bits of a hash of them; a
    null doc_id comes before all others. An empty table gives an empty result, other columns are not read, whatever
    their names. A task holds about a dozen numbers of 8 bytes for each byte of its longest text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    place = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    # both joins with the texts deal them out in the same way, so that Spark does it once
    with_hash = docs.select(F.col(id_col).cast("long").alias("doc_id"), place.alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    spans = repeated_spans(with_hash)
    per_doc = spans.groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "run")).alias("spans"))

    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text, spans in zip(*(batch.column(i) for i in range(3)), strict=True):
                data = (text.as_py() or "").encode()
                gone = np.zeros(len(data) + 1, np.int32)
                if spans.is_valid and len(spans):
                    lo, length = (spans.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                    np.add.at(gone, lo, 1)
                    np.add.at(gone, lo + length + LENGTH, -1)
                cover = np.cumsum(gone[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~cover].tobytes()
                values = (doc_id.as_py(), len(data), kept, len(data) - len(kept), int(np.count_nonzero(np.diff(np.concatenate([[0], cover])) == 1)))
                for column, x in zip(out, values, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "n_bytes", "kept", "n_removed", "n_spans"])

    joined = with_hash.join(per_doc, ["doc", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, kept binary, n_removed long, n_spans long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: SQL can't state it within reason; tests hold it against a brute-force version.
ORACLE_SQL = None
