"""Binary log files: records as bytes, and files of them as a DataFrame.

A record is length u32, CRC-32 u32, sequence u64, time u64, operation u8 and payload, all big-endian; the length counts
what follows it, the checksum covers what follows the checksum. A file ends at its first record that is cut short,
doesn't match its checksum or can't be read; the next file goes on.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from siltlog.operators.mutations import LOG_SCHEMA

#: The operations' numbers in a record.
CODES = {"PUT": 1, "DELETE": 2, "BATCH_PUT": 3}
_NAMES = {code: op for op, code in CODES.items()}
_COLUMNS = [c.split()[0] for c in LOG_SCHEMA.split(", ")]


def _key(text: str) -> bytes:
    raw = text.encode()
    if not 0 < len(raw) <= 0xFFFF:
        raise ValueError("a key takes 1 to 65535 bytes")
    return struct.pack(">H", len(raw)) + raw


def _value(text: str) -> bytes:
    raw = text.encode()
    return struct.pack(">I", len(raw)) + raw


def encode(seq: int, ts: int, op: str, key: str | None = None, value: str | None = None, keys=None, values=None) -> bytes:
    """One record; an empty value is a value."""
    if op == "PUT":
        payload = _key(key) + _value(value)
    elif op == "DELETE":
        payload = _key(key)
    elif op == "BATCH_PUT":
        payload = struct.pack(">I", len(keys)) + b"".join(_key(k) + _value(v) for k, v in zip(keys, values, strict=True))
    else:
        raise ValueError(f"unknown operation {op!r}")
    body = struct.pack(">QQB", seq, ts, CODES[op]) + payload
    return struct.pack(">II", len(body) + 4, zlib.crc32(body)) + body


def decode(data: bytes) -> Iterator[tuple]:
    """(seq, ts, op, key, value, keys, values) of the records of a file, up to the first that is broken."""
    at = 0
    while at + 8 <= len(data):
        size, crc = struct.unpack_from(">II", data, at)
        body = data[at + 8 : at + 4 + size]
        if size < 21 or at + 4 + size > len(data) or zlib.crc32(body) != crc:
            return
        try:
            yield _record(body)
        except (struct.error, UnicodeDecodeError, KeyError):
            return
        at += 4 + size


def _record(body: bytes) -> tuple:
    seq, ts, code = struct.unpack_from(">QQB", body)
    at = 17

    def text(form: str, width: int) -> str:
        nonlocal at
        (n,) = struct.unpack_from(form, body, at)
        if at + width + n > len(body):
            raise struct.error("cut short")
        at += width + n
        return body[at - n : at].decode()

    op = _NAMES[code]
    if op == "PUT":
        return seq, ts, op, text(">H", 2), text(">I", 4), None, None
    if op == "DELETE":
        return seq, ts, op, text(">H", 2), None, None, None
    (n,) = struct.unpack_from(">I", body, at)
    at += 4
    pairs = [(text(">H", 2), text(">I", 4)) for _ in range(n)]
    return seq, ts, op, None, None, [k for k, _ in pairs], [v for _, v in pairs]


def encode_entry(key: str, value: str, ts: int, deleted: bool) -> bytes:
    """An entry of a run."""
    return _key(key) + _value(value) + struct.pack(">QB", ts, deleted)


def decode_entry(data: bytes, at: int = 0) -> tuple[str, str, int, bool, int]:
    """(key, value, ts, deleted) of the entry that begins at a byte, and where the next one begins."""
    out = []
    for form in (">H", ">I"):
        (n,) = struct.unpack_from(form, data, at)
        at += struct.calcsize(form) + n
        if at > len(data):
            raise ValueError("an entry is cut short")
        out.append(data[at - n : at].decode())
    ts, deleted = struct.unpack_from(">QB", data, at)
    return out[0], out[1], ts, deleted == 1, at + 9


def encode_log(log: DataFrame) -> DataFrame:
    """(content): the records of a log as bytes, many in each row, as a file of them holds them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(*(batch[c] for c in _COLUMNS), strict=True)
            yield pd.DataFrame({"content": [b"".join(encode(int(r[0]), int(r[1]), *r[2:]) for r in rows)]})

    return log.select(*_COLUMNS).mapInPandas(run, "content binary")


def decode_log(contents: DataFrame) -> DataFrame:
    """The records of rows (content), each up to its first record that is broken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame(list(decode(bytes(content))), columns=_COLUMNS)

    return contents.select("content").mapInPandas(run, LOG_SCHEMA)


def read_binary_log(spark: SparkSession, path: str) -> DataFrame:
    """The records of all *.log files in a folder; whole files are read, many at a time, and need no order."""
    return decode_log(spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path))
