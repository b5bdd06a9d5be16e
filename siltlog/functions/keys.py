"""Key order and the sizes that log records and run entries take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a record around its keys and values: length, checksum, sequence, time, operation.
RECORD_HEAD = 4 + 4 + 8 + 8 + 1
#: Bytes of a run entry around key and value: key length, value length, time, deleted flag.
ENTRY_HEAD = 2 + 4 + 8 + 1
#: Bytes that an entry in memory counts besides key and value.
MEMORY_HEAD = 49
#: Bytes of UTF-8 that the u16 length of a key can tell.
LONGEST_KEY = 65_535


def sort_key(key: Column) -> Column:
    """Bytes that order as UTF-16 code units do: they differ from UTF-8 order where a key has characters beyond U+FFFF."""
    return F.encode(key, "UTF-16BE")


def entry_bytes(key: Column, value: Column) -> Column:
    return (F.octet_length(key) + F.octet_length(value) + ENTRY_HEAD).cast("long")


def entry_encoded(key: Column, value: Column, ts: Column, deleted: Column) -> Column:
    """A run entry as bytes: key behind its u16 length, value behind its u32 length, time u64, a byte that tells a tombstone."""
    number = lambda x, digits: F.unhex(F.lpad(F.hex(x.cast("long")), digits, "0"))
    return F.concat(number(F.octet_length(key), 4), key.cast("binary"), number(F.octet_length(value), 8), value.cast("binary"), number(ts, 16), number(deleted.cast("int"), 2))


def memory_bytes(key: Column, value: Column) -> Column:
    return (F.octet_length(key) + F.octet_length(value) + MEMORY_HEAD).cast("long")


def record_bytes(op: Column, key: Column, value: Column, keys: Column, values: Column) -> Column:
    """Bytes of a log record: PUT holds key and value with their lengths, DELETE a key, BATCH_PUT a count and pairs."""
    pairs = F.aggregate(
        F.arrays_zip(keys.alias("k"), values.alias("v")),
        F.lit(4).cast("long"),
        lambda total, p: total + 6 + F.octet_length(p["k"]) + F.octet_length(p["v"]),
    )
    payload = F.when(op == "PUT", 6 + F.octet_length(key) + F.octet_length(value)).when(op == "DELETE", 2 + F.octet_length(key)).otherwise(pairs)
    return (payload + RECORD_HEAD).cast("long")


def js_text(value) -> str:
    """A JSON value as the text that is stored: numbers without a needless fraction, lower-case booleans.

    Objects and arrays have no text of their own and are refused.
    """
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    if isinstance(value, int | float | str):
        return str(value)
    raise TypeError(f"a value must be text, a number or a boolean, not {type(value).__name__}")
