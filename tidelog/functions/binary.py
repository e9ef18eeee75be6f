"""Column expressions for the binary record layout and for unsigned arithmetic.

A record is a 4-byte length, an 8-byte offset and the payload, big-endian. All of
it is built-in expressions, so it stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes before a payload, and the largest payload and frame.
HEADER = 12
MAX_RECORD = 10 * 1024 * 1024


def big_endian(value: Column, width: int) -> Column:
    """A non-negative whole number as ``width`` bytes; null stays null."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * width, "0"))


def number_at(data: Column, start: Column | int, width: int) -> Column:
    """The unsigned number in ``width`` bytes from position ``start`` (from 0) on, as DECIMAL(20,0); null if the bytes end before."""
    start = F.lit(start) if isinstance(start, int) else start
    part = F.substring(data, start.cast("int") + 1, F.lit(width))
    return F.when(F.octet_length(part) == width, F.conv(F.hex(part), 16, 10).cast("decimal(20,0)"))


def signed_range(value: Column) -> Column:
    """A decoded unsigned number as LONG; null where it exceeds 2^63 - 1."""
    return F.when(value <= F.lit("9223372036854775807").cast("decimal(20,0)"), value.cast("long"))


def record_size(payload: Column) -> Column:
    """Bytes of a record: header and payload (bytes, not characters). A null payload counts as empty."""
    return (F.coalesce(F.octet_length(payload), F.lit(0)) + F.lit(HEADER)).cast("long")


def encode_record(offset: Column, payload: Column) -> Column:
    body = F.coalesce(payload, F.lit(b""))
    return F.concat(big_endian(F.octet_length(body), 4), big_endian(offset, 8), body)


def encode_key_value(key: Column, value: Column) -> Column:
    """Key length, key, value length, value; a null value (a tombstone) has length 0."""
    body = F.coalesce(value, F.lit(b""))
    return F.concat(big_endian(F.octet_length(key), 4), key, big_endian(F.octet_length(body), 4), body)


def decode_key_value(data: Column) -> Column:
    """STRUCT<key, value> of such a payload; value is null for a tombstone, the struct's fields are null if it is cut short."""
    k = number_at(data, 0, 4).try_cast("int")
    v = number_at(data, k + 4, 4).try_cast("int")
    fits = F.octet_length(data).cast("long") >= k.cast("long") + v + 8
    return F.struct(
        F.when(fits, F.substring(data, F.lit(5), k)).alias("key"),
        F.when(fits & (v > 0), F.substring(data, k + 9, v)).alias("value"),
    )


def saturating_minus(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0).cast("long"))


def segment_file_name(base: Column) -> Column:
    return F.format_string("%020d.log", base)


def fill_payload(offset: Column, size: int) -> Column:
    """``size`` bytes that all equal offset mod 256, the payload of benchmark logs."""
    return F.unhex(F.repeat(F.lpad(F.hex(F.pmod(offset, F.lit(256))), 2, "0"), size))


def valid_text(data: Column) -> Column:
    """The bytes as a string; null where they aren't UTF-8."""
    return F.try_validate_utf8(data.cast("string"))
