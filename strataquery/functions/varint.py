"""Unsigned integers as bytes of seven bits, least significant first (LEB128), as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_varint(value: Column) -> Column:
    """The shortest encoding of a value of 0 or more as binary; null and negative values give null."""
    v = value.cast("bigint")
    size = F.greatest(F.lit(1), F.ceil((F.length(F.bin(v))) / 7)).cast("int")
    group = lambda i: F.call_function("shiftrightunsigned", v, 7 * i).bitwiseAND(F.lit(127))
    byte = lambda i: F.lpad(F.hex(F.when(i < size - 1, group(i).bitwiseOR(F.lit(128))).otherwise(group(i))), 2, "0")
    return F.when(v >= 0, F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), size - 1), byte), "")))


def decode_varint(encoded: Column) -> Column:
    """The value of an encoding; null if it is cut short, too long, or not the shortest one."""
    bytes_of = F.transform(F.regexp_extract_all(F.hex(encoded), F.lit(".{2}"), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("bigint"))
    value = F.aggregate(F.sequence(F.lit(1), F.size(bytes_of)), F.lit(0).cast("bigint"), lambda a, i: a + F.call_function("shiftleft", F.try_element_at(bytes_of, i).bitwiseAND(F.lit(127)), 7 * (i - 1)))
    whole = (F.length(encoded).between(1, 9)) & F.forall(F.slice(bytes_of, 1, F.size(bytes_of) - 1), lambda b: b >= 128) & (F.try_element_at(bytes_of, F.lit(-1)) < 128) & ((F.length(encoded) == 1) | (F.try_element_at(bytes_of, F.lit(-1)) > 0))
    return F.when(whole, value)
