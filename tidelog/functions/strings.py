"""Byte-string functions of keys and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by unsigned bytes, a prefix first."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def byte_length(s: Column) -> Column:
    return F.octet_length(s)


def append(a: Column, *more: Column) -> Column:
    return F.concat(a, *more)


def char_at(s: Column, i: Column) -> Column:
    """The character at a place from 0; beyond the text it raises, as element_at does."""
    return F.element_at(F.split(s, ""), i + 1)


def first_token(s: Column) -> Column:
    """The first run without white space; empty if there is none."""
    return F.regexp_extract(s, r"(\S+)", 1)


def first_difference(a: Column, b: Column) -> Column:
    """The place of the first character that differs, counted from 0; null if the strings are equal."""
    shorter = F.least(F.length(a), F.length(b))
    places = F.filter(F.sequence(F.lit(0), shorter), lambda i: ~F.substring(a, i + 1, F.lit(1)).eqNullSafe(F.substring(b, i + 1, F.lit(1))))
    return F.when(a != b, F.get(places, F.lit(0)))


def byte_at(s: Column, i: int) -> Column:
    """The byte at a place from 0, as a number; null beyond the text."""
    two = F.substring(F.hex(F.encode(s, "UTF-8")), 2 * i + 1, 2)
    return F.when(two != "", F.conv(two, 16, 10).cast("int"))


def first_differing_byte(a: Column, b: Column) -> Column:
    """The place of the first byte that differs, counted from 0; null if the strings are equal."""
    x, y = (F.hex(F.encode(s, "UTF-8")) for s in (a, b))
    places = F.sequence(F.lit(0), F.least(F.octet_length(a), F.octet_length(b)))
    other = F.filter(places, lambda i: F.substring(x, 2 * i + 1, F.lit(2)) != F.substring(y, 2 * i + 1, F.lit(2)))
    return F.when(a != b, F.get(other, F.lit(0)))


def common_prefix(a: Column, b: Column) -> Column:
    """The longest common prefix of two strings."""
    return F.when(a == b, a).otherwise(F.substring(a, F.lit(1), first_difference(a, b)))


def number_from(s: Column) -> Column:
    """A decimal number, null where the text is none."""
    return s.try_cast("bigint")


def padded_key(prefix: str, number: Column, width: int = 8) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))
