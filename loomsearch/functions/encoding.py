"""UTF-8 and UTF-16 functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower


def to_utf16(text: Column, big: bool = False, bom: bool = True) -> Column:
    """Bytes of a text in UTF-16, with a byte order mark unless told otherwise."""
    body = F.encode(text, "UTF-16BE" if big else "UTF-16LE")
    return F.concat(F.unhex(F.lit("FEFF" if big else "FFFE")), body) if bom else body


def from_utf16(data: Column) -> Column:
    """Text of UTF-16 bytes with a byte order mark; without one they are little-endian."""
    mark = F.hex(F.substring(data, 1, 2))
    rest = F.substring(data, 3, 1 << 30)
    return F.when(mark == "FEFF", F.decode(rest, "UTF-16BE")).when(mark == "FFFE", F.decode(rest, "UTF-16LE")).otherwise(F.decode(data, "UTF-16LE"))


def valid(data: Column) -> Column:
    return F.is_valid_utf8(data)


def repaired(data: Column) -> Column:
    """Malformed sequences become U+FFFD."""
    return F.make_valid_utf8(data)


def compare(a: Column, b: Column, most: int | None = None, fold: bool = False) -> Column:
    """-1, 0 or 1 by bytes; of the first ``most`` characters only; A-Z folded if asked for."""
    if most is not None:
        a, b = F.substring(a, 1, most), F.substring(b, 1, most)
    if fold:
        a, b = ascii_lower(a), ascii_lower(b)
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def char_class(c: Column) -> Column:
    """Of a character: space, control, punctuation or other, by ASCII."""
    return F.when(c.rlike("^[ \t\n\x0b\f\r]$"), "space").when(c.rlike("^[\\x00-\\x1f\\x7f]$"), "control").when(c.rlike("^[!-/:-@\\[-`{-~]$"), "punctuation").otherwise("other")


def char_lengths(text: Column) -> Column:
    """Bytes of each character, in order."""
    return F.transform(F.split(text, ""), lambda c: F.octet_length(c))
