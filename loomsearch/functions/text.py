"""Index-side tokens and other string functions, as Column expressions. Character classes are ASCII, lengths are bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longer words are dropped, measured before apostrophes go.
MAX_WORD_BYTES = 50
#: Words with one of these are dropped.
ENTITY_MARKS = ("&#", "&nbsp", "&lrm", "&rlm")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Non-empty words between space, tab, CR and LF."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "[ \t\r\n]+"), lambda w: w != "")


def lines(c: Column) -> Column:
    """Non-blank lines."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "\r?\n"), lambda w: F.trim(w) != "")


def clean_words(raw: Column) -> Column:
    """Of an array of raw words: entity apostrophes removed, long and entity words dropped, apostrophes removed, both ends trimmed."""
    raw = F.transform(raw, lambda w: F.replace(w, F.lit("&#039;"), F.lit("")))

    def good(w: Column) -> Column:
        ok = F.octet_length(w) <= MAX_WORD_BYTES
        for mark in ENTITY_MARKS:
            ok = ok & ~F.contains(w, F.lit(mark))
        return ok

    trimmed = F.transform(F.filter(raw, good), lambda w: F.regexp_replace(F.replace(w, F.lit("'"), F.lit("")), "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    return F.filter(trimmed, lambda w: w != "")


def split_hyphens(cleaned: Column) -> Column:
    """Parts between hyphens, empty ones dropped, in order."""
    return F.flatten(F.transform(cleaned, lambda w: F.filter(F.split(w, "-"), lambda p: p != "")))


def index_terms(raw: Column) -> Column:
    """The terms of an array of raw words, in order."""
    return F.transform(split_hyphens(clean_words(raw)), ascii_lower)


def terms(c: Column) -> Column:
    """The terms of a text, in order; a term's position is its place in the array."""
    return index_terms(words(c))


def is_ascii(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7F]")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def join_words(arr: Column, most: int | None = None) -> Column:
    return F.array_join(arr if most is None else F.slice(arr, 1, most), " ")


NAMED_ENTITIES = {
    "quot": '"', "apos": "'", "lsquo": "'", "rsquo": "'", "ldquo": "“", "rdquo": "”", "lt": "<", "gt": ">", "nbsp": " ", "ndash": "-", "mdash": "—",
    "hellip": "…", "bull": "•", "trade": "™", "copy": "©", "reg": "®", "deg": "°", "sect": "§", "para": "¶", "iexcl": "¡",
    "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "amp": "&"}


def decode_entities(c: Column) -> Column:
    """Named and numeric character references; unknown ones stay, numbers beyond Unicode vanish. A text is split at '&', so that results aren't decoded again."""
    parts = F.split(c, "&", -1)

    def one(p: Column) -> Column:
        body, rest = F.regexp_extract(p, "^([^;]*);", 1), F.regexp_replace(p, "^[^;]*;", "")
        hexa, deci = F.regexp_extract(body, "^#[xX]([0-9A-Fa-f]{1,7})", 1), F.regexp_extract(body, "^#([0-9]{1,8})", 1)
        code = F.when(hexa != "", F.conv(hexa, 16, 10).cast("int")).when(deci != "", deci.cast("int"))
        char = F.when((code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit(""))
        named = F.lit(None).cast("string")
        for name, value in NAMED_ENTITIES.items():
            named = F.when(body == name, F.lit(value)).otherwise(named)
        ended = p.rlike("^[^;]*;")
        return F.when(ended & F.startswith(body, F.lit("#")), F.concat(char, rest)).when(ended & named.isNotNull(), F.concat(named, rest)).otherwise(F.concat(F.lit("&"), p))

    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, 1 << 30), one), ""))
