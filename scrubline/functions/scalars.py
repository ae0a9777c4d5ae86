"""Scalar expressions: masking, ids, offsets, labels, trimming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the ECMAScript class \s matches, as the inside of a character class of Java and of Python.
SPACES = r" \t\n\x0B\f\r\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
BULLET = "•"


def mask(value: Column) -> Column:
    """All bullets up to length 4; else two letters, at most 8 bullets, two letters."""
    n = F.length(value)
    middle = F.repeat(F.lit(BULLET), F.least(F.lit(8), n - 4))
    return F.when(n <= 4, F.repeat(F.lit(BULLET), n)).otherwise(F.concat(F.substring(value, 1, 2), middle, F.right(value, F.lit(2))))


def utf16_length(value: Column) -> Column:
    """The length of a text in UTF-16 code units."""
    return (F.octet_length(F.encode(value, "UTF-16BE")) / 2).cast("int")


def finding_id(kind: Column, start: Column, value: Column) -> Column:
    """The first 16 hex digits of SHA-256 over type, NUL, start, NUL, value."""
    return F.substring(F.sha2(F.concat(kind, F.lit("\0"), start.cast("string"), F.lit("\0"), value), 256), 1, 16)


def trim(value: Column) -> Column:
    return F.regexp_replace(value, f"^[{SPACES}]+|[{SPACES}]+$", "")


def is_blank(value: Column) -> Column:
    """True for null and for nothing but white space."""
    return F.coalesce(trim(value) == "", F.lit(True))


def normalize_label(value: Column) -> Column:
    """Upper case; runs outside A-Z 0-9 _ - become one hyphen; none at the edges; SENSITIVE if nothing is left."""
    hyphens = F.regexp_replace(F.upper(value), "[^A-Z0-9_-]+", "-")
    bare = F.regexp_replace(hyphens, "^-+|-+$", "")
    return F.when(bare == "", "SENSITIVE").otherwise(bare)


def token(label: Column, ordinal: Column) -> Column:
    return F.format_string("【%s-%02d】", label, ordinal.cast("long"))


def safe_entry_name(name: Column) -> Column:
    """Whether an archive entry's name is relative, has no backslash and no parent segment."""
    return (name != "") & ~F.startswith(name, F.lit("/")) & ~F.contains(name, F.lit("\\")) & ~F.array_contains(F.split(name, "/"), "..")
