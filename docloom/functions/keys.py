"""Canonical forms of keys that are written in more than one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import SPACE_CHARS


def uuid_hex(c: Column) -> Column:
    """32 lower-case hex digits of a UUID in any usual spelling (braces, urn, blanks, no hyphens).

    Null stays null. A value that is no UUID is kept, trimmed and lower-cased.
    """
    bare = F.regexp_replace(F.translate(F.lower(c), SPACE_CHARS + "{}-", ""), "^urn:uuid:", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare).otherwise(F.lower(F.btrim(c, F.lit(SPACE_CHARS))))


def uuid_text(hex_digits: Column) -> Column:
    """36 characters with hyphens, from ``uuid_hex``; anything else as it is."""
    parts = [F.substring(hex_digits, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(hex_digits.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts)).otherwise(hex_digits)
