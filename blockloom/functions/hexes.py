"""Hex spellings as Catalyst expressions.

A value may carry a leading ``0x`` or ``\\x`` and any letter case. All functions
here are built-in expressions, so they stay in code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_digits(col: Column) -> Column:
    """Lower-case digits without the prefix; null stays null."""
    low = F.lower(col)
    return F.when(F.substring(low, 1, 2).isin("0x", "\\x"), F.substring(low, 3, 1 << 30)).otherwise(low)


def address(col: Column) -> Column:
    """Canonical ``0x`` address; null and empty (also a bare prefix) are null."""
    digits = hex_digits(col)
    return F.when(F.length(digits) > 0, F.concat(F.lit("0x"), digits))


def tx_hash(col: Column) -> Column:
    """Canonical ``0x`` hash; null stays null."""
    return F.concat(F.lit("0x"), hex_digits(col))


def number_digits(col: Column) -> Column:
    """Digits of a hex number without leading zeros; zero is ``0``, empty is null."""
    digits = hex_digits(col)
    bare = F.ltrim(digits, F.lit("0"))
    return F.when(F.length(digits) > 0, F.when(F.length(bare) > 0, bare).otherwise(F.lit("0")))


def number_key(col: Column) -> Column:
    """Canonical ``0x`` spelling of a hex number, of any size."""
    return F.concat(F.lit("0x"), number_digits(col))


def number_long(col: Column) -> Column:
    """A hex number as bigint; null if it is no hex number below 16**15."""
    digits = number_digits(col)
    return F.when((F.length(digits) <= 15) & digits.rlike("^[0-9a-f]+$"), F.conv(digits, 16, 10).cast("bigint"))


def long_key(col: Column) -> Column:
    """The `number_key` spelling of a bigint."""
    return F.concat(F.lit("0x"), F.lower(F.hex(col)))


def bytes_key(col: Column) -> Column:
    """The `tx_hash` spelling of a binary value."""
    return F.concat(F.lit("0x"), F.lower(F.hex(col)))
