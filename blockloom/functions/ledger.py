"""Conversions of ledger values, as built-in expressions wherever Spark has them.

Where a value cannot be converted the result is null; nothing here raises, also
under ANSI mode.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bare(col: Column) -> Column:
    """Without a leading 0x or \\x, if anything follows it."""
    return F.when(F.substring(col, 1, 2).isin("0x", "\\x") & (F.length(col) > 2), F.substring(col, 3, 1 << 30)).otherwise(col)


def decode_hex(col: Column) -> Column:
    """Bytes of a hex text; null for an odd length, a bad digit or a bare prefix."""
    bare = _bare(col)
    return F.when((F.length(bare) % 2 == 0) & bare.rlike("^[0-9a-fA-F]*$"), F.unhex(bare))


def hex_to_int(col: Column) -> Column:
    """An unsigned 64-bit hex number as decimal(20,0); null if it is none."""
    bare = _bare(col)
    digits = F.regexp_replace(bare, "^0+(?=.)", "")
    return F.when(bare.rlike("^[0-9a-fA-F]+$") & (F.length(digits) <= 16), F.conv(digits, 16, 10).cast("decimal(20,0)"))


def _limbs(col: Column) -> tuple[Column, Column]:
    bare = _bare(col)
    return F.regexp_replace(bare, "^0+(?=.)", ""), bare.rlike("^[0-9a-fA-F]+$")


def hex_to_double(col: Column) -> Column:
    """A hex number of up to 288 bits as the nearest double, ties to even; null if it is none.

    The first 64 bits are exact as a decimal; where any bit follows them their last one
    is set, which decides ties as the whole number would.
    """
    digits, good = _limbs(col)
    top = F.conv(F.substring(digits, 1, 16), 16, 10).cast("decimal(20,0)")
    more = F.substring(digits, 17, 1 << 30).rlike("[1-9a-fA-F]") & (top % 2 == 0)
    scale = F.element_at(F.array(*[F.lit(float(2 ** (4 * i))) for i in range(57)]), F.greatest(F.length(digits) - 15, F.lit(1)))
    return F.when(good & (F.length(digits) <= 72), (top + more.cast("int")).cast("double") * scale)


@F.pandas_udf(T.StringType())
def _big_decimal(hexes: pd.Series) -> pd.Series:
    return hexes.map(lambda h: str(int(h, 16)), na_action="ignore")


def hex_to_u256(col: Column) -> Column:
    """A hex number of any size as base-10 text; null if it is none.

    Up to 64 bits stay in the JVM; Spark has no wider integer than decimal(38), so
    only longer ones are converted in Arrow batches.
    """
    digits, good = _limbs(col)
    long_ = F.when(good & (F.length(digits) > 16), digits)
    return F.when(good, F.when(F.length(digits) <= 16, F.conv(digits, 16, 10)).otherwise(_big_decimal(long_)))


def topic(topics: Column, index: int) -> Column:
    """The 0-based topic as bytes; null beyond the list or if it is no hex."""
    return decode_hex(F.get(topics, F.lit(index)))


def epoch_to_ts(seconds: Column) -> Column:
    """Unix seconds as a timestamp without zone, whatever the session's zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def bytes_to_h(n: Column) -> Column:
    """A size for people: two decimals (ties to even) and B, KB, MB, GB, TB or PB in steps of 1024."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    out = F.lit(None).cast("string")
    for i in reversed(range(len(units))):
        text = F.format_string(f"%.2f{units[i]}", F.bround(n.cast("double") / float(1024**i), 2))
        out = text if i == len(units) - 1 else F.when(n < 1024 ** (i + 1), text).otherwise(out)
    return F.when(n.isNotNull(), out)


def json_add_key(doc: Column, key: str, value: Column) -> Column:
    """A JSON object with a key added or replaced, its keys in order and every other value as it was.

    Any other JSON, other text and null stay as they are. A null value becomes a JSON null.
    """
    parsed = F.try_parse_json(doc)
    fields = F.when(doc.rlike(r"^\s*\{"), parsed).cast("map<string,variant>")
    old = F.map_filter(fields, lambda k, _: k != key)
    added = F.coalesce(value.cast("variant"), F.parse_json(F.lit("null")))
    every = F.map_concat(old, F.create_map(F.lit(key), added))
    keys = F.array_sort(F.map_keys(every))
    return F.coalesce(F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(every, k)))), doc)


def register_current_block(spark: SparkSession, heads: dict[str, int]) -> None:
    """(Re)create the SQL function current_block(chain): the head frozen now; null for other chains.

    It is a SQL function over literals, so a call folds to a constant and a filter
    that uses it reaches the parquet scan.
    """
    for name in heads:
        if "'" in name or "\\" in name:
            raise ValueError(f"bad chain name {name!r}")
    known = ", ".join(f"'{name}', {int(head)}L" for name, head in heads.items() if head is not None)
    body = f"try_element_at(map({known}), chain)" if known else "CAST(NULL AS BIGINT)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION current_block(chain STRING) RETURNS BIGINT RETURN {body}")
