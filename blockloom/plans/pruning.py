"""Which partition files can hold a row that a filter keeps.

A filter prunes if it depends on nothing but the block number. Such a filter is
evaluated on every number of every candidate partition, on the executors, so any
expression works: OR, floor, modulo, CASE. Pruning only leaves files out; the filter
itself is always applied to the rows as well.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SUBQUERY = re.compile(r"\bselect\b", re.I)
_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`")
#: Filters that differ from call to call (fixed list of such functions).
_UNSTABLE = re.compile(r"\b(?:rand|randn|random|uuid|monotonically_increasing_id|spark_partition_id|input_file_name|now|current_timestamp|current_date|localtimestamp|shuffle|randstr|uniform)\b", re.I)


def conjuncts(spark: SparkSession, text: str) -> list[str]:
    """The parts of a condition that are joined by AND at its top, by Spark's own parser."""
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
        out, todo = [], [tree]
        while todo:
            node = todo.pop()
            if node.getClass().getSimpleName() == "And":
                todo += [node.right(), node.left()]
            else:
                out.append(node.sql())
        return out
    except Exception:  # noqa: BLE001 - an expression whose parts cannot be printed stays whole
        return [text]


def _names(spark: SparkSession, text: str) -> set[str] | None:
    """The column names in a condition, in lower case; None if it does not parse or has a subquery."""
    try:
        todo, names = [spark._jsparkSession.sessionState().sqlParser().parseExpression(text)], set()
        while todo:
            node = todo.pop()
            kind = node.getClass().getSimpleName()
            if kind in ("ScalarSubquery", "Exists", "InSubquery", "ListQuery", "UnresolvedStar"):
                return None
            if kind == "UnresolvedAttribute":
                names.add(node.name().replace("`", "").lower())
            kids = node.children()
            todo += [kids.apply(i) for i in range(kids.size())]
        return names
    except Exception:  # noqa: BLE001 - what does not parse does not prune
        return None


def is_pruner(spark: SparkSession, text: str, column: str) -> bool:
    """Whether a condition depends on the block column alone; a constant one does too.

    It is tried on a one-column table. Subqueries and functions that differ from call
    to call are refused: when unsure, a filter does not prune.
    """
    bare = _QUOTED.sub(lambda m: m[0] if m[0][0] == "`" else "''", text)
    if _SUBQUERY.search(bare) or _UNSTABLE.search(bare):
        return False
    names = _names(spark, text)
    if names is None or names - {column.lower()}:
        return False
    try:
        tried = spark.range(0).select(F.col("id").alias(column)).filter(F.expr(text))
        return tried._jdf.queryExecution().analyzed().deterministic()
    except PySparkException:
        return False


def classify(spark: SparkSession, filters: Sequence[str], column: str) -> tuple[list[str], list[str]]:
    """(pruners, residual) of the filters' conjuncts."""
    parts = [c for f in filters for c in conjuncts(spark, f)]
    prune = [c for c in parts if is_pruner(spark, c, column)]
    return prune, [c for c in parts if c not in prune]


def simple_bounds(spark: SparkSession, pruners: Sequence[str], column: str) -> tuple[int, int]:
    """[low, high) outside which some pruner, a comparison of the column with a whole number, is false."""
    low, high = -(1 << 63), 1 << 63
    for text in pruners:
        found = re.fullmatch(r"\(*\s*`?(\w+)`?\s*(<=|>=|<|>|=|<=>)\s*(-?\d+)[lL]?\s*\)*", text.strip())
        if not found or found[1].lower() != column.lower():
            continue
        n = int(found[3])
        if found[2] in (">", ">=", "=", "<=>"):
            low = max(low, n + (found[2] == ">"))
        if found[2] in ("<", "<=", "=", "<=>"):
            high = min(high, n + (found[2] != "<"))
    return low, high


def surviving(spark: SparkSession, pruners: Sequence[str], column: str, bounds: Sequence[tuple[int, int]]) -> set[int]:
    """Lower bounds of the partitions [lower, upper) in which some number passes all pruners.

    Block numbers are tried that need not exist, so an arithmetic error can come from
    pruning alone; then every partition is kept.
    """
    if not pruners or not bounds:
        return {a for a, _ in bounds}
    low, high = simple_bounds(spark, pruners, column)
    # numbers beyond what plain comparisons allow need not be tried
    clipped = [(a, max(a, low), min(b, high)) for a, b in bounds]
    bounds = [(x, b) for _, x, b in clipped if b > x]
    if not bounds:
        return set()
    first = {x: a for a, x, b in clipped if b > x}
    spans = spark.createDataFrame([(a, b - 1) for a, b in bounds], "_lower bigint, _last bigint")
    tries = max(1, min(len(bounds), sum(b - a for a, b in bounds) // 1_000_000))
    numbers = spans.repartition(tries).select("_lower", F.explode(F.sequence("_lower", "_last")).alias(column))
    for p in pruners:
        numbers = numbers.filter(F.expr(p))
    try:
        return {first[r._lower] for r in numbers.select("_lower").distinct().collect()}
    except PySparkException:
        return set(first.values())


def merged(filters: Sequence[str]) -> str:
    """All filters as one condition; true if there are none."""
    return " AND ".join(["true", *[f"({f})" for f in filters]])


def kept(df: DataFrame, filters: Sequence[str]) -> DataFrame:
    """Rows that pass every filter."""
    for f in filters:
        df = df.filter(F.expr(f))
    return df
