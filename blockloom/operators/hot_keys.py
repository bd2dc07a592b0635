"""A few keys holding most records: per-key results without long tasks.

`segment_pairs` needs each key's rows in order; it cuts a key's rows into segments of
the order's range and lends the rows at a border to the next segment.
`eager_join` is an aggregate over a join; it aggregates both inputs by the join key
before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def segment_pairs(rows: DataFrame, max_gap: int = 3, segment: int = 256) -> DataFrame:
    """Row ids whose direct predecessor of the same key has the same mark and a position at most `max_gap` lower; see `marked_pairs`."""
    return marked_pairs(rows, max_gap, segment).filter("found").select("id")


def marked_pairs(rows: DataFrame, max_gap: int = 3, segment: int = 256) -> DataFrame:
    """key, id, found of every row: whether its direct predecessor of the same key has the same mark and a position at most `max_gap` lower.

    rows: `key, pos bigint, sub bigint, id string, mark string`; further columns are
    not read. Rows of one key are ordered by pos, sub and id; repeated rows (same id)
    count once; rows with a null key, pos or id are left out; a null mark equals none;
    a null sub comes first. Needs `max_gap < segment`.

    Each key is cut into segments of `segment` positions, whose rows are sorted
    within one task: a key holding a third of all rows is spread over all segments.
    A predecessor across a border lies within `max_gap` of it, so the rows there are
    also lent to the next segment, where they are only looked back at. One shuffle
    and one sort do it; `max_gap / segment` of the rows travel twice.
    """
    if not 0 <= max_gap < segment:
        raise ValueError("max_gap must be below segment")
    seg = F.expr(f"(pos - pmod(pos, {segment}L)) div {segment}L")
    lent = F.expr(f"pmod(pos, {segment}L)") >= segment - max_gap
    places = F.array(F.struct(seg.alias("seg"), F.lit(False).alias("lent")), F.when(lent, F.struct((seg + 1).alias("seg"), F.lit(True).alias("lent"))))
    rows = rows.select("key", "pos", "sub", "id", "mark").filter("key is not null and pos is not null and id is not null").select("*", F.inline(F.array_compact(places)))
    inside = W.partitionBy("key", "seg").orderBy("pos", "sub", "id")
    once = rows.withColumn("_same", F.lag("id").over(inside)).filter("_same is null or _same <> id")
    near = once.select("key", "id", "pos", "mark", "lent", F.lag("pos").over(inside).alias("_pos"), F.lag("mark").over(inside).alias("_mark"))
    found = (F.col("_mark") == F.col("mark")) & (F.col("pos") - F.col("_pos") <= max_gap)
    return near.filter(~F.col("lent")).select("key", "id", F.coalesce(found, F.lit(False)).alias("found"))


def eager_join(left: DataFrame, right: DataFrame, key: str, left_sums: dict[str, Column], right_sums: dict[str, Column]) -> DataFrame:
    """COUNT and SUMs over `left LEFT JOIN right USING (key)` per key of left, without forming the pairs.

    Both inputs are first aggregated by the key (partially before the shuffle, so a
    key holding most rows sends one row per task), then the states are joined and
    combined: n_pairs is the product of the counts, and each sum counts once per
    partner. Result: key, n_left, n_right, n_pairs, then the sums by name. A key
    without partner has n_right and n_pairs 0 and zero sums. Null keys are left out;
    null values add nothing; a sum over nulls only is 0.
    """
    zero = F.lit(0)
    a = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_left"), *[F.coalesce(F.sum(c), zero).alias(n) for n, c in left_sums.items()])
    b = right.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_right"), *[F.sum(c).alias(n) for n, c in right_sums.items()])
    n_right = F.coalesce("n_right", zero)

    def wide(x: Column, y: Column) -> Column:
        return x.cast("decimal(20,0)") * y.cast("decimal(18,0)")

    return a.join(b, key, "left").select(
        key, "n_left", n_right.alias("n_right"), wide(F.col("n_left"), n_right).alias("n_pairs"),
        *[wide(F.col(n), n_right).alias(n) for n in left_sums], *[wide(F.coalesce(n, zero), F.col("n_left")).alias(n) for n in right_sums],
    )


def rollup_pairs(per_key: DataFrame, group: Column, sums: list[str]) -> DataFrame:
    """Roll the joined states up to a coarser group."""
    return per_key.groupBy(group.alias("grp")).agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n_pairs").alias("n_pairs"), *[F.sum(s).alias(s) for s in sums])
