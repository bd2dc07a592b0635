"""References to records that do not exist, and what they pull down with them.

`find_orphans` checks every reference of every record (direct orphans), then walks
the foreign-key graph to a fixpoint: a record whose parent record is orphaned as a
whole is an inherited orphan, and so are its own children.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.session import written

#: Result of `find_orphans`.
ORPHANS = "child_table string, child_id bigint, ref string, status string, kind string, depth int"


@dataclass(frozen=True)
class Target:
    """Values that references of one kind may point to.

    key: canonical text of the value. gone: the rows name deleted values instead.
    """

    space: str
    df: DataFrame
    key: Column
    arrived: Column | None = None
    gone: bool = False


@dataclass(frozen=True)
class Records:
    """A child table: its id, its arrival and its references (name -> (space, key)).

    own: the (space, key) under which other tables refer to its rows, if they do.
    """

    name: str
    df: DataFrame
    id: Column
    arrived: Column
    refs: dict[str, tuple[str, Column]] = field(default_factory=dict)
    own: tuple[str, Column] | None = None


def _targets(targets: Sequence[Target]) -> DataFrame:
    """One row per (space, key): earliest arrival of a row, whether it is deleted."""
    parts = [
        t.df.select(
            F.lit(t.space).alias("space"),
            t.key.alias("key"),
            (F.lit(None) if t.gone or t.arrived is None else t.arrived).cast("timestamp_ntz").alias("arrived"),
            F.lit(not t.gone).alias("present"),
        ).filter("key is not null")
        for t in targets
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("space", "key").agg(
        F.min("arrived").alias("first_arrived"),
        F.max("present").alias("present"),
        F.max(~F.col("present")).alias("gone"),
    )


def _references(r: Records) -> DataFrame:
    """Long form: one row per record and non-null reference."""
    refs = F.array(*[F.struct(F.lit(n).alias("ref"), F.lit(s).alias("space"), k.alias("key")) for n, (s, k) in r.refs.items()])
    return r.df.select(F.lit(r.name).alias("child_table"), r.id.alias("child_id"), r.arrived.cast("timestamp_ntz").alias("child_arrived"), F.inline(refs)).filter("key is not null")


def direct_orphans(records: Sequence[Records], targets: Sequence[Target]) -> DataFrame:
    """Each reference whose target is deleted, missing or late.

    `deleted` wins over `missing`, `missing` over `late`; late means that every
    target row arrived after the child row. A null reference is none and gives no
    row; a null arrival on either side is never late. Repeated records (same id)
    each give their rows once. All references of all tables share one join, and
    the target side is aggregated to one row per value before it is shuffled; a
    value that many children share is split by the adaptive skew join.
    """
    refs = reduce(DataFrame.unionByName, [_references(r) for r in records])
    status = (
        F.when(F.col("gone"), "deleted")
        .when(F.col("present").isNull() | ~F.col("present"), "missing")
        .when(F.col("first_arrived") > F.col("child_arrived"), "late")
    )
    return (
        refs.join(_targets(targets), ["space", "key"], "left")
        .select("child_table", "child_id", "ref", status.alias("status"))
        .filter("status is not null")
    )


def find_orphans(spark: SparkSession, records: Sequence[Records], targets: Sequence[Target], broken: Sequence[str] = ("missing", "deleted")) -> DataFrame:
    """Direct and inherited orphans as `ORPHANS` rows.

    Only statuses in `broken` are inherited (a late parent exists by now). A parent
    record may have several rows; it is orphaned when all of them are. Each round
    semi-joins the children of the newest orphans and keeps those not yet known,
    until a round finds none; cycles therefore end too. depth is 0 for direct rows
    and the number of the round for inherited ones, whose status is `inherited`.
    Empty tables give no rows; columns beside those named are never read.
    """
    known = written(direct_orphans(records, targets).dropDuplicates(["child_table", "child_id", "ref"]).select("*", F.lit("direct").alias("kind"), F.lit(0).alias("depth")), "orphans")
    result = known
    parents = {r.own[0]: r for r in records if r.own}
    edges = [(child, ref, parents[space]) for child in records for ref, (space, _) in child.refs.items() if space in parents]
    newly = known.filter(F.col("status").isin(*broken)).select("child_table", "child_id").distinct()
    everyone = newly
    for depth in count(1):
        found = []
        for child, ref, parent in edges:
            def own(ids: DataFrame, parent: Records = parent) -> DataFrame:
                return ids.filter(F.col("child_table") == parent.name).select(F.col("child_id").alias("_id"))

            rows = parent.df.select(parent.id.alias("_id"), parent.own[1].alias("_key")).filter("_key is not null")
            # only the keys of rows that fell in the last round can have lost their last sound row
            touched = rows.join(own(newly), "_id", "left_semi").select("_key").distinct()
            sound = rows.join(touched, "_key", "left_semi").join(own(everyone), "_id", "left_anti").select("_key")
            keys = touched.join(sound, "_key", "left_anti")
            kids = child.df.select(child.id.alias("child_id"), child.refs[ref][1].alias("_key")).join(keys, "_key", "left_semi")
            found.append(kids.select(F.lit(child.name).alias("child_table"), "child_id", F.lit(ref).alias("ref")).distinct())
        if not found:
            break
        fresh = reduce(DataFrame.unionByName, found).join(result.select("child_table", "child_id", "ref"), ["child_table", "child_id", "ref"], "left_anti")
        fresh = written(fresh.select("*", F.lit("inherited").alias("status"), F.lit("inherited").alias("kind"), F.lit(depth).alias("depth")), "orphans")
        # records that refer to a parent are the only ones that pull others down
        parents_down = fresh.filter(F.col("child_table").isin(sorted({p.name for _, _, p in edges}))).select("child_table", "child_id")
        # written, as everyone would stand in its own plan twice, and the plan double with each round
        newly = written(parents_down.join(everyone, ["child_table", "child_id"], "left_anti").distinct(), "fallen")
        result = result.unionByName(fresh)
        if newly.isEmpty():
            break
        everyone = everyone.unionByName(newly)
        if depth % 20 == 0:  # else the plans grow with each round
            result, everyone = written(result, "orphans"), written(everyone, "fallen")
    return result


def orphan_report(orphans: DataFrame, records: Sequence[Records], period: str = "month") -> DataFrame:
    """Orphan references per child table, period of arrival, reference, status and kind."""
    arrivals = reduce(
        DataFrame.unionByName,
        [r.df.select(F.lit(r.name).alias("child_table"), r.id.alias("child_id"), F.date_trunc(period, r.arrived).cast("date").cast("string").alias("period")).distinct() for r in records],
    )
    return (
        orphans.join(arrivals, ["child_table", "child_id"])
        .groupBy("child_table", "period", "ref", "status", "kind")
        .agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("child_id").alias("n_records"))
    )
