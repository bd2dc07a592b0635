"""Relational operators that the engine leaves to Spark SQL, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from blockloom.session import scratch_path, table
from blockloom.sources.storage import location_parts


def _sql(text: str, *names: str):
    """A query in Spark SQL over views of the named tables."""

    def run(spark: SparkSession, base: str) -> DataFrame:
        for n in names:
            table(spark, base, n).createOrReplaceTempView(n)
        return spark.sql(text)

    return run


def _join(how: str):
    """Customers and their orders by key, summed per segment and status."""

    def run(spark: SparkSession, base: str) -> DataFrame:
        c = table(spark, base, "customer").filter("c_acctbal > 0")
        o = table(spark, base, "orders").filter("o_orderstatus <> 'P'")
        j = c.join(o, c.c_custkey == o.o_custkey, how)
        if how in ("left_semi", "left_anti"):
            return j.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
        return j.groupBy("c_mktsegment", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count("o_orderkey").alias("n_orders"), F.countDistinct("c_custkey").alias("n_customers"))

    return run


def join_range(spark: SparkSession, base: str) -> DataFrame:
    """Suppliers and parts whose price lies in the supplier's band, by band and no pairs beyond it.

    The band key makes it an equi-join; the comparison inside a band stays exact.
    """
    width = 50.0
    s = table(spark, base, "supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("low")).filter("low > 0").withColumn("high", F.col("low") + width)
    s = s.withColumn("band", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    p = table(spark, base, "part").select("p_partkey", "p_retailprice").withColumn("band", F.floor(F.col("p_retailprice") / width))
    return p.join(s, "band").filter("p_retailprice >= low AND p_retailprice < high").groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n_suppliers"))


def join_cross(spark: SparkSession, base: str) -> DataFrame:
    """Both sides of a cross join are tables of fixed size here."""
    n, r = table(spark, base, "nation"), table(spark, base, "region")
    return n.crossJoin(r).select("n_name", "r_name", (F.col("n_regionkey") == F.col("r_regionkey")).alias("own"))


def agg_approx(spark: SparkSession, base: str) -> DataFrame:
    """Approximate aggregates beside the exact ones, and whether they are within their error: 3 standard errors of 2 %, and a rank within 1 %."""
    rows = table(spark, base, "lineitem")
    got = rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("approx"), F.countDistinct("l_orderkey").alias("n_orders"), F.percentile_approx("l_quantity", 0.5, 100).alias("middle"), F.count(F.lit(1)).alias("n"))
    below = rows.join(got.select("l_returnflag", "middle"), "l_returnflag").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") < F.col("middle")).alias("lower"), F.count_if(F.col("l_quantity") <= F.col("middle")).alias("upper"))
    near = F.abs(F.col("approx") / F.col("n_orders") - 1) <= 0.06
    ranked = (F.col("lower") <= 0.51 * F.col("n")) & (F.col("upper") >= 0.49 * F.col("n"))
    return got.join(below, "l_returnflag").select("l_returnflag", "n_orders", near.alias("near"), ranked.alias("ranked"))


def sinks(spark: SparkSession, base: str) -> DataFrame:
    """One table through every file format and back."""
    df = table(spark, base, "customer").select("c_custkey", "c_name", "c_mktsegment")
    out = scratch_path(spark, "sinks")
    parts = []
    for form, options in (("parquet", {}), ("orc", {}), ("json", {}), ("csv", {"header": "true"})):
        df.write.format(form).options(**options).save(f"{out}/{form}")
        back = spark.read.format(form).schema(df.schema).options(**options).load(f"{out}/{form}")
        parts.append(back.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys")).select(F.lit(form).alias("form"), "*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def locations(spark: SparkSession, base: str) -> DataFrame:
    """Scheme and path of every manifest location, by expression; checked against the value type in tests."""
    scheme, _, path = location_parts(F.col("location"))
    return table(spark, base, "block_partitions").select("entry_id", scheme.alias("scheme"), F.concat(F.lit("/"), path).alias("path"))


def table_union(spark: SparkSession, base: str) -> DataFrame:
    a = table(spark, base, "txns").select(F.col("ingested_at").cast("date").alias("day"))
    b = table(spark, base, "logs").select(F.col("ingested_at").cast("date").alias("day"))
    return a.unionByName(b).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


def win_frame(spark: SparkSession, base: str) -> DataFrame:
    """Per customer: rows-framed and range-framed sums of order keys."""
    by = W.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, base, "orders").select("o_orderkey", F.sum("o_orderkey").over(by.rowsBetween(-2, 0)).alias("last3"), F.count(F.lit(1)).over(by.rangeBetween(-1000, 1000)).alias("near"))


_JOIN = "SELECT c_mktsegment, o_orderstatus, count(*) n, count(o_orderkey) n_orders, count(DISTINCT c_custkey) n_customers FROM (SELECT * FROM customer WHERE c_acctbal > 0) c {} JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON c_custkey = o_custkey GROUP BY 1, 2"

# text that both engines read alike
_SAME: dict[str, tuple[str, tuple[str, ...]]] = {
    "project_cols": ("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, l_shipdate FROM lineitem", ("lineitem",)),
    "case_expr": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS level, coalesce(nullif(o_orderstatus, 'P'), '-') AS status FROM orders", ("orders",)),
    "agg_group": ("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS price, min(l_discount) AS low, max(l_tax) AS high FROM lineitem GROUP BY l_returnflag, l_linestatus", ("lineitem",)),
    "agg_having": ("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 500 AND max(l_quantity) >= 50", ("lineitem",)),
    "agg_distinct": ("SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_priorities, count(DISTINCT o_orderstatus) AS n_statuses FROM orders GROUP BY o_custkey", ("orders",)),
    "agg_cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", ("lineitem",)),
    "agg_rollup": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", ("orders",)),
    "agg_gsets": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", ("orders",)),
    "win_rank": ("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rnk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS dense, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS quart FROM orders", ("orders",)),
    "win_lag": ("SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_type, 1, 'none') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type, first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_id FROM events", ("events",)),
    "sort_nulls": ("SELECT log_id, row_number() OVER (PARTITION BY block_number ORDER BY topic3 DESC NULLS LAST, topic2 ASC NULLS FIRST, log_id) AS place FROM logs", ("logs",)),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", ("orders",)),
    "page_offset": ("SELECT lower_bound, entry_id FROM block_partitions ORDER BY lower_bound, entry_id LIMIT 64 OFFSET 64", ("block_partitions",)),
    "set_union": ("SELECT number AS n FROM blocks UNION SELECT block_number FROM logs", ("blocks", "logs")),
    "set_union_all": ("SELECT s_nationkey AS k, 's' AS side FROM supplier UNION ALL SELECT c_nationkey, 'c' FROM customer", ("supplier", "customer")),
    "set_intersect": ("SELECT number AS n FROM blocks INTERSECT SELECT block_number FROM logs", ("blocks", "logs")),
    "set_except": ("SELECT block_number AS n FROM logs EXCEPT SELECT number FROM blocks", ("blocks", "logs")),
    "subq_scalar": ("SELECT o_orderkey, o_totalprice - (SELECT max(o_totalprice) FROM orders) AS below FROM orders", ("orders",)),
    "subq_in": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)", ("customer", "orders")),
    "subq_exists": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", ("customer", "orders")),
    "subq_correlated": ("SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c", ("customer", "orders")),
    "cte": ("WITH per AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT max(n) AS m FROM per) SELECT o_custkey, n FROM per JOIN top ON per.n = top.m", ("orders",)),
    "str_funcs": ("SELECT p_partkey, upper(p_name) AS up, length(p_name) AS len, substring(p_brand, 1, 3) AS head, replace(p_type, ' ', '_') AS under, trim(concat('  ', p_brand, ' ')) AS trimmed, p_name LIKE '%a%' AS has_a, p_type ILIKE '%STEEL%' AS steel, reverse(p_brand) AS back, lpad(p_brand, 12, '*') AS padded, md5(p_name) AS digest FROM part", ("part",)),
    "math_funcs": ("SELECT l_orderkey, l_linenumber, floor(l_quantity / 7) AS fl, ceil(l_quantity / 7) AS ce, abs(l_discount - 0.05) AS ab, l_orderkey % 7 AS md, sign(l_tax - 0.04) AS sg, sqrt(l_quantity) AS sq, greatest(l_discount, l_tax) AS gr, least(l_discount, l_tax) AS le FROM lineitem", ("lineitem",)),
    "date_funcs": ("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q, day(o_orderdate) AS d, date_trunc('month', o_orderdate) AS month_start, CAST(o_orderdate AS DATE) AS day FROM orders", ("orders",)),
    "is_funcs": ("SELECT txn_id, tx_type IS NULL AS no_type, (to_addr = '0x') IS TRUE AS bare, (to_addr = '0x') IS NOT FALSE AS not_other, tx_type IS DISTINCT FROM '0x2' AS other FROM txns", ("txns",)),
    "join_equi_multi": ("SELECT n_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity > 10 GROUP BY n_name", ("lineitem", "orders", "customer", "nation")),
}

QUERIES = {name: _sql(text, *tables) for name, (text, tables) in _SAME.items()} | {
    "join_inner": _join("inner"),
    "join_left": _join("left"),
    "join_right": _join("right"),
    "join_full": _join("full"),
    "join_semi": _join("left_semi"),
    "join_anti": _join("left_anti"),
    "join_cross": join_cross,
    "join_range": join_range,
    "win_frame": win_frame,
    "table_union": table_union,
    "agg_approx": agg_approx,
    "sinks": sinks,
    "locations": locations,
    "cast_expr": _sql("SELECT txn_id, try_cast(gas AS BIGINT) AS as_number, CAST(txn_id AS STRING) AS as_text, CAST(ingested_at AS DATE) AS as_day FROM txns", "txns"),
    "json_get": _sql("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "events"),
    "date_bin": _sql("SELECT window(ts, '15 minutes').start AS bin, count(*) AS n FROM events GROUP BY 1", "events"),
    "str_regex": _sql("SELECT p_partkey, regexp_extract(p_name, '([a-z]+)', 1) AS word, instr(p_name, 'a') AS place, lower(hex(p_partkey)) AS hexed, sha2(p_name, 256) AS digest FROM part", "part"),
    "int_division": _sql("SELECT l_orderkey, l_linenumber, l_orderkey div 7 AS d FROM lineitem", "lineitem"),
}
ORACLE = {name: text for name, (text, _) in _SAME.items()} | {
    **{f"join_{k}": _JOIN.format(v) for k, v in (("inner", ""), ("left", "LEFT"), ("right", "RIGHT"), ("full", "FULL"))},
    "join_semi": "SELECT c_mktsegment, count(*) n FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1",
    "join_anti": "SELECT c_mktsegment, count(*) n FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1",
    "join_cross": "SELECT n_name, r_name, n_regionkey = r_regionkey AS own FROM nation CROSS JOIN region",
    "join_range": "SELECT p_partkey, count(*) n_suppliers FROM part JOIN (SELECT round(s_acctbal, 2) low FROM supplier) s ON low > 0 AND p_retailprice >= low AND p_retailprice < low + 50.0 GROUP BY 1",
    "agg_approx": "SELECT l_returnflag, count(DISTINCT l_orderkey) n_orders, true AS near, true AS ranked FROM lineitem GROUP BY 1",
    "win_frame": "SELECT o_orderkey, (sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))::BIGINT last3, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) near FROM orders",
    "table_union": "SELECT day, count(*) n FROM (SELECT ingested_at::DATE AS day FROM txns UNION ALL SELECT ingested_at::DATE FROM logs) GROUP BY 1",
    "sinks": "SELECT form, c_mktsegment, count(*) n, sum(c_custkey)::BIGINT keys FROM customer, (SELECT unnest(['parquet', 'orc', 'json', 'csv']) form) GROUP BY 1, 2",
    "locations": "SELECT entry_id, split_part(location, '://', 1) scheme, '/' || regexp_extract(location, '^[a-z0-9]+://[^/]*/(.*)$', 1) path FROM block_partitions",
    "cast_expr": "SELECT txn_id, CASE WHEN gas NOT LIKE '0%x%' THEN TRY_CAST(gas AS BIGINT) END as_number, txn_id::VARCHAR as_text, ingested_at::DATE as_day FROM txns",
    "json_get": "SELECT event_id, (props->>'$.k')::BIGINT k FROM events",
    "date_bin": "SELECT time_bucket(INTERVAL '15 minutes', ts) bin, count(*) n FROM events GROUP BY 1",
    "str_regex": "SELECT p_partkey, regexp_extract(p_name, '([a-z]+)', 1) word, strpos(p_name, 'a')::INT place, lower(to_hex(p_partkey)) hexed, sha256(p_name) digest FROM part",
    "int_division": "SELECT l_orderkey, l_linenumber, l_orderkey // 7 d FROM lineitem",
}
