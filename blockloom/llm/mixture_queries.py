"""Mixing the archive's sources to target shares (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.mixture import MAX_LEAVES, VOCABULARY, Node, plan, select_prefixes, short, with_tokens
from blockloom.session import few, table, written

#: Domain of each source; sources not named belong to `mail`.
DOMAINS = {"newsletters": "bulk", "alerts": "bulk", "lists": "bulk"}


def _tokens(spark: SparkSession, base: str) -> DataFrame:
    """doc_id, source, lang, n_tokens: counted once and kept, for the plan and the choice both read it."""
    docs = table(spark, base, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang"), "text")
    return written(with_tokens(docs, ["doc_id", "source", "lang"], spark.conf.get("blockloom.vocabulary", VOCABULARY)), "tokens")


def _plan(spark: SparkSession, base: str, tokens: DataFrame) -> tuple[Node, int, dict[str, tuple[float, int]]]:
    sums = few(tokens.groupBy("source", "lang").agg(F.sum("n_tokens").alias("n")), MAX_LEAVES)
    rows = few(table(spark, base, "mix_targets").filter("source is not null"), MAX_LEAVES)
    targets = {r.source: (r.target_share or 0.0, r.max_repeats or 0) for r in rows}
    tree, total = plan(sorted((DOMAINS.get(r.source, "mail"), r.source, r.lang, r.n) for r in sums), targets)
    return tree, total, targets


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    """Sources of the leaves whose budget by weight is more than their repeats allow: those the tree found short."""
    tree, _, _ = _plan(spark, base, _tokens(spark, base))
    return spark.createDataFrame([(s,) for s in short(tree)], "source string")


def _mix(spark: SparkSession, base: str) -> tuple[DataFrame, dict[str, tuple[float, int]], int]:
    tokens = _tokens(spark, base)
    tree, total, targets = _plan(spark, base, tokens)
    sizes = {(r.source, r.lang): r.n for r in few(tokens.groupBy("source", "lang").agg(F.sum("n_tokens").alias("n")), MAX_LEAVES)}
    rows = [(f"{source}/{lang}", sizes[source, lang], float(leaf.budget)) for (_, lang, source), leaf in tree.leaves() if (source, lang) in sizes]
    budgets = spark.createDataFrame(rows, "leaf string, tokens bigint, budget double")
    return select_prefixes(tokens.withColumn("leaf", F.concat_ws("/", "source", "lang")), budgets), targets, total


def p9_mix(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base)[0].filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def p9_shares(spark: SparkSession, base: str) -> DataFrame:
    """Target and actual share of each source in the mix."""
    mix, targets, _ = _mix(spark, base)
    per = mix.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mix_tokens"), F.sum("n_tokens").alias("own_tokens"), F.max("copies").alias("most_repeats"))
    got = {r.source: r for r in few(per, MAX_LEAVES)}
    total = sum(r.mix_tokens for r in got.values()) or 1
    rows = []
    for source, (share, repeats) in targets.items():
        r = got.get(source)
        rows.append((source, share, (r.mix_tokens if r else 0) / total, repeats, r.most_repeats if r else 0, r.own_tokens if r else 0, r.mix_tokens if r else 0))
    return spark.createDataFrame(rows, "source string, target_share double, actual_share double, max_repeats bigint, most_repeats bigint, own_tokens bigint, mix_tokens bigint")


QUERIES = {"p9_found": p9_found, "p9_mix": p9_mix, "p9_shares": p9_shares}
# any tokenizer gives the same sources, so SQL counts runs of letters, digits and signs
ORACLE = {
    "p9_found": r"""
WITH n AS (SELECT source, sum(len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]+'))) t FROM documents GROUP BY 1)
SELECT m.source FROM mix_targets m LEFT JOIN n USING (source) WHERE m.max_repeats * coalesce(t, 0) < m.target_share * (SELECT sum(t) FROM n)""",
}
