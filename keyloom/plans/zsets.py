"""Sorted-set queries: customers of a nation by account balance, parts by size."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import hashes, keyspace as k, zsets as z
from keyloom.plans.base import query
from keyloom.plans.fixtures import NATION_ZSET, SIZE_ZSET, WRITES, nation_zset, size_zset, writes

UP, DOWN = "PARTITION BY key ORDER BY score, member", "PARTITION BY key ORDER BY score DESC, member DESC"
RANKED = f"(SELECT *, row_number() OVER ({UP}) - 1 AS rank, row_number() OVER ({DOWN}) - 1 AS back, count(*) OVER (PARTITION BY key) AS n FROM {NATION_ZSET})"
SIZES = f"(SELECT *, row_number() OVER ({UP}) - 1 AS rank, row_number() OVER ({DOWN}) - 1 AS back, count(*) OVER (PARTITION BY key) AS n FROM {SIZE_ZSET})"


def plain(rows):
    return rows.select("key", "member", "score")


def rank(rows):
    return rows.select("key", "member", "score", F.col("rank").cast("long").alias("rank"))


def by_type(t):
    """A sorted set per event type: users by the sum of their events' cents."""
    return writes(t).groupBy(F.concat(F.lit("z:"), "value").alias("key"), F.col("user_id").cast("string").alias("member")).agg(F.sum("cents").cast("double").alias("score"))


BY_TYPE = f"(SELECT 'z:' || value AS key, CAST(user_id AS VARCHAR) AS member, CAST(sum(cents) AS DOUBLE) AS score FROM {WRITES} GROUP BY 1, 2)"


def news(t):
    """Scores for customers of even number, twice each; half of them in a set of their own."""
    rows = t.customer.where("c_custkey % 2 = 0").select(F.concat(F.lit("nation:"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey")).otherwise(99)).alias("key"), F.col("c_custkey").cast("string").alias("member"), F.col("c_custkey"))
    return rows.select("key", "member", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.col("c_custkey").cast("double").alias("score")), F.struct(F.lit(2).alias("seq"), (F.col("c_custkey") + 0.5).cast("double").alias("score")))).alias("x")).select("key", "member", "x.seq", "x.score")


NEWS = "(SELECT 'nation:' || CASE WHEN c_custkey % 4 = 0 THEN c_nationkey ELSE 99 END AS key, CAST(c_custkey AS VARCHAR) AS member, CAST(c_custkey AS DOUBLE) AS first FROM customer WHERE c_custkey % 2 = 0)"


def upsert_sql(score, where="true"):
    return f"SELECT coalesce(z.key, n.key) AS key, coalesce(z.member, n.member) AS member, {score} AS score FROM {NATION_ZSET} z FULL JOIN {NEWS} n ON z.key = n.key AND z.member = n.member WHERE {where}"


def combined(how, keep_all=False):
    weights = {"z:view": 2.0, "z:click": 3.0, "z:error": -1.0}
    return lambda t: z.combine(by_type(t), weights, how, keep_all).select("member", "score")


def combined_sql(how, keep_all=False):
    w = "score * CASE key WHEN 'z:view' THEN 2.0 WHEN 'z:click' THEN 3.0 ELSE -1.0 END"
    return f"SELECT member, CAST({how}({w}) AS DOUBLE) AS score FROM {BY_TYPE} WHERE key IN ('z:view', 'z:click', 'z:error') GROUP BY member" + (" HAVING count(*) = 3" if keep_all else "")


SCORES = "score > 0 AND score <= 5000"
LEX = "member >= '1' AND member < '3'"


def scores():
    return z.in_scores(0, 5000, low_open=True)


def lex():
    return z.in_members("1", "3", high_open=True)


QUERIES = [
    query("zadd", lambda t: z.upsert(nation_zset(t), news(t))[0], upsert_sql("coalesce(n.first + 0.5, z.score)")),
    query("zadd_nx", lambda t: z.upsert(nation_zset(t), news(t), "nx")[0], upsert_sql("coalesce(z.score, n.first)")),
    query("zadd_xx", lambda t: z.upsert(nation_zset(t), news(t), "xx")[0], upsert_sql("coalesce(n.first + 0.5, z.score)", "z.key IS NOT NULL")),
    query("zadd_ch", lambda t: z.upsert(nation_zset(t), news(t))[1], f"SELECT key, CAST(sum(CAST(old IS NULL AS INTEGER)) AS BIGINT) AS added, CAST(sum(CASE WHEN old <> score THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM (SELECT z.score AS old, coalesce(z.key, n.key) AS key, coalesce(n.first + 0.5, z.score) AS score FROM {NATION_ZSET} z FULL JOIN {NEWS} n ON z.key = n.key AND z.member = n.member) GROUP BY key"),
    query("zincrby", lambda t: z.upsert(nation_zset(t), news(t), "incr")[0].withColumn("score", F.round("score", 4)), upsert_sql("round(coalesce(z.score, 0) + coalesce(2 * n.first + 0.5, 0), 4)")),
    query("zrem", lambda t: plain(nation_zset(t)).join(news(t).select("key", "member"), ["key", "member"], "left_anti"), f"SELECT z.* FROM {NATION_ZSET} z LEFT JOIN {NEWS} n ON z.key = n.key AND z.member = n.member WHERE n.key IS NULL"),
    query("zcard", lambda t: nation_zset(t).groupBy("key").agg(F.count(F.lit(1)).alias("n")), f"SELECT key, count(*) AS n FROM {NATION_ZSET} GROUP BY key"),
    query("zscore", lambda t: plain(nation_zset(t)).where("member = '17'"), f"SELECT * FROM {NATION_ZSET} WHERE member = '17'"),
    query("zrank", lambda t: rank(z.ranked(nation_zset(t))), f"SELECT key, member, score, rank FROM {RANKED}"),
    query("zrevrank", lambda t: rank(z.ranked(size_zset(t), reverse=True, large=True)), f"SELECT key, member, score, back AS rank FROM {SIZES}"),
    query("zcount", lambda t: nation_zset(t).groupBy("key").agg(F.count_if(scores()).alias("n")), f"SELECT key, count(*) FILTER ({SCORES}) AS n FROM {NATION_ZSET} GROUP BY key"),
    query("zlexcount", lambda t: nation_zset(t).groupBy("key").agg(F.count_if(lex()).alias("n")), f"SELECT key, count(*) FILTER ({LEX}) AS n FROM {NATION_ZSET} GROUP BY key"),
    query("zrange", lambda t: rank(z.zrange(nation_zset(t), 1, 4)), f"SELECT key, member, score, rank FROM {RANKED} WHERE rank BETWEEN 1 AND 4"),
    query("zrange_mixed", lambda t: rank(z.zrange(nation_zset(t), 2, -3)), f"SELECT key, member, score, rank FROM {RANKED} WHERE rank BETWEEN 2 AND n - 3"),
    query("zrange_back", lambda t: plain(z.zrange(size_zset(t), -5, -2)), f"SELECT key, member, score FROM {SIZES} WHERE rank BETWEEN n - 5 AND n - 2"),
    query("zrevrange", lambda t: rank(z.zrange(nation_zset(t), 0, 2, reverse=True)), f"SELECT key, member, score, back AS rank FROM {RANKED} WHERE back < 3"),
    query("zrangebyscore", lambda t: plain(z.range_by(nation_zset(t), scores(), offset=1, limit=3)), f"SELECT key, member, score FROM (SELECT *, row_number() OVER ({UP}) AS i FROM {NATION_ZSET} WHERE {SCORES}) WHERE i BETWEEN 2 AND 4"),
    query("zrevrangebyscore", lambda t: plain(z.range_by(nation_zset(t), scores(), reverse=True, limit=2)), f"SELECT key, member, score FROM (SELECT *, row_number() OVER ({DOWN}) AS i FROM {NATION_ZSET} WHERE {SCORES}) WHERE i <= 2"),
    query("zrangebylex", lambda t: plain(z.range_by(size_zset(t), lex(), limit=10)), f"SELECT key, member, score FROM (SELECT *, row_number() OVER ({UP}) AS i FROM {SIZE_ZSET} WHERE {LEX}) WHERE i <= 10"),
    query("zrevrangebylex", lambda t: plain(z.range_by(size_zset(t), lex(), reverse=True, offset=2, limit=10)), f"SELECT key, member, score FROM (SELECT *, row_number() OVER ({DOWN}) AS i FROM {SIZE_ZSET} WHERE {LEX}) WHERE i BETWEEN 3 AND 12"),
    query("zremrangebyrank", lambda t: plain(z.ranked(nation_zset(t)).where("NOT rank BETWEEN 0 AND 2")), f"SELECT key, member, score FROM {RANKED} WHERE rank > 2"),
    query("zremrangebyscore", lambda t: plain(nation_zset(t).where(~scores())), f"SELECT * FROM {NATION_ZSET} WHERE NOT ({SCORES})"),
    query("zremrangebylex", lambda t: plain(nation_zset(t).where(~lex())), f"SELECT * FROM {NATION_ZSET} WHERE NOT ({LEX})"),
    query("zunionstore", combined("sum"), combined_sql("sum")),
    query("zunionstore_max", combined("max"), combined_sql("max")),
    query("zinterstore", combined("sum", True), combined_sql("sum", True)),
    query("zinterstore_min", combined("min", True), combined_sql("min", True)),
    query("zscan", lambda t: k.scan(plain(nation_zset(t)).where("key = 'nation:3'"), "member", "1", 10, k.matches(F.col("member"), "*1*")).select("key", "member", "score", "cursor"),
          f"WITH q AS (SELECT *, row_number() OVER (ORDER BY member) AS i, count(*) OVER () AS n FROM {NATION_ZSET} WHERE key = 'nation:3' AND member > '1' AND member LIKE '%1%') SELECT key, member, score, CASE WHEN n > 10 THEN (SELECT max(member) FROM q WHERE i <= 10) END AS cursor FROM q WHERE i <= 10"),
    query("zscanbyscore", lambda t: plain(z.range_by(nation_zset(t), z.in_scores(1000.0), limit=5)), f"SELECT key, member, score FROM (SELECT *, row_number() OVER ({UP}) AS i FROM {NATION_ZSET} WHERE score >= 1000) WHERE i <= 5"),
    query("zsize", lambda t: hashes.byte_size(nation_zset(t), "member"), f"SELECT key, count(*) AS n, CAST(sum(octet_length(encode(member))) AS BIGINT) AS n_bytes FROM {NATION_ZSET} GROUP BY key"),
]
