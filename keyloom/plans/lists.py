"""List queries: the event types of each user in order of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import hashes, lists as ls
from keyloom.plans.base import query
from keyloom.plans.fixtures import USER_LIST, user_list

POSITIONED = f"(SELECT key, value, idx, row_number() OVER (PARTITION BY key ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM {USER_LIST})"


def dense(rows):
    """Positions after a change, which make results comparable."""
    return ls.positioned(rows).select("key", F.col("pos").cast("long").alias("pos"), "value")


def dense_sql(rows):
    return f"SELECT key, row_number() OVER (PARTITION BY key ORDER BY idx) - 1 AS pos, value FROM ({rows})"


def pushed(t):
    """Two values for every user of even number, one of whom has no list."""
    users = t.events.where("user_id % 2 = 0").select("user_id").distinct().union(t.region.where("r_regionkey = 0").selectExpr("cast(999999 as bigint)"))
    return users.select(F.concat(F.lit("user:"), "user_id").alias("key"), F.posexplode(F.array(F.lit("a"), F.lit("b"))).alias("seq", "value"))


KEYS = "(SELECT DISTINCT 'user:' || user_id AS key FROM events WHERE user_id % 2 = 0{more})"


def push_sql(left, only_present):
    keys = KEYS.format(more="" if only_present else " UNION ALL SELECT 'user:999999'")
    order = [("a", -1), ("b", -2)] if left else [("a", 1e15), ("b", 2e15)]
    new = " UNION ALL ".join(f"SELECT key, CAST({i} AS DOUBLE) AS idx, '{v}' AS value FROM {keys}" for v, i in order)
    return dense_sql(f"SELECT key, idx, value FROM {USER_LIST} UNION ALL {new}")


def rotate(t):
    pairs = t.events.select(F.concat(F.lit("user:"), "user_id").alias("source"), F.concat(F.lit("user:"), F.col("user_id").bitwiseXOR(F.lit(1).cast("long"))).alias("target")).distinct()
    return dense(ls.move_last(user_list(t), pairs))


def pop_query(right):
    return lambda t: ls.pop(user_list(t), 2, right)[0].select("key", "idx", "value")


def remove(count):
    return lambda t: dense(ls.remove_equal(user_list(t), "click", count))


def remove_sql(count):
    way = "DESC" if count < 0 else "ASC"
    limit = abs(count) if count else 1 << 40
    return dense_sql(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY idx {way}) AS i FROM {USER_LIST}) WHERE value <> 'click' OR i > {limit}")


def insert_sql(after):
    way, step = ("min", ">") if after else ("max", "<")
    fallback = "a + 1" if after else "a - 1"
    return dense_sql(
        f"SELECT key, idx, value FROM {USER_LIST} UNION ALL SELECT p.key, (a + coalesce((SELECT {way}(idx) FROM {USER_LIST} l WHERE l.key = p.key AND l.idx {step} a), {fallback})) / 2, 'new' "
        f"FROM (SELECT key, min(idx) AS a FROM {USER_LIST} WHERE value = 'purchase' GROUP BY key) p"
    )


QUERIES = [
    query("llen", lambda t: user_list(t).groupBy("key").agg(F.count(F.lit(1)).alias("n")), f"SELECT key, count(*) AS n FROM {USER_LIST} GROUP BY key"),
    query("lpush", lambda t: dense(ls.push(user_list(t), pushed(t), left=True)), push_sql(True, False)),
    query("rpush", lambda t: dense(ls.push(user_list(t), pushed(t))), push_sql(False, False)),
    query("lpushx", lambda t: dense(ls.push(user_list(t), pushed(t), left=True, only_present=True)), push_sql(True, True)),
    query("rpushx", lambda t: dense(ls.push(user_list(t), pushed(t), only_present=True)), push_sql(False, True)),
    query("lpop", pop_query(False), f"SELECT key, idx, value FROM {POSITIONED} WHERE pos < 2"),
    query("rpop", pop_query(True), f"SELECT key, idx, value FROM {POSITIONED} WHERE pos >= n - 2"),
    query("rpoplpush", rotate, dense_sql(
        f"SELECT key, idx, value FROM {POSITIONED} WHERE pos < n - 1 OR 'user:' || xor(CAST(substr(key, 6) AS BIGINT), 1) IS NULL "
        f"UNION ALL SELECT 'user:' || xor(CAST(substr(key, 6) AS BIGINT), 1), -1, value FROM {POSITIONED} WHERE pos = n - 1")),
    query("lrange", lambda t: dense_range(t, 2, 5), f"SELECT key, pos, value FROM {POSITIONED} WHERE pos BETWEEN 2 AND 5"),
    query("lrange_back", lambda t: ls.lrange(user_list(t), -3, -2).select("key", "idx", "value"), f"SELECT key, idx, value FROM {POSITIONED} WHERE pos BETWEEN n - 3 AND n - 2"),
    query("lindex", lambda t: dense_range(t, 3, 3), f"SELECT key, pos, value FROM {POSITIONED} WHERE pos = 3"),
    query("lset", lambda t: dense(ls.replace_at(user_list(t), -1, "last")), f"SELECT key, pos, CASE WHEN pos = n - 1 THEN 'last' ELSE value END AS value FROM {POSITIONED}"),
    query("ltrim", lambda t: dense(ls.lrange(user_list(t), 1, -3).select("key", "idx", "value")), f"SELECT key, pos - 1 AS pos, value FROM {POSITIONED} WHERE pos BETWEEN 1 AND n - 3"),
    query("lrem", remove(2), remove_sql(2)),
    query("lrem_back", remove(-1), remove_sql(-1)),
    query("lrem_all", remove(0), remove_sql(0)),
    query("linsert_before", lambda t: dense(ls.insert(user_list(t), "purchase", "new")), insert_sql(False)),
    query("linsert_after", lambda t: dense(ls.insert(user_list(t), "purchase", "new", after=True)), insert_sql(True)),
    query("lsize", lambda t: hashes.byte_size(user_list(t), "value"), f"SELECT key, count(*) AS n, CAST(sum(octet_length(encode(value))) AS BIGINT) AS n_bytes FROM {USER_LIST} GROUP BY key"),
]


def dense_range(t, start, stop):
    return ls.lrange(user_list(t), start, stop).select("key", F.col("pos").cast("long").alias("pos"), "value")
