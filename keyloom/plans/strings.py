"""String and counter queries: part names, and a command log with one write per event."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import strings as s
from keyloom.plans.base import query
from keyloom.plans.fixtures import NOW_MS, PART_NAMES, WRITES, part_names, writes

KINDS_SQL = "CASE value WHEN 'signup' THEN 'nx' WHEN 'error' THEN 'xx' WHEN 'click' THEN 'del' ELSE 'set' END"


def kinds(log):
    kind = F.when(F.col("value") == "signup", "nx").when(F.col("value") == "error", "xx").when(F.col("value") == "click", "del").otherwise("set")
    return log.withColumn("kind", kind).withColumn("value", F.col("cents").cast("string"))


def versioned(log):
    """Writes whose version is right only now and then."""
    return log.withColumn("version", F.col("seq") % 3)


def absent(t):
    """New names for all parts of even number and for as many keys that no part has; only the latter may be written."""
    new = t.part.where("p_partkey % 2 = 0").select(
        F.explode(F.array(F.concat(F.lit("part:"), "p_partkey"), F.concat(F.lit("part:x"), "p_partkey"))).alias("key"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("value")
    )
    return s.set_if_absent(part_names(t), new)


ABSENT = "SELECT 'part:x' || p_partkey AS key, p_brand AS value FROM part WHERE p_partkey % 2 = 0"


def timed(seconds, column):
    def plan(t):
        return s.last_write(writes(t), "value", "ts_ms").select("key", "value", (F.col("ts_ms") + seconds * 1000).alias(column))

    return plan


def timed_sql(seconds, column):
    return f"SELECT key, arg_max(value, seq) AS value, arg_max(ts_ms, seq) + {seconds * 1000} AS {column} FROM {WRITES} GROUP BY key"


def counted(delta):
    return lambda t: s.count_up(writes(t), F.lit(delta)).select("key", "seq", "counter")


def counted_sql(delta):
    return f"SELECT key, seq, CAST(sum({delta}) OVER (PARTITION BY key ORDER BY seq) AS BIGINT) AS counter FROM {WRITES}"


def msetnx(t):
    """Statements of two keys each; one is carried out only if neither exists."""
    asked = t.part.select(F.col("p_partkey").alias("stmt"), F.explode(F.array(F.concat(F.lit("part:"), F.col("p_partkey") * 2), F.concat(F.lit("new:"), "p_partkey"))).alias("key"))
    hit = asked.join(part_names(t).select("key"), "key", "left_semi").select("stmt").distinct()
    return asked.join(hit, "stmt", "left_anti").select("stmt", "key")


def mget(t):
    asked = t.part.select("p_partkey").withColumn("_k", F.array(F.concat(F.lit("part:"), "p_partkey"), F.concat(F.lit("part:x"), "p_partkey"), F.concat(F.lit("part:"), F.col("p_partkey") + 1)))
    asked = asked.select("p_partkey", F.posexplode("_k").alias("pos", "key"))
    return asked.join(part_names(t).select("key", "value"), "key", "left").select("p_partkey", "pos", "key", "value")


INCREX_SQL = f"""
WITH RECURSIVE e AS (SELECT key, ts_ms, row_number() OVER (PARTITION BY key ORDER BY ts_ms, seq) AS i FROM {WRITES}),
w AS (
  SELECT key, i, ts_ms AS opened_ms FROM e WHERE i = 1
  UNION ALL
  SELECT e.key, e.i, CASE WHEN e.ts_ms < w.opened_ms + 3600000 THEN w.opened_ms ELSE e.ts_ms END FROM w JOIN e ON e.key = w.key AND e.i = w.i + 1
)
SELECT key, opened_ms, count(*) AS counter FROM w GROUP BY key, opened_ms
"""

CAS_SQL = f"""
WITH RECURSIVE e AS (SELECT key, seq % 3 AS version, value, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM {WRITES}),
w AS (
  SELECT key, i, version + 1 AS version, value, CAST(1 AS BIGINT) AS accepted FROM e WHERE i = 1
  UNION ALL
  SELECT e.key, e.i, CASE WHEN e.version = w.version THEN e.version + 1 ELSE w.version END,
    CASE WHEN e.version = w.version THEN e.value ELSE w.value END, w.accepted + CASE WHEN e.version = w.version THEN 1 ELSE 0 END
  FROM w JOIN e ON e.key = w.key AND e.i = w.i + 1
)
SELECT key, arg_max(version, i) AS version, arg_max(value, i) AS value, arg_max(accepted, i) AS accepted FROM w GROUP BY key
"""

SET_SQL = f"""
WITH RECURSIVE e AS (SELECT key, {KINDS_SQL} AS kind, CAST(cents AS VARCHAR) AS value, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM {WRITES}),
w AS (
  SELECT key, i, CASE WHEN kind IN ('set', 'nx') THEN value END AS value FROM e WHERE i = 1
  UNION ALL
  SELECT e.key, e.i, CASE WHEN (kind = 'nx' AND w.value IS NOT NULL) OR (kind = 'xx' AND w.value IS NULL) THEN w.value WHEN kind = 'del' THEN NULL ELSE e.value END
  FROM w JOIN e ON e.key = w.key AND e.i = w.i + 1
), l AS (SELECT key, max(i) AS i FROM w GROUP BY key)
SELECT w.key, w.value FROM w JOIN l ON w.key = l.key AND w.i = l.i WHERE w.value IS NOT NULL
"""

def byte_names(t):
    """Names between characters of two and three bytes, so that byte positions fall inside characters."""
    return part_names(t).select("key", F.concat(F.lit("é"), "value", F.lit("日é")).alias("value"))


BYTE_NAMES = f"(SELECT key, hex(encode('é' || value || '日é')) AS h, octet_length(encode('é' || value || '日é')) AS n FROM {PART_NAMES})"


QUERIES = [
    query("get", lambda t: part_names(t).where(F.col("key") == "part:7").select("key", "value"), f"SELECT key, value FROM {PART_NAMES} WHERE key = 'part:7'"),
    query("set", lambda t: s.set_if_present(kinds(writes(t))), SET_SQL),
    query("setex", timed(60, "expire_at_ms"), timed_sql(60, "expire_at_ms")),
    query("psetex", timed(2, "expire_at_ms"), timed_sql(2, "expire_at_ms")),
    query("setnx", absent, ABSENT),
    query("setnxex", lambda t: absent(t).withColumn("expire_at_ms", F.lit(NOW_MS + 60_000).cast("long")), f"SELECT *, {NOW_MS + 60_000} AS expire_at_ms FROM ({ABSENT})"),
    query("getset", lambda t: s.previous(writes(t), "value").select("key", "seq", "value", "old"), f"SELECT key, seq, value, lag(value) OVER (PARTITION BY key ORDER BY seq) AS old FROM {WRITES}"),
    query("mget", mget, f"SELECT a.p_partkey, a.pos, a.key, p.value FROM (SELECT p_partkey, unnest([0, 1, 2]) AS pos, unnest(['part:' || p_partkey, 'part:x' || p_partkey, 'part:' || (p_partkey + 1)]) AS key FROM part) a LEFT JOIN {PART_NAMES} p ON a.key = p.key"),
    query("mset", lambda t: s.last_write(writes(t), "value"), f"SELECT key, arg_max(value, seq) AS value FROM {WRITES} GROUP BY key"),
    query("msetnx", msetnx, "SELECT stmt, key FROM (SELECT p_partkey AS stmt, unnest(['part:' || (p_partkey * 2), 'new:' || p_partkey]) AS key FROM part) WHERE stmt NOT IN (SELECT p_partkey // 2 FROM part WHERE p_partkey % 2 = 0)"),
    query("strlen", lambda t: part_names(t).select("key", s.strlen(F.col("value")).alias("n")), f"SELECT key, octet_length(encode(value)) AS n FROM {PART_NAMES}"),
    query("append", lambda t: s.append(writes(t)), f"SELECT key, string_agg(value, '' ORDER BY seq) AS value, octet_length(encode(string_agg(value, '' ORDER BY seq))) AS n_bytes FROM {WRITES} GROUP BY key"),
    query("getrange", lambda t: byte_names(t).select("key", F.hex(s.byte_range(F.col("value"), -6, -2)).alias("part")), f"SELECT key, substr(h, 2 * greatest(n - 6, 0) + 1, 2 * (n - 1 - greatest(n - 6, 0))) AS part FROM {BYTE_NAMES}"),
    query("substr", lambda t: byte_names(t).select("key", F.hex(s.byte_range(F.col("value"), 1, 4)).alias("part")), f"SELECT key, substr(h, 3, 8) AS part FROM {BYTE_NAMES}"),
    query("setrange", lambda t: byte_names(t).select("key", F.hex(s.set_range(F.col("value"), 2, "#é")).alias("value")), f"SELECT key, substr(h, 1, 4) || '23C3A9' || substr(h, 11) AS value FROM {BYTE_NAMES}"),
    query("incr", counted(1), counted_sql("1")),
    query("decr", counted(-1), counted_sql("-1")),
    query("incrby", lambda t: s.totals(writes(t), F.col("cents")), f"SELECT key, CAST(sum(cents) AS BIGINT) AS counter FROM {WRITES} GROUP BY key"),
    query("decrby", lambda t: s.totals(writes(t), -F.col("cents")), f"SELECT key, CAST(-sum(cents) AS BIGINT) AS counter FROM {WRITES} GROUP BY key"),
    query("incrbyfloat", lambda t: s.totals(writes(t), F.col("cents") / 8).select("key", F.round("counter", 4).alias("counter")), f"SELECT key, round(sum(cents / 8), 4) AS counter FROM {WRITES} GROUP BY key"),
    query("increx", lambda t: s.fixed_window_counter(writes(t), 3_600_000), INCREX_SQL),
    query("cas", lambda t: s.compare_and_set(versioned(writes(t))), CAS_SQL),
    query("getvsn", lambda t: s.compare_and_set(versioned(writes(t))).select(F.col("version").alias("cas"), "key", "value"), f"SELECT version AS cas, key, value FROM ({CAS_SQL})"),
]
