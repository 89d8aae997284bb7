"""Key queries: existence, types, deletion, renaming, expiry, slots, scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import keyspace as k
from keyloom.plans.base import query
from keyloom.plans.fixtures import DEADLINES, NOW_MS, PART_NAMES, SUPPLIER_SETS, deadlines, part_names, supplier_sets

SMALL = "(SELECT 'part:' || p_partkey AS key FROM part WHERE p_size <= 10)"


#: How each type is described.
ENCODINGS = {"string": "raw", "list": "linkedlist", "zset": "skiplist", "hash": "ht", "set": "ht"}


def small_parts(t):
    return t.part.where("p_size <= 10").select(F.concat(F.lit("part:"), "p_partkey").alias("key"))


def everything(t):
    """All keys with their types."""
    typed = lambda prefix, column, kind, table: table.select(F.concat(F.lit(prefix), column).alias("key")).distinct().withColumn("type", F.lit(kind))
    frames = [typed("part:", "p_partkey", "string", t.part), typed("cust:", "c_custkey", "hash", t.customer), typed("user:", "user_id", "list", t.events), typed("sup:", "s_suppkey", "set", t.supplier), typed("nation:", "c_nationkey", "zset", t.customer)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


EVERYTHING = (
    "(SELECT 'part:' || p_partkey AS key, 'string' AS type FROM part UNION ALL SELECT 'cust:' || c_custkey, 'hash' FROM customer UNION ALL "
    "SELECT DISTINCT 'user:' || user_id, 'list' FROM events UNION ALL SELECT 'sup:' || s_suppkey, 'set' FROM supplier UNION ALL SELECT DISTINCT 'nation:' || c_nationkey, 'zset' FROM customer)"
)
ASKED = "(SELECT 'part:' || (p_partkey * 3) AS key FROM part UNION ALL SELECT 'part:' || (p_partkey * 3) AS key FROM part WHERE p_size > 25)"


def asked(t):
    one = t.part.select(F.concat(F.lit("part:"), F.col("p_partkey") * 3).alias("key"), "p_size")
    return one.select("key").union(one.where("p_size > 25").select("key"))


def moves(t):
    return t.part.where("p_partkey % 2 = 0").select(F.concat(F.lit("part:"), "p_partkey").alias("source"), F.concat(F.lit("part:"), F.col("p_partkey") * 2 + 1).alias("target"))


def deadline_at(expression, name="expire_at_ms"):
    return lambda t: k.expire_at(deadlines(t), NOW_MS, expression()).select("key", name)


LIVE = f"(expire_at_ms = 0 OR expire_at_ms > {NOW_MS})"
USER = "CAST(split_part(key, ':', 2) AS BIGINT)"


def user():
    return F.split_part(F.col("key"), F.lit(":"), F.lit(2)).cast("long")


def deadline_sql(expression):
    return f"SELECT key, expire_at_ms FROM (SELECT key, {expression} AS expire_at_ms FROM {DEADLINES} WHERE {LIVE}) WHERE expire_at_ms > {NOW_MS}"


CRC_TABLE = "[" + ", ".join(map(str, k._crc16_table())) + "]"
SLOT_SQL = (
    f"(list_reduce(list_concat([0], list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1)))), "
    f"lambda crc, b: xor((crc << 8) & 65535, {CRC_TABLE}[(xor(crc >> 8, b) & 255) + 1])) & 16383)"
)
SLOTTED = f"(SELECT key, CAST({SLOT_SQL} AS INTEGER) AS slot FROM {PART_NAMES})"


def slotted(t):
    return part_names(t).select("key", k.key_slot(F.col("key")).alias("slot"))


QUERIES = [
    query("del", lambda t: k.delete(part_names(t), small_parts(t)).select("key", "value"), f"SELECT key, value FROM {PART_NAMES} WHERE key NOT IN (SELECT key FROM {SMALL})"),
    query("unlink", lambda t: part_names(t).join(small_parts(t), "key", "left_semi").agg(F.count(F.lit(1)).alias("removed")), f"SELECT count(*) AS removed FROM {SMALL}"),
    query("rename", lambda t: k.rename(part_names(t).select("key", "value"), moves(t)),
          f"SELECT CASE WHEN p_partkey % 2 = 0 THEN 'part:' || (p_partkey * 2 + 1) ELSE key END AS key, value FROM {PART_NAMES} WHERE NOT (p_partkey % 4 = 1)"),
    query("renamenx", lambda t: k.rename(part_names(t).select("key", "value"), moves(t), only_absent=True),
          f"SELECT CASE WHEN p_partkey % 2 = 0 AND p_partkey * 2 + 1 NOT IN (SELECT p_partkey FROM part) THEN 'part:' || (p_partkey * 2 + 1) ELSE key END AS key, value FROM {PART_NAMES}"),
    query("exists", lambda t: k.exists(part_names(t), asked(t)), f"SELECT a.key, CAST(sum(CASE WHEN p.key IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n FROM {ASKED} a LEFT JOIN {PART_NAMES} p ON a.key = p.key GROUP BY a.key"),
    query("type", lambda t: asked(t).distinct().join(everything(t), "key", "left").select("key", F.coalesce("type", F.lit("none")).alias("type")), f"SELECT a.key, coalesce(e.type, 'none') AS type FROM (SELECT DISTINCT key FROM {ASKED}) a LEFT JOIN {EVERYTHING} e ON a.key = e.key"),
    query("expire", deadline_at(lambda: F.lit(NOW_MS) + (user() % 5) * 1000), deadline_sql(f"{NOW_MS} + ({USER} % 5) * 1000")),
    query("pexpire", deadline_at(lambda: F.lit(NOW_MS) + user() % 5 - 1), deadline_sql(f"{NOW_MS} + ({USER} % 5) - 1")),
    query("expireat", deadline_at(lambda: (F.lit(NOW_MS // 1000) + user() - 3) * 1000), deadline_sql(f"({NOW_MS // 1000} + {USER} - 3) * 1000")),
    query("pexpireat", deadline_at(lambda: F.lit(NOW_MS) + user() - 3), deadline_sql(f"{NOW_MS} + {USER} - 3")),
    query("ttl", lambda t: deadlines(t).select("key", k.ttl(NOW_MS).alias("ttl")), f"SELECT key, CAST(CASE WHEN expire_at_ms = 0 THEN -1 WHEN expire_at_ms <= {NOW_MS} THEN -2 ELSE (expire_at_ms - {NOW_MS} + 500) // 1000 END AS BIGINT) AS ttl FROM {DEADLINES}"),
    query("pttl", lambda t: deadlines(t).select("key", k.pttl(NOW_MS).alias("pttl")), f"SELECT key, CAST(CASE WHEN expire_at_ms = 0 THEN -1 WHEN expire_at_ms <= {NOW_MS} THEN -2 ELSE expire_at_ms - {NOW_MS} END AS BIGINT) AS pttl FROM {DEADLINES}"),
    query("persist", lambda t: k.persist(deadlines(t), NOW_MS).select("key", "changed"), f"SELECT key, CAST(expire_at_ms <> 0 AS INTEGER) AS changed FROM {DEADLINES} WHERE {LIVE}"),
    query("revision", lambda t: k.expire_at(deadlines(t), NOW_MS, F.lit(NOW_MS + 1000)).select("key", "expire_at_ms", user().alias("version_ep")), f"SELECT key, {NOW_MS + 1000} AS expire_at_ms, {USER} AS version_ep FROM {DEADLINES} WHERE {LIVE}"),
    query("object", lambda t: everything(t).select("key", F.element_at(F.create_map(*[F.lit(x) for kv in ENCODINGS.items() for x in kv]), F.col("type")).alias("encoding")),
          f"SELECT key, CASE type WHEN 'string' THEN 'raw' WHEN 'list' THEN 'linkedlist' WHEN 'zset' THEN 'skiplist' ELSE 'ht' END AS encoding FROM {EVERYTHING}"),
    query("keys", lambda t: everything(t).where(k.matches(F.col("key"), "part:[12]?*")).select("key"), f"SELECT key FROM {EVERYTHING} WHERE regexp_matches(key, '^part:[12]..*$')"),
    query("scan", lambda t: k.scan(everything(t), "key", "cust:1", 20, (F.col("type") == "hash") & k.matches(F.col("key"), "cust:*5*") & k.key_slot(F.col("key")).between(0, 8191)).select("key", "cursor"),
          f"WITH q AS (SELECT key, row_number() OVER (ORDER BY key) AS i, count(*) OVER () AS n FROM {EVERYTHING} WHERE type = 'hash' AND key > 'cust:1' AND key LIKE 'cust:%5%' AND {SLOT_SQL} <= 8191) SELECT key, CASE WHEN n > 20 THEN (SELECT max(key) FROM q WHERE i <= 20) END AS cursor FROM q WHERE i <= 20"),
    query("sscan", lambda t: k.page(supplier_sets(t).where("key = 'sup:1'"), ["member"], ("2",), 20), f"SELECT key, member FROM {SUPPLIER_SETS} WHERE key = 'sup:1' AND member > '2' ORDER BY member LIMIT 20"),
    query("dbsize", lambda t: deadlines(t).where(k.live(NOW_MS)).agg(F.count(F.lit(1)).alias("n")), f"SELECT count(*) AS n FROM {DEADLINES} WHERE {LIVE}"),
    query("dbempty", lambda t: everything(t).limit(1).agg((F.count(F.lit(1)) == 0).cast("int").alias("is_empty")), f"SELECT CAST(count(*) = 0 AS INTEGER) AS is_empty FROM {EVERYTHING}"),
    query("iterallkeys", lambda t: deadlines(t).select("key", "expire_at_ms"), f"SELECT key, expire_at_ms FROM {DEADLINES}"),
    query("info_keyspace", lambda t: everything(t).rollup("type").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("type", F.lit("all")).alias("type"), "n"), f"SELECT coalesce(type, 'all') AS type, count(*) AS n FROM {EVERYTHING} GROUP BY ROLLUP (type)"),
    query("cluster_keyslot", slotted, f"SELECT key, slot FROM {SLOTTED}"),
    query("cluster_countkeysinslot", lambda t: slotted(t).groupBy("slot").agg(F.count(F.lit(1)).alias("n")), f"SELECT slot, count(*) AS n FROM {SLOTTED} GROUP BY slot"),
    query("cluster_getkeysinslot", lambda t: slotted(t).where("slot < 1000").select("slot", "key"), f"SELECT slot, key FROM {SLOTTED} WHERE slot < 1000"),
    query("deleteslots", lambda t: slotted(t).where("NOT slot BETWEEN 0 AND 8191"), f"SELECT key, slot FROM {SLOTTED} WHERE NOT slot BETWEEN 0 AND 8191"),
    query("slotsempty", lambda t: slotted(t).where("slot BETWEEN 0 AND 100").limit(1).agg((F.count(F.lit(1)) == 0).cast("int").alias("is_empty")), f"SELECT CAST(count(*) = 0 AS INTEGER) AS is_empty FROM {SLOTTED} WHERE slot BETWEEN 0 AND 100"),
]
