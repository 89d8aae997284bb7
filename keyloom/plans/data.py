"""Queries over sketches, sorts, dumps, snapshots, change logs, scripts and the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions import Scripts
from keyloom.operators import hashes, sketches as sk, sorting
from keyloom.plans.base import query
from keyloom.plans.fixtures import CUSTOMER_HASH, EVENT_BITS, NATION_ZSET, NOW_MS, PART_NAMES, SUPPLIER_SETS, USER_LIST, WRITES, customer_hash, event_bits, nation_zset, part_names, supplier_sets, user_list, writes
from keyloom.plans.strings import INCREX_SQL
from keyloom.sources import changelog, dumps, snapshots
from keyloom.streaming import counters, folds
from keyloom.streaming.base import scratch


def flag_orders(t):
    return t.lineitem.select(F.concat(F.lit("uniq:"), "l_returnflag").alias("key"), "l_orderkey")


def checked(counted, exact, name="n"):
    """Estimates beside exact counts: whether they are within 5 %."""
    return counted.join(exact, "key").select("key", "exact", (F.abs(F.col(name) - F.col("exact")) <= F.col("exact") * 0.05).cast("int").alias("close"))


def pfcount(t):
    exact = flag_orders(t).groupBy("key").agg(F.count_distinct("l_orderkey").alias("exact"))
    return checked(sk.estimate(sk.sketched(flag_orders(t), "l_orderkey")), exact)


def pfadd(t):
    """Sketches of the even orders, to which the odd ones are added."""
    exact = flag_orders(t).groupBy("key").agg(F.count_distinct("l_orderkey").alias("exact"))
    even = sk.sketched(flag_orders(t).where("l_orderkey % 2 = 0"), "l_orderkey")
    return checked(sk.estimate(sk.add(even, flag_orders(t).where("l_orderkey % 2 = 1"), "l_orderkey")), exact)


def pfmerge(t):
    exact = flag_orders(t).agg(F.lit("all").alias("key"), F.count_distinct("l_orderkey").alias("exact"))
    return checked(sk.estimate(sk.merge(sk.sketched(flag_orders(t), "l_orderkey"), "all")), exact)


def order_lists(t):
    return t.orders.select(F.concat(F.lit("cust:"), "o_custkey").alias("key"), F.col("o_orderkey").cast("string").alias("element"))


ORDER_LISTS = "(SELECT 'cust:' || o_custkey AS key, CAST(o_orderkey AS VARCHAR) AS element, o_totalprice, o_orderstatus, o_orderkey FROM orders)"


def weights(t):
    """Weights of some orders; the others count 0."""
    return t.orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").cast("string").alias("element"), F.col("o_totalprice").alias("weight"))


def fetched(t):
    return t.orders.select(F.col("o_orderkey").cast("string").alias("element"), F.col("o_orderstatus").alias("status"))


def log(t):
    """A change log in which clicks delete."""
    return writes(t).withColumn("op", F.when(F.col("value") == "click", "del").otherwise("set")).select("key", "seq", "ts_ms", "op", "value")


LOG = f"(SELECT key, seq, ts_ms, CASE value WHEN 'click' THEN 'del' ELSE 'set' END AS op, value FROM {WRITES})"
def stored(t):
    """A state with a value of its own for every user, and keys that the log does not name."""
    return log(t).select("key", F.lit("stored").alias("value")).distinct().union(part_names(t).select("key", "value"))


LATER = f"(SELECT key, arg_max(value, seq) AS value, arg_max(op, seq) AS op FROM {LOG} WHERE seq > 700 GROUP BY key)"
APPLIED = f"SELECT DISTINCT key, 'stored' AS value FROM {LOG} WHERE key NOT IN (SELECT key FROM {LATER}) UNION ALL SELECT key, value FROM {PART_NAMES} UNION ALL SELECT key, value FROM {LATER} WHERE op = 'set'"
LAST = "SELECT key, arg_max(value, seq) AS value, arg_max(op, seq) AS op FROM {log} GROUP BY key"


def snapshot(t):
    path = scratch(t.spark, "backup")
    snapshots.backup(nation_zset(t), path)
    return snapshots.restore_backup(t.spark, path).select("key", "member", "score")


def script(t):
    scripts = Scripts()
    digest = scripts.load("CASE WHEN value = 'purchase' THEN cents * 2 ELSE cents END")
    return writes(t).select("key", "seq", scripts.call(digest).alias("result"))


def catalogue(t):
    from keyloom.catalog import describe

    return describe(t.spark).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


BIG = f"(SELECT key, count(*) AS n, CAST(sum(octet_length(encode(member))) AS BIGINT) AS n_bytes FROM {NATION_ZSET} GROUP BY key)"

def every_element(t):
    """All elements of all structures in one table: ``(type, key, element, value)``."""
    frames = [
        customer_hash(t).select(F.lit("hash").alias("type"), "key", F.col("field").alias("element"), "value"),
        nation_zset(t).select(F.lit("zset"), "key", "member", F.round(F.col("score") * 100).cast("long").cast("string")),
        supplier_sets(t).select(F.lit("set"), "key", "member", F.lit(None).cast("string")),
        part_names(t).select(F.lit("string"), "key", F.lit("").alias("e"), "value"),
        user_list(t).select(F.lit("list"), "key", F.col("idx").cast("long").cast("string"), "value"),
        event_bits(t).select(F.lit("bitmap"), "key", F.col("pos").cast("string"), F.lit("1")),
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


EVERY_ELEMENT = (
    f"SELECT 'hash' AS type, key, field AS element, value FROM {CUSTOMER_HASH} UNION ALL SELECT 'zset', key, member, CAST(CAST(round(score * 100) AS BIGINT) AS VARCHAR) FROM {NATION_ZSET} "
    f"UNION ALL SELECT 'set', key, member, NULL FROM {SUPPLIER_SETS} UNION ALL SELECT 'string', key, '', value FROM {PART_NAMES} "
    f"UNION ALL SELECT 'list', key, CAST(CAST(idx AS BIGINT) AS VARCHAR), value FROM {USER_LIST} UNION ALL SELECT 'bitmap', key, CAST(pos AS VARCHAR), '1' FROM {EVENT_BITS}"
)


def commandlist(t):
    from keyloom.catalog import describe

    return describe(t.spark).where("NOT has_sql").select("name", "family")


def structures(t):
    """One structure of each type, by type."""
    return {"string": part_names(t), "hash": customer_hash(t), "list": user_list(t), "set": supplier_sets(t), "zset": nation_zset(t), "bitmap": event_bits(t)}


def together(frames):
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


def part_deadlines(t):
    """Deadlines of parts: every third never expires, the others end around ``now``."""
    at = F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(F.lit(NOW_MS) + F.col("p_size") - 25).cast("long")
    return t.part.select(F.concat(F.lit("part:"), "p_partkey").alias("key"), at.alias("expire_at_ms"), "p_size")


PART_DEADLINES = f"(SELECT 'part:' || p_partkey AS key, p_name AS value, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE {NOW_MS} + p_size - 25 END AS ends, p_size FROM part)"


def live_dumps(t):
    every = together(dumps.dump(rows, kind) for kind, rows in structures(t).items())
    return dumps.dump_live(every, part_deadlines(t), NOW_MS)


def restored_parts(t):
    """Strings come back with their deadlines, but for keys that are there."""
    found = dumps.restorable(live_dumps(t), part_deadlines(t).where("p_size > 40"), NOW_MS)
    return dumps.restore(found, "string").join(found.select("key", "expire_at_ms"), "key")


SIZES_OF_ALL = " UNION ALL ".join(f"SELECT key, '{kind}' AS kind, count(*) AS n, 0 AS ttl_ms FROM {rows} GROUP BY key" for kind, rows in {"hash": CUSTOMER_HASH, "list": USER_LIST, "set": SUPPLIER_SETS, "zset": NATION_ZSET, "bitmap": EVENT_BITS}.items())


QUERIES = [
    query("iterall", every_element, EVERY_ELEMENT),
    query("commandlist", commandlist),
    query("eval", lambda t: Scripts().eval(writes(t), "cents % 7").select("key", "seq", "result"), f"SELECT key, seq, cents % 7 AS result FROM {WRITES}"),
    query("eval_arguments", lambda t: Scripts().eval(writes(t), "concat(:prefix, cents % :m)", args={"prefix": "{r}", "m": 7}).select("key", "seq", "result"), f"SELECT key, seq, '{{r}}' || (cents % 7) AS result FROM {WRITES}"),
    query("sort_store", lambda t: sorting.store(sorting.sort_by(order_lists(t), alpha=True, descending=True), F.concat(F.lit("sorted:"), "key")),
          f"SELECT 'sorted:' || key AS key, CAST(row_number() OVER (PARTITION BY key ORDER BY element DESC) - 1 AS DOUBLE) AS idx, element AS value FROM {ORDER_LISTS}"),
    query("dumpx", lambda t: live_dumps(t).select("key", "kind", F.json_array_length("payload").cast("long").alias("n"), "ttl_ms"),
          f"{SIZES_OF_ALL} UNION ALL SELECT key, 'string', 1, CASE WHEN ends = 0 THEN 0 ELSE ends - {NOW_MS} END FROM {PART_DEADLINES} WHERE ends = 0 OR ends > {NOW_MS}"),
    query("restore_ttl", restored_parts, f"SELECT key, value, ends AS expire_at_ms FROM {PART_DEADLINES} WHERE (ends = 0 OR ends > {NOW_MS}) AND p_size <= 40"),
    query("restore_types", lambda t: together(dumps.restore(live_dumps(t), kind).groupBy("key").agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")) for kind in ("hash", "list", "set", "zset", "bitmap")),
          f"SELECT key, kind, n FROM ({SIZES_OF_ALL})"),
    query("restorevalue_types", lambda t: together(dumps.rebuild(structures(t)[kind], kind) for kind in ("string", "list", "set", "zset")),
          f"SELECT key, 'SET ' || key || ' ' || value AS command, 0.0::DOUBLE AS n FROM {PART_NAMES} UNION ALL SELECT key, 'RPUSH ' || key || ' ' || value, idx FROM {USER_LIST} "
          f"UNION ALL SELECT key, 'SADD ' || key || ' ' || member, 0 FROM {SUPPLIER_SETS} UNION ALL SELECT key, 'ZADD ' || key || ' ' || score || ' ' || member, 0 FROM {NATION_ZSET}"),
    query("binlogstart", lambda t: changelog.bounds(log(t)).select("first"), f"SELECT min(seq) AS first FROM {WRITES}"),
    query("binlogmeta", lambda t: log(t).orderBy("seq").limit(1).select("seq", "ts_ms", "key", "op"), f"SELECT seq, ts_ms, key, op FROM {LOG} ORDER BY seq LIMIT 1"),
    query("pfcount", pfcount, "SELECT 'uniq:' || l_returnflag AS key, count(DISTINCT l_orderkey) AS exact, 1 AS close FROM lineitem GROUP BY 1"),
    query("pfmerge", pfmerge, "SELECT 'all' AS key, count(DISTINCT l_orderkey) AS exact, 1 AS close FROM lineitem"),
    query("pfadd", pfadd, "SELECT 'uniq:' || l_returnflag AS key, count(DISTINCT l_orderkey) AS exact, 1 AS close FROM lineitem GROUP BY 1"),
    query("pfdebug_getreg", lambda t: sk.registers(flag_orders(t), "l_orderkey").groupBy("key", "rho").agg(F.count(F.lit(1)).alias("n"))),
    query("sort", lambda t: sorting.sort_by(order_lists(t), limit=3), f"SELECT key, element, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o_orderkey, element) - 1 AS rank FROM {ORDER_LISTS}) WHERE rank < 3"),
    query("sort_by_get", lambda t: sorting.sort_by(order_lists(t), weights(t), fetched(t), descending=True, offset=1, limit=3),
          f"SELECT key, element, rank, o_orderstatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice ELSE 0 END DESC, element DESC) - 1 AS rank FROM {ORDER_LISTS}) WHERE rank BETWEEN 1 AND 3"),
    query("sort_alpha", lambda t: sorting.sort_by(order_lists(t), alpha=True), f"SELECT key, element, row_number() OVER (PARTITION BY key ORDER BY element) - 1 AS rank FROM {ORDER_LISTS}"),
    query("dump", lambda t: dumps.dump(customer_hash(t)).select("key", "payload"),
          f"""SELECT key, '[' || string_agg('{{"field":"' || field || '","value":"' || value || '"}}', ',' ORDER BY field) || ']' AS payload FROM {CUSTOMER_HASH} GROUP BY key"""),
    query("restore", lambda t: dumps.restore(dumps.dump(customer_hash(t))), f"SELECT key, field, value FROM {CUSTOMER_HASH}"),
    query("restorevalue", lambda t: dumps.rebuild_commands(customer_hash(t), "HSET", "field", "value"), f"SELECT key, 'HSET ' || key || ' ' || field || ' ' || value AS command FROM {CUSTOMER_HASH}"),
    query("restoremeta", lambda t: dumps.flag_big(hashes.byte_size(nation_zset(t), "member"), 60, 1 << 20), f"SELECT *, CAST(n >= 60 OR n_bytes >= 1048576 AS INTEGER) AS big FROM {BIG}"),
    query("restorebackup", snapshot, f"SELECT * FROM {NATION_ZSET}"),
    query("applybinlogsv2", lambda t: changelog.apply(stored(t), log(t), applied=700), APPLIED),
    query("restorebinlogv2", lambda t: changelog.replay(log(t), 600), f"SELECT key, value FROM ({LAST.format(log=f'(SELECT * FROM {LOG} WHERE seq <= 600)')}) WHERE op = 'set'"),
    query("incrmeta", lambda t: changelog.changed_keys(log(t), 200, 500), f"SELECT key, max(seq) AS seq, arg_max(op, seq) AS op FROM {LOG} WHERE seq BETWEEN 200 AND 500 GROUP BY key"),
    query("binlogpos", lambda t: changelog.bounds(log(t)), f"SELECT min(seq) AS first, max(seq) AS last, arg_max(ts_ms, seq) AS ts_ms FROM {LOG}"),
    query("binlogtime", lambda t: log(t).where("seq = 77").select("seq", "ts_ms"), f"SELECT seq, ts_ms FROM {LOG} WHERE seq = 77"),
    query("syncversion", lambda t: changelog.watermarks(log(t), "op"), f"WITH m AS (SELECT op, max(seq) AS seq, max(ts_ms) AS ts_ms FROM {LOG} GROUP BY op) SELECT * FROM m UNION ALL SELECT 'all', min(seq), min(ts_ms) FROM m"),
    query("evalsha", script, f"SELECT key, seq, CASE WHEN value = 'purchase' THEN cents * 2 ELSE cents END AS result FROM {WRITES}"),
    query("command_count", catalogue),
    query("incrsync", lambda t: folds.last_writes(t.spark, t.folder), "SELECT user_id, arg_max(event_type, event_id) AS value, max(event_id) AS seq FROM events GROUP BY user_id"),
    query("stream_windows", lambda t: folds.windowed_counts(t.spark, t.folder), "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS opened, event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2"),
    query("stream_increx", lambda t: counters.stream_fixed_windows(t.spark, t.folder),
          f"WITH all_windows AS ({INCREX_SQL}) SELECT CAST(split_part(key, ':', 2) AS BIGINT) AS user_id, opened_ms, counter FROM all_windows QUALIFY opened_ms < max(opened_ms) OVER (PARTITION BY key)"),
]
