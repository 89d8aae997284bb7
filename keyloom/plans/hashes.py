"""Hash queries: a hash per customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import hashes as h
from keyloom.plans.base import query
from keyloom.plans.fixtures import CUSTOMER_HASH, WRITES, customer_hash, writes


def updates(t):
    """New fields for every third customer: one that exists and one that does not."""
    rows = t.customer.where("c_custkey % 3 = 0").select(F.concat(F.lit("cust:"), "c_custkey").alias("key"), F.explode(F.array(F.lit("segment"), F.lit("tier"))).alias("field"), F.col("c_custkey").alias("seq"))
    return rows.withColumn("value", F.concat(F.lit("new-"), "field"))


UPDATES = "(SELECT 'cust:' || c_custkey AS key, unnest(['segment', 'tier']) AS field, unnest(['new-segment', 'new-tier']) AS value FROM customer WHERE c_custkey % 3 = 0)"
PUT = f"SELECT h.key, h.field, h.value FROM {CUSTOMER_HASH} h LEFT JOIN {UPDATES} u ON h.key = u.key AND h.field = u.field WHERE u.key IS NULL UNION ALL SELECT key, field, value FROM {UPDATES}"
PUT_ABSENT = f"SELECT key, field, value FROM {CUSTOMER_HASH} UNION ALL SELECT key, field, value FROM {UPDATES} WHERE field = 'tier'"


def hget(t, field):
    return customer_hash(t).where(F.col("field") == field)


def commands(t):
    """Versioned hash commands; right versions occur now and then."""
    return writes(t).select("key", "seq", (F.col("seq") % 3).alias("version"), (F.col("seq") % 5 + 1).alias("new_version"), F.col("value").alias("field"), (F.col("seq") % 2).alias("op"), F.col("cents").alias("value"))


def hmcas_sql(explicit):
    version = "e.new_version" if explicit else "e.version + 1"
    ok = "(w.cas = -1 OR w.cas = e.version)" + (" AND e.new_version > w.cas" if explicit else "")
    return f"""
WITH RECURSIVE e AS (
  SELECT key, seq % 3 AS version, seq % 5 + 1 AS new_version, value AS field, seq % 2 AS op, cents AS value, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM {WRITES}
), w AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS cas, false AS done, CAST(NULL AS VARCHAR) AS field, CAST(0 AS BIGINT) AS op, CAST(0 AS BIGINT) AS value FROM e
  UNION ALL
  SELECT e.key, e.i, CASE WHEN {ok} THEN {version} ELSE w.cas END, {ok}, e.field, e.op, e.value FROM w JOIN e ON e.key = w.key AND e.i = w.i + 1
), d AS (SELECT * FROM w WHERE done),
s AS (SELECT key, field, max(CASE WHEN op = 0 THEN i ELSE 0 END) AS last_set FROM d GROUP BY key, field),
f AS (SELECT d.key, d.field, CAST(sum(d.value) AS BIGINT) AS value FROM d JOIN s ON d.key = s.key AND d.field = s.field AND d.i >= s.last_set GROUP BY d.key, d.field)
SELECT f.key, v.cas, f.field, f.value FROM f JOIN (SELECT key, arg_max(cas, i) AS cas FROM w GROUP BY key) v ON f.key = v.key
"""


QUERIES = [
    query("hset", lambda t: h.put(customer_hash(t), updates(t)), PUT),
    query("hmset", lambda t: h.put(customer_hash(t), updates(t).where("field = 'tier'")), PUT_ABSENT),
    query("hsetnx", lambda t: h.put(customer_hash(t), updates(t), only_absent=True), PUT_ABSENT),
    query("hget", lambda t: hget(t, "segment").select("key", "value"), "SELECT 'cust:' || c_custkey AS key, c_mktsegment AS value FROM customer"),
    query("hmget", lambda t: h.get_many(customer_hash(t), ["name", "nation", "missing"]), "SELECT 'cust:' || c_custkey AS key, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, CAST(NULL AS VARCHAR) AS missing FROM customer"),
    query("hgetall", lambda t: h.as_map(customer_hash(t)).select("key", F.to_json("fields").alias("fields")), f"SELECT key, '{{' || string_agg('\"' || field || '\":\"' || value || '\"', ',' ORDER BY field) || '}}' AS fields FROM {CUSTOMER_HASH} GROUP BY key"),
    query("hkeys", lambda t: customer_hash(t).select("key", "field"), f"SELECT key, field FROM {CUSTOMER_HASH}"),
    query("hvals", lambda t: customer_hash(t).select("key", "value"), f"SELECT key, value FROM {CUSTOMER_HASH}"),
    query("hlen", lambda t: customer_hash(t).groupBy("key").agg(F.count(F.lit(1)).alias("n")), f"SELECT key, count(*) AS n FROM {CUSTOMER_HASH} GROUP BY key"),
    query("hexists", lambda t: customer_hash(t).groupBy("key").agg(F.max((F.col("field") == "tier").cast("int")).alias("tier"), F.max((F.col("field") == "name").cast("int")).alias("name")), f"SELECT key, max(CAST(field = 'tier' AS INTEGER)) AS tier, max(CAST(field = 'name' AS INTEGER)) AS name FROM {CUSTOMER_HASH} GROUP BY key"),
    query("hstrlen", lambda t: hget(t, "name").select("key", F.octet_length("value").cast("long").alias("n")), "SELECT 'cust:' || c_custkey AS key, octet_length(encode(c_name)) AS n FROM customer"),
    query("hdel", lambda t: h.remove(customer_hash(t), updates(t)), f"SELECT h.* FROM {CUSTOMER_HASH} h LEFT JOIN {UPDATES} u ON h.key = u.key AND h.field = u.field WHERE u.key IS NULL"),
    query("hincrby", lambda t: h.add(writes(t).withColumnRenamed("value", "field"), F.col("cents")), f"SELECT key, value AS field, CAST(sum(cents) AS BIGINT) AS value FROM {WRITES} GROUP BY ALL"),
    query("hincrbyfloat", lambda t: h.add(writes(t).withColumnRenamed("value", "field"), F.col("cents") / 8).withColumn("value", F.round("value", 4)), f"SELECT key, w.value AS field, round(sum(cents / 8), 4) AS value FROM {WRITES} w GROUP BY key, w.value"),
    query("hmcas", lambda t: h.compare_and_set(commands(t)), hmcas_sql(False)),
    query("hmcasv2", lambda t: h.compare_and_set(commands(t), explicit=True), hmcas_sql(True)),
    query("hmgetvsn", lambda t: h.compare_and_set(commands(t)).where(F.col("field").isin("view", "click")), f"SELECT * FROM ({hmcas_sql(False)}) WHERE field IN ('view', 'click')"),
    query("hsize", lambda t: h.byte_size(customer_hash(t), "field", "value"), f"SELECT key, count(*) AS n, CAST(sum(octet_length(encode(field)) + octet_length(encode(value))) AS BIGINT) AS n_bytes FROM {CUSTOMER_HASH} GROUP BY key"),
    query("hscan", lambda t: h.page(customer_hash(t), "cents", 2), f"SELECT key, field, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY field) AS i FROM {CUSTOMER_HASH} WHERE field > 'cents') WHERE i <= 2"),
]
