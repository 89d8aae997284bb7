"""Set queries: the parts of each supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import hashes, sets as st
from keyloom.plans.base import query
from keyloom.plans.fixtures import SUPPLIER_SETS, pieces, supplier_sets

THREE = ["sup:1", "sup:2", "sup:3"]


def of(i):
    return f"SELECT member FROM {SUPPLIER_SETS} WHERE key = 'sup:{i}'"


def stored(name, sql):
    return f"SELECT '{name}' AS key, member FROM ({sql})"


def new_members(t):
    return t.part.select(F.concat(F.lit("sup:"), F.col("p_partkey") % 12).alias("key"), F.col("p_partkey").cast("string").alias("member"))


NEW = "(SELECT 'sup:' || (p_partkey % 12) AS key, CAST(p_partkey AS VARCHAR) AS member FROM part)"
NUMBERED = f"(SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS i FROM {SUPPLIER_SETS})"
INTER, UNION, DIFF = f"{of(1)} INTERSECT {of(2)} INTERSECT {of(3)}", f"{of(1)} UNION {of(2)} UNION {of(3)}", f"{of(1)} EXCEPT {of(2)} EXCEPT {of(3)}"


def moves(t):
    one = new_members(t)
    return one.select(F.col("key").alias("source"), F.lit("sup:new").alias("target"), "member")


QUERIES = [
    query("sadd", lambda t: st.add(supplier_sets(t), new_members(t))[1], f"SELECT key, count(*) AS added FROM (SELECT * FROM {NEW} EXCEPT SELECT * FROM {SUPPLIER_SETS}) GROUP BY key"),
    query("srem", lambda t: supplier_sets(t).join(new_members(t), ["key", "member"], "left_anti"), f"SELECT * FROM {SUPPLIER_SETS} EXCEPT SELECT * FROM {NEW}"),
    query("scard", lambda t: supplier_sets(t).groupBy("key").agg(F.count(F.lit(1)).alias("n")), f"SELECT key, count(*) AS n FROM {SUPPLIER_SETS} GROUP BY key"),
    query("sismember", lambda t: supplier_sets(t).join(new_members(t), ["key", "member"], "left_semi"), f"SELECT * FROM {SUPPLIER_SETS} INTERSECT SELECT * FROM {NEW}"),
    query("smembers", lambda t: supplier_sets(t).where("key = 'sup:2'").select("member"), of(2)),
    query("smove", lambda t: st.move(supplier_sets(t), moves(t), pieces(t.lineitem)), f"SELECT * FROM {SUPPLIER_SETS} EXCEPT SELECT * FROM {NEW} UNION SELECT 'sup:new' AS key, s.member FROM {SUPPLIER_SETS} s JOIN {NEW} n ON s.key = n.key AND s.member = n.member"),
    query("spop", lambda t: st.smallest(supplier_sets(t), 3), f"SELECT key, member FROM {NUMBERED} WHERE i <= 3"),
    query("srandmember", lambda t: st.sample(supplier_sets(t), 5, seed=42), f"SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('42:' || key || ':' || member), member) AS i FROM {SUPPLIER_SETS}) WHERE i <= 5"),
    query("srandmember_repeats", lambda t: st.sample(supplier_sets(t), -4, seed=42), f"SELECT key, CAST(d AS INTEGER) AS draw, arg_min(member, md5('42:' || d || ':' || key || ':' || member)) AS member FROM {SUPPLIER_SETS}, range(1, 5) r(d) GROUP BY key, d"),
    query("sdiff", lambda t: st.difference(supplier_sets(t), "sup:1", THREE[1:]), DIFF),
    query("sdiffstore", lambda t: st.store(st.difference(supplier_sets(t), "sup:1", THREE[1:]), "d"), stored("d", DIFF)),
    query("sinter", lambda t: st.intersect(supplier_sets(t), THREE), INTER),
    query("sinterstore", lambda t: st.store(st.intersect(supplier_sets(t), [*THREE, "sup:none"], skip_missing=True), "i"), stored("i", INTER)),
    query("sunion", lambda t: st.union(supplier_sets(t), THREE), UNION),
    query("sunionstore", lambda t: st.store(st.union(supplier_sets(t), THREE), "u"), stored("u", UNION)),
    query("ssize", lambda t: hashes.byte_size(supplier_sets(t), "member"), f"SELECT key, count(*) AS n, CAST(sum(octet_length(encode(member))) AS BIGINT) AS n_bytes FROM {SUPPLIER_SETS} GROUP BY key"),
]
