"""Bitmap queries: minutes with events by event type; and bit fields of part numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import bits as b
from keyloom.plans.base import query
from keyloom.plans.fixtures import EVENT_BITS, PART_NAMES, WRITES, event_bits, part_names, writes

THREE = ["act:view", "act:click", "act:error"]
IN_THREE = "key IN ('act:view', 'act:click', 'act:error')"


def asked(t):
    """The minute after each event, in the bitmap of its type: some bits are set, others not."""
    return event_bits(t).select("key", (F.col("pos") + 1).alias("pos"))


ASKED = f"(SELECT key, pos + 1 AS pos FROM {EVENT_BITS})"


def flips(t):
    """A command log that sets and clears the bits of users."""
    return writes(t).select(F.concat(F.lit("f:"), F.col("seq") % 3).alias("key"), F.col("user_id").alias("pos"), "seq", (F.col("cents") % 2).cast("int").alias("bit"))


FLIPS = f"(SELECT 'f:' || (seq % 3) AS key, user_id AS pos, seq, CAST(cents % 2 AS INTEGER) AS bit FROM {WRITES})"


def registers(t):
    return t.part.select("p_partkey", ((F.col("p_partkey") * 1_000_003) % 65536).alias("r"))


REGISTERS = "(SELECT p_partkey, (p_partkey * 1000003) % 65536 AS r FROM part)"


def field(t, offset):
    """An unsigned byte of the 16-bit register, as the register's low bits."""
    return b.get_field(F.col("r"), 8, 48 + offset, False)


def grown(overflow):
    return lambda t: registers(t).select("p_partkey", b.increment_field(F.col("r"), 8, 56, False, F.lit(100).cast("long"), overflow).alias("v"))


def chained(t):
    """Several commands on the bytes of one name, one after the other."""
    ops = [("get", "u8", "#0"), ("set", "u8", "#1", 65), ("overflow", "sat"), ("incrby", "u8", "#2", 200), ("get", "u12", 4), ("overflow", "fail"), ("incrby", "i8", 0, 120)]
    done = part_names(t).select("key", b.bitfield(F.col("value"), ops).alias("f"))
    return done.select("key", *[F.get("f.results", F.lit(i)).alias(f"r{i}") for i in range(5)], F.hex("f.value").alias("value"))


CHARS = f"(SELECT key, hex(value) AS h, ascii(value[1]) AS b0, ascii(value[2]) AS b1, ascii(value[3]) AS b2 FROM {PART_NAMES})"
CHAINED = (
    "SELECT key, CAST(b0 AS BIGINT) AS r0, CAST(b1 AS BIGINT) AS r1, CAST(least(b2 + 200, 255) AS BIGINT) AS r2, CAST((b0 & 15) * 256 + 65 AS BIGINT) AS r3, "
    "CAST(CASE WHEN b0 + 120 <= 127 THEN b0 + 120 END AS BIGINT) AS r4, "
    f"CASE WHEN b0 + 120 <= 127 THEN printf('%02X', b0 + 120) ELSE h[1:2] END || '41' || printf('%02X', least(b2 + 200, 255)) || h[7:] AS value FROM {CHARS}"
)


def event_words(t):
    return b.words(event_bits(t))


def hours(t):
    """The first minute of the hour of each event, in the bitmap of its type."""
    return event_bits(t).select("key", (F.floor(F.col("pos") / 60) * 60).alias("offset")).distinct()


HOURS = f"(SELECT DISTINCT key, pos // 60 * 60 AS o FROM {EVENT_BITS})"
#: The five minutes from ``o`` as a number, the first being the highest bit.
FIVE = f"SELECT h.key, h.o, CAST(sum(CASE WHEN e.pos IS NULL THEN 0 ELSE 1 << CAST(4 - (e.pos - h.o) AS INTEGER) END) AS BIGINT) AS v FROM {HOURS} h LEFT JOIN {EVENT_BITS} e ON e.key = h.key AND e.pos BETWEEN h.o AND h.o + 4 GROUP BY h.key, h.o"


def grown_fields(t, overflow="wrap"):
    return b.increment_word_fields(event_words(t), hours(t).withColumn("delta", F.lit(7).cast("long")), "u5", overflow)


QUERIES = [
    query("setbit", lambda t: b.set_bits(flips(t))[0], f"SELECT key, pos FROM {FLIPS} GROUP BY key, pos HAVING arg_max(bit, seq) = 1"),
    query("setbit_old", lambda t: b.set_bits(flips(t))[1].select("seq", "old"), f"SELECT seq, coalesce(lag(bit) OVER (PARTITION BY key, pos ORDER BY seq), 0) AS old FROM {FLIPS}"),
    query("getbit", lambda t: b.get_bits(event_bits(t), asked(t)),
          f"SELECT a.key, a.pos, CASE WHEN e.key IS NULL THEN 0 ELSE 1 END AS bit FROM {ASKED} a LEFT JOIN {EVENT_BITS} e ON a.key = e.key AND a.pos = e.pos"),
    query("bitcount", lambda t: b.count_bits(event_bits(t)), f"SELECT key, count(*) AS n FROM {EVENT_BITS} GROUP BY key"),
    query("bitcount_range", lambda t: b.count_bits(event_bits(t), 0, 179), f"SELECT key, count(*) AS n FROM {EVENT_BITS} WHERE pos BETWEEN 0 AND 1439 GROUP BY key"),
    query("bitpos_set", lambda t: b.first_set(event_bits(t)), f"SELECT key, min(pos) AS pos FROM {EVENT_BITS} GROUP BY key"),
    query("bitpos_clear", lambda t: b.first_clear(event_bits(t)), f"SELECT k.key, (SELECT min(p) FROM range(0, 100000) r(p) WHERE NOT EXISTS (SELECT 1 FROM {EVENT_BITS} e WHERE e.key = k.key AND e.pos = r.p)) AS pos FROM (SELECT DISTINCT key FROM {EVENT_BITS}) k"),
    query("bitpos_clear_range", lambda t: b.first_clear(event_bits(t), 0, 1),
          f"SELECT k.key, coalesce((SELECT min(p) FROM range(0, 16) r(p) WHERE NOT EXISTS (SELECT 1 FROM {EVENT_BITS} e WHERE e.key = k.key AND e.pos = r.p)), -1) AS pos FROM (SELECT DISTINCT key FROM {EVENT_BITS}) k"),
    query("bitop_and", lambda t: b.combine(event_bits(t), THREE, "and"), f"SELECT pos FROM {EVENT_BITS} WHERE {IN_THREE} GROUP BY pos HAVING count(*) = 3"),
    query("bitop_or", lambda t: b.combine(event_bits(t), THREE, "or"), f"SELECT DISTINCT pos FROM {EVENT_BITS} WHERE {IN_THREE}"),
    query("bitop_xor", lambda t: b.combine(event_bits(t), THREE, "xor"), f"SELECT pos FROM {EVENT_BITS} WHERE {IN_THREE} GROUP BY pos HAVING count(*) % 2 = 1"),
    query("bitop_not", lambda t: b.complement(event_bits(t), "act:view"), f"SELECT p AS pos FROM range(0, 100000) r(p) WHERE p < (SELECT (max(pos) // 8) * 8 + 8 FROM {EVENT_BITS} WHERE key = 'act:view') AND p NOT IN (SELECT pos FROM {EVENT_BITS} WHERE key = 'act:view')"),
    query("bitfield_get", lambda t: registers(t).select("p_partkey", field(t, 0).alias("high"), field(t, 8).alias("low")), f"SELECT p_partkey, r >> 8 AS high, r & 255 AS low FROM {REGISTERS}"),
    query("bitfield_set", lambda t: registers(t).select("p_partkey", b.set_field(F.col("r"), 4, 52, F.lit(9).cast("long")).alias("v")), f"SELECT p_partkey, (r & 61695) | 2304 AS v FROM {REGISTERS}"),
    query("bitfield_incrby_wrap", grown("wrap"), f"SELECT p_partkey, ((r & 255) + 100) % 256 AS v FROM {REGISTERS}"),
    query("bitfield_incrby_sat", grown("sat"), f"SELECT p_partkey, least((r & 255) + 100, 255) AS v FROM {REGISTERS}"),
    query("bitfield_incrby_fail", grown("fail"), f"SELECT p_partkey, CASE WHEN (r & 255) + 100 <= 255 THEN (r & 255) + 100 END AS v FROM {REGISTERS}"),
    query("tsetbit", lambda t: b.fragments(b.set_bits(flips(t))[0]).select("key", "frag_id", F.bitmap_count("bits").alias("n")), f"SELECT key, pos // 8192 AS frag_id, count(*) AS n FROM (SELECT key, pos FROM {FLIPS} GROUP BY key, pos HAVING arg_max(bit, seq) = 1) GROUP BY 1, 2"),
    query("tbitcount", lambda t: b.fragment_counts(b.fragments(event_bits(t))), f"SELECT key, count(*) AS n FROM {EVENT_BITS} GROUP BY key"),
    query("tbitop_or", lambda t: b.fragment_union(b.fragments(event_bits(t)), THREE).select("frag_id", F.bitmap_count("bits").alias("n")), f"SELECT pos // 8192 AS frag_id, count(DISTINCT pos) AS n FROM {EVENT_BITS} WHERE {IN_THREE} GROUP BY 1"),
    query("tgetbit", lambda t: b.fragment_get(b.fragments(event_bits(t)), asked(t)),
          f"SELECT a.key, a.pos, CASE WHEN e.key IS NULL THEN 0 ELSE 1 END AS bit FROM {ASKED} a LEFT JOIN {EVENT_BITS} e ON a.key = e.key AND a.pos = e.pos"),
    query("tbitpos", lambda t: b.fragment_first_set(b.fragments(event_bits(t))), f"SELECT key, min(pos) AS pos FROM {EVENT_BITS} GROUP BY key"),
    query("tbitop_and", lambda t: b.fragment_intersection(b.fragments(event_bits(t)), THREE).select("frag_id", F.bitmap_count("bits").alias("n")).where("n > 0"),
          f"SELECT pos // 8192 AS frag_id, count(*) AS n FROM (SELECT pos FROM {EVENT_BITS} WHERE {IN_THREE} GROUP BY pos HAVING count(*) = 3) GROUP BY 1"),
    query("bitfield_chain", chained, CHAINED),
    query("tbitop_xor", lambda t: b.positions(b.word_combine(event_words(t), THREE, "xor")), f"SELECT pos FROM {EVENT_BITS} WHERE {IN_THREE} GROUP BY pos HAVING count(*) % 2 = 1"),
    query("tbitop_not", lambda t: b.positions(b.word_not(event_words(t), "act:view")), f"SELECT p AS pos FROM range(0, 100000) r(p) WHERE p < (SELECT (max(pos) // 8) * 8 + 8 FROM {EVENT_BITS} WHERE key = 'act:view') AND p NOT IN (SELECT pos FROM {EVENT_BITS} WHERE key = 'act:view')"),
    query("tbitcount_range", lambda t: b.word_counts(event_words(t), 100, 333), f"SELECT key, count_if(pos BETWEEN 800 AND 2671) AS n FROM {EVENT_BITS} GROUP BY key"),
    query("tbitpos_range", lambda t: b.word_first(event_words(t), 1, 101, 900), f"SELECT key, coalesce(min(CASE WHEN pos BETWEEN 808 AND 7207 THEN pos END), -1) AS pos FROM {EVENT_BITS} GROUP BY key"),
    query("tbitpos_clear", lambda t: b.word_first(event_words(t), 0), f"SELECT k.key, (SELECT min(p) FROM range(0, 100000) r(p) WHERE NOT EXISTS (SELECT 1 FROM {EVENT_BITS} e WHERE e.key = k.key AND e.pos = r.p)) AS pos FROM (SELECT DISTINCT key FROM {EVENT_BITS}) k"),
    query("tbitfield_get", lambda t: b.word_fields(event_words(t), hours(t), "u5"), f"SELECT key, o AS offset, v AS value FROM ({FIVE})"),
    query("tbitfield_incrby", lambda t: grown_fields(t)[1], f"SELECT key, o AS offset, (v + 7) % 32 AS value FROM ({FIVE})"),
    query("tbitfield_incrby_fail", lambda t: grown_fields(t, "fail")[1], f"SELECT key, o AS offset, CASE WHEN v + 7 <= 31 THEN v + 7 END AS value FROM ({FIVE})"),
    query("tbitfield_set", lambda t: b.word_counts(grown_fields(t)[0]),
          f"SELECT key, CAST(sum(n) AS BIGINT) AS n FROM (SELECT key, count(*) AS n FROM {EVENT_BITS} WHERE pos % 60 > 4 GROUP BY key UNION ALL SELECT key, sum(bit_count((v + 7) % 32)) FROM ({FIVE}) GROUP BY key) GROUP BY key"),
]
