"""Keys, expiry and slots.

``now`` is always an argument.  A key is live while ``expire_at_ms`` is 0 or above ``now``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 16384


def live(now_ms: int, expire_at: Column | None = None) -> Column:
    at = F.col("expire_at_ms") if expire_at is None else expire_at
    return (at == 0) | (at > F.lit(now_ms))


def pttl(now_ms: int) -> Column:
    """Milliseconds left: -1 without expiry, -2 once expired."""
    at = F.col("expire_at_ms")
    return F.when(at == 0, F.lit(-1)).when(at <= now_ms, F.lit(-2)).otherwise(at - now_ms).cast("long")


def ttl(now_ms: int) -> Column:
    """Seconds left, rounded to the nearest."""
    left = pttl(now_ms)
    return F.when(left < 0, left).otherwise(F.floor((left + 500) / 1000)).cast("long")


def expire_at(keys: DataFrame, now_ms: int, at: Column) -> DataFrame:
    """Sets deadlines; a deadline that is not after ``now`` deletes the key."""
    return keys.where(live(now_ms)).withColumn("expire_at_ms", at.cast("long")).where(F.col("expire_at_ms") > now_ms)


def persist(keys: DataFrame, now_ms: int) -> DataFrame:
    """Drops deadlines of live keys; ``changed`` tells which had one."""
    return keys.where(live(now_ms)).select("key", (F.col("expire_at_ms") != 0).cast("int").alias("changed"), F.lit(0).cast("long").alias("expire_at_ms"))


def exists(keys: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(key)`` with ``n``, the times it names a key that exists."""
    hits = asked.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return asked.distinct().join(hits, "key", "left").select("key", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def delete(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys.select("key"), "key", "left_anti")


def rename(rows: DataFrame, moves: DataFrame, only_absent: bool = False) -> DataFrame:
    """Moves rows of key ``source`` to key ``target``, which loses its own rows.

    ``moves(source, target)`` names each key at most once on either side.  With ``only_absent`` a move onto an existing
    key does not happen.  Moves of missing keys, and of a key onto itself, change nothing."""
    keys = rows.select(F.col("key").alias("source")).distinct()
    moves = moves.where("source <> target").join(keys, "source", "left_semi")
    if only_absent:
        moves = moves.join(keys.withColumnRenamed("source", "target"), "target", "left_anti")
    rest = rows.join(moves.select(F.col("target").alias("key")), "key", "left_anti")
    new = rest.join(moves.withColumnRenamed("source", "key"), "key", "left").withColumn("key", F.coalesce("target", "key"))
    return new.select(*rows.columns)


def _crc16_table() -> list[int]:
    """CRC-16 with polynomial 0x1021, most significant bit first."""
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
        out.append(crc)
    return out


def crc16(text: Column) -> Column:
    """CRC-16 of the text's bytes, as an expression over its hex digits."""
    table = F.array(*[F.lit(x) for x in _crc16_table()])
    hex_digits = F.hex(F.encode(text, "utf-8"))
    n = F.octet_length(text)
    byte = lambda i: F.conv(F.substring(hex_digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")

    def step(crc: Column, i: Column) -> Column:
        at = F.shiftright(crc, 8).bitwiseXOR(byte(i)).bitwiseAND(F.lit(255))
        return F.shiftleft(crc, 8).bitwiseAND(F.lit(0xFFFF)).bitwiseXOR(F.get(table, at))

    return F.when(n == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step))


def key_slot(key: Column) -> Column:
    """Hash slot: of the part in the first braces, if there is one that is not empty, else of the whole key."""
    tag = F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1)
    return crc16(F.when(tag != "", tag).otherwise(key)).bitwiseAND(F.lit(SLOTS - 1))


def _escaped(c: str) -> str:
    return c if c.isalnum() or c == "_" else "\\" + c


def _glob_class(body: str) -> str:
    """A regular expression's class for what stands between the brackets: members, ranges, ``\\`` before a literal, ``^`` first."""
    negated = body.startswith("^")
    chars, i = [], int(negated)
    while i < len(body):
        literal = body[i] == "\\" and i + 1 < len(body)
        i += literal
        chars.append((body[i], literal))
        i += 1
    out, i = [], 0
    while i < len(chars):
        c = chars[i][0]
        if i + 2 < len(chars) and chars[i + 1] == ("-", False):
            low, high = sorted((c, chars[i + 2][0]))
            out.append(f"{_escaped(low)}-{_escaped(high)}")
            i += 3
        else:
            out.append(_escaped(c))
            i += 1
    if not out:
        return "." if negated else "(?!)"  # any character, or none
    return "[" + "^" * negated + "".join(out) + "]"


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression for a glob with ``*``, ``?``, ``[...]`` and backslash."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = i + 1
        while end < len(pattern) and pattern[end] != "]":
            end += 2 if pattern[end] == "\\" else 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and end < len(pattern):
            out.append(_glob_class(pattern[i + 1 : end]))
            i = end
        else:
            if c == "\\" and i + 1 < len(pattern):
                i += 1
                c = pattern[i]
            out.append(_escaped(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def matches(column: Column, pattern: str) -> Column:
    """Glob match.  A literal prefix becomes ``startswith``, which reaches the scan."""
    prefix = ""
    for c in pattern:
        if c in "*?[\\":
            break
        prefix += c
    if prefix == pattern:
        return column == pattern
    if pattern == prefix + "*":
        return column.startswith(prefix) if prefix else column.isNotNull()
    test = column.rlike(glob_to_regex(pattern))
    return column.startswith(prefix) & test if prefix else test


def page(rows: DataFrame, order: list[str], after: tuple | None, n: int) -> DataFrame:
    """The next ``n`` rows after a position, by keyset: no rows before the position are counted off."""
    if after is not None:
        conditions = []
        for i, name in enumerate(order):
            same = [F.col(c) == F.lit(v) for c, v in zip(order[:i], after[:i], strict=True)]
            conditions.append(reduce(lambda x, y: x & y, [*same, F.col(name) > F.lit(after[i])]))
        rows = rows.where(reduce(lambda x, y: x | y, conditions))
    return rows.orderBy(*order).limit(n)


def scan(rows: DataFrame, by: str, after: str | None, count: int, test: Column | None = None) -> DataFrame:
    """The next ``count`` rows after ``after`` that pass a test, and ``cursor``: where the next page goes on, null once nothing is
    left.  Patterns, types and slots go into the test, so a page is full as long as there are rows for it."""
    found = page(rows if test is None else rows.where(test), [by], None if after is None else (after,), count + 1)
    # one window over a page and a row
    numbered = found.withColumns({"_i": F.row_number().over(Window.orderBy(by)), "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    last = F.max(F.when(F.col("_i") <= count, F.col(by))).over(Window.partitionBy())
    return numbered.withColumn("cursor", F.when(F.col("_n") > count, last)).where(F.col("_i") <= count).drop("_i", "_n")
