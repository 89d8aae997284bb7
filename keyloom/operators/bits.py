"""Bitmaps: ``(key, pos)`` of set bits, position 0 being the highest bit of the first byte; fragments of them; and bit
fields of 64-bit registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAGMENT_BITS = 8192


def set_bits(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Applies ``(key, pos, seq, bit)``: the bits that are set in the end, and for each command the bit it found."""
    order = Window.partitionBy("key", "pos").orderBy("seq")
    old = log.withColumn("old", F.coalesce(F.lag("bit").over(order), F.lit(0)))
    last = log.groupBy("key", "pos").agg(F.max_by("bit", "seq").alias("bit"))
    return last.where("bit = 1").select("key", "pos"), old


def get_bits(bits: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(key, pos)`` with ``bit``."""
    return asked.join(bits.withColumn("bit", F.lit(1)), ["key", "pos"], "left").select("key", "pos", F.coalesce("bit", F.lit(0)).alias("bit"))


def count_bits(bits: DataFrame, first_byte: int | None = None, last_byte: int | None = None) -> DataFrame:
    """Set bits of each key in an inclusive range of bytes."""
    if first_byte is not None:
        bits = bits.where(F.col("pos").between(8 * first_byte, 8 * last_byte + 7))
    return bits.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def first_set(bits: DataFrame, first_byte: int = 0, last_byte: int | None = None) -> DataFrame:
    """The first set position of each key, within an inclusive range of bytes if there is one; keys without any are
    left out."""
    inside = F.col("pos") >= 8 * first_byte
    if last_byte is not None:
        inside = inside & (F.col("pos") <= 8 * last_byte + 7)
    return bits.where(inside).groupBy("key").agg(F.min("pos").alias("pos"))


def first_clear(bits: DataFrame, first_byte: int = 0, last_byte: int | None = None) -> DataFrame:
    """The first position without a bit: the least of the range's start and the places right after a bit that hold none.

    Without an end the bitmap goes on with zeros; within a given end a full range has none, which is -1.  Positions meet by a
    shuffle on both columns, so one long bitmap is no single task."""
    start = F.lit(8 * first_byte).cast("long")
    inside = bits.where(F.col("pos") >= start).select("key", "pos")
    places = inside.select("key", F.col("pos") + 1).union(bits.select("key", start).distinct()).toDF("key", "pos")
    found = F.min("pos")
    if last_byte is not None:
        found = F.when(found <= 8 * last_byte + 7, found).otherwise(-1)
    return places.join(inside, ["key", "pos"], "left_anti").groupBy("key").agg(found.cast("long").alias("pos"))


def combine(bits: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``and``, ``or`` or ``xor`` of bitmaps: a count by position."""
    counts = bits.where(F.col("key").isin(keys)).groupBy("pos").agg(F.count(F.lit(1)).alias("n"))
    test = {"and": F.col("n") == len(set(keys)), "or": F.lit(True), "xor": F.col("n") % 2 == 1}[how]
    return counts.where(test).select("pos")


def _upto(ends: DataFrame, name: str, piece: int = 65_536) -> DataFrame:
    """All numbers from 0 below ``_end``, made in pieces by many tasks."""
    starts = ends.select("_end", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_end") - 1, F.lit(piece).cast("long"))).alias("_from"))
    last = F.least(F.col("_from") + piece, "_end") - 1
    return starts.repartition("_from").select(F.explode(F.sequence("_from", last)).alias(name))


def complement(bits: DataFrame, key: str) -> DataFrame:
    """All clear positions up to the last byte that has a bit."""
    own = bits.where(F.col("key") == key).select("pos")
    end = own.agg(((F.max("pos") / 8).cast("long") * 8 + 8).alias("_end")).where("_end IS NOT NULL")
    return _upto(end, "pos").join(own, "pos", "left_anti")


def fragments(bits: DataFrame) -> DataFrame:
    """Bitmaps in fragments: ``(key, frag_id, bits)``; a fragment's size is fixed, however long the bitmap is."""
    at = F.col("pos")
    return bits.groupBy("key", F.floor(at / FRAGMENT_BITS).alias("frag_id")).agg(F.bitmap_construct_agg(at % FRAGMENT_BITS).alias("bits"))


def fragment_counts(frags: DataFrame) -> DataFrame:
    return frags.groupBy("key").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def fragment_union(frags: DataFrame, keys: list[str]) -> DataFrame:
    """Bitwise or, fragment by fragment."""
    return frags.where(F.col("key").isin(keys)).groupBy("frag_id").agg(F.bitmap_or_agg("bits").alias("bits"))


def get_field(register: Column, width: int, offset: int, signed: bool) -> Column:
    """A bit field of a 64-bit register, counted from its highest bit."""
    left = F.shiftleft(register, offset)
    return F.shiftright(left, 64 - width) if signed else F.shiftrightunsigned(left, 64 - width)


def set_field(register: Column, width: int, offset: int, value: Column) -> Column:
    shift = 64 - width - offset
    mask = ((1 << width) - 1) << shift
    mask = mask - (1 << 64) if mask >= 1 << 63 else mask
    placed = F.shiftleft(value, shift).bitwiseAND(F.lit(mask))
    return register.bitwiseAND(F.lit(~mask)).bitwiseOR(placed)


def increment_field(register: Column, width: int, offset: int, signed: bool, delta: Column, overflow: str = "wrap") -> Column:
    """The field after adding; ``overflow`` is ``wrap``, ``sat`` (stop at the end of the range) or ``fail`` (null).  Fields of
    up to 62 bits."""
    low, high = (-(1 << (width - 1)), (1 << (width - 1)) - 1) if signed else (0, (1 << width) - 1)
    total = get_field(register, width, offset, signed) + delta
    if overflow == "sat":
        return F.greatest(F.least(total, F.lit(high)), F.lit(low))
    if overflow == "fail":
        return F.when(total.between(low, high), total)
    return F.pmod(total - F.lit(low), F.lit(1 << width)) + F.lit(low)


def fragment_get(frags: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(key, pos)`` with ``bit``; only the fragment of each position is met."""
    asked = asked.withColumn("frag_id", F.floor(F.col("pos") / FRAGMENT_BITS))
    inside = (F.col("pos") % FRAGMENT_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("bits", (inside / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, cast(pos % 8 as int)) & 1")
    found = asked.join(frags, ["key", "frag_id"], "left").withColumn("_byte", byte)
    return found.select("key", "pos", F.coalesce(bit, F.lit(0)).alias("bit"))


def fragment_first_set(frags: DataFrame) -> DataFrame:
    """First set position of each key: of the first fragment with a bit, the first byte that is not zero."""
    first = frags.where(F.bitmap_count("bits") > 0).groupBy("key").agg(F.min_by("bits", "frag_id").alias("bits"), F.min("frag_id").alias("frag_id"))
    zeros = (F.length(F.regexp_extract(F.hex("bits"), "^(00)*", 0)) / 2).cast("int")
    byte = F.conv(F.hex(F.substring("bits", zeros + 1, F.lit(1))), 16, 10).cast("int")
    low = F.round(F.log2(byte.bitwiseAND(-byte).cast("double"))).cast("int")
    return first.select("key", (F.col("frag_id") * FRAGMENT_BITS + zeros * 8 + low).cast("long").alias("pos"))


def fragment_intersection(frags: DataFrame, keys: list[str]) -> DataFrame:
    """Bitwise and, fragment by fragment; a fragment that one key lacks is zero."""
    chosen = frags.where(F.col("key").isin(keys)).groupBy("frag_id").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("_n"))
    return chosen.where(F.col("_n") == len(set(keys))).drop("_n")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by.cast("int"))


def _kind(kind: str) -> tuple[bool, int]:
    """``i1`` to ``i64`` and ``u1`` to ``u63``: whether signed, and the width."""
    signed, width = kind[0] == "i", int(kind[1:])
    if kind[0] not in "iu" or not 1 <= width <= 63 + signed:
        raise ValueError(f"no such type of field: {kind}")
    return signed, width


def _sum_in_range(old: Column, delta: Column, signed: bool, width: int, overflow: str) -> Column:
    """``old + delta`` within the field's range; decimals hold what a long cannot."""
    low, high = (-(1 << (width - 1)), (1 << (width - 1)) - 1) if signed else (0, (1 << width) - 1)
    whole = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    total = old.cast("decimal(20,0)") + delta.cast("decimal(20,0)")
    if overflow == "sat":
        return F.greatest(F.least(total, whole(high)), whole(low)).cast("long")
    if overflow == "fail":
        return F.when(total.between(whole(low), whole(high)), total.cast("long"))
    if overflow != "wrap":
        raise ValueError(f"no such overflow: {overflow}")
    return (F.pmod(total - whole(low), whole(1 << width)) + whole(low)).cast("long")


def get_bytes_field(raw: Column, kind: str, offset: int) -> Column:
    """A field that starts at any bit of a byte string; bytes beyond its end are zero."""
    signed, width = _kind(kind)
    nine = F.rpad(F.substring(raw, offset // 8 + 1, 9), 9, F.lit(bytearray(1)))
    number = lambda x: F.conv(F.hex(x), 16, -10).cast("long")
    left = F.shiftleft(number(F.substring(nine, 1, 8)), offset % 8).bitwiseOR(F.shiftrightunsigned(number(F.substring(nine, 9, 1)), 8 - offset % 8))
    return F.shiftright(left, 64 - width) if signed else F.shiftrightunsigned(left, 64 - width)


def set_bytes_field(raw: Column, kind: str, offset: int, value: Column) -> Column:
    """The byte string with a field overwritten, grown by zero bytes up to the field's end; a null value changes nothing."""
    _, width = _kind(kind)
    at, shift = offset // 8, offset % 8
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    mask = ((1 << width) - 1) << (64 - width)
    high_mask, low_mask = mask >> shift, (mask << (8 - shift)) & 255
    n = F.greatest(F.octet_length(raw), F.lit((offset + width + 7) // 8))
    placed = F.shiftleft(value.cast("long"), 64 - width)

    def written(padded: Column) -> Column:
        number = lambda x: F.conv(F.hex(x), 16, -10).cast("long")
        high = number(F.substring(padded, at + 1, 8)).bitwiseAND(F.lit(signed(~high_mask & (1 << 64) - 1)))
        low = number(F.substring(padded, at + 9, 1)).bitwiseAND(F.lit(255 - low_mask))
        high = high.bitwiseOR(F.shiftrightunsigned(placed, shift).bitwiseAND(F.lit(signed(high_mask))))
        low = low.bitwiseOR(F.shiftleft(placed, 8 - shift).bitwiseAND(F.lit(low_mask)))
        made = F.concat(F.unhex(F.lpad(F.hex(high), 16, "0")), F.unhex(F.lpad(F.hex(low), 2, "0")))
        return F.substring(F.concat(F.substring(padded, 1, at), made, F.substring(padded, at + 10, 1 << 30)), F.lit(1), n)

    padded = F.rpad(raw, F.greatest(F.octet_length(raw), F.lit(at + 9)), F.lit(bytearray(1)))
    return F.when(value.isNull(), raw).otherwise(_let(padded, written))


def _field_step(what: str, kind: str, at: int, overflow: str, number: Column | int | None = None) -> Callable[[Column], Column]:
    """One command on a struct of a byte string and the results so far."""
    if what not in ("get", "set", "incrby"):
        raise ValueError(f"no such command: {what}")
    number = number if isinstance(number, Column) else F.lit(number)

    def step(s: Column) -> Column:
        def after(value: Column, result: Column) -> Column:
            return F.struct(value.alias("value"), F.array_append(s["results"], result).alias("results"))

        old = get_bytes_field(s["value"], kind, at)
        if what == "get":
            return after(s["value"], old)
        if what == "set":
            return after(set_bytes_field(s["value"], kind, at, number), old)
        return _let(_sum_in_range(old, number, *_kind(kind), overflow), lambda new: after(set_bytes_field(s["value"], kind, at, new), new))

    return step


def bitfield(value: Column, ops: list[tuple]) -> Column:
    """Runs ``ops`` on a byte string one after the other: a struct of the new ``value`` and ``results``, one for each of them.

    ``("get", kind, offset)``; ``("set", kind, offset, n)``, whose result is the old field; ``("incrby", kind, offset, delta)``, whose
    result is the new one; ``("overflow", how)`` rules the increments after it.  An offset ``"#3"`` counts fields of that
    kind.  An increment that fails gives null.  A null value is an empty string."""
    overflow = "wrap"
    state = F.struct(F.coalesce(value.cast("binary"), F.lit(bytearray())).alias("value"), F.array().cast("array<bigint>").alias("results"))
    for op in ops:
        if op[0] == "overflow":
            overflow = op[1]
            continue
        what, kind, offset, *rest = op
        at = int(offset[1:]) * _kind(kind)[1] if isinstance(offset, str) else offset
        state = _let(state, _field_step(what, kind, at, overflow, *rest))
    return state


def words(bits: DataFrame) -> DataFrame:
    """Bitmaps in words: ``(key, word, bits)``, 64 positions a row, the lowest position being the highest bit.  Words
    without a bit have no row."""
    at = _shift("shiftleft", F.lit(1).cast("long"), 63 - F.pmod("pos", F.lit(64)))
    return bits.groupBy("key", F.floor(F.col("pos") / 64).alias("word")).agg(F.bit_or(at).alias("bits"))


def positions(ws: DataFrame) -> DataFrame:
    """The set positions of words."""
    digits = F.lpad(F.bin("bits"), 64, "0")
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.substring(digits, i + 1, F.lit(1)) == "1")
    return ws.select(*[c for c in ws.columns if c not in ("word", "bits")], F.explode(places).alias("_i"), "word").withColumn("pos", F.col("word") * 64 + F.col("_i")).drop("_i", "word")


def _masked(ws: DataFrame, first_byte: int, last_byte: int | None) -> DataFrame:
    """Words cut to an inclusive range of bytes."""
    def ones(low: int, high: int) -> int:
        x = ((1 << (high - low + 1)) - 1) << (63 - high)
        return x - (1 << 64) if x >> 63 else x

    first, last = 8 * first_byte, None if last_byte is None else 8 * last_byte + 7
    test, cut = F.col("word") >= first // 64, F.when(F.col("word") == first // 64, F.lit(ones(first % 64, 63))).otherwise(F.lit(-1).cast("long"))
    if last is not None:
        test = test & (F.col("word") <= last // 64)
        cut = cut.bitwiseAND(F.when(F.col("word") == last // 64, F.lit(ones(0, last % 64))).otherwise(F.lit(-1).cast("long")))
    return ws.where(test).withColumn("bits", F.col("bits").bitwiseAND(cut))


def word_counts(ws: DataFrame, first_byte: int = 0, last_byte: int | None = None) -> DataFrame:
    """Set bits of each key in an inclusive range of bytes, 0 where there are none."""
    counts = _masked(ws, first_byte, last_byte).groupBy("key").agg(F.sum(F.bit_count("bits")).alias("_n"))
    return ws.select("key").distinct().join(counts, "key", "left").select("key", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def word_first(ws: DataFrame, bit: int = 1, first_byte: int = 0, last_byte: int | None = None) -> DataFrame:
    """The first position of each key that is set, or clear, in an inclusive range of bytes; -1 if there is none.  Without
    an end a bitmap goes on with zeros."""
    first, last = 8 * first_byte, None if last_byte is None else 8 * last_byte + 7
    if bit:
        hits = _masked(ws, first_byte, last_byte).where("bits <> 0").groupBy("key").agg(F.min(F.struct("word", "bits")).alias("w"))
        found = F.col("w.word") * 64 + 64 - F.length(F.bin("w.bits"))
    else:
        start = F.lit(first // 64).cast("long")
        full = ws.where((F.col("word") >= start) & (F.col("bits") == -1)).select("key", "word")
        places = full.select("key", F.col("word") + 1).union(ws.select("key", start).distinct()).toDF("key", "word")
        # in the range's first word the bits before it do not count, so it may be full and the word after it is a place too
        places = places.union(ws.where(F.col("word") == start).select("key", F.col("word") + 1)).distinct()
        ones = (1 << 64) - (1 << (64 - first % 64))
        before = F.when(F.col("word") == start, F.lit(ones - (1 << 64) if ones else 0)).otherwise(F.lit(0).cast("long"))
        rest = places.join(full, ["key", "word"], "left_anti").join(ws, ["key", "word"], "left")
        clear = rest.withColumn("bits", F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long")).bitwiseOR(before))).where("bits <> 0")
        hits = clear.groupBy("key").agg(F.min(F.struct("word", "bits")).alias("w"))
        found = F.col("w.word") * 64 + 64 - F.length(F.bin("w.bits"))
        if last is not None:
            found = F.when(found <= last, found)
    return ws.select("key").distinct().join(hits, "key", "left").select("key", F.coalesce(found, F.lit(-1)).cast("long").alias("pos"))


def word_combine(ws: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``and``, ``or`` or ``xor`` of bitmaps, word by word."""
    fold = {"and": F.bit_and, "or": F.bit_or, "xor": F.bit_xor}[how]
    out = ws.where(F.col("key").isin(keys)).groupBy("word").agg(fold("bits").alias("bits"), F.count(F.lit(1)).alias("_n"))
    return (out.where(F.col("_n") == len(set(keys))) if how == "and" else out).where("bits <> 0").drop("_n")


def word_not(ws: DataFrame, key: str) -> DataFrame:
    """The clear bits up to the last byte that has a bit."""
    own = ws.where(F.col("key") == key).select("word", "bits")
    top = own.where("bits <> 0").agg(F.max(F.struct("word", "bits")).alias("w")).where("w IS NOT NULL")
    last = F.floor((F.length(F.rtrim(F.lpad(F.bin("w.bits"), 64, "0"), F.lit("0"))) - 1) / 8)
    ends = top.select((F.col("w.word") + 1).alias("_end"), (F.col("w.word") * 8 + last).alias("_last"))
    flipped = _upto(ends, "word").join(own, "word", "left").select("word", F.bitwise_not(F.coalesce("bits", F.lit(0).cast("long"))).alias("bits"))
    # beyond the last byte nothing is flipped; there is one row of ends
    cut = _shift("shiftleft", F.lit(-1).cast("long"), 56 - 8 * F.pmod("_last", F.lit(8)))
    cut = F.when(F.col("word") == F.col("_end") - 1, cut).otherwise(F.lit(-1).cast("long"))
    return flipped.join(F.broadcast(ends)).select("word", F.col("bits").bitwiseAND(cut).alias("bits")).where("bits <> 0")


def word_fields(ws: DataFrame, asked: DataFrame, kind: str) -> DataFrame:
    """``asked(key, offset)`` with ``value``, the field of that kind at the offset; a field lies in one word or two."""
    signed, width = _kind(kind)
    shift = F.pmod("offset", F.lit(64))
    found = asked.withColumn("word", F.floor(F.col("offset") / 64))
    for name, by in (("_w0", 0), ("_w1", 1)):
        found = found.join(ws.select("key", (F.col("word") - by).alias("word"), F.col("bits").alias(name)), ["key", "word"], "left")
    w0, w1 = (F.coalesce(c, F.lit(0).cast("long")) for c in ("_w0", "_w1"))
    left = F.when(shift == 0, w0).otherwise(_shift("shiftleft", w0, shift).bitwiseOR(_shift("shiftrightunsigned", w1, 64 - shift)))
    value = F.shiftright(left, 64 - width) if signed else F.shiftrightunsigned(left, 64 - width)
    return found.select("key", "offset", value.alias("value"))


def set_word_fields(ws: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """Words after writing ``new(key, offset, value, seq)``; where fields overlap the last ``seq`` wins bit by bit."""
    _, width = _kind(kind)
    each = new.select("key", "seq", "value", "offset", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("_i"))
    bit = _shift("shiftrightunsigned", F.col("value").cast("long"), F.lit(width - 1) - F.col("_i")).bitwiseAND(F.lit(1))
    last = each.groupBy("key", (F.col("offset") + F.col("_i")).alias("pos")).agg(F.max_by(bit, "seq").alias("bit"))
    at = lambda x: _shift("shiftleft", x.cast("long"), 63 - F.pmod("pos", F.lit(64)))
    written = last.groupBy("key", F.floor(F.col("pos") / 64).alias("word")).agg(F.bit_or(at(F.lit(1))).alias("_mask"), F.bit_or(at(F.col("bit"))).alias("_ones"))
    old, mask, ones = (F.coalesce(c, F.lit(0).cast("long")) for c in ("bits", "_mask", "_ones"))
    return ws.join(written, ["key", "word"], "full").select("key", "word", old.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(ones).alias("bits")).where("bits <> 0")


def increment_word_fields(ws: DataFrame, deltas: DataFrame, kind: str, overflow: str = "wrap") -> tuple[DataFrame, DataFrame]:
    """Adds ``deltas(key, offset, delta)``, each field once, to fields that do not overlap: the words, and ``(key, offset, value)`` with the
    new fields, null where ``fail`` refused."""
    signed, width = _kind(kind)
    found = word_fields(ws, deltas.select("key", "offset"), kind).join(deltas, ["key", "offset"])
    found = found.select("key", "offset", _sum_in_range(F.col("value"), F.col("delta"), signed, width, overflow).alias("value"))
    return set_word_fields(ws, found.where("value IS NOT NULL").withColumn("seq", F.lit(0)), kind), found
