"""Known small cases and models in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import bits, hashes, keyspace, lists, sets, sketches, strings, zsets
from keyloom.plans import fixtures
from keyloom.plans.base import Tables
from keyloom.sources import changelog, dumps


def one(spark, value, schema="value string"):
    return spark.createDataFrame([(value,)], schema)


def test_bytes_not_characters(spark):
    df = one(spark, "é")
    assert df.select(strings.strlen(F.col("value"))).first()[0] == 2
    assert one(spark, None).select(strings.strlen(F.col("value"))).first()[0] == 0


def test_get_range(spark):
    df = one(spark, "This is a string")
    get = lambda s, e: bytes(df.select(strings.byte_range(F.col("value"), s, e)).first()[0]).decode()
    assert get(-3, -1) == "ing"
    assert get(0, 3) == "This"
    assert get(0, -1) == "This is a string"
    assert get(10, 100) == "string"
    assert get(5, 3) == ""


def test_set_range_pads(spark):
    df = one(spark, "ab")
    assert df.select(strings.set_range(F.col("value"), 4, "xy")).first()[0] == b"ab\0\0xy"
    assert one(spark, None).select(strings.set_range(F.col("value"), 0, "")).first()[0] == b""


def test_slot(spark):
    slots = {k: one(spark, k).select(keyspace.key_slot(F.col("value"))).first()[0] for k in ("123456789", "{user1}.a", "{user1}.b", "foo{}{bar}", "")}
    assert slots["123456789"] == 0x31C3 & 0x3FFF == 12739
    assert slots["{user1}.a"] == slots["{user1}.b"]
    assert slots[""] == 0


def test_glob(spark):
    names = spark.createDataFrame([("hello",), ("hallo",), ("hxllo",), ("heello",), ("h*llo",), ("other",)], "k string")
    found = lambda p: sorted(r.k for r in names.where(keyspace.matches(F.col("k"), p)).collect())
    assert found("h?llo") == ["h*llo", "hallo", "hello", "hxllo"]
    assert found("h[ae]llo") == ["hallo", "hello"]
    assert found("h[^e]llo") == ["h*llo", "hallo", "hxllo"]
    assert found("h\\*llo") == ["h*llo"]
    assert found("h*o") == ["h*llo", "hallo", "heello", "hello", "hxllo"]


def test_ttl(spark):
    keys = spark.createDataFrame([("a", 0), ("b", 1499), ("c", 1500), ("d", 1000)], "key string, expire_at_ms long")
    assert [r[0] for r in keys.orderBy("key").select(keyspace.ttl(1000)).collect()] == [-1, 0, 1, -2]


def test_equal_scores_rank_by_member(spark):
    z = spark.createDataFrame([("k", "c", 1.0), ("k", "a", 1.0), ("k", "b", 1.0)], "key string, member string, score double")
    assert [r.member for r in zsets.ranked(z).orderBy("rank").collect()] == ["a", "b", "c"]
    assert [r.member for r in zsets.ranked(z, reverse=True).orderBy("rank").collect()] == ["c", "b", "a"]


def test_infinities_that_cancel(spark):
    inf = float("inf")
    z = spark.createDataFrame([("a", "m", inf), ("b", "m", -inf)], "key string, member string, score double")
    assert zsets.combine(z, {"a": 1, "b": 1}).first().score == 0


def test_missing_operand_empties_an_intersection(spark):
    z = spark.createDataFrame([("a", "m", 1.0)], "key string, member string, score double")
    assert zsets.combine(z, {"a": 1, "none": 1}, all_keys=True).count() == 0


def test_range_ends(spark):
    rng = random.Random(1)
    rows = [("k", f"m{i:03}", float(rng.randrange(20))) for i in range(40)]
    z = spark.createDataFrame(rows, "key string, member string, score double").cache()
    order = [m for _, m, _ in sorted(rows, key=lambda r: (r[2], r[1]))]
    for start, stop in ((0, -1), (-3, -1), (3, 7), (-100, 2), (5, 2), (38, 100), (-5, 37)):
        low, high = (start if start >= 0 else max(40 + start, 0)), (stop if stop >= 0 else 40 + stop)
        got = [r.member for r in zsets.zrange(z, start, stop).orderBy("score", "member").collect()]
        assert got == order[low : high + 1], (start, stop)


def test_list_edits(spark):
    rows = spark.createDataFrame([("k", float(i), v) for i, v in enumerate("abcab")], "key string, idx double, value string").cache()
    text = lambda df: "".join(r.value for r in lists.positioned(df).orderBy("pos").collect())
    assert text(lists.insert(rows, "b", "X")) == "aXbcab"
    assert text(lists.insert(rows, "b", "X", after=True)) == "abXcab"
    assert text(lists.insert(rows, "zz", "X")) == "abcab"
    assert text(lists.remove_equal(rows, "a", 1)) == "bcab"
    assert text(lists.remove_equal(rows, "a", -1)) == "abcb"
    assert text(lists.remove_equal(rows, "b", 0)) == "aca"
    assert text(lists.replace_at(rows, -2, "X")) == "abcXb"
    assert text(lists.lrange(rows, -2, -1)) == "ab"
    pairs = spark.createDataFrame([("k", "k")], "source string, target string")
    assert text(lists.move_last(rows, pairs)) == "babca"


def test_versions(spark):
    log = spark.createDataFrame([("k", 1, 5, "a"), ("k", 2, 5, "b"), ("k", 3, 6, "c")], "key string, seq long, version long, value string")
    assert tuple(strings.compare_and_set(log).first()) == ("k", 7, "c", 2)


def test_fixed_windows(spark):
    log = spark.createDataFrame([("k", t) for t in (0, 5, 9, 10, 25)], "key string, ts_ms long")
    assert sorted(tuple(r)[1:] for r in strings.fixed_window_counter(log, 10).collect()) == [(0, 3), (10, 1), (25, 1)]


def test_field_overflow(spark):
    rng = random.Random(2)
    for width, signed in ((8, False), (5, True), (16, True)):
        low, high = (-(1 << width - 1), (1 << width - 1) - 1) if signed else (0, (1 << width) - 1)
        cases = [(rng.randint(low, high), rng.randint(-300, 300)) for _ in range(30)]
        df = spark.createDataFrame([(v << 64 - width if v >= 0 and v << 64 - width < 1 << 63 else (v << 64 - width) % (1 << 64) - (1 << 64) if (v << 64 - width) % (1 << 64) >= 1 << 63 else (v << 64 - width) % (1 << 64), v, d) for v, d in cases], "r long, v long, d long")
        up = lambda how: bits.increment_field(F.col("r"), width, 0, signed, F.col("d"), how)  # noqa: B023, E731
        for r in df.select("v", "d", bits.get_field(F.col("r"), width, 0, signed).alias("got"), up("wrap").alias("w"), up("sat").alias("s"), up("fail").alias("f")).collect():
            total = r.v + r.d
            assert r.got == r.v
            assert r.w == (total - low) % (1 << width) + low
            assert r.s == min(max(total, low), high)
            assert r.f == (total if low <= total <= high else None)


def test_bit_positions(spark):
    full = spark.createDataFrame([("k", i) for i in range(16)], "key string, pos long")
    assert bits.first_clear(full).first().pos == 16
    assert bits.first_clear(full, 0, 1).first().pos == -1
    assert bits.first_clear(full, 1, 5).first().pos == 16
    assert bits.first_set(full, 1, 1).first().pos == 8
    holes = spark.createDataFrame([("k", 3), ("k", 5)], "key string, pos long")
    assert bits.first_clear(holes).first().pos == 0
    assert bits.first_set(holes).first().pos == 3
    assert sorted(r.pos for r in bits.complement(holes, "k").collect()) == [0, 1, 2, 4, 6, 7]


def test_sketch_error(spark):
    for n in (1, 100, 30_000):
        rows = spark.range(n).selectExpr("'k' as key", "id")
        assert abs(sketches.estimate(sketches.sketched(rows, "id")).first().n - n) <= max(0.03 * n, 1)


def test_dump_round_trip(spark):
    rows = spark.createDataFrame([("k", "f", 'quote " and é'), ("k", "g", ""), ("l", "f", "x")], "key string, field string, value string")
    assert sorted(map(tuple, dumps.restore(dumps.dump(rows)).collect())) == sorted(map(tuple, rows.collect()))
    broken = dumps.dump(rows).withColumn("payload", F.concat("payload", F.lit(" ")))
    assert dumps.restore(broken).count() == 0


def test_log_refuses_what_was_applied(spark):
    state = spark.createDataFrame([("a", "old"), ("b", "old")], "key string, value string")
    log = spark.createDataFrame([("a", 1, "set", "late"), ("b", 2, "del", None), ("c", 3, "set", "new")], "key string, seq long, op string, value string")
    assert sorted(map(tuple, changelog.apply(state, log, applied=1).collect())) == [("a", "old"), ("c", "new")]


def test_hash_page_and_absent(spark):
    rows = spark.createDataFrame([("k", f, f) for f in "abcd"], "key string, field string, value string")
    assert sorted(r.field for r in hashes.page(rows, "a", 2).collect()) == ["b", "c"]
    new = spark.createDataFrame([("k", "a", "x", 1), ("k", "z", "1", 1), ("k", "z", "2", 2)], "key string, field string, value string, seq int")
    done = {r.field: r.value for r in hashes.put(rows, new, only_absent=True).collect()}
    assert done == {"a": "a", "b": "b", "c": "c", "d": "d", "z": "1"}


def test_scripts(spark):
    from keyloom.functions import Scripts

    scripts = Scripts()
    digest = scripts.load("upper(value)")
    assert scripts.exists(digest, "no") == [True, False]
    assert one(spark, "a").select(scripts.call(digest)).first()[0] == "A"


def test_bytes_inside_characters(spark):
    df = spark.createDataFrame([("é日",)], "value string")
    raw = "é日".encode()
    for start, stop in ((0, 0), (1, 3), (-2, -1), (4, 9), (9, 12)):
        assert df.select(strings.byte_range(F.col("value"), start, stop)).first()[0] == raw[start : stop + 1 if stop != -1 else None]
    assert df.select(strings.set_range(F.col("value"), 1, b"\xff")).first()[0] == raw[:1] + b"\xff" + raw[2:]


@pytest.mark.parametrize(
    "pattern, yes, no",
    [("a[[]b", ["a[b"], ["ab", "a]b"]), ("a[&&]b", ["a&b"], ["ab", "a&&b"]), ("[^a]x", ["bx"], ["ax"]), ("[z-a]", ["m"], ["M"]), ("[a-]", ["a", "-"], ["b"]), ("\\\\*", ["\\\\x"], ["x"]), ("[\\]]", ["]"], ["\\"]), ("a[", ["a["], ["a"]), ("[a^]", ["^"], ["b"])],
)
def test_globs(spark, pattern, yes, no):
    df = spark.createDataFrame([(x,) for x in yes + no], "key string")
    assert {r.key for r in df.where(F.regexp_like("key", F.lit(keyspace.glob_to_regex(pattern)))).collect()} == set(yes)


def python_field(raw, signed, width, offset):
    whole = int.from_bytes(raw.ljust((offset + width + 7) // 8, b"\0"), "big")
    n = max(len(raw), (offset + width + 7) // 8) * 8
    value = whole >> (n - offset - width) & (1 << width) - 1
    return value - (1 << width) if signed and value >> width - 1 else value


def python_set(raw, width, offset, value):
    n = max(len(raw), (offset + width + 7) // 8)
    whole, shift = int.from_bytes(raw.ljust(n, b"\0"), "big"), n * 8 - offset - width
    mask = ((1 << width) - 1) << shift
    return (whole & ~mask | (value << shift) & mask).to_bytes(n, "big")


def test_fields_of_byte_strings(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(bytearray(rng.randbytes(n)),) for n in (0, 1, 2, 8, 9, 17)] + [(None,)], "value binary").cache()
    for kind, offset in (("i64", 0), ("i64", 3), ("u63", 1), ("u63", 70), ("i1", 7), ("u1", 8), ("u8", "#2"), ("i13", 29), ("u12", 100)):
        signed, width = kind[0] == "i", int(kind[1:])
        at = int(offset[1:]) * width if isinstance(offset, str) else offset
        low, high = (-(1 << width - 1), (1 << width - 1) - 1) if signed else (0, (1 << width) - 1)
        new, delta = rng.randint(low, high), rng.choice([1, -1]) * rng.randint(0, (1 << 63) - 1)
        ops = [("get", kind, offset), ("set", kind, offset, new), ("incrby", kind, offset, delta), ("overflow", "fail"), ("incrby", kind, offset, delta), ("overflow", "sat"), ("incrby", kind, offset, delta)]
        for r in rows.select("value", bits.bitfield(F.col("value"), ops).alias("f")).collect():
            raw = bytes(r.value or b"")
            old = python_field(raw, signed, width, at)
            first = (new + delta - low) % (1 << width) + low
            second = first + delta if low <= first + delta <= high else None
            third = min(max((first if second is None else second) + delta, low), high)
            assert r.f.results == [old, old, first, second, third], (kind, offset)
            assert bytes(r.f.value) == python_set(raw, width, at, third), (kind, offset)
    with pytest.raises(ValueError):
        bits.bitfield(F.col("value"), [("get", "u64", 0)])


def test_words(spark):
    rng = random.Random(4)
    model = {"full": set(range(200)), "mixed": {rng.randrange(400) for _ in range(250)} | {399}, "late": {130}, "ends": {0, 63, 64, 127}}
    ws = bits.words(spark.createDataFrame([(k, p) for k, ps in model.items() for p in ps], "key string, pos long")).cache()
    assert {k: {r.pos for r in bits.positions(ws).where(F.col("key") == k).collect()} for k in model} == model
    for first, last in ((0, None), (0, 0), (1, 3), (7, 8), (8, 24), (24, 30), (16, None), (60, 70)):
        inside = range(8 * first, 1000 if last is None else 8 * last + 8)
        wanted = lambda test: {k: next((p for p in inside if test(p in ps)), -1) for k, ps in model.items()}  # noqa: B023, E731
        assert {r.key: r.n for r in bits.word_counts(ws, first, last).collect()} == {k: sum(p in ps for p in inside) for k, ps in model.items()}
        assert {r.key: r.pos for r in bits.word_first(ws, 1, first, last).collect()} == wanted(lambda x: x)
        assert {r.key: r.pos for r in bits.word_first(ws, 0, first, last).collect()} == wanted(lambda x: not x)
    got = lambda df: {r.pos for r in bits.positions(df).collect()}
    assert got(bits.word_combine(ws, ["full", "mixed"], "xor")) == model["full"] ^ model["mixed"]
    assert got(bits.word_combine(ws, ["full", "late"], "and")) == {130}
    assert got(bits.word_combine(ws, ["full", "none"], "and")) == set()
    for k, ps in model.items():
        assert got(bits.word_not(ws, k)) == set(range(max(ps) // 8 * 8 + 8)) - ps
    assert got(bits.word_not(ws, "none")) == set()
    new = spark.createDataFrame([("late", 60, -3, 1), ("late", 62, 5, 2), ("fresh", 5, 1, 1)], "key string, offset long, value long, seq int")
    after = bits.set_word_fields(ws, new, "i7").cache()
    assert {(r.key, r.offset): r.value for r in bits.word_fields(after, new.select("key", "offset"), "i7").collect()} == {("late", 60): -31, ("late", 62): 5, ("fresh", 5): 1}
    assert bits.word_counts(after).where("key = 'full'").first().n == 200
    grown, found = bits.increment_word_fields(after, spark.createDataFrame([("late", 62, 60)], "key string, offset long, delta long"), "i7", "sat")
    assert found.first().value == 63 and bits.word_fields(grown, new.select("key", "offset"), "i7").where("offset = 62").first().value == 63


def test_scan_to_the_end(spark):
    keys = spark.createDataFrame([(f"k{i:02}", i % 2) for i in range(23)], "key string, odd int").cache()
    seen, cursor = [], None
    while True:
        rows = keyspace.scan(keys, "key", cursor, 4, F.col("odd") == 1).collect()
        seen += [r.key for r in rows]
        cursor = rows[0].cursor if rows else None
        if cursor is None:
            break
        assert cursor == rows[-1].key or cursor == max(r.key for r in rows)
    assert sorted(seen) == [f"k{i:02}" for i in range(23) if i % 2]


def test_large_keys_are_ranked_in_pieces(spark):
    rng = random.Random(5)
    rows = [("hot", f"m{i}", float(rng.randrange(9))) for i in range(500)] + [("small", "a", 1.0), ("small", "b", 0.5)]
    z = spark.createDataFrame(rows, "key string, member string, score double").repartition(6).cache()
    for reverse in (False, True):
        wanted = {(r.key, r.member): r.rank for r in zsets.ranked(z, reverse).collect()}
        assert {(r.key, r.member): r.rank for r in zsets.ranked(z, reverse, large=True).collect()} == wanted
    line = spark.createDataFrame([("k", float(i * 3 % 50), str(i)) for i in range(50)], "key string, idx double, value string")
    assert {r.idx: r.pos for r in lists.positioned(line, large=True).collect()} == {float(i): i for i in range(50)}
    assert zsets.ranked(z.limit(0), large=True).count() == 0


def test_draws_may_repeat(spark):
    one_member = spark.createDataFrame([("k", "a")], "key string, member string")
    assert sorted((r.draw, r.member) for r in sets.sample(one_member, -3, 1).collect()) == [(1, "a"), (2, "a"), (3, "a")]
    many = spark.createDataFrame([("k", str(i)) for i in range(30)], "key string, member string")
    drawn = [r.member for r in sets.sample(many, -300, 1).collect()]
    assert len(drawn) == 300 and len(set(drawn)) > 25


def test_dumps_of_all_types(spark):
    cases = {
        "string": [("k", 'a"é')], "list": [("k", 1.5, "x"), ("k", 2.0, "x")], "set": [("k", "m"), ("l", "")], "zset": [("k", "m", float("-inf")), ("k", "n", 0.1)],
        "bitmap": [("k", 5), ("k", 1 << 40)], "hash": [("k", "f", "v")],
    }
    for kind, rows in cases.items():
        df = spark.createDataFrame(rows, "key string, " + dumps.SCHEMAS[kind])
        made = dumps.dump(df, kind)
        assert sorted(map(tuple, dumps.restore(made, kind).collect())) == sorted(rows)
        assert dumps.restore(made.withColumn("crc", F.col("crc") + 1), kind).count() == 0
    made = dumps.dump(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, value string"), "string")
    ends = spark.createDataFrame([("a", 50), ("b", 150)], "key string, expire_at_ms long")
    live = dumps.dump_live(made, ends, 100).cache()
    assert sorted((r.key, r.ttl_ms) for r in live.collect()) == [("b", 50), ("c", 0)]
    present = spark.createDataFrame([("c",)], "key string")
    assert [(r.key, r.expire_at_ms) for r in dumps.restorable(live, present, 1000).collect()] == [("b", 1050)]
    assert dumps.restorable(live, present, 1000, replace=True).count() == 2


def test_script_arguments(spark):
    from keyloom.functions import Scripts

    scripts = Scripts()
    digest = scripts.load("concat(value, :tail, '{x}')")
    assert scripts.run(one(spark, "a"), digest, args={"tail": "'; --"}).first().result == "a'; --{x}"
    with pytest.raises(KeyError):
        scripts.run(one(spark, "a"), "none", args={"tail": "b"})


def test_many_windows_of_one_key(spark):
    log = spark.createDataFrame([("k", 10 * t) for t in range(2000)] + [("l", 3)], "key string, ts_ms long").repartition(3)
    found = sorted(tuple(r) for r in strings.fixed_window_counter(log, 15).collect())
    assert found == sorted([("k", 20 * t, 2) for t in range(1000)] + [("l", 3, 1)])


def test_supplier_sets_are_dealt_in_pieces(spark, data):
    """Adaptive execution does not merge the tasks that make the sets to one a core."""
    tables = Tables(spark, data)
    used = fixtures.supplier_sets(tables).select(F.spark_partition_id().alias("at")).distinct().count()
    assert 8 < used <= fixtures.pieces(tables.lineitem)


def test_move_joins_once(spark):
    """Moves of members that are there, twice, to two targets, to a set that holds the member, or of what is not there; one join does."""
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "z"), (None, "x")], "key string, member string")
    moves = spark.createDataFrame([("a", "b", "x"), ("a", "b", "x"), ("b", "c", "z"), ("b", "d", "z"), ("a", "b", "none"), (None, "b", "x")], "source string, target string, member string")
    wanted = [("", "x"), ("a", "y"), ("b", "x"), ("c", "z"), ("d", "z")]
    for pieces in (None, 5):
        moved = sets.move(rows, moves, pieces)
        assert sorted((r.key or "", r.member) for r in moved.collect()) == wanted
        assert moved._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


@pytest.mark.parametrize("n", [5, -4])
def test_samples_are_drawn_in_pieces(spark, data, n):
    """Members are ranked and drawn first in the tasks to which the sets were dealt by number, before sets come together."""
    drawn = sets.sample(fixtures.supplier_sets(Tables(spark, data)), n, 42)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange ") == 2
