import re

import duckdb
import pytest

from keyloom.llm.mixing import mix_to_targets, mixed_documents, source_targets


def fill(sizes, weights, share, cap):
    """Targets by filling sources one by one."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 1000, None: 50}, {"a": 7}, {"a": 0, "b": 5}, {"x": 10, "y": 10, "z": 10, "é": 10, "": 400}])
def test_targets(spark, sizes):
    found = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    wanted = fill(sizes, (5, 2, 1), 1.5, 2.0)
    assert found.keys() == wanted.keys()
    for s in wanted:
        assert found[s] == pytest.approx(wanted[s])


def test_near_targets(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    first = mix_to_targets(docs).collect()
    assert {r.doc_id: r.taken for r in first} == {r.doc_id: r.taken for r in mix_to_targets(docs.repartition(5)).collect()}
    by = {}
    for r in first:
        assert r.taken in (0, r.size, 2 * r.size)
        took = by.setdefault(r.source, [0, r.target, 0])
        took[0] += r.taken
        took[2] = max(took[2], r.size)
    assert all(abs(t - target) <= largest for t, target, largest in by.values())


def test_odd_rows(odd, empty):
    rows = mix_to_targets(odd).collect()
    assert len(rows) == odd.count()
    sizes = {r.doc_id: r.size for r in rows}
    assert sizes[2] == sizes[3] == sizes[5] == 0 and sizes[6] == 30_001 and sizes[7] == len(re.findall(r"[^\x20\x09-\x0D]+", "ÀÉÎ \u00a0 日本語 🙂"))
    assert mix_to_targets(empty).count() == 0
    mixed = mixed_documents(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r.copies for r in rows)


def test_repeated_rows_are_taken_one_by_one(spark):
    """Rows of one id, equal ones included, bring every source near its target."""
    rows = [(1, "same words here", s) for s in ("a", "b", "c") for _ in range(100)] + [(None, f"text {i} of no id", "c") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = {}
    for r in mix_to_targets(docs).collect():
        took = by.setdefault(r.source, [0, r.target])
        took[0] += r.taken
    assert all(abs(taken - target) <= 4 for taken, target in by.values())
    again = mix_to_targets(docs.repartition(7)).groupBy("source").sum("taken").collect()
    assert {r[0]: r[1] for r in again} == {s: x[0] for s, x in by.items()}
    assert mixed_documents(docs).groupBy("source").count().count() == 3


def test_empty_texts_stay_below_the_cap(spark):
    docs = spark.createDataFrame([(i, "" if i % 2 else "a b c", "s") for i in range(400)], "doc_id long, text string, source string")
    assert max(r.copies for r in mix_to_targets(docs, share=2.0).collect()) == 2


def test_sizes_and_targets_by_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = con.execute(r"""
      WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
      s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
      fill AS (
        SELECT 0 AS step, source, source_size, w, false AS filled, 1.5 * sum(source_size) OVER () AS rest, sum(w) OVER () AS open FROM s
        UNION ALL
        SELECT step + 1, source, source_size, w, f, tot - sum(CASE WHEN f THEN 2 * source_size ELSE 0 END) OVER (), sum(CASE WHEN f THEN 0 ELSE w END) OVER ()
        FROM (SELECT *, filled OR rest * w / open > 2 * source_size AS f, 1.5 * sum(source_size) OVER () AS tot FROM fill WHERE step < 20 AND open > 0)
      ),
      t AS (SELECT source, source_size, CASE WHEN filled OR open = 0 THEN 2 * source_size ELSE rest * w / open END AS target FROM fill QUALIFY step = max(step) OVER ())
      SELECT doc_id, size, source_size, target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source ORDER BY doc_id""").fetchall()
    got = sorted((r.doc_id, r.size, r.source_size, r.target) for r in mix_to_targets(spark.read.parquet(f"{data}/documents.parquet")).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want])
