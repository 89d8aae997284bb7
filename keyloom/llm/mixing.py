"""Mixing sources to target weights with hash-threshold histograms.

Each source has a budget of words.  Every document has a fixed hash; a source takes the documents
whose hash lies below the source's threshold.  Thresholds come from histograms of words by source
and hash bucket: the bucket in which the running sum crosses the budget is refined by the next
bits of the hash, all other buckets are settled.  Nothing is sorted and no group is gathered.

Larger budgets only raise a threshold, so the mixes of different budgets are nested.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.shared import MAX_BROADCAST_KEYS, keep, spread, table
from keyloom.llm.words import count_words

BITS = 12  # hash bits settled by one histogram
LEVELS = 3


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Budgets for ``sizes(source, source_size)``.

    Sources by code point, nulls last, get ``weights`` in turn; together they get ``share`` of all
    words.  A budget stops at ``cap`` times its source's words and the excess goes to the others by
    weight until none is above.  Returns source, source_size, weight, target.

    In order of the level ``cap * size / weight`` at which a source fills up, the filled sources are a
    prefix; the common level of the rest follows from running sums.  The table has one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", w).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    levels = (
        ranked.withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
        .withColumn("holds", F.col("level") * F.col("weight") <= F.col("limit"))
        .withColumn("common", F.min(F.when(F.col("holds"), F.struct(F.col("full"), F.col("level")))).over(whole))
    )
    target = F.when(F.col("common").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("common.level") * F.col("weight")))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def _bucket(level: int) -> Column:
    shift = 63 - BITS * (level + 1)
    return F.shiftright(F.col("hash"), shift).bitwiseAND(F.lit((1 << BITS) - 1))


def _hashed(docs: DataFrame, seed: int, *columns: Column) -> DataFrame:
    """``columns`` with a ``hash`` of 63 bits of each row's id, source and text.

    Equal rows are numbered, so that they do not enter and leave as one: by the part of the input they stand in, and within it.
    Which of them gets which number is immaterial."""
    base = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "source", "text", F.lit(seed))
    rows = docs.select(*columns, base.alias("_base"), F.spark_partition_id().alias("_part"))
    repeated = keep(docs.select(base.alias("_base")).groupBy("_base").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_base"), "mix-repeated")
    if repeated.count() <= MAX_BROADCAST_KEYS:
        repeated = F.broadcast(repeated)
    some = rows.join(repeated, "_base", "left_semi")
    before = Window.partitionBy("_base").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = some.groupBy("_base", "_part").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_base", "_part").orderBy(F.lit(1)))
    numbered = some.withColumn("_i", within).join(parts.drop("_rows"), ["_base", "_part"]).withColumn("_i", F.col("_i") + F.col("_before"))
    own = lambda i: F.xxhash64("_base", i.cast("long")).bitwiseAND(F.lit((1 << 63) - 1)).alias("hash")
    single = rows.join(repeated, "_base", "left_anti")
    kept = [c for c in rows.columns if c not in ("_base", "_part")]
    return single.select(*kept, own(F.lit(1))).union(numbered.select(*kept, own(F.col("_i"))))


def mix_thresholds(docs: DataFrame, seed: int = 17, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, DataFrame, int]:
    """The sized rows (doc_id, source, size, hash), one row of thresholds a source, and the number of sources."""
    slim = keep(_hashed(docs, seed, F.col("doc_id"), F.col("source"), count_words(F.col("text")).alias("size")), "mix-sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = keep(source_targets(sizes, weights, share, cap), "mix-targets")
    n_sources = targets.count()

    # whole copies first; the histogram finds the threshold of what is left of the budget
    floor = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = (
        targets.withColumn("whole", floor.cast("int"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("below", F.lit(0).cast("long"))
    )
    for level in range(LEVELS):
        last = level == LEVELS - 1
        rows = slim.where("size > 0")
        if level:
            upper = F.shiftright(F.col("hash"), 63 - BITS * level)
            rows = spread(rows, state.select("source", "prefix"), "source", n_sources, F.col("hash")).where(upper == F.col("prefix"))
        histogram = rows.groupBy("source", _bucket(level).alias("bucket")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("bucket")
        facts = state.withColumnRenamed("source", "_source")
        crossing = (
            histogram.withColumn("upto", F.sum("words").over(running))
            .join(facts, F.col("source").eqNullSafe(F.col("_source")))
            .where(F.col("below") + F.col("upto") > F.col("rest"))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "upto", "words")).alias("at"))
        )
        joined = state.join(crossing.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left")
        # with no crossing bucket the rest of the budget covers the whole range
        bucket = F.coalesce(F.col("at.bucket"), F.lit((1 << BITS)))
        under = F.col("below") + F.coalesce(F.col("at.upto") - F.col("at.words"), F.lit(0))
        if last:
            # the last bucket is taken if that brings the sum nearer to the budget
            over = F.col("below") + F.col("at.upto")
            bucket = bucket + F.when(over - F.col("rest") < F.col("rest") - under, 1).otherwise(0)
        state = joined.select(
            "source", "source_size", "weight", "target", "whole", "rest",
            (F.shiftleft(F.col("prefix"), BITS) + bucket).alias("prefix"), under.cast("long").alias("below"),
        )
        state = keep(state, f"mix-level{level}")

    return slim, state, n_sources


def _copies(rows: DataFrame, state: DataFrame, n_sources: int) -> DataFrame:
    # a source whose budget is whole copies has nothing left for any document, not even for an empty one
    below = (F.shiftright(F.col("hash"), 63 - BITS * LEVELS) < F.col("prefix")) & (F.col("rest") > 0)
    return spread(rows, state.drop("weight", "below"), "source", n_sources, F.col("hash")).withColumn("copies", (F.col("whole") + below.cast("int")).cast("int"))


def mix_to_targets(docs: DataFrame, **options) -> DataFrame:
    """How often the mix takes each document.

    Input: ``doc_id``, ``text``, ``source``; other columns are ignored.  Output: ``doc_id``, ``source``, ``size``,
    ``source_size``, ``target``, ``copies`` (int, at most the cap), ``taken`` (copies times size).  A document is
    taken whole or not at all.  Options: see ``mix_thresholds``.

    Null texts have size 0; a null source is a source of its own; null ids are hashed like any value.
    Rows that repeat an id, or all columns, are taken or left one by one.  Documents of size 0 are taken as
    their hash says.  An empty table gives an empty result.
    """
    rows = _copies(*mix_thresholds(docs, **options))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix_to_targets`` takes it, with the columns of ``docs``, whatever
    their names.  Nulls, repeated rows and empty tables are treated as there."""
    _, state, n_sources = mix_thresholds(docs, seed, **options)
    rows = _hashed(docs, seed, F.col("source"), F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    taken = _copies(rows, state, n_sources).where("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def op1_mix_sources(spark, sf_dir):
    mixed = mix_to_targets(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")
