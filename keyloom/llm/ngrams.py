"""Interpolated modified Kneser-Ney trigram models.

Counting is a set of Spark aggregations and joins, sharded by the hash of the context.  A model of any size is a table
of 64-bit keys with one value each (``gram_values``), to which the n-grams of whole documents are joined (``score``): a text's log
probability is the sum of the values of its n-grams.  ``train`` makes a model of few texts in memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.shared import drop, keep, meet, text_slices
from keyloom.llm.words import find_words, hashed_words

START, END = -1, -2  # word keys of the document's edges
SHARDS = 16
MEMO = 150_000
HEAD = 300_000  # n-grams of a model that tasks keep at hand
PARTS = 6
SHARD_GRAMS = 6_000_000  # n-grams of documents that a shard of the keys has at most, about
HELD = 2_000_000  # sums of texts that a task holds while it reads its shards
PILES = ["shard", "keys", "values", "texts", "of"]
PILE_TYPES = "shard int, keys binary, values binary, texts binary, of binary"
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_words: dict[str, int] = {}


def word_keys(text: str | None) -> np.ndarray:
    """Signed 64-bit keys of the words, equal to Spark's ``xxhash64``."""
    found = find_words(text) if text else []
    if len(_words) > MEMO:
        _words.clear()
    keys = []
    for w in found:
        key = _words.get(w)
        if key is None:
            key = _words[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42)
        keys.append(key)
    return np.array(keys, dtype=np.uint64)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A key for two keys side by side; used again for three."""
    x = (a ^ (a >> np.uint64(31))) * _M1 + b
    return (x ^ (x >> np.uint64(29))) * _M2


@dataclass
class Table:
    """A sharded map from keys to values: shard by the top bits, sorted inside."""

    shards: list[tuple[np.ndarray, np.ndarray]]
    default: float

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray, default: float) -> Table:
        order = np.argsort(keys)
        keys, values = keys[order], values[order].astype(np.float32)
        cuts = np.searchsorted(keys, np.arange(1, SHARDS, dtype=np.uint64) << np.uint64(60))
        return cls(list(zip(np.split(keys, cuts), np.split(values, cuts), strict=True)), default)

    def sorted(self, wanted: np.ndarray) -> np.ndarray:
        """Values for keys in order."""
        out = np.full(len(wanted), self.default, dtype=np.float64)
        cuts = np.searchsorted(wanted, np.arange(1, SHARDS, dtype=np.uint64) << np.uint64(60))
        cuts = [0, *cuts, len(wanted)]
        for (own, values), i, j in zip(self.shards, cuts[:-1], cuts[1:], strict=True):
            if len(own) and i < j:
                at = np.minimum(np.searchsorted(own, wanted[i:j]), len(own) - 1)
                hit = own[at] == wanted[i:j]
                out[i:j][hit] = values[at[hit]]
        return out

    def join(self, keys: np.ndarray) -> np.ndarray:
        """Values for keys, one shard at a time."""
        out = np.empty(len(keys))
        order = np.argsort(keys)
        out[order] = self.sorted(keys[order])
        return out


@dataclass
class Model:
    trigrams: Table
    pairs: Table  # weight of backing off from two words
    bigrams: Table
    singles: Table  # weight of backing off from one word
    unigrams: Table
    n_words: int

    def log10(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability and number of tokens (words and one end) of each document."""
        start, end = np.uint64(START & (2**64 - 1)), np.uint64(END & (2**64 - 1))
        padded = [np.concatenate([[start, start], d, [end]]).astype(np.uint64) for d in docs]
        flat = np.concatenate(padded)
        a, b, c = flat[:-2], flat[1:-1], flat[2:]
        ab, bc = pair_key(a, b), pair_key(b, c)
        p = self.unigrams.join(c)
        p = self.bigrams.join(bc) + self.singles.join(b) * p
        p = self.trigrams.join(pair_key(ab, c)) + self.pairs.join(ab) * p
        sizes = np.array([len(x) for x in padded])
        first = np.cumsum(sizes) - sizes
        return _sums(np.log10(p), first, sizes - 2), sizes - 2


def _sums(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[starts + lengths] - total[starts]


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from the counts of counts."""
    n = counts.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]).first()
    n1, n2, n3, n4 = (float(x) for x in n)
    if min(n1, n2, n3, n4) == 0:
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [min(max(d, 0.1), top) for d, top in zip(found, (0.9, 1.8, 2.7), strict=True)]


def _less(d: list[float]) -> Column:
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


def _padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the words of all texts in one row, with two edges before each text and one behind it, the text of each place, and
    the places of each text."""
    edge, end = np.uint64(START & (2**64 - 1)), np.uint64(END & (2**64 - 1))
    words, n = hashed_words(texts)
    sizes = n + 3
    of, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
    flat, inner = np.full(len(of), edge), np.ones(len(of), bool)
    inner[ends - sizes] = inner[ends - sizes + 1] = inner[ends - 1] = False
    flat[ends - 1], flat[inner] = end, words
    return flat, of, sizes


def _counts(texts: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Counts of trigrams ``(a, b, c)`` and of the words before each bigram ``(b, c)``, both in ``PARTS`` tables by ``b``, and of those
    before each word ``c``.  Null texts count as empty.  A task adds up the trigrams of a slice of texts before it sends them."""

    def grams(i: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch, rows=4096):
                    flat, of, _ = _padded(part.column("text"))
                    at = np.flatnonzero((of[:-2] == of[2:]) & (flat[1:-1].view(np.int64) % PARTS == i))
                    key = pair_key(pair_key(flat[at], flat[at + 1]), flat[at + 2])
                    _, first, n = np.unique(key, return_index=True, return_counts=True)
                    at = at[first]
                    yield pa.RecordBatch.from_arrays([*[pa.array(flat[at + j].view(np.int64)) for j in range(3)], pa.array(n)], names=["a", "b", "c", "n"])

        return run

    tri, bi = [], []
    for i in range(PARTS):
        found = texts.select("text").mapInArrow(grams(i), "a long, b long, c long, n long")
        tri.append(keep(found.groupBy("a", "b", "c").agg(F.sum("n").alias("n")), "ngram-3"))
        bi.append(keep(tri[i].groupBy("b", "c").agg(F.count(F.lit(1)).alias("n")), "ngram-2"))
    return tri, bi, keep(_union(bi).groupBy("c").agg(F.count(F.lit(1)).alias("n")), "ngram-1")


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def _totals(grams: DataFrame, context: list[str], less: Column) -> DataFrame:
    """``total`` of each context, and ``weight``, what it leaves to the lower order if each of its grams loses ``less``."""
    totals = grams.groupBy(*context).agg(F.sum("n").alias("total"), F.sum(less).alias("left"))
    return totals.select(*context, "total", (F.col("left") / F.col("total")).alias("weight"))


def _unigrams(uni: DataFrame) -> tuple[Column, float]:
    """Probability of a word of ``uni``, and of each word never seen: what discounts leave, shared evenly, with one share for those."""
    less = _less(_discounts(uni))
    n_words, total, left = uni.agg(F.count(F.lit(1)), F.sum("n"), F.sum(less)).first()
    total, left = float(total or 1), float(left or 1)
    unseen = left / total / (n_words + 1)
    return (F.col("n") - less) / total + unseen, unseen


def _keyed(df: DataFrame, parts: list[str], *others: str) -> DataFrame:
    """``key``, the words of a gram as one key made by the tasks, and other columns."""
    schema = ", ".join(["key long", *[f"{name} {df.schema[name].dataType.simpleString()}" for name in others]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, *more = (batch.column(i).to_numpy().view(np.uint64) for i in range(len(parts)))
            for part in more:
                key = pair_key(key, part)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns[len(parts) :]], names=["key", *others])

    return df.select(*parts, *others).mapInArrow(run, schema)


def train(texts: DataFrame) -> Model:
    """A model in memory of the ``text`` of all rows; callers bound them.  Null texts count as empty."""
    tris, bis, uni = _counts(texts)
    tri, bi = _union(tris), _union(bis)

    def arrays(df: DataFrame, value: Column, *parts: str) -> tuple[np.ndarray, np.ndarray]:
        table = _keyed(df.withColumn("value", value.cast("float")), list(parts), "value").toArrow()
        return table.column("key").to_numpy().view(np.uint64), table.column("value").to_numpy()

    less3, less2 = _less(_discounts(tri)), _less(_discounts(bi))
    left3, left2 = _totals(tri, ["a", "b"], less3), _totals(bi, ["b"], less2)
    p1, unseen = _unigrams(uni)
    share = lambda less: (F.col("n") - less) / F.col("total")
    return Model(
        Table.of(*arrays(tri.join(left3, ["a", "b"]), share(less3), "a", "b", "c"), 0.0), Table.of(*arrays(left3, F.col("weight"), "a", "b"), 1.0),
        Table.of(*arrays(bi.join(left2, "b"), share(less2), "b", "c"), 0.0), Table.of(*arrays(left2, F.col("weight"), "b"), 1.0), Table.of(*arrays(uni, p1, "c"), unseen), uni.count(),
    )


def gram_values(texts: DataFrame) -> tuple[DataFrame, float]:
    """The model of the ``text`` of all rows as a table: ``key``, ``value``, ``n``, with a row for each n-gram of the texts, and the
    log10 probability of a word never seen.

    Without any n-gram seen, a token has the backoff weights of its two contexts and the probability of a word never seen.  In
    log space each n-gram that was seen adds a term of its own to that: a word its probability and its weight as a context, a
    bigram what its probability has over its backoff, and its weight, a trigram what its probability has over its backoff.
    ``n`` tells about how often the gram stands in the texts, up to 10,000.  Grams are worked on in ``PARTS`` parts by a
    word, one after the other, which bounds the disk that shuffles need.
    """
    tris, bis, uni = _counts(texts)
    tri, bi = _union(tris), _union(bis)
    less3, less2 = _less(_discounts(tri)), _less(_discounts(bi))
    p1, unseen = _unigrams(uni)
    log = lambda x: F.coalesce(F.log10(x), F.lit(0.0))
    part = lambda df, word, i: df.where(F.pmod(word, F.lit(PARTS)) == i)
    often = lambda n: F.coalesce(F.least(n, F.lit(10_000)), F.lit(1)).cast("int").alias("n")
    # the full joins add the document's edge, which is a context and never follows one
    words = keep(uni.select("c", p1.alias("p1")).join(_totals(bi, ["b"], less2).withColumnRenamed("b", "c"), "c", "full"), "ngram-words")
    first = words.select(F.col("c").alias("b"), F.col("total").alias("total2"), F.col("weight").alias("weight2")).where("total2 IS NOT NULL")
    backoff = F.col("weight2") * F.col("p1")
    pairs = []
    for i in range(PARTS):
        p2 = bis[i].join(part(first, "b", i), "b").join(words.select("c", "p1"), "c").select("b", "c", ((F.col("n") - less2) / F.col("total2") + backoff).alias("p2"), backoff.alias("low"))
        left3 = _totals(part(tri, "a", i), ["a", "b"], less3).withColumnsRenamed({"b": "c", "a": "b"})
        value = log(F.col("p2") / F.col("low")) + log(F.col("weight"))
        found = p2.join(left3, ["b", "c"], "full").select("b", "c", F.col("p2").cast("float"), value.cast("float").alias("value"), "total", F.col("weight").cast("float"))
        pairs.append(keep(found, "ngram-pairs"))
    drop(bi)
    every = _union(pairs)
    over = (F.col("n") - less3) / F.col("total") / (F.col("weight").cast("double") * F.col("p2"))
    made = []
    for i in range(PARTS):
        heads = part(every.where("total IS NOT NULL"), "c", i).select(F.col("b").alias("a"), F.col("c").alias("b"), "total", "weight")
        three = tris[i].join(heads, ["a", "b"]).join(pairs[i].where("p2 IS NOT NULL").select("b", "c", "p2"), ["b", "c"])
        made.append(keep(_keyed(three.select("a", "b", "c", F.log10(1 + over).cast("float").alias("value"), often("n")), ["a", "b", "c"], "value", "n"), "ngram-values"))
        drop(tris[i])
    made.append(keep(_keyed(every.select("b", "c", "value", often("total")), ["b", "c"], "value", "n"), "ngram-values"))
    one = (log(F.col("p1") / unseen) + log(F.col("weight"))).cast("float").alias("value")
    made.append(keep(_keyed(words.select("c", one, often("total")), ["c"], "value", "n"), "ngram-values"))
    for used in (uni, words, every):
        drop(used)
    return _union(made), float(np.log10(unseen))


def _head(values: DataFrame) -> Table:
    """The most frequent n-grams, ``HEAD`` at most, for the tasks to keep at hand; the rest of the model stays a table."""
    often = values.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("n")).collect()
    least, rows = 10_001, 0
    for r in often:
        rows += r["rows"]
        if rows > HEAD:
            break
        least = r["n"]
    table = values.where(F.col("n") >= least).select("key", "value").toArrow()
    return Table.of(table.column("key").to_numpy().view(np.uint64), table.column("value").to_numpy(), np.nan)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all n-grams of the padded texts, the text of each, and the tokens of each text."""
    flat, of, sizes = _padded(texts)
    pairs = pair_key(flat[:-1], flat[1:])
    triples = pair_key(pairs[:-1], flat[2:])
    second, third = of[:-1] == of[1:], of[:-2] == of[2:]
    return np.concatenate([flat[1:][second], pairs[second], triples[third]]), np.concatenate([of[1:][second], of[1:][second], of[2:][third]]), sizes - 2


def _packed(shard: int, keys: np.ndarray, values: np.ndarray | None = None, texts: np.ndarray | None = None, of: np.ndarray | None = None) -> tuple:
    return (shard, *(None if x is None else x.tobytes() for x in (keys, values, texts, of)))


def _piles(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=PILES)


def _pile_values(values: DataFrame, bits: int) -> DataFrame:
    """The model's rows, many to a row of one shard of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def made() -> pa.RecordBatch:
            keys = np.concatenate([b.column(0).to_numpy() for b in held]).view(np.uint64)
            found = np.concatenate([b.column(1).to_numpy() for b in held]).astype(np.float32)
            order = np.argsort(keys)
            keys, found = keys[order], found[order]
            shards, first = np.unique(keys >> np.uint64(64 - bits), return_index=True)
            return _piles([_packed(int(s), keys[i:j], values=found[i:j]) for s, i, j in zip(shards, first, np.append(first, len(keys))[1:], strict=True)])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > 1_000_000:
                yield made()
                held, rows = [], 0
        if rows:
            yield made()

    return values.mapInArrow(run, PILE_TYPES)


def _shard_sums(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Texts and the sums of the values of their n-grams in one shard of the keys."""
    table = pa.Table.from_batches(rows)
    joined = lambda rows, name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
    is_model = pc.is_valid(table.column("values"))
    model, asked = table.filter(is_model), table.filter(pc.invert(is_model))
    texts, keys = joined(asked, "texts", np.int64), joined(asked, "keys", np.uint64)
    own, values = joined(model, "keys", np.uint64), joined(model, "values", np.float32)
    if not len(own) or not len(keys):
        return np.empty(0, np.int64), np.empty(0)
    order = np.argsort(own)
    own, values = own[order], values[order].astype(float)
    sizes, grams = (pc.binary_length(asked.column(c)).to_numpy() // 8 for c in ("texts", "keys"))
    of = joined(asked, "of", np.uint16).astype(np.int64) + np.repeat(np.cumsum(sizes) - sizes, grams)
    at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
    hit = own[at] == keys
    total = np.bincount(of[hit], weights=values[at[hit]], minlength=len(texts)).astype(float)
    some = total != 0
    return texts[some], total[some]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the values of each text's n-grams in the shards that a task reads, which come one after the other.  One shard is held at
    a time, and the sums of ``HELD`` texts, about."""
    shard, rows, texts, sums, held = None, [], [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        found, where = np.unique(np.concatenate(texts), return_inverse=True)
        return found, np.bincount(where, weights=np.concatenate(sums), minlength=len(found))

    def made(found: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(total)], names=["_text", "sum"])

    def settled() -> Iterator[pa.RecordBatch]:
        nonlocal rows, texts, sums, held
        found, total = _shard_sums(rows)
        rows, held = [], held + len(found)
        texts.append(found), sums.append(total)
        if held > HELD:
            found, total = merged()
            if len(found) > HELD // 2:
                yield made(found, total)
                found, total = found[:0], total[:0]
            texts, sums, held = [found], [total], len(found)

    for batch in batches:
        shards = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            if rows and shards[i] != shard:
                yield from settled()
            shard = shards[i]
            rows.append(batch.slice(i, j - i))
    if rows:
        yield from settled()
    if held:
        yield made(*merged())


def score(docs: DataFrame, values: DataFrame, unseen: float) -> DataFrame:
    """``n_tokens`` and ``log10``, the log probability, of the whole ``text`` of every row, with its other columns but the text.

    The n-grams of documents meet the model in a shuffle by shards of their key, a quarter of the keys at a time, which bounds
    the disk.  Both sides travel packed, a row for each shard that a few texts or a piece of the model has grams in; the number of
    shards follows that of n-grams, so a shard's size is bounded.  The tasks that settle shards are as many as the cluster asks for,
    whatever the input: each reads its shards one by one and sends one sum a text.  The most frequent n-grams are looked up in the
    tasks, so no key that is frequent in the model is shuffled."""
    head = docs.sparkSession.sparkContext.broadcast(_head(values))
    others = [f for f in docs.columns if f != "text"]
    docs = docs.select(*others, "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                keys, of, n = _grams(part.column("text"))
                total = np.bincount(of, weights=np.nan_to_num(head.value.join(keys)), minlength=len(n)) + unseen * n
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], part.column("_text"), pa.array(n, pa.int64()), pa.array(total)], names=[*others, "_text", "n_tokens", "_known"])

    def asked(quarter: int, bits: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch):
                    keys, of, _ = _grams(part.column("text"))
                    mine = keys >> np.uint64(62) == quarter
                    keys, of = keys[mine], of[mine]
                    order = np.argsort(keys)
                    keys, of = keys[order], of[order]
                    rest = np.isnan(head.value.sorted(keys))
                    keys, of, texts = keys[rest], of[rest], part.column("_text").to_numpy()
                    shards, first = np.unique(keys >> np.uint64(64 - bits), return_index=True)
                    rows = []
                    for shard, i, j in zip(shards, first, np.append(first, len(keys))[1:], strict=True):
                        there = np.bincount(of[i:j], minlength=len(texts)) > 0
                        place = (np.cumsum(there) - 1).astype(np.uint16)
                        rows.append(_packed(int(shard), keys[i:j], texts=texts[there], of=place[of[i:j]]))
                    if rows:
                        yield _piles(rows)

        return run

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in others)
    rows = keep(docs.mapInArrow(known, f"{kinds}_text long, n_tokens long, _known double"), "ngram-known")
    tokens = rows.agg(F.sum("n_tokens")).first()[0] or 0
    tasks = 2 * max(docs.sparkSession.sparkContext.defaultParallelism, 4)
    bits = 2 + math.ceil(math.log2(max(0.75 * max(tokens, values.count() // 3) / SHARD_GRAMS, 8 * tasks)))
    texts = docs.select("text", "_text")
    sums = []
    for quarter in range(4):
        model = values.where(F.shiftrightunsigned("key", 62) == quarter).select("key", "value")
        piles = texts.mapInArrow(asked(quarter, bits), PILE_TYPES).union(_pile_values(model, bits))
        dealt = piles.repartitionById(tasks, F.pmod("shard", F.lit(tasks))).sortWithinPartitions("shard")
        sums.append(keep(dealt.mapInArrow(_settle, "_text long, sum double"), "ngram-sums"))
    every = sums[0].union(sums[1]).union(sums[2]).union(sums[3]).groupBy("_text").agg(F.sum("sum").alias("sum"))
    # equal texts have equal scores: their n-grams were added up together
    copies = keep(rows.groupBy("_text").agg(F.count(F.lit(1)).alias("_n")).join(every, "_text", "left").select("_text", "_n", (F.coalesce("sum", F.lit(0.0)) / F.col("_n")).alias("_more")), "ngram-texts")
    return meet(rows, copies, "_text", rows.count(), counted=True).select(*others, "n_tokens", (F.col("_known") + F.col("_more")).alias("log10"))
