"""Toxicity by class-conditional Kneser-Ney models.

One model for toxic and one for ordinary documents.  Counts are Kneser-Ney type counts: the number of documents
that hold an expression, whatever its repetitions.  Both models discount the counts of their class and give
what they take off to the same shared backoff counts, so an expression that is rare in both classes says nothing
for or against it by its counts alone; the toxic discount is large enough for chance to be absorbed, and the ordinary one is
chosen so that both models back off with the same weight.  How much likelier such an expression is in toxic documents follows
from the counts of counts of all expressions as rare as it.

The class models are interpolated with a third, shared one of words after the last common word before them.
In a context in which a word is expected in any case, such as the words of one language among each other,
the classes then hardly differ, however they are spread over languages and topics.

A document's score is the difference of its two log-likelihoods by length, calibrated on labelled documents
that the models have not seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.shared import keep, list_slices, table
from keyloom.llm.words import ascii_lower, find_words, lower_ascii, words_array
from keyloom.session import ship

TRAIN_DOCS = 24_000  # about so many labelled documents are used, for the models and their calibration
DISCOUNT = 8.0  # of the toxic class
PRIOR_WORDS = 25.0  # added to the length, so that one word does not decide
EDGES = ".,;:!?\"'()[]{}<>#*$%&|-_"


def expressions(text: str | None) -> list[str]:
    """Lower-cased words without punctuation around them."""
    return [w.strip(EDGES) or w for w in find_words(lower_ascii(text))] if text else []


def expression_keys(text: Column) -> Column:
    """64-bit keys of the expressions of a text, in order, by Spark."""
    stripped = lambda w: F.coalesce(F.nullif(F.btrim(w, F.lit(EDGES)), F.lit("")), w)
    return F.transform(words_array(ascii_lower(text)), lambda w: F.xxhash64(stripped(w)))


def _key(word: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)).view(np.int64))


class Models:
    """Log ratios of toxic to ordinary probability of common words, by the common word before."""

    def __init__(self, words: list[tuple[str, float, float, float]], after: dict[int, float], pairs: dict[int, float]):
        """``words``: toxic, ordinary and shared probability of each, numbered from 1; ``after``: by a context's number, the
        weight of backing off to the shared probability; ``pairs``: by both numbers in one, the discounted share."""
        keys = np.array([_key(w) for w, *_ in words], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.number = keys[order], order + 1
        self.toxic, self.ordinary, self.common = np.array([[0.0] * 3] + [list(x[1:]) for x in words]).T
        self.after = np.ones(len(words) + 1)
        self.after[list(after)] = list(after.values())
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.shares = np.array([pairs[k] for k in self.pairs.tolist()])

    @staticmethod
    def _find(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the values that are known, and which are."""
        if not len(known):
            return np.empty(0, np.int64), np.zeros(len(asked), bool)
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        hit = known[at] == asked
        return at[hit], hit

    def ratios(self, keys: np.ndarray) -> np.ndarray:
        """Log ratios of pairs of context and word."""
        context, word = keys >> 32, keys & 0xFFFFFFFF
        shared = self.after[context] * self.common[word]
        at, hit = self._find(self.pairs, keys)
        shared[hit] += self.shares[at]
        return np.log((shared + self.toxic[word]) / (shared + self.ordinary[word]))

    def evidence(self, keys: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """By document: the difference of the log-likelihoods, in which an expression counts once after each context, and
        the number of different expressions."""
        different = np.unique(((keys ^ (keys >> 31)) & ((1 << 40) - 1)) | doc << 40) >> 40
        at, hit = self._find(self.keys, keys)
        word, doc = self.number[at], doc[hit]
        before = np.where(np.diff(doc, prepend=-1) == 0, np.roll(word, 1), 0)
        order = np.lexsort((before << 32 | word, doc))
        pair, doc = (before << 32 | word)[order], doc[order]
        first = np.ones(len(pair), bool)
        first[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
        pair, doc = pair[first], doc[first]
        return np.bincount(doc, weights=self.ratios(pair), minlength=docs), np.bincount(different, minlength=docs)


def _by_document(train: DataFrame, tally, schema: str, names: list[str]) -> DataFrame:
    """Sums over documents of what ``tally`` finds in each, as ``(key, toxic, ordinary)``."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                counts: dict = {}
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    for key in set(tally(text)):
                        counts.setdefault(key, [0, 0])[toxic] += 1
                n = np.array(list(counts.values()), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), names[1]), pa.array(n[:, 1]), pa.array(n[:, 0])], names=["key", "toxic", "ordinary"])

    parts = train.select("text", "toxic").mapInArrow(gather, schema)
    return parts.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _lifts(counts: DataFrame, discount: float, high: float, n_toxic: float, n_ordinary: float) -> dict[tuple[int, int], float]:
    """How many times likelier in toxic documents a word is whose counts ``(toxic, ordinary)`` are both discounted away.

    Good-Turing from the counts of counts: a toxic occurrence of a word of ``(t + 1, o)`` and an ordinary one of a word of
    ``(t, o + 1)`` both meet a word of ``(t, o)`` among the other documents.  The lift never falls as ``t`` grows, and is 1 at least."""
    most_t, most_o = int(discount), int(high)
    small = counts.where((F.col("toxic") <= most_t + 1) & (F.col("ordinary") <= most_o + 1))
    words = {(r["toxic"], r["ordinary"]): r["words"] for r in small.groupBy("toxic", "ordinary").agg(F.count(F.lit(1)).alias("words")).collect()}
    found = {}
    for o in range(most_o + 1):
        blocks: list[tuple[float, float, int]] = []  # log lift, weight and length; neighbours that fall are pooled
        for t in range(1, most_t + 1):
            toxic, ordinary = (t + 1) * words.get((t + 1, o), 0), (o + 1) * words.get((t, o + 1), 0)
            block = (math.log((toxic + 0.5) / n_toxic / ((ordinary + 0.5) / n_ordinary)) if toxic + ordinary else 0.0, toxic + ordinary + 1.0, 1)
            while blocks and blocks[-1][0] > block[0]:
                x, w, n = blocks.pop()
                block = ((x * w + block[0] * block[1]) / (w + block[1]), w + block[1], n + block[2])
            blocks.append(block)
        logs = [x for x, _, n in blocks for _ in range(n)]
        found |= {(t, o): max(math.exp(x), 1.0) for t, x in enumerate(logs, start=1)}
    return found


def fit(train: DataFrame, discount: float = DISCOUNT) -> Models:
    """Models from ``text`` and ``toxic`` (0 or 1) of all rows; callers bound them, and so what is collected."""
    counts = keep(_by_document(train, expressions, "key string, toxic long, ordinary long", ["key", pa.string()]), "toxic-words")
    left_t = F.least("toxic", F.lit(float(discount)))
    n_toxic, n_ordinary, n_words, taken_t = (float(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("ordinary"), F.count(F.lit(1)), F.sum(left_t)).first())
    if not n_toxic or not n_ordinary:
        return Models([], {}, {})
    # how many words are in how many ordinary documents; no more rows than the sample has documents
    histogram = counts.groupBy("ordinary").agg(F.count(F.lit(1)).alias("words")).toPandas().to_numpy(dtype=float)
    back, low, high = taken_t / n_toxic, 0.0, float(histogram[:, 0].max())
    for _ in range(60):
        middle = (low + high) / 2
        less = (np.minimum(histogram[:, 0], middle) * histogram[:, 1]).sum() / n_ordinary < back
        low, high = (middle, high) if less else (low, middle)
    lift = _lifts(counts, discount, high, n_toxic, n_ordinary)
    common = (F.col("toxic") > 0) | (F.col("ordinary") > high)
    words = []
    for row in counts.where(common).orderBy("key").toLocalIterator():
        pooled = (row["toxic"] + row["ordinary"] + 0.5) / (n_toxic + n_ordinary + 0.5 * (n_words + 1))
        toxic = max(row["toxic"] - discount, 0) / n_toxic + back * pooled
        ordinary = max(row["ordinary"] - high, 0) / n_ordinary + back * pooled
        # a word beyond the discount has the evidence of one at it at least
        toxic = max(toxic, ordinary * lift.get((min(row["toxic"], int(discount)), row["ordinary"]), 1.0))
        words.append((row["key"], toxic, ordinary, pooled))

    numbers = train.sparkSession.sparkContext.broadcast({w: i for i, (w, *_) in enumerate(words, start=1)})

    def pairs_of(text: str | None) -> list[int]:
        found = [i for w in expressions(text) if (i := numbers.value.get(w))]
        return [a << 32 | b for a, b in zip([0, *found], found, strict=False)]

    pairs = keep(_by_document(train, pairs_of, "key long, toxic long, ordinary long", ["key", pa.int64()]), "toxic-pairs")
    pairs = pairs.select("key", F.shiftright("key", 32).alias("a"), (F.col("toxic") + F.col("ordinary")).alias("n"))
    contexts = {row["a"]: (row["n"], row["types"] / row["n"]) for row in pairs.groupBy("a").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).toLocalIterator()}
    # pairs seen once are discounted away
    shares = {row["key"]: (row["n"] - 1) / contexts[row["a"]][0] for row in pairs.where("n > 1").toLocalIterator()}
    return Models(words, {a: left for a, (_, left) in contexts.items()}, shares)


def _evidence(docs: DataFrame, models: Models, also: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in list_slices(batches):
            found = part.column("keys")
            offsets = found.offsets.to_numpy()
            doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            total, n = shared.value.evidence(found.flatten().to_numpy(zero_copy_only=False), doc, part.num_rows)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in also], pa.array(total / (n + PRIOR_WORDS))], names=[*also, "evidence"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in also)
    return docs.select(*also, expression_keys(F.col("text")).alias("keys")).mapInArrow(score, f"{kinds}, evidence double")


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the evidence, lightly regularised; the slope is never negative."""
    if not len(y) or y.min() == y.max():
        return 0.0 if not len(y) else (-3.0 if y[0] == 0 else 3.0), 20.0
    scale = x.std() or 1.0
    z = np.stack([np.ones(len(x)), x / scale], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-6, 1e-2])
        step = np.linalg.solve(hessian, z.T @ (y - p) - np.array([0, 1e-2]) * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0) / scale)


def score_toxicity(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, threshold: float = 0.3) -> DataFrame:
    """Toxicity of every whole text.

    Input: documents with ``doc_id``, ``text``, labels with ``doc_id``, ``toxic``; other columns are ignored.  Output: ``doc_id``,
    ``held_out`` (whether crc32 of the id as text leaves 2 modulo 4; such rows are never learnt from), ``score``,
    ``predicted``.  The models learn from remainders 0 and 1, the calibration from 3.

    Null and empty texts get the score of no evidence.  A null id is not held out and has no label.  Of
    conflicting labels of one id the higher counts.  Without labels of both classes all scores are equal.
    Repeated rows get equal scores; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold != 2)
    known = keep(known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"), F.max(fold).alias("_fold")), "toxic-labels")
    share = train_docs / max(known.count(), train_docs)
    drawn = known.where(F.pmod(F.xxhash64("_id", F.lit(13)), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    sample = keep(docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("text", "toxic", "_fold"), "toxic-sample")
    models = fit(sample.where("_fold <> 3"))
    seen = _evidence(sample.where("_fold = 3"), models, ["toxic"]).toPandas()
    a, b = calibrate(seen["evidence"].to_numpy(dtype=float), seen["toxic"].to_numpy(dtype=float))
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("evidence"))))
    rows = _evidence(docs, models, ["doc_id"])
    return rows.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
