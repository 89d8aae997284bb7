"""Language-model scores by a Brown class bigram model.

``P(w | before) = P(class(w) | class(before)) * P(w | class(w))``, smoothed with the plain word distribution.

1. Words of the training documents are counted by a shuffle.  The ``frequent`` words, bounded in number, are broadcast;
   documents become arrays of their numbers, and the rare words in them keep their 64-bit keys.
2. The most frequent words are clustered by exchange on the driver, word by word: the table of their pairs has a
   fixed size.  That is where the sweeps over the whole vocabulary start.
3. In a sweep every frequent word makes an exchange step at once: how often each class stands before and after it is
   counted over all training tokens, and it moves to the class that raises the likelihood of the class bigrams most.
4. Every rare word makes the same step, by the classes of the frequent words beside it.  Rare neighbours, and the
   edges of documents, are contexts of their own, so each word of the corpus has two contexts an occurrence.
5. Rare words meet their counts and classes in a join; all other pairs are settled where the documents are.
   Class transitions and emissions are counted over all training tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.shared import drop, keep, list_slices, table, text_slices
from keyloom.llm.words import hashed_words
from keyloom.session import ship

FREQUENT = 524_288
CLUSTERED = 1024  # words of the dense start
CLASSES = 32
SWEEPS = 6  # of the dense start
VOCABULARY_SWEEPS = 2
ALPHA = 0.9  # weight of the class model
SLOT_BITS = 20  # of a key, by which most words are looked up at once
NEAR = 2048  # most frequent words, whose contexts a task counts in a small table
RARE, BEGIN, FINISH = -1, -2, -3  # in sequences of word numbers
START, UNKNOWN = CLASSES, CLASSES + 1  # contexts besides the classes
END = CLASSES  # target besides the classes
# contexts on one side of a word: the classes, the document's edge, a word without class
EDGE, UNCLASSED, SIDE = CLASSES, CLASSES + 1, CLASSES + 2
CONTEXTS = 2 * SIDE  # first those before, then those after


def _texts_keys(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the 64-bit keys of all words of their ``text``, lower-cased, in order, and the words of each text."""
    for part in text_slices(batch, rows=4096):
        keys, sizes = hashed_words(part.column("text"), lower=True)
        yield part, keys.view(np.int64), sizes


def count_words(texts: DataFrame) -> DataFrame:
    """``(key, c)`` for every word of ``text``."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            all_keys, where = np.unique(np.concatenate(keys), return_inverse=True)
            return all_keys, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)

        for _, found, _ in (x for batch in batches for x in _texts_keys(batch)):
            k, n = np.unique(found, return_counts=True)
            keys.append(k), counts.append(n)
            held += len(k)
            if held > 2_000_000:
                k, n = merged()
                if len(k) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "c"])
                    k, n = k[:0], n[:0]
                keys, counts, held = [k], [n], len(k)
        if keys:
            k, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], names=["key", "c"])

    return texts.select("text").mapInArrow(tally, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, at_most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the words with at least the least count that at most ``at_most`` words reach, most frequent first."""
    how_many = counts.groupBy("c").agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("c").desc()).limit(at_most).toArrow()
    c, words = how_many.column("c").to_numpy(), how_many.column("words").to_numpy()
    fits = np.cumsum(words) <= at_most
    least = int(c[fits].min()) if fits.any() else (int(c.max()) + 1 if len(c) else 1)
    rows = counts.where(F.col("c") >= least).toArrow()
    keys, n = rows.column("key").to_numpy(), rows.column("c").to_numpy()
    order = np.lexsort((keys, -n))
    return keys[order], n[order]


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def first_look(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By the top bits of a key: the most frequent word that has them, as its key and number (-1: none)."""
    number = np.full(1 << SLOT_BITS, RARE, np.int32)
    number[_slots(keys[::-1])] = np.arange(len(keys), dtype=np.int32)[::-1]
    return np.append(keys, 0)[number], number


def word_numbers(k: np.ndarray, known: np.ndarray, number: np.ndarray, slot_key: np.ndarray, slot_number: np.ndarray) -> np.ndarray:
    """Numbers of words by their keys (-1: rare).  Most are found by their top bits, the others are searched for."""
    slot = _slots(k)
    ids = slot_number[slot]
    rest = np.flatnonzero((slot_key[slot] != k) & (ids != RARE))  # where a slot is empty, no frequent word has these bits
    if len(rest):
        at = np.minimum(np.searchsorted(known, k[rest]), len(known) - 1)
        ids[rest] = np.where(known[at] == k[rest], number[at], RARE)
    return ids


def encode(docs: DataFrame, keys: np.ndarray) -> DataFrame:
    """Word numbers of every text (-1: rare), and the keys of its rare words in order."""
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], order.astype(np.int32), *first_look(keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for part, k, sizes in (x for batch in batches for x in _texts_keys(batch)):
            ids = word_numbers(k, *tables)
            missing = ids == RARE
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            upto = np.concatenate([[0], np.cumsum(missing)])[offsets]
            lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(x)) for o, x in ((offsets, ids), (upto, k[missing]))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("train"), *lists], names=["doc_id", "train", "ids", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = docs.select("doc_id", "train", "text").mapInArrow(run, f"doc_id {kind}, train boolean, ids array<int>, rare array<long>")
    return keep(coded.withColumn("row", F.monotonically_increasing_id()), "brown-coded")


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents of a batch in one row of numbers with their edges, the document of each place, and the rare keys."""
    ids, rare = batch.column("ids"), batch.column("rare")
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(ids.offsets.to_numpy())
    doc = np.repeat(np.arange(len(sizes)), sizes + 2)
    out = np.full(len(flat) + 2 * len(sizes), RARE, np.int32)
    ends = np.cumsum(sizes + 2)
    out[ends - 1], out[ends - sizes - 2] = FINISH, BEGIN
    inner = np.ones(len(out), bool)
    inner[ends - 1] = inner[ends - sizes - 2] = False
    out[inner] = flat
    return out, doc, rare.flatten().to_numpy(zero_copy_only=False)


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the words of a dense table of pair counts, by exchange clustering.

    Words start dealt by frequency.  Each in turn moves to the class with the highest likelihood of the class
    bigrams, until a sweep moves none."""
    n = len(pairs)
    cls = np.arange(n) % classes
    onehot = np.eye(classes)
    xlogx = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    table = onehot[cls].T @ pairs @ onehot[cls]
    right, left = pairs @ onehot[cls], pairs.T @ onehot[cls]  # by word: counts of classes after and before it
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            own = pairs[w, w]
            r, l_ = right[w].copy(), left[w].copy()
            r[cls[w]] -= own
            l_[cls[w]] -= own
            k = cls[w]
            table[k, :] -= r
            table[:, k] -= l_
            table[k, k] -= own
            # sums as they are wherever the word goes: its neighbours' rows and columns hold it in any case
            rows, cols = table.sum(axis=1) + l_, table.sum(axis=0) + r
            out, into = r.sum() + own, l_.sum() + own
            # change of sum(n log n) of cells, less that of the row and column sums, for each class the word may join
            cells_r, cells_l = xlogx(table + r[None, :]) - xlogx(table), xlogx(table + l_[:, None]) - xlogx(table)
            gain = cells_r.sum(axis=1) + cells_l.sum(axis=0)
            d = np.diagonal(table)
            rd, ld = np.diagonal(cells_r), np.diagonal(cells_l)
            gain += xlogx(d + r + l_ + own) - xlogx(d) - rd - ld
            gain -= xlogx(rows + out) - xlogx(rows) + xlogx(cols + into) - xlogx(cols)
            best = int(np.argmax(gain))
            if gain[best] <= gain[k] + 1e-9:
                best = k
            table[best, :] += r
            table[:, best] += l_
            table[best, best] += own
            if best != k:
                moved += 1
                cls[w] = best
                right[:, k] -= pairs[:, w]
                right[:, best] += pairs[:, w]
                left[:, k] -= pairs[w, :]
                left[:, best] += pairs[w, :]
        if not moved:
            break
    return cls


def clustered_pairs(coded: DataFrame, n: int) -> np.ndarray:
    """How often the ``n`` most frequent words follow each other in training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for batch in list_slices(batches):
            seq, _, _ = _sequences(batch)
            a, b = seq[:-1], seq[1:]
            ok = (a >= 0) & (a < n) & (b >= 0) & (b < n)
            total += np.bincount(a[ok].astype(np.int64) * n + b[ok], minlength=n * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    rows = coded.where("train").select("ids", "rare").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n * n)
    out[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(n, n)


def _contexts(cls: np.ndarray) -> np.ndarray:
    """Context of each entry of a sequence, by its number or, from the end, its mark."""
    return np.append(np.where(cls >= 0, cls, UNCLASSED), [EDGE, EDGE, UNCLASSED]).astype(np.int64)


def frequent_evidence(coded: DataFrame, cls: np.ndarray) -> DataFrame:
    """``(word, n)``: how often each of the ``CONTEXTS`` stands beside each frequent word in training documents.

    A task sends one row a word with the contexts that it met, so a word's rows are short and as many as there are tasks."""
    shared = coded.sparkSession.sparkContext.broadcast(_contexts(cls))
    size = len(cls)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, total = shared.value, np.zeros(size * CONTEXTS, np.int32)
        near = min(size, NEAR) * CONTEXTS
        often = np.zeros(near, np.int64)
        for batch in list_slices(batches):
            seq, _, _ = _sequences(batch)
            beside, word = contexts[seq], seq[1:-1]
            cell = word.astype(np.int64) * CONTEXTS
            small = (word >= 0) & (cell < near)
            large = cell >= near
            for cells in (cell + beside[:-2], cell + beside[2:] + SIDE):
                often += np.bincount(cells[small], minlength=near)
                np.add.at(total, cells[large], 1)
        total[:near] += often.astype(np.int32)
        for start in range(0, size, 16_384):
            part = total[start * CONTEXTS : (start + 16_384) * CONTEXTS]
            at = np.flatnonzero(part)
            words, first, sizes = np.unique(at // CONTEXTS, return_index=True, return_counts=True)
            if not len(words):
                continue
            offsets = np.append(first, len(at)).astype(np.int32)
            packed = [pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets * x.itemsize), pa.py_buffer(x)]) for x in ((at % CONTEXTS).astype(np.uint8), part[at])]
            yield pa.RecordBatch.from_arrays([pa.array((words + start).astype(np.int32)), *packed], names=["word", "contexts", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts")
            flat, offsets = parts.flatten(), parts.offsets.to_numpy()
            contexts, counts = (b"".join(flat.field(x).to_pylist()) for x in ("contexts", "counts"))
            contexts, counts = np.frombuffer(contexts, np.uint8), np.frombuffer(counts, np.int32)
            cells = np.diff(np.concatenate([[0], np.cumsum(pa.compute.binary_length(flat.field("contexts")).to_numpy())])[offsets - offsets[0]])
            row = np.repeat(np.arange(batch.num_rows), cells)
            n = np.bincount(row * CONTEXTS + contexts, weights=counts, minlength=batch.num_rows * CONTEXTS).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * CONTEXTS), pa.array(n))
            yield pa.RecordBatch.from_arrays([batch.column("word"), lists], names=["word", "n"])

    rows = coded.where("train").select("ids", "rare").mapInArrow(gather, "word int, contexts binary, counts binary")
    parts = rows.groupBy("word").agg(F.collect_list(F.struct("contexts", "counts")).alias("parts"))
    return keep(parts.mapInArrow(merge, "word int, n array<long>"), "brown-evidence")


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, CONTEXTS).astype(float)


def class_table(evidence: DataFrame, cls: np.ndarray) -> np.ndarray:
    """How often each context stands beside a word of each class."""
    shared = evidence.sparkSession.sparkContext.broadcast(cls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES, CONTEXTS))
        for batch in batches:
            own = shared.value[batch.column("word").to_numpy()]
            np.add.at(total, own[own >= 0], _matrix(batch.column("n"))[own >= 0])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at].astype(np.int64))], names=["at", "n"])

    out = np.zeros(CLASSES * CONTEXTS)
    for r in evidence.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # classes * contexts at most
        out[r["at"]] = r["n"]
    return out.reshape(CLASSES, CONTEXTS)


def best_classes(n: np.ndarray, own: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each word the class that raises the likelihood of the class bigrams most, by its counts of contexts.

    ``own`` is the class that the word is in as yet (-1: none), from which its counts are taken out.  It stays unless
    another class is better."""
    f = lambda x: x * np.log(np.maximum(x, 1.0))  # noqa: E731  counts are whole
    size, base = table[:, :SIDE].sum(axis=1), f(table)
    row, context = np.nonzero(n)
    count = n[row, context]
    gain = np.zeros((len(n), CLASSES))
    np.add.at(gain, row, f(table[:, context].T + count[:, None]) - base[:, context].T)
    tokens = n[:, :SIDE].sum(axis=1)
    gain -= 2 * (f(size + tokens[:, None]) - f(size))
    inside = np.flatnonzero(own >= 0)
    if len(inside):
        k = own[row]
        stay = np.where(k >= 0, base[k, context] - f(np.maximum(table[k, context] - count, 0)), 0.0)
        stay = np.bincount(row, weights=stay, minlength=len(n)) - 2 * (f(size)[own] - f(np.maximum(size[own] - tokens, 0)))
        gain[inside, own[inside]] = stay[inside] + 1e-9
    return gain.argmax(axis=1)


def sweep(evidence: DataFrame, cls: np.ndarray) -> np.ndarray:
    """The classes of all frequent words after an exchange step of each."""
    table = class_table(evidence, cls)
    shared = evidence.sparkSession.sparkContext.broadcast(cls)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in list_slices(batches, 512 * CONTEXTS):
            words = batch.column("word")
            best = best_classes(_matrix(batch.column("n")), shared.value[words.to_numpy()], table)
            yield pa.RecordBatch.from_arrays([words, pa.array(best.astype(np.int32))], names=["word", "class"])

    moved = evidence.mapInArrow(run, "word int, class int").toArrow()  # one row a frequent word
    out = cls.copy()
    out[moved.column("word").to_numpy()] = moved.column("class").to_numpy()
    return out


def rare_classes(coded: DataFrame, cls: np.ndarray, table: np.ndarray) -> DataFrame:
    """``(key, class, c)`` of all rare words, by one exchange step; ``c`` is how often the word occurs."""
    shared = coded.sparkSession.sparkContext.broadcast(_contexts(cls))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts = shared.value
        for batch in list_slices(batches, 2_000_000):
            seq, _, rare = _sequences(batch)
            at = np.flatnonzero(seq == RARE)
            k, c = np.tile(rare, 2), np.concatenate([contexts[seq[at - 1]], contexts[seq[at + 1]] + SIDE])
            order = np.lexsort((c, k))
            k, c = k[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])) if len(k) else np.empty(0, np.int64)
            count = np.diff(np.append(first, len(k)))
            yield pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(c[first].astype(np.int32)), pa.array(count)], names=["key", "context", "n"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in list_slices(batches, 20_000):
            found = batch.column("contexts")
            row = np.repeat(np.arange(batch.num_rows), np.diff(found.offsets.to_numpy()))
            n = np.zeros((batch.num_rows, CONTEXTS))
            n[row, found.flatten().field("context").to_numpy()] = found.flatten().field("n").to_numpy()
            best = best_classes(n, np.full(batch.num_rows, -1), table)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(best.astype(np.int32)), pa.array(n[:, :SIDE].sum(axis=1).astype(np.int64))], names=["key", "class", "c"])

    votes = coded.where("train AND size(rare) > 0").select("ids", "rare").mapInArrow(gather, "key long, context int, n long")
    # rare words have few occurrences, already combined by task, so one shuffle by word serves both groupings
    sums = votes.repartition("key").groupBy("key", "context").agg(F.sum("n").alias("n"))
    lists = sums.groupBy("key").agg(F.collect_list(F.struct("context", "n")).alias("contexts"))
    return lists.mapInArrow(choose, "key long, class int, c long")


def _rare_places(coded: DataFrame, cls: np.ndarray, counts: np.ndarray) -> DataFrame:
    """One row for each rare word in a text: class of the word before it or, if that is rare too, its key, and class
    and count of the word after it (null if rare)."""
    shared = coded.sparkSession.sparkContext.broadcast((np.append(cls, [END, START, -1]).astype(np.int32), np.append(counts, [0, 0, 0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, c = shared.value
        for batch in list_slices(batches):
            seq, doc, rare = _sequences(batch)
            at = np.flatnonzero(seq == RARE)
            before, after = classes[seq[at - 1]], classes[seq[at + 1]]
            row, train = batch.column("row").to_numpy(), batch.column("train").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row[doc[at]]), pa.array(train[doc[at]]), pa.array(rare), pa.array(np.roll(rare, 1), mask=before >= 0),
                    pa.array(before, mask=before < 0), pa.array(after, mask=after < 0), pa.array(c[seq[at + 1]]),
                ],
                names=["row", "train", "key", "key_before", "before", "after", "after_c"],
            )

    schema = "row long, train boolean, key long, key_before long, before int, after int, after_c long"
    return coded.where(F.size("rare") > 0).select("row", "train", "ids", "rare").mapInArrow(run, schema)


def _rare_steps(places: DataFrame, rare_words: DataFrame) -> DataFrame:
    """Class ``a`` before each rare word, its own class (null if never seen in training) and count, and what is after it.

    A word that is frequent only in texts that nothing is learnt from is a hot key without a match; adaptive execution splits it."""
    own = F.coalesce("class", F.lit(UNKNOWN))
    known = places.join(rare_words, "key", "left").select("row", "train", "key_before", "before", "class", F.coalesce("c", F.lit(0)).alias("c"), own.alias("own"), "after", "after_c")
    known = keep(known, "brown-places")
    before = rare_words.select(F.col("key").alias("key_before"), F.col("class").alias("class_before"))
    # runs of rare words are few: only they meet the classes a second time
    runs = known.where("key_before IS NOT NULL").join(before, "key_before", "left").withColumn("before", F.coalesce("class_before", F.lit(UNKNOWN)))
    columns = ["row", "train", F.col("before").alias("a"), "class", "c", "own", "after", "after_c"]
    return known.where("key_before IS NULL").select(*columns).union(runs.select(*columns))


def _transitions(coded: DataFrame, cls: np.ndarray) -> DataFrame:
    """Class pairs in training documents whose words are both frequent or edges: ``(a, b, n)``."""
    shared = coded.sparkSession.sparkContext.broadcast(np.append(cls, [END, START, -1]).astype(np.int64))
    width = CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, total = shared.value, np.zeros((CLASSES + 2) * width, np.int64)
        for batch in list_slices(batches):
            seq, _, _ = _sequences(batch)
            a, b = classes[seq[:-1]], classes[seq[1:]]
            ok = (a >= 0) & (b >= 0) & (seq[1:] != BEGIN) & (seq[:-1] != FINISH)
            total += np.bincount(a[ok] * width + b[ok], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32)), pa.array(total[at])], names=["a", "b", "n"])

    return coded.where("train").select("ids", "rare").mapInArrow(run, "a int, b int, n long")


def cluster(coded: DataFrame, n: int, sweeps: int = VOCABULARY_SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the ``n`` frequent words, and how often each context stands beside a word of each class."""
    if not n:
        return np.empty(0, np.int64), np.zeros((CLASSES, CONTEXTS))
    top = min(CLUSTERED, n)
    cls = np.full(n, -1, np.int64)
    cls[:top] = exchange(clustered_pairs(coded, top))
    for _ in range(sweeps):
        evidence = frequent_evidence(coded, cls)
        cls = sweep(evidence, cls)
        by_context = class_table(evidence, cls)
        drop(evidence)
    return cls, by_context


def score_documents(docs: DataFrame, train: Column, frequent: int = FREQUENT) -> DataFrame:
    """Scores of all whole texts by a model of the documents for which ``train`` holds.

    Input: ``doc_id``, ``text``; other columns are ignored.  Output: ``doc_id``, ``train``, ``n_tokens`` (words and one end), ``n_known``
    (tokens that occur in training), ``train_tokens``, ``base_score`` (add-half unigram), ``score``; both are log10
    probabilities.  Words never seen in training are one symbol, whose share is what absolute discounting takes off
    the seen ones.

    Null and empty texts are one end.  Rows are scored one by one, so repeated rows and null ids need no rule.
    Without training documents every token is unknown.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    counts = keep(count_words(rows.where("train")), "brown-counts")
    words, tokens = (int(x or 0) for x in counts.agg(F.count(F.lit(1)), F.sum("c")).first())
    keys, c = frequent_words(counts, frequent)
    coded = encode(rows, keys)
    n_train = coded.where("train").count()
    n, v = tokens + n_train, words + (n_train > 0)

    cls, by_context = cluster(coded, len(keys))
    settled = np.zeros((CLASSES + 2, CLASSES + 1))
    for r in _transitions(coded, cls).groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # at most (classes + 1) squared rows
        settled[r["a"], r["b"]] = r["n"]
    # the table the sweeps end with, but for what stands beside words without class
    by_context[:, :UNCLASSED], by_context[:, SIDE : SIDE + UNCLASSED] = settled[:-1, :CLASSES].T, settled[:CLASSES]
    rare_words = keep(rare_classes(coded, cls, by_context), "brown-rare")
    steps = _rare_steps(_rare_places(coded, cls, np.asarray(c)), rare_words)

    from_rare = steps.where("train")
    into = from_rare.where("class IS NOT NULL").groupBy("a", F.col("class").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    out = from_rare.where("after IS NOT NULL").groupBy(F.col("own").alias("a"), F.col("after").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    t = settled + 1.0
    for r in into.union(out).groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # as few
        t[r["a"], r["b"]] += r["n"]
    t[UNKNOWN] = t[: CLASSES + 1].sum(axis=0)
    t /= t.sum(axis=1, keepdims=True)
    size, types = np.bincount(cls, weights=c, minlength=CLASSES).astype(float), np.bincount(cls, minlength=CLASSES).astype(float)
    for r in rare_words.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        size[r["class"]] += r["c"]
        types[r["class"]] += r["v"]
    # an empty class leaves all its weight to unknown words
    unknown = t[:, :CLASSES] @ np.where(size > 0, 0.5 * types / np.maximum(size, 1), 1.0)
    return _scores(coded, steps, cls, np.asarray(c), t, size, unknown, n, v, n_train)


def _scores(coded, steps, cls, c, t, size, unknown, n, v, n_train) -> DataFrame:
    spread = n + 0.5 * (v + 1)
    width = CLASSES + 1
    emission = np.append((c - 0.5) / size[cls] if len(cls) else np.empty(0), [1.0, 0.0, 0.0])
    base = np.append((c + 0.5) / spread, [(n_train + 0.5) / spread, 1.0, 1.0])
    shared = coded.sparkSession.sparkContext.broadcast((np.append(cls, [END, START, -1]).astype(np.int64), emission, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, e, b = shared.value
        for batch in list_slices(batches):
            seq, doc, _ = _sequences(batch)
            docs = batch.num_rows
            before, now = seq[:-1], seq[1:]
            token = (now != BEGIN) & (now != RARE)
            here = doc[1:]
            base_sum = np.bincount(here[token], weights=np.log10(b[now[token]]), minlength=docs).astype(float)
            known = np.bincount(here[token], weights=(now[token] >= 0) | (n_train > 0), minlength=docs).astype(np.int64)
            ok = token & (before != RARE)
            p = ALPHA * t[classes[before[ok]], classes[now[ok]]] * e[now[ok]] + (1 - ALPHA) * b[now[ok]]
            score = np.bincount(here[ok], weights=np.log10(p), minlength=docs).astype(float)
            total = np.bincount(here[now != BEGIN], minlength=docs).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("train"), pa.array(total), pa.array(known), pa.array(base_sum), pa.array(score)], names=["row", "doc_id", "train", "n_tokens", "known", "base", "sum"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    settled = coded.select("row", "doc_id", "train", "ids", "rare").mapInArrow(run, f"row long, doc_id {kind}, train boolean, n_tokens long, known long, base double, sum double")

    # the steps into and out of rare words, as expressions over small constant arrays
    table = lambda values: F.array(*[F.lit(float(x)) for x in np.asarray(values).ravel()])
    log10 = lambda x: F.log10(x)
    t_sql, size_sql, unknown_sql = table(t), table(size), table(unknown)
    word = F.when(
        F.col("class").isNotNull(),
        ALPHA * F.get(t_sql, F.col("a") * width + F.col("class")) * (F.col("c") - 0.5) / F.get(size_sql, F.col("class")) + (1 - ALPHA) * (F.col("c") + 0.5) / spread,
    ).otherwise(ALPHA * F.get(unknown_sql, F.col("a")) + (1 - ALPHA) * 0.5 / spread)
    after_c = F.when(F.col("after") == END, F.lit(n_train)).otherwise(F.col("after_c"))
    after_e = F.when(F.col("after") == END, F.lit(1.0)).otherwise((after_c - 0.5) / F.get(size_sql, F.col("after")))
    following = ALPHA * F.get(t_sql, F.col("own") * width + F.col("after")) * after_e + (1 - ALPHA) * (after_c + 0.5) / spread
    per_row = steps.groupBy("row").agg(
        F.sum(log10(word) + F.coalesce(log10(following), F.lit(0.0))).alias("_sum"),
        F.sum(log10((F.col("c") + 0.5) / spread)).alias("_base"),
        F.count_if(F.col("c") > 0).alias("_known"),
    )
    zero = F.lit(0.0)
    joined = settled.join(per_row, "row", "left")
    return joined.select(
        "doc_id", "train", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", zero)).alias("base_score"), (F.col("sum") + F.coalesce("_sum", zero)).alias("score"),
    )


def op6_brown_lm(spark, sf_dir):
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    scored = score_documents(table(spark, sf_dir, "documents"), F.coalesce(fold != 1, F.lit(True)))
    held_out = F.coalesce(fold == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
