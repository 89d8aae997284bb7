"""MinHash near-duplicates: universal hash minima, bands, signature check, exact check, components.

1. One pass over the texts gives each document's number of distinct word shingles, a fingerprint of the
   whole set, band keys and a short signature.  Documents with equal sets form a class, of which only the
   smallest id goes on.
2. Classes that share a band key are candidates.  A bucket links its members to its smallest one, never in
   pairs; components of these links are the groups in which near-duplicates can be.
3. Groups are dealt into chunks.  A task gets two chunks with their texts, compares signatures, confirms
   links on full shingle sets, and returns a spanning forest of them: fewer links than documents, with the
   same components.
4. Components of the confirmed links, by alternating stars, are the result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.components import components
from keyloom.llm.shared import keep, meet, table, without
from keyloom.llm.words import find_words, lower_ascii
from keyloom.session import ship

SHINGLE = 5
PERCENT = 80  # least overlap of near-duplicates
ROWS = 5
MISSED = 1e-6  # greatest probability that a pair at the least overlap shares no band
CHUNK_DOCS, CHUNK_SHINGLES = 512, 2_000_000
MEMO = 150_000

_rng = np.random.default_rng(20240229)
_PLACE = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROW = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_words: dict[str, int] = {}


def bands_for(percent: int) -> int:
    """How many bands find pairs that overlap by ``percent``: 24 at 85, 35 at 80."""
    missed_by_one = max(1 - (percent / 100) ** ROWS, 1e-9)
    return max(1, math.ceil(math.log(MISSED) / math.log(missed_by_one)))


def least_agreement(percent: int) -> float:
    """Share of the signature that pairs at ``percent`` have in common, less six standard deviations."""
    share = percent / 100
    return share - 6 * math.sqrt(share * (1 - share) / (bands_for(percent) * ROWS))


@lru_cache
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of ``n`` universal hash functions."""
    rng = np.random.default_rng(20240301)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; fewer words make one shingle, none an empty set."""
    found = find_words(lower_ascii(text)) if text else []
    if not found:
        return np.empty(0, dtype=np.uint64)
    if len(_words) > MEMO:
        _words.clear()
    hashes = []
    for w in found:
        h = _words.get(w)
        if h is None:
            h = _words[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        hashes.append(h)
    x = np.array(hashes, dtype=np.uint64)
    if len(x) < SHINGLE:
        return _mix((x * _PLACE[: len(x)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(x)))
    n = len(x) - SHINGLE + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(SHINGLE):
        total += x[i : i + n] * _PLACE[i]
    return np.unique(_mix(total))


def minima(s: np.ndarray, n: int) -> np.ndarray:
    """The least value of each of ``n`` hash functions over the set."""
    factors, summands = _functions(n)
    out = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(s), 1024):
        hashed = s[start : start + 1024, None] * factors
        hashed += summands
        np.minimum(out, hashed.min(axis=0), out=out)
    return out


def _sign(docs: DataFrame, n_bands: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sizes, sets, bands, signatures = [], [], [], []
                for text in part.column("text").to_pylist():
                    s = shingles(text)
                    sizes.append(len(s))
                    if not len(s):
                        sets.append(None), bands.append(None), signatures.append(None)
                        continue
                    least = minima(s, n_bands * ROWS)
                    sets.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    keys = (least.reshape(n_bands, ROWS) * _ROW).sum(axis=1, dtype=np.uint64) + np.arange(n_bands, dtype=np.uint64)
                    bands.append(_mix(keys).view(np.int64))
                    signatures.append((_mix(least) & np.uint64(255)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                    names=["doc_id", "n_shingles", "same", "bands", "signature"],
                )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, same binary, bands array<long>, signature binary")


def links(ids: np.ndarray, signatures: np.ndarray, sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the confirmed links between rows of two chunks.

    ``first`` marks rows of the one chunk, ``second`` rows of the other (the same rows if a chunk meets itself)."""
    n = len(ids)
    root = np.arange(n)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    values, place = np.unique(flat, return_inverse=True)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    mark = np.zeros(len(values), dtype=np.int32)
    least = least_agreement(percent) * signatures.shape[1]
    out = []
    for a in range(n):
        possible = (second if first[a] else np.zeros(n, dtype=bool)) | (first if second[a] else np.zeros(n, dtype=bool))
        possible = possible & (root != root[a]) & (100 * np.minimum(sizes, sizes[a]) >= percent * np.maximum(sizes, sizes[a]))
        possible[: a + 1] = False
        near = np.flatnonzero(possible)
        if len(near):
            near = near[(signatures[near] == signatures[a]).sum(axis=1) >= least]
        if not len(near):
            continue
        own = place[starts[a] : stops[a]]
        mark[own] = 1
        if len(near) > 8:
            common = np.add.reduceat(mark[place], starts)[near]
        else:
            common = np.array([mark[place[starts[b] : stops[b]]].sum() for b in near])
        mark[own] = 0
        for b, both in zip(near, common, strict=True):
            if 100 * both >= percent * (sizes[a] + sizes[b] - both) and root[a] != root[b]:
                out.append((int(ids[a]), int(ids[b])))
                root[root == root[b]] = root[a]
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Components of documents whose shingle sets overlap by ``percent`` or more of their union.

    Input: ``doc_id`` (integer), ``text``; other columns are ignored.  Output: ``doc_id``, ``n_shingles``, ``component_id`` (the
    smallest id reachable, itself included), ``kept`` (whether that is its own).  There are as many bands as find a
    pair at ``percent`` with all but a millionth's probability, so lower percentages need more.

    Null and empty texts have no shingles and link with nothing.  A null id links with nothing either, is
    its own component (null) and kept.  Rows that repeat an id are separate documents under one name: each
    row's component is that of its text.  Equal texts of one id are all kept or all not.  An empty table
    gives an empty result.
    """
    ship(docs.sparkSession)
    rows = keep(_sign(docs, bands_for(percent)), "minhash-rows")
    named = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = keep(
        named.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature"), F.count(F.lit(1)).alias("_n")),
        "minhash-classes",
    )
    n_keys = classes.count() * bands_for(percent)
    keys = classes.select("rep", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    candidates = meet(keys, buckets, "key", n_keys).where("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v"))
    groups = components(candidates, "minhash-groups").withColumnRenamed("node", "rep").withColumnRenamed("component", "group")
    found = keep(_confirmed(docs, classes, groups, percent), "minhash-links")
    linked = components(found, "minhash-components").withColumnRenamed("node", "rep")
    final = classes.select("same", "rep", "_n").join(linked, "rep", "left").select("same", F.coalesce("component", "rep").alias("_component"), "_n")
    met = meet(named.select("doc_id", "n_shingles", "same"), final, "same", rows.count()).select("doc_id", "n_shingles", "_component")
    alone = rows.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("_component"))
    out, component = met.union(alone), F.col("_component")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _confirmed(docs: DataFrame, classes: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Spanning links ``(u, v)`` of the pairs inside groups whose full sets overlap enough."""
    members = keep(classes.select("rep", "same", "n", "signature").join(groups, "rep"), "minhash-members")
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("weight"))
    n_docs, weight = members.agg(F.count(F.lit(1)), F.sum("n")).first()
    # small groups share a bundle, which is then one chunk; large ones are dealt into chunks by hash
    bundles = max(1, math.ceil(n_docs / 256), math.ceil((weight or 0) / CHUNK_SHINGLES))
    chunks = F.greatest(F.ceil(F.col("docs") / CHUNK_DOCS), F.ceil(F.col("weight") / CHUNK_SHINGLES)).cast("int")
    placed = (
        meet(members, sizes.select("group", chunks.alias("chunks"), F.col("docs").alias("_n")), "group", n_docs)
        .withColumn("bundle", F.when(F.col("chunks") == 1, -1 - F.pmod(F.xxhash64("group"), F.lit(bundles))).otherwise(F.col("group")))
        .withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(9)), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("rep", "same", "group", "signature", "bundle", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    )
    # members grow with the corpus, so texts meet them by a shuffle at every size
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(members.select("rep").distinct().hint("shuffle_hash"), "rep", "left_semi")
    work = keep(texts, "minhash-texts").join(placed, "rep")
    parts = max(bundles, 1)

    def confirm(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable")
        out = []
        for _, part in rows.groupby("group", sort=False):
            sets = [shingles(t) for t in part["text"]]
            # of rows that share an id, the one whose text is the class's counts
            right = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == bytes(same) for s, same in zip(sets, part["same"], strict=True)]
            part, sets = part[right].reset_index(drop=True), [s for s, ok in zip(sets, right, strict=True) if ok]
            single = ~part.duplicated(["rep", "same"]).to_numpy()
            part, sets = part[single], [s for s, ok in zip(sets, single, strict=True) if ok]
            if len(part) < 2:
                continue
            signatures = np.frombuffer(b"".join(map(bytes, part["signature"])), dtype=np.uint8).reshape(len(part), -1)
            chunk = part["chunk"].to_numpy()
            out += links(part["rep"].to_numpy(), signatures, sets, chunk == key[1], chunk == key[2], percent)
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return work.repartition(parts, "bundle", "i", "j").groupBy("bundle", "i", "j").applyInPandas(confirm, "u long, v long")


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose ids ``near_duplicates`` keeps, with their columns, whatever their names.

    Rows of null id, without words, or of null text stay.  Of rows that repeat an id all stay if any of their texts stays.
    An empty table gives an empty result."""
    judged = near_duplicates(docs, percent).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    return without(docs, judged.where("not kept"))


def op10_minhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


#: All pairs that share a shingle, in plain SQL.
OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS l FROM w
), n AS (SELECT doc_id, CAST(len(l) AS BIGINT) AS n FROM l), s AS (SELECT doc_id, unnest(l) AS shingle FROM l),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, x.v FROM r JOIN both_ways x ON x.u = r.reached)
SELECT doc_id, any_value(n.n) AS n_shingles, min(reached) AS component_id, doc_id = min(reached) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id
"""
