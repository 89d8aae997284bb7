"""The word rule that the operators share: maximal runs without space or U+0009 to U+000D."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

find_words = re.compile(WORD).findall
_IS_GAP = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = str.maketrans(UPPER, UPPER.lower())
_LOWER_BYTES = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
_P1, _P2, _P3, _P4, _P5 = (  # of xxHash
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def lower_ascii(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.translate(_LOWER) if not text.isascii() else text.lower()


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """``xxhash64`` with seed 42 of pieces of ``data`` of one length below 32; eight more bytes follow the last piece."""
    at = lambda i, kind: np.ndarray(len(data) - 8, kind, data, 0, (1,))[starts + i].astype(np.uint64, copy=False)
    h = np.full(len(starts), np.uint64((42 + int(_P5) + length) % 2**64))
    for i in range(0, length - 7, 8):
        h = _rotated(h ^ (_rotated(at(i, "<u8") * _P2, 31) * _P1), 27) * _P1 + _P4
    if length & 4:
        h = _rotated(h ^ (at(length & ~7, "<u4") * _P1), 23) * _P2 + _P3
    for i in range(length & ~3, length):
        h = _rotated(h ^ (at(i, "u1") * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of all words of the texts in order, equal to Spark's ``xxhash64``, and how many each text has.  Null is empty.
    With ``lower``, A-Z are lower-cased first."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    text = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = np.zeros(len(text) + 16, np.uint8)
    data[: len(text)] = _LOWER_BYTES[text] if lower else text
    inside = ~_IS_GAP[text]
    # places where a word may begin although the byte before is part of one
    edges = offsets[:-1][np.diff(offsets) > 0]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    keys = np.empty(len(starts), np.uint64)
    order = np.argsort(np.minimum(sizes, 32).astype(np.uint8), kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(np.minimum(sizes, 32), minlength=33))])
    for length in range(1, 32):
        these = order[cuts[length] : cuts[length + 1]]
        if len(these):
            keys[these] = _hashes(data, starts[these], length)
    for i in order[cuts[32] :]:
        keys[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]].tobytes(), 42)
    return keys, np.diff(np.searchsorted(starts, offsets))


def count_words(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_array(text: Column) -> Column:
    """All words in order; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
