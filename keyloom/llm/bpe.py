"""BPE encoding and decoding by a streaming transducer with bounded look-ahead.

A BPE tokenizer whose tokens all encode to themselves has a prefix property: if the encoding of a
word ends with token ``t`` from position ``p``, then what stands before is the encoding of the first
``p`` symbols.  Two neighbouring tokens can stand side by side exactly when the merges of their joined
text leave the seam alone, which the merge ranks along the seam decide.

So the transducer reads symbols and keeps, for each position, the last token of that prefix's encoding.
Every later token starts within the last ``lookahead`` positions, where ``lookahead`` is the longest
token of the merge list in symbols.  Once the encodings of all prefixes that end in this window share a
token, no continuation can change it, and it is emitted.  Only the window and the tokens that are not
yet stable stay in memory.

Decoding is an incremental state machine from token bytes to text: characters leave it as soon as their bytes are
complete, and it holds no more than the bytes of one that is not.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from keyloom.session import ship

NONE = 1 << 60
MEMO = 120_000  # words whose ids are remembered by a task
_NO_SPACES = "\x1c\x1d\x1e\x1f"
_SPACES = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

# The library composes by Unicode 9.0, so marks that later versions added neither move nor compose there,
# and it lower-cases by Unicode 17.0, so letters newer than Python's tables change too.
_LATER_MARKS = regex.compile(
    "([\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c"
    "\U00010d24-\U00010d27\U00010eab-\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b"
    "\U0001145e\U00011839-\U0001183a\U00011930\U0001193d-\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42"
    "\U00011d44-\U00011d45\U00011d97\U00011f41-\U00011f42\U00016ff0-\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae"
    "\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef])"
)
_LATER_LETTERS = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
_LATER_LETTERS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_LATER = regex.compile(_LATER_MARKS.pattern + "|[" + "".join(map(chr, _LATER_LETTERS)) + "]")
_HIGH = re.compile("[\u07fd-\U0010ffff]")  # where the first of both stands; most texts end before it


def byte_letters() -> dict[int, str]:
    """By byte: its printable letter in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class Transducer:
    """Encodes words, given as sequences of symbols, by a merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.end = end
        self.rank: dict[tuple[int, int], int] = {}
        self.order: dict[int, int] = {}  # by token: the rank of the merge that makes it; single symbols come first
        self.parts: dict[int, tuple[int, int]] = {}
        length: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            whole = vocab[a + b]
            x, y = vocab[a], vocab[b]
            self.rank.setdefault((x, y), rank)
            if whole not in self.parts:
                self.parts[whole], self.order[whole] = (x, y), rank
                length[whole] = length.get(x, 1) + length.get(y, 1)
        self.lookahead = max(length.values(), default=1)
        # tokens inside a word, and tokens that end one (without the end mark), each as a trie from the last
        # symbol backwards; None leads to the token
        self.inner: dict = {}
        self.final: dict = {} if end else self.inner
        for token, i in vocab.items():
            ends = bool(end) and token.endswith(end)
            node = self.final if ends else self.inner
            for symbol in reversed(token[: -len(end)] if ends else token):
                node = node.setdefault(symbol, {})
            node[None] = i
        self.fits: dict[int, bool] = {}  # by both tokens in one number

    def seam(self, a: int, b: int) -> bool:
        """Whether the merges of ``a`` and ``b`` side by side leave both as they are."""
        key = a << 32 | b
        if len(self.fits) > 2 * MEMO:
            self.fits.clear()
        # (rank, left-to-right) of merges undone so far: a merge across the seam counts if it would have come first
        limit = NONE
        while True:
            joined = self.rank.get((a, b))
            if joined is not None and joined < limit:
                out = False
                break
            made_a, made_b = self.order.get(a, -1), self.order.get(b, -1)
            if made_a < 0 and made_b < 0:
                out = True
                break
            if made_a > made_b:
                # ties of rank go to the left: the merge inside ``a`` stands left of the seam
                limit, a = made_a, self.parts[a][1]
            elif made_b > made_a:
                limit, b = made_b + 1, self.parts[b][0]
            else:
                # both sides are the same merge; the left one happens first, then the right one
                limit, b = made_b + 1, self.parts[b][0]
                a, limit = self.parts[a][1], min(limit, made_a)
        self.fits[key] = out
        return out

    def words(self, symbols: Iterable[str]) -> Iterator[int]:
        """Token ids of one word, emitted once stable.  ``symbols`` may be a stream of any length."""
        span, fits, inner = self.lookahead, self.fits, self.inner
        text = ""  # the symbols that tokens not yet emitted may hold
        # by position: the last token of the encoding up to there (-1: none yet, -2: no encoding) and its length
        last, sizes, n = [-1], [0], 0
        feed = iter(symbols)
        ahead = next(feed, None)
        while ahead is not None:
            text += ahead
            n += 1
            ahead = next(feed, None)
            node = self.final if ahead is None else inner
            start = n
            while start:
                start -= 1
                node = node.get(text[start])
                if node is None:
                    last.append(-2)
                    sizes.append(1)
                    break
                token = node.get(None)
                if token is None:
                    continue
                before = last[start]
                if before >= 0:
                    fit = fits.get(before << 32 | token)
                    if fit is None:
                        fit = self.seam(before, token)
                    if not fit:
                        continue
                elif before == -2 or start:
                    continue
                last.append(token)
                sizes.append(n - start)
                break
            else:
                last.append(-2)
                sizes.append(1)
            if n >= 4 * span and ahead is not None and (stable := self._common(last, sizes, n)):
                yield from self._path(last, sizes, stable)
                # only the last stable token is still needed, as the left neighbour of what follows
                text, last, sizes = text[stable:], last[stable:], [0, *sizes[stable + 1 :]]
                n -= stable
        yield from self._path(last, sizes, n)

    def _common(self, last: list[int], sizes: list[int], n: int) -> int:
        """The latest position through which the encodings of all prefixes in the window pass."""
        open_ends = {p for p in range(max(0, n - self.lookahead + 1), n + 1) if last[p] != -2}
        while len(open_ends) > 1:
            far = max(open_ends)
            open_ends.discard(far)
            open_ends.add(max(0, far - sizes[far]))
        return open_ends.pop() if open_ends else 0

    @staticmethod
    def _path(last: list[int], sizes: list[int], stop: int) -> list[int]:
        out = []
        while stop > 0:
            out.append(last[stop])
            stop -= sizes[stop]
        return out[::-1]


def _lower(text: str) -> str:
    """Lower case character by character, without the rule for a final sigma."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


def _compose(text: str) -> str:
    """Canonical composition, in which marks of later versions stay where they are; letters of later versions in lower case."""
    if not (_HIGH.search(text) and _LATER.search(text)):
        return unicodedata.normalize("NFC", text)
    return "".join(unicodedata.normalize("NFC", part) for part in _LATER_MARKS.split(text)).translate(_LATER_LETTERS)


class Decoder:
    """Token ids to text, in as many steps as one likes: an incremental byte-to-text state machine.

    Its state is whether a token came before, and the bytes of a character that is not complete."""

    def __init__(self, table: dict[int, bytes], gap: bytes = b""):
        self.table, self.gap, self.before = table, gap, b""
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        """The characters that these ids complete."""
        if not ids:
            return ""
        raw = self.before + self.gap.join([self.table[i] for i in ids])
        self.before = self.gap
        return self.machine.decode(raw)

    def finish(self) -> str:
        """What is left at the end; bytes that make no character become U+FFFD."""
        self.before = b""
        return self.machine.decode(b"", True)


class Tokenizer:
    """A ``tokenizers`` JSON file of the kind BPE with word ends: normalise, split, byte letters, merges."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.transducer = Transducer(self.vocab, merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.letters = byte_letters()
        # ids of words seen lately, in two generations
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def normalise(text: str) -> list[str]:
        """The words of the normalised text: canonical composition, lower case, split at white space."""
        if not text.isascii():
            text = _compose(text)
        if any(c in text for c in _NO_SPACES):  # white space for Python, not for the vocabulary's pattern
            words = _SPACES.split(text)
            return [w for w in (_lower(w) for w in words) if w]
        return _lower(text).split()

    def _word(self, word: str) -> tuple[int, ...]:
        ids: list[int] = []
        for piece in self.pieces.findall(word):
            found = self.memo.get(piece) if piece != word else None
            if found is None:
                text = piece if piece.isalnum() and piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
                found = tuple(self.transducer.words(text))
                self._remember(piece, found)
            ids += found
        return tuple(ids)

    def _remember(self, word: str, ids: tuple[int, ...]) -> None:
        if len(word) <= 64:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            self.memo[word] = ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        if self.split_special and "<" in text and self.split_special.search(text):
            parts = self.split_special.split(text)
        else:
            parts = [text]
        for part in parts:
            if part in self.special:
                ids.append(self.special[part])
                continue
            for word in self.normalise(part):
                found = self.memo.get(word)
                if found is None:
                    found = self.older.get(word) or self._word(word)
                    self._remember(word, found)
                ids += found
        return ids

    @cached_property
    def _name_bytes(self) -> dict[int, bytes]:
        return {i: name.encode() for i, name in self.names.items()}

    @cached_property
    def _text_bytes(self) -> dict[int, bytes]:
        back, end = {c: b for b, c in self.letters.items()}, self.transducer.end

        def raw(name: str) -> bytes:
            word_end = bool(end) and name.endswith(end)
            return bytes(back[c] for c in (name[: -len(end)] if word_end else name)) + (b" " if word_end else b"")

        return {i: raw(name) for i, name in self.names.items() if name not in self.special} | {i: name.encode() for name, i in self.special.items()}

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The library's form of ids without a decoder, in pieces: token strings with single spaces."""
        return self._run(Decoder(self._name_bytes, b" "), ids)

    def decode_text(self, ids: Iterable[int]) -> Iterator[str]:
        """Readable text, in pieces: byte letters back to bytes, word ends to spaces."""
        return self._run(Decoder(self._text_bytes), ids)

    @staticmethod
    def _run(decoder: Decoder, ids: Iterable[int]) -> Iterator[str]:
        feed = iter(ids)
        while part := list(islice(feed, 4096)):
            yield decoder.feed(part)
        yield decoder.finish()


_TOKENIZERS: dict[str, Tokenizer] = {}


def _tokenizer(name: str, spec) -> Tokenizer:
    """One tokenizer a worker process, so that its memo outlives a task."""
    if name not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[name] = Tokenizer(json.loads(spec.value))
    return _TOKENIZERS[name]


SCHEMA = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("decoded", T.StringType()),
    ]
)


def encode_documents(docs: DataFrame, vocabulary: str, with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """Encode whole texts and decode them again.

    Input: ``doc_id``, ``text``; other columns are ignored.  ``vocabulary`` is the path of the JSON file, read on the
    driver; its size bounds the broadcast.  Output: ``doc_id``, ``n_tokens``, ``ids`` (unless ``with_ids`` is false),
    ``ids_sha256`` (of little-endian unsigned 32-bit ids), ``decoded_sha256`` (of the text that the library decodes to), and with
    ``with_text`` ``decoded``, the readable text of the ids.  Ids are equal to those of the tokenizers
    library without special tokens added; strings of special tokens inside a text become their ids, as there.

    Null text counts as empty: no ids, and the hash of nothing.  Rows are independent, so repeated rows,
    null ids and empty tables need no rule of their own.
    """
    ship(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        raw = f.read()
    name = hashlib.sha256(raw).hexdigest()
    spec = docs.sparkSession.sparkContext.broadcast(raw)
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *[f for f in SCHEMA if {"ids": with_ids, "decoded": with_text}.get(f.name, True)]]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(name, spec)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                n, all_ids, hashes, decoded, texts = [], [], [], [], []
                for text in part.column("text").to_pylist():
                    ids = np.asarray(tokenizer.encode(text or ""), dtype="<u4")
                    n.append(len(ids))
                    if with_ids:
                        all_ids.append(ids.astype("i4"))
                    hashes.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    out = hashlib.sha256()
                    for piece in tokenizer.decode(ids.tolist()):
                        out.update(piece.encode())
                    decoded.append(out.hexdigest())
                    if with_text:
                        texts.append("".join(tokenizer.decode_text(ids.tolist())))
                columns = [part.column("doc_id"), pa.array(n, pa.int64())]
                if with_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                columns += [pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                if with_text:
                    columns.append(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(encode, T.StructType(fields))


def op7_bpe_codec(spark, sf_dir):
    import public_tokenizers

    from keyloom.llm.shared import table

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
