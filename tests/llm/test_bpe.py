import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from keyloom.llm.bpe import Decoder, Tokenizer, Transducer, encode_documents  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
OWN = Tokenizer(json.load(open(PATH, encoding="utf-8")))
LIBRARY = tokenizers.Tokenizer.from_file(PATH)


def check(text):
    wanted = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == wanted
    assert "".join(OWN.decode(wanted)) == LIBRARY.decode(wanted, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x1FFFF, exclude_categories=["Cs", "Cn"]), max_size=60))
def test_any_text(text):
    check(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "ha" * 3000, "!" * 999, "it's we'll DON'T", "<|startoftext|> a<|endoftext|>b <|endoftext", "ΑΣ σΣ", "é e\u0301", "a\x85b\u3000c", "q\u0749\u089a", "q\u1dfa\u0316", "\U00011935\U00011930", "e\u0898\u0301", "\u1c89 \ua7cb\ua7dc \U00010d50 \U00016ea0"])
def test_cases(text):
    check(text)


def test_memory_stays_constant():
    """A word without end is encoded as it comes."""
    coder = Transducer(OWN.vocab, [tuple(m) for m in json.load(open(PATH, encoding="utf-8"))["model"]["merges"]], "</w>")
    read = 0

    def letters():
        nonlocal read
        for _ in range(20_000):
            read += 1
            yield "abetinosr"[read * read % 9]

    written, most = 0, 0
    back = {i: len(t.removesuffix("</w>")) for t, i in OWN.vocab.items()}
    for token in coder.words(letters()):
        written += back[token]
        most = max(most, read - written)
    assert written == 20_000
    assert most <= 8 * coder.lookahead


def test_text_round_trip():
    text = "hello wörld 日本 🙂 !"
    assert "".join(OWN.decode_text(OWN.encode(text))).strip() == text


def test_characters_leave_when_complete():
    """Ids one at a time give what all at once give, and no character before its last byte."""
    ids = OWN.encode("日本 🙂 " * 50 + "wörld")
    machine, held, out = Decoder(OWN._text_bytes), b"", ""
    for i in ids:
        held += OWN._text_bytes[i]
        piece = machine.feed([i])
        held = held[len(piece.encode()) :]
        assert len(held) < 4 and "\ufffd" not in piece
        out += piece
    assert out + machine.finish() == "".join(OWN.decode_text(ids)) and held == b""
    assert machine.feed([]) == "" and Decoder(OWN._text_bytes).finish() == ""
    named = Decoder(OWN._name_bytes, b" ")
    assert "".join(named.feed([i]) for i in ids) + named.finish() == LIBRARY.decode(ids, skip_special_tokens=False)
    cut = Decoder({0: "é".encode()[:1]})
    assert cut.feed([0]) == "" and cut.finish() == "\ufffd"


def test_decoded_text(odd):
    rows = encode_documents(odd, PATH, with_ids=False, with_text=True)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded"]
    long = next(r.decoded for r in rows.collect() if r.doc_id == 6)
    assert long.split() == ("long " * 30_000 + "end").split()


def test_odd_rows(odd, empty):
    rows = encode_documents(odd, PATH).collect()
    assert len(rows) == odd.count() and encode_documents(empty, PATH).count() == 0
    nothing = hashlib.sha256(b"").hexdigest()
    by = {r.doc_id: r for r in rows}
    assert by[2].n_tokens == 0 and by[2].ids == [] and by[2].ids_sha256 == by[2].decoded_sha256 == nothing
    assert by[6].ids == LIBRARY.encode("long " * 30_000 + "end", add_special_tokens=False).ids
