"""Splits and ids over all code points, against the libraries' own tables."""

import sys

import numpy as np
import public_tokenizers as P
import pytest

from loomwright.llm import bpe, letters, tokenfiles

# of the planes that hold nothing one in 97
EVERY = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (not 0x40000 <= c < 0xE0000 or c % 97 == 0)]
ODD = ["\U0003da4f첃", "\U0003daf4첃", "\U00016eb4첃", "\U0003d8b6挃", "a՘b", "a࢏1 ౜೜!", "x ꟎\U00016ea0y\U0003d000 z", "͸͹ ͸"]


def test_split_of_every_code_point_as_tiktoken():
    """A vocabulary that holds every possible piece shows the library's pieces as its tokens."""
    import tiktoken

    split = letters.Splitter(P.PATTERN, letters.kinds_of_tiktoken(P.PATTERN))
    # the splitter asks for doubtful characters one by one; here their classes are read off once more in blocks
    base = {bytes([b]): b for b in range(256)}
    different = 0
    for k in range(0, len(EVERY), 1 << 16):
        block = EVERY[k : k + (1 << 16)]
        pieces = dict.fromkeys(p.encode() for c in block for p in (c, "a" + c, c + "b", "a" + c + "b", "1" + c, "\t" + c))
        ranks = base | {p: 256 + n for n, p in enumerate(x for x in pieces if len(x) > 1)}
        lib = tiktoken.Encoding("probe", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        of = lambda text: [t.decode("utf-8", "replace") for t in lib.decode_tokens_bytes(lib.encode_ordinary(text))]  # noqa: B023, E731
        kinds = {"letter": "a", "number": "1", "blank": "\t"}
        split.kind_of = lambda c: next((kind for kind, x in kinds.items() if len(of(x + c)) == 1), "other")  # noqa: B023
        for c in block:
            text = f"a{c}b"
            if split(text) != of(text):
                different += 1
    assert different == 0


def test_classes_asked_of_the_library():
    kind_of = letters.kinds_of_tiktoken(P.PATTERN)
    assert [kind_of(c) for c in ("é", "٣", " ", "¤", "͸")] == ["letter", "number", "blank", "other", "other"]
    assert not letters.doubtful("plain été 123 漢字   ¤" + "".join(letters.STAND_INS.values()))


def test_usual_blocks_hold_nothing_doubtful():
    first, last = letters.doubtful_ranges()
    assert len(first) > 300 and all(a <= b for a, b in zip(first, last)) and all(b < a for b, a in zip(last, first[1:]))
    assert all(letters.UNUSUAL.match(chr(c)) for a, b in zip(first, last) for c in range(a, b + 1))


def test_every_code_point_as_tokenizers():
    lib = tokenfiles.LibraryEncoder(P.path("byte_bpe_50k.json"))
    texts = [f"a{c}b {c}1" for c in EVERY]
    for k in range(0, len(texts), 1 << 14):
        some = texts[k : k + (1 << 14)]
        got = list(lib.encode_batch(some))
        expected = lib.lib.encode_batch(some, add_special_tokens=False)
        assert [g for g, e in zip(got, expected) if g != np.array(e.ids, "<u4").tobytes()] == []


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts(text):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    ours = bpe.codec(path, P.PATTERN)
    for t in (text, f"word {text} word", text * 3, f"1{text}\t{text} "):
        assert next(ours.encode_batch([t])) == lib.encode_ordinary(t)
        assert ours.decode(lib.encode_ordinary(t)) == t.encode()
    enc = tokenfiles.encoder(P.path("byte_bpe_50k.json"))
    assert next(enc.encode_batch([text])) == np.array(enc.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
