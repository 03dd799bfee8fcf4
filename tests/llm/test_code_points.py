"""Byte-level BPE over every code point, and its pieces' hashes."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from larkspur.llm import bpe


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.VOCABULARY))
    return bpe.Codec(ranks), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_code_point_is_what_the_library_makes_of_it(both):
    own, lib = both
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 1 << 14):
        text = "".join(f"a{chr(c)}1{chr(c)} " for c in points[i : i + (1 << 14)])
        assert own.encode([text.encode()])[0] == lib.encode_ordinary(text), hex(points[i])


def test_equal_hashes_do_not_mix_pieces(both, monkeypatch):
    own, lib = both
    texts = ["one two three, two one", "", "drei zwei eins"]
    want = [lib.encode_ordinary(t) for t in texts]
    assert own.encode([t.encode() for t in texts]) == want
    monkeypatch.setattr(bpe.Chunk, "hash", lambda self, s, e: np.zeros(len(s), np.uint64))
    assert own.encode([t.encode() for t in texts]) == want
    assert own.encode([]) == [] and own.encode([b"", b""]) == [[], []]
