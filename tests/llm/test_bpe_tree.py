"""BPE by tree concatenation against the public library."""

import hashlib
import random

import numpy as np
import pytest

from lossledger.llm import registry
from lossledger.llm.bpe_tree import LEAF, cut_text, encode, encode_digests, tree_codec

from .cases import AWKWARD, documents, rows
from .test_tokens import ALPHABET, fuzz, table_texts

tokenizers = pytest.importorskip("tokenizers")
REPEATS = ["aaaa", "abab", "ing", "tion", " the", "==", "    ", "\n\n", "<|endof", "text|>"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(registry.BYTE_BPE)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_whole_texts_equal_the_library(library):
    codec = tree_codec(registry.BYTE_BPE)
    for text in fuzz(1500, 21) + table_texts()[:60]:
        want = ids_of(library, text)
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == want
        assert codec.decode(np.array(want, "<u4")).decode() == library.decode(want, skip_special_tokens=False)


def test_decode_of_arbitrary_ids_equals_the_library(library):
    codec, r = tree_codec(registry.BYTE_BPE), random.Random(4)
    for _ in range(300):
        ids = [r.randrange(50257) if r.random() < 0.5 else r.randrange(256) for _ in range(r.randint(0, 12))]
        assert codec.decode(np.array(ids, "<u4")).decode() == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("block", [9, 40, 200])
def test_blocks_join_to_the_whole(library, block):
    """Cuts run through words, special strings, white space and repetitions; the tree gives the library's ids."""
    codec, r = tree_codec(registry.BYTE_BPE), random.Random(block)
    texts = ["".join(r.choices(ALPHABET + REPEATS if k % 2 else REPEATS[:4], k=r.randint(0, 120))) for k in range(500)]
    for text in [*texts, "x" * 3000, "aab" * 1500, " " * 900 + "x", "é" * 700, "<|endoftext|>" * 60]:
        parts = cut_text(text.encode(), block)
        assert b"".join(parts) == text.encode() and all(p.decode() is not None and len(p) <= max(block, 8) for p in parts)
        joined = codec.tree([codec.encode_block(p) for p in parts])
        assert joined.ids.tolist() == ids_of(library, text)
        assert joined.begins.tolist() == codec.encode_block(text.encode()).begins.tolist()


def test_long_words_are_halved(library):
    codec, r = tree_codec(registry.BYTE_BPE), random.Random(8)
    for letters in ("ab", "abcdefghij", "aei", "=-"):
        word = "".join(r.choices(letters, k=LEAF * 20))
        assert codec.word(word.encode()) == ids_of(library, word)


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_awkward_rows(spark, library, block):
    """Long texts go through blocks, shuffles and the tree; repeated rows come back as often as they occur."""
    df = documents(spark, AWKWARD + [(7, AWKWARD[7][1]), (None, AWKWARD[7][1]), (20, "q" * 999), (20, "q" * 999)])
    pairs = rows(df, "doc_id", "text")
    got = sorted(rows(encode_digests(df, registry.BYTE_BPE, block=block), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), key=str)
    want = []
    for i, text in pairs:
        ids = ids_of(library, text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    whole = [(r["doc_id"], r["decoded"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows(encode(df, registry.BYTE_BPE, block=block))]
    assert sorted(whole, key=str) == sorted([(i, t or "", ids_of(library, t or "")) for i, t in pairs], key=str)
    assert encode_digests(df.limit(0), registry.BYTE_BPE, block=block).count() == 0
