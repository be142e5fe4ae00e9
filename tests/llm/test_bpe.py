import hashlib
import itertools
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quantloom.llm import bpe
from quantloom.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
ODD = ["the", " ", "  ", "\n", "'s", "'ll", "ing", "1²½", "é", "ß", "你好", "🙂", "​", "\x85", "\x1c", "====", "<|endoftext|>", "THETHE", "aaaa", "İ"]


def by_merging(word: bytes, merges):
    tokens = list(word)
    for u, v, w in merges:
        out, i = [], 0
        while i < len(tokens):
            if tokens[i : i + 2] == [u, v]:
                out.append(w)
                i += 2
            else:
                out.append(tokens[i])
                i += 1
        tokens = out
    return tokens


@pytest.mark.parametrize("seed", range(30))
def test_automaton_is_bpe_for_random_merges(seed):
    rng = random.Random(seed)
    labels = {i: bytes([i]) for i in range(256)}
    letters = [97, 98, 99][: 2 + seed % 2]
    merges = []
    pool = list(letters)
    while len(merges) < 14:
        u, v = rng.choice(pool), rng.choice(pool)
        if any(m[:2] == (u, v) for m in merges) or labels[u] + labels[v] in labels.values():
            continue
        w = 256 + len(merges)
        labels[w] = labels[u] + labels[v]
        merges.append((u, v, w))
        pool.append(w)
    automaton = bpe.Automaton(labels, merges)
    for n in range(1, 9):
        for word in itertools.product(letters, repeat=n):
            assert automaton.encode(bytes(word)) == by_merging(bytes(word), merges), (bytes(word), merges)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=8)), max_size=20).map("".join))
def test_as_the_tokenizers_library(text):
    t, own = Tokenizer.from_file(PATH), bpe.coder(PATH)
    want = t.encode(text, add_special_tokens=False).ids
    got = own.encode(text)
    assert got == struct.pack(f"<{len(want)}I", *want)
    assert own.decode(got) == t.decode(want, skip_special_tokens=False)


def test_every_character_is_split_as_by_the_library():
    t, own = Tokenizer.from_file(PATH), bpe.coder(PATH)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 8192):
        # beside a letter, a number, a space, and what ends with a contraction
        texts = ["".join(f"a{c}'m1{c} {c}!" for c in chars[i : i + 512]) for i in range(at, min(at + 8192, len(chars)), 512)]
        for text, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
            assert own.encode(text) == struct.pack(f"<{len(want.ids)}I", *want.ids)


def test_documents(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a" * 50_000, None), (4, "Hello, wörld", "x"), (4, "Hello, wörld", "x"), (None, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    t = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        sha = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        want.append((doc_id, len(ids), sha, hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, bpe.round_trip(docs).collect()))) == sorted(map(str, want))
    back = bpe.decode_documents(bpe.encode_documents(docs)).collect()
    assert sorted(map(str, map(tuple, back))) == sorted(str((i, x or "")) for i, x, _ in rows)
    assert bpe.round_trip(docs.limit(0)).count() == 0
