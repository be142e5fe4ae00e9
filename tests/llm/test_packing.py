import random
import struct
import zlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

from quantloom.llm import packing
from quantloom.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, sequence_id string, piece string"
PATH = tokenizer_path("word_bpe_49k.json")


def odd_documents():
    rng = random.Random(3)
    texts = [None, "", "  ", "a", "Aİ ΣσΣ <|endoftext|> x", "café café ① 12½", "it's\x1c we'LL 你好"]
    texts += [" ".join(rng.choice(["the", "of", "Ærø", "1234", "don't!"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    texts += ["same words here"] * 40 + ["word " * 9000]
    return [(i, t, None, "x", "y") for i, t in enumerate(texts)] + [(3, "a", None, "x", "y"), (None, "b", None, None, None)]


def test_pieces_are_whole_and_places_gapless(spark):
    rows = odd_documents()
    out = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(5), capacity=256).collect()
    t = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 256)):
            own = ids[s : s + 256]
            want[doc_id, k, s, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    at = {}
    for r in out:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 256
    assert len(at) <= -(-sum(r.length for r in out) // 256) + 1


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("lengths, best", [({6: 4, 4: 4}, 4), ({7: 3, 5: 2, 3: 2}, 4), ({5: 4, 3: 4, 2: 4}, 4), ({10: 2}, 2)])
def test_solver_finds_the_fewest_bins(spark, lengths, best):
    winner = packing.solve(spark, lengths, 10, islands=2, rounds=2)
    got = Counter()
    for pattern, m in winner:
        assert packing.filled((pattern, m)) <= 10
        for length, n in pattern:
            got[length] += n * m
    assert got == Counter(lengths)
    assert sum(m for _, m in winner) == best


def test_crossover_keeps_every_piece():
    rng = random.Random(1)
    lengths = Counter(rng.randint(1, 90) for _ in range(400))
    a, b = (packing.best_fit(packing._noisy(lengths, rng, x), [], 100) for x in (0.5, 0.9))
    for _ in range(20):
        child = packing.crossover(a, b, 100, rng, 0.2)
        got = Counter()
        for pattern, m in child:
            for length, n in pattern:
                got[length] += n * m
        assert got == lengths
        a, b = child, a
