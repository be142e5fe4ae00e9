import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quantloom.llm import langid

SYLLABLES = {"aa": "ka lo mi tu se".split(), "bb": "schn erg ung stei ach".split(), "cc": "éa oi ñu ção il".split()}


def some_text(lang, rng, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))).title() + rng.choice(",. ") for _ in range(n))


def brute_kneser_ney(words, order, alphabet):
    """log p(c | h) by the textbook, over dicts of strings."""
    raw = defaultdict(Counter)
    for w, n in words.items():
        s = f"\x02{w}\x03"
        for i in range(1, len(s)):
            for k in range(1, min(order, i + 1) + 1):
                raw[k][s[i - k + 1 : i + 1]] += n
    count = {order: dict(raw[order])}
    for k in range(1, order):
        before = defaultdict(set)
        for g in raw[k + 1]:
            before[g[1:]].add(g[0])
        count[k] = {g: raw[k][g] if g[0] == "\x02" else len(before[g]) for g in raw[k]}

    def p(h, c):
        k = len(h) + 1
        below = 1 / alphabet if k == 1 else p(h[1:], c)
        same = [n for g, n in count[k].items() if g[:-1] == h]
        if not same:
            return below
        n1, n2 = (sum(v == x for v in count[k].values()) for x in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        return max(count[k].get(h + c, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * below

    def word(w):
        s = f"\x02{w}\x03"
        return -sum(math.log(p(s[max(0, i - order + 1) : i], s[i])) for i in range(1, len(s)))

    return word


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_as_by_the_textbook(order):
    lists = {"x": {"banana": 3, "band": 2, "an": 1, "nab": 1, "bad": 4}, "y": {"ananas": 2, "das": 5, "sand": 1, "é": 1}}
    model = langid.fit(lists, {}, order)
    alphabet = len(set("".join([*lists["x"], *lists["y"]]))) + 2
    words = ["banana", "das", "a", "zzz", "bandé", "nananas", "x"]
    got = model.surprisal(words)
    for j, x in enumerate(["x", "y"]):
        word = brute_kneser_ney(lists[x], order, alphabet)
        assert np.allclose(got[:, j], [word(w) for w in words], atol=1e-4)
    assert got[:, 2].tolist() == [len(w) + 1 for w in words]


def test_held_out_accuracy_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(langid, "_CACHE_WORDS", 100)
    rng = random.Random(4)
    rows = [(i, some_text(x, rng, rng.randint(3, 200)), x, "s") for i, x in enumerate(rng.choices(list(SYLLABLES), [8, 1, 1], k=300))]
    odd = [(1000, None, "aa", "s"), (1001, "", "bb", "s"), (1002, "12 _ !", None, "s"), (1005, "\u00bd \u00b2 \u2460 \u2167 \u0301", "aa", "s"), (None, "ka lo mi", "cc", "s"), (1003, "wxyz qqvw " * 50, None, "s"), (1004, "Éaoi " * 20_000, None, "s"), (1004, "Éaoi " * 20_000, None, "s")]
    docs = langid.with_fold(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string").repartition(3))
    out = langid.predict(docs, langid.train(docs.where("not held_out"), 200), ["doc_id", "held_out"]).collect()
    assert len(out) == len(rows) + len(odd)
    got = {r.doc_id: r for r in out}
    held = [got[i].lang_pred == lang for i, _, lang, _ in rows if got[i].held_out]
    assert len(held) > 40 and sum(held) >= 0.98 * len(held)
    assert not any(got[i].rejected for i, *_ in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1000, 1001, 1002, 1005))
    assert got[None].lang_pred == "aa" and got[None].held_out is False
    assert got[1003].rejected and got[1004].lang_pred == "cc" and not got[1004].rejected
    assert all(0 <= r.score <= 1 for r in out)


def test_words_are_runs_of_letters():
    assert langid.words_of("Aé1b\u00bdc x_y \u2167z don't \u4f60\u597d") == ["aé", "b", "c", "x", "y", "z", "don", "t", "\u4f60\u597d"]
    assert langid.words_of("\u00bd\u00b2\u2460 12") == langid.words_of(None) == []


def test_empty_table_and_no_labels(spark):
    docs = langid.with_fold(spark.createDataFrame([(1, "ka", None)], "doc_id long, text string, lang string"))
    assert langid.train(docs) is None
    assert [r.lang_pred for r in langid.predict(docs, None, ["doc_id"]).collect()] == ["und"]
    assert langid.predict(docs.limit(0), None, ["doc_id"]).count() == 0
