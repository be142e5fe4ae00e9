"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is its words, runs of letters in lower case, each between a start and an end mark; a word's surprisal
does not depend on its neighbours, so each distinct word is scored once. The models' n-grams lie in one
sorted array of hashes per order, with a column per language: log probabilities, already interpolated for
languages that lack the n-gram, and log back-off weights of contexts. The language with the least
surprisal per character wins. It is rejected where its surprisal lies nearer to that of the calibration
texts' words with their letters mixed up than to that of the words themselves, by three standard errors.

The models are fitted on docs_per_language labelled texts of each language, about that many, chosen by a
hash of doc_id; a fifth of them only calibrates. Every text is predicted whole.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_RUNS = re.compile(r"[^\W\d_]+")  # of letters, and of numerals that are no digits, such as a half
_START, _END, _PRIME = 2, 3, np.uint64(0x9E3779B97F4A7C15)
_CACHE_WORDS = 500_000


def words_of(text: str | None) -> list[str]:
    """The runs of letters (general category L) in lower case."""
    runs = _RUNS.findall((text or "").lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [w for run in runs for w in "".join(c if c.isalpha() else " " for c in run).split()]


def _marked(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all words between marks, each character's place in its word, and the words' sizes."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return codes, place, sizes


def _hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 0 to order, the hash of the k characters that end at each place."""
    out = [np.zeros(len(codes), np.uint64)]
    for _ in range(order):
        before = np.concatenate([[np.uint64(0)], out[-1][:-1]])
        out.append((before ^ (before >> np.uint64(29))) * _PRIME + codes + np.uint64(1))
    return out


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(0, len(sorted_keys) - 1))
    return at, (sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool))


def _kneser_ney(words: list[str], counts: np.ndarray, order: int, alphabet: int):
    """For each order k: (hashes, contexts, suffixes, probability), and (hashes, weight) of the contexts."""
    codes, place, sizes = _marked(words)
    hashes, weight = _hashes(codes, order), np.repeat(counts, sizes)
    grams, first = [], []
    for k in range(1, order + 1):
        at = np.flatnonzero(place >= max(1, k - 1))
        keys, one, back = np.unique(hashes[k][at], return_index=True, return_inverse=True)
        raw = np.bincount(back, weight[at], len(keys))
        one = at[one]
        grams.append((keys, hashes[k - 1][one - 1], hashes[k - 1][one], raw))
        first.append(place[one] == k - 1)
    out, lower = [], None
    for k, (keys, contexts, suffixes, raw) in enumerate(grams, 1):
        count = raw
        if k < order:  # in how many characters' wake it comes; those at a word's start count as they are
            longer, is_first = grams[k][2], first[k - 1] & (k > 1)
            i, ok = _find(keys, longer)
            count = np.where(is_first, raw, np.maximum(1, np.bincount(i[ok], minlength=len(keys))))
        n1, n2 = (count == 1).sum(), (count == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        if k == 1:
            contexts = np.zeros(len(keys), np.uint64)
        own, back = np.unique(contexts, return_inverse=True)
        total, kinds = np.bincount(back, count, len(own)), np.bincount(back, minlength=len(own))
        rest = discount * kinds / total
        below = 1.0 / alphabet if k == 1 else lower[1][_find(lower[0], suffixes)[0]]
        p = np.maximum(count - discount, 0) / total[back] + rest[back] * below
        out.append((keys, contexts, suffixes, np.log(p), own, np.log(rest)))
        lower = (keys, p)
    return out


@dataclass
class Model:
    languages: list[str]
    order: int
    floor: np.ndarray  # log probability of a character that no n-gram has
    grams: list  # by order from 1: sorted hashes, log probabilities by language
    contexts: list  # the same of contexts and their weights; zero where a language lacks the context
    limits: np.ndarray  # by language: the surprisal from which a long text is rejected, its variance per character

    def surprisal(self, words: list[str]) -> np.ndarray:
        """A row for each word: the surprisal by language, in nats, and the number of characters and marks."""
        codes, place, sizes = _marked(words)
        hashes, n = _hashes(codes, self.order), len(self.languages)
        at = np.flatnonzero(place >= 1)
        log_p = np.zeros((len(at), n))
        left = np.arange(len(at))
        for k in range(self.order, 0, -1):
            try_ = left if k <= 2 else left[place[at[left]] >= k - 1]
            keys, values = self.grams[k - 1]
            i, ok = _find(keys, hashes[k][at[try_]])
            log_p[try_[ok]] += values[i[ok]]
            missed = try_[~ok]
            if len(missed):
                keys, values = self.contexts[k - 1]
                context = hashes[k - 1][at[missed] - 1] if k > 1 else np.zeros(len(missed), np.uint64)
                i, ok = _find(keys, context)
                log_p[missed[ok]] += values[i[ok]]
            left = missed if k <= 2 else np.concatenate([missed, left[place[at[left]] < k - 1]])
        log_p[left] += self.floor
        ends = np.cumsum(sizes - 1)
        return np.column_stack([-np.add.reduceat(log_p, ends - (sizes - 1), axis=0), sizes - 1])


def fit(lists: dict[str, dict[str, int]], calibration: dict[str, dict[str, int]], order: int = 5, calibration_words: int = 20_000) -> Model:
    """Fits a model to {language: {word: count}}, and its rejection to so many distinct words at most of others."""
    languages = sorted(lists)
    alphabet = len({c for words in lists.values() for w in words for c in w}) + 2
    parts = [
        _kneser_ney(list(lists[x]), np.fromiter(lists[x].values(), float), order, alphabet) for x in languages
    ]
    grams, contexts, weights = [], [], []
    for k in range(order):
        keys, one = np.unique(np.concatenate([p[k][0] for p in parts]), return_index=True)
        context, suffix = (np.concatenate([p[k][j] for p in parts])[one] for j in (1, 2))
        own = np.unique(np.concatenate([p[k][4] for p in parts]))
        weight, log_p = np.zeros((len(own), len(languages))), np.zeros((len(keys), len(languages)))
        for j, p in enumerate(parts):
            weight[_find(own, p[k][4])[0], j] = p[k][5]
            i, ok = _find(p[k][0], keys)
            log_p[ok, j] = p[k][3][i[ok]]
            below = -np.log(alphabet) if k == 0 else grams[k - 1][1][_find(grams[k - 1][0], suffix[~ok])[0], j]
            log_p[~ok, j] = weight[_find(own, context[~ok])[0], j] + below
        grams.append((keys, log_p.astype(np.float32)))
        contexts.append((own, weight.astype(np.float32)))
    floor = np.full(len(languages), -np.log(alphabet))
    model = Model(languages, order, floor, grams, contexts, np.zeros((len(languages), 2)))
    rng = random.Random(order)
    for j, x in enumerate(languages):
        counts = calibration.get(x) or lists[x]
        words = sorted(counts)
        words = rng.sample(words, calibration_words) if len(words) > calibration_words else words
        n = np.fromiter(map(counts.__getitem__, words), float, len(words))
        own = model.surprisal(words)[:, [j, -1]]
        mixed = model.surprisal(["".join(rng.sample(w, len(w))) for w in words])
        mean = n @ own[:, 0] / (n @ own[:, 1])
        spread = n @ (own[:, 0] - mean * own[:, 1]) ** 2 / (n @ own[:, 1])
        model.limits[j] = (mean + n @ mixed[:, :-1].min(axis=1) / (n @ mixed[:, -1])) / 2, spread
    return model


def train(docs: DataFrame, docs_per_language: int = 800, order: int = 5) -> Model | None:
    """Learns from docs(doc_id, text, lang); rows with a null doc_id, lang or text are left out."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "lang").where("doc_id is not null and lang is not null and text is not null")
    share = {r.lang: min(1.0, docs_per_language / r.n) for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return None
    shares = spark.createDataFrame(list(share.items()), "lang string, share double")  # a row for each language
    dice = (F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000).alias("dice")
    chosen = docs.join(F.broadcast(shares), "lang").where(dice < F.col("share"))
    chosen = chosen.select("lang", "text", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("calibrates"))

    def count(batches):
        for batch in batches:
            for lang, text, calibrates in zip(*(c.to_pylist() for c in batch.columns)):
                words, n = np.unique(np.array(words_of(text), object), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words), pa.string()), pa.array([calibrates] * len(words), pa.bool_()), pa.array(words.tolist(), pa.string()), pa.array(n, pa.int64())],
                    ["lang", "calibrates", "word", "n"],
                )

    lists: dict[str, dict[str, int]] = {}
    calibration: dict[str, dict[str, int]] = {}
    pairs = chosen.mapInArrow(count, "lang string, calibrates boolean, word string, n long")
    for batch in pairs.groupBy("lang", "calibrates", "word").agg(F.sum("n").alias("n")).toArrow().to_batches():
        for lang, calibrates, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            (calibration if calibrates else lists).setdefault(lang, {})[word] = n
    lists = {x: dict(sorted(words.items())) for x, words in lists.items()}
    return fit(lists, calibration, order) if lists else None


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """Adds to the columns keep: lang_pred, score (0 to 1), cross_entropy (nats a character) and rejected.

    Null texts and those without letters are und, with score 0 and rejected; so is everything without a model.
    """
    kinds = [docs.schema[c] for c in keep]
    columns = keep if "text" in keep else [*keep, "text"]
    names = [*keep, "lang_pred", "score", "cross_entropy", "rejected"]

    def run(batches):
        ids: dict[str, int] = {}
        scores = np.zeros((0, len(model.languages) + 1)) if model else None
        for batch in batches:
            texts = batch.column(columns.index("text"))
            for at in range(0, len(texts), 256):
                lists = [words_of(t) if model else [] for t in texts.slice(at, 256).to_pylist()]
                if len(ids) > _CACHE_WORDS:
                    ids.clear()
                    scores = scores[:0]
                new = list(set().union(*lists) - ids.keys())
                if new:
                    ids.update(zip(new, range(len(ids), len(ids) + len(new))))
                    fresh = model.surprisal(new)
                    if len(ids) > len(scores):
                        grown = np.zeros((max(len(ids), 2 * len(scores)), fresh.shape[1]), np.float32)
                        grown[: len(ids) - len(new)] = scores[: len(ids) - len(new)]
                        scores = grown
                    scores[len(ids) - len(new) : len(ids)] = fresh
                n = len(lists)
                lang, score, rate, rejected = ["und"] * n, [0.0] * n, [None] * n, [True] * n
                some = [i for i, x in enumerate(lists) if x]
                if some:
                    rows = np.concatenate([np.fromiter(map(ids.__getitem__, lists[i]), np.int64, len(lists[i])) for i in some])
                    sizes = np.array([len(lists[i]) for i in some])
                    total = np.add.reduceat(scores[rows], np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
                    h = total[:, :-1] / total[:, -1:]
                    best = h.argmin(axis=1)
                    least = h[np.arange(len(some)), best]
                    limit, spread = model.limits[best].T
                    odd = least > limit + 3 * np.sqrt(spread / total[:, -1])
                    sure = 1 / np.exp(-(h - least[:, None]) * np.sqrt(total[:, -1:])).sum(axis=1)
                    for i, b, s, x, z in zip(some, best.tolist(), sure.tolist(), least.tolist(), odd.tolist()):
                        lang[i], score[i], rate[i], rejected[i] = model.languages[b], s, x, z
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(at, 256) for c in batch.columns[: len(keep)]), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64()), pa.array(rejected, pa.bool_())],
                    names,
                )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "lang_pred string", "score double", "cross_entropy double", "rejected boolean"])
    return docs.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, schema)


def known_language(docs: DataFrame, docs_per_language: int = 800) -> DataFrame:
    """The documents, of the same columns, without those that the models reject; models learn from the rows
    that are not held out. A null lang becomes the predicted one. Without any labelled row all are kept."""
    docs_ = with_fold(docs)
    model = train(docs_.where("not held_out"), docs_per_language)
    if model is None:
        return docs
    out = predict(docs, model, docs.columns).where("not rejected")
    return out.select(*(F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def with_fold(docs: DataFrame) -> DataFrame:
    """held_out: whether crc32(doc_id as text) mod 4 is 2; false where doc_id is null."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return docs.withColumn("held_out", F.coalesce(rest == 2, F.lit(False)))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_fold(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = train(docs.where("not held_out"))
    return predict(docs, model, ["doc_id", "held_out"])
