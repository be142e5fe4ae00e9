"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

Pieces of equal length are interchangeable, so the packing problem is the histogram of piece lengths, of
capacity numbers at most, whatever the corpus holds. A chromosome is a list of groups: a bin's pattern
(lengths and their counts) and how many bins share it. Crossover injects whole well-filled bins of one
parent into the other, removes the receiver's bins whose pieces are now taken twice, and best-fits the
displaced pieces. Islands evolve in separate tasks; after each round their elites move to the next island.
At last each piece gets the place that its rank among the pieces of its length has in the winner.
"""

from __future__ import annotations

import bisect
import json
import pickle
import random
import re
import zlib
from collections import Counter
from itertools import compress, count, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, tokenizer_path

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
# texts of these characters only are split here; all others go to the tokenizer whole
_PLAIN = re.compile(rf"[\t\n\r -~{_LETTERS}¿¡«»]*")
_CACHE_WORDS = 800_000
_TOKENIZERS: dict = {}


class _Ids:
    """Token ids of whole texts, as little-endian 32-bit bytes, by a tokenizers file with word ends.

    Words repeat, so each word's ids are kept; the tokenizer itself sees each word once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.split_words = bool(suffix)
        if suffix:
            vocab = self.tokenizer.get_vocab()
            self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
            self.ends_word[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, "<u4").tobytes() for x in found]

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of words, many words a call: each word's ids end with the one that carries the suffix."""
        out = []
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(ends) != len(some):  # a word has no token that ends it
                out += self.whole(some)
                continue
            blob = ids.tobytes()
            out += [blob[i:j] for i, j in zip([0, *ends], ends)]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        split, rest = {}, []
        for i, text in enumerate(texts):
            if self.split_words and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
                split[i] = _WORDS.findall(text.lower())
            else:
                rest.append(i)
        if len(self.words) > _CACHE_WORDS:
            self.words.clear()
        words = self.words
        # one look-up a word; what is not there is noted with its place, and filled in once the tokenizer has seen it
        found = {i: list(map(words.get, ws)) for i, ws in split.items()}
        missing = {i: list(compress(count(), map(is_, ids, repeat(None)))) for i, ids in found.items() if None in ids}
        new = list({split[i][k] for i, places in missing.items() for k in places})
        words.update(zip(new, self.of_words(new)))
        for i, places in missing.items():
            ids, ws = found[i], split[i]
            for k in places:
                ids[k] = words[ws[k]]
        out = {i: b"".join(ids) for i, ids in found.items()}
        out.update(zip(rest, self.whole([texts[i] for i in rest])))
        return [out[i] for i in range(len(texts))]


def tokenizer(path: str) -> _Ids:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = _Ids(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Cuts documents (doc_id, text) into pieces of at most capacity tokens.

    Each document's ids end with end_id. Null and empty texts are that one id; repeated rows and null
    doc_ids are documents of their own. Returns doc_id, piece, start, length, ids_crc32, and the task and
    the rank within task and length that place() uses; stored, so that these never change.
    """

    def cut(batches):
        ids_of, part, end = tokenizer(path), TaskContext.get().partitionId(), np.asarray([end_id], "<u4").tobytes()
        seen: Counter = Counter()
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                rows = []
                for doc_id, ids in zip(doc_ids[at : at + 256], ids_of([t or "" for t in texts[at : at + 256]])):
                    ids += end
                    for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + capacity)]
                        n = len(own) // 4
                        rows.append((doc_id, k, start, n, zlib.crc32(own), part, seen[n]))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
    return stored(docs.select("doc_id", "text").mapInArrow(cut, schema), "pieces")


# ---------------------------------------------------------------- the genetic algorithm, over histograms

Group = tuple[tuple[tuple[int, int], ...], int]  # a bin's (length, count) pairs, and the number of such bins


def filled(group: Group) -> int:
    return sum(length * n for length, n in group[0])


def best_fit(lengths: list[tuple[int, int]], groups: list[Group], capacity: int) -> list[Group]:
    """Puts (length, count) pieces in the order given, each where least room stays, else into a new bin."""
    room: dict[int, Counter] = {}
    for pattern, m in groups:
        room.setdefault(capacity - filled((pattern, m)), Counter())[pattern] += m
    rooms = sorted(room)

    def put(pattern, left, m):
        if left not in room:
            room[left] = Counter()
            bisect.insort(rooms, left)
        room[left][pattern] += m

    for length, count in lengths:
        while count:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                fit = min(capacity // length, count)
                new = count // fit
                put(((length, fit),), capacity - fit * length, new)
                count -= new * fit
                continue
            left = rooms[i]
            pattern, m = next(iter(room[left].items()))
            fit = min(left // length, count)
            used = min(m, count // fit)
            if used == m:
                del room[left][pattern]
                if not room[left]:
                    del room[left]
                    rooms.pop(i)
            else:
                room[left][pattern] = m - used
            added = dict(pattern)
            added[length] = added.get(length, 0) + fit
            put(tuple(sorted(added.items(), reverse=True)), left - fit * length, used)
            count -= used * fit
    return [(pattern, m) for left in rooms for pattern, m in room[left].items()]


def fitness(groups: list[Group], capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then fuller ones."""
    return sum(m for _, m in groups), -sum(m * (filled((p, m)) / capacity) ** 2 for p, m in groups)


def _noisy(lengths: Counter, rng: random.Random, noise: float) -> list[tuple[int, int]]:
    """Lengths in falling order, or in two random shares each that move about in that order."""
    shares = []
    for n, c in lengths.items():
        part = rng.randint(0, c) if noise else c
        shares += [(n, x) for x in (part, c - part) if x]
    return sorted(shares, key=lambda x: -x[0] * (1 + noise * rng.random()))


def crossover(giver: list[Group], taker: list[Group], capacity: int, rng: random.Random, noise: float) -> list[Group]:
    well = sorted(giver, key=lambda g: -filled(g))
    inject = [(p, rng.randint(1, m)) for p, m in well[: max(1, len(well) * 2 // 3)] if rng.random() < 0.5]
    stock: Counter = Counter()
    for p, m in taker:
        for length, n in p:
            stock[length] += n * m
    for p, m in inject:
        for length, n in p:
            stock[length] -= n * m
    kept = []
    for p, m in sorted(taker, key=lambda g: -filled(g)):
        m = min(m, *(stock[length] // n for length, n in p))
        if m > 0 and (filled((p, m)) == capacity or rng.random() < 0.9):
            kept.append((p, m))
            for length, n in p:
                stock[length] -= n * m
    return best_fit(_noisy(stock, rng, noise), inject + kept, capacity)


def evolve(population: list[list[Group]], capacity: int, bound: int, generations: int, rng: random.Random):
    for _ in range(generations):
        population.sort(key=lambda g: fitness(g, capacity))
        if fitness(population[0], capacity)[0] <= bound:
            break
        a, b = rng.sample(population[: max(2, len(population) // 2)], 2)
        child = crossover(a, b, capacity, rng, rng.choice((0.0, 0.05, 0.5, 3.0)))
        if fitness(child, capacity) < fitness(population[-1], capacity):
            population[-1] = child
    return sorted(population, key=lambda g: fitness(g, capacity))


def solve(
    spark: SparkSession,
    histogram: dict[int, int],
    capacity: int = 2048,
    islands: int = 4,
    population: int = 6,
    rounds: int = 3,
    generations: int = 40,
) -> list[Group]:
    """The winner among the islands for {length: count}; ends early once no packing can have fewer bins."""
    if not histogram:
        return []
    total = sum(n * c for n, c in histogram.items())
    bound = max(-(-total // capacity), sum(c for n, c in histogram.items() if 2 * n > capacity))

    def live(batches):
        for batch in batches:
            for island, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, age = pickle.loads(blob) if blob else ([], 0)
                rng = random.Random(1000 * island + age)
                lengths = Counter(histogram)
                while len(own) < population:
                    own.append(best_fit(_noisy(lengths, rng, len(own) / population * bool(island + len(own))), [], capacity))
                own = evolve(own, capacity, bound, generations, rng)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([island], pa.int64()),
                        pa.array([fitness(own[0], capacity)[0]], pa.int64()),
                        pa.array([pickle.dumps(own)], pa.binary()),
                    ],
                    ["island", "bins", "blob"],
                )

    state = [(i, b"") for i in range(islands)]
    for age in range(1, rounds + 1):
        frame = spark.createDataFrame(state, "island long, blob binary").repartitionByRange(islands, "island")
        # a population is bounded by islands x population x capacity, whatever the corpus holds
        got = sorted(frame.mapInArrow(live, "island long, bins long, blob binary").collect())
        own = [pickle.loads(r.blob) for r in got]
        best = min((p[0] for p in own), key=lambda g: fitness(g, capacity))
        if fitness(best, capacity)[0] <= bound:
            break
        state = [(i, pickle.dumps((own[i][:-1] + [own[i - 1][0]], age))) for i in range(islands)]
    return best


# ---------------------------------------------------------------- places


def pack(pieces: DataFrame, capacity: int = 2048, **parameters) -> DataFrame:
    """Gives each of the pieces of token_pieces() a sequence_id and a gapless offset in it.

    Parameters go to solve(). An empty table has no sequences; equal rows are packed like any others.
    """
    spark = pieces.sparkSession
    by_task = stored(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(capacity, 0)
    winner = solve(spark, histogram, capacity, **parameters)
    # the ranks of a length that a group's bins take: from, length, pieces a bin, first sequence, first offset
    taken: Counter = Counter()
    runs, sequence = [], full
    for pattern, m in winner:
        offset = 0
        for length, n in pattern:
            runs.append((length, taken[length], n, sequence, offset))
            taken[length] += n * m
            offset += n * length
        sequence += m
    runs = np.array(sorted([(capacity, 0, 1, 0, 0), *runs]), np.int64)
    key = runs[:, 0] * 2**48 + runs[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            run = runs[np.searchsorted(key, length * 2**48 + rank, "right") - 1]
            nth = rank - run[:, 1]
            found = [pa.array(run[:, 3] + nth // run[:, 2]), pa.array(run[:, 4] + nth % run[:, 2] * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [*batch.schema.names[:-1], "sequence_id", "offset"])

    earlier = "coalesce(sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0)"
    first = stored(by_task.select("length", "part", F.expr(earlier).alias("earlier")), "ranks")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = pieces.join(first.hint("merge"), ["length", "part"]).select(*columns, (F.col("place") + F.col("earlier")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0, **parameters) -> DataFrame:
    """documents(doc_id, text, ...) packed into sequences; see token_pieces() and pack() for odd rows."""
    return pack(token_pieces(docs, path or tokenizer_path("word_bpe_49k.json"), capacity, end_id), capacity, **parameters)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
