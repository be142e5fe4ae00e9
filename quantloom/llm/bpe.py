"""Byte-level BPE by a tokenization automaton.

The automaton reads tokens, and accepts exactly the token sequences that BPE makes. It begins as one state
with a loop for every byte. Merges, in order, each add a gadget: for (u, v) -> w, states that have an arc u
to a state with an arc v get an arc w to where the two lead, and their arc u now leads to a copy of its
target that lacks the arc v. All arcs of a token lead to one state, so a token names the state after it;
state(w) begins as state(v) was when w was made. Hence whether state p has an arc t is decided by the
later-made of the two:

    (p, t) is itself merged                     no arc
    t = (u, v) made after p                     as state p had an arc u then, if state(u) had an arc v
    p = (a, b) made after t                     as state(b) had an arc t then
    p = t = (u, v)                              as state(v) had an arc u just before
    both bytes                                  an arc

which gives the same table as the 50,000 gadgets done one by one, without the copies: the gadgets are compiled
in order, each against the automaton of those before it, and a pair's entry is kept once it is known.

To read bytes, labels are compiled into a table of gotos, each node with the tokens that end there, longest
first. As the accepted paths are closed under taking the last token off, each prefix of a word has one path,
and reading a byte has one outcome: of the tokens that end there, the one to which the state at its beginning
has an arc. So every byte is one transition, nothing is undone, and a word's tokens are those that lead back
from its end. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, tokenizer_path

_CACHE_WORDS = 300_000
_KEPT_ARCS = 2_000_000
_CODERS: dict = {}


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """Built from the label of each token and the merges, pairs of tokens in order with what they make."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.merged: dict[tuple[int, int], int] = {}
        self.made = dict.fromkeys(labels, 0)
        self.parts: dict[int, tuple[int, int]] = {}
        self.arcs: dict[int, bool] = {}  # by state and token
        dead = set()
        for time, (u, v, w) in enumerate(merges, 1):
            # the gadget is empty where no state has an arc u, or state(u) has no arc v
            if u in dead or v in dead or w in self.parts or not self.arc(u, v, time):
                if w not in self.parts:
                    dead.add(w)
                continue
            self.merged[u, v] = time
            self.made[w], self.parts[w] = time, (u, v)
        # the tables: goto by node and byte, where to go on without one, and the tokens that end at a node with
        # their sizes, the longest first
        self.goto: dict[int, int] = {}
        ends, depth = [-1], [0]
        for token, label in labels.items():
            if token not in dead and (len(label) == 1 or token in self.parts):
                node = 0
                for byte in label:
                    to = self.goto.get(node << 8 | byte)
                    if to is None:
                        to = self.goto[node << 8 | byte] = len(ends)
                        ends.append(-1)
                        depth.append(depth[node] + 1)
                    node = to
                ends[node] = token
        self.fail: list[int] = [0] * len(depth)
        self.tokens: list[tuple] = [()] * len(depth)
        for key, node in sorted(self.goto.items(), key=lambda x: depth[x[1]]):
            above, byte = key >> 8, key & 255
            while above:
                above = self.fail[above]
                if (to := self.goto.get(above << 8 | byte)) is not None:
                    self.fail[node] = to
                    break
            rest = self.tokens[self.fail[node]]
            self.tokens[node] = ((ends[node], len(labels[ends[node]])), *rest) if ends[node] >= 0 else rest
        self.size = {t: len(x) for t, x in labels.items()}

    def arc(self, p: int, t: int, time: int) -> bool:
        """Whether state p has an arc t when all merges before time are done."""
        made, parts, merged = self.made, self.parts, self.merged
        while True:
            if merged.get((p, t), time) < time:
                return False
            if made[t] > made[p]:
                time = made[t]
                t = parts[t][0]
                # the state's own arc t[0] may have gone at this very merge, if p is t[0] and so is t[1]
                if merged.get((p, t), time + 1) <= time:
                    return False
            elif made[p] > made[t]:
                time = made[p]
                p = parts[p][1]
            elif p in parts:  # p is t
                time = made[p]
                t, p = parts[p]
            else:
                return True

    def encode(self, word: bytes) -> list[int]:
        goto, fail, tokens, arcs, size = self.goto, self.fail, self.tokens, self.arcs, self.size
        last_time, node, state = len(self.made) + 1, 0, [0]
        for end, byte in enumerate(word, 1):
            while (to := goto.get(node << 8 | byte)) is None:
                node = fail[node]
            node = to
            for t, n in tokens[node]:
                if n == end:
                    break
                key = state[end - n] << 20 | t
                ok = arcs.get(key)
                if ok is None:
                    if len(arcs) > _KEPT_ARCS:
                        arcs.clear()
                    ok = arcs[key] = self.arc(state[end - n], t, last_time)
                if ok:
                    break
            state.append(t)
        path, at = [], len(word)
        while at:
            path.append(state[at])
            at -= size[state[at]]
        path.reverse()
        return path


@lru_cache(1)
def character_classes() -> dict[str, str]:
    """The characters that the tokenizers library takes for letters, numbers and white space, as ranges of a
    character class. It knows more of Unicode than unicodedata does, so that it is asked itself: a run of one
    kind makes one piece with a character of that kind before it."""
    from tokenizers import pre_tokenizers

    pieces = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    found: dict[str, list[list[int]]] = {"a": [], "1": [], "!": [], " ": []}

    def look(first: int, last: int):
        run = "".join(map(chr, range(first, last)))
        kind = next((x for x in "a1!" if len(pieces(x + run)) == 1), " " if last - first == 1 else None)
        if kind is None:
            middle = (first + last) // 2
            look(first, middle)
            look(middle, last)
        elif found[kind] and found[kind][-1][1] == first:
            found[kind][-1][1] = last
        else:
            found[kind].append([first, last])

    for first in [*range(0, 0xD800, 2048), *range(0xE000, 0x110000, 2048)]:
        look(first, first + 2048)
    return {kind: "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in ranges) for kind, ranges in found.items()}


def word_pattern(classes: dict[str, str], top: int) -> re.Pattern:
    """The byte-level rule for texts of characters up to top: the fewer ranges a class has, the faster it is."""

    def up_to(ranges: str) -> str:
        pairs = [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\U(\w{8})-\\U(\w{8})", ranges)]
        return "".join(f"\\U{a:08x}-\\U{min(b, top):08x}" for a, b in pairs if a <= top)

    letter, number, white = (up_to(classes[kind]) for kind in "a1 ")
    return re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{white}{letter}{number}]+|[{white}]+(?![^{white}])|[{white}]+"
    )


class Coder:
    """Encodes and decodes whole texts as a byte-level tokenizers file says. classes: of character_classes()."""

    def __init__(self, path: str, classes: dict[str, str]):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rule = spec["pre_tokenizer"] or {}
        if (rule.get("type"), rule.get("use_regex"), rule.get("add_prefix_space")) != ("ByteLevel", True, False) or spec["normalizer"]:
            raise ValueError(f"{path}: words are split otherwise than by the byte-level rule")
        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if s not in self.added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.emitted = [b""] * (max([*labels, *self.added.values()]) + 1)
        for i, label in [*labels.items(), *((i, s.encode()) for s, i in self.added.items())]:
            self.emitted[i] = label
        self.ascii, self.plane, self.full = (word_pattern(classes, top) for top in (0x7F, 0xFFFF, 0x10FFFF))
        self.special = re.compile(f"({'|'.join(map(re.escape, sorted(self.added, key=len, reverse=True)))})")
        self.words: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        words, out = self.words, []
        split = self.ascii if text.isascii() else self.plane if max(text) <= "\uffff" else self.full
        for word in split.findall(text):
            ids = words.get(word)
            if ids is None:
                if len(words) > _CACHE_WORDS:
                    words.clear()
                path = self.automaton.encode(word.encode("utf-8"))
                ids = np.asarray(path, "<u4").tobytes()
                if len(word) < 200:
                    words[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids, as little-endian 32-bit bytes."""
        if not self.added or not any(s in text for s in self.added):
            return self.plain(text)
        parts = self.special.split(text)
        return b"".join(
            int(self.added[x]).to_bytes(4, "little") if i % 2 else self.plain(x) for i, x in enumerate(parts)
        )

    def decode(self, ids: bytes) -> str:
        emitted = self.emitted
        return b"".join([emitted[i] for i in memoryview(ids).cast("I").tolist()]).decode("utf-8", "replace")


def coder(path: str, classes: dict[str, str] | None = None) -> Coder:
    """One for each process; on executors, classes are the driver's."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path, classes or character_classes())
    return _CODERS[path]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids binary: little-endian 32-bit ids). Null texts are as empty ones, without
    ids; repeated rows, null doc_ids and extra columns change nothing."""
    path, classes = path or tokenizer_path("byte_bpe_50k.json"), character_classes()

    def encode(batches):
        own = coder(path, classes)
        for batch in batches:
            doc_ids, texts = batch.columns
            for at in range(0, len(texts), 512):
                ids = [own.encode(t or "") for t in texts.slice(at, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, 512), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids binary")


def decode_documents(ids: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); bytes that are no UTF-8 become U+FFFD. Null ids are as none."""
    path, classes = path or tokenizer_path("byte_bpe_50k.json"), character_classes()

    def decode(batches):
        own = coder(path, classes)
        for batch in batches:
            doc_ids, blobs = batch.columns
            for at in range(0, len(blobs), 512):
                texts = [own.decode(b or b"") for b in blobs.slice(at, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, 512), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them: both steps in one pass over the rows."""
    path, classes = path or tokenizer_path("byte_bpe_50k.json"), character_classes()

    def both(batches):
        own, sha = coder(path, classes), hashlib.sha256
        for batch in batches:
            doc_ids, texts = batch.columns
            for at in range(0, len(texts), 512):
                n, of_ids, of_text = [], [], []
                for text in texts.slice(at, 512).to_pylist():
                    ids = own.encode(text or "")
                    n.append(len(ids) // 4)
                    of_ids.append(sha(ids).hexdigest())
                    of_text.append(sha(own.decode(ids).encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(at, 512), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(both, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
