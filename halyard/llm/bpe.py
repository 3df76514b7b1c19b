"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word's symbols are leaves; leaf i holds the merge rank of symbols i and i + 1 with its position, and
each inner node holds the lesser of its children, so the root is the leftmost pair of the lowest rank.
A merge changes three leaves at most, and each change climbs the tree once, so a word of n bytes takes
O(n log n) steps however long it is. Encoding stops when the root holds no mergeable pair.

Texts are normalised and split by the vocabulary file's own rules. These rules never look across
ASCII white space, so encodings are kept by white-space-delimited chunk in a store that is bounded by
bytes.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import bounded, portions, rows_of

VOCABULARY = "word_bpe_49k.json"
KEPT_CHUNKS = 1_000_000
KEPT_BYTES = 128 << 20  # of chunks and their ids, in a worker
LEARN_CHUNKS = 200_000
LEARN_ROWS = 20_000
TEXTS_BYTES = 4 << 20
NONE = 1 << 80
FAR = np.int64(1 << 60)
STOP = re.compile(rb"(?<=[a-z0-9])([.,])(?=[\x20\x09-\x0D]|\Z)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the named public vocabulary lies on this machine."""
    return importlib.import_module("public_tokenizers").path(name)


def merge_symbols(symbols: list[int], ranks: dict[int, int]) -> list[int]:
    """Apply merges, lowest rank first and leftmost among equals.

    ``ranks``: ``left << 20 | right`` to ``rank << 20 | merged``. A leaf of the tree is
    ``rank << 52 | merged << 32 | position``, so the lesser of two is the one to merge first.
    """
    last = len(symbols) - 1
    if last < 1:
        return symbols
    get = ranks.get
    size = 1
    while size < last:
        size *= 2
    tree = [NONE] * (2 * size)
    i = size
    left = symbols[0]
    for leaf in range(last):
        right = symbols[leaf + 1]
        if (found := get(left << 20 | right)) is not None:
            tree[i + leaf] = found << 32 | leaf
        left = right
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    root = tree[1]
    if root == NONE:
        return symbols
    symbols = symbols[:]
    after, before = list(range(1, last + 2)), list(range(-1, last))
    while root != NONE:
        at = root & 0xFFFFFFFF
        gone = after[at]
        merged = symbols[at] = root >> 32 & 0xFFFFF
        symbols[gone] = -1
        follow = after[at] = after[gone]
        changed = []
        if gone < last:
            changed.append((gone, NONE))
        if follow <= last:
            before[follow] = at
            found = get(merged << 20 | symbols[follow])
            changed.append((at, NONE if found is None else found << 32 | at))
        else:
            changed.append((at, NONE))
        lead = before[at]
        if lead >= 0:
            found = get(symbols[lead] << 20 | merged)
            changed.append((lead, NONE if found is None else found << 32 | lead))
        for leaf, key in changed:
            i = leaf + size
            if tree[i] == key:
                continue
            tree[i] = key
            while i > 1:
                other = tree[i ^ 1]
                if other < key:
                    key = other
                i >>= 1
                if tree[i] == key:
                    break
                tree[i] = key
        root = tree[1]
    return [s for s in symbols if s >= 0]


class PairRanks:
    """Merges as sorted arrays: pairs to (rank, merged) for many words at once."""

    WIDTH = 16

    def __init__(self, ranks: dict[int, int]):
        pairs = np.array(sorted(ranks), dtype=np.int64)
        found = np.array([ranks[p] for p in pairs.tolist()], dtype=np.int64)
        self.pairs = np.append(pairs, np.int64(1 << 60))
        self.keys = np.append(found << 4, np.int64(FAR))

    def key(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``rank << 24 | merged << 4 | position`` of pairs, or FAR where there is no merge."""
        pair = left << 20 | right
        i = np.searchsorted(self.pairs, pair)
        return np.where((self.pairs[i] == pair) & (left >= 0) & (right >= 0), self.keys[i] | at, FAR)

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """The same segment tree for many words of up to WIDTH symbols, -1 where a row has no symbol."""
        w, n = symbols.shape
        tree = np.full((w, 2 * n), FAR, dtype=np.int64)
        tree[:, n : 2 * n - 1] = self.key(symbols[:, :-1], symbols[:, 1:], np.arange(n - 1))
        level = n
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        after = np.tile(np.arange(1, n + 1), (w, 1))
        before = np.tile(np.arange(-1, n - 1), (w, 1))
        rows = np.arange(w)
        while True:
            rows = rows[tree[rows, 1] != FAR]
            if not len(rows):
                return symbols
            root = tree[rows, 1]
            at, merged = root & 15, root >> 4 & 0xFFFFF
            gone = after[rows, at]
            follow = after[rows, gone]
            symbols[rows, at] = merged
            symbols[rows, gone] = -1
            after[rows, at] = follow
            inside = follow < n
            before[rows[inside], follow[inside]] = at[inside]
            right = np.where(inside, symbols[rows, np.minimum(follow, n - 1)], -1)
            lead = before[rows, at]
            left = np.where(lead >= 0, symbols[rows, lead], -1)
            tree[rows, gone + n] = FAR
            tree[rows, at + n] = self.key(merged, right, at)
            lead = np.where(lead >= 0, lead, n - 1)  # the last leaf never holds a pair
            tree[rows, lead + n] = np.where(left >= 0, self.key(left, merged, lead), FAR)
            for leaf in (gone, at, lead):
                i = (leaf + n) >> 1
                while i[0]:
                    tree[rows, i] = np.minimum(tree[rows, 2 * i], tree[rows, 2 * i + 1])
                    i = i >> 1


class Codec:
    """Encoder and decoder for a vocabulary file of the tokenizers library with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rules = Tokenizer.from_file(path)
        if spec["model"].get("type", "BPE") != "BPE" or not spec["model"].get("end_of_word_suffix") or rules.normalizer is None or rules.normalizer.normalize_str("A\u00c9") != "a\u00e9":
            raise ValueError(f"{path}: not a vocabulary of lower-case words with a word-end mark")
        self.normalise, self.split = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        end: str = model["end_of_word_suffix"] or ""
        self.inner = {t: i for t, i in self.ids.items() if len(t) == 1}
        self.last = {t[0]: i for t, i in self.ids.items() if len(t) == 1 + len(end) and t.endswith(end)}
        self.ranks: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks[self.ids[a] << 20 | self.ids[b]] = rank << 20 | self.ids[a + b]
        self.many = PairRanks(self.ranks)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for t, i in (self.ids | self.special).items():
            self.token[i] = t
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.mark = os.path.commonprefix([*self.special]).encode() or None
        # a chunk of ASCII letters is one word under the rules, which then only lower its case
        self.plain = all([w for w, _ in self.split(self.normalise(x))] == [x.lower()] for x in ("Plain", "z", "STst")) and not any(t.isalpha() for t in self.special)
        self.chunks: dict[bytes, bytes] = {}
        self.held = 0

    def symbols(self, word: str) -> list[int]:
        """First symbols of a word in the vocabulary's byte alphabet; the last one carries the word end."""
        get = self.inner.get
        out = [get(c, -1) for c in word]
        out[-1] = self.last.get(word[-1], -1)
        return out if min(out) >= 0 else [x for x in out if x >= 0]

    def encode(self, text: str) -> list[int]:
        """Ids of any text, word by word and without the store of chunks."""
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for word, _ in self.split(self.normalise(part)):
                    out.extend(merge_symbols(self.symbols(word), self.ranks))
        return out

    def decode(self, ids) -> str:
        """The vocabulary names no decoder, so tokens stand as they are, a space between them."""
        return " ".join(map(self.token.__getitem__, ids))

    def words_of(self, chunks: list[bytes]) -> tuple[list[list[str]], list[int]]:
        """The words of each chunk, and which chunks need :meth:`encode` instead."""
        words: list[list[str]] = [[]] * len(chunks)
        alone, joint = [], []
        for k, c in enumerate(chunks):
            if self.plain and c.isalpha():
                words[k] = [c.decode().lower()]
            elif (self.mark and self.mark in c) or len(c) > 256 or c.decode().split() != [c.decode()]:
                alone.append(k)
            else:
                joint.append(k)
        if joint:
            # rules split at the spaces between chunks, and a word in the byte alphabet has a letter a byte
            normal = self.normalise(" ".join(chunks[k].decode() for k in joint)).split(" ")
            pieces = iter(self.split(" ".join(normal)))
            for k, x in zip(joint, normal, strict=True):
                own, left = [], len(x.encode())
                while left > 0:
                    own.append(next(pieces)[0])
                    left -= len(own[-1])
                words[k] = own
        return words, alone

    def learn(self, chunks: list[bytes]) -> None:
        """Encode new chunks together."""
        words, alone = self.words_of(chunks)
        found: dict[str, bytes] = {}
        narrow: list[str] = []
        rows: list[int] = []
        width = self.many.WIDTH
        pad = [[-1] * i for i in range(width + 1)]
        for w in {w for own in words for w in own}:
            symbols = self.symbols(w)
            if 1 < len(symbols) <= width:
                narrow.append(w)
                rows += symbols
                rows += pad[width - len(symbols)]
            else:
                found[w] = array("I", merge_symbols(symbols, self.ranks)).tobytes()
        for at in range(0, len(narrow), LEARN_ROWS):
            part = narrow[at : at + LEARN_ROWS]
            merged = self.many.merge(np.array(rows[at * width : (at + len(part)) * width], dtype=np.int64).reshape(-1, width))
            kept = merged >= 0
            ids = merged[kept].astype("<u4").tobytes()
            ends = np.cumsum(kept.sum(axis=1)) * 4
            for w, s, e in zip(part, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                found[w] = ids[s:e]
        get = found.__getitem__
        for c, own in zip(chunks, words, strict=True):
            self.chunks[c] = get(own[0]) if len(own) == 1 else b"".join(map(get, own))
        for k in alone:
            self.chunks[chunks[k]] = array("I", self.encode(chunks[k].decode())).tobytes()

    def pieces(self, text: bytes) -> list[bytes]:
        """Chunks that can be encoded apart: split at white space, and before a last point or comma."""
        if self.mark and self.mark in text:
            return text.split()
        return STOP.sub(rb" \1", text.lower()).split()

    def all(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) for t in texts]
        stored = self.chunks
        new = {c for own in split for c in own if c not in stored}
        if new:
            if len(stored) + len(new) > KEPT_CHUNKS or self.held + sum(map(weight, new)) > KEPT_BYTES:  # forget all, then learn all that these texts hold
                stored.clear()
                self.held, new = 0, {c for own in split for c in own}
            self.held += sum(map(weight, new))
            new = list(new)
            for at in range(0, len(new), LEARN_CHUNKS):
                self.learn(new[at : at + LEARN_CHUNKS])
        for own in split:
            yield b"".join(map(stored.__getitem__, own))


@lru_cache
def checked(vocabulary: str) -> None:
    """Open the vocabulary once, so that a wrong one fails here and not in a task."""
    Codec(vocabulary_path(vocabulary))


def weight(chunk: bytes) -> int:
    """The most that a chunk takes in the store: its bytes, an id a byte, and its entry."""
    return 5 * len(chunk) + 170


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` for each row of ``docs``.

    A null text counts as empty and has no ids. Texts of any length are encoded whole; equal rows give
    equal rows; an empty table gives an empty result, and other columns are not read. ``vocabulary`` names
    a file of the public set with merges, a normaliser that lowers case and a word-end mark; another kind
    is refused with a ValueError. Each executor opens its own copy.
    """
    checked(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digests(codec: Codec, rows: Iterator[tuple]) -> Iterator[tuple]:
        for part in portions(rows, TEXTS_BYTES):
            for (doc_id, _), ids in zip(part, codec.all([t or b"" for _, t in part]), strict=True):
                view = memoryview(ids).cast("I")
                yield doc_id, len(view), np.frombuffer(ids, dtype="<i4") if keep_ids else None, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(view).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary_path(vocabulary))
        yield from bounded(digests(codec, rows_of(batches, "doc_id", "text")), schema, 2000, lambda r: 4 * r[1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def decoded(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary_path(vocabulary))
        yield from bounded(((i, codec.decode(ids or [])) for i, ids in rows_of(batches, "doc_id", "ids")), schema, 2000, lambda r: len(r[1]))

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
