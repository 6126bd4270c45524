"""Encoding a corpus with a public byte-pair tokenizer: speculate and verify.

The distinct words of an Arrow batch are first split by greedy longest match,
which is nearly always what the merges would give.  A split is right exactly if
every two neighbours are *compatible*, that is, if no merge across their border
would have come before the merges that built them; all neighbour pairs of all new
words are tested at once with numpy.  Only words with an incompatible pair
go through the merges one by one.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
#: Fixed value: how this vocabulary cuts text into words before merging.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept by one Python worker before its memory of words starts anew.
MEMORY_WORDS = 1_000_000
#: Characters of text that are handled at a time.
GROUP_CHARS = 1_000_000
NEVER = np.int64(1) << 40


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, as a map to the byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Byte-pair encoder over one vocabulary file."""

    def __init__(self, path: str) -> None:
        import regex

        model = json.load(open(path, encoding="utf-8"))["model"]
        alphabet = _byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = model["vocab"]
        merged: dict[tuple[int, int], int] = {}
        for order, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merged.setdefault((vocab[left], vocab[right]), vocab[left + right])
        self.size = max(vocab.values()) + 1
        self.left = np.full(self.size, -1, dtype=np.int64)
        self.right = np.full(self.size, -1, dtype=np.int64)
        for (a, b), c in merged.items():
            if self.left[c] < 0:
                self.left[c], self.right[c] = a, b
        self.merged = merged
        keys = np.fromiter((a * self.size + b for a, b in merged), dtype=np.int64, count=len(merged))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ids = np.fromiter(merged.values(), dtype=np.int64, count=len(merged))[order]
        self.bytes_to_id = {raw(t): i for t, i in vocab.items() if all(c in alphabet for c in t) and (len(t) == 1 or self.left[i] >= 0)}
        self.single = [self.bytes_to_id[bytes([b])] for b in range(256)]
        self._keep_reachable()
        self.longest = max(map(len, self.bytes_to_id))
        self.words = regex.compile(WORD_PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.memory: dict[str, int] = {}
        self.starts = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros(0, dtype=np.int64)
        self.store = np.zeros(0, dtype=np.int32)

    def _merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, inside: bool = False) -> np.ndarray:
        """Whether tokens ``a`` and ``b`` stay apart when their bytes are merged.

        Time runs backwards: the younger of the two pieces at the border is undone,
        and each time it is asked whether the pieces then at the border would
        have merged before their own outer merges.  With ``inside`` the two are the
        halves of one token, so the merge of the halves themselves is expected.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_until, y_until = np.full(len(x), NEVER), np.full(len(x), NEVER)
        fine = np.ones(len(x), dtype=bool)
        live = np.arange(len(x))
        first = inside
        while len(live):
            if not first:
                m = self._merge_of(x[live], y[live])
                crossed = (m != NEVER) & (m < x_until[live]) & (m <= y_until[live])
                fine[live[crossed]] = False
                live = live[~crossed]
            first = False
            xs, ys = x[live], y[live]
            born_x = np.where(self.left[xs] >= 0, xs, -1)
            born_y = np.where(self.left[ys] >= 0, ys, -1)
            going = (born_x >= 0) | (born_y >= 0)
            live, xs, ys, born_x, born_y = live[going], xs[going], ys[going], born_x[going], born_y[going]
            undo_x = born_x > born_y
            ux, uy = live[undo_x], live[~undo_x]
            x_until[ux], x[ux] = xs[undo_x], self.right[xs[undo_x]]
            y_until[uy], y[uy] = ys[~undo_x], self.left[ys[~undo_x]]
        return fine

    def _keep_reachable(self) -> None:
        """Leave out tokens that merging their own bytes would not give."""
        ids = np.flatnonzero(self.left >= 0)
        ok = np.ones(self.size, dtype=bool)
        ok[ids] = self.compatible(self.left[ids], self.right[ids], inside=True)
        for i in ids.tolist():
            ok[i] = ok[i] and ok[self.left[i]] and ok[self.right[i]]
        self.bytes_to_id = {b: i for b, i in self.bytes_to_id.items() if ok[i]}

    def greedy(self, word: bytes) -> list[int]:
        """Longest match from the left."""
        find, out, at, end = self.bytes_to_id.get, [], 0, len(word)
        while at < end:
            stop = min(end, at + self.longest)
            while (token := find(word[at:stop])) is None:
                stop -= 1
            out.append(token)
            at = stop
        return out

    def exact(self, word: bytes) -> list[int]:
        """The merges one by one; the lowest id first, the leftmost on ties.

        Live neighbour pairs stand in a heap, so a very long word costs n log n.
        """
        import heapq

        ids = [self.single[b] for b in word]
        nxt, prv = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(m, k) for k in range(len(ids) - 1) if (m := self.merged.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, k = heapq.heappop(heap)
            j = nxt[k]
            if ids[k] < 0 or j >= len(ids) or self.merged.get((ids[k], ids[j])) != m:
                continue
            ids[k], ids[j] = m, -1
            nxt[k] = nxt[j]
            if nxt[j] < len(ids):
                prv[nxt[j]] = k
                if (c := self.merged.get((m, ids[nxt[k]]))) is not None:
                    heapq.heappush(heap, (c, k))
            if prv[k] >= 0 and (c := self.merged.get((ids[prv[k]], m))) is not None:
                heapq.heappush(heap, (c, prv[k]))
        return [i for i in ids if i >= 0]

    def learn(self, new: list[str]) -> None:
        """Encode words not seen before and remember them."""
        raw = [w.encode("utf-8", "replace") for w in new]
        tokens = [self.greedy(w) for w in raw]
        counts = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        flat = np.fromiter((t for ts in tokens for t in ts), dtype=np.int64, count=int(counts.sum()))
        owner = np.repeat(np.arange(len(new)), counts)
        beside = owner[1:] == owner[:-1]
        pairs, back = np.unique(flat[:-1][beside] * self.size + flat[1:][beside], return_inverse=True)
        bad = ~self.compatible(pairs // self.size, pairs % self.size)[back] if len(pairs) else np.zeros(0, dtype=bool)
        for k in np.unique(owner[1:][beside][bad]).tolist():
            tokens[k] = self.exact(raw[k])
            counts[k] = len(tokens[k])
        flat = np.fromiter((t for ts in tokens for t in ts), dtype=np.int32, count=int(counts.sum()))
        base = len(self.counts)
        self.memory.update(zip(new, range(base, base + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.store) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.store = np.concatenate([self.store, flat])

    def indexes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, and the number of words of each text."""
        if len(self.memory) > MEMORY_WORDS:
            self._forget()
        words = [self.words(t) if t else [] for t in texts]
        known = self.memory
        unseen = dict.fromkeys(w for ws in words for w in ws if w not in known)
        if unseen:
            self.learn(list(unseen))
        per_text = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        find = self.memory.__getitem__
        return np.fromiter((k for ws in words for k in map(find, ws)), dtype=np.int64, count=int(per_text.sum())), per_text

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat token ids of all texts, and the number of ids of each text."""
        numbers, per_text = self.indexes(texts)
        counts = self.counts[numbers]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.store[np.repeat(self.starts[numbers] - (ends - counts), counts) + np.arange(total)]
        return ids, self._per_text(counts, per_text)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        numbers, per_text = self.indexes(texts)
        return self._per_text(self.counts[numbers], per_text)

    @staticmethod
    def _per_text(counts: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum(per_text)
        return sums[ends] - sums[ends - per_text]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process for a vocabulary file, read once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of about GROUP_CHARS characters; one text is never cut."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= GROUP_CHARS:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def vocabulary_path(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> str:
    return os.path.join(folder, f"{name}.json")


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids): the token ids of each text by a byte-level vocabulary.

    No special tokens; their strings in a text are ordinary text.  Null and empty
    texts both give an empty list; a null key stays null.  Whole texts are encoded,
    however long; repeated rows each give a row; other columns are ignored.  The
    work is one narrow pass, without shuffle.
    """
    path = vocabulary_path(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _groups(texts):
                ids, counts = enc.encode(texts[lo:hi])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["key", "ids"])

    kind = documents.schema[key].dataType.simpleString()
    out = documents.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """The columns ``keep`` with ``n_tokens`` and ``n_chars`` of each text; 0 for null."""
    path = vocabulary_path(tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in _groups(texts):
                counts = pa.array(enc.count(texts[lo:hi]), pa.int64())
                chars = pa.array([len(t or "") for t in texts[lo:hi]], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k + 1).slice(lo, hi - lo) for k in range(len(keep))), counts, chars], names=[*keep, "n_tokens", "n_chars"])

    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(F.col(text).cast("string").alias("_text"), *keep).mapInArrow(run, f"{kinds}, n_tokens long, n_chars long")
