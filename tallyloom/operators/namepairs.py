"""Scores of all pairs of names that share a word or nearly so, in tiles of the cross product.

A common word, a legal form or an initial, joins a large share of all names: the pairs grow
as the square of the names, and a join on words has one task for the commonest word.  So
both sides are cut into blocks, and each pair of blocks is a task of its own.  It lists, for
each name of one side, the names of the other that share a key with it, each once, scores
them in one vectorised pass and hands them on in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import similarity as sim
from tallyloom.session import cut, shuffle_width

#: Names that a tile has at most on either side, about: names are dealt by hash.
LEFT_NAMES, RIGHT_NAMES = 4096, 32768
#: Names for which a smaller block is not worth while.
FEW_NAMES = 128
#: Pairs in a batch, about.
PAIRS = 65_536
#: Positions of a name that one machine word holds; pairs of longer names are scored singly.
BITS = 64
#: Letters of a tile whose positions are kept ready; the others are laid out when met.
LETTERS = 256


class Postings:
    """For each key the names that have it."""

    def __init__(self, sets: list[Iterable[str]]) -> None:
        self.ids: dict[str, int] = {}
        ids = np.array([self.ids.setdefault(k, len(self.ids)) for s in sets for k in s], dtype=np.int64)
        self.names = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[np.argsort(ids, kind="stable")]
        self.ends = [0, *np.cumsum(np.bincount(ids, minlength=len(self.ids))).tolist()]

    def of(self, keys: Iterable[str]) -> np.ndarray:
        """The names that have a key, once for each key."""
        parts = [self.names[self.ends[i] : self.ends[i + 1]] for i in map(self.ids.get, keys) if i is not None]
        return np.concatenate(parts) if parts else self.names[:0]


class Letters:
    """For each letter and name the positions at which it stands, as bits of one word."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.length = names, np.array([len(n) for n in names], dtype=np.int64)
        codes = np.frombuffer("".join(names).encode("utf-32-le"), dtype=np.uint32)
        rows = np.repeat(np.arange(len(names)), self.length)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        self.head = np.full((4, len(names)), 0xFFFFFFFF, dtype=np.uint32)
        first = at < 4
        self.head[at[first], rows[first]] = codes[first]
        fits = at < BITS
        codes, rows, at = codes[fits], rows[fits], at[fits].astype(np.uint64)
        order = np.argsort(codes, kind="stable")
        alphabet, start = np.unique(codes[order], return_index=True)
        ends = [*start.tolist(), len(codes)]
        self._places = {chr(c): (rows[order[p:q]], at[order[p:q]]) for c, p, q in zip(alphabet.tolist(), ends, ends[1:], strict=False)}
        often = sorted(self._places, key=lambda c: -len(self._places[c][0]))[:LETTERS]
        self._ready = {c: self._laid_out(c) for c in often}

    def _laid_out(self, letter: str) -> np.ndarray:
        bits = np.zeros(len(self.names), dtype=np.uint64)
        if letter in self._places:
            rows, at = self._places[letter]
            np.bitwise_or.at(bits, rows, np.uint64(1) << at)
        return bits

    def of(self, letter: str, at: np.ndarray) -> np.ndarray:
        """The positions of a letter in the names at ``at``."""
        bits = self._ready.get(letter)
        return (self._laid_out(letter) if bits is None else bits).take(at)


def _below(n: np.ndarray) -> np.ndarray:
    """The bits of the first n positions."""
    return np.where(n > 0, np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(BITS - n, BITS - 1).astype(np.uint64), np.uint64(0))


@lru_cache(maxsize=BITS)
def _windows(length: int) -> np.ndarray:
    """For each position of a name of that length, and each length of the other name, the
    positions that Jaro looks at."""
    i, other = np.arange(length)[:, None], np.arange(BITS + 1)[None, :]
    reach = np.maximum(np.maximum(length, other) // 2 - 1, 0)
    return _below(np.minimum(other, i + reach + 1)) & ~_below(np.maximum(i - reach, 0).clip(max=BITS))


class JaroWinkler:
    """``similarity.jaro_winkler`` of a name with many."""

    def __init__(self, texts: list[str]) -> None:
        self.letters = Letters(texts)

    def of(self, text: str, at: np.ndarray) -> np.ndarray:
        far = at if len(text) > BITS else at[self.letters.length[at] > BITS]
        if not len(far):
            return self._short(text, at)
        out, near = np.empty(len(at)), self.letters.length[at] <= (BITS if len(text) <= BITS else -1)
        out[near] = self._short(text, at[near])
        out[~near] = [sim.jaro_winkler(text, self.letters.names[k]) for k in at[~near].tolist()]
        return out

    def _short(self, text: str, at: np.ndarray) -> np.ndarray:
        length, windows = self.letters.length[at], _windows(len(text))
        free, seen = np.full(len(at), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64), []
        for i, c in enumerate(text):
            places = self.letters.of(c, at)
            open_ = windows[i].take(length)
            open_ &= places
            open_ &= free
            hit = open_ != 0
            open_ &= np.negative(open_)  # the first of them
            free ^= open_
            seen.append((places, hit))
        used = ~free
        hits = np.bitwise_count(used).astype(np.int64)
        swaps = np.zeros(len(at), dtype=np.int64)
        for places, hit in seen:
            first = np.negative(used)
            first &= used
            first *= hit
            used ^= first
            places &= first
            swaps += hit & (places == 0)
        base = (hits / len(text) + hits / length + (hits - swaps // 2) / np.maximum(hits, 1)) / 3
        base[hits == 0] = 0.0
        same, prefix = np.ones(len(at), dtype=bool), np.zeros(len(at), dtype=np.int64)
        for k, c in enumerate(text[:4]):
            same &= self.letters.head[k].take(at) == ord(c)
            prefix += same
        return np.where(base < 0.7, base, base + prefix * 0.1 * (1 - base))


class Levenshtein:
    """1 less the edit distance of a name to many over the longer length."""

    def __init__(self, texts: list[str]) -> None:
        self.letters = Letters(texts)

    def of(self, text: str, at: np.ndarray) -> np.ndarray:
        length = self.letters.length[at]
        edits = self._edits(text, at, length)
        for k in np.flatnonzero(length > BITS).tolist():
            edits[k] = self._long(text, self.letters.names[at[k]])
        return 1.0 - edits / np.maximum(length, len(text))

    def _edits(self, text: str, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Columns of the table of distances as bits of their steps up and down, names of
        up to a word of bits; all names at once, letter by letter of the text."""
        up, down = np.full(len(at), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64), np.zeros(len(at), dtype=np.uint64)
        for c in text:
            same = self.letters.of(c, at)
            diagonal = same & up
            diagonal += up
            diagonal ^= up
            diagonal |= same
            diagonal |= down
            right_up = diagonal | up
            np.invert(right_up, out=right_up)
            right_up |= down
            up &= diagonal  # the steps down to the right
            right_up <<= np.uint64(1)
            right_up |= np.uint64(1)
            up <<= np.uint64(1)
            down = right_up & diagonal
            diagonal |= right_up
            np.invert(diagonal, out=diagonal)
            up |= diagonal
        inside = _below(length)
        return len(text) + np.bitwise_count(up & inside).astype(np.int64) - np.bitwise_count(down & inside)

    @staticmethod
    def _long(a: str, b: str) -> int:
        """The same for one name of any length."""
        places: dict[str, int] = {}
        for i, c in enumerate(b):
            places[c] = places.get(c, 0) | 1 << i
        inside = (1 << len(b)) - 1
        up, down = inside, 0
        for c in a:
            same = places.get(c, 0)
            diagonal = (((same & up) + up) ^ up) | same | down
            right_up, right_down = down | ~(diagonal | up), diagonal & up
            right_up = (right_up << 1 | 1) & inside
            up, down = (right_down << 1 | ~(diagonal | right_up)) & inside, right_up & diagonal & inside
        return len(a) + up.bit_count() - down.bit_count()


class Trigrams:
    """Jaccard index of the padded trigrams of a text with many; the texts are in upper case."""

    def __init__(self, texts: list[str]) -> None:
        grams = [self._grams(t) for t in texts]
        self.meet, self.sizes = Postings(grams), np.array([len(g) for g in grams], dtype=np.int64)

    @staticmethod
    def _grams(text: str) -> set[str]:
        padded = f"  {text} " if text else ""
        return {padded[k : k + 3] for k in range(len(padded) - 2)}

    def of(self, text: str, at: np.ndarray) -> np.ndarray:
        return self.jaccard(self._grams(text), at)

    def jaccard(self, grams: set[str], at: np.ndarray) -> np.ndarray:
        both = np.bincount(self.meet.of(grams), minlength=len(self.sizes))[at]
        return both / np.maximum(len(grams) + self.sizes[at] - both, 1)


class TokenSets:
    """0.7 of the Jaccard index of the words and 0.3 of that of the trigrams of the sorted
    words, 0 without a shared word; the texts are distinct words in order."""

    def __init__(self, texts: list[str]) -> None:
        words = [t.split() for t in texts]
        self.meet, self.sizes, self.trigrams = Postings(words), np.array([len(w) for w in words], dtype=np.int64), Trigrams(texts)

    def of(self, text: str, at: np.ndarray) -> np.ndarray:
        words = text.split()
        both = np.bincount(self.meet.of(words), minlength=len(self.sizes))[at]
        mixed = 0.7 * (both / np.maximum(len(words) + self.sizes[at] - both, 1)) + 0.3 * self.trigrams.of(text, at)
        return np.where(both == 0, 0.0, mixed)


def rounded(values: np.ndarray) -> np.ndarray:
    """Six places as the engine rounds: half up, on the shortest decimal of the number."""
    scaled = values * 1e6
    down = np.floor(scaled)
    over = scaled - down
    out = (down + (over >= 0.5)) / 1e6
    edge = np.flatnonzero(np.abs(over - 0.5) < 1e-4)
    if len(edge):
        some, back = np.unique(values[edge], return_inverse=True)
        out[edge] = np.array([float(Decimal(repr(v)).quantize(Decimal("1e-6"), ROUND_HALF_UP)) for v in some.tolist()])[back]
    return out


def _keys(words: str, known: dict[str, list[str]]) -> set[str]:
    """The words, and each word less one letter."""
    keys: set[str] = set()
    for w in words.split():
        if w not in known:
            known[w] = [w, *(w[:i] + w[i + 1 :] for i in range(len(w)) if len(w) > 1)]
        keys.update(known[w])
    return keys


def _tile(left: pa.StructArray, right: pa.StructArray, scorer: Callable, result: str) -> Iterator[pa.RecordBatch]:
    known: dict[str, list[str]] = {}
    meet = Postings([_keys(w, known) for w in right.field("words").to_pylist()])
    score, hit = scorer(right.field("text").to_pylist()), np.zeros(len(right), dtype=bool)
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    count = 0

    def batch() -> pa.RecordBatch:
        x = np.repeat([k for k, _, _ in held], [len(at) for _, at, _ in held])
        y = np.concatenate([at for _, at, _ in held])
        return pa.RecordBatch.from_arrays([left.field("name").take(pa.array(x)), right.field("name").take(pa.array(y)), pa.array(rounded(np.concatenate([s for _, _, s in held])))], ["x", "y", result])

    for k, (words, text) in enumerate(zip(left.field("words").to_pylist(), left.field("text").to_pylist(), strict=True)):
        hit[meet.of(_keys(words, known))] = True
        at = np.flatnonzero(hit)
        if not len(at):
            continue
        hit[at] = False
        held.append((k, at, score.of(text, at)))
        count += len(at)
        if count >= PAIRS:
            yield batch()
            held, count = [], 0
    if held:
        yield batch()


def scored_pairs(left: DataFrame, right: DataFrame, scorer: Callable, result: str) -> DataFrame:
    """Pairs of distinct names of either table that share a word, or a word less one letter
    of either, with their score.

    The tables have ``name``, ``words`` (the words that count, with spaces between) and
    ``text``, of which ``scorer`` is made for the right side and asked for the left one."""
    spark = left.sparkSession

    def blocks(names: DataFrame, side: str, most: int, least: int) -> DataFrame:
        table = cut(names.select("name", "words", "text"), "names")
        count = table.count()
        n = max(1, -(-count // most), min(-(-count // FEW_NAMES), least))
        dealt = table.groupBy(F.pmod(F.xxhash64("name"), F.lit(n)).cast("int").alias("_block")).agg(F.collect_list(F.struct("name", "words", "text")).alias(side))
        return dealt.repartitionById(n, "_block").select(side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _tile(batch.column(0)[k].values, batch.column(1)[k].values, scorer, result)

    # No broadcast and no further shuffle: each task fetches its two blocks.
    tiles = blocks(left, "_left", LEFT_NAMES, shuffle_width(spark)).hint("shuffle_replicate_nl").crossJoin(blocks(right, "_right", RIGHT_NAMES, 1))
    return tiles.mapInArrow(run, f"x string, y string, {result} double")
