"""Evaluation items that leaked into documents (problem 8).

Windows of a fixed number of words of items and documents are embedded by a CGK random
walk, which turns edit distance into Hamming distance: at each of 3 * window steps the
word under the pointer is written, and the pointer moves on or stays by a random bit of
that word and step. Bit-sampling LSH compares a few places of the embedding, in several
repetitions, every other one from the end of the window to its beginning, as an edit disturbs
only what the walk meets behind it. Hits are verified by edit distance on the words.

Equal windows agree at all places, so that one repetition finds them all. With one edit, 4
places and 10 repetitions miss fewer than 1 in 100 (measured in tests/llm against the
exhaustive search, which looks up the pieces of each window of which one stands unchanged).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.textwords import finalize, word_hashes

#: Characters of items that are sent to the executors at once; more items take more passes.
BLOCK_CHARS = 20_000_000
_SLICE = 1 << 18


class Walk:
    """Random walks and sampled places of all repetitions, the same everywhere for one seed."""

    def __init__(self, window: int, places: int, repeats: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.window, self.steps = window, 3 * window
        self.salts = rng.integers(1, 2**63, size=repeats, dtype=np.int64).astype(np.uint64)
        self.places = [frozenset(rng.choice(self.steps, size=min(places, self.steps), replace=False).tolist()) for _ in range(repeats)]

    def keys(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, repeat: int) -> np.ndarray:
        """LSH key of the words from each start to its end, which may lie at the end of a text."""
        bits = finalize(hashes ^ self.salts[repeat])
        pointer = starts.copy()
        key = np.full(len(starts), self.salts[repeat], dtype=np.uint64)
        last = max(self.places[repeat])
        for j in range(last + 1):
            inside = pointer < ends
            at = np.minimum(pointer, len(hashes) - 1)
            if j in self.places[repeat]:
                key = (key ^ np.where(inside, hashes[at], np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            pointer += (((bits[at] >> np.uint64(j & 63)) & np.uint64(1)).astype(np.int64)) & inside
        return key


def _padded(parts: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All hashes in a row, and start and owner of every whole window."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    whole = np.maximum(sizes - window + 1, 0)
    owner = np.repeat(np.arange(len(parts)), whole)
    first = np.cumsum(sizes) - sizes
    within = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
    return np.concatenate([*parts, np.zeros(window + 1, dtype=np.uint64)]), np.repeat(first, whole) + within, owner


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distance of each row of a to every beginning of the same row of b, insertions, deletions and replacements costing one."""
    n, m = a.shape[1], b.shape[1]
    row = np.tile(np.arange(m + 1), (len(a), 1))
    for i in range(1, n + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        for j in range(1, m + 1):
            new[:, j] = np.minimum(np.minimum(row[:, j], new[:, j - 1]) + 1, row[:, j - 1] + (a[:, i - 1] != b[:, j - 1]))
        row = new
    return row


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distance of each row of a to the same row of b."""
    return _last_row(a, b)[:, b.shape[1]]


def least_distances(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Least edit distance of each row of a to the first n - edits or more words of the same row of b."""
    return _last_row(a, b)[:, max(a.shape[1] - edits, 0) :].min(axis=1)


def _runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place; the last places have none."""
    key = np.zeros(max(len(hashes) - size + 1, 0), dtype=np.uint64)
    for j in range(size):
        key = (key ^ hashes[j : j + len(key)]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key


def _table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, their order, and which of their first 20 bits occur."""
    order = np.argsort(keys, kind="stable")
    there = np.zeros(1 << 20, dtype=bool)
    there[(keys >> np.uint64(44)).astype(np.int64)] = True
    return keys[order], order, there


def _hits(table: tuple[np.ndarray, np.ndarray, np.ndarray], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in key, entry of the table) of equal keys."""
    keys, order, there = table
    some = np.flatnonzero(there[(key >> np.uint64(44)).astype(np.int64)])
    lo, hi = np.searchsorted(keys, key[some], "left"), np.searchsorted(keys, key[some], "right")
    many = hi - lo
    which = np.repeat(some, many)
    return which, order[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(len(which))]


class Index:
    """Tables over the windows of a set of items: of walks, or, if exhaustive, of pieces.

    ``places`` and ``repeats`` are those of the walks; pieces need none.
    """

    def __init__(self, items: list[tuple[int, str | None]], window: int, edits: int, places: int, repeats: int, seed: int, exhaustive: bool = False) -> None:
        self.walk, self.edits, self.exhaustive = Walk(window, places, repeats, seed), edits, exhaustive
        self.numbers = np.array([i for i, _ in items], dtype=np.int64)
        self.hashes, self.starts, self.owner = _padded([word_hashes(t) for _, t in items], window)
        self.tables = []
        if not edits:
            self.tables = [_table(self.walk.keys(self.hashes, self.starts, self.starts + window, r)) for r in range(repeats)]
            return
        self._distinct()
        if exhaustive:
            self._cut()
            return
        starts = np.arange(len(self.windows)) * window
        for r in range(repeats):
            line = np.r_[self.windows[:, :: 1 - 2 * (r % 2)].reshape(-1), np.zeros(1, np.uint64)]
            self.tables.append(_table(self.walk.keys(line, starts, starts + window, r)))

    def _distinct(self) -> None:
        """Equal windows are one; the items that hold each."""
        window = self.walk.window
        rows = self.hashes[self.starts[:, None] + np.arange(window)]
        self.windows, same = np.unique(rows, axis=0, return_inverse=True)
        order = np.argsort(same.reshape(-1), kind="stable")
        self.holders = self.numbers[self.owner[order]]  # items by window, first and last in bounds
        self.bounds = np.searchsorted(same.reshape(-1)[order], np.arange(len(self.windows) + 1))
        held = set(self.windows.reshape(-1).tolist())
        # a word that no item's word equals
        self.none = next(np.uint64(k) for k in range(len(held) + 1) if k not in held)

    def _cut(self) -> None:
        """Tables (size, offset, hashes, windows) of the pieces."""
        window, pieces = self.walk.window, self.edits + 1
        cuts = [window * k // pieces for k in range(pieces + 1)]
        for offset, end in zip(cuts, cuts[1:]):
            keys = np.array([], dtype=np.uint64) if not len(self.windows) else _runs(self.windows[:, offset:end].reshape(-1), end - offset)[:: end - offset]
            by = np.argsort(keys, kind="stable")
            self.tables.append((end - offset, offset, keys[by], by))

    def _items(self, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (position in parts, item number) of (position, window) pairs."""
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), dtype=np.int64)
        count = self.bounds[pairs[:, 1] + 1] - self.bounds[pairs[:, 1]]
        each = np.repeat(self.bounds[pairs[:, 1]] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        hits = np.unique(np.stack([np.repeat(pairs[:, 0], count), self.holders[each]], axis=1), axis=0)
        return hits[:, 0], hits[:, 1]

    def _verified(self, windows: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each window is within ``edits`` of the words from start, of a text that ends at end."""
        out = np.zeros(len(start), dtype=bool)
        for at in range(0, len(start), _SLICE):
            where = start[at : at + _SLICE, None] + np.arange(self.walk.window + self.edits)
            b = hashes[np.minimum(where, len(hashes) - 1)]
            b[where >= end[at : at + _SLICE, None]] = self.none
            out[at : at + _SLICE] = least_distances(windows[at : at + _SLICE], b, self.edits) <= self.edits
        return out

    def _walked(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Items with a window within ``edits`` of a run of words, by walks from both ends."""
        window, edits = self.walk.window, self.edits
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        owner, ends = np.repeat(np.arange(len(parts)), sizes), np.repeat(np.cumsum(sizes), sizes)
        starts = np.flatnonzero(ends - np.arange(len(owner)) >= window - edits)
        found = []
        for back in (0, 1):
            line = np.concatenate([*(p[::-1] if back else p for p in parts), np.zeros(1, dtype=np.uint64)])
            windows = self.windows[:, ::-1] if back else self.windows
            for r in range(back, len(self.tables), 2):
                for at in range(0, len(starts), _SLICE):
                    mine = starts[at : at + _SLICE]
                    which, w = _hits(self.tables[r], self.walk.keys(line, mine, np.minimum(mine + window, ends[mine]), r))
                    for cut in range(0, len(which), _SLICE):
                        start, one = mine[which[cut : cut + _SLICE]], w[cut : cut + _SLICE]
                        near = self._verified(windows[one], line, start, ends[start])
                        found.append(np.unique(np.stack([owner[start[near]], one[near]], axis=1), axis=0))
        return self._items(found)

    def _near(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Items with a window within ``edits`` of a run of words, by the pieces of the windows."""
        window, edits = self.walk.window, self.edits
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        ends = np.cumsum(sizes)
        hashes = np.concatenate([*parts, np.zeros(window + edits, dtype=np.uint64)])
        owner = np.repeat(np.arange(len(parts)), sizes)
        first = ends - sizes
        found = []
        for size, offset, keys, by in self.tables:
            key = _runs(hashes[: len(owner)], size)
            for at in range(0, len(key), _SLICE):
                mine = key[at : at + _SLICE]
                lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
                hit = np.flatnonzero(hi > lo)
                many = (hi - lo)[hit]
                upto = np.cumsum(many)
                total = int(upto[-1]) if len(upto) else 0
                for cut in range(0, total, _SLICE):
                    one = np.arange(cut, min(cut + _SLICE, total))
                    k = np.searchsorted(upto, one, "right")
                    w = by[lo[hit[k]] + one - (upto[k] - many[k])]
                    place = hit[k] + at
                    for shift in range(-edits, edits + 1):
                        start = place - offset + shift
                        who = owner[place]
                        ok = np.flatnonzero((start >= first[who]) & (start < ends[who]))
                        if not len(ok):
                            continue
                        near = ok[self._verified(self.windows[w[ok]], hashes, start[ok], ends[who[ok]])]
                        found.append(np.unique(np.stack([who[near], w[near]], axis=1), axis=0))
        return self._items(found)

    def search(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (position in parts, item number) of verified windows."""
        if self.edits:
            return self._near(parts) if self.exhaustive else self._walked(parts)
        window = self.walk.window
        hashes, starts, owner = _padded(parts, window)
        found = []
        span = np.arange(window)
        for r, table in enumerate(self.tables):
            for at in range(0, len(starts), _SLICE):
                mine, who = starts[at : at + _SLICE], owner[at : at + _SLICE]
                which, items = _hits(table, self.walk.keys(hashes, mine, mine + window, r))
                for cut in range(0, len(which), _SLICE):
                    w, i = which[cut : cut + _SLICE], items[cut : cut + _SLICE]
                    a, b = hashes[mine[w][:, None] + span], self.hashes[self.starts[i][:, None] + span]
                    near = (a == b).all(axis=1)  # an edit distance of 0
                    found.append(np.stack([who[w[near]], self.numbers[self.owner[i[near]]]], axis=1))
        hits = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), dtype=np.int64)
        return hits[:, 0], hits[:, 1]


def leaked_items(documents: DataFrame, items: DataFrame, window: int = 10, edits: int = 0, places: int = 10, repeats: int = 1, seed: int = 8, exhaustive: bool = False) -> DataFrame:
    """Distinct (doc_id, item_no) where a window of the item is within ``edits`` of a run of words of the document.

    With edits = 0 all are found, in one repetition. With edits, which must be fewer than the words
    of a window, walks of ``places`` and ``repeats`` find them at a recall that rises with repeats and
    falls with places; ``exhaustive`` looks up pieces instead of walks and finds all. Null ids
    are left out; null, empty and shorter texts hold no window. Items are a given query set,
    sent in blocks of BLOCK_CHARS characters.
    """
    spark = documents.sparkSession
    asked = items.where("item_no is not null").select("item_no", "item_input").distinct()
    chars = asked.agg(F.sum(F.length("item_input"))).first()[0] or 0
    blocks = int(-(-chars // BLOCK_CHARS)) or 1
    parts = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_no"), F.lit(blocks)) == b).collect() if blocks > 1 else asked.collect()
        index = spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in rows], window, edits, places, repeats, seed, exhaustive))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    where, item = index.value.search([word_hashes(t) for t in part.column(1).to_pylist()])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[where], pa.int64()), pa.array(item, pa.int64())], ["doc_id", "item_no"])

        parts.append(documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id bigint, item_no bigint"))
    return reduce(DataFrame.unionAll, parts).distinct()


def leak_report(leaks: DataFrame) -> DataFrame:
    """Per leaked item the number of documents that hold it."""
    return leaks.groupBy("item_no").agg(F.count("*").alias("n_documents"))
