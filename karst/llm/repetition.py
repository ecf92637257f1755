"""Repetition inside a document (problem 9).

Features are densities of hashed word and character n-grams that stood before in the document.
A logistic regression over them, trained on rows labelled by their exact share and calibrated
on others, scores every document in Arrow batches against a fixed threshold. Only documents
that it flags are counted exactly, by their five-word sequences, which are no feature.

A five-word sequence that stood before holds shorter ones that did, so the density of each
shorter size is no lower than the share. Weights are not negative, and the threshold is the
score at densities of LIMIT: no document whose share reaches LIMIT is passed over.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from karst.llm.textwords import finalize, sequences, word_hashes

#: Words of the sequences whose share counts, and of those that are features.
RUN = 5
WORD_SIZES = (2, 3, 4)
CHAR_SIZES = (24,)
#: Share of repeated content from which a document counts, as a fraction.
LIMIT = (3, 10)
#: Labelled rows that a fit takes at most.
FIT_ROWS = 20_000
MODEL = os.path.join(os.path.dirname(__file__), "repetition.json")


def _repeated(hashes: np.ndarray) -> int:
    """Number of hashed n-grams that stood before, in a space of 2^28."""
    if len(hashes) < 2:
        return 0
    folded = np.sort((hashes >> np.uint64(36)).astype(np.uint32))
    return int((folded[1:] == folded[:-1]).sum())


def _char_sequences(codes: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``size`` characters, by doubling."""
    if len(codes) < size:
        return np.empty(0, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    runs, length, out, done = codes.astype(np.uint64) + np.uint64(1), 1, None, 0
    rest = size
    while rest:
        if rest & 1:
            out = runs if out is None else out[: len(codes) - done - length + 1] * np.uint64(pow(base, length, 2**64)) + runs[done:]
            done += length
        rest >>= 1
        if rest:
            runs = runs[:-length] * np.uint64(pow(base, length, 2**64)) + runs[length:]
            length *= 2
    return finalize(out)


def features(hashes: np.ndarray, text: str | None) -> np.ndarray:
    """Densities, at most 1: word n-grams that stood before by five-word sequences, characters by characters."""
    runs = max(len(hashes) - RUN + 1, 1)
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x = [_repeated(sequences(hashes, k, short=False)) / runs for k in WORD_SIZES] if len(hashes) >= RUN else [0.0] * len(WORD_SIZES)
    return np.minimum([*x, *(_repeated(_char_sequences(codes, k)) / max(len(codes), 1) for k in CHAR_SIZES)], 1.0)


def exact(hashes: np.ndarray) -> tuple[int, int]:
    """Number of five-word sequences and of distinct ones."""
    runs = np.sort(sequences(hashes, RUN, short=False))
    return len(runs), int((runs[1:] != runs[:-1]).sum()) + 1 if len(runs) else 0


def _reaches(n: int, distinct: int) -> bool:
    return (n - distinct) * LIMIT[1] >= LIMIT[0] * n > 0


class Scorer:
    """Calibrated logistic regression with weights of at least zero."""

    def __init__(self, weights: list[float], bias: float, slope: float, shift: float) -> None:
        self.weights, self.bias, self.slope, self.shift = np.asarray(weights, dtype=np.float64), bias, slope, shift

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.atleast_2d(x) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-(self.slope * z + self.shift)))

    @property
    def threshold(self) -> float:
        """Score at word densities of LIMIT, without characters; a little lower, for rounding."""
        x = np.zeros(len(self.weights))
        x[: len(WORD_SIZES)] = LIMIT[0] / LIMIT[1] - 1e-9
        return float(self(x)[0]) * (1 - 1e-9)

    @staticmethod
    def fit(x: np.ndarray, label: np.ndarray, steps: int = 4000, rate: float = 2.0, decay: float = 1e-4) -> Scorer:
        """Projected gradient descent on every second row, calibration of slope and shift on the others."""
        x, label = np.asarray(x, dtype=np.float64)[:FIT_ROWS], np.asarray(label, dtype=np.float64)[:FIT_ROWS]
        train, held = slice(0, None, 2), slice(1, None, 2)
        w, b = np.zeros(x.shape[1]), 0.0
        weight = np.where(label[train] > 0, 0.5 / max(label[train].mean(), 1e-6), 0.5 / max(1 - label[train].mean(), 1e-6))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(x[train] @ w + b)))
            g = (p - label[train]) * weight / len(p)
            w = np.maximum(0.0, w - rate * 10 * (x[train].T @ g + decay * w))
            b -= rate * 10 * g.sum()
        slope, shift, z = 1.0, 0.0, x[held] @ w + b
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(slope * z + shift)))
            g = (p - label[held]) / len(p)
            slope = max(1e-3, slope - 0.05 * (z * g).sum())
            shift -= 0.05 * g.sum()
        return Scorer([round(float(v), 6) for v in w], round(float(b), 6), round(float(slope), 6), round(float(shift), 6))

    def save(self, path: str = MODEL) -> None:
        with open(path, "w") as out:
            json.dump({"weights": self.weights.tolist(), "bias": self.bias, "slope": self.slope, "shift": self.shift}, out)


@lru_cache(maxsize=1)
def scorer() -> Scorer:
    with open(MODEL) as text:
        return Scorer(**json.load(text))


def fit_rows(texts: list[str | None]) -> Scorer:
    """Scorer from texts labelled by their exact share; takes FIT_ROWS texts at most."""
    rows = [(word_hashes(t), t) for t in texts[:FIT_ROWS]]
    return Scorer.fit(np.array([features(h, t) for h, t in rows]), np.array([_reaches(*exact(h)) for h, _ in rows]))


def repetition(documents: DataFrame) -> DataFrame:
    """(doc_id, share, score, flagged) of every document; share is 0 below five words, for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = scorer()
        floor = model.threshold
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [word_hashes(t) for t in texts]
            score = model(np.array([features(h, t) for h, t in zip(rows, texts)])) if rows else np.empty(0)
            share = [(n - d) / n if n else 0.0 for n, d in map(exact, rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(share, pa.float64()), pa.array(score, pa.float64()), pa.array(score >= floor)], ["doc_id", "share", "score", "flagged"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, share double, score double, flagged boolean")


def repetitive(documents: DataFrame) -> DataFrame:
    """doc_id of documents that the model flags and whose exact share, counted for these only, reaches the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = scorer()
        floor = model.threshold
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [word_hashes(t) for t in texts]
            if rows:
                flagged = np.flatnonzero(model(np.array([features(h, t) for h, t in zip(rows, texts)])) >= floor)
                kept = [k for k in flagged if _reaches(*exact(rows[k]))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64()))], ["doc_id"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint")
