"""Token ids of whole texts by a public byte-level BPE vocabulary (problem 7).

A long text is halved down to leaves; encodings of neighbours are joined by encoding
again a window around the cut. The vocabulary's pattern never puts a white-space
character behind another kind in one piece, so before such a character a piece surely
begins, whatever stands around: the window grows on both sides to the nearest such
place, and the tokens outside it stay as they are. Only token counts by bytes are needed
to find the tokens to keep, so a join costs its window and not the text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FOLDER = "/opt/tokenizers"
FILE = "byte_bpe_50k.tiktoken"
#: Pieces of the vocabulary's pre-tokenization; a fixed value of the public file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 8192
#: White space as the pattern's \\s has it (Unicode White_Space; Python's own class is wider).
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_START = re.compile(f"(?<=[^{_WHITE}])[{_WHITE}]")


class Codec:
    """Encoder and decoder of one vocabulary file of ranks."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.bytes_of[rank] = len(token)

    def plain(self, text: str) -> np.ndarray:
        return np.asarray(self._encoding.encode_to_numpy(text, disallowed_special=()), dtype=np.int32)

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        """Ids of a text; lone surrogates count as U+FFFD."""
        if not text:
            return np.empty(0, dtype=np.int32)
        try:
            text.encode()
        except UnicodeEncodeError:
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        return self._tree(text, 0, len(text), max(1, leaf))

    def _tree(self, text: str, start: int, end: int, leaf: int) -> np.ndarray:
        if end - start <= leaf:
            return self.plain(text[start:end])
        middle = (start + end) // 2
        return self.join(text, start, middle, end, self._tree(text, start, middle, leaf), self._tree(text, middle, end, leaf))

    def join(self, text: str, start: int, middle: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of text[start:end] from those of its parts before and from middle."""
        a = self._before(text, start, middle)
        b = self._after(text, middle, end)
        keep_left = self._tokens(left[::-1], len(text[a:middle].encode()))
        keep_right = self._tokens(right, len(text[middle:b].encode()))
        return np.concatenate([left[: len(left) - keep_left], self.plain(text[a:b]), right[keep_right:]])

    @staticmethod
    def _before(text: str, start: int, middle: int) -> int:
        """Last sure start of a piece before middle."""
        step = 64
        while True:
            lo = max(start, middle - step)
            last = None
            for last in _START.finditer(text, lo, middle):  # looks behind lo, too
                pass
            if last is not None and last.start() > start:
                return last.start()
            if lo == start:
                return start
            step *= 4

    @staticmethod
    def _after(text: str, middle: int, end: int) -> int:
        """First sure start of a piece behind middle; a space at middle itself may belong to a run before it."""
        found = _START.search(text, middle + 1, end) if middle + 1 < end else None
        return found.start() if found else end

    def _tokens(self, ids: np.ndarray, n_bytes: int) -> int:
        """Number of first tokens that make up n_bytes."""
        if not n_bytes:
            return 0
        take = 64
        while True:
            ends = np.cumsum(self.bytes_of[ids[:take]])
            if len(ends) == len(ids) or ends[-1] >= n_bytes:
                at = int(np.searchsorted(ends, n_bytes))
                if at == len(ends) or ends[at] != n_bytes:
                    raise AssertionError("the window doesn't end between tokens")
                return at + 1
            take *= 4

    def decode(self, ids: list[int]) -> str:
        """Text of ids, by halves; bytes that are no UTF-8 become U+FFFD."""
        if not len(ids):
            return ""
        return self._bytes(list(map(int, ids))).decode("utf-8", "replace")

    def _bytes(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return self._encoding.decode_bytes(ids)
        half = len(ids) // 2
        return self._bytes(ids[:half]) + self._bytes(ids[half:])


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_texts(documents: DataFrame, folder: str = FOLDER, key: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """(key, ids) of every row, repeated rows included; empty and null texts give an empty list.

    Special tokens are ordinary text. Other columns are not read.
    """
    path = os.path.join(folder, FILE)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            step = 512
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = [own.encode(x, leaf) if x else np.empty(0, np.int32) for x in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], [key, "ids"])

    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, folder: str = FOLDER, key: str = "doc_id") -> DataFrame:
    """(key, text) of encoded rows; null ids give null."""
    path = os.path.join(folder, FILE)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {kind}, text string")
