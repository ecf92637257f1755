"""Private data of people inside chat messages (problem 5).

The character tagger (charcrf.py) reads overlapping windows over the whole of every
message; their tag scores are averaged where they overlap, and the best tag path is decoded
over the whole message, however long. Equal windows are scored once. Decoded spans must have
the parts that their kind needs.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.charcrf import KINDS, TAGS, Tagger, encode

MODEL = os.path.join(os.path.dirname(__file__), "pii_model.npz")
WINDOW = 512
STRIDE = 448
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}
_BATCH = 768
#: Characters that are tagged at once, so that blocks are full and of like lengths, and of a block with its padding, unless one text alone has more.
_AT_ONCE = 3_200_000
_IN_BLOCK = 800_000

_DIGIT = re.compile(r"\d")
_LETTERS = re.compile(r"[^\W\d_]+")
_AT = re.compile(r"\S@[^\s@]+\.[^\W\d_]{2}|собака.*точка|[(\[]?\s?(?:at|собака)\s?[)\]]?.*(?:dot|точка)", re.IGNORECASE | re.DOTALL)
_DATE = re.compile(r"\d{1,4}\D{1,3}\d{1,2}\D{1,3}\d{2,4}|\d{1,2}\s+[^\W\d_]+\s+\d{4}|[^\W\d_]{3,}\.?\s+\d{1,2}\D{0,4}\s+\d{4}")


def _whole(kind: str, span: str) -> bool:
    """Whether a decoded span has what its kind needs."""
    digits = len(_DIGIT.findall(span))
    if kind == "email":
        return bool(_AT.search(span))
    if kind == "phone":
        return 5 <= digits <= 18
    if kind == "id_number":
        return 8 <= digits <= 20
    if kind == "address":
        return digits > 0 and len(_LETTERS.findall(span)) > 1
    if kind == "birth_date":
        return bool(_DATE.search(span))
    parts = _LETTERS.findall(span)
    return not digits and not set(span) & set("()[]:;?!") and len(parts) >= 2 and any(len(p) > 2 for p in parts)


@lru_cache(maxsize=1)
def tagger() -> Tagger:
    return Tagger.load(MODEL)


def _chunks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Places by length, in blocks of _BATCH that hold no more than _IN_BLOCK characters with their padding."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        to = min(at + _BATCH, len(order))
        while to > at + 1 and (to - at) * int(lengths[order[to - 1]]) > _IN_BLOCK:
            to = at + (to - at) // 2
        yield order[at:to]
        at = to


def tag(texts: list[str], model: Tagger) -> list[np.ndarray]:
    """Tags of each text: windows are scored, averaged where they overlap, and decoded as a whole."""
    codes = [encode(t) for t in texts]
    places: dict[bytes, list[tuple[int, int]]] = {}
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    for k, c in enumerate(codes):
        for at in range(0, max(1, len(c) - (WINDOW - STRIDE)), STRIDE):
            places.setdefault(c[at : at + WINDOW].tobytes(), []).append((k, at))
    windows = [np.frombuffer(w, dtype=np.int16) for w in places]
    where = list(places.values())
    lengths = np.array([len(w) for w in windows], dtype=np.int64)
    tags: list[np.ndarray] = [np.empty(0, np.int8)] * len(texts)
    # of texts of several windows; characters amid a window are read with more around them and count more
    scores = {k: np.zeros((int(n), TAGS), dtype=np.float32) for k, n in enumerate(sizes) if n > WINDOW}
    seen = {k: np.zeros(len(v), dtype=np.float32) for k, v in scores.items()}
    up = np.arange(1, WINDOW + 1, dtype=np.float32)
    for some in _chunks(lengths):
        steps = int(lengths[some].max())
        if not steps:
            continue
        block = np.zeros((steps, len(some)), dtype=np.int16)
        for b, w in enumerate(some):
            block[: lengths[w], b] = windows[w]
        out = model.emissions(block, np.arange(steps)[:, None] < lengths[some])
        best = np.ascontiguousarray(model.viterbi(out, lengths[some]).T)
        for b, w in enumerate(some):
            n = int(lengths[w])
            for k, at in where[w]:
                if k in scores:
                    part = np.minimum(up[:n], up[:n][::-1])
                    scores[k][at : at + n] += out[:n, b] * part[:, None]
                    seen[k][at : at + n] += part
                else:  # the window is the whole text
                    tags[k] = best[b, :n]
    long = np.array(list(scores), dtype=np.int64)
    for some in _chunks(sizes[long]) if len(long) else ():
        which = long[some]
        held = np.zeros((int(sizes[which].max()), len(which), TAGS), dtype=np.float32)
        for b, k in enumerate(which):
            held[: sizes[k], b] = scores[k] / seen[k][:, None]
        best = model.viterbi(held, sizes[which])
        for b, k in enumerate(which):
            tags[k] = best[: sizes[k], b]
    return tags


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of tagged runs; a begin tag opens a new one."""
    kind = (tags.astype(np.int64) + 1) // 2
    cut = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | ((tags[1:] % 2 == 1) & (kind[1:] > 0))]) if len(tags) else np.empty(0, np.int64)
    ends = np.r_[cut[1:], len(tags)]
    return [(int(a), int(b), int(kind[a]) - 1) for a, b in zip(cut, ends) if kind[a]]


_MAIL = frozenset("._%+-@")


def _whole_words(text: str, start: int, end: int, kind: str) -> tuple[int, int]:
    """The span grown to whole words and numbers, an address with an at sign to all its characters."""
    goes_on = (lambda c: c.isalnum() or c in _MAIL) if kind == "email" and "@" in text[start:end] else str.isalnum
    while start > 0 and goes_on(text[start - 1]) and goes_on(text[start]):
        start -= 1
    while end < len(text) and goes_on(text[end]) and goes_on(text[end - 1]):
        end += 1
    return start, end


def _groups(texts: list[str | None]) -> Iterator[list[int]]:
    """Places of texts that aren't null or empty, of _AT_ONCE characters or one text at a time."""
    group, size = [], 0
    for k, t in enumerate(texts):
        if t:
            if group and size + len(t) > _AT_ONCE:
                yield group
                group, size = [], 0
            group.append(k)
            size += len(t)
    if group:
        yield group


def find(texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) of the private data of each text; null and empty texts have none."""
    model = tagger()
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for group in _groups(texts):
        for k, tags in zip(group, tag([texts[k] for k in group], model)):
            if not tags.any():
                continue
            text = texts[k]
            upto = 0  # spans don't overlap after growing
            for start, end, kind in spans_of(tags):
                while end > start and text[end - 1].isspace():
                    end -= 1
                while end > start and text[start].isspace():
                    start += 1
                start, end = _whole_words(text, start, end, KINDS[kind])
                span = text[start:end]
                if span.endswith(".") and (KINDS[kind] != "name" or len((_LETTERS.findall(span) or [""])[-1]) > 2):
                    end -= 1  # the end of the sentence
                if start >= upto and _whole(KINDS[kind], text[start:end]):
                    found[k].append((start, end, KINDS[kind]))
                    upto = end
    return found


def scrub(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Text with a placeholder in place of each span, all else unchanged."""
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


def _messages(examples: DataFrame) -> DataFrame:
    return examples.select("line_no", F.posexplode("messages").alias("msg_pos", "m")).select("line_no", "msg_pos", F.col("m.content").alias("content"))


def found_kinds(examples: DataFrame) -> DataFrame:
    """(line_no, msg_pos, kind): kinds that a message of any role holds; null and empty messages hold none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, places = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(i, p, kind) for i, p, spans in zip(lines, places, find(batch.column(2).to_pylist())) for kind in dict.fromkeys(s[2] for s in spans)]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["line_no", "msg_pos", "kind"])

    return _messages(examples).where("content is not null and content <> ''").mapInArrow(run, "line_no bigint, msg_pos int, kind string")


def scrubbed(examples: DataFrame) -> DataFrame:
    """(line_no, msg_pos, content, n_found): every message with placeholders; null contents stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            spans = find(texts)
            clean = [None if t is None else scrub(t, s) for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(clean, pa.string()), pa.array([len(s) for s in spans], pa.int32())], ["line_no", "msg_pos", "content", "n_found"])

    return _messages(examples).mapInArrow(run, "line_no bigint, msg_pos int, content string, n_found int")
