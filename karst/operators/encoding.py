"""Chat records to token arrays with loss masks, by any tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from karst.functions.arrays import PAD_LABEL

#: A tokenizer gives ids and the (start, end) characters of each.
Tokenizer = Callable[[str], tuple[list[int], list[tuple[int, int]]]]
SCHEMA = "input_ids array<int>, labels array<int>, full_len int, prompt_len int, answer_len int, truncated boolean, bpe_fallback boolean, supervised int, fault string"


def chars() -> Tokenizer:
    """One id per character: its code point."""
    return lambda text: ([ord(c) for c in text], [(i, i + 1) for i in range(len(text))])


def template(messages: list[dict]) -> str:
    """Messages each between marks of their role."""
    return "".join(f"<|{m['role']}|>\n{m['content']}<|end|>\n" for m in messages)


def prompt_length(tokenizer: Tokenizer, prompt: str, ids: list[int], offsets: list[tuple[int, int]]) -> tuple[int, bool] | None:
    """Tokens of the prompt, and whether they were found by place since a token goes over its end; None if nothing is left."""
    own = tokenizer(prompt)[0]
    if ids[: len(own)] == own:
        return len(own), False
    return next(((k, True) for k, (start, _) in enumerate(offsets) if start >= len(prompt)), None)


def encode_record(tokenizer: Tokenizer, messages: list[dict] | None, most: int) -> dict:
    """Token arrays of one record. A record that doesn't end with an answer, or lacks content, has a fault and nothing else."""
    if not messages or any(m is None or m["content"] is None or m["role"] is None for m in messages):
        return {"fault": "content"}
    if messages[-1]["role"] != "assistant":
        return {"fault": "no_answer"}
    head = template(messages[:-1]) + "<|assistant|>\n"
    ids, offsets = tokenizer(template(messages))
    found = prompt_length(tokenizer, head, ids, offsets)
    if found is None:
        return {"fault": "no_boundary"}
    n, fallback = found
    kept = ids[:most]
    labels = [PAD_LABEL] * min(n, len(kept)) + kept[n:]
    return {"input_ids": kept, "labels": labels, "full_len": len(ids), "prompt_len": n, "answer_len": len(ids) - n, "truncated": len(ids) > most, "bpe_fallback": fallback, "supervised": sum(x != PAD_LABEL for x in labels), "fault": None}


def encode_chats(df: DataFrame, key: str, make: Callable[[], Tokenizer] = chars, most: int = 384) -> DataFrame:
    """(key, input_ids, labels, lengths and flags, fault) of each record; ``make`` builds the tokenizer once a task."""
    kind = df.schema[key].dataType.simpleString()
    names = ["input_ids", "labels", "full_len", "prompt_len", "answer_len", "truncated", "bpe_fallback", "supervised", "fault"]
    kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int32()] * 3, pa.bool_(), pa.bool_(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = make()
        for batch in batches:
            rows = [encode_record(tokenizer, m, most) for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds))], [key, *names])

    return df.select(key, "messages").mapInArrow(run, f"{key} {kind}, {SCHEMA}")
