"""Digests and hash draws."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def priority(seed: int, key: Column) -> Column:
    """Stable pseudo-random order of keys."""
    return sha256(F.concat(F.lit(f"{seed}:"), key))


def hex_mod(digest: Column, n: int) -> Column:
    """A hex number of any length modulo n, digit by digit."""
    digits = F.transform(F.split(digest, ""), lambda c: F.instr(F.lit("0123456789abcdef"), c) - 1)
    return F.aggregate(F.filter(digits, lambda d: d >= 0), F.lit(0), lambda acc, d: (acc * 16 + d) % n)


def canonical(value: object, compact: bool = True) -> str:
    """JSON with sorted keys, in UTF-8; NaN and infinities are errors. Not compact: with blanks behind separators."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":") if compact else None)


def _plain(value: object) -> object:
    return {k: _plain(v) for k, v in value.items()} if isinstance(value, dict) else [_plain(v) for v in value] if isinstance(value, list) else value


def fingerprint(text: Column, compact: bool = True) -> Column:
    """SHA-256 of the canonical form of JSON text; null for null, broken and non-finite values."""

    def one(t: str | None) -> str | None:
        try:
            return hashlib.sha256(canonical(_plain(json.loads(t)), compact).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def ordered_digest(value: Column) -> Column:
    """Aggregate: SHA-256 of the sorted non-null values of a group, joined by line breaks. Groups should be bounded."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(value)), "\n"), 256)
