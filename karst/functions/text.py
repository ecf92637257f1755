"""Column expressions over text. All stay in the JVM but for NFKC, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.isspace has it, for Java's and RE2's syntax alike.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
#: A word character as Python's \w has it.
WORD = r"[\p{L}\p{N}_]"
#: Dashes and the no-break space, and what stands for them in normalized text; fixed values.
DASHES, PLAIN = "—–‑ ", "--- "
QUESTION_MARK = "Вопрос:\n"

#: Patterns of private data and their placeholders; fixed values. Digits and white space are those of Unicode.
PII = {
    "phone": (r"(?U)(?:\+7|(?<![\p{L}\p{N}_])8)[\s\-(]{0,3}\d{3}[\s\-)]{0,3}\d{3}[\s\-]?\d{2}[\s\-]?\d{2}(?![\p{L}\p{N}_])", "[PHONE]"),
    "email": (r"(?U)(?<![\p{L}\p{N}_])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?![\p{L}\p{N}_])", "[EMAIL]"),
    "birth_date": (
        r"(?iuU)((?:дат[аеы]\s+рождения|год\s+рождения|родил(?:ся|ась)|(?<![\p{L}\p{N}_])г\.\s?р\.|(?<![\p{L}\p{N}_])д\.\s?р\.)\s*[:\-—]?\s*)"
        r"(?:0?[1-9]|[12]\d|3[01])[.\-/](?:0?[1-9]|1[0-2])[.\-/](?:19|20)\d{2}(?![\p{L}\p{N}_])",
        "$1[DATE]",
    ),
}


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """NFKC form; ASCII values never leave the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.pandas_udf(_nfkc, "string")(text)).otherwise(text)


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.btrim(text, F.lit(_SPACES))


def is_blank(text: Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(strip(text) == "", F.lit(True))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def normalize_text(text: Column, compose: bool = True) -> Column:
    """One form of a text: NFKC (unless switched off for texts already in it), plain dashes, single blanks, lower case."""
    return F.lower(collapse(F.translate(nfkc(text) if compose else text, DASHES, PLAIN)))


def normalize_group(topic: Column, compose: bool = True) -> Column:
    """Normalized part of a topic before the first |."""
    return normalize_text(F.split_part(topic, F.lit("|"), F.lit(1)), compose)


def question_key(text: Column, compose: bool = True) -> Column:
    """Normalized text behind the last question mark line, or all of it."""
    return normalize_text(F.substring_index(text, QUESTION_MARK, -1), compose)


def words(text: Column) -> Column:
    """Runs of word characters."""
    return F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0))


def ngrams(tokens: Column, size: int) -> Column:
    """Joined runs of ``size`` tokens; a shorter list has one run, an empty one none; null for null."""
    n = F.size(tokens)
    whole = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, size), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(n > 0, whole)


def pii_counts(text: Column) -> tuple[Column, dict[str, Column]]:
    """Scrubbed text and hits by kind; every pattern sees what the one before it left."""
    hits = {}
    for kind, (pattern, placeholder) in PII.items():
        hits[kind] = F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))
        text = F.regexp_replace(text, pattern, placeholder.replace("[", "\\["))
    return text, hits


def safe_path(path: Column) -> Column:
    """A relative path that never climbs: not blank, not absolute, without '..' parts, back slashes or NUL."""
    return ~is_blank(path) & ~path.rlike(r"^/|^[A-Za-z]:|\\|\x00|(^|/)\.\.(/|$)")


def replace_once(source: Column, pattern: str, new: str) -> Column:
    """source with the pattern's only match replaced; null if it matches never or more than once."""
    return F.when(F.regexp_count(source, F.lit(pattern)) == 1, F.regexp_replace(source, pattern, new))


def without_prefix(source: Column, prefix: str) -> Column:
    return F.when(F.startswith(source, F.lit(prefix)), F.substr(source, F.lit(len(prefix) + 1))).otherwise(source)


def between_marks(source: Column, start: str, end: str) -> Column:
    """Stripped text between the first start mark and the next end mark; null without them."""
    tail = F.when(F.contains(source, F.lit(start)), F.substr(source, F.locate(start, source) + len(start)))
    return strip(F.when(F.contains(tail, F.lit(end)), F.substring_index(tail, end, 1)))


def number(value: Column, digits: int) -> Column:
    """1234567.891 as '1 234 567,89'."""
    return F.translate(F.format_number(value, digits), ",.", " ,")


def percent(share: Column, digits: int = 1) -> Column:
    return F.concat(number(share * 100, digits), F.lit(" %"))


_FOLDED = {chr(c): chr(c).casefold() for c in range(0x110000) if chr(c).casefold() != chr(c).lower()}


def casefold(text: Column) -> Column:
    """Lower case with the other foldings of Unicode (ß to ss, final sigma to sigma); characters that become several are looked up only where one stands."""
    one = {a: b for a, b in _FOLDED.items() if len(b) == 1}
    many = {a: b for a, b in _FOLDED.items() if len(b) > 1}
    folded = lambda t: F.translate(F.lower(F.translate(t, "".join(one), "".join(one.values()))), "ς", "σ")  # lower case gives final sigmas
    table = F.create_map(*(F.lit(x) for pair in many.items() for x in pair))
    slow = folded(F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), ""))
    return F.when(text.rlike("[" + "".join(many) + "]"), slow).otherwise(folded(text))
