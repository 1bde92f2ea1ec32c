"""String functions as Column expressions, with the semantics of Python's own string methods where flows rely on them."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java regex flags that make a pattern behave as in Python: `.` stops at \n only, classes are Unicode.
UNICODE, DOTALL = "(?dU)", "(?sdU)"
#: What Python's str.strip() removes.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
SPACE = r"[\s\x1c-\x1f]"
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
SPECIAL = r"^[+-]?(inf|infinity|nan)$"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(text: str) -> str:
    """A literal inside a Java pattern."""
    return re.sub(r"([\\.\[\]{}()*+?^$|\-&~#])", r"\\\1", text)


def strip(c: Column | str) -> Column:
    # No pattern: one would be tried at each blank inside the text.
    return F.btrim(column(c), F.lit(SPACES))


def lstrip(c: Column | str) -> Column:
    return F.ltrim(column(c), F.lit(SPACES))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """A function of a value that is worked out once a row, however often the function names it."""
    return F.transform(F.array(value), then)[0]


def to_float(c: Column | str) -> Column:
    """float() of a string; null where that would fail, and for null."""
    return once(strip(column(c).cast("string")), lambda t: F.when(t.rlike(NUMBER) | F.lower(t).rlike(SPECIAL), t.try_cast("double")))


def to_int(c: Column | str) -> Column:
    """int() of a string; null where that would fail, and for null."""
    return once(strip(column(c).cast("string")), lambda t: F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint")))


def after_marker(c: Column | str, marker: str = "</think>") -> Column:
    """What follows the last marker, stripped on the left; the text itself without one."""
    c = column(c)
    return F.when(c.contains(marker), lstrip(F.substring_index(c, marker, -1))).otherwise(c)


def between(c: Column | str, start: str, end: str) -> Column:
    """The stripped text between the first start marker and the next end marker; null if either is missing."""
    c = column(c)
    rest = F.substr(c, F.locate(start, c) + len(start))
    return F.when(c.contains(start) & (F.locate(end, rest) > 0), strip(F.substring_index(rest, end, 1)))


def question_of(output: Column | str) -> Column:
    """The text up to and with the first question mark; empty without one."""
    c = column(output)
    return F.when(F.locate("?", c) > 0, F.concat(strip(F.substring_index(c, "?", 1)), F.lit("?"))).otherwise(F.lit(""))


def response_of(output: Column | str) -> Column:
    """The text after the first question mark; all of it without one."""
    c = column(output)
    return strip(F.when(F.locate("?", c) > 0, F.substr(c, F.locate("?", c) + 1)).otherwise(c))


def without(c: Column | str, tags: Sequence[str] | None) -> Column:
    c = column(c)
    for tag in tags or ():
        c = F.replace(c, F.lit(tag), F.lit(""))
    return c


def tagged(c: Column | str, start: str, end: str) -> Column:
    """Array of the stripped texts between tags; with both tags empty the whole text, stripped, null if empty."""
    c = column(c)
    if not start and not end:
        return F.array(F.nullif(strip(c), F.lit("")))
    found = F.regexp_extract_all(c, F.lit(f"{DOTALL}{quoted(start)}(.*?){quoted(end)}"), F.lit(1))
    return F.transform(found, strip)


def matched(c: Column | str, pattern: str, group: int) -> Column:
    """Array of one group's texts over all matches of a pattern (dot matches all), stripped."""
    return F.transform(F.regexp_extract_all(column(c), F.lit(DOTALL + pattern), F.lit(group)), strip)


def options(c: Column | str) -> Column:
    """Array of the texts of `X) text` options, X a capital letter at a word's start."""
    return F.regexp_extract_all(column(c), F.lit(r"(?d)(?<![\p{L}\p{N}_])[A-Z]\) (.+)"), F.lit(1))


def answer_letter(c: Column | str) -> Column:
    return F.substring_index(column(c), ")", 1)


def stem(c: Column | str) -> Column:
    """The question before its options."""
    return strip(F.substring_index(column(c), "A)", 1))


def compact_table(c: Column | str) -> Column:
    """Runs of two dashes or more before a pipe become one, and so do blanks."""
    return F.regexp_replace(F.regexp_replace(column(c), r"-{2,}\|", "-|"), r" {2,}\|", " |")


def heading(c: Column | str) -> Column:
    """A short first part before a dot in bold; the dot after it goes."""
    c = column(c)
    parts = F.split(c, r"\.")
    first = F.element_at(parts, 1)
    short = (F.size(parts) > 1) & (F.size(F.split(first, " ")) < 3)
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), ".")
    return F.when(short, F.concat(F.lit("**"), first, F.lit("**"), rest)).otherwise(c)


def word_count(c: Column | str) -> Column:
    c = strip(column(c))
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, f"(?U){SPACE}+")))


def tokens_from_words(words: Column | int):
    return int(words * 1.3) if isinstance(words, int) else F.floor(words * F.lit(13) / F.lit(10)).cast("int")


def chars_from_tokens(tokens: Column | int):
    return int(tokens * 4.0) if isinstance(tokens, int) else (tokens * 4).cast("int")


def token_count(c: Column | str, count: Callable[[str], int] | None = None) -> Column:
    """Tokens of a text by the words-times-1.3 rule, or by a function of a text, such as a tokenizer's length."""
    if count is None:
        return tokens_from_words(word_count(c))
    counted = F.pandas_udf(lambda texts: texts.map(count, na_action="ignore").astype("Int64"), "long")
    return counted(column(c))


def hash_number(*keys: Column | str, modulus: int | Column) -> Column:
    """A number below modulus from the md5 of the keys, joined by |; any engine with md5 gives the same."""
    text = F.concat_ws("|", *[column(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % modulus


def row_id(*keys: Column | str) -> Column:
    """A UUID-shaped id from keys, the same in each run."""
    h = F.md5(F.concat_ws("|", *[column(k).cast("string") for k in keys]).cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def as_json(**fields: Column | str) -> Column:
    """A JSON object that keeps null fields."""
    return F.to_json(F.struct(*[column(v).alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})
