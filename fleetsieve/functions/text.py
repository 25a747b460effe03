"""String expressions shared by the rules."""
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a number in text.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def contains_any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def to_number(c: Column) -> Column:
    """Text to number, NULL when it is not one; the pattern guards against '5d'."""
    return F.when(c.rlike(NUMBER_PATTERN), strip(c).try_cast("double"))


def fails_number(c: Column) -> Column:
    return c.isNotNull() & ~c.rlike(NUMBER_PATTERN)


def log1p(c: Column) -> Column:
    return F.log1p(c)


def clip_log1p(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def short_title(c: Column, width: int = 80) -> Column:
    return F.substring(c, 1, width)


def file_safe(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}\-_.]", "_")


def key_value(line: Column):
    """``key: value`` split at the first colon; key lowered, both stripped."""
    parts = F.split(line, ":", 2)
    has = line.contains(":")
    return (F.when(has, F.lower(strip(parts[0]))), F.when(has, strip(parts[1])))


def char_fingerprint(text: Column, bits: int, n: int = 3) -> Column:
    """Sorted set of the bit positions hit by the text's character n-grams."""
    # one left-to-right scan: substring by position would walk the text again for every gram
    grams = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))
    position = lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 8), 16, 10).cast("bigint") % bits
    return F.array_sort(F.array_distinct(F.transform(
        F.coalesce(grams, F.array().cast("array<string>")), position)))


def bit_vector(hits: Column, bits: int) -> Column:
    """Dense 0/1 array of width ``bits`` from sorted hit positions."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    runs = F.transform(hits, lambda h, i: F.concat(
        zeros(h - F.coalesce(F.get(hits, i - 1), F.lit(-1)) - 1), F.array(F.lit(1.0))))
    last = F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit(-1))
    return F.concat(F.flatten(runs), zeros(F.lit(bits - 1) - last))
