"""Column expressions. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from flowsift.schema import EMPTY_LABELS, MISSING_TOKENS, STRATEGIES

INFINITY = float("inf")
WHITESPACE = " \t\n\r\x0b\x0c"
# Letters of the notations a cast takes for numbers but the data set does not: '1d', '1f', '0x1p3'.
NOT_DECIMAL = "dDfFpP"


def strip(text: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def parse_number(text: Column) -> Column:
    """Text to double; NULL, NaN or infinite unless it is a decimal number that fits.

    Byte searches rule out the other notations, which costs less than matching a pattern per cell.
    Adding zero turns -0.0 into 0.0, so both print, hash and group alike.
    """
    foreign = any_of(F.contains(text, F.lit(letter)) for letter in NOT_DECIMAL)
    return F.when(~foreign, text.try_cast("double")) + F.lit(0.0)


def numbers(columns: Iterable[Column], convert: Callable[[Column], Column] | None = None) -> Column:
    """The columns as one array, each converted, by default parsed to a finite number or NULL.

    Dozens of conversions spelled out column by column make a generated method too long for the JIT
    compiler. One function over an array stays short. At 61 columns the parsing step alone took about 5
    instead of 20 seconds in a default session; with ``build_session``'s method limit both took about 8.
    """
    return F.transform(F.array(*columns), convert or to_number)


def finite(value: Column) -> Column:
    """NULL out infinities and NaN."""
    return F.when(is_finite(value), value)


def is_finite(value: Column) -> Column:
    """True for ordinary numbers; false or NULL otherwise (NaN sorts above infinity in Spark)."""
    return F.abs(value) < F.lit(INFINITY)


def to_number(text: Column) -> Column:
    return finite(parse_number(text))


def missing_to_null(text: Column) -> Column:
    return F.when(~text.isin(MISSING_TOKENS), text)


def is_stray_header(protocol: Column) -> Column:
    return F.coalesce(strip(protocol) == F.lit("Protocol"), F.lit(False))


def is_empty_label(label: Column) -> Column:
    return F.coalesce(strip(label).isin(EMPTY_LABELS), F.lit(True))


def clip_lower(value: Column, bound: float = 0.0) -> Column:
    """Raise values below ``bound``; NULL stays NULL, which ``greatest`` would not keep."""
    return F.when(value < F.lit(bound), F.lit(bound)).otherwise(value)


def epoch_seconds(text: Column) -> Column:
    """``dd/MM/yyyy HH:mm:ss`` (leading zeros optional) to epoch seconds, NULL if unparsable.

    The offset travels in the text, so the session time zone has no influence.
    """
    stamped = F.concat(text, F.lit(" +00:00"))
    return F.unix_timestamp(F.try_to_timestamp(stamped, F.lit("d/M/yyyy H:m:s XXX")))


def content_digest(columns: Iterable[str], seed: int) -> Column:
    """md5 over the named columns and a seed: a reproducible pseudo-random order for rows.

    A lone key column is hashed as ``value|seed``. NULLs are spelled out, since ``concat_ws``
    would skip them and let different rows share a text.
    """
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in columns]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def row_fingerprint(columns: Iterable[str]) -> Column:
    """128 bits over the named columns as text: a reproducible id for rows that differ in them."""
    cells = [F.col(f"`{c}`") for c in columns]
    halves = [F.hex(F.xxhash64(F.lit(i), *cells)) for i in (1, 2)]
    return F.concat_ws("-", *halves)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def safe_ratio(numerator: Column, denominator: Column, empty: float = 0.0) -> Column:
    """``numerator / denominator`` as double, ``empty`` where the denominator is zero."""
    return F.when(denominator == 0, F.lit(empty)).otherwise(
        numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))
    )


def strategy_in(path: Column) -> Column:
    """The split strategy that a path names, null if it names none."""
    return F.nullif(F.regexp_extract(path, "|".join(STRATEGIES), 0), F.lit(""))
