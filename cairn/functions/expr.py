"""Small expression helpers shared by the rule functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: ColumnLike) -> Column:
    """Null-safe string."""
    return F.coalesce(col(c), F.lit(""))


def low(c: ColumnLike) -> Column:
    return F.lower(text(c))


def has_any(c: ColumnLike, words: Iterable[str]) -> Column:
    """True if the string contains any of the literal words.

    Plain contains tests: several times cheaper than one regular expression of
    alternatives, above all inside array functions.
    """
    value, out = col(c), None
    for w in words:
        hit = value.contains(w)
        out = hit if out is None else out | hit
    return out if out is not None else F.lit(False)


def lits(words: Iterable[str]) -> Column:
    words = list(words)
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    """Value of a small fixed table, as a literal map inside the projection."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), default)


def first_case(cases: Iterable[tuple[Column, object]], default: object) -> Column:
    """Ordered CASE: the first true condition wins."""
    out: Column | None = None
    for cond, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return default if out is None else out.otherwise(default)


def packed(key: ColumnLike) -> Column:
    """A key as bytes, equal where the keys are: of lower-case hex (md5) half its length; null stays null.

    The first byte tells the two forms apart; `unpacked` gives the key back.  Written so that Spark sees that
    a key that is never null is packed to one, else it works the whole key out again for a null test.
    """
    key = col(key)
    short = F.unhex(key)
    halved = F.when(F.lower(F.hex(short)) == key, F.concat(F.lit(b"\x01"), short))
    return F.coalesce(halved, F.concat(F.lit(b"\x00"), key.cast("binary")))


def unpacked(key: ColumnLike) -> Column:
    key = col(key)
    body = F.substr(key, F.lit(2))
    return F.when(F.substr(key, F.lit(1), F.lit(1)) == F.lit(b"\x01"), F.lower(F.hex(body))).otherwise(body.cast("string"))


#: Longer texts are not sure to be read back by the JSON parser.
LONGEST_JSON = 1_000_000


def as_json(c: ColumnLike) -> tuple[Column, Column]:
    """(text, rest): an array of structs of strings, whole numbers and booleans for a move, about half its size in memory.

    What JSON might not give back is the rest, as it was: long texts, and strings that are not UTF-8, which
    JSON shows with the replacement character.  See `from_text`.
    """
    told = F.to_json(col(c))
    told = F.when((F.octet_length(told) <= LONGEST_JSON) & ~told.contains("\ufffd"), told)
    return told, F.when(told.isNull(), col(c))


def from_text(told: ColumnLike, rest: ColumnLike, kind: T.ArrayType) -> Column:
    return F.coalesce(F.from_json(col(told), kind), col(rest))


def compact(*items: Column) -> Column:
    """Array of the non-null items, in order."""
    return F.array_compact(F.array(*items))


def days_between(later: ColumnLike, earlier: ColumnLike) -> Column:
    """Whole 24-hour days, floored (a negative gap floors downwards)."""
    micros = F.unix_micros(col(later).cast("timestamp")) - F.unix_micros(col(earlier).cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("bigint")


def names(columns: ColumnLike) -> Column:
    """Lower-cased column names of an asset."""
    return F.coalesce(F.transform(col(columns), lambda c: F.lower(c["name"])), F.array().cast("array<string>"))
