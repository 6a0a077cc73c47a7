"""Loose number and text semantics of open map tags, as column functions.

Tags are strings that may hold '5.5 m', '' or nonsense; NaN, 0 and '' count as absent where a fallback follows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number at the start of a text.
NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_float(text: Column | str) -> Column:
    """The number that a text starts with, else null."""
    return F.regexp_extract(_col(text), NUMBER, 1).try_cast("double")


def number_or(x: Column, other: Column) -> Column:
    """x, or the other where x is null, NaN or 0."""
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")) & (x != 0), x).otherwise(other)


def text_or_null(x: Column | str) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(_col(x), F.lit(""))


def positive(text: Column | str) -> Column:
    """The number that a text starts with if it is above 0, else null."""
    n = parse_float(text)
    return F.when(n > 0, n)


def round_half_up(x: Column) -> Column:
    """Rounds halves toward positive infinity (-2.5 to -2)."""
    return F.floor(x + 0.5)


def round_to(x: Column, digits: int) -> Column:
    return round_half_up(x * 10.0**digits) / 10.0**digits


def french_date(x: Column) -> Column:
    """A date as day/month/year; null for what isn't one."""
    return F.date_format(x, "dd/MM/yyyy")


def iso_day(text: Column) -> Column:
    """The day of a time in ISO form: its first ten characters."""
    return F.substring(text, 1, 10)


def wrap32(x: Column) -> Column:
    """A long, wrapped to a signed 32-bit value."""
    return F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


def text_hash(text: Column | str) -> Column:
    """The 32-bit polynomial hash (times 31, plus the character's code) of a text. A character beyond the basic plane
    counts by the first of its two UTF-16 units."""
    chars = F.filter(F.split(_col(text), ""), lambda c: c != "")
    code = lambda c: F.when(F.ascii(c) < 0x10000, F.ascii(c)).otherwise(F.lit(0xD800) + F.shiftright(F.ascii(c) - 0x10000, 10)).cast("long")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda n, c: wrap32(n * 31 + code(c)))


def unsigned(x: Column) -> Column:
    return F.pmod(x, F.lit(1 << 32))


def imul(a: Column, b: Column) -> Column:
    """The low 32 bits of a product, signed. Splits b so that no product leaves 64 bits."""
    ua, ub = unsigned(a), unsigned(b)
    low = ua * F.pmod(ub, F.lit(1 << 16))
    high = F.pmod(ua * F.shiftright(ub, 16), F.lit(1 << 16)) * F.lit(1 << 16)
    return wrap32(F.pmod(low, F.lit(1 << 32)) + high)


def seeded_random(n: Column, seed: int = 10220) -> Column:
    """Value number n (from 1) in [0, 1) of the counter-based 32-bit generator, a pure function of n."""
    s = wrap32(F.lit(seed) + imul(n.cast("long"), F.lit(0x6D2B79F5)))
    shift = lambda x, k: F.shiftright(unsigned(x), k)
    t = imul(s.bitwiseXOR(shift(s, 15)), s.bitwiseOR(F.lit(1)))
    t = wrap32(t + imul(t.bitwiseXOR(shift(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseXOR(t)
    return unsigned(t.bitwiseXOR(shift(t, 14))) / F.lit(float(1 << 32))


def lookup(key: Column | str, table: dict) -> Column:
    """A fixed table as a map literal; null for other keys."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _col(key))
