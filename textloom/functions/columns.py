"""Small helpers on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's str.strip() and regular expressions know it, as a Java character class.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
#: The characters of WS, one by one.
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's variable stands for it."""
    return F.transform(F.array(value), body)[0]


def strip(x: Column | str) -> Column:
    """Without white space at either end. Only the ends are looked at; a pattern would try each blank of the text."""
    return F.btrim(col(x), F.lit(BLANKS))


def text(x: Column | str) -> Column:
    """Null as an empty text."""
    return F.coalesce(col(x), F.lit(""))


def first_full(*xs: Column | str) -> Column:
    """The first that is neither null nor empty; null if none is."""
    return F.coalesce(*(F.nullif(col(x), F.lit("")) for x in xs))


def contains_any(x: Column, terms: list[str]) -> Column:
    """Whether x contains one of a fixed list of terms."""
    out = F.lit(False)
    for t in terms:
        out = out | x.contains(t)
    return out


def contains_all(x: Column, terms: list[str]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & x.contains(t)
    return out


def safe_int(x: Column | str, default: int = 0) -> Column:
    """A whole number or the default."""
    return F.coalesce(strip(col(x).cast("string")).try_cast("bigint"), F.lit(default).cast("bigint"))
