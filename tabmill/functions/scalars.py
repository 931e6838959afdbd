"""Scalar column helpers: tokens, name parts, display names, dates, k, formats.

All are compositions of built-in ``pyspark.sql.functions`` so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def tokens(value) -> Column:
    """Split a line on runs of blanks, empties removed."""
    return F.filter(F.split(F.trim(_c(value)), r"\s+"), lambda t: t != F.lit(""))


def part(value, sep: str, index: int) -> Column:
    """1-based part of a delimited name; negative counts from the end."""
    return F.split_part(_c(value), F.lit(sep), F.lit(index))


def display_name(value, replace: dict[str, str] | None = None,
                 drop_suffix: str | None = None) -> Column:
    """S3: spelled-out name: prefix replaced, suffix removed, '_' -> ' ',
    title case, trimmed."""
    c = _c(value)
    for old, new in (replace or {}).items():
        c = F.when(F.split_part(c, F.lit("_"), F.lit(1)) == old,
                   F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 20))).otherwise(c)
    if drop_suffix:
        c = F.replace(c, F.lit(drop_suffix), F.lit(""))
    c = F.replace(c, F.lit("_"), F.lit(" "))
    # title case that also capitalises after '-' (initcap only splits on blanks)
    c = F.array_join(F.transform(F.split(c, "-"), lambda w: F.initcap(w)), "-")
    return F.trim(c)


def full_year(yy) -> Column:
    """Two-digit year with the usual pivot (69..99 -> 19xx, 00..68 -> 20xx)."""
    y = _c(yy)
    return F.when(y < 69, y + 2000).otherwise(y + 1900)


def ymd(yy, mm, dd) -> Column:
    """Date from a two-digit year, month and day (invalid -> NULL)."""
    return F.try_make_timestamp(full_year(yy), _c(mm), _c(dd), F.lit(0), F.lit(0), F.lit(0)).cast("date")


def iso_date(d) -> Column:
    return F.date_format(_c(d), "yyyy-MM-dd")


def days_between(later, earlier) -> Column:
    """Whole days from ``earlier`` to ``later``."""
    return F.datediff(_c(later), _c(earlier))


def k_of_n(n, force_odd: bool = False) -> Column:
    """k = round-half-even(sqrt(n)); with ``force_odd`` an even k
    becomes k - 1."""
    k = F.bround(F.sqrt(_c(n).cast("double")), 0).cast("int")
    if force_odd:
        k = F.when(k % 2 == 0, k - 1).otherwise(k)
    return F.greatest(k, F.lit(1))


def grid(start_i: int, stop_i: int, scale: float) -> Column:
    """Numeric range as an integer ``sequence`` scaled afterwards, so a
    float step never accumulates error."""
    return F.transform(F.sequence(F.lit(start_i), F.lit(stop_i)),
                       lambda i: F.round(i * F.lit(scale), 9))


def pct(value, digits: int = 1) -> Column:
    """S10: '{:.1%}' style text."""
    return F.concat(F.format_number(_c(value) * 100.0, digits), F.lit("%"))


def sig3(value) -> Column:
    """S10: '{:.3}' style: three significant digits (fixed notation)."""
    v = _c(value).cast("double")
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v))).cast("double") - 2)
    return F.when(v == 0, F.lit(0.0)).otherwise(F.round(F.round(v / unit) * unit, 12))
