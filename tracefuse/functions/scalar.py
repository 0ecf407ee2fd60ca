"""Column-level helpers.  All are built-in expressions (codegen, no Python UDF)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x) -> Column:
    """Spark orders NaN above every number (``NaN >= 0.6`` is true); a missing
    probability must instead fail every threshold, so NaN becomes NULL."""
    return F.nanvl(_c(x), F.lit(None).cast("double"))


def above(x, threshold: float) -> Column:
    """Strict threshold test ``p > t``; NaN and NULL are False."""
    return F.coalesce(nan_to_null(x) > F.lit(float(threshold)), F.lit(False))


def at_least(x, threshold: float) -> Column:
    """Inclusive threshold test; NaN and NULL are False."""
    return F.coalesce(nan_to_null(x) >= F.lit(float(threshold)), F.lit(False))


def predict(x, threshold: float = 0.5, strict: bool = False) -> Column:
    """Score to class: ``int(p >= t)``, or ``int(p > t)`` when ``strict``."""
    return (above if strict else at_least)(x, threshold).cast("int")


def safe_div(num, den) -> Column:
    """Guarded division: 0.0 when the denominator is not positive."""
    num, den = _c(num), _c(den)
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def clip01(x) -> Column:
    """Clip to [0, 1] (P22).  NULL and NaN stay missing (``greatest``/``least``
    skip NULLs, which would turn a missing score into 1.0)."""
    v = nan_to_null(_c(x))
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


#: hexadecimal digits of an MD5 that make one uniform number (52 bits)
HASH_DIGITS = 13


def hash_uniform(key: Column, part: int = 0) -> Column:
    """Number in (0, 1) from the MD5 of a text column; ``part`` 0 and 1 are independent."""
    digits = F.substring(F.md5(key.cast("binary")), 1 + part * HASH_DIGITS, HASH_DIGITS)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(16 ** HASH_DIGITS))


def hash_normal(key: Column) -> Column:
    """Standard normal number that depends on a text column alone (Box-Muller over its MD5).

    The same key gives the same number under any partitioning, retry or engine.
    """
    return F.sqrt(F.lit(-2.0) * F.log(hash_uniform(key, 0))) * F.cos(F.lit(2.0 * math.pi) * hash_uniform(key, 1))


def to_int_or_zero(x) -> Column:
    """Lossy coercion: unparseable -> NULL -> 0 (P5); never raises under ANSI."""
    return F.coalesce(F.expr(f"try_cast({x} as bigint)") if isinstance(x, str)
                      else x.try_cast("bigint"), F.lit(0))


def label_from_name(name, mode: str = "syscall") -> Column:
    """Label inferred from a capture/log file name.

    ``syscall``: case-insensitive ``mal_`` or ``malicious``;
    ``network``: case-sensitive ``mal_`` only.
    """
    name = _c(name)
    if mode == "syscall":
        low = F.lower(name)
        hit = low.contains("mal_") | low.contains("malicious")
    elif mode == "network":
        hit = name.contains("mal_")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.coalesce(hit, F.lit(False)).cast("int")


def base_name(name, suffixes=(".log",)) -> Column:
    """Literal (not regex) removal of each suffix string anywhere in the name,
    applied in order (P16).  Network captures use ``("_network.pcap", ".pcap")``."""
    out = _c(name)
    for s in suffixes:
        out = F.replace(out, F.lit(s), F.lit(""))
    return out


def epoch_seconds(ts, ntz: bool = True) -> Column:
    """Whole seconds since 1970.

    ``timestamp_ntz`` values are wall-clock readings: days and time of day
    are taken from the value itself, so the result does not depend on the
    session time zone (a cast to ``timestamp`` would, across DST changes).
    ``ntz=False`` is for zone-aware ``timestamp`` columns (absolute instants).
    """
    c = _c(ts)
    if not ntz:
        return F.unix_seconds(c)
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
