"""Salted SHA-256 helpers. All order and random choice in the library comes from here."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def salted_sha(salt: str, *parts: Column | str) -> Column:
    """SHA-256 hex of ``salt|part|part...``."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws("|", F.lit(salt), *[c.cast("string") for c in cols]), 256)


def hash_int(hex_col: Column, digits: int = 12) -> Column:
    """Leading ``digits`` hex digits as a long (at most 15)."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("long")


def hash_unit(hex_col: Column, digits: int = 12) -> Column:
    """Leading digits as a double in [0, 1)."""
    return hash_int(hex_col, digits) / F.lit(float(16**digits))


def hash_below(hex_col: Column, n: Column) -> Column:
    """Draw in ``0 .. n-1`` from the leading digits."""
    return F.pmod(hash_int(hex_col), n)


def poisson_weight(unit: Column, most: int = 17) -> Column:
    """Poisson(1) multiplicity from a uniform draw, by inverting the distribution function.

    Multiplicities above 17 lie beyond the resolution of a draw of 48 bits.
    """
    term = math.exp(-1.0)
    cumulative = term
    weight = F.lit(0)
    for k in range(1, most + 1):
        weight = F.when(unit >= F.lit(cumulative), F.lit(k)).otherwise(weight)
        term /= k
        cumulative += term
    return weight
