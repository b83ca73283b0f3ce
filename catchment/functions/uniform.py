"""Reproducible random numbers as column expressions.

A draw is a function of (seed, identifiers) only, so it does not depend on
partitioning, and a lost task recomputes the same values. One MD5 digest holds
four 32-bit lanes, i.e. four independent uniforms for the price of one hash, and
gives the same numbers in any SQL engine. The ``fast`` stream replaces it by
xxHash64 where a run makes billions of draws and no other engine has to agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LANE_SIZE = float(2 ** 32)


def digest(seed: int | str, *parts: Column, fast: bool = False) -> Column:
    """Key of one draw: MD5 of ``seed|part|part…``, or its xxHash64."""
    if fast:
        return F.xxhash64(F.lit(str(seed)), *parts)
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def lane(key: Column, index: int = 0, fast: bool = False) -> Column:
    """Uniform number in [0, 1) from lane 0–3 of a key."""
    if fast:
        return F.shiftrightunsigned(F.xxhash64(key, F.lit(index)), 11).cast("double") * 2.0 ** -53
    return F.conv(F.substring(key, 1 + 8 * index, 8), 16, 10).cast("double") / F.lit(LANE_SIZE)


def uniform(seed: int | str, *parts: Column, index: int = 0) -> Column:
    return lane(digest(seed, *parts), index)


def pick(u: Column, n: Column | int) -> Column:
    """Zero-based position ``floor(u · n)``."""
    size = n if isinstance(n, Column) else F.lit(n)
    return F.floor(u * size.cast("double")).cast("long")


def standard_normal(u0: Column, u1: Column) -> Column:
    """Box–Muller transform of two uniforms."""
    return F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u0)) * F.cos(F.lit(2.0 * math.pi) * u1)
