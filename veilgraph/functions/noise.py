"""Noise from integer arithmetic that every SQL engine evaluates alike.

A draw depends on a key and a stream only, not on partitions or plans, so DP operators can be repeated and compared.
It is no cryptographic source; a release passes its own uniform column instead.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2147483647


def _state(key: Column, stream: Column | int) -> Column:
    p = F.lit(P).cast("long")
    s = (stream if isinstance(stream, Column) else F.lit(stream)).cast("long")
    x1 = ((key.cast("long") % p) * 48271 + s * 69621 + 12345) % p
    x2 = (x1 * x1 + 1013904223) % p
    x3 = (x2 * 16807 + 40503) % p
    return (x3 * x3 + 362437) % p


def draw(key: Column, stream: Column | int) -> Column:
    """An integer in [0, P)."""
    return _state(key, stream)


def drawn(key: np.ndarray, stream: int) -> np.ndarray:
    """draw() of an array of keys."""
    x1 = np.fmod(np.fmod(key, P) * 48271 + (stream * 69621 + 12345), P)
    x3 = np.fmod(np.fmod(x1 * x1 + 1013904223, P) * 16807 + 40503, P)
    return np.fmod(x3 * x3 + 362437, P)


def uniform(key: Column, stream: Column | int) -> Column:
    return (_state(key, stream) + 0.5) / F.lit(float(P))


def laplace(u: Column, scale: Column | float) -> Column:
    """Inverse distribution function at u."""
    b = scale if isinstance(scale, Column) else F.lit(float(scale))
    return -b * F.signum(u - 0.5) * F.ln(1 - 2 * F.abs(u - 0.5))


def laplace_clamped(value: Column, u: Column, scale: Column | float) -> Column:
    return F.greatest(value + laplace(u, scale), F.lit(0.0))


def gumbel(u: Column) -> Column:
    return -F.ln(-F.ln(u))


def bernoulli(u: Column, p: Column | float) -> Column:
    return u < (p if isinstance(p, Column) else F.lit(float(p)))


def sql_draw(key: str, stream: int | str) -> str:
    """The same integer as a SQL expression."""
    x1 = f"(((({key}) % {P}) * 48271 + ({stream}) * 69621 + 12345) % {P})"
    x2 = f"(({x1} * {x1} + 1013904223) % {P})"
    x3 = f"(({x2} * 16807 + 40503) % {P})"
    return f"(({x3} * {x3} + 362437) % {P})"


def sql_uniform(key: str, stream: int | str) -> str:
    return f"(({sql_draw(key, stream)} + 0.5) / {P}.0::double)"


def sql_laplace(key: str, stream: int | str, scale: str) -> str:
    u = sql_uniform(key, stream)
    return f"(-({scale}) * sign({u} - 0.5) * ln(1 - 2 * abs({u} - 0.5)))"
