"""Whole-number helpers and reduced fractions."""

from __future__ import annotations

import math
from fractions import Fraction

LONG_MAX = (1 << 63) - 1


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def floor_div(a: int, b: int) -> int:
    return a // b


def saturating_add(a: int, b: int, most: int = LONG_MAX) -> int:
    return min(a + b, most)


factorial, gcd, lcm = math.factorial, math.gcd, math.lcm


def rational(numerator: int, denominator: int = 1) -> Fraction:
    """A reduced fraction, the sign on its numerator; a zero denominator raises."""
    return Fraction(numerator, denominator)


def truncated(x: Fraction) -> int:
    return int(x)
