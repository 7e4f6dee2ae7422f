"""Numbers beyond the range of doubles, for accounts whose holdings multiply without end.

The functions give what doubles give wherever that is finite, and a :class:`Wide` (a double and a power of two)
elsewhere; quantities are Python's unbounded integers.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterable
from functools import reduce, total_ordering

LOW, HIGH = -1021, 1023


def parts(x) -> tuple[float, int]:
    """(m, e) with ``x`` = m * 2**e and m from 0.5 to 1, or 0."""
    if isinstance(x, Wide):
        return x.m, x.e
    if isinstance(x, int) and (spare := x.bit_length() - 64) > 0:
        m, e = math.frexp(float(abs(x) >> spare))
        return (-m if x < 0 else m), e + spare
    return math.frexp(x)


def make(m: float, e: int):
    """m * 2**e, as a double if it is one."""
    m, more = math.frexp(m)
    e += more
    return math.ldexp(m, e) if not m or LOW <= e <= HIGH else Wide(m, e)


@total_ordering
class Wide:
    """m * 2**e, of a size that no double has."""

    __slots__ = ("m", "e")

    def __init__(self, m: float, e: int):
        self.m, self.e = m, e

    def __add__(self, other):
        (a, p), (b, q) = parts(self), parts(other)
        top = max(p if a else q, q if b else p)
        return make(math.ldexp(a, p - top) + math.ldexp(b, q - top), top)

    def __mul__(self, other):
        (a, p), (b, q) = parts(self), parts(other)
        return make(a * b, p + q)

    def __truediv__(self, other):
        (a, p), (b, q) = parts(self), parts(other)
        return make(a / b, p - q)

    def __rtruediv__(self, other):
        (a, p), (b, q) = parts(self), parts(other)
        return make(b / a, q - p)

    def __neg__(self):
        return Wide(-self.m, self.e)

    def __sub__(self, other):
        return self + -other

    def __rsub__(self, other):
        return -self + other

    __radd__, __rmul__ = __add__, __mul__

    def __eq__(self, other):
        return parts(self) == parts(other)

    def __lt__(self, other):
        return parts(self - other)[0] < 0

    __hash__ = None

    def __float__(self):
        return math.copysign(math.inf if self.e > 0 else 0.0, self.m)

    def __floor__(self) -> int:
        if self.e <= 0:
            return -(self.m < 0)
        return int(math.ldexp(self.m, 53)) << (self.e - 53)

    def __repr__(self):
        return f"{self.m} * 2**{self.e}"


def _or_wide(op, x, a, b):
    """``x``, or what wide numbers give where it is none or infinite."""
    if x is None:  # an integer that no double holds
        return op(make(*parts(a)), make(*parts(b)))
    return op(Wide(*parts(a)), b) if math.isfinite(float(a)) and math.isfinite(float(b)) else x


def times(a, b):
    try:
        x = a * b
    except OverflowError:
        x = None
    return x if x is not None and (x.__class__ is not float or math.isfinite(x)) else _or_wide(operator.mul, x, a, b)


def plus(a, b):
    try:
        x = a + b
    except OverflowError:
        x = None
    return x if x is not None and (x.__class__ is not float or math.isfinite(x)) else _or_wide(operator.add, x, a, b)


def over(a, b):
    try:
        x = a / b
    except OverflowError:
        x = None
    if a and x.__class__ is float and abs(x) < 2.0**LOW:
        return Wide(*parts(a)) / b
    return x if x is not None and (x.__class__ is not float or math.isfinite(x)) else _or_wide(operator.truediv, x, a, b)


def total(xs: Iterable):
    xs = list(xs)
    if not any(isinstance(x, Wide) for x in xs) and math.isfinite(x := sum(xs)):
        return x
    return reduce(plus, xs)


def number(x):
    """``x`` as a double, or as a Wide."""
    return x if isinstance(x, Wide) else make(*parts(x)) if isinstance(x, int) and x.bit_length() > HIGH else float(x)


def share(n: int, x: float) -> int:
    """``n * x`` to the nearest integer."""
    y = times(n, x)
    return math.floor(y) if isinstance(y, Wide) else int(round(y))


def ratio(n: int, a: int, b: int) -> int:
    """``n * a / b`` to the nearest integer."""
    try:
        return int(round(n * a / b))
    except OverflowError:
        return (2 * n * a + b) // (2 * b)
