"""Check digits: Luhn and Verhoeff, for Python values and as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn_valid(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return bool(digits) and total % 10 == 0


def luhn_digit(digits: str) -> str:
    """The digit that makes ``digits`` + it valid."""
    return next(str(d) for d in range(10) if luhn_valid(digits + str(d)))


def dihedral(a: int, b: int) -> int:
    """Product in the symmetry group of the pentagon: 0-4 rotations, 5-9 reflections."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
    return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5


def _permutations() -> list[list[int]]:
    #: The permutation of the Verhoeff scheme.
    base = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    out = [list(range(10))]
    for _ in range(7):
        out.append([base[x] for x in out[-1]])
    return out


PERMUTED = _permutations()
PRODUCT = [[dihedral(a, b) for b in range(10)] for a in range(10)]


def verhoeff_state(digits: str, shift: int = 0) -> int:
    c = 0
    for i, x in enumerate(reversed(digits)):
        c = PRODUCT[c][PERMUTED[(i + shift) % 8][int(x)]]
    return c


def verhoeff_valid(digits: str) -> bool:
    return bool(digits) and verhoeff_state(digits) == 0


def verhoeff_digit(digits: str) -> str:
    """The digit that makes ``digits`` + it valid."""
    return str(PRODUCT[verhoeff_state(digits, 1)].index(0))


def luhn_valid_column(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def verhoeff_valid_column(digits: Column) -> Column:
    """Native: a fold over the reversed digits with the two tables as literals."""
    product = F.array(*(F.lit(x) for row in PRODUCT for x in row))
    permuted = F.array(*(F.lit(x) for row in PERMUTED for x in row))
    reversed_digits = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), lambda x, i: F.struct(x.cast("int").alias("d"), i.alias("i")))
    state = F.aggregate(reversed_digits, F.lit(0), lambda c, x: F.element_at(product, c * 10 + F.element_at(permuted, x["i"] % 8 * 10 + x["d"] + 1) + 1))
    return (F.length(digits) > 0) & (state == 0)
