"""Distances for guided search, and packed keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def manhattan_distance(a: Column, b: Column, width: int) -> Column:
    """Between cells of a grid that are numbered row by row."""
    row = lambda v: F.floor(v / width)
    return (F.abs(row(a) - row(b)) + F.abs(a % width - b % width)).cast("double")


def euclidean_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


INDEX_BITS = (1 << 56) - 1


def symbol(letter: str | Column, index: Column | int) -> Column:
    """A letter in the top byte over a 56-bit index."""
    code = F.ascii(F.lit(letter) if isinstance(letter, str) else letter)
    return F.shiftleft(code.cast("long"), 56).bitwiseOR((index if isinstance(index, Column) else F.lit(index)).cast("long").bitwiseAND(F.lit(INDEX_BITS)))


def symbol_chr(key: Column) -> Column:
    return F.chr(F.shiftrightunsigned(key, 56))


def symbol_index(key: Column) -> Column:
    return key.bitwiseAND(F.lit(INDEX_BITS))


def X(index) -> Column:
    return symbol("x", index)


def L(index) -> Column:
    return symbol("l", index)


def P(index) -> Column:
    return symbol("p", index)
