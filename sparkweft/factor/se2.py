"""Planar poses as column expressions: a pose is (theta, x, y), a tangent vector (x, y, theta)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this angle the series of the closed forms are used.
SMALL = 1e-6


class Pose(NamedTuple):
    theta: Column
    x: Column
    y: Column

    @classmethod
    def of(cls, v: Column) -> Pose:
        """From an array [theta, x, y]."""
        return cls(F.get(v, F.lit(0)), F.get(v, F.lit(1)), F.get(v, F.lit(2)))

    @classmethod
    def field(cls, s: Column) -> Pose:
        return cls(s["theta"], s["x"], s["y"])

    def array(self) -> Column:
        return F.array(*self)


def wrap(theta: Column) -> Column:
    return F.atan2(F.sin(theta), F.cos(theta))


def compose(a: Pose, b: Pose) -> Pose:
    c, s = F.cos(a.theta), F.sin(a.theta)
    return Pose(wrap(a.theta + b.theta), a.x + c * b.x - s * b.y, a.y + s * b.x + c * b.y)


def between(a: Pose, b: Pose) -> Pose:
    """The pose of b as seen from a."""
    c, s, dx, dy = F.cos(a.theta), F.sin(a.theta), b.x - a.x, b.y - a.y
    return Pose(wrap(b.theta - a.theta), c * dx + s * dy, c * dy - s * dx)


def inverse(a: Pose) -> Pose:
    c, s = F.cos(a.theta), F.sin(a.theta)
    return Pose(wrap(-a.theta), -(c * a.x + s * a.y), s * a.x - c * a.y)


def half_cot(theta: Column) -> Column:
    """theta/2 * cot(theta/2)."""
    return F.when(F.abs(theta) < SMALL, 1 - theta * theta / 12).otherwise(theta / 2 * F.cos(theta / 2) / F.sin(theta / 2))


def half_cot_slope(theta: Column) -> Column:
    s = F.sin(theta / 2)
    return F.when(F.abs(theta) < SMALL, -theta / 6).otherwise(F.cos(theta / 2) / s / 2 - theta / (4 * s * s))


def log(p: Pose) -> tuple[Column, Column, Column]:
    a, h = half_cot(p.theta), p.theta / 2
    return a * p.x + h * p.y, a * p.y - h * p.x, p.theta


def exp(u: Column, v: Column, theta: Column) -> Pose:
    small = F.abs(theta) < SMALL
    s = F.when(small, 1 - theta * theta / 6).otherwise(F.sin(theta) / theta)
    c = F.when(small, theta / 2).otherwise((1 - F.cos(theta)) / theta)
    return Pose(wrap(theta), s * u - c * v, c * u + s * v)
