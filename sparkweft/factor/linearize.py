"""Errors and Jacobians of factors, as column expressions over factors joined to their values.

Residuals are signed and divided by sigma. A variable moves by ``exp(d) * T`` if it is a pose and by
addition otherwise; Jacobians are with respect to that d.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import losses, se2
from .se2 import Pose


@dataclass(frozen=True)
class Kind:
    """``residual(a, b, meas)`` of the values' arrays a and b (null with one key) as a list of columns.

    ``jacobians`` gives a matrix (rows of columns) for each key; without it differences are taken.
    ``robust`` tells whether a factor's loss counts.
    """

    keys: int
    variable: str
    residual: Callable[[Column, Column, Column], list[Column]]
    jacobians: Callable[[Column, Column, Column], list[list[list[Column]]]] | None = None
    robust: bool = True

    @property
    def width(self) -> int:
        return 1 if self.variable == "scalar" else 3


def _log_slope(e: Pose) -> tuple[list[Column], list[Column]]:
    """Two rows of how log(E) moves when E is moved from the left."""
    a, h, da = se2.half_cot(e.theta), e.theta / 2, se2.half_cot_slope(e.theta)
    # The turn moves the translation to (-y, x) and changes the matrix of the logarithm.
    return [a, h, -a * e.y + h * e.x + da * e.x + e.y / 2], [-h, a, h * e.y + a * e.x - e.x / 2 + da * e.y]


def _pose_jacobian(e: Pose, g: Pose) -> list[list[Column]]:
    """The slope of log(G exp(d) G^-1 E) at d = 0."""
    c, s = F.cos(g.theta), F.sin(g.theta)
    rows = []
    for p, q, r in _log_slope(e):
        rows.append([p * c + q * s, q * c - p * s, p * g.y - q * g.x + r])
    return [*rows, [F.lit(0.0), F.lit(0.0), F.lit(1.0)]]


def _se2_prior_jacobians(a, b, m):
    inv = se2.inverse(Pose.field(m))
    return [_pose_jacobian(se2.between(Pose.field(m), Pose.of(a)), inv)]


def _se2_between_error(a, b, m) -> Pose:
    return se2.between(Pose.field(m), se2.between(Pose.of(a), Pose.of(b)))


def _se2_between_jacobians(a, b, m):
    g = se2.inverse(se2.compose(Pose.of(a), Pose.field(m)))
    j = _pose_jacobian(_se2_between_error(a, b, m), g)
    return [[[-x for x in row] for row in j], j]


def _first(v: Column) -> Column:
    return F.get(v, F.lit(0))


KINDS: dict[str, Kind] = {
    "prior": Kind(1, "scalar", lambda a, b, m: [_first(a) - m["x"]], lambda a, b, m: [[[F.lit(1.0)]]], robust=False),
    "between": Kind(2, "scalar", lambda a, b, m: [_first(b) - _first(a) - m["x"]], lambda a, b, m: [[[F.lit(-1.0)]], [[F.lit(1.0)]]], robust=False),
    "se2_prior": Kind(1, "se2", lambda a, b, m: list(se2.log(se2.between(Pose.field(m), Pose.of(a)))), _se2_prior_jacobians),
    "se2_between": Kind(2, "se2", lambda a, b, m: list(se2.log(_se2_between_error(a, b, m))), _se2_between_jacobians),
}


def register_kind(name: str, kind: Kind) -> None:
    """A factor kind of one's own; its residual is a column expression, so it runs like the built-in ones."""
    KINDS[name] = kind


def moved(kind: str, v: Column, d: list[Column]) -> Column:
    """The value array moved by d."""
    if kind == "se2":
        return se2.compose(se2.exp(*d), Pose.of(v)).array()
    return F.array(*[F.get(v, F.lit(i)) + x for i, x in enumerate(d)])


#: Half the distance of the central differences.
STEP = 1e-6


def numeric_jacobians(kind: Kind, a: Column, b: Column, m: Column) -> list[list[list[Column]]]:
    """By central differences; what kinds without Jacobians of their own use."""
    out = []
    for k in range(kind.keys):
        columns = []
        for d in range(kind.width):
            ends = []
            for sign in (STEP, -STEP):
                shift = [F.lit(sign if i == d else 0.0) for i in range(kind.width)]
                there = moved(kind.variable, b if k else a, shift)
                ends.append(kind.residual(a, there, m) if k else kind.residual(there, b, m))
            columns.append([(p - q) / (2 * STEP) for p, q in zip(*ends)])
        out.append([list(row) for row in zip(*columns)])
    return out


def with_values(factors: DataFrame, values: DataFrame) -> DataFrame:
    """Factors with the values ``a`` and ``b`` of their keys; a key without a value is an error when it is read.

    Factors of one key are dealt out by their ids for ``b``, where they meet nothing; as nulls they would fill one task.
    """
    for name, i in (("a", 0), ("b", 1)):
        key = F.get("keys", F.lit(i))
        side = values.select(F.col("key").alias("__key"), F.col("v").alias(name))
        factors = factors.join(side, (F.coalesce(key, F.col("fid")) == F.col("__key")) & key.isNotNull(), "left").drop("__key")
        factors = factors.withColumn(name, F.when(key.isNotNull(), F.coalesce(F.col(name), F.raise_error(F.concat(F.lit("no value for the key "), key.cast("string"))))))
    return factors


def of_kind(make: Callable[[Kind, Column, Column, Column], Column], name: Column, a: Column, b: Column, meas: Column) -> Column:
    """What ``make`` makes of the kind that ``name`` names."""
    out = None
    for known, kind in KINDS.items():
        value = make(kind, a, b, meas)
        out = F.when(name == known, value) if out is None else out.when(name == known, value)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown kind "), name)))


def _of_kind(make: Callable[[Kind, Column, Column, Column], Column]) -> Column:
    return of_kind(make, F.col("kind"), F.col("a"), F.col("b"), F.col("meas"))


def matrices(kind: Kind, a: Column, b: Column, m: Column) -> Column:
    """The Jacobians as an array of arrays of rows."""
    found = (kind.jacobians or (lambda a, b, m: numeric_jacobians(kind, a, b, m)))(a, b, m)
    return F.array(*[F.array(*[F.array(*row) for row in j]) for j in found])


def raw_residuals() -> Column:
    return _of_kind(lambda k, a, b, m: F.array(*k.residual(a, b, m)))


def jacobians_of() -> Column:
    return _of_kind(matrices)


def whitened(met: DataFrame) -> DataFrame:
    """Factors with their values get ``r`` and ``s``."""
    met = met.withColumn("r", raw_residuals())
    met = met.withColumn("r", F.zip_with("r", "sigma", lambda r, sigma: F.when(sigma > 0, r / sigma).otherwise(F.raise_error(F.lit("sigmas must be positive")))))
    return met.withColumn("s", F.aggregate("r", F.lit(0.0), lambda acc, r: acc + r * r))


def residuals(factors: DataFrame, values: DataFrame) -> DataFrame:
    """The factors with ``r``, their residuals over sigma, and ``s``, the sum of its squares."""
    return whitened(with_values(factors, values))


def loss_of() -> Column:
    robust = [name for name, kind in KINDS.items() if kind.robust]
    return F.when(F.col("kind").isin(robust), F.col("loss"))


def errors_of(met: DataFrame) -> DataFrame:
    """With ``error``: half the squared residuals, or the loss of them."""
    return met.withColumn("error", F.when(loss_of().isNull(), F.col("s") / 2).otherwise(losses.rho(loss_of(), F.col("s"))))


def errors(factors: DataFrame, values: DataFrame) -> DataFrame:
    """(fid, error)."""
    return errors_of(residuals(factors, values)).select("fid", "error")


def total_error(factors: DataFrame, values: DataFrame) -> float:
    return errors(factors, values).agg(F.coalesce(F.sum("error"), F.lit(0.0))).first()[0]


def linearize(factors: DataFrame, values: DataFrame) -> DataFrame:
    """(fid, keys, b, jacobians, s, loss): whitened blocks; a Jacobian is an array of rows."""
    met = residuals(factors, values).withColumn("j", jacobians_of())
    white = F.transform("j", lambda j: F.zip_with(j, F.col("sigma"), lambda row, s: F.transform(row, lambda x: x / s)))
    return met.select("fid", "keys", F.col("r").alias("b"), white.alias("jacobians"), "s", F.when(loss_of().isNotNull(), F.col("loss")).alias("loss"))


def gradient(linear: DataFrame) -> DataFrame:
    """(key, g): the slope of the total error along each variable, losses included."""
    scale = F.when(F.col("loss").isNull(), 1.0).otherwise(losses.slope2(F.col("loss"), F.col("s")))
    rows = linear.select("b", scale.alias("w"), F.explode(F.arrays_zip("keys", "jacobians")).alias("x"))
    pull = F.transform(F.sequence(F.lit(0), F.size(F.get("x.jacobians", F.lit(0))) - 1), lambda i: F.col("w") * _dot(F.transform(F.col("x.jacobians"), lambda row: F.get(row, i)), F.col("b")))
    rows = rows.select(F.col("x.keys").alias("key"), pull.alias("g"))
    width = F.max(F.size("g"))
    return rows.groupBy("key").agg(width.alias("n"), *[F.sum(F.get("g", F.lit(i))).alias(f"g{i}") for i in range(3)]).select("key", F.slice(F.array("g0", "g1", "g2"), F.lit(1), F.col("n")).alias("g"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def normal_blocks(linear: DataFrame, irls: bool = True) -> DataFrame:
    """(ki, kj, rows, cols, h0..h8, g0..g2): sums of J'WJ by pair of keys, and of J'Wr where ki = kj.

    Partial sums are made before the shuffle; a block has nine numbers at most.
    """
    w = F.when(F.col("loss").isNull() | F.lit(not irls), 1.0).otherwise(losses.weight(F.col("loss"), F.col("s")))
    sides = F.transform(F.arrays_zip("keys", "jacobians"), lambda x, i: F.struct(x["keys"].alias("key"), x["jacobians"].alias("j"), i.alias("i")))
    rows = linear.select("b", w.alias("w"), sides.alias("sides")).select("b", "w", "sides", F.explode("sides").alias("p")).select("b", "w", "p", F.explode("sides").alias("q"))
    width = lambda x: F.size(F.get(F.col(f"{x}.j"), F.lit(0)))
    column = lambda x, i: F.transform(F.col(f"{x}.j"), lambda row: F.get(row, i))
    entry = lambda k: F.col("w") * _dot(column("p", F.floor(k / width("q")).cast("int")), column("q", (k % width("q")).cast("int")))
    rows = rows.select(
        F.col("p.key").alias("ki"), F.col("q.key").alias("kj"), width("p").alias("rows"), width("q").alias("cols"),
        F.transform(F.sequence(F.lit(0), width("p") * width("q") - 1), entry).alias("h"),
        F.when(F.col("p.i") == F.col("q.i"), F.transform(F.sequence(F.lit(0), width("p") - 1), lambda i: F.col("w") * _dot(column("p", i), F.col("b")))).alias("g"),
    )
    return rows.groupBy("ki", "kj").agg(F.max("rows").alias("rows"), F.max("cols").alias("cols"), *[F.sum(F.get("h", F.lit(i))).alias(f"h{i}") for i in range(9)], *[F.sum(F.get("g", F.lit(i))).alias(f"g{i}") for i in range(3)])


class GaussianFactor:
    """One linearized factor on the driver: the error of a step d is half the square of A d + b."""

    def __init__(self, keys, jacobians, b):
        self.keys, self.b = list(keys), np.asarray(b, float)
        self._jacobians = [np.asarray(j, float) for j in jacobians]
        if len(self.keys) != len(self._jacobians):
            raise ValueError("one Jacobian for each key")
        if any(j.ndim != 2 or len(j) != len(self.b) for j in self._jacobians):
            raise ValueError("a Jacobian has a row for each element of b")

    @classmethod
    def of(cls, row) -> GaussianFactor:
        """From a row of :func:`linearize`."""
        return cls(row["keys"], row["jacobians"], row["b"])

    def jacobian(self, key: int) -> np.ndarray:
        if key not in self.keys:
            raise KeyError(key)
        return self._jacobians[self.keys.index(key)]

    def jacobians(self) -> list[np.ndarray]:
        return self._jacobians

    def dim(self) -> int:
        return len(self.b)

    def error(self, steps: dict[int, object]) -> float:
        """A key without a step stays."""
        out = self.b.copy()
        for key, j in zip(self.keys, self._jacobians):
            if key in steps:
                d = np.atleast_1d(np.asarray(steps[key], float))
                if len(d) != j.shape[1]:
                    raise ValueError(f"the step of the key {key} has the wrong size")
                out += j @ d
        return 0.5 * float(out @ out)
