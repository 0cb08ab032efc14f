"""Operators on two or three datasets: arithmetic, comparison, conditions, climatologies.

A dataset that is known to have one step, one variable or one level (``Dataset.single``)
fills up the other's in it; the other keys are joined. A filling side is broadcast only
when it is one field of ``BROADCAST_CELLS`` cells at most; the planner decides on larger ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.dataset import Dataset
from isohyet.operators.registry import op, put
from isohyet.operators.values import div0, mul0

BROADCAST_CELLS = 500_000
Both = Callable[[Column, Column], Column]

ARITHMETIC: dict[str, Both] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": mul0,
    "div": div0,
}
BINARY: dict[str, Both] = ARITHMETIC | {
    "min": F.least,
    "max": F.greatest,
    "atan2": F.atan2,
    "eq": lambda a, b: (a == b).cast("double"),
    "ne": lambda a, b: (a != b).cast("double"),
    "le": lambda a, b: (a <= b).cast("double"),
    "lt": lambda a, b: (a < b).cast("double"),
    "ge": lambda a, b: (a >= b).cast("double"),
    "gt": lambda a, b: (a > b).cast("double"),
}


def small(d: Dataset) -> bool:
    return {"ts", "var", "level"} <= d.single and d.grid.size <= BROADCAST_CELLS


def beside(a: Dataset, b: Dataset, name: str = "w") -> DataFrame:
    """a's cells with b's value as *name*; b fills up variables, levels and steps of which it has one."""
    keys = [c for c in ("var", "level", "ts") if c not in b.single]
    keys += ["x", "y"] if b.grid.size > 1 else []
    right = b.cells.select(*keys, F.col("v").alias(name))
    right = F.broadcast(right) if small(b) else right
    if not keys:
        return a.cells.join(right)  # one value for all
    return a.cells.join(right, keys)


def binary(f: Both) -> Callable[[Dataset, Dataset], Dataset]:
    def run(a: Dataset, b: Dataset) -> Dataset:
        if a.single > b.single:  # a fills up b
            return b.of(beside(b, a).withColumn("v", f(F.col("w"), F.col("v")).cast("double")))
        return a.of(beside(a, b).withColumn("v", f(F.col("v"), F.col("w")).cast("double")))

    return run


for _name, _f in BINARY.items():
    put(_name, binary(_f), 2)


@op("ifthen")
def ifthen(mask: Dataset, d: Dataset) -> Dataset:
    return d.of(beside(d, mask).withColumn("v", F.when(F.col("w") != 0, F.col("v"))))


@op("ifnotthen")
def ifnotthen(mask: Dataset, d: Dataset) -> Dataset:
    return d.of(beside(d, mask).withColumn("v", F.when(F.col("w") == 0, F.col("v"))))


@op("ifthenelse")
def ifthenelse(mask: Dataset, a: Dataset, b: Dataset) -> Dataset:
    joined = beside(a.with_(cells=beside(a, b, "other")), mask, "m")
    return a.of(joined.withColumn("v", F.when(F.col("m") != 0, F.col("v")).when(F.col("m") == 0, F.col("other"))))


#: How a climatology's steps are told apart, for each family.
PERIODS: dict[str, Callable[[Column], list[Column]]] = {
    "mon": lambda t: [F.year(t) * 12 + F.month(t)],
    "ymon": lambda t: [F.month(t)],
    "yday": lambda t: [(F.month(t) - 1) * 31 + F.day(t)],
    "yhour": lambda t: [((F.month(t) - 1) * 31 + F.day(t)) * 25 + F.hour(t)],
    "yseas": lambda t: [F.floor(F.month(t) % 12 / 3).cast("int")],
}


def climatology(period: Callable[[Column], list[Column]], f: Both) -> Callable[[Dataset, Dataset], Dataset]:
    """A step meets the climatology's value of its period; a period that is not there is an error."""

    def run(d: Dataset, clim: Dataset) -> Dataset:
        keys = ["var", "level", "x", "y", "_p"]
        own = d.cells.withColumn("_p", period(F.col("t"))[0])
        right = clim.cells.withColumn("_p", period(F.col("t"))[0]).select(*keys, F.col("v").alias("w"), F.lit(True).alias("_there"))
        joined = own.join(right, keys, "left")
        value = F.when(F.col("_there"), f(F.col("v"), F.col("w"))).otherwise(F.raise_error(F.lit("a period has no step in the second dataset")).cast("double"))
        return d.of(joined.withColumn("v", value))

    return run


for _p, _key in PERIODS.items():
    for _name, _f in ARITHMETIC.items():
        put(_p + _name, climatology(_key, _f), 2)
