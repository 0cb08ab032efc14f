"""Correlation, regression, tests on moments, and distribution functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.dataset import FIELD, SERIES, Dataset
from isohyet.functions.special import beta_cdf, beta_quantile, chi_square_cdf, fisher_cdf, normal_cdf, student_cdf, student_quantile
from isohyet.operators.pairs import beside
from isohyet.operators.registry import op, put
from isohyet.operators.stats import middle

V = F.col("v")
PAIR = V.isNotNull() & F.col("w").isNotNull()


def _moments(w: Column) -> tuple[Column, ...]:
    x, y = V, F.col("w")
    return F.sum(w), F.sum(w * x), F.sum(w * y), F.sum(w * x * x), F.sum(w * y * y), F.sum(w * x * y)


def _field(a: Dataset, b: Dataset, value: Column) -> Dataset:
    from isohyet.operators.stats import ONE

    out = beside(a, b).where(PAIR).groupBy(*FIELD).agg(value.alias("v"))
    return a.of(out.withColumn("x", F.lit(0)).withColumn("y", F.lit(0)), grid=a.grid.with_(lons=ONE, lats=ONE, mask=None, areas=None))


@op("fldcor")
def fldcor(a: Dataset, b: Dataset) -> Dataset:
    n, x, y, xx, yy, xy = _moments(a.grid.weight())
    spread = (xx * n - x * x) * (yy * n - y * y)
    return _field(a, b, F.when(spread > 0, (xy * n - x * y) / F.sqrt(spread)))


@op("fldcovar")
def fldcovar(a: Dataset, b: Dataset) -> Dataset:
    n, x, y, _, _, xy = _moments(a.grid.weight())
    return _field(a, b, (xy * n - x * y) / F.nullif(n * n, F.lit(0.0)))


@op("fldrms")
def fldrms(a: Dataset, b: Dataset) -> Dataset:
    w = a.grid.weight()
    return _field(a, b, F.sqrt(F.sum(w * (F.col("w") - V) * (F.col("w") - V)) / F.sum(w)))


@op("varrms")
def varrms(a: Dataset, b: Dataset) -> Dataset:
    """Root mean square difference over space and levels."""
    from isohyet.operators.stats import ONE

    w = a.grid.weight()
    value = F.sqrt(F.sum(w * (F.col("w") - V) * (F.col("w") - V)) / F.sum(w))
    out = beside(a, b).where(PAIR).groupBy("var", "ts", "t").agg(value.alias("v"))
    return a.of(out.withColumns({"x": F.lit(0), "y": F.lit(0), "level": F.lit(0.0)}), grid=a.grid.with_(lons=ONE, lats=ONE)).only("level")


@op("trms", inputs=3)
def trms(a: Dataset, b: Dataset, dp: Dataset) -> Dataset:
    """Difference weighted by area and by the layers' pressure thickness (third dataset)."""
    from isohyet.operators.stats import ONE

    thick = dp.cells.select("level", "ts", "x", "y", F.col("v").alias("dp"))
    own = beside(a, b).where(PAIR).join(thick, ["level", "ts", "x", "y"])
    w = a.grid.weight() * F.col("dp")
    out = own.groupBy("var", "ts", "t").agg(F.sqrt(F.sum(w * (F.col("w") - V) * (F.col("w") - V)) / F.sum(w)).alias("v"))
    return a.of(out.withColumns({"x": F.lit(0), "y": F.lit(0), "level": F.lit(0.0)}), grid=a.grid.with_(lons=ONE, lats=ONE)).only("level")


def _series(a: Dataset, b: Dataset, value: Column) -> Dataset:
    out = beside(a, b).where(PAIR).groupBy(*SERIES).agg(value.alias("v"), middle(F.min("t"), F.max("t")).alias("t"))
    return a.of(out.withColumn("ts", F.lit(0))).only("ts")


@op("timcor")
def timcor(a: Dataset, b: Dataset) -> Dataset:
    spread = F.stddev_pop(V) * F.stddev_pop("w")
    return _series(a, b, F.when(spread > 0, F.covar_pop(V, F.col("w")) / spread))


@op("timcovar")
def timcovar(a: Dataset, b: Dataset) -> Dataset:
    return _series(a, b, F.covar_pop(V, F.col("w")))


@op("regres")
def regres(d: Dataset) -> Dataset:
    """Slope of the values over the steps 1, 2, 3 ..."""
    return _line(d, F.regr_slope(V, F.col("ts") + 1))


def _line(d: Dataset, value: Column) -> Dataset:
    out = d.dense().cells.groupBy(*SERIES).agg(value.alias("v"), middle(F.min("t"), F.max("t")).alias("t"))
    return d.of(out.withColumn("ts", F.lit(0))).only("ts")


@op("trend")
def trend(d: Dataset) -> tuple[Dataset, Dataset]:
    """Intercept and slope over the steps 0, 1, 2 ..."""
    return _line(d, F.regr_intercept(V, F.col("ts"))), _line(d, F.regr_slope(V, F.col("ts")))


@op("detrend")
def detrend(d: Dataset) -> Dataset:
    return subtrend(d, *trend(d))


@op("subtrend")
def subtrend(d: Dataset, intercept: Dataset, slope: Dataset) -> Dataset:
    own = d.dense().cells
    a, b = intercept.cells.select(*SERIES, F.col("v").alias("_a")), slope.cells.select(*SERIES, F.col("v").alias("_b"))
    return d.of(own.join(a, SERIES).join(b, SERIES).withColumn("v", V - (F.col("_a") + F.col("_b") * F.col("ts"))))


def _two(a: Dataset, b: Dataset) -> DataFrame:
    one = a.cells.select(*SERIES, "t", "v", F.lit(None).cast("double").alias("w"))
    two = b.cells.select(*SERIES, "t", F.lit(None).cast("double").alias("v"), F.col("v").alias("w"))
    return one.unionByName(two).groupBy(*SERIES).agg(F.count("v").alias("n"), F.count("w").alias("m"), F.avg("v").alias("mx"), F.avg("w").alias("my"), F.var_pop("v").alias("vx"), F.var_pop("w").alias("vy"), middle(F.min("t"), F.max("t")).alias("t"))


@op("meandiff2test")
def meandiff2test(a: Dataset, b: Dataset, mean: float = 0.0, risk: float = 0.05) -> Dataset:
    """1 where the difference of the means departs from *mean* beyond Student's quantile, else 0."""
    risk = float(risk)
    quantile = F.pandas_udf(lambda n: pd.Series([student_quantile(max(k, 1), 1 - risk / 2) for k in n]), "double")
    own = _two(a, b).where("n + m > 2")
    df = F.col("n") + F.col("m") - 2
    pooled = F.sqrt((F.col("n") * F.col("vx") + F.col("m") * F.col("vy")) / df * (1 / F.col("n") + 1 / F.col("m")))
    test = F.abs((F.col("mx") - F.col("my") - float(mean)) / F.nullif(pooled, F.lit(0.0)))
    return a.of(own.withColumn("v", (test > quantile(df.cast("double"))).cast("double")).withColumn("ts", F.lit(0))).only("ts")


@op("varquot2test")
def varquot2test(a: Dataset, b: Dataset, ratio: float = 1.0, risk: float = 0.05) -> Dataset:
    """1 where the quotient of the variances departs from *ratio* beyond the beta quantiles, else 0."""
    risk, ratio = float(risk), float(ratio)
    outside = F.pandas_udf(
        lambda s, n, m: pd.Series([float(q < beta_quantile((i - 1) / 2, (j - 1) / 2, risk / 2) or q > beta_quantile((i - 1) / 2, (j - 1) / 2, 1 - risk / 2)) if i > 1 and j > 1 and q == q else None for q, i, j in zip(s, n, m)]),
        "double",
    )
    own = _two(a, b)
    share = F.col("n") * F.col("vx") / F.nullif(F.col("n") * F.col("vx") + ratio * F.col("m") * F.col("vy"), F.lit(0.0))
    return a.of(own.withColumn("v", outside(share, F.col("n"), F.col("m"))).withColumn("ts", F.lit(0))).only("ts")


def _distribution(name: str, cdf) -> None:  # noqa: ANN001
    def run(d: Dataset, *args: float) -> Dataset:
        own = [float(a) for a in args]

        @F.pandas_udf("double")
        def probability(v: pd.Series) -> pd.Series:
            return v.map(lambda x: cdf(x, *own) if x is not None and not math.isnan(x) else np.nan).astype(float)

        return d.map(F.when(V.isNotNull(), probability(V)))

    put(name, run)


_distribution("normal", normal_cdf)
_distribution("studentt", lambda x, n: student_cdf(n, x))
_distribution("chisquare", lambda x, n: chi_square_cdf(n, x))
_distribution("beta", lambda x, p, q: beta_cdf(p, q, x))
_distribution("fisher", lambda x, n, m: fisher_cdf(n, m, x))
