"""Running statistics, multi-year running statistics, run lengths, and sorting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isohyet.dataset import SERIES, Dataset
from isohyet.operators.registry import op, put
from isohyet.operators.stats import KEYS, STATS, TIME_STATS, middle, percentile

V = F.col("v")
STEPS = W.partitionBy(*SERIES).orderBy("ts")


def _nearest(values: Column, p: float) -> Column:
    """Nearest rank in an array, nulls left out."""
    found = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    at = F.greatest(F.ceil(F.size(found) * (float(p) / 100)), F.lit(1)).cast("int")
    return F.when(F.size(found) > 0, F.get(found, at - 1))


def _windowed(stat: str, frame: W) -> Column:
    """A statistic over a frame; sums of squares would lose digits, so variances come from two windows."""
    n, rows = F.count(V).over(frame), F.count(F.lit(1)).over(frame)
    simple = {"min": F.min(V), "max": F.max(V), "sum": F.sum(V), "mean": F.avg(V), "var": F.var_pop(V), "var1": F.var_samp(V), "std": F.stddev_pop(V), "std1": F.stddev_samp(V)}
    if stat == "avg":
        return F.when(n == rows, F.avg(V).over(frame))
    return simple[stat].over(frame)


def running(d: Dataset, value: Column, n: int) -> Dataset:
    """Full frames of n steps only; a frame's ts is its first step's, its stamp the middle one."""
    frame = STEPS.rowsBetween(0, n - 1)
    out = d.cells.withColumn("_v", value).withColumn("_n", F.count(F.lit(1)).over(frame)).withColumn("_t", middle(F.first("t").over(frame), F.last("t").over(frame)))
    return d.of(out.where(F.col("_n") == n).withColumn("v", F.col("_v").cast("double")).withColumn("t", F.col("_t")))


for _s in TIME_STATS:
    put(f"run{_s}", lambda d, n, s=_s: running(d, _windowed(s, STEPS.rowsBetween(0, int(n) - 1)), int(n)))


@op("runpctl")
def runpctl(d: Dataset, p: float, n: int) -> Dataset:
    frame = STEPS.rowsBetween(0, int(n) - 1)
    return running(d, _nearest(F.collect_list(V).over(frame), float(p)), int(n))


def multi_year_running(d: Dataset, value: Column, n: int) -> Dataset:
    """All values of all full frames of n steps, gathered by month and day of the frame's middle step.

    Each frame's values are gathered as rows, n to a frame, before one aggregate: a
    variance of the pooled values needs them all.
    """
    n = int(n)
    frame = STEPS.rowsBetween(0, n - 1)
    full = d.cells.withColumn("_all", F.collect_list(F.struct("v")).over(frame)).withColumn("_mid", F.get(F.collect_list(F.struct("t")).over(frame), F.lit((n - 1) // 2))["t"])
    full = full.where(F.size("_all") == n).select(*SERIES, F.col("_mid").alias("t"), F.explode("_all").alias("_one")).select(*SERIES, "t", F.col("_one.v").alias("v"))
    out = full.withColumn("ts", KEYS["yday"](F.col("t"))).groupBy(*SERIES, "ts").agg(value.alias("v"), F.max("t").alias("t"))
    return d.of(out.withColumn("v", F.col("v").cast("double")))


for _s in TIME_STATS:
    put(f"ydrun{_s}", lambda d, n, s=_s: multi_year_running(d, STATS[s], n))
put("ydrunpctl", lambda d, p, n, *bounds: multi_year_running(d, percentile(float(p)), n))


def islands(d: Dataset, inside: Column) -> Dataset:
    """cells with _in (1 or 0; missing is 0) and _island, the number of breaks so far."""
    own = d.cells.withColumn("_in", F.coalesce(inside, F.lit(False)).cast("int"))
    return d.with_(cells=own.withColumn("_island", F.sum(1 - F.col("_in")).over(STEPS.rowsBetween(W.unboundedPreceding, 0))))


def run_length() -> Column:
    """Length so far of the run that a step is in; 0 outside."""
    own = W.partitionBy(*SERIES, "_island").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    return F.sum("_in").over(own).cast("double")


@op("consecsum")
def consecsum(d: Dataset, ref: float = 0.0) -> Dataset:
    """Steps in a row that differ from the reference value; a missing value breaks the row."""
    return d.of(islands(d, V != float(ref)).cells.withColumn("v", run_length()))


@op("consects")
def consects(d: Dataset) -> Dataset:
    """The length of a row of nonzero values, at its last step only."""
    runs = islands(d, V != 0).cells.withColumn("_run", run_length())
    last = F.lead("_in").over(STEPS)
    return d.of(runs.withColumn("v", F.when((F.col("_run") > 0) & (F.coalesce(last, F.lit(0)) == 0), F.col("_run"))))


@op("timsort")
def timsort(d: Dataset) -> Dataset:
    """Each series sorted over time, missing values first."""
    rank = W.partitionBy(*SERIES).orderBy(F.col("v").asc_nulls_first(), "ts")
    own = d.cells.withColumn("_k", F.row_number().over(STEPS)).withColumn("_r", F.row_number().over(rank))
    axis = own.select(*SERIES, "ts", "t", "_k")
    values = own.select(*SERIES, "v", F.col("_r").alias("_k"))
    return d.of(axis.join(values, [*SERIES, "_k"]))


@op("sortcode")
def sortcode(d: Dataset) -> Dataset:
    return d.with_(variables=dict(sorted(d.variables.items(), key=lambda x: x[1].get("code", 0))))


@op("sortname")
def sortname(d: Dataset) -> Dataset:
    return d.with_(variables=dict(sorted(d.variables.items())))


@op("sortlevel")
def sortlevel(d: Dataset) -> Dataset:
    """Levels carry their value, so that their order is that of the value."""
    return d
