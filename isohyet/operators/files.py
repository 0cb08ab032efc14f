"""Joining, splitting, copying, and text output of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isohyet.dataset import Dataset, union
from isohyet.operators.registry import op, put
from isohyet.operators.stats import KEYS, timsel_key

T = F.col("t")


def _whole(datasets: list[Dataset]) -> Dataset:
    return datasets[0] if len(datasets) == 1 else cat(datasets)


for _n in ("copy", "selall", "szip"):
    put(_n, _whole, -1)
put("ncopy", lambda d, n=1: d)
put("template1", lambda d: d)
put("template2", lambda d: d)


def _joined(datasets: list[Dataset]) -> dict:
    metas: dict[str, dict] = {}
    for d in datasets:
        metas |= d.variables
    return metas


@op("cat", inputs=-1)
def cat(datasets: list[Dataset]) -> Dataset:
    """Steps of one dataset after those of another; numbers go on."""
    parts = []
    for k, d in enumerate(datasets):
        # the position of the dataset leads, so that no step need be counted
        parts.append(d.with_(cells=d.cells.withColumn("ts", F.col("ts").cast("long") + F.lit(k * (1 << 40)).cast("long"))))
    first = datasets[0]
    return first.of(union(parts), variables=_joined(datasets)).with_(single=first.single - {"ts"})


@op("merge", inputs=-1)
def merge(datasets: list[Dataset]) -> Dataset:
    """Fields of all datasets, for the steps that all have."""
    own = [d.dense() for d in datasets]
    steps = own[0].steps().select("ts")
    for d in own[1:]:
        steps = steps.join(d.steps().select("ts"), "ts")
    first = datasets[0]
    kept = union(own).join(steps, "ts")
    return first.of(kept, variables=_joined(datasets)).with_(single=first.single - {"var", "level"})


@op("mergetime", inputs=-1)
def mergetime(datasets: list[Dataset], skip: str = "") -> Dataset:
    """All steps in order of time; with "skip_same_time", of equal times the first dataset's step only."""
    out = None
    for k, d in enumerate(datasets):
        part = d.cells.withColumn("_k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    axis = out.select("t", "_k").distinct()
    if skip == "skip_same_time":
        axis = axis.groupBy("t").agg(F.min("_k").alias("_k"))
    axis = axis.withColumn("_n", (F.row_number().over(W.orderBy("t", "_k")) - 1).cast("int"))
    first = datasets[0]
    return first.of(out.join(axis, ["t", "_k"]).withColumn("ts", F.col("_n"))).with_(single=first.single - {"ts"})


@op("sorttimestamp", "sorttaxis", inputs=-1)
def sorttimestamp(datasets: list[Dataset], skip: str = "") -> Dataset:
    return mergetime(datasets, skip)


@op("mergegrid")
def mergegrid(a: Dataset, b: Dataset) -> Dataset:
    """Values of the second dataset over those of the first, where it has them, by coordinates."""
    at = lambda c, own, other: F.element_at(F.lit([next((j for j, o in enumerate(other) if abs(o - v) < 1e-6), -1) for v in own]), (F.col(c) + 1).cast("int"))
    right = b.cells.withColumns({"x": at("x", b.grid.lons, a.grid.lons), "y": at("y", b.grid.lats, a.grid.lats)}).where("x >= 0 AND y >= 0").select("var", "level", "ts", "x", "y", F.col("v").alias("w"))
    return a.of(a.cells.join(right, ["var", "level", "ts", "x", "y"], "left").withColumn("v", F.coalesce("w", "v")))


@op("replace")
def replace(a: Dataset, b: Dataset) -> Dataset:
    """Variables of the first dataset that the second has too come from the second."""
    names = b.cells.select("var").distinct()
    axis = a.dense()
    return a.of(union([axis.with_(cells=axis.cells.join(names, "var", "left_anti")), b.dense().with_(cells=b.dense().cells.join(a.cells.select("var").distinct(), "var", "left_semi"))]))


@op("duplicate")
def duplicate(d: Dataset, n: int = 2) -> Dataset:
    """All steps, n times in a row."""
    return cat([d] * int(n))


@op("collgrid", inputs=-1)
def collgrid(datasets: list[Dataset], *names: str) -> Dataset:
    """Tiles put together by their coordinates."""
    lons = tuple(sorted({v for d in datasets for v in d.grid.lons}))
    lats = sorted({v for d in datasets for v in d.grid.lats})
    down = datasets[0].grid.ny > 1 and datasets[0].grid.lats[0] > datasets[0].grid.lats[-1]
    lats = tuple(reversed(lats) if down else lats)
    parts = []
    for d in datasets:
        at = lambda c, own, other: F.element_at(F.lit([other.index(v) for v in own]), (F.col(c) + 1).cast("int"))
        parts.append(d.with_(cells=d.cells.withColumns({"x": at("x", d.grid.lons, lons), "y": at("y", d.grid.lats, lats)})))
    out = datasets[0].of(union(parts), grid=datasets[0].grid.with_(lons=lons, lats=lats, mask=None, areas=None))
    return out.where(F.col("var").isin(list(names))) if names else out


@op("distgrid")
def distgrid(d: Dataset, nx: int, ny: int = 1) -> list[Dataset]:
    """nx by ny tiles."""
    from isohyet.operators.select import selindexbox

    cuts = lambda n, k: [(n * i // k + 1, n * (i + 1) // k) for i in range(k)]
    return [selindexbox(d, x1, x2, y1, y2) for y1, y2 in cuts(d.grid.ny, int(ny)) for x1, x2 in cuts(d.grid.nx, int(nx))]


def split_by(d: Dataset, key: Column, path: str | None = None, name: str = "part") -> DataFrame:
    """cells with the column *name* by which they part; written partitioned where a path is given.

    One pass writes all parts: partitions of the column take the place of files with a
    common prefix, and reading one of them reads nothing else.
    """
    own = d.cells.withColumn(name, key)
    if path:
        own.write.partitionBy(name).parquet(path)
    return own


def _meta_key(d: Dataset, key: str) -> Column:
    out = F.lit(None).cast("string")
    for n, m in d.variables.items():
        out = F.when(F.col("var") == n, F.lit(str(m.get(key, "")))).otherwise(out)
    return out


SPLITS = {
    "name": lambda d: F.col("var"),
    "code": lambda d: _meta_key(d, "code"),
    "param": lambda d: _meta_key(d, "param"),
    "tabnum": lambda d: _meta_key(d, "tabnum"),
    "level": lambda d: F.col("level").cast("string"),
    "grid": lambda d: F.lit(d.grid.kind),
    "zaxis": lambda d: _meta_key(d, "zaxis"),
    "rec": lambda d: F.concat_ws("_", F.col("ts").cast("string"), "var", F.col("level").cast("string")),
    "hour": lambda d: F.date_format(T, "HH"),
    "day": lambda d: F.date_format(T, "dd"),
    "mon": lambda d: F.date_format(T, "MM"),
    "seas": lambda d: F.element_at(F.lit(["DJF", "MAM", "JJA", "SON"]), KEYS["yseas"](T) + 1),
    "year": lambda d: F.date_format(T, "yyyy"),
    "yearmon": lambda d: F.date_format(T, "yyyyMM"),
}
for _n, _f in SPLITS.items():
    put(f"split{_n}", lambda d, path=None, f=_f: split_by(d, f(d), path))


@op("splitsel")
def splitsel(d: Dataset, n: int, offset: int = 0, skip: int = 0, path: str | None = None) -> DataFrame:
    key, inside = timsel_key(int(n), int(offset), int(skip))
    return split_by(d.dense().where(inside), key.cast("string"), path)


@op("tee")
def tee(d: Dataset, path: str | None = None) -> Dataset:
    """Written on the way, and passed on."""
    if path:
        d.cells.write.parquet(path)
    return d


# Text output: rows in order of step, variable, level and cell

KEY_COLUMNS = {
    "value": lambda d: F.col("v"),
    "name": lambda d: F.col("var"),
    "code": lambda d: _meta_key(d, "code"),
    "param": lambda d: _meta_key(d, "param"),
    "lon": lambda d: d.lon(),
    "lat": lambda d: d.lat(),
    "lev": lambda d: F.col("level"),
    "xind": lambda d: F.col("x") + 1,
    "yind": lambda d: F.col("y") + 1,
    "timestep": lambda d: F.col("ts") + 1,
    "date": lambda d: F.date_format(T, "yyyy-MM-dd"),
    "time": lambda d: F.date_format(T, "HH:mm:ss"),
    "year": lambda d: F.year(T),
    "month": lambda d: F.month(T),
    "day": lambda d: F.day(T),
}


def _printed(d: Dataset, columns: list[str]) -> DataFrame:
    order = [F.col("ts").alias("_ts"), F.col("var").alias("_var"), F.col("level").alias("_level"), (F.col("y") * d.grid.nx + F.col("x")).alias("_cell")]
    return d.cells.select(*order, *[KEY_COLUMNS[c](d).alias(c) for c in columns]).orderBy("_ts", "_var", "_level", "_cell").drop("_ts", "_var", "_level", "_cell")


for _n, _c in {
    "output": ["value"],
    "outputarr": ["value"],
    "outputts": ["date", "time", "value"],
    "outputfld": ["date", "lon", "lat", "value"],
    "outputxyz": ["lon", "lat", "value"],
    "outputsrv": ["code", "lev", "date", "time", "value"],
    "outputext": ["date", "code", "lev", "value"],
}.items():
    put(_n, lambda ds, c=_c: _printed(_whole(ds), c), -1)
put("outputint", lambda ds: _printed(_whole(ds), ["value"]).withColumn("value", F.round("value").cast("long")), -1)
put("outputf", lambda ds, form="%13.6g", n=1: _printed(_whole(ds), ["value"]).select(F.when(F.col("value").isNotNull(), F.format_string(form, "value")).alias("value")), -1)
put("outputtab", lambda ds, *keys: _printed(_whole(ds), [str(k).split(":")[0] for k in keys]), -1)


@op("pack")
def pack(d: Dataset, bits: int = 16) -> Dataset:
    """Values as they come back from integers of a number of bits, scaled per variable."""
    w = F.col("_hi") - F.col("_lo")
    top = 2 ** int(bits) - 2
    bounds = d.cells.groupBy("var").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    own = d.cells.join(bounds, "var")
    scale = F.when(w > 0, w / top).otherwise(1.0)
    return d.of(own.withColumn("v", F.round((F.col("v") - F.col("_lo")) / scale) * scale + F.col("_lo")))


# Input of text and binary files

def _reader(name: str):  # noqa: ANN202
    def run(spark, path, *args):  # noqa: ANN001, ANN002, ANN202
        from isohyet.grid import named
        from isohyet.sources import formats

        grid = lambda: named(args[0]) if isinstance(args[0], str) else args[0]
        return {
            "input": lambda: formats.input_text(spark, path, grid()),
            "inputsrv": lambda: formats.input_records(spark, path, "service"),
            "inputext": lambda: formats.input_records(spark, path, "extra"),
            "import_obs": lambda: formats.import_observations(spark, path, grid()),
            "import_binary": lambda: formats.read_binary(spark, path, *(args or ("service",))),
        }[name]()

    return run


for _n in ("input", "inputsrv", "inputext", "import_obs", "import_binary"):
    put(_n, _reader(_n), 0)


@op("cdiread")
def cdiread(d: Dataset) -> DataFrame:
    """How many values a full read meets."""
    return d.cells.agg(F.count(F.lit(1)).alias("cells"), F.count("v").alias("values"))


@op("writerandom")
def writerandom(d: Dataset, path: str | None = None) -> Dataset:
    """Records in no particular order: rows have none anyway."""
    if path:
        d.cells.orderBy(F.rand(1)).write.parquet(path)
    return d


# Text of cells for plotting tools, and small tables

for _n in ("outputcenter", "outputcenter2", "outputcentercpt"):
    put(_n, lambda d: _printed(d, ["lon", "lat", "value"]))


def _bounds(d: Dataset) -> DataFrame:
    """Each cell's value with its four corners, counter-clockwise from the south-west."""
    west, south = F.element_at(F.lit(d.grid.lon_edges()), F.col("x") + 1), F.element_at(F.lit(d.grid.lat_edges()), F.col("y") + 1)
    east, north = F.element_at(F.lit(d.grid.lon_edges()), F.col("x") + 2), F.element_at(F.lit(d.grid.lat_edges()), F.col("y") + 2)
    return d.cells.select("var", "level", "ts", F.col("v").alias("value"), F.array(west, east, east, west).alias("lons"), F.array(south, south, north, north).alias("lats"))


for _n in ("outputbounds", "outputboundscpt", "outputtri"):
    put(_n, _bounds)


@op("outputvector")
def outputvector(d: Dataset, u: str = "u", v: str = "v") -> DataFrame:
    """Position, length and direction (degrees from east) of the vectors of two variables."""
    own = d.cells.where(F.col("var").isin(u, v)).groupBy("level", "ts", "x", "y").agg(F.max(F.when(F.col("var") == u, F.col("v"))).alias("_u"), F.max(F.when(F.col("var") == v, F.col("v"))).alias("_v"))
    return own.select("level", "ts", d.lon().alias("lon"), d.lat().alias("lat"), F.hypot("_u", "_v").alias("speed"), F.degrees(F.atan2("_v", "_u")).alias("direction"))


@op("gridverify")
def gridverify(d: Dataset) -> list[str]:
    """What is wrong with a grid: centres out of order or repeated, latitudes beyond the poles."""
    found = []
    for name, values in (("lon", d.grid.lons), ("lat", d.grid.lats)):
        steps = [b - a for a, b in zip(values, values[1:])]
        if steps and not (all(s > 0 for s in steps) or all(s < 0 for s in steps)):
            found.append(f"{name} centres are not in order")
    if any(abs(v) > 90 for v in d.grid.lats):
        found.append("latitudes lie beyond a pole")
    return found


@op("read_cmor_table", inputs=0)
def read_cmor_table(spark, path: str) -> list[dict[str, str]]:  # noqa: ANN001
    from isohyet.sources.tables import read_entries

    return read_entries(path)


@op("conv_cmor_table", inputs=0)
def conv_cmor_table(spark, path: str) -> str:  # noqa: ANN001
    """The entries as namelist text."""
    from isohyet.sources.tables import read_entries

    lines = []
    for e in read_entries(path):
        kind = next((k for k in e if k.endswith("_entry")), "global")
        inner = " ".join(f'{k}="{v}"' for k, v in e.items() if not k.endswith("_entry"))
        lines.append(f"&{kind.removesuffix('_entry')} name=\"{e.get(kind, '')}\" {inner} /")
    return "\n".join(lines)


@op("nmltest", inputs=0)
def nmltest(spark, text: str) -> list[dict[str, str]]:  # noqa: ANN001
    from isohyet.sources.tables import namelists

    return namelists(text)
