"""Reading and writing: Parquet, text, and the simple binary record formats."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.dataset import COLUMNS, Dataset
from isohyet.grid import Grid

MISSING = -9e33
CELLS = "var string, level double, ts int, t timestamp, x int, y int, v double"


def from_parquet(spark: SparkSession, path: str, grid: Grid, **description: object) -> Dataset:
    return Dataset(spark.read.parquet(path).select(*COLUMNS), grid, **description)


def to_parquet(d: Dataset, path: str, mode: str = "error", by: list[str] | None = None, compression: str = "zstd") -> None:
    writer = d.cells.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def _records(blob: bytes) -> Iterator[bytes]:
    """Records framed by their length in four bytes on both sides, in either byte order."""
    if len(blob) < 4:
        return
    order = "<" if struct.unpack("<i", blob[:4])[0] in range(0, len(blob)) else ">"
    at = 0
    while at + 4 <= len(blob):
        n = struct.unpack(order + "i", blob[at : at + 4])[0]
        if n < 0 or at + 8 + n > len(blob):
            raise ValueError("a record is cut short")
        yield (order.encode() + blob[at + 4 : at + 4 + n])
        at += 8 + n


def _numbers(record: bytes, count: int, kind: str) -> np.ndarray:
    body = record[1:]
    size = len(body) // count
    return np.frombuffer(body, record[:1].decode() + kind + str(size), count)


def _fields(blob: bytes, layout: str) -> Iterator[tuple[int, float, int, int, int, int, np.ndarray]]:
    """code, level, date, time, nx, ny, values of each record pair of a service, extra or ieg file."""
    heads = {"service": 8, "extra": 4}
    records = _records(blob)
    for head in records:
        body = next(records, None)
        if body is None:
            raise ValueError("a header without values")
        h = _numbers(head, heads[layout], "i")
        if layout == "service":
            code, level, date, time, nx, ny = (int(v) for v in h[:6])
        else:
            date, code, level, nx = (int(v) for v in h)
            time, ny = 0, 1
        values = _numbers(body, nx * ny, "f")
        yield code, float(level), date, time, nx, ny, values.astype(float)


def read_binary(spark: SparkSession, path: str, layout: str = "service", missing: float = MISSING) -> Dataset:
    """A service (code, level, date, time, nx, ny) or extra (date, code, level, size) file.

    Files are read whole, one a task. The grid is that of the first field of one file.
    """
    files = spark.read.format("binaryFile").load(path)
    first = next(_fields(bytes(files.select("content").first()[0]), layout))
    grid = Grid(tuple(360 / first[4] * i for i in range(first[4])), tuple(90 - 180 / first[5] * (j + 0.5) for j in range(first[5])) if first[5] > 1 else (0.0,))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                for code, level, date, time, nx, ny, v in _fields(blob, layout):
                    at = np.arange(nx * ny)
                    stamp = f"{date // 10000:04d}-{date // 100 % 100:02d}-{date % 100:02d} {time // 100:02d}:{time % 100:02d}:00"
                    n = nx * ny
                    gone = np.isclose(v, missing, rtol=1e-6) | np.isnan(v)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"var{code}"] * n), pa.array(np.full(n, level)), pa.array([stamp] * n), pa.array((at % nx).astype(np.int32)), pa.array((at // nx).astype(np.int32)), pa.array(v, mask=gone)],
                        names=["var", "level", "t", "x", "y", "v"],
                    )

    rows = files.select("content").mapInArrow(run, "var string, level double, t string, x int, y int, v double").withColumn("t", F.col("t").cast("timestamp"))
    timed = rows.withColumn("ts", F.unix_timestamp("t"))
    return Dataset(timed.select(*COLUMNS), grid, attrs={"format": layout}).dense()


def to_binary(d: Dataset, path: str, layout: str = "service", missing: float = MISSING) -> None:
    """One file a step, in double precision; each field is one task's group of cells."""
    import os

    nx, ny = d.grid.nx, d.grid.ny
    fields = d.cells.withColumn("code", F.coalesce(F.try_to_number(F.regexp_extract("var", r"(\d+)$", 1), F.lit("999999999")).cast("int"), F.lit(0)))
    fields = fields.groupBy("ts", "t", "code", "level").agg(F.array_sort(F.collect_list(F.struct((F.col("y") * nx + F.col("x")).alias("cell"), F.coalesce("v", F.lit(missing)).alias("v")))).alias("f"))
    os.makedirs(path, exist_ok=True)

    def frame(body: bytes) -> bytes:
        return struct.pack("<i", len(body)) + body + struct.pack("<i", len(body))

    def write(rows: Iterator) -> None:
        for r in rows:
            date, time = r["t"].year * 10000 + r["t"].month * 100 + r["t"].day, r["t"].hour * 100 + r["t"].minute
            v = np.full(nx * ny, missing)
            v[[c["cell"] for c in r["f"]]] = [c["v"] for c in r["f"]]
            head = (r["code"], int(r["level"]), date, time, nx, ny, 0, 0) if layout == "service" else (date, r["code"], int(r["level"]), nx * ny)
            with open(f"{path}/{r['ts']:09d}-{r['code']:06d}-{r['level']:g}.{layout}", "wb") as f:
                f.write(frame(struct.pack(f"<{len(head)}i", *head)) + frame(v.astype("<f8").tobytes()))

    fields.foreachPartition(write)


def input_text(spark: SparkSession, path: str, grid: Grid, var: str = "var1", start: str = "1970-01-01", missing: float = MISSING) -> Dataset:
    """White-space separated numbers, a field (one step) after another; a file is one value sequence."""
    words = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != "")).alias("i", "w"))
    n = grid.size
    i = F.col("i")
    cells = words.select(
        F.lit(var).alias("var"),
        F.lit(0.0).alias("level"),
        F.floor(i / n).cast("int").alias("ts"),
        F.lit(start).cast("timestamp").alias("t"),
        (i % n % grid.nx).cast("int").alias("x"),
        F.floor(i % n / grid.nx).cast("int").alias("y"),
        F.when(F.abs(F.col("w").cast("double") - missing) > abs(missing) * 1e-9, F.col("w").cast("double")).alias("v"),
    )
    return Dataset(cells, grid)


def input_records(spark: SparkSession, path: str, layout: str = "service", missing: float = MISSING) -> Dataset:
    """Text form of a service or extra file: header numbers, then the values."""
    n = 8 if layout == "service" else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(0).to_pylist():
                words, at = text.split(), 0
                while at < len(words):
                    h = [int(float(w)) for w in words[at : at + n]]
                    code, level, date, time, nx, ny = (*h[:6],) if layout == "service" else (h[1], h[2], h[0], 0, h[3], 1)
                    v = np.array(words[at + n : at + n + nx * ny], float)
                    at += n + nx * ny
                    own = np.arange(nx * ny)
                    stamp = f"{date // 10000:04d}-{date // 100 % 100:02d}-{date % 100:02d} {time // 100:02d}:{time % 100:02d}:00"
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"var{code}"] * len(own)), pa.array(np.full(len(own), float(level))), pa.array([stamp] * len(own)), pa.array((own % nx).astype(np.int32)), pa.array((own // nx).astype(np.int32)), pa.array(v, mask=v == missing)],
                        names=["var", "level", "t", "x", "y", "v"],
                    )

    rows = spark.read.text(path, wholetext=True).mapInArrow(run, "var string, level double, t string, x int, y int, v double").withColumn("t", F.col("t").cast("timestamp"))
    top = rows.agg(F.max("x"), F.max("y")).first()
    nx, ny = top[0] + 1, top[1] + 1
    grid = Grid(tuple(360 / nx * i for i in range(nx)), tuple(90 - 180 / ny * (j + 0.5) for j in range(ny)) if ny > 1 else (0.0,))
    return Dataset(rows.withColumn("ts", F.unix_timestamp("t")).select(*COLUMNS), grid).dense()


def import_observations(spark: SparkSession, path: str, grid: Grid) -> Dataset:
    """Text lines of station, date and time, lat, lon, height, code, level, value; gridded to the nearest cell."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(parts) >= 8).select(parts.alias("p"))
    lon, lat = F.col("p")[3].cast("double"), F.col("p")[2].cast("double")
    nearest = lambda c, own: F.expr("cast(null as int)") if not own else F.array_position(F.transform(F.lit(list(own)), lambda o: F.abs(o - c)), F.array_min(F.transform(F.lit(list(own)), lambda o: F.abs(o - c)))).cast("int") - 1
    cells = rows.select(
        F.concat(F.lit("var"), F.col("p")[5]).alias("var"),
        F.lit(0.0).alias("level"),
        F.to_timestamp(F.col("p")[1], "yyyyMMddHHmm").alias("t"),
        nearest(lon, grid.lons).alias("x"),
        nearest(lat, grid.lats).alias("y"),
        F.col("p")[7].cast("double").alias("v"),
    )
    return Dataset(cells.withColumn("ts", F.unix_timestamp("t")).select(*COLUMNS), grid).dense()


class Packed:
    """Values as integers of a number of bits, with scale and offset."""

    def __init__(self, low: float, high: float, bits: int = 16) -> None:
        self.top = 2**bits - 2
        self.scale = (high - low) / self.top if high > low else 1.0
        self.offset = low

    def column(self) -> object:
        return F.round((F.col("v") - self.offset) / self.scale).cast("long")


def finite(x: float | None) -> bool:
    return x is not None and math.isfinite(x)
