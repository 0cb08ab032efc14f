"""Shared helpers: durable intermediate tables and table access."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh path under the session's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset on a
    single machine (as in tests) a temporary folder is made and remembered; executors
    elsewhere could not see it, so a cluster without the setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="isohyet-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/t-{uuid.uuid4().hex}"


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write *df* as Parquet to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs one stage only, and gives the
    planner the real size of the table.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, with the session's Arrow batches held to *rows* rows at most.

    Rows carry whole texts here; the usual 10,000 of them, in the JVM and in two Python
    workers at once, take more memory than an executor has beside its heap. A lower
    setting stays as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key, "10000")) <= rows:
        conf.set(key, str(rows))
    return df


def least_hashed(df: DataFrame, hash_col: str, n: int) -> DataFrame:
    """From large tables the rows under a bound of a 64-bit hash, of which some 2 n are expected.

    Ordered and limited to n afterwards, they are a sample whose rows are the same at
    any partitioning; what the tasks send to be merged does not grow with their number.
    Tables of up to 4 n rows pass whole, and give the same sample: the bound changes only
    how many rows are sent, as the first n by hash lie under it.
    """
    total = df.count()
    return df.where(F.col(hash_col) < int(2**64 * 2 * n / total) - 2**63) if total > 4 * n else df


def boxed(df: DataFrame, **own: Column) -> DataFrame:
    """(_row, own ...): all columns of df as one struct beside an operator's own, so that no names clash."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), *[c.alias(name) for name, c in own.items()])


def running(values: Column, least: int = 0, largest: bool = False) -> Column:
    """For each element of an array of ints the sum, or the largest, of those before it; *least* for the first.

    Running arrays are built in blocks of about the square root of the length, as every
    step copies what its array has so far.
    """

    def op(a: Column, b: Column) -> Column:
        return F.greatest(a, b) if largest else a + b

    def fold(xs: Column) -> Column:
        state = F.struct(F.lit(least).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(xs, state, lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def blocked(xs: Column) -> Column:
        side = F.greatest(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / side).cast("int") - 1, F.lit(0))), lambda b: fold(F.slice(xs, b * side + 1, side)))
        return F.transform(F.array(blocks), lambda bs: F.flatten(F.zip_with(bs, fold(F.transform(bs, lambda b: b["at"]))["out"], lambda b, o: F.transform(b["out"], lambda x: op(x, o)))))[0]

    return F.transform(F.array(values), blocked)[0]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is made once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def wide(text: Column) -> Column:
    """A text as UTF-32, of which parts can be cut without counting characters from the begin."""
    return F.encode(text, "UTF-32")


def part(wide_text: Column, start: Column, end: Column) -> Column:
    """Code points start to end, exclusive, of a text in UTF-32."""
    return F.decode(F.substring(wide_text, 4 * start + 1, F.greatest(4 * (end - start), F.lit(0))), "UTF-32")
