"""Datasets made from the relational tables, each as a DataFrame plan and as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from isohyet.dataset import Dataset
from isohyet.grid import Grid

LI_GRID = Grid(tuple(18.0 + 36 * i for i in range(10)), tuple(-81.0 + 18 * j for j in range(10)))
EV_GRID = Grid(tuple(18.0 + 36 * i for i in range(10)), tuple(-72.0 + 36 * j for j in range(5)))
EM_GRID = Grid(tuple(45.0 * i for i in range(8)), tuple(-78.75 + 22.5 * j for j in range(8)))
PL_GRID = Grid(tuple(90.0 * i for i in range(4)), tuple(-67.5 + 45 * j for j in range(4)))

TURN = 11  # cells by which the fields of an ensemble's members differ

VARIABLES = {
    "li": {"A": {"code": 1, "param": "1.1", "unit": "pcs"}, "N": {"code": 2, "param": "2.1", "unit": "pcs"}, "R": {"code": 3, "param": "3.1", "unit": "pcs"}},
    "emb": {"emb": {"code": 130, "param": "130.128", "unit": "1", "stdname": "embedding", "ltype": 1, "tabnum": 128}},
}


def _table(spark: SparkSession, sf_dir: str, name: str):  # noqa: ANN202
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [c for c, kind in t.dtypes if kind == "timestamp_ntz"]
    return t.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else t


def li(spark: SparkSession, sf_dir: str) -> Dataset:
    """Daily quantities of line items: flags are variables, states levels, suppliers cells; discount 0 is missing."""
    t = _table(spark, sf_dir, "lineitem")
    cells = t.groupBy(
        F.col("l_returnflag").alias("var"),
        F.when(F.col("l_linestatus") == "F", 1.0).otherwise(2.0).alias("level"),
        F.datediff("l_shipdate", F.lit("1995-01-01")).alias("ts"),
        F.col("l_shipdate").alias("t"),
        (F.col("l_suppkey") % 10).cast("int").alias("x"),
        F.floor(F.col("l_suppkey") / 10 % 10).cast("int").alias("y"),
    ).agg(F.sum(F.when(F.col("l_discount") != 0, F.col("l_quantity"))).alias("v"))
    return Dataset(cells, LI_GRID, VARIABLES["li"])


LI_SQL = """li AS (
    SELECT l_returnflag AS var, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 2.0 END AS level,
           datediff('day', DATE '1995-01-01', l_shipdate::DATE) AS ts, l_shipdate AS t,
           l_suppkey % 10 AS x, (l_suppkey // 10) % 10 AS y,
           sum(CASE WHEN l_discount <> 0 THEN l_quantity END) AS v
    FROM lineitem GROUP BY ALL)"""


def ev(spark: SparkSession, sf_dir: str) -> Dataset:
    """Hourly sums of event values: types are variables, users cells."""
    t = _table(spark, sf_dir, "events").withColumn("h", F.date_trunc("hour", "ts"))
    cells = t.groupBy(
        F.col("event_type").alias("var"),
        F.lit(0.0).alias("level"),
        F.floor(F.unix_timestamp("h") / 3600).cast("int").alias("ts"),
        F.col("h").alias("t"),
        (F.col("user_id") % 10).cast("int").alias("x"),
        F.floor(F.col("user_id") / 10 % 5).cast("int").alias("y"),
    ).agg(F.round(F.sum("value"), 2).alias("v"))
    return Dataset(cells, EV_GRID)


EV_SQL = """ev AS (
    SELECT event_type AS var, 0.0 AS level, (epoch(date_trunc('hour', ts)) // 3600)::BIGINT AS ts, date_trunc('hour', ts) AS t,
           user_id % 10 AS x, (user_id // 10) % 5 AS y, round(sum(value), 2) AS v
    FROM events GROUP BY ALL)"""


def evd(spark: SparkSession, sf_dir: str) -> Dataset:
    """Daily sums of event values for every type, cell and day; days without events are missing."""
    t = _table(spark, sf_dir, "events").select(F.col("event_type").alias("var"), F.to_date("ts").alias("d"), (F.col("user_id") % 10).cast("int").alias("x"), F.floor(F.col("user_id") / 10 % 5).cast("int").alias("y"), "value")
    sums = t.groupBy("var", "d", "x", "y").agg(F.round(F.sum("value"), 2).alias("v"))
    # every type with every cell, from the type's own rows; and every day from the range of days
    span = t.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    places = F.explode(F.transform(F.sequence(F.lit(0), F.lit(EV_GRID.size - 1)), lambda i: F.struct((i % 10).cast("int").alias("x"), F.floor(i / 10).cast("int").alias("y"))))
    full = t.groupBy("var").agg(F.first(F.lit(1)).alias("one")).join(F.broadcast(span)).select("var", F.explode(F.sequence("a", "b")).alias("d")).select("var", "d", places.alias("p")).select("var", "d", "p.x", "p.y")
    cells = full.join(sums, ["var", "d", "x", "y"], "left").select("var", F.lit(0.0).alias("level"), F.datediff("d", F.lit("2024-01-01")).alias("ts"), F.col("d").cast("timestamp").alias("t"), "x", "y", "v")
    return Dataset(cells, EV_GRID)


EVD_SQL = """evd AS (
    SELECT f.var, 0.0 AS level, datediff('day', DATE '2024-01-01', f.d) AS ts, f.d::TIMESTAMP AS t, f.x, f.y, s.v
    FROM (SELECT var, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS d, c % 10 AS x, c // 10 AS y
          FROM (SELECT DISTINCT event_type AS var FROM events), (SELECT min(ts)::DATE AS a, max(ts)::DATE AS b FROM events), (SELECT unnest(range(50)) AS c)) f
    LEFT JOIN (SELECT event_type AS var, ts::DATE AS d, user_id % 10 AS x, (user_id // 10) % 5 AS y, round(sum(value), 2) AS v FROM events GROUP BY ALL) s
      ON s.var = f.var AND s.d = f.d AND s.x = f.x AND s.y = f.y)"""


def days(ts: Column) -> Column:
    """The time stamp ts days after 2000-01-01; seconds are counted in 64 bits, as 32 bits overflow from day 13,899 on."""
    return F.timestamp_seconds(F.lit(946684800) + ts.cast("long") * 86400)


def em(spark: SparkSession, sf_dir: str, member: int = 0) -> Dataset:
    """Embeddings as fields of 8 by 8 cells, a step each. A member has all of them, laid out from TURN cells further on."""
    t = _table(spark, sf_dir, "embeddings")
    rows = t.select(F.col("vec_id").cast("int").alias("ts"), F.posexplode("embedding").alias("i", "e")).withColumn("i", (F.col("i") + member * TURN) % 64)
    cells = rows.select(F.lit("emb").alias("var"), F.lit(0.0).alias("level"), "ts", days(F.col("ts")).alias("t"), (F.col("i") % 8).cast("int").alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.col("e").cast("double").alias("v"))
    return Dataset(cells, EM_GRID, VARIABLES["emb"], single=frozenset({"var", "level"}))


def em_sql(name: str = "em", member: int = 0) -> str:
    return f"""{name} AS (
    SELECT 'emb' AS var, 0.0 AS level, n AS ts, TIMESTAMP '2000-01-01' + to_days(n::INTEGER) AS t, i % 8 AS x, i // 8 AS y, e::DOUBLE AS v
    FROM (SELECT vec_id AS n, unnest(embedding) AS e, (generate_subscripts(embedding, 1) - 1 + {member * TURN}) % 64 AS i FROM embeddings))"""


def pl(spark: SparkSession, sf_dir: str) -> Dataset:
    """Mean prices of parts: sizes are levels, keys cells."""
    t = _table(spark, sf_dir, "part")
    cells = t.groupBy(
        F.substring("p_brand", 1, 7).alias("var"), F.col("p_size").cast("double").alias("level"), (F.col("p_partkey") % 4).cast("int").alias("x"), F.floor(F.col("p_partkey") / 4 % 4).cast("int").alias("y")
    ).agg(F.round(F.avg("p_retailprice"), 2).alias("v"))
    return Dataset(cells.withColumns({"ts": F.lit(0), "t": F.lit("2000-01-01").cast("timestamp")}), PL_GRID, single=frozenset({"ts"}))


PL_SQL = """pl AS (
    SELECT substring(p_brand, 1, 7) AS var, p_size::DOUBLE AS level, 0 AS ts, TIMESTAMP '2000-01-01' AS t,
           p_partkey % 4 AS x, (p_partkey // 4) % 4 AS y, round(avg(p_retailprice), 2) AS v
    FROM part GROUP BY ALL)"""

SQL = {"li": LI_SQL, "ev": EV_SQL, "evd": EVD_SQL, "em": em_sql(), "pl": PL_SQL} | {f"m{k}": em_sql(f"m{k}", k) for k in range(5)}
DATASETS = {"li": li, "ev": ev, "evd": evd, "em": em, "pl": pl} | {f"m{k}": (lambda s, d, k=k: em(s, d, k)) for k in range(5)}
