"""What shows only in larger tables: long time axes, many steps on few cells."""

from __future__ import annotations

import pytest

from isohyet import catalogue
from tests.conftest import SF, rows


@pytest.fixture(scope="module")
def late(spark, tmp_path_factory):
    """Embeddings that are dated up to the year 3684, as 6 GB of them are."""
    import duckdb

    path = tmp_path_factory.mktemp("late")
    duckdb.sql(f"COPY (SELECT CASE WHEN vec_id < 60 THEN vec_id ELSE 615000 + vec_id END AS vec_id, embedding, label FROM '{SF}/embeddings.parquet') TO '{path}/embeddings.parquet' (FORMAT parquet)")
    return str(path)


@pytest.fixture(scope="module")
def late_duck(late):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{late}/embeddings.parquet')")
    return con


@pytest.mark.parametrize("name", ["boxavg", "enlarge", "enlargegrid", "fldavg", "fldcor", "fldcovar", "ensbrs", "enscrps", "ensrkhist_time", "eofcoeff", "eofcoeff3d", "ml2pl"])
def test_dates_of_long_tables(spark, late, late_duck, name):
    assert rows(catalogue.queries()[name](spark, late).toPandas()) == rows(late_duck.sql(catalogue.oracle_sql()[name]).df())


@pytest.mark.parametrize(("name", "shift"), [("bandpass", 615000), ("fc2sp", 615000), ("fc2gp", 615000), ("dv2uv", 153750), ("dv2ps", 153750)])
def test_dates_after_2262_in_python(spark, late, sf, name, shift):
    query = catalogue.queries()[name]
    found = query(spark, late).toPandas()
    assert found["ts"].max() >= shift
    found["ts"] = found["ts"].where(found["ts"] < shift, found["ts"] - shift)
    assert rows(found) == rows(query(spark, sf).toPandas())


def test_fields_of_several_steps_go_through_at_once(spark):
    """Steps with gaps in their numbers, fields with missing and absent cells."""
    import datetime as dt

    import numpy as np

    from isohyet.dataset import Dataset
    from isohyet.functions.kernels import from_fourier, to_fourier
    from isohyet.grid import named

    grid, steps = named("r4x2"), (-3, 0, 1, 9_000, 9_001, 70_000)
    value = np.random.default_rng(1).normal(size=(len(steps), grid.ny, grid.nx))
    value[1, 0, 2] = value[2, 1, 1] = np.nan
    cells = [("v", 0.0, s, dt.datetime(2001, 1, 1) + dt.timedelta(days=s), x, y, None if np.isnan(value[i, y, x]) else float(value[i, y, x])) for i, s in enumerate(steps) for y in range(2) for x in range(4) if (i, y, x) != (2, 1, 1)]
    d = Dataset(spark.createDataFrame(cells, "var string, level double, ts int, t timestamp, x int, y int, v double"), grid, {"v": {}}, single=frozenset({"var", "level"}))
    got = d.gp2fc().fc2gp().cells.collect()
    assert len(got) == value.size
    for r in got:
        want = from_fourier(to_fourier(value[steps.index(r["ts"])]))[r["y"], r["x"]]
        assert r["t"] == dt.datetime(2001, 1, 1) + dt.timedelta(days=r["ts"])
        assert r["v"] is None if np.isnan(want) else r["v"] == pytest.approx(want)


def test_eof_of_many_steps_holds_no_matrix_of_steps(spark):
    """40,000 steps of two cells: their own matrix would take 12.8 GB."""
    from pyspark.sql import functions as F

    from isohyet.dataset import Dataset
    from isohyet.grid import named

    cells = spark.range(80_000).select(F.lit("v").alias("var"), F.lit(0.0).alias("level"), F.expr("cast(id div 2 as int)").alias("ts"), F.expr("timestamp_seconds((id div 2) * 86400)").alias("t"), F.expr("cast(id % 2 as int)").alias("x"), F.lit(0).alias("y"), F.expr("if(id % 2 = 0, 3.0, if(id % 4 = 1, 1.0, -1.0))").alias("v"))
    found, patterns = Dataset(cells, named("r2x1"), {"v": {}}, single=frozenset({"var", "level"})).eof(2, "off")
    assert [r["v"] for r in found.cells.orderBy("ts").collect()] == pytest.approx([4.5, 0.5])
    assert [r["v"] for r in patterns.cells.orderBy("ts", "x").collect()] == pytest.approx([2**0.5, 0, 0, 2**0.5])


@pytest.mark.parametrize("few", [1024, 0])
@pytest.mark.parametrize("steps", [4, 40])
@pytest.mark.parametrize("three", [False, True])
def test_eof_of_cells_and_of_steps(spark, monkeypatch, few, steps, three):
    """Two levels, weights, missing values: both matrices give the patterns of the whole one."""
    import datetime as dt

    import numpy as np

    from isohyet.dataset import Dataset
    from isohyet.grid import named
    from isohyet.operators import spectral

    monkeypatch.setattr(spectral, "FEW", few)
    grid, levels = named("r4x3"), (10.0, 500.0)
    x = np.random.default_rng(5).normal(size=(steps, 2, grid.ny, grid.nx))
    x[2, 1, 1, 1] = np.nan
    cells = [("v", levels[k], 7 * i, dt.datetime(2001, 1, 1) + dt.timedelta(days=i), c, r, None if np.isnan(x[i, k, r, c]) else float(x[i, k, r, c])) for i, k, r, c in np.ndindex(steps, 2, grid.ny, grid.nx)]
    d = Dataset(spark.createDataFrame(cells, "var string, level double, ts int, t timestamp, x int, y int, v double"), grid, {"v": {}}, single=frozenset({"var"}))
    found, patterns = spectral.eof(d, 2, three)
    got = {(r["level"], r["ts"], r["y"], r["x"]): r["v"] for r in patterns.cells.collect()}
    own = {(r["level"], r["ts"]): r["v"] for r in found.cells.collect()}
    w = np.broadcast_to(np.array(grid.row_weights())[:, None], (2, grid.ny, grid.nx))
    for group in [(0, 1)] if three else [(0,), (1,)]:
        flat, root = np.nan_to_num(x)[:, group].reshape(steps, -1), np.sqrt(w[list(group)].ravel())
        value, vector = np.linalg.eigh(flat.T @ flat * root * root[:, None] / (root**2).sum() / steps)
        for k in range(2):
            assert own[0.0 if three else levels[group[0]], k] == pytest.approx(value[-1 - k])
            want = vector[:, -1 - k] / root
            want = want * np.sign(want[np.argmax(abs(want))]) / np.sqrt((root**2 * want**2).sum()) * np.sqrt((root**2).sum())
            assert [got[levels[g], k, r, c] for g in group for r in range(grid.ny) for c in range(grid.nx)] == pytest.approx(list(want), abs=1e-9)


def test_growing_seasons_begin_and_end(spark, sf, tmp_path):
    """The query's seasons end within their years; each whose first half is there against a plain search, after 2262."""
    import datetime as dt
    from itertools import groupby

    import duckdb

    begin = (dt.date(2299, 7, 1) - dt.date(2000, 1, 1)).days
    duckdb.sql(f"COPY (SELECT {begin} + vec_id AS vec_id, embedding, label FROM '{sf}/embeddings.parquet') TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{tmp_path}/embeddings.parquet' ORDER BY vec_id").fetchall()
    want, others = {}, 0
    for cell in range(64):
        days = [(dt.date(2000, 1, 1) + dt.timedelta(n), e[cell]) for n, e in table]
        south = cell // 8 < 4
        year = lambda day: day.year - (south and day.month < 7)  # noqa: B023, E731
        for y, season in groupby(days, lambda d: year(d[0])):
            season = list(season)
            second = [d.month < 7 if south else d.month > 6 for d, _ in season]
            if second[0]:
                others += 1
                continue
            pairs = [(a > 0 and b > 0, a < 0 and b < 0) for (_, a), (_, b) in zip(season, season[1:])]
            start = next((k for k, (warm, _) in enumerate(pairs) if warm and not second[k]), None)
            end = None if start is None else next((k for k, (_, cold) in enumerate(pairs) if cold and second[k] and k > start), None)
            tail = start is not None and end is None and second[-1] and season[-1][1] < 0
            want[cell % 8, cell // 8, y] = 0 if start is None else (end if end is not None else len(season) - tail) - start
    got = {(r["x"], r["y"], r["ts"]): r["v"] for r in catalogue.queries()["eca_gsl"](spark, str(tmp_path)).collect()}
    assert {k: got.get(k) for k in want} == want
    assert len(got) == len(want) + others
    assert len(set(want.values())) > 20


def test_a_season_without_a_start(spark):
    import numpy as np

    from isohyet.functions.kernels import growing_season

    late = np.arange(10) > 4
    assert growing_season(np.array([1.0, 0, 1, np.nan, 1, 0, 0, 1, 1, 1]), late, 2, 0.5) == (0.0, None)
    assert growing_season(np.array([0.0, 1, 1, np.nan, 1, 0, 1, 0, 0, 1]), late, 2, 0.5) == (6.0, 1)
    assert growing_season(np.array([0.0, 1, 1, 1, 1, 1, 1, 1, 1, 0]), late, 2, 0.5) == (8.0, 1)


def test_extrapolation_below_the_lowest_level_is_written_once(spark, sf):
    """Repeated in one expression it makes a method too long for the JVM to compile, which took most of the time."""
    query = catalogue.queries()["ml2hl_lp"](spark, sf)
    assert query._jdf.queryExecution().optimizedPlan().toString().count("255.0") <= 3


@pytest.mark.parametrize("of_pressure", [False, True])
def test_columns_with_gaps_onto_pressure(spark, of_pressure):
    """A level that is not there is passed over, a missing value or surface pressure leaves values missing."""
    import datetime as dt

    from isohyet.dataset import Dataset
    from isohyet.grid import named

    def row(var, level, x, v):
        return (var, float(level), 0, dt.datetime(2001, 1, 1), x, 0, v)

    full = [10_000.0, 40_000.0, 70_000.0, 95_000.0]
    ps = [100_000.0, 100_000.0, None]
    cells = [row("q", k + 1, x, None if (k, x) == (0, 1) else full[k] / 1000) for k in range(4) for x in range(3) if (k, x) != (1, 0)]
    cells += [row("q", 9, 0, 1.0)]  # on no level
    if of_pressure:
        cells += [row("pressure", k + 1, x, full[k] if ps[x] else None) for k in range(4) for x in range(3)]
        cells += [row("deltap", 1, x, p) for x, p in enumerate(ps) if p]
    else:
        cells += [row("ps", 0, x, p) for x, p in enumerate(ps)]
    vct = (5_000.0, 15_000.0, 65_000.0, 75_000.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.15)
    d = Dataset(spark.createDataFrame(cells, "var string, level double, ts int, t timestamp, x int, y int, v double"), named("r3x1"), {}, vct=vct)
    out = (d.ap2pl if of_pressure else d.ml2pl)(20_000, 60_000, 99_000, 101_000)
    got = {(r["x"], r["level"]): r["v"] for r in out.cells.collect()}
    assert len(got) == 12
    assert [got[0, z] for z in (20e3, 60e3, 99e3, 101e3)] == [pytest.approx(20), pytest.approx(60), 95, None]
    assert [got[1, z] for z in (20e3, 60e3, 99e3, 101e3)] == [None, pytest.approx(60), 95, None]
    if not of_pressure:
        assert [got[2, z] for z in (20e3, 60e3, 99e3, 101e3)] == [None] * 4
