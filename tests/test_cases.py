"""Exact small cases, relations between operators, and round trips."""

from __future__ import annotations

import datetime as dt
import math

import pytest

from isohyet.dataset import Dataset
from isohyet.grid import Grid, named
from isohyet.plans.chain import run


def series(spark, values, start="2001-01-01", grid=None, var="v"):
    """One cell, a value a day; None is missing."""
    day = dt.datetime.fromisoformat(start)
    cells = spark.createDataFrame([(var, 0.0, i, day + dt.timedelta(days=i), 0, 0, None if v is None else float(v)) for i, v in enumerate(values)], "var string, level double, ts int, t timestamp, x int, y int, v double")
    return Dataset(cells, grid or Grid((0.0,), (45.0,)), {var: {}}, single=frozenset({"var", "level"}))


def field(spark, grid, f, var="v"):
    rows = [(var, 0.0, 0, dt.datetime(2001, 1, 1), x, y, f(x, y)) for x in range(grid.nx) for y in range(grid.ny)]
    cells = spark.createDataFrame(rows, "var string, level double, ts int, t timestamp, x int, y int, v double")
    return Dataset(cells, grid, {var: {}}, single=frozenset({"var", "level", "ts"}))


def values(d):
    return [r["v"] for r in d.cells.orderBy("var", "level", "ts", "y", "x").collect()]


C = 273.15


@pytest.mark.parametrize(
    ("op", "given", "expected"),
    [
        ("eca_fd", [None, None], None),
        ("eca_fd", [None, None, 1 + C], 0),
        ("eca_fd", [None, None, 1 + C, 1 + C, C - 1], 1),
        ("eca_fd", [None, None, 1 + C, 1 + C, C - 1, C - 1], 2),
        ("eca_su", [None, None], None),
        ("eca_su", [None, None, 26 + C, 24 + C, 26 + C, 24 + C], 2),
        ("eca_su,20", [None, None, 26 + C, 24 + C, 26 + C, 24 + C], 4),
        ("eca_su,30", [None, None, 26 + C, 24 + C, 26 + C, 24 + C], 0),
        ("timcount", [None, None], None),
        ("timcount", [None, None, 1, None, 1, 1], 3),
        ("timmean", [None, 1, 3], 2),
        ("timavg", [None, 1, 3], None),
        ("timvar1", [5], None),
        ("timpctl,50", [4, 1, 3, 2], 2),
    ],
)
def test_small_series(spark, op, given, expected):
    assert values(run(f"{op} in", {"in": series(spark, given)})) == [expected]


@pytest.mark.parametrize(("n", "expected"), [(1, None), (2, 0), (3, 0), (4, 1), (5, 1)])
def test_frost_days_without_snow(spark, n, expected):
    t = series(spark, [None, 1 + C, C - 1, C - 1, C - 1][:n])
    snow = series(spark, [0, 0, 1, 0, None][:n])
    assert values(t.fdns(snow)) == [expected]


def test_windchill(spark):
    got = values(series(spark, [-3.1102]).wct(series(spark, [1.9787])))
    assert got[0] == pytest.approx(-6.34597, abs=1e-5)


def test_zero_times_missing(spark):
    a, b = series(spark, [0, None, 2]), series(spark, [None, 0, None])
    assert values(a.mul(b)) == [0, 0, None]
    assert values(series(spark, [None, 1]).mulc(0)) == [0, 0]
    assert values(a.div(b)) == [None, None, None]


def test_constant_and_expression_agree(spark):
    d = series(spark, [1, 2, None], var="a")
    assert values(d.addc(2)) == values(run("expr,'b=a+2' in", {"in": d})) == values(d.add(series(spark, [2]).with_(single=frozenset({"var", "level", "ts"}))))


def test_growing_season(spark):
    land = field(spark, Grid((0.0,), (45.0,)), lambda x, y: 0.5)
    d = series(spark, [6 + C] * 7 + [C - 1] * 7, "2001-06-30")
    length, start = d.eca_gsl(land)
    assert values(length) == [7]
    assert values(start) == [181]


def test_sphere_area():
    for name in ("r36x18", "n16", "global_10"):
        assert sum(named(name).row_areas(1.0)) * named(name).nx == pytest.approx(4 * math.pi, rel=1e-9)


def test_detrend_is_subtrend_of_trend(spark):
    d = series(spark, [1, 4, 2, 8, 5])
    assert values(d.detrend()) == pytest.approx(values(d.subtrend(*d.trend())))


def test_spectral_round_trip(spark):
    g = named("n4")
    d = field(spark, g, lambda x, y: 1 + math.cos(math.radians(g.lons[x])) * math.cos(math.radians(g.lats[y])))
    assert values(d.gp2sp().sp2gp()) == pytest.approx(values(d), abs=1e-9)


def test_wind_round_trip(spark):
    g = named("n8")
    u = field(spark, g, lambda x, y: 10 * math.cos(math.radians(g.lats[y])), "u")
    v = field(spark, g, lambda x, y: 0.0, "v")
    both = u.with_(cells=u.cells.unionByName(v.cells))
    back = both.uv2dv().dv2uv()
    assert [round(r["v"], 6) for r in back.cells.where("var = 'u'").orderBy("y", "x").collect()] == [round(x, 6) for x in values(u)]


def test_conservative_remap_keeps_the_mean(spark):
    g = named("r8x4")
    d = field(spark, g, lambda x, y: float(x * y + 1))
    weigh = lambda d: sum(r["v"] * (math.sin(math.radians(d.grid.lat_edges()[r["y"] + 1])) - math.sin(math.radians(d.grid.lat_edges()[r["y"]]))) * (d.grid.lon_edges()[1] - d.grid.lon_edges()[0]) for r in d.cells.collect())
    assert weigh(d.remapcon("r12x6")) == pytest.approx(weigh(d))


def test_sea_water(spark):
    assert series(spark, [1]).cells is not None
    t, s = series(spark, [10.0], var="t"), series(spark, [35.0], var="s")
    both = t.with_(cells=t.cells.unionByName(s.cells))
    assert values(both.rhopot(0))[0] == pytest.approx(1026.952, abs=1e-3)
    warm = both.adisit(100)
    back = warm.with_(cells=warm.chname("to", "t").cells.unionByName(s.cells)).adipot(100)
    assert values(back)[0] == pytest.approx(10, abs=2e-3)


def test_histogram_percentile_is_near_the_exact_one(spark):
    d = series(spark, [i % 97 for i in range(400)])
    exact = values(d.timpctl(75))[0]
    assert values(d.timpctl(75, d.timmin(), d.timmax()))[0] == pytest.approx(exact, abs=2)


def test_chain_parser(spark):
    d = series(spark, [1, 2, 3])
    assert values(run("addc,1 -timmean in", {"in": d})) == [3]
    with pytest.raises(KeyError):
        run("nosuch in", {"in": d})
    with pytest.raises(ValueError, match="missing"):
        run("add in", {"in": d})


def test_binary_round_trip(spark, tmp_path):
    from isohyet.sources.formats import read_binary, to_binary

    d = series(spark, [1.5, None, 3], var="var7")
    to_binary(d, str(tmp_path / "out"))
    assert values(read_binary(spark, str(tmp_path / "out"))) == [1.5, None, 3]


def test_text_input(spark, tmp_path):
    from isohyet.sources.formats import input_text

    (tmp_path / "a.txt").write_text("1 2\n3 4 5 6")
    assert values(input_text(spark, str(tmp_path / "a.txt"), named("r2x1"))) == [1, 2, 3, 4, 5, 6]


def test_streaming_agrees_with_batch(spark, tmp_path):
    from isohyet.streaming.windows import periods

    d = series(spark, [1, 2, 3, 4], "2001-01-02")  # an even day since the epoch, where windows begin
    d.cells.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.cells.schema).parquet(str(tmp_path / "in"))
    query = periods(stream, "2 days", "1 day").writeStream.outputMode("complete").format("memory").queryName("two_days").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["mean"] for r in spark.table("two_days").collect()) == [1.5, 3.5]


def test_eof_against_the_whole_matrix(spark):
    import numpy as np

    grid, steps = named("r4x3"), 5
    x = np.random.default_rng(3).normal(size=(steps, grid.ny, grid.nx))
    x[2, 1, 1] = np.nan
    rows = [("v", 0.0, i, dt.datetime(2001, 1, 1) + dt.timedelta(days=i), c, r, None if np.isnan(x[i, r, c]) else float(x[i, r, c])) for i in range(steps) for r in range(grid.ny) for c in range(grid.nx)]
    d = Dataset(spark.createDataFrame(rows, "var string, level double, ts int, t timestamp, x int, y int, v double"), grid, {"v": {}}, single=frozenset({"var", "level"}))
    found, patterns = d.eof(2, "off")
    flat = np.nan_to_num(x).reshape(steps, -1)
    value, vector = np.linalg.eigh(flat.T @ flat / flat.shape[1] / steps)
    assert values(found) == pytest.approx(value[::-1][:2])
    for k in range(2):
        got = np.array([r["v"] for r in patterns.cells.where(f"ts = {k}").orderBy("y", "x").collect()])
        want = vector[:, -1 - k] * math.sqrt(flat.shape[1])
        assert abs(got) == pytest.approx(abs(want), abs=1e-9)
        assert got[np.argmax(abs(got))] > 0


def test_a_set_date_ends_with_its_month(spark):
    d = series(spark, [1, 2], start="2000-02-28")
    days = lambda o: [str(r["t"].date()) for r in o.cells.orderBy("ts").collect()]
    assert days(d.setyear(2003)) == ["2003-02-28", "2003-02-28"]
    assert days(d.setday(31)) == ["2000-02-29", "2000-02-29"]
    assert days(d.setmon(3)) == ["2000-03-28", "2000-03-29"]
