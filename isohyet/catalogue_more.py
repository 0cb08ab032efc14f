"""More registered queries: an atmosphere on hybrid levels made from the embeddings, and what takes more than a chain."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from isohyet.catalogue import _QUERIES, _SQL, COLUMNS, _add, _listing, _sql
from isohyet.plans import adapters
from isohyet.plans.adapters import EM_GRID, em_sql

VCT = (0.0, 5000.0, 10000.0, 5000.0, 0.0, 0.0, 0.0, 0.2, 0.6, 1.0)
#: Variables by level, and at the surface, from a value e of the embeddings.
UPPER = {"t": "280 + 20 * e", "q": "0.005 + 0.001 * e", "omega": "0.1 * e", "u": "5 + e", "v": "2 * e", "s": "35 + e", "aclcac": "least(greatest(0.5 + e, 0), 1)"}
SURFACE = {"ps": "100000 + 500 * e", "geosp": "1000 * (1 + e)"}


def atm(spark: SparkSession, sf_dir: str):  # noqa: ANN201
    """Four levels a step, from all embeddings in turn."""
    from pyspark.sql import functions as F

    base = adapters.em(spark, sf_dir)
    own = base.cells.select(F.floor(F.col("ts") / 4).cast("int").alias("ts"), (F.col("ts") % 4 + 1).cast("double").alias("level"), "x", "y", F.col("v").alias("e"))
    upper = F.array(*[F.struct(F.lit(n).alias("var"), F.expr(x).cast("double").alias("v")) for n, x in UPPER.items()])
    lower = F.array(*[F.struct(F.lit(n).alias("var"), F.expr(x).cast("double").alias("v")) for n, x in SURFACE.items()])
    rows = own.withColumn("r", F.explode(upper)).select("r.var", "level", "ts", "x", "y", "r.v").unionByName(own.where("level = 1").withColumn("r", F.explode(lower)).select("r.var", F.lit(0.0).alias("level"), "ts", "x", "y", "r.v"))
    cells = rows.withColumn("t", adapters.days(F.col("ts")))
    return base.of(cells, vct=VCT, variables={n: {} for n in [*UPPER, *SURFACE]}).with_(single=frozenset())


ATM_SQL = em_sql("m0") + ", own AS (SELECT ts // 4 AS ts, ts % 4 + 1 AS level, x, y, v AS e FROM m0)"
_UP = ", ".join(f"{x} AS {n}" for n, x in UPPER.items())
_LOW = ", ".join(f"{x} AS {n}" for n, x in SURFACE.items())
ATM_SQL += f", up AS (SELECT ts, level, x, y, {_UP} FROM own), low AS (SELECT ts, x, y, {_LOW} FROM own WHERE level = 1)"
adapters.SQL["atm"] = ATM_SQL
adapters.DATASETS["atm"] = atm

_HALF = ", ".join(f"({k + 1}, {VCT[k]}, {VCT[k + 5]}, {VCT[k + 1] if k < 4 else 'NULL'}, {VCT[k + 6] if k < 4 else 'NULL'})" for k in range(5))
_LEVELS = f"(VALUES {_HALF}) h(k, a, b, a2, b2)"


def _polynomial(coefficients: tuple[float, ...], t: str) -> str:
    out = repr(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = f"(({out}) * {t} + {c!r})"
    return out


def _sea_water(table: dict[str, tuple[float, ...]]) -> dict[str, str]:
    return {k: _polynomial(c, "(t - 270)") for k, c in table.items()}


def _physics() -> None:
    """SQL of the sea-water formulas from the same tables of constants."""
    from isohyet.functions.constants import BRYDEN, STATE

    d, s, r, p = _sea_water(STATE), "greatest(s, 0)", "sqrt(pow(greatest(s, 0), 3))", "100.0"
    surface = f"({d['a']} + {s} * {d['b']} + {r} * {d['c']} + {d['d']} * {s} * {s})"
    modulus = f"({d['e']} + {s} * {d['f']} + {r} * {d['g']} + {p} * ({d['h']} + {s} * {d['i']} + {r} * {d['j']}) + {p} * {p} * ({d['k']} + {s} * {d['m']}))"
    body = "SELECT '{var}' AS var, level, ts, x, y, {v} AS v FROM up"
    chain = "-aexpr,'t=t-270' -selname,t,s atm"
    _add("rhopot", f"rhopot,100 {chain}", "atm", body.format(var="rhopoto", v=f"{surface} / (1 - {p} / {modulus})"))
    b = _sea_water(BRYDEN)
    cooling = f"{p} * ({b['a']} + (s - 35) * {b['b']} + {p} * ({b['c']} - {b['d']} * (s - 35) + {p} * {b['e']}))"
    _add("adipot", f"adipot,100 {chain}", "atm", body.format(var="tho", v=f"(t - 270) - {cooling}"))
    _add("adisit", f"adisit,100 {chain}", "atm", None)


_physics()
_P = "SELECT '{n}' AS var, h.k AS level, ts, x, y, {v} AS v FROM low, " + _LEVELS + " WHERE {w}"
_add("pressure_hl", "pressure_hl atm", "atm", _P.format(n="pressure", v="a + b * ps", w="TRUE"))
_add("pressure_fl", "pressure_fl atm", "atm", _P.format(n="pressure", v="(a + b * ps + a2 + b2 * ps) / 2", w="k < 5"))
_add("deltap", "deltap atm", "atm", _P.format(n="deltap", v="a2 + b2 * ps - (a + b * ps)", w="k < 5"))
_add("vertwind", "vertwind -merge atm -pressure_fl atm", "atm", f"SELECT 'wz' AS var, k AS level, l.ts, l.x, l.y, omega / (9.80665 * ((a + b * ps + a2 + b2 * ps) / 2 / (287.05 * t * (1 + 0.608 * q)))) AS v FROM low l JOIN {_LEVELS} ON h.k < 5 LEFT JOIN up u ON (u.ts, u.x, u.y, u.level) = (l.ts, l.x, l.y, h.k)")
_ON = f"FROM up JOIN low USING (ts, x, y) JOIN {_LEVELS} ON h.k = level"
_add("gheight", "gheight atm", "atm", f"""
    SELECT 'zh' AS var, k AS level, ts, x, y, CASE WHEN count(t) OVER (PARTITION BY ts, x, y) = 4 THEN geosp / 9.80665
           + sum(287.05 / 9.80665 * t * (1 + 0.608 * q) * ln((a2 + b2 * ps) / greatest(a + b * ps, 0.1))) OVER (PARTITION BY ts, x, y ORDER BY k DESC) END AS v
    FROM low JOIN {_LEVELS} ON h.k < 5 LEFT JOIN (SELECT ts, x, y, level AS k, t, q FROM up) USING (ts, x, y, k)""")
_add("sealevelpressure", "sealevelpressure atm", "atm", f"""
    WITH low_ AS (SELECT ts, x, y, geosp AS g, ps, (1 + 287.05 * 0.0065 / 9.80665 * (ps / ((a + b * ps + ps) / 2) - 1)) * t AS raw {_ON} WHERE k = 4),
    mild AS (SELECT *, CASE WHEN raw < 255 THEN (255 + raw) / 2 ELSE raw END AS s FROM low_),
    sea AS (SELECT *, s + 0.0065 / 9.80665 * g AS m FROM mild),
    drawn AS (SELECT *, CASE WHEN m > 290.5 AND s > 290.5 THEN (290.5 + s) / 2 ELSE s END AS s2, CASE WHEN m > 290.5 AND s > 290.5 THEN (290.5 + s) / 2 WHEN m > 290.5 THEN 290.5 ELSE m END AS m2 FROM sea),
    powers AS (SELECT *, g / (287.05 * s2) AS p, (m2 - s2) / s2 AS q FROM drawn)
    SELECT 'psl' AS var, 0 AS level, ts, x, y, CASE WHEN abs(g) < 1e-4 THEN ps ELSE ps * exp(p * (1 - q / 2 + q * q / 3)) END AS v FROM powers""")
for _n, _a in (("cloudlayer", ""), ("uv2dv", ""), ("uv2dvl", ""), ("rotuvb", ",u,v"), ("mrotuvb", ""), ("mrotuv", "")):
    _add(_n, f"{_n}{_a} atm", "atm", None)
_add("dv2uv", "dv2uv -uv2dv atm", "atm", None)
_add("dv2uvl", "dv2uvl -uv2dvl atm", "atm", None)
_add("dv2ps", "dv2ps -uv2dv atm", "atm", None)
_add("mastrfu", "mastrfu -zonmean -selname,v atm", "atm", """
    WITH zonal AS (SELECT ts, y, level, avg(v) AS v FROM up GROUP BY ALL),
    layers AS (SELECT *, coalesce((v + lag(v) OVER w) * (level - lag(level) OVER w), 0) AS s FROM zonal WINDOW w AS (PARTITION BY ts, y ORDER BY level))
    SELECT 'v' AS var, level, ts, 0 AS x, y, pi() * 6371000 / 9.80665 * cos(radians(-78.75 + 22.5 * y)) * sum(s) OVER (PARTITION BY ts, y ORDER BY level) AS v FROM layers""")
#: Above the top full level, between levels, below the lowest one, and below ground.
_GOALS = {"ml2pl": ["101500", "100100", "97000", "90000", "50000", "20000", "1500"], "ml2hl": ["-50", "150", "400", "1000", "5000", "30000"], "ap2pl": ["112000", "101500", "97000", "90000", "50000", "1500"]}


def _onto_sql(kind: str, extrapolate: bool, logarithmic: bool, names: str) -> str:
    """Full levels numbered from the top; each target with the last one above it and the next."""
    goals = _GOALS[kind]
    at = "ln({})" if logarithmic else "{}"
    pressure = "101325.0 * exp(-z / 7000.0)" if kind == "ml2hl" else "z"
    long = " UNION ALL ".join(f"SELECT '{n}' AS var, ts, x, y, level, {n} AS v FROM up" for n in names.split(","))
    ground = at.format("110000.0" if kind == "ap2pl" else "ps")
    star = "(1 + 287.05 * 0.0065 / 9.80665 * (s / p - 1)) * v"
    return f"""
        WITH long AS ({long}), goal AS (SELECT z::DOUBLE AS z, {at.format(pressure)} AS pz FROM (VALUES {", ".join(f"({z}.0)" for z in goals)}) g(z)),
        full_ AS (
            SELECT var, l.ts, l.x, l.y, level, v, {at.format("((a + b * ps + a2 + b2 * ps) / 2)")} AS p, {ground} AS s, {"geosp" if kind != "ap2pl" else "0"} AS g
            FROM long l JOIN low USING (ts, x, y) JOIN {_LEVELS} ON h.k = level
        ),
        found AS (SELECT var, ts, x, y, z, pz, any_value(s) AS s, any_value(g) AS g, greatest(count(*) FILTER (WHERE p < pz), 1) AS k FROM full_, goal GROUP BY ALL),
        pair AS (
            SELECT f.*, c.p, c.v, n.p AS p2, n.v AS v2 FROM found f JOIN full_ c ON (c.var, c.ts, c.x, c.y, c.level) = (f.var, f.ts, f.x, f.y, f.k)
            LEFT JOIN full_ n ON (n.var, n.ts, n.x, n.y, n.level) = (f.var, f.ts, f.x, f.y, f.k + 1)
        ),
        warm AS (SELECT *, {star} AS raw, CASE WHEN {star} < 255 THEN (255 + {star}) / 2 ELSE {star} END AS mild, g / 9.80665 AS h FROM pair),
        drawn AS (
            SELECT *, CASE WHEN mild > 290.5 AND mild + 0.0065 * h > 290.5 THEN (290.5 + mild) / 2 ELSE mild END AS near,
                   CASE WHEN h > 2000 AND raw + 0.0065 * h > 298 THEN CASE WHEN h < 2500 THEN 0.002 * ((2500 - h) * (raw + 0.0065 * h) + (h - 2000) * 298) ELSE 298 END ELSE raw + 0.0065 * h END AS sea
            FROM warm
        ),
        lapse AS (SELECT *, CASE WHEN sea - raw < 1e-6 THEN 0 WHEN abs(g) > 1e-4 THEN 287.05 * (sea - raw) / g ELSE 287.05 * 0.0065 / 9.80665 END * ln(pz / s) AS q FROM drawn)
        SELECT var, z AS level, ts, x, y,
               CASE WHEN {"FALSE" if extrapolate else "pz > s"} THEN NULL WHEN v2 IS NOT NULL THEN v + (pz - p) * (v2 - v) / (p2 - p)
                    WHEN var <> 't' OR {"TRUE" if kind == "ap2pl" else "FALSE"} THEN v WHEN pz <= s THEN ((s - pz) * v + (pz - p) * near) / (s - p)
                    ELSE raw * (1 + q * (1 + q * (0.5 + q / 6))) END AS v
        FROM lapse"""


for _kind in _GOALS:
    for _log in ("", "_lp"):
        for _x in ("", "x"):
            _names = "q,u" if _x and _log and _kind != "ap2pl" else "t,q,u"
            _from = f"-merge -selname,{_names} atm -pressure_fl atm" if _kind == "ap2pl" else f"-selname,{_names},ps,geosp atm"
            _add(f"{_kind}{_x}{_log}", f"{_kind}{_x}{_log},{','.join(_GOALS[_kind])} {_from}", "atm", _onto_sql(_kind, bool(_x), bool(_log), _names))
_PASS = "SELECT * FROM m0"
_add("complextorect", "complextorect m0", "m0", _PASS)
_add("imtocomplex", "imtocomplex m0", "m0", _PASS, pick=1)
_add("complextopol", "complextopol m0 m1", "m0 m1", "SELECT a.var, a.level, a.ts, a.x, a.y, sqrt(a.v * a.v + b.v * b.v) AS v FROM m0 a JOIN m1 b USING (ts, x, y)")
_add("enlargegrid", "enlargegrid,r8x8 -selindexbox,2,4,1,8 -setgrid,r8x8 m0", "m0", "SELECT var, level, ts, x, y, CASE WHEN x BETWEEN 1 AND 3 THEN v END AS v FROM m0")
_add("intyear", "intyear,1996 -selyear,1995 li -selyear,1997 li", "li", "SELECT a.var, a.level, a.ts, a.x, a.y, (a.v + b.v) / 2 AS v FROM (SELECT * FROM li WHERE year(t) = 1995) a JOIN (SELECT * FROM li WHERE year(t) = 1997) b ON (a.var, a.level, a.x, a.y) = (b.var, b.level, b.x, b.y) AND strftime(a.t, '%m-%d') = strftime(b.t, '%m-%d')")
for _n, _k in (("change_e5slm", "l"), ("change_e5lsm", "(l >= 0.5)::INT"), ("change_e5mask", "CASE WHEN l < 0.5 THEN 0 ELSE v END")):
    _add(_n, f"{_n} m0 -gtc,0 -seltimestep,1 m1", "m0 m1", f"SELECT a.var, a.level, a.ts, a.x, a.y, {_k} AS v FROM m0 a JOIN (SELECT x, y, (v > 0)::INT AS l FROM m1 WHERE ts = 0) USING (x, y)")
_add("eofcoeff", "eofcoeff -timmean m0 m0", "m0", "SELECT a.var || '_0' AS var, a.level, a.ts, 0 AS x, 0 AS y, sum(a.v * p.v) AS v FROM m0 a JOIN (SELECT x, y, avg(v) AS v FROM m0 GROUP BY ALL) p USING (x, y) GROUP BY a.var, a.level, a.ts")
_add("eofcoeff3d", "eofcoeff3d -timmean m0 m0", "m0", "SELECT a.var, 0 AS level, a.ts, 0 AS x, 0 AS y, sum(a.v * p.v) AS v FROM m0 a JOIN (SELECT x, y, avg(v) AS v FROM m0 GROUP BY ALL) p USING (x, y) GROUP BY a.var, a.ts")
_add("pack", "pack m0", "m0", "SELECT var, level, ts, x, y, round((v - lo) / s) * s + lo AS v FROM (SELECT *, min(v) OVER () AS lo, (max(v) OVER () - min(v) OVER ()) / 65534 AS s FROM m0)")
_add("fc2sp", "fc2sp -gp2fc -setgrid,n2 -selindexbox,1,8,1,4 m0", "m0", None)
_add("gp2spl", "gp2spl -setgrid,n2 -selindexbox,1,8,1,4 m0", "m0", None)
_add("sp2gpl", "sp2gpl -gp2spl -setgrid,n2 -selindexbox,1,8,1,4 m0", "m0", None)
_add("sp2fc", "sp2fc -gp2sp -setgrid,n2 -selindexbox,1,8,1,4 m0", "m0", None)


_ROW = "([" + ", ".join(repr(w) for w in EM_GRID.row_weights()) + "])[y + 1]"


def _call(key: str, sets: str, f: Any, body: str | None) -> None:
    """Queries whose arguments are not text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from isohyet.session import ship

        ship(spark)
        out = f(*[adapters.DATASETS[s](spark, sf_dir) for s in sets.split()])
        return out.table() if hasattr(out, "cells") else out

    _QUERIES[key] = run
    if body:
        _SQL[key] = _sql(sets, body, COLUMNS)


_call("maskregion", "em", lambda d: d.maskregion([(40, -60), (200, -60), (200, 60), (40, 60)]), "SELECT var, level, ts, x, y, CASE WHEN 45 * x >= 40 AND 45 * x < 200 AND -78.75 + 22.5 * y BETWEEN -60 AND 60 THEN v END AS v FROM em")


def _described(key: str, f: Any, note: Any, expected: str) -> None:
    """Queries over em whose arguments are not text; beside the values, what the operator did to a description."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.sql import functions as F

        out = f(adapters.DATASETS["em"](spark, sf_dir))
        return out.table().withColumn("note", F.lit(note(out)))

    _QUERIES[key] = run
    _SQL[key] = _sql("em", f"SELECT *, '{expected}' AS note FROM em", COLUMNS + ", note")


def _two(d: Any, key: str) -> Any:
    """The fields under two names that differ in what *key* says."""
    return d.merge(d.setname("b")).with_(variables={"emb": {key: "first"}, "b": {key: "second"}})


def _script(text: str) -> str:
    import os
    import tempfile

    path = os.path.join(tempfile.mkdtemp(), "script")  # read on the driver, when the query is made
    with open(path, "w") as f:
        f.write(text)
    return path


def _path(d: Any) -> DataFrame:
    """Three points of a path: between four cells and two days, across the date line of the grid, and on a centre."""
    rows = [("2000-01-03 06:00:00", 100.0, 20.0), ("2000-01-05 12:00:00", 350.0, -40.0), ("2000-01-07 00:00:00", 45.0, 11.25)]
    return d.cells.sparkSession.createDataFrame(rows, "t string, lon double, lat double").selectExpr("cast(t as timestamp) AS t", "lon", "lat")


_call("selgrid", "em", lambda d: _two(d, "grid").selgrid("first"), "SELECT * FROM em")
_call("selzaxis", "em", lambda d: _two(d, "zaxis").selzaxis("first"), "SELECT * FROM em")
_call("exprf", "li", lambda d: d.exprf(_script("s=A+2*N;\nr=(A>N)?A:N # the larger\n")), None)
_call("aexprf", "li", lambda d: d.aexprf(_script("s=sqrt(A)*2")), None)
_SQL["exprf"], _SQL["aexprf"] = _SQL["expr"], _SQL["aexpr"]
_call("intgridtraj", "em", lambda d: d.intgridtraj(_path(d)), """
    SELECT var, level, epoch(p.t)::BIGINT AS ts, 0 AS x, 0 AS y,
           sum(v * greatest(0, 1 - abs(e.x + k - lon / 45)) * greatest(0, 1 - abs(e.y - (lat + 78.75) / 22.5)) * greatest(0, 1 - abs(e.ts - epoch(p.t - TIMESTAMP '2000-01-01') / 86400.0))) AS v
    FROM em e, (VALUES (0), (8)) r(k), (VALUES (TIMESTAMP '2000-01-03 06:00:00', 100.0, 20.0), (TIMESTAMP '2000-01-05 12:00:00', 350.0, -40.0), (TIMESTAMP '2000-01-07 00:00:00', 45.0, 11.25)) p(t, lon, lat)
    GROUP BY var, level, p.t""")
_listing("ncode", "ncode li", "li", ["n"], "SELECT count(DISTINCT var) AS n FROM li")
_listing("showformat", "showformat li", "li", ["value"], "SELECT 'parquet' AS value")
_listing("filedes", "filedes -setgatt,title,x em", "em", ["name", "value"], "SELECT 'title' AS name, 'x' AS value")
for _n in ("vct", "vct2"):
    _listing(_n, f"{_n} atm", "atm", ["k", "a", "b"], f"SELECT (k - 1)::BIGINT AS k, round(a, 4)::DOUBLE AS a, round(b, 4)::DOUBLE AS b FROM {_LEVELS}")
_described("setgridmask", lambda d: d.setgridmask([1] * 63 + [0]), lambda d: str(sum(d.grid.mask)), "63")
_call("setgridarea", "em", lambda d: d.setgridarea([1.0] * EM_GRID.size).fldmean(), "SELECT var, level, ts, 0 AS x, 0 AS y, avg(v) AS v FROM em GROUP BY ALL")
_described("setgatts", lambda d: d.setgatts({"a": "b", "c": "d"}), lambda d: ",".join(f"{k}={v}" for k, v in sorted(d.attrs.items())), "a=b,c=d")
_call("setpartabn", "m0", lambda d: d.setpartabn([{"name": "emb", "factor": 2}], "convert"), "SELECT * REPLACE (2 * v AS v) FROM m0")
_call("setpartabc", "m0", lambda d: d.setpartabc([{"code": 130, "factor": 3}], "convert"), "SELECT * REPLACE (3 * v AS v) FROM m0")
_call("setpartabp", "m0", lambda d: d.setpartabp([{"param": "130.128", "factor": 4}], "convert"), "SELECT * REPLACE (4 * v AS v) FROM m0")
_described("setpartab", lambda d: d.setpartab([{"code": 130, "unit": "K"}]), lambda d: str(d.variables["emb"]["unit"]), "K")
_call("setrcaname", "m0", lambda d: d.setrcaname([{"code": 130, "out_name": "new"}]), "SELECT * REPLACE ('new' AS var) FROM m0")
_call("remap", "m0", lambda d: d.remap("r12x6", d.gennn("r12x6")), None)
_SQL["remap"] = _SQL["remapnn"]
_call("remapeta", "atm", lambda d: d.remapeta((0.0, 20000.0, 0.0, 0.0, 0.3, 1.0)), None)
_call("trms", "m0 m1 m2", lambda a, b, p: a.trms(b, p.abs()), f"SELECT a.var, 0 AS level, a.ts, 0 AS x, 0 AS y, sqrt(sum(w * abs(p.v) * (a.v - b.v) * (a.v - b.v)) / sum(w * abs(p.v))) AS v FROM (SELECT *, {_ROW} AS w FROM m0) a JOIN m1 b USING (ts, x, y) JOIN m2 p USING (ts, x, y) GROUP BY a.var, a.ts")
_call("intlevel3d", "pl", lambda d: d.intlevel3d(_heights(d), _heights(d).where(_level(d))), None)
_call("intlevelx3d", "pl", lambda d: d.intlevelx3d(_heights(d), _heights(d).where(_level(d))), None)


def _heights(d: Any) -> Any:
    from pyspark.sql import functions as F

    return d.map(F.col("level") * 10.0).where(F.col("var") == "Brand#1")


def _level(d: Any) -> Any:
    from pyspark.sql import functions as F

    return F.col("level") == 20.0

for _n in ("outputcenter", "outputcenter2", "outputcentercpt"):
    _listing(_n, f"{_n} li", "li", ["lon", "lat", "value"], "SELECT 18.0::DOUBLE + 36 * x AS lon, -81.0::DOUBLE + 18 * y AS lat, v AS value FROM li")
for _n in ("outputbounds", "outputboundscpt", "outputtri"):
    _listing(_n, f"{_n} m0", "m0", ["ts", "value"], "SELECT ts::BIGINT AS ts, round(v, 4) AS value FROM m0")
_listing("outputvector", "outputvector atm", "atm", ["level", "lon", "lat", "speed", "direction"], "SELECT level::DOUBLE AS level, 45.0::DOUBLE * x AS lon, -78.75::DOUBLE + 22.5 * y AS lat, round(sqrt(u * u + v * v), 4) AS speed, round(degrees(atan2(v, u)), 4) AS direction FROM up")
