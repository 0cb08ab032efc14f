"""The registered queries of the gridded operators: each over a whole adapted table, with SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from isohyet.plans import adapters
from isohyet.plans.adapters import EM_GRID, SQL
from isohyet.session import ship

FLAGSHIP = "ymonmean"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

COLUMNS = "var, level::DOUBLE AS level, ts::BIGINT AS ts, x::BIGINT AS x, y::BIGINT AS y, round(v::DOUBLE + 3.1e-7, 4) AS v"
KEYS = "var, level, x, y"


def _sql(sets: str, body: str, columns: str = COLUMNS, more: str = "") -> str:
    parts = [SQL[s] for s in sets.split()]
    return f"WITH {', '.join(parts + ([more] if more else []))} SELECT {columns} FROM ({body})"


def _add(key: str, chain: str, sets: str, body: str | None, columns: str = COLUMNS, more: str = "", pick: int = 0, name: str | None = None) -> None:
    """A query that runs a chain over adapted tables; body: SQL for its rows, or None."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from isohyet.plans.chain import run as run_chain

        ship(spark)
        inputs = {s: adapters.DATASETS[s](spark, sf_dir) for s in set(sets.split())}
        out: Any = run_chain(chain, inputs, spark)
        if isinstance(out, (tuple, list)):
            out = out[pick]
        return out.table() if hasattr(out, "table") and hasattr(out, "cells") else out

    _QUERIES[key] = run
    if body is not None:
        _SQL[key] = _sql(sets, body, columns, more)


def _noted(key: str, chain: str, sets: str, note: Callable[[Any], dict[str, str] | str], body: str) -> None:
    """A query that runs a chain; its rows tell beside the values what the operator did to a description. body: SQL with a column note."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.sql import functions as F

        from isohyet.plans.chain import run as run_chain

        ship(spark)
        out: Any = run_chain(chain, {s: adapters.DATASETS[s](spark, sf_dir) for s in set(sets.split())}, spark)
        told = note(out)
        column = F.lit(told) if isinstance(told, str) else F.coalesce(*[F.when(F.col("var") == n, F.lit(x)) for n, x in told.items()], F.lit("none"))
        return out.table().withColumn("note", column)

    _QUERIES[key] = run
    _SQL[key] = _sql(sets, body, COLUMNS + ", note")


def _variables(key: str) -> Callable[[Any], dict[str, str]]:
    return lambda d: {n: str(m.get(key)) for n, m in d.variables.items()}


def _each(sets: str, ops: dict[str, tuple[str, str]]) -> None:
    """Operators on single values: arguments and the SQL expression."""
    for name, (args, value) in ops.items():
        first = sets.split()[0]
        _add(name, f"{name}{args} {first}", sets, f"SELECT var, level, ts, x, y, {value} AS v FROM {first}")


_each(
    "em",
    {
        "abs": ("", "abs(v)"),
        "int": ("", "trunc(v)"),
        "sqr": ("", "v * v"),
        "sqrt": ("", "CASE WHEN v >= 0 THEN sqrt(v) END"),
        "exp": ("", "exp(v)"),
        "ln": ("", "CASE WHEN v > 0 THEN ln(v) WHEN v = 0 THEN '-inf'::DOUBLE END"),
        "log10": ("", "CASE WHEN v > 0 THEN log10(v) WHEN v = 0 THEN '-inf'::DOUBLE END"),
        "sin": ("", "sin(v)"),
        "cos": ("", "cos(v)"),
        "tan": ("", "tan(v)"),
        "asin": ("", "CASE WHEN abs(v) <= 1 THEN asin(v) END"),
        "acos": ("", "CASE WHEN abs(v) <= 1 THEN acos(v) END"),
        "atan": ("", "atan(v)"),
        "mulcoslat": ("", "v * cos(radians(-78.75 + 22.5 * y))"),
        "divcoslat": ("", "v / cos(radians(-78.75 + 22.5 * y))"),
        "masklonlatbox": (",90,200,-40,60", "CASE WHEN 45 * x BETWEEN 90 AND 200 AND -78.75 + 22.5 * y BETWEEN -40 AND 60 THEN v END"),
        "maskindexbox": (",2,5,3,6", "CASE WHEN x BETWEEN 1 AND 4 AND y BETWEEN 2 AND 5 THEN v END"),
        "setclonlatbox": (",9,90,200,-40,60", "CASE WHEN 45 * x BETWEEN 90 AND 200 AND -78.75 + 22.5 * y BETWEEN -40 AND 60 THEN 9 ELSE v END"),
        "setcindexbox": (",9,7,2,1,8", "CASE WHEN x >= 6 OR x <= 1 THEN 9 ELSE v END"),
    },
)
_each(
    "li",
    {
        "nint": ("", "CASE WHEN v < 0 THEN ceil(v - 0.5) ELSE floor(v + 0.5) END"),
        "reci": ("", "1 / nullif(v, 0)"),
        "pow": (",1.5", "pow(v, 1.5)"),
        "addc": (",2.5", "v + 2.5"),
        "subc": (",2.5", "v - 2.5"),
        "mulc": (",0", "0.0"),
        "divc": (",4", "v / 4"),
        "mod": (",7", "v % 7"),
        "eqc": (",20", "(v = 20)::INT"),
        "nec": (",20", "(v <> 20)::INT"),
        "lec": (",20", "(v <= 20)::INT"),
        "ltc": (",20", "(v < 20)::INT"),
        "gec": (",20", "(v >= 20)::INT"),
        "gtc": (",20", "(v > 20)::INT"),
        "ifthenc": (",3", "CASE WHEN v <> 0 THEN 3 END"),
        "ifnotthenc": (",3", "CASE WHEN v = 0 THEN 3 END"),
        "setctomiss": (",20", "nullif(v, 20)"),
        "setmissval": (",20", "nullif(v, 20)"),
        "setmisstoc": (",-1", "coalesce(v, -1)"),
        "setrtomiss": (",10,20", "CASE WHEN NOT v BETWEEN 10 AND 20 THEN v END"),
        "setvrange": (",10,20", "CASE WHEN v BETWEEN 10 AND 20 THEN v END"),
        "setvals": (",10,1,20,2", "CASE WHEN v = 10 THEN 1 WHEN v = 20 THEN 2 ELSE v END"),
        "setrtoc": (",10,20,5", "CASE WHEN v BETWEEN 10 AND 20 THEN 5 ELSE v END"),
        "setrtoc2": (",10,20,5,6", "CASE WHEN v BETWEEN 10 AND 20 THEN 5 WHEN v IS NOT NULL THEN 6 END"),
        "muldpm": ("", "v * day(last_day(t))"),
        "divdpm": ("", "v / day(last_day(t))"),
        "muldpy": ("", "v * (CASE WHEN year(t) % 4 = 0 THEN 366 ELSE 365 END)"),
        "divdpy": ("", "v / (CASE WHEN year(t) % 4 = 0 THEN 366 ELSE 365 END)"),
        "muldoy": ("", "v * dayofyear(t)"),
    },
)
_SQL["mulc"] = _sql("li", "SELECT var, level, ts, x, y, 0.0 AS v FROM li")

# Selection

for _n, _a, _w in (
    ("selname", "A,R", "var IN ('A', 'R')"),
    ("delname", "A", "var <> 'A'"),
    ("selcode", "1,3", "var IN ('A', 'R')"),
    ("delcode", "1", "var <> 'A'"),
    ("selparam", "2.1", "var = 'N'"),
    ("delparam", "2.1", "var <> 'N'"),
    ("sellevel", "2", "level = 2"),
    ("selyear", "1996,1998", "year(t) IN (1996, 1998)"),
    ("selmon", "1/3", "month(t) BETWEEN 1 AND 3"),
    ("selday", "1,15", "day(t) IN (1, 15)"),
    ("selseas", "DJF", "month(t) IN (12, 1, 2)"),
    ("seldate", "1996-02-01,1996-03-15", "t >= DATE '1996-02-01' AND t < DATE '1996-03-16'"),
    ("del29feb", "", "NOT (month(t) = 2 AND day(t) = 29)"),
    ("delday", "1jan", "NOT (month(t) = 1 AND day(t) = 1)"),
    ("select", "name=A,N,year=1997", "var IN ('A', 'N') AND year(t) = 1997"),
    ("delete", "name=A,month=6", "NOT (var = 'A' AND month(t) = 6)"),
):
    _add(_n, f"{_n},{_a} li" if _a else f"{_n} li", "li", f"SELECT * FROM li WHERE {_w}")
_add("selhour", "selhour,6/12 ev", "ev", "SELECT * FROM ev WHERE hour(t) BETWEEN 6 AND 12")
_add("seltime", "seltime,00:00:00,12:00:00 ev", "ev", "SELECT * FROM ev WHERE hour(t) IN (0, 12)")
_add("sellevidx", "sellevidx,2 li", "li", "SELECT * FROM li WHERE level = 2")
_add("seltimestep", "seltimestep,1/10 li", "li", "SELECT * FROM (SELECT *, dense_rank() OVER (ORDER BY ts) AS n FROM li) WHERE n <= 10")
_add("selsmon", "selsmon,2,1,2 em", "em", "SELECT * FROM em WHERE ts IN (SELECT b.ts FROM em a JOIN em b ON b.ts BETWEEN a.ts - 1 AND a.ts + 2 WHERE month(a.t) = 2)")
_add("sellonlatbox", "sellonlatbox,40,200,-50,30 em", "em", "SELECT var, level, ts, x - 1 AS x, y - 2 AS y, v FROM em WHERE 45 * x BETWEEN 40 AND 200 AND -78.75 + 22.5 * y BETWEEN -50 AND 30")
_add("selindexbox", "selindexbox,7,2,3,5 em", "em", "SELECT var, level, ts, CASE WHEN x >= 6 THEN x - 6 ELSE x + 2 END AS x, y - 2 AS y, v FROM em WHERE (x >= 6 OR x <= 1) AND y BETWEEN 2 AND 4")
_add("selrec", "selrec,1/20 li", "li", "SELECT * FROM (SELECT *, dense_rank() OVER (ORDER BY ts, var, level) AS n FROM li) WHERE n <= 20")

# Two datasets

_PAIR = "SELECT a.var, a.level, a.ts, a.x, a.y, {v} AS v FROM m0 a JOIN m1 b USING (ts, x, y)"
for _n, _v in {
    "add": "a.v + b.v", "sub": "a.v - b.v", "mul": "a.v * b.v", "div": "a.v / nullif(b.v, 0)", "min": "least(a.v, b.v)", "max": "greatest(a.v, b.v)",
    "atan2": "atan2(a.v, b.v)", "eq": "(a.v = b.v)::INT", "ne": "(a.v <> b.v)::INT", "le": "(a.v <= b.v)::INT", "lt": "(a.v < b.v)::INT", "ge": "(a.v >= b.v)::INT", "gt": "(a.v > b.v)::INT",
}.items():
    _add(_n, f"{_n} m0 m1", "m0 m1", _PAIR.format(v=_v))
_add("ifthen", "ifthen -gtc,0 m1 m0", "m0 m1", _PAIR.format(v="CASE WHEN b.v > 0 THEN a.v END"))
_add("ifnotthen", "ifnotthen -gtc,0 m1 m0", "m0 m1", _PAIR.format(v="CASE WHEN NOT b.v > 0 THEN a.v END"))
_add("ifthenelse", "ifthenelse -gtc,0 m1 m0 m2", "m0 m1 m2", "SELECT a.var, a.level, a.ts, a.x, a.y, CASE WHEN b.v > 0 THEN a.v ELSE c.v END AS v FROM m0 a JOIN m1 b USING (ts, x, y) JOIN m2 c USING (ts, x, y)")

# Statistics over periods

STATS = {
    "min": "min(v)", "max": "max(v)", "sum": "sum(v)", "mean": "avg(v)", "avg": "CASE WHEN count(v) = count(*) THEN avg(v) END",
    "var": "var_pop(v)", "var1": "var_samp(v)", "std": "stddev_pop(v)", "std1": "stddev_samp(v)",
}
PERIODS = {
    "tim": ("li", "0"),
    "year": ("li", "year(t)"),
    "mon": ("li", "year(t) * 12 + month(t) - 1"),
    "day": ("ev", "datediff('day', DATE '1970-01-01', t::DATE)"),
    "hour": ("ev", "ts"),
    "seas": ("li", "(year(t) + (month(t) = 12)::INT) * 4 + (month(t) % 12) // 3"),
    "ymon": ("li", "month(t)"),
    "yday": ("li", "(month(t) - 1) * 31 + day(t)"),
    "yhour": ("ev", "((month(t) - 1) * 31 + day(t)) * 25 + hour(t)"),
    "yseas": ("li", "(month(t) % 12) // 3"),
}
_GROUP = "SELECT {keys}, {p} AS ts, {v} AS v FROM {s} GROUP BY ALL"
for _p, (_s, _key) in PERIODS.items():
    for _n, _v in STATS.items():
        _add(_p + _n, f"{_p}{_n} {_s}", _s, _GROUP.format(keys=KEYS, p=_key, v=_v, s=_s))
    _add(f"{_p}pctl", f"{_p}pctl,75 {_s}", _s, _GROUP.format(keys=KEYS, p=_key, v="quantile_disc(v, 0.75)", s=_s))
    if _p[0] != "y" or _p == "year":
        _add(f"{_p}count", f"{_p}count {_s}", _s, _GROUP.format(keys=KEYS, p=_key, v="nullif(count(v), 0)", s=_s))
_N = "(SELECT *, dense_rank() OVER (ORDER BY ts) - 1 AS n FROM evd)"
for _n, _v in (STATS | {"pctl": "quantile_disc(v, 0.75)"}).items():
    _add(f"timsel{_n}", f"timsel{_n},{'75,' if _n == 'pctl' else ''}5,2,1 evd", "evd", f"SELECT {KEYS}, (n - 2) // 6 AS ts, {_v} AS v FROM {_N} WHERE n >= 2 AND (n - 2) % 6 < 5 GROUP BY ALL")
_add("yearmonmean", "yearmonmean -monmean li", "li", "SELECT var, level, x, y, ts, sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END) AS v FROM (SELECT var, level, x, y, year(t) AS ts, month(t) AS m, avg(v) AS v, max(day(last_day(t))) AS w FROM li GROUP BY ALL) GROUP BY ALL")
_add("yearmonavg", "yearmonavg -monmean li", "li", "SELECT var, level, x, y, ts, CASE WHEN count(v) = count(*) THEN sum(v * w) / sum(w) END AS v FROM (SELECT var, level, x, y, year(t) AS ts, month(t) AS m, avg(v) AS v, max(day(last_day(t))) AS w FROM li GROUP BY ALL) GROUP BY ALL")
_add("tstepcount", "tstepcount,20 li", "li", "SELECT var, level, x, y, 0 AS ts, min(CASE WHEN v = 20 THEN n + 1 END) AS v FROM (SELECT *, dense_rank() OVER (ORDER BY ts) - 1 AS n FROM li) GROUP BY ALL")

# Running

_FRAME = "SELECT * FROM (SELECT {keys}, ts, {v} OVER w AS v, count(*) OVER w AS n FROM evd WINDOW w AS (PARTITION BY {keys} ORDER BY ts ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE n = 5"
for _n, _v in (STATS | {"pctl": "quantile_disc(v, 0.75)"}).items():
    _body = _FRAME.format(keys=KEYS, v=_v)
    if _n == "avg":
        _body = "SELECT var, level, x, y, ts, CASE WHEN c = 5 THEN v END AS v FROM (" + _FRAME.format(keys=KEYS, v="avg(v)").replace("count(*) OVER w AS n", "count(*) OVER w AS n, count(v) OVER w AS c") + ")"
    _add(f"run{_n}", f"run{_n},{'75,' if _n == 'pctl' else ''}5 evd", "evd", _body)
    _add(
        f"ydrun{_n}",
        f"ydrun{_n},{'75,' if _n == 'pctl' else ''}5 evd",
        "evd",
        f"SELECT a.var, a.level, a.x, a.y, (month(m.t) - 1) * 31 + day(m.t) AS ts, {_v.replace('(v', '(b.v')} AS v FROM evd a JOIN evd m ON (m.var, m.x, m.y) = (a.var, a.x, a.y) AND m.ts = a.ts + 2 JOIN evd b ON (b.var, b.x, b.y) = (a.var, a.x, a.y) AND b.ts BETWEEN a.ts AND a.ts + 4 WHERE a.ts + 4 <= (SELECT max(ts) FROM evd) GROUP BY ALL",
    )
_ISLANDS = "SELECT *, sum(1 - inside) OVER (PARTITION BY {k} ORDER BY ts) AS island FROM (SELECT *, coalesce(({c})::INT, 0) AS inside FROM evd)"
_RUN = "SELECT *, sum(inside) OVER (PARTITION BY {k}, island ORDER BY ts) AS run FROM (" + _ISLANDS + ")"
_add("consecsum", "consecsum,0 evd", "evd", f"SELECT {KEYS}, ts, run AS v FROM ({_RUN.format(k=KEYS, c='v <> 0')})")
_add("consects", "consects evd", "evd", f"SELECT {KEYS}, ts, CASE WHEN run > 0 AND coalesce(lead(inside) OVER (PARTITION BY {KEYS} ORDER BY ts), 0) = 0 THEN run END AS v FROM ({_RUN.format(k=KEYS, c='v <> 0')})")
_add("timsort", "timsort evd", "evd", f"SELECT a.var, a.level, a.x, a.y, a.ts, b.v FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY ts) AS k FROM evd) a JOIN (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY v NULLS FIRST, ts) AS k FROM evd) b USING (var, level, x, y, k)")

# Space

_ROWS = "[" + ", ".join(repr(w) for w in EM_GRID.row_weights()) + "]"
_W = f"(CASE WHEN v IS NOT NULL THEN ({_ROWS})[y + 1] END)"
_VAR = f"(sum({_W} * v * v) * sum({_W}) - sum({_W} * v) * sum({_W} * v)) / nullif(sum({_W}) * sum({_W}), 0)"
_VAR1 = f"(sum({_W} * v * v) * sum({_W}) - sum({_W} * v) * sum({_W} * v)) / nullif(sum({_W}) * sum({_W}) - sum({_W} * {_W}), 0)"
WEIGHTED = {"min": "min(v)", "max": "max(v)", "sum": "sum(v)", "mean": f"sum({_W} * v) / sum({_W})", "avg": f"sum({_W} * v) / sum({_W})", "var": _VAR, "std": f"sqrt({_VAR})", "var1": _VAR1, "std1": f"sqrt({_VAR1})"}


def _gaps(source: str, low: float = 0.3) -> str:
    """SQL of -setrtomiss,low,9999 on *source*."""
    return f"(SELECT * REPLACE (CASE WHEN v BETWEEN {low} AND 9999 THEN NULL ELSE v END AS v) FROM {source})"


_WHOLE = "CASE WHEN count(v) = count(*) THEN {v} END"  # of averages: missing where any value is
for _n, _v in WEIGHTED.items():
    # means and averages over fields with gaps, which tells them apart
    _in, _from = ("-setrtomiss,0.3,9999 em", _gaps("em")) if _n in ("mean", "avg") else ("em", "em")
    _v = _WHOLE.format(v=_v) if _n == "avg" else _v
    _add(f"fld{_n}", f"fld{_n} {_in}", "em", f"SELECT var, level, ts, 0 AS x, 0 AS y, {_v} AS v FROM {_from} GROUP BY ALL")
    if _n not in ("var1", "std1"):
        _add(f"mer{_n}", f"mer{_n} {_in}", "em", f"SELECT var, level, ts, x, 0 AS y, {_v} AS v FROM {_from} GROUP BY ALL")
        _add(f"gridbox{_n}", f"gridbox{_n},2,4 {_in}", "em", f"SELECT var, level, ts, bx AS x, b AS y, {_v} AS v FROM (SELECT *, x // 2 AS bx, y // 4 AS b FROM {_from}) GROUP BY var, level, ts, bx, b")
        _add(f"zon{_n}", f"zon{_n} {_in}", "em", f"SELECT var, level, ts, 0 AS x, y, {STATS[_n]} AS v FROM {_from} GROUP BY ALL")
_add("zonrange", "zonrange em", "em", "SELECT var, level, ts, 0 AS x, y, max(v) - min(v) AS v FROM em GROUP BY ALL")
for _n, _x, _y in (("fldpctl", "0", "0"), ("zonpctl", "0", "y"), ("merpctl", "x", "0")):
    _add(_n, f"{_n},90 em", "em", f"SELECT var, level, ts, {_x} AS x, {_y} AS y, quantile_disc(v, 0.9) AS v FROM em GROUP BY ALL")

# Levels: thickness between the middles of neighbouring levels of the whole axis

_AXIS = "axis AS (SELECT level, (coalesce((level + lead(level) OVER (ORDER BY level)) / 2, level) - coalesce((level + lag(level) OVER (ORDER BY level)) / 2, level)) AS dz FROM (SELECT DISTINCT level FROM pl))"
for _n in ("min", "max", "sum", "var", "std"):
    _add(f"vert{_n}", f"vert{_n} pl", "pl", f"SELECT var, 0 AS level, ts, x, y, {STATS[_n]} AS v FROM pl GROUP BY ALL")
_MEAN = "sum(v * dz) / sum(CASE WHEN v IS NOT NULL THEN dz END)"
for _n, _v, _in, _from in (("mean", _MEAN, "-setrtomiss,995,9999 pl", _gaps("pl", 995)), ("avg", _WHOLE.format(v=_MEAN), "-setrtomiss,995,9999 pl", _gaps("pl", 995)), ("int", "sum(v * dz)", "pl", "pl")):
    _add(f"vert{_n}", f"vert{_n} {_in}", "pl", f"SELECT var, 0 AS level, ts, x, y, {_v} AS v FROM {_from} JOIN axis USING (level) GROUP BY ALL", more=_AXIS)
_HIST = {"count": "count(k.v)", "sum": "coalesce(sum(k.v), 0)", "mean": "coalesce(avg(k.v), 0)", "freq": "count(k.v) / max(t.n)"}
for _n, _v in _HIST.items():
    _add(
        f"hist{_n}",
        f"hist{_n},0,100,300,1000 evd",
        "evd",
        f"SELECT t.var, b.i AS level, 0 AS ts, t.x, t.y, CASE WHEN max(t.n) > 0 THEN {_v} END AS v FROM (SELECT var, x, y, count(v) AS n FROM evd GROUP BY ALL) t CROSS JOIN (VALUES (1, 0, 100), (2, 100, 300), (3, 300, 1000)) b(i, lo, hi) LEFT JOIN evd k ON (k.var, k.x, k.y) = (t.var, t.x, t.y) AND k.v >= b.lo AND k.v < b.hi GROUP BY t.var, b.i, t.x, t.y",
    )

# Ensembles

_MEMBERS = "(" + " UNION ALL ".join(f"SELECT *, {k} AS member FROM m{k}" for k in range(5)) + ")"
for _n, _v in (STATS | {"pctl": "quantile_disc(v, 0.75)"}).items():
    _in, _from = ("-setrtomiss,0.3,9999 m0", _MEMBERS.replace("FROM m0", f"FROM {_gaps('m0')}")) if _n in ("mean", "avg") else ("m0", _MEMBERS)
    _add(f"ens{_n}", f"ens{_n}{',75' if _n == 'pctl' else ''} {_in} m1 m2 m3 m4", "m0 m1 m2 m3 m4", f"SELECT var, level, ts, x, y, {_v} AS v FROM {_from} GROUP BY ALL")
_RANK = f"(SELECT var, ts, x, y, len(list_filter(m, lambda e: e < obs)) AS r FROM (SELECT var, ts, x, y, max(CASE WHEN member = 0 THEN v END) AS obs, list(v) FILTER (member > 0) AS m FROM {_MEMBERS} GROUP BY ALL HAVING count(*) = 5))"
_add("ensrkhist_space", "ensrkhist_space m0 m1 m2 m3 m4", "m0 m1 m2 m3 m4", f"SELECT var, r AS level, 0 AS ts, x, y, count(*) AS v FROM {_RANK} GROUP BY ALL")
_add("ensrkhist_time", "ensrkhist_time m0 m1 m2 m3 m4", "m0 m1 m2 m3 m4", f"SELECT var, r AS level, ts, 0 AS x, 0 AS y, count(*) AS v FROM {_RANK} GROUP BY ALL")
# the scores by their plain definitions: mean distances, and the mean square of probability less event
_CASES = f"(SELECT var, level, ts, x, y, max(CASE WHEN member = 0 THEN v END) AS obs, list(v) FILTER (member > 0) AS m FROM {_MEMBERS} GROUP BY ALL HAVING count(*) = 5)"
_PLAIN = f"SELECT var, level, ts, 0 AS x, 0 AS y, sum({_W} * s) / sum({_W}) AS v FROM (SELECT *, {{s}} AS s, 0 AS v FROM {_CASES}) GROUP BY var, level, ts"
_add("enscrps", "enscrps m0 m1 m2 m3 m4", "m0 m1 m2 m3 m4", _PLAIN.format(s="list_avg(list_transform(m, lambda a: abs(a - obs))) - list_avg(list_transform(m, lambda a: list_avg(list_transform(m, lambda b: abs(a - b))))) / 2"))
_add("ensbrs", "ensbrs,0 m0 m1 m2 m3 m4", "m0 m1 m2 m3 m4", _PLAIN.format(s="pow(len(list_filter(m, lambda a: a > 0)) / 4 - (obs > 0)::INT, 2)"))
_add("ensroc", "ensroc m0 m1 m2 m3 m4", "m0 m1 m2 m3 m4", None)

# Climatologies

for _p, _clim in (("mon", "mon"), ("ymon", "ymon"), ("yday", "yday"), ("yseas", "yseas"), ("yhour", "yhour")):
    _s, _key = PERIODS[_clim]
    for _n, _f in (("add", "a.v + b.v"), ("sub", "a.v - b.v"), ("mul", "CASE WHEN a.v = 0 OR b.v = 0 THEN 0 ELSE a.v * b.v END"), ("div", "a.v / nullif(b.v, 0)")):
        _add(
            _p + _n,
            f"{_p}{_n} {_s} -{_clim}mean {_s}",
            _s,
            f"SELECT a.var, a.level, a.ts, a.x, a.y, {_f} AS v FROM (SELECT *, {_key} AS p FROM {_s}) a JOIN (SELECT {KEYS}, {_key} AS p, avg(v) AS v FROM {_s} GROUP BY ALL) b USING (var, level, x, y, p)",
        )

# Relations

_add("timcor", "timcor m0 m1", "m0 m1", "SELECT a.var, a.level, 0 AS ts, a.x, a.y, corr(a.v, b.v) AS v FROM m0 a JOIN m1 b USING (ts, x, y) GROUP BY ALL")
_add("timcovar", "timcovar m0 m1", "m0 m1", "SELECT a.var, a.level, 0 AS ts, a.x, a.y, covar_pop(a.v, b.v) AS v FROM m0 a JOIN m1 b USING (ts, x, y) GROUP BY ALL")
_P = f"(SELECT a.var, a.level, a.ts, a.v AS p, b.v AS q, ({_ROWS})[y + 1] AS w FROM m0 a JOIN m1 b USING (ts, x, y))"
_COV = "(sum(w * p * q) * sum(w) - sum(w * p) * sum(w * q))"
_add("fldcor", "fldcor m0 m1", "m0 m1", f"SELECT var, level, ts, 0 AS x, 0 AS y, {_COV} / sqrt((sum(w * p * p) * sum(w) - sum(w * p) * sum(w * p)) * (sum(w * q * q) * sum(w) - sum(w * q) * sum(w * q))) AS v FROM {_P} GROUP BY ALL")
_add("fldcovar", "fldcovar m0 m1", "m0 m1", f"SELECT var, level, ts, 0 AS x, 0 AS y, {_COV} / (sum(w) * sum(w)) AS v FROM {_P} GROUP BY ALL")
for _n in ("fldrms", "varrms"):
    _add(_n, f"{_n} m0 m1", "m0 m1", f"SELECT var, 0 AS level, ts, 0 AS x, 0 AS y, sqrt(sum(w * (q - p) * (q - p)) / sum(w)) AS v FROM {_P} GROUP BY ALL")
_LINE = "(SELECT *, dense_rank() OVER (ORDER BY ts) - 1 AS n FROM li)"
_add("regres", "regres li", "li", f"SELECT {KEYS}, 0 AS ts, regr_slope(v, n + 1) AS v FROM {_LINE} GROUP BY ALL")
_add("trend", "trend li", "li", f"SELECT {KEYS}, 0 AS ts, regr_intercept(v, n) AS v FROM {_LINE} GROUP BY ALL")
_DETREND = f"SELECT {KEYS}, n AS ts, v - (regr_intercept(v, n) OVER w + regr_slope(v, n) OVER w * n) AS v FROM {_LINE} WINDOW w AS (PARTITION BY {KEYS})"
_add("detrend", "detrend li", "li", _DETREND)
_add("subtrend", "subtrend li -trend li", "li", _DETREND)
for _n, _a in (("normal", ""), ("studentt", ",5"), ("chisquare", ",3"), ("beta", ",2,3"), ("fisher", ",3,7")):
    _add(_n, f"{_n}{_a} m0", "m0", None)
_add("meandiff2test", "meandiff2test,0,0.05 m0 m1", "m0 m1", None)
_add("varquot2test", "varquot2test,1,0.05 m0 m1", "m0 m1", None)

# Indices

_ALL = "SELECT {keys}, 0 AS ts, CASE WHEN count({valid}) > 0 THEN {v} END AS v FROM {s} GROUP BY ALL"
for _n, _a, _v in (
    ("eca_fd", "", "count(*) FILTER (v < 273.15)"),
    ("eca_id", "", "count(*) FILTER (v < 273.15)"),
    ("eca_su", ",25", "count(*) FILTER (v > 298.15)"),
    ("eca_tr", ",20", "count(*) FILTER (v > 293.15)"),
    ("eca_rr1", "", "count(*) FILTER (v >= 1)"),
    ("eca_pd", ",100", "count(*) FILTER (v >= 100)"),
    ("eca_r10mm", "", "count(*) FILTER (v >= 10)"),
    ("eca_r20mm", "", "count(*) FILTER (v >= 20)"),
    ("eca_hd", ",17", "coalesce(sum(CASE WHEN v < 290.15 THEN 290.15 - v END), 0)"),
    ("eca_rx1day", "", "max(v)"),
    ("eca_rx5day", "", "max(v)"),
    ("eca_sdii", ",100", "avg(CASE WHEN v >= 100 THEN v END)"),
    ("strwin", ",100", "count(*) FILTER (v >= 100)"),
    ("strbre", "", "count(*) FILTER (v >= 10.5)"),
    ("strgal", "", "count(*) FILTER (v >= 20.5)"),
    ("hurr", "", "count(*) FILTER (v >= 32.5)"),
):
    _add(_n, f"{_n}{_a} evd", "evd", _ALL.format(keys=KEYS, valid="v", v=_v, s="evd"))
for _n, _a, _c in (("eca_cfd", "", "v < 273.15"), ("eca_csu", "", "v > 298.15"), ("eca_cdd", ",100", "v < 100"), ("eca_cwd", ",100", "v >= 100")):
    _add(_n, f"{_n}{_a} evd", "evd", _ALL.format(keys=KEYS, valid="v", v="max(run)", s=f"({_RUN.format(k=KEYS, c=_c)})"))
_REF = "(SELECT a.*, b.w FROM evd a JOIN (SELECT var, x, y, {v} AS w FROM evd GROUP BY ALL) b USING (var, x, y))"
for _n, _c in (("eca_cwdi", "v < w - 5"), ("eca_hwdi", "v > w + 5"), ("eca_cwfi", "v < w"), ("eca_hwfi", "v > w")):
    _ref = "avg(v)" if _n.endswith("di") else "quantile_disc(v, 0.5)"
    _chain = f"{_n},2{',5' if _n.endswith('di') else ''} evd {'-timmean' if _n.endswith('di') else '-timpctl,50'} evd"
    _runs = _RUN.format(k=KEYS, c=_c).replace("FROM evd)", f"FROM {_REF.format(v=_ref)})")
    _add(_n, _chain, "evd", _ALL.format(keys=KEYS, valid="v + w", v="sum(CASE WHEN run = 2 THEN 2 WHEN run > 2 THEN 1 ELSE 0 END)", s=f"({_runs})"))
for _t in ("tg", "tn", "tx"):
    for _p, _c in ((10, "v < w"), (90, "v > w")):
        _add(f"eca_{_t}{_p}p", f"eca_{_t}{_p}p evd -timpctl,{_p} evd", "evd", _ALL.format(keys=KEYS, valid="v + w", v=f"100.0 * count(*) FILTER ({_c}) / nullif(count(v), 0)", s=_REF.format(v=f"quantile_disc(v, {_p / 100})")))
for _p in (75, 90, 95, 99):
    _s = _REF.format(v=f"quantile_disc(v, {_p / 100})")
    _add(f"eca_r{_p}p", f"eca_r{_p}p evd -timpctl,{_p} evd", "evd", _ALL.format(keys=KEYS, valid="v", v="100.0 * count(*) FILTER (v >= 1 AND v > w) / nullif(count(*) FILTER (v >= 1), 0)", s=_s))
    _add(f"eca_r{_p}ptot", f"eca_r{_p}ptot evd -timpctl,{_p} evd", "evd", _ALL.format(keys=KEYS, valid="v", v="100.0 * coalesce(sum(CASE WHEN v >= 1 AND v > w THEN v END), 0) / nullif(sum(v), 0)", s=_s))
_add("eca_etr", "eca_etr m0 m1", "m0 m1", "SELECT a.var, a.level, 0 AS ts, a.x, a.y, max(a.v) - min(b.v) AS v FROM m0 a JOIN m1 b USING (ts, x, y) GROUP BY ALL")
_add("fdns", "fdns m0 m1", "m0 m1", "SELECT a.var, a.level, 0 AS ts, a.x, a.y, count(*) FILTER (a.v <= 273.15 AND b.v <= 0.01) AS v FROM m0 a JOIN m1 b USING (ts, x, y) GROUP BY ALL")
_add("eca_gsl", "eca_gsl,2,-273.15 m0 -addc,1 -timmean m0", "m0", None)

# Changes of coordinates and time

_MOVED = {
    "invertlat": ("", "x, 7 - y AS y, v"),
    "invertlon": ("", "7 - x AS x, y, v"),
    "invertlatdata": ("", "x, 7 - y AS y, v"),
    "invertlondata": ("", "7 - x AS x, y, v"),
    "invertlatdes": ("", "x, y, v"),
    "invertlondes": ("", "x, y, v"),
    "transxy": ("", "y AS x, x AS y, v"),
}
for _n, (_a, _v) in _MOVED.items():
    _add(_n, f"{_n} em", "em", f"SELECT var, level, ts, {_v} FROM em")
_add("sethalo", "sethalo,1,2 em", "em", "SELECT var, level, ts, x + 1 AS x, y, v FROM em UNION ALL SELECT var, level, ts, 0, y, v FROM em WHERE x = 7 UNION ALL SELECT var, level, ts, x + 9, y, v FROM em WHERE x < 2")
_add("tpnhalo", "tpnhalo em", "em", "SELECT var, level, ts, x, y + 2 AS y, v FROM em UNION ALL SELECT var, level, ts, 7 - x, 1 - y, v FROM em WHERE y < 2")
_add("setlevel", "setlevel,5 em", "em", "SELECT var, 5 AS level, ts, x, y, v FROM em")
_add("chlevel", "chlevel,1,10 li", "li", "SELECT var, CASE WHEN level = 1 THEN 10 ELSE level END AS level, ts, x, y, v FROM li")
_add("chlevelv", "chlevelv,A,1,10 li", "li", "SELECT var, CASE WHEN level = 1 AND var = 'A' THEN 10 ELSE level END AS level, ts, x, y, v FROM li")
_add("chlevelc", "chlevelc,1,1,10 li", "li", "SELECT var, CASE WHEN level = 1 AND var = 'A' THEN 10 ELSE level END AS level, ts, x, y, v FROM li")
_add("chname", "chname,A,B,N,M li", "li", "SELECT CASE var WHEN 'A' THEN 'B' WHEN 'N' THEN 'M' ELSE var END AS var, level, ts, x, y, v FROM li")
_add("setname", "setname,a,n,r li", "li", "SELECT lower(var) AS var, level, ts, x, y, v FROM li")
_add("invertlev", "invertlev li", "li", "SELECT a.var, 3 - a.level AS level, ts, x, y, v FROM li a WHERE var IN (SELECT var FROM li GROUP BY var HAVING count(DISTINCT level) = 2) UNION ALL SELECT var, level, ts, x, y, v FROM li WHERE var IN (SELECT var FROM li GROUP BY var HAVING count(DISTINCT level) = 1)")
_add("setgrid", "setgrid,r16x4 em", "em", "SELECT var, level, ts, (y * 8 + x) % 16 AS x, (y * 8 + x) // 16 AS y, v FROM em")
_add("setzaxis", "setzaxis,7,9 li", "li", "SELECT var, CASE level WHEN 1 THEN 7 ELSE 9 END AS level, ts, x, y, v FROM li")
_add("pardup", "pardup m0", "m0", "SELECT var || s AS var, level, ts, x, y, v FROM m0, (VALUES (''), ('_1')) k(s)")
_add("parmul", "parmul,3 m0", "m0", "SELECT var || s AS var, level, ts, x, y, v FROM m0, (VALUES (''), ('_1'), ('_2')) k(s)")
_add("enlarge", "enlarge,r8x4 -zonmean -selindexbox,1,8,1,4 m0", "m0", "SELECT var, level, ts, k.x, y, v FROM (SELECT var, level, ts, y, avg(v) AS v FROM m0 WHERE y < 4 GROUP BY ALL), (SELECT unnest(range(8)) AS x) k")
for _n, _k, _v in (("setcode", "code", "7"), ("setparam", "param", "1.2"), ("setunit", "unit", "K"), ("setstdname", "stdname", "x"), ("setlongname", "longname", "some name"), ("setltype", "ltype", "100"), ("settabnum", "tabnum", "3")):
    _noted(_n, f"{_n},{_v.replace(' ', '_')} li", "li", _variables(_k), f"SELECT *, '{_v.replace(' ', '_')}' AS note FROM li")
for _n, _k, _v, _w in (("chcode", "code", "130,7", "7"), ("chparam", "param", "130.128,9.9", "9.9"), ("chunit", "unit", "1,K", "K"), ("chtabnum", "tabnum", "128,2", "2"), ("chltype", "ltype", "1,2", "2")):
    _noted(_n, f"{_n},{_v} em", "em", _variables(_k), f"SELECT *, '{_w}' AS note FROM em")
for _n, _v, _f, _w in (
    ("setcalendar", "360_day", lambda d: d.calendar, "360_day"), ("settunits", "days", lambda d: d.attrs["time_units"], "days"), ("setgatt", "title,x", lambda d: d.attrs["title"], "x"),
    ("setgridtype", "curvilinear", lambda d: d.grid.kind, "curvilinear"), ("setgridnumber", "7", lambda d: str(d.grid.attrs["number"]), "7"), ("setgriduri", "x", lambda d: d.grid.attrs["uri"], "x"),
    ("setreftime", "1990-01-01,00:00:00", lambda d: d.attrs["reference_time"], "1990-01-01 00:00:00"),
):
    _noted(_n, f"{_n},{_v} em", "em", _f, f"SELECT *, '{_w}' AS note FROM em")
# the selected ones of two variables
for _n, _v, _other in (("selstdname", "embedding", "setstdname,other"), ("selltype", "1", "setltype,5"), ("seltabnum", "128", "settabnum,2"), ("seloperator", "130,1,0", "setcode,7")):
    _add(_n, f"{_n},{_v} -merge em -{_other} -setname,b em", "em", "SELECT * FROM em")
_noted("unsetgridmask", "unsetgridmask em", "em", lambda d: str(d.grid.mask), "SELECT *, 'None' AS note FROM em")
for _n in ("sortcode", "sortname", "sortlevel", "ncopy", "template1", "template2", "retocomplex", "tee", "writerandom"):
    _add(_n, f"{_n} m0", "m0", "SELECT * FROM m0")
_TIMES = "SELECT var, {key} AS level, ts, x, y, v FROM {s}"
for _n, _a, _k in (("setyear", "2003", "year"), ("setmon", "2", "mon"), ("setdate", "2001-05-06", "mon"), ("shifttime", "1month", "mon"), ("settaxis", "2001-01-01,00:00:00,1day", "mon")):
    _chain = f"{_n},{_a} m0"
    _at = {"setyear": "make_date(2003, month(t), 1)", "setmon": "make_date(year(t), 2, 1)", "setdate": "DATE '2001-05-06'", "shifttime": "t + INTERVAL 1 MONTH", "settaxis": "DATE '2001-01-01' + ts::INTEGER"}[_n]
    _period = "year({t})" if _k == "year" else "year({t}) * 12 + month({t}) - 1"
    _add(_n, f"{_k}sum -{_chain}", "m0", f"SELECT var, level, x, y, {_period.format(t=_at)} AS ts, sum(v) AS v FROM m0 GROUP BY ALL")
_add("setday", "daysum -setday,5 m0", "m0", "SELECT var, level, x, y, datediff('day', DATE '1970-01-01', make_date(year(t), month(t), 5)) AS ts, sum(v) AS v FROM m0 GROUP BY ALL")
_add("settime", "hoursum -settime,06:00:00 m0", "m0", "SELECT var, level, x, y, datediff('day', DATE '1970-01-01', t::DATE) * 24 + 6 AS ts, sum(v) AS v FROM m0 GROUP BY ALL")

# Files

for _n in ("copy", "selall", "szip"):
    _add(_n, f"{_n} m0", "m0", "SELECT * FROM m0")
_add("cat", "cat m0 m1", "m0 m1", "SELECT * FROM m0 UNION ALL SELECT * REPLACE (ts + 1099511627776 AS ts) FROM m1")
_add("duplicate", "duplicate,2 m0", "m0", "SELECT * FROM m0 UNION ALL SELECT * REPLACE (ts + 1099511627776 AS ts) FROM m0")
_add("merge", "merge m0 -setname,second m1", "m0 m1", "SELECT * FROM m0 WHERE ts IN (SELECT ts FROM m1) UNION ALL SELECT * REPLACE ('second' AS var) FROM m1 WHERE ts IN (SELECT ts FROM m0)")
_MERGED = "SELECT var, level, dense_rank() OVER (ORDER BY t, k) - 1 AS ts, x, y, v FROM (SELECT *, 0 AS k FROM m0 UNION ALL SELECT *, 1 AS k FROM m1)"
for _n in ("mergetime", "sorttimestamp", "sorttaxis"):
    _add(_n, f"{_n} m0 m1", "m0 m1", _MERGED)
_add("mergegrid", "mergegrid m0 -selindexbox,2,4,2,4 -mulc,2 m0", "m0", "SELECT var, level, ts, x, y, CASE WHEN x BETWEEN 1 AND 3 AND y BETWEEN 1 AND 3 THEN 2 * v ELSE v END AS v FROM m0")
_add("replace", "replace li -mulc,2 -selname,A li", "li", "SELECT var, level, n AS ts, x, y, v FROM (SELECT *, dense_rank() OVER (ORDER BY ts) - 1 AS n FROM li) WHERE var <> 'A' UNION ALL SELECT var, level, dense_rank() OVER (ORDER BY ts) - 1, x, y, 2 * v FROM li WHERE var = 'A'")
_add("collgrid", "collgrid -selindexbox,1,4,1,8 m0 -selindexbox,5,8,1,8 m0", "m0", "SELECT * FROM m0")
_add("distgrid", "distgrid,2,2 m0", "m0", "SELECT * FROM m0 WHERE x < 4 AND y < 4")
_PART = "part::VARCHAR AS part, count(*) AS n, round(sum(v), 2) AS v"


def _parts(key: str, chain: str, sets: str, part: str, where: str = "TRUE") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.sql import functions as F

        from isohyet.plans.chain import run as run_chain

        out = run_chain(chain, {s: adapters.DATASETS[s](spark, sf_dir) for s in sets.split()}, spark)
        return out.groupBy(F.col("part").cast("string").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 2).alias("v"))

    _QUERIES[key] = run
    _SQL[key] = _sql(sets, f"SELECT {part} AS part, v FROM {sets} WHERE {where}", _PART) + " GROUP BY part"


for _n, _p in (
    ("splitname", "var"), ("splitcode", "CASE var WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END"), ("splitparam", "CASE var WHEN 'A' THEN '1.1' WHEN 'N' THEN '2.1' ELSE '3.1' END"),
    ("splitlevel", "printf('%.1f', level)"), ("splitgrid", "'lonlat'"), ("splitzaxis", "''"), ("splittabnum", "''"),
    ("splitrec", "ts || '_' || var || '_' || printf('%.1f', level)"), ("splitday", "strftime(t, '%d')"), ("splitmon", "strftime(t, '%m')"), ("splityear", "strftime(t, '%Y')"), ("splityearmon", "strftime(t, '%Y%m')"),
    ("splitseas", "['DJF', 'MAM', 'JJA', 'SON'][(month(t) % 12) // 3 + 1]"),
):
    _parts(_n, f"{_n} li", "li", _p)
_parts("splithour", "splithour ev", "ev", "strftime(t, '%H')")
_parts("splitsel", "splitsel,5 evd", "evd", "ts // 5")

# Information



def _listing(key: str, chain: str, sets: str, columns: list[str], body: str) -> None:
    """Queries whose results are DataFrames: some of their columns, doubles rounded."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.sql import functions as F

        from isohyet.plans.chain import run as run_chain

        out = run_chain(chain, {s: adapters.DATASETS[s](spark, sf_dir) for s in set(sets.split())}, spark)
        kinds = dict(out.dtypes)
        fit = lambda c: F.round(c, 4) if kinds[c] == "double" else F.col(c).cast("long") if kinds[c] in ("int", "bigint") else F.col(c)
        return out.select(*[fit(c).alias(c) for c in columns])

    _QUERIES[key] = run
    _SQL[key] = _sql(sets, body, "*")


_INFO = "SELECT var, level::DOUBLE AS level, ts::BIGINT AS ts, count(*) AS size, count(*) - count(v) AS missing, round(min(v), 4) AS minimum, round(avg(v), 4) AS mean, round(max(v), 4) AS maximum FROM li GROUP BY ALL"
for _n in ("info", "infop", "infon", "infoc", "pinfo", "pinfov"):
    _listing(_n, f"{_n} li", "li", ["var", "level", "ts", "size", "missing", "minimum", "mean", "maximum"], _INFO)
for _e in ("", "e"):
    for _k in ("", "p", "n", "c"):
        _listing(f"s{_e}info{_k}", f"s{_e}info{_k} li", "li", ["var", "levels", "steps", "cells"], "SELECT var, count(DISTINCT level) AS levels, count(DISTINCT ts) AS steps, 100::BIGINT AS cells FROM li GROUP BY var")
_listing("tinfo", "tinfo evd", "evd", ["ts", "seconds"], "SELECT ts::BIGINT AS ts, (epoch(t) - epoch(lag(t) OVER (ORDER BY ts)))::BIGINT AS seconds FROM (SELECT DISTINCT ts, t FROM evd)")
for _n in ("diff", "diffp", "diffn", "diffc"):
    _listing(_n, f"{_n} evd -setvals,0,1 -setrtoc,100,200,150 evd", "evd", ["var", "ts", "differing", "largest"], "SELECT var, ts::BIGINT AS ts, count(*) AS differing, round(max(abs(v - 150)), 4) AS largest FROM evd WHERE v BETWEEN 100 AND 200 AND v <> 150 GROUP BY var, ts")
for _n, _v in (("nyear", "year(t)"), ("nmon", "month(t)"), ("ndate", "t::DATE")):
    _listing(_n, f"{_n} li", "li", ["n"], f"SELECT (count(*) FILTER (k <> p) + 1)::BIGINT AS n FROM (SELECT {_v} AS k, lag({_v}) OVER (ORDER BY ts) AS p FROM (SELECT DISTINCT ts, t FROM li))")
_listing("ntime", "ntime li", "li", ["n"], "SELECT count(DISTINCT ts) AS n FROM li")
_listing("npar", "npar li", "li", ["n"], "SELECT count(DISTINCT var) AS n FROM li")
_listing("nlevel", "nlevel li", "li", ["var", "n"], "SELECT var, count(DISTINCT level) AS n FROM li GROUP BY var")
for _n, _v in (("showyear", "year(t)"), ("showmon", "month(t)")):
    _listing(_n, f"{_n} li", "li", ["value"], f"SELECT DISTINCT {_v}::BIGINT AS value FROM li")
for _n, _f in (("showdate", "%Y-%m-%d"), ("showtime", "%H:%M:%S"), ("showtimestamp", "%Y-%m-%dT%H:%M:%S")):
    _listing(_n, f"{_n} ev", "ev", ["value"], f"SELECT DISTINCT strftime(t, '{_f}') AS value FROM ev")
_listing("showname", "showname li", "li", ["value"], "SELECT DISTINCT var AS value FROM li")
_listing("showlevel", "showlevel li", "li", ["var", "level"], "SELECT DISTINCT var, level::DOUBLE AS level FROM li")
_listing("zaxisdes", "zaxisdes li", "li", ["var", "level"], "SELECT DISTINCT var, level::DOUBLE AS level FROM li")
for _n, _v in (("showcode", "CASE var WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END"), ("showparam", "CASE var WHEN 'A' THEN '1.1' WHEN 'N' THEN '2.1' ELSE '3.1' END"), ("showunit", "'pcs'"), ("showstdname", "NULL::VARCHAR"), ("showltype", "NULL::VARCHAR")):
    _listing(_n, f"{_n} li", "li", ["var", "value"], f"SELECT DISTINCT var, {_v} AS value FROM li")
for _n in ("griddes", "griddes2", "writegrid"):
    _listing(_n, f"{_n} m0", "m0", ["cell", "lon", "lat"], "SELECT DISTINCT y * 8 + x AS cell, 45.0::DOUBLE * x AS lon, -78.75::DOUBLE + 22.5 * y AS lat FROM m0")
for _n in ("pardes", "partab", "partab2", "spartab", "vlist"):
    _listing(_n, f"{_n} li", "li", ["name", "code"], "SELECT * FROM (VALUES ('A', '1'), ('N', '2'), ('R', '3')) t(name, code)")
_listing("map", "map m0", "m0", ["var", "ts", "y", "row"], "SELECT var, ts::BIGINT AS ts, y::BIGINT AS y, string_agg(least(floor((v - lo) * 10 / (hi - lo)), 9)::INT::VARCHAR, '' ORDER BY x) AS row FROM (SELECT *, min(v) OVER (PARTITION BY ts) AS lo, max(v) OVER (PARTITION BY ts) AS hi FROM m0) GROUP BY var, ts, y")
_listing("cdiread", "cdiread evd", "evd", ["cells", "values"], 'SELECT count(*) AS cells, count(v) AS "values" FROM evd')
for _n, _c, _b in (
    ("output", ["value"], "round(v, 4) AS value"),
    ("outputarr", ["value"], "round(v, 4) AS value"),
    ("outputint", ["value"], "round(v)::BIGINT AS value"),
    ("outputts", ["date", "time", "value"], "strftime(t, '%Y-%m-%d') AS date, '00:00:00' AS time, round(v, 4) AS value"),
    ("outputfld", ["date", "lon", "lat", "value"], "strftime(t, '%Y-%m-%d') AS date, 18.0::DOUBLE + 36 * x AS lon, -81.0::DOUBLE + 18 * y AS lat, v AS value"),
    ("outputxyz", ["lon", "lat", "value"], "18.0::DOUBLE + 36 * x AS lon, -81.0::DOUBLE + 18 * y AS lat, v AS value"),
    ("outputsrv", ["lev", "date", "value"], "level::DOUBLE AS lev, strftime(t, '%Y-%m-%d') AS date, v AS value"),
    ("outputext", ["lev", "date", "value"], "level::DOUBLE AS lev, strftime(t, '%Y-%m-%d') AS date, v AS value"),
):
    _listing(_n, f"{_n} li", "li", _c, f"SELECT {_b} FROM li")
_listing("outputf", "outputf,%.2f li", "li", ["value"], "SELECT CASE WHEN v IS NOT NULL THEN printf('%.2f', v) END AS value FROM li")
_listing("outputtab", "outputtab,name,xind,value li", "li", ["name", "xind", "value"], "SELECT var AS name, x + 1 AS xind, v AS value FROM li")

# Interpolation

_add("intntime", "intntime,4 m0", "m0", "SELECT a.var, a.level, a.ts * 4 + k AS ts, a.x, a.y, CASE WHEN k = 0 THEN a.v ELSE a.v * (1 - k / 4) + b.v * k / 4 END AS v FROM m0 a LEFT JOIN m0 b ON b.ts = a.ts + 1 AND b.x = a.x AND b.y = a.y CROSS JOIN (SELECT unnest(range(4)) AS k) WHERE k = 0 OR b.ts IS NOT NULL")
_add("inttime", "inttime,2000-01-03,12:00:00,1day m0", "m0", "SELECT a.var, a.level, a.ts - 2 AS ts, a.x, a.y, (a.v + b.v) / 2 AS v FROM m0 a JOIN m0 b ON b.ts = a.ts + 1 AND b.x = a.x AND b.y = a.y WHERE a.ts >= 2")
_add("intlevel", "intlevel,12.5 -sellevel,12,13 pl", "pl", "SELECT a.var, 12.5 AS level, a.ts, a.x, a.y, CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v ELSE (a.v + b.v) / 2 END AS v FROM (SELECT * FROM pl WHERE level = 12) a JOIN (SELECT * FROM pl WHERE level = 13) b USING (var, x, y) UNION ALL SELECT var, 12.5, ts, x, y, NULL FROM pl p WHERE level IN (12, 13) AND NOT EXISTS (SELECT 1 FROM pl q WHERE q.level = 25 - p.level AND q.var = p.var AND q.x = p.x AND q.y = p.y)")
_add("intlevelx", "intlevelx,60 -sellevel,12,13 pl", "pl", "SELECT var, 60 AS level, ts, x, y, arg_max(v, level) AS v FROM pl WHERE level IN (12, 13) GROUP BY ALL")
_add("smooth9", "smooth9 m0", "m0", "SELECT a.var, a.level, a.ts, a.x, a.y, sum(b.v * w) / sum(w) AS v FROM m0 a CROSS JOIN (SELECT i, j, [1.0, 0.5, 0.3][abs(i) + abs(j) + 1] AS w FROM (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)) k JOIN m0 b ON b.ts = a.ts AND b.x = (a.x + k.i + 8) % 8 AND b.y = a.y + k.j GROUP BY ALL")
_add("boxavg", "boxavg,2,4 em", "em", "SELECT var, level, ts, x // 2 AS x, y // 4 AS y, avg(v) AS v FROM em GROUP BY ALL")
_add("thinout", "thinout,2,4 em", "em", "SELECT var, level, ts, x // 2 AS x, y // 4 AS y, v FROM em WHERE x % 2 = 0 AND y % 4 = 0")


def _links(key: str, method: str, grid: str, total: bool = False) -> None:
    """Remapping against SQL with the same links spelled out."""
    from isohyet.grid import named
    from isohyet.operators import weights

    src, dst, w = weights.METHODS[method](EM_GRID, named(grid))
    nx = named(grid).nx
    rows = ", ".join(f"({a}, {b}, {c!r})" for a, b, c in zip(src.tolist(), dst.tolist(), w.tolist()))
    _add(key, f"{key},{grid} m0", "m0", f"SELECT var, level, ts, d % {nx} AS x, d // {nx} AS y, sum(w * v) / sum(w) AS v FROM m0 JOIN (VALUES {rows}) k(s, d, w) ON k.s = y * 8 + x GROUP BY ALL")


for _n, _m in (("remapnn", "nn"), ("remapdis", "dis"), ("remapbil", "bil"), ("remapcon", "con"), ("remapycon", "ycon"), ("remaplaf", "laf"), ("remapbic", "bic"), ("remapcon2", "con2"), ("intgridbil", "bil"), ("intgridcon", "con"), ("interpolate", "bil"), ("yarbil", "bil"), ("yarcon", "con")):
    _links(_n, _m, "r12x6")
for _n in ("gennn", "gendis", "genbic", "gencon2"):
    _add(_n, f"{_n},r12x6 m0", "m0", None)
# weights from 8 by 8 to 12 by 6 cells by their definition: parts of a target that sources cover, and shares between centres
_SPANS = """
    east AS (SELECT s, d, (least(45 * s + 22.5 + k, 30 * d + 15) - greatest(45 * s - 22.5 + k, 30 * d - 15)) / 30 AS w
             FROM range(8) a(s), range(12) b(d), (VALUES (0), (-360), (360)) r(k) WHERE least(45 * s + 22.5 + k, 30 * d + 15) > greatest(45 * s - 22.5 + k, 30 * d - 15)),
    north AS (SELECT s, d, (sin(radians(least(22.5 * s - 67.5, 30 * d - 60))) - sin(radians(greatest(22.5 * s - 90, 30 * d - 90)))) / (sin(radians(30 * d - 60)) - sin(radians(30 * d - 90))) AS w
              FROM range(8) a(s), range(6) b(d) WHERE least(22.5 * s - 67.5, 30 * d - 60) > greatest(22.5 * s - 90, 30 * d - 90)),
    spans AS (SELECT (n.s * 8 + e.s)::INT AS src, (n.d * 12 + e.d)::INT AS dst, e.w * n.w AS w FROM east e, north n)"""
for _n in ("gencon", "genycon"):
    _listing(_n, f"{_n},r12x6 m0", "m0", ["src", "dst", "w"], f"WITH {_SPANS} SELECT src, dst, round(w, 4) AS w FROM spans")
_listing("genlaf", "genlaf,r12x6 m0", "m0", ["src", "dst"], f"WITH {_SPANS} SELECT src, dst FROM spans QUALIFY row_number() OVER (PARTITION BY dst ORDER BY w DESC) = 1")
_BETWEEN = "SELECT floor({p})::INT + k AS s, d, CASE k WHEN 0 THEN 1 - ({p} - floor({p})) ELSE {p} - floor({p}) END AS w FROM range({n}) b(d), (VALUES (0), (1)) r(k)"
_listing("genbil", "genbil,r12x6 m0", "m0", ["src", "dst", "w"], f"SELECT (n.s * 8 + e.s % 8)::INT AS src, (n.d * 12 + e.d)::INT AS dst, round(e.w * n.w, 4) AS w FROM ({_BETWEEN.format(p='(30 * d / 45)', n=12)}) e, ({_BETWEEN.format(p='((30 * d + 3.75) / 22.5)', n=6)}) n WHERE e.w * n.w > 0")
_add("remapsum", "remapsum,r4x4 em", "em", "SELECT var, level, ts, (x + k) % 8 // 2 AS x, y // 2 AS y, sum(v * s) AS v FROM em JOIN (VALUES (0, 0, 1.0), (1, 0, 0.5), (1, 1, 0.5)) p(odd, k, s) ON odd = x % 2 GROUP BY ALL")
_add("intpoint", "intpoint,100,20 em", "em", "SELECT var, level, ts, 0 AS x, 0 AS y, sum(v * (1 - abs(x - 100.0 / 45)) * (1 - abs(y - 98.75 / 22.5))) AS v FROM em WHERE abs(x - 100.0 / 45) < 1 AND abs(y - 98.75 / 22.5) < 1 GROUP BY var, level, ts")


def _fill_sql(linear: bool) -> str:
    """Every gap's nearest values by self-joins on its row and its column."""
    side = "(SELECT arg_{f}({{v: b.v, off: abs(b.{a} - c.{a})}}, b.{a}) FROM {r} b WHERE b.v IS NOT NULL AND (b.var, b.ts, b.{o}) = (c.var, c.ts, c.{o}) AND b.{a} {c} c.{a}) AS {n}"
    sides = ", ".join(side.format(f=f, a=a, o=o, c=c, n=n, r="ring" if a == "x" and linear else "evd") for f, a, o, c, n in (("max", "x", "y", "<", "w"), ("min", "x", "y", ">", "e"), ("max", "y", "x", "<", "n"), ("min", "y", "x", ">", "s")))
    if linear:
        along = "CASE WHEN {a} IS NULL THEN {b}.v WHEN {b} IS NULL THEN {a}.v ELSE ({a}.v * {b}.off + {b}.v * {a}.off) / ({a}.off + {b}.off) END"
        out = f"SELECT *, {along.format(a='w', b='e')} AS vx, {along.format(a='n', b='s')} AS vy, (w IS NOT NULL)::INT + (e IS NOT NULL)::INT AS nx, (n IS NOT NULL)::INT + (s IS NOT NULL)::INT AS ny FROM sides"
        return f"WITH ring AS (SELECT var, ts, x + 10 * k AS x, y, v FROM evd, (VALUES (-1), (0), (1)) r(k)), sides AS (SELECT c.*, {sides} FROM evd c), along AS ({out}) SELECT var, level, ts, x, y, coalesce(v, CASE WHEN nx = 0 THEN vy WHEN ny = 0 THEN vx ELSE (vx * ny + vy * nx) / (nx + ny) END) AS v FROM along"
    best = "list_first(list_sort(list_filter([{off: e.off, k: 0, v: e.v}, {off: w.off, k: 1, v: w.v}, {off: n.off, k: 2, v: n.v}, {off: s.off, k: 3, v: s.v}], lambda r: r.v IS NOT NULL)))"
    return f"WITH sides AS (SELECT c.*, {sides} FROM evd c) SELECT var, level, ts, x, y, coalesce(v, ({best}).v) AS v FROM sides"


_add("fillmiss", "fillmiss evd", "evd", _fill_sql(True))
_add("fillmiss2", "fillmiss2 evd", "evd", _fill_sql(False))
_add("isosurface", "isosurface,950 pl", "pl", """
    WITH steps AS (SELECT *, lead(level) OVER w AS z2, lead(v) OVER w AS v2 FROM pl WINDOW w AS (PARTITION BY var, ts, x, y ORDER BY level)),
    hits AS (SELECT var, ts, x, y, arg_min(CASE WHEN v = 950 THEN level WHEN v = v2 THEN z2 ELSE level + (950 - v) / (v2 - v) * (z2 - level) END, level) AS v
             FROM steps WHERE 950 BETWEEN least(v, v2) AND greatest(v, v2) AND v2 IS NOT NULL GROUP BY ALL)
    SELECT c.var, 0 AS level, c.ts, c.x, c.y, h.v FROM (SELECT DISTINCT var, ts, x, y FROM pl) c LEFT JOIN hits h USING (var, ts, x, y)""")

# Expressions

_add("expr", "expr,'s=A+2*N;r=(A>N)?A:N' li", "li", "SELECT k.var, level, ts, x, y, CASE k.var WHEN 's' THEN a + 2 * n WHEN 'r' THEN CASE WHEN a > n THEN a WHEN a <= n THEN n END END AS v FROM (SELECT level, ts, x, y, max(CASE WHEN var = 'A' THEN v END) AS a, max(CASE WHEN var = 'N' THEN v END) AS n FROM li WHERE var IN ('A', 'N') GROUP BY ALL) CROSS JOIN (VALUES ('s'), ('r')) k(var)")
_add("aexpr", "aexpr,'s=sqrt(A)*2' li", "li", "SELECT var, level, ts, x, y, v FROM li UNION ALL SELECT 's', level, ts, x, y, CASE WHEN v >= 0 THEN sqrt(v) END * 2 FROM li WHERE var = 'A'")

# Generators and geometry

_CELLS = "SELECT i % 8 AS x, i // 8 AS y FROM (SELECT unnest(range(64)) AS i)"
_AREAS = "[" + ", ".join(repr(a) for a in EM_GRID.row_areas()) + "]"
_add("const", "const,3.5,r8x8", "", None)
_SQL["const"] = f"SELECT {COLUMNS} FROM (SELECT 'const' AS var, 0 AS level, 0 AS ts, x, y, 3.5 AS v FROM ({_CELLS}))"
_add("for", "for,1,20,0.5", "", None)
_SQL["for"] = f"SELECT {COLUMNS} FROM (SELECT 'for' AS var, 0 AS level, i AS ts, 0 AS x, 0 AS y, 1 + 0.5 * i AS v FROM (SELECT unnest(range(39)) AS i))"
for _n, _v in (("sincos", "cos(radians(45.0 * x)) * sin(2 * radians(-78.75 + 22.5 * y))"), ("coshill", "2 - cos(acos(cos(radians(45.0 * x)) * cos(radians(-78.75 + 22.5 * y))) / 1.2)")):
    _add(_n, f"{_n},r8x8", "", None)
    _SQL[_n] = f"SELECT {COLUMNS} FROM (SELECT '{_n}' AS var, 0 AS level, 0 AS ts, x, y, {_v} AS v FROM ({_CELLS}))"
for _n in ("random", "cdiwrite"):
    _add(_n, f"{_n},r8x8" if _n == "random" else "cdiwrite", "", None)
_add("stdatm", "stdatm,0,1000,5000,10000", "", None)
_SQL["stdatm"] = f"""SELECT {COLUMNS} FROM (
    SELECT k.var, z AS level, 0 AS ts, 0 AS x, 0 AS y, CASE k.var WHEN 'T' THEN 213 + 75 * exp(-z / 10000.0)
        ELSE 1013.25 * pow((exp(z / 10000.0) * 213 + 75) / 288.0, -9.80665 * 10000 / (287.05 * 213)) END AS v
    FROM (VALUES (0), (1000), (5000), (10000)) h(z), (VALUES ('P'), ('T')) k(var))"""
_add("gridarea", "gridarea m0", "m0", f"SELECT 'cell_area' AS var, 0 AS level, 0 AS ts, x, y, ({_AREAS})[y + 1] AS v FROM ({_CELLS})")
_add("gridweights", "gridweights m0", "m0", f"SELECT 'cell_weights' AS var, 0 AS level, 0 AS ts, x, y, ({_ROWS})[y + 1] AS v FROM ({_CELLS})")
_add("gridmask", "gridmask m0", "m0", f"SELECT 'grid_mask' AS var, 0 AS level, 0 AS ts, x, y, 1 AS v FROM ({_CELLS})")
_LAT = "radians(-78.75 + 22.5 * {})"
# by the haversine; a row's neighbours are 45 degrees of longitude off, and rows 22.5 degrees of latitude
_add("griddx", "griddx em", "em", f"SELECT 'dx' AS var, 0 AS level, 0 AS ts, x, y, 2 * 6371000 * asin(cos({_LAT.format('y')}) * sin(radians(22.5))) AS v FROM ({_CELLS})")
_add("griddy", "griddy em", "em", f"SELECT 'dy' AS var, 0 AS level, 0 AS ts, x, y, 6371000 * radians(22.5) AS v FROM ({_CELLS})")
_add("wct", "wct m0 -addc,3 m1", "m0 m1", _PAIR.format(v="CASE WHEN b.v + 3 >= 1.39 AND a.v <= 33 THEN 33 + (a.v - 33) * (0.478 + 0.237 * (sqrt((b.v + 3) * 3.6) - 0.0124 * (b.v + 3) * 3.6)) END"))
_add("hi", "hi -addc,30 m0 -addc,12 m1 -addc,50 m2", "m0 m1 m2", "SELECT a.var, a.level, a.ts, a.x, a.y, CASE WHEN a.v + 30 >= 26 AND c.v + 50 >= 40 THEN a.v + 30 + 5 / 9 * (b.v + 2) END AS v FROM m0 a JOIN m1 b USING (ts, x, y) JOIN m2 c USING (ts, x, y)")

# Along whole series and fields

for _n, _a in (("bandpass", ",20,90"), ("highpass", ",30"), ("lowpass", ",60"), ("fourier", ",-1"), ("harmonic", ",1,1"), ("spectrum", ",1,1"), ("eof", ",2"), ("eof3d", ",2"), ("eofspatial", ",1"), ("eoftime", ",1"), ("eof3dspatial", ",1"), ("eof3dtime", ",1")):
    _add(_n, f"{_n}{_a} m0", "m0", None, pick=1 if _n.startswith("eof") else 0)
for _n in ("gp2sp", "gp2fc"):
    _add(_n, f"{_n} -setgrid,n2 -selindexbox,1,8,1,4 m0", "m0", None)
_add("sp2gp", "sp2gp -gp2sp -setgrid,n2 -selindexbox,1,8,1,4 m0", "m0", None)
_add("fc2gp", "fc2gp -gp2fc m0", "m0", "SELECT * FROM m0")
_add("sp2sp", "sp2sp,1 -gp2sp -setgrid,n2 -selindexbox,1,8,1,4 m0", "m0", None)
_add("spcut", "spcut,1 -gp2sp -setgrid,n2 -selindexbox,1,8,1,4 m0", "m0", None)


def queries() -> dict[str, Query]:
    from isohyet import catalogue_more  # noqa: F401  registers more

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from isohyet import catalogue_more  # noqa: F401  registers more

    return dict(_SQL)
