"""Operators by name: how many inputs they take, and what they do."""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Operator:
    name: str
    run: Callable[..., Any]
    inputs: int  # -1: any number


OPERATORS: dict[str, Operator] = {}
MODULES = ["select", "values", "pairs", "stats", "windows", "modify", "relate", "indices", "interpolate", "remap", "spectral", "generate", "physics", "info", "files", "expression", "ensemble"]
#: Other names of operators (fixed values).
ALIASES = {
    "anomaly": "ymonsub", "deltap_fl": "deltap", "diffv": "diffn", "covar0": "timcovar", "covar0r": "fldcovar", "gather": "collgrid", "geopotheight": "gheight",
    "ggstat": "info", "ggstats": "sinfo", "globavg": "fldavg", "infos": "sinfo", "infov": "infon", "intgrid": "intgridbil", "log": "ln", "lmean": "ymonmean",
    "lmmean": "ymonmean", "lmavg": "ymonavg", "lmstd": "ymonstd", "lsmean": "yseasmean", "chvar": "chname", "ncode": "npar", "nvar": "npar", "outputkey": "outputtab",
    "vardes": "pardes", "delvar": "delname", "vardup": "pardup", "varmul": "parmul", "read_e5ml": "import_e5ml", "remapcon1": "remaplaf", "remapdis1": "remapnn",
    "scatter": "distgrid", "showvar": "showname", "selgridname": "selgrid", "selzaxisname": "selzaxis", "selvar": "selname", "setvar": "setname", "setpartabv": "setpartabn",
    "sinfov": "sinfon", "sortvar": "sortname", "splitvar": "splitname", "sort": "timsort", "write_e5ml": "export_e5ml", "eca_r1mm": "eca_rr1", "fpressure": "pressure_fl",
    "hpressure": "pressure_hl", "ensrkhistspace": "ensrkhist_space", "ensrkhisttime": "ensrkhist_time",
}


def op(*names: str, inputs: int | None = None) -> Callable:
    """Register a function; its first parameters are the datasets, one of them a list for any number."""

    def add(f: Callable) -> Callable:
        for name in names:
            n = inputs if inputs is not None else sum(p.annotation in ("Dataset", "DataFrame") for p in inspect.signature(f).parameters.values())
            OPERATORS[name] = Operator(name, f, n)
        return f

    return add


def put(name: str, f: Callable, inputs: int = 1) -> None:
    OPERATORS[name] = Operator(name, f, inputs)


def load() -> None:
    """Import all operators. Their column expressions need a running session."""
    for m in MODULES:
        importlib.import_module(f"isohyet.operators.{m}")


def known(name: str) -> bool:
    load()
    return ALIASES.get(name, name) in OPERATORS


def get(name: str) -> Operator:
    load()
    name = ALIASES.get(name, name)
    if name not in OPERATORS:
        raise KeyError(f"no operator is named {name}")
    return OPERATORS[name]


def apply(name: str, datasets: list, *args: Any) -> Any:
    found = get(name)
    if found.inputs >= 0:
        datasets, rest = datasets[: found.inputs], [*datasets[found.inputs :], *args]
        if len(datasets) < found.inputs:
            datasets, rest = [*datasets, *rest[: found.inputs - len(datasets)]], rest[found.inputs - len(datasets) :]
        return found.run(*datasets, *rest)
    more = [a for a in args if hasattr(a, "cells")]
    return found.run([*datasets, *more], *[a for a in args if not hasattr(a, "cells")])
