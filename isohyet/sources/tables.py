"""Small text tables: parameter tables, key = value lists, namelists. They are read on the driver."""

from __future__ import annotations

import re


def read_keys(path: str) -> dict[str, str]:
    """name = value lines; quotes are dropped, # starts a remark."""
    out = {}
    with open(path) as f:
        for line in f:
            name, sep, value = line.split("#", 1)[0].partition("=")
            if sep:
                out[name.strip()] = value.strip().strip("\"'")
    return out


def namelists(text: str) -> list[dict[str, str]]:
    """Every &group name = value, ... / of a text, with the group's name under group."""
    out = []
    for m in re.finditer(r"&(\w+)(.*?)(?:^|\s)/", text, re.S | re.M):
        entries = re.findall(r"(\w+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s,]+)", m[2])
        out.append({"group": m[1]} | {k: v.strip("\"'") for k, v in entries})
    return out


def read_table(path: str) -> list[dict[str, str]]:
    """Entries of a parameter table: namelist groups, or lines of code | level | name | longname | unit."""
    with open(path) as f:
        text = f.read()
    if "&" in text:
        return namelists(text)
    rows = [line.split("|") for line in text.splitlines() if line.strip() and line[0] not in "#!"]
    names = ["code", "level", "name", "longname", "unit"]
    return [dict(zip(names, (p.strip() for p in r))) for r in rows]


def read_entries(path: str) -> list[dict[str, str]]:
    """Entries of a table whose lines are key: value, and in which variable_entry or axis_entry begins an entry."""
    out: list[dict[str, str]] = [{}]
    with open(path) as f:
        for line in f:
            name, sep, value = line.split("!", 1)[0].partition(":")
            if not sep:
                continue
            if name.strip().endswith("_entry"):
                out.append({})
            out[-1][name.strip()] = value.strip()
    return [e for e in out if e]
