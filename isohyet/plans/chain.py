"""Operator chains as text: run("fldmean -sellonlatbox,0,90,0,90 -timmean in", {"in": dataset})."""

from __future__ import annotations

import shlex
from typing import Any

from isohyet.dataset import Dataset
from isohyet.operators import registry


def _value(text: str) -> Any:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def _split(token: str) -> tuple[str, list[Any]]:
    """The operator's name and its arguments, which commas part."""
    name, *args = token.split(",")
    return name.lstrip("-"), [_value(a) for a in args]


def run(text: str, inputs: dict[str, Dataset] | None = None, spark: Any = None) -> Any:
    """Evaluate a chain. An operator takes the next inputs that it needs; one of any number takes all that are left.

    The result is a plan: nothing runs before its rows are asked for.
    """
    inputs = inputs or {}
    words = shlex.split(text)
    at = 0

    def operand() -> Any:
        nonlocal at
        if at >= len(words):
            raise ValueError("an input is missing")
        word = words[at]
        at += 1
        return inputs[word] if word in inputs else operator(word)

    def operator(word: str) -> Any:
        name, args = _split(word)
        found = registry.get(name)
        if found.inputs == 0:
            return found.run(spark, *args) if found.name != "specinfo" else found.run(*args)
        own: list[Any] = []
        while (found.inputs < 0 and at < len(words)) or len(own) < found.inputs:
            made = operand()
            own += list(made) if isinstance(made, (tuple, list)) else [made]
        return found.run(own, *args) if found.inputs < 0 else found.run(*own[: found.inputs], *args)

    word = words[0]
    at = 1
    out = inputs[word] if word in inputs else operator(word)
    if at != len(words):
        raise ValueError(f"not used: {' '.join(words[at:])}")
    return out
