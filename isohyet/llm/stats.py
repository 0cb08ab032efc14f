"""Counts over whole texts, for the quality classifier and the quality rules.

Null texts read as empty; every count of an empty text is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import small_batches

SYMBOLS = "#*$%&|<>"
#: All counts, in order.
COUNTS = ["n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_echoes", "n_upper", "n_letters", "n_digits", "n_bangs", "n_stops"]

_UPPER, _LETTER, _DIGIT, _SPACE, _SYMBOL, _BANG, _STOP, _NEWLINE = (1 << k for k in range(8))
_TABLE = np.zeros(0x800, np.uint8)
for _c in range(0x800):
    _s = chr(_c)
    _TABLE[_c] = _UPPER * _s.isupper() | _LETTER * _s.isalpha() | _DIGIT * (_s in "0123456789") | _SPACE * (_c == 32 or 9 <= _c <= 13) | _SYMBOL * (_s in SYMBOLS) | _BANG * (_s == "!") | _STOP * (_s in ".,;:?") | _NEWLINE * (_s == "\n")
_PAIRS = np.array([[c >> k & 1 for k in range(8)] for c in range(256)], np.int64)


def _repeats(ids: np.ndarray) -> int:
    """Words covered by 3-word windows that are found twice or more."""
    if len(ids) < 4:
        return 0
    top = int(ids.max()) + 1
    if top < 2_000_000:
        keys = (ids[:-2] * top + ids[1:-1]) * top + ids[2:]
    else:
        keys = np.unique(ids[:-2] * top + ids[1:-1], return_inverse=True)[1] * top + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    covered = np.zeros(len(ids), bool)
    for at in (order[1:][same], order[:-1][same]):
        covered[at] = covered[at + 1] = covered[at + 2] = True
    return int(covered.sum())


def count(text: str) -> list[int]:
    """COUNTS of one text. Words are split at ASCII white space."""
    if not text:
        return [0] * len(COUNTS)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = np.bincount(_TABLE[np.where(points < 0x800, points, 0)], minlength=256) @ _PAIRS
    upper, letters, digits, spaces, symbols, bangs, stops, breaks = map(int, kinds)
    high = int((points >= 0x800).sum())
    words = text.encode().split()
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    lines = text.split("\n") if breaks else ()
    seen: set[str] = set()
    again = 0
    for line in lines:
        if line in seen:
            again += bool(line.encode().split())
        else:
            seen.add(line)
    return [len(points), len(words), len(points) - spaces, symbols, breaks + 1, again, _repeats(ids), len(known), int((ids[1:] == ids[:-1]).sum()), upper, letters + high, digits, bangs, stops]


def counted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts array<long>) of every whole text; counts as COUNTS lists them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                rows = [count(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["id", "counts"])

    return small_batches(df).select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, counts array<bigint>").withColumnRenamed("id", id_col)
