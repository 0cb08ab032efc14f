"""Best-fit packing: length patterns fitted to the length histogram by non-negative least squares.

Only the histogram of piece lengths (at most ``capacity`` rows, whatever the corpus)
reaches the driver. There, patterns of up to three lengths that fill a sequence are
enumerated, their repeat counts are fitted to the histogram by non-negative least
squares and rounded down, and what is left over is packed best fit first, again in
repeated patterns: every step uses up a length or the room of a pattern, so
the plan's size depends on the capacity only.

Pieces get a number within their length and the task that read them, and that task's count
of a length a base, the number of pieces of that length in the tasks before. What meets in
one task is a row a task for one length, however frequent the length. The piece's number
then tells its sequence and offset by a search in the plan.

Special strings in texts are what the tokenizer file makes of them: an added token's one id.

Defined results: an empty table gives no rows; null texts are empty documents of the one
closing id; a piece longer than the capacity is an error; equal rows are packed
separately; other columns are not looked at by ``pack_documents``, and are kept by ``pack``, but
those named sequence_id or offset give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohyet.llm.common import small_batches, written

CAPACITY = 2048
#: Lengths of this many kinds at most start triples; pairs cover all lengths.
TRIPLE_STARTS = 64
_encoders: dict = {}


def _encoder(path: str):
    """The ids that the tokenizer file gives a text without adding special tokens.

    Merge ranks, splitting and added tokens are read from the file; added tokens that do
    more than stand for their own string are left to the tokenizer itself.
    """
    if path not in _encoders:
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        added = spec["added_tokens"]
        plain = not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added)
        if plain and spec["model"]["type"] == "BPE" and spec.get("normalizer") is None and pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": pre.get("trim_offsets"), "use_regex": True}:
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printable)}
            special = {a["content"]: a["id"] for a in added}
            ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
            fast = tiktoken.Encoding("pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            _encoders[path] = lambda text: np.array(fast.encode(text, allowed_special="all"), np.uint32)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            _encoders[path] = lambda text: np.array(t.encode(text, add_special_tokens=False).ids, np.uint32)
    return _encoders[path]


def cut(df: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids) of every whole text, closed by *end_id*.

    Documents longer than *capacity* are cut so that only the first piece is shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                row, piece, start, length, blobs = [], [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    for k, at in enumerate([0, *range(first, len(ids), capacity)]):
                        to = first if k == 0 else at + capacity
                        row.append(i), piece.append(k), start.append(at), length.append(to - at), blobs.append(ids[at:to].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(blobs, pa.binary())],
                    names=["id", "piece", "start", "length", "ids"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return small_batches(df).select(id_col, text_col).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


def patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths (0: none) that fill a sequence, or nearly so, from *present* lengths."""
    have = np.zeros(capacity + 1, bool)
    have[present] = True
    rows = [(capacity, 0, 0)] if have[capacity] else []
    below = np.maximum.accumulate(np.where(have, np.arange(capacity + 1), 0))  # the longest length that fits
    rows += [(a, b, 0) for a in present if 2 * a >= capacity > a and (b := below[capacity - a])]
    starts = present[np.unique(np.linspace(0, len(present) - 1, TRIPLE_STARTS).astype(int))]
    rows += [(a, b, c) for a in starts for b in present if b <= a and 0 < capacity - a - b <= b and (c := below[capacity - a - b])]
    return np.unique(np.array(rows, int).reshape(-1, 3), axis=0)


def fit(rows: np.ndarray, histogram: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Repeat counts x >= 0 of least ||A x - histogram||, by multiplicative updates."""
    x = histogram[rows].max(axis=1).astype(float) / 2 + 1e-9
    weight = rows > 0
    wanted = (histogram[rows] * weight).sum(axis=1)
    for _ in range(rounds):
        made = np.bincount(rows.ravel(), weights=(x[:, None] * weight).ravel(), minlength=len(histogram))
        x *= wanted / np.maximum((made[rows] * weight).sum(axis=1), 1e-12)
    return x


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, times) that use up *histogram*, longest first in each sequence."""
    left, found = histogram.astype(np.int64).copy(), []
    left[0] = 0
    present = np.flatnonzero(left)
    rows = patterns(present, capacity) if len(present) else np.zeros((0, 3), int)
    if len(rows):
        x = fit(rows, left)
        for n in np.argsort(-x, kind="stable"):
            own, times = np.unique(rows[n][rows[n] > 0], return_counts=True)
            k = min(int(x[n]), int((left[own] // times).min()))
            if k > 0:
                left[own] -= k * times
                found.append((sorted((int(a) for a in rows[n] if a), reverse=True), k))
    while left.any():
        room, own = capacity, []
        spare = left.copy()
        while fits := int(np.flatnonzero(spare[: room + 1])[-1]) if spare[: room + 1].any() else 0:
            own.append(fits)
            spare[fits] -= 1
            room -= fits
        kinds, times = np.unique(own, return_counts=True)
        k = int((left[kinds] // times).min())
        left[kinds] -= k * times
        found.append((own, k))
    return found


def places(found: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first number, first sequence, number of its places in the pattern, their offsets."""
    out: dict[int, list] = {}
    sequence = 0
    for own, k in found:
        at: dict[int, list[int]] = {}
        offset = 0
        for length in own:
            at.setdefault(length, []).append(offset)
            offset += length
        for length, offsets in at.items():
            rows = out.setdefault(length, [])
            first = rows[-1][0] + rows[-1][2] * len(rows[-1][3]) if rows else 0
            rows.append((first, sequence, k, offsets))
        sequence += k
    return out


def numbered(pieces: DataFrame, length_col: str = "length") -> DataFrame:
    """(_piece, _task, _nth): the rows of pieces as structs, each with the task that read it and its number of that length there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
        for b in batches:
            length = b.column(0).field(length_col).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(length) and length.min() < 0:
                raise ValueError("piece lengths must be positive")
            seen = np.append(seen, np.zeros(max(0, int(length.max(initial=0)) + 1 - len(seen)), np.int64))
            order = np.argsort(length, kind="stable")
            own = length[order]
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
            nth = np.empty(len(own), np.int64)
            nth[order] = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own)))) + seen[own]
            seen += np.bincount(own, minlength=len(seen))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(own), task, np.int32)), pa.array(nth)], names=["_piece", "_task", "_nth"])

    boxed = pieces.select(F.struct(*[pieces[c] for c in pieces.columns]).alias("_piece"))
    return boxed.mapInArrow(run, T.StructType([*boxed.schema.fields, T.StructField("_task", T.IntegerType()), T.StructField("_nth", T.LongType())]))


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """*pieces* with sequence_id and offset; pieces is read once, and written with its numbers."""
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    own = written(numbered(pieces.select(*[pieces[c] for c in names]), length_col)).withColumn("_length", F.col(f"_piece.`{length_col}`").cast("long"))
    counts = written(own.groupBy("_length", "_task").agg(F.count("*").alias("_n")))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("_length").agg(F.sum("_n").alias("n")).limit(capacity + 2).collect():
        if r["_length"] is None or not 0 < r["_length"] <= capacity:
            raise ValueError(f"piece lengths must be within 1 and {capacity}")
        histogram[r["_length"]] = r["n"]
    found = places(plan(histogram, capacity))
    shared = spark.sparkContext.broadcast(found)  # bounded by the capacity

    def place(batches: Iterator) -> Iterator:
        found = shared.value
        for b in batches:
            length, number = b.column(1).to_numpy(), b.column(2).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                parts = found[int(length[rows[0]])]
                at = np.searchsorted(np.array([p[0] for p in parts]), number[rows], "right") - 1
                for a in np.unique(at):
                    of = at == a
                    first, seq, times, offsets = parts[a]
                    rel = number[rows][of] - first
                    sequence[rows[of]] = seq + rel % times
                    offset[rows[of]] = np.array(offsets)[rel // times]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sequence), pa.array(offset)], names=["_piece", "sequence_id", "offset"])

    before = F.sum("_n").over(W.partitionBy("_length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1))
    base = counts.select(F.col("_length").alias("_l"), F.col("_task").alias("_t"), F.coalesce(before, F.lit(0)).alias("_base"))
    based = own.join(base, (F.col("_length") == F.col("_l")) & (F.col("_task") == F.col("_t"))).select("_piece", "_length", (F.col("_base") + F.col("_nth")).alias("_number"))
    kinds = T.StructType([own.schema["_piece"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return based.mapInArrow(place, kinds).select(*[F.col("_piece")[c].alias(c) for c in names], "sequence_id", "offset")


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut, checksum and pack documents; ids themselves are left out of the shuffled rows."""
    own = cut(df, tokenizer_path, 0, capacity, id_col, text_col)
    return pack(own.select(F.col(id_col), "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)
