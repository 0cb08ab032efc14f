"""Byte-level BPE by recursive DuckDB queries, one database per Python worker.

Each partition's new words become token-position rows. A recursive query joins
neighbouring tokens with the merge table and contracts every word's leftmost pair of
the lowest rank until no pair is left; ordered aggregation turns rows into id lists
and, for decoding, ids into bytes.

Words already seen by the worker are kept in a memo of bounded size, which is dropped
when full but for words met again; it changes the time only. Pieces over ``LONG_PIECE`` bytes (runs
without any break) go through the same contraction order with a heap, since one
contraction a round would need as many rounds as the piece has bytes.

Null texts read as empty and give an empty id list; null id lists decode to empty bytes;
other columns of the input are not looked at; rows are handled one by one, so
repeated rows and ids give repeated rows.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohyet.llm.common import small_batches

LONG_PIECE = 192
WORDS_A_QUERY = 10_000
MEMO_WORDS = 400_000
ROWS_A_DECODE = 200_000

ENCODE = """
WITH RECURSIVE step(place, token, done) AS (
    SELECT word::BIGINT * 256 + pos, token, false FROM seed
    UNION ALL
    SELECT place, token, done FROM (
        WITH live AS MATERIALIZED (SELECT place, token FROM step WHERE NOT done),
        ranked AS MATERIALIZED (
            SELECT a.place, m.merged::BIGINT * 256 + a.place % 256 AS ranking
            FROM live a JOIN live b ON b.place = a.place + 1
            JOIN merges m ON m.pair = a.token::BIGINT * 65536 + b.token
        ),
        best AS MATERIALIZED (SELECT place // 256 AS word, min(ranking) AS ranking FROM ranked GROUP BY 1)
        SELECT place - CASE WHEN place % 256 > ranking % 256 THEN 1 ELSE 0 END AS place,
               CASE WHEN place % 256 = ranking % 256 THEN (ranking // 256)::INTEGER ELSE token END AS token,
               ranking IS NULL AS done
        FROM live LEFT JOIN best ON best.word = place // 256
        WHERE ranking IS NULL OR place % 256 <> ranking % 256 + 1
    )
)
SELECT (place // 256)::INTEGER AS word, list(token ORDER BY place) AS ids FROM step WHERE done GROUP BY 1
"""

DECODE = """
SELECT doc, string_agg(v.hex, '' ORDER BY pos) AS bytes
FROM ids JOIN vocabulary v USING (token) GROUP BY doc
"""

#: Letters, digits and white space of these ranges mean the same to re and to regex.
PLAIN = re.compile("[^\t-\r -~\u0085 -±´-¸º»¿-ɏ]")
LETTER, NUMBER = r"[^\W\d_]", r"\d"


def splitter(pattern: str):
    """findall for *pattern*, by re where the text allows it, else by regex."""
    import regex

    full = regex.compile(pattern).findall
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", LETTER).replace(r"\p{N}", NUMBER)
    if r"\p" in plain:
        return full
    quick = re.compile(plain).findall
    return lambda text: full(text) if PLAIN.search(text) else quick(text)


class Vocabulary:
    """Ranks, merge table and memo of one vocabulary file in one process."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = splitter(pattern)
        self.memo: dict[str, bytes] = {}  # ids as int32
        self.again: set[str] = set()  # words met in more than one batch
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        merges = [(self.ranks[t[:i]] * 65536 + self.ranks[t[i:]], n) for t, n in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        pair, merged = (np.array(x, np.int64) for x in zip(*merges))
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "192MB", "temp_directory": ""})
        self.db.register("m", pa.table({"pair": pair, "merged": merged.astype(np.int32)}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.db.register("v", pa.table({"token": np.fromiter(self.ranks.values(), np.int32), "hex": [t.hex() for t in self.ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM v")

    def _long(self, word: bytes) -> bytes:
        """The same contractions for one long piece: lowest rank first, then leftmost."""
        parts = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[int, int, bytes, bytes]] = []

        def offer(i: int) -> None:
            if 0 <= i and (j := after[i]) < len(parts) and (r := self.ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            if parts[i] != left or (j := after[i]) >= len(parts) or parts[j] != right or not left:
                continue
            parts[i], parts[j] = left + right, b""
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return np.array([self.ranks[p] for p in parts if p], np.int32).tobytes()

    def learn(self, words: list[str]) -> None:
        """Encode words into the memo."""
        for k in range(0, len(words), WORDS_A_QUERY):
            some, raw = words[k : k + WORDS_A_QUERY], [w.encode() for w in words[k : k + WORDS_A_QUERY]]
            rest = []
            for i, b in enumerate(raw):
                if (r := self.ranks.get(b)) is not None:
                    self.memo[some[i]] = r.to_bytes(4, "little")
                elif len(b) > LONG_PIECE:
                    self.memo[some[i]] = self._long(b)
                else:
                    rest.append(i)
            if not rest:
                continue
            sizes = np.array([len(raw[i]) for i in rest])
            word = np.repeat(np.array(rest, np.int32), sizes)
            pos = (np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            token = self.single[np.frombuffer(b"".join(raw[i] for i in rest), np.uint8)]
            self.db.register("seed", pa.table({"word": word, "pos": pos, "token": token}))
            got = self.db.sql(ENCODE).to_arrow_table()
            ids = got["ids"].combine_chunks()
            flat, at = ids.values.to_numpy().tobytes(), (4 * ids.offsets.to_numpy()).tolist()
            for n, i in enumerate(got["word"].to_pylist()):
                self.memo[some[i]] = flat[at[n] : at[n + 1]]

    def recall(self, words: set[str]) -> None:
        """Have all words in the memo."""
        new = words.difference(self.memo)
        if len(new) + len(self.memo) > MEMO_WORDS:
            self.memo = {w: self.memo[w] for w in self.again}
            if len(self.memo) > MEMO_WORDS // 2:
                self.memo, self.again = {}, set()
            new = words.difference(self.memo)
        self.again |= words - new
        self.learn(list(new))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for lo in range(0, len(texts), 256):
            split = [self.pieces(t) for t in texts[lo : lo + 256]]
            self.recall(set().union(*split))
            get = self.memo.__getitem__
            out += [np.frombuffer(b"".join(map(get, x)), np.int32) for x in split]
        return out

    def decode(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Bytes of each document, of *sizes* ids each in *flat*."""
        out, ends, lo = [], np.cumsum(sizes), 0
        while lo < len(sizes):
            first = ends[lo] - sizes[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, first + ROWS_A_DECODE, "right")))
            token = flat[first : ends[hi - 1]]
            doc = np.repeat(np.arange(hi - lo, dtype=np.int32), sizes[lo:hi])
            self.db.register("ids", pa.table({"doc": doc, "pos": np.arange(len(token), dtype=np.int32), "token": token}))
            got = dict(self.db.execute(DECODE).fetchall())
            out += [bytes.fromhex(got.get(i, "")) for i in range(hi - lo)]
            lo = hi
        return out


_loaded: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Vocabulary(path, pattern)
    return _loaded[path, pattern]


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(df: DataFrame, vocabulary_path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row's whole text."""
    pattern = pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = v.encode([t or "" for t in part.column(1).to_pylist()])
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["id", "ids"])

    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return small_batches(df).select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary_path: str, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id and ids columns with decoded, the bytes that the ids stand for."""
    pattern = pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                lists = part.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(v.decode(flat, sizes), pa.binary())], names=["id", "ids", "decoded"])

    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    return small_batches(df).select(F.col(id_col), F.col(ids_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, vocabulary_path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) of every row's whole text: encode and decode in one Python worker a task instead of two."""
    pattern = pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = v.encode([t or "" for t in part.column(1).to_pylist()])
                sizes = np.array([len(x) for x in ids])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(v.decode(flat, sizes), pa.binary())], names=["id", "ids", "decoded"])

    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    return small_batches(df).select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)
