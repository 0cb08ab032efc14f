"""N-gram Jaccard join by chosen paths.

Texts become sets of hashed five-word shingles; texts of one set are one class from the
start. A step of a path is ``STEP`` tokens of a set, each the least one under a hash of its own. Every
run takes one step: sets that take the same share a bucket. Buckets over ``SMALL`` sets are
split again, recursively, by further steps that are picked for the path so far, and read from
the sets' sketches. Two tokens a step part sets that share a passage only: sets that have a
part f of their least tokens in common stay together with a probability of f squared. A
split that leaves over half of a bucket together tells nothing apart (near copies of one text); such
a bucket is compared as it is, so that sizes halve at least and the recursion ends. Runs and steps are as
many as it takes until a pair at the threshold is missed with a probability of at most 1 - ``RECALL`` at any depth.

Paths and clusters are made of (bucket, node) alone, node being a 64-bit hash of the set; sizes and
sketches are brought to the few rows that share a bucket. Sets that meet in one node are compared
once more, nothing else.

Buckets are brute-forced over 64-byte minhash sketches and leave a spanning forest of
likely pairs only, never all pairs. The components of these forests are clusters, and
inside a cluster all pairs are compared exactly, in square tiles of ``BLOCK``
sets a side where a cluster is larger. Tiles yield link counts per set and a spanning
forest of links; its components are the classes.

Defined results: words are parted by ASCII white space; a text of one to four words is
one shingle of all its words; null and wordless texts have no shingles, are linked
to nothing, and are classes of their own; classes are named by their least id; a row's
links are all other rows of similarity at or over the threshold, exact copies
included; null ids are kept and never name a class that has another id; repeated rows are
copies; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import boxed, small_batches, written
from isohyet.llm.graph import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
STEP = 2
SMALL = 500
BLOCK = 1024
SKETCH = 64
#: Rows of (id, cluster), of some 120 bytes, that may be broadcast; beyond, a join by shuffle.
BROADCAST_ROWS = 250_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_A = np.random.default_rng(11).integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_memo: dict[bytes, int] = {}


np.seterr(over="ignore")


def likely(threshold: float = THRESHOLD) -> int:
    """Matching sketch bytes that make a pair likely: six standard deviations below the threshold."""
    return int(SKETCH * threshold - 6 * math.sqrt(SKETCH * threshold * (1 - threshold)))


def missed(runs: int, splits: int, threshold: float = THRESHOLD) -> float:
    """How likely a pair at the threshold is in no common bucket, however deep the paths.

    The mean over the places that the two sketches share, as all steps are read from those.
    """
    total = 0.0
    for same in range(SKETCH + 1):
        chance = math.comb(SKETCH, same) * threshold**same * (1 - threshold) ** (SKETCH - same)
        step, below = math.comb(same, STEP) / math.comb(SKETCH, STEP), 0.0
        for _ in range(99):  # a level more each time, up to the limit
            below = (1 - step * (1 - below)) ** splits
        total += chance * (1 - step * (1 - below)) ** runs
    return total


@cache
def runs_for(threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(runs, steps into which a bucket is split): the least sum of both that misses no more than allowed."""
    most = SKETCH // STEP
    for total in range(2, 16 * most):
        for splits in range(1, min(most, total - 1) + 1):
            if missed(total - splits, splits, threshold) <= 1 - recall:
                return total - splits, splits
    raise ValueError(f"a sketch of {SKETCH} places does not find pairs of a similarity of {threshold}")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit values; products wrap around."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingles."""
    import xxhash

    split = text.encode().split()
    if not split:
        return np.zeros(0, np.uint64)
    if len(_memo) > 150_000:
        _memo.clear()
    new = set(split).difference(_memo)
    _memo.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
    ids = np.fromiter(map(_memo.__getitem__, split), np.uint64, len(split))
    n = max(1, len(ids) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(ids))):
        out = _mixed(out + _MIX) ^ ids[k : k + n]
    return np.unique(_mixed(out + np.uint64(min(words, len(ids)))))


def least(tokens: np.ndarray) -> np.ndarray:
    """The least value of a set under each of the hashes."""
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(tokens), 4096):
        low = np.minimum(low, (tokens[k : k + 4096, None] * _A).min(axis=0))
    return low


def sketch(low: np.ndarray) -> bytes:
    return (_mixed(low) & np.uint64(255)).astype(np.uint8).tobytes()


def paths(low: np.ndarray, runs: int) -> np.ndarray:
    """The buckets of a set: the first step of each run. No two runs take the same places."""
    run = np.arange(runs)
    first, apart = STEP * run % SKETCH, 1 + STEP * (run // (SKETCH // STEP))
    keys = run.astype(np.uint64) * _MIX
    for k in range(STEP):
        keys = _mixed(keys + _MIX) ^ low[(first + k * apart) % SKETCH]
    return _mixed(keys).astype(np.int64)


def sets(df: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    """(id, key, name, n, sketch, buckets): a row for each text; name: a hash of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                name, size, drawn, buckets = [], [], [], []
                for text in part.column(2).to_pylist():
                    tokens = shingles(text or "")
                    low = least(tokens)
                    name.append(xxhash.xxh3_128_digest(tokens.tobytes())), size.append(len(tokens))
                    drawn.append(sketch(low)), buckets.append(paths(low, runs))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(name, pa.binary()), pa.array(size, pa.int32()), pa.array(drawn, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], names=["id", "key", "name", "n", "sketch", "buckets"])

    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    schema = f"id {kind}, key long, name binary, n int, sketch binary, buckets array<long>"
    return small_batches(df).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(run, schema)


class Forest:
    """Union-find over row numbers; edges() are its tree edges."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Union of rows a with rows b, in whole arrays: hook, then jump until nothing moves."""
        while len(a):
            while True:
                up = self.up[self.up]
                if (up == self.up).all():
                    break
                self.up = up
            x, y = self.up[a], self.up[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        own = np.arange(len(self.up))
        while (up := self.up[self.up]).tolist() != self.up.tolist():
            self.up = up
        return own[self.up != own], self.up[self.up != own]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of sorted rows, many at once: rows, and where groups begin; the first *keys* columns are the key."""
    held: pa.Table | None = None

    def begins(rows: pa.Table) -> np.ndarray:
        new = np.zeros(len(rows), bool)
        new[0] = True
        for c in rows.columns[:keys]:
            x = np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else c.to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        start = begins(rows)
        held = rows.slice(start[-1])
        if len(start) > 1:
            yield rows.slice(0, start[-1]), start[:-1]
    if held is not None:
        yield held, np.zeros(1, int)


def _likely(rows: pa.Table, start: np.ndarray, threshold: float) -> tuple[pa.Array, pa.Array]:
    """Spanning forests of the likely pairs within the groups of rows, as nodes (a, b)."""
    node, n, of = rows["node"].combine_chunks(), rows["n"].to_numpy(), rows["_of"].to_numpy()
    codes = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(rows), SKETCH)
    stop = np.repeat(np.append(start[1:], len(rows)), np.diff(np.append(start, len(rows))))
    least_same = likely(threshold)
    forest = Forest(len(rows))
    left = np.arange(len(rows))
    for k in range(1, int(np.diff(np.append(start, len(rows))).max())):
        left = left[left + k < stop[left]]
        a, b = left, left + k
        fits = (np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])) & ((of[a] != of[b]) | (of[a] == 0))
        a, b = a[fits], b[fits]
        near = (codes[a] == codes[b]).sum(axis=1) >= least_same
        forest.join(a[near], b[near])
    a, b = forest.edges()
    return node.take(pa.array(a)), node.take(pa.array(b))


def _pair_tiles(df: DataFrame, name: str, size: str, side: int) -> DataFrame:
    """df with _x, _y, _of: square tiles of a group's rows; _of: 0 both sides, 1 left, 2 right.

    A group of one block makes one tile; a row of a larger one goes to as many
    tiles as the group has blocks.
    """
    blocks = F.ceil(F.col(size) / side).cast("int")
    own = F.pmod(F.xxhash64(name), blocks).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(own, k).alias("x"), F.greatest(own, k).alias("y"), F.when(own == k, 0).when(own < k, 1).otherwise(2).alias("of")))
    return df.withColumn("_t", F.explode(tiles)).withColumn("_x", F.col("_t.x")).withColumn("_y", F.col("_t.y")).withColumn("_of", F.col("_t.of")).drop("_t")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of buckets of two and more, with the bucket's size; a written table.

    Large buckets are few; their sizes are brought to the rows, so that only rows of small ones are shuffled.
    """
    sizes = written(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    hot = sizes.where(F.col("size") > SMALL)
    if hot.count() > BROADCAST_ROWS:
        return written(rows.join(sizes, "bucket"))
    flagged = rows.join(F.broadcast(hot.withColumnRenamed("size", "_hot")), "bucket", "left")
    small = flagged.where("_hot is null").drop("_hot").join(sizes.where(F.col("size") <= SMALL), "bucket")
    return written(flagged.where("_hot is not null").withColumnRenamed("_hot", "size").unionByName(small))


def _steps(splits: int) -> Column:
    """Buckets below ``bucket``: what the sketch has at places that the path picks, ``STEP`` of them a bucket, none twice."""
    first, apart = F.pmod(F.xxhash64("bucket"), F.lit(SKETCH)), 2 * F.pmod(F.xxhash64("bucket", F.lit(1)), F.lit(SKETCH // 2)) + 1
    at = lambda k: F.substring("sketch", F.pmod(first + k * apart, F.lit(SKETCH)).cast("int") + 1, F.lit(1))
    return F.array(*[F.xxhash64("bucket", F.lit(k), *[at(STEP * k + i) for i in range(STEP)]) for k in range(splits)])


def _leaves(reps: DataFrame, threshold: float) -> DataFrame:
    """(bucket, size, node, n, sketch): the buckets that are compared."""
    own = reps.where("n > 0").select("node", "n", "sketch", "buckets")
    sketches = own.select("node", "n", "sketch")
    level = written(_sized(own.select("node", F.explode("buckets").alias("bucket"))).join(sketches, "node"))
    row = ["bucket", "size", "node", "n", "sketch"]
    leaves = level.where(F.col("size") <= SMALL).select(*row)
    large = level.where(F.col("size") > SMALL)
    _, splits = runs_for(threshold)
    while not large.isEmpty():
        split = written(large.select("node", "n", "sketch", F.col("bucket").alias("parent"), F.col("size").alias("of"), F.explode(_steps(splits)).alias("bucket")))
        level = _sized(split)
        parts = level.groupBy("parent").agg(F.first("of").alias("of"), F.max("size").alias("most")).where(F.col("most") * 2 > F.col("of"))
        together = written(parts.select(F.col("parent").alias("bucket")))
        few = F.broadcast if together.count() <= BROADCAST_ROWS else lambda df: df
        leaves = leaves.unionByName(large.join(few(together), "bucket", "left_semi").select(*row))
        apart = level.join(few(together.withColumnRenamed("bucket", "parent")), "parent", "left_anti")
        leaves = leaves.unionByName(apart.where(F.col("size") <= SMALL).select(*row))
        large = apart.where(F.col("size") > SMALL)
    return leaves


def _candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a spanning forest of likely pairs of every bucket, as nodes."""
    buckets = _pair_tiles(_leaves(reps, threshold), "node", "size", BLOCK)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, start in _groups(batches, 3):
            yield pa.RecordBatch.from_arrays([*_likely(rows, start, threshold)], names=["a", "b"])

    keys = ["bucket", "_x", "_y"]
    together = buckets.select(*keys, "_of", "node", "n", "sketch").repartition(*keys).sortWithinPartitions(*keys)
    return together.mapInArrow(pairs, "a long, b long").distinct()


def overlaps(tokens: list[np.ndarray]) -> np.ndarray:
    """Common tokens of all pairs of sets. Frequent tokens by matrix product, others pair by pair."""
    rows = len(tokens)
    owner = np.repeat(np.arange(rows), [len(t) for t in tokens])
    flat = np.concatenate(tokens) if rows else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, int)
    count = np.diff(np.append(start, len(flat)))
    common = np.zeros((rows, rows), np.float32)
    often = np.flatnonzero(count > max(1, rows // 50))
    for lo in range(0, len(often), 2048):
        some = often[lo : lo + 2048]
        own = np.zeros((rows, len(some)), np.float32)
        column = np.repeat(np.arange(len(some)), count[some])
        at = np.repeat(start[some] - np.concatenate([[0], np.cumsum(count[some])[:-1]]), count[some]) + np.arange(len(column))
        own[owner[at], column] = 1
        common += own @ own.T
    cells = common.reshape(-1)
    for c in np.unique(count[(count > 1) & (count <= max(1, rows // 50))]):
        own = owner[start[count == c][:, None] + np.arange(c)]
        for i in range(c):
            for j in range(c):
                if i != j:
                    np.add.at(cells, own[:, i] * rows + own[:, j], np.float32(1))
    return common


def _exact(name: np.ndarray, copies: np.ndarray, of: np.ndarray, blobs: list[bytes], threshold: float) -> tuple[list, list, list]:
    """Links of one tile: (name, weighted links, a linked name of the spanning forest or null)."""
    _, own = np.unique(name, return_index=True)  # repeated rows bring a set along again
    name, copies, of = name[own], copies[own], of[own]
    tokens = [np.frombuffer(blobs[i], np.uint64) for i in own]
    size = np.array([len(t) for t in tokens])
    common = overlaps(tokens)
    near = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
    np.fill_diagonal(near, False)
    near &= (of[:, None] != of[None, :]) | (of[:, None] == 0)
    links = near @ copies
    forest = Forest(len(name))
    forest.join(*np.nonzero(np.triu(near)))
    a, b = forest.edges()
    other = np.full(len(name), None, object)
    other[a] = name[b]
    some = np.flatnonzero(links)
    return name[some].tolist(), links[some].tolist(), other[some].tolist()


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, key, class_id, links): every row's class and the number of its links; key: xxhash64 of its text."""
    rows = written(sets(df, id_col, text_col, runs_for(threshold)[0]))
    reps = rows.groupBy("name").agg(F.min(F.struct("id", "key")).alias("of"), F.min("id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("buckets").alias("buckets"))
    reps = written(reps.withColumn("node", F.xxhash64("name")))
    clusters = components(_candidates(reps, threshold))
    sized = clusters.groupBy("root").agg(F.count("*").alias("size"))
    member = written(reps.join(clusters.join(sized, "root"), "node").select("name", "copies", F.col("of.id").alias("_id"), F.col("of.key").alias("_key"), F.col("root").alias("cluster"), "size"))
    side = F.broadcast(member) if member.count() <= BROADCAST_ROWS else member
    text = F.coalesce(F.col(text_col), F.lit(""))
    picked = df.select(F.col(id_col).alias("id"), text.alias("text")).join(side, F.col("id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))).select("name", "copies", "cluster", "size", "text")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([shingles(t).tobytes() for t in b.column(4).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], made], names=["name", "copies", "cluster", "size", "tokens"])

    full = picked.mapInArrow(tokens, "name binary, copies long, cluster long, size long, tokens binary")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, start in _groups(batches, 3):
            name, copies, of, blobs = np.array(rows["name"].to_pylist(), object), rows["copies"].to_numpy(), rows["_of"].to_numpy(), rows["tokens"].to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            for lo, hi in zip(start, np.append(start[1:], len(rows))):
                for all_, own in zip(out, _exact(name[lo:hi], copies[lo:hi], of[lo:hi], blobs[lo:hi], threshold)):
                    all_ += own
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["name", "links", "other"])

    keys = ["cluster", "_x", "_y"]
    tiles = _pair_tiles(full, "name", "size", BLOCK).select(*keys, "_of", "name", "copies", "tokens").repartition(*keys).sortWithinPartitions(*keys)
    links = written(tiles.mapInArrow(exact, "name binary, links long, other binary"))
    classes = components(links.where("other is not null").select(F.col("name").alias("a"), F.col("other").alias("b")))
    counts = links.groupBy("name").agg(F.sum("links").alias("links"))
    known = reps.select("name", "least", "copies").join(classes, F.col("name") == F.col("node"), "left").select("name", "least", "copies", F.coalesce("root", "name").alias("class"))
    named = known.join(counts, "name", "left").select("name", "class", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    named = written(named)
    least = named.groupBy("class").agg(F.min("least").alias("class_id"))
    final = written(named.join(least, "class").select("name", "class_id", "links"))
    joined = rows.select("id", "key", "name", "n").join(final, "name")
    linked = F.col("n") > 0
    return joined.select(F.col("id").alias(id_col), "key", F.when(linked, F.col("class_id")).otherwise(F.col("id")).alias("class_id"), F.when(linked, F.col("links")).otherwise(0).cast("long").alias("links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the later members of each class: the row of the least id stays, with all its columns.

    Of rows equal in id and text one stays; only where there are any, those rows are shuffled.
    """
    found = join(docs, id_col, text_col, threshold)
    gone = written(found.where((F.col(id_col) > F.col("class_id")) | (F.col(id_col).isNull() & F.col("class_id").isNotNull())).select(F.col(id_col).alias("_id"), F.col("key").alias("_key")).distinct())
    few = gone.count() <= BROADCAST_ROWS
    own = boxed(docs, _of=docs[id_col], _own=F.xxhash64(F.coalesce(docs[text_col], F.lit(""))))
    left = own.join(F.broadcast(gone) if few else gone, F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key")), "left_anti")
    twice = written(found.groupBy(F.col(id_col).alias("_id"), F.col("key").alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    same = F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_key"))
    n = twice.count()
    if n:
        side = F.broadcast(twice) if n <= BROADCAST_ROWS else twice
        left = left.join(side, same, "left_anti").unionByName(left.join(side, same, "left_semi").dropDuplicates(["_of", "_own"]))
    return left.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
