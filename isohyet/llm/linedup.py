"""Line dedup: repeated line runs by prefix doubling over line-ID sequences.

In DataFrame functions only. Lines become IDs, the ranks of the distinct repeated lines;
lines that occur once end every repeated run and drop out at once. Prefix doubling
then gives each position the rank of its next 2, 4, 8 ... lines: pairs of ranks are
reduced to distinct pairs, sorted over ranges and numbered, which are the ranks of
the suffix array to that depth, and joined back. A run of L lines is named by the two
ranks of the largest power of two within it, at its begin and at its end: positions
of one name are a longest-common-prefix interval of depth L or more.

A line is deleted where it lies in a run of at least ``min_words`` words that
occurs earlier in the corpus, by (id, text hash, line). Such maximal runs are the unions of
their shortest sub-runs of that many words, begun or ended at each line; only those
need names, so the depth never exceeds min_words lines and the rounds
log2(min_words), whatever the corpus. A passage within one document counts too.

Every group is reduced to its first position by a partial aggregate, and joined back from
a written table, so that no group meets in one task: where a name is frequent, the join's other side
is read in parts.

Defined results: null texts have no lines and stay null; lines without a word are never
deleted and do not part a run; rows equal in id and text are one document and
lose the same lines; null ids come first; texts that lose nothing are unchanged; all
other columns stay, one named as the column of lost lines too (``lost_column``); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isohyet.llm.common import boxed, let, written

MIN_WORDS = 10
#: Line numbers to delete that may be broadcast to the texts, at some 30 bytes; beyond, texts are shuffled to them.
BROADCAST_LINES = 1_000_000
_BLANK = r"[\x20\x09-\x0D]+"


def _capped_words(line: Column, cap: int) -> Column:
    """Words of a line, counted to *cap* at most."""
    return F.size(F.filter(F.split(line, _BLANK, cap + 2), lambda w: F.length(w) > 0))


def _lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(doc, key, i, n, h1, h2, words) of every line with a word; i counts those, n all lines."""
    text = F.col(text_col)
    parts = F.transform(F.split(text, "\n", -1), lambda x, n: F.struct(n.alias("n"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("line"), x).alias("h2"), _capped_words(x, min_words).alias("words")))
    full = F.filter(parts, lambda p: p["words"] > 0)
    rows = docs.where(text.isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("key"), F.posexplode(full).alias("i", "line"))
    return rows.select("doc", "key", "i", "line.n", "line.h1", "line.h2", F.least("line.words", F.lit(min_words)).alias("words"))


def _ranked(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Order-preserving numbers of distinct keys: sorted over ranges, then numbered."""
    return written(groups.sort(*keys).withColumn("r", F.monotonically_increasing_id()))


def _at(doc: str = "doc", key: str = "key", i: str = "i") -> Column:
    return F.struct(F.col(doc).alias("doc"), F.col(key).alias("key"), F.col(i).alias("i"))


def _runs(level0: DataFrame, min_words: int) -> DataFrame:
    """(doc, key, i, size): shortest runs of min_words words begun or ended at each position."""
    order = W.partitionBy("doc", "key").orderBy("i")
    blocks = level0.withColumn("block", F.col("i") - F.row_number().over(order))
    of = W.partitionBy("doc", "key", "block").orderBy("i")
    ahead = F.collect_list("words").over(of.rowsBetween(0, min_words - 1))
    behind = F.reverse(F.collect_list("words").over(of.rowsBetween(1 - min_words, 0)))

    def shortest(words: Column) -> Column:
        """Lines until min_words words are reached; null if they never are."""
        state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"))
        return F.aggregate(
            words,
            state,
            lambda s, w: F.when(s["sum"] >= min_words, s).otherwise(F.struct((s["n"] + 1).alias("n"), (s["sum"] + w).alias("sum"))),
            lambda s: F.when(s["sum"] >= min_words, s["n"]),
        )

    found = blocks.select("doc", "key", "i", shortest(ahead).alias("begun"), shortest(behind).alias("ended"))
    both = F.array(F.struct(F.col("i"), F.col("begun").alias("size")), F.struct((F.col("i") - F.col("ended") + 1).alias("i"), F.col("ended").alias("size")))
    runs = found.select("doc", "key", F.explode(F.array_distinct(F.filter(both, lambda r: r["size"].isNotNull()))).alias("run"))
    return runs.select("doc", "key", "run.i", "run.size")


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, key, lines): numbers, from 0, of the lines that each document loses; a written table."""
    lines = written(_lines(docs, id_col, text_col, min_words))
    repeated = lines.groupBy("h1", "h2").agg(F.count("*").alias("count"), F.min(_at()).alias("first")).where("count > 1").drop("count")
    ids = _ranked(repeated, ["h1", "h2"])
    level = written(lines.join(ids, ["h1", "h2"]).select("doc", "key", "i", "n", "words", "r", "first").distinct())
    line_numbers = level
    runs = written(_runs(level.select("doc", "key", "i", "words"), min_words))
    long = runs.where("size > 1")
    marked = [level.where((F.col("words") >= min_words) & (_at() > F.col("first"))).select("doc", "key", "n")]
    names, depth = level.select("doc", "key", "i", "r"), 1
    while 2 * depth <= min_words:
        ahead = names.select("doc", "key", (F.col("i") - depth).alias("i"), F.col("r").alias("rb"))
        pairs = _beside(names.withColumnRenamed("r", "ra"), ahead)
        groups = _ranked(pairs.groupBy("ra", "rb").agg(F.count("*").alias("count")).where("count > 1").drop("count"), ["ra", "rb"])
        names = written(pairs.join(groups, ["ra", "rb"]).select("doc", "key", "i", "r"))
        depth *= 2
        # runs of up to twice as many lines take two of these ranks; at the last depth, all longer ones
        marked.append(_later(long.where((F.col("size") >= depth) & (F.col("size") < 2 * depth)), names, depth, line_numbers))
    out = marked[0]
    for m in marked[1:]:
        out = out.unionByName(m)
    return written(out.groupBy("doc", "key").agg(F.array_sort(F.collect_set("n")).alias("lines")))


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Equal positions of both, null ids being equal."""
    right = right.withColumnsRenamed({"doc": "_doc", "key": "_key", "i": "_i"})
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")) & (F.col("i") == F.col("_i"))
    return left.join(right, same).drop("_doc", "_key", "_i")


def _later(runs: DataFrame, names: DataFrame, depth: int, line_numbers: DataFrame) -> DataFrame:
    """(doc, key, n) of the lines of runs that occur earlier; depth: lines that a rank covers."""
    begun = _beside(runs, names.withColumnRenamed("r", "ra"))
    ends = names.select("doc", "key", F.col("i").alias("i"), F.col("r").alias("rb"))
    shifted = begun.withColumn("start", F.col("i")).withColumn("i", F.col("i") + F.col("size") - depth)
    named = written(_beside(shifted, ends).select("doc", "key", F.col("start").alias("i"), "size", "ra", "rb"))
    first = written(named.groupBy("size", "ra", "rb").agg(F.min(_at()).alias("first"), F.count("*").alias("count")).where("count > 1").drop("count"))
    again = named.join(first, ["size", "ra", "rb"]).where(_at() > F.col("first"))
    covered = again.select("doc", "key", F.explode(F.sequence("i", F.col("i") + F.col("size") - 1)).alias("i")).distinct()
    return written(_beside(covered, line_numbers.select("doc", "key", "i", "n")).select("doc", "key", "n"))


def lost_column(docs: DataFrame) -> str:
    """Name of the column of lost lines: ``_lost``, with more underscores where docs has such columns."""
    name = "_lost"
    while name in docs.columns:
        name += "_"
    return name


def _without(parts: Column, lost: Column) -> Column:
    """The parts whose numbers are not in *lost*, an ascending list."""
    gaps = F.zip_with(F.concat(F.array(F.lit(-1)), F.slice(lost, 1, F.size(lost) - 1)), lost, lambda a, b: F.concat(F.array_repeat(F.lit(True), b - a - 1), F.array(F.lit(False))))
    flags = F.concat(F.flatten(gaps), F.array_repeat(F.lit(True), F.size(parts) - F.element_at(lost, -1) - 1))
    kept = F.filter(F.zip_with(parts, flags, lambda x, f: F.struct(x.alias("x"), f.alias("f"))), lambda p: p["f"])
    return F.transform(kept, lambda p: p["x"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated runs deleted from the text, and the numbers of the lines deleted in ``lost_column(docs)``."""
    gone = deletions(docs, id_col, text_col, min_words)
    lines = gone.agg(F.sum(F.size("lines") + 2)).first()[0] or 0
    gone = F.broadcast(gone) if lines <= BROADCAST_LINES else gone.hint("merge")
    own = boxed(docs, _of=docs[id_col], _text=docs[text_col], _own=F.xxhash64(docs[text_col]))
    joined = own.join(gone, F.col("_of").eqNullSafe(F.col("doc")) & (F.col("_own") == F.col("key")), "left")
    left = let(F.split("_text", "\n", -1), lambda parts: _without(parts, F.col("lines")))
    lost = F.coalesce(F.col("lines"), F.expr("cast(array() as array<int>)"))
    text = F.when(F.col("lines").isNotNull(), F.array_join(left, "\n")).otherwise(F.col("_text"))
    return joined.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns], lost.alias(lost_column(docs)))
