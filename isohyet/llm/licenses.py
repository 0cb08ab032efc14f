"""Licence scan: a trained paragraph classifier with a confirming template comparison.

In DataFrame functions on the path of the texts. Features are word 1- to 3-grams of
the templates that hold an anchor, a template word that is not an everyday word (the longest
everyday words too, where half of a template would do without). A multinomial logistic regression over the licence
families and an unknown class is fitted on the driver, with an L1 penalty that keeps
few weights: positives are templates, whole and damaged; negatives are a bounded background
sample of the corpus and sentences on other things. A paragraph without an anchor has no feature and is unknown,
so that documents without one pass at once; anchors come from the fixed lists alone, whatever the corpus.

The probability from which a family is told is calibrated on all lines of the corpus: of those that share less than
``NEAR`` of a template with the family, at most ``FALSE_ALARMS`` of all lines with a letter reach it. It lies between
``LEAST`` and ``HIGHEST``.

A prediction is confirmed where a template of the family shares at least ``CONFIRM`` of its
3-grams (shorter ones: words) with the paragraph.

Besides single lines, blocks of consecutive non-blank lines are scored as one paragraph, as
licence texts are wrapped. A block counts, at its first line, where it is confirmed
and none of its lines is confirmed for the same family by itself.

Bounds: BACKGROUND lines of at most LONGEST_LINE characters (those of the least hash) reach the driver; the table of
weights has as many rows as the templates have n-grams, whatever the corpus, and is broadcast. The calibration collects
a histogram of at most a thousand bins. Predictions of at least LEAST are written to the shared folder.

Defined results: paragraphs are the lines and blocks of a text, numbered by line from 0; a block tells one family; null and empty texts
have none; rows without any family have empty lists; repeated rows are scored
separately; other columns are not looked at; an empty table gives no rows (the model then
has no background but the fixed sentences).
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isohyet.llm.common import least_hashed, written
from isohyet.llm.license_texts import EVERYDAY, OTHERS, TEMPLATES

BACKGROUND = 2000
LONGEST_LINE = 2000  # of the background, in characters; scanned lines are of any length
DAMAGED = 24  # copies of each template with words lost, cut or put around
FALSE_ALARMS = 0.001
CONFIRM = 0.5
PENALTY = 2e-4
LEAST, HIGHEST = 0.5, 0.95  # bounds of the probability from which a family is told
NEAR = 0.1
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
UNKNOWN = "unknown"


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams(tokens: list[str]) -> set[str]:
    return {" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)}


def shape(tokens: list[str]) -> set[str]:
    """What a template is compared by."""
    return {" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)} or set(tokens)


class Model:
    """Weights of the n-grams for every family; unknown is the first class."""

    def __init__(self, background: list[str], seed: int = 5) -> None:
        rng = random.Random(seed)
        self.families = sorted({f for f, _ in TEMPLATES})
        classes = [UNKNOWN, *self.families]
        templates = [(f, words(t)) for f, t in TEMPLATES]
        self.shapes = [(f, shape(t)) for f, t in templates]
        plain = [w for w in map(words, background) if not any(len(s & shape(w)) >= CONFIRM * len(s) and s for _, s in self.shapes)]
        self.anchors = {w for _, t in templates for w in t if re.search("[a-z]{2}", w) and w not in EVERYDAY}
        for _, t in templates:  # no text with CONFIRM of a template is without an anchor
            for w in sorted(set(t), key=lambda w: (-len(w), w)):
                if sum(not self.anchors & set(g.split()) for g in shape(t)) >= CONFIRM * len(shape(t)):
                    self.anchors.add(w)
        rows: list[tuple[str, list[str]]] = [(UNKNOWN, w) for w in plain] + 3 * [(UNKNOWN, words(o)) for o in OTHERS]
        fill = [x for w in plain for x in w][:20000] or [x for o in OTHERS for x in words(o)]
        for family, t in templates:
            rows += 8 * [(family, t)]
            for _ in range(DAMAGED):
                cut = t[int(len(t) * 0.3 * rng.random()) :]
                kept = [x for x in cut if rng.random() > 0.1] or t
                rows.append((family, [rng.choice(fill) for _ in range(rng.randrange(8))] + kept + [rng.choice(fill) for _ in range(rng.randrange(8))]))
        vocabulary = sorted({g for _, t in templates for g in grams(t) if self.anchors & set(g.split())})
        self.grams = {g: k for k, g in enumerate(vocabulary)}
        x = self._matrix([w for _, w in rows])
        y = np.array([classes.index(f) for f, _ in rows])
        self.weights, self.bias = self._fit(x, y, len(classes))
        self.threshold = LEAST

    def _matrix(self, texts: list[list[str]]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.grams)))
        for i, w in enumerate(texts):
            x[i, [self.grams[g] for g in grams(w) if g in self.grams]] = 1
        return x

    def _chance(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
        """Accelerated proximal gradient descent on the mean log loss with an L1 penalty."""
        share = 1 / np.bincount(y, minlength=classes).clip(1)[y]
        share /= share.sum()
        target = np.eye(classes)[y]
        w, b = np.zeros((x.shape[1], classes)), np.zeros(classes)
        pace = 1 / (0.5 * max(1.0, float((x * x).sum(axis=1) @ share)))
        at, last, t = w, w, 1.0
        for _ in range(rounds):
            self.weights, self.bias = at, b
            error = (self._chance(x) - target) * share[:, None]
            new = at - pace * (x.T @ error)
            new = np.sign(new) * np.maximum(np.abs(new) - pace * PENALTY, 0)
            b = b - pace * error.sum(axis=0)
            t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            at, last = new + (old - 1) / t * (new - last), new
        return last, b


def background(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """A whole line of at most LONGEST_LINE characters, chosen by hash, of each of at most BACKGROUND documents, those of the least hash."""
    lines = F.filter(F.split(F.col(text_col), "\n", -1), lambda x: x.rlike("[A-Za-z]") & (F.length(x) <= LONGEST_LINE))
    h = F.pmod(F.xxhash64(text_col), F.greatest(F.size(lines), F.lit(1))).cast("int")
    named = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(id_col, text_col).alias("h"), text_col)
    one = least_hashed(named, "h", BACKGROUND).select("h", F.get(lines, h).alias("line")).where("line is not null")
    return [r["line"] for r in one.orderBy("h", "line").limit(BACKGROUND).collect()]


def calibrated(scored: DataFrame, lines: int) -> float:
    """The least of thousand steps from LEAST on that at most FALSE_ALARMS of all lines reach, of those unlike any template."""
    plain = scored.where((F.col("line") == F.col("last")) & (F.col("overlap") < NEAR))
    bins = sorted(plain.groupBy(F.floor(F.col("probability") * 1000).alias("bin")).count().collect(), reverse=True)
    seen = 0
    for one, n in bins:
        seen += n
        if seen > FALSE_ALARMS * lines:
            return min(HIGHEST, max(LEAST, (one + 1) / 1000))
    return LEAST


def _ngrams(tokens: Column) -> Column:
    """Distinct 1- to 3-grams; the outer transform has the tokens made once for all of them."""

    def of(t: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1)))
        return F.when(F.size(t) >= n, F.transform(starts, lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.transform(F.array(tokens), lambda t: F.concat(of(t, 1), of(t, 2), of(t, 3)))[0])


UNIT = "array<struct<line:int,last:int,paragraph:string>>"
_GAP = r"\n(?:[^\S\n]*\n)+"  # blank lines with the line ends around them


def _blocks(text: Column, wanted) -> Column:  # noqa: ANN001
    """(line, last, paragraph) of the wanted runs of two and more non-blank lines."""
    padded = F.concat(F.lit("\n\n"), text)
    breaks = lambda c: F.length(F.regexp_replace(c, r"[^\n]", ""))
    pairs = F.zip_with(F.regexp_extract_all(padded, F.lit(_GAP), F.lit(0)), F.slice(F.split(padded, _GAP, -1), 2, F.size(F.split(padded, _GAP, -1))), lambda g, b: F.struct(g.alias("gap"), b.alias("block")))
    start = F.struct(F.lit(-2).alias("at"), F.expr(f"cast(array() as {UNIT})").alias("found"))

    def step(state: Column, pair: Column) -> Column:
        line = state["at"] + breaks(pair["gap"])
        last = line + breaks(pair["block"])
        one = F.array(F.struct(line.alias("line"), last.alias("last"), pair["block"].alias("paragraph")))
        return F.struct(last.alias("at"), F.when((last > line) & wanted(pair["block"]), F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    return F.aggregate(pairs, start, step, lambda s: s["found"])


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, line, family, probability, overlap, confirmed) of every licence line or block; key: xxhash64 of the text."""
    spark = docs.sparkSession
    whole = sorted({max(re.findall("[a-z0-9]+", a), key=lambda w: (w not in EVERYDAY, len(w))) for a in model.anchors})
    anchor = F.lit(whole) if whole else F.array().cast("array<string>")
    parts = lambda c: F.split(F.lower(c), "[^a-z0-9]+")
    some = docs.where(F.arrays_overlap(parts(F.col(text_col)), anchor))
    wanted = lambda c: F.arrays_overlap(parts(c), anchor)
    single = F.filter(F.transform(F.split(text_col, "\n", -1), lambda x, n: F.struct(n.alias("line"), n.alias("last"), x.alias("paragraph"))), lambda u: wanted(u["paragraph"]))
    numbered = some.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.concat(single, _blocks(F.col(text_col), wanted)).alias("units"))
    units = numbered.select("row", "id", "key", F.explode("units").alias("u"))  # in a step of its own: rows are numbered before it
    tokens = F.regexp_extract_all(F.lower("u.paragraph"), F.lit(WORD), F.lit(0))
    found = units.select("row", "id", "key", "u.line", "u.last", F.explode(_ngrams(tokens)).alias("gram"))

    n, classes = len(model.shapes), [UNKNOWN, *model.families]
    table = []
    for g in sorted(set(model.grams) | {g for _, s in model.shapes for g in s}):
        w = model.weights[model.grams[g]].tolist() if g in model.grams else [0.0] * len(classes)
        if any(w) or any(g in s for _, s in model.shapes):
            table.append((g, w + [float(g in s) for _, s in model.shapes]))
    weights = spark.createDataFrame(table, "gram string, w array<double>")
    sums = [F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(classes) + n)]
    by = found.join(F.broadcast(weights), "gram").groupBy("row", "id", "key", "line", "last").agg(*sums)
    logits = F.array(*[F.col(f"s{k}") + float(model.bias[k]) for k in range(len(classes))])
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda z: F.exp(z - top)), F.lit(0.0), lambda a, z: a + z)
    names = F.lit(classes)
    overlap = F.array(*[F.greatest(F.lit(0.0), F.lit(0.0), *[F.col(f"s{len(classes) + j}") / len(s) for j, (f, s) in enumerate(model.shapes) if f == c]) for c in classes])
    best = F.array_position(logits, top).cast("int")
    scored = by.select("row", "id", "key", "line", "last", F.element_at(names, best).alias("family"), (1 / total).alias("probability"), F.element_at(overlap, best).alias("overlap"))
    scored = written(scored.where((F.col("family") != UNKNOWN) & (F.col("probability") >= LEAST)))
    total = docs.select(F.sum(F.size(F.filter(F.split(text_col, "\n", -1), lambda x: x.rlike("[A-Za-z]"))).cast("long"))).first()[0]
    model.threshold = calibrated(scored, total or 0)
    told = scored.where(F.col("probability") >= model.threshold)
    told = told.withColumn("confirmed", F.col("overlap") >= CONFIRM)
    alone = F.collect_list(F.when(F.col("confirmed") & (F.col("line") == F.col("last")), F.col("line"))).over(W.partitionBy("row", "family"))
    block = F.col("confirmed") & ~F.exists("alone", lambda x: x.between(F.col("line"), F.col("last")))
    told = told.withColumn("alone", alone).where((F.col("line") == F.col("last")) | block)
    return told.select(F.col("id").alias(id_col), "key", "line", "family", "probability", "overlap", "confirmed")


def families(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licences, unconfirmed): for every row the confirmed line:family list, and the other predictions."""
    own = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"))
    rows = docs.select(F.col(id_col).alias("_of"), F.col(text_col).alias("_text"))
    found = scan(rows, Model(background(rows, "_of", "_text")), "_of", "_text")
    mark = F.struct("line", "family")
    lists = found.groupBy("_of", "key").agg(F.array_sort(F.collect_set(F.when(F.col("confirmed"), mark))).alias("sure"), F.array_sort(F.collect_set(F.when(~F.col("confirmed"), mark))).alias("unsure"))
    shown = lambda c: F.concat_ws(",", F.transform(c, lambda m: F.concat_ws(":", m["line"].cast("string"), m["family"])))
    joined = own.join(lists, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("key")), "left")
    return joined.select(F.col("_id").alias(id_col), F.coalesce(F.size("sure"), F.lit(0)).cast("long").alias("n_licences"), shown("sure").alias("licences"), shown("unsure").alias("unconfirmed"))
