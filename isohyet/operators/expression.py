"""expr and its kin: statements over the variables of a dataset."""

from __future__ import annotations

from pyspark.sql import functions as F

from isohyet.dataset import Dataset
from isohyet.functions.language import Parser, names
from isohyet.operators.registry import put


def evaluate(d: Dataset, text: str, append: bool = False) -> Dataset:
    """Variables side by side in one aggregate, statements as columns, results as rows again.

    Only variables that the statements read are gathered. Those with one level meet all levels
    of the others.
    """
    assigned, reads = names(text)
    own = d.cells.where(F.col("var").isin(reads))
    wide = own.groupBy("level", "ts", "x", "y").agg(F.max("t").alias("t"), *[F.max(F.when(F.col("var") == n, F.col("v"))).alias(f"v_{n}") for n in reads], *[F.max((F.col("var") == n).cast("int")).alias(f"h_{n}") for n in reads])
    found = Parser(text, lambda n: F.col(f"v_{n}")).statements()
    rows = F.array(*[F.struct(F.lit(n).alias("var"), found[n].cast("double").alias("v")) for n in assigned])
    out = wide.select("level", "ts", "t", "x", "y", F.explode(rows).alias("r")).select("r.var", "level", "ts", "t", "x", "y", "r.v")
    made = d.of(out, variables={n: {"code": int(n[3:])} if n.startswith("var") and n[3:].isdigit() else {} for n in assigned})
    if append:
        kept = d.cells.where(~F.col("var").isin(assigned))
        return d.of(kept.select(*made.cells.columns).unionByName(made.cells), variables=d.variables | made.variables).with_(single=d.single - {"var"})
    return made.only("var") if len(assigned) == 1 else made.with_(single=d.single - {"var"})


def _text(path: str) -> str:
    with open(path) as f:
        return " ".join(line.split("#", 1)[0] for line in f)


def _rest(text: str, more: tuple) -> str:
    return ",".join([text, *map(str, more)])


put("expr", lambda d, text, *more: evaluate(d, _rest(text, more)))
put("aexpr", lambda d, text, *more: evaluate(d, _rest(text, more), True))
put("exprf", lambda d, path: evaluate(d, _text(path)))
put("aexprf", lambda d, path: evaluate(d, _text(path), True))
