"""Personal data: base patterns, and terms that give a protected entity away.

In SQL functions only. Base spans are the leftmost matches of four patterns, checked
for address parts, Luhn sums and digit counts. Every matched value is a protected
entity. Words are maximal runs of letters, marks and digits clear of base spans, in lower case,
of any length. With c documents that hold both a word and the entity, n(t) with the word, n(e)
with the entity and N in all, the word's posterior is c / n(t), and it tells
log2(c N / (n(t) n(e))) of the log2(N / n(e)) bits that name the entity. A word discloses
the entity if the posterior is at least ``POSTERIOR``, the bits are at least the share
``SHARE`` of all, c is at least ``SUPPORT``, and so many documents in common have a
probability below 2 ** -``EVIDENCE`` were the two independent (Chernoff's bound). Such words are
generalised, or removed when they all but name the entity, wherever they occur in the corpus.

All counts are over all documents and whole texts. A document's distinct words are written once.
Words in more than max n(e) / POSTERIOR documents, entities of fewer than SUPPORT documents
and pairs with n(t) > n(e) / POSTERIOR can't reach the thresholds and give no pairs.
Rows shuffled: words and pairs pre-aggregated; the words of documents with shared
entities where the vocabulary is not broadcast; and texts once, unless the terms found in documents
are counted to ``BROADCAST_FOUND`` at most. Vocabularies are broadcast only when counted to
``BROADCAST_ROWS`` at most.

Defined results: null texts are empty and have no spans; rows equal in id and text get
equal results each; a null id is kept; other columns are not looked at by ``spans``,
and are kept by ``sanitise``; base spans of different kinds may overlap, and term
spans never touch base spans.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import boxed, let, part, running, wide, written

#: The base patterns of the contract. Where a match can start inside a run of its own
#: characters only behind another match, the start is pinned to the run's begin or that match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?=[0-9])(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]
TERM_KINDS = ["generalise", "remove"]

SUPPORT = 2
POSTERIOR = 0.5
#: Of the bits that name the entity; what it asks is at most POSTERIOR for entities in up to a quarter of all documents.
SHARE = 0.5
EVIDENCE = 10.0
REMOVE_AT = 0.9
BROADCAST_ROWS = 200_000
#: Found terms, summed over documents, that may be broadcast to the texts; beyond, texts are shuffled to them.
BROADCAST_FOUND = 1_000_000
#: A term: a maximal run of these, in lower case.
LETTER = r"\p{L}\p{M}\p{N}"

#: Stands for the characters of a base span; no letter, and a blank where a text holds it by itself.
CUT = "\ue000"

SPAN = "struct<kind:string,start:int,end:int>"
NONE = f"cast(array() as array<{SPAN}>)"


def _located(text: Column, pattern: str, kind: str, valid) -> Column:  # noqa: ANN001
    """Spans of a pattern's valid matches: text between matches and matches take turns."""

    def spans(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), F.length)
        lengths = F.transform(found, F.length)

        def placed(before: Column) -> Column:
            begins = F.zip_with(before, gaps, lambda at, gap: at + gap)
            made = F.zip_with(found, begins, lambda m, at: F.when(valid(m), F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(m)).alias("end"))))
            return F.filter(made, lambda s: s.isNotNull())

        return let(running(F.zip_with(gaps, lengths, lambda g, n: g + n)), placed)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + d

    return n.between(13, 19) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)


_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def base_spans(text: Column) -> Column:
    """Base spans by kind as listed, then start; cheap tests first let most texts pass."""
    ip = F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _located(text, IP, "ip", lambda m: m.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")))
    card = F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), _located(text, CARD, "card", _luhn))
    email = F.when(text.contains("@"), _located(text, EMAIL, "email", lambda m: F.lit(True)))
    phone = F.when(text.contains("+"), _located(text, PHONE, "phone", lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)))
    digits = text.rlike("[0-9]")
    either = F.concat(*[F.coalesce(x, F.expr(NONE)) for x in (email, ip, card, phone)])
    return F.when(text.contains("@") | digits, either).otherwise(F.expr(NONE))


def _plain(text: Column) -> Column:
    """The text without CUT of its own; few texts hold it, and translating takes longer than looking."""
    return F.when(text.contains(CUT), F.translate(text, CUT, " ")).otherwise(text)


def _words(text: Column) -> Column:
    """The distinct words of a text, an empty one among them perhaps.

    Lower case is that of each word by itself. For texts without the two letters whose lower case is
    longer or hangs on their neighbours it is that of the whole text, which is quicker.
    """
    cut = rf"[^{LETTER}{CUT}]+"
    return F.array_distinct(F.when(text.rlike("[\u0130\u03a3]"), F.transform(F.split(text, cut), F.lower)).otherwise(F.split(F.lower(text), cut)))


def _clear_words(text: Column, spans: Column) -> Column:
    """Distinct words that touch no base span, joined by blanks; a string takes less memory to write than an array."""
    clear = lambda words: F.when(F.size(spans) > 0, F.filter(words, lambda w: ~w.contains(CUT))).otherwise(words)
    return F.array_join(let(let(_masked(text, spans), _words), clear), " ")


def _masked(text: Column, spans: Column) -> Column:
    """The text, as long as before, with base spans as runs of CUT, which counts as a character of the words beside them."""

    def of_kind(kind: str, plain: Column) -> Column:
        def cut(own: Column) -> Column:
            ends = F.concat(F.array(F.lit(0)), F.transform(own, lambda s: s["end"]))
            at = F.zip_with(F.slice(ends, 1, F.size(own)), own, lambda e, s: F.struct(e.alias("after"), s["start"].alias("start"), s["end"].alias("end")))
            pieces = lambda w: F.array_join(F.concat(F.transform(at, lambda s: F.concat(part(w, s["after"], s["start"]), F.repeat(F.lit(CUT), s["end"] - s["start"]))), F.array(part(w, F.element_at(ends, -1), F.length(plain)))), "")
            return F.when(F.size(own) > 0, let(wide(plain), pieces)).otherwise(plain)

        return let(F.filter(spans, lambda s: s["kind"] == kind), cut)

    out = _plain(text)
    for kind in KINDS:
        out = let(out, partial(of_kind, kind))
    return F.when(F.size(spans) > 0, out).otherwise(_plain(text))


def _values(text: Column, spans: Column) -> Column:
    """A hash of each span's kind and text in lower case."""
    return F.when(F.size(spans) > 0, let(wide(text), lambda w: F.transform(spans, lambda s: F.xxhash64(s["kind"], F.lower(part(w, s["start"], s["end"])))))).otherwise(F.array().cast("array<bigint>"))


def disclosing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, kind): words that give an entity away, with what is done to them; a written table."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    based = docs.select(text.alias("text")).select("text", base_spans(F.col("text")).alias("spans"))
    own = written(based.select(F.monotonically_increasing_id().alias("row"), F.array_distinct(_values(F.col("text"), F.col("spans"))).alias("entities"), _clear_words(F.col("text"), F.col("spans")).alias("words")))
    holders = own.where(F.size("entities") > 0)
    held = holders.select("row", F.explode("entities").alias("entity"))
    entities = written(held.groupBy("entity").agg(F.count("*").alias("with_entity")).where(F.col("with_entity") >= SUPPORT))
    total, known, most = own.count(), *entities.agg(F.count("*"), F.max("with_entity")).first()
    most = (most or 0) / POSTERIOR
    few = F.broadcast if known <= BROADCAST_ROWS else lambda df: df
    shared = held.join(few(entities), "entity").groupBy("row").agg(F.collect_list(F.struct("entity", "with_entity")).alias("shared"))
    vocabulary = written(own.select(F.explode(F.split("words", " ")).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("with_term")).where(F.col("with_term").between(SUPPORT, most)))
    few = F.broadcast if vocabulary.count() <= BROADCAST_ROWS else lambda df: df
    words = holders.select("row", "words").join(shared, "row").select("shared", F.explode(F.split("words", " ")).alias("term")).join(few(vocabulary), "term")
    near = F.filter("shared", lambda e: F.col("with_term") * POSTERIOR <= e["with_entity"])
    pairs = words.select("term", "with_term", F.explode(near).alias("e")).groupBy("term", "with_term", "e.entity", "e.with_entity").agg(F.count("*").alias("together"))
    p, q = F.col("together") / F.col("with_term"), F.col("with_entity") / F.lit(float(total))
    told = (p >= POSTERIOR) & (F.col("together") >= SUPPORT) & (q < 1) & (F.log2(p / q) >= -F.log2(q) * SHARE)
    against = F.when(p < 1, (1 - p) * F.log2((1 - p) / (1 - q))).otherwise(0.0)
    over = pairs.where(told & (F.col("with_term") * (p * F.log2(p / q) + against) >= EVIDENCE)).select("term", p.alias("posterior"))
    return written(over.groupBy("term").agg(F.max("posterior").alias("posterior")).select("term", F.when(F.col("posterior") >= REMOVE_AT, "remove").otherwise("generalise").alias("kind")))


def _term_spans(text: Column, base: Column, terms: Column) -> Column:
    """Spans of the terms (term, kind) in a text, clear of base spans."""
    word = rf"[{LETTER}{CUT}]+"

    def spans(masked: Column) -> Column:
        found = F.regexp_extract_all(masked, F.lit(word), F.lit(0))
        gaps = F.transform(F.split(masked, word, -1), F.length)

        def placed(chosen: Column) -> Column:
            lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), F.transform(found, F.length), lambda g, n: g + n)
            ends = F.zip_with(running(lengths), lengths, lambda at, n: at + n)
            made = F.zip_with(found, ends, lambda m, e: let(chosen[F.lower(m)], lambda k: F.when(k.isNotNull(), F.struct(k.alias("kind"), (e - F.length(m)).alias("start"), e.alias("end")))))
            return F.filter(made, lambda s: s.isNotNull())

        return let(F.map_from_entries(terms), placed)

    return F.when(F.size(terms) > 0, let(_masked(text, base), spans)).otherwise(F.expr(NONE))


def _located_all(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, _text, _base, _terms): the rows of docs with their spans."""
    text = F.coalesce(docs[text_col], F.lit(""))
    terms = disclosing(docs, id_col, text_col)
    keyed = boxed(docs, _of=docs[id_col], _text=text, _key=F.xxhash64(docs[id_col], text))
    tokens = keyed.select(F.col("_of").alias("_id"), F.col("_key").alias("_key2"), F.explode(let(_plain(F.col("_text")), _words)).alias("term"))
    few = terms.count() <= BROADCAST_ROWS
    hits = written(tokens.join(F.broadcast(terms) if few else terms, "term").groupBy("_id", "_key2").agg(F.collect_set(F.struct("term", "kind")).alias("_found")))
    found = hits.agg(F.sum(F.size("_found") + 2)).first()[0] or 0
    hits = F.broadcast(hits) if found <= BROADCAST_FOUND else hits.hint("merge")
    joined = keyed.join(hits, (F.col("_key") == F.col("_key2")) & F.col("_of").eqNullSafe(F.col("_id")), "left")
    found = F.coalesce(F.col("_found"), F.expr("cast(array() as array<struct<term:string,kind:string>>)"))
    based = joined.withColumn("_base", base_spans(F.col("_text")))
    return based.select("_row", "_text", "_base", _term_spans(F.col("_text"), F.col("_base"), found).alias("_terms"))


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with _base and _terms, arrays of (kind, start, end); these two win over the input's columns."""
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("_base", "_terms")]
    return _located_all(docs, id_col, text_col).select(*kept, "_base", "_terms")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text cleaned: base spans and terms give way to marks, or to nothing."""
    text = F.col("_text")
    spans = F.array_sort(F.transform(F.concat("_base", "_terms"), lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def cleaned(own: Column) -> Column:
        before = running(F.transform(own, lambda s: s["end"]), largest=True)  # the last end so far; spans that begin earlier are within another

        def pieces(w: Column) -> Column:
            mark = lambda s: F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", "[term]").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
            out = F.zip_with(before, own, lambda at, s: F.when(s["start"] >= at, F.concat(part(w, at, s["start"]), mark(s))).otherwise(""))
            return F.array_join(F.concat(out, F.array(part(w, F.array_max(F.transform(own, lambda s: s["end"])), F.length(text)))), "")

        return let(wide(text), pieces)

    clean = let(spans, cleaned)
    changed = F.when(F.size("_base") + F.size("_terms") > 0, clean).otherwise(F.col("_row")[text_col])
    return _located_all(docs, id_col, text_col).select(*[changed.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
