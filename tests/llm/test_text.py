"""Personal data, licences, quality, rules and line dedup against brute force, with odd inputs."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

from isohyet.llm import licenses, linedup, pii, quality, queries, rules, stats

SCHEMA = "doc_id long, text string, lang string, _key int, _base string"


def docs(spark, texts, ids=None):
    """With extra columns, two of whose names the operators use inside."""
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", 1, "x") for i, t in zip(ids, texts)], SCHEMA)


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        s = re.sub("[ -]", "", m.group())
        if 13 <= len(s) <= 19 and luhn(s):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


ODD = [
    None,
    "",
    "a@b.c_d@e.f and x.y@z",
    "é 1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.002.003.004",
    "4111 1111-1111 1111 4111111111111112",
    "+1 (386) 555-3733 +44 20 7946 0958 +123",
    "@" * 50 + "a" * 3000 + "@" + "b.c" * 40,
    "日本語 mail@例.com 12",
    "1" * 5000,
]


def test_base_spans_are_those_of_the_patterns(spark):
    rng = random.Random(1)
    more = ["".join(rng.choice("a1.@+- 4") for _ in range(rng.randrange(60))) for _ in range(400)]
    texts = ODD + more
    got = pii.with_spans(docs(spark, texts)).select("doc_id", pii.listed(pii.F.col("_base")).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in got} == {i: base(t or "") for i, t in enumerate(texts)}


def test_terms_that_name_an_entity_go(spark):
    plain = [f"plain words number {i} about weather and harvest" for i in range(200)]
    known = ["report of zanzibarius by a.b@mail.org about weather", "again zanzibarius wrote a.b@mail.org about harvest", "zanzibarius without address"]
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(docs(spark, plain + known)).collect()}
    assert out[200] == "report of [term] by [email] about weather"
    assert out[202] == "[term] without address"
    assert [out[i] for i in range(200)] == plain
    assert pii.sanitise(docs(spark, plain)).columns[:3] == ["doc_id", "text", "lang"]


def test_terms_of_an_entity_that_many_documents_hold_go(spark):
    """A third of all documents share an address; the word beside it is in no other document."""
    plain = [f"plain words number {i} about weather and harvest" for i in range(20)]
    known = [f"note {i} of zanzibarius about weather, desk@mail.org" for i in range(10)]
    got = [r["text"] for r in pii.sanitise(docs(spark, plain + known)).orderBy("doc_id").collect()]
    assert got[:20] == plain
    assert all("zanzibarius" not in t and t.endswith("about weather, [email]") for t in got[20:])


def test_terms_far_from_the_entity_short_and_with_digits_go(spark):
    far = " ".join(["about weather"] * 30)
    plain = [f"plain words about weather {k}" for k in range(200)]
    known = [f"Łuk j77 report {far} by a.b@mail.org" for _ in range(2)]
    got = [r["text"] for r in pii.sanitise(docs(spark, plain + known)).orderBy("doc_id").collect()]
    assert got[:200] == plain
    assert got[200] == got[201] == f"   {far}  [email]"  # one blank a removed word


def test_terms_whose_lower_case_is_longer_go(spark):
    plain = [f"plain words about weather {k}" for k in range(200)]
    known = ["by İzmirliyan a.b@mail.org", "again İzmirliyan a.b@mail.org", "İzmirliyan alone"]
    got = [r["text"] for r in pii.sanitise(docs(spark, plain + known)).orderBy("doc_id").collect()]
    assert got == [*plain, "by [term] [email]", "again [term] [email]", "[term] alone"]


def test_many_spans_in_one_text(spark):
    import time

    many = " ".join(f"me{i}@host{i}.org is" for i in range(16000))
    pii.sanitise(docs(spark, ["warm a@b.c"])).collect()
    began = time.time()
    got = [r["text"] for r in pii.sanitise(docs(spark, [many, "x"])).orderBy("doc_id").collect()]
    assert got == [" ".join(["[email] is"] * 16000), "x"]
    assert time.time() - began < 15  # 50 s where arrays grew by one element a step


def disclosed_slowly(texts):
    """Terms and kinds by counting every pair of word and entity."""
    import itertools
    from math import log2

    import regex

    held, words = [], []
    for t in texts:
        spans = [x.split(":") for x in base(t or "").split(",") if x]
        own = [(k, int(a), int(b)) for k, a, b in spans]
        held.append({(k, t[a:b].lower()) for k, a, b in own})
        words.append({m.group().lower() for m in regex.finditer(r"[\p{L}\p{M}\p{N}]+", t or "") if not any(a < m.end() and b > m.start() for _, a, b in own)})
    n, best = len(texts), {}
    entities, terms = set().union(*held), set().union(*words)
    for e, w in itertools.product(entities, terms):
        ne, nt = sum(e in h for h in held), sum(w in x for x in words)
        c = sum(e in h and w in x for h, x in zip(held, words))
        p, q = c / nt, ne / n
        if c < 2 or p < 0.5 or q == 1 or log2(p / q) < 0.5 * -log2(q):
            continue
        if nt * (p * log2(p / q) + ((1 - p) * log2((1 - p) / (1 - q)) if p < 1 else 0)) >= 10:
            best[w] = max(best.get(w, 0), p)
    return {w: "remove" if p >= 0.9 else "generalise" for w, p in best.items()}


def test_disclosing_terms_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    people = [(f"name{k}", f"n{k}@mail.org") for k in range(12)]
    texts = [None, ""]
    for i in range(300):
        name, mail = rng.choice(people[:3] if i % 3 else people)
        own = [rng.choice(["weather", "harvest", "river", f"x{rng.randrange(40)}"]) for _ in range(8)]
        if i % 4 < 3:
            own.insert(rng.randrange(8), name)
        if i % 5 < 3:
            own.insert(rng.randrange(8), mail)
        texts.append(" ".join(own))
    got = {r["term"]: r["kind"] for r in pii.disclosing(docs(spark, texts)).collect()}
    assert got == disclosed_slowly(texts)
    assert "generalise" in got.values()


def test_personal_data_of_odd_rows(spark):
    rows = [(1, "a@b.c x"), (1, "a@b.c x"), (None, "a@b.c x"), (None, None), (2, "\ue000a@b.c\ue000 +1 (386) 555-3733")]
    got = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0), r["text"] or "~") for r in got) == [(0, "[email] x"), (0, "~"), (1, "[email] x"), (1, "[email] x"), (2, "\ue000[email]\ue000 [phone]")]


def test_pii_of_nothing(spark):
    assert pii.with_spans(docs(spark, [])).count() == 0


def test_licences(spark):
    texts = ["Some prose.\nReleased under the MIT License.", "Nothing here.", None, "", "Licensed under the Apache License, Version 2.0.\nAll rights reserved.", "He lost his license and went to Apache county."]
    got = {r["doc_id"]: (r["n_licences"], r["licences"]) for r in licenses.families(docs(spark, texts)).collect()}
    assert got == {0: (1, "1:MIT"), 1: (0, ""), 2: (0, ""), 3: (0, ""), 4: (2, "0:Apache-2.0,1:Proprietary"), 5: (0, "")}
    assert licenses.families(docs(spark, [])).count() == 0


def test_licences_are_those_of_a_slow_reading(spark, sf):
    """Scores of the query's lines and blocks, made again in Python from the fitted weights."""
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    model = licenses.Model(licenses.background(frame))
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()] + [(-1, "x " * 200_000 + "Licensed under the MIT License."), (-2, None), (-2, None)]
    odd = spark.createDataFrame(rows, "line long, text string")
    got = sorted((r["line"], r["licences"]) for r in licenses.families(odd, "line").collect())
    model = licenses.Model(licenses.background(odd, "line"))
    shapes = {f: [s for g, s in model.shapes if g == f] for f in model.families}

    def told(paragraph):
        tokens = licenses.words(paragraph)
        if not model.anchors & set(tokens):
            return None
        z = np.array([model.weights[model.grams[g]] for g in licenses.grams(tokens) if g in model.grams]).sum(axis=0) + model.bias
        best = int(np.argmax(z))
        own = licenses.grams(tokens)
        if best and 1 / np.exp(z - z[best]).sum() >= model.threshold:
            family = model.families[best - 1]
            return family if max(len(s & own) / len(s) for s in shapes[family]) >= licenses.CONFIRM else None
        return None

    want = []
    for i, text in rows:
        lines, found = (text or "").split("\n"), set()
        single = {(n, told(x)) for n, x in enumerate(lines) if text}
        found |= {(n, f) for n, f in single if f}
        start = 0
        for n in range(len(lines) + 1):
            if n == len(lines) or not lines[n].strip():
                if n - start > 1 and (f := told("\n".join(lines[start:n]))) and not any((k, f) in found for k in range(start, n)):
                    want.append((i, start, f))
                start = n + 1
        want += [(i, n, f) for n, f in found]
    listed = sorted((i, ",".join(f"{n}:{f}" for k, n, f in sorted(want) if k == i)) for i, _ in rows)
    assert got == listed
    assert sum(bool(x) for _, x in got) > 5


def test_every_confirmed_paragraph_holds_an_anchor():
    model = licenses.Model([])
    for _, shape in model.shapes:
        without = [g for g in shape if not model.anchors & set(g.split())]
        assert len(without) < licenses.CONFIRM * len(shape)


def test_licence_threshold_is_of_all_lines(spark):
    rows = [(3, 3, 0.05, 0.6)] * 3 + [(1, 1, 0.0, 0.7), (2, 2, 0.9, 0.99), (4, 9, 0.0, 0.99)]  # like a template; a block
    scored = spark.createDataFrame(rows, "line int, last int, overlap double, probability double")
    assert licenses.calibrated(scored, 4000) == 0.5
    assert licenses.calibrated(scored, 3000) == pytest.approx(0.6, abs=0.0011)
    assert licenses.calibrated(scored, 1000) == pytest.approx(0.6, abs=0.0011)
    assert licenses.calibrated(scored, 999) == pytest.approx(0.7, abs=0.0011)
    assert licenses.calibrated(spark.createDataFrame([(1, 1, 0.0, 0.999)], scored.schema), 10) == licenses.HIGHEST
    assert licenses.calibrated(scored.limit(0), 0) == 0.5


def test_licences_wrapped_over_lines(spark):
    import textwrap

    from isohyet.llm.license_texts import TEMPLATES

    longest = {f: max((t for g, t in TEMPLATES if g == f), key=len) for f in ("MIT", "GPL")}
    mit, gpl = (textwrap.wrap(longest[f], 40) for f in ("MIT", "GPL"))
    texts = ["\n".join(mit), "Some prose.\n \n" + "\n".join("# " + x for x in gpl) + "\n\nMore prose.", "\n\n" + "\n".join(mit + ["", *gpl]), "He lost his\nlicense and went\nto Apache county."]
    got = {r["doc_id"]: r["licences"] for r in licenses.families(docs(spark, texts)).collect()}
    assert got == {0: "0:MIT", 1: "2:GPL", 2: f"2:MIT,{len(mit) + 3}:GPL", 3: ""}


def count_slowly(t):
    words = t.encode().split()
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines, dup = set(), 0
    for line in t.split("\n"):
        dup += bool(line.encode().split()) and line in lines
        lines.add(line)
    return [len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), dup, len(covered)]


@pytest.mark.parametrize("t", ["", " ", "a b c a b c", "x\nx\n\n\nx y", "a a a a a", "é | # <b>\t\x0b z", "日本 日本 日本 日本", "w " * 3000, " a b"])
def test_counts(t):
    got = stats.count(t)
    at = [stats.COUNTS.index(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    assert [got[k] for k in at] == count_slowly(t)


def test_quality_on_held_out_rows(spark, sf):
    sf = sf.replace("0.001", "0.01")
    scored = queries.op3_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in scored if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.classify(docs(spark, ["a", None]), none).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(docs(spark, ["a b", "c", "d", ""]), one).collect()} == {1.0}
    assert quality.classify(docs(spark, []), none).count() == 0


def test_rules(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = queries.op6_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in got if r["quality"] == 1 and not r["base_failed"]], [r for r in got if r["quality"] == 0]
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert np.mean([r["kept"] for r in good]) > 0.97
    assert np.mean([not r["kept"] for r in bad]) > 0.9


def test_rules_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    long = " ".join(f"w{i}" for i in range(60))
    got = {r["doc_id"]: r["kept"] for r in rules.verdicts(docs(spark, [long, "short", None, ""]), none).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False}
    assert [r["doc_id"] for r in rules.keep(docs(spark, [long, "short", None]), none).collect()] == [0]
    assert rules.keep(docs(spark, []), none).count() == 0


def dedup_slowly(texts, least):
    """Deletes every line that lies in a run of least words that occurs earlier."""
    seqs = []
    for t in texts:
        lines = t.split("\n")
        seqs.append([(n, x, min(least, len(x.encode().split()))) for n, x in enumerate(lines) if x.encode().split()])
    gone = [set() for _ in texts]
    seen = set()
    for d, seq in enumerate(seqs):
        for i in range(len(seq)):
            total = 0
            for j in range(i, len(seq)):
                total += seq[j][2]
                run = tuple(x for _, x, _ in seq[i : j + 1])
                if total >= least:
                    if (run in seen) and any(True for _ in [0]):
                        gone[d] |= {seq[k][0] for k in range(i, j + 1)}
        for i in range(len(seq)):
            for j in range(i, len(seq)):
                seen.add(tuple(x for _, x, _ in seq[i : j + 1]))
    return ["\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]) for d, t in enumerate(texts)]


def test_line_dedup_is_that_of_brute_force(spark):
    rng = random.Random(3)
    pool = ["one two three", "four five", "six", "", "seven eight nine ten", "a b c d e f g h i j k l"]
    # within a document each pool line once, so that a run has no earlier copy of itself there
    texts = ["\n".join(rng.sample(pool, rng.randrange(1, 7)) + [f"own {i}"]) for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in linedup.dedup(docs(spark, texts), min_words=5).collect()}
    assert [got[i] for i in range(len(texts))] == dedup_slowly(texts, 5)


def covered_slowly(texts, least):
    """Lines of runs of least words that begin earlier too, overlapping copies included, by all pairs of positions."""
    seqs = [[(n, x, len(x.encode().split())) for n, x in enumerate(t.split("\n")) if x.encode().split()] for t in texts]
    at = [(d, i) for d, s in enumerate(seqs) for i in range(len(s))]
    gone = [set() for _ in texts]
    by_line = {}
    for d, i in at:
        for e, j in by_line.get(seqs[d][i][1], []):
            k = 0
            while i + k < len(seqs[d]) and j + k < len(seqs[e]) and seqs[d][i + k][1] == seqs[e][j + k][1]:
                k += 1
            if sum(w for _, _, w in seqs[d][i : i + k]) >= least:
                gone[d] |= {n for n, _, _ in seqs[d][i : i + k]}
        by_line.setdefault(seqs[d][i][1], []).append((d, i))
    return ["\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]) for d, t in enumerate(texts)]


def test_line_dedup_of_long_and_overlapping_repeats(spark):
    """Repeats of 11 to 100 lines, copies that overlap themselves, many copies of one line."""
    rng = random.Random(6)
    source = [f"line {k} of {rng.randrange(9)}" if k % 3 else f"w{k}" for k in range(400)]
    texts = []
    for d in range(40):
        a, n = rng.randrange(300), rng.randrange(11, 101)
        texts.append("\n".join([f"own {d}", *source[a : a + n], f"end {d}", *rng.choices(["x", "y z", ""], k=6)]))
    texts += ["\n".join(["a b"] * 30), "\n".join(["a b", "c"] * 25), "\n".join(["a b"] * 30), "z\n" * 200 + "a b", "\n".join(source)]
    for least in (10, 7):
        got = [r["text"] for r in linedup.dedup(docs(spark, texts), min_words=least).orderBy("doc_id").collect()]
        assert got == covered_slowly(texts, least)


def test_line_dedup_of_a_long_text_and_clashing_names(spark):
    import time

    run = "\n".join(f"line number {k} of the text" for k in range(20_000))
    rows = spark.createDataFrame([(0, run, "mine"), (1, run + "\nend", "mine"), (None, run, "null")], "doc_id long, text string, _lost string")
    began = time.time()
    got = {r["doc_id"]: r for r in linedup.dedup(rows).collect()}
    assert time.time() - began < 60
    assert got[None]["text"] == run and got[0]["text"] == "" and got[1]["text"] == "end"
    assert got[1]["_lost"] == "mine" and got[1]["_lost_"] == list(range(20_000))


def test_line_dedup_of_odd_rows(spark):
    run = "one two three four five six\nseven eight nine ten eleven twelve"
    got = linedup.dedup(docs(spark, [run, None, "", run, run + "\n\n" + run, run], [0, 1, 2, 3, 4, 0])).orderBy("doc_id", "text").collect()
    assert [(r["doc_id"], r["text"]) for r in got] == [(0, run), (0, run), (1, None), (2, ""), (3, ""), (4, "")]
    assert linedup.dedup(docs(spark, [])).count() == 0
