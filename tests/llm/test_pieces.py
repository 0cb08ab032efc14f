"""Packing, media, chats, joins and byte pairs: round trips and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from isohyet.llm import bpe, chat, jaccard, media, packing, queries
from isohyet.llm.graph import components

TEXTS = [None, "", "x", "é" * 70, "日本語 text <|endoftext|> ½ x² \x1c", "word " * 4000, "a" * 6000, "same", "same", "\r\n\t  end "]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "clash", 7, 3) for i, t in enumerate(texts)], "doc_id long, text string, ids string, piece int, offset int")


def hf(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: [*t.encode(text, add_special_tokens=False).ids, 0]


def test_packing(spark):
    path = queries.tokenizer_file("byte_bpe_50k.json")
    encode = hf(path)
    got = packing.pack_documents(docs(spark), path).toPandas()
    for i, t in enumerate(TEXTS):
        own = got[got.doc_id == i].sort_values("piece")
        ids = np.array(encode(t or ""), "<u4")
        assert own.length.sum() == len(ids)
        assert (own.length[1:] == 2048).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)] == list(own.ids_crc32)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]]
        assert s.length.sum() <= 2048
    assert 50256 in encode(TEXTS[4])  # the string of an added token, read as the tokenizer file has it
    assert packing.pack_documents(docs(spark, []), path).count() == 0


def test_packing_of_equal_rows_and_clashing_names(spark):
    names = "sequence_id long, offset string, _length long, _task int, _piece string, length int, other map<string,int>"
    rows = [(9, "o", 1, 2, "p", n, {"k": n}) for n in (5, 5, 5, 2048, 2043, 2043, 1) * 3]
    got = packing.pack(spark.createDataFrame(rows, names).repartition(3)).toPandas()
    assert sorted(got.length) == sorted(r[5] for r in rows)
    assert set(got._length) == {1} and set(got._piece) == {"p"}
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert got.sequence_id.nunique() == 10  # the least: 18,450 tokens
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(2049,)], "length int"))
    twice = [(1, "same"), (1, "same"), (None, "same"), (None, None)]
    own = packing.pack_documents(spark.createDataFrame(twice, "doc_id long, text string"), queries.tokenizer_file("byte_bpe_50k.json")).toPandas()
    assert len(own) == 4 and own.offset.nunique() == 4 and own.sequence_id.nunique() == 1


@pytest.mark.parametrize("lengths", [[], [2048] * 5, [1500] * 9, [1000, 1048] * 50, list(range(1, 2049)), [3] * 5000])
def test_plans_use_up_the_histogram(lengths):
    h = np.bincount(lengths, minlength=2049) if lengths else np.zeros(2049, int)
    made = np.zeros(2049, int)
    sequences = 0
    for own, k in packing.plan(h):
        assert sum(own) <= 2048
        sequences += k
        for n in own:
            made[n] += k
    assert (made == h).all()
    if lengths in ([1000, 1048] * 50, list(range(1, 2049))):
        assert sequences <= 1.01 * -(-sum(lengths) // 2048)


def test_media_round_trip(spark):
    got = {r["doc_id"]: r for r in media.read(media.store(docs(spark))).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        assert bytes(got[i]["pixels"])[: len(raw)] == raw
        assert got[i]["n_bytes"] == len(raw)
        assert len(got[i]["pixels"]) % 64 == 0
        assert got[i]["error"] is None
    assert got[7]["thumbnail_hash"] == got[8]["thumbnail_hash"]


def test_media_of_many_images_and_bad_files(spark):
    big = bytes(random.Random(2).randrange(256) for _ in range(64 * (media.MOST_ROWS + 3)))
    assert media._read(media._write([big], [len(big)]))[0]["pixels"] == big
    bad = spark.createDataFrame([(1, b"junk"), (2, None), (3, b"\xff\xd8\xff\xd9")], "doc_id long, media binary")
    assert [r["pixels"] for r in media.read(bad).orderBy("doc_id").collect()] == [None] * 3


def test_chats_come_back(spark):
    marks = ["</s>[INST] ok [/INST]", " [/INST]", "\\[x\\\\", "<role:x> </role>", "<<SYS>>\n", "\n<</SYS>>\n\n", "plain", "", None, "[INST]", "a\\", "tail "]
    marks += ["</s>", "\ue000 <s>", "\ue001/s> [INST]", "\t", "<role:a> b"]
    roles = ["user", "assistant", "system", "tool>", "a> b", "<role:x> y", "\\g\\", None]
    rng = random.Random(4)
    rows = [(c, t, rng.choice(roles), rng.choice(marks), 0) for c in range(40) for t in range(rng.randrange(1, 6))]
    rows += [(None, 0, "user", "no id", 0), (5, 9, "user", "twice", 0), (5, 9, "user", "twice", 0)]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted int")).collect()}
    for c in {r[0] for r in rows}:
        want = sorted(((t, r or "", x or "") for k, t, r, x, _ in rows if k == c))
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for _, r, x in want]
        texts = [got[c]["formatted"][m["start"] : m["end"]] for m in got[c]["mask"]]
        assert len(texts) == sum(r == "assistant" for _, r, _ in want)
        marks_left = re.findall(chat.CONTROL, re.sub(r"\\[\\\[<>]", "", got[c]["formatted"]))
        kinds = {"user": 3, "assistant": 1, "system": 2}
        assert len(marks_left) == sum(kinds.get(r, 2) for _, r, _ in want)  # the template's own, and no other
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_long_chats(spark):
    """A conversation of many turns, a text of many control strings, a long role."""
    rows = [(1, i, ("user", "assistant")[i % 2], "turn </s>" if i % 3 else "x") for i in range(4000)]
    rows += [(2, 0, "assistant", "<s> " * 100_000), (3, 0, "r>" * 20_000, "x")]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r, x) for c, _, r, x in rows if c == 1]
    assert got[2]["turns"][0]["text"] == "<s> " * 100_000
    assert got[3]["turns"][0]["role"] == "r>" * 20_000


def links_slowly(texts):
    s = [set(jaccard.shingles(t or "").tolist()) for t in texts]
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b) and len(a) > 0
    links = [sum(near(a, b) for j, b in enumerate(s) if j != i) for i, a in enumerate(s)]
    up = list(range(len(s)))
    for _ in s:
        for i, a in enumerate(s):
            for j, b in enumerate(s):
                if near(a, b):
                    up[i] = up[j] = min(up[i], up[j])
    return links, up


def test_join_is_that_of_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "a", "a", "a b c d", "one two three four five six"]
    for _ in range(20):
        own = [rng.choice(words) for _ in range(rng.randrange(30, 120))]
        texts.append(" ".join(own))
        for _ in range(rng.randrange(4)):
            copy = list(own)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    links, classes = links_slowly(texts)
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.join(docs(spark, texts)).collect()}
    assert got == {i: (classes[i], links[i]) for i in range(len(texts))}
    kept = {r["doc_id"] for r in jaccard.keep_one(docs(spark, texts)).collect()}
    assert kept == {i for i in range(len(texts)) if classes[i] == i}
    assert jaccard.join(docs(spark, [])).count() == 0


def test_one_of_equal_rows_stays(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None), (None, "x")]
    names = "_id long, _row string"
    kept = jaccard.keep_one(spark.createDataFrame(rows, names), "_id", "_row").collect()
    assert sorted((r["_id"] or 0, r["_row"] or "") for r in kept) == [(0, "x"), (1, "a b c d e f"), (3, "")]


def test_large_buckets_are_tiled(monkeypatch, spark):
    monkeypatch.setattr(jaccard, "SMALL", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k:]]) for k in range(0, 80, 4)]
    links, _ = links_slowly(texts)
    assert {r["doc_id"]: r["links"] for r in jaccard.join(docs(spark, texts)).collect()} == dict(enumerate(links))


def test_buckets_are_split_until_they_are_small(monkeypatch, spark):
    """Texts that share a passage but are unlike otherwise: all have its buckets; pairs are found below them."""
    monkeypatch.setattr(jaccard, "SMALL", 6)
    rng = random.Random(9)
    common = [f"c{k}" for k in range(40)]
    texts = []
    for d in range(60):
        own = [f"d{d}x{k}" for k in range(60)]
        texts += [" ".join(common + own), " ".join(common + own[:rng.randrange(57, 61)])]
    texts += [" ".join(common + [f"e{k}" for k in range(60)] + [f"near{j}"]) for j in range(30)]
    links, classes = links_slowly(texts)
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.join(docs(spark, texts)).collect()}
    assert got == {i: (classes[i], links[i]) for i in range(len(texts))}


def test_rows_of_large_buckets_are_made_once(monkeypatch, spark):
    """Paths carry no sketches into the first shuffle; the rows of a split are made once, not for each table that reads them."""
    monkeypatch.setattr(jaccard, "SMALL", 20)
    given, sized = [], jaccard._sized
    monkeypatch.setattr(jaccard, "_sized", lambda rows: given.append(rows) or sized(rows))
    common = [f"c{k}" for k in range(40)]
    texts = [" ".join(common + [f"d{d}x{k}" for k in range(60)]) for d in range(60)]
    texts += [" ".join(common + [f"e{k}" for k in range(60)] + [f"near{j}"]) for j in range(30)]
    links, classes = links_slowly(texts)
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.join(docs(spark, texts)).collect()}
    assert got == {i: (classes[i], links[i]) for i in range(len(texts))}
    assert len(given) > 1 and not {"sketch", "splits"} & set(given[0].columns)
    assert not [rows for rows in given[1:] if "Generate" in rows._jdf.queryExecution().toString()]


def test_pairs_at_the_threshold_meet():
    """Sets of a similarity of 0.8 share a first step as often as planned; sets that share a quarter seldom do."""
    import numpy as np

    rng = np.random.default_rng(4)
    runs, splits = jaccard.runs_for()
    assert jaccard.missed(runs, splits) <= 1 - jaccard.RECALL

    def shared(common, own):
        tokens = jaccard._mixed(rng.integers(0, 1 << 63, common + 2 * own, dtype=np.uint64))
        a, b = (jaccard.paths(jaccard.least(np.concatenate([tokens[:common], own])), runs) for own in (tokens[common : common + own], tokens[common + own :]))
        return int((a == b).sum())

    assert sum(shared(80, 10) == 0 for _ in range(2000)) <= 8
    assert sum(shared(25, 75) for _ in range(500)) <= 250  # a token a step: 9 * 1 / 7 buckets a pair, here 9 / 49


def test_long_texts_are_joined(spark):
    base = [f"w{k}" for k in range(150_000)]
    texts = [" ".join(base), " ".join(base[:140_000]), " ".join(base[:100_000]), "x"]
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.join(docs(spark, texts)).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (2, 0), 3: (3, 0)}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


def test_bpe_is_that_of_the_library(spark):
    import base64

    import public_tokenizers
    import tiktoken

    path = queries.tokenizer_file("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pairs = bpe.encode(docs(spark), path)
    got = {r["doc_id"]: r["ids"] for r in pairs.collect()}
    assert got == {i: own.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(pairs, path).collect()} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    both = bpe.round_trip(docs(spark), path).collect()
    assert {r["doc_id"]: hashlib.sha256(bytes(r["decoded"])).hexdigest() for r in both} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(TEXTS)}


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    left = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = left.columns, left.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, sf)
        assert left.columns == columns, name
        assert left.count() <= before
    packed = corpus_pipeline.run(spark, sf).toPandas()
    assert (packed.groupby("sequence_id").length.sum() <= 2048).all()
    assert packed.doc_id.nunique() == left.select("doc_id").distinct().count()


def test_sql_agrees(spark, sf, duck):
    from tests.conftest import rows

    for name, sql in queries.oracle_sql().items():
        assert rows(queries.queries()[name](spark, sf).toPandas()) == rows(duck.sql(sql).df()), name
