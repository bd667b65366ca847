import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scenekiln.llm import decontam as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(texts, items, window):
    """Number of words, places of hit words and item ids of each text."""
    phrases = {}
    for name, text in items:
        own = words(text)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            phrases.setdefault(tuple(own[i : i + size]), set()).add(name)
    sizes = {len(p) for p in phrases}
    for text in texts:
        own = words(text)
        found = [(i, n, phrases[tuple(own[i : i + n])]) for n in sizes for i in range(len(own) - n + 1) if tuple(own[i : i + n]) in phrases]
        yield len(own), {j for i, n, _ in found for j in range(i, i + n)}, sorted({x for *_, names in found for x in names if x is not None})


def made(rng, most=60):
    known = ["a", "B", "É", "c9", "dd", "straße"][: rng.randint(1, 6)]
    text = lambda n: rng.choice([" ", ". ", "\n"]).join(rng.choice(known + ["zz"] * rng.randint(0, 1)) for _ in range(n))
    texts = [None if rng.random() < 0.05 else text(rng.choice([0, 1, 3, 20, most])) for _ in range(rng.randint(0, 8))]
    items = [(str(i) if rng.random() < 0.9 else None, rng.choice([None, " ".join(rng.choice(known) for _ in range(rng.choice([0, 1, 2, 5, 9])))])) for i in range(rng.randint(0, 4))]
    return texts + texts[:2], items


def same(got, texts, items, window):
    for (n, hit, names), (n_got, spans, items_got), text in zip(brute(texts, items, window), got, texts, strict=True):
        assert (n, hit, names) == (n_got, {x for s in spans for x in range(s[0], s[1])}, items_got)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        data = (text or "").encode()
        assert all(len(words(data[s[2] : s[3]].decode())) == s[1] - s[0] for s in spans)


def test_index_against_brute_force(monkeypatch):
    rng = random.Random(1)
    for _ in range(150):
        texts, items = made(rng)
        window = rng.choice([1, 2, 3, 5])
        monkeypatch.setattr(d, "CHUNK_BYTES", rng.choice([3, 10, 50, 1 << 20]))  # long texts go by pieces
        monkeypatch.setattr(d, "SHARD_WORDS", rng.choice([8, 16, 1000]))  # and by shards
        found = d._Found(d.Phrases.of(items, window))
        found.take_texts(pa.array(texts, pa.string()))
        same(zip(*found.finished()), texts, items, window)


def test_suffixes_are_in_order():
    rng = np.random.default_rng(2)
    for _ in range(100):
        own = rng.integers(0, rng.integers(2, 5), rng.integers(1, 80))
        own = np.r_[np.tile(own, 2), 0]
        ends = [int(np.flatnonzero(own[i:] == 0)[0]) + i for i in range(len(own))]
        key = lambda i: [*((int(x), 0) for x in own[i : ends[i]]), (0, ends[i])]  # noqa: E731, B023
        assert d.suffix_array(own).tolist() == sorted(range(len(own)), key=key)


def rows_of(df):
    return [(r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in df.orderBy("at").collect()]


def test_dataframes_edges_and_passes(spark):
    rng = random.Random(3)
    texts, items = made(rng, 200)
    while not any(i for i in items if i[1]):
        texts, items = made(rng, 200)
    docs = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(texts)], "at int, text string, spans string, `a.b` array<int>")
    bench = spark.createDataFrame(items, "item_id string, text string")
    whole = d.decontaminate(docs, bench, 3)
    assert whole.columns == ["at", "text", "a.b", "n_words", "spans", "items"]
    same(rows_of(whole), texts, items, 3)
    passes = d.decontaminate(docs, bench, 3, pass_bytes=8)  # several passes, merged
    assert rows_of(passes) == rows_of(whole)
    assert d.decontaminate(docs.limit(0), bench).count() == 0
    assert all(not r.spans and not r["items"] for r in d.decontaminate(docs, bench.limit(0)).collect())
    with pytest.raises(ValueError):
        d.decontaminate(docs, bench, 0)


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([("é one two THREE, four é",), ("one two three",), ("none",), (None,)], "text string")
    out = d.decontaminate(docs, spark.createDataFrame([(7, "One-two three")], "item_id int, text string"), 3)
    left = out.select(d.without_spans(F.col("text"), F.col("spans")).alias("t")).collect()
    assert [r.t for r in left] == ["é  , four é", " ", "none", None]


def test_long_text_and_many_copies(spark, monkeypatch):
    rng = random.Random(4)
    item = [f"q{i}" for i in range(12)]
    parts = [[rng.choice("abcdefgh") for _ in range(500)] for _ in range(40)]
    long = " ".join(x for p in parts for x in (*p, *item, "tail"))  # the passage 40 times in one text
    found = d._Found(d.Phrases.of([("i", " ".join(item)), ("b", "a b c d")]))
    monkeypatch.setattr(d, "CHUNK_BYTES", 1000)
    monkeypatch.setattr(d, "SHARD_WORDS", 70)
    found.take_texts(pa.array([long, None, long]))
    same(zip(*found.finished()), [long, None, long], [("i", " ".join(item)), ("b", "a b c d")], 10)
    copies = spark.createDataFrame([(long[:2000],)] * 300, "text string").repartition(3)
    assert len({str(r) for r in d.decontaminate(copies, spark.createDataFrame([("i", long[500:900])], "item_id string, text string")).collect()}) == 1
