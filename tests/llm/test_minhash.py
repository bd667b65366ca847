import random
import re

import numpy as np
import pyarrow as pa

from scenekiln.llm import minhash
from scenekiln.llm.minhash import NearDuplicates, components, shingle_sets, signature


def sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k):
    own = {i: sets(t, k) for i, t in rows if i is not None}
    root = {i: i for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(own)
    for x in ids:
        for y in ids:
            if x < y and own[x] and own[y] and (n := len(own[x] & own[y])) and 100 * n >= 80 * (len(own[x]) + len(own[y]) - n):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(own[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(500)]
    rows, texts = [], []
    for _ in range(60):
        texts.append([rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 30, 80, 200]))])
    for base in list(texts[:25]):
        for _ in range(rng.choice([1, 2, 12])):  # from copies to pairs around the threshold and chains
            words = list(rng.choice(texts[-3:] + [base] * 3))
            for _ in range(rng.randrange(0, 2 + len(words) // 18)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(words)
    for i, words in enumerate(texts):
        rows.append((i * 7 % 1009, rng.choice(["", " \n"]) + rng.choice([" ", "\t", "  "]).join(words)))
    return rows + [(2000, None), (2001, ""), (2002, " \n "), (2003, "ONE two"), (2004, "one TWO"), (2005, "x" * 100_000)]


def test_against_brute_force(spark):
    for seed, k in ((1, 4), (2, 5)):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, "c") for i, t in rows + rows[:3] + [(None, "one two")]], "doc_id long, text string, component_id string")
        near = NearDuplicates(docs, k=k)
        out = near.result().collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == brute(rows, k)
        assert len(out) == len(rows) + 4 and all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)
        left = [r.doc_id for r in near.kept(docs).collect()]
        assert set(left) == {r.doc_id for r in out if r.kept}
    assert NearDuplicates(docs.limit(0)).result().count() == 0


def test_tiles_of_large_buckets(spark, monkeypatch):
    """Many variants of one text, few of them linked with the smallest: links that only tiles find."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.choice([0, 2, 4, 6, 9]) if i else 8):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 4)
    for members in (1024, 7):
        monkeypatch.setattr(minhash, "BLOCK_MEMBERS", members)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in NearDuplicates(docs, k=4).result().collect()} == want


def test_sets_and_signatures():
    rng = random.Random(4)
    base = [f"t{rng.randrange(10**6)}" for _ in range(3000)]
    texts = [" ".join(base), " ".join(base[300:]), "A b\x0bC d", "a B c D e", None, ""]
    got = list(shingle_sets(pa.array(texts), 4))
    assert [len(g) for g in got] == [len(sets(t, 4)) for t in texts]
    assert len(np.intersect1d(got[0], got[1])) == len(sets(texts[0], 4) & sets(texts[1], 4)) and len(np.intersect1d(got[2], got[3])) == 1
    (a, keys_a), (b, keys_b) = signature(got[0]), signature(got[1])
    same = sum((int(x) >> (4 * i) & 15) == (int(y) >> (4 * i) & 15) for x, y in zip(a, b) for i in range(16)) / 96
    assert abs((same - 1 / 16) / (15 / 16) - 0.9) < 0.12 and (keys_a == keys_b).sum() >= 5


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(1, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(35)] + [(500, i) for i in range(501, 700)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {n: got.get(n, n) for n in root} == root


def test_repeated_rows_leave_one(spark):
    texts = ["one two three four five six", "seven eight nine ten eleven twelve", "a b c d e f g", "h i j k l m n"]
    rows = [(7, texts[0])] * 3 + [(7, "ONE two three four five six"), (8, texts[0]), (7, texts[1]), (9, texts[2]), (6, "")]
    rows += [(None, texts[3])] * 3 + [(None, texts[2]), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    left = [tuple(r) for r in NearDuplicates(docs, k=5).kept(docs).collect()]
    want = [(7, "ONE two three four five six"), (7, texts[1]), (9, texts[2]), (6, ""), (None, texts[3]), (None, texts[2]), (None, ""), (None, None)]
    assert sorted(map(repr, left)) == sorted(map(repr, want))


def test_long_texts_in_pieces(monkeypatch):
    """A text that is hashed in pieces has the set it has in one, wherever the cuts fall."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("abÉ  \n\tZ") for _ in range(rng.randrange(1, 400))) for _ in range(60)] + ["x" * 300, " " * 300, "", "a b", " x" + "y" * 100 + " "]
    whole = [g.tolist() for g in shingle_sets(pa.array(texts), 4)]
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(minhash, "CHUNK_BYTES", size)
        assert [g.tolist() for g in shingle_sets(pa.array(texts), 4)] == whole


def test_large_bucket_with_few_outsiders(spark, monkeypatch):
    """Most members are linked with the hub; those that are not meet every block of those that are."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]

    def changed(words, n, tag):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = f"{tag}{rng.randrange(10**6)}"
        return words

    chain = [base]
    for _ in range(6):  # each linked with the one before, the last not with the first
        chain.append(changed(chain[-1], 4, "c"))
    texts = [base] + [changed(base, 2, "x") for _ in range(80)] + chain[::-1] + [changed(base, 12, "far") for _ in range(5)]
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in NearDuplicates(docs, k=4).result().collect()} == brute(rows, 4)


def test_kept_rows_of_any_columns(spark):
    """Repeated ids with maps, dotted and clashing names, nulls."""
    text = "one two three four five six seven"
    rows = [(1, text, {"a": 1}, [1.0], b"x", None), (1, text, {"b": 2}, None, None, "u"), (1, text, None, [2.0], b"", "v"), (1, "others " + text, {}, [], b"y", "w"), (2, text, {}, [], b"y", "w"), (None, text, {"c": 3}, [], b"z", "w"), (None, text, {"c": 4}, [], b"z", "w"), (3, "", {"d": 1}, [], b"", ""), (3, "", {"d": 1}, [], b"", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, `a.b` array<double>, row binary, told string")
    for parts in (1, 4):
        out = NearDuplicates(docs.repartition(parts).select("doc_id", "text"), k=5).kept(docs.repartition(parts))
        assert out.columns == docs.columns
        found = out.collect()
        assert sorted(map(repr, ((r.doc_id, r.text) for r in found))) == sorted(map(repr, [(1, text), (1, "others " + text), (None, text), (3, ""), (3, "")]))
        assert all((r.doc_id, r.text, r.m, r["a.b"], bytes(r["row"]) if r["row"] is not None else None, r.told) in rows for r in found)
        first = first if parts == 4 else sorted(map(repr, found))
    assert sorted(map(repr, found)) == first
