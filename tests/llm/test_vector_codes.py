import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from scenekiln.llm import vector_codes as c

SCHEMA = "vec_id long, embedding array<double>, label string, code string, `a.b` int"


def brute(rows, rounds=4):
    """(vec_id, code, error, label_error) rows and the digest, in plain integers."""
    clean = [(i, [max(-c.BOUND - 1, min(c.BOUND, math.floor(1024 * x))) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    size = len(clean[0][1]) // 4
    part = lambda v, p: v[p * size : (p + 1) * size]
    first = {}
    for i, v, _ in sorted((r for r in clean if r[0] is not None), key=lambda r: r[:2]):
        first.setdefault(i, v)
    books = [[part(first[i], p) for i in sorted(first)[:256]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(part(v, p), books[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(4):
            own = [[] for _ in books[p]]
            for _, v, _ in clean:
                own[near(v, p)].append(part(v, p))
            new.append([[sum(x) // len(m) for x in zip(*m)] if m else e for m, e in zip(own, books[p])])
        books = new
    out = []
    for i, v, label in clean:
        codes = [near(v, p) for p in range(4)]
        out.append((i, label, "".join(f"{e:02x}" for e in codes), sum(far(part(v, p), books[p][e]) for p, e in enumerate(codes))))
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((i, code, error, sums[label]) for i, label, code, error in out), key=repr), hashlib.sha256(text.encode()).hexdigest()


def made(rng, n, dim=8):
    rows = [(rng.choice([i, i % 7, i * 3]), [rng.choice([rng.gauss(0, 0.3), 0.25]) for _ in range(dim)], rng.choice(["a", "b", None])) for i in range(n)]
    rows += [(5, None, "a"), (6, [], "a"), (7, [float("nan")] + [0.0] * (dim - 1), "a"), (8, [None] + [0.0] * (dim - 1), None), (None, [0.1] * dim, None)]
    return rows + [(3, rows[0][1], "hot")] * (n // 2)  # one id and label in a third of all rows


def listed(spark, rows):
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA).repartition(3)
    codes, books = c.compress(df)
    out = c.with_label_error(codes)
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out.collect()), key=repr), {r.codebooks_sha256 for r in out.collect()}, books


def test_against_plain_integers(spark, monkeypatch):
    rng = random.Random(6)
    for n, entries in ((400, True), (30, False)):
        rows = made(rng, n)
        got, digest, books = listed(spark, rows)
        want, sha = brute(rows)
        assert got == want and digest == {sha} and (books[8].entries.shape[1] == 256) == entries
    monkeypatch.setattr(c, "MAX_BROADCAST_LABELS", 0)
    assert listed(spark, rows)[0] == want
    monkeypatch.setattr(c, "BLOCK", 1)
    monkeypatch.setattr(c, "ROWS", 7)
    assert listed(spark, rows)[0] == want


def test_huge_components_stay_exact(spark):
    rng = random.Random(7)
    rows = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-3, 300) for _ in range(8)], "a") for i in range(60)]
    got, digest, books = listed(spark, rows)
    want, sha = brute(rows)
    most = (1 << 63) - 1
    assert [(r[0], r[1], r[2]) for r in got] == [(r[0], r[1], r[2]) for r in want] and digest == {sha}
    assert {r[3] for r in got} == {min(r[3], most) for r in want} and abs(books[8].entries).max() == c.BOUND + 1
    own = c.Codebooks(np.random.default_rng(1).integers(-c.BOUND, c.BOUND, (4, 5, 2)))
    x = np.random.default_rng(2).integers(-c.BOUND, c.BOUND, (9, 2))
    small = c.Codebooks(own.entries % 1000)
    for books, y in ((own, x), (small, x % 1000)):  # int64 and double products
        assert (books.products(1, y) == y @ books.entries[1].T).all()


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    empty = spark.createDataFrame([], schema)
    codes, books = c.compress(empty)
    assert c.with_label_error(codes).count() == 0 and not books
    codes, books = c.compress(spark.createDataFrame([(1, [0.5] * 4, 1), (2, [0.5] * 8, 1), (3, [0.5] * 6, 1), (None, [0.5] * 12, 1)], schema))
    assert {(r.vec_id, r.code, r.error) for r in codes.collect()} == {(1, "00000000", 0), (2, "00000000", 0)} and sorted(books) == [4, 8]
    assert [r.id for r in spark.range(0).select(F.col("id").alias("vec_id")).collect()] == []
