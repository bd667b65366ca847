import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenekiln.llm import vectors
from scenekiln.llm.mtree import MTree, products, top_products
from scenekiln.llm.queries import op5_ann
from scenekiln.llm.vptree import VpTree, cosines, nearest_neighbours

SF = "/root/testdata/sf0.1"


def odd_rows(rng, n=300, dim=8):
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, list(rows[3][1])) for i in range(40)]  # a group of equal vectors
    rows += [(1000, None), (1001, []), (1002, [0.0] * dim), (1003, [float("nan")] + [1.0] * (dim - 1)), (1004, [None] + [1.0] * (dim - 1)), (1005, [float("inf")] * dim), (None, [1.0] * dim)]
    rows += [(1010, [1.0, 2.0, 3.0]), (1050, [1.0, 2.0, 2.5]), (7, list(rows[7][1])), (1060, [1e200] + [0.5] * (dim - 1)), (1070, [2.0 * x for x in rows[5][1]])]
    return rows


def brute(rows, score, zero_ok, every=10, k=5):
    clean = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or (not zero_ok and not any(v)):
            continue
        clean[i] = np.array(v)
    out = {}
    for q in clean:
        if q % every == 0:
            found = sorted((-score(clean[q], v), i) for i, v in clean.items() if i != q and len(v) == len(clean[q]))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int")


def test_exact_neighbours_at_factor_one(spark):
    rows = odd_rows(random.Random(1))
    got = listed(nearest_neighbours(frame(spark, rows), F.col("id") % 10 == 0, factor=1.0))
    want = brute(rows, lambda a, b: float(cosines(a, b[None])[0]), False)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items() if v}
    assert all(s == pytest.approx(t) for q in got for (_, s), (_, t) in zip(got[q], want[q]))
    assert nearest_neighbours(frame(spark, []), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        nearest_neighbours(frame(spark, rows), F.lit(True), factor=0.5)


def test_ties_of_parallel_vectors_go_by_id(spark):
    rng = random.Random(8)
    base = [rng.gauss(0, 1) for _ in range(16)]
    rows = [(i, [2.0 ** (i % 7) * x for x in base]) for i in range(40)] + [(100 + i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(200)]
    rng.shuffle(rows)
    got = listed(nearest_neighbours(frame(spark, rows), F.col("id") < 40, factor=1.0))
    for q in range(40):
        assert [i for i, _ in got[q]] == [i for i in range(6) if i != q][:5] and all(s == pytest.approx(1.0) for _, s in got[q])


def test_groups_of_query_blocks(spark, monkeypatch):
    rows = odd_rows(random.Random(6))
    whole = listed(top_products(frame(spark, rows), F.lit(True)))
    for name, value in (("SHARD_ROWS", 50), ("BLOCK_ROWS", 20), ("GROUP_BYTES", 2000)):
        monkeypatch.setattr(vectors, name, value)
    assert listed(top_products(frame(spark, rows), F.lit(True))) == whole and len(whole) > 300


def test_exact_products(spark):
    rng = random.Random(2)
    rows = odd_rows(rng) + [(2000 + i, [rng.choice([0.0, 0.004, -0.004]) for _ in range(8)]) for i in range(200)]  # many ties
    got = listed(top_products(frame(spark, rows), F.col("id") % 10 == 0))
    score = lambda a, b: min(max(sum(int(x) * int(y) for x, y in zip(*(np.floor(np.clip(m * 256, -1e150, 1e150)) for m in (a, b)))), -(2**63)), 2**63 - 1)
    assert got == {q: v for q, v in brute(rows, score, True).items() if v}
    assert top_products(frame(spark, []), F.lit(True)).count() == 0


def test_recall_on_whole_table(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    m = np.stack(data.embedding).astype(float)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = listed(op5_ann(spark, SF))
    hits = total = 0
    for at in np.flatnonzero(data.vec_id % 50 == 0):
        s = unit @ unit[at]
        s[at] = -9
        want = set(data.vec_id.to_numpy()[np.argsort(-s)[:5]])
        hits += len(want & {i for i, _ in got[data.vec_id[at]]})
        total += 5
    assert hits / total >= 0.95


def test_one_id_in_a_third_of_the_rows(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(2000)] + [(50, [rng.gauss(0, 1) for _ in range(rng.choice([4, 4, 4, 3]))]) for _ in range(1000)]
    rng.shuffle(rows)
    df = frame(spark, rows).repartition(5)
    least = {}
    for i, v in sorted(rows):
        least.setdefault((i, len(v)), v)
    want = [(i, v) for (i, _), v in least.items()]
    assert sorted(map(repr, ((r.id, list(r.v)) for r in vectors.distinct_ids(vectors.usable(df, "vec_id", "embedding", True)).collect()))) == sorted(map(repr, want))
    monkeypatch.setattr(vectors, "SHARD_ROWS", 100)
    dealt = vectors.distinct_ids(vectors.usable(df, "vec_id", "embedding", True))
    shards = -(-dealt.count() // 100)
    most = dealt.groupBy(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("s")).count().agg(F.max("count")).first()[0]
    assert most <= 1.5 * 100
    got = listed(top_products(df, F.col("id") % 50 == 0))
    same = listed(top_products(frame(spark, want), F.col("id") % 50 == 0))
    assert got == same and len(got) == 40


def test_tree_leaves_work_out():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 6)) * 8
    m = np.floor((centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 6))) * 16)
    tree = MTree(np.arange(2000), m)
    asks = m[:50]
    place, computed = tree.nearest(asks, 5)
    assert computed < 0.6 * len(asks) * len(tree.points)
    for q, own in zip(asks, place):
        assert sorted(products(q, tree.points[own, :-1])) == sorted(products(q, tree.points[:, :-1]))[-5:]
    vp = VpTree(np.arange(2000), m)
    unit = vp.unit[:50]
    exact, loose = vp.nearest(unit, 5, 1.0), vp.nearest(unit, 5, 3.0)
    d = np.sort(vp._distances(unit, np.arange(len(vp.unit))), axis=1)[:, :5]
    assert np.allclose(np.sort(np.take_along_axis(vp._distances(unit, np.arange(len(vp.unit))), exact, 1), axis=1), d, atol=1e-6)
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(exact, loose)]) > 0.5
