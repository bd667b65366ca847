import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from scenekiln.functions import geometry as g
from scenekiln.functions import text as t
from scenekiln.operators import ranking, sampling, scenes
from scenekiln.plans import sql
from scenekiln.plans.queries import ORACLE_SQL, QUERIES
from scenekiln.plans.sql import scenes_sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    by_name = sorted(columns)
    order = [columns.index(c) for c in by_name]
    norm = lambda rs: sorted(repr([plain(v) for v in r]) for r in rs)
    assert norm([r[c] for c in by_name] for r in rows) == norm([r[i] for i in order] for r in want.fetchall())


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def pts(points):
    return F.array(*[g.point(F.lit(float(x)), F.lit(float(y))) for x, y in points]) if points else F.array().cast(g.POINTS)


def test_boxes(spark):
    box = lambda p, w, h, m: one(spark, g.points_to_bbox(pts(p), F.lit(w), F.lit(h), m))
    assert tuple(box([(5, 5), (50, 60)], 100, 100, 3)) == (2, 2, 53, 63)
    assert box([], 100, 100, 3) is None and box([(-10, 5), (-5, 6)], 100, 100, 1) is None
    assert tuple(box([(3.9, 3.2), (9.9, 9.9)], 100, 100, 3)) == (0, 0, 12, 12)
    yolo = lambda w, h, *b, **k: one(spark, g.voc_to_yolo(F.lit(w), F.lit(h), *map(F.lit, b), **k))
    assert tuple(yolo(100, 100, 25, 75, 25, 75)) == (0.5, 0.5, 0.5, 0.5)
    for w, b, said in ((100, (50, 50, 10, 20), "degenerate"), (0, (1, 2, 3, 4), "positive")):
        with pytest.raises(Exception, match=said):
            yolo(w, 100, *b)
        assert yolo(w, 100, *b, strict=False) is None


def test_polygons(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert one(spark, g.polygon_area(pts(square))) == 100
    moved = one(spark, g.hull_to_points(pts(square), F.lit(5), F.lit(7)))
    assert (moved[0].x, moved[0].y, moved[2].x, moved[2].y) == (5, 7, 15, 17)
    with pytest.raises(Exception, match="three points"):
        one(spark, g.polygon(pts([(0, 0), (1, 1)])))
    assert one(spark, g.safe_area(pts([(0, 0), (1, 1), (2, 2)]))) is None
    assert one(spark, g.safe_area(pts([(0, 0), (10, 0), (1, 1), (0, 10)]))) == pytest.approx(10)
    c = one(spark, g.centroid(pts(square)))
    assert (c.x, c.y) == (5, 5)


def test_occlusion_boundary(spark):
    hull = [(0, 0), (10, 0), (10, 10), (0, 10)]
    kept = lambda h, o: one(spark, g.kept_after_occlusion(pts(h), pts(o) if o is not None else F.lit(None).cast(g.POINTS)))
    cover = lambda x: [(-5, -5), (x, -5), (x, 20), (-5, 20)]
    assert kept(hull, None) and kept(hull[:2], None)
    assert kept(hull, cover(0.99)) and not kept(hull, cover(1.01)) and kept(hull, [(50, 50), (60, 50), (60, 60)])
    assert not kept(hull[:2], cover(1)) and not kept(hull, [(0, 0), (1, 1)])


def test_gates(spark):
    assert one(spark, g.hull_plausible(F.lit(940.0))) and one(spark, g.hull_plausible(F.lit(2120.0))) and not one(spark, g.hull_plausible(F.lit(939.9)))
    assert not one(spark, g.lies_wide(F.lit(3), F.lit(3))) and one(spark, g.rectangularity(F.lit(101.0), F.lit(100.0))) == 1.0
    assert one(spark, g.rectangularity(F.lit(1.0), F.lit(0.0))) is None
    edge = 34 / 2 - 34 * 0.3
    assert not one(spark, g.centre_ok(F.lit(34), F.lit(82), F.lit(edge), F.lit(41.0))) and one(spark, g.centre_ok(F.lit(34), F.lit(82), F.lit(edge + 1e-6), F.lit(41.0)))


def cut_area(a, b):
    """Shared area by sampling-free clipping on exact half planes, in plain Python."""
    def sign(p):
        return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(p, p[1:] + p[:1])) / 2

    out = list(a)
    s = 1 if sign(b) > 0 else -1
    for (ax, ay), (bx, by) in zip(b, b[1:] + b[:1]):
        f = lambda p: s * ((bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax))  # noqa: B023, E731
        new = []
        for p, q in zip(out, out[1:] + out[:1]):
            d, e = f(p), f(q)
            if d >= 0:
                new.append(p)
            if d * e < 0:
                new.append((p[0] + (q[0] - p[0]) * d / (d - e), p[1] + (q[1] - p[1]) * d / (d - e)))
        out = new
    return abs(sign(out)) if out else 0.0


def test_intersections_are_symmetric_and_bounded(spark):
    rng = random.Random(4)

    def quad():
        cx, cy, a, w, h = rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(0, 7), rng.uniform(1, 15), rng.uniform(1, 15)
        flat = [(-w, -h), (w, -h), (w, h), (-w, h)]
        turned = [(cx + x * math.cos(a) - y * math.sin(a), cy + x * math.sin(a) + y * math.cos(a)) for x, y in flat]
        return turned if rng.random() < 0.5 else turned[::-1]

    pairs = [(i, quad(), quad()) for i in range(300)]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in a], [{"x": x, "y": y} for x, y in b]) for i, a, b in pairs], f"id int, a {g.POINTS}, b {g.POINTS}")
    rows = df.select("id", g.intersection_area(F.col("a"), F.col("b")).alias("ab"), g.intersection_area(F.col("b"), F.col("a")).alias("ba"), g.polygon_area(F.col("a")).alias("a"), g.polygon_area(F.col("b")).alias("b")).collect()
    for r in rows:
        _, a, b = pairs[r.id]
        assert r.ab == pytest.approx(r.ba, abs=1e-7) and r.ab <= min(r.a, r.b) + 1e-7 and r.ab == pytest.approx(cut_area(a, b), abs=1e-7)


def test_label_text(spark):
    values = [0.0078125, 5e-7, 0.5, 1.0, 0.1234565, 1 / 3]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    lines = [r.line for r in df.select(t.yolo_line(F.lit(3), F.struct(*[F.col("v").alias(c) for c in ("cx", "cy", "w", "h")])).alias("line")).collect()]
    assert lines == [" ".join(["3"] + [f"{v:.6f}"] * 4) for v in values]


def test_ranks_and_slots(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(10**6), rng.random() < 0.7) for _ in range(500)]
    df = spark.createDataFrame(rows, "k int, ok boolean").repartition(7)
    got = ranking.shard_slots(ranking.ranked(df, [F.col("k")], F.col("ok")), 64).orderBy("index").collect()
    assert [r["index"] for r in got] == list(range(500)) and [r.k for r in got] == sorted(k for k, _ in rows)
    ranks = [r["rank"] for r in got if r.ok]
    assert ranks == list(range(1, len(ranks) + 1)) and all(r["rank"] is None for r in got if not r.ok)
    assert [(r.shard, r.slot) for r in got if r.ok] == [divmod(i, 64) for i in range(len(ranks))]
    assert ranking.ranked(df.limit(0), [F.col("k")]).count() == 0
    with pytest.raises(ValueError):
        ranking.shard_slots(df, 0)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**31), st.integers(1, 20), st.sampled_from([2, 3]))
def test_plans_depend_on_the_seed_alone(seed, scenes_, n):
    rows = sampling.plan_rows(seed, scenes_, n, [3, 1, 2], 4)
    assert rows == sampling.plan_rows(seed, scenes_, n, [3, 1, 2], 4) and rows[: (scenes_ // 2) * n] == sampling.plan_rows(seed, scenes_ // 2, n, [3, 1, 2], 4) and len(rows) == scenes_ * n
    assert all(0 <= r[2] < 4 and 0 <= r[4] < [3, 1, 2][r[3]] and -30 <= r[5] <= 30 and 0.5 <= r[6] <= 0.8 for r in rows)
    assert rows[0][2] == int(np.random.default_rng(seed + 1).integers(0, 4))


def test_plans_refuse(spark):
    for bad in ((1, 1, 4, [1], 1), (1, 1, 2, [], 1), (1, 1, 2, [1], 0)):
        with pytest.raises(ValueError):
            sampling.plan_rows(*bad)


def test_all_later_occluders(spark):
    rows = [(1, z, "a", 0.0, 0.8, x, 0.0) for z, x in ((1, 0.0), (2, 0.9), (3, 0.0))]
    df = scenes.placed(spark.createDataFrame(rows, "scene int, z int, class string, angle double, scale double, tx double, ty double"))
    z = lambda **k: {r.z for r in scenes.corner_labels(df, **k).collect()}
    assert z() == {1, 3} or z() == {1, 2, 3}
    assert 1 not in z(occluders="all_later")
    with pytest.raises(ValueError):
        scenes.with_occluder(df, "x")


def test_name_list_reads_every_line_of_every_text(spark, duck):
    texts = [r[0] for r in duck.execute("SELECT text FROM documents").fetchall()]
    want = {line.strip() for text in texts for line in text.split("\n")} - {""}
    rows = [r.name for r in QUERIES["name_list"](spark, SF).collect()]
    assert len(rows) == len(want) and set(rows) == want and any(len(n) >= 20 for n in want)


def test_every_labelled_scene_has_a_label_file(spark, duck):
    select = "SELECT scene, string_agg(printf('%d %.6f %.6f %.6f %.6f', id, cx, cy, w, h) || chr(10), '' ORDER BY z, corner) AS text FROM corner_labels JOIN names USING (class) GROUP BY scene"
    want = dict(duck.execute(scenes_sql(select)).fetchall())
    rows = [(r.scene, r.text) for r in QUERIES["yolo_label_lines"](spark, SF).collect()]
    assert len(rows) == len(want) and dict(rows) == want and {scene % 3 for scene in want} == {0, 1, 2}


def test_all_layers_of_a_scene_are_composited(spark, duck):
    layers = {}
    for vec_id, embedding in duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall():
        layers.setdefault(vec_id // 3, []).append([int((float(x) + 1) * 127.5) for x in embedding])
    want = {}
    for scene, (base, *others) in layers.items():
        for over in others:
            base = [max(0, min(255, int(o * (a / 255.0) + b * (1 - a / 255.0)))) for o, b, a in zip(over, base, range(252, 60, -3))]
        want[scene] = sum(base)
    rows = [(r.scene, r.total) for r in QUERIES["alpha_composite_grid"](spark, SF).collect()]
    assert len(rows) == len(want) and dict(rows) == want and {len(v) for v in layers.values()} == {2, 3}


def test_safe_polygon_returns_every_point_set(spark, duck):
    want = {}
    for vec_id, e in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall():
        want[vec_id] = [(360 + 700 * float(e[2 * i]), 360 + 700 * float(e[2 * i + 1])) for i in range(32)]
    got = {r.vec_id: r.area for r in QUERIES["safe_polygon"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(a > 0 for a in got.values())
    for vec_id in list(want)[::100]:  # edges of 32 random points cross many times
        small = [((x - 0) / 30, (y - 0) / 30) for x, y in want[vec_id]]
        assert got[vec_id] / 900 == pytest.approx(grid_area([small], 0.1), rel=0.05)


def test_repaired_areas(spark):
    area = lambda *p: one(spark, g.safe_area(pts(list(p))))
    assert area((0, 0), (10, 0), (10, 10), (0, 10)) == 100 and area((0, 0), (10, 0), (1, 1), (0, 10)) == pytest.approx(10)
    assert area((0, 0), (1, 1), (2, 2)) is None and area() is None
    assert area((0, 0), (10, 0), (10, 0), (10, 10), (0, 10), (0, 0)) == pytest.approx(100)
    assert area((0, 0), (6, 0), (6, 4), (4, 4), (4, 2), (2, 2), (2, 4), (0, 4)) == pytest.approx(20)
    assert area((0, 0), (10, 10), (10, 0), (0, 5)) == pytest.approx(100 / 3)  # of a bow the larger lobe: the edges meet at (10/3, 10/3)
    star = [(10 * math.cos(4 * math.pi * i / 5), 10 * math.sin(4 * math.pi * i / 5)) for i in range(5)]  # all turns one way, twice around
    inner = 10 * math.cos(2 * math.pi / 5) / math.cos(math.pi / 5)
    assert area(*star) == pytest.approx(10 * 10 * inner * math.sin(math.pi / 5) / 2)
    assert area(*star[::-1]) == pytest.approx(area(*star))


def grid_area(polygons, step=0.25):
    """Share of a fine grid of points that all polygons wind around, the way round of their own signed areas."""
    def winds(p, x, y):
        n = 0
        for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1]):
            side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            n += (ay <= y < by and side > 0) - (by <= y < ay and side < 0)
        return n

    forward = [p if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) >= 0 else p[::-1] for p in polygons]
    places = [(i + 0.37) * step for i in range(int(24 / step))]
    return sum(all(winds(p, x, y) > 0 for p in forward) for x in places for y in places) * step * step


def test_any_polygons_against_a_grid(spark):
    rng = random.Random(12)
    some = lambda n: [(rng.uniform(1, 23), rng.uniform(1, 23)) for _ in range(n)]
    pairs = [(some(rng.randint(3, 9)), some(rng.randint(3, 9))) for _ in range(25)]
    square = [(2.0, 2.0), (12.0, 2.0), (12.0, 12.0), (2.0, 12.0)]
    cross = [(7.0, 2.0), (9.0, 2.0), (9.0, 20.0), (7.0, 20.0)]  # shares a border with the square
    notch = [(2.0, 2.0), (12.0, 2.0), (12.0, 12.0), (7.0, 7.0), (2.0, 12.0)]
    pairs += [(square, cross), (notch, square), (notch, notch), (square, [(12.0, 2.0), (20.0, 2.0), (20.0, 12.0), (12.0, 12.0)])]
    rows = [(i, [{"x": x, "y": y} for x, y in a], [{"x": x, "y": y} for x, y in b]) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, f"i int, a {g.POINTS}, b {g.POINTS}").select("i", g.safe_area(F.col("a")).alias("area"), g.intersection_area(F.col("a"), F.col("b")).alias("ab"), g.intersection_area(F.col("b"), F.col("a")).alias("ba"), g.region_shared(F.col("a"), F.col("b")).alias("r"))
    got = {r.i: r for r in df.collect()}
    for i, (a, b) in enumerate(pairs):
        assert (got[i].area or 0) == pytest.approx(grid_area([a]), abs=6) and got[i].ab == pytest.approx(grid_area([a, b]), abs=6)
        assert got[i].ab == pytest.approx(got[i].ba, abs=1e-6) and got[i].r == pytest.approx(got[i].ab, abs=1e-6)
    assert [round(got[i].ab, 6) for i in range(25, 29)] == [20.0, 75.0, 75.0, 0.0]


def test_corners_under_odd_cards(spark):
    hull, notch = [(0, 0), (10, 0), (10, 10), (0, 10)], [(-1, -1), (30, -1), (30, 30), (20, 5), (-1, 30)]
    kept = lambda h, o: one(spark, g.kept_after_occlusion(pts(h), pts(o)))
    assert not kept(hull, notch) and kept([(18, 25), (22, 25), (22, 29), (18, 29)], notch)


def test_plan_and_its_labels_against_plain_python_and_sql(spark, duck):
    """The planned queries, with draws from generators used in plain loops here, cards looked up and labelled in SQL."""
    entries = {}
    for brand, size, key in duck.execute("SELECT p_brand, p_size, printf('%08d', p_partkey) FROM part ORDER BY ALL").fetchall():
        entries.setdefault(brand, []).append((str(size), key))
    place, ground, deck = np.random.default_rng(42), np.random.default_rng(43), np.random.default_rng(44)
    want, names = [], sorted(entries)
    for scene in range(100):
        background = int(ground.integers(0, 64))
        cards = []
        for _ in range(3):
            name = names[int(deck.integers(0, len(names)))]
            cards.append((name, *sorted(entries[name], key=lambda e: (int(e[0]), e[1]))[int(deck.integers(0, len(entries[name])))]))
        for z, card in enumerate(cards):
            want.append((scene, z, background, *card, *(float(place.uniform(a, b)) for a, b in ((-30, 30), (0.5, 0.8), (-0.15, 0.15), (-0.15, 0.15)))))
    got = QUERIES["scene_plan"](spark, SF).collect()
    assert sorted((r.scene, r.z, r.background, r.name, str(r.shard), r.key, r.angle, r.scale, r.tx, r.ty) for r in got) == sorted(want)
    rows = ", ".join(f"({w[0]}, {w[1]}, '{w[3]}', " + ", ".join(f"{x!r}::DOUBLE" for x in w[6:]) + ")" for w in want)
    given = f"placements(scene, z, class, angle, scale, tx, ty) AS (VALUES {rows})"
    parts = [given, sql.PLACED, sql.SHARED, sql.LABELS]
    want = duck.execute("WITH " + ",\n".join(parts) + " SELECT scene, z, corner, class, xmin, ymin, xmax, ymax, round(cx, 6), round(cy, 6), round(w, 6), round(h, 6) FROM labels").fetchall()
    assert sorted(map(tuple, QUERIES["planned_labels"](spark, SF).collect())) == sorted(want) and len(want) > 300


def test_hashed_plan_against_plain_python(spark):
    index = spark.createDataFrame([("b", 0, "x"), ("a", 1, "k1"), ("a", 0, "k2"), ("a", 0, "k2"), (None, 0, "n")], "name string, shard int, key string")
    entries = [[(0, "k2"), (0, "k2"), (1, "k1")], [(0, "x")]]  # by rank of the class
    u = lambda *parts: int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52
    want = []
    for scene in range(40):
        for z in range(2):
            rank = int(u(9, "class", scene, z) * 2)
            shard, key = entries[rank][int(u(9, "entry", scene, z) * len(entries[rank]))]
            moves = [low + (high - low) * u(7, name, scene, z) for name, low, high in (("angle", -30.0, 30.0), ("scale", 0.5, 0.8), ("tx", -0.15, 0.15), ("ty", -0.15, 0.15))]
            want.append((scene, z, int(u(8, "background", scene) * 5), "ab"[rank], shard, key, *moves))
    plan = lambda n: sorted(map(tuple, sampling.drawn_cards(sampling.hashed_plan(spark, 7, n, 2, index, 5), index).select("scene", "z", "background", "name", "shard", "key", "angle", "scale", "tx", "ty").collect()))
    assert plan(40) == want and plan(10) == want[:20]
    assert sampling.hashed_plan(spark, 7, 3_000_000, 2, index, 5).count() == 6_000_000  # more than a driver's plan may hold
    for bad in ((4, index, 1), (2, index.limit(0), 1), (2, index, 0)):
        with pytest.raises(ValueError):
            sampling.hashed_plan(spark, 1, 1, *bad)


def test_index_numbers_against_plain_python(spark):
    """A class in most rows, ties and a missing name."""
    rows = [("hot", i % 7, f"{i % 50:03d}") for i in range(300)] + [("cold", 1, "x"), (None, 1, "y"), ("", 2, "z")]
    got = sampling.numbered_index(spark.createDataFrame(rows, "name string, shard int, key string").repartition(5)).collect()
    want = [(name, s, k, at, rank) for rank, name in enumerate(["", "cold", "hot"]) for at, (s, k) in enumerate(sorted(r[1:] for r in rows if r[0] == name))]
    assert sorted((r.name, r.shard, r.key, r.entry, r.class_rank) for r in got) == sorted(want)
    assert sampling.numbered_index(spark.createDataFrame([], "name string, shard int, key string")).count() == 0


@pytest.fixture(scope="module")
def odd_lines(tmp_path_factory):
    """Lines without a part, without an order, without numbers, and parts that repeat a key."""
    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE lineitem AS SELECT * FROM '{SF}/lineitem.parquet' WHERE l_orderkey < 300")
    con.execute("UPDATE lineitem SET l_partkey = 10000000 + l_partkey WHERE l_linenumber = 2")
    con.execute("UPDATE lineitem SET l_orderkey = NULL WHERE l_orderkey = 7")
    con.execute("UPDATE lineitem SET l_discount = NULL WHERE l_orderkey % 10 = 3 AND l_linenumber = 3")
    con.execute(f"CREATE TABLE part AS SELECT * FROM '{SF}/part.parquet' UNION ALL SELECT * FROM '{SF}/part.parquet' WHERE p_partkey = 5")
    con.execute(f"CREATE TABLE orders AS SELECT * FROM '{SF}/orders.parquet'")
    for name in ("lineitem", "part", "orders"):
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return con, str(folder)


@pytest.mark.parametrize("name", ["label_manifest", "yolo_label_lines", "first_scenes"])
def test_labels_of_odd_lines(spark, odd_lines, name):
    con, folder = odd_lines
    numbers = lambda rows: sorted(repr([plain(v) for v in r]) for r in rows)
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert numbers([r[c] for c in columns] for r in QUERIES[name](spark, folder).collect()) == numbers(want.fetchall())


def test_tight_rectangles_of_odd_vectors(spark, tmp_path):
    """No vector, some of its numbers, none that is a number, all alike, two points, a line."""
    rng = random.Random(3)
    drawn = lambda n: [rng.uniform(-1, 1) for _ in range(n)]
    line = [v for i in range(32) for v in (i / 32, i / 64)]
    odd = [None, [], [0.25] * 64, [None] * 64, [math.nan] * 64, [0.5] * 62 + [0.75, None], [0.0] * 32 + [0.5, 0.25] * 16, line]
    odd += [drawn(64), drawn(40), drawn(63), [None, *drawn(63)], [math.nan, *drawn(63)], [math.nan, None, *drawn(62)]]
    path = f"{tmp_path}/embeddings.parquet"
    pq.write_table(pa.table({"vec_id": range(len(odd)), "embedding": pa.array(odd, pa.list_(pa.float32()))}), path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
    want = con.execute(ORACLE_SQL["tight_rectangles"]).fetchall()
    assert sorted(repr(tuple(r)) for r in QUERIES["tight_rectangles"](spark, str(tmp_path)).collect()) == sorted(map(repr, want))
    assert len(want) == 9


@pytest.mark.parametrize("name", ["label_manifest", "yolo_label_lines"])
def test_only_numbers_of_cards_are_shuffled(spark, name):
    """One shuffle of cards by scene, before there are corners, hulls or boxes."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Window [row_number") :]
    assert below.count("hashpartitioning(l_orderkey") == 1 and "ArrowEvalPython" not in below and "COS(" not in below
    assert plan.count("hashpartitioning(scene") == (name == "yolo_label_lines")  # of finished lines


def test_zones_in_sight_are_those_of_the_polygons(spark):
    rng = random.Random(5)
    rows = [(i // 3, i % 3, "a", rng.choice([0.0, 90.0, -90.0, 180.0, rng.uniform(-180, 180)]), rng.choice([0.0, 0.5, 1.0, rng.uniform(0.1, 2)]), rng.choice([0.0, 0.1, rng.uniform(-1, 1)]), rng.choice([0.0, None, rng.uniform(-1, 1)])) for i in range(1500)]
    cards = spark.createDataFrame(rows, "scene int, z int, class string, angle double, scale double, tx double, ty double")
    w = Window.partitionBy("scene").orderBy("z")
    numbers = F.struct("angle", "scale", "tx", "ty")
    kept = lambda df: sorted(repr(r) for r in df.collect())
    want = kept(scenes.corner_labels(scenes.placed(cards)))
    assert kept(scenes.zone_labels(cards.withColumn("next", F.lead(numbers).over(w)))) == want and len(want) > 500
