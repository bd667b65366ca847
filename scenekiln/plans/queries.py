"""The registered queries of the scene operators, each beside the DuckDB SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenekiln.functions import geometry as g
from scenekiln.functions import text as t
from scenekiln.functions.hull import convex_hull, hull_by
from scenekiln.operators import members as m
from scenekiln.operators import ranking, sampling, scenes
from scenekiln.plans import rasters, shapes  # rasters registers queries of its own
from scenekiln.plans.registry import ORACLE_SQL, QUERIES, query
from scenekiln.plans.sql import LABELS, NAMES, PLACED, SHARED, regions, scenes_sql, shoelace, with_shapes
from scenekiln.session import materialize, table, united
from scenekiln.sources.shards import distinct_names

#: Ranks and suits of the deck.
RANKS, SUITS = ("A", "K", "Q", "J", "10", "9", "8", "7"), ("h", "d", "c", "s")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenes.zone_labels(shapes.placements(spark, sf_dir))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.dictionary(table(spark, sf_dir, "part").select(F.col("p_brand").alias("class")), "class")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# Scenes and labels

SIX = ", ".join(f"round({c}, 6) AS {c}" for c in ("cx", "cy", "w", "h"))


@query(scenes_sql(f"SELECT scene, z, corner, class, xmin, ymin, xmax, ymax, {SIX} FROM corner_labels"))
def label_manifest(spark, sf_dir):
    """The labels of all scenes: placed cards, occlusion, boxes, fractions."""
    return _rounded(_labels(spark, sf_dir).select("scene", "z", "corner", "class", "box.*", "yolo.*"))


@query(scenes_sql("SELECT scene, string_agg(printf('%d %.6f %.6f %.6f %.6f', id, cx, cy, w, h) || chr(10), '' ORDER BY z, corner) AS text FROM corner_labels JOIN names USING (class) GROUP BY scene"))
def yolo_label_lines(spark, sf_dir):
    """Label files of all scenes that have labels."""
    return scenes.label_files(_labels(spark, sf_dir), _names(spark, sf_dir))


@query(scenes_sql("SELECT class, count(*) AS labels, count(*) FILTER (id BETWEEN 0 AND 31 AND cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1 AND w > 0 AND w <= 1 AND h > 0 AND h <= 1) AS valid FROM corner_labels LEFT JOIN names USING (class) GROUP BY class"))
def label_validity_audit(spark, sf_dir):
    """Labels and valid labels by class."""
    return scenes.audited(_labels(spark, sf_dir), _names(spark, sf_dir)).groupBy("class").agg(F.count("*").alias("labels"), F.count_if("ok").alias("valid"))


@query(scenes_sql("SELECT bool_and(w > 0 AND h > 0) AS all_valid, bool_or(corner = 1) AS any_lower, count(DISTINCT class) AS classes, count(*) AS labels FROM corner_labels"))
def label_assertions(spark, sf_dir):
    """Whether all labels are valid and any is there, and how many classes were seen."""
    df = scenes.audited(_labels(spark, sf_dir), _names(spark, sf_dir))
    return df.agg(F.bool_and("ok").alias("all_valid"), F.bool_or(F.col("corner") == 1).alias("any_lower"), F.count_distinct("class").alias("classes"), F.count("*").alias("labels"))


@query(scenes_sql("SELECT class, count(*) AS n FROM corner_labels GROUP BY class"))
def class_histogram(spark, sf_dir):
    return _labels(spark, sf_dir).groupBy("class").agg(F.count("*").alias("n"))


@query(scenes_sql("SELECT o_orderkey AS scene, count(l.scene) AS labels FROM orders LEFT JOIN corner_labels l ON o_orderkey = l.scene GROUP BY 1"))
def labels_per_scene(spark, sf_dir):
    """Every scene, also those without labels."""
    counts = _labels(spark, sf_dir).groupBy("scene").agg(F.count("*").alias("labels"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene")).join(counts, "scene", "left").fillna(0, ["labels"])


@query(scenes_sql("SELECT scene, z, corner, class FROM corner_labels WHERE scene IN (SELECT DISTINCT scene FROM corner_labels ORDER BY scene LIMIT 4)"))
def first_scenes(spark, sf_dir):
    """Labels of the first four scenes that have any, as a preview shows them."""
    labels = _labels(spark, sf_dir)
    first = labels.select("scene").distinct().orderBy(F.asc_nulls_last("scene")).limit(4).collect()  # four rows
    return labels.filter(F.col("scene").isin([r.scene for r in first if r.scene is not None])).select("scene", "z", "corner", "class")


@query(scenes_sql("SELECT scene, string_agg(class, ',' ORDER BY z, corner) AS classes FROM corner_labels GROUP BY scene"))
def label_bags(spark, sf_dir):
    """The labels of a scene, appended in order."""
    bag = F.array_sort(F.collect_list(F.struct("z", "corner", "class")))
    return _labels(spark, sf_dir).groupBy("scene").agg(F.array_join(F.transform(bag, lambda s: s["class"]), ",").alias("classes"))


@query("WITH " + ",\n".join([with_shapes("placements"), PLACED]) + " SELECT scene, z, round(corners[1].x, 6) AS x0, round(corners[1].y, 6) AS y0, round(corners[3].x, 6) AS x2, round(corners[3].y, 6) AS y2, round(hull_hl[2].x, 6) AS hx, round(hull_lr[4].y, 6) AS ly FROM placed")
def affine_points(spark, sf_dir):
    """Corners and hulls under each card's turn, size and move."""
    df = scenes.placed(shapes.placements(spark, sf_dir))
    at = lambda c, i, k: F.col(c)[i][k]
    return _rounded(df.select("scene", "z", at("corners", 0, "x").alias("x0"), at("corners", 0, "y").alias("y0"), at("corners", 2, "x").alias("x2"), at("corners", 2, "y").alias("y2"), at("hull_hl", 1, "x").alias("hx"), at("hull_lr", 3, "y").alias("ly")))


@query("WITH " + ",\n".join([with_shapes("placements"), PLACED, SHARED]) + " SELECT scene, z, corner, round(inter, 4) AS inter FROM shared")
def intersection_area(spark, sf_dir):
    """Area that each corner hull shares with the card drawn next."""
    df = scenes.with_occluder(scenes.placed(shapes.placements(spark, sf_dir))).filter("occluder IS NOT NULL").select("scene", "z", "occluder", F.posexplode(F.array("hull_hl", "hull_lr")).alias("corner", "hull"))
    return df.select("scene", "z", "corner", F.round(g.intersection_area(F.col("hull"), F.col("occluder")), 4).alias("inter"))


@query("WITH " + ",\n".join([with_shapes("placements"), PLACED, SHARED]) + " SELECT scene, z, corner, free OR (area - inter) / area >= 0.9::DOUBLE AS kept FROM measured")
def occlusion_keep(spark, sf_dir):
    """Which corners stay visible."""
    df = scenes.with_occluder(scenes.placed(shapes.placements(spark, sf_dir))).select("scene", "z", "occluder", F.posexplode(F.array("hull_hl", "hull_lr")).alias("corner", "hull"))
    return df.select("scene", "z", "corner", g.kept_after_occlusion(F.col("hull"), F.col("occluder")).alias("kept"))


@query("WITH " + ",\n".join([with_shapes("placements"), PLACED, SHARED]) + " SELECT scene, z, corner, round((area - inter) / area, 6) + 0 AS visible FROM shared")
def visible_fraction(spark, sf_dir):
    """How much of each corner the card drawn next leaves in sight."""
    df = scenes.with_occluder(scenes.placed(shapes.placements(spark, sf_dir))).filter("occluder IS NOT NULL").select("scene", "z", "occluder", F.posexplode(F.array("hull_hl", "hull_lr")).alias("corner", "hull"))
    return df.select("scene", "z", "corner", (F.round(g.visible_fraction(F.col("hull"), F.col("occluder")), 6) + 0).alias("visible"))  # + 0: no negative zero


@query("WITH " + ",\n".join([with_shapes("placements"), PLACED]) + " SELECT scene, z, lead(z) OVER (PARTITION BY scene ORDER BY z) AS next_z FROM placed")
def next_card(spark, sf_dir):
    """The card drawn after each card."""
    return shapes.placements(spark, sf_dir).select("scene", "z", F.lead("z").over(Window.partitionBy("scene").orderBy("z")).alias("next_z"))


# Geometry

BOX_SQL = """SELECT vec_id, xmin, ymin, xmax, ymax FROM (
  SELECT vec_id, greatest(0, trunc(list_min([q.x FOR q IN points]) - 3)::INTEGER) AS xmin, greatest(0, trunc(list_min([q.y FOR q IN points]) - 3)::INTEGER) AS ymin,
    least(512, trunc(list_max([q.x FOR q IN points]) + 3)::INTEGER) AS xmax, least(512, trunc(list_max([q.y FOR q IN points]) + 3)::INTEGER) AS ymax FROM point_sets)
  WHERE xmin < xmax AND ymin < ymax"""


@query(f"WITH {with_shapes('point_sets')} {BOX_SQL}")
def points_to_bbox(spark, sf_dir):
    """Boxes of 32 points, cut at a canvas of 512."""
    df = shapes.point_sets(spark, sf_dir).withColumn("box", g.points_to_bbox(F.col("points"), F.lit(512), F.lit(512)))
    return df.filter("box IS NOT NULL").select("vec_id", "box.*")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_tax > 0 AND l_discount > 0 THEN round((l_quantity + l_quantity + l_discount) / 2 / 100, 6) END AS cx, CASE WHEN l_tax > 0 AND l_discount > 0 THEN round(l_tax / 80, 6) END AS h FROM lineitem")
def voc_to_yolo(spark, sf_dir):
    """Box fractions, null for boxes without extent."""
    x, y = F.col("l_quantity"), F.col("l_quantity") * 0
    yolo = g.voc_to_yolo(F.lit(100), F.lit(80), x, x + F.col("l_discount"), y, y + F.col("l_tax"), strict=False)
    df = table(spark, sf_dir, "lineitem").withColumn("yolo", yolo)
    return _rounded(df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "yolo.cx", "yolo.h")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice"), "cx", "h")


@query(f"WITH {with_shapes('point_sets')} SELECT vec_id, round(list_sum([q.x + 5 FOR q IN points]), 4) AS sx, round(list_sum([q.y - 7 FOR q IN points]), 4) AS sy FROM point_sets")
def hull_to_points(spark, sf_dir):
    """Moved points, by their sums."""
    moved = g.hull_to_points(F.col("points"), F.lit(5), F.lit(-7))
    total = lambda c: F.round(F.aggregate("moved", F.lit(0.0), lambda s, p: s + p[c]), 4)
    return shapes.point_sets(spark, sf_dir).withColumn("moved", moved).select("vec_id", total("x").alias("sx"), total("y").alias("sy"))


@query(f"WITH {with_shapes('point_sets')} SELECT vec_id, round(abs({shoelace('points')}), 4) AS area FROM point_sets")
def polygon_area(spark, sf_dir):
    """Absolute area of all points as a polygon."""
    return shapes.point_sets(spark, sf_dir).select("vec_id", F.round(g.polygon_area(g.polygon(F.col("points"))), 4).alias("area"))


@query(f"WITH {with_shapes('point_sets')}, own AS (SELECT vec_id, 0 AS of, points AS p FROM point_sets), {regions('own')} SELECT vec_id, round(area, 4) AS area FROM regions")
def safe_polygon(spark, sf_dir):
    """Areas of all points as polygons, repaired where their edges cross."""
    return _spread(shapes.point_sets(spark, sf_dir)).select("vec_id", F.round(g.safe_area(F.col("points")), 4).alias("area"))


def _spread(df: DataFrame) -> DataFrame:
    """Few narrow rows that take long each, over all cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, "vec_id")


def _star(points: Column, first: int) -> Column:
    """Twelve points as a polygon whose edges do not cross: in the order of their angles around their mean."""
    own = F.slice(points, first, 12)
    mean = lambda ps, c: F.aggregate(ps, F.lit(0.0), lambda s, p: s + p[c]) / 12
    turned = lambda ps, m: F.array_sort(F.transform(ps, lambda p: F.struct(F.atan2(p["y"] - m["y"], p["x"] - m["x"]).alias("a"), p["x"].alias("x"), p["y"].alias("y"))))
    sorted_ = g.let(own, lambda ps: g.let(F.struct(mean(ps, "x").alias("x"), mean(ps, "y").alias("y")), lambda m: turned(ps, m)))
    return F.transform(sorted_, lambda s: g.point(s["x"], s["y"]))


def _star_sql(of: int, first: int) -> str:
    turned = f"list_sort([{{'a': atan2(q.y - my, q.x - mx), 'x': q.x, 'y': q.y}} FOR q IN own])"
    return f"SELECT vec_id, {of} AS of, {turned} AS p FROM (SELECT vec_id, own, list_sum([q.x FOR q IN own]) / 12 AS mx, list_sum([q.y FOR q IN own]) / 12 AS my FROM (SELECT vec_id, points[{first}:{first + 11}] AS own FROM point_sets))"


@query(f"WITH {with_shapes('point_sets')}, own AS ({_star_sql(0, 1)} UNION ALL {_star_sql(1, 13)}), {regions('own')} SELECT vec_id, round(area, 4) AS shared FROM regions")
def shared_polygons(spark, sf_dir):
    """Area that two polygons of twelve points share, which are not convex."""
    df = _spread(shapes.point_sets(spark, sf_dir)).select("vec_id", _star(F.col("points"), 1).alias("a"), _star(F.col("points"), 13).alias("b"))
    return df.select("vec_id", F.round(g.intersection_area(F.col("a"), F.col("b")), 4).alias("shared"))


CROSS = "(points[i].x * points[i % 32 + 1].y - points[i % 32 + 1].x * points[i].y)"


def _centre(c: str) -> str:
    return f"round(list_sum([(points[i].{c} + points[i % 32 + 1].{c}) * {CROSS} FOR i IN range(1, 33)]) / (6 * {shoelace('points')}), 3) AS c{c}"


@query(f"WITH {with_shapes('point_sets')} SELECT vec_id, {_centre('x')}, {_centre('y')} FROM point_sets")
def polygon_centroid(spark, sf_dir):
    """Centres of gravity of all points as polygons."""
    df = shapes.point_sets(spark, sf_dir).select("vec_id", g.centroid(F.col("points")).alias("c"))
    return df.select("vec_id", F.round("c.x", 3).alias("cx"), F.round("c.y", 3).alias("cy"))


@query(f"""WITH {with_shapes('point_sets')}, p AS (SELECT vec_id, unnest(points) AS q FROM point_sets), n AS (SELECT DISTINCT vec_id, q.x AS x, q.y AS y FROM p),
e AS (SELECT a.vec_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM n a JOIN n b ON a.vec_id = b.vec_id AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (FROM n c WHERE c.vec_id = a.vec_id AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0 AND (c.x <> b.x OR c.y <> b.y)))
SELECT vec_id, count(*) AS corners, round(sum(ax * b_y - bx * ay) / 2, 3) AS area FROM e GROUP BY vec_id""")
def convex_hulls(spark, sf_dir):
    """Corner counts and areas of the hulls of 32 points."""
    df = shapes.point_sets(spark, sf_dir).withColumn("hull", convex_hull("points"))
    return df.select("vec_id", F.size("hull").cast("long").alias("corners"), F.round(g.polygon_area(F.col("hull")), 3).alias("area"))


HULL_EDGES = """{0} AS (SELECT a.{1} AS id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM {2} a JOIN {2} b ON a.{1} = b.{1} AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (FROM {2} c WHERE c.{1} = a.{1} AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0 AND (c.x <> b.x OR c.y <> b.y)))"""


@query(f"""WITH points AS (SELECT event_type AS zone, event_id % 50 AS x, value AS y FROM events WHERE value IS NOT NULL),
ends AS (SELECT zone, x, min(y) AS y FROM points GROUP BY zone, x UNION SELECT zone, x, max(y) FROM points GROUP BY zone, x),
{HULL_EDGES.format('e', 'zone', 'ends')} SELECT id AS zone, round(sum(ax * b_y - bx * ay) / 2, 3) AS area, round(min(ay), 6) AS lowest, round(max(ay), 6) AS highest FROM e GROUP BY id""")
def zone_hulls(spark, sf_dir):
    """Hulls of all points of a zone, however many rows it has, merged from hulls of batches."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("zone"), (F.col("event_id") % 50).alias("x"), F.col("value").alias("y"))
    hulls = hull_by(events, ["zone"], F.col("x"), F.col("y"))
    ys = F.transform("hull", lambda p: p["y"])
    return hulls.select("zone", F.round(g.polygon_area(F.col("hull")), 3).alias("area"), F.round(F.array_min(ys), 6).alias("lowest"), F.round(F.array_max(ys), 6).alias("highest"))


@query(f"""WITH {with_shapes('point_sets')}, n AS (SELECT DISTINCT vec_id, q.x AS x, q.y AS y FROM (SELECT vec_id, unnest(points) AS q FROM point_sets)),
{HULL_EDGES.format('e', 'vec_id', 'n')},
u AS (SELECT id, (bx - ax) / d AS ux, (b_y - ay) / d AS uy FROM (SELECT *, sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) AS d FROM e)),
r AS (SELECT id, ux, uy, max(x * ux + y * uy) - min(x * ux + y * uy) AS w, max(y * ux - x * uy) - min(y * ux - x * uy) AS h FROM u JOIN n ON id = vec_id GROUP BY id, ux, uy)
SELECT id AS vec_id, round(min(w * h), 3) AS area, round(arg_min(w + h, w * h), 4) AS sides FROM r GROUP BY id""")
def tight_rectangles(spark, sf_dir):
    """The smallest rectangles around 32 points, of which those without both numbers take no part; no row where all are alike."""
    spread = lambda ps, c: F.array_min(ps[c]) < F.array_max(ps[c])
    df = shapes.point_sets(spark, sf_dir).filter(g.let(F.col("points"), lambda ps: spread(ps, "x") | spread(ps, "y")))
    df = df.withColumn("points", F.array_distinct(F.filter("points", lambda p: p["x"].isNotNull() & p["y"].isNotNull())))
    none = F.exists("points", lambda p: F.isnan(p["x"]) | F.isnan(p["y"]))  # such sets have no hull, and sides of NaN
    df = df.withColumn("hull", F.when(none, F.col("points")).otherwise(convex_hull("points"))).select("vec_id", g.tight_rectangle(F.col("hull")).alias("r"))
    return df.select("vec_id", F.round("r.area", 3).alias("area"), F.round(F.col("r.width") + F.col("r.height"), 4).alias("sides"))


@query("SELECT p_partkey, (greatest(348, p_size * 20) - 228) // 2 AS dx, (greatest(348, p_size * 20) - 348) // 2 AS dy FROM part")
def card_offsets(spark, sf_dir):
    """Where a card lies on placement canvases of many sizes."""
    place = F.greatest(F.lit(g.CARD_HEIGHT), F.col("p_size") * 20)
    return table(spark, sf_dir, "part").select("p_partkey", F.floor((place - g.CARD_WIDTH) / 2).cast("int").alias("dx"), F.floor((place - g.CARD_HEIGHT) / 2).cast("int").alias("dy"))


def _zone_rows(name: str, points) -> str:
    return ", ".join(f"('{name}', {i}, {float(x)}::DOUBLE, {float(y)}::DOUBLE)" for i, (x, y) in enumerate(points))


@query(f"SELECT * FROM (VALUES {_zone_rows('hl', g.CORNER_HL)}, {_zone_rows('lr', g.CORNER_LR)}) v(corner, i, x, y)")
def placeholder_hulls(spark, sf_dir):
    """The corner zones that stand for hulls that were not looked for."""
    df = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(n).alias("corner"), g.quad(q).alias("q")) for n, q in (("hl", g.CORNER_HL), ("lr", g.CORNER_LR))])).alias("s"))
    return df.select("s.corner", F.posexplode("s.q").alias("i", "p")).select("corner", "i", "p.*")


# Contours and gates

IN_CENTRE = "abs(34 / 2.0::DOUBLE - cx) < 34 * 0.3::DOUBLE AND abs(82 / 2.0::DOUBLE - cy) < 82 * 0.4::DOUBLE"


def _gated(spark, sf_dir) -> DataFrame:
    zone_w, zone_h = (F.lit(float(b - a)) for a, b in (g.ZONE_X, g.ZONE_Y))
    df = shapes.contours(spark, sf_dir).withColumn("solidity", g.solidity(F.col("area"), F.col("hull_area")))
    return df.filter((F.col("area") >= g.MIN_CONTOUR_AREA) & (F.col("solidity") > g.MIN_SOLIDITY) & g.centre_ok(zone_w, zone_h, F.col("cx"), F.col("cy")))


@query(f"WITH {with_shapes('contours')} SELECT zone, ord, round(area / hull_area, 6) AS solidity FROM contours WHERE area >= 30 AND hull_area > 0 AND area / hull_area > 0.3::DOUBLE AND {IN_CENTRE}")
def contour_filters(spark, sf_dir):
    """Contours that are large, solid and central enough."""
    return _rounded(_gated(spark, sf_dir).select("zone", "ord", "solidity"))


@query(f"WITH {with_shapes('contours')} SELECT zone, string_agg(ord::VARCHAR, ',' ORDER BY ord) AS merged FROM contours WHERE area >= 30 AND area / hull_area > 0.3::DOUBLE AND {IN_CENTRE} GROUP BY zone")
def merged_contours(spark, sf_dir):
    """What is left of a zone's contours, put together in their order; zones without any are not there."""
    return _gated(spark, sf_dir).groupBy("zone").agg(F.array_join(F.transform(F.array_sort(F.collect_list("ord")), lambda o: o.cast("string")), ",").alias("merged"))


@query(f"WITH {with_shapes('contours')} SELECT zone, ord, area FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY area DESC, ord) AS r FROM contours) WHERE r = 1")
def top_contour(spark, sf_dir):
    """The largest contour, the first on ties."""
    w = Window.partitionBy("zone").orderBy(F.desc("area"), "ord")
    return shapes.contours(spark, sf_dir).withColumn("r", F.row_number().over(w)).filter("r = 1").select("zone", "ord", "area")


@query("SELECT p_partkey, p_retailprice BETWEEN 940 AND 2120 AS ok FROM part")
def hull_plausible(spark, sf_dir):
    """Whether a hull's area is that of a symbol."""
    return table(spark, sf_dir, "part").select("p_partkey", g.hull_plausible(F.col("p_retailprice")).alias("ok"))


@query("SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN least(1.0::DOUBLE, 5000 / c_acctbal) END, 6) AS rectangularity FROM customer WHERE c_acctbal > 0 AND least(1.0::DOUBLE, 5000 / c_acctbal) >= 0.95::DOUBLE")
def rectangularity_gate(spark, sf_dir):
    """Rectangularity, one at most, where it passes."""
    df = table(spark, sf_dir, "customer").select("c_custkey", g.rectangularity(F.lit(5000.0), F.col("c_acctbal")).alias("rectangularity"))
    return _rounded(df.filter(F.col("rectangularity") >= g.MIN_RECTANGULARITY))


@query("SELECT s_suppkey, CASE WHEN s_nationkey > s_suppkey % 25 THEN 'upright' ELSE 'turned' END AS quad FROM supplier")
def orientation_choice(spark, sf_dir):
    """Which reference quad a rectangle takes; equal sides are turned."""
    wide = g.lies_wide(F.col("s_nationkey"), F.col("s_suppkey") % 25)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(wide, "upright").otherwise("turned").alias("quad"))


# Pixels of small grids


def _near(i: str, d: int, size: int) -> str:
    v = f"({i} + {d})"
    return f"CASE WHEN {v} < 0 THEN -{v} WHEN {v} >= {size} THEN {2 * size - 2} - {v} ELSE {v} END"


_R, _C = "(i // 8)", "(i % 8)"
FOCUS = f"""focus AS (
  SELECT vec_id, [(grid[({_near(_R, -1, 8)}) * 8 + {_C} + 1] + grid[({_near(_R, 1, 8)}) * 8 + {_C} + 1] + grid[{_R} * 8 + ({_near(_C, -1, 8)}) + 1] + grid[{_R} * 8 + ({_near(_C, 1, 8)}) + 1] - 4 * grid[i + 1])::DOUBLE FOR i IN range(0, 64)] AS v FROM grids),
scored AS (SELECT vec_id, round(list_sum([x * x FOR x IN v]) / 64 - power(list_sum(v) / 64, 2), 6) AS focus FROM focus)"""


@query(f"WITH {with_shapes('grids')}, {FOCUS} SELECT vec_id, focus FROM scored")
def laplacian_focus(spark, sf_dir):
    """Focus of every grid."""
    return shapes.grids(spark, sf_dir).select("vec_id", F.round(scenes.laplacian_variance(F.col("grid"), 8, 8), 6).alias("focus"))


@query(f"WITH {with_shapes('grids')}, {FOCUS} SELECT vec_id, focus FROM scored WHERE focus >= 1000")
def focus_filter(spark, sf_dir):
    """Grids that are sharp enough; the bound passes."""
    return laplacian_focus(spark, sf_dir).filter(F.col("focus") >= 1000)


@query(f"""WITH {with_shapes('grids')}, pixels AS (SELECT vec_id, vec_id // 3 AS scene, unnest(range(1, 65)) AS i, unnest(grid)::DOUBLE AS v FROM grids),
mixed AS (
  SELECT scene, i, list_reduce(list(v ORDER BY vec_id), lambda base, over: least(255, greatest(0, trunc(over * ((255 - i * 3) / 255.0::DOUBLE) + base * (1 - (255 - i * 3) / 255.0::DOUBLE))))) AS v
  FROM pixels GROUP BY scene, i)
SELECT scene, sum(v)::BIGINT AS total FROM mixed GROUP BY scene""")
def alpha_composite_grid(spark, sf_dir):
    """All grids of a scene, laid over its first in their order with a sloping alpha; sums of the pixels."""
    alpha = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: 255 - i * 3)
    layers = F.array_sort(F.collect_list(F.struct("vec_id", "grid")))  # three at most, as scenes are threes of ids
    df = shapes.grids(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 3).alias("scene")).agg(F.transform(layers, lambda s: s["grid"]).alias("layers"))
    mixed = F.aggregate(F.slice("layers", 2, F.size("layers")), F.get("layers", F.lit(0)), lambda base, over: scenes.composited(base, over, alpha))
    return df.select("scene", F.aggregate(mixed, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


# Files, members and shards

WALK = "lower(regexp_extract(path, '[^/]\\.([^./]*)$', 1)) IN ('bmp', 'jpeg', 'jpg', 'png', 'webp')"


@query(f"WITH {with_shapes('walked')} SELECT doc_id, path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS index FROM walked WHERE {WALK}")
def image_walk(spark, sf_dir):
    """Images in the order of their path parts."""
    df = shapes.walked_files(spark, sf_dir).filter(t.is_image(F.col("path")))
    return ranking.ranked(df, [F.split("path", "/")]).select("doc_id", "path", "index")


@query(f"WITH {with_shapes('walked')} SELECT string_split(path, '/')[1] AS class, count(*) AS images FROM walked WHERE {WALK} GROUP BY 1")
def class_scan(spark, sf_dir):
    """Images by class folder."""
    df = shapes.walked_files(spark, sf_dir).filter(t.is_image(F.col("path")) & F.contains("path", F.lit("/")))
    return df.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("class")).agg(F.count("*").alias("images"))


@query(f"""WITH {with_shapes('walked')}, w AS (SELECT *, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS i FROM walked WHERE {WALK}),
r AS (SELECT *, row_number() OVER (ORDER BY i) - 1 AS k FROM w WHERE decodes)
SELECT doc_id, printf('%08d', i) AS key, printf('backgrounds-%04d', k // 64) AS shard, k % 64 AS slot FROM r""")
def shard_assignment_gapped(spark, sf_dir):
    """Background shards of 64: keys count walked files, so those that do not decode leave gaps."""
    df = shapes.walked_files(spark, sf_dir).filter(t.is_image(F.col("path")))
    df = ranking.shard_slots(ranking.ranked(df, [F.split("path", "/")], F.col("decodes")), 64).filter("rank IS NOT NULL")
    return df.select("doc_id", t.padded(F.col("index"), 8).alias("key"), F.concat(F.lit("backgrounds-"), t.padded(F.col("shard"), 4)).alias("shard"), "slot")


@query(f"WITH {with_shapes('walked')} SELECT doc_id, substr(path, strpos(path, '.') + 1) AS ext FROM walked WHERE strpos(path, '.') > 0 AND substr(path, strpos(path, '.') + 1) IN ('jpeg', 'jpg', 'png', 'webp')")
def reader_images(spark, sf_dir):
    """Members that the reader takes for images: by their whole ext, case and all."""
    df = shapes.walked_files(spark, sf_dir).select("doc_id", t.member_ext(F.col("path")).alias("ext"))
    return df.filter(F.col("ext").isin(*t.READ))


@query("SELECT p_partkey FROM part WHERE p_retailprice BETWEEN 940 AND 2120 AND p_retailprice + p_size * 20 BETWEEN 940 AND 2120")
def packable_cards(spark, sf_dir):
    """Cards of which both corner hulls are there and plausible; others are not packed."""
    areas = F.col("p_retailprice"), F.col("p_retailprice") + F.col("p_size") * 20
    return table(spark, sf_dir, "part").filter(g.hull_plausible(areas[0]) & g.hull_plausible(areas[1])).select("p_partkey")


@query("WITH r AS (SELECT *, row_number() OVER (ORDER BY p_brand, p_partkey) - 1 AS k FROM part WHERE p_size > 5) SELECT p_partkey, printf('%08d', k) AS key, printf('cards-%04d', k // 512) AS shard, k % 512 AS slot FROM r")
def shard_assignment_dense(spark, sf_dir):
    """Card shards of 512: keys count written cards."""
    df = table(spark, sf_dir, "part").filter("p_size > 5").select("p_partkey", "p_brand")
    df = ranking.shard_slots(ranking.ranked(df, [F.col("p_brand"), F.col("p_partkey")]), 512)
    return df.select("p_partkey", t.padded(F.col("rank") - 1, 8).alias("key"), F.concat(F.lit("cards-"), t.padded(F.col("shard"), 4)).alias("shard"), "slot")


@query("""WITH c AS (SELECT *, (lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1)::INTEGER AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS run FROM c)
SELECT user_id AS shard, run::BIGINT AS run, event_type AS key, count(*) AS members, arg_max(value, (ts, event_id)) AS last FROM r GROUP BY ALL""")
def run_grouping(spark, sf_dir):
    """Samples are runs of members with one key; the last payload counts."""
    df = m.runs(shapes.event_members(spark, sf_dir), ["shard"], ["ts", "event_id"])
    return df.groupBy("shard", "run", "key").agg(F.count("*").alias("members"), F.max_by("payload", F.struct("ts", "event_id")).alias("last"))


@query("SELECT conv_id AS key, " + ", ".join(f"arg_max(text, turn) FILTER (role = '{r}') AS {r}" for r in ("system", "user", "assistant")) + " FROM conversations GROUP BY conv_id")
def ext_pivot(spark, sf_dir):
    """A column for each ext: its last payload."""
    return m.samples(shapes.chat_members(spark, sf_dir), ["system", "user", "assistant"], ["key"])


@query("SELECT conv_id AS key, arg_min(text, turn) AS payload FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def first_member(spark, sf_dir):
    """The first admissible member of each sample; samples without one go."""
    df = shapes.chat_members(spark, sf_dir).filter(F.col("ext").isin("user", "assistant"))
    return df.groupBy("key").agg(F.min_by("payload", "ord").alias("payload"))


@query(f"WITH {with_shapes('part_members')} SELECT trim(payload, ' ' || chr(9) || chr(10)) AS name, shard, key FROM part_members WHERE ext = 'cls'")
def class_index(spark, sf_dir):
    """Where each class's samples are."""
    return m.class_index(shapes.part_members(spark, sf_dir))


@query("SELECT p_brand AS name, count(*) AS n, arg_min(printf('%08d', p_partkey), (p_size, p_partkey)) AS first FROM part GROUP BY 1")
def grouped_class_index(spark, sf_dir):
    """Entries by class, in order."""
    paged = m.PagedIndex(m.class_index(shapes.part_members(spark, sf_dir)))
    first = paged.pages.filter("page = 0").select("name", F.col("entries")[0]["key"].alias("first"))
    return paged.directory.select("name", "n").join(first, "name")


@query("SELECT p_brand AS name, p_size AS shard, printf('%08d', p_partkey) AS key, p_name AS png, p_type AS hull_hl FROM part")
def sample_lookup(spark, sf_dir):
    """Samples joined from their members."""
    members = shapes.part_members(spark, sf_dir)
    return m.load_samples(m.class_index(members), members, ["png", "hull_hl.npy", "hull_lr.npy"]).select("name", "shard", "key", "png", F.col("`hull_hl.npy`").alias("hull_hl"))


@query("""WITH c AS (SELECT *, (lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1)::INTEGER AS new FROM events WINDOW w AS (ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (ORDER BY ts, event_id) - 1 AS run FROM c) SELECT run::BIGINT AS run, event_type AS key, count(*) AS members FROM r GROUP BY ALL""")
def giant_run_grouping(spark, sf_dir):
    """Runs where one shard has all members: numbered in many tasks."""
    df = m.runs(shapes.event_members(spark, sf_dir).withColumn("shard", F.lit("all")), ["shard"], ["ts", "event_id"])
    return df.groupBy("run", "key").agg(F.count("*").alias("members"))


@query("""WITH e AS (SELECT p_brand, p_size, printf('%08d', p_partkey) AS key, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, printf('%08d', p_partkey)) - 1 AS e, count(*) OVER (PARTITION BY p_brand) AS c FROM part),
b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS r, count(*) OVER () AS k FROM (SELECT DISTINCT p_brand FROM part)),
draws AS (SELECT o_orderkey AS draw, (o_orderkey * 7919) % (SELECT max(k) FROM b) AS r FROM orders)
SELECT draw, e.p_brand AS name, p_size AS shard, key FROM draws JOIN b USING (r) JOIN e ON e.p_brand = b.p_brand AND e = (draw * 104729) % c""")
def paged_draws(spark, sf_dir):
    """A class, then one of its entries, from the pages of the class index that a given plan asks for."""
    paged = m.PagedIndex(m.class_index(shapes.part_members(spark, sf_dir)))
    classes = paged.directory.count()
    draws = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("draw"), (F.col("o_orderkey") * 7919 % classes).cast("int").alias("class_rank"))
    draws = draws.join(paged.directory.select("class_rank", "n"), "class_rank").select("draw", "class_rank", (F.col("draw") * 104729 % F.col("n")).alias("entry"))
    return paged.drawn(draws).select("draw", "name", "shard", "key")


@query("SELECT name, shard, key FROM (SELECT p_brand AS name, p_size AS shard, printf('%08d', p_partkey) AS key, row_number() OVER (PARTITION BY p_brand ORDER BY md5(concat_ws(':', 42, 'sample', p_size, printf('%08d', p_partkey)))) AS r FROM part) WHERE r <= 3")
def keyed_class_sample(spark, sf_dir):
    """Three entries of each class, drawn by hash in one scan."""
    return sampling.keyed_sample(m.class_index(shapes.part_members(spark, sf_dir)), 42, 3, ["shard", "key"], ["name"]).select("name", "shard", "key")


@query(f"WITH {with_shapes('walked')} SELECT doc_id, path FROM walked WHERE decodes AND {WALK} ORDER BY md5(concat_ws(':', 7, 'sample', path)) LIMIT 20")
def background_draws(spark, sf_dir):
    """Twenty backgrounds of all walked files that decode, drawn by hash in one scan."""
    df = shapes.walked_files(spark, sf_dir).filter(t.is_image(F.col("path")) & F.col("decodes"))
    return sampling.keyed_sample(df.select("doc_id", "path"), 7, 20, ["path"])


@query("SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1")
def counts_by_class(spark, sf_dir):
    return m.class_index(shapes.part_members(spark, sf_dir)).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS cards, count(DISTINCT p_brand) AS classes FROM part")
def deck_totals(spark, sf_dir):
    return m.class_index(shapes.part_members(spark, sf_dir)).agg(F.count("*").alias("cards"), F.count_distinct("name").alias("classes"))


@query(f"WITH {NAMES} SELECT class, id FROM names")
def class_ids(spark, sf_dir):
    """Ids from 0 of the classes present, by code point."""
    return _names(spark, sf_dir)


@query(f"WITH {NAMES} SELECT string_agg(class || chr(10), '' ORDER BY id) AS text FROM names")
def classes_file(spark, sf_dir):
    """The text of classes.txt: the names in the order of their ids, one a line."""
    return ranking.listed(_names(spark, sf_dir), "class")


@query("SELECT DISTINCT p_brand AS name FROM part")
def class_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()


DECK_SQL = f"SELECT r || s AS name FROM (SELECT unnest({list(RANKS)}) AS r), (SELECT unnest({list(SUITS)}) AS s)"


@query(DECK_SQL)
def expected_deck(spark, sf_dir):
    """Ranks times suits: 32 names."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, RANKS))).alias("r")).select("r", F.explode(F.array(*map(F.lit, SUITS))).alias("s")).select(shapes.deck(F.col("r"), F.col("s")).alias("name"))


@query(f"""WITH deck AS ({DECK_SQL}), found AS (SELECT DISTINCT {list(RANKS)}[p_size % 8 + 1] || CASE WHEN p_size % 5 = 0 THEN 'x' ELSE 'h' END AS name FROM part)
SELECT 'unexpected' AS side, name FROM (SELECT name FROM found EXCEPT SELECT name FROM deck) UNION ALL SELECT 'missing', name FROM (SELECT name FROM deck EXCEPT SELECT name FROM found)""")
def deck_diff(spark, sf_dir):
    """Names that should not be there, and names that are not."""
    found = table(spark, sf_dir, "part").select(F.concat(F.element_at(F.array(*map(F.lit, RANKS)), F.col("p_size") % 8 + 1), F.when(F.col("p_size") % 5 == 0, "x").otherwise("h")).alias("name"))
    deck = expected_deck(spark, sf_dir)
    return united(found.subtract(deck).select(F.lit("unexpected").alias("side"), "name"), deck.subtract(found).select(F.lit("missing"), "name"))


@query("SELECT p_partkey, printf('%04d', p_partkey) AS four, printf('%08d', p_partkey) AS eight, printf('scene_%06d', p_partkey * 1000) AS scene FROM part")
def key_format(spark, sf_dir):
    """Padded names, never cut."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", t.padded(k, 4).alias("four"), t.padded(k, 8).alias("eight"), F.concat(F.lit("scene_"), t.padded(k * 1000, 6)).alias("scene"))


@query(f"WITH {with_shapes('walked')} SELECT doc_id, string_split(path, '.')[1] AS key, CASE WHEN strpos(path, '.') > 0 THEN substr(path, strpos(path, '.') + 1) END AS ext FROM walked WHERE strpos(path, '.') > 0")
def key_ext_split(spark, sf_dir):
    """Keys and exts at the first dot; names without one are no members."""
    df = shapes.walked_files(spark, sf_dir).select("doc_id", t.member_key(F.col("path")).alias("key"), t.member_ext(F.col("path")).alias("ext"))
    return df.filter("ext IS NOT NULL")


#: Code points of white space.
WHITE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


@query(f"SELECT DISTINCT name FROM (SELECT trim(unnest(string_split(text, chr(10))), {' || '.join(f'chr({c})' for c in WHITE)}) AS name FROM documents) WHERE name <> ''")
def name_list(spark, sf_dir):
    """Lines of all texts as a list of names: stripped, without blanks, distinct."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return distinct_names(lines, F.col("line"))


@query("""WITH n AS (SELECT p_brand, p_partkey, count(*) OVER (PARTITION BY p_brand) AS c, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS e FROM part),
b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS r, count(*) OVER () AS k FROM (SELECT DISTINCT p_brand FROM part)),
draws AS (SELECT o_orderkey AS draw, (o_orderkey * 7919) % (SELECT max(k) FROM b) AS r FROM orders)
SELECT draw, n.p_brand AS name, p_partkey FROM draws JOIN b USING (r) JOIN n ON n.p_brand = b.p_brand AND e = (draw * 104729) % c""")
def balanced_sample(spark, sf_dir):
    """A class, then one of its entries, for each draw of a given plan."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.lit(0).alias("shard"), F.col("p_partkey").alias("key"))
    index = sampling.numbered_index(part)
    sizes = part.groupBy("name").agg(F.count("*").alias("c"))
    ranks = index.select("name", "class_rank").distinct().join(sizes, "name")
    classes = part.select("name").distinct().count()
    draws = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("draw"), (F.col("o_orderkey") * 7919 % classes).cast("int").alias("class_rank"))
    draws = draws.join(ranks.select("class_rank", "c"), "class_rank").withColumn("entry", F.col("draw") * 104729 % F.col("c"))
    return draws.join(index, ["class_rank", "entry"]).select("draw", "name", F.col("key").alias("p_partkey"))


@query()
def scene_plan(spark, sf_dir):
    """A hundred scenes of three cards drawn from the deck of parts, seed 42."""
    index = m.class_index(shapes.part_members(spark, sf_dir))
    sizes = [r.n for r in index.groupBy("name").agg(F.count("*").alias("n")).orderBy("name").collect()]  # one row a class
    plan = sampling.scene_plan(spark, 42, 100, 3, sizes, 64)
    return sampling.drawn_cards(plan, index).select("scene", "z", "background", "name", "shard", "key", "angle", "scale", "tx", "ty")


@query()
def planned_labels(spark, sf_dir):
    """Labels of the planned scenes."""
    cards = scene_plan(spark, sf_dir).withColumnRenamed("name", "class")
    return _rounded(scenes.corner_labels(scenes.placed(cards)).select("scene", "z", "corner", "class", "box.*", "yolo.*"))



#: Scenes, cards a scene and backgrounds of the hashed plan, and its seed.
PLAN_SCENES, PLAN_CARDS, PLAN_GROUNDS, PLAN_SEED = 10_000, 3, 64, 42


def _draw(seed: int, stream: str, *keys: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join([str(seed), repr(stream), *keys])})), 1, 13))::BIGINT::DOUBLE / 4503599627370496"


def _moved(stream: str, low: float, high: float) -> str:
    return f"{low!r}::DOUBLE + {high - low!r}::DOUBLE * ({_draw(PLAN_SEED, stream, 'scene', 'z')}) AS {stream}"


_AUG = sampling.AugmentRange()
PLANNED = f"""deck AS (SELECT p_brand AS name, count(*) AS n, row_number() OVER (ORDER BY p_brand) - 1 AS class_rank FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand),
entries AS (SELECT p_brand AS name, p_size AS shard, printf('%08d', p_partkey) AS key, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, printf('%08d', p_partkey)) - 1 AS entry FROM part),
asked AS (SELECT scene, z, floor(({_draw(PLAN_SEED + 2, 'class', 'scene', 'z')}) * (SELECT count(*) FROM deck))::INTEGER AS class_rank FROM range({PLAN_SCENES}) s(scene), range({PLAN_CARDS}) c(z)),
planned AS (
  SELECT scene, z::INTEGER AS z, floor(({_draw(PLAN_SEED + 1, 'background', 'scene')}) * {PLAN_GROUNDS})::BIGINT AS background, e.name, e.shard, e.key,
    {_moved('angle', *_AUG.rotation_deg)}, {_moved('scale', *_AUG.scale)}, {_moved('tx', *_AUG.translate_frac)}, {_moved('ty', *_AUG.translate_frac)}
  FROM asked JOIN deck d USING (class_rank) JOIN entries e ON e.name = d.name AND e.entry = floor(({_draw(PLAN_SEED + 2, 'entry', 'scene', 'z')}) * d.n)::BIGINT)"""
PLAN_LABELS = ",\n".join([PLANNED, "placements AS (SELECT scene, z, name AS class, angle, scale, tx, ty FROM planned)", PLACED, SHARED, LABELS])


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = materialize(m.class_index(shapes.part_members(spark, sf_dir)), "class-index")
    return sampling.drawn_cards(sampling.hashed_plan(spark, PLAN_SEED, PLAN_SCENES, PLAN_CARDS, index, PLAN_GROUNDS), index)


@query(f"WITH {PLANNED} SELECT * FROM planned")
def hashed_plan(spark, sf_dir):
    """Ten thousand scenes of three cards, each draw a hash of its place: no row of the plan is on the driver."""
    return _hashed(spark, sf_dir).select("scene", "z", "background", "name", "shard", "key", "angle", "scale", "tx", "ty")


@query(f"WITH {PLAN_LABELS} SELECT scene, z, corner, class, xmin, ymin, xmax, ymax, {SIX} FROM labels")
def hashed_labels(spark, sf_dir):
    """Labels of the scenes of `hashed_plan`."""
    cards = _hashed(spark, sf_dir).withColumnRenamed("name", "class")
    return _rounded(scenes.corner_labels(scenes.placed(cards)).select("scene", "z", "corner", "class", "box.*", "yolo.*"))


__all__ = ["ORACLE_SQL", "QUERIES", "rasters"]
