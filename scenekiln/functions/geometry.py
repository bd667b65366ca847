"""Plane geometry of card scenes as Column expressions.

Points are structs (x, y) of doubles, polygons and hulls arrays of points, boxes structs of ints. Everything here is a
built-in expression, so it runs beside its row: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sizes in pixels of the canonical card, of a corner's symbol zone, and of the default scene.
CARD_WIDTH, CARD_HEIGHT = 228, 348
ZONE_X, ZONE_Y = (8, 42), (10, 92)
SCENE_SIZE = 720
#: The gates of extraction, corner hulls, occlusion and boxes.
MIN_FOCUS, MIN_RECTANGULARITY = 120.0, 0.95
MIN_CONTOUR_AREA, MIN_SOLIDITY = 30.0, 0.3
HULL_AREA = (940.0, 2120.0)
CENTRE_TOLERANCE = (0.3, 0.4)
MAX_HIDDEN, BOX_MARGIN = 0.1, 3

POINTS = "array<struct<x:double,y:double>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def rectangle(x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, float]]:
    """Clockwise on screen from the top left."""
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


CARD_QUAD = rectangle(0, 0, CARD_WIDTH, CARD_HEIGHT)
CORNER_HL = rectangle(ZONE_X[0], ZONE_Y[0], ZONE_X[1], ZONE_Y[1])
CORNER_LR = rectangle(CARD_WIDTH - ZONE_X[1], CARD_HEIGHT - ZONE_Y[1], CARD_WIDTH - ZONE_X[0], CARD_HEIGHT - ZONE_Y[0])


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def quad(points: list[tuple[float, float]], dx: Column | float = 0, dy: Column | float = 0) -> Column:
    """A literal polygon, moved."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.array(*[point(F.lit(float(x)) + as_col(dx), F.lit(float(y)) + as_col(dy)) for x, y in points])


def hull_to_points(hull: Column, dx: Column, dy: Column) -> Column:
    return F.transform(hull, lambda p: point(p["x"] + dx, p["y"] + dy))


def polygon(points: Column) -> Column:
    """The points, if they are three at least; else an error."""
    return F.when(F.size(points) >= 3, points).otherwise(F.raise_error(F.lit("a polygon needs three points or more")).cast(POINTS))


def _sum(array: Column, term) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, e: s + term(e))


def signed_area(points: Column) -> Column:
    """Positive if the points run clockwise on screen (y down)."""
    return let(points, lambda p: _sum(_pairs(p), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2)


def _pairs(points: Column) -> Column:
    n = F.size(points)
    return F.transform(points, lambda p, i: F.struct(p.alias("a"), F.get(points, (i + 1) % n).alias("b")))


def polygon_area(points: Column) -> Column:
    return F.abs(signed_area(points))


def convex(points: Column) -> Column:
    """Whether all turns go one way, and only once around: a star of crossing edges turns one way as well."""

    def turns(own: Column) -> Column:
        n = F.size(own)

        def turn(p: Column, i: Column) -> Column:
            q, r = F.get(own, (i + 1) % n), F.get(own, (i + 2) % n)
            return (q["x"] - p["x"]) * (r["y"] - q["y"]) - (q["y"] - p["y"]) * (r["x"] - q["x"])

        return F.transform(own, turn)

    def once(own: Column) -> Column:
        n = F.size(own)
        ways = F.filter(F.transform(own, lambda p, i: F.signum(F.get(own, (i + 1) % n)["x"] - p["x"])), lambda w: w != 0)
        return let(ways, lambda ws: F.size(F.filter(ws, lambda w, i: w != F.get(ws, (i + 1) % F.size(ws)))) <= 2)

    one_way = let(let(points, turns), lambda ts: (F.array_min(ts) >= -1e-9) | (F.array_max(ts) <= 1e-9))
    return F.when(F.size(points) < 5, one_way).otherwise(one_way & let(points, once))


#: How near a border counts as on it, in pixels.
NEAR = 1e-9


def _cut(edges: Column, cutters: Column) -> Column:
    """The edges in pieces between the places where cutters cross or touch them."""

    def pieces(e: Column) -> Column:
        rx, ry = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]

        def places(f: Column) -> Column:
            sx, sy, qx, qy = f["b"]["x"] - f["a"]["x"], f["b"]["y"] - f["a"]["y"], f["a"]["x"] - e["a"]["x"], f["a"]["y"] - e["a"]["y"]
            across = rx * sy - ry * sx
            met = F.when(F.when(across != 0, (qx * ry - qy * rx) / across).between(-NEAR, 1 + NEAR), F.array((qx * sy - qy * sx) / across))
            along = lambda x, y: F.try_divide(x * rx + y * ry, rx * rx + ry * ry)
            in_line = F.when(qx * ry - qy * rx == 0, F.array(along(qx, qy), along(qx + sx, qy + sy)))
            return F.coalesce(F.when(across != 0, met).otherwise(in_line), F.array().cast("array<double>"))

        inner = F.filter(F.flatten(F.transform(cutters, places)), lambda t: (t > 0) & (t < 1))
        at = lambda t: point(e["a"]["x"] + t * rx, e["a"]["y"] + t * ry)
        ends = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), inner)))
        return let(F.transform(ends, at), lambda ps: F.transform(F.slice(ps, F.lit(1), F.size(ps) - 1), lambda p, i: F.struct(p.alias("a"), F.get(ps, i + 1).alias("b"))))

    return F.flatten(F.transform(edges, pieces))


def _sides(piece: Column, edges: Column) -> Column:
    """How often a polygon winds around what lies right beside the piece's middle, on its left and right."""
    mx, my = (piece["a"]["x"] + piece["b"]["x"]) / 2, (piece["a"]["y"] + piece["b"]["y"]) / 2
    ux, uy = piece["b"]["x"] - piece["a"]["x"], piece["b"]["y"] - piece["a"]["y"]

    def winds(frame: Column) -> Column:
        """Edges are seen in the piece's own frame: along it, and to its left."""
        along = lambda p: (p["x"] - frame["mx"]) * frame["ux"] + (p["y"] - frame["my"]) * frame["uy"]
        left = lambda p: (p["y"] - frame["my"]) * frame["ux"] - (p["x"] - frame["mx"]) * frame["uy"]

        def crossed(e: Column) -> Column:
            """Where an edge crosses the normal, and which way."""
            a, b = F.struct(along(e["a"]).alias("s"), left(e["a"]).alias("n")), F.struct(along(e["b"]).alias("s"), left(e["b"]).alias("n"))
            ends = F.struct(a.alias("a"), b.alias("b"))
            return let(ends, lambda q: F.struct((q["a"]["n"] - q["a"]["s"] * (q["b"]["n"] - q["a"]["n"]) / (q["b"]["s"] - q["a"]["s"])).alias("n"), F.when(q["b"]["s"] < 0, 1).otherwise(-1).alias("way")))

        total = lambda hits, side: F.aggregate(hits, F.lit(0), lambda n, h: n + F.when(h["n"] * side > NEAR, h["way"] * side).otherwise(0))
        some = F.filter(edges, lambda e: (along(e["a"]) < 0) != (along(e["b"]) < 0))
        return let(F.transform(some, crossed), lambda hits: F.struct(total(hits, 1).alias("left"), total(hits, -1).alias("right")))

    n = F.sqrt(ux * ux + uy * uy)
    return let(F.struct(mx.alias("mx"), my.alias("my"), (ux / n).alias("ux"), (uy / n).alias("uy")), winds)


def _forward(points: Column) -> Column:
    """Edges of the polygon that have a length, the way round in which its area is positive."""
    own = let(signed_area(points), lambda a: F.when(a < 0, F.reverse(points)).otherwise(points))
    return F.filter(_pairs_of(own), lambda e: e["a"] != e["b"])


def _pairs_of(points: Column) -> Column:
    return let(points, _pairs)


def _bounded(pieces: Column, inside: Callable[[Column], Column], skipped: Callable[[Column], Column] | None = None) -> Column:
    """Twice the area that pieces of border go around: those that have the region on one side only."""

    def part(p: Column) -> Column:
        cross = p["a"]["x"] * p["b"]["y"] - p["b"]["x"] * p["a"]["y"]
        value = cross * inside(p)
        return value if skipped is None else F.when(skipped(p), F.lit(0.0)).otherwise(value)

    return F.aggregate(pieces, F.lit(0.0), lambda s, p: s + part(p))


def region_area(points: Column) -> Column:
    """Area of what a polygon winds around, the way round of its own signed area: of one whose edges cross, the repaired
    area. Edges are cut where they cross, and what has the region on one side only bounds it (Green's theorem)."""
    inside = lambda edges: lambda p: let(_sides(p, edges), lambda w: (w["left"] > 0).cast("int") - (w["right"] > 0).cast("int"))
    return let(_forward(points), lambda edges: F.abs(_bounded(_cut(edges, edges), inside(edges))) / 2)


def region_shared(first: Column, second: Column) -> Column:
    """Area that the regions of two polygons of any kind share. A border that both have counts once."""

    def shared(e: Column) -> Column:
        a, b = e["a"], e["b"]
        both = lambda p: let(F.struct(_sides(p, a).alias("a"), _sides(p, b).alias("b")), lambda w: ((w["a"]["left"] > 0) & (w["b"]["left"] > 0)).cast("int") - ((w["a"]["right"] > 0) & (w["b"]["right"] > 0)).cast("int"))

        def on_first(p: Column) -> Column:
            mx, my = (p["a"]["x"] + p["b"]["x"]) / 2, (p["a"]["y"] + p["b"]["y"]) / 2

            def holds(f: Column) -> Column:
                dx, dy = f["b"]["x"] - f["a"]["x"], f["b"]["y"] - f["a"]["y"]
                n, t = F.sqrt(dx * dx + dy * dy), (mx - f["a"]["x"]) * dx + (my - f["a"]["y"]) * dy
                return (F.abs((mx - f["a"]["x"]) * dy - (my - f["a"]["y"]) * dx) <= NEAR * n) & (t >= 0) & (t <= n * n)

            return F.exists(a, holds)

        every = F.concat(a, b)
        return F.abs(_bounded(_cut(a, every), both) + _bounded(_cut(b, every), both, on_first)) / 2

    return let(F.struct(_forward(first).alias("a"), _forward(second).alias("b")), shared)


def safe_area(points: Column, is_convex: Column | None = None) -> Column:
    """Area of a usable polygon, repaired where its edges cross; null for under three points or no area."""
    own = F.when(convex(points) if is_convex is None else is_convex, polygon_area(points)).otherwise(region_area(points))
    return F.when(F.size(points) >= 3, let(own, lambda a: F.when(a > 0, a)))


def centroid(points: Column) -> Column:
    """Centre of gravity of the polygon; null without area."""
    area = signed_area(points)
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    mean = lambda c: _sum(_pairs(points), lambda e: (e["a"][c] + e["b"][c]) * cross(e)) / (6 * area)
    return F.when(area != 0, point(mean("x"), mean("y")))


def placement_offset(canvas: int) -> tuple[int, int]:
    """Where the card's top left lies when it is centred on its placement canvas."""
    place = max(canvas, CARD_WIDTH, CARD_HEIGHT)
    return (place - CARD_WIDTH) // 2, (place - CARD_HEIGHT) // 2


def affine_matrix(angle: Column, scale: Column, tx: Column, ty: Column, canvas: int = SCENE_SIZE) -> Column:
    """Rotation by degrees and scaling about the placement canvas's centre, then a move by fractions of the canvas."""
    place = max(canvas, CARD_WIDTH, CARD_HEIGHT)
    centre, back = place / 2, (canvas - place) / 2
    a, b = scale * F.cos(F.radians(angle)), scale * F.sin(F.radians(angle))
    return F.struct(
        a.alias("a"),
        b.alias("b"),
        ((1 - a) * centre - b * centre + back + tx * canvas).alias("dx"),
        (b * centre + (1 - a) * centre + back + ty * canvas).alias("dy"),
    )


def affine_points(matrix: Column, points: Column) -> Column:
    m = matrix
    return F.transform(points, lambda p: point(m["a"] * p["x"] + m["b"] * p["y"] + m["dx"], -m["b"] * p["x"] + m["a"] * p["y"] + m["dy"]))


def points_to_bbox(points: Column, width: Column, height: Column, margin: int = BOX_MARGIN) -> Column:
    """Box of the points with a margin, cut at the image, each side truncated towards zero; null if nothing is left."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, ends_to_bbox(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys), width, height, margin))


def ends_to_bbox(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, margin: int = BOX_MARGIN) -> Column:
    """The same from the points' smallest and largest x and y."""
    xmin, xmax = F.greatest(F.lit(0), (x0 - margin).cast("int")), F.least(width.cast("int"), (x1 + margin).cast("int"))
    ymin, ymax = F.greatest(F.lit(0), (y0 - margin).cast("int")), F.least(height.cast("int"), (y1 + margin).cast("int"))
    box = F.struct(xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax"))
    return F.when((xmin < xmax) & (ymin < ymax), box)


def voc_to_yolo(width: Column, height: Column, xmin: Column, xmax: Column, ymin: Column, ymax: Column, strict: bool = True) -> Column:
    """Centre and size as fractions of the image. A bad image or box is an error, or null if not `strict`."""
    image_ok, box_ok = (width > 0) & (height > 0), (xmax > xmin) & (ymax > ymin)
    yolo = F.struct(
        ((xmin + xmax) / 2.0 / width).alias("cx"), ((ymin + ymax) / 2.0 / height).alias("cy"), ((xmax - xmin) / width.cast("double")).alias("w"), ((ymax - ymin) / height.cast("double")).alias("h")
    )
    if not strict:
        return F.when(image_ok & box_ok, yolo)
    kind = "struct<cx:double,cy:double,w:double,h:double>"
    bad_box = F.when(box_ok, yolo).otherwise(F.raise_error(F.lit("degenerate box")).cast(kind))
    return F.when(image_ok, bad_box).otherwise(F.raise_error(F.lit("image sizes must be positive")).cast(kind))


def _clipped(poly: Column, a: Column, b: Column, side: Column) -> Column:
    """The part of a convex polygon on the inner side of the line a-b, by its corners' signed distances."""

    def away(p: Column) -> Column:
        return side * ((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))

    def cut(far: Column) -> Column:
        def kept(p: Column, i: Column) -> Column:
            before = F.pmod(i - 1, F.size(far))
            q, d, e = F.get(poly, before), F.get(far, i), F.get(far, before)
            share = e / (e - d)
            border = point(q["x"] + (p["x"] - q["x"]) * share, q["y"] + (p["y"] - q["y"]) * share)
            return F.when((d >= 0) & (e >= 0), F.array(p)).when(d >= 0, F.array(border, p)).when(e >= 0, F.array(border)).otherwise(F.array().cast(POINTS))

        return F.when(F.array_min(far) >= 0, poly).when(F.array_max(far) < 0, F.array().cast(POINTS)).otherwise(F.flatten(F.transform(poly, kept)))

    return F.when(F.size(poly) == 0, poly).otherwise(let(F.transform(poly, away), cut))


def intersection_area(subject: Column, clip: Column, both_convex: Column | None = None) -> Column:
    """Area shared by two polygons. Of convex ones the first is cut along every edge of the second; others go by their borders."""
    ends = lambda p, c, f: f(F.transform(p, lambda q: q[c]))
    apart = F.lit(False)
    for c in "xy":
        apart = apart | (ends(subject, c, F.array_min) > ends(clip, c, F.array_max)) | (ends(subject, c, F.array_max) < ends(clip, c, F.array_min))
    cut = let(F.signum(signed_area(clip)), lambda side: polygon_area(F.aggregate(_pairs(clip), subject, lambda poly, e: _clipped(poly, e["a"], e["b"], side))))
    plain = convex(subject) & convex(clip) if both_convex is None else both_convex
    return F.when(apart, F.lit(0.0)).when(plain, cut).otherwise(region_shared(subject, clip))


def visible_fraction(hull: Column, occluder: Column) -> Column:
    return let(safe_area(hull), lambda area: F.try_divide(area - intersection_area(hull, occluder), area))


def kept_after_occlusion(hull: Column, occluder: Column, hidden: float = MAX_HIDDEN) -> Column:
    """Whether a corner is labelled: no occluder, or at most `hidden` of the hull lies under it."""

    def judged(c: Column) -> Column:
        visible = let(safe_area(hull, c["h"]), lambda area: F.coalesce((area - intersection_area(hull, occluder, c["h"] & c["o"])) / area >= 1.0 - hidden, F.lit(False)))
        return F.when(safe_area(occluder, c["o"]).isNull(), False).otherwise(visible)

    both = F.struct(convex(hull).alias("h"), convex(occluder).alias("o"))
    return F.when(occluder.isNull(), True).otherwise(let(both, judged))


def tight_rectangle(hull: Column) -> Column:
    """The smallest rectangle around a hull, as corners, width, height and area: of those that share a direction with one of
    its edges the first of smallest area. A line has one of no area; null for fewer than two corners."""

    def around(e: Column) -> Column:
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        unit = let(F.sqrt(dx * dx + dy * dy), lambda n: point(dx / n, dy / n))

        def sized(u: Column) -> Column:
            s, t = F.transform(hull, lambda p: p["x"] * u["x"] + p["y"] * u["y"]), F.transform(hull, lambda p: p["y"] * u["x"] - p["x"] * u["y"])
            return F.struct(u.alias("u"), F.array_min(s).alias("s0"), F.array_max(s).alias("s1"), F.array_min(t).alias("t0"), F.array_max(t).alias("t1"))

        return let(unit, sized)

    def corners(r: Column) -> Column:
        u = r["u"]
        at = lambda s, t: point(u["x"] * r[s] - u["y"] * r[t], u["y"] * r[s] + u["x"] * r[t])
        return F.array(at("s0", "t0"), at("s1", "t0"), at("s1", "t1"), at("s0", "t1"))

    edges = F.filter(_pairs(hull), lambda e: e["a"] != e["b"])
    sides = lambda r: F.struct(((r["s1"] - r["s0"]) * (r["t1"] - r["t0"])).alias("area"), (r["s1"] - r["s0"]).alias("width"), (r["t1"] - r["t0"]).alias("height"), r.alias("r"))
    least = let(F.transform(edges, lambda e: let(around(e), sides)), lambda all_: F.array_min(F.transform(all_, lambda r, i: F.struct(r["area"].alias("area"), i.alias("i"), r.alias("r")))))
    named = lambda m: F.struct(corners(m["r"]["r"]).alias("corners"), m["r"]["width"].alias("width"), m["r"]["height"].alias("height"), m["area"].alias("area"))
    return F.when(F.size(hull) >= 2, let(least, named))


def rectangularity(area: Column, box_area: Column) -> Column:
    """Share of its tightest rectangle that a contour fills, one at most; null without a rectangle."""
    return F.when(box_area > 0, F.least(F.lit(1.0), area / box_area))


def lies_wide(width: Column, height: Column) -> Column:
    """Whether the upright reference quad fits; an equal-sided card is turned."""
    return width > height


def solidity(area: Column, hull_area: Column) -> Column:
    return F.when(hull_area > 0, area / hull_area)


def centre_ok(width: Column, height: Column, cx: Column, cy: Column, tolerance: tuple[float, float] = CENTRE_TOLERANCE) -> Column:
    return (F.abs(width / 2 - cx) < width * tolerance[0]) & (F.abs(height / 2 - cy) < height * tolerance[1])


def hull_plausible(area: Column, hull_area: tuple[float, float] = HULL_AREA) -> Column:
    return area.between(*hull_area)
