"""Cards and their corner symbols found among the outlines of an image. Outlines stand beside their row as lists of points;
all that measures and judges them is Column functions, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenekiln.functions import contours
from scenekiln.functions import geometry as g
from scenekiln.functions.hull import convex_hull, convex_hulls

MEASURED = "struct<area:double,hull_area:double,cx:double,cy:double>"


def measured(line: Column, hull: Column) -> Column:
    """Area, hull area and centre of an outline."""
    centre = g.let(g.centroid(line), lambda c: F.struct(g.polygon_area(line).alias("area"), g.polygon_area(hull).alias("hull_area"), c["x"].alias("cx"), c["y"].alias("cy")))
    return F.when(F.size(line) >= 3, centre)


def with_corner_hull(
    cards: DataFrame,
    into: str,
    zone: list[tuple[float, float]] = g.CORNER_HL,
    image: str = "image",
    min_area: float = g.MIN_CONTOUR_AREA,
    min_solidity: float = g.MIN_SOLIDITY,
    hull_area: tuple[float, float] = g.HULL_AREA,
    tolerance: tuple[float, float] = g.CENTRE_TOLERANCE,
) -> DataFrame:
    """`cards` with struct `into` of the hull of the symbol in a corner zone, its area, and `ok`, whether that is plausible;
    null where there is no symbol.

    Outlines count from `min_area`, above `min_solidity`, and if their centre is off the zone's by less than `tolerance`.
    """
    x0, y0 = (float(int(v)) for v in zone[0])
    width, height = (F.lit(float(int(b) - int(a))) for a, b in zip(zone[0], zone[2]))
    df = cards.withColumn("__lines", contours.zone_outlines(zone)(F.col(image))).withColumn("__around", convex_hulls("__lines"))

    def stays(m: Column) -> Column:
        solid = F.coalesce(g.solidity(m["area"], m["hull_area"]) > min_solidity, F.lit(False))
        return F.coalesce((m["area"] >= min_area) & solid & g.centre_ok(width, height, m["cx"], m["cy"], tolerance), F.lit(False))

    kept = F.filter("__lines", lambda line, i: g.let(measured(line, F.get(F.col("__around"), i)), stays))
    # a column of its own that is asked for twice: a Python function's argument must not come to hold a lambda
    df = df.withColumn("__kept", F.flatten(kept)).withColumn("__hull", convex_hull("__kept"))
    found = g.let(g.polygon_area(F.col("__hull")), lambda a: F.struct(g.hull_to_points(F.col("__hull"), F.lit(x0), F.lit(y0)).alias("hull"), g.hull_plausible(a, hull_area).alias("ok"), a.alias("area")))
    return df.withColumn(into, F.when(F.size("__kept") > 0, found)).drop("__lines", "__around", "__kept", "__hull")


def with_card(frames: DataFrame, min_focus: float = g.MIN_FOCUS, min_rectangularity: float = g.MIN_RECTANGULARITY, image: str = "image") -> DataFrame:
    """Frames that show a card, with focus, rectangularity, its outline `line`, its corners `box` and where they go, `target`.

    The blurred go first, as that is cheapest; of the others the largest outline, the first of equals, is the card's if it
    fills its tightest rectangle well enough.
    """
    df = frames.withColumn("focus", contours.focus.asNondeterministic()(F.col(image))).filter(F.col("focus") >= min_focus)
    df = df.withColumn("__lines", contours.frame_outlines(image))
    ranked = F.transform("__lines", lambda line, i: F.struct(g.polygon_area(line).alias("area"), (-i).alias("i")))
    df = df.withColumn("__top", F.array_max(ranked)).filter("__top IS NOT NULL")
    df = df.withColumn("line", F.get("__lines", -F.col("__top.i"))).withColumn("__hull", convex_hull("line"))
    df = df.withColumn("__rect", g.tight_rectangle(F.col("__hull"))).filter("__rect IS NOT NULL")
    whole = F.transform("__rect.corners", lambda p: g.point(F.when(p["x"] < 0, F.ceil(p["x"])).otherwise(F.floor(p["x"])), F.when(p["y"] < 0, F.ceil(p["y"])).otherwise(F.floor(p["y"]))))
    df = df.withColumn("box", whole).withColumn("rectangularity", g.rectangularity(F.col("__top.area"), g.polygon_area(F.col("box"))))
    df = df.filter(F.col("rectangularity") >= min_rectangularity)
    turned = g.CARD_QUAD[1:] + g.CARD_QUAD[:1]
    upright = g.lies_wide(F.col("__rect.width"), F.col("__rect.height"))
    return df.withColumn("target", F.when(upright, g.quad(g.CARD_QUAD)).otherwise(g.quad(turned))).drop("__lines", "__top", "__hull", "__rect")
