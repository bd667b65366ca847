"""Scenes as rows: placed cards, their corner labels, label files, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scenekiln.functions import geometry as g
from scenekiln.functions import quads
from scenekiln.functions.text import yolo_line
from scenekiln.operators.ranking import encoded


def placed(cards: DataFrame, canvas: int = g.SCENE_SIZE, hull_hl: Column | None = None, hull_lr: Column | None = None) -> DataFrame:
    """Cards (angle, scale, tx, ty) with corners, hull_hl and hull_lr on the canvas. Without hulls of their own, cards
    have their corner zones."""
    dx, dy = g.placement_offset(canvas)
    m = F.col("__m")
    moved = lambda hull, quad: g.hull_to_points(hull, F.lit(dx), F.lit(dy)) if hull is not None else g.quad(quad, dx, dy)
    return (
        cards.withColumn("__m", g.affine_matrix(F.col("angle"), F.col("scale"), F.col("tx"), F.col("ty"), canvas))
        .withColumns({"corners": g.affine_points(m, g.quad(g.CARD_QUAD, dx, dy)), "hull_hl": g.affine_points(m, moved(hull_hl, g.CORNER_HL)), "hull_lr": g.affine_points(m, moved(hull_lr, g.CORNER_LR))})
        .drop("__m")
    )


def with_occluder(cards: DataFrame, occluders: str = "next") -> DataFrame:
    """Each card with the outline of the card drawn right after it in its scene; with `all_later`, of all those."""
    w = Window.partitionBy("scene").orderBy("z")
    if occluders == "next":
        return cards.withColumn("occluder", F.lead("corners").over(w))
    if occluders == "all_later":
        return cards.withColumn("occluders", F.collect_list("corners").over(w.rowsBetween(1, Window.unboundedFollowing)))
    raise ValueError("occluders are `next` or `all_later`")


def corner_labels(cards: DataFrame, canvas: int = g.SCENE_SIZE, hidden: float = g.MAX_HIDDEN, occluders: str = "next") -> DataFrame:
    """One row a visible corner: scene, z, corner (0 top left, 1 bottom right), class, box and yolo."""
    df = with_occluder(cards, occluders).select("*", F.posexplode(F.array("hull_hl", "hull_lr")).alias("corner", "hull"))
    hull = F.col("hull")
    if occluders == "next":
        kept = g.kept_after_occlusion(hull, F.col("occluder"), hidden)
    else:
        kept = F.forall("occluders", lambda o: g.kept_after_occlusion(hull, o, hidden))
    side = F.lit(canvas)
    df = df.filter(kept).withColumn("box", g.points_to_bbox(hull, side, side)).filter("box IS NOT NULL")
    yolo = g.voc_to_yolo(side, side, F.col("box.xmin"), F.col("box.xmax"), F.col("box.ymin"), F.col("box.ymax"))
    return df.select("scene", "z", "corner", "class", "box", yolo.alias("yolo"))


def zone_labels(cards: DataFrame, canvas: int = g.SCENE_SIZE, hidden: float = g.MAX_HIDDEN) -> DataFrame:
    """As `corner_labels`, of cards (scene, z, class, angle, scale, tx, ty, next) that have no hulls but their corner zones.
    `next` has the four numbers of the card drawn right after; no polygon is made, sorted or shuffled."""
    numbers = ("angle", "scale", "tx", "ty")
    matrix = lambda of: [g.affine_matrix(*[F.col(of + c) for c in numbers], canvas)[c] for c in ("a", "b", "dx", "dy")]
    df = cards.withColumn("__zones", quads.zones_in_sight(matrix(""), matrix("next."), canvas))
    zone = lambda i, of: F.struct(F.lit(i).alias("corner"), *[F.col(f"__zones.{of}.{c}").alias(c) for c in quads.KNOWN])
    df = df.select("scene", "z", "class", F.col("next").isNull().alias("free"), F.inline(F.array(zone(0, "hl"), zone(1, "lr"))))
    df = df.filter(F.col("free") | F.coalesce(F.col("seen") >= 1.0 - hidden, F.lit(False)))
    side = F.lit(canvas)
    df = df.withColumn("box", g.ends_to_bbox(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), side, side)).filter("box IS NOT NULL")
    yolo = g.voc_to_yolo(side, side, F.col("box.xmin"), F.col("box.xmax"), F.col("box.ymin"), F.col("box.ymax"))
    return df.select("scene", "z", "corner", "class", "box", yolo.alias("yolo"))


def label_files(labels: DataFrame, names: DataFrame) -> DataFrame:
    """One row a scene that has labels of known classes: the text of its label file, lines in label order."""
    known = encoded(labels, names, "class").withColumn("line", yolo_line(F.col("id"), F.col("yolo")))
    lines = F.array_sort(F.collect_list(F.struct("z", "corner", "line")))
    return known.groupBy("scene").agg(F.concat(F.array_join(F.transform(lines, lambda s: s["line"]), "\n"), F.lit("\n")).alias("text"))


def audited(labels: DataFrame, names: DataFrame, canvas: int = g.SCENE_SIZE, classes: int = 32) -> DataFrame:
    """Labels with `ok`: known class, id in the deck, fractions and box inside the canvas."""
    df = labels.join(names, "class", "left")
    y, b = (lambda c: F.col(f"yolo.{c}")), (lambda c: F.col(f"box.{c}"))
    inside = y("cx").between(0, 1) & y("cy").between(0, 1) & (y("w") > 0) & (y("w") <= 1) & (y("h") > 0) & (y("h") <= 1)
    ordered = (b("xmin") >= 0) & (b("xmin") < b("xmax")) & (b("xmax") <= canvas) & (b("ymin") >= 0) & (b("ymin") < b("ymax")) & (b("ymax") <= canvas)
    return df.withColumn("ok", F.coalesce(F.col("id").between(0, classes - 1) & inside & ordered, F.lit(False)))


def composited(base: Column, overlay: Column, alpha: Column) -> Column:
    """An overlay's channel over a base's, by an alpha of 0 to 255: clipped and truncated. Arrays of equal length."""
    share = F.transform(alpha, lambda a: a / F.lit(255.0))
    over = F.zip_with(overlay, share, lambda o, a: o * a)
    under = F.zip_with(base, share, lambda b, a: b * (1 - a))
    return F.zip_with(over, under, lambda o, u: F.least(F.lit(255), F.greatest(F.lit(0), (o + u).cast("int"))))


def laplacian_variance(grid: Column, width: int, height: int) -> Column:
    """Focus of a gray grid (row-major array): population variance of its Laplacian, borders mirrored without repeat."""
    n = width * height
    mirror = lambda i, size: F.when(i < 0, -i).when(i >= size, 2 * size - 2 - i).otherwise(i)
    at = lambda r, c: F.get(grid, mirror(r, height) * width + mirror(c, width))

    def cell(i: Column) -> Column:
        r, c = F.floor(i / width).cast("int"), F.pmod(i, F.lit(width))
        return (at(r - 1, c) + at(r + 1, c) + at(r, c - 1) + at(r, c + 1) - 4 * at(r, c)).cast("double")

    values = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n
    return F.transform(F.array(values), lambda v: mean(F.transform(v, lambda x: x * x)) - F.pow(mean(v), F.lit(2)))[0]
