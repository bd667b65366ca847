"""Reproducible sampling: a plan has a row a card, ids and numbers but no pixels, and Spark joins it.

A plan depends on its seed alone and never on partitions. `scene_plan` draws in sequence on the driver, from a generator
each for scenes, backgrounds and cards; that bounds its size. `hashed_plan` makes each draw from the seed and the draw's
own place by a hash, as an expression beside its row, so it has any number of scenes and no row on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenekiln.operators import ranking
from scenekiln.operators.members import PagedIndex

#: Scenes that a plan drawn in sequence may hold on the driver; `hashed_plan` has no such bound.
MAX_SCENES = 1_000_000
PLAN = "scene long, z int, background long, class_rank int, entry long, angle double, scale double, tx double, ty double"


@dataclass(frozen=True)
class AugmentRange:
    """Uniform ranges of a card's turn (degrees), size and move (fractions of the canvas)."""

    #: The public parameters and their defaults.
    rotation_deg: tuple[float, float] = (-30.0, 30.0)
    scale: tuple[float, float] = (0.5, 0.8)
    translate_frac: tuple[float, float] = (-0.15, 0.15)


def plan_rows(seed: int, scenes: int, n_cards: int, entries: list[int], backgrounds: int, aug: AugmentRange | None = None) -> list[tuple]:
    """Rows of PLAN. `entries`: number of samples of each class, in the order of class names."""
    if n_cards not in (2, 3):
        raise ValueError("a scene has two or three cards")
    if backgrounds < 1 or not entries or min(entries) < 1:
        raise ValueError("there are no backgrounds or no cards")
    if scenes > MAX_SCENES:
        raise ValueError("too many scenes for one plan")
    ranges = aug or AugmentRange()
    place, ground, deck = (np.random.default_rng(seed + k) for k in range(3))
    out = []
    for scene in range(scenes):
        background = int(ground.integers(0, backgrounds))
        drawn = []
        for _ in range(n_cards):
            rank = int(deck.integers(0, len(entries)))  # classes first: balanced whatever their sizes
            drawn.append((rank, int(deck.integers(0, entries[rank]))))
        for z, (rank, entry) in enumerate(drawn):
            moves = [float(place.uniform(*r)) for r in (ranges.rotation_deg, ranges.scale, ranges.translate_frac, ranges.translate_frac)]
            out.append((scene, z, background, rank, entry, *moves))
    return out


def scene_plan(spark: SparkSession, seed: int, scenes: int, n_cards: int, entries: list[int], backgrounds: int, aug: AugmentRange | None = None) -> DataFrame:
    return spark.createDataFrame(plan_rows(seed, scenes, n_cards, entries, backgrounds, aug), PLAN)


def uniform(seed: int, stream: str, *keys: Column) -> Column:
    """A number in [0, 1) for each row, from 52 bits of the MD5 of seed, stream and keys."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit(stream), *keys))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _upto(draw: Column, n: Column) -> Column:
    return F.floor(draw * n).cast("long")


def hashed_plan(spark: SparkSession, seed: int, scenes: int, n_cards: int, index: DataFrame, backgrounds: int, aug: AugmentRange | None = None) -> DataFrame:
    """Rows of PLAN for any number of scenes: classes first, then an entry of the class, as in `plan_rows`.

    The streams have the seed, the seed + 1 (backgrounds) and the seed + 2 (cards). A scene's draws stay the same
    however many scenes are asked for.
    """
    if n_cards not in (2, 3):
        raise ValueError("a scene has two or three cards")
    sizes = index.filter("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n"))
    sizes = sizes.select("n", (F.row_number().over(Window.orderBy("name")) - 1).alias("class_rank"))  # one row a class
    classes = sizes.count()
    if backgrounds < 1 or not classes:
        raise ValueError("there are no backgrounds or no cards")
    ranges, at = aug or AugmentRange(), (F.col("scene"), F.col("z"))
    cards = spark.range(scenes).select(F.col("id").alias("scene"), F.explode(F.sequence(F.lit(0), F.lit(n_cards - 1))).alias("z"))
    rank = _upto(uniform(seed + 2, "class", *at), F.lit(classes)).cast("int")
    drawn = ranking.encoded(cards.withColumn("class_rank", rank), sizes, "class_rank")
    entry = _upto(uniform(seed + 2, "entry", *at), F.col("n"))
    background = _upto(uniform(seed + 1, "background", F.col("scene")), F.lit(backgrounds))
    between = lambda name, r: (F.lit(float(r[0])) + F.lit(float(r[1] - r[0])) * uniform(seed, name, *at)).alias(name)
    moves = [between(n, r) for n, r in (("angle", ranges.rotation_deg), ("scale", ranges.scale), ("tx", ranges.translate_frac), ("ty", ranges.translate_frac))]
    return drawn.select("scene", "z", background.alias("background"), "class_rank", entry.alias("entry"), *moves)


def numbered_index(index: DataFrame) -> DataFrame:
    """A class index (name, shard, key) with class_rank and entry, both from 0, as plans count them.

    Entries are places in one order of all rows less their class's first, so a class of most rows is numbered in many
    tasks. Rows without a name go.
    """
    rows = ranking.ranked(index.filter("name IS NOT NULL"), [F.col("name"), F.col("shard"), F.col("key")])
    first = rows.groupBy("name").agg(F.min("index").alias("first"))
    first = first.withColumn("class_rank", F.row_number().over(Window.orderBy("name")) - 1)  # one row a class
    return ranking.encoded(rows, first, "name").select(*index.columns, (F.col("index") - F.col("first")).alias("entry"), "class_rank")


def drawn_cards(plan: DataFrame, index: DataFrame) -> DataFrame:
    """A plan with the name, shard and key of each card."""
    return PagedIndex(index).drawn(plan)


def keyed_sample(rows: DataFrame, seed: int, k: int, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """k rows, of each group of `by` if there is one, drawn evenly without replacement: those of smallest hash of seed and keys.

    One scan: each task keeps the k smallest it has, and only those are shuffled. The draw does not depend on partitions.
    Rows of equal keys are one draw.
    """
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.lit("sample"), *[F.col(f"`{c}`").cast("string") for c in keys]))
    order = [draw, *[F.col(f"`{c}`") for c in keys]]
    if not by:
        return rows.orderBy(*order).limit(k)
    w = Window.partitionBy(*[F.col(f"`{c}`") for c in by]).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


def random_sample(index: DataFrame, seed: int, name: str | None = None) -> DataFrame:
    """One entry of a class index: of a random class, whatever the classes' sizes, or of the class named. An unknown class is
    a KeyError. One scan of the index gives one row a class, of which one is left."""
    rows = index.filter(F.col("name") == name) if name is not None else index.filter("name IS NOT NULL")
    each = keyed_sample(rows.select("name", "shard", "key"), seed, 1, ["shard", "key"], ["name"])
    drawn = each.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.lit("class"), "name"))).limit(1).collect()
    if not drawn:
        raise KeyError(name)
    return index.sparkSession.createDataFrame(drawn, each.schema)
