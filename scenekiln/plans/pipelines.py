"""Packing and scene generation end to end: image folders to shards, shards to labelled scenes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenekiln.functions import contours, pixels
from scenekiln.functions import geometry as g
from scenekiln.functions.hull import POINT, flat_points, point_lists
from scenekiln.functions.text import READ, padded
from scenekiln.operators import cards as cards_of
from scenekiln.operators import members as m
from scenekiln.operators import ranking, sampling, scenes
from scenekiln.session import materialize, united
from scenekiln.sources import png
from scenekiln.sources import shards as s

POINT_LIST = T.ArrayType(POINT)
ROLES = ["cls", "png", "hull_hl.npy", "hull_lr.npy"]


def pack_backgrounds(spark: SparkSession, images: str, out: str, shard_size: int = 1024, prefix: str = "backgrounds") -> int:
    """Images to PNG shards. Keys count walked files, so files that do not decode leave gaps. Returns the shards.

    Images are decoded once and written as PNG; only paths are ranked.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            payload = [png.encode_png(pixels.to_bgr(pixels.from_image(i))) if ok else None for i, ok in zip(batch["image"], batch["ok"])]
            yield pd.DataFrame({"path": batch["path"], "payload": pd.Series(payload, dtype=object)})

    walked = s.walk_images(spark, images, decode=True).withColumn("ok", F.col("image").isNotNull())
    encoded = materialize(walked.mapInPandas(encode, "path string, payload binary"), "backgrounds")
    paths = encoded.select("path", F.col("payload").isNotNull().alias("ok"))
    ranks = ranking.shard_slots(ranking.ranked(paths, [F.split(s.relative(F.col("path"), s.qualified(spark, images)), "/")], F.col("ok")), shard_size).filter("rank IS NOT NULL")
    file, name = F.concat(F.lit(f"{prefix}-"), padded(F.col("shard"), 4), F.lit(".tar")), F.concat(padded(F.col("index"), 8), F.lit(".png"))
    s.write_files(ranks.join(encoded, "path").select(file.alias("file"), name.alias("name"), "payload", "slot"), out, ["slot"], replaces=prefix)
    return -(-ranks.count() // shard_size)


def _as_png():
    @F.arrow_udf("binary")
    def made(images: pa.Array) -> pa.Array:
        return pa.array([png.encode_png(pixels.to_bgra(pixels.from_image(i.as_py()))) for i in images], pa.binary())

    return made


def _as_npy():
    """Hulls as payloads of shape (K, 1, 2)."""

    @F.arrow_udf("binary")
    def made(hulls: pa.Array) -> pa.Array:
        begins, points = flat_points(hulls)
        return pa.array([png.encode_npy(points[a:b].astype(np.int64).reshape(-1, 1, 2)) for a, b in zip(begins, begins[1:])], pa.binary())

    return made


def pack_cards(spark: SparkSession, root: str, out: str, shard_size: int = 512, prefix: str = "cards", extract_hulls: bool = True, **thresholds) -> int:
    """Cards by class folder to shards of four members each. Only canonical images with plausible hulls are packed, and
    keys count those. A gray image of the right size is passed over, not an error.

    `thresholds` are those of `with_corner_hull`. Hulls are looked for once; only paths are ranked.
    """
    path = s.relative(F.col("path"), s.qualified(spark, root))
    df = s.walk_images(spark, root, decode=True).filter(F.contains(path, F.lit("/")))
    df = df.filter((F.col("image.height") == g.CARD_HEIGHT) & (F.col("image.width") == g.CARD_WIDTH) & F.col("image.nChannels").isin(3, 4))
    df = df.select(F.split_part(path, F.lit("/"), F.lit(1)).alias("class"), path.alias("path"), "image")
    for name, zone in (("hl", g.CORNER_HL), ("lr", g.CORNER_LR)):
        if extract_hulls:
            df = cards_of.with_corner_hull(df, name, zone, **thresholds).filter(f"{name}.ok")
        else:
            df = df.withColumn(name, F.struct(g.quad(zone).alias("hull")))
    cards = df.select("class", "path", _as_png()("image").alias("png"), _as_npy()("hl.hull").alias("hl"), _as_npy()("lr.hull").alias("lr"))
    cards = materialize(cards, "cards")
    ranks = ranking.shard_slots(ranking.ranked(cards.select("path"), [F.split("path", "/")]), shard_size)
    df = ranks.join(cards, "path")
    key = padded(F.col("rank") - 1, 8)
    payloads = zip(ROLES, (F.col("class").cast("binary"), F.col("png"), F.col("hl"), F.col("lr")))
    parts = F.posexplode(F.array(*[F.struct(F.lit(f".{role}").alias("ext"), p.alias("payload")) for role, p in payloads])).alias("part", "m")
    rows = df.select(F.concat(F.lit(f"{prefix}-"), padded(F.col("shard"), 4), F.lit(".tar")).alias("file"), key.alias("key"), "slot", parts)
    s.write_files(rows.select("file", F.concat("key", "m.ext").alias("name"), "m.payload", "slot", "part"), out, ["slot", "part"], replaces=prefix)
    return -(-ranks.count() // shard_size)


def _points(payload: Column) -> Column:
    """Hull payloads (K, 1, 2) or (K, 2) as points."""

    @F.arrow_udf(POINT_LIST)
    def read(payloads: pa.Array) -> pa.Array:
        return point_lists([png.decode_npy(p.as_py()).reshape(-1, 2).astype(np.float64) if p.is_valid else None for p in payloads])

    return read(payload)


def load_cards(spark: SparkSession, folder: str) -> DataFrame:
    """The class index of a shard folder: its classes are read, its images are not. No card at all is an error."""
    index = materialize(m.class_index(s.read_members(spark, folder, ["cls"])), "class-index")
    if index.isEmpty():
        raise ValueError("there are no cards in the shards")
    return index


def background_index(spark: SparkSession, folder: str) -> DataFrame:
    """background (from 0, in shard and member order) and where its member lies: the first image of each sample.

    Only headers are read. No image at all is an error.
    """
    df = m.runs(s.member_index(spark, folder), ["shard"], ["ord"])
    first = df.filter(F.col("ext").isin(*READ)).groupBy("shard", "run").agg(F.min(F.struct("ord", "key", "ext", "offset", "size")).alias("m"))
    ranks = ranking.ranked(first.select("shard", "run", "m.*"), [F.col("shard"), F.col("run")]).withColumnRenamed("index", "background").drop("run", "rank")
    if ranks.isEmpty():
        raise ValueError("there are 0 images in the shards")
    return ranks


def load_backgrounds(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """background and payload, as PNG, of all backgrounds or of those in `wanted` (background); no others are read."""
    index = background_index(spark, folder)
    return background_images(index if wanted is None else index.join(wanted.select("background").distinct(), "background", "left_semi"))


def background_images(index: DataFrame) -> DataFrame:
    """background and payload, as PNG, of rows of a background index."""
    return s.as_png(index).select("background", "payload")


def background_sample(index: DataFrame, seed: int, size: int) -> DataFrame:
    """One row of a background index, drawn by `seed` in one scan, as a PNG of `size` by `size`: background, payload."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(payload=[png.encode_png(pixels.resize(pixels.to_bgr(png.decode_png(p)), size, size)) for p in batch["payload"]])

    drawn = materialize(sampling.keyed_sample(index, seed, 1, ["background"]), "background")
    return background_images(drawn).mapInPandas(cut, "background long, payload binary")


def generate(
    spark: SparkSession,
    backgrounds: str,
    cards: str,
    out: str,
    count: int = 10,
    n_cards: int = 2,
    canvas: int = g.SCENE_SIZE,
    seed: int = 42,
    aug: sampling.AugmentRange | None = None,
    hidden: float = g.MAX_HIDDEN,
    draws: str = "sequence",
) -> DataFrame:
    """Scenes, label files and classes.txt into `out`; returns the labels. Pixels are fetched only where scenes are drawn.

    `aug`: ranges of turn, size and move; `hidden`: how much of a corner may lie under the next card; `draws`: `sequence`
    (generators in sequence, a million scenes at most) or `hashed` (any number of scenes, other draws).
    """
    if count < 1 or canvas < 64:
        raise ValueError("there is a scene at least, and a canvas of 64 at least")
    if draws not in ("sequence", "hashed"):
        raise ValueError("draws are `sequence` or `hashed`")
    index, grounds = load_cards(spark, cards), materialize(background_index(spark, backgrounds), "background-index")
    if draws == "hashed":
        plan = sampling.hashed_plan(spark, seed, count, n_cards, index, grounds.count(), aug)
    else:
        sizes = [r.n for r in index.groupBy("name").agg(F.count("*").alias("n")).orderBy("name").collect()]  # one row a class
        plan = sampling.scene_plan(spark, seed, count, n_cards, sizes, grounds.count(), aug)
    drawn = materialize(sampling.drawn_cards(plan, index), "drawn-cards")
    loaded = s.load_samples(spark, cards, drawn.select("shard", "key").distinct(), ROLES[1:])
    full = materialize(drawn.join(loaded.select("shard", "key", F.col("png"), F.col("`hull_hl.npy`").alias("hl"), F.col("`hull_lr.npy`").alias("lr")), ["shard", "key"]), "drawn")
    cards_df = full.drop("png").withColumnRenamed("name", "class").withColumns({"phl": _points(F.col("hl")), "plr": _points(F.col("lr"))})
    labels = materialize(scenes.corner_labels(scenes.placed(cards_df, canvas, F.col("phl"), F.col("plr")), canvas, hidden), "labels")

    def draw(keys, rows: pd.DataFrame, ground: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("z")
        layers = [pixels.placed_card(pixels.to_bgra(png.decode_png(r.png)), r.angle, r.scale, r.tx, r.ty, canvas) for r in rows.itertuples()]
        image = pixels.compose(png.decode_png(ground["payload"].iloc[0]), layers, canvas)
        return pd.DataFrame({"scene": [int(keys[0])], "payload": [png.encode_png(image)]})

    placed = plan.select("scene", "background").distinct()
    asked = placed.join(background_images(grounds.join(placed.select("background").distinct(), "background", "left_semi")), "background")
    images = full.select("scene", "z", "png", "angle", "scale", "tx", "ty").groupBy("scene").cogroup(asked.groupBy("scene")).applyInPandas(draw, "scene long, payload binary")
    names = ranking.dictionary(index.select(F.col("name").alias("class")), "class")
    texts = plan.select("scene").distinct().join(scenes.label_files(labels, names), "scene", "left")
    stem = F.concat(F.lit("scene_"), padded(F.col("scene"), 6))
    files = images.select(F.concat(stem, F.lit(".png")).alias("file"), F.lit(None).cast("string").alias("name"), "payload")
    texts = texts.select(F.concat(stem, F.lit(".txt")), F.lit(None).cast("string"), F.coalesce("text", F.lit("")).cast("binary"))
    s.write_files(united(files, texts, ranking.listed(names, "class").select(F.lit("classes.txt"), F.lit(None).cast("string"), F.col("text").cast("binary"))), out, [])
    return labels


def extract_cards(frames: DataFrame, min_focus: float = g.MIN_FOCUS, min_rectangularity: float = g.MIN_RECTANGULARITY) -> DataFrame:
    """Cards cut from rows (path, image): path, focus, rectangularity and PNG. Frames that give no card go."""
    df = cards_of.with_card(frames.filter("image IS NOT NULL").select("path", "image"), min_focus, min_rectangularity)
    return df.select("path", "focus", "rectangularity", contours.cut_out("image", "box", "target", "line").alias("png"))


random_sample = sampling.random_sample
__all__ = ["background_index", "background_sample", "extract_cards", "generate", "load_backgrounds", "load_cards", "pack_backgrounds", "pack_cards", "random_sample"]
