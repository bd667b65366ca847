"""Registered queries that send small rasters, payloads and shards through the codecs, kernels and writers.

The kernels are numpy functions in Arrow batches; the SQL beside each query states the same result by plain arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenekiln.functions import geometry as g
from scenekiln.functions import contours, pixels
from scenekiln.functions.text import padded
from scenekiln.operators import members as m
from scenekiln.plans import shapes
from scenekiln.plans.registry import query
from scenekiln.plans.sql import with_shapes
from scenekiln.session import shared_path, table
from scenekiln.sources import png
from scenekiln.sources import shards as s
from scenekiln.sources.files import write_files

GRIDS = f"WITH {with_shapes('grids')}"


def _each(df: DataFrame, column: str, schema: str, use: Callable[[np.ndarray], tuple]) -> DataFrame:
    """vec_id and what `use` makes of the array in `column`."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([use(np.asarray(v)) for v in batch[column]], columns=names)
            yield found.assign(vec_id=batch["vec_id"].to_numpy())[["vec_id", *names]]

    return df.select("vec_id", column).mapInPandas(run, f"vec_id long, {schema}")


def _gray(grid: np.ndarray) -> np.ndarray:
    return grid.astype(np.uint8).reshape(8, 8)


def _coloured(grid: np.ndarray) -> np.ndarray:
    """A grid as blue, from its end as green, inverted as red."""
    return np.dstack([_gray(grid), _gray(grid[::-1]), 255 - _gray(grid)])


def _total(image: np.ndarray) -> int:
    """Sum of values by their places from 1, so that a value out of place shows."""
    flat = image.astype(np.int64).ravel()
    return int(flat @ np.arange(1, len(flat) + 1))


@query(f"""{GRIDS} SELECT vec_id, list_sum([(i + 1) * grid[i + 1] FOR i IN range(0, 64)])::BIGINT AS gray,
  list_sum([(3 * i + 1) * grid[i + 1] + (3 * i + 2) * grid[64 - i] + (3 * i + 3) * (255 - grid[i + 1]) FOR i IN range(0, 64)])::BIGINT AS bgr FROM grids""")
def png_roundtrip(spark, sf_dir):
    """Gray and BGR images written as PNG and read again."""
    again = lambda image: _total(png.decode_png(png.encode_png(image)))
    return _each(shapes.grids(spark, sf_dir), "grid", "gray long, bgr long", lambda v: (again(_gray(v)), again(_coloured(v))))


@query(f"{GRIDS} SELECT vec_id, 32 AS points, list_sum([(i + 1) * grid[i + 1] FOR i IN range(0, 64)])::BIGINT AS total FROM grids")
def npy_roundtrip(spark, sf_dir):
    """Hulls of shape (K, 1, 2) written as npy and read again."""

    def again(v: np.ndarray) -> tuple:
        hull = png.decode_npy(png.encode_npy(v.astype(np.int32).reshape(-1, 1, 2)))
        return hull.shape[0], _total(hull)

    return _each(shapes.grids(spark, sf_dir), "grid", "points int, total long", again)


@query(f"{GRIDS} SELECT vec_id, list_sum([(i + 1) * ((3735 * grid[i + 1] + 19235 * grid[64 - i] + 9798 * (255 - grid[i + 1]) + 16384) >> 15) FOR i IN range(0, 64)])::BIGINT AS total FROM grids")
def gray_levels(spark, sf_dir):
    """Luma of BGR pixels."""
    return _each(shapes.grids(spark, sf_dir), "grid", "total long", lambda v: (_total(pixels.to_gray(_coloured(v))),))


@query(f"""{GRIDS} SELECT vec_id, list_sum([(i + 1) * round_even((grid[i // 4 * 16 + i % 4 * 2 + 1] + grid[i // 4 * 16 + i % 4 * 2 + 2] + grid[i // 4 * 16 + i % 4 * 2 + 9] + grid[i // 4 * 16 + i % 4 * 2 + 10]) / 4, 0) FOR i IN range(0, 16)])::BIGINT AS total FROM grids""")
def area_resize(spark, sf_dir):
    """Grids at half their size: means of four pixels."""
    return _each(shapes.grids(spark, sf_dir), "grid", "total long", lambda v: (_total(pixels.resize(_gray(v), 4, 4)),))


def _at(row: str, col: str) -> str:
    return f"(CASE WHEN {row} < 0 OR {col} < 0 THEN 0 ELSE grid[({row}) * 8 + ({col}) + 1] END)"


def _beside(row: str) -> str:
    return f"({_at(row, 'i % 8 - 1')} + {_at(row, 'i % 8')})"


@query(f"{GRIDS} SELECT vec_id, list_sum([(i + 1) * round_even(({_beside('i // 8 - 1')} + 3 * {_beside('i // 8')}) / 8, 0) FOR i IN range(0, 64)])::BIGINT AS total FROM grids")
def affine_warp(spark, sf_dir):
    """Grids moved by half a pixel and a quarter, between pixels, with nothing outside."""
    move = np.array([[1.0, 0.0, 0.5], [0.0, 1.0, 0.25]])
    return _each(shapes.grids(spark, sf_dir), "grid", "total long", lambda v: (_total(pixels.warp_affine(_gray(v)[:, :, None], move, 8)),))


#: Grays above it stand out.
STANDS_OUT = 140


@query(f"""WITH RECURSIVE {with_shapes('grids')}, cells AS (SELECT vec_id, i, i // 8 AS y, i % 8 AS x FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(grid) AS v FROM grids) WHERE v > {STANDS_OUT}),
beside AS (SELECT a.vec_id, a.i, b.i AS j FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach AS (SELECT vec_id, i, i AS first FROM cells UNION SELECT r.vec_id, j, first FROM reach r JOIN beside n ON r.vec_id = n.vec_id AND r.i = n.i),
parts AS (SELECT vec_id, i, min(first) AS first FROM reach GROUP BY vec_id, i)
SELECT p.vec_id, p.first, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM parts p JOIN cells c ON p.vec_id = c.vec_id AND p.i = c.i GROUP BY p.vec_id, p.first""")
def grid_outlines(spark, sf_dir):
    """What stands out in each grid: where the outline of every connected part begins, and its box."""
    masks = shapes.grids(spark, sf_dir).select("vec_id", F.transform("grid", lambda v: (v > STANDS_OUT).cast("int")).alias("mask"))
    lines = masks.withColumn("lines", contours.mask_outlines("mask")).select("vec_id", F.explode("lines").alias("line"))
    end = lambda f, c: f(F.transform("line", lambda p: p[c])).cast("long").alias(c + ("min" if f is F.array_min else "max"))
    first = (F.col("line")[0]["y"] * 8 + F.col("line")[0]["x"]).cast("long")
    return lines.select("vec_id", first.alias("first"), *[end(f, c) for f in (F.array_min, F.array_max) for c in "xy"])


#: A square of side 100 whose corners are moved by up to 20.
SQUARE = g.rectangle(0, 0, 100, 100)
_Q = ", ".join(f"{{'x': {float(x)}::DOUBLE + 20 * embedding[{2 * i + 1}]::DOUBLE, 'y': {float(y)}::DOUBLE + 20 * embedding[{2 * i + 2}]::DOUBLE}}" for i, (x, y) in enumerate(SQUARE))


def _cross(a: int, b: int, c: int, d: int) -> str:
    return f"((q[{b}].x - q[{a}].x) * (q[{d}].y - q[{c}].y) - (q[{b}].y - q[{a}].y) * (q[{d}].x - q[{c}].x))"


@query(f"""WITH quads AS (SELECT vec_id, [{_Q}] AS q FROM embeddings), t AS (SELECT vec_id, q, {_cross(1, 2, 2, 4)} / {_cross(1, 3, 2, 4)} AS t FROM quads)
SELECT vec_id, round(q[1].x + t * (q[3].x - q[1].x), 4) AS x, round(q[1].y + t * (q[3].y - q[1].y), 4) AS y FROM t""")
def perspective_centre(spark, sf_dir):
    """Where the perspective that takes a square to a quadrangle puts its centre: on both diagonals."""

    def centre(v: np.ndarray) -> tuple:
        x, y, w = pixels.homography(SQUARE, np.array(SQUARE) + 20 * v[:8].reshape(4, 2)) @ (50, 50, 1)
        return float(x / w), float(y / w)

    df = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return _each(df, "e", "x double, y double", centre).select("vec_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(f"""SELECT y, count(*) FILTER (x BETWEEN 2 AND {g.CARD_WIDTH - 3} AND y BETWEEN 2 AND {g.CARD_HEIGHT - 3} AND x - {g.CARD_WIDTH - 6} <= least(y, {g.CARD_HEIGHT - 1} - y) - 1) AS opaque
FROM range({g.CARD_HEIGHT}) r(y), range({g.CARD_WIDTH}) c(x) GROUP BY y""")
def feather_rows(spark, sf_dir):
    """Opaque pixels in each row of a cut-out card's mask."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            opaque = (pixels.feather_mask() == 255).sum(axis=1)
            yield pd.DataFrame({"y": np.arange(len(opaque)), "opaque": opaque})

    return spark.range(1, numPartitions=1).mapInPandas(rows, "y long, opaque long")


#: Parts of a shard, and lines of a file: shards and files grow in number with the table.
SHARD_PARTS, FILE_LINES = 128, 16
PACKED = f"WITH {with_shapes('part_members')}, packed AS (SELECT printf('parts-%04d.tar', key::BIGINT // {SHARD_PARTS}) AS shard, ord, key, ext, payload FROM part_members)"


@query(f"{PACKED} SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY ord) - 1 AS ord, key, ext, payload FROM packed")
def shard_roundtrip(spark, sf_dir):
    """Members written to tar shards and read again, each in its place."""
    members = s.read_members(spark, part_shards(spark, sf_dir))
    return members.select(F.substring_index("shard", "/", -1).alias("shard"), "ord", "key", "ext", F.col("payload").cast("string").alias("payload"))


def part_shards(spark, sf_dir) -> str:
    """A folder of tar shards with four members a part."""
    folder = shared_path(spark, "shards")
    df = shapes.part_members(spark, sf_dir)
    number = F.floor(F.col("key").cast("long") / SHARD_PARTS)
    file, name = F.concat(F.lit("parts-"), padded(number, 4), F.lit(".tar")), F.concat_ws(".", "key", "ext")
    write_files(df.select(file.alias("file"), name.alias("name"), F.col("payload").cast("binary").alias("payload"), "ord"), folder, ["ord"])
    return folder


@query(f"{PACKED} SELECT shard, count(*) AS members, sum(length(payload))::BIGINT AS bytes FROM packed GROUP BY shard")
def shard_listing(spark, sf_dir):
    """The shards of a folder in the order of their names, with members and bytes as their headers say."""
    index = s.member_index(spark, part_shards(spark, sf_dir))
    return index.groupBy(F.substring_index("shard", "/", -1).alias("shard")).agg(F.count("*").alias("members"), F.sum("size").alias("bytes"))


@query(f"{PACKED} SELECT trim(payload, ' ' || chr(9) || chr(10)) AS name, shard, key FROM packed WHERE ext = 'cls'")
def shard_class_index(spark, sf_dir):
    """Where each class's samples are in real shards, of which only headers and classes are read."""
    index = m.class_index(s.read_members(spark, part_shards(spark, sf_dir), ["cls"]))
    return index.select("name", F.substring_index("shard", "/", -1).alias("shard"), "key")


@query(f"SELECT p_brand AS name, printf('parts-%04d.tar', p_partkey // {SHARD_PARTS}) AS shard, printf('%08d', p_partkey) AS key, p_name AS png, p_type AS hull_hl FROM part")
def shard_sample_lookup(spark, sf_dir):
    """Every sample, each member one read of its byte range."""
    folder = part_shards(spark, sf_dir)
    wanted = m.class_index(s.read_members(spark, folder, ["cls"]))
    found = s.load_samples(spark, folder, wanted, ["png", "hull_hl.npy", "hull_lr.npy"])
    return found.select("name", F.substring_index("shard", "/", -1).alias("shard"), "key", F.col("png").cast("string").alias("png"), F.col("`hull_hl.npy`").cast("string").alias("hull_hl"))


@query(f"SELECT p_partkey // {FILE_LINES} AS scene, string_agg(p_name || chr(10), '' ORDER BY p_partkey) AS text FROM part GROUP BY 1")
def files_roundtrip(spark, sf_dir):
    """Text files written one a scene and read again."""
    folder = shared_path(spark, "files")
    lines = F.array_sort(F.collect_list(F.struct("p_partkey", "p_name")))
    texts = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / FILE_LINES).alias("scene")).agg(F.array_join(F.transform(lines, lambda r: F.concat(r["p_name"], F.lit("\n"))), "").alias("text"))
    file = F.concat(F.lit("scene_"), padded(F.col("scene"), 6), F.lit(".txt"))
    write_files(texts.select(file.alias("file"), F.lit(None).cast("string").alias("name"), F.col("text").cast("binary").alias("payload")), folder, [])
    found = spark.read.format("binaryFile").load(folder)
    return found.select(F.regexp_extract("path", r"scene_(\d+)\.txt$", 1).cast("long").alias("scene"), F.col("content").cast("string").alias("text"))
