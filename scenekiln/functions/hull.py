"""Convex hulls of point sets: beside their row, and as an aggregate over any number of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
#: Directions whose farthest points fence off the inside of a set, sets that are worth it, tasks that merge a group's hulls.
DIRECTIONS, FENCED, MERGERS = 16, 64, 64
_TURNS = np.arange(DIRECTIONS) * 2 * np.pi / DIRECTIONS
_ALONG = np.stack([np.cos(_TURNS), np.sin(_TURNS)])


def fenced(points: np.ndarray) -> np.ndarray:
    """The points less those strictly inside the polygon of the farthest ones in each direction, which are on no hull."""
    if len(points) <= FENCED:
        return points
    fence = points[np.argmax(points @ _ALONG, axis=0)]
    fence = fence[(fence != np.roll(fence, 1, axis=0)).any(axis=1)]
    if len(fence) < 3:
        return points
    a, d = fence, np.roll(fence, -1, axis=0) - fence
    slack = 1e-9 * np.abs(points).max() ** 2
    inside = ((d[:, 0, None] * (points[:, 1] - a[:, 1, None]) - d[:, 1, None] * (points[:, 0] - a[:, 0, None])) > slack).all(axis=0)
    return points[~inside]


def hull_of(points: np.ndarray) -> np.ndarray:
    """Corners of the hull of (N, 2) points, from the leftmost on, counter-clockwise for y up; no collinear ones."""
    own = np.unique(fenced(points), axis=0)
    if len(own) < 3:
        return own
    chains = []
    for side in (own.tolist(), own[::-1].tolist()):
        chain: list[list[float]] = []
        for x, y in side:
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2], chain[-1]
                if (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0:
                    break
                chain.pop()
            chain.append([x, y])
        chains += chain[:-1]
    return np.array(chains)


def flat_points(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each list of points begins and ends, and the points of all as (N, 2), without a Python object a point."""
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    own = lists.flatten()
    return np.r_[0, np.cumsum(sizes)], np.stack([np.asarray(own.field(i), np.float64) for i in (0, 1)], axis=1)


def point_lists(parts: list[np.ndarray | None]) -> pa.Array:
    """Lists of points as Arrow has them; None is null."""
    whole = np.concatenate([np.empty((0, 2)), *[p.reshape(-1, 2) for p in parts if p is not None]])
    offsets = np.r_[0, np.cumsum([0 if p is None else len(p) for p in parts])].astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(whole[:, 0]), pa.array(whole[:, 1])], ["x", "y"])
    lists = pa.ListArray.from_arrays(pa.array(offsets), values)
    gone = pa.array([p is None for p in parts], pa.bool_())
    return pc.if_else(gone, pa.nulls(len(parts), lists.type), lists) if any(p is None for p in parts) else lists


def _hulls(lists: pa.Array) -> pa.Array:
    begins, points = flat_points(lists)
    return point_lists([hull_of(points[a:b]) if ok else None for a, b, ok in zip(begins, begins[1:], lists.is_valid().to_pylist())])


@F.arrow_udf(T.ArrayType(POINT))
def convex_hull(points: pa.Array) -> pa.Array:
    """array<point> to the corners of its hull; null stays null."""
    return _hulls(points)


@F.arrow_udf(T.ArrayType(T.ArrayType(POINT)))
def convex_hulls(sets: pa.Array) -> pa.Array:
    """array<array<point>> to the hull of each."""
    sizes = np.asarray(sets.value_lengths().fill_null(0))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), _hulls(sets.flatten()))


# Marked so that no projection is folded into one that uses the hulls in a lambda, where Python functions cannot stand.
convex_hull, convex_hulls = convex_hull.asNondeterministic(), convex_hulls.asNondeterministic()


def hull_by(rows: DataFrame, by: list[str], x: Column, y: Column) -> DataFrame:
    """`by` and the hull of each group's points, as an aggregate: of any number of rows, however many one group has.

    Each batch of rows gives the hulls of what it has, those of a group are merged in a bounded number of tasks, and these
    give one row a group; so no group's points meet anywhere, only corners. Points with a null or NaN are none; a group
    without points is not there.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", x double, y double"
    points = rows.select(*[F.col(f"`{c}`") for c in by], x.cast("double").alias("x"), y.cast("double").alias("y"))
    points = points.filter(~(F.isnan("x") | F.isnan("y")) & F.col("x").isNotNull() & F.col("y").isNotNull())

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = hull_of(pdf[["x", "y"]].to_numpy())
        return pdf.iloc[[0] * len(hull)].assign(x=hull[:, 0], y=hull[:, 1])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.concat([corners(own) for _, own in batch.groupby(by, dropna=False, sort=False)])

    salted = points.mapInPandas(partial, schema).withColumn("__salt", F.pmod(F.xxhash64("x", "y"), F.lit(MERGERS)).cast("int"))
    merged = salted.groupBy(*by, "__salt").applyInPandas(corners, schema + ", __salt int")
    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = hull_of(pdf[["x", "y"]].to_numpy())
        return pdf.iloc[[0]][by].assign(hull=[[{"x": x, "y": y} for x, y in hull.tolist()]])

    named = schema.rpartition(", x double")[0]
    return merged.drop("__salt").groupBy(*by).applyInPandas(whole, f"{named}, hull array<struct<x:double,y:double>>")
