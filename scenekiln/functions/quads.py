"""What rectangles that were turned, sized and moved leave of each other in sight, for whole Arrow batches at once.

Cards and corner zones stay rectangles on the canvas, so what two of them share follows from the parts of either's edges
that lie inside the other (Green's theorem), without a polygon a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenekiln.functions import geometry as g

Quads = tuple[np.ndarray, np.ndarray]  # x and y, each of shape (4, N)


def moved(matrix: list[np.ndarray], points: list[tuple[float, float]]) -> Quads:
    """Four points under each row's matrix (a, b, dx, dy)."""
    a, b, dx, dy = matrix
    return np.stack([a * x + b * y + dx for x, y in points]), np.stack([-b * x + a * y + dy for x, y in points])


def areas(q: Quads) -> np.ndarray:
    x, y = q
    nx, ny = np.roll(x, -1, axis=0), np.roll(y, -1, axis=0)
    return np.abs((x * ny - nx * y).sum(axis=0) / 2)


def _border(p: Quads, q: Quads, both_once: bool) -> np.ndarray:
    """Twice what the parts of p's edges inside q add to the area. `both_once`: an edge that lies on one of q's is left out."""
    (px, py), (qx, qy) = p, q
    start, end = np.zeros_like(px), np.ones_like(px)
    for j in range(4):
        k = (j + 1) % 4
        d = (qx[k] - qx[j]) * (py - qy[j]) - (qy[k] - qy[j]) * (px - qx[j])
        e = np.roll(d, -1, axis=0)
        out = (d <= 0) & (e <= 0) if both_once else (d < 0) & (e < 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            met = d / (d - e)
        start = np.maximum(start, np.where(out, 2.0, np.where(d < 0, met, 0.0)))
        end = np.minimum(end, np.where((e < 0) & (d >= 0), met, 1.0))
    wx, wy = np.roll(px, -1, axis=0) - px, np.roll(py, -1, axis=0) - py
    ax, ay, bx, by = px + start * wx, py + start * wy, px + end * wx, py + end * wy
    return np.where(start < end, ax * by - bx * ay, 0.0).sum(axis=0)


def shared(p: Quads, q: Quads) -> np.ndarray:
    """Area that convex quads share, both with the same way round as the card on screen."""
    near = np.ones(p[0].shape[1], bool)
    for own, other in zip(p, q):
        near &= (own.min(axis=0) <= other.max(axis=0)) & (own.max(axis=0) >= other.min(axis=0))
    out = np.zeros(len(near))
    if near.any():
        at = [c[:, near].mean(axis=0) for c in p]  # near the origin products lose less
        p, q = (tuple(c[:, near] - m for c, m in zip(one, at)) for one in (p, q))
        out[near] = np.abs(_border(p, q, False) + _border(q, p, True)) / 2
    return out


#: What is known of a corner zone: the share in sight, and its smallest and largest x and y.
KNOWN = ("seen", "x0", "x1", "y0", "y1")


def zones_in_sight(matrix: list[Column], later: list[Column], canvas: int) -> Column:
    """KNOWN of both corner zones of a card, `hl` and `lr`. `seen` is the share that the card of matrix `later` leaves in
    sight: null where a number is null, or where a zone or the later card has no area."""
    dx, dy = g.placement_offset(canvas)
    hl, lr, outline = [[(x + dx, y + dy) for x, y in quad] for quad in (g.CORNER_HL, g.CORNER_LR, g.CARD_QUAD)]
    zone = T.StructType([T.StructField(n, T.DoubleType()) for n in KNOWN])

    @F.arrow_udf(T.StructType([T.StructField(n, zone) for n in ("hl", "lr")]))
    def judged(a: pa.Array, b: pa.Array, x: pa.Array, y: pa.Array, la: pa.Array, lb: pa.Array, lx: pa.Array, ly: pa.Array) -> pa.Array:
        given = (a, b, x, y, la, lb, lx, ly)
        values = [np.asarray(pc.fill_null(c, 0.0)) for c in given]
        there = [np.asarray(c.is_valid()) for c in given]
        card = moved(values[4:], outline)
        both = np.logical_and.reduce(there) & (areas(card) != 0)
        out = []
        for points in (hl, lr):
            quad = moved(values[:4], points)
            area = areas(quad)
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = pa.array((area - shared(quad, card)) / area, mask=~(both & (area != 0)))
            ends = [pa.array(f(c, axis=0), mask=~(there[0] & there[1] & there[i])) for i, c in zip((2, 3), quad) for f in (np.min, np.max)]
            out.append(pa.StructArray.from_arrays([seen, *ends], list(KNOWN)))
        return pa.StructArray.from_arrays(out, ["hl", "lr"])

    return judged(*matrix, *later)
