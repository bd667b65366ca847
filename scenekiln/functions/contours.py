"""Edges and outlines on numpy, for cutting cards from frames and finding corner symbols.

Arrow functions give the outlines of an image as lists of points beside its row; what they are measured and judged by are
Column functions (`geometry`, `operators.cards`). Written from the algorithms' published descriptions; results agree with other implementations to about a pixel, not to
the bit, and are tested with tolerances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenekiln.functions import geometry as g
from scenekiln.functions.hull import POINT, flat_points, point_lists
from scenekiln.functions.pixels import feather_mask, from_image, homography, to_bgra, to_gray, variance_of_laplacian, warp_perspective
from scenekiln.sources.png import encode_png

OUTLINES = T.ArrayType(T.ArrayType(POINT))


def bilateral(gray: np.ndarray, diameter: int = 11, sigma_colour: float = 17, sigma_space: float = 17) -> np.ndarray:
    """Smooths within a disc, little across edges."""
    r = diameter // 2
    own, total, weight = gray.astype(np.float64), np.zeros(gray.shape), np.zeros(gray.shape)
    padded = np.pad(own, r, mode="reflect")
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dx * dx + dy * dy <= r * r:
                near = padded[r + dy : r + dy + own.shape[0], r + dx : r + dx + own.shape[1]]
                w = np.exp(-((near - own) ** 2) / (2 * sigma_colour**2) - (dx * dx + dy * dy) / (2 * sigma_space**2))
                total += w * near
                weight += w
    return np.rint(total / weight).astype(np.uint8)


def canny(gray: np.ndarray, low: float, high: float) -> np.ndarray:
    """Thin edges: gradient maxima above `low` that hang together with one above `high`."""
    p = np.pad(gray.astype(np.float64), 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    size = np.abs(gx) + np.abs(gy)
    q = np.pad(size, 1)
    shift = lambda dy, dx: q[1 + dy : q.shape[0] - 1 + dy, 1 + dx : q.shape[1] - 1 + dx]
    flat, steep = np.abs(gy) <= 0.4142 * np.abs(gx), np.abs(gy) >= 2.4142 * np.abs(gx)
    same = gx * gy >= 0
    one = np.where(flat, shift(0, -1), np.where(steep, shift(-1, 0), np.where(same, shift(-1, -1), shift(-1, 1))))
    other = np.where(flat, shift(0, 1), np.where(steep, shift(1, 0), np.where(same, shift(1, 1), shift(1, -1))))
    peak = (size > one) & (size >= other) & (size > low)
    kept = peak & (size > high)
    while True:
        grown = peak & dilate(kept)
        if grown.sum() == kept.sum():
            return kept
        kept = grown


def dilate(mask: np.ndarray) -> np.ndarray:
    p = np.pad(mask, 1)
    h, w = mask.shape
    return np.logical_or.reduce([p[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)])


def _labels(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Connected parts numbered from 1 on, by passing on the smallest number."""
    out = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    far = mask.size + 1
    while True:
        p = np.pad(np.where(mask, out, far), 1, constant_values=far)
        least = out.copy()
        for dy, dx in [*steps, *((-a, -b) for a, b in steps)]:
            least = np.minimum(least, p[1 + dy : 1 + dy + mask.shape[0], 1 + dx : 1 + dx + mask.shape[1]])
        least = np.where(mask, least, 0)
        flat = np.concatenate([[0], least.ravel()])
        least = np.where(mask, flat[least], 0)  # follow pointers
        if (least == out).all():
            return least
        out = least


#: The eight neighbours, clockwise on screen from the east: (dy, dx).
_AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def outlines(mask: np.ndarray) -> list[np.ndarray]:
    """Outer borders of the connected parts as (N, 2) x, y: traced around, only where the direction turns."""
    numbers, found = _labels(mask, True), []
    for number in np.unique(numbers[numbers > 0]):
        part = np.pad(numbers == number, 1)
        y, x = (int(v) for v in np.argwhere(part)[0])
        path, at, back = [(y, x)], (y, x), 4
        while True:
            for turn in range(1, 9):
                d = (back + turn) % 8
                ny, nx = at[0] + _AROUND[d][0], at[1] + _AROUND[d][1]
                if part[ny, nx]:
                    break
            else:
                break
            if len(path) > 1 and at == path[0] and (ny, nx) == path[1]:
                path.pop()
                break
            at, back = (ny, nx), (d + 4) % 8
            path.append(at)
        points = np.array(path)[:, ::-1] - 1
        if len(points) > 2:
            before, after = points - np.roll(points, 1, axis=0), np.roll(points, -1, axis=0) - points
            points = points[(before != after).any(axis=1)]
        found.append(points)
    return found


def _filled(points: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels inside a polygon or on its border, by crossings of their row."""
    y, x = np.mgrid[:height, :width].astype(float)
    inside = np.zeros((height, width), bool)
    for (ax, ay), (bx, by) in zip(points, np.roll(points, -1, axis=0)):
        if ay != by:
            inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return dilate(inside) if inside.any() else inside


def _lists(found: list[list[np.ndarray]]) -> pa.Array:
    sizes = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), point_lists([line for f in found for line in f]))


def zone_outlines(zone: list[tuple[float, float]]):
    """Arrow function of images: the outlines of what stands in a zone, in the zone's pixels. A zone without extent has none."""
    (x0, y0), (x1, y1) = ((int(v) for v in zone[i]) for i in (0, 2))

    @F.arrow_udf(OUTLINES)
    def found(images: pa.Array) -> pa.Array:
        if x1 <= x0 or y1 <= y0:
            return _lists([[] for _ in images])
        return _lists([outlines(dilate(canny(to_gray(from_image(i.as_py())[y0:y1, x0:x1]), 30, 200))) if i.is_valid else [] for i in images])

    return found.asNondeterministic()  # see convex_hull


@F.arrow_udf(OUTLINES)
def mask_outlines(masks: pa.Array) -> pa.Array:
    """The outlines of square masks, given as lists of their pixels."""
    begins = np.r_[0, np.cumsum(np.asarray(masks.value_lengths().fill_null(0)))]
    pixels = np.asarray(masks.flatten()) != 0
    sides = np.sqrt(np.diff(begins)).astype(int)
    return _lists([outlines(pixels[a:b].reshape(n, n)) for a, b, n in zip(begins, begins[1:], sides)])


mask_outlines = mask_outlines.asNondeterministic()


@F.arrow_udf(OUTLINES)
def frame_outlines(images: pa.Array) -> pa.Array:
    """The outlines of a whole frame, smoothed before."""
    return _lists([outlines(canny(bilateral(to_gray(from_image(i.as_py()))), 30, 200)) if i.is_valid else [] for i in images])


@F.arrow_udf(T.DoubleType())
def focus(images: pa.Array) -> pa.Array:
    """Variance of the Laplacian of BGR frames; an image of other channels is an error."""
    out = []
    for image in images:
        own = image.as_py()
        if own is not None and own["nChannels"] != 3:
            raise ValueError("a frame is a BGR image of uint8")
        out.append(None if own is None else variance_of_laplacian(from_image(own)))
    return pa.array(out, pa.float64())


frame_outlines = frame_outlines.asNondeterministic()


@F.arrow_udf(T.BinaryType())
def cut_out(images: pa.Array, boxes: pa.Array, targets: pa.Array, lines: pa.Array) -> pa.Array:
    """PNG of the card whose corners are `boxes`, turned upright on the canonical canvas, with a feathered alpha inside its line."""
    (_, box), (_, target), (begins, line) = (flat_points(p) for p in (boxes, targets, lines))
    out = []
    for i, image in enumerate(images):
        matrix = homography(box[4 * i : 4 * i + 4], target[4 * i : 4 * i + 4])
        card = to_bgra(warp_perspective(from_image(image.as_py()), matrix, g.CARD_WIDTH, g.CARD_HEIGHT)).copy()
        own = line[begins[i] : begins[i + 1]]
        moved = np.column_stack([own, np.ones(len(own))]) @ matrix.T
        card[:, :, 3] = np.where(_filled(np.trunc(moved[:, :2] / moved[:, 2:]), g.CARD_WIDTH, g.CARD_HEIGHT), feather_mask(), 0)
        out.append(encode_png(card))
    return pa.array(out, pa.binary())
