"""Pixel kernels on numpy arrays, used inside Arrow batches: BGR(A) images of uint8, row-major."""

from __future__ import annotations

import numpy as np

from scenekiln.functions.geometry import CARD_HEIGHT, CARD_WIDTH, placement_offset

#: Shares of blue, green and red in luma, in 32768ths.
LUMA = np.array([3735, 19235, 9798])


def from_image(row) -> np.ndarray:
    """Spark's image struct as an array."""
    own = np.frombuffer(row["data"], np.uint8).reshape(int(row["height"]), int(row["width"]), int(row["nChannels"]))  # floats beside a null
    return own[:, :, 0] if own.shape[2] == 1 else own


def to_bgr(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return np.repeat(image[:, :, None], 3, axis=2)
    return np.ascontiguousarray(image[:, :, :3])


def to_bgra(image: np.ndarray) -> np.ndarray:
    """Opaque if there is no alpha."""
    if image.ndim == 3 and image.shape[2] == 4:
        return image
    bgr = to_bgr(image)
    return np.dstack([bgr, np.full(bgr.shape[:2], 255, np.uint8)])


def to_gray(image: np.ndarray) -> np.ndarray:
    """Luma of 0.114 B + 0.587 G + 0.299 R, rounded; in integers, as no rounding of floats then decides a tie."""
    return image if image.ndim == 2 else ((image[:, :, :3] @ LUMA + (1 << 14)) >> 15).astype(np.uint8)


def variance_of_laplacian(image: np.ndarray) -> float:
    """Focus: population variance of the Laplacian over all pixels and channels."""
    if image.ndim not in (2, 3):
        raise ValueError("an image has two or three axes")
    own = np.pad(image.astype(np.float64), [(1, 1), (1, 1)] + [(0, 0)] * (image.ndim - 2), mode="reflect")
    return float((own[:-2, 1:-1] + own[2:, 1:-1] + own[1:-1, :-2] + own[1:-1, 2:] - 4 * own[1:-1, 1:-1]).var())


def alpha_composite(base: np.ndarray, overlay: np.ndarray) -> np.ndarray:
    """A BGRA overlay on a BGR base."""
    alpha = overlay[:, :, 3:].astype(np.float32) / np.float32(255)
    mixed = overlay[:, :, :3] * alpha + base * (1 - alpha)
    return np.clip(mixed, 0, 255).astype(np.uint8)


def _weights(size: int, wanted: int) -> np.ndarray:
    """(wanted, size) shares of source pixels that each wanted pixel covers; between pixels where it enlarges."""
    scale = size / wanted
    if scale >= 1:
        left, right = np.arange(wanted)[:, None] * scale, (np.arange(wanted)[:, None] + 1) * scale
        at = np.arange(size)[None]
        return np.clip(np.minimum(right, at + 1) - np.maximum(left, at), 0, None) / scale
    at = np.clip((np.arange(wanted) + 0.5) * scale - 0.5, 0, size - 1)
    low = np.floor(at).astype(int)
    out = np.zeros((wanted, size))
    np.add.at(out, (np.arange(wanted), low), 1 - (at - low))
    np.add.at(out, (np.arange(wanted), np.minimum(low + 1, size - 1)), at - low)
    return out


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """By area where it shrinks."""
    own = image.astype(np.float64).reshape(*image.shape[:2], -1)
    out = np.einsum("yh,hwc,xw->yxc", _weights(image.shape[0], height), own, _weights(image.shape[1], width), optimize=True)
    return np.rint(out).clip(0, 255).astype(np.uint8).reshape(height, width, *image.shape[2:])


def _sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear samples; 0 outside."""
    padded = np.pad(image, [(1, 1), (1, 1), (0, 0)]).astype(np.float32)
    x, y = np.clip(x, -1, image.shape[1]) + 1, np.clip(y, -1, image.shape[0]) + 1
    x0, y0 = np.minimum(np.floor(x).astype(int), image.shape[1]), np.minimum(np.floor(y).astype(int), image.shape[0])
    fx, fy = (x - x0)[..., None].astype(np.float32), (y - y0)[..., None].astype(np.float32)
    top = padded[y0, x0] * (1 - fx) + padded[y0, x0 + 1] * fx
    low = padded[y0 + 1, x0] * (1 - fx) + padded[y0 + 1, x0 + 1] * fx
    return np.rint(top * (1 - fy) + low * fy).clip(0, 255).astype(np.uint8)


def warp_affine(image: np.ndarray, matrix: np.ndarray, size: int) -> np.ndarray:
    """`image` moved by a 2 x 3 matrix onto a square canvas, transparent outside."""
    inverse = np.linalg.inv(np.vstack([matrix, [0, 0, 1]]))
    x, y = np.meshgrid(np.arange(size), np.arange(size))
    return _sampled(image, inverse[0, 0] * x + inverse[0, 1] * y + inverse[0, 2], inverse[1, 0] * x + inverse[1, 1] * y + inverse[1, 2])


def placed_card(card: np.ndarray, angle: float, scale: float, tx: float, ty: float, canvas: int) -> np.ndarray:
    """A BGRA card turned, scaled and moved on a transparent canvas."""
    if card.shape != (CARD_HEIGHT, CARD_WIDTH, 4):
        raise ValueError("a card has the canonical size and four channels")
    place = max(canvas, CARD_HEIGHT, CARD_WIDTH)
    dx, dy = placement_offset(canvas)
    a, b = scale * np.cos(np.radians(angle)), scale * np.sin(np.radians(angle))
    mid, back = place / 2, (canvas - place) / 2
    move = np.array([[a, b, (1 - a) * mid - b * mid + back + tx * canvas], [-b, a, b * mid + (1 - a) * mid + back + ty * canvas]])
    move[:, 2] += move[:, :2] @ [dx, dy]  # the card itself stands for its place on the placement canvas
    return warp_affine(card, move, canvas)


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that sends four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def warp_perspective(image: np.ndarray, matrix: np.ndarray, width: int, height: int) -> np.ndarray:
    inverse = np.linalg.inv(matrix)
    x, y = np.meshgrid(np.arange(width), np.arange(height))
    u, v, w = (inverse[i, 0] * x + inverse[i, 1] * y + inverse[i, 2] for i in range(3))
    return _sampled(image, u / w, v / w)


def feather_mask(border: int = 2) -> np.ndarray:
    """Alpha of a cut-out card: opaque but for its border and for cut right-hand corners."""
    mask = np.full((CARD_HEIGHT, CARD_WIDTH), 255, np.uint8)
    mask[:border], mask[-border:], mask[:, :border], mask[:, -border:] = 0, 0, 0, 0
    y, x = np.mgrid[:CARD_HEIGHT, :CARD_WIDTH]
    corner = CARD_WIDTH - 3 * border
    mask[(x - corner > y - border / 2) | (x - corner > CARD_HEIGHT - 1 - y - border / 2)] = 0
    return mask


def compose(background: np.ndarray, cards: list[np.ndarray], canvas: int) -> np.ndarray:
    """Cards on a background, in order from back to front."""
    image = to_bgr(background)
    if image.shape[:2] != (canvas, canvas):
        image = resize(image, canvas, canvas)
    for card in cards:
        image = alpha_composite(image, card)
    return image
