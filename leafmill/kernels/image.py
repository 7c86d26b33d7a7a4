"""Image kernels on grey or colour arrays (numpy), as the page stage uses them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Degrees: the usual search, the wide one where the usual ends at its edge, and the least turn worth making.
USUAL, WIDE, LEAST_TURN = 15.0, 45.0, 0.25
LEAST_HEIGHT = 1000


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 3:
        return (image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    return image.astype(np.uint8)


def median3(image: np.ndarray) -> np.ndarray:
    """3 x 3 median with the edge repeated."""
    p = np.pad(image, 1, mode="edge")
    h, w = image.shape
    return np.median(np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0).astype(np.uint8)


def brighten(image: np.ndarray, cut: float = 0.01) -> np.ndarray:
    """Contrast stretched so that the lightest ``cut`` of the pixels is white; the dark end only moves with the darkest pixel."""
    lo, hi = float(image.min()), float(np.quantile(image, 1 - cut))
    if hi <= lo:
        return image
    return np.clip((image.astype(np.float32) - lo) * (255.0 / (hi - lo)), 0, 255).astype(np.uint8)


def turn(image: np.ndarray, degrees: int) -> np.ndarray:
    """Exact quarter turns clockwise."""
    if degrees % 90:
        raise ValueError(f"{degrees} is no quarter turn")
    return np.ascontiguousarray(np.rot90(image, k=-(degrees // 90) % 4))


def rotate(image: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """Rotation about the centre by nearest neighbour, counter-clockwise for positive angles, canvas grown to fit."""
    a = np.deg2rad(degrees)
    h, w = image.shape[:2]
    c, s = np.cos(a), np.sin(a)
    nh, nw = int(np.ceil(abs(h * c) + abs(w * s))), int(np.ceil(abs(w * c) + abs(h * s)))
    y, x = np.mgrid[0:nh, 0:nw]
    y, x = y - (nh - 1) / 2, x - (nw - 1) / 2
    sx, sy = np.rint(c * x - s * y + (w - 1) / 2).astype(int), np.rint(s * x + c * y + (h - 1) / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full((nh, nw, *image.shape[2:]), fill, image.dtype)
    out[inside] = image[sy[inside], sx[inside]]
    return out


def _shrunk(image: np.ndarray, width: int) -> np.ndarray:
    step = max(1, int(np.ceil(image.shape[1] / width)))
    h, w = image.shape[0] // step * step, image.shape[1] // step * step
    return image[:h, :w].reshape(h // step, step, w // step, step).mean((1, 3)) if step > 1 else image


def _sharpness(ink: np.ndarray, weights: np.ndarray, degrees: float) -> float:
    """Variance of the ink per row after turning the ink's places by ``degrees``."""
    a = np.deg2rad(degrees)
    rows = np.rint(ink[:, 0] * np.cos(a) + ink[:, 1] * np.sin(a)).astype(int)
    return float(np.bincount(rows - rows.min(), weights).var())


def skew(image: np.ndarray) -> float:
    """Degrees a page must be turned (counter-clockwise) to stand straight; 0 for a blank page.

    Row profiles are sharpest at the right angle: whole degrees first, then fifths
    around the best; the wide search runs only where the usual one ends at its edge.
    """
    small = _shrunk(grey(image), 800).astype(np.float32)
    dark = 255.0 - small
    dark[dark < 64] = 0
    at = np.argwhere(dark > 0)
    if len(at) < 20:
        return 0.0
    weights = dark[at[:, 0], at[:, 1]]
    best = 0.0
    for reach in (USUAL, WIDE):
        coarse = np.arange(-reach, reach + 0.5, 1.0)
        coarse = coarse[np.argsort(np.abs(coarse), kind="stable")]
        best = float(max(coarse, key=lambda d: _sharpness(at, weights, d)))
        if abs(best) < reach:
            break
    fine = best + np.arange(-1.0, 1.01, 0.2)
    best = float(max(fine, key=lambda d: (_sharpness(at, weights, d), -abs(d))))
    return round(-max(-WIDE, min(WIDE, best)), 2) or 0.0


@dataclass
class Prepared:
    image: np.ndarray
    skew: float
    upscaled: float


def prepare(image: np.ndarray, deskew: bool = True, denoise: bool = True) -> Prepared:
    """Grey, median-filtered, brightened, straightened and, where too small, enlarged by whole steps."""
    g = grey(image)
    if denoise:
        g = median3(g)
    g = brighten(g)
    angle = skew(g) if deskew else 0.0
    if abs(angle) >= LEAST_TURN:
        g = rotate(g, angle)
    else:
        angle = 0.0
    scale = 1.0
    if g.shape[0] < LEAST_HEIGHT:
        scale = float(int(np.ceil(LEAST_HEIGHT / g.shape[0])))
        g = np.kron(g, np.ones((int(scale), int(scale)), np.uint8))
    return Prepared(g, angle, scale)


def preview(image: np.ndarray, width: int = 1100) -> np.ndarray:
    step = max(1, int(np.ceil(image.shape[1] / width)))
    return image[::step, ::step]
