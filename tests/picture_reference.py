"""Whole-picture statistics of one picture in numpy, which the banded Spark form is held against."""

from __future__ import annotations

import numpy as np

from credence.operators.corpus import CHANNEL_STATS, IMAGE_FEATURES  # noqa: F401


def pixels(height: int, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, 3)


def gray_of(img: np.ndarray) -> np.ndarray:
    b, g, r = (img[:, :, i].astype(np.float64) for i in range(3))
    return np.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5)


def _padded(a: np.ndarray, by: int) -> np.ndarray:
    mode = "reflect" if min(a.shape) > by else "edge"
    return np.pad(a, by, mode=mode)


def laplacian(gray: np.ndarray) -> np.ndarray:
    p = _padded(gray, 1)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * gray


def smoothed(gray: np.ndarray) -> np.ndarray:
    weights = np.array([1, 4, 6, 4, 1]) / 16.0
    p = _padded(gray, 2)
    rows = sum(w * p[i : i + gray.shape[0], :] for i, w in enumerate(weights))
    both = sum(w * rows[:, i : i + gray.shape[1]] for i, w in enumerate(weights))
    return np.floor(both + 0.5)


def edge_share(gray: np.ndarray) -> float:
    """Share of pixels with a strong gradient, or a medium one beside a strong one.

    Two thresholds as in hysteresis edge detection; ridges are not thinned, so the share is higher
    than that of a thinned edge map.
    """
    p = _padded(gray, 1)
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    size = np.abs(gx) + np.abs(gy)
    strong, medium = size > 150, size > 50
    near = np.pad(strong, 1)
    beside = np.zeros_like(strong)
    for dy in range(3):
        for dx in range(3):
            beside |= near[dy : dy + strong.shape[0], dx : dx + strong.shape[1]]
    return float((strong | (medium & beside)).mean())


def saturation(img: np.ndarray) -> np.ndarray:
    top, low = img.max(axis=2).astype(np.float64), img.min(axis=2).astype(np.float64)
    return np.where(top > 0, np.floor(255 * (top - low) / np.maximum(top, 1) + 0.5), 0.0)


def hue(img: np.ndarray) -> np.ndarray:
    """Hue in half degrees, 0 to 179."""
    b, g, r = (img[:, :, i].astype(np.float64) for i in range(3))
    top, low = img.max(axis=2).astype(np.float64), img.min(axis=2).astype(np.float64)
    d = np.where(top > low, top - low, 1.0)
    h = np.where(top == r, (g - b) / d, np.where(top == g, 2 + (b - r) / d, 4 + (r - g) / d)) * 60
    return np.where(top > low, np.floor((h % 360) / 2 + 0.5) % 180, 0.0)


def blocks_of(gray: np.ndarray, size: int) -> list[np.ndarray]:
    h, w = gray.shape
    return [gray[y : y + size, x : x + size] for y in range(0, h - size, size) for x in range(0, w - size, size)]


def _texture(gray: np.ndarray) -> float:
    stds = [b.std() for b in blocks_of(gray, 16)]
    return float(np.mean(stds)) if stds else 0.0


def _clone_score(gray: np.ndarray) -> float:
    samples = [b[::6, ::6].tobytes() for b in blocks_of(gray, 48)]
    return float(min(100, (len(samples) - len(set(samples))) * 10))


_FEATURES = {
    "resolution": lambda img, gray: min(100.0, img.shape[1] * img.shape[0] / (800 * 600) * 100),
    "sharpness": lambda img, gray: min(100.0, float(laplacian(gray).var()) / 5),
    "edge_density": lambda img, gray: edge_share(gray) * 100,
    "white_ratio": lambda img, gray: float((gray > 245).mean()) * 100,
    "saturation": lambda img, gray: float(saturation(img).mean()),
    "texture": lambda img, gray: _texture(gray),
    "noise": lambda img, gray: float((gray - smoothed(gray)).std()),
    "clone_score": lambda img, gray: _clone_score(gray),
}


def describe(height: int, width: int, data: bytes, names: list[str] = IMAGE_FEATURES) -> list[float]:
    """The named pixel features of the classifier, by default all eight."""
    img = pixels(height, width, data)
    gray = gray_of(img)
    return [_FEATURES[n](img, gray) for n in names]


def _dark_level(gray: np.ndarray) -> float:
    """Threshold that separates dark and light pixels best (largest between-class variance)."""
    counts = np.bincount(gray.astype(np.int64).ravel(), minlength=256).astype(np.float64)
    below, levels = np.cumsum(counts), np.arange(256)
    mass, total = np.cumsum(counts * levels), counts.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = (mass[-1] * below / total - mass) ** 2 / (below * (total - below))
    return float(np.nanargmax(np.where(np.isfinite(spread), spread, -1)))


def channel_stats(height: int, width: int, data: bytes, seal_box: tuple[float, float, float, float] = (0.75, 0.95, 0.35, 0.65)) -> list[float]:
    """Statistics behind the security-feature rules; the seal box is given as shares of the image."""
    img = pixels(height, width, data)
    gray, sat = gray_of(img), saturation(img)
    header = img[0 : height // 4, width // 4 : 3 * width // 4].mean(axis=2)
    borders = [gray[0:50, :], gray[max(0, height - 50) : height, :], gray[:, 0:50], gray[:, max(0, width - 50) : width]]
    y0, y1, x0, x1 = seal_box
    seal = img[int(height * y0) : int(height * y1), int(width * x0) : int(width * x1)]
    ink = gray[gray <= _dark_level(gray)]
    return [
        float(img[:, :, 0].mean()) / (float(img[:, :, 2].mean()) + 1), float((header > 220).mean()), float(sat.std()), float(laplacian(gray).var()),
        float(np.mean([laplacian(r).var() for r in borders])), float(ink.std()) if ink.size > 100 else float("nan"),
        float(hue(seal).std()) if seal.size else 0.0, float(saturation(seal).mean()) if seal.size else 0.0, float(gray.var()),
    ]
