"""Per-picture array helpers used inside Arrow batches."""

from __future__ import annotations

import numpy as np

from vecbank.settings import CHANNEL_MEAN, CHANNEL_STD, INPUT_SIDE


def to_rgb(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Spark image bytes (grey, BGR or BGRA) as an (h, w, 3) RGB array."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(pixels, 3, axis=2)
    return pixels[:, :, 2::-1]


def resize_weights(size: int, out: int) -> np.ndarray:
    """(out, size) weights of a bilinear resize whose triangle widens when the picture shrinks."""
    scale = size / out
    reach = max(scale, 1.0)
    centers = (np.arange(out) + 0.5) * scale
    gaps = np.abs(np.arange(size)[None, :] + 0.5 - centers[:, None]) / reach
    weights = np.clip(1.0 - gaps, 0.0, None)
    return weights / weights.sum(axis=1, keepdims=True)


def resize(picture: np.ndarray, side: int = INPUT_SIDE) -> np.ndarray:
    """Resize to (side, side, 3), first along the rows, each pass rounded to whole grey levels."""
    across = np.einsum("ow,hwc->hoc", resize_weights(picture.shape[1], side), picture.astype(np.float64))
    across = np.clip(np.floor(across + 0.5), 0, 255)
    down = np.einsum("oh,hwc->owc", resize_weights(picture.shape[0], side), across)
    return np.clip(np.floor(down + 0.5), 0, 255).astype(np.uint8)


def model_input(picture: np.ndarray) -> np.ndarray:
    """(3, side, side) in [0, 1]; the exported model normalises the channels itself."""
    return resize(picture).astype(np.float32).transpose(2, 0, 1) / np.float32(255.0)


def normalize_channels(batch: np.ndarray) -> np.ndarray:
    """(n, 3, side, side) in [0, 1] with the channel means removed and deviations divided out."""
    mean = np.array(CHANNEL_MEAN, dtype=np.float32).reshape(1, 3, 1, 1)
    std = np.array(CHANNEL_STD, dtype=np.float32).reshape(1, 3, 1, 1)
    return (batch - mean) / std


def _blend(a: np.ndarray, b: np.ndarray | float, factor: float) -> np.ndarray:
    return np.clip(factor * a + (1.0 - factor) * b, 0, 255)


def _grey(picture: np.ndarray) -> np.ndarray:
    return picture @ np.array([0.299, 0.587, 0.114])


def augment(picture: np.ndarray, seed: int) -> np.ndarray:
    """Random flip, rotation up to 10 degrees (nearest pixel, black border) and colour jitter of 20 %.

    All draws come from ``seed``, so a retried task repeats them.
    """
    rng = np.random.default_rng(seed & 0xFFFFFFFFFFFFFFFF)
    out = picture.astype(np.float64)
    if rng.random() < 0.5:
        out = out[:, ::-1]
    angle = np.deg2rad(rng.uniform(-10, 10))
    h, w = out.shape[:2]
    y, x = np.mgrid[0:h, 0:w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    from_x = np.rint(np.cos(angle) * (x - cx) - np.sin(angle) * (y - cy) + cx).astype(int)
    from_y = np.rint(np.sin(angle) * (x - cx) + np.cos(angle) * (y - cy) + cy).astype(int)
    inside = (from_x >= 0) & (from_x < w) & (from_y >= 0) & (from_y < h)
    turned = np.zeros_like(out)
    turned[inside] = out[from_y[inside], from_x[inside]]
    out = turned
    for step in rng.permutation(3):
        factor = rng.uniform(0.8, 1.2)
        if step == 0:
            out = _blend(out, 0.0, factor)
        elif step == 1:
            out = _blend(out, float(_grey(out).mean()), factor)
        else:
            out = _blend(out, _grey(out)[:, :, None], factor)
    return np.rint(out).astype(np.uint8)
