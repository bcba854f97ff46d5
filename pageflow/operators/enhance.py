"""Pages and crops made clearer before they are read: thresholds, smoothing of noise, sharpening (numpy)."""

from __future__ import annotations

import numpy as np

from . import kernels

#: Neighbourhoods of the threshold and of the noise filter, and their strengths (fixed values).
BLOCK, OFFSET, PATCH, SEARCH, STRENGTH, CONTRAST = 11, 2, 7, 21, 10, 1.5


def adaptive(g: np.ndarray, block: int = BLOCK, offset: float = OFFSET) -> np.ndarray:
    """Black and white by each pixel's Gaussian neighbourhood: black where it lies below by more than the offset."""
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    return np.where(g > kernels.smooth(g.astype(np.float32), block, sigma) - offset, 255, 0).astype(np.float32)


def box_mean(a: np.ndarray, size: int) -> np.ndarray:
    """Means over squares that lie wholly within the array."""
    sums = np.pad(np.cumsum(np.cumsum(a, axis=0, dtype=np.float64), axis=1), ((1, 0), (1, 0)))
    return (sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]) / size**2


def denoised(g: np.ndarray, strength: float = STRENGTH, patch: int = PATCH, search: int = SEARCH, band: int = 256) -> np.ndarray:
    """Non-local means: each pixel becomes the mean of those around it, weighted by how alike
    their patches are.  Works in bands of rows, so that its memory is bounded by their width."""
    half, reach = patch // 2, search // 2
    padded = np.pad(g.astype(np.float64), half + reach, mode="reflect") if min(g.shape) > half + reach else np.pad(g.astype(np.float64), half + reach, mode="edge")
    out = np.empty(g.shape)
    for top in range(0, g.shape[0], band):
        rows = min(band, g.shape[0] - top)
        part = padded[top : top + rows + 2 * (half + reach)]
        at = lambda down, right, by: part[reach + down - by + half : reach + down + by + half + rows, reach + right - by + half : reach + right + by + half + g.shape[1]]  # noqa: E731, B023
        own = at(0, 0, half)
        total, weights = np.zeros((rows, g.shape[1])), np.zeros((rows, g.shape[1]))
        for down in range(-reach, reach + 1):
            for right in range(-reach, reach + 1):
                w = np.exp(-box_mean((at(down, right, half) - own) ** 2, patch) / strength**2)
                total += w * at(down, right, 0)
                weights += w
        out[top : top + rows] = total / weights
    return np.rint(out).astype(np.float32)


def filtered(a: np.ndarray, middle: float, side: float, scale: float = 1.0) -> np.ndarray:
    """Each pixel weighed against its eight neighbours; the border stays as it is."""
    x = a.astype(np.float32)
    out = x.copy()
    if min(x.shape[:2]) > 2:
        rows = x[:-2] + x[1:-1] + x[2:]
        around = rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:] - x[1:-1, 1:-1]
        out[1:-1, 1:-1] = np.clip((middle * x[1:-1, 1:-1] + side * around) / scale, 0, 255)
    return out


def prepared(g: np.ndarray) -> np.ndarray:
    """A gray page for a second reading: black and white, without noise, sharpened, with more contrast."""
    if not g.size:
        return g.astype(np.uint8)
    sharp = filtered(denoised(adaptive(g)), 9, -1)
    mean = np.floor(sharp.mean() + 0.5)
    return np.clip((sharp - mean) * CONTRAST + mean, 0, 255).astype(np.uint8)


def sharpened(rgb: np.ndarray) -> np.ndarray:
    """A crop with its edges raised, then sharpened."""
    return np.rint(filtered(filtered(rgb, 10, -1, 2), 32, -2, 16)).astype(np.uint8)


def _cross(mask: np.ndarray, times: int) -> np.ndarray:
    for _ in range(times):
        p = np.pad(mask, 1)
        mask = p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
    return mask


def mended(mask: np.ndarray) -> np.ndarray:
    """A mask with gaps closed by two steps to the sides, then specks opened by one; outside counts as unset."""
    worn = lambda m, times: ~_cross(np.pad(~m, times, constant_values=True), times)[times:-times, times:-times]
    return _cross(worn(worn(_cross(mask.astype(bool), 2), 2), 1), 1)
