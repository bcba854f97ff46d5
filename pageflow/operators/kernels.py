"""Edge, threshold and drawing kernels on gray pixels (numpy, no image library)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pixels


def smooth(g: np.ndarray, size: int = 5, sigma: float = 1.4) -> np.ndarray:
    """Gaussian blur by two passes of one axis each."""
    at = np.arange(size) - size // 2
    k = np.exp(-(at**2) / (2 * sigma**2))
    k /= k.sum()
    for axis in (0, 1):
        padded = np.pad(g, [(size // 2,) * 2 if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        n, out = g.shape[axis], np.zeros_like(g)
        for i, x in enumerate(k.astype(g.dtype)):
            out += x * (padded[i : i + n] if axis == 0 else padded[:, i : i + n])
        g = out
    return g


def dilate(mask: np.ndarray, size: int = 3, times: int = 1) -> np.ndarray:
    """Any set neighbour in a square, as two passes of one axis each."""
    half = size // 2
    for _ in range(times):
        for axis in (0, 1):
            n = mask.shape[axis]
            padded = np.pad(mask, [(half, half) if a == axis else (0, 0) for a in (0, 1)])
            mask = np.zeros_like(mask)
            for i in range(size):
                mask |= padded[i : i + n] if axis == 0 else padded[:, i : i + n]
    return mask


def close(mask: np.ndarray, size: int) -> np.ndarray:
    """Gaps narrower than the square are filled; outside the page counts as unset."""
    by = size // 2
    wide = dilate(np.pad(mask, by), size)
    return ~dilate(~wide, size)[by : by + mask.shape[0], by : by + mask.shape[1]]


def edges(g: np.ndarray, low: float = 30, high: float = 100) -> np.ndarray:
    """Canny edges: thinned gradients over ``high``, and those over ``low`` joined to them."""
    if min(g.shape, default=0) < 2:
        return np.zeros(g.shape, bool)
    p = np.pad(smooth(g.astype(np.float32)), 1, mode="edge")
    rows, cols = p[:-2] + 2 * p[1:-1] + p[2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    dx, dy = rows[:, 2:] - rows[:, :-2], cols[2:] - cols[:-2]
    size = np.hypot(dx, dy)
    turn = (np.round(np.arctan2(dy, dx) / np.float32(np.pi / 4)) % 4).astype(np.int8)
    padded, thin = np.pad(size, 1), np.zeros(size.shape, bool)
    at = lambda down, right: padded[1 + down : 1 + down + size.shape[0], 1 + right : 1 + right + size.shape[1]]
    for k, (down, right) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        thin |= (turn == k) & (size >= at(down, right)) & (size > at(-down, -right))
    return pixels.holding(thin & (size >= low), size >= high)


def edge_regions(g: np.ndarray, low: float = 30, high: float = 100, times: int = 3, gap: int = 15) -> list[tuple[int, int, int, int, int]]:
    """Boxes (x0, y0, x1, y1, area) of what edges enclose once thickened and closed."""
    return sorted(pixels.components(close(dilate(edges(g, low, high), 3, times), gap)), key=lambda b: (b[1], b[0]))


def opened(mask: np.ndarray, size: int) -> np.ndarray:
    """Parts narrower than the square are taken away; outside the page counts as set."""
    by = size // 2
    thin = ~dilate(np.pad(~mask, by), size)
    return dilate(thin, size)[by : by + mask.shape[0], by : by + mask.shape[1]]


def background_regions(g: np.ndarray, step: int = 25, background: int | None = None, size: int = 5) -> list[tuple[int, int, int, int, int]]:
    """Boxes (x0, y0, x1, y1, area) of what differs from the background once closed and opened, largest first."""
    mask = opened(close(pixels.foreground(g, step, background), size), size)
    return sorted(pixels.components(mask, True), key=lambda b: (-b[4], b[1], b[0]))


def otsu(g: np.ndarray) -> int:
    """The gray level that parts dark from light with the largest variance between them."""
    n = np.bincount(g.astype(np.uint8).ravel(), minlength=256).astype(np.float64)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nan_to_num(spread).argmax())


def ink_box(g: np.ndarray, least_side: int = 30, least_ink: float = 0.1) -> tuple[int, int, int, int] | None:
    """The box around all dark pixels; None if it is small or nearly empty."""
    if not g.size:
        return None
    ink = g <= otsu(g)
    ys, xs = np.flatnonzero(ink.any(1)), np.flatnonzero(ink.any(0))
    if not len(ys):
        return None
    x0, y0, x1, y1 = int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1
    if x1 - x0 < least_side or y1 - y0 < least_side or ink[y0:y1, x0:x1].mean() < least_ink:
        return None
    return x0, y0, x1, y1


def draw_boxes(rgb: np.ndarray, boxes: list[tuple[int, int, int, int]], colors: list[tuple[int, int, int]], thick: int = 2) -> np.ndarray:
    """A copy of the page with box outlines in their colours."""
    out = rgb.copy()
    for (x0, y0, x1, y1), color in zip(boxes, colors):
        x0, y0 = max(0, x0), max(0, y0)
        for part in (out[y0 : y0 + thick, x0:x1], out[max(y0, y1 - thick) : y1, x0:x1], out[y0:y1, x0 : x0 + thick], out[y0:y1, max(x0, x1 - thick) : x1]):
            part[:] = color
    return out


def crop(rgb: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """The part of a page in a box, at least a pixel wide and high, within the page."""
    height, width = rgb.shape[:2]
    x0, y0 = min(max(0, box[0]), width - 1), min(max(0, box[1]), height - 1)
    return rgb[y0 : max(y0 + 1, box[3]), x0 : max(x0 + 1, box[2])]


def draw_line(rgb: np.ndarray, a: tuple[int, int], b: tuple[int, int], color: tuple[int, int, int], thick: int = 2) -> np.ndarray:
    """A copy of the page with a line between two places (x, y); what lies outside is left out."""
    out = rgb.copy()
    n = max(abs(a[0] - b[0]), abs(a[1] - b[1])) + 1
    xs, ys = (np.rint(np.linspace(a[k], b[k], n)).astype(int) for k in (0, 1))
    for down in range(thick):
        for right in range(thick):
            x, y = xs + right, ys + down
            on = (x >= 0) & (y >= 0) & (x < out.shape[1]) & (y < out.shape[0])
            out[y[on], x[on]] = color
    return out


#: Letters of labels: five rows from the top, each the octal digit of its three points (fixed values).
GLYPHS = {"0": "75557", "1": "26227", "2": "71747", "3": "71717", "4": "55711", "5": "74717", "6": "74757", "7": "71111", "8": "75757", "9": "75717", "#": "57575", "[": "64446", "]": "31113", "B": "65656", "P": "75744", "R": "65655", "T": "72222", " ": "00000"}


def draw_label(rgb: np.ndarray, at: tuple[int, int], label: str, color: tuple[int, int, int], size: int = 3) -> np.ndarray:
    """A copy of the page with a label at (x, y), moved into the page; letters without a glyph are blank."""
    points = np.zeros((5, 4 * len(label)), bool)
    for k, c in enumerate(label):
        for row, digit in enumerate(GLYPHS.get(c, GLYPHS[" "])):
            points[row, 4 * k : 4 * k + 3] = [int(digit) >> bit & 1 for bit in (2, 1, 0)]
    mask = points.repeat(size, 0).repeat(size, 1)
    out = rgb.copy()
    y, x = max(0, min(at[1], out.shape[0] - mask.shape[0])), max(0, min(at[0], out.shape[1] - mask.shape[1]))
    part = out[y : y + mask.shape[0], x : x + mask.shape[1]]
    part[mask[: part.shape[0], : part.shape[1]]] = color
    return out


def page_regions(images: DataFrame) -> DataFrame:
    """Edge regions of pages (page_id, image) in reading order; a bad page gives an error row."""
    box = "page_id string, ord int, x0 int, y0 int, x1 int, y1 int, area int, error string"

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in found:
            for r in batch.itertuples(index=False):  # a page's regions at a time
                try:
                    rows = [(r.page_id, i, *b, None) for i, b in enumerate(edge_regions(pixels.gray(r.data, r.height, r.width, r.channels)))]
                except (ValueError, TypeError) as e:
                    rows = [(r.page_id, *[None] * 6, str(e))]
                yield pd.DataFrame(rows, columns=["page_id", "ord", "x0", "y0", "x1", "y1", "area", "error"])

    return images.select("page_id", F.col("image.data").alias("data"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels")).mapInPandas(run, box)
