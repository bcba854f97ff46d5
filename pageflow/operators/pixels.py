"""Pixel statistics.  Kernels over decoded images are numpy in mapInPandas; those
over a page's value columns are plain aggregates and windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Limits of the blank score (fixed values).
LOW_ENTROPY, LOW_EDGES, EDGE_STEP = 3.5, 0.02, 30


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luma of Spark's image bytes (BGR, row by row)."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float32)
    return a[..., 0] if channels == 1 else 0.114 * a[..., 0] + 0.587 * a[..., 1] + 0.299 * a[..., 2]


def rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Red, green and blue of Spark's image bytes."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[..., 2::-1].copy()


def luma(rgb: np.ndarray) -> np.ndarray:
    return 0.299 * rgb[..., 0].astype(np.float32) + 0.587 * rgb[..., 1] + 0.114 * rgb[..., 2]


def blank_score(g: np.ndarray) -> tuple[float, float, float, bool]:
    """(score, entropy, edge density, blank): 1 for an empty crop, 0 for a busy one."""
    if g.size == 0:
        return 1.0, 0.0, 0.0, True
    p = np.bincount(g.astype(np.uint8).ravel(), minlength=256) / g.size
    entropy = float(-(p[p > 0] * np.log2(p[p > 0] + 1e-10)).sum())
    edges = float((np.abs(np.diff(g, axis=1)) > EDGE_STEP).sum() + (np.abs(np.diff(g, axis=0)) > EDGE_STEP).sum()) / (2 * g.size)
    blank = entropy < LOW_ENTROPY or edges < LOW_EDGES
    score = 1 - (0.6 * min(entropy / 8, 1) + 0.4 * min(10 * edges, 1))
    return (max(score, 0.7) if blank else score), entropy, edges, blank


def realism(g: np.ndarray, rgb: np.ndarray, least_edges: float = 0.05) -> tuple[float, float, float, bool]:
    """(variance, share that is no background, edge density, real picture)."""
    variance = float(g.var())
    content = float(1 - (rgb > 240).all(axis=-1).mean()) if g.size else 0.0
    edges = float((np.abs(np.diff(g, axis=1)) > EDGE_STEP).mean()) if g.size and g.shape[1] > 1 else 0.0
    return variance, content, edges, variance >= 500 and content >= 0.2 and edges >= least_edges


def grid_lines(g: np.ndarray, axis: int, threshold: float = 10.0) -> list[int]:
    """Rows (axis 0) or columns (axis 1) where the mean step to the next exceeds the threshold."""
    return [int(i) for i in np.flatnonzero(np.abs(np.diff(g, axis=axis)).mean(axis=1 - axis) > threshold)]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, end column) of each run of set pixels, row by row."""
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    padded[:, 1:-1] = mask
    steps = np.diff(padded, axis=1)
    rows, first = np.nonzero(steps == 1)
    return rows, first, np.nonzero(steps == -1)[1]


def _parts(rows: np.ndarray, first: np.ndarray, end: np.ndarray, width: int, diagonal: bool) -> np.ndarray:
    """The part that each run belongs to: the least run that it is joined to.

    Runs that meet in the row above are found by bisection; parts are joined by hooking
    each to the least neighbour and shortening the ways, until nothing changes."""
    span = width + 2
    above, sides = (rows - 1) * span, ("left", "right") if diagonal else ("right", "left")
    low = np.searchsorted(rows * span + end, above + first, sides[0])
    high = np.searchsorted(rows * span + first, above + end, sides[1])
    count = np.maximum(high - low, 0)
    mine = np.repeat(np.arange(len(rows)), count)
    theirs = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    part = np.arange(len(rows))
    while True:
        a, b = part[mine], part[theirs]
        apart = a != b
        if not apart.any():
            return part
        np.minimum.at(part, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not (part == (shorter := part[part])).all():
            part = shorter


def components(mask: np.ndarray, diagonal: bool = False) -> list[tuple[int, int, int, int, int]]:
    """Boxes (x0, y0, x1, y1, area) of the connected parts of a mask (by sides, or corners too)."""
    rows, first, end = _runs(mask)
    if not len(rows):
        return []
    names, part = np.unique(_parts(rows, first, end, mask.shape[1], diagonal), return_inverse=True)
    box = np.full((4, len(names)), mask.size, np.int64)
    box[2:] = 0
    area = np.zeros(len(names), np.int64)
    np.minimum.at(box[0], part, first)
    np.minimum.at(box[1], part, rows)
    np.maximum.at(box[2], part, end)
    np.maximum.at(box[3], part, rows + 1)
    np.add.at(area, part, end - first)
    return [tuple(map(int, b)) for b in zip(*box, area)]


def holding(mask: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The parts of a mask, joined by sides or corners, that hold a seed."""
    rows, first, end = _runs(mask)
    if not len(rows):
        return np.zeros_like(mask)
    part = _parts(rows, first, end, mask.shape[1], True)
    sums = np.concatenate([[0], np.cumsum((seeds & mask).ravel())])
    base = rows * mask.shape[1]
    seeded = np.zeros(len(rows), bool)
    seeded[part[sums[base + end] > sums[base + first]]] = True
    kept = seeded[part]
    steps = np.zeros((mask.shape[0], mask.shape[1] + 1), np.int8)
    steps[rows[kept], first[kept]] = 1
    np.subtract.at(steps, (rows[kept], end[kept]), 1)
    return np.cumsum(steps, axis=1, dtype=np.int8)[:, :-1] > 0


def foreground(g: np.ndarray, step: int = 25, background: int | None = None) -> np.ndarray:
    """What differs from the background, the most frequent gray if none is given, by more than a step."""
    if background is None:
        background = int(np.bincount(g.astype(np.uint8).ravel(), minlength=256).argmax())
    return np.abs(g - background) > step


def page_hash(g: np.ndarray, size: int = 64) -> str:
    """MD5 of a page shrunk, by means over equal parts, to ``size`` pixels at most a side."""
    height, width = (max(1, min(size, n)) for n in g.shape)
    rows, cols = (np.linspace(0, n, k + 1).astype(int)[:-1] for n, k in zip(g.shape, (height, width)))
    sums = np.add.reduceat(np.add.reduceat(g.astype(np.float64), rows, axis=0), cols, axis=1)
    counts = np.outer(np.diff([*rows, g.shape[0]]), np.diff([*cols, g.shape[1]]))
    return hashlib.md5((sums / counts).astype(np.uint8).tobytes(), usedforsecurity=False).hexdigest()


def padded_crop(rgb: np.ndarray, box: tuple[int, int, int, int], pad: int = 10, contrast: float = 1.0) -> np.ndarray:
    """A crop with a margin within the page, its contrast raised about its mean."""
    x0, y0, x1, y1 = box
    part = rgb[max(0, y0 - pad) : y1 + pad, max(0, x0 - pad) : x1 + pad]
    if contrast == 1.0 or not part.size:
        return part.copy()
    mean = part.mean()
    return np.clip((part - mean) * contrast + mean, 0, 255).astype(np.uint8)


def grid_lines_laddered(g: np.ndarray, threshold: float = 10.0) -> tuple[list[int], list[int]]:
    """Rows and columns of a grid: the first of three falling thresholds that finds two of each."""
    for limit in (threshold, max(5.0, threshold - 3), max(3.0, threshold // 2)):
        found = grid_lines(g, 0, limit), grid_lines(g, 1, limit)
        if min(map(len, found)) >= 2:
            return found
    return [], []


def crop_scores(images: DataFrame) -> DataFrame:
    """Blank and realism scores of crops: (key, image, x0, y0, x1, y1).

    A bad image gives a row with an error and no scores; it never fails the job."""

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in found:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    raw = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                    g = gray(r.data, r.height, r.width, r.channels)[r.y0 : r.y1, r.x0 : r.x1]
                    rows.append((r.key, *blank_score(g), *realism(g, raw[r.y0 : r.y1, r.x0 : r.x1]), None))
                except (ValueError, TypeError) as e:
                    rows.append((r.key, *[None] * 8, str(e)))
            yield pd.DataFrame(rows, columns=["key", "score", "entropy", "edges", "blank", "variance", "content", "gradient", "real", "error"])

    picked = images.select("key", F.col("image.data").alias("data"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), "x0", "y0", "x1", "y1")
    return picked.mapInPandas(run, "key string, score double, entropy double, edges double, blank boolean, variance double, content double, gradient double, real boolean, error string")


def value_blank_scores(values: DataFrame) -> DataFrame:
    """The blank score of value rows (key, i, value 0..255), by aggregates alone."""
    w = Window.partitionBy("key").orderBy("i")
    steps = values.withColumn("edge", F.when(F.abs(F.col("value") - F.lag("value").over(w)) > EDGE_STEP, 1).otherwise(0))
    bins = steps.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("edge").alias("e"))
    total = Window.partitionBy("key")
    share = F.col("n") / F.sum("n").over(total)
    t = bins.withColumn("p", share).groupBy("key").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
    edges = F.col("e") / (2 * F.col("n"))
    blank = (F.col("entropy") < LOW_ENTROPY) | (edges < LOW_EDGES)
    score = 1 - (0.6 * F.least(F.col("entropy") / 8, F.lit(1.0)) + 0.4 * F.least(10 * edges, F.lit(1.0)))
    return t.select("key", F.round("entropy", 6).alias("entropy"), F.round(edges, 6).alias("edge_density"), blank.alias("is_blank"), F.round(F.when(blank, F.greatest(score, F.lit(0.7))).otherwise(score), 6).alias("score"))


def local_minima(values: DataFrame) -> DataFrame:
    """Places (key, i, value) under half the median and no higher than those two off."""
    w = Window.partitionBy("key").orderBy("i")
    middle = values.groupBy("key").agg(F.percentile("value", F.lit(0.5)).alias("median"))
    t = values.withColumn("a", F.lag("value", 2).over(w)).withColumn("b", F.lead("value", 2).over(w)).join(middle, "key")
    return t.filter((F.col("value") < F.col("median") * 0.5) & (F.col("value") <= F.col("a")) & (F.col("value") <= F.col("b"))).select("key", "i", "value")


def content_bands(flags: DataFrame, least: int) -> DataFrame:
    """Runs of set flags (key, i, flag) longer than ``least``: first and last place."""
    w = Window.partitionBy("key").orderBy("i")
    runs = flags.withColumn("run", F.sum(F.when(F.col("flag") != F.coalesce(F.lag("flag").over(w), ~F.col("flag")), 1).otherwise(0)).over(w))
    bands = runs.filter("flag").groupBy("key", "run").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    return bands.filter(F.col("last") - F.col("first") + 1 > least).select("key", "first", "last")


def profile_peaks(values: DataFrame, gap: int = 50, share: float = 0.9) -> DataFrame:
    """Lines (key, line) where a profile (key, i, value) is over its 90th percentile; places
    less than ``gap`` from the last are one line, at their mean."""
    limit = values.groupBy("key").agg(F.percentile("value", F.lit(share)).alias("limit"))
    w = Window.partitionBy("key").orderBy("i")
    high = values.join(limit, "key").filter(F.col("value") > F.col("limit"))
    high = high.withColumn("_new", F.when(F.col("i") - F.lag("i").over(w) >= gap, 1).otherwise(0)).withColumn("grp", F.sum("_new").over(w))
    return high.groupBy("key", "grp").agg(F.avg("i").cast("int").alias("line")).select("key", "line")


def foreground_share(values: DataFrame, background: int = 188, step: int = 25) -> DataFrame:
    """Per cent of values (key, value) that differ from the background by more than a step."""
    return values.groupBy("key").agg(F.round(100.0 * F.count_if(F.abs(F.col("value") - background) > step) / F.count(F.lit(1)), 6).alias("foreground"))


def top_values(values: DataFrame, most: int = 5) -> DataFrame:
    """The most frequent values, the largest first on ties: a report."""
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("value")).limit(most)


def histogram(values: DataFrame, bins: int = 10, most: int = 256) -> DataFrame:
    return values.groupBy(F.floor(F.col("value") * bins / most).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
