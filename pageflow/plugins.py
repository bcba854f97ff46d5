"""Model-backed steps as plugins; a stored-result engine stands in offline."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sinks
from .operators import enhance, kernels, pixels

#: A decoded image's pixels and size.
_IMAGE = "image.data AS data", "image.height AS height", "image.width AS width", "image.nChannels AS channels"


class OcrEngine(Protocol):
    """Built once a Python worker."""

    def tokens(self, content: bytes) -> list[tuple[str, float, tuple[int, int, int, int]]]:
        """(text, confidence, box) of each token of an encoded image."""


class PageRenderer(Protocol):
    def count(self, content: bytes) -> int:
        """Pages of a document."""

    def pages(self, content: bytes, dpi: int) -> list[tuple[str, bytes]]:
        """(page id, encoded image) of each page of a document."""


class PictureDetector(Protocol):
    def pictures(self, gray: np.ndarray) -> list[tuple[float, tuple[int, int, int, int]]]:
        """(confidence, box) of each picture of a gray page.  A detector with ``in_color`` set
        is given the page's colours instead."""


class Chain:
    """Engines tried in order: the first that can be built and finds something answers.

    An engine that can't be built is left out for good; one that fails on a page is passed
    over.  Only if all that were asked failed does the last error go on."""

    def __init__(self, *makers):
        self.makers, self.built = makers, None

    def _engines(self) -> list:
        if self.built is None:
            self.built = []
            for make in self.makers:
                try:
                    self.built.append(make())
                except Exception:  # a missing library or model
                    continue
        return self.built

    def _first(self, name: str, *args) -> list:
        error, answered = None, False
        for engine in self._engines():
            try:
                if found := getattr(engine, name)(*args):
                    return found
                answered = True
            except Exception as e:  # the next engine may do
                error = e
        if error and not answered:
            raise error
        return []

    def tokens(self, content: bytes) -> list:
        return self._first("tokens", content)

    def pictures(self, gray: np.ndarray) -> list:
        return self._first("pictures", gray)


class EdgeDetector:
    """Pictures as regions that edges enclose."""

    def __init__(self, least: int = 1000):
        self.least = least

    def pictures(self, gray: np.ndarray) -> list:
        return [(0.7, b[:4]) for b in kernels.edge_regions(gray, 50, 150, 2, 3) if (b[2] - b[0]) * (b[3] - b[1]) >= self.least]


class GridDetector:
    """Pictures as the upper parts of an estimated grid's cells that aren't plain."""

    def pictures(self, gray: np.ndarray) -> list:
        height, width = gray.shape
        cols, rows = max(1, min(4, width // 300)), max(1, min(6, height // 300))
        w, h, out = width // cols, height // rows, []
        for r in range(rows):
            for c in range(cols):
                box = c * w + 10, r * h + 10, (c + 1) * w - 10, r * h + int(h * 0.65)
                part = gray[box[1] : box[3], box[0] : box[2]]
                if part.size and part.std() >= 20:
                    out.append((0.5, box))
        return out


class Real:
    """A detector's pictures without those that look like a plain surface or have few edges."""

    in_color = True

    def __init__(self, detector, least_edges: float = 0.05):
        self.detector, self.least = detector, least_edges

    def pictures(self, rgb: np.ndarray) -> list:
        g = pixels.luma(rgb)
        found = self.detector.pictures(rgb if getattr(self.detector, "in_color", False) else g)
        return [(c, b) for c, b in found if pixels.realism(g[b[1] : b[3], b[0] : b[2]], rgb[b[1] : b[3], b[0] : b[2]], self.least)[3]]


def run_detector(images: DataFrame, make) -> DataFrame:
    """Pictures (page_id, ord, confidence, box) of decoded pages (page_id, image); a page that
    fails gives one error row.  ``make`` builds the detector in the worker."""

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = make()
        for batch in found:
            for r in batch.itertuples(index=False):
                try:
                    decode = pixels.rgb if getattr(detector, "in_color", False) else pixels.gray
                    got = detector.pictures(decode(r.data, r.height, r.width, r.channels))
                    rows = [(r.page_id, i, float(c), dict(zip(("x0", "y0", "x1", "y1"), map(int, b))), None) for i, (c, b) in enumerate(got)]
                except Exception as e:  # a bad page must not fail the job
                    rows = [(r.page_id, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["page_id", "ord", "confidence", "box", "error"])

    return images.selectExpr("page_id", *_IMAGE).mapInPandas(run, "page_id string, ord int, confidence double, box struct<x0:int,y0:int,x1:int,y1:int>, error string")


_TOKENS = "page_id string, ord int, text string, confidence double, box struct<x0:int,y0:int,x1:int,y1:int>, error string"


def run_ocr(pages: DataFrame, make, attempts: int = 2) -> DataFrame:
    """Tokens of pages (page_id, content) or decoded ones (page_id, image); a page whose last
    attempt fails gives one error row.

    ``make`` builds the engine in the worker.  From the second attempt on a decoded page is
    cleaned up first (enhance.prepared); an encoded one is asked again as it is."""
    decoded = "image" in pages.columns

    def tries(content, image):
        """What each attempt shows the engine."""
        if image is None:
            yield from [content] * attempts
            return
        page = pixels.rgb(*image)
        yield sinks.png(page)
        if attempts > 1:
            better = sinks.png(enhance.prepared(pixels.luma(page)))
            yield from [better] * (attempts - 1)

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        for batch in found:
            for r in batch.itertuples(index=False):  # a page's tokens at a time
                got, error = [], None
                for shown in tries(*((None, (r.data, r.height, r.width, r.channels)) if decoded else (r.content, None))):
                    try:
                        got, error = engine.tokens(shown), None
                    except Exception as e:  # a bad page must not fail the job
                        got, error = [], str(e)
                    if got:
                        break
                rows = [(r.page_id, i, t, c, dict(zip(("x0", "y0", "x1", "y1"), b)), None) for i, (t, c, b) in enumerate(got)]
                if error:
                    rows.append((r.page_id, None, None, None, None, error))
                yield pd.DataFrame(rows, columns=["page_id", "ord", "text", "confidence", "box", "error"])

    picked = pages.selectExpr("page_id", *_IMAGE) if decoded else pages.select("page_id", "content")
    return picked.mapInPandas(run, _TOKENS)


class Segmenter(Protocol):
    def masks(self, rgb: np.ndarray, box: tuple[int, int, int, int]) -> list[np.ndarray]:
        """Masks of the page for what a box holds."""


def segment(rgb: np.ndarray, box: tuple[int, int, int, int], engine, name: str = "segmenter") -> tuple[str, np.ndarray]:
    """(method, pixels) of a single word's crop: the largest mask's part of the page with the
    mask as alpha; without a mask the box with a margin, sharpened; if that fails, the box."""
    try:
        found = engine.masks(rgb, box) if engine is not None else []
    except Exception:  # the box stands in
        found = []
    if found:
        mask = enhance.mended(max(found, key=lambda m: int(m.sum())))
        ys, xs = np.nonzero(mask)
        if len(xs):
            y, x = slice(max(0, ys.min() - 5), ys.max() + 6), slice(max(0, xs.min() - 5), xs.max() + 6)
            return name, np.dstack([rgb[y, x], mask[y, x].astype(np.uint8) * 255])
    try:
        return "bbox_fallback_enhanced", enhance.sharpened(pixels.padded_crop(rgb, box, 5))
    except Exception:  # the plain box still serves
        return "bbox_fallback", kernels.crop(rgb, box)


def run_segmenter(words: DataFrame, make=None, name: str = "segmenter") -> DataFrame:
    """Crops (page_id, segment_status, segment_method, content, error) of single words (page_id,
    image, box): a row a page.  A word without a box fails; ``make`` builds the engine."""

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make() if make else None
        for batch in found:
            for r in batch.itertuples(index=False):
                row = r.page_id, "failed", name, None, None
                try:
                    if r.box is not None:
                        how, crop = segment(pixels.rgb(r.data, r.height, r.width, r.channels), tuple(r.box[c] for c in ("x0", "y0", "x1", "y1")), engine, name)
                        row = r.page_id, "success", how, sinks.png(crop), None
                except Exception as e:  # a bad page must not fail the job
                    row = r.page_id, "failed", name, None, str(e)
                yield pd.DataFrame([row], columns=["page_id", "segment_status", "segment_method", "content", "error"])

    return words.selectExpr("page_id", *_IMAGE, "box").mapInPandas(run, "page_id string, segment_status string, segment_method string, content binary, error string")
