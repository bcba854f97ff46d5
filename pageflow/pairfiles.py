"""Files of extracted pairs: crops, descriptions, page summaries and drawings.

They are made where a page's pixels are, a page at a time, and written by the tasks to a
folder that all of them share."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jobfiles, sinks
from .operators import kernels, pixels, summaries

#: Outlines of pictures, of texts, and the lines between them (fixed values).
PICTURE, TEXT, LINK = (0, 0, 255), (255, 0, 0), (0, 255, 0)
#: The size of the white crop of a pair without a text (fixed value: height, width).
NO_TEXT = 30, 100
FILE = "page_id string, path string, content binary"
META = ("pair_id", "order_index", "picture_bbox", "text_bbox", "caption_text", "has_text", "needs_review", "reasons", "confidence")


def _listed(box: str):
    """A box as a list of four numbers, null where there is none."""
    return F.when(F.col(box).isNotNull(), F.array(*(F.col(f"{box}.{c}") for c in ("x0", "y0", "x1", "y1"))))


def by_page(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """Decoded pages (page_id, image) with their pairs (of extract.extract_pairs) in order; a
    page without pairs has an empty list."""
    held = pairs.withColumn("picture_bbox", _listed("picture_box")).withColumn("text_bbox", _listed("text_box"))
    item = F.struct("order_index", *(c for c in META if c != "order_index"))
    grouped = held.groupBy(F.col("page_id").cast("string").alias("page_id")).agg(F.array_sort(F.collect_list(item)).alias("pairs"))
    pixels_of = images.select("page_id", *(F.col(f"image.{c}").alias(c) for c in ("data", "height", "width", "nChannels")))
    return pixels_of.join(grouped, "page_id", "left")


def _meta(pair) -> dict:
    said = {name: pair[name] for name in META}
    return {k: list(v) if isinstance(v, np.ndarray) else v for k, v in said.items()}


def _json(value) -> bytes:
    return json.dumps(value, ensure_ascii=False, indent=2, default=lambda x: x.item() if hasattr(x, "item") else str(x)).encode()


def _each(rows: DataFrame, make) -> DataFrame:
    """``make(page_id, rgb, pairs)`` yields (path, content) of a page's files."""

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in found:
            for r in batch.itertuples(index=False):  # one page's files at a time
                pairs = [] if r.pairs is None else [_meta(p) for p in r.pairs]
                for path, content in make(r.page_id, pixels.rgb(r.data, r.height, r.width, r.nChannels), pairs):
                    yield pd.DataFrame([(r.page_id, path, content)], columns=["page_id", "path", "content"])

    return rows.mapInPandas(run, FILE)


def pair_files(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page_id, path, content) of each pair's image.png, text.png (white without a text) and
    meta.json, and of each page's summary.json."""

    def make(page_id, rgb, pairs):
        for p in pairs:
            folder = f"{page_id}/pair_{p['order_index'] + 1:03d}"
            yield f"{folder}/image.png", sinks.png(kernels.crop(rgb, p["picture_bbox"]))
            none = np.full((*NO_TEXT, 3), 255, np.uint8)
            yield f"{folder}/text.png", sinks.png(none if p["text_bbox"] is None else kernels.crop(rgb, p["text_bbox"]))
            yield f"{folder}/meta.json", _json(p)
        yield f"{page_id}/summary.json", _json({"page_id": page_id, "image_size": [rgb.shape[1], rgb.shape[0]], "pairs_extracted": len(pairs), "pairs_needing_review": sum(bool(p["needs_review"]) for p in pairs), "pairs": pairs})

    return _each(by_page(images, pairs), make)


def card_crops(images: DataFrame, cards: DataFrame) -> DataFrame:
    """(page_id, path, content) of the crops of cards (page_id, box, front_image_path); a card
    without a box shows its whole page.  A path of several cards is made once."""
    item = F.struct("front_image_path", _listed("box").alias("box"))
    asked = cards.filter(F.coalesce("front_image_path", F.lit("")) != "").dropDuplicates(["front_image_path"])
    grouped = asked.groupBy("page_id").agg(F.collect_list(item).alias("pairs"))
    rows = images.select("page_id", *(F.col(f"image.{c}").alias(c) for c in ("data", "height", "width", "nChannels"))).join(grouped, "page_id")

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in found:
            for r in batch.itertuples(index=False):
                page = pixels.rgb(r.data, r.height, r.width, r.nChannels)
                for p in r.pairs:
                    crop = page if p["box"] is None else kernels.crop(page, p["box"])
                    yield pd.DataFrame([(r.page_id, p["front_image_path"], sinks.png(crop))], columns=["page_id", "path", "content"])

    return rows.mapInPandas(run, FILE)


def drawings(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """(page_id, path, content) of pages with their pairs drawn: numbered boxes of pictures and
    texts, and lines between their centres."""
    middle = lambda b: ((b[0] + b[2]) // 2, (b[1] + b[3]) // 2)

    def make(page_id, rgb, pairs):
        for n, p in enumerate(pairs, 1):
            picture, said = p["picture_bbox"], p["text_bbox"]
            for box, color, thick, name in ((picture, PICTURE, 4, "P"), (said, TEXT, 3, "T")):
                if box is not None:
                    rgb = kernels.draw_boxes(rgb, [box], [color], thick)
                    rgb = kernels.draw_label(rgb, (box[0], box[1] - 20), f"{name}#{n}", color)
            if picture is not None and said is not None:
                rgb = kernels.draw_line(rgb, middle(picture), middle(said), LINK)
        yield f"debug_viz/{page_id}_pairs.png", sinks.png(rgb)

    return _each(by_page(images, pairs), make)


def panel_pages(images: DataFrame, panels: DataFrame) -> DataFrame:
    """(page_id, path, content) of pages with their panels (page_id, block_index, box,
    needs_review, is_blank): red to review, yellow if blank, else green, labelled
    ``#i [R] [B]``."""
    item = F.struct("block_index", _listed("box").alias("box"), "needs_review", "is_blank")
    grouped = panels.filter("box is not null").groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("pairs"))
    rows = images.select("page_id", *(F.col(f"image.{c}").alias(c) for c in ("data", "height", "width", "nChannels"))).join(grouped, "page_id", "left")

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in found:
            for r in batch.itertuples(index=False):
                page = pixels.rgb(r.data, r.height, r.width, r.nChannels)
                for p in [] if r.pairs is None else r.pairs:
                    color = (255, 0, 0) if p["needs_review"] else (255, 200, 0) if p["is_blank"] else (0, 160, 0)
                    label = f"#{p['block_index']}" + " [R]" * bool(p["needs_review"]) + " [B]" * bool(p["is_blank"])
                    page = kernels.draw_label(kernels.draw_boxes(page, [p["box"]], [color]), (p["box"][0] + 4, p["box"][1] + 4), label, color)
                yield pd.DataFrame([(r.page_id, f"{r.page_id}_panels.png", sinks.png(page))], columns=["page_id", "path", "content"])

    return rows.mapInPandas(run, FILE)


def write_files(files: DataFrame, folder: str) -> int:
    """Writes files (path, content) under a folder that all tasks share; returns how many.

    A file is written under a name of its own and renamed, so a task that is run again does
    no harm.  A path that leaves the folder fails the job."""

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in found:
            for path, content in zip(batch["path"], batch["content"]):
                if os.path.isabs(path) or ".." in path.replace("\\", "/").split("/"):
                    raise ValueError(f"unsafe path: {path}")
                whole = os.path.join(folder, path)
                os.makedirs(os.path.dirname(whole), exist_ok=True)
                part = f"{whole}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, whole)
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("path", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_job_summary(summary: DataFrame, pairs: DataFrame, folder: str, job: str, options: dict, learned: dict | None = None) -> dict:
    """job_summary.json of a quick extraction: totals, then the pages (of extract_pairs) in
    order with their pairs, streamed through the driver; returns the totals."""
    held = pairs.withColumn("picture_bbox", _listed("picture_box")).withColumn("text_bbox", _listed("text_box"))
    place = F.concat(F.col("page_id").cast("string"), F.format_string("/pair_%03d/", F.col("order_index") + 1))
    item = F.struct("order_index", *(c for c in META if c != "order_index"), F.concat(place, F.lit("image.png")).alias("picture_path"), F.concat(place, F.lit("text.png")).alias("text_path"), F.concat(place, F.lit("meta.json")).alias("meta_path"))
    pages = summary.join(held.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("pairs")), "page_id", "left").orderBy("page_id")
    totals = summaries.job_totals(summary).first().asDict()
    told = {"job_id": job, "created_at": jobfiles.now(), **totals, "config": options, "learning_stats": learned or {}}
    os.makedirs(folder, exist_ok=True)
    part = os.path.join(folder, f"job_summary.json.{uuid.uuid4().hex}.part")
    with open(part, "w", encoding="utf-8") as f:
        f.write(json.dumps(told, ensure_ascii=False)[:-1] + ', "pages": [')
        for n, row in enumerate(pages.select(F.to_json(F.struct(*pages.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
            f.write(("," if n else "") + row.j)
        f.write("]}")
    os.replace(part, os.path.join(folder, "job_summary.json"))
    return told
