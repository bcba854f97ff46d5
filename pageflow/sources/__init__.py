"""Readers of pages, tokens, cards, feedback and packages as DataFrames."""

from __future__ import annotations

import io
import json
import sqlite3
import tempfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Image endings that a folder scan takes (fixed values).
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")
BOX = "array<int>"
TOKEN_PAGE = f"page_id string, raw_count int, clean_count int, deduped_count int, tokens array<struct<text:string,confidence:double,bbox_xyxy:{BOX}>>"
FEEDBACK = f"card_id string, pair_id string, action string, edited_text string, edited_caption string, corrected_bbox {BOX}, corrected_caption string, preferred_search_direction string"
CARD = f"card_id string, page_id string, source_page_id string, token_index int, layout_type string, word string, bbox_xyxy {BOX}, method string, front_image_path string, source_ref string, confidence double, needs_review boolean, status string, created_at string, updated_at string, reasons array<string>"
QUEUE = "card_id string, page_id string, token_index int, text string, review_reason string, suggested_action string"
JOB_CARD = "card_id string, page_id string, source_ref string, token_index int, word string, box struct<x0:int,y0:int,x1:int,y1:int>, method string, confidence double, needs_review boolean, status string, reasons array<string>, front_image_path string"
PAIR = f"pair_id string, page_id string, order_index int, item_index int, picture_bbox {BOX}, text_bbox {BOX}, caption_text string, has_text boolean, needs_review boolean, reasons array<string>, confidence double, status string, picture_path string, text_path string"


def _fields(columns: str) -> str:
    """Column definitions as the fields of a struct."""
    return ",".join(":".join(c.split(" ", 1)) for c in columns.split(", "))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images of a folder; undecodable files are dropped."""
    found = spark.read.format("image").option("dropInvalid", True).load(path)
    return found.select(F.element_at(F.split("image.origin", "/"), -1).alias("file"), "image")


def read_files(spark: SparkSession, path: str, endings: tuple[str, ...] = IMAGE_ENDINGS) -> DataFrame:
    """Undecoded files, by path: kind 0 images, 1 PDFs."""
    found = spark.read.format("binaryFile").load(path)
    ending = F.lower(F.element_at(F.split("path", r"\."), -1))
    return found.withColumn("ending", ending).filter(F.col("ending").isin(*endings, "pdf")).withColumn("kind", (F.col("ending") == "pdf").cast("int"))


def read_token_pages(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of stored OCR pages: page_id, ord, text, confidence, box."""
    pages = spark.read.schema(TOKEN_PAGE).option("multiLine", True).json(path)
    t = pages.select("page_id", F.posexplode("tokens").alias("ord", "t"))
    b = F.col("t.bbox_xyxy")
    box = F.when(F.size(b) == 4, F.struct(*(b[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1")))))
    return t.select("page_id", "ord", F.col("t.text").alias("text"), F.col("t.confidence").alias("confidence"), box.alias("box"))


def read_job_cards(spark: SparkSession, path: str) -> DataFrame:
    """Cards of a result file {cards: [..]}, with absent fields filled in."""
    cards = spark.read.schema(f"cards array<struct<{_fields(CARD)}>>").option("multiLine", True).json(path)
    c = cards.select(F.explode("cards").alias("c")).select("c.*")
    return c.withColumn("status", F.coalesce("status", F.when(F.col("needs_review"), "review").otherwise("active"))).withColumn("source_page_id", F.coalesce("source_page_id", "page_id")).withColumn("token_index", F.coalesce("token_index", F.lit(0)))


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback, a bare list or {items: [..]}, with its order in ``ord``."""
    fields = _fields(FEEDBACK)
    raw = spark.read.text(path, wholetext=True)
    items = F.when(F.trim("value").startswith("["), F.from_json("value", f"array<struct<{fields}>>")).otherwise(F.from_json("value", f"items array<struct<{fields}>>")["items"])
    return raw.select(F.posexplode(items).alias("ord", "f")).select("ord", "f.*")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of either schema: 1.0 (pairs) or 2.0 (pages of pairs)."""
    fields = _fields(PAIR)
    raw = spark.read.schema(f"schema_version string, pairs array<struct<{fields}>>, pages array<struct<page_id:string,pairs:array<struct<{fields}>>>>").option("multiLine", True).json(path)
    old = raw.filter(~F.coalesce(F.col("schema_version").startswith("2.0"), F.lit(False)) & F.col("pairs").isNotNull()).select(F.posexplode("pairs").alias("n", "p")).select("n", "p.*")
    new = raw.filter(F.col("schema_version").startswith("2.0")).select(F.explode("pages").alias("g")).select(F.col("g.page_id").alias("_page"), F.posexplode("g.pairs").alias("n", "p")).select("n", "_page", "p.*").withColumn("page_id", F.coalesce("page_id", "_page")).drop("_page")
    both = old.withColumn("older", F.lit(True)).unionByName(new.withColumn("older", F.lit(False)))
    return both.withColumn("order_index", F.coalesce("order_index", "item_index", "n")).drop("n")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_apkg(spark: SparkSession, path: str) -> DataFrame:
    """Notes and media of packages: path, note_id, fields, media (name by number), error."""

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in found:
            rows = []
            for where, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z, tempfile.NamedTemporaryFile(suffix=".anki2") as f:
                        media = json.dumps(json.loads(z.read("media")))
                        f.write(z.read("collection.anki2"))
                        f.flush()
                        with sqlite3.connect(f.name) as db:
                            notes = db.execute("SELECT id, flds FROM notes ORDER BY id").fetchall()
                        names = json.dumps(sorted(z.namelist()))
                    rows += [(where, int(i), fields, media, names, None) for i, fields in notes]
                except (KeyError, ValueError, zipfile.BadZipFile, sqlite3.Error) as e:
                    rows.append((where, None, None, None, None, f"apkg: {e}"))
            yield pd.DataFrame(rows, columns=["path", "note_id", "fields", "media", "entries", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, note_id long, fields string, media string, entries string, error string")
