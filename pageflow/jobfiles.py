"""A job's own files: configuration, ids, placeholders, the input's manifest, stages and exports.

These are a job's few small files, made by the driver; rows are written by Spark."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from dataclasses import dataclass, fields
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import pages

#: A new job's totals (fixed values: their names).
COUNTERS = ("pages_total", "pages_processed", "cards_total", "review_items_total", "segment_success_count", "segment_fail_count", "ocr_empty_count", "pages_single_word", "pages_multi_word", "multiword_tokens", "multiword_crops_written", "multiword_crop_failures", "multiword_crops_gated_small", "multiword_crops_gated_ratio", "deduped_tokens", "review_items")
#: Keys of the configuration and the options they set (fixed values).
CLEANUP = {"lowercase": "lowercase", "remove_numeric_only": "remove_numeric_only", "min_token_length": "min_token_length", "allow_short_tokens": "allow_short", "dedupe_enabled": "dedupe", "drop_punctuation_only": "drop_punctuation_only", "drop_suspicious_tokens": "drop_suspicious", "suspicious_patterns": "suspicious", "drop_patterns": "drop_patterns", "max_tokens_per_page": "max_tokens", "min_confidence": "min_confidence", "quality_sort_enabled": "quality_sort"}
CROP = {"bbox_crop_padding_px": "padding", "bbox_crop_min_area_px": "min_area", "bbox_crop_min_area_ratio": "min_ratio", "bbox_crop_max_area_ratio": "max_ratio"}


@dataclass(frozen=True)
class Config:
    clean: pages.CleanOptions = pages.CleanOptions()
    crop: pages.CropOptions = pages.CropOptions()


def load_config(path: str) -> Config:
    """A configuration file; keys that it leaves out have the options' own defaults."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)

    def made(kind, names: dict[str, str], given: dict):
        known = {x.name for x in fields(kind)}
        found = {names[k]: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in names}
        return kind(**{k: v for k, v in found.items() if k in known})

    return Config(made(pages.CleanOptions, CLEANUP, held.get("cleanup", {})), made(pages.CropOptions, CROP, held.get("crop", {})))


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S+00:00")


def job_id(timeline: bool = True) -> str:
    """By day and time with eight random letters, or random alone."""
    own = uuid.uuid4()
    return datetime.now(UTC).strftime("%Y-%m-%d/%H-%M-%S__") + own.hex[:8] if timeline else str(own)


def input_id(path: str) -> str:
    """The id of a quick extraction, by its input's path."""
    return hashlib.sha1(path.encode(), usedforsecurity=False).hexdigest()[:12]


def _put(path: str, value) -> None:
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
    os.replace(part, path)


def start_job(folder: str, name: str, source: str, kind: str, path: str) -> dict:
    """A job's placeholders, unfinished and empty, and the manifest of its input; returns the job's description."""
    os.makedirs(os.path.join(folder, "input"), exist_ok=True)
    job = {"job_id": name, "source": source, "input": {"type": kind, "path": path}, "created_at": now()}
    _put(os.path.join(folder, "result.json"), {"job": job, "cards": []})
    _put(os.path.join(folder, "review_queue.json"), {"items": []})
    _put(os.path.join(folder, "metrics.json"), {"created_at": job["created_at"], "finished": False, **dict.fromkeys(COUNTERS, 0)})
    open(os.path.join(folder, "errors.jsonl"), "a").close()
    _put(os.path.join(folder, "input", "manifest.json"), {"type": kind, "path": path})
    return job


def write_stage(rows: DataFrame, folder: str, stage: str) -> None:
    """A stage's rows as JSON, a folder a page."""
    rows.write.mode("overwrite").partitionBy("page_id").json(f"{folder}/stage/{stage}")


def export_training(records: DataFrame, path: str, form: str = "jsonl") -> None:
    """Training records as JSON lines, or (``json``) one object with its count."""
    if form == "json":
        records.agg(F.count(F.lit(1)).alias("record_count"), F.collect_list(F.struct(*records.columns)).alias("records")).coalesce(1).write.mode("overwrite").json(path)
    else:
        records.write.mode("overwrite").json(path)


def write_contour_pairs(pairs: DataFrame, path: str) -> None:
    """Pairs of contours (page_id, order_index, text, ..) a page: their count, and which lack a text."""
    held = F.struct("order_index", *(c for c in pairs.columns if c not in ("page_id", "order_index")), (F.coalesce("text", F.lit("")) == "").alias("needs_text_input"))
    grouped = pairs.groupBy("page_id").agg(F.count(F.lit(1)).alias("total_pairs"), F.array_sort(F.collect_list(held)).alias("pairs"))
    grouped.write.mode("overwrite").json(path)


def log_feedback(feedback: DataFrame, folder: str, job: str) -> str:
    """Appends feedback rows to a log of their own, named by time and job."""
    path = f"{folder}/{now().replace(':', '-')}__{job[:8]}"
    feedback.select(F.lit(job).alias("job_id"), F.lit(now()).alias("timestamp"), F.to_json(F.struct(*feedback.columns)).alias("feedback_item")).write.mode("append").json(path)
    return path


def upgraded_feedback(held) -> dict:
    """A feedback file's content as the versioned object: bare lists are wrapped, objects keep what they have."""
    if isinstance(held, list):
        return {"feedback_version": 1, "generated_at": now(), "items": held}
    if isinstance(held, dict) and isinstance(held.get("items"), list):
        return {"feedback_version": 1, "generated_at": now(), **held}
    raise ValueError("feedback must be a list or an object with a list of items")


def resolve_input(path: str) -> tuple[str, str]:
    """(type, path) of an input: a document, an image, or a folder of both."""
    if os.path.isdir(path):
        return "folder", path
    ending = re.sub(r"^.*\.", "", path).lower()
    if ending == "pdf":
        return "pdf", path
    if ending in ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff"):
        return "image", path
    raise ValueError(f"no input of a known type: {path}")


def present_files(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """(job_id, name) of the files in jobs' folders."""
    rows = [(job, name) for job, folder in folders.items() if os.path.isdir(folder) for name in sorted(os.listdir(folder))]
    return spark.createDataFrame(rows, "job_id string, name string")
