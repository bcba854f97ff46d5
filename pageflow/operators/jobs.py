"""Job bookkeeping: counters of stages, exports and feedback, and checks of job files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom, text
from .review import judged


def crop_stats(cropped: DataFrame) -> DataFrame:
    """One row of counters over cropped tokens (crop_status, warnings)."""
    status = lambda s: F.count_if(F.col("crop_status") == s)
    gated = F.exists("warnings", lambda w: w.startswith("CROP_GATED"))
    return cropped.agg(status("success").alias("crops_success"), status("failed").alias("crops_failed"), status("skipped").alias("crops_skipped"), F.count_if(gated).alias("crops_gated"), F.count_if(F.array_contains("warnings", "BBOX_TOO_LARGE")).alias("crops_too_large"))


def export_stats(cards: DataFrame, include_review: bool = False) -> DataFrame:
    """One row of counters of the CSV export; rejected cards count as skipped for review."""
    gone = (F.col("status") == "rejected") | (F.lit(False) if include_review else F.col("needs_review"))
    unsafe = F.coalesce(text.path_problem(F.col("front_image_path")) != "empty", F.lit(False))
    return cards.agg(F.count(F.lit(1)).alias("cards_seen"), F.count_if(gone).alias("cards_skipped_review"), F.count_if(~gone & unsafe).alias("cards_unsafe"), F.count_if(~gone & ~unsafe).alias("cards_exported"))


#: Error buckets in report order (fixed values).
BUCKETS = ("CONTRACT", "DETERMINISM", "LIFECYCLE", "APKG", "SECURITY")


def error_buckets(errors: DataFrame) -> DataFrame:
    """Count of each category of messages (message), with its place in the report."""
    counted = errors.groupBy(text.error_category(F.col("message")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    place = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("category"))
    return counted.select("category", "n", (place - 1).cast("int").alias("place"))


def feedback_counters(cards: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: items, applied, of unknown cards, already applied (feedback as in the fold).

    Rows of unknown actions count as items alone."""
    j = judged(cards, feedback)
    done = j.agg(F.count_if(F.col("effective") | F.col("rejects")).alias("applied"), F.count(F.lit(1)).alias("known"))
    items = feedback.agg(F.count(F.lit(1)).alias("feedback_items"))
    unknown = feedback.join(cards.select("card_id"), "card_id", "left_anti").agg(F.count(F.lit(1)).alias("skipped_unknown_card"))
    one = items.crossJoin(unknown).crossJoin(done)  # rows of totals
    return one.select("feedback_items", "applied", "skipped_unknown_card", (F.col("known") - F.col("applied")).alias("skipped_already_applied"))


def open_queue(queue: DataFrame, cards: DataFrame, feedback: DataFrame) -> DataFrame:
    """Review rows that feedback leaves: an invalid edit of a live card doesn't resolve it."""
    resolved = judged(cards, feedback).filter((F.col("action") == "reject") | F.col("valid") | ~F.col("live"))
    return queue.join(resolved.select("card_id"), "card_id", "left_anti")


#: Least area, length and confidence of text blocks by source (fixed values).
TEXT_GATES = {"block": (300, 2, 0.4), "tesseract": (200, 2, 0.3), "easyocr": (200, 1, 0.15), "plain": (0, 2, 0.3)}


def text_gate(blocks: DataFrame, rule: str = "block") -> DataFrame:
    """Text blocks (text, confidence, box) worth matching; a lone sign must be a letter."""
    least, length, confidence = TEXT_GATES[rule]
    said = F.trim("text")
    keep = (geom.area(F.col("box")) >= least) & (F.length(said) >= length) & (F.col("confidence") >= confidence)
    return blocks.filter(keep & ((F.length(said) > 1) | said.rlike(r"^\p{L}$")))


def captions_below(regions: DataFrame, texts: DataFrame, width: int, height: int) -> DataFrame:
    """The most confident text in the window below each region (page_id, region, box);
    the first on ties, null where there is none."""
    t = texts.select("page_id", "ord", "text", "confidence", F.col("box").alias("_box"))
    met = regions.withColumn("window", geom.window_below(F.col("box"), width, height)).join(t, "page_id").filter(geom.overlaps(F.col("window"), F.col("_box")))
    best = met.groupBy("page_id", "region").agg(F.min_by("text", F.struct(-F.col("confidence"), F.col("ord"))).alias("caption"))
    return regions.select("page_id", "region").join(best, ["page_id", "region"], "left")


def column_mode(boxes: DataFrame, gap: int = 100) -> DataFrame:
    """The most frequent count of boxes in a row of each page; the least on ties."""
    y = geom.center_y(F.col("box"))
    w = Window.partitionBy("page_id").orderBy("y", "ord")
    rows = boxes.withColumn("y", y).withColumn("_new", F.when(F.col("y") - F.lag("y").over(w) >= gap, 1).otherwise(0))
    sizes = rows.withColumn("row", F.sum("_new").over(w)).groupBy("page_id", "row").agg(F.count(F.lit(1)).alias("column_count"))
    counts = sizes.groupBy("page_id", "column_count").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("page_id").agg(F.sum("n").alias("row_count"), F.min_by("column_count", F.struct(-F.col("n"), F.col("column_count"))).alias("column_count"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Pairs of each page, and of all (page null)."""
    return pairs.rollup("page_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("needs_review").alias("to_review"))


def duplicate_names(media: DataFrame, most: int = 10) -> DataFrame:
    """The first ``most`` names (name) that media hold twice or more: a report."""
    return media.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("name").limit(most)


def review_violations(queue: DataFrame) -> DataFrame:
    """(card_id, rule) for each rule that a review row breaks."""
    rules = {
        "card_id": ~F.coalesce(F.col("card_id").rlike("^[0-9a-fA-F]{40}$"), F.lit(False)),
        "page_id": F.trim(F.coalesce(F.col("page_id").cast("string"), F.lit(""))) == "",
        "reason": F.trim(F.coalesce("review_reason", F.lit(""))) == "",
    }
    broken = F.array_compact(F.array(*(F.when(test, name) for name, test in rules.items())))
    return queue.select("card_id", F.explode(broken).alias("rule"))


def metrics_violations(metrics: DataFrame) -> DataFrame:
    """Rules that a job's metrics (finished, completed_at, pages_processed, pages_total) break."""
    done, total = F.col("pages_processed"), F.col("pages_total")
    rules = {
        "finished": ~F.coalesce(F.col("finished"), F.lit(False)),
        "completed_at": F.trim(F.coalesce("completed_at", F.lit(""))) == "",
        "pages": ~F.coalesce((done >= 0) & (done <= total), F.lit(False)),
    }
    return metrics.select(F.explode(F.array_compact(F.array(*(F.when(test, name) for name, test in rules.items())))).alias("rule"))
