"""Counts and rows that jobs report: pages, crops, panels, pairs, learning, and cards of
pages without words.  Each is one aggregate over rows that other operators made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom, ids, text
from . import pages


def clean_counts(tokens: DataFrame, options: pages.CleanOptions = pages.CONFIGURED) -> DataFrame:
    """raw_count, clean_count and deduped_count of each page of raw tokens."""
    every = pages.CleanOptions(**{**vars(options), "dedupe": False})
    raw = tokens.groupBy("page_id").agg(F.count(F.lit(1)).alias("raw_count"))
    kept = pages.clean_tokens(tokens, every).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("words"))
    n, words = F.coalesce("n", F.lit(0)), F.coalesce("words", F.lit(0))
    clean = words if options.dedupe else n
    return raw.join(kept, "page_id", "left").select("page_id", "raw_count", clean.alias("clean_count"), (n - clean).alias("deduped_count"))


def word_candidates(tokens: DataFrame) -> DataFrame:
    """The non-empty words of each page's clean tokens, in rank order."""
    words = F.array_sort(F.collect_list(F.when(text.strip(F.coalesce("text", F.lit(""))) != "", F.struct("rank", "text"))))
    return tokens.groupBy("page_id").agg(F.transform(words, lambda w: w["text"]).alias("word_candidates"))


def unknown_cards(found: DataFrame) -> DataFrame:
    """Cards of pages that have no usable word: (page_id, source_ref, image_path, layout_type)
    of an unknown layout, or of a single word's without a token."""
    lost = F.when(F.col("layout_type") == "unknown", "LAYOUT_UNCERTAIN").otherwise("OCR_EMPTY")
    none = F.lit(None).cast("struct<x0:int,y0:int,x1:int,y1:int>")
    return found.select(
        ids.sha1(F.concat_ws("|", "source_ref", F.col("page_id").cast("string"), F.lit("UNKNOWN"), F.lit(""))).alias("card_id"), "page_id", "source_ref", F.lit(0).alias("token_index"), "layout_type", F.lit("UNKNOWN").alias("word"), none.alias("box"),
        F.lit("page").alias("method"), F.col("image_path").alias("front_image_path"), F.lit(0.0).alias("confidence"), F.lit(True).alias("needs_review"), F.lit("review").alias("status"), F.array(lost).alias("reasons"),
    )


def unknown_review_rows(cards: DataFrame) -> DataFrame:
    """The review row of each card of unknown_cards()."""
    said = F.when(F.col("layout_type") == "unknown", "UNKNOWN").otherwise("")
    todo = F.when(F.col("layout_type") == "unknown", "manual_review").otherwise("manual_enter_word_or_fix_ocr")
    return cards.select("card_id", "page_id", "source_ref", "front_image_path", "token_index", said.alias("text"), F.get("reasons", F.lit(0)).alias("review_reason"), todo.alias("suggested_action"))


def empty_page_rows(found: DataFrame, cards: DataFrame) -> DataFrame:
    """A review row for each multi-word page (page_id, source_ref, image_path) without any card."""
    none = found.join(cards.select("page_id"), "page_id", "left_anti")
    return none.select(ids.sha1(F.concat_ws("|", "source_ref", F.col("page_id").cast("string"), F.lit(""), F.lit(""))).alias("card_id"), "page_id", "source_ref", F.col("image_path").alias("front_image_path"), F.lit(0).alias("token_index"), F.lit("").alias("text"), F.lit("OCR_EMPTY").alias("review_reason"), F.lit("manual_enter_word_or_fix_ocr").alias("suggested_action"))


def job_metrics(layout: DataFrame, counts: DataFrame, cropped: DataFrame, cards: DataFrame, queue: DataFrame, segments: DataFrame, panels: DataFrame) -> DataFrame:
    """One row of a job's totals over layouts, clean_counts(), crops of multi-word pages,
    cards, review rows, segments (status) and panels.  Each input is read once."""
    parts = [
        layout.agg(F.count(F.lit(1)).alias("pages_processed"), *(F.count_if(F.col("layout_type") == k).alias(f"pages_{k}") for k in ("single_word", "multi_word"))),
        counts.agg(F.count_if(F.col("clean_count") == 0).alias("ocr_empty_count"), F.coalesce(F.sum("deduped_count"), F.lit(0)).alias("deduped_tokens")),
        cropped.agg(F.count(F.lit(1)).alias("multiword_tokens"), F.count_if(F.col("crop_status") == "success").alias("multiword_crops_written"), F.count_if(F.col("crop_status") == "failed").alias("multiword_crop_failures"), *(F.count_if(F.array_contains("warnings", f"CROP_GATED_{k.upper()}")).alias(f"multiword_crops_gated_{k}") for k in ("small", "ratio"))),
        cards.agg(F.count(F.lit(1)).alias("cards_total")),
        queue.agg(F.count(F.lit(1)).alias("review_items_total")),
        segments.agg(*(F.count_if(F.col("status") == s).alias(f"segment_{n}_count") for s, n in (("success", "success"), ("failed", "fail")))),
        panel_counts(panels),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.withColumn("review_items", F.col("review_items_total"))


def grid_pair_metrics(pairs: DataFrame) -> DataFrame:
    """One row of totals over grid pairs (needs_review, reasons)."""
    has = lambda r: F.count_if(F.array_contains("reasons", r))
    return pairs.agg(F.count(F.lit(1)).alias("pairs_total"), F.count_if("needs_review").alias("pairs_needing_review"), has("BLANK_PICTURE").alias("pairs_blank_picture"), has("BLANK_TEXT").alias("pairs_blank_text"), has("OCR_EMPTY").alias("pairs_ocr_empty"))


def page_summaries(found: DataFrame, pictures: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts of each page (page_id): pictures, text blocks, pairs (page_id, text, needs_review;
    ``text`` the block taken or null), pairs to review and blocks that no pair took."""
    n = lambda df, name: df.groupBy("page_id").agg(F.count(F.lit(1)).alias(name))
    made = pairs.groupBy("page_id").agg(F.count(F.lit(1)).alias("pairs_extracted"), F.count_if("needs_review").alias("pairs_needing_review"), F.count("text").alias("_taken"))
    out = found.join(n(pictures, "pictures_detected"), "page_id", "left").join(n(texts, "text_blocks_detected"), "page_id", "left").join(made, "page_id", "left").na.fill(0)
    return out.withColumn("unmatched_text_blocks", F.col("text_blocks_detected") - F.col("_taken")).drop("_taken")


def job_totals(summaries: DataFrame) -> DataFrame:
    """One row of totals over page_summaries()."""
    total = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).alias(n)
    return summaries.agg(F.count(F.lit(1)).alias("pages_processed"), total("pairs_extracted", "total_pairs"), total("pairs_needing_review", "total_needing_review"), total("pictures_detected", "total_pictures_detected"), total("text_blocks_detected", "total_text_blocks_detected"), total("unmatched_text_blocks", "total_unmatched_text"))


#: The least area of a panel, and the score over which it counts as blank (fixed values).
PANEL_AREA, PANEL_BLANK = 1000, 0.7


def panels(tokens: DataFrame, width: int, height: int) -> DataFrame:
    """Diagnostics of panels (page_id, block_index, box, text, score, is_blank, blank_reasons):
    clamped box, reasons once each in order, and what to do."""
    box = geom.clamp_box(F.col("box"), width, height)
    bad = F.col("box").isNull() | box.isNull()
    blank = F.coalesce(F.col("is_blank"), F.lit(True))
    none = F.array().cast("array<string>")
    said = text.strip(F.coalesce("text", F.lit("")))
    found = F.concat(
        F.when(geom.area(box) < PANEL_AREA, F.array(F.lit("SMALL_AREA"))).otherwise(none),
        F.when(blank, F.concat(F.array(F.lit("BLANK_CROP")), F.coalesce("blank_reasons", none))).otherwise(none),
        F.when(said == "", F.array(F.lit("OCR_EMPTY"))).otherwise(none),
    )
    reasons = F.when(bad, F.array(F.lit("BBOX_INVALID"))).otherwise(F.array_distinct(found))
    t = tokens.select("page_id", "block_index", F.when(bad, F.col("box")).otherwise(box).alias("box"), said.alias("caption_text"), F.when(bad, 1.0).otherwise(F.coalesce("score", F.lit(1.0))).alias("blank_score"), reasons.alias("reasons"))
    review = F.size("reasons") > 0
    return t.withColumn("needs_review", review).withColumn("status", F.when(review, "review").otherwise("active"))


def panel_counts(found: DataFrame, blank: float = PANEL_BLANK) -> DataFrame:
    """One row of totals over panels()."""
    return found.agg(F.count(F.lit(1)).alias("panels_total"), F.count_if("needs_review").alias("panels_needing_review"), F.count_if(F.col("blank_score") > blank).alias("panels_blank"))


def failed_pairs(items: DataFrame) -> DataFrame:
    """Pairs of grid items (page_id, item_index, box) whose extraction raised an error."""
    return items.select(ids.pair_id(F.col("page_id").cast("string"), F.col("item_index"), F.col("box")).alias("pair_id"), "page_id", "item_index", F.lit("").alias("caption_text"), F.lit("review").alias("status"), F.lit(True).alias("needs_review"), F.array(F.lit("EXTRACTION_FAILED")).alias("reasons"), F.lit(1.0).alias("blank_score_picture"), F.lit(1.0).alias("blank_score_text"), F.lit(0.0).alias("confidence"))


def pair_card_stats(pairs: DataFrame) -> DataFrame:
    """One row over pairs (caption_text, status, needs_review): pairs seen, dropped and used, and their cards."""
    empty = text.strip(F.coalesce("caption_text", F.lit(""))) == ""
    # An empty caption sends a pair to review before its rejection is looked at.
    gone = (F.col("status") == "rejected") & ~empty
    review = empty | F.coalesce(F.col("needs_review"), F.lit(False))
    return pairs.agg(F.count(F.lit(1)).alias("pairs_seen"), F.count_if(gone).alias("pairs_rejected"), F.count_if(~gone).alias("cards_forward"), F.count_if(~gone & ~empty).alias("cards_reverse"), F.count_if(empty).alias("pairs_without_text"), F.count_if(~gone & review).alias("cards_review"), F.count_if(~gone & ~review).alias("cards_active"))


def cache_stats(records: DataFrame, captions: DataFrame, parameters: DataFrame) -> DataFrame:
    """One row over feedback records, learned captions and learned parameters (key, value)."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    limit = F.coalesce(F.max(F.when(F.col("key") == "blank_threshold", F.col("value").try_cast("double"))), F.lit(0.7))
    one = n(records, "total_records").crossJoin(n(captions, "caption_corrections"))  # rows of totals
    return one.crossJoin(parameters.agg(F.count(F.lit(1)).alias("cached_parameters"), limit.alias("blank_threshold")))


def rules_stats(records: DataFrame, captions: DataFrame, direction: DataFrame) -> DataFrame:
    """One row over feedback records (file): how many files, learned captions and the direction (below by default)."""
    one = records.agg(F.countDistinct("file").alias("feedback_records")).crossJoin(captions.agg(F.count(F.lit(1)).alias("caption_corrections")))
    return one.crossJoin(direction.agg(F.coalesce(F.max("direction"), F.lit("below")).alias("search_direction")))


def overlay(summaries: DataFrame, found: DataFrame) -> DataFrame:
    """Page summaries beside their pages (page_index, image_path), for drawing."""
    return summaries.join(found.select("page_index", "image_path"), "page_index")


def largest_masks(masks: DataFrame) -> DataFrame:
    """The mask (page_id, ord, area, box) of most area of each page; the first on ties."""
    return masks.groupBy("page_id").agg(F.min_by(F.struct("ord", "area", "box"), F.struct(-F.col("area"), F.col("ord"))).alias("m")).select("page_id", "m.ord", "m.area", "m.box")


def regions_by_area(regions: DataFrame) -> DataFrame:
    """Regions (page_id, ord, box) with their place on the page by area, largest first."""
    area = geom.area(F.col("box"))
    items = F.array_sort(F.collect_list(F.struct((-area).alias("key"), "ord", area.alias("area"))))
    return regions.groupBy("page_id").agg(items.alias("items")).select("page_id", F.posexplode("items").alias("place", "r")).select("page_id", "place", "r.ord", "r.area")


def review_items(raw: DataFrame) -> DataFrame:
    """Review rows as the review page takes them: those of a card, with the older name of the reason filled in."""
    reason = F.coalesce(F.nullif("review_reason", F.lit("")), "reason", F.lit(""))
    return raw.filter(F.col("card_id").isNotNull()).withColumn("review_reason", reason)


def errors_of(*sources: DataFrame) -> DataFrame:
    """Messages (message) of a job's and a package's checks, together."""
    out = sources[0].select("message")
    for s in sources[1:]:
        out = out.unionByName(s.select("message"))
    return out


#: Files that a job's folder must have (fixed values).
CONTRACT = ("result.json", "review_queue.json", "metrics.json", "errors.jsonl")


def missing_files(present: DataFrame, jobs: DataFrame) -> DataFrame:
    """Contract files that each job (job_id) lacks; ``present``: job_id, name."""
    wanted = jobs.select("job_id", F.explode(F.array(*map(F.lit, CONTRACT))).alias("name"))
    return wanted.join(present.select("job_id", "name"), ["job_id", "name"], "left_anti")


def job_violations(job: DataFrame) -> DataFrame:
    """(job_id, rule): fields that a job's description (job_id, source, created_at, input_type, input_path) lacks."""
    rules = ("source", "created_at", "input_type", "input_path")
    return job.select("job_id", F.explode(F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in rules)))).alias("rule"))


def missing_images(rows: DataFrame, files: DataFrame, path: str = "front_image_path") -> DataFrame:
    """Rows (card_id, path) whose image is unsafe, or not among a job's files (path)."""
    problem = text.path_problem(F.col(path))
    asked = rows.filter(F.coalesce(F.col(path), F.lit("")) != "").select("card_id", F.col(path).alias("path"), problem.alias("problem"))
    lost = asked.filter(F.col("problem").isNull()).join(files.select("path"), "path", "left_anti").withColumn("problem", F.lit("missing"))
    return asked.filter(F.col("problem").isNotNull()).unionByName(lost.select("card_id", "path", "problem"))


def blank_reasons(entropy: Column, edges: Column) -> Column:
    """Why a crop counts as blank."""
    return F.array_compact(F.array(F.when(entropy < 3.5, "LOW_ENTROPY"), F.when(edges < 0.02, "LOW_EDGE_DENSITY")))
