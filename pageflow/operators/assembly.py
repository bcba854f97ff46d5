"""Assembly of pairs and single-word cards, and the gates of regions, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom, ids


def _listed(*tests: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(t, name) for t, name in tests)))


def grid_pairs(items: DataFrame, blank: float = 0.7, min_area: int = 5000, learned: DataFrame | None = None) -> DataFrame:
    """Pairs of grid items (page_id, item_index, blank_picture, blank_text, caption, item_area).

    ``learned`` (page_id, item_index, learned_caption) puts a reviewed caption first."""
    t = items.withColumn("learned_caption", F.lit(None).cast("string")) if learned is None else items.join(learned, ["page_id", "item_index"], "left")
    known = F.length(F.trim(F.coalesce("learned_caption", F.lit("")))) > 0
    t = t.withColumn("caption_text", F.when(known, F.col("learned_caption")).otherwise(F.trim(F.coalesce("caption", F.lit("")))))
    empty = F.col("caption_text") == ""
    reasons = _listed((F.col("blank_picture") > blank, "BLANK_PICTURE"), (F.col("blank_text") > blank, "BLANK_TEXT"), (known, "LEARNED_CORRECTION"), (empty, "OCR_EMPTY"), (F.col("item_area") < min_area, "SMALL_ITEM"))
    t = t.withColumn("reasons", reasons)
    lost = F.when(F.col("blank_picture") > 0.5, 0.2).otherwise(0.0) + F.when(F.col("blank_text") > 0.5, 0.2).otherwise(0.0) + F.when(empty, 0.3).otherwise(0.0) + 0.1 * F.size("reasons")
    review = F.size(F.array_remove("reasons", "LEARNED_CORRECTION")) > 0
    return t.select("page_id", "item_index", "caption_text", "reasons", review.alias("needs_review"), F.when(review, "review").otherwise("active").alias("status"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - lost)), 6).alias("confidence"))


def matched_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs of matched pictures (page_id, order_index, box, confidence, text, corrected):
    ``text`` is null where no text was matched, ``corrected`` where none was learned."""
    said = F.coalesce(F.nullif(F.trim("corrected"), F.lit("")), "text", F.lit(""))
    corrected = F.length(F.trim(F.coalesce("corrected", F.lit("")))) > 0
    reasons = _listed((F.col("text").isNull(), "NO_TEXT_MATCH"), (F.col("text").isNotNull() & (F.trim("text") == "") & ~corrected, "OCR_EMPTY"))
    t = pairs.withColumn("caption_text", said).withColumn("reasons", reasons)
    has = corrected | (F.col("text").isNotNull() & (F.trim("caption_text") != ""))
    kept = F.col("confidence") * F.when(has, 1.0).otherwise(0.5) * F.when(F.size("reasons") > 0, 0.8).otherwise(1.0)
    review = ~corrected & (~has | (F.size("reasons") > 0))
    return t.select(ids.pair_id(F.col("page_id").cast("string"), F.col("order_index"), F.col("box")).alias("pair_id"), "page_id", "order_index", "caption_text", has.alias("has_text"), review.alias("needs_review"), "reasons", F.bround(kept, 4).alias("confidence"))


def page_summary(pairs: DataFrame) -> DataFrame:
    """Counts of each page's pairs (from matched_pairs)."""
    return pairs.groupBy("page_id").agg(F.count(F.lit(1)).alias("pairs_extracted"), F.count_if("needs_review").alias("pairs_needing_review"), F.count_if("has_text").alias("with_text"))


def single_word_cards(words: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Cards of single-word pages (page_id, word, confidence, segment_status,
    segment_method): a degraded crop is reviewed, whatever the fallback's name."""
    done = F.col("segment_status") == "success"
    degraded = done & F.coalesce(F.col("segment_method").startswith("bbox_fallback"), F.lit(False))
    page = ~F.coalesce(done, F.lit(False))
    reasons = _listed((F.coalesce(F.col("segment_status") == "failed", F.lit(False)), "SEGMENT_FAILED"), (page, "PAGE_FALLBACK"), (F.coalesce(degraded, F.lit(False)), "BBOX_FALLBACK"), (F.coalesce("word", F.lit("")) == "", "WORD_MISSING"), (F.coalesce("confidence", F.lit(0.0)) < min_confidence, "LOW_CONFIDENCE"))
    t = words.withColumn("reasons", reasons)
    method = F.when(page, "page_fallback").when(degraded, "bbox_fallback").otherwise("segmenter")
    lead = F.get(F.filter("reasons", lambda r: r != "WORD_MISSING"), F.lit(0))
    return t.select("page_id", "word", method.alias("method"), (F.size("reasons") > 0).alias("needs_review"), "reasons", lead.alias("review_reason"))


def segment_gate(box: Column, width: int, height: int, scale: float = 4.0, least: float = 0.02) -> Column:
    """The expanded box and whether its share of the page is large enough."""
    grown = geom.expand(box, scale, width, height)
    ratio = geom.area(grown) / (width * height)
    return F.struct(grown.alias("box"), ratio.alias("area_ratio"), F.when(ratio < least, "area_ratio_too_small").alias("reason"))


#: Region classes by share of the page and aspect (fixed values).
REGION_CLASS = {"contour": (0.0018, 0.5, 2.0), "edges": (0.0025, 0.5, 2.0), "debug": (0.0008, 0.35, 2.8)}


def region_class(box: Column, width: int, height: int, rule: str = "contour") -> Column:
    least, low, high = REGION_CLASS[rule]
    aspect = geom.width(box) / F.greatest(F.lit(1), geom.height(box))
    return F.when((geom.area(box) / (width * height) > least) & (aspect > low) & (aspect < high), "picture").otherwise("text")


#: Region filters: least and most share of the page, least and most aspect, least side, margin (fixed values).
REGION_FILTER = {"first": (0.001, 0.5, 0.3, 3.0, 0, 0), "unified": (0.001, 0.3, 0.25, 4.0, 0, 0), "contour": (0.001, 0.1, 0.3, 3.0, 80, 50), "picture": (0.003, 0.15, 0.4, 2.5, 0, 0)}


def region_kept(box: Column, width: int, height: int, rule: str, most: float | None = None) -> Column:
    """A rule's verdict; ``most`` is another largest share of the page."""
    low, high, thin, wide, side, margin = REGION_FILTER[rule]
    high = high if most is None else most
    share, aspect = geom.area(box) / (width * height), geom.width(box) / F.greatest(F.lit(1), geom.height(box))
    inside = (box["x0"] >= margin) & (box["y0"] >= margin) & (box["x1"] <= width - margin) & (box["y1"] <= height - margin)
    return share.between(low, high) & aspect.between(thin, wide) & (geom.width(box) >= side) & (geom.height(box) >= side) & (inside if margin else F.lit(True))
