"""Pairs of pictures and captions from pages: detection, gates, matching and assembly in one plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plugins, sources
from .functions import geom, ids
from .operators import assembly, jobs, matching, review, summaries


@dataclass(frozen=True)
class PairOptions:
    search_direction: str = "below"
    max_pairing_distance_px: float = 300.0
    text_iou_threshold: float = 0.5
    nms_threshold: float = 0.3
    max_area_ratio: float = 0.15
    #: Pictures with fewer edges, or with the look of a plain surface, go; None keeps them.
    min_edge_density: float | None = None


#: The stricter gates of pictures (fixed values).
STRICT = {"max_area_ratio": 0.10, "min_edge_density": 0.10}


def with_rules(options: PairOptions, rules: dict) -> PairOptions:
    """Options with learned rules applied; an unknown direction is left out, the options given stay as they are."""
    new: dict = {}
    if rules.get("search_direction") in review.DIRECTIONS:
        new["search_direction"] = rules["search_direction"]
    if "max_pairing_distance_px" in rules:
        new["max_pairing_distance_px"] = float(int(rules["max_pairing_distance_px"]))
    if "text_iou_threshold" in rules:
        new["text_iou_threshold"] = float(rules["text_iou_threshold"])
    return replace(options, **new)


def ordered_pictures(pictures: DataFrame, texts: DataFrame, pages: DataFrame, options: PairOptions = PairOptions()) -> DataFrame:
    """Picture candidates (page_id, ord, confidence, box) that pass the gates of their page
    (page_id, width, height), lie on no text and overlap no better one; ``ord`` is their
    place in reading order."""
    sized = pictures.join(pages, "page_id").filter(assembly.region_kept(F.col("box"), F.col("width"), F.col("height"), "picture", options.max_area_ratio)).drop("width", "height")
    alone = matching.suppress(matching.without_overlap(sized, texts, options.text_iou_threshold), options.nms_threshold)
    key = F.struct(geom.canonical_key(F.col("box")).alias("at"), "ord", "confidence", "box")
    items = alone.groupBy("page_id").agg(F.array_sort(F.collect_list(key)).alias("items"))
    return items.select("page_id", F.posexplode("items").alias("place", "p")).select("page_id", F.col("place").cast("long").alias("ord"), "p.confidence", "p.box")


def extract_pairs(pictures: DataFrame, texts: DataFrame, pages: DataFrame, options: PairOptions = PairOptions(), captions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, page summaries) of picture candidates and text blocks (page_id, ord, text,
    confidence, box).  ``captions`` (pair_id, caption) are learned ones."""
    blocks = jobs.text_gate(texts)
    found = ordered_pictures(pictures, texts, pages, options)
    score = lambda p, t: geom.pair_score(p, t, options.max_pairing_distance_px, options.search_direction)
    taken = matching.greedy_pairs(found, blocks, score).withColumnRenamed("text", "_text")
    said = blocks.select("page_id", F.col("ord").cast("long").alias("_text"), "text", F.col("box").alias("text_box"))
    t = found.withColumnRenamed("ord", "order_index").join(taken.withColumnRenamed("picture", "order_index"), ["page_id", "order_index"]).join(said, ["page_id", "_text"], "left")
    if captions is None:
        t = t.withColumn("corrected", F.lit(None).cast("string"))
    else:
        own = ids.pair_id(F.col("page_id").cast("string"), F.col("order_index"), F.col("box"))
        t = t.withColumn("_id", own).join(captions.select(F.col("pair_id").alias("_id"), F.col("caption").alias("corrected")), "_id", "left")
    made = assembly.matched_pairs(t)
    boxes = t.select("page_id", "order_index", F.col("box").alias("picture_box"), "text_box", F.col("_text").alias("text"))
    pairs = made.join(boxes, ["page_id", "order_index"])
    summary = summaries.page_summaries(pages.select("page_id"), found, blocks, pairs)
    return pairs.drop("text"), summary


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pages (page_id, image) of an image or a folder; a page is named by its file without the ending."""
    return sources.read_images(spark, path).select(F.regexp_replace("file", r"\.[^.]*$", "").alias("page_id"), "image")


def extract_pairs_from_pages(images: DataFrame, tokens: DataFrame, make_detector=None, options: PairOptions = PairOptions(), captions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, summaries) of decoded pages (page_id, image) with their OCR tokens (page_id, ord,
    text, confidence, box).  Without a detector edges are tried, then a grid."""
    make = make_detector or (lambda: plugins.Chain(plugins.EdgeDetector, plugins.GridDetector))
    least = options.min_edge_density
    pictures = plugins.run_detector(images, make if least is None else lambda: plugins.Real(make(), least)).filter("error is null").drop("error")
    pages = images.select("page_id", F.col("image.width").alias("width"), F.col("image.height").alias("height"))
    lines = matching.merge_lines(tokens)
    texts = lines.select("page_id", F.col("grp").cast("long").alias("ord"), "text", "confidence", geom.box("x0", "y0", "x1", "y1").alias("box"))
    return extract_pairs(pictures, texts, pages, options, captions)


def extract_pairs_from_folder(spark: SparkSession, path: str, tokens: DataFrame, make_detector=None, options: PairOptions = PairOptions(), captions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The same of a folder's images."""
    return extract_pairs_from_pages(decoded(spark, path), tokens, make_detector, options, captions)


def extract_pairs_from_image(spark: SparkSession, path: str, tokens: DataFrame, make_detector=None, options: PairOptions = PairOptions()) -> tuple[DataFrame, DataFrame]:
    """The same of one image."""
    return extract_pairs_from_folder(spark, path, tokens, make_detector, options)


def picture_path() -> Column:
    """Where a pair's picture is, in its job's folder."""
    return F.concat(F.col("page_id").cast("string"), F.format_string("/pair_%03d/image.png", F.col("order_index") + 1))


def quick_cards(pairs: DataFrame, created_at: str = "", short: bool = False) -> DataFrame:
    """Cards of a quick extraction, named by their pairs: all sixteen fields, or the seven of the short form."""
    page, stamp = F.col("page_id").cast("string"), F.lit(created_at)
    box = F.array(*(F.col(f"picture_box.{c}") for c in ("x0", "y0", "x1", "y1")))
    fields = {
        "card_id": F.col("pair_id"), "page_id": page, "source_page_id": page, "token_index": F.col("order_index").cast("int"), "layout_type": F.lit("pair"),
        "word": F.coalesce("caption_text", F.lit("")), "bbox_xyxy": box, "method": F.lit("pair_sam"), "front_image_path": picture_path(), "source_ref": page,
        "confidence": F.coalesce("confidence", F.lit(0.0)), "needs_review": F.coalesce("needs_review", F.lit(False)),
        "status": F.when(F.col("needs_review"), "review").otherwise("active"), "created_at": stamp, "updated_at": stamp, "reasons": F.col("reasons"),
    }
    names = ("card_id", "page_id", "word", "front_image_path", "confidence", "needs_review", "status") if short else tuple(fields)
    return pairs.select(*(fields[c].alias(c) for c in names))


def cards_of_pairs(pairs: DataFrame) -> DataFrame:
    """Cards for a quick export: a picture's path with its caption, reviewed where the pair is."""
    path = picture_path()
    return pairs.select(F.sha1(F.encode("pair_id", "utf-8")).alias("card_id"), "page_id", F.col("page_id").cast("string").alias("source_ref"), F.col("order_index").cast("int").alias("token_index"), F.col("caption_text").alias("word"), F.lit("bbox_crop").alias("method"), "confidence", "needs_review", F.when(F.col("needs_review"), "review").otherwise("active").alias("status"), "reasons", path.alias("front_image_path"))
