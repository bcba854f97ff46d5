"""Command line: run, validate, export, apply-review, review-ui, learning-stats,
apply-pair-feedback, build-flashcards, generate-review-html, extract, extract-pairs."""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extract, jobfiles, pairfiles, plugins, sinks, sources
from .operators import checks, jobs, matching, pages, review, summaries
from .sources import scan


def job(spark: SparkSession, tokens_path: str, width: int, height: int, source: str, min_confidence: float = 0.7, config: jobfiles.Config | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cards, review queue, metrics) of stored OCR pages."""
    tokens = sources.read_token_pages(spark, tokens_path)
    clean = pages.clean_tokens(tokens, config.clean) if config else pages.clean_tokens(tokens)
    seen = tokens.select("page_id").distinct().withColumns({"width": F.lit(width), "height": F.lit(height)})
    kinds = pages.layouts(seen, clean)
    cropped = pages.crops(clean, width, height, config.crop if config else pages.CropOptions(padding=10)).withColumn("token_index", F.col("rank").cast("int")).withColumn("source_ref", F.concat_ws("/", F.lit(source), "page_id"))
    made = pages.cards(cropped, min_confidence).withColumn("front_image_path", F.concat(F.lit("pages/crops/"), "card_id", F.lit(".png")))
    return made, pages.review_rows(made), pages.page_metrics(kinds, made)


def _cards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(sources.JOB_CARD).json(f"{folder}/result")


def _made(name: str | None):
    """The class that ``module:name`` names, or None."""
    if name is None:
        return None
    module, _, of = name.partition(":")
    return getattr(importlib.import_module(module), of)


def _images(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Decoded pages of an image, a document or a folder of both; documents need a renderer."""
    kind, path = jobfiles.resolve_input(a.input)
    images = extract.decoded(spark, path) if kind != "pdf" else None
    renderer = _made(a.renderer)
    if renderer is None:
        if images is None:
            raise ValueError("a document needs --renderer")
        return images
    shown = scan.document_images(spark, path, renderer, a.dpi)
    return shown if images is None else images.unionByName(shown)


def _tokens(spark: SparkSession, a: argparse.Namespace, images: DataFrame) -> DataFrame:
    """Stored OCR results, an engine's, or without either a placeholder for each cell of a page."""
    if a.tokens:
        return sources.read_token_pages(spark, a.tokens)
    if a.ocr:
        return plugins.run_ocr(images, _made(a.ocr)).filter("error is null").drop("error")
    return matching.placeholder_texts(images.select("page_id", F.col("image.width").alias("width"), F.col("image.height").alias("height")))


def quick(spark: SparkSession, a: argparse.Namespace) -> int:
    """Pictures with their captions from an image or a folder: files by page, a summary, and an export."""
    strict = extract.STRICT if a.strict else {"max_area_ratio": a.max_area_ratio, "min_edge_density": a.min_edge_density}
    options = extract.PairOptions(**strict)
    job_name = jobfiles.input_id(a.input) if a.command == "extract" else jobfiles.now().replace(":", "-").replace("T", "_")[:19] + "_" + jobfiles.input_id(a.input)[:8]
    folder = os.path.join(a.workspace, "output", f"job_{job_name}")
    images = _images(spark, a)
    found, summary = extract.extract_pairs_from_pages(images, _tokens(spark, a, images), _made(a.detector), options)
    # every later step reads what was found once
    found.write.mode("overwrite").parquet(f"{folder}/stage/pairs")
    summary.write.mode("overwrite").parquet(f"{folder}/stage/summaries")
    found, summary = spark.read.parquet(f"{folder}/stage/pairs"), spark.read.parquet(f"{folder}/stage/summaries")
    pairfiles.write_files(pairfiles.pair_files(images, found), folder)
    told = pairfiles.write_job_summary(summary, found, folder, job_name, dataclasses.asdict(options))
    if a.command == "extract-pairs" and a.debug_viz:
        pairfiles.write_files(pairfiles.drawings(images, found), folder)
    print(f"job_id={job_name} pages={told['pages_processed']} pairs={told['total_pairs']} review={told['total_needing_review']} output={folder}")
    if not told["pages_processed"]:
        print("no pages found")
        return 1
    if a.export:
        cards = extract.quick_cards(found, told["created_at"], a.command == "extract-pairs")
        cards.write.mode("overwrite").json(f"{folder}/result")
        full = extract.quick_cards(found, told["created_at"])
        if a.export.endswith(".apkg"):
            n = sinks.export_apkg(full, a.export, a.deck_name or os.path.splitext(os.path.basename(os.path.normpath(a.input)))[0], sinks.Folder(folder))
        elif a.export.endswith(".csv"):
            n = sinks.export_csv(full, a.export)
        else:
            raise ValueError(f"unknown export format: {a.export}")
        print(f"exported={n}")
    return 0


def validate(spark: SparkSession, a: argparse.Namespace, cards: DataFrame) -> int:
    """Counts of what a job breaks, then its messages by category; ``--files`` also asks for the
    contract's files and the cards' images, ``--apkg`` checks a package."""
    queue = spark.read.schema(f"{sources.QUEUE}, source_ref string").json(f"{a.job_dir}/review_queue")
    metrics = spark.read.schema("finished boolean, completed_at string, pages_processed int, pages_total int").json(f"{a.job_dir}/metrics")
    named = lambda df, file, rule="rule": df.select(F.concat(F.lit(f"{file}: "), F.col(rule)).alias("message"))
    bad_cards, bad_queue = review.card_violations(cards), jobs.review_violations(queue)
    found = {
        "invalid_cards": named(bad_cards, "result"),
        "invalid_review_items": named(bad_queue, "review_queue"),
        "invalid_metrics": named(jobs.metrics_violations(metrics.withColumn("pages_processed", F.coalesce("pages_processed", "pages_total"))), "metrics"),
    }
    if a.files:
        held = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(a.job_dir)
        files = held.select(F.get(F.split("path", f"\\Q{os.path.abspath(a.job_dir)}/\\E", 2), F.lit(1)).alias("path"))
        present = jobfiles.present_files(spark, {"job": a.job_dir}).select("job_id", F.when(F.col("name").contains("."), F.col("name")).when(F.col("name") == "errors", "errors.jsonl").otherwise(F.concat("name", F.lit(".json"))).alias("name"))
        found["missing_contract_files"] = named(summaries.missing_files(present, spark.createDataFrame([("job",)], "job_id string")), "missing", "name")
        found["missing_images"] = summaries.missing_images(cards, files).select(F.concat_ws(" ", F.when(F.col("problem") == "missing", "missing card image:").otherwise("unsafe card front_image_path:"), "path").alias("message"))
    if a.apkg:
        found["apkg"] = checks.package_errors(sources.read_apkg(spark, a.apkg)).select("message")
    for name, rows in found.items():
        print(f"{name}={rows.count()}")
    buckets = jobs.error_buckets(summaries.errors_of(*found.values())).collect()
    for r in buckets:
        print(r.asDict())
    print("ERRORS" if buckets else "OK")
    return int(bool(buckets))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="pageflow")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("run")
    p.add_argument("--tokens", required=True)
    p.add_argument("--job-dir", required=True)
    p.add_argument("--width", type=int, required=True)
    p.add_argument("--height", type=int, required=True)
    p.add_argument("--source", default="pages")
    p.add_argument("--min-confidence", type=float, default=0.7)
    p.add_argument("--images")
    p.add_argument("--config")
    for name, extra in (("validate", ()), ("export", ("--format", "--out")), ("apply-review", ("--feedback", "--out")), ("review-ui", ("--out",)), ("learning-stats", ("--feedback",))):
        p = commands.add_parser(name)
        p.add_argument("--job-dir", required=True)
        for x in extra:
            p.add_argument(x, required=True)
        if name == "export":
            p.add_argument("--include-review", action="store_true")
            for x in ("--deck-name", "--tags"):
                p.add_argument(x)
        if name == "validate":
            p.add_argument("--apkg")
            p.add_argument("--files", action="store_true")
    for name, extra in (("apply-pair-feedback", ("--feedback",)), ("build-flashcards", ()), ("generate-review-html", ())):
        p = commands.add_parser(name)
        for x in ("--pairs", "--out", *extra):
            p.add_argument(x, required=True)
        if name == "generate-review-html":
            p.add_argument("--images")
        if name == "build-flashcards":
            p.add_argument("--source", default="")
            p.add_argument("--sides", default="both", choices=("both", "forward", "reverse"))
    for name in ("extract", "extract-pairs"):
        p = commands.add_parser(name)
        p.add_argument("--input", required=True)
        p.add_argument("--workspace", default="./workspace")
        for x in ("--tokens", "--ocr", "--detector", "--renderer", "--export", "--deck-name"):
            p.add_argument(x)
        p.add_argument("--min-edge-density", type=float, default=0.05)
        p.add_argument("--max-area-ratio", type=float, default=0.15)
        p.add_argument("--dpi", type=int, default=300)
        p.add_argument("--strict", action="store_true")
        if name == "extract-pairs":
            p.add_argument("--debug-viz", action="store_true")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "run":
        sinks.write_job(*job(spark, a.tokens, a.width, a.height, a.source, a.min_confidence, jobfiles.load_config(a.config) if a.config else None), a.job_dir)
        sinks.write_errors(spark.createDataFrame([], "page_id string, stage string, message string"), f"{a.job_dir}/errors")
        if a.images:
            pairfiles.write_files(pairfiles.card_crops(extract.decoded(spark, a.images), _cards(spark, a.job_dir)), a.job_dir)
        return 0
    if a.command in ("extract", "extract-pairs"):
        try:
            return quick(spark, a)
        except (ValueError, OSError) as e:
            print(f"{a.command} failed: {e}")
            return 1
    if "pairs" in a:
        pairs = sources.read_pairs(spark, a.pairs)
        if a.command == "apply-pair-feedback":
            done = review.apply_pair_feedback(pairs.withColumnRenamed("caption_text", "caption"), sources.read_feedback(spark, a.feedback)).withColumnRenamed("caption", "caption_text")
            sinks.write_pairs(done.drop("older"), a.out)
        elif a.command == "build-flashcards":
            kept = pairs.filter(F.coalesce(F.col("status") != "rejected", F.lit(True)))
            pages.pair_cards(kept, a.source, jobfiles.now(), ("forward", "reverse") if a.sides == "both" else (a.sides,)).write.mode("overwrite").json(a.out)
        else:
            print(sinks.pair_review_page(sinks.with_images(spark, pairs, a.images), a.out))
        return 0
    cards = _cards(spark, a.job_dir)
    if a.command == "validate":
        return validate(spark, a, cards)
    if a.command == "export":
        if a.format == "csv":
            n = sinks.export_csv(cards, a.out, a.include_review)
        else:
            n = sinks.export_apkg(cards, a.out, a.deck_name or sinks.deck_name(cards, os.path.basename(os.path.normpath(a.job_dir))), sinks.Folder(a.job_dir), a.tags)
        print(n)
    elif a.command == "apply-review":
        said = sources.read_feedback(spark, a.feedback)
        queue = spark.read.schema(sources.QUEUE).json(f"{a.job_dir}/review_queue")
        metrics = spark.read.json(f"{a.job_dir}/metrics")
        sinks.write_job(review.apply_card_feedback(cards, said), jobs.open_queue(queue, review.last_cards(cards), said), metrics, a.out)
        print(jobs.feedback_counters(review.last_cards(cards), said).first().asDict())
    elif a.command == "review-ui":
        sinks.review_page(spark.read.schema(sources.QUEUE).json(f"{a.job_dir}/review_queue"), a.out)
    else:
        review.learning_stats(review.training_records(cards, sources.read_feedback(spark, a.feedback))).show()
    return 0


if __name__ == "__main__":
    sys.exit(main())
