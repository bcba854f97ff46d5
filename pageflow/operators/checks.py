"""Checks of a job's raw rows, its files and its package; each finding is a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import review

#: Keys that a card and a review row must have (fixed values).
CARD_KEYS = ("card_id", "method", "bbox_xyxy", "front_image_path", "page_id", "source_ref", "source_page_id", "token_index")
REVIEW_KEYS = ("card_id", "review_reason", "page_id", "source_ref", "front_image_path")


def _at(row: Column, key: str) -> Column:
    """A field as it is: null where the key is missing."""
    return F.try_variant_get(row, f"$.{key}", "variant")


def _is(row: Column, key: str, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(_at(row, key)) == kind, F.lit(False))


def _said(row: Column, key: str) -> Column:
    """A field's text, null if it holds none."""
    return F.when(_is(row, key, "STRING"), F.try_variant_get(row, f"$.{key}", "string"))


def _blank(row: Column, key: str) -> Column:
    return F.coalesce(text.strip(_said(row, key)), F.lit("")) == ""


def _bad_box(row: Column) -> Column:
    """A box that is neither null nor four whole numbers."""
    v = _at(row, "bbox_xyxy")
    parts = F.try_variant_get(row, "$.bbox_xyxy", "array<variant>")
    whole = (F.size(parts) == 4) & F.forall(parts, lambda x: F.schema_of_variant(x).isin("BIGINT", "BOOLEAN"))
    return v.isNotNull() & ~F.is_variant_null(v) & ~F.coalesce(whole, F.lit(False))


def _found(rows: DataFrame, keys: tuple[str, ...], rules: dict[str, Column]) -> DataFrame:
    row = F.col("_row")
    lacks = {f"missing field {k}": _at(row, k).isNull() for k in keys}
    listed = F.array_compact(F.array(*(F.when(test, name) for name, test in {**lacks, **rules}.items())))
    whole = F.coalesce(F.schema_of_variant(row).startswith("OBJECT"), F.lit(False))
    t = rows.withColumn("_row", F.try_parse_json("json"))
    return t.select("idx", F.explode(F.when(whole, listed).otherwise(F.array(F.lit("not an object")))).alias("problem"))


def _wrong_id(row: Column) -> Column:
    return ~F.coalesce(_said(row, "card_id").rlike("^[0-9a-fA-F]{40}$"), F.lit(False))


def strict_cards(rows: DataFrame) -> DataFrame:
    """(idx, problem) of cards as they were written (idx, json): keys, types, ids, methods and
    the rule that a degraded card is reviewed.  A whole number in quotes, or true, is none."""
    row = F.col("_row")
    method = _said(row, "method")
    reviewed = F.coalesce(F.try_variant_get(row, "$.needs_review", "boolean"), F.lit(False))
    reasons = F.try_variant_get(row, "$.reasons", "array<string>")
    rules = {
        "card_id": _wrong_id(row),
        "source_page_id": _blank(row, "source_page_id"),
        "token_index": ~_is(row, "token_index", "BIGINT"),
        "front_image_path": _blank(row, "front_image_path"),
        "method": ~F.coalesce(method.isin(*review.METHODS), F.lit(False)),
        "fallback requires needs_review=true": F.coalesce(method.isin("page_fallback", "bbox_fallback"), F.lit(False)) & ~reviewed,
        "SEGMENT_FAILED requires needs_review=true": F.coalesce(F.array_contains(reasons, "SEGMENT_FAILED"), F.lit(False)) & ~reviewed,
        "bbox_xyxy": _bad_box(row),
    }
    return _found(rows, CARD_KEYS, rules)


def strict_reviews(rows: DataFrame) -> DataFrame:
    """(idx, problem) of review rows as they were written (idx, json)."""
    row = F.col("_row")
    rules = {"card_id": _wrong_id(row), "review_reason": _blank(row, "review_reason"), "front_image_path": _blank(row, "front_image_path"), "bbox_xyxy": _bad_box(row)}
    return _found(rows, REVIEW_KEYS, rules)


def package_errors(notes: DataFrame) -> DataFrame:
    """(path, message) of packages as sources.read_apkg() reads them: unreadable ones, media
    that notes use and the mapping lacks, and media whose entry isn't in the archive.  A name
    that several numbers have needs one entry only."""
    broken = notes.filter("error is not null").select("path", F.col("error").alias("message"))
    sound = notes.filter("error is null")
    used = sound.select("path", F.explode(text.media_refs(F.col("fields"))).alias("name")).distinct()
    packages = sound.groupBy("path").agg(F.first("media").alias("media"), F.first("entries").alias("entries"))
    named = packages.select("path", F.explode(F.from_json("media", "map<string,string>")).alias("number", "name"))
    entries = packages.select("path", F.explode(F.from_json("entries", "array<string>")).alias("number"))
    unmapped = used.join(named, ["path", "name"], "left_anti").select("path", F.concat(F.lit("apkg_missing_media_mapping: "), "name").alias("message"))
    held = named.join(entries, ["path", "number"], "left_semi")
    lost = used.join(named, ["path", "name"], "left_semi").join(held, ["path", "name"], "left_anti").select("path", F.concat(F.lit("apkg_missing_media_blob: "), "name").alias("message"))
    return broken.unionByName(unmapped).unionByName(lost)
