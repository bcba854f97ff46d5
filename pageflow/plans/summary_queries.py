"""Registered queries of counts, panels, learning, templates and checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import extract
from ..functions import geom, ids, text
from ..operators import assembly, checks, jobs, matching, pages, pixels, review, summaries
from . import adapters as A
from .queries import _BOXES, _CARDS, _CLEANED, _CROPS, _FB, _LAYOUT, _TOK, HEIGHT, WIDTH, _boxes, _cards, _cleaned, _crops, _layouts, query

_C = f"WITH c AS ({A.CARDS})"
_RAW_COUNTS = """r AS (SELECT page_id, count(*) AS raw_count FROM tok GROUP BY page_id), a AS (SELECT page_id, count(*) AS n, count(DISTINCT text) AS words FROM f WHERE k <= 200 GROUP BY page_id),
  counts AS (SELECT page_id, raw_count, coalesce(words, 0) AS clean_count, coalesce(n, 0) - coalesce(words, 0) AS deduped_count FROM r LEFT JOIN a USING (page_id))"""


@query(f"{_CLEANED}, {_RAW_COUNTS} SELECT * FROM counts")
def clean_counts(spark, sf):
    return summaries.clean_counts(A.tokens(spark, sf))


@query(f"{_CLEANED} SELECT page_id, string_agg(text, '|' ORDER BY rank) AS words FROM clean GROUP BY page_id")
def word_candidates(spark, sf):
    return summaries.word_candidates(_cleaned(spark, sf)).select("page_id", F.array_join("word_candidates", "|").alias("words"))


def _lost_pages(spark, sf):
    d = F.col("doc_id")
    return A.cards(spark, sf).select(d.alias("page_id"), "source_ref", F.col("front_image_path").alias("image_path"), F.when(d % 3 == 0, "single_word").otherwise("unknown").alias("layout_type"))


@query(f"""{_C} SELECT sha1(concat('doc#', CAST(doc_id AS VARCHAR(20)), '|', CAST(doc_id AS VARCHAR(20)), '|UNKNOWN|')) AS card_id, doc_id AS page_id, CASE WHEN doc_id % 3 = 0 THEN 'OCR_EMPTY' ELSE 'LAYOUT_UNCERTAIN' END AS review_reason,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'UNKNOWN' END AS text, CASE WHEN doc_id % 3 = 0 THEN 'manual_enter_word_or_fix_ocr' ELSE 'manual_review' END AS suggested_action FROM c""")
def unknown_pages(spark, sf):
    return summaries.unknown_review_rows(summaries.unknown_cards(_lost_pages(spark, sf))).select("card_id", "page_id", "review_reason", "text", "suggested_action")


@query(f"{_C} SELECT sha1(concat('doc#', CAST(doc_id AS VARCHAR(20)), '|', CAST(doc_id AS VARCHAR(20)), '||')) AS card_id, doc_id AS page_id, 'OCR_EMPTY' AS review_reason FROM c WHERE status <> 'active'")
def empty_pages(spark, sf):
    made = A.cards(spark, sf).filter("status = 'active'").select(F.col("doc_id").alias("page_id"))
    return summaries.empty_page_rows(_lost_pages(spark, sf), made).select("card_id", "page_id", "review_reason")


_PANELS = """g AS (SELECT page_id, ord, CASE WHEN ord % 4 = 0 THEN '' ELSE trim(text) END AS said, ord % 3 = 0 AS blank, greatest(0, least(1199, x0)) AS a0, greatest(0, least(1399, y0)) AS b0, greatest(1, least(1200, x1)) AS a1, greatest(1, least(1400, y1)) AS b1 FROM tok),
  panel AS (SELECT page_id, ord, (ord % 10) / 10.0 AS blank_score, concat_ws('|', CASE WHEN (a1 - a0) * (b1 - b0) < 1000 THEN 'SMALL_AREA' END, CASE WHEN blank THEN 'BLANK_CROP|LOW_ENTROPY' END, CASE WHEN said = '' THEN 'OCR_EMPTY' END) AS reasons FROM g)"""


def _panels(spark, sf):
    o = F.col("ord")
    t = A.tokens(spark, sf).select("page_id", o.alias("block_index"), "box", F.when(o % 4 == 0, "").otherwise(F.col("text")).alias("text"), (o % 10 / 10.0).alias("score"), (o % 3 == 0).alias("is_blank"), F.when(o % 3 == 0, F.array(F.lit("LOW_ENTROPY"), F.lit("BLANK_CROP"))).alias("blank_reasons"))
    return summaries.panels(t, WIDTH, HEIGHT)


@query(f"{_TOK}, {_PANELS} SELECT page_id, ord AS block_index, reasons, reasons <> '' AS needs_review, CASE WHEN reasons <> '' THEN 'review' ELSE 'active' END AS status FROM panel")
def panel_diagnostics(spark, sf):
    return _panels(spark, sf).select("page_id", "block_index", F.array_join("reasons", "|").alias("reasons"), "needs_review", "status")


_PANEL_COUNTS = "(SELECT count(*) AS panels_total, count(*) FILTER (reasons <> '') AS panels_needing_review, count(*) FILTER (blank_score > 0.7) AS panels_blank FROM panel)"


@query(f"{_TOK}, {_PANELS} SELECT * FROM {_PANEL_COUNTS}")
def panel_counts(spark, sf):
    return summaries.panel_counts(_panels(spark, sf))


@query(f"""{_CLEANED}, {_RAW_COUNTS}, {_LAYOUT}, {_CROPS}, {_CARDS}, {_PANELS.replace('g AS', 'g2 AS').replace('FROM g)', 'FROM g2)')}, s AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' ELSE 'skipped' END AS status FROM ({A.CARDS}) x)
  SELECT * FROM (SELECT count(*) AS pages_processed, count(*) FILTER (layout_type = 'single_word') AS pages_single_word, count(*) FILTER (layout_type = 'multi_word') AS pages_multi_word FROM layout),
  (SELECT count(*) FILTER (clean_count = 0) AS ocr_empty_count, CAST(coalesce(sum(deduped_count), 0) AS BIGINT) AS deduped_tokens FROM counts),
  (SELECT count(*) AS multiword_tokens, count(*) FILTER (crop_status = 'success') AS multiword_crops_written, count(*) FILTER (crop_status = 'failed') AS multiword_crop_failures, count(*) FILTER (crop_status = 'failed') AS multiword_crops_gated_small, CAST(0 AS BIGINT) AS multiword_crops_gated_ratio FROM crop),
  (SELECT count(*) AS cards_total, count(*) FILTER (needs_review) AS review_items_total, count(*) FILTER (needs_review) AS review_items FROM card),
  (SELECT count(*) FILTER (status = 'success') AS segment_success_count, count(*) FILTER (status = 'failed') AS segment_fail_count FROM s), {_PANEL_COUNTS}""")
def job_metrics(spark, sf):
    cards = _cards(spark, sf)
    kind = F.col("doc_id") % 3
    segments = A.cards(spark, sf).select(F.when(kind == 0, "success").when(kind == 1, "failed").otherwise("skipped").alias("status"))
    return summaries.job_metrics(_layouts(spark, sf), summaries.clean_counts(A.tokens(spark, sf)), _crops(spark, sf), cards, pages.review_rows(cards), segments, _panels(spark, sf))


@query(f"""{_C}, p AS (SELECT (doc_id % 10) / 10.0 > 0.7 AS bp, (doc_id % 7) / 7.0 > 0.7 AS bt, doc_id % 3 = 0 AS e, doc_id % 9000 < 5000 AS small FROM c)
  SELECT count(*) AS pairs_total, count(*) FILTER (bp OR bt OR e OR small) AS pairs_needing_review, count(*) FILTER (bp) AS pairs_blank_picture, count(*) FILTER (bt) AS pairs_blank_text, count(*) FILTER (e) AS pairs_ocr_empty FROM p""")
def grid_pair_metrics(spark, sf):
    d = F.col("doc_id")
    t = A.cards(spark, sf).select("page_id", d.alias("item_index"), (d % 10 / 10.0).alias("blank_picture"), (d % 7 / 7.0).alias("blank_text"), F.when(d % 3 == 0, "").otherwise(F.col("word")).alias("caption"), (d % 9000).alias("item_area"))
    return summaries.grid_pair_metrics(assembly.grid_pairs(t))


_SUMMARY = f"""{_BOXES}, j AS (SELECT p.page_id, t.ord AS text FROM pic p LEFT JOIN txt t ON t.page_id = p.page_id AND t.ord = p.ord + 1), s AS (
  SELECT page_id, (SELECT count(*) FROM pic WHERE pic.page_id = g.page_id) AS pictures_detected, (SELECT count(*) FROM txt WHERE txt.page_id = g.page_id) AS text_blocks_detected,
    (SELECT count(*) FROM j WHERE j.page_id = g.page_id) AS pairs_extracted, (SELECT count(*) FILTER (text IS NULL) FROM j WHERE j.page_id = g.page_id) AS pairs_needing_review,
    (SELECT count(*) FROM txt WHERE txt.page_id = g.page_id) - (SELECT count(text) FROM j WHERE j.page_id = g.page_id) AS unmatched_text_blocks FROM (SELECT DISTINCT page_id FROM tok) g)"""


def _summaries(spark, sf):
    p, t = _boxes(spark, sf)
    pairs = p.select("page_id", "ord").join(t.select("page_id", (F.col("ord") - 1).alias("ord"), F.col("ord").alias("text")), ["page_id", "ord"], "left").withColumn("needs_review", F.col("text").isNull())
    return summaries.page_summaries(A.tokens(spark, sf).select("page_id").distinct(), p, t, pairs)


@query(f"{_SUMMARY} SELECT * FROM s")
def page_summaries(spark, sf):
    return _summaries(spark, sf)


@query(f"""{_SUMMARY} SELECT count(*) AS pages_processed, CAST(sum(pairs_extracted) AS BIGINT) AS total_pairs, CAST(sum(pairs_needing_review) AS BIGINT) AS total_needing_review, CAST(sum(pictures_detected) AS BIGINT) AS total_pictures_detected,
  CAST(sum(text_blocks_detected) AS BIGINT) AS total_text_blocks_detected, CAST(sum(unmatched_text_blocks) AS BIGINT) AS total_unmatched_text FROM s""")
def job_totals(spark, sf):
    return summaries.job_totals(_summaries(spark, sf))


@query(f"{_TOK} SELECT substr(sha1(concat_ws('|', page_id, ord, concat_ws(',', x0, y0, x1, y1))), 1, 16) AS pair_id, page_id, ord AS item_index, 'EXTRACTION_FAILED' AS reasons, 0.0::DOUBLE AS confidence FROM tok WHERE ord % 6 = 0")
def failed_pairs(spark, sf):
    t = A.tokens(spark, sf).filter("ord % 6 = 0").withColumnRenamed("ord", "item_index")
    return summaries.failed_pairs(t).select("pair_id", "page_id", "item_index", F.array_join("reasons", "|").alias("reasons"), "confidence")


@query(f"""{_C}, p AS (SELECT doc_id % 4 = 0 AS e, status = 'rejected' AND doc_id % 4 <> 0 AS gone, doc_id % 4 = 0 OR needs_review AS review FROM c)
  SELECT count(*) AS pairs_seen, count(*) FILTER (gone) AS pairs_rejected, count(*) FILTER (NOT gone) AS cards_forward, count(*) FILTER (NOT gone AND NOT e) AS cards_reverse, count(*) FILTER (e) AS pairs_without_text, count(*) FILTER (NOT gone AND review) AS cards_review, count(*) FILTER (NOT gone AND NOT review) AS cards_active FROM p""")
def pair_card_stats(spark, sf):
    return summaries.pair_card_stats(A.cards(spark, sf).select(F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("word")).alias("caption_text"), "status", "needs_review"))


@query(f"WITH {_FB} SELECT (SELECT count(*) FROM f) AS total_records, (SELECT count(*) FROM c WHERE needs_review) AS caption_corrections, (SELECT count(*) FROM c WHERE doc_id < 50) AS cached_parameters, 0.55::DOUBLE AS blank_threshold")
def cache_stats(spark, sf):
    cards = A.cards(spark, sf)
    parameters = cards.filter("doc_id < 50").select(F.when(F.col("doc_id") == 7, "blank_threshold").otherwise(F.concat(F.lit("text_ratio_"), "card_id")).alias("key"), F.when(F.col("doc_id") == 7, "0.55").otherwise("bottom").alias("value"))
    return summaries.cache_stats(A.feedback(spark, sf), cards.filter("needs_review"), parameters)


_RULES = """r AS (SELECT ord, CASE WHEN ord % 6 = 0 THEN '' ELSE card_id END AS pair_id, CASE WHEN ord % 4 = 0 THEN '' WHEN ord % 4 = 1 THEN concat('n', CAST(ord AS VARCHAR(20))) END AS corrected_caption,
  CASE WHEN ord % 3 = 0 THEN edited_text END AS edited_caption, CASE WHEN ord % 5 = 0 THEN 'sideways' WHEN ord % 5 < 4 THEN direction END AS preferred FROM f)"""


def _rule_feedback(spark, sf):
    o = F.col("ord")
    return A.feedback(spark, sf).select("ord", F.when(o % 6 == 0, "").otherwise(F.col("card_id")).alias("pair_id"), F.when(o % 4 == 0, "").when(o % 4 == 1, F.concat(F.lit("n"), "ord")).alias("corrected_caption"), F.when(o % 3 == 0, F.col("edited_text")).alias("edited_caption"), F.when(o % 5 == 0, "sideways").when(o % 5 < 4, F.col("direction")).alias("preferred_search_direction"))


@query(f"WITH {_FB}, {_RULES}, t AS (SELECT *, coalesce(nullif(corrected_caption, ''), nullif(edited_caption, '')) AS caption FROM r) SELECT pair_id, arg_max(caption, ord) AS caption FROM t WHERE pair_id <> '' AND caption IS NOT NULL GROUP BY pair_id")
def rule_captions(spark, sf):
    return review.rule_captions(_rule_feedback(spark, sf))


@query(f"""WITH {_FB}, {_RULES} SELECT count(*) AS processed, count(*) FILTER (preferred IN ('below', 'above', 'right', 'left', 'nearest')) AS direction_changes,
  count(*) FILTER (pair_id <> '' AND coalesce(nullif(corrected_caption, ''), nullif(edited_caption, '')) IS NOT NULL) AS caption_corrections FROM r""")
def rule_stats(spark, sf):
    return review.rule_stats(_rule_feedback(spark, sf))


@query(f"WITH {_FB}, {_RULES} SELECT preferred AS direction, count(*) + CASE preferred WHEN 'above' THEN 3 ELSE 0 END AS votes FROM r WHERE preferred IN ('below', 'above', 'right', 'left', 'nearest') GROUP BY preferred")
def rule_votes(spark, sf):
    old = spark.createDataFrame([("above", 3, 0)], "direction string, votes long, first_ord long")
    return review.rule_votes(old, _rule_feedback(spark, sf)).select("direction", "votes")


@query(f"""WITH {_FB}, {_RULES} SELECT (SELECT count(DISTINCT concat('f', CAST(ord % 23 AS VARCHAR(9)))) FROM r) AS feedback_records, (SELECT count(*) FROM c WHERE needs_review) AS caption_corrections,
  (SELECT preferred FROM r WHERE preferred <> 'sideways' GROUP BY preferred ORDER BY count(*) DESC, min(ord) LIMIT 1) AS search_direction""")
def rules_stats(spark, sf):
    f = _rule_feedback(spark, sf)
    best = review.direction_vote(f.select("ord", F.col("preferred_search_direction").alias("direction")).filter(F.col("direction").isin(*review.DIRECTIONS)))
    return summaries.rules_stats(f.select(F.concat(F.lit("f"), F.col("ord") % 23).alias("file")), A.cards(spark, sf).filter("needs_review"), best)


@query(f"""WITH {_FB}, e AS (SELECT card_id AS page_id, ord, CASE WHEN ord % 3 = 0 THEN (ord % 10) / 10.0::DOUBLE END AS ratio, CASE WHEN ord % 4 = 0 THEN '' WHEN ord % 4 = 1 THEN direction END AS place FROM f WHERE action = 'edit'),
  n AS (SELECT page_id, arg_max(ratio, ord) FILTER (ratio IS NOT NULL) AS ratio, arg_max(place, ord) FILTER (place <> '') AS place FROM e GROUP BY page_id), o AS (SELECT card_id AS page_id, 0.3::DOUBLE AS ratio, 'bottom' AS place FROM c WHERE doc_id % 2 = 0)
  SELECT coalesce(o.page_id, n.page_id) AS page_id, coalesce(n.ratio, o.ratio) AS text_ratio, coalesce(n.place, o.place) AS text_position FROM o FULL JOIN n ON o.page_id = n.page_id WHERE coalesce(n.ratio, o.ratio) IS NOT NULL OR coalesce(n.place, o.place) IS NOT NULL""")
def learned_regions(spark, sf):
    o = F.col("ord")
    f = A.feedback(spark, sf).select("ord", F.col("card_id").alias("page_id"), F.upper("action").alias("action"), F.when(o % 3 == 0, o % 10 / 10.0).alias("corrected_text_ratio"), F.when(o % 4 == 0, "").when(o % 4 == 1, F.col("direction")).alias("corrected_text_position"))
    old = A.cards(spark, sf).filter("doc_id % 2 = 0").select(F.col("card_id").alias("page_id"), F.lit(0.3).alias("text_ratio"), F.lit("bottom").alias("text_position"))
    return review.learned_regions(old, f)


@query(f"WITH {_FB} SELECT count(*) AS processed, count(*) FILTER (action = 'approve') AS approved, count(*) FILTER (action = 'reject') AS rejected, count(*) FILTER (action = 'edit') AS edited FROM f WHERE card_id IN (SELECT card_id FROM c)")
def pair_feedback_stats(spark, sf):
    f = A.feedback(spark, sf).select("ord", F.col("card_id").alias("pair_id"), F.upper("action").alias("action"))
    return review.pair_feedback_stats(A.cards(spark, sf).select(F.col("card_id").alias("pair_id")), f)


@query(f"WITH {_FB} SELECT card_id, arg_max(action, ord) AS action, arg_max(edited_text, ord) AS edited_text, min(ord) AS place FROM f GROUP BY card_id")
def last_actions(spark, sf):
    return review.last_actions(A.feedback(spark, sf))


@query(f"{_TOK} SELECT page_id, arg_min(ord, (-(x1 - x0) * (y1 - y0), ord)) AS ord, max((x1 - x0) * (y1 - y0)) AS area FROM tok GROUP BY page_id")
def largest_masks(spark, sf):
    return summaries.largest_masks(A.tokens(spark, sf).withColumn("area", geom.area(F.col("box")))).select("page_id", "ord", "area")


@query(f"{_TOK} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY (x1 - x0) * (y1 - y0) DESC, ord) - 1 AS INT) AS place, ord, (x1 - x0) * (y1 - y0) AS area FROM tok")
def regions_by_area(spark, sf):
    return summaries.regions_by_area(A.tokens(spark, sf))


@query(f"{_C} SELECT card_id, CASE WHEN doc_id % 5 = 0 THEN 'OLD' WHEN doc_id % 7 = 0 THEN '' ELSE 'NEW' END AS review_reason FROM c WHERE doc_id % 11 <> 0")
def review_items(spark, sf):
    d = F.col("doc_id")
    raw = A.cards(spark, sf).select(F.when(d % 11 != 0, F.col("card_id")).alias("card_id"), F.when(d % 5 == 0, "").when(d % 7 != 0, "NEW").alias("review_reason"), F.when(d % 5 == 0, "OLD").alias("reason"))
    return summaries.review_items(raw).select("card_id", "review_reason")


@query(f"""{_C}, w AS (SELECT doc_id AS job_id, unnest(['result.json', 'review_queue.json', 'metrics.json', 'errors.jsonl']) AS name, doc_id FROM c)
  SELECT job_id, name FROM w WHERE NOT (name = 'result.json' OR name = 'metrics.json' AND doc_id % 2 = 0 OR name = 'errors.jsonl' AND doc_id % 3 = 0)""")
def missing_files(spark, sf):
    d = F.col("doc_id")
    found = F.array_compact(F.array(F.lit("result.json"), F.when(d % 2 == 0, "metrics.json"), F.when(d % 3 == 0, "errors.jsonl"), F.lit("other.txt")))
    cards = A.cards(spark, sf)
    return summaries.missing_files(cards.select(d.alias("job_id"), F.explode(found).alias("name")), cards.select(d.alias("job_id")))


@query(f"{_C} SELECT doc_id AS job_id, 'input_path' AS rule FROM c WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'source' FROM c WHERE doc_id % 9 = 0")
def job_violations(spark, sf):
    d = F.col("doc_id")
    return summaries.job_violations(A.cards(spark, sf).select(d.alias("job_id"), F.when(d % 9 != 0, "scan").alias("source"), F.lit("2026").alias("created_at"), F.lit("images").alias("input_type"), F.when(d % 4 != 0, "in").alias("input_path")))


@query(f"""{_C} SELECT card_id, front_image_path AS path, CASE WHEN front_image_path LIKE '/%' THEN 'absolute' WHEN front_image_path LIKE '../%' THEN 'parent' ELSE 'missing' END AS problem
  FROM c WHERE front_image_path <> '' AND (front_image_path LIKE '/%' OR front_image_path LIKE '../%' OR doc_id % 50 >= 10)""")
def missing_images(spark, sf):
    cards = A.cards(spark, sf)
    files = cards.filter("doc_id % 50 < 10").select(F.col("front_image_path").alias("path")).distinct()
    return summaries.missing_images(cards, files)


_SIZES = "SELECT doc_id AS page_id, CAST(40 + n_chars % 900 AS INT) AS width, CAST(60 + n_chars * 7 % 1900 AS INT) AS height FROM documents"


def _sizes(spark, sf):
    return A.table(spark, sf, _SIZES)


@query(f"""WITH p AS ({_SIZES}), g AS (SELECT * FROM (VALUES (0, 2, 3), (1, 2, 4), (2, 3, 3), (3, 3, 4), (4, 4, 3), (5, 2, 5), (6, 2, 6)) AS v(i, cols, rows)),
  b AS (SELECT p.*, coalesce(cols, 1) AS cols, coalesce(rows, 1) AS rows FROM p LEFT JOIN g ON p.width // g.cols >= 50 AND p.height // g.rows >= 50 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY cols * rows DESC, i) = 1),
  c AS (SELECT *, unnest(range(rows)) AS r FROM b), d AS (SELECT *, unnest(range(cols)) AS k FROM c)
  SELECT page_id, CAST(k * (width // cols) AS INT) AS x0, CAST(r * (height // rows) AS INT) AS y0, CAST(least((k + 1) * (width // cols), width) AS INT) AS x1, CAST(least((r + 1) * (height // rows), height) AS INT) AS y1 FROM d""")
def template_cells(spark, sf):
    return matching.template_cells(_sizes(spark, sf))


@query(f"""WITH p AS ({_SIZES}), b AS (SELECT *, greatest(1, least(4, width // 300)) AS cols, greatest(1, least(6, height // 300)) AS rows FROM p), c AS (SELECT *, unnest(range(rows)) AS r FROM b), d AS (SELECT *, unnest(range(cols)) AS k FROM c),
  e AS (SELECT page_id, r, k, k * (width // cols) + 10 AS x0, r * (height // rows) + CAST(trunc((height // rows) * 0.7::DOUBLE) AS INT) AS y0, (k + 1) * (width // cols) - 10 AS x1, (r + 1) * (height // rows) - 10 AS y1 FROM d)
  SELECT page_id, concat('[cell_', r, '_', k, ']') AS text, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1 FROM e WHERE x1 - x0 >= 50 AND y1 - y0 >= 20""")
def placeholder_texts(spark, sf):
    return matching.placeholder_texts(_sizes(spark, sf)).select("page_id", "text", *(F.col(f"box.{c}").cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")))


_BORDERED = """l AS (SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS page_id, CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'v' END AS axis, CAST(l_partkey % 900 AS INT) AS line FROM lineitem),
  s AS (SELECT page_id, unnest(['h', 'v']) AS axis, unnest([1400, 1200]) AS size FROM (SELECT DISTINCT page_id FROM l)), e AS (SELECT s.page_id, s.axis, s.size, min(line) AS lo, max(line) AS hi FROM s LEFT JOIN l USING (page_id, axis) GROUP BY ALL),
  b AS (SELECT page_id, axis, line FROM l UNION ALL SELECT page_id, axis, 0 FROM e WHERE lo IS NULL OR lo > 50 UNION ALL SELECT page_id, axis, size FROM e WHERE hi IS NULL OR hi < size - 50),
  n AS (SELECT *, lead(line) OVER (PARTITION BY page_id, axis ORDER BY line) AS nxt FROM b), k AS (SELECT h.page_id, v.line AS x0, h.line AS y0, v.nxt AS x1, h.nxt AS y1 FROM n h JOIN n v ON h.page_id = v.page_id AND h.axis = 'h' AND v.axis = 'v'
    WHERE h.nxt - h.line >= 50 AND v.nxt - v.line >= 50 AND (h.nxt - h.line) * (v.nxt - v.line) >= 5000)"""


def _blocks(spark, sf):
    lines = A.table(spark, sf, "SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS page_id, CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'v' END AS axis, CAST(l_partkey % 900 AS INT) AS line FROM lineitem")
    found = lines.select("page_id").distinct().withColumns({"width": F.lit(1200), "height": F.lit(1400)})
    return matching.grid_cells(matching.bordered(lines, found))


@query(f"WITH {_BORDERED} SELECT * FROM k")
def grid_blocks(spark, sf):
    return _blocks(spark, sf)


@query(f"WITH {_BORDERED} SELECT page_id, count(DISTINCT y0) AS grid_rows, count(DISTINCT x0) AS grid_cols, count(*) AS items_detected FROM k GROUP BY page_id")
def grid_size(spark, sf):
    return matching.grid_size(_blocks(spark, sf))


@query(f"""{_TOK.replace('WITH', 'WITH RECURSIVE', 1)}, b AS (SELECT page_id, ord, x0, y0, x1, y1, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS k FROM tok),
  f AS (SELECT page_id, k, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'ord': ord}}] AS kept FROM b WHERE k = 1
    UNION ALL SELECT b.page_id, b.k, CASE WHEN len(list_filter(f.kept, lambda a: greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.5 * ((b.x1 - b.x0) * (b.y1 - b.y0)))) > 0
      THEN f.kept ELSE list_append(f.kept, {{'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1, 'ord': b.ord}}) END FROM f JOIN b ON b.page_id = f.page_id AND b.k = f.k + 1)
  SELECT page_id, unnest(kept).ord AS ord FROM f QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY k DESC) = 1""")
def overlap_dedupe(spark, sf):
    return matching.without_repeats(A.tokens(spark, sf)).select("page_id", "ord")


@query(f"""{_TOK}, l AS (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY page_id ORDER BY y0, ord) >= 70 THEN 1 ELSE 0 END AS s FROM tok)
  SELECT page_id, ord, CAST(sum(s) OVER (PARTITION BY page_id ORDER BY y0, ord) AS INT) AS row FROM l""")
def contour_rows(spark, sf):
    return matching.rows_by_gap(A.tokens(spark, sf), HEIGHT // 20).select("page_id", "ord", "row")


@query("SELECT page_id, html AS text FROM pages")
def unescape_round_trip(spark, sf):
    return A.read(spark, sf, "pages").select("page_id", text.html_unescape(text.html_escape(F.col("html"))).alias("text"))


@query(f"{_C} SELECT card_id, substr(sha1(concat_ws('|', card_id, status, '2026-01-01T00:00:00+00:00')), 1, 16) AS record_id, CASE WHEN doc_id % 3 = 0 THEN 1000000000 ELSE token_index END AS place FROM c")
def record_ids(spark, sf):
    path = F.when(F.col("doc_id") % 3 == 0, "img/c.png").otherwise(F.concat(F.lit("img/token_"), F.lpad(F.col("token_index").cast("string"), 4, "0"), F.lit("_x.png")))
    return A.cards(spark, sf).select("card_id", ids.record_id(F.col("card_id"), F.col("status"), F.lit("2026-01-01T00:00:00+00:00")).alias("record_id"), text.token_index_in(path).alias("place"))


@query(f"{_TOK} SELECT page_id, ord, least(x0, y1) AS x0, least(y0, x1) AS y0, greatest(x0, y1) AS x1, greatest(y0, x1) AS y1 FROM tok")
def polygon_boxes(spark, sf):
    b = F.col("box")
    half = lambda x, y: F.array(x + 0.5, y + 0.25)
    found = geom.polygon_box(F.array(half(b["x0"], b["y0"]), half(b["y1"], b["x1"])))
    return A.tokens(spark, sf).select("page_id", "ord", found.alias("p")).select("page_id", "ord", "p.*")


_G = f"CAST((x1 - x0) * (y1 - y0) AS DOUBLE) / {WIDTH * HEIGHT}"
_S = "CAST(x1 - x0 AS DOUBLE) / greatest(1, y1 - y0)"


@query(f"""{_TOK} SELECT page_id, ord, {_G} BETWEEN 0.001 AND 0.3 AND {_S} BETWEEN 0.25 AND 4 AS unified, {_G} BETWEEN 0.001 AND 0.1 AND {_S} BETWEEN 0.3 AND 3 AND x1 - x0 >= 80 AND y1 - y0 >= 80 AND x0 >= 50 AND y0 >= 50 AND x1 <= 1150 AND y1 <= 1350 AS contour,
  CASE WHEN {_G} > 0.0025 AND {_S} > 0.5 AND {_S} < 2 THEN 'picture' ELSE 'text' END AS edges, CASE WHEN {_G} > 0.0008 AND {_S} > 0.35 AND {_S} < 2.8 THEN 'picture' ELSE 'text' END AS debug FROM tok""")
def region_rules(spark, sf):
    b = F.col("box")
    kept = lambda rule: assembly.region_kept(b, WIDTH, HEIGHT, rule).alias(rule)
    kind = lambda rule: assembly.region_class(b, WIDTH, HEIGHT, rule).alias(rule)
    return A.tokens(spark, sf).select("page_id", "ord", kept("unified"), kept("contour"), kind("edges"), kind("debug"))


@query(f"""{_TOK} SELECT page_id, ord, (x1 - x0) * (y1 - y0) >= 200 AND length(trim(text)) >= 2 AND confidence >= 0.3 AS tesseract, (x1 - x0) * (y1 - y0) >= 200 AND confidence >= 0.15 AND (length(trim(text)) > 1 OR regexp_matches(trim(text), '^\\p{{L}}$')) AS easyocr,
  length(trim(text)) >= 2 AND confidence >= 0.3 AS plain FROM tok""")
def text_prefilters(spark, sf):
    t = A.tokens(spark, sf)
    out = t.select("page_id", "ord")
    for rule in ("tesseract", "easyocr", "plain"):
        kept = jobs.text_gate(t, rule).select("page_id", "ord", F.lit(True).alias(rule))
        out = out.join(kept, ["page_id", "ord"], "left").withColumn(rule, F.coalesce(rule, F.lit(False)))
    return out


@query(f"""WITH {_FB}, t AS (SELECT f.ord, f.card_id, f.action, c.word, c.page_id, c.method, CASE WHEN f.action = 'edit' THEN edited_text END AS e FROM f JOIN c USING (card_id) WHERE f.action IN ('approve', 'reject', 'edit'))
  SELECT card_id, ord, action, word AS predicted_text, page_id, method, e AS corrected_text, substr(sha1(concat_ws('|', card_id, action, CAST(ord AS VARCHAR(20)))), 1, 16) AS record_id FROM t""")
def training_records(spark, sf):
    f = A.feedback(spark, sf).withColumn("created_at", F.col("ord").cast("string")).withColumn("action", F.initcap("action"))
    return review.training_records(A.cards(spark, sf), f).select("card_id", "ord", "action", "predicted_text", "page_id", "method", "corrected_text", "record_id")


_PXW = f"WITH px AS ({A.PX_SQL})"


@query(f"""{_PXW}, q AS (SELECT key, quantile_cont(value, 0.9) AS q FROM px GROUP BY key), h AS (SELECT key, i FROM px JOIN q USING (key) WHERE value > q),
  g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY key ORDER BY i) >= 5 THEN 1 ELSE 0 END AS s FROM h), c AS (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY i) AS grp FROM g)
  SELECT key, CAST(trunc(avg(i)) AS INT) AS line FROM c GROUP BY key, grp""")
def profile_peaks(spark, sf):
    return pixels.profile_peaks(A.pixels(spark, sf), 5)


@query(f"{_PXW} SELECT key, round(100.0 * count(*) FILTER (abs(value - 188) > 25) / count(*), 6) AS foreground FROM px GROUP BY key")
def foreground_share(spark, sf):
    return pixels.foreground_share(A.pixels(spark, sf))


@query(f"{_PXW}, n AS (SELECT value, count(*) AS n FROM px GROUP BY value) SELECT value, n FROM n ORDER BY n DESC, value DESC LIMIT 5")
def top_brightness(spark, sf):
    return pixels.top_values(A.pixels(spark, sf))


#: Cards as they might have been written, some with wrong types or without a field.
RAW = """SELECT CAST(doc_id AS BIGINT) AS idx, CASE WHEN doc_id % 31 = 0 THEN '[1]' ELSE concat('{"card_id":"', CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE sha1(CAST(doc_id AS VARCHAR(20))) END, '"',
  ',"method":"', CASE WHEN doc_id % 11 = 0 THEN 'page_fallback' WHEN doc_id % 13 = 0 THEN 'other' ELSE 'bbox_crop' END, '"',
  CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 3 = 0 THEN ',"token_index":"1"' WHEN doc_id % 8 = 1 THEN ',"token_index":true' ELSE concat(',"token_index":', CAST(doc_id AS VARCHAR(20))) END,
  CASE WHEN doc_id % 4 = 0 THEN ',"bbox_xyxy":null' WHEN doc_id % 9 = 0 THEN ',"bbox_xyxy":[1,2,3]' WHEN doc_id % 10 = 1 THEN ',"bbox_xyxy":[1,2,3,4.5]' ELSE ',"bbox_xyxy":[1,2,3,4]' END,
  CASE WHEN doc_id % 6 = 0 THEN ',"reasons":["SEGMENT_FAILED"]' ELSE ',"reasons":[]' END, ',"needs_review":', CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END,
  ',"front_image_path":"', CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE 'a.png' END, '","page_id":"p","source_ref":"s","source_page_id":"p"}') END AS json FROM documents"""


@query(f"""WITH r AS ({RAW}), v AS (SELECT idx, CAST(json AS JSON) AS j FROM r), o AS (SELECT * FROM v WHERE json_type(j) = 'OBJECT'),
  b AS (SELECT *, json_extract_string(j, '$.method') IN ('page_fallback', 'bbox_fallback') AS fallback, json_extract_string(j, '$.needs_review') = 'true' AS reviewed, json_type(j, '$.bbox_xyxy') AS kind FROM o)
  SELECT idx, 'not an object' AS problem FROM v WHERE json_type(j) <> 'OBJECT'
  UNION ALL SELECT idx, 'missing field token_index' FROM o WHERE json_type(j, '$.token_index') IS NULL
  UNION ALL SELECT idx, 'card_id' FROM o WHERE NOT regexp_full_match(json_extract_string(j, '$.card_id'), '[0-9a-fA-F]{{40}}')
  UNION ALL SELECT idx, 'token_index' FROM o WHERE coalesce(json_type(j, '$.token_index'), '') NOT IN ('UBIGINT', 'BIGINT')
  UNION ALL SELECT idx, 'front_image_path' FROM o WHERE trim(json_extract_string(j, '$.front_image_path')) = ''
  UNION ALL SELECT idx, 'method' FROM o WHERE json_extract_string(j, '$.method') = 'other'
  UNION ALL SELECT idx, 'fallback requires needs_review=true' FROM b WHERE fallback AND NOT reviewed
  UNION ALL SELECT idx, 'SEGMENT_FAILED requires needs_review=true' FROM b WHERE json_array_length(j, '$.reasons') > 0 AND NOT reviewed
  UNION ALL SELECT idx, 'bbox_xyxy' FROM b WHERE kind <> 'NULL' AND NOT (kind = 'ARRAY' AND json_array_length(j, '$.bbox_xyxy') = 4 AND json_type(j, '$.bbox_xyxy[3]') <> 'DOUBLE')""")
def strict_cards(spark, sf):
    return checks.strict_cards(A.table(spark, sf, RAW))


@query(f"""WITH c AS ({A.CARDS}), m AS (SELECT DISTINCT card_id, doc_id FROM c)
  SELECT card_id AS path, 'apkg_missing_media_mapping: lost.png' AS message FROM m WHERE doc_id % 3 = 0
  UNION ALL SELECT card_id, 'apkg_missing_media_blob: kept.png' FROM m WHERE doc_id % 3 <> 0 AND doc_id % 5 = 0
  UNION ALL SELECT card_id, 'apkg: bad' FROM m WHERE doc_id % 7 = 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0""")
def package_errors(spark, sf):
    d = F.col("doc_id")
    bad = (d % 7 == 0) & (d % 3 != 0) & (d % 5 != 0)
    fields = F.when(d % 3 == 0, F.lit('<img src="lost.png">')).otherwise(F.lit("<IMG class='x' src='img/kept.png'>"))
    media = F.lit('{"0":"kept.png","1":"kept.png"}')
    entries = F.when(d % 5 == 0, F.lit('["media","collection.anki2"]')).otherwise(F.lit('["media","collection.anki2","1"]'))
    notes = A.cards(spark, sf).select(F.col("card_id").alias("path"), F.when(~bad, fields).alias("fields"), F.when(~bad, media).alias("media"), F.when(~bad, entries).alias("entries"), F.when(bad, "apkg: bad").alias("error"))
    return checks.package_errors(notes)


@query(f"""WITH c AS ({A.CARDS}) SELECT card_id, page_id, word, concat(page_id, '/pair_', lpad(CAST(token_index + 995 AS VARCHAR(9)), CAST(greatest(3, length(CAST(token_index + 995 AS VARCHAR(9)))) AS INT), '0'), '/image.png') AS front_image_path,
  CAST(0.5 AS DOUBLE) AS confidence, needs_review, CASE WHEN needs_review THEN 'review' ELSE 'active' END AS status FROM c""")
def quick_cards(spark, sf):
    none = F.struct(*(F.lit(0).alias(c) for c in ("x0", "y0", "x1", "y1")))
    pairs = A.cards(spark, sf).select(F.col("card_id").alias("pair_id"), "page_id", (F.col("token_index") + 994).alias("order_index"), F.col("word").alias("caption_text"), none.alias("picture_box"), F.lit(0.5).alias("confidence"), "needs_review", "reasons")
    return extract.quick_cards(pairs, short=True)


@query(f"""WITH c AS ({A.CARDS}), p AS (SELECT card_id AS pair_id, page_id, token_index, method, needs_review AS flagged, status, doc_id % 3 = 0 AS older, CASE WHEN doc_id % 4 = 0 THEN '' ELSE word END AS word, front_image_path AS picture, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 't.png' END AS said FROM c),
  k AS (SELECT *, flagged OR word = '' AS review FROM p WHERE NOT (older AND status = 'rejected')), s AS (SELECT *, 'forward' AS direction FROM k UNION ALL SELECT *, 'reverse' FROM k WHERE word <> '')
  SELECT substr(sha1(concat_ws('|', pair_id, page_id, word, direction)), 1, 16) AS card_id, pair_id, page_id, page_id AS source_page_id, token_index, direction, CASE direction WHEN 'forward' THEN 'pair' ELSE 'pair_reverse' END AS layout_type, word,
    CASE direction WHEN 'forward' THEN '' ELSE word END AS front_text, CASE direction WHEN 'forward' THEN word ELSE '' END AS back_text, CASE direction WHEN 'forward' THEN 'pair_sam' ELSE 'pair_sam_reverse' END AS method,
    CASE direction WHEN 'forward' THEN picture ELSE said END AS front_image_path, CASE direction WHEN 'forward' THEN nullif(said, '') ELSE picture END AS back_image_path, concat('book#', page_id) AS source_ref, CAST(0.5 AS DOUBLE) AS confidence,
    review AS needs_review, CASE WHEN review THEN 'review' ELSE 'active' END AS status, concat(CASE WHEN flagged THEN 'LOW|' ELSE '' END, CASE WHEN word = '' AND NOT older THEN 'NO_TEXT|' ELSE '' END) AS reasons FROM s""")
def pair_cards(spark, sf):
    d = F.col("doc_id")
    pairs = A.cards(spark, sf).select(F.col("card_id").alias("pair_id"), "page_id", F.col("token_index").alias("order_index"), F.lit(None).cast("array<int>").alias("picture_bbox"), F.when(d % 4 == 0, " ").otherwise(F.col("word")).alias("caption_text"), "needs_review", "status", (d % 3 == 0).alias("older"),
        F.when(F.col("needs_review"), F.array(F.lit("LOW"))).alias("reasons"), F.lit(0.5).alias("confidence"), F.col("front_image_path").alias("picture_path"), F.when(d % 5 == 0, "").otherwise("t.png").alias("text_path"))
    made = pages.pair_cards(pairs, "book", sides=("forward", "reverse"))
    return made.withColumn("reasons", F.array_join(F.transform("reasons", lambda r: F.concat(r, F.lit("|"))), "")).drop("bbox_xyxy", "created_at", "updated_at")
