"""Registered queries of job bookkeeping, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs, pages
from . import adapters as A
from .queries import _BOXES, _CLEANED, _CROPS, _FB, _boxes, _crops, query

_LEFT = "greatest(0, p.x0 - CAST(floor((p.x1 - p.x0) / 4) AS INT))"
_RIGHT = "least(1200, p.x1 + CAST(floor((p.x1 - p.x0) / 4) AS INT))"
_JUDGED = f"""{_FB}, a AS (SELECT f.*, c.word, c.status, c.needs_review, min(CASE WHEN action = 'reject' THEN ord END) OVER (PARTITION BY card_id) AS r FROM f JOIN c USING (card_id) WHERE action IN ('approve', 'reject', 'edit')),
  b AS (SELECT *, status <> 'rejected' AND (r IS NULL OR ord < r) AS live, trim(coalesce(edited_text, '')) AS said FROM a),
  v AS (SELECT *, live AND (action = 'approve' OR action = 'edit' AND said <> '') AS valid FROM b),
  w AS (SELECT *, max(CASE WHEN valid THEN 1 ELSE 0 END) OVER p AS seen, last_value(CASE WHEN valid AND action = 'edit' THEN said END IGNORE NULLS) OVER p AS last FROM v WINDOW p AS (PARTITION BY card_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  j AS (SELECT *, valid AND (NOT (coalesce(seen, 0) = 1 OR status = 'active' AND NOT needs_review) OR action = 'edit' AND said <> coalesce(last, word)) AS effective FROM w)"""


@query(f"""WITH {_JUDGED}, n AS (SELECT count(*) FILTER (effective OR action = 'reject' AND status <> 'rejected' AND ord = r) AS applied, count(*) AS known FROM j)
  SELECT (SELECT count(*) FROM f) AS feedback_items, applied, (SELECT count(*) FROM f WHERE card_id NOT IN (SELECT card_id FROM c)) AS skipped_unknown_card, known - applied AS skipped_already_applied FROM n""")
def feedback_counters(spark, sf):
    return jobs.feedback_counters(A.cards(spark, sf), A.feedback(spark, sf))


@query(f"WITH {_JUDGED} SELECT card_id, word AS text FROM c WHERE needs_review AND card_id NOT IN (SELECT card_id FROM j WHERE action = 'reject' OR valid OR NOT live)")
def open_queue(spark, sf):
    cards = A.cards(spark, sf)
    return jobs.open_queue(pages.review_rows(cards), cards, A.feedback(spark, sf)).select("card_id", "text")


@query(f"""{_CLEANED}, {_CROPS} SELECT count(*) FILTER (crop_status = 'success') AS crops_success, count(*) FILTER (crop_status = 'failed') AS crops_failed, count(*) FILTER (crop_status = 'skipped') AS crops_skipped,
  count(*) FILTER (crop_area < 4096) AS crops_gated, count(*) FILTER (crop_area > 0.8 * 1680000) AS crops_too_large FROM crop""")
def crop_stats(spark, sf):
    return jobs.crop_stats(_crops(spark, sf))


@query(f"""WITH c AS ({A.CARDS}), e AS (SELECT *, status = 'rejected' OR needs_review AS gone, front_image_path LIKE '/%' OR list_contains(string_split(front_image_path, '/'), '..') AS unsafe FROM c)
  SELECT count(*) AS cards_seen, count(*) FILTER (gone) AS cards_skipped_review, count(*) FILTER (NOT gone AND unsafe) AS cards_unsafe, count(*) FILTER (NOT gone AND NOT unsafe) AS cards_exported FROM e""")
def export_stats(spark, sf):
    return jobs.export_stats(A.cards(spark, sf))


@query("""SELECT category, count(*) AS n, CAST(CASE category WHEN 'CONTRACT' THEN 0 WHEN 'DETERMINISM' THEN 1 WHEN 'APKG' THEN 3 ELSE 4 END AS INT) AS place
  FROM (SELECT CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'APKG' WHEN 1 THEN 'SECURITY' WHEN 2 THEN 'DETERMINISM' ELSE 'CONTRACT' END AS category FROM pages) GROUP BY category""")
def error_buckets(spark, sf):
    said = F.array(*map(F.lit, ("bad apkg zip", "unsafe file", "not deterministic", "missing key")))
    return jobs.error_buckets(A.read(spark, sf, "pages").select(F.element_at(said, (F.col("page_id") % 4 + 1).cast("int")).alias("message")))


@query(f"{_BOXES} SELECT page_id, ord, text FROM txt WHERE (x1 - x0) * (y1 - y0) >= 300 AND length(trim(text)) >= 2 AND confidence >= 0.4")
def text_block_gates(spark, sf):
    return jobs.text_gate(_boxes(spark, sf)[1]).select("page_id", "ord", "text")


@query(f"""{_BOXES} SELECT p.page_id, p.ord AS region, arg_min(t.text, (-t.confidence, t.ord)) AS caption FROM pic p LEFT JOIN txt t ON p.page_id = t.page_id AND t.x0 < {_RIGHT} AND t.x1 > {_LEFT}
  AND t.y0 < least(1400, p.y1 + 200) AND t.y1 > least(1400, p.y1 + 5) GROUP BY p.page_id, p.ord""")
def caption_below(spark, sf):
    pictures, texts = _boxes(spark, sf)
    return jobs.captions_below(pictures.select("page_id", F.col("ord").alias("region"), "box"), texts, 1200, 1400)


@query(f"""{_BOXES}, y AS (SELECT page_id, ord, (y0 + y1) / 2 AS y FROM tok), g AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page_id ORDER BY y, ord) >= 100 THEN 1 ELSE 0 END AS new FROM y),
  r AS (SELECT page_id, sum(new) OVER (PARTITION BY page_id ORDER BY y, ord) AS k FROM g), s AS (SELECT page_id, k, count(*) AS column_count FROM r GROUP BY page_id, k),
  n AS (SELECT page_id, column_count, count(*) AS n FROM s GROUP BY page_id, column_count)
  SELECT page_id, CAST(sum(n) AS BIGINT) AS row_count, arg_min(column_count, (-n, column_count)) AS column_count FROM n GROUP BY page_id""")
def column_mode(spark, sf):
    return jobs.column_mode(A.tokens(spark, sf))


@query(f"WITH c AS ({A.CARDS}) SELECT page_id, count(*) AS pairs, count(*) FILTER (needs_review) AS to_review FROM c GROUP BY ROLLUP (page_id)")
def pair_counts(spark, sf):
    return jobs.pair_counts(A.cards(spark, sf))


@query(f"WITH c AS ({A.CARDS}) SELECT front_image_path AS name, count(*) AS n FROM c GROUP BY name HAVING count(*) > 1 ORDER BY name LIMIT 10")
def duplicate_media(spark, sf):
    return jobs.duplicate_names(A.cards(spark, sf).select(F.col("front_image_path").alias("name")))


@query(f"""WITH c AS ({A.CARDS}), q AS (SELECT CASE WHEN doc_id % 7 = 0 THEN concat('x', CAST(doc_id AS VARCHAR(20))) ELSE card_id END AS card_id, doc_id FROM c WHERE needs_review)
  SELECT card_id, 'card_id' AS rule FROM q WHERE doc_id % 7 = 0 UNION ALL SELECT card_id, 'reason' FROM q WHERE doc_id % 5 = 0""")
def validate_review(spark, sf):
    d = F.col("doc_id")
    queue = A.cards(spark, sf).filter("needs_review").select(F.when(d % 7 == 0, F.concat(F.lit("x"), d)).otherwise(F.col("card_id")).alias("card_id"), "page_id", F.when(d % 5 == 0, " ").otherwise("LOW_CONFIDENCE").alias("review_reason"))
    return jobs.review_violations(queue)
