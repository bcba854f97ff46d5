"""Registered queries of the page and card operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geom, ids, text
from ..operators import assembly, matching, pages, pixels, review
from . import adapters as A

CAP = pages.CONFIGURED.max_tokens
_CLEAN = pages.CONFIGURED
WIDTH, HEIGHT = 1200, 1400
Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


#: Token cleaning in plain SQL, capped before the dedupe.
CLEAN_SQL = f"""n AS (SELECT page_id, ord, confidence, x0, y0, x1, y1, lower(translate(trim(regexp_replace(text, '\\s+', ' ', 'g')), '‘’“”–—', '''''""--')) AS text FROM tok),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS k FROM n
  WHERE length(text) > 0 AND confidence >= 0.3 AND NOT (length(text) > 2 AND text = repeat(substr(text, 1, 1), CAST(length(text) AS BIGINT)))
    AND NOT length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) / greatest(length(text), 1) > 0.5 AND NOT regexp_matches(text, '[^\\p{{L}}\\p{{N}}_\\s]{{3,}}')
    AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(text, '^[0-9]+$') AND text NOT IN ('page', 'unit', 'lesson', 'chapter') AND (length(text) >= 3 OR text IN ('a', 'an', 'i'))),
d AS (SELECT *, row_number() OVER (PARTITION BY page_id, text ORDER BY confidence DESC, y0, x0, y1, x1, text, ord) AS b FROM f WHERE k <= {CAP}),
clean AS (SELECT page_id, ord, text, confidence, x0, y0, x1, y1, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, y1, x1, text, ord) - 1 AS rank FROM d WHERE b = 1)"""
_TOK = f"WITH tok AS ({A.TOK})"
_CLEANED = f"{_TOK}, {CLEAN_SQL}"


def _cleaned(spark: SparkSession, sf: str, options: pages.CleanOptions = _CLEAN) -> DataFrame:
    return pages.clean_tokens(A.tokens(spark, sf), options)


@query(f"{_CLEANED} SELECT page_id, ord, text, confidence, rank FROM clean")
def clean_tokens(spark, sf):
    return _cleaned(spark, sf).select("page_id", "ord", "text", "confidence", F.col("rank").cast("long").alias("rank"))


_LAYOUT = """h AS (SELECT page_id, count(*) AS n, greatest(1, (max(x1) - min(x0)) * (max(y1) - min(y0))) AS extent, max((x1 - x0) * (y1 - y0)) AS largest FROM clean GROUP BY page_id),
layout AS (SELECT p.page_id, CAST(coalesce(n, 0) AS INT) AS cleaned_words, CASE WHEN n IS NULL THEN 'unknown' WHEN largest / extent >= 0.7 AND extent / 1680000 <= 0.25 AND n <= 6 THEN 'single_word' ELSE 'multi_word' END AS layout_type, n IS NULL AS needs_review FROM (SELECT DISTINCT page_id FROM tok) p LEFT JOIN h USING (page_id))"""


def _layouts(spark: SparkSession, sf: str, options: pages.CleanOptions = _CLEAN) -> DataFrame:
    found = A.tokens(spark, sf).select("page_id").distinct().withColumns({"width": F.lit(WIDTH), "height": F.lit(HEIGHT)})
    return pages.layouts(found, _cleaned(spark, sf, options))


@query(f"{_CLEANED}, {_LAYOUT} SELECT * FROM layout")
def layout_classify(spark, sf, options=_CLEAN):
    return _layouts(spark, sf, options).select("page_id", "cleaned_words", "layout_type", "needs_review")


@query(f"""{_CLEANED} SELECT page_id, ord, round(least(1.0, 0.6 * confidence + CASE WHEN length(text) BETWEEN 3 AND 15 THEN 0.2 WHEN length(text) < 3 THEN 0.1 ELSE 0 END
  + 0.2 * length(regexp_replace(text, '\\P{{L}}', '', 'g')) / greatest(length(text), 1)), 6) AS quality FROM clean""")
def quality_score(spark, sf):
    return _cleaned(spark, sf).select("page_id", "ord", F.round("quality_score", 6).alias("quality"))


_CROPS = """c AS (SELECT *, greatest(0, least(1199, x0 - 8)) AS a0, greatest(0, least(1399, y0 - 8)) AS b0, greatest(1, least(1200, x1 + 8)) AS a1, greatest(1, least(1400, y1 + 8)) AS b1 FROM clean),
crop AS (SELECT *, CASE WHEN (a1 - a0) * (b1 - b0) < 4096 THEN 'failed' ELSE 'success' END AS crop_status, (a1 - a0) * (b1 - b0) AS crop_area FROM c)"""


def _crops(spark, sf):
    return pages.crops(_cleaned(spark, sf), WIDTH, HEIGHT).withColumn("token_index", F.col("rank").cast("int"))


@query(f"{_CLEANED}, {_CROPS} SELECT page_id, ord, CAST(rank AS INT) AS token_index, crop_status, CAST(crop_area AS BIGINT) AS crop_area, CASE WHEN crop_status = 'failed' THEN 'CROP_GATED_SMALL' ELSE '' END AS warnings FROM crop")
def crop_gates(spark, sf):
    return _crops(spark, sf).select("page_id", "ord", "token_index", "crop_status", geom.area(F.col("crop_box")).cast("long").alias("crop_area"), F.array_join("warnings", "|").alias("warnings"))


_CARDS = """card AS (SELECT sha1(concat_ws('|', concat('scan#', page_id), page_id, text, concat_ws(',', x0, y0, x1, y1))) AS card_id, page_id, CAST(rank AS INT) AS token_index, text AS word,
  CASE WHEN crop_status = 'failed' THEN 'page_fallback' ELSE 'bbox_crop' END AS method, greatest(0.4, least(0.6, confidence)) AS confidence,
  crop_status = 'failed' OR confidence < 0.7 AS needs_review, concat_ws('|', CASE WHEN crop_status = 'failed' THEN 'CROP_GATED_SMALL|PAGE_FALLBACK' END, CASE WHEN confidence < 0.7 THEN 'LOW_CONFIDENCE' END) AS reasons FROM crop)"""


def _cards(spark, sf):
    return pages.cards(_crops(spark, sf).withColumn("source_ref", F.concat(F.lit("scan#"), "page_id")))


@query(f"{_CLEANED}, {_CROPS}, {_CARDS} SELECT *, CASE WHEN needs_review THEN 'review' ELSE 'active' END AS status FROM card")
def cards_multiword(spark, sf):
    return _cards(spark, sf).select("card_id", "page_id", "token_index", "word", "method", "confidence", "needs_review", "status", F.array_join("reasons", "|").alias("reasons"))


@query(f"{_CLEANED}, {_CROPS}, {_CARDS} SELECT card_id, page_id, word AS text, split_part(reasons, '|', 1) AS review_reason FROM card WHERE needs_review")
def review_queue(spark, sf):
    return pages.review_rows(_cards(spark, sf)).select("card_id", "page_id", "text", "review_reason")


@query(f"{_CLEANED} SELECT page_id, arg_min(text, (-confidence, y0, x0, y1, x1, text, ord)) AS word, max(confidence) AS confidence, count(*) AS candidates FROM clean GROUP BY page_id")
def representative_token(spark, sf):
    return pages.representative(_cleaned(spark, sf))


@query(f"""{_CLEANED}, {_LAYOUT}, {_CROPS}, {_CARDS} SELECT * FROM (SELECT count(*) FILTER (layout_type = 'single_word') AS pages_single_word, count(*) FILTER (layout_type = 'multi_word') AS pages_multi_word, count(*) FILTER (layout_type = 'unknown') AS pages_unknown, count(*) AS pages_total FROM layout),
  (SELECT count(*) AS cards_total, count(*) FILTER (needs_review) AS cards_review, count(*) FILTER (method = 'page_fallback') AS cards_fallback FROM card)""")
def metrics_rollup(spark, sf):
    return pages.page_metrics(_layouts(spark, sf), _cards(spark, sf))


@query(f"""{_TOK} SELECT DISTINCT text, rtrim(concat(coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9_-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 41), ''), 'token'), '_', substr(sha1(text), 1, 8))) AS slug FROM tok""")
def slugify(spark, sf):
    return A.tokens(spark, sf).select("text").distinct().select("text", text.slug(F.col("text")).alias("slug"))


@query(f"WITH c AS ({A.CARDS}) SELECT card_id, CAST(CAST(concat('0x', substr(sha1(card_id), 1, 16)) AS UBIGINT) % 2147483647 AS BIGINT) AS n FROM c")
def stable_ints(spark, sf):
    return A.cards(spark, sf).select("card_id", ids.stable_int(F.col("card_id")).alias("n"))


@query(f"""WITH c AS ({A.CARDS}) SELECT card_id, CASE WHEN front_image_path = '' THEN 'empty' WHEN front_image_path LIKE '/%' THEN 'absolute' WHEN list_contains(string_split(front_image_path, '/'), '..') THEN 'parent' END AS problem FROM c""")
def path_safety(spark, sf):
    spaced = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" \t"), "front_image_path", F.lit("\n"))).otherwise(F.col("front_image_path"))
    return A.cards(spark, sf).select("card_id", text.path_problem(spaced).alias("problem"))


@query("""SELECT CAST(page_id AS BIGINT) AS page_id, CASE WHEN title LIKE '%apkg%' THEN 'APKG' WHEN title LIKE '%unsafe%' THEN 'SECURITY' WHEN title LIKE '%determin%' THEN 'DETERMINISM' ELSE 'CONTRACT' END AS category
  FROM (SELECT page_id, CASE CAST(page_id % 4 AS INT) WHEN 0 THEN 'bad apkg zip' WHEN 1 THEN 'unsafe file' WHEN 2 THEN 'not deterministic' ELSE 'missing key' END AS title FROM pages)""")
def error_categories(spark, sf):
    p = A.read(spark, sf, "pages").select("page_id", F.element_at(F.array(*map(F.lit, ("bad apkg zip", "unsafe file", "not deterministic", "missing key"))), (F.col("page_id") % 4 + 1).cast("int")).alias("title"))
    return p.select("page_id", text.error_category(F.col("title")).alias("category"))


# Boxes: pictures are the odd tokens of a page, texts the even ones.
_BOXES = f"{_TOK}, pic AS (SELECT * FROM tok WHERE ord % 2 = 1), txt AS (SELECT * FROM tok WHERE ord % 2 = 0)"


def _boxes(spark, sf):
    t = A.tokens(spark, sf)
    return t.filter("ord % 2 = 1"), t.filter("ord % 2 = 0")


@query(f"""{_BOXES} SELECT p.page_id, p.ord, t.ord AS other, round(sqrt(pow((p.x0 + p.x1) / 2 - (t.x0 + t.x1) / 2, 2) + pow((p.y0 + p.y1) / 2 - (t.y0 + t.y1) / 2, 2)), 6) AS dist,
  round(CAST(greatest(0, least(p.x1, t.x1) - greatest(p.x0, t.x0)) * greatest(0, least(p.y1, t.y1) - greatest(p.y0, t.y0)) AS DOUBLE) / ((p.x1 - p.x0) * (p.y1 - p.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - greatest(0, least(p.x1, t.x1) - greatest(p.x0, t.x0)) * greatest(0, least(p.y1, t.y1) - greatest(p.y0, t.y0))), 6) AS iou
  FROM pic p JOIN txt t ON p.page_id = t.page_id""")
def box_measures(spark, sf):
    p, t = _boxes(spark, sf)
    t = t.select("page_id", F.col("ord").alias("other"), F.col("box").alias("b"))
    return p.join(t, "page_id").select("page_id", "ord", "other", F.round(geom.distance(F.col("box"), F.col("b")), 6).alias("dist"), F.round(geom.iou(F.col("box"), F.col("b")), 6).alias("iou"))


@query(f"""{_BOXES} SELECT p.page_id, p.ord AS region, coalesce(string_agg(t.text, ' ' ORDER BY t.y0, t.x0, t.ord, t.text), '') AS caption FROM pic p LEFT JOIN txt t ON p.page_id = t.page_id AND t.x0 < p.x1 + 200 AND t.x1 > p.x0 - 200 AND t.y0 < p.y1 + 200 AND t.y1 > p.y0 - 200 GROUP BY p.page_id, p.ord""")
def range_overlap_caption(spark, sf):
    p, t = _boxes(spark, sf)
    b = F.col("box")
    return matching.overlap_captions(p.select("page_id", F.col("ord").alias("region"), geom.box(b["x0"] - 200, b["y0"] - 200, b["x1"] + 200, b["y1"] + 200).alias("box")), t)


_INTER = "greatest(0, least(p.x1, t.x1) - greatest(p.x0, t.x0)) * greatest(0, least(p.y1, t.y1) - greatest(p.y0, t.y0))"


@query(f"""{_BOXES} SELECT p.page_id, p.ord FROM pic p WHERE NOT EXISTS (SELECT 1 FROM txt t WHERE t.page_id = p.page_id AND ({_INTER} > 0.5 * ((p.x1 - p.x0) * (p.y1 - p.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - {_INTER}) OR {_INTER} > 0.8 * (t.x1 - t.x0) * (t.y1 - t.y0) OR {_INTER} > 0.8 * (p.x1 - p.x0) * (p.y1 - p.y0)))""")
def iou_anti_join(spark, sf):
    return matching.without_overlap(*_boxes(spark, sf)).select("page_id", "ord")


#: Folds over a page's boxes as recursive SQL: the k-th box meets the state that the boxes before it left.
_NMS = """b AS (SELECT page_id, ord, confidence, x0, y0, x1, y1, row_number() OVER (PARTITION BY page_id ORDER BY -confidence, ord) AS k FROM tok),
  f AS (SELECT page_id, k, [{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'ord': ord}] AS kept FROM b WHERE k = 1
    UNION ALL SELECT b.page_id, b.k, CASE WHEN len(list_filter(f.kept, lambda a: greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) >
        0.3 * ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))))) > 0
      THEN f.kept ELSE list_append(f.kept, {'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1, 'ord': b.ord}) END FROM f JOIN b ON b.page_id = f.page_id AND b.k = f.k + 1),
  z AS (SELECT page_id, unnest(kept).ord AS ord FROM f QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY k DESC) = 1)"""


@query(f"{_BOXES.replace('WITH', 'WITH RECURSIVE', 1)}, {_NMS} SELECT page_id, ord, confidence FROM z JOIN b USING (page_id, ord)")
def nms_fold(spark, sf):
    return matching.suppress(A.tokens(spark, sf)).select("page_id", "ord", "confidence")


def _greedy(score: str, rest: str = "") -> str:
    """Each picture in order takes the first free text of its candidates, best score first."""
    return f"""{_BOXES.replace('WITH', 'WITH RECURSIVE', 1)}, m AS (SELECT p.page_id, p.ord AS picture, t.ord AS text, sqrt(pow((p.x0 + p.x1) / 2 - (t.x0 + t.x1) / 2, 2) + pow((p.y0 + p.y1) / 2 - (t.y0 + t.y1) / 2, 2)) AS d,
    (p.x0 + p.x1) / 2 AS px, (t.x0 + t.x1) / 2 AS tx, (p.y0 + p.y1) / 2 AS py, (t.y0 + t.y1) / 2 AS ty, p.x1 - p.x0 AS pw, t.x1 - t.x0 AS tw, least(p.x1, t.x1) - greatest(p.x0, t.x0) AS across FROM pic p JOIN txt t ON p.page_id = t.page_id),
  s AS (SELECT page_id, picture, text, {score} AS s FROM m), c AS (SELECT page_id, picture, list(text ORDER BY s, text) AS texts FROM s WHERE s IS NOT NULL GROUP BY page_id, picture),
  o AS (SELECT pic.page_id, pic.ord AS picture, coalesce(c.texts, []) AS texts, row_number() OVER (PARTITION BY pic.page_id ORDER BY pic.ord) AS k FROM pic LEFT JOIN c ON c.page_id = pic.page_id AND c.picture = pic.ord),
  g AS (SELECT page_id, k, picture, texts[1] AS text, [texts[1]] AS used FROM o WHERE k = 1
    UNION ALL SELECT page_id, k, picture, text, list_append(used, text) FROM (SELECT o.page_id, o.k, o.picture, list_filter(o.texts, lambda x: NOT list_contains(g.used, x))[1] AS text, g.used FROM g JOIN o ON o.page_id = g.page_id AND o.k = g.k + 1) x)
  SELECT page_id, picture, text FROM g {rest}"""


@query(_greedy("""CASE WHEN d <= 300 THEN greatest(0.0, d + CASE WHEN ty < py THEN 200 ELSE 0 END - CASE WHEN abs(tx - px) < 0.5 * pw THEN 50 ELSE 0 END + CASE WHEN across > 0 THEN -30.0::DOUBLE * across / greatest(1, least(pw, tw)) ELSE 0 END) END"""))
def greedy_pair_below(spark, sf):
    return matching.greedy_pairs(*_boxes(spark, sf), lambda p, t: geom.pair_score(p, t))


@query(_greedy("CASE WHEN d < 500 THEN d END", "WHERE text IS NOT NULL"))
def greedy_pair_nearest(spark, sf):
    near = lambda p, t: F.when(geom.distance(p, t) < 500, geom.distance(p, t))
    return matching.greedy_pairs(*_boxes(spark, sf), near).filter("text is not null")


@query(_greedy("CASE WHEN d * CASE WHEN ty > py THEN 0.8::DOUBLE ELSE 1 END < 600 THEN d * CASE WHEN ty > py THEN 0.8::DOUBLE ELSE 1 END END"))
def greedy_pair_weighted(spark, sf):
    def score(p, t):
        d = geom.distance(p, t) * F.when(geom.center_y(t) > geom.center_y(p), 0.8).otherwise(1.0)
        return F.when(d < 600, d)

    return matching.greedy_pairs(*_boxes(spark, sf), score)


_LINES = "SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS page_id, CAST(l_partkey AS BIGINT) AS line FROM lineitem"


@query(f"""WITH l AS ({_LINES}), g AS (SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY page_id ORDER BY line) >= 30 THEN 1 ELSE 0 END AS s FROM l), c AS (SELECT *, CAST(sum(s) OVER (PARTITION BY page_id ORDER BY line) AS INT) AS grp FROM g)
  SELECT page_id, grp, CAST(trunc(avg(line)) AS INT) AS center, count(*) AS members FROM c GROUP BY page_id, grp""")
def line_cluster(spark, sf):
    return matching.cluster_lines(A.table(spark, sf, _LINES), 30)


@query(f"""{_TOK}, l AS (SELECT *, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1 FROM tok WINDOW w AS (PARTITION BY page_id ORDER BY y0, ord)),
  g AS (SELECT *, CASE WHEN px0 IS NULL OR (least(px1, x1) - greatest(px0, x0) > 0.3 * least(px1 - px0, x1 - x0) AND y0 - py1 >= -10 AND y0 - py1 < 1.5 * (py1 - py0)) THEN 0 ELSE 1 END AS s FROM l),
  c AS (SELECT *, CAST(sum(s) OVER (PARTITION BY page_id ORDER BY y0, ord) AS INT) AS grp FROM g)
  SELECT page_id, grp, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, ' ' ORDER BY y0, ord) AS text, round(avg(confidence), 6) AS confidence, count(*) AS line_count FROM c GROUP BY page_id, grp""")
def text_merge(spark, sf):
    return matching.merge_lines(A.tokens(spark, sf))


@query(f"""{_TOK.replace('WITH', 'WITH RECURSIVE', 1)}, b AS (SELECT page_id, ord, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, row_number() OVER (PARTITION BY page_id ORDER BY (y0 + y1) / 2, ord) AS k FROM tok),
  f AS (SELECT page_id, ord, x, y, k, y AS anchor, CAST(0 AS INT) AS row FROM b WHERE k = 1
    UNION ALL SELECT b.page_id, b.ord, b.x, b.y, b.k, CASE WHEN b.y - f.anchor > 0.05::DOUBLE * {HEIGHT} THEN b.y ELSE f.anchor END, f.row + CASE WHEN b.y - f.anchor > 0.05::DOUBLE * {HEIGHT} THEN 1 ELSE 0 END FROM f JOIN b ON b.page_id = f.page_id AND b.k = f.k + 1)
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY row, x, y, ord) - 1 AS INT) AS reading_index, ord, row FROM f""")
def reading_order_rows(spark, sf):
    return matching.reading_order(A.tokens(spark, sf), HEIGHT)


_GRID = "SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS page_id, CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'v' END AS axis, CAST(l_partkey % 900 AS INT) AS line FROM lineitem"


@query(f"""WITH g AS (SELECT *, lead(line) OVER (PARTITION BY page_id, axis ORDER BY line) AS nxt FROM ({_GRID})), s AS (SELECT * FROM g WHERE nxt - line >= 50)
  SELECT h.page_id, v.line AS x0, h.line AS y0, v.nxt AS x1, h.nxt AS y1 FROM s h JOIN s v ON h.page_id = v.page_id AND h.axis = 'h' AND v.axis = 'v' AND (v.nxt - v.line) * (h.nxt - h.line) >= 5000""")
def grid_cells(spark, sf):
    return matching.grid_cells(A.table(spark, sf, _GRID))


_FB = f"c AS ({A.CARDS}), f AS ({A.FB})"


#: Ordered feedback, row by row: a recursive walk that applies each row to the card's state.
_WALK = f"""{_FB}, k AS (SELECT f.card_id, lower(f.action) AS action, trim(coalesce(f.edited_text, '')) AS said, row_number() OVER (PARTITION BY f.card_id ORDER BY f.ord) AS n FROM f JOIN c USING (card_id) WHERE lower(f.action) IN ('approve', 'reject', 'edit')),
  walk AS (SELECT card_id, CAST(0 AS BIGINT) AS n, word, status, needs_review, false AS cleared, CAST(0 AS BIGINT) AS applied FROM c
    UNION ALL SELECT card_id, kn, CASE WHEN e AND action = 'edit' THEN said ELSE word END, CASE WHEN e THEN 'active' WHEN j THEN 'rejected' ELSE status END, CASE WHEN e OR j THEN false ELSE needs_review END, cleared OR e, applied + CASE WHEN e OR j THEN 1 ELSE 0 END
    FROM (SELECT w.*, k.n AS kn, k.action, k.said, w.status <> 'rejected' AND k.action = 'reject' AS j,
      w.status <> 'rejected' AND (k.action = 'approve' AND NOT (w.status = 'active' AND NOT w.needs_review) OR k.action = 'edit' AND k.said <> '' AND NOT (w.status = 'active' AND NOT w.needs_review AND trim(w.word) = k.said)) AS e
      FROM walk w JOIN k ON k.card_id = w.card_id AND k.n = w.n + 1) x),
  final AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY n DESC) = 1)"""


@query(f"""WITH RECURSIVE {_WALK} SELECT card_id, word, status, needs_review, cleared FROM final""")
def feedback_fold(spark, sf):
    cards = A.cards(spark, sf).withColumn("reasons", F.array(F.lit("ANY")))
    return review.apply_card_feedback(cards, A.feedback(spark, sf)).select("card_id", "word", "status", "needs_review", (F.size("reasons") == 0).alias("cleared"))


@query(f"""WITH {_FB}, s AS (SELECT card_id, arg_max(action, ord) AS action, arg_max(edited_text, ord) FILTER (action = 'edit') AS edited FROM f WHERE action IN ('approve', 'reject', 'edit') GROUP BY card_id)
  SELECT c.card_id AS pair_id, coalesce(edited, word) AS caption, CASE WHEN action = 'reject' THEN 'rejected' WHEN action IS NOT NULL THEN 'active' ELSE status END AS status, needs_review AND action IS NULL AS needs_review FROM c LEFT JOIN s USING (card_id)""")
def pair_feedback_fold(spark, sf):
    pairs = A.cards(spark, sf).select(F.col("card_id").alias("pair_id"), F.col("word").alias("caption"), "status", "reasons", "needs_review")
    said = A.feedback(spark, sf).select("ord", F.col("card_id").alias("pair_id"), "action", F.col("edited_text").alias("edited_caption"))
    return review.apply_pair_feedback(pairs, said).select("pair_id", "caption", "status", "needs_review")


@query(f"WITH f AS ({A.FB}) SELECT direction, count(*) AS votes FROM f GROUP BY direction ORDER BY votes DESC, min(ord) LIMIT 1")
def direction_vote(spark, sf):
    return review.direction_vote(A.feedback(spark, sf))


@query(f"WITH {_FB}, n AS (SELECT card_id, arg_max(edited_text, ord) AS t FROM f WHERE action = 'edit' GROUP BY card_id) SELECT coalesce(c.card_id, n.card_id) AS card_id, coalesce(n.t, c.word) AS edited_text FROM c FULL JOIN n ON c.card_id = n.card_id")
def learned_captions(spark, sf):
    old = A.cards(spark, sf).select("card_id", F.col("word").alias("edited_text"))
    return review.upsert(old, A.feedback(spark, sf).filter("action = 'edit'"), "card_id", "edited_text")


@query(f"""WITH {_FB}, t AS (SELECT f.action, c.word, CASE WHEN f.action = 'edit' THEN edited_text END AS e FROM f JOIN c USING (card_id) WHERE f.action IN ('approve', 'reject', 'edit'))
  SELECT count(*) AS records, count(*) FILTER (action = 'approve') AS approves, count(*) FILTER (action = 'reject') AS rejects, count(*) FILTER (action = 'edit') AS edits, count(*) FILTER (e <> word) AS text_corrections FROM t""")
def learning_stats(spark, sf):
    return review.learning_stats(review.training_records(A.cards(spark, sf), A.feedback(spark, sf)))


@query(f"WITH c AS ({A.CARDS}) SELECT word AS front_text, '' AS back_text, front_image_path, concat('doc#', CAST(doc_id AS VARCHAR(20))) AS source_ref, card_id, page_id AS page, token_index AS idx, CASE WHEN method = 'page_fallback' THEN 'PAGE_FALLBACK' ELSE '' END AS review_reason FROM c WHERE status <> 'rejected' AND NOT needs_review")
def export_csv_rows(spark, sf):
    return review.csv_rows(A.cards(spark, sf))


@query(f"""WITH c AS ({A.CARDS}) SELECT card_id, concat('<img src="', front_image_path, '">') AS front, concat('<div>', word, '</div>') AS back FROM c WHERE status = 'active' AND front_image_path <> ''""")
def export_apkg_rows(spark, sf):
    return A.cards(spark, sf).filter("status = 'active' and front_image_path <> ''").select("card_id", text.note_front(F.col("front_image_path")).alias("front"), text.note_back(F.col("word")).alias("back"))


@query(f"""WITH c AS ({A.CARDS}), g AS (SELECT split_part(front_image_path, '/', -1) AS base, front_image_path AS path, min(doc_id) AS ord, arg_min(card_id, doc_id) AS card FROM c WHERE front_image_path <> '' GROUP BY front_image_path),
  n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ord) AS k FROM g) SELECT path, CASE WHEN k = 1 THEN base ELSE concat(card, '_', base) END AS name FROM n""")
def media_names(spark, sf):
    return review.media_names(A.cards(spark, sf).filter("front_image_path <> ''").select(F.col("front_image_path").alias("path"), "card_id", F.col("doc_id").alias("ord")))


@query("""WITH r AS (SELECT DISTINCT split_part(unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)), '/', -1) AS name FROM pages) SELECT name FROM r WHERE length(name) % 2 = 1""")
def media_integrity(spark, sf):
    notes = A.read(spark, sf, "pages").select(F.regexp_replace("html", '<a href="', '<img src="').alias("fields"))
    used = notes.select(F.explode(text.media_refs(F.col("fields"))).alias("name")).distinct()
    return review.missing_media(notes, used.filter("length(name) % 2 = 0"))


@query(f"""WITH c AS ({A.CARDS}) SELECT card_id, rule FROM (
  SELECT card_id, 'method' AS rule FROM c WHERE method = 'unknown' UNION ALL SELECT card_id, 'fallback_review' FROM c WHERE method = 'page_fallback' AND NOT needs_review
  UNION ALL SELECT card_id, 'path' FROM c WHERE front_image_path = '' OR front_image_path LIKE '/%' OR list_contains(string_split(front_image_path, '/'), '..'))""")
def validate_cards(spark, sf):
    return review.card_violations(A.cards(spark, sf))


@query(f"""WITH c AS ({A.CARDS}), p AS (SELECT card_id AS pair_id, page_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE word END AS caption FROM c),
  s AS (SELECT *, 'forward' AS direction, '[picture]' AS front, caption AS back FROM p UNION ALL SELECT *, 'reverse', caption, '[picture]' FROM p WHERE caption <> '')
  SELECT substr(sha1(concat_ws('|', pair_id, page_id, caption, direction)), 1, 16) AS card_id, pair_id, direction, front, back, CASE WHEN caption = '' THEN 'review' ELSE 'active' END AS status FROM s""")
def reverse_cards(spark, sf):
    p = A.cards(spark, sf).select(F.col("card_id").alias("pair_id"), "page_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("word")).alias("caption"))
    return pages.reverse_cards(p)


_PXW = f"WITH px AS ({A.PX_SQL})"


@query(f"""{_PXW}, e AS (SELECT *, CASE WHEN abs(value - lag(value) OVER (PARTITION BY key ORDER BY i)) > 30 THEN 1 ELSE 0 END AS e FROM px),
  b AS (SELECT key, value, count(*) AS n, sum(e) AS e FROM e GROUP BY key, value), p AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY key) AS p FROM b),
  t AS (SELECT key, sum(n) AS n, sum(e) AS e, -sum(p * log2(p)) AS h FROM p GROUP BY key), x AS (SELECT key, h, CAST(e AS DOUBLE) / (2 * n) AS d FROM t),
  s AS (SELECT *, h < 3.5 OR d < 0.02 AS is_blank, 1 - (0.6 * least(h / 8, 1) + 0.4 * least(10 * d, 1)) AS s FROM x)
  SELECT key, round(h, 6) AS entropy, round(d, 6) AS edge_density, is_blank, round(CASE WHEN is_blank THEN greatest(s, 0.7) ELSE s END, 6) AS score FROM s""")
def blank_score(spark, sf):
    return pixels.value_blank_scores(A.pixels(spark, sf))


@query(f"""{_PXW}, m AS (SELECT key, quantile_cont(value, 0.5) AS m FROM px GROUP BY key), w AS (SELECT *, lag(value, 2) OVER (PARTITION BY key ORDER BY i) AS a, lead(value, 2) OVER (PARTITION BY key ORDER BY i) AS b FROM px)
  SELECT key, i, value FROM w JOIN m USING (key) WHERE value < m * 0.5 AND value <= a AND value <= b""")
def profile_minima(spark, sf):
    return pixels.local_minima(A.pixels(spark, sf))


@query(f"""{_PXW}, f AS (SELECT key, i, value > 128 AS flag FROM px), r AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER (PARTITION BY key ORDER BY i) THEN 1 ELSE 0 END AS s FROM f),
  g AS (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY i) AS run FROM r) SELECT key, min(i) AS first, max(i) AS last FROM g WHERE flag GROUP BY key, run HAVING max(i) - min(i) + 1 > 3""")
def content_bands(spark, sf):
    return pixels.content_bands(A.pixels(spark, sf).select("key", "i", (F.col("value") > 128).alias("flag")), 3)


@query(f"{_PXW} SELECT CAST(floor(value * 10 / 256) AS INT) AS bin, count(*) AS n FROM px GROUP BY 1")
def brightness_histogram(spark, sf):
    return pixels.histogram(A.pixels(spark, sf))


@query(f"""WITH c AS ({A.CARDS}), p AS (SELECT doc_id, page_id, token_index, (doc_id % 10) / 10.0 AS bp, (doc_id % 7) / 7.0 AS bt, CASE WHEN doc_id % 3 = 0 THEN '' ELSE word END AS cap, doc_id % 9000 AS area FROM c),
  r AS (SELECT *, concat_ws('|', CASE WHEN bp > 0.7 THEN 'BLANK_PICTURE' END, CASE WHEN bt > 0.7 THEN 'BLANK_TEXT' END, CASE WHEN cap = '' THEN 'OCR_EMPTY' END, CASE WHEN area < 5000 THEN 'SMALL_ITEM' END) AS reasons,
    CAST(bp > 0.7 AS INT) + CAST(bt > 0.7 AS INT) + CAST(cap = '' AS INT) + CAST(area < 5000 AS INT) AS n FROM p)
  SELECT page_id, CAST(doc_id AS BIGINT) AS item_index, cap AS caption_text, reasons, n > 0 AS needs_review, CASE WHEN n > 0 THEN 'review' ELSE 'active' END AS status,
    CAST(round(greatest(0.0, least(1.0, 1 - (CASE WHEN bp > 0.5 THEN 0.2 ELSE 0 END + CASE WHEN bt > 0.5 THEN 0.2 ELSE 0 END + CASE WHEN cap = '' THEN 0.3 ELSE 0 END + 0.1 * n))), 6) AS DOUBLE) AS confidence FROM r""")
def grid_pair_assembly(spark, sf):
    d = F.col("doc_id")
    t = A.cards(spark, sf).select("page_id", d.alias("item_index"), (d % 10 / 10.0).alias("blank_picture"), (d % 7 / 7.0).alias("blank_text"), F.when(d % 3 == 0, "").otherwise(F.col("word")).alias("caption"), (d % 9000).alias("item_area"))
    return assembly.grid_pairs(t).withColumn("reasons", F.array_join("reasons", "|"))


@query(f"""{_BOXES}, j AS (SELECT p.page_id, CAST(p.ord AS BIGINT) AS order_index, p.x0, p.y0, p.x1, p.y1, p.confidence, CASE WHEN p.ord % 5 = 0 THEN '' ELSE t.text END AS text FROM pic p LEFT JOIN txt t ON t.page_id = p.page_id AND t.ord = p.ord + 1),
  r AS (SELECT *, text IS NOT NULL AND trim(text) <> '' AS has_text, CASE WHEN text IS NULL THEN 'NO_TEXT_MATCH' WHEN trim(text) = '' THEN 'OCR_EMPTY' ELSE '' END AS reasons FROM j)
  SELECT substr(sha1(concat_ws('|', page_id, order_index, concat_ws(',', x0, y0, x1, y1))), 1, 16) AS pair_id, page_id, order_index, coalesce(text, '') AS caption_text, has_text, NOT has_text AS needs_review, reasons,
    round(confidence * CASE WHEN has_text THEN 1.0 ELSE 0.5 END * CASE WHEN reasons <> '' THEN 0.8 ELSE 1.0 END, 3) AS confidence FROM r""")
def matched_pair_assembly(spark, sf):
    p, t = _boxes(spark, sf)
    t = t.select("page_id", (F.col("ord") - 1).alias("ord"), "text")
    joined = p.drop("text").join(t, ["page_id", "ord"], "left").select("page_id", F.col("ord").alias("order_index"), "box", "confidence", F.when(F.col("ord") % 5 == 0, "").otherwise(F.col("text")).alias("text"), F.lit(None).cast("string").alias("corrected"))
    return assembly.matched_pairs(joined).withColumn("reasons", F.array_join("reasons", "|")).withColumn("confidence", F.round("confidence", 3))


@query(f"""WITH c AS ({A.CARDS}), s AS (SELECT doc_id, page_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE word END AS word, (doc_id % 100) / 100.0 AS confidence, CASE doc_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'success' WHEN 2 THEN 'success' END AS st, CASE doc_id % 4 WHEN 1 THEN 'segmenter' ELSE 'bbox_fallback_enhanced' END AS me FROM c)
  SELECT CAST(doc_id AS VARCHAR) AS page_id, word, CASE WHEN st IS NULL OR st = 'failed' THEN 'page_fallback' WHEN me = 'segmenter' THEN 'segmenter' ELSE 'bbox_fallback' END AS method,
    concat_ws('|', CASE WHEN st = 'failed' THEN 'SEGMENT_FAILED' END, CASE WHEN st IS NULL OR st = 'failed' THEN 'PAGE_FALLBACK' END, CASE WHEN st = 'success' AND me <> 'segmenter' THEN 'BBOX_FALLBACK' END, CASE WHEN word = '' THEN 'WORD_MISSING' END, CASE WHEN confidence < 0.7 THEN 'LOW_CONFIDENCE' END) AS reasons,
    CASE WHEN st = 'failed' THEN 'SEGMENT_FAILED' WHEN st IS NULL THEN 'PAGE_FALLBACK' WHEN me <> 'segmenter' THEN 'BBOX_FALLBACK' WHEN confidence < 0.7 THEN 'LOW_CONFIDENCE' END AS review_reason FROM s""")
def cards_single_word(spark, sf):
    d = F.col("doc_id")
    kind = d % 4
    t = A.cards(spark, sf).select(d.cast("string").alias("page_id"), F.when(d % 9 == 0, "").otherwise(F.col("word")).alias("word"), (d % 100 / 100.0).alias("confidence"), F.when(kind == 0, "failed").when(kind < 3, "success").alias("segment_status"), F.when(kind == 1, "segmenter").otherwise("bbox_fallback_enhanced").alias("segment_method"))
    return assembly.single_word_cards(t).drop("needs_review").withColumn("reasons", F.array_join("reasons", "|"))


_ASPECT = "CAST(x1 - x0 AS DOUBLE) / greatest(1, y1 - y0)"
_SHARE = "CAST((x1 - x0) * (y1 - y0) AS DOUBLE) / 1680000"


@query(f"""{_TOK} SELECT page_id, ord, CASE WHEN {_SHARE} > 0.0018 AND {_ASPECT} > 0.5 AND {_ASPECT} < 2 THEN 'picture' ELSE 'text' END AS kind,
  {_SHARE} BETWEEN 0.001 AND 0.5 AND {_ASPECT} BETWEEN 0.3 AND 3 AS first, {_SHARE} BETWEEN 0.003 AND 0.15 AND {_ASPECT} BETWEEN 0.4 AND 2.5 AS picture FROM tok""")
def region_gates(spark, sf):
    b = F.col("box")
    return A.tokens(spark, sf).select("page_id", "ord", assembly.region_class(b, WIDTH, HEIGHT).alias("kind"), assembly.region_kept(b, WIDTH, HEIGHT, "first").alias("first"), assembly.region_kept(b, WIDTH, HEIGHT, "picture").alias("picture"))


@query(f"""{_TOK} SELECT page_id, ord, CAST(floor((y0 + y1) // 2 / 50) AS BIGINT) AS row, (x0 + x1) // 2 AS col FROM tok""")
def canonical_order(spark, sf):
    key = geom.canonical_key(F.col("box"))
    return A.tokens(spark, sf).select("page_id", "ord", key["row"].alias("row"), key["col"].alias("col"))


@query("""SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS said, count(*) AS turns, arg_min(text, turn) FILTER (trim(text) <> '') AS first_said FROM conversations GROUP BY conv_id""")
def ordered_concat(spark, sf):
    c = A.read(spark, sf, "conversations")
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("said"), F.count(F.lit(1)).alias("turns"), F.min_by("text", F.when(F.trim("text") != "", F.col("turn"))).alias("first_said"))


def _registered() -> None:
    from . import job_queries, summary_queries  # noqa: F401  (they register their queries)


def queries() -> dict[str, Query]:
    _registered()
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    _registered()
    return dict(_SQL)
