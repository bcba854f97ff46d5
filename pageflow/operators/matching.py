"""Matching boxes on a page: range joins, anti joins, suppression, greedy pairs, clusters.

Joins are equi-joins by page with the box test as residual.  Greedy operators are
folds over a page's sorted boxes, which hold one page's boxes, not a key's rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom


def overlap_captions(regions: DataFrame, tokens: DataFrame) -> DataFrame:
    """Text of the tokens that overlap each region (page_id, region, box), in reading order."""
    t = tokens.select("page_id", F.col("box").alias("tbox"), "text", "ord")
    met = regions.join(t, "page_id").filter(geom.overlaps(F.col("box"), F.col("tbox")))
    parts = F.array_sort(F.collect_list(F.struct(F.col("tbox.y0").alias("y"), F.col("tbox.x0").alias("x"), "ord", "text")))
    said = met.groupBy("page_id", "region").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("caption"))
    return regions.join(said, ["page_id", "region"], "left").select("page_id", "region", F.coalesce("caption", F.lit("")).alias("caption"))


def without_overlap(pictures: DataFrame, texts: DataFrame, most: float = 0.5, inside: float = 0.8) -> DataFrame:
    """Pictures that no text overlaps by more than ``most`` (IoU) or lies in by ``inside``."""
    t = texts.select(F.col("page_id").alias("_page"), F.col("box").alias("_box"))
    hit = (geom.iou(F.col("box"), F.col("_box")) > most) | (geom.contains_ratio(F.col("box"), F.col("_box")) > inside) | (geom.contains_ratio(F.col("_box"), F.col("box")) > inside)
    return pictures.join(t, (F.col("page_id") == F.col("_page")) & hit, "left_anti")


def suppress(boxes: DataFrame, most: float = 0.3) -> DataFrame:
    """Non-maximum suppression: (page_id, ord, confidence, box), best first, ties by ord."""
    item = F.struct((-F.col("confidence")).alias("key"), "ord", "box", "confidence")
    pages = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kept = F.aggregate("items", F.slice("items", 1, 0), lambda acc, b: F.when(F.exists(acc, lambda k: geom.iou(k["box"], b["box"]) > most), acc).otherwise(F.array_append(acc, b)))
    return pages.select("page_id", F.explode(kept).alias("k")).select("page_id", "k.ord", "k.confidence", "k.box")


def greedy_pairs(pictures: DataFrame, texts: DataFrame, score: Callable[[Column, Column], Column]) -> DataFrame:
    """Each picture, in order, takes the best free text of its page (first on ties).

    ``score`` of (picture box, text box) is null where they can't be matched.
    Returns page_id, picture, text (null where unmatched)."""
    p = pictures.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "box"))).alias("pics"))
    t = texts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "box"))).alias("texts"))
    both = p.join(t, "page_id", "left").withColumn("texts", F.coalesce("texts", F.slice("pics", 1, 0)))
    pair = "array<struct<picture:bigint,text:bigint>>"

    def step(acc: Column, pic: Column) -> Column:
        free = F.filter("texts", lambda x: ~F.exists(acc, lambda m: m["text"].eqNullSafe(x["ord"])))
        scored = F.filter(F.transform(free, lambda x: F.struct(score(pic["box"], x["box"]).alias("s"), x["ord"].cast("long").alias("ord"))), lambda x: x["s"].isNotNull())
        return F.array_append(acc, F.struct(pic["ord"].cast("long").alias("picture"), F.array_min(scored)["ord"].alias("text")))

    made = both.withColumn("m", F.aggregate("pics", F.array().cast(pair), step))
    return made.select("page_id", F.explode("m").alias("m")).select("page_id", "m.picture", "m.text")


def islands(df: DataFrame, by: list[str], order: list[str], starts: Callable[[Column], Column] | Column, name: str = "grp") -> DataFrame:
    """Numbers runs of rows; ``starts`` says where a row begins a new one."""
    w = Window.partitionBy(*by).orderBy(*order)
    flag = F.when(F.row_number().over(w) == 1, 0).when(starts, 1).otherwise(0) if isinstance(starts, Column) else starts(w)
    return df.withColumn("_new", flag).withColumn(name, F.sum("_new").over(w).cast("int")).drop("_new")


def cluster_lines(lines: DataFrame, gap: int) -> DataFrame:
    """Clusters coordinates (page_id, line) by the gap to the last member; mean of each."""
    w = Window.partitionBy("page_id").orderBy("line")
    grouped = islands(lines, ["page_id"], ["line"], F.col("line") - F.lag("line").over(w) >= gap)
    return grouped.groupBy("page_id", "grp").agg(F.avg("line").cast("int").alias("center"), F.count(F.lit(1)).alias("members"))


def merge_lines(blocks: DataFrame, factor: float = 1.5) -> DataFrame:
    """Merges text lines below each other, (page_id, ord, text, confidence, box)."""
    w = Window.partitionBy("page_id").orderBy(F.col("box.y0"), F.col("ord"))
    last, b = F.lag("box").over(w), F.col("box")
    across = F.least(last["x1"], b["x1"]) - F.greatest(last["x0"], b["x0"])
    gap = b["y0"] - last["y1"]
    joins = (across > 0.3 * F.least(geom.width(last), geom.width(b))) & (gap >= -10) & (gap < factor * geom.height(last))
    grouped = islands(blocks.withColumn("y", F.col("box.y0")), ["page_id"], ["y", "ord"], ~joins)
    parts = F.array_sort(F.collect_list(F.struct("y", "ord", "text")))
    return grouped.groupBy("page_id", "grp").agg(*(f(b[c]).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))), F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"), F.round(F.avg("confidence"), 6).alias("confidence"), F.count(F.lit(1)).alias("line_count"))


def reading_order(panels: DataFrame, height: int) -> DataFrame:
    """Rows anchored at their first member's centre within 5 % of the height, then by x."""
    item = F.struct(geom.center_y(F.col("box")).alias("y"), "ord", geom.center_x(F.col("box")).alias("x"))
    pages = panels.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("row"), F.array().cast("array<struct<row:int,x:double,y:double,ord:bigint>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        new = acc["anchor"].isNull() | (i["y"] - acc["anchor"] > 0.05 * height)
        row = F.when(new, acc["row"] + 1).otherwise(acc["row"])
        return F.struct(F.when(new, i["y"]).otherwise(acc["anchor"]).alias("anchor"), row.alias("row"), F.array_append(acc["out"], F.struct(row.alias("row"), i["x"].alias("x"), i["y"].alias("y"), i["ord"].cast("long").alias("ord"))).alias("out"))

    sorted_ = F.array_sort(F.aggregate("items", start, step)["out"])
    return pages.select("page_id", F.posexplode(sorted_).alias("reading_index", "p")).select("page_id", "reading_index", F.col("p.ord").alias("ord"), F.col("p.row").alias("row"))


def bordered(lines: DataFrame, pages: DataFrame, reach: int = 50) -> DataFrame:
    """Lines (page_id, axis, line) with the page's borders (page_id, width, height) where
    no line lies within ``reach`` of them; a page without lines has its borders alone."""
    size = pages.select("page_id", F.explode(F.map_from_arrays(F.array(F.lit("h"), F.lit("v")), F.array("height", "width"))).alias("axis", "size"))
    ends = lines.groupBy("page_id", "axis").agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
    t = size.join(ends, ["page_id", "axis"], "left")
    first, last = F.coalesce(F.col("lo") > reach, F.lit(True)), F.coalesce(F.col("hi") < F.col("size") - reach, F.lit(True))
    more = t.select("page_id", "axis", F.explode(F.array_compact(F.array(F.when(first, 0), F.when(last, F.col("size"))))).alias("line"))
    return lines.select("page_id", "axis", F.col("line").cast("int")).unionByName(more.withColumn("line", F.col("line").cast("int")))


#: Columns and rows of usual pages, tried in this order (fixed values).
TEMPLATES = ((2, 3), (2, 4), (3, 3), (3, 4), (4, 3), (2, 5), (2, 6))


def template_cells(pages: DataFrame, least: int = 50) -> DataFrame:
    """Cells of the template with most cells whose cells are wide and high enough (the
    first on ties), of pages (page_id, width, height); the whole page where none is."""
    grids = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("cols"), F.lit(r).alias("rows")) for i, (c, r) in enumerate(TEMPLATES)))
    fits = F.filter(grids, lambda g: (F.floor(F.col("width") / g["cols"]) >= least) & (F.floor(F.col("height") / g["rows"]) >= least))
    ranked = F.transform(fits, lambda g: F.struct((-g["cols"] * g["rows"]).alias("cells"), g["i"].alias("i"), g["cols"].alias("cols"), g["rows"].alias("rows")))
    t = pages.withColumn("g", F.array_min(ranked)).withColumn("cols", F.coalesce("g.cols", F.lit(1))).withColumn("rows", F.coalesce("g.rows", F.lit(1)))
    t = t.withColumn("w", F.floor(F.col("width") / F.col("cols")).cast("int")).withColumn("h", F.floor(F.col("height") / F.col("rows")).cast("int"))
    t = t.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    end = lambda i, size, most: F.least((F.col(i) + 1) * F.col(size), F.col(most)).cast("int")
    return t.select("page_id", (F.col("col") * F.col("w")).cast("int").alias("x0"), (F.col("row") * F.col("h")).cast("int").alias("y0"), end("col", "w", "width").alias("x1"), end("row", "h", "height").alias("y1"))


def placeholder_texts(pages: DataFrame) -> DataFrame:
    """Text blocks where captions usually are, of pages (page_id, width, height): the last
    30 % of each cell of an estimated grid, with a name for a text and a low confidence."""
    cells = lambda size, most: F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col(size) / 300))).cast("int")
    t = pages.withColumn("cols", cells("width", 4)).withColumn("rows", cells("height", 6))
    t = t.withColumn("w", F.floor(F.col("width") / F.col("cols")).cast("int")).withColumn("h", F.floor(F.col("height") / F.col("rows")).cast("int"))
    t = t.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    x0, y0 = F.col("col") * F.col("w") + 10, F.col("row") * F.col("h") + (F.col("h") * 0.7).cast("int")
    x1, y1 = (F.col("col") + 1) * F.col("w") - 10, (F.col("row") + 1) * F.col("h") - 10
    t = t.select("page_id", (F.col("row") * F.col("cols") + F.col("col")).cast("long").alias("ord"), F.concat(F.lit("[cell_"), "row", F.lit("_"), "col", F.lit("]")).alias("text"), F.lit(0.3).alias("confidence"), geom.box(x0, y0, x1, y1).alias("box"))
    return t.filter((geom.width(F.col("box")) >= 50) & (geom.height(F.col("box")) >= 20))


def without_repeats(boxes: DataFrame, most: float = 0.5) -> DataFrame:
    """Boxes (page_id, ord, box) that no earlier kept one covers by more than ``most``."""
    pages = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "box"))).alias("items"))
    kept = F.aggregate("items", F.slice("items", 1, 0), lambda acc, b: F.when(F.exists(acc, lambda k: geom.covered(b["box"], k["box"]) > most), acc).otherwise(F.array_append(acc, b)))
    return pages.select("page_id", F.explode(kept).alias("k")).select("page_id", "k.ord", "k.box")


def rows_by_gap(boxes: DataFrame, gap: int) -> DataFrame:
    """Numbers rows of boxes (page_id, ord, box): a new one where the top is ``gap`` or more below the last's."""
    w = Window.partitionBy("page_id").orderBy("y", "ord")
    t = boxes.withColumn("y", F.col("box.y0"))
    return islands(t, ["page_id"], ["y", "ord"], F.col("y") - F.lag("y").over(w) >= gap, "row").drop("y")


def grid_cells(lines: DataFrame, least: int = 50, least_area: int = 5000) -> DataFrame:
    """Cells between consecutive lines (page_id, axis 'h' or 'v', line); small ones dropped."""
    w = Window.partitionBy("page_id", "axis").orderBy("line")
    spans = lines.withColumn("next", F.lead("line").over(w)).filter(F.col("next") - F.col("line") >= least)
    h = spans.filter("axis = 'h'").select("page_id", F.col("line").alias("y0"), F.col("next").alias("y1"))
    v = spans.filter("axis = 'v'").select("page_id", F.col("line").alias("x0"), F.col("next").alias("x1"))
    big = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= least_area
    return h.join(v, "page_id").filter(big).select("page_id", "x0", "y0", "x1", "y1")


def grid_size(cells: DataFrame) -> DataFrame:
    """Rows and columns of each page's grid: distinct tops and left sides."""
    return cells.groupBy("page_id").agg(F.countDistinct("y0").alias("grid_rows"), F.countDistinct("x0").alias("grid_cols"), F.count(F.lit(1)).alias("items_detected"))
