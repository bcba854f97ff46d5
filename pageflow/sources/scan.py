"""Page scans: folders of images and documents, and stored OCR results by page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import TOKEN_PAGE, read_files

_PAGE = "path string, n int, name string, content binary, error string"


def _rendered(files: DataFrame, make: Callable, dpi: int) -> DataFrame:
    """A row a page of each document (path, content); a bad document gives an error row."""

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        renderer = make()
        for batch in found:
            for path, content in zip(batch["path"], batch["content"]):  # one document's pages at a time
                try:
                    rows = [(path, n, name, image, None) for n, (name, image) in enumerate(renderer.pages(content, dpi))]
                except Exception as e:  # a bad document must not fail the job
                    rows = [(path, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["path", "n", "name", "content", "error"])

    return files.select("path", "content").mapInPandas(run, _PAGE)


def _counted(files: DataFrame, make: Callable) -> DataFrame:
    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        renderer = make()
        for batch in found:
            counts = []
            for content in batch["content"]:
                try:
                    counts.append(renderer.count(content))
                except Exception:  # its error row comes from rendering
                    counts.append(0)
            yield pd.DataFrame({"path": batch["path"], "n_pages": counts})

    return files.select("path", "content").mapInPandas(run, "path string, n_pages int")


def document_images(spark: SparkSession, path: str, make_renderer: Callable, dpi: int = 300) -> DataFrame:
    """Decoded pages (page_id, image) of documents: ``{page}`` of a single one, ``{file}_{page}``
    in a folder.  The renderer's ``arrays(content, dpi)`` gives (page, RGB pixels); a bad
    document is left out."""
    alone = path.lower().endswith(".pdf")

    def run(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        renderer = make_renderer()
        for batch in found:
            for where, content in zip(batch["path"], batch["content"]):
                stem = where.rpartition("/")[2].rpartition(".")[0]
                try:
                    for name, rgb in renderer.arrays(content, dpi):
                        data = rgb[..., ::-1].tobytes()
                        yield pd.DataFrame([(name if alone else f"{stem}_{name}", where, rgb.shape[0], rgb.shape[1], 3, 16, data)], columns=["page_id", "origin", "height", "width", "nChannels", "mode", "data"])
                except Exception as e:  # a bad document must not fail the job
                    print(f"rendering failed: {where}: {e}")

    made = read_files(spark, path).filter("kind = 1").select("path", "content").mapInPandas(run, "page_id string, origin string, height int, width int, nChannels int, mode int, data binary")
    return made.select("page_id", F.struct("origin", "height", "width", "nChannels", "mode", "data").alias("image"))


def read_pages(spark: SparkSession, path: str, make_renderer: Callable | None = None, dpi: int = 200) -> DataFrame:
    """Pages of folders: page_index, page_id, source_ref, content, error.

    Images come first, by path, then documents' pages; a folder is a job and numbers
    its own pages.  Numbers come from file names and page counts alone, so images are
    never sorted.  Without a renderer (``count(content)``, ``pages(content, dpi)``,
    built in the worker) documents are left out."""
    files = read_files(spark, path)
    images, documents = files.filter("kind = 0"), files.filter("kind = 1")
    counts = images.select("path", F.lit(0).alias("kind"), F.lit(1).alias("n_pages"))
    pages = images.select("path", F.lit(0).alias("n"), F.lit(None).cast("string").alias("name"), "content", F.lit(None).cast("string").alias("error"))
    if make_renderer:
        counts = counts.unionByName(_counted(documents, make_renderer).withColumn("kind", F.lit(1)))
        pages = pages.unionByName(_rendered(documents, make_renderer, dpi))
    parts = F.split("path", "/")
    before = Window.partitionBy("folder").orderBy("kind", "path").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")).withColumn("first", F.coalesce(F.sum("n_pages").over(before), F.lit(0))).select("path", "first")
    named = pages.join(starts, "path").withColumn("page_index", (F.col("first") + F.col("n")).cast("int"))
    page_id = F.when(F.col("n").isNotNull(), F.concat(F.lit("page_"), F.lpad((F.col("page_index") + 1).cast("string"), F.greatest(F.lit(3), F.length((F.col("page_index") + 1).cast("string"))), F.lit("0"))))
    source = F.concat(F.element_at(parts, -2), F.lit("/"), F.element_at(parts, -1), F.when(F.col("name").isNotNull(), F.concat(F.lit("#"), "name")).otherwise(""))
    return named.select("page_index", page_id.alias("page_id"), source.alias("source_ref"), "content", "error")


def stored_tokens(spark: SparkSession, pages: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(tokens, errors) of pages (page_id, page_index) with a stored clean OCR result.

    A page's file is the first of four names that has tokens; one that can't be
    parsed ends the search with an error, as does a page without any file."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.from_json("value", f"{TOKEN_PAGE}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("j"))
    i = F.col("page_index")
    names = F.array(F.concat("page_id", F.lit("_clean.json")), F.concat("page_id", F.lit(".cleaned.json")), F.format_string("page_%03d.cleaned.json", i), F.format_string("page_%d.cleaned.json", i))
    tried = pages.select("page_id", F.posexplode(names).alias("place", "file")).join(raw, "file", "left")
    bad = F.col("j._bad").isNotNull()
    usable = F.col("j.tokens").isNotNull() | bad
    first = tried.groupBy("page_id").agg(F.min_by(F.struct("file", "j"), F.when(usable, F.col("place"))).alias("f"), F.max(F.col("j").isNotNull()).alias("any"))
    found = first.select("page_id", "f.file", "f.j", "any").withColumn("bad", F.coalesce(bad, F.lit(False)))
    tokens = found.filter(~F.col("bad")).select("page_id", F.posexplode("j.tokens").alias("ord", "t"))
    b = F.col("t.bbox_xyxy")
    box = F.when(F.size(b) == 4, F.struct(*(b[k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1")))))
    message = F.when(F.col("bad"), F.concat(F.lit("failed_to_parse: "), "file")).when(~F.col("any"), "mocked_clean_missing")
    errors = found.withColumn("message", message).filter("message is not null").select("page_id", F.lit("mocked_ocr").alias("stage"), "message")
    return tokens.select("page_id", "ord", F.col("t.text").alias("text"), F.col("t.confidence").alias("confidence"), box.alias("box")), errors
