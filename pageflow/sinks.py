"""Writers: CSV, job files, packages, review pages, PNG crops."""

from __future__ import annotations

import html
import json
import os
import sqlite3
import struct
import tempfile
import zipfile
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import review

_MODEL = 1607392319


def unsafe_paths(cards: DataFrame, most: int = 20) -> list[str]:
    """The first unsafe image paths (empty ones are allowed here)."""
    problem = text.path_problem(F.col("front_image_path"))
    rows = cards.filter(problem.isNotNull() & (problem != "empty")).orderBy("card_id").limit(most).collect()
    return [r.front_image_path for r in rows]


def export_csv(cards: DataFrame, path: str, include_review: bool = False) -> int:
    """Writes the CSV export in order; raises for unsafe paths or no rows."""
    if bad := unsafe_paths(cards):
        raise ValueError(f"unsafe paths: {bad}")
    rows = review.csv_rows(cards, include_review)
    n = rows.count()
    if not n:
        raise ValueError("no cards to export")
    rows.orderBy("page", "idx", "card_id").drop("page", "idx").write.mode("overwrite").option("header", True).csv(path)
    return n


def write_job(cards: DataFrame, queue: DataFrame, metrics: DataFrame, folder: str) -> None:
    """Result, review queue, and last the metrics, which mark the job finished."""
    cards.write.mode("overwrite").json(f"{folder}/result")
    queue.write.mode("overwrite").json(f"{folder}/review_queue")
    metrics.withColumn("finished", F.lit(True)).withColumn("completed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).write.mode("overwrite").json(f"{folder}/metrics")


def deck_name(cards: DataFrame, other: str) -> str:
    """The first source in export order, or another name where there is none."""
    place = F.struct(F.coalesce("page_id", F.lit("")), F.coalesce("token_index", F.lit(0)), "card_id")
    said = text.strip(F.coalesce("source_ref", F.lit("")))
    return cards.filter(said != "").agg(F.min_by(said, place).alias("s")).first().s or other


def export_apkg(cards: DataFrame, path: str, deck: str, images: dict[str, bytes] | Folder | None = None, tags: str | None = None) -> int:
    """Writes one package of the active cards (a deck is a file for one person: its
    rows stream through the driver in order)."""
    rows = cards.filter((F.col("status") == "active") & (F.coalesce("front_image_path", F.lit("")) != ""))
    if bad := unsafe_paths(rows):
        raise ValueError(f"unsafe paths: {bad}")
    ordered = rows.select("card_id", "word", "front_image_path", text.note_front(F.element_at(F.split("front_image_path", "/"), -1)).alias("front"), text.note_back(F.col("word")).alias("back")).orderBy(F.coalesce("page_id", F.lit("")), F.coalesce("token_index", F.lit(0)), "card_id")
    media: dict[str, str] = {}
    named = [t.strip().replace(" ", "_") for t in (tags or "").split(",") if t.strip()]
    marks = f" {' '.join(named)} " if named else ""
    n = 0
    with tempfile.TemporaryDirectory() as folder:
        db = sqlite3.connect(os.path.join(folder, "collection.anki2"))
        db.executescript(
            "CREATE TABLE col (id INTEGER PRIMARY KEY, crt INTEGER, mod INTEGER, scm INTEGER, ver INTEGER, dty INTEGER, usn INTEGER, ls INTEGER, conf TEXT, models TEXT, decks TEXT, dconf TEXT, tags TEXT);"
            "CREATE TABLE notes (id INTEGER PRIMARY KEY, guid TEXT, mid INTEGER, mod INTEGER, usn INTEGER, tags TEXT, flds TEXT, sfld TEXT, csum INTEGER, flags INTEGER, data TEXT);"
            "CREATE TABLE cards (id INTEGER PRIMARY KEY, nid INTEGER, did INTEGER, ord INTEGER, mod INTEGER, usn INTEGER, type INTEGER, queue INTEGER, due INTEGER, ivl INTEGER, factor INTEGER, reps INTEGER, lapses INTEGER, left INTEGER, odue INTEGER, odid INTEGER, flags INTEGER, data TEXT);"
        )
        db.execute("INSERT INTO col VALUES (1,0,0,0,11,0,0,0,'{}',?,?,'{}','{}')", (json.dumps({str(_MODEL): {"name": "picture"}}), json.dumps({"1": {"name": deck}})))
        for row in ordered.toLocalIterator():
            n += 1
            base = row.front_image_path.rpartition("/")[2]
            name = base if media.setdefault(base, row.front_image_path) == row.front_image_path else f"{row.card_id}_{base}"
            media[name] = row.front_image_path
            front = row.front.replace(html.escape(base), html.escape(name))
            db.execute("INSERT INTO notes VALUES (?,?,?,0,-1,?,?,?,0,0,'')", (n, row.card_id, _MODEL, marks, f"{front}\x1f{row.back}", row.word))
            db.execute("INSERT INTO cards VALUES (?,?,1,0,0,-1,0,0,?,0,0,0,0,0,0,0,0,'')", (n, n, n))
        db.commit()
        db.close()
        if not n:
            raise ValueError("no active cards to export")
        with zipfile.ZipFile(path, "w") as z:
            z.write(os.path.join(folder, "collection.anki2"), "collection.anki2")
            z.writestr("media", json.dumps({str(i): name for i, name in enumerate(media)}))
            for i, name in enumerate(media):
                z.writestr(str(i), (images or {}).get(media[name], b""))
    return n


def review_page(queue: DataFrame, path: str) -> None:
    """A static page that lists the review queue (one person's, in order)."""
    rows = [r.asDict() for r in queue.orderBy("page_id", "token_index", "card_id").toLocalIterator()]
    body = json.dumps(rows, ensure_ascii=False, default=str).replace("</", "<\\/")
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<!DOCTYPE html><meta charset="utf-8"><title>Review</title><ol id="list"></ol><script>const items={body};for(const x of items){{const li=document.createElement("li");li.textContent=`${{x.page_id}}: ${{x.text}} (${{x.review_reason}})`;document.getElementById("list").append(li)}}</script>')


#: Image types by ending (fixed values).
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp"}


def data_url(path: Column, content: Column) -> Column:
    """An image's data URL; a missing one is empty."""
    kinds = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    ending = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.when(content.isNull(), "").otherwise(F.concat(F.lit("data:"), F.coalesce(kinds[ending], F.lit("image/png")), F.lit(";base64,"), F.base64(content)))


_PAIR_PAGE = """<!DOCTYPE html><meta charset="utf-8"><title>Pairs</title><p id="stats"></p>
<p><button data-f="all">all</button><button data-f="review">review</button><button data-f="edited">edited</button><button data-f="excluded">excluded</button><button id="save">export</button></p><ol id="list"></ol>
<script>const pairs=@@PAIRS@@,state=new Map();let shown="all";
const of=p=>state.get(p.pair_id)||{};const put=(p,x)=>{state.set(p.pair_id,{...of(p),...x});draw()};
const tests={all:p=>true,review:p=>p.needs_review,edited:p=>of(p).caption!==undefined,excluded:p=>!!of(p).excluded};
function draw(){document.getElementById("stats").textContent=Object.keys(tests).map(k=>`${k}: ${pairs.filter(tests[k]).length}`).join(", ");
const list=document.getElementById("list");list.replaceChildren();for(const p of pairs.filter(tests[shown])){const li=document.createElement("li"),text=document.createElement("input"),out=document.createElement("input");
if(p.image){const img=document.createElement("img");img.src=p.image;img.height=120;li.append(img)}
text.value=of(p).caption??p.caption_text??"";text.onchange=()=>put(p,{caption:text.value});out.type="checkbox";out.checked=!!of(p).excluded;out.onchange=()=>put(p,{excluded:out.checked});
li.append(text,out,` exclude (${p.page_id}, ${p.badge})`);list.append(li)}}
document.querySelectorAll("[data-f]").forEach(b=>b.onclick=()=>{shown=b.dataset.f;draw()});
document.getElementById("save").onclick=()=>{const items=pairs.filter(p=>state.has(p.pair_id)).map(p=>({pair_id:p.pair_id,action:of(p).excluded?"reject":of(p).caption!==undefined?"edit":"approve",edited_caption:of(p).caption}));
const a=document.createElement("a");a.href=URL.createObjectURL(new Blob([JSON.stringify({items})],{type:"application/json"}));a.download="pair_feedback.json";a.click()};draw();</script>"""


def pair_review_page(pairs: DataFrame, path: str) -> int:
    """A static page to review pairs (pair_id, page_id, order_index, caption_text, needs_review,
    confidence, image): one person's, streamed in order.  Its export is a feedback file."""
    rows = pairs.select("pair_id", "page_id", "order_index", "caption_text", "needs_review", "image", text.badge(F.col("confidence")).alias("badge")).orderBy("page_id", "order_index", "pair_id")
    before, _, after = _PAIR_PAGE.partition("@@PAIRS@@")
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write(before + "[")
        for row in rows.toLocalIterator():
            f.write(("," if n else "") + json.dumps(row.asDict(), ensure_ascii=False).replace("</", "<\\/"))
            n += 1
        f.write("]" + after)
    return n


def with_images(spark: SparkSession, pairs: DataFrame, folder: str | None, path: str = "picture_path") -> DataFrame:
    """Pairs with ``image``, the data URL of their picture in a job's folder; empty where there
    is none, where its path is unsafe, or without a folder."""
    if folder is None or path not in pairs.columns:
        return pairs.withColumn("image", F.lit(""))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(folder)
    root = folder.rstrip("/") if "://" in folder else os.path.abspath(folder)
    held = files.select(F.get(F.split("path", f"\\Q{root}/\\E", 2), F.lit(1)).alias("_path"), "content")
    safe = F.when(text.path_problem(F.col(path)).isNull(), F.regexp_replace(path, r"\\", "/"))
    return pairs.withColumn("_path", safe).join(held, "_path", "left").withColumn("image", data_url(F.col("_path"), F.col("content"))).drop("_path", "content")


class Folder:
    """Images of a job's folder by their path in it; a missing one is empty."""

    def __init__(self, folder: str):
        self.folder = folder

    def get(self, path: str, default: bytes = b"") -> bytes:
        try:
            with open(os.path.join(self.folder, path), "rb") as f:
                return f.read()
        except OSError:
            return default


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Pairs as JSON, a row a page with its pairs in order (schema 2.0)."""
    held = F.struct("order_index", *(c for c in pairs.columns if c not in ("order_index", "page_id")))
    grouped = pairs.groupBy("page_id").agg(F.array_sort(F.collect_list(held)).alias("pairs"))
    grouped.select(F.lit("2.0-sam").alias("schema_version"), F.array(F.struct("page_id", "pairs")).alias("pages")).write.mode("overwrite").json(path)


def write_errors(errors: DataFrame, path: str) -> None:
    """Error rows (page_id, stage, message), appended."""
    errors.select("page_id", "stage", "message").write.mode("append").json(path)


def png(rgb: np.ndarray) -> bytes:
    """A PNG of 8-bit gray, RGB or RGBA pixels."""
    height, width = rgb.shape[:2]
    kind = 0 if rgb.ndim == 2 else 6 if rgb.shape[2] == 4 else 2
    raw = b"".join(b"\0" + np.ascontiguousarray(row, np.uint8).tobytes() for row in rgb)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
