import json
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageflow import cli, extract, jobfiles, pairfiles, plugins, sinks, sources
from pageflow.operators import enhance, kernels, pixels, review, summaries

TEXTS = "page_id string, ord int, text string, confidence double, box struct<x0:int,y0:int,x1:int,y1:int>"


def box(*v):
    return dict(zip(("x0", "y0", "x1", "y1"), v))


def flood(mask, diagonal):
    """Boxes and areas by walking from pixel to pixel."""
    left, out = {tuple(p) for p in np.argwhere(mask)}, []
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0), *([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])]
    while left:
        todo, part = [left.pop()], []
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            for dy, dx in steps:
                if (y + dy, x + dx) in left:
                    left.remove((y + dy, x + dx))
                    todo.append((y + dy, x + dx))
        ys, xs = zip(*part)
        out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(part)))
    return sorted(out)


@pytest.mark.parametrize("diagonal", [False, True])
def test_components_against_a_walk(diagonal):
    rng = np.random.default_rng(4)
    for share in (0.2, 0.5, 0.6, 0.9):
        mask = rng.random((23, 31)) < share
        assert sorted(pixels.components(mask, diagonal)) == flood(mask, diagonal)
        seeds = mask & (rng.random(mask.shape) < 0.05)
        kept = pixels.holding(mask, seeds)
        grown = seeds
        while not (grown == (more := kernels.dilate(grown, 3) & mask)).all():
            grown = more
        assert (kept == grown).all()
    assert pixels.components(np.zeros((4, 4), bool)) == []


def test_a_page_is_scanned_in_seconds():
    g = np.random.default_rng(2).integers(0, 256, (1500, 2000)).astype(np.float32)
    began = time.time()
    assert len(pixels.components(g > 128)) > 1000 and kernels.edges(g).any()
    assert time.time() - began < 30


def test_background_regions():
    g = np.full((120, 160), 188.0)
    g[20:60, 30:90] = 20
    g[80:110, 100:150] = 250
    g[5, 5] = 0  # a speck is opened away
    assert [b[:4] for b in kernels.background_regions(g, background=188)] == [(30, 20, 90, 60), (100, 80, 150, 110)]


def test_page_hash_and_grid():
    a = np.zeros((300, 200), np.float32)
    b = a.copy()
    b[:150] = 255
    assert pixels.page_hash(a) == pixels.page_hash(a.copy()) != pixels.page_hash(b)
    g = np.full((200, 200), 255.0)
    g[50], g[150], g[:, 60], g[:, 140] = 0, 0, 0, 0
    rows, cols = pixels.grid_lines_laddered(g)
    assert {49, 50, 149, 150} <= set(rows) and {59, 60, 139, 140} <= set(cols)


def test_pairs_of_a_page(spark):
    pages = spark.createDataFrame([("a", 1000, 1000), ("b", 1000, 1000)], "page_id string, width int, height int")
    pictures = spark.createDataFrame([("a", 0, 0.9, box(100, 100, 300, 300)), ("a", 1, 0.8, box(110, 110, 310, 310)), ("a", 2, 0.7, box(500, 100, 700, 300)), ("a", 3, 0.9, box(0, 0, 1000, 1000)), ("b", 0, 0.9, box(100, 100, 300, 300))], "page_id string, ord int, confidence double, box struct<x0:int,y0:int,x1:int,y1:int>")
    texts = spark.createDataFrame([("a", 0, "apple", 0.9, box(120, 320, 280, 360)), ("a", 1, "fish", 0.9, box(520, 320, 680, 360)), ("a", 2, "x", 0.1, box(800, 800, 900, 850))], TEXTS)
    pairs, summary = extract.extract_pairs(pictures, texts, pages)
    got = {(r.page_id, r.order_index): (r.caption_text, r.needs_review) for r in pairs.collect()}
    assert got == {("a", 0): ("apple", False), ("a", 1): ("fish", False), ("b", 0): ("", True)}
    s = {r.page_id: r for r in summary.collect()}
    assert (s["a"].pictures_detected, s["a"].text_blocks_detected, s["a"].unmatched_text_blocks, s["b"].pairs_needing_review) == (2, 2, 0, 1)
    lost = pairs.filter("needs_review").select("pair_id", F.lit("dog").alias("caption"))
    again, _ = extract.extract_pairs(pictures, texts, pages, captions=lost)
    assert {r.caption_text for r in again.collect()} == {"apple", "fish", "dog"}
    cards = extract.cards_of_pairs(pairs)
    assert review.card_violations(cards).count() == 0 and cards.filter("status = 'review'").count() == 1


def test_pairs_of_a_folder(spark, tmp_path):
    rgb = np.full((400, 300, 3), 255, np.uint8)
    rgb[60:160, 60:160] = (200, 30, 30)
    (tmp_path / "one.png").write_bytes(sinks.png(rgb))
    tokens = spark.createDataFrame([("one", 0, "hello world", 0.9, box(60, 175, 160, 200))], TEXTS)
    pairs, summary = extract.extract_pairs_from_folder(spark, str(tmp_path), tokens)
    assert [(r.page_id, r.caption_text) for r in pairs.collect()] == [("one", "hello world")]
    assert summary.first().pairs_extracted == 1


def test_rules_change_a_copy():
    plain = extract.PairOptions()
    new = extract.with_rules(plain, {"search_direction": "right", "max_pairing_distance_px": "120", "text_iou_threshold": 0.4})
    assert (new.search_direction, new.max_pairing_distance_px, new.text_iou_threshold) == ("right", 120.0, 0.4)
    assert plain == extract.PairOptions() == extract.with_rules(plain, {"search_direction": "sideways"})
    assert review.blank_threshold(None) == 0.7 and review.blank_threshold(0.9, 0.2) == 0.95 and review.blank_threshold(0.35, -0.2) == 0.3


def test_engines_are_tried_in_order():
    class Missing:
        def __init__(self):
            raise ImportError("no model")

    class Fails:
        def tokens(self, content):
            raise ValueError("bad page")

    class Finds:
        def tokens(self, content):
            return [("w", 0.5, (0, 0, 1, 1))]

    assert plugins.Chain(Missing, Fails, Finds).tokens(b"") == [("w", 0.5, (0, 0, 1, 1))]
    assert plugins.Chain(Missing).tokens(b"") == []
    with pytest.raises(ValueError):
        plugins.Chain(Missing, Fails).tokens(b"")


def test_job_files(spark, tmp_path):
    job = str(tmp_path / "job")
    told = jobfiles.start_job(job, jobfiles.job_id(), "scan", *jobfiles.resolve_input(str(tmp_path)))
    assert told["input"]["type"] == "folder" and not json.load(open(f"{job}/metrics.json"))["finished"]
    jobs = spark.createDataFrame([("a",), ("b",)], "job_id string")
    lost = summaries.missing_files(jobfiles.present_files(spark, {"a": job, "b": str(tmp_path / "none")}), jobs)
    assert {(r.job_id, r.name) for r in lost.collect()} == {("b", x) for x in summaries.CONTRACT}
    (tmp_path / "c.json").write_text(json.dumps({"cleanup": {"max_tokens_per_page": 7, "allow_short_tokens": ["a"]}, "crop": {"bbox_crop_padding_px": 3}}))
    config = jobfiles.load_config(str(tmp_path / "c.json"))
    assert (config.clean.max_tokens, config.clean.allow_short, config.clean.min_confidence, config.crop.padding, config.crop.min_area) == (7, ("a",), 0.3, 3, 4096)
    assert jobfiles.upgraded_feedback([{"a": 1}])["items"] == [{"a": 1}]
    with pytest.raises(ValueError):
        jobfiles.upgraded_feedback({"items": 3})
    with pytest.raises(ValueError):
        jobfiles.resolve_input("x.txt")
    records = spark.createDataFrame([("r", "approve")], "record_id string, action string")
    jobfiles.export_training(records, f"{job}/out", "json")
    assert spark.read.json(f"{job}/out").first().record_count == 1
    jobfiles.write_stage(spark.createDataFrame([("p", 1)], "page_id string, n int"), job, "layout")
    assert spark.read.json(f"{job}/stage/layout").first().page_id == "p"
    path = jobfiles.log_feedback(records, f"{job}/log", "job-1234-5")
    assert path.endswith("__job-1234") and spark.read.json(path).count() == 1


def scene(spark, folder):
    """A page with a noisy picture at (60, 60, 160, 160) and a caption below it."""
    rgb = np.full((400, 300, 3), 255, np.uint8)
    rgb[60:160, 60:160] = np.random.default_rng(3).integers(0, 200, (100, 100, 1))
    folder.mkdir()
    (folder / "one.png").write_bytes(sinks.png(rgb))
    return rgb


def test_extract_commands(spark, tmp_path):
    rgb = scene(spark, tmp_path / "in")
    (tmp_path / "ocr.json").write_text(json.dumps({"page_id": "one", "tokens": [{"text": "hello world", "confidence": 0.9, "bbox_xyxy": [60, 175, 160, 200]}]}))
    base = ["--input", str(tmp_path / "in"), "--workspace", str(tmp_path / "ws"), "--tokens", str(tmp_path / "ocr.json")]
    assert cli.main(["extract", *base, "--export", str(tmp_path / "deck.apkg")]) == 0
    job = next((tmp_path / "ws/output").iterdir())
    told = json.loads((job / "job_summary.json").read_text())
    pair = told["pages"][0]["pairs"][0]
    assert told["total_pairs"] == 1 and pair["caption_text"] == "hello world" and pair["picture_path"] == "one/pair_001/image.png"
    meta = json.loads((job / "one/pair_001/meta.json").read_text())
    assert meta["pair_id"] == pair["pair_id"] and meta["text_bbox"] == [60, 175, 160, 200]
    x0, y0, x1, y1 = meta["picture_bbox"]
    shown = extract.decoded(spark, str(job / "one/pair_001")).filter("page_id = 'image'").first().image
    assert (pixels.rgb(shown.data, shown.height, shown.width, shown.nChannels) == rgb[y0:y1, x0:x1]).all()
    assert json.loads((job / "one/summary.json").read_text())["image_size"] == [300, 400]
    notes = sources.read_apkg(spark, str(tmp_path / "deck.apkg")).collect()
    assert len(notes) == 1 and zipfile.ZipFile(tmp_path / "deck.apkg").read("0") == (job / "one/pair_001/image.png").read_bytes()
    # the second command draws, exports a table and keeps seven fields
    assert cli.main(["extract-pairs", *base, "--debug-viz", "--export", str(tmp_path / "out.csv")]) == 0
    other = next(x for x in (tmp_path / "ws/output").iterdir() if x != job)
    assert (other / "debug_viz/one_pairs.png").stat().st_size and len(spark.read.json(str(other / "result")).columns) == 7
    assert len(spark.read.json(str(other / "result")).first()) == 7
    assert cli.main(["extract", *base, "--max-area-ratio", "0.01"]) == 0  # the picture is too large then
    assert json.loads((job / "job_summary.json").read_text())["total_pairs"] == 0
    assert cli.main(["extract", "--input", str(tmp_path / "none.txt"), "--workspace", str(tmp_path)]) == 1


def test_pages_are_shown_with_their_pictures(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/image.png").write_bytes(b"picture")
    pairs = spark.createDataFrame([("p", "a/image.png"), ("q", "../x.png"), ("r", "a/none.png")], "pair_id string, picture_path string")
    got = {r.pair_id: r.image for r in sinks.with_images(spark, pairs, str(tmp_path)).collect()}
    assert got == {"p": "data:image/png;base64,cGljdHVyZQ==", "q": "", "r": ""}


def test_files_stay_in_their_folder(spark, tmp_path):
    files = lambda path: spark.createDataFrame([(path, b"x")], "path string, content binary")
    assert pairfiles.write_files(files("a/b.txt"), str(tmp_path)) == 1 and (tmp_path / "a/b.txt").read_bytes() == b"x"
    with pytest.raises(Exception, match="unsafe path"):
        pairfiles.write_files(files("../b.txt"), str(tmp_path))
    assert pairfiles.write_files(files("x").limit(0), str(tmp_path)) == 0


def test_drawing():
    page = np.zeros((40, 60, 3), np.uint8)
    line = kernels.draw_line(page, (5, 5), (25, 15), (0, 255, 0), 1)
    assert line[5, 5, 1] and line[15, 25, 1] and (line[..., 1] > 0).sum() == 21
    label = kernels.draw_label(page, (-5, 38), "P#1 ?", (9, 9, 9), 2)
    assert label[30, 0, 0] == 9 and (label[:30] == 0).all() and kernels.draw_label(page, (0, 0), "#" * 40, (9, 9, 9)).shape == page.shape
    assert kernels.crop(page, (55, 35, 90, 90)).shape == (5, 5, 3) and kernels.crop(page, (70, 50, 80, 60)).shape == (1, 1, 3)


def test_panels_are_drawn(spark, tmp_path):
    scene(spark, tmp_path / "in")
    panels = spark.createDataFrame([("one", 1, box(20, 20, 200, 200), True, False), ("one", 2, None, True, True)], "page_id string, block_index int, box struct<x0:int,y0:int,x1:int,y1:int>, needs_review boolean, is_blank boolean")
    made = pairfiles.panel_pages(extract.decoded(spark, str(tmp_path / "in")), panels).collect()
    assert [r.path for r in made] == ["one_panels.png"] and made[0].content.startswith(b"\x89PNG")


def test_second_reading_is_cleaned_up(spark, tmp_path):
    rgb = scene(spark, tmp_path / "in")

    class Engine:
        seen = 0

        def tokens(self, content):
            self.seen += 1
            if self.seen == 1:
                return []
            return [("gray" if content == sinks.png(enhance.prepared(pixels.luma(rgb))) else "other", 0.9, (0, 0, 5, 5))]

    got = plugins.run_ocr(extract.decoded(spark, str(tmp_path / "in")), Engine).collect()
    assert [(r.page_id, r.text, r.error) for r in got] == [("one", "gray", None)]


def test_noise_filter_against_brute_force():
    g = np.random.default_rng(1).integers(0, 256, (9, 11)).astype(np.float32)
    got = enhance.denoised(g, 60, 3, 5, band=4)
    p = np.pad(g.astype(float), 3, mode="reflect")
    for y in range(9):
        for x in range(11):
            own, total, weights = p[y + 2 : y + 5, x + 2 : x + 5], 0.0, 0.0
            for dy in range(-2, 3):
                for dx in range(-2, 3):
                    other = p[y + 2 + dy : y + 5 + dy, x + 2 + dx : x + 5 + dx]
                    w = np.exp(-((own - other) ** 2).mean() / 60**2)
                    total, weights = total + w * other[1, 1], weights + w
            assert abs(got[y, x] - total / weights) <= 0.5 + 1e-6
    flat = np.full((12, 12), 7.0)
    assert (enhance.adaptive(flat) == 255).all() and enhance.prepared(np.zeros((0, 4))).size == 0 and enhance.prepared(np.zeros((3, 3))).shape == (3, 3)


def test_segments(spark, tmp_path):
    rgb = scene(spark, tmp_path / "in")

    class Engine:
        def masks(self, page, at):
            small, large = np.zeros(page.shape[:2], bool), np.zeros(page.shape[:2], bool)
            small[0:3, 0:3] = True
            large[60:160, 60:160] = True
            large[100:102, 100:102] = False  # a gap is closed
            return [small, large]

    class Fails:
        def masks(self, page, at):
            raise RuntimeError("no model")

    how, crop = plugins.segment(rgb, (50, 50, 170, 170), Engine(), "model")
    assert how == "model" and crop.shape == (110, 110, 4) and (crop[5:105, 5:105, 3] == 255).sum() >= 100 * 100 - 4
    how, crop = plugins.segment(rgb, (50, 50, 170, 170), Fails())
    assert how == "bbox_fallback_enhanced" and crop.shape == (130, 130, 3)
    words = extract.decoded(spark, str(tmp_path / "in")).withColumn("box", F.expr("named_struct('x0', 50, 'y0', 50, 'x1', 170, 'y1', 170)"))
    both = words.unionByName(words.withColumn("page_id", F.lit("two")).withColumn("box", F.lit(None).cast(words.schema["box"].dataType)))
    got = {r.page_id: (r.segment_status, r.segment_method) for r in plugins.run_segmenter(both, Engine, "model").collect()}
    assert got == {"one": ("success", "model"), "two": ("failed", "model")}
    assert (enhance.sharpened(np.full((5, 5, 3), 90, np.uint8)) == 90).all()
