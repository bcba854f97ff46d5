import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageflow import sinks, sources
from pageflow.functions import geom, ids, text
from pageflow.operators import assembly, matching, pages, pixels, review

SMOKE = [("alpha", 0.98, (10, 10, 80, 50)), ("beta", 0.97, (90, 10, 170, 50)), ("gamma", 0.96, (180, 10, 235, 50)), ("delta", 0.95, (10, 65, 90, 110)), ("epsilon", 0.94, (100, 65, 220, 110))]


@pytest.fixture(scope="module")
def smoke(spark):
    rows = [("page_001", i, w, c, dict(zip(("x0", "y0", "x1", "y1"), b))) for i, (w, c, b) in enumerate(SMOKE)]
    return spark.createDataFrame(rows, "page_id string, ord int, text string, confidence double, box struct<x0:int,y0:int,x1:int,y1:int>")


def test_smoke_page(spark, smoke):
    clean = pages.clean_tokens(smoke)
    sizes = spark.createDataFrame([("page_001", 240, 120), ("page_002", 240, 120)], "page_id string, width int, height int")
    kinds = {r.page_id: r.layout_type for r in pages.layouts(sizes, clean).collect()}
    assert kinds == {"page_001": "multi_word", "page_002": "unknown"}
    cropped = pages.crops(clean, 240, 120, pages.CropOptions(padding=10)).withColumn("token_index", F.col("rank")).withColumn("source_ref", F.lit("pages/page_000.png"))
    areas = [r.a for r in cropped.orderBy("rank").select(geom.area(F.col("crop_box")).alias("a")).collect()]
    assert areas == [5400, 6000, 4200, 6500, 9100]
    made = {r.word: r for r in pages.cards(cropped, 0.99).collect()}
    want = hashlib.sha1(b"pages/page_000.png|page_001|alpha|10,10,80,50").hexdigest()
    assert made["alpha"].card_id == want and made["alpha"].confidence == 0.6
    assert all(r.reasons == ["LOW_CONFIDENCE"] and r.status == "review" for r in made.values())


def test_text_rules(spark):
    rows = [("aaa",), ("!!!",), ("a!b",), ("Café  ‘x’",), ("12",), ("x?!?!",)]
    t = spark.createDataFrame(rows, "t string")
    garbage = [r[0] for r in t.select(text.is_garbage(F.col("t"))).collect()]
    assert garbage == [True, True, False, False, False, True]
    assert t.select(text.normalize(F.col("t"))).collect()[3][0] == "café 'x'"
    assert t.select(text.tags(F.lit("a b, ,c"))).first()[0] == ["a_b", "c"]
    assert t.select(ids.stable_int(F.lit("deck"))).first()[0] == int.from_bytes(hashlib.sha1(b"deck").digest()[:8]) % (2**31 - 1)


def test_geometry(spark):
    def box(*v):
        return F.struct(*(F.lit(x).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"))))

    one = spark.range(1)
    got = one.select(geom.iou(box(0, 0, 100, 100), box(50, 50, 150, 150)), geom.iou(box(0, 0, 9, 9), box(20, 20, 30, 30)), geom.distance(box(0, 0, 100, 100), box(100, 0, 200, 100))).first()
    assert got[0] == pytest.approx(1 / 7) and got[1] == 0 and got[2] == 100
    pic = box(50, 50, 150, 150)
    below, above, far = one.select(geom.pair_score(pic, box(50, 170, 150, 200)), geom.pair_score(pic, box(50, 10, 150, 40)), geom.pair_score(pic, box(500, 500, 600, 550), 100)).first()
    assert below < above and far is None


def test_feedback_is_idempotent(spark):
    cards = spark.createDataFrame([(str(i), w, "review", True) for i, (w, _, _) in enumerate(SMOKE)], "card_id string, word string, status string, needs_review boolean")
    said = spark.createDataFrame([(0, "0", "edit", "ALPHA"), (1, "1", "approve", None), (2, "3", "reject", None), (3, "3", "approve", None), (4, "9", "approve", None)], "ord int, card_id string, action string, edited_text string")
    once = review.apply_card_feedback(cards, said)
    twice = review.apply_card_feedback(once, said)
    want = {("0", "ALPHA", "active"), ("1", "beta", "active"), ("2", "gamma", "review"), ("3", "delta", "rejected"), ("4", "epsilon", "review")}
    assert {(r.card_id, r.word, r.status) for r in once.collect()} == want == {(r.card_id, r.word, r.status) for r in twice.collect()}


def test_blank_scores():
    white = np.full((100, 100), 255, np.float32)
    noise = np.random.default_rng(1).integers(0, 256, (100, 100)).astype(np.float32)
    assert pixels.blank_score(white)[0] >= 0.7 and pixels.blank_score(noise)[0] <= 0.7
    mask = np.zeros((20, 20), bool)
    mask[2:5, 3:9] = mask[10:18, 10:12] = True
    assert sorted(pixels.components(mask)) == [(3, 2, 9, 5, 18), (10, 10, 12, 18, 16)]


def test_images_round_trip(spark, tmp_path):
    rgb = np.zeros((30, 40, 3), np.uint8)
    rgb[5:20, 5:30] = (250, 10, 10)
    (tmp_path / "a.png").write_bytes(sinks.png(rgb))
    (tmp_path / "b.png").write_bytes(b"no image")
    found = sources.read_images(spark, str(tmp_path))
    assert [r.file for r in found.select("file").collect()] == ["a.png"]
    scored = pixels.crop_scores(found.select(F.col("file").alias("key"), "image", F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(40).alias("x1"), F.lit(30).alias("y1"))).first()
    assert scored.blank and scored.error is None


def test_feedback_forms(spark, tmp_path):
    items = [{"card_id": "a", "action": "approve"}, {"card_id": "b", "action": "edit", "edited_text": "x"}]
    for name, body in (("list", items), ("object", {"items": items})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
        got = sources.read_feedback(spark, str(tmp_path / f"{name}.json")).select("ord", "card_id", "edited_text").collect()
        assert [tuple(r) for r in got] == [(0, "a", None), (1, "b", "x")]


def test_package_round_trip(spark, tmp_path):
    rows = [("c1", "p", 0, "one & two", "active", "m/a.png"), ("c2", "p", 1, "", "active", "n/a.png"), ("c3", "p", 2, "three", "review", "m/c.png")]
    cards = spark.createDataFrame(rows, "card_id string, page_id string, token_index int, word string, status string, front_image_path string")
    path = str(tmp_path / "deck.apkg")
    assert sinks.export_apkg(cards, path, "deck") == 2
    notes = sources.read_apkg(spark, path).orderBy("note_id").collect()
    assert [n.fields.split("\x1f")[1] for n in notes] == ["<div>one &amp; two</div>", "<div>(no text)</div>"]
    assert sorted(json.loads(notes[0].media).values()) == ["a.png", "c2_a.png"]
    media = spark.createDataFrame([(n,) for n in json.loads(notes[0].media).values()], "name string")
    assert review.missing_media(sources.read_apkg(spark, path), media).count() == 0
    with pytest.raises(ValueError):
        sinks.export_csv(cards.withColumn("front_image_path", F.lit("../x")).withColumn("needs_review", F.lit(False)).withColumn("reasons", F.array().cast("array<string>")), str(tmp_path / "out"))


def test_pair_assembly(spark):
    rows = [("p", 0, 0.1, 0.1, "cat", 5000), ("p", 1, 0.9, 0.2, "", 5000), ("p", 2, 0.55, 0.6, "dog", 100)]
    t = spark.createDataFrame(rows, "page_id string, item_index int, blank_picture double, blank_text double, caption string, item_area int")
    got = {r.item_index: r for r in assembly.grid_pairs(t).collect()}
    assert got[0].reasons == [] and got[0].confidence == 1.0 and not got[0].needs_review
    assert got[1].reasons == ["BLANK_PICTURE", "OCR_EMPTY"] and got[1].confidence == pytest.approx(0.3)
    assert got[2].reasons == ["SMALL_ITEM"] and got[2].confidence == pytest.approx(0.5)


def test_suppression_case(spark):
    rows = [("p", i, c, dict(zip(("x0", "y0", "x1", "y1"), b))) for i, (c, b) in enumerate([(0.9, (0, 0, 100, 100)), (0.8, (10, 10, 110, 110)), (0.7, (200, 200, 300, 300))])]
    boxes = spark.createDataFrame(rows, "page_id string, ord int, confidence double, box struct<x0:int,y0:int,x1:int,y1:int>")
    assert sorted(r.confidence for r in matching.suppress(boxes).collect()) == [0.7, 0.9]
