import json
import sqlite3
import zipfile

import numpy as np
from pyspark.sql import functions as F

from pageflow import cli, plugins, sinks
from pageflow.functions import text

TOKENS = [{"text": w, "confidence": 0.95, "bbox_xyxy": b} for w, b in (("alpha", [10, 10, 80, 50]), ("beta", [90, 10, 170, 50]), ("gamma", [180, 10, 235, 50]))]


def test_job_to_export(spark, tmp_path):
    (tmp_path / "ocr").mkdir()
    (tmp_path / "ocr/p.json").write_text(json.dumps({"page_id": "page_001", "raw_count": 3, "tokens": TOKENS}))
    job, out = str(tmp_path / "job"), str(tmp_path / "done")
    assert cli.main(["run", "--tokens", str(tmp_path / "ocr/p.json"), "--job-dir", job, "--width", "240", "--height", "120"]) == 0
    cards = {r.word: r.card_id for r in spark.read.json(f"{job}/result").collect()}
    assert set(cards) == {"alpha", "beta", "gamma"}
    (tmp_path / "fb.json").write_text(json.dumps([{"card_id": cards["beta"], "action": "reject"}, {"card_id": cards["alpha"], "action": "edit", "edited_text": "ALPHA"}]))
    assert cli.main(["apply-review", "--job-dir", job, "--feedback", str(tmp_path / "fb.json"), "--out", out]) == 0
    assert {(r.word, r.status) for r in spark.read.json(f"{out}/result").collect()} == {("ALPHA", "active"), ("beta", "rejected"), ("gamma", "active")}
    after = {r.word: r for r in spark.read.json(f"{out}/result").collect()}
    assert not after["beta"].needs_review and not after["ALPHA"].needs_review and not after["ALPHA"].reasons
    assert spark.read.json(f"{out}/metrics").first().finished
    assert spark.read.schema("card_id string").json(f"{out}/review_queue").filter(f"card_id in ('{cards['beta']}', '{cards['alpha']}')").count() == 0
    assert cli.main(["validate", "--job-dir", out]) == 0
    assert cli.main(["export", "--job-dir", out, "--format", "csv", "--out", str(tmp_path / "csv")]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert cli.main(["review-ui", "--job-dir", job, "--out", str(tmp_path / "ui.html")]) == 0


def test_ocr_fails_softly(spark):
    class Engine:
        def tokens(self, content):
            if content == b"bad":
                raise ValueError("unreadable")
            return [("word", 0.9, (0, 0, 5, 5))]

    got = plugins.run_ocr(spark.createDataFrame([("a", b"ok"), ("b", b"bad")], "page_id string, content binary"), Engine).orderBy("page_id").collect()
    assert [(r.page_id, r.text, r.error) for r in got] == [("a", "word", None), ("b", None, "unreadable")]


def test_feedback_stream(spark, tmp_path):
    from pageflow.streaming import feedback_rates, feedback_stream

    (tmp_path / "in").mkdir()
    rows = [{"card_id": "a", "ord": k, "action": "approve", "at": f"2024-01-01T00:0{k}:00Z"} for k in range(3)]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    q = feedback_rates(feedback_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert [r.n for r in spark.table("rates").collect()] == [3]


def test_job_with_images_is_checked(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/page_001.png").write_bytes(sinks.png(np.full((120, 240, 3), 90, np.uint8)))
    (tmp_path / "p.json").write_text(json.dumps({"page_id": "page_001", "raw_count": 3, "tokens": TOKENS}))
    job = str(tmp_path / "job")
    assert cli.main(["run", "--tokens", str(tmp_path / "p.json"), "--job-dir", job, "--width", "240", "--height", "120", "--images", str(tmp_path / "in")]) == 0
    assert len(list((tmp_path / "job/pages/crops").glob("*.png"))) == 3
    assert cli.main(["export", "--job-dir", job, "--format", "apkg", "--out", str(tmp_path / "d.apkg")]) in (0, None)
    capsys.readouterr()
    assert cli.main(["validate", "--job-dir", job, "--files"]) == 0 and "missing_images=0" in capsys.readouterr().out
    next((tmp_path / "job/pages/crops").glob("*.png")).unlink()
    (tmp_path / "bad.apkg").write_bytes(b"no archive")
    assert cli.main(["validate", "--job-dir", job, "--files", "--apkg", str(tmp_path / "bad.apkg")]) == 1
    said = capsys.readouterr().out
    assert "missing_images=1" in said and "apkg=1" in said and "APKG" in said


def test_media_references(spark):
    rows = spark.createDataFrame([("<IMG src='a/b&amp;c.png'> [SOUND: x.mp3 ]<img src=\"  \">",)], "fields string")
    assert rows.select(text.media_refs(F.col("fields")).alias("m")).first().m == ["b&c.png", "x.mp3"]


def test_package_has_tags_and_a_name(spark, tmp_path):
    rows = [("b", "p2", 0, "two", "src 2", "active", "a.png"), ("a", "p1", 0, "one", " ", "active", "a.png"), ("c", "p3", 0, "no", "src 3", "review", "a.png")]
    cards = spark.createDataFrame(rows, "card_id string, page_id string, token_index int, word string, source_ref string, status string, front_image_path string")
    assert sinks.deck_name(cards, "job") == "src 2" and sinks.deck_name(cards.filter("card_id = 'a'"), "job") == "job"
    assert sinks.export_apkg(cards, str(tmp_path / "d.apkg"), "deck", {"a.png": b"x"}, "school, year one,") == 2
    with zipfile.ZipFile(tmp_path / "d.apkg") as z:
        z.extract("collection.anki2", tmp_path)
    with sqlite3.connect(tmp_path / "collection.anki2") as db:
        assert db.execute("SELECT DISTINCT tags FROM notes").fetchall() == [(" school year_one ",)]
