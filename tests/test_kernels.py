import json

import numpy as np
from pyspark.sql import functions as F

from pageflow import cli, sinks, sources
from pageflow.operators import kernels


def page():
    g = np.full((200, 300), 240.0)
    g[40:100, 50:130] = 20
    g[120:180, 200:270] = 20
    return g


def test_edges_lie_on_the_border():
    e = kernels.edges(page())
    ys, xs = np.nonzero(e)
    assert e.any() and not e[60:80, 70:110].any() and not e[:30].any()
    assert abs(ys.min() - 40) <= 2 and abs(xs.min() - 50) <= 2


def test_edge_regions_find_both_blocks():
    found = [b for b in kernels.edge_regions(page()) if b[4] > 100]
    for want, got in zip([(50, 40, 130, 100), (200, 120, 270, 180)], found, strict=True):
        assert max(abs(a - b) for a, b in zip(want, got)) <= 8


def test_close_and_dilate():
    m = np.zeros((9, 9), bool)
    m[4, 2] = m[4, 5] = True
    assert kernels.dilate(m).sum() == 18
    assert kernels.close(m, 5)[4, 2:6].all() and not kernels.close(m, 5)[0].any()


def test_ink_box():
    assert kernels.ink_box(page()[:110]) == (50, 40, 130, 100)
    assert kernels.ink_box(np.zeros((0, 0))) is None
    assert kernels.ink_box(page()[40:60, 50:70]) is None


def test_drawn_boxes_stay_on_the_page():
    out = kernels.draw_boxes(np.zeros((20, 20, 3), np.uint8), [(-5, 2, 30, 10)], [(255, 0, 0)])
    assert out[2, 0, 0] == 255 and out[9, 10, 0] == 255 and out[5, 10, 0] == 0


def test_page_regions(spark):
    pixels = np.repeat(page().astype(np.uint8)[..., None], 3, 2).tobytes()
    image = "page_id string, image struct<data:binary,height:int,width:int,nChannels:int>"
    rows = kernels.page_regions(spark.createDataFrame([("a", (pixels, 200, 300, 3)), ("b", (b"xx", 200, 300, 3))], image)).collect()
    assert sum(r.page_id == "a" and r.area > 100 for r in rows) == 2
    assert [r.error is not None for r in rows if r.page_id == "b"] == [True]


def test_pair_commands(spark, tmp_path):
    pairs = {"schema_version": "2.0-sam", "pages": [{"page_id": "p1", "pairs": [{"pair_id": "x", "order_index": 0, "caption_text": "a</script>", "needs_review": True, "reasons": ["OCR_EMPTY"], "confidence": 0.9}, {"pair_id": "y", "order_index": 1, "caption_text": "", "reasons": [], "confidence": 0.1}]}]}
    (tmp_path / "pairs.json").write_text(json.dumps(pairs))
    (tmp_path / "said.json").write_text(json.dumps({"items": [{"pair_id": "x", "action": "edit", "edited_caption": "b"}, {"pair_id": "y", "action": "reject"}]}))
    source, done = str(tmp_path / "pairs.json"), str(tmp_path / "done")
    assert cli.main(["apply-pair-feedback", "--pairs", source, "--feedback", str(tmp_path / "said.json"), "--out", done]) == 0
    assert sorted((r.pair_id, r.caption_text, r.status) for r in sources.read_pairs(spark, done).collect()) == [("x", "b", "active"), ("y", "", "rejected")]
    assert cli.main(["build-flashcards", "--pairs", done, "--out", str(tmp_path / "cards")]) == 0
    assert sorted(r.direction for r in spark.read.json(str(tmp_path / "cards")).collect()) == ["forward", "reverse"]
    assert cli.main(["generate-review-html", "--pairs", source, "--out", str(tmp_path / "r.html")]) == 0
    written = (tmp_path / "r.html").read_text()
    assert written.count("</script>") == 1 and '"pair_id": "x"' in written


def test_data_url(spark):
    rows = spark.createDataFrame([("a.JPG", b"abc"), ("b", None)], "path string, content binary").select(sinks.data_url(F.col("path"), F.col("content")).alias("u")).collect()
    assert [r.u for r in rows] == ["data:image/jpeg;base64,YWJj", ""]
