import json

from pageflow.sources import scan


def lines():
    """Made in a function, so that workers get it by value."""

    class Lines:
        """A stand-in renderer: a document's lines are its pages."""

        def count(self, content):
            return len(content.decode().splitlines())

        def pages(self, content, dpi):
            return [(f"page_{n:03d}", f"{line}@{dpi}".encode()) for n, line in enumerate(content.decode().splitlines(), 1)]

    return Lines


def test_pages_of_a_mixed_folder(spark, tmp_path):
    folder = tmp_path / "scan"
    folder.mkdir()
    for name, body in {"b.png": b"B", "a.JPG": b"A", "x.pdf": b"one\ntwo", "w.pdf": b"\xff", "y.pdf": b"three", "note.txt": b"no"}.items():
        (folder / name).write_bytes(body)
    rows = scan.read_pages(spark, str(folder), lines(), 72).collect()
    good = [(r.page_index, r.page_id, r.source_ref, bytes(r.content)) for r in rows if r.error is None]
    assert sorted(good) == [(0, "page_001", "scan/a.JPG", b"A"), (1, "page_002", "scan/b.png", b"B"), (2, "page_003", "scan/x.pdf#page_001", b"one@72"), (3, "page_004", "scan/x.pdf#page_002", b"two@72"), (4, "page_005", "scan/y.pdf#page_001", b"three@72")]
    assert [(r.page_id, r.source_ref) for r in rows if r.error] == [(None, "scan/w.pdf")]
    assert scan.read_pages(spark, str(folder)).count() == 2


def test_stored_tokens(spark, tmp_path):
    page = lambda word: json.dumps({"page_id": "p", "tokens": [{"text": word, "confidence": 0.5, "bbox_xyxy": [1, 2, 3, 4]}]})
    files = {"p0.cleaned.json": page("named"), "page_000.cleaned.json": page("numbered"), "p1_clean.json": '{"other": 1}', "page_1.cleaned.json": page("plain"), "page_002.cleaned.json": "{broken"}
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    pages = spark.createDataFrame([(f"p{i}", i) for i in range(4)], "page_id string, page_index int")
    tokens, errors = scan.stored_tokens(spark, pages, str(tmp_path))
    assert sorted((r.page_id, r.text, r.box.x1) for r in tokens.collect()) == [("p0", "named", 3), ("p1", "plain", 3)]
    assert sorted((r.page_id, r.message) for r in errors.collect()) == [("p2", "failed_to_parse: page_002.cleaned.json"), ("p3", "mocked_clean_missing")]
