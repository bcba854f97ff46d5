import pytest

import __spark_entry__
from compare import same
from pageflow.plans import queries as plans


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, sf, name):
    same(plans.queries()[name](spark, sf), plans.oracle_sql()[name], sf)


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(5).count() == 5


def test_entry_keeps_the_seventh_token(spark):
    found = __spark_entry__.entry(spark).agg({"cleaned_words": "max"}).first()[0]
    assert found == 9


def test_tokens_beyond_the_cap_are_dropped(spark, sf):
    from pageflow.operators import pages
    from pageflow.plans import adapters

    tokens = adapters.tokens(spark, sf)
    free, capped = (pages.clean_tokens(tokens, pages.CleanOptions(**{**vars(pages.CONFIGURED), "dedupe": False, "max_tokens": n})) for n in (200, 3))
    ranked = {}
    for r in sorted((r.page_id, r.ord) for r in free.collect()):
        ranked.setdefault(r[0], []).append(r[1])
    assert {(r.page_id, r.ord) for r in capped.collect()} == {(p, o) for p, found in ranked.items() for o in found[:3]}
    assert max(map(len, ranked.values())) > 3


def _boxes(spark, sf):
    from pageflow.plans import adapters

    pages = {}
    for r in adapters.tokens(spark, sf).collect():
        pages.setdefault(r.page_id, []).append((r.ord, r.confidence, tuple(r.box)))
    return pages


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def _center(b):
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def test_nms_by_hand(spark, sf):
    want = set()
    for page, items in _boxes(spark, sf).items():
        kept = []
        for o, c, b in sorted(items, key=lambda x: (-x[1], x[0])):
            if all(_iou(k, b) <= 0.3 for k in kept):
                kept.append(b)
                want.add((page, o))
    assert {(r.page_id, r.ord) for r in plans.nms_fold(spark, sf).collect()} == want


def test_greedy_by_hand(spark, sf):
    def weighted(p, t):
        (px, py), (tx, ty) = _center(p), _center(t)
        d = ((px - tx) ** 2 + (py - ty) ** 2) ** 0.5 * (0.8 if ty > py else 1)
        return d if d < 600 else None

    want = set()
    for page, items in _boxes(spark, sf).items():
        texts, used = sorted(x for x in items if x[0] % 2 == 0), set()
        for o, _, b in sorted(x for x in items if x[0] % 2):
            scores = [(s, t[0]) for t in texts if t[0] not in used and (s := weighted(b, t[2])) is not None]
            best = min(scores)[1] if scores else None
            used.add(best)
            want.add((page, o, best))
    assert {tuple(r) for r in plans.greedy_pair_weighted(spark, sf).collect()} == want


def test_reading_order_by_hand(spark, sf):
    want = set()
    for page, items in _boxes(spark, sf).items():
        row, anchor, out = -1, None, []
        for y, o, x in sorted((_center(b)[1], o, _center(b)[0]) for o, _, b in items):
            if anchor is None or y - anchor > 0.05 * plans.HEIGHT:
                row, anchor = row + 1, y
            out.append((row, x, y, o))
        want |= {(page, i, o, r) for i, (r, _, _, o) in enumerate(sorted(out))}
    assert {tuple(r) for r in plans.reading_order_rows(spark, sf).collect()} == want
