import random

from pyspark.sql import functions as F

from pageflow.operators import jobs, review

CARDS = "card_id string, page_id string, token_index int, word string, status string, needs_review boolean"
SAID = "ord long, card_id string, action string, edited_text string"


def simulate(cards, feedback):
    """Feedback applied row by row: (applied, unknown, already applied, resolved cards)."""
    state = {c[0]: [c[3], c[4], c[5]] for c in cards}
    applied = unknown = already = 0
    resolved, cleared = set(), set()
    for _, card, action, said in sorted(feedback):
        if card not in state:
            unknown += 1
            continue
        action = action.lower()
        if action not in ("approve", "reject", "edit"):
            continue
        word, status, review = state[card]
        said = (said or "").strip()
        if status == "rejected":
            already += 1
        elif action == "reject":
            state[card], applied = [word, "rejected", False], applied + 1
        elif action == "edit" and not said:
            already += 1
            continue
        elif status == "active" and not review and (action == "approve" or said == word):
            already += 1
        else:
            state[card], applied = [said if action == "edit" else word, "active", False], applied + 1
            cleared.add(card)
        resolved.add(card)
    return applied, unknown, already, resolved, state, cleared


def test_feedback_row_by_row(spark):
    rng = random.Random(3)
    cards = [(f"c{i}", "p", i, f"w{i % 3}", rng.choice(["active", "review", "rejected"]), rng.random() < 0.5) for i in range(60)]
    said = [(i, f"c{rng.randrange(70)}", rng.choice(["approve", "Edit", "edit", "EDIT", "Reject", "view"]), rng.choice([None, " ", "w0", "w1", " w2 "])) for i in range(400)]
    c, f = spark.createDataFrame(cards, CARDS), spark.createDataFrame(said, SAID)
    applied, unknown, already, resolved, state, cleared = simulate(cards, said)
    got = jobs.feedback_counters(c, f).first()
    assert (got.feedback_items, got.applied, got.skipped_unknown_card, got.skipped_already_applied) == (400, applied, unknown, already)
    after = review.apply_card_feedback(c.withColumn("reasons", F.array(F.lit("WHY"))), f)
    assert {r.card_id: [r.word, r.status, r.needs_review] for r in after.collect()} == state
    assert {r.card_id for r in after.filter("size(reasons) = 0").collect()} == cleared
    assert {r.card_id for r in jobs.open_queue(c, c, f).collect()} == {x[0] for x in cards} - resolved


def test_metrics_rules(spark):
    schema = "finished boolean, completed_at string, pages_processed int, pages_total int"
    rules = lambda *row: {r.rule for r in jobs.metrics_violations(spark.createDataFrame([row], schema)).collect()}
    assert rules(True, "2026-01-01T00:00:00+00:00", 2, 2) == set()
    assert rules(None, None, 3, 2) == {"finished", "completed_at", "pages"}


def test_lone_signs_are_gated(spark):
    t = spark.createDataFrame([("a", 0.9), ("-", 0.9), ("ab", 0.1), ("ab", 0.9)], "text string, confidence double").withColumn("box", F.struct(*(F.lit(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (0, 0, 20, 20)))))
    assert sorted(r.text for r in jobs.text_gate(t, "easyocr").collect()) == ["a", "ab"]


def test_the_last_of_equal_cards_counts(spark):
    cards = spark.createDataFrame([("a", "old", "review", True, 0), ("a", "new", "review", True, 1)], "card_id string, word string, status string, needs_review boolean, ord int")
    said = spark.createDataFrame([(0, "a", "APPROVE", None)], SAID)
    assert [(r.word, r.status) for r in review.apply_card_feedback(cards, said).collect()] == [("new", "active")]


def test_paths_are_trimmed_before_they_are_judged(spark):
    from pageflow.functions import text

    rows = [(p,) for p in (" /etc/x", "\t../x", "  ", "a/b.png ", "C:\\x", "a/../b", "\n\\\\host")]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").select(text.path_problem(F.col("p"))).collect()]
    assert got == ["absolute", "parent", "empty", None, "absolute", "parent", "absolute"]
