"""Human review: lifecycle folds in closed form, learned values, exports and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text

def last_cards(cards: DataFrame) -> DataFrame:
    """One row a card_id: the last (by ``ord``, where cards have one), with a status."""
    if "ord" in cards.columns:
        w = Window.partitionBy("card_id").orderBy(F.desc("ord"))
        cards = cards.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    else:
        cards = cards.dropDuplicates(["card_id"])
    return cards.withColumn("status", F.coalesce("status", F.when(F.col("needs_review"), "review").otherwise("active")))


def judged(cards: DataFrame, feedback: DataFrame) -> DataFrame:
    """Known feedback rows, with whether they are live (before a reject of a card that is
    not rejected), valid, effective (they change the card) or the reject that counts.

    The word that an edit is compared with is the last valid edit's before it: one
    that changed nothing left the same word."""
    state = cards.select("card_id", "word", F.col("status").alias("_status"), F.col("needs_review").alias("_review"))
    f = feedback.withColumn("action", F.lower("action")).filter(F.col("action").isin("approve", "reject", "edit")).join(state, "card_id")
    by_card = Window.partitionBy("card_id")
    f = f.withColumn("rejected_at", F.min(F.when(F.col("action") == "reject", F.col("ord"))).over(by_card))
    said = text.strip(F.coalesce("edited_text", F.lit("")))
    open_ = F.col("_status") != "rejected"
    live = open_ & F.coalesce(F.col("ord") < F.col("rejected_at"), F.lit(True))
    valid = live & ((F.col("action") == "approve") | ((F.col("action") == "edit") & (said != "")))
    f = f.withColumn("live", live).withColumn("valid", valid).withColumn("said", F.when((F.col("action") == "edit") & valid, said))
    before = by_card.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.col("valid").cast("int")).over(before), F.lit(0)) == 1
    clean = seen | ((F.col("_status") == "active") & ~F.col("_review"))
    current = F.coalesce(F.last("said", ignorenulls=True).over(before), text.strip(F.col("word")))
    changed = (F.col("action") == "edit") & (F.col("said") != current)
    return f.withColumn("effective", F.col("valid") & F.coalesce(~clean | changed, F.lit(False))).withColumn("rejects", open_ & (F.col("action") == "reject") & (F.col("ord") == F.col("rejected_at")))


def apply_card_feedback(cards: DataFrame, feedback: DataFrame, now: str | None = None) -> DataFrame:
    """Cards (card_id, word, status, needs_review, reasons, ..) after ordered feedback
    (ord, card_id, action, edited_text), with all their columns: a reject is final and ends
    the review; before it an effective approve or edit activates, ends the review and clears
    the reasons, and the last effective edit gives the word.  ``updated_at``, where cards have
    it, becomes ``now`` for those that change."""
    cards = last_cards(cards)
    done = judged(cards, feedback).filter("effective or rejects").groupBy("card_id").agg(
        F.max_by("said", F.when(F.col("effective") & (F.col("action") == "edit"), F.col("ord"))).alias("_said"),
        F.max(F.col("effective") & (F.col("action") == "edit")).alias("_edited"), F.max("effective").alias("_approved"), F.max("rejects").alias("_rejected"))
    t = cards.join(done, "card_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    changed = yes("_approved") | yes("_rejected")
    new = {
        "word": F.when(yes("_edited"), F.col("_said")).otherwise(F.col("word")),
        "status": F.when(yes("_rejected"), "rejected").when(yes("_approved"), "active").otherwise(F.col("status")),
        "needs_review": F.when(changed, False).otherwise(F.col("needs_review")),
    }
    if "reasons" in cards.columns:
        new["reasons"] = F.when(yes("_approved"), F.array().cast("array<string>")).otherwise(F.col("reasons"))
    if "updated_at" in cards.columns and now is not None:
        new["updated_at"] = F.when(changed, F.lit(now)).otherwise(F.col("updated_at"))
    return t.select(*(new[c].alias(c) if c in new else F.col(c) for c in cards.columns))


def apply_pair_feedback(pairs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Pairs (pair_id, caption, status, reasons[, needs_review]) after feedback: the last known
    action wins, even over a reject; a caption comes from the last edit that has one."""
    known = feedback.withColumn("action", F.lower("action")).filter(F.col("action").isin("approve", "reject", "edit"))
    captioned = (F.col("action") == "edit") & F.col("edited_caption").isNotNull()
    said = known.groupBy("pair_id").agg(F.max_by("action", "ord").alias("_action"), F.max_by("edited_caption", F.when(captioned, F.col("ord"))).alias("_edited"), F.max(captioned).alias("_has_edit"))
    t = pairs.join(said, "pair_id", "left")
    edited = F.coalesce("_has_edit", F.lit(False))
    new = {
        "caption": F.when(edited, F.col("_edited")).otherwise(F.col("caption")),
        "status": F.when(F.col("_action") == "reject", "rejected").when(F.col("_action").isNotNull(), "active").otherwise(F.col("status")),
        "reasons": F.when(edited, F.array_remove("reasons", "OCR_EMPTY")).otherwise(F.col("reasons")),
    }
    if "needs_review" in pairs.columns:
        new["needs_review"] = F.when(F.col("_action").isNotNull(), False).otherwise(F.col("needs_review"))
    return t.select(*(new[c].alias(c) if c in new else F.col(c) for c in pairs.columns))


def pair_feedback_stats(pairs: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: rows of known pairs, whatever they say, and approvals, rejects and edits of them."""
    f = feedback.withColumn("action", F.lower("action")).join(pairs.select("pair_id").distinct(), "pair_id", "left_semi")
    return f.agg(F.count(F.lit(1)).alias("processed"), *(F.count_if(F.col("action") == a).alias(n) for a, n in (("approve", "approved"), ("reject", "rejected"), ("edit", "edited"))))


#: Directions in which a picture's text may be looked for (fixed values).
DIRECTIONS = ("below", "above", "right", "left", "nearest")


def rule_captions(feedback: DataFrame) -> DataFrame:
    """Captions that rule feedback (ord, pair_id, corrected_caption, edited_caption) teaches: the last of each pair."""
    said = F.coalesce(F.nullif("corrected_caption", F.lit("")), F.nullif("edited_caption", F.lit("")))
    f = feedback.withColumn("caption", said).filter((F.coalesce("pair_id", F.lit("")) != "") & F.col("caption").isNotNull())
    return f.groupBy("pair_id").agg(F.max_by("caption", "ord").alias("caption"))


def rule_stats(feedback: DataFrame) -> DataFrame:
    """One row: items, direction changes and caption corrections of rule feedback."""
    said = F.coalesce(F.nullif("corrected_caption", F.lit("")), F.nullif("edited_caption", F.lit("")))
    return feedback.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("preferred_search_direction").isin(*DIRECTIONS)).alias("direction_changes"), F.count_if((F.coalesce("pair_id", F.lit("")) != "") & said.isNotNull()).alias("caption_corrections"))


def rule_votes(old: DataFrame, feedback: DataFrame) -> DataFrame:
    """Votes by direction (direction, votes, first_ord): the old ones, first inserted first, and the new ones'."""
    new = feedback.select("ord", F.col("preferred_search_direction").alias("direction")).filter(F.col("direction").isin(*DIRECTIONS))
    new = new.groupBy("direction").agg(F.count(F.lit(1)).alias("votes"), F.min("ord").alias("first_ord"))
    both = old.select("direction", "votes", "first_ord", F.lit(0).alias("era")).unionByName(new.withColumn("era", F.lit(1)))
    return both.groupBy("direction").agg(F.sum("votes").alias("votes"), F.min(F.struct("era", "first_ord")).alias("place"))


def blank_threshold(old: float | None, delta: float = 0.0) -> float:
    """The learned limit of the blank score, moved by ``delta`` within its bounds."""
    return max(0.3, min(0.95, (0.7 if old is None else old) + delta))


def learned_regions(old: DataFrame, feedback: DataFrame) -> DataFrame:
    """Learned text share and place (page_id, text_ratio, text_position) after edits (ord,
    page_id, action, corrected_text_ratio, corrected_text_position): the last of each wins."""
    f = feedback.filter(F.lower("action") == "edit")
    place = F.nullif("corrected_text_position", F.lit(""))
    new = f.groupBy("page_id").agg(F.max_by("corrected_text_ratio", F.when(F.col("corrected_text_ratio").isNotNull(), F.col("ord"))).alias("_ratio"), F.max_by(place, F.when(place.isNotNull(), F.col("ord"))).alias("_place"))
    t = old.join(new, "page_id", "full").select("page_id", F.coalesce("_ratio", "text_ratio").alias("text_ratio"), F.coalesce("_place", "text_position").alias("text_position"))
    return t.filter("text_ratio is not null or text_position is not null")


def last_actions(actions: DataFrame) -> DataFrame:
    """Actions (ord, card_id, action, edited_text) of a review page: the last of a card, at the place of its first."""
    last = actions.groupBy("card_id").agg(F.max_by(F.struct("action", "edited_text"), "ord").alias("a"), F.min("ord").alias("place"))
    return last.select("card_id", "a.action", "a.edited_text", "place")


def direction_vote(votes: DataFrame) -> DataFrame:
    """The most voted direction (ord, direction), the first seen on ties."""
    counts = votes.groupBy("direction").agg(F.count(F.lit(1)).alias("votes"), F.min("ord").alias("first_ord"))
    return counts.orderBy(F.desc("votes"), "first_ord").limit(1).select("direction", "votes")


def upsert(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Learned values: the last new one by ord, else the old one."""
    last = new.groupBy(key).agg(F.max_by(value, "ord").alias("_new"))
    return old.join(last, key, "full").select(key, F.coalesce("_new", value).alias(value))


def csv_rows(cards: DataFrame, include_review: bool = False) -> DataFrame:
    """Rows of the CSV export, with their place in export order."""
    keep = F.col("status") != "rejected"
    keep = keep if include_review else keep & ~F.col("needs_review")
    page, index = F.coalesce("page_id", F.lit("")), F.coalesce("token_index", F.lit(0))
    return cards.filter(keep).select(F.col("word").alias("front_text"), F.lit("").alias("back_text"), F.coalesce("front_image_path", F.lit("")).alias("front_image_path"), F.coalesce("source_ref", F.lit("")).alias("source_ref"), "card_id", page.alias("page"), index.alias("idx"), text.join_reasons(F.col("reasons")).alias("review_reason"))


def media_names(refs: DataFrame) -> DataFrame:
    """Media names (path, card_id, ord): the first path of a base name keeps it,
    others get the card's id before it."""
    base = F.element_at(F.split("path", "/"), -1)
    first = refs.withColumn("base", base).groupBy("base", "path").agg(F.min(F.struct("ord", "card_id")).alias("f"))
    w = Window.partitionBy("base").orderBy("f.ord")
    return first.withColumn("n", F.row_number().over(w)).select("path", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("_", F.col("f.card_id"), "base")).alias("name"))


def missing_media(notes: DataFrame, media: DataFrame) -> DataFrame:
    """Media that notes (note_id, fields) refer to and the mapping (name) lacks."""
    used = notes.select(F.explode(text.media_refs(F.col("fields"))).alias("name")).distinct()
    return used.join(media.select("name"), "name", "left_anti")


#: Card methods that the validator knows (fixed values).
METHODS = ("bbox_crop", "page_fallback", "segmenter", "bbox_fallback", "page")


def card_violations(cards: DataFrame) -> DataFrame:
    """(card_id, rule) for each rule that a card breaks."""
    fallback = F.col("method").isin("page_fallback", "bbox_fallback")
    rules = {
        "card_id": ~F.coalesce(F.col("card_id").rlike("^[0-9a-fA-F]{40}$"), F.lit(False)),
        "page_id": F.coalesce(F.trim("page_id"), F.lit("")) == "",
        "token_index": F.col("token_index").isNull() | (F.col("token_index") < 0),
        "method": ~F.coalesce(F.col("method").isin(*METHODS), F.lit(False)),
        "fallback_review": fallback & ~F.col("needs_review"),
        "path": text.path_problem(F.col("front_image_path")).isNotNull(),
    }
    broken = F.array_compact(F.array(*(F.when(test, name) for name, test in rules.items())))
    return cards.select("card_id", F.explode(broken).alias("rule"))


def training_records(cards: DataFrame, feedback: DataFrame) -> DataFrame:
    """One record for each valid feedback row, with the card as it was before."""
    valid = feedback.withColumn("action", F.lower("action")).filter(F.col("action").isin("approve", "reject", "edit"))
    state = {"word": "predicted_text", "page_id": "page_id", "front_image_path": "page_image_path", "box": "predicted_box", "confidence": "predicted_confidence", "reasons": "failure_reasons", "layout_type": "layout_type", "method": "method", "source_ref": "source_ref"}
    known = cards.select("card_id", *(F.col(c).alias(n) for c, n in state.items() if c in cards.columns))
    own = [n for c, n in state.items() if c in cards.columns]
    given = [c for c in ("corrected_box", "created_at") if c in feedback.columns]
    t = valid.join(known, "card_id").select("card_id", "ord", "action", *own, *given, F.when(F.col("action") == "edit", F.col("edited_text")).alias("corrected_text"))
    return t.withColumn("record_id", ids.record_id(F.col("card_id"), F.col("action"), F.col("created_at"))) if "created_at" in given else t


def learning_stats(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("records"), *(F.count_if(F.col("action") == a).alias(f"{a}s") for a in ("approve", "reject", "edit")), F.count_if(F.col("corrected_text") != F.col("predicted_text")).alias("text_corrections"))
