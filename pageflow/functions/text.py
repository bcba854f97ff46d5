"""Text expressions over token, card and note columns (Column -> Column, no UDF)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Curly quotes and dashes with their ASCII forms (fixed values).
CURLY, STRAIGHT = "‘’“”–—", "''\"\"--"

def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize(text: Column, lower: bool = True) -> Column:
    out = F.translate(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), CURLY, STRAIGHT)
    return F.lower(out) if lower else out


def is_garbage(t: Column) -> Column:
    n = F.length(t)
    special = F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]", ""))
    return ((n > 2) & (F.regexp_replace(t, r"(?s)^(.)\1+$", "").__eq__(""))) | (special / F.greatest(n, F.lit(1)) > 0.5) | t.rlike(r"[^\p{L}\p{N}_\s]{3,}")


def is_numeric(t: Column) -> Column:
    return F.trim(t).rlike(r"^[0-9]+$")


def has_alnum(t: Column) -> Column:
    return t.rlike(r"[\p{L}\p{N}]")


def matches_any(t: Column, patterns: Sequence[str], whole: bool) -> Column:
    """Any pattern, ignoring case, over the whole text or somewhere in it."""
    out = F.lit(False)
    for p in patterns:
        out = out | t.rlike(f"(?iu)^(?:{p})$" if whole else f"(?iu){p}")
    return out


def quality_score(t: Column, confidence: Column) -> Column:
    n = F.length(t)
    by_length = F.when(n.between(3, 15), 0.2).when(n < 3, 0.1).otherwise(0.0)
    letters = F.length(F.regexp_replace(t, r"\P{L}", "")) / F.greatest(n, F.lit(1))
    return F.least(F.lit(1.0), 0.6 * confidence + by_length + 0.2 * letters)


def filename_token(text: Column, most: int = 50) -> Column:
    squeezed = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9_-]+", "_"), "_+", "_")
    cut = F.substring(F.regexp_replace(squeezed, r"^_+|_+$", ""), 1, most)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("token"))


def slug(text: Column, most: int = 50) -> Column:
    tail = F.substring(F.sha1(F.encode(text, "utf-8")), 1, 8)
    return F.concat(F.substring(filename_token(text), 1, most - 9), F.lit("_"), tail)


def tags(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: F.replace(x, F.lit(" "), F.lit("_")))


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def note_front(image: Column) -> Column:
    return F.concat(F.lit('<img src="'), html_escape(image), F.lit('">'))


def note_back(word: Column) -> Column:
    return F.when(F.trim(F.coalesce(word, F.lit(""))) == "", F.lit("<div>(no text)</div>")).otherwise(F.concat(F.lit("<div>"), html_escape(word), F.lit("</div>")))


def media_refs(fields: Column) -> Column:
    """Base names of images and sounds that a note refers to, in any case, unescaped."""
    found = F.concat(F.regexp_extract_all(fields, F.lit(r"(?i)<img[^>]+?src=[\"']([^\"']+)[\"']")), F.regexp_extract_all(fields, F.lit(r"(?i)\[sound:([^\]]+)\]")))
    named = F.transform(found, lambda x: F.element_at(F.split(strip(html_unescape(x)), "/"), -1))
    return F.filter(named, lambda x: x != "")


def join_reasons(reasons: Column) -> Column:
    return F.array_join(F.filter(reasons, lambda r: F.trim(r) != ""), "|")


def error_category(message: Column) -> Column:
    """The first that fits of APKG, SECURITY, LIFECYCLE, DETERMINISM; else CONTRACT."""
    low = F.lower(F.trim(F.coalesce(message, F.lit(""))))
    says = lambda *words: F.greatest(F.lit(False), *(F.contains(low, F.lit(w)) for w in words))
    order = says("determin", "canonical") | (says("token_index") & says("order"))
    return F.when(says("apkg"), "APKG").when(says("unsafe", "path traversal"), "SECURITY").when(says("requires needs_review=true", "segment_failed"), "LIFECYCLE").when(order, "DETERMINISM").otherwise("CONTRACT")


def path_problem(path: Column) -> Column:
    """Why a path is no safe path inside a job; null if it is one."""
    p = strip(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    return F.when(p == "", "empty").when(p.startswith("/") | p.rlike("^[A-Za-z]:"), "absolute").when(F.array_contains(F.split(p, "/"), ".."), "parent")


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&"))


def html_unescape(text: Column) -> Column:
    """The entities that html_escape() makes, and the decimal quote."""
    for a, b in _ENTITIES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def token_index_in(path: Column) -> Column:
    """The number in ``token_0012_``; a billion where there is none."""
    return F.coalesce(F.regexp_extract(path, r"token_(\d{4})_", 1).try_cast("int"), F.lit(1_000_000_000))


def picture_path(path: Column, job_dir: str) -> Column:
    """A picture's path relative to its job: the job's own folder is taken off."""
    p, root = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), job_dir.rstrip("/") + "/"
    return F.when(p.startswith(root), F.substr(p, F.lit(len(root) + 1))).otherwise(p)


def page_number(page_id: Column) -> Column:
    return F.coalesce(F.try_to_number(F.regexp_extract(page_id, r"_([0-9]+)$", 1), F.lit("999999999")).cast("int"), F.lit(1_000_000_000))


def badge(confidence: Column) -> Column:
    return F.when(confidence * 100 >= 80, "ok").when(confidence * 100 >= 50, "mid").otherwise("review")


def source_ref(source: Column, page: Column) -> Column:
    return F.when(F.coalesce(source, F.lit("")) != "", F.concat_ws("#", source, page)).otherwise(page)


def ocr_languages(text: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in (("de", "deu"), ("en", "eng"), ("fr", "fra"), ("es", "spa"), ("it", "ita")) for x in pair))
    return F.array_join(F.transform(F.split(text, ","), lambda x: F.coalesce(known[F.trim(x)], F.trim(x))), "+")
