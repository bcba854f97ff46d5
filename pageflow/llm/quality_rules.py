"""Quality rules: base counts, and divergence from language references.

A text's histogram of character classes and its histogram of common words are
compared, by Jensen-Shannon distance, with references of each language.  The
references are gathered over all documents that pass the base rules, by their
``lang``: every document weighs the same, so that long or hot ones don't sway
them.  A text is rejected if it is far from every reference by either histogram;
a histogram of too few characters or words is not judged, nor is a text whose
own language has too few documents for a reference: others' would reject it for
its language.

Defined results: null or empty texts have no words and fail the base rules; a
null ``lang`` gives a reference of its own; repeated rows count each; no rows
give no references, and without references nothing but the base rules rejects.
Other columns are passed by.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S

#: Common words by language (fixed values).
COMMON = {
    "de": "der die das und in zu den von mit sich nicht ist auf für ein eine im dem es als auch an werden aus er hat dass sie nach wird bei",
    "en": "the of and to in a is that it for was on are as with be by at this have from or an had not but what all were when we",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son d'une aux",
}
#: Character classes (fixed values), tried in this order; all else is "other".
CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "symbol", "other")
_STOP, _MARK, _SYMBOL = ".,;:", "!?'\"()-¿¡«»", "#*$%&|<>~^_=+/\\@{}[]`"
N_CLASSES = len(CLASSES)
#: Words of common histograms, then one place for all other words.
_WORDS = sorted({w for ws in COMMON.values() for w in ws.split()})
_PLACE = {w.encode(): i for i, w in enumerate(_WORDS)}
N_WORDS = len(_WORDS) + 1
_TRIM = b".,;:!?\"'()"
#: The least characters and words judged.
LEAST_CHARS, LEAST_WORDS = 200, 50
#: The largest distances kept: base + slack / sqrt(n_words), as a histogram's
#: sampling noise falls with the root of its size.
CLASS_LIMIT, WORD_LIMIT = (0.15, 1.2), (0.17, 2.2)
LIMITS = (CLASS_LIMIT, WORD_LIMIT, LEAST_CHARS, LEAST_WORDS)
#: Documents that a language's reference needs.
LEAST_DOCS = 10


def _class_table() -> np.ndarray:
    """The class of every code point below 0x250; beyond it is decided by case."""
    out = np.full(0x250, CLASSES.index("other"), np.uint8)
    for cp in range(0x250):
        c = chr(cp)
        for name, test in (("lower", c.islower()), ("upper", c.isupper()), ("digit", c.isdigit()), ("space", c.isspace()), ("stop", c in _STOP), ("mark", c in _MARK), ("symbol", c in _SYMBOL)):
            if test:
                out[cp] = CLASSES.index(name)
                break
    return out


_CLASS = _class_table()
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_BLANK = " \t\n\x0b\x0c\r"


def repeated_words(found: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of 8 words found twice or more in the text.

    Windows are numbered exactly, by pairs of numbers: words, 2, 4, 8 words."""
    n = len(found)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, n)
    if len(number) == n:
        return 0
    span = 1
    while span < width:
        pairs = ids[: len(ids) - span] * (int(ids.max()) + 1) + ids[span:]
        _, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if counts.max(initial=0) < 2:
            return 0
        span *= 2
    again = np.flatnonzero(counts[ids] > 1)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def base_counts(text: str | None, found: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    chars = len(text) - sum(map(text.count, _BLANK))
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(found), chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated_words(found)


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 20 or 100 * n_repeat > 30 * n_words


def histograms(text: str | None, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by character class and by common word."""
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), "<u4")
    low = points[points < 0x250]
    classes = np.bincount(_CLASS[low], minlength=N_CLASSES).astype(np.float64)
    classes[-1] += len(points) - len(low)
    places = [_PLACE.get(w.strip(_TRIM), N_WORDS - 1) for w in found]
    return classes, np.bincount(np.array(places, np.int64), minlength=N_WORDS).astype(np.float64)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (root of the divergence, base 2): 0 to 1."""
    p, q = p / max(p.sum(), 1e-300), q / max(q.sum(), 1e-300)
    m = (p + q) / 2

    def part(x):
        some = x > 0
        return float((x[some] * np.log2(x[some] / m[some])).sum())

    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def judge(text: str | None, references: list[tuple[np.ndarray, np.ndarray]], limits: tuple) -> tuple:
    """Base counts, base_failed, kept, class and word distance (None: not judged)."""
    found = S.words(text)
    counts = base_counts(text, found)
    failed = base_failed(counts[0], counts[4])
    class_limit, word_limit, least_chars, least_words = limits
    by_class = by_word = None
    if references:
        classes, common = histograms(text, found)
        if classes.sum() >= least_chars:
            by_class = min(distance(classes, r[0]) for r in references)
        if counts[0] >= least_words:
            by_word = min(distance(common, r[1]) for r in references)
    noise = max(counts[0], 1) ** -0.5
    near = all(d is None or d <= base + slack * noise for d, (base, slack) in ((by_class, class_limit), (by_word, word_limit)))
    kept = not failed and near
    return (*counts, failed, kept, by_class, by_word)


def _gather(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums of normalised histograms by language."""
    sums: dict[str | None, np.ndarray] = {}
    for lang, text in S.rows_of(found):
        ws = S.words(text)
        if len(ws) >= LEAST_WORDS and not base_failed(len(ws), repeated_words(ws)):
            classes, common = histograms(text, ws)
            row = np.concatenate([[1.0], classes / classes.sum(), common / common.sum()])
            sums[lang] = sums[lang] + row if lang in sums else row
    if sums:
        schema = pa.schema([("lang", pa.string()), ("sums", pa.list_(pa.float64()))])
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], schema[1].type)], schema=schema)


def references(docs: DataFrame) -> dict[str | None, tuple[np.ndarray, np.ndarray]]:
    """References over all of ``docs`` by language: (classes, common words) each.

    Tasks send one row a language; those are summed by language and place."""
    sums = S.columns(docs, lang="string", text="string").mapInArrow(_gather, "lang string, sums array<double>")
    total = sums.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("s"))
    by_lang = total.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("pos", "s"))).alias("m"))
    rows = by_lang.filter(F.col("m")[0] >= LEAST_DOCS).orderBy(F.col("m")[0].desc(), "lang").collect()
    out = {}
    for row in rows:  # a kilobyte a language
        v = np.array([row.m[i] for i in range(1 + N_CLASSES + N_WORDS)])
        out[row.lang] = v[1 : 1 + N_CLASSES], v[1 + N_CLASSES :]
    return out


def judging(refs: dict) -> Callable[[str | None], list]:
    """The references that a text of a language is judged by: all, or none without one of its own."""
    every = list(refs.values())
    return lambda lang: every if lang in refs else []


def score_rules(docs: DataFrame, limits: tuple = LIMITS) -> DataFrame:
    """doc_id with the base counts, base_failed, kept and both distances."""
    by = judging(references(docs))
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("class_distance", pa.float64()), ("word_distance", pa.float64())])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from S.batches(((key, *judge(text, by(lang), limits)) for key, text, lang in S.rows_of(found)), schema)

    return S.columns(docs, doc_id="long", text="string", lang="string").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double")


def keep_where(docs: DataFrame, test: Callable[[], Callable[..., list]], *columns: str) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text (or ``columns``, as strings) passes.

    ``test()`` is called once a task and gives a function from texts to booleans."""
    at = [docs.columns.index(c) for c in columns or ("text",)]
    S.small_batches(docs.sparkSession)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = test()
        for batch in found:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield part.filter(pa.array(passes(*(part.column(i).cast(pa.string()).to_pylist() for i in at)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def filter_rules(docs: DataFrame, limits: tuple = LIMITS) -> DataFrame:
    """Pipeline stage: the documents kept, with their own columns."""
    by = judging(references(docs))
    return keep_where(docs, lambda: lambda texts, langs: [judge(t, by(lang), limits)[6] for t, lang in zip(texts, langs)], "text", "lang")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: base counts and verdict of every document."""
    return score_rules(S.table(spark, sf_dir, "documents"))
