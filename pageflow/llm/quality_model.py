"""Quality classifier: a factorisation machine over a text's own features.

Features: hashed words, hashed word shapes, and standardised structure
statistics and metadata of the text (length, line and word sizes, shares of
character classes, repetition).  Labels, language, source and id are no input.
A score is sigmoid(w0 + <w, x> + half the sum over factors of (V'x)^2 - V^2'x^2),
linear in the features a text has.

Training reads every labelled row.  Up to ``SHARD`` rows are fitted in one go; more are
dealt by hash into shards of about so many, each fitted by a task from the same start
and scale, and the machines are averaged by their rows (in whole numbers, so in any
order).  Every text is scored whole, in one map.

Defined results: null and empty texts are scored by their statistics alone;
repeated labels of a document count each, as do repeated documents of a label; null labels are left out; without any
label, or with labels of one kind, the score is that share of ones (0.5 with
none).  Null ids are scored.  Other columns are passed by.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S
from . import quality_rules as Q

#: Hash places of words, statistics beside them, factors.
PLACES, FACTORS = 1 << 14, 8
#: Labelled rows to learn from at most: None, all.
SAMPLE: int | None = None
#: Labelled rows of a shard, at most twice so many fitted at once, and labels of one broadcast.
SHARD, SENT = 6000, 500_000
#: Parts of a unit that averages of machines, and sums of statistics, are counted in.
UNIT = 1 << 24
THRESHOLD = 0.7
STATS = ("log_words", "log_chars", "word_size", "line_size", "distinct", "repeated", "dup_lines", "stop_share", "capital_words", "odd_words", *(f"share_{c}" for c in Q.CLASSES))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash places, their values, statistics) of a text."""
    text = text or ""
    found = S.words(text)
    n, chars = len(found), len(text)
    classes, _ = Q.histograms(text, [])
    counts = Counter(found)
    lines = [x for x in text.split("\n") if x.strip()]
    common = capital = odd = 0
    cells: dict[int, float] = {}
    for w, k in counts.items():
        bare = w.strip(b".,;:!?\"'()")
        common += k * (bare in Q._PLACE)
        capital += k * (bare.isupper() and len(bare) > 1)
        plain = bare.isalpha() or len(bare) > 0 and max(bare) > 127
        odd += k * (not plain)
        place = zlib.crc32(bare.lower() if plain else w) % PLACES
        cells[place] = cells.get(place, 0.0) + k
        if not plain:  # the shape of what is no plain word
            place = zlib.crc32(b"\0" + bytes(46 if 48 <= b < 58 else 97 if b > 127 or chr(b).isalpha() else b for b in w)) % PLACES
            cells[place] = cells.get(place, 0.0) + k
    values = np.log1p(np.fromiter(cells.values(), np.float32, len(cells)))
    values /= max(1e-9, float(np.sqrt((values**2).sum())))
    m = max(n, 1)
    stats = [np.log1p(n), np.log1p(chars), (chars - classes[3]) / m, n / max(len(lines), 1), len(counts) / m, Q.repeated_words(found) / m, (len(lines) - len(set(lines))) / max(len(lines), 1), common / m, capital / m, odd / m, *(classes / max(chars, 1))]
    stats[2], stats[3] = np.log1p(stats[2]), np.log1p(stats[3])
    return np.fromiter(cells, np.int32, len(cells)), values, np.array(stats, np.float32)


@dataclass
class Machine:
    """Weights: bias, linear (places then statistics), factors, and the statistics' scale."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def row(self, places: np.ndarray, values: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / len(STATS) ** 0.5
        return np.concatenate([places, np.arange(PLACES, PLACES + len(STATS))]), np.concatenate([values, z]).astype(np.float32)

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        s = v.sum(0)
        return float(self.bias + self.linear[at] @ x + 0.5 * ((s * s).sum() - (v * v).sum()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*self.row(*features(text))), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 0.1, decay: float = 1e-5, seed: int = 7, common: tuple | None = None) -> Machine:
    """Stochastic gradient with AdaGrad steps on the logistic loss.

    ``common``: share of ones, mean and deviation of the statistics, where rows are part of more."""
    n = PLACES + len(STATS)
    share = common[0] if common else sum(r[3] for r in rows) / len(rows) if rows else 0.5
    bias = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    rng = np.random.default_rng(seed)
    stats = np.array([r[2] for r in rows], np.float32) if rows else np.zeros((1, len(STATS)), np.float32)
    mean, scale = common[1:] if common else (stats.mean(0), stats.std(0) + 1e-6)
    m = Machine(bias, np.zeros(n, np.float32), (rng.standard_normal((n, FACTORS)) * 0.01).astype(np.float32), mean, scale)
    if not rows or share in (0.0, 1.0):
        m.factors[:] = 0
        return m
    data = [(*m.row(*r[:3]), r[3]) for r in rows]
    g_bias, g_linear, g_factors = 1.0, np.full(n, 0.1, np.float32), np.full((n, FACTORS), 0.1, np.float32)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            at, x, y = data[i]
            f = m.factors[at]
            v = f * x[:, None]
            s = v.sum(0)
            raw = m.bias + m.linear[at] @ x + 0.5 * ((s * s).sum() - (v * v).sum())
            slope = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y
            d_linear = slope * x + decay * m.linear[at]
            d_factors = slope * x[:, None] * (s - v) + decay * f
            g_bias += slope**2
            g_linear[at] += d_linear**2
            g_factors[at] += d_factors**2
            m.bias -= rate * slope / g_bias**0.5
            m.linear[at] -= rate * d_linear / np.sqrt(g_linear[at])
            m.factors[at] -= rate * d_factors / np.sqrt(g_factors[at])
    return m


def learnable() -> F.Column:
    """Rows that may teach: those whose crc32(doc_id as text) mod 4 is not 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2


_TAUGHT = "doc_id long, places binary, values binary, stats binary, quality int"


def _features(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("places", pa.binary()), ("values", pa.binary()), ("stats", pa.binary()), ("quality", pa.int32())])
    yield from S.batches(((key, *(x.tobytes() for x in features(text)), y) for key, text, y in S.rows_of(found)), schema)


def _learned(rows: list[tuple]) -> list[tuple]:
    """Rows of features as numbers, in an order of their own."""
    held = [(np.frombuffer(p, np.int32), np.frombuffer(v, np.float32), np.frombuffer(s, np.float32), y) for _, p, v, s, y in rows]
    return sorted(held, key=lambda r: (r[3], r[0].tobytes(), r[2].tobytes()))


def _totals(found: Iterator[pa.RecordBatch]) -> np.ndarray:
    """Rows, ones, and sums of the statistics and their squares."""
    out = np.zeros(2 + 2 * len(STATS), np.int64)
    for stats, y in S.rows_of(found):
        x = np.frombuffer(stats, np.float32).astype(np.float64)
        out += np.rint(np.concatenate([[1, y], x * UNIT, x * x * UNIT])).astype(np.int64)
    return out


def _fit_shards(common: tuple):
    """Shards of features -> the sum of their machines (bias, linear, factors), each times its rows."""

    def run(found: Iterator[pa.RecordBatch]) -> np.ndarray:
        n = PLACES + len(STATS)
        out, at, held = np.zeros(1 + n + n * FACTORS, np.int64), None, []

        def add() -> None:
            if held:
                m = fit(_learned(held), common=common)
                whole = np.concatenate([[m.bias], m.linear, m.factors.ravel()]).astype(np.float64)
                out[:] += np.rint(whole * UNIT).astype(np.int64) * len(held)
                held.clear()

        for shard, *row in S.rows_of(found):
            if shard != at or len(held) == 2 * SHARD:  # a hot shard is fitted in parts
                add()
            at = shard
            held.append(row)
        add()
        return out

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int | None = SAMPLE) -> Machine:
    """Fits a machine to all labelled documents, or to ``sample`` of them, which a hash of the id picks.

    The driver holds the features of ``SHARD`` rows (or of the sample) at most."""
    spark = docs.sparkSession
    known = S.columns(labels, doc_id="long", quality="int").filter(learnable() & F.col("quality").isin(0, 1))
    held = S.columns(docs, doc_id="long", text="string")
    n = known.count()
    order = F.xxhash64("doc_id", F.lit(11))
    if sample is not None:
        # ``picked`` has ``sample`` rows of two numbers at most: a bounded broadcast.
        picked = known.orderBy(order, "doc_id", "quality").limit(sample)
        # Documents that share a labelled id are more rows: a hash of the text picks among them.
        taught = held.join(F.broadcast(picked), "doc_id").orderBy(order, F.xxhash64("text"), "quality").limit(sample)
        return fit(_learned(taught.select("doc_id", "text", "quality").mapInArrow(_features, _TAUGHT).collect()))
    # Labels are sent in blocks of bounded size; texts stay where they are read, only features are written.
    blocks, taught = max(1, -(-n // SENT)), None
    for b in range(blocks):
        part = held.join(F.broadcast(known.filter(F.pmod(order, F.lit(blocks)) == b)), "doc_id").select("doc_id", "text", "quality").mapInArrow(_features, _TAUGHT)
        taught = part if taught is None else taught.unionByName(part)
    folder = S.scratch(spark, "taught")
    taught = S.saved(taught, folder)
    sums = S.summed(taught.select("stats", "quality"), _totals, 2 + 2 * len(STATS))
    rows, ones = int(sums[0]), int(sums[1])
    if rows <= SHARD:
        machine = fit(_learned(taught.collect()))
    else:
        mean, square = (sums[2:] / UNIT / rows).reshape(2, -1)
        common = ones / rows, mean.astype(np.float32), (np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-6).astype(np.float32)
        shards = -(-rows // SHARD)
        number = F.pmod(F.xxhash64("doc_id", "places", "values", "stats", "quality"), F.lit(shards)).cast("int")
        dealt = taught.select(number.alias("shard"), "*").repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("doc_id", "places", "stats", "quality"))
        if ones in (0, rows):
            machine = fit([], common=common)
        else:
            whole = S.summed(dealt, _fit_shards(common), 1 + (PLACES + len(STATS)) * (1 + FACTORS)) / UNIT / rows
            at = 1 + PLACES + len(STATS)
            machine = Machine(float(whole[0]), whole[1:at].astype(np.float32), whole[at:].astype(np.float32).reshape(-1, FACTORS), *common[1:])
    S.drop(spark, folder)
    return machine


def score_quality(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    held = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = held.value.score
        yield from S.batches(((key, score(text)) for key, text in S.rows_of(found)), schema)

    scored = S.columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filter_quality(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """Pipeline stage: the documents predicted good, with their own columns."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    return Q.keep_where(docs, lambda: lambda texts: [held.value.score(t) >= threshold for t in texts])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's score."""
    docs = S.table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, S.table(spark, sf_dir, "labels")))
