"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages of 24 words.  Hashed terms weigh by
inverse document frequency, counted over all documents.  A distributed randomised
SVD of the TF-IDF passages (their products with random groups of terms, counted
exactly in one pass over all documents, and a Nystroem step) gives the latent
space, and every passage of every document is projected.  Pieces
of benchmark items whose cosine with a passage reaches ``COSINE`` make a
candidate of that place, if their cosine over all terms reaches ``FULL``, which
rids short passages of chance neighbours.  It counts as a leak if the longest common subsequence
of words there holds ``VERBATIM`` of the item, or ``PARAPHRASE`` of it together
with the item's answer (its last sentence, or an answer column).

Every passage goes through the latent search.  Beside it, a place is a candidate if
it holds as many of an item's rarest words as any text with ``PARAPHRASE`` of the item
must.  That misses no place that the subsequence would accept, so what is found depends
neither on the fitted space, nor on an item's length; ``latent`` says which of them the
latent search proposed itself.

Items are the stated query set, matched in blocks of ``ITEMS`` and ``ITEM_WORDS`` words.  Defined results:
null and empty texts have no passages; an item of fewer than ``LEAST`` words is
found where its words stand in a row; items without words are not searched; null
and repeated ids are reported by row; no rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S
from .quality_rules import keep_where

#: Hash places of terms, latent dimensions, and groups of terms that the space is fitted by.
TERMS, RANK, GROUPS = 1 << 13, 96, 256
#: Words of half a passage; passages are two halves, each half in two of them.
HALF = 12
#: Documents that the latent space is fitted on: None, all.
SAMPLE: int | None = None
COSINE, FULL, VERBATIM, PARAPHRASE, ANSWER = 0.5, 0.4, 0.8, 0.6, 0.6
LEAST = 8
#: Items and words of the items matched at once: a Searcher's memory is some 100 bytes a word.
ITEMS, ITEM_WORDS = 2000, 1 << 18
#: Share of an item's words, the rarest, that the exact path counts; hash places of words there.
RAREST, FINE = 0.5, 1 << 20
#: Terms worked on at once.
CHUNK = 1 << 16
#: A-Z lower-cased; marks that end or enclose words part them, as white space does.
_PARTS = b".,;:!?\"'()[]"
_TABLE = bytes(32 if c in _PARTS or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_FACTOR = 0x9E3779B97F4A7C15


class Terms:
    """Texts -> hash places of their words, without a Python object a word.

    A word's hash is a polynomial in its bytes, from prefix sums modulo 2^64."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            n = 2 * n
            inverse = pow(_FACTOR, -1, 1 << 64)
            self.power, self.inverse = (np.multiply.accumulate(np.append(np.uint64(1), np.full(n, f, np.uint64))) for f in (np.uint64(_FACTOR), np.uint64(inverse)))

    def hashes(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode("utf-8", "replace").translate(_TABLE), np.uint8)
        inside = np.concatenate([[False], data != 32, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        if not len(edges):
            return np.zeros(0, np.uint64)
        self._grow(len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * self.power[: len(data)], dtype=np.uint64)])
        begin, end = edges[::2], edges[1::2]
        h = (sums[end] - sums[begin]) * self.inverse[begin]
        return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)

    def of(self, text: str | None) -> np.ndarray:
        return places(self.hashes(text))


def places(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(TERMS)).astype(np.int32)


def fine_places(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(12)) % np.uint64(FINE)).astype(np.int32)


def norm_words(text: str | None) -> list[bytes]:
    """The words that Terms hashes."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def _together(found: Iterator[pa.RecordBatch]) -> np.ndarray:
    """A task's counts: pairs of (term place, group of terms) within a passage, documents that a term is in, documents."""
    terms, width = Terms(), 2 * HALF
    pairs, seen, total = np.zeros((TERMS + 1) * (GROUPS + 1), np.int64), np.zeros(TERMS, np.int64), 0
    group = np.append(np.arange(TERMS) % GROUPS, GROUPS)  # what pads a text's last passage is term TERMS of group GROUPS

    def add(held: list[np.ndarray]) -> None:
        ids = np.concatenate(held).astype(np.int64).reshape(-1, width)
        for at in range(0, len(ids), CHUNK // width):
            part = ids[at : at + CHUNK // width]
            pairs[:] += np.bincount((part[:, :, None] * (GROUPS + 1) + group[part][:, None, :]).ravel(), minlength=len(pairs))

    held, n = [], 0
    for (text,) in S.rows_of(found):
        ids = terms.of(text)
        if len(ids):
            seen += np.bincount(ids, minlength=TERMS) > 0
            total += 1
            held.append(np.append(ids, np.full(-len(ids) % width, TERMS, ids.dtype)))
            n += len(held[-1])
            if n >= CHUNK:
                add(held)
                held, n = [], 0
    if held:
        add(held)
    return np.concatenate([pairs.reshape(TERMS + 1, GROUPS + 1)[:TERMS, :GROUPS].ravel(), seen, [total]])


def count_terms(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray, int]:
    """(counts of terms with groups of terms in a passage, documents that each term is in, documents with words) of all rows."""
    counts = S.summed(S.columns(docs, **{text: "string"}), _together, TERMS * GROUPS + TERMS + 1)
    return counts[: TERMS * GROUPS].reshape(TERMS, GROUPS), counts[TERMS * GROUPS : -1], int(counts[-1])


def fit_basis(pairs: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """V / sigma: the map (TERMS x RANK) that folds passages into the latent space.

    With N the term counts of all passages, S the groups' indicator and D the weights, ``pairs``
    is N'N S: the weighted N'N is approximated by Y (S'N'N S)^-1 Y', Y = D N'N S (Nystroem), and its
    leading vectors are taken exactly."""
    core = pairs.reshape(TERMS // GROUPS, GROUPS, GROUPS).sum(0).astype(np.float64)
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-12 * max(values.max(), 1e-300)
    root = (weight[:, None].astype(np.float64) * pairs) @ (vectors[:, good] / np.sqrt(values[good]))
    values, vectors = np.linalg.eigh(root.T @ root)
    order = np.argsort(-values)[:RANK]
    order = order[values[order] > 1e-9 * max(values.max(initial=0), 1e-300)]
    out = np.zeros((TERMS, RANK), np.float32)
    out[:, : len(order)] = root @ vectors[:, order] / np.maximum(values[order], 1e-6 * values.max(initial=0))
    return out


def passages(ids: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Unit latent vectors of a text's passages (halves i and i + 1)."""
    words, whole = np.take(space, ids, axis=0), len(ids) // HALF * HALF
    halves = np.einsum("ijk->ik", words[:whole].reshape(-1, HALF, space.shape[1]))
    if whole < len(ids):
        halves = np.concatenate([halves, words[whole:].sum(0, keepdims=True)])
    both = halves[:-1] + halves[1:] if len(halves) > 1 else halves
    return both / np.maximum(np.sqrt((both * both).sum(1, keepdims=True)), 1e-12)


def piece_ids(ids: np.ndarray) -> list[np.ndarray]:
    """An item's pieces of 24 words, 12 apart, the last at its end."""
    width = 2 * HALF
    return [ids[s : s + width] for s in sorted({*range(0, max(1, len(ids) - width + 1), HALF), max(0, len(ids) - width)})]


def item_pieces(ids: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Unit latent vectors of an item's pieces."""
    out = np.stack([space[x].sum(0) for x in piece_ids(ids)])
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-12)


def common_subsequence(masks: dict[bytes, int], n: int, found: list[bytes]) -> int:
    """Length of the longest common subsequence, 64 and more words a step (bit-parallel)."""
    full = (1 << n) - 1
    row = full
    for w in found:
        m = masks.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


class Item:
    """A benchmark item: its words, and those of its answer."""

    def __init__(self, item_id: int, text: str | None, answer: str | None):
        self.id, self.text, self.words = item_id, text, norm_words(text)
        if answer is None:
            ends = [x for x in (text or "").replace("\n", " ").rstrip(" .!?").split(". ") if x.strip()]
            answer = ends[-1] if len(ends) > 1 else b" ".join(self.words[-(len(self.words) // 3 or 1) :]).decode()
        self.answer = norm_words(answer)
        self.bag = Counter(self.words)
        self.masks, self.answer_masks = self._masks(self.words), self._masks(self.answer)

    @staticmethod
    def _masks(words: list[bytes]) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        for i, w in enumerate(words):
            out[w] = out.get(w, 0) | 1 << i
        return out

    def enough(self, found: list[bytes]) -> bool:
        """Whether words hold ``PARAPHRASE`` of the item in any order."""
        bag = Counter(filter(self.bag.__contains__, found))
        return sum(min(k, self.bag[w]) for w, k in bag.items()) >= PARAPHRASE * len(self.words)

    def leak(self, found: list[bytes]) -> tuple[float, bool, bool]:
        """(share of the item found in order, answer found, leak) at a place."""
        n = len(self.words)
        if not self.enough(found):  # no subsequence can be longer
            return 0.0, False, False
        share = common_subsequence(self.masks, n, found) / n
        answered = bool(self.answer) and common_subsequence(self.answer_masks, len(self.answer), found) >= ANSWER * len(self.answer)
        return share, answered, share >= VERBATIM or share >= PARAPHRASE and answered


class Rarest:
    """Exact gate: places that hold enough of an item's rarest words.

    A leak holds ``PARAPHRASE`` of an item's n words, so it lacks at most the rest
    of them, and has all but so many of any part of the item, within the
    24 + 2 n words that a place is judged by."""

    def __init__(self, items: list[Item], weight: np.ndarray, terms: Terms):
        self.need, self.span, pairs = np.ones(len(items), np.int64), np.ones(len(items), np.int64), set()
        self.first: list[int] = []
        for k, x in enumerate(items):
            h, n = terms.hashes(x.text), len(x.words)
            order = np.argsort(-weight[places(h)], kind="stable")
            # Floats may fall to either side of a whole number: one word more is let go.
            lacked = 0 if n < LEAST else min(n - 1, int((1 - PARAPHRASE) * n + 1e-6))
            some = order[: 1 if n < LEAST else max(lacked + 1, int(np.ceil(RAREST * n)))]
            self.need[k], self.span[k] = len(some) - lacked, 2 * HALF + 2 * n
            self.first.append(int(some[0]))
            pairs.update((int(f), k) for f in fine_places(h)[some])
        found = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.owner, used = found[:, 1], np.unique(found[:, 0])
        self.slot = np.zeros(FINE, np.int32)  # 0: in no item
        self.slot[used] = np.arange(1, len(used) + 1)
        self.begin = np.searchsorted(found[:, 0], used)
        self.count = np.diff([*self.begin, len(found)])
        self.widest = int(self.span.max(initial=0))

    def near(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first and last word) of each shortest row of words with enough of an item's."""
        for at in range(0, len(hashes), CHUNK):
            slots = self.slot[fine_places(hashes[at : at + CHUNK + self.widest])]
            hit = np.flatnonzero(slots)
            if not len(hit):
                continue
            slots = slots[hit] - 1
            count = self.count[slots]
            ends = np.cumsum(count)
            owner = self.owner[np.arange(ends[-1]) + np.repeat(self.begin[slots] - ends + count, count)]
            order = np.argsort(owner, kind="stable")
            owner, word = owner[order], np.repeat(hit, count)[order]
            last = np.arange(len(owner)) + self.need[owner] - 1
            inside = np.minimum(last, len(owner) - 1)
            good = np.flatnonzero((last < len(owner)) & (owner[inside] == owner) & (word[inside] - word < self.span[owner]))
            yield from zip(owner[good].tolist(), (at + word[good]).tolist(), (at + word[last[good]]).tolist())


class Searcher:
    """Finds leaks in whole texts; holds the latent space and a block of items."""

    def __init__(self, items: list[tuple], weight: np.ndarray, basis: np.ndarray, cosine: float = COSINE):
        self.space = np.ascontiguousarray(basis * weight[:, None], np.float32)
        every = [x for x in (Item(*i) for i in items) if x.words]
        self.items, self.short = ([x for x in every if (len(x.words) < LEAST) == short] for short in (False, True))
        self.rarest = Rarest(self.items + self.short, weight, Terms())
        terms = Terms()
        pieces = [item_pieces(terms.of(x.text), self.space) for x in self.items]
        self.owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        self.queries = np.ascontiguousarray(np.concatenate(pieces).T) if pieces else np.zeros((basis.shape[1], 0), np.float32)
        # A short item fills a part of a passage: its cosines are smaller by the root of that part.
        fill = np.sqrt([min(1.0, len(p) / (2 * HALF)) for x in self.items for p in piece_ids(terms.of(x.text))]).astype(np.float32)
        self.cosine, self.least, self.terms = cosine * fill, FULL * fill, terms
        # Term weights over each piece's norm, as sorted (piece, term) places: 24 a piece at most.
        self.weight, places_, values = np.append(weight, 0).astype(np.float32), [], []
        for k, ids in enumerate(ids for x in self.items for ids in piece_ids(terms.of(x.text))):
            some, times = np.unique(ids, return_counts=True)
            row = times * weight[some]
            places_.append(k * (TERMS + 1) + some.astype(np.int64))
            values.append(row * weight[some] / max(float(np.sqrt((row * row).sum())), 1e-9))
        self.at = np.concatenate([*places_, [np.iinfo(np.int64).max]])
        self.value = np.concatenate([*values, [0.0]]).astype(np.float32)

    def _full_cosine(self, ids: np.ndarray, at: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Cosine over all terms of passages and pieces (a passage's repeats count once: never too low)."""
        width = 2 * HALF
        padded = np.append(ids, np.full(width, TERMS, ids.dtype))
        words = padded[(at * HALF)[:, None] + np.arange(width)]
        norm = np.sqrt((self.weight[words] ** 2).sum(1))
        wanted = piece[:, None].astype(np.int64) * (TERMS + 1) + words
        found = np.searchsorted(self.at, wanted)
        return np.where(self.at[found] == wanted, self.value[found], 0).sum(1) / np.maximum(norm, 1e-9)

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(item, passage, cosine) at or above the threshold."""
        for at in range(0, len(ids), CHUNK // 8 // HALF * HALF):
            part = ids[at : at + CHUNK // 8 // HALF * HALF + HALF]
            scores = passages(part, self.space) @ self.queries
            at_passage, piece = np.divmod(np.flatnonzero(scores >= self.cosine), max(1, scores.shape[1]))
            for i in range(0, len(piece), CHUNK):
                p, q = at_passage[i : i + CHUNK], piece[i : i + CHUNK]
                near = self._full_cosine(part, p, q) >= self.least[q]
                for a, b in zip(p[near].tolist(), q[near].tolist()):
                    yield int(self.owner[b]), at // HALF + a, float(scores[a, b])

    def _cosine(self, ids: np.ndarray, passage: int, pieces: np.ndarray) -> float:
        """The largest cosine of a passage and some pieces (latent x piece)."""
        return float((passages(ids[passage * HALF : (passage + 2) * HALF], self.space)[:1] @ pieces).max())

    def _short(self, ids: np.ndarray, k: int, words: list[int], found: list[bytes]) -> tuple | None:
        """A short item's leak: its words in a row around one of ``words``, where its rarest one may be."""
        x, n = self.short[k], len(self.short[k].words)
        for word in words:
            begin = word - self.rarest.first[len(self.items) + k]
            if begin >= 0 and found[begin : begin + n] == x.words:
                return x.id, self._cosine(ids, begin // HALF, item_pieces(self.terms.of(x.text), self.space).T), 1.0, True, begin, False
        return None

    def leaks(self, text: str | None) -> Iterator[tuple[int, float, float, bool, int, bool]]:
        """(item id, cosine, share, answer found, first word, by latent search) of each item leaked, once."""
        hashes = self.terms.hashes(text)
        ids = places(hashes)
        if not len(ids):
            return
        # The latent search comes first, over every passage; the exact count admits what it misses.
        near: dict[int, dict[int, float]] = {}
        for item, passage, cosine in self.candidates(ids):
            held = near.setdefault(item, {})
            held[passage] = max(cosine, held.get(passage, -1.0))
        exact: dict[int, dict[int, int]] = {}
        for item, first, last in self.rarest.near(hashes):
            exact.setdefault(item, {})[first] = last
        if not near and not exact:
            return
        found = norm_words(text)
        for item in sorted({*near, *exact}):
            if item >= len(self.items):
                top = self._short(ids, item - len(self.items), sorted(exact[item]), found)
            else:
                top = self._best(ids, item, near.get(item, {}), self._enough(item, exact.get(item, {}), found), found)
            if top:
                yield top

    def _best(self, ids: np.ndarray, item: int, near: dict[int, float], counted: list[int], found: list[bytes]) -> tuple | None:
        """The leak of an item with the largest share, at its latent places (passage: cosine) or counted ones."""
        x, top = self.items[item], None
        if beside := [p for p in counted if p not in near]:
            pieces = self.queries[:, self.owner == item]
            held = [*near.items(), *((p, self._cosine(ids, p, pieces)) for p in beside)]
        else:
            held = list(near.items())
        for passage, cosine in sorted(held, key=lambda h: (-h[1], h[0])):
            begin = max(0, passage * HALF - len(x.words))
            share, answered, leak = x.leak(found[begin : passage * HALF + 2 * HALF + len(x.words)])
            if leak and (top is None or share > top[2]):
                top = x.id, cosine, share, answered, begin, passage in near
                if share == 1.0:
                    break
        return top

    def _enough(self, item: int, rows: dict[int, int], found: list[bytes]) -> list[int]:
        """Passages whose judged words hold a row of ``rows`` (first: last word) and enough of an item."""
        x, n, done, out = self.items[item], len(self.items[item].words), 0, []
        top = max(1, -(-len(found) // HALF) - 1)
        for first, last in sorted(rows.items()):
            begin, end = max(done, -(-(last + 1 - n) // HALF) - 2), min((first + n) // HALF + 1, top)
            if begin < end and x.enough(found[max(0, begin * HALF - n) : (end + 1) * HALF + n]):
                out += [p for p in range(begin, end) if x.enough(found[max(0, p * HALF - n) : (p + 2) * HALF + n])]
            done = max(done, end)
        return out


_OUT = "doc_id long, item_id long, cosine double, share double, answer_found boolean, first_word long, latent boolean"


def _prepared(docs: DataFrame, benchmark: DataFrame, sample: int | None) -> list:
    """Broadcasts of what a Searcher needs, one a block of items; none without words or items.

    Frequencies and the latent space are of all rows, unless ``sample`` asks for about so many."""
    spark = docs.sparkSession
    held = S.columns(docs, text="string")
    answers = {"answer": "string"} if "answer" in benchmark.columns else {}
    items = S.columns(benchmark, item_id="long", text="string", **answers)
    n_items = items.count()
    if not n_items:
        return []
    pairs, n, total = count_terms(held)
    if not total:
        return []
    weight = np.log((1 + total) / (1 + n)).astype(np.float32)
    if sample is not None:
        pairs = count_terms(held.filter(F.rand(3) < min(1.0, sample / total)))[0]
    basis = fit_basis(pairs, weight)
    n_words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks, out = max(-(-n_items // ITEMS), -(-n_words // ITEM_WORDS)), []
    for b in range(blocks):
        block = [tuple(r) if answers else (*r, None) for r in items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()]
        out.append(spark.sparkContext.broadcast((block, weight, basis)))  # ITEMS items and two matrices of fixed size
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, sample: int | None = SAMPLE, cosine: float = COSINE) -> DataFrame:
    """A row for each document and benchmark item found in it."""
    held = S.columns(docs, doc_id="long", text="string")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("share", pa.float64()), ("answer_found", pa.bool_()), ("first_word", pa.int64()), ("latent", pa.bool_())])
    out = None
    for sent in _prepared(docs, benchmark, sample):

        def run(found: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(*sent.value, cosine)
            yield from S.batches(((key, *leak) for key, text in S.rows_of(found) for leak in searcher.leaks(text)), schema)

        part = held.mapInArrow(run, _OUT)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], _OUT) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, sample: int | None = SAMPLE, cosine: float = COSINE) -> DataFrame:
    """Pipeline stage: the rows without a leak, with their own columns.

    Each row is judged by its own text in one pass, so null and repeated ids need
    no join and a clean row that shares its id with a leak stays."""
    for sent in _prepared(docs, benchmark, sample):

        def clean(sent=sent):
            searcher = Searcher(*sent.value, cosine)
            return lambda texts: [next(searcher.leaks(t), None) is None for t in texts]

        docs = keep_where(docs, clean)
    return docs


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: benchmark items found in all documents."""
    return find_leaks(S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "benchmark"))
