"""Token counts by a linear longest-match automaton.

Greedy word pieces: the longest piece that begins a word, then the longest
continuation pieces.  The pieces form two tries, of word beginnings and of
continuations.  A node's failure link names the continuation node that reads the
rest once greedy pieces are taken off the node's string, and its popped count how
many pieces those were.  A word is counted in one walk over its bytes, with
neither backtracking nor any piece made.  A word without a full split counts as
one unknown token.

Frequent words' counts are kept in a bounded memo.  Defined results: null and
empty texts count 0 of everything; words of any length are counted; null and
repeated ids are counted by row; no rows give no rows; other columns are passed by.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S
from .tokens import _byte_letters, default_path

#: Words in the memo at most; it starts anew beyond that.
MEMO = 300_000


def vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """(word beginnings, continuations) of a byte-level vocabulary file.

    Entries that start with the space letter begin words; the others continue
    them.  Both have every single byte that the vocabulary has with it."""
    byte_of = {letter: byte for byte, letter in _byte_letters().items()}
    begin, rest = [], []
    for piece in json.load(open(path, encoding="utf-8"))["model"]["vocab"]:
        if all(c in byte_of for c in piece):
            raw = bytes(byte_of[c] for c in piece)
            (begin if raw[:1] == b" " else rest).append(raw[1:] if raw[:1] == b" " else raw)
    return [p for p in begin if p and not p.split()[1:] and p.strip() == p], [p for p in rest if p.strip() == p]


class Automaton:
    """Counts greedy pieces of words; nodes are numbers, edges one dictionary."""

    FAIL = -1

    def __init__(self, begin: Iterable[bytes], rest: Iterable[bytes]):
        # Node 0 is the root of word beginnings, node 1 that of continuations.
        self.edges: dict[int, int] = {}
        ends = [False, False]
        for root, pieces in ((0, begin), (1, rest)):
            for piece in pieces:
                node = root
                for byte in piece:
                    step = node << 8 | byte
                    child = self.edges.get(step)
                    if child is None:
                        child = self.edges[step] = len(ends)
                        ends.append(False)
                    node = child
                ends[node] = True
        n = len(ends)
        self.fail, self.popped = [self.FAIL] * n, [0] * n
        level = [0, 1]
        children: dict[int, list[tuple[int, int]]] = {}
        for step, child in self.edges.items():
            children.setdefault(step >> 8, []).append((step & 255, child))
        while level:  # by depth: a child's link follows from its parent's
            deeper = []
            for node in level:
                for byte, child in children.get(node, ()):
                    if ends[child]:  # the whole string is a piece
                        self.fail[child], self.popped[child] = 1, 1
                    else:
                        at, count = self.fail[node], self.popped[node]
                        while at != self.FAIL and (at << 8 | byte) not in self.edges:
                            count += self.popped[at]
                            at = self.fail[at]
                        if at != self.FAIL:
                            self.fail[child], self.popped[child] = self.edges[at << 8 | byte], count
                    deeper.append(child)
            level = deeper
        self.memo: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of a word; 0 if it has no full split."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = total = 0
        for byte in word:
            while (step := edges.get(node << 8 | byte)) is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = step
        while node != 1:  # what is left must end at the root of continuations
            if node <= 0:
                return 0
            total += popped[node]
            node = fail[node]
        return total

    def text(self, text: str | None) -> tuple[int, int, int]:
        """(words, tokens, unknown words) of a text."""
        found, memo = S.words(text), self.memo
        counts = list(map(memo.get, found))
        unknown = 0
        if None in counts or 0 in counts:
            if len(memo) > MEMO:
                memo.clear()
            for i, c in enumerate(counts):
                if c is None:
                    c = counts[i] = self.count(found[i])
                    if len(found[i]) <= 64:
                        memo[found[i]] = c
                if not c:
                    unknown += 1
        return len(found), sum(counts) + unknown, unknown


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_tokens, n_unknown of each row, in one map over the texts."""
    found_pieces = vocabulary(path)
    name = hashlib.sha256(repr(found_pieces).encode()).hexdigest()
    pieces = docs.sparkSession.sparkContext.broadcast(found_pieces)  # of the vocabulary's size
    schema = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, pieces)
        yield from S.batches(((k, *automaton.text(t)) for k, t in S.rows_of(found)), schema)

    return S.columns(docs, **{key: "long", text: "string"}).mapInArrow(run, "key long, n_words long, n_tokens long, n_unknown long")


_BUILT: dict[str, Automaton] = {}


def _automaton(name: str, pieces) -> Automaton:
    """One automaton a Python worker; ``name`` tells vocabularies apart by what they hold."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(*pieces.value)
    return _BUILT[name]


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: words, greedy word pieces and unknown words of every document."""
    out = count_tokens(S.table(spark, sf_dir, "documents"), default_path())
    return out.select(F.col("key").alias("doc_id"), "n_words", "n_tokens", "n_unknown")
