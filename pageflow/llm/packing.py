"""Packing by Karmarkar-Karp multiway differencing.

Documents are joined to windows of at most ``capacity`` ids.  A document's full
windows stand alone.  What remains of each document of a group is dealt, whole, to k
windows: a partial partition is k sums with their pieces; the two partitions of the
widest spread are merged, the largest sum of one onto the smallest of the other, until
one is left, whose windows are near-equal.  k starts at the least number that could
hold the ids and rises while a window exceeds the capacity, until padding would exceed
``PADDING``.  Only then is a document cut: what a window holds too much of is taken off
the end of its longest piece and fills the room of other windows.

A group is a run of documents of one task, so packing needs no shuffle, no
window crosses a task, and memory holds one group.  A retried task packs the
same rows of its partition again.  Null and empty texts are documents of the end
id alone; null and repeated keys are packed as any; no rows give no pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S
from . import tokens as T

#: Documents and ids of a group, whichever is met first.
GROUP_DOCS, GROUP_IDS = 400, 1 << 20
#: Padding beyond which documents are cut instead.
PADDING = 0.01
#: Sequence ids of a task lie in a range of their own.
_TASK_BITS = 33


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: indexes of ``sizes`` in k near-equal sets.

    A partial partition keeps only its non-empty sets; sums are relative to its
    smallest one.  Ties go to the partition made first."""
    heap: list[tuple[int, int, list[int], list[list[int]]]] = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, _, a_sums, a_sets = heapq.heappop(heap)
        _, _, b_sums, b_sets = heapq.heappop(heap)
        # Sums are descending; sets beyond those kept are empty, of sum 0.
        over = max(0, len(a_sums) + len(b_sums) - k)
        sums, sets = a_sums[: len(a_sums) - over] + b_sums[: len(b_sums) - over], a_sets[: len(a_sets) - over] + b_sets[: len(b_sets) - over]
        for j in range(over):  # a's smallest kept with b's largest that would not fit
            i, m = len(a_sums) - over + j, len(b_sums) - 1 - j
            sums.append(a_sums[i] + b_sums[m])
            sets.append(a_sets[i] + b_sets[m])
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        low = sums[order[-1]] if len(sums) == k else 0
        # A difference is all that later merges look at; its sums are taken off the least.
        heapq.heappush(heap, (-(sums[order[0]] - low), n, [sums[o] - low for o in order], [sets[o] for o in order]))
        n += 1
    return heap[0][3] if heap else []


def fit(sizes: list[int], capacity: int, most_windows: int | None = None) -> list[list[int]]:
    """The least k, tried upwards to ``most_windows``, whose differencing keeps to the capacity."""
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while True:
        sets = differencing(sizes, k)
        most = max((sum(sizes[i] for i in s) for s in sets), default=0)
        if most <= capacity or most_windows is not None and k >= most_windows:
            return sets
        k = max(k + 1, -(-k * most // (capacity + most - 1)) if most < 2 * capacity else k + 1)
        if most_windows is not None:  # one rise to what padding allows: documents are cut beyond it
            k = max(k, most_windows)


def windows(sizes: list[int], capacity: int, padding: float = PADDING) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (index, begin, length) that hold every id of ``sizes`` once."""
    least = max(1, -(-sum(sizes) // capacity))
    out = [[(i, 0, sizes[i]) for i in s] for s in fit(sizes, capacity, max(least, int(sum(sizes) * (1 + padding) // capacity)))]
    cut: list[tuple[int, int, int]] = []
    room: list[tuple[int, int]] = []
    for w, pieces in enumerate(out):
        over = sum(p[2] for p in pieces) - capacity
        while over > 0:
            at = max(range(len(pieces)), key=lambda j: pieces[j][2])
            i, begin, n = pieces.pop(at)
            off = min(over, n)
            cut.append((i, begin + n - off, off))
            over -= off
            if n > off:
                pieces.append((i, begin, n - off))
        if over < 0:
            room.append((over, w))
    room.sort()
    cut.sort(key=lambda p: p[2])
    while cut:  # the longest piece to the widest room, in parts where it must be
        i, begin, n = cut.pop()
        free, w = room[0]
        some = min(n, -free)
        out[w].append((i, begin, some))
        heapq.heapreplace(room, (free + some, w)) if free + some < 0 else heapq.heappop(room)
        if some < n:
            cut.append((i, begin + some, n - some))
    return out


def _pack(path: str, by_rank: bool, end_id: int, capacity: int):
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = T.encoder(path, by_rank).encode
        sequence = TaskContext.get().partitionId() << _TASK_BITS

        def rows():
            nonlocal sequence
            held: list[tuple] = []  # key, start, doc_tokens, ids
            docs = total = 0

            def packed():
                nonlocal sequence
                for window in windows([len(h[3]) for h in held], capacity):
                    offset = 0
                    for i, begin, length in sorted(window):
                        key, start, n, ids = held[i]
                        yield key, start + begin, length, n, sequence, offset, ids[begin : begin + length].tobytes()
                        offset += length
                    sequence += 1

            for key, text in S.rows_of(found):
                ids = encode(text, end_id)
                n = len(ids)
                full = n - n % capacity
                for at in range(0, full, capacity):
                    yield key, at, capacity, n, sequence, 0, ids[at : at + capacity].tobytes()
                    sequence += 1
                if full < n:
                    held.append((key, full, n, ids[full:].copy()))
                docs, total = docs + 1, total + n - full
                if docs >= GROUP_DOCS or total >= GROUP_IDS:
                    yield from packed()
                    held, docs, total = [], 0, 0
            if held:
                yield from packed()

        yield from S.batches(rows(), schema)

    return run, "key long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of ``docs`` in windows: key, start (the document's ids before the
    piece), length, doc_tokens, sequence_id, offset, ids (little-endian u32)."""
    run, schema = _pack(path, T.ranked(path), end_id, capacity)
    return S.columns(docs, **{key: "long", text: "string"}).mapInArrow(run, schema)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all documents in windows of 1024 ids."""
    return digest(pack(S.table(spark, sf_dir, "documents"), T.default_path()))
