"""Token files: frequency-ranked ids, byte-aligned variable-length coding.

``write_tokens`` encodes texts, ranks the ids by their frequency over the whole
corpus and writes each id's rank in 1 to 4 bytes.  The byte counts stand apart,
two bits an id, four ids a control byte, so that a block of ids is decoded by
numpy table lookup without a loop.  ``read_tokens`` reads the files back.

A file holds a key range of documents in ascending key order::

    magic "PFTOK1\\n\\0"
    block*: u32 documents, u32 ids, u32 control bytes, u32 data bytes,
            i64 key[documents], u32 n_ids[documents], control, data

``ranks.bin`` beside the files has the ids by descending frequency (u32 each).
All numbers are little-endian.  Each file is written by one task under a name of
its own and renamed when whole, so lost executors and retries do no harm.

Null or empty texts give documents of the end id alone; rows with a null key
come first (under the smallest long, which stands for null in a file); repeated keys are
kept, one document each, ordered by a hash of their packed bytes.  No rows: no file, no row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S
from . import tokens as T

MAGIC = b"PFTOK1\n\0"
#: Ids of one block at most (a longer document is one block's only one).
BLOCK_IDS = 1 << 18
_HEAD = "<4I"
_NULL = -(1 << 63)


def _length_tables() -> tuple[np.ndarray, np.ndarray]:
    """By control byte: the byte counts of its four ids, and their sum."""
    control = np.arange(256, dtype=np.uint16)[:, None]
    lengths = ((control >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
    return lengths, lengths.sum(1).astype(np.uint8)


LENGTHS, TOTALS = _length_tables()


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    r = np.ascontiguousarray(ranks, "<u4")
    n = len(r)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    more = padded[:n]  # bytes beyond the first; ranks of more are ever fewer
    places, longer = np.arange(n), []
    for k in (1, 2, 3):
        places = places[r[places] >> np.uint32(8 * k) > 0] if k > 1 else np.flatnonzero(r > 0xFF)
        more[places] = k
        longer.append(places)
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    ends = np.cumsum(more, dtype=np.int64) + np.arange(1, n + 1)
    data = np.empty(int(ends[-1]) if n else 0, np.uint8)
    at = ends - more - 1
    data[at] = r.view(np.uint8)[::4]
    for k, places in enumerate(longer, 1):
        data[at[places] + k] = r[places] >> np.uint32(8 * k) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that encode_ranks() was given."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.zeros(len(data) + 3, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokenise(path: str, by_rank: bool, end_id: int, n_vocab: int):
    """Texts -> packed ids, and at the end of a task its histogram of ids."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("body", pa.binary())])
    narrow = np.uint16 if n_vocab <= 1 << 16 else np.uint32

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = T.encoder(path, by_rank).encode, zstandard.ZstdCompressor(level=1).compress
        seen, uncounted, n = np.zeros(n_vocab, np.int64), [], 0

        def counted():
            nonlocal seen, uncounted, n
            if uncounted:
                seen += np.bincount(np.concatenate(uncounted), minlength=n_vocab)
                uncounted, n = [], 0

        def rows():
            nonlocal n
            for key, text in S.rows_of(found):
                ids = encode(text, end_id).astype(narrow)
                uncounted.append(ids)
                n += len(ids)
                if n > 1 << 20:
                    counted()
                yield _NULL if key is None else key, len(ids), pack(ids)
            counted()
            used = np.flatnonzero(seen)
            if len(used):  # a row with n = -1 is the histogram of a task
                yield None, -1, np.stack([used, seen[used]]).astype("<i8").tobytes()

        yield from S.batches(rows(), schema)

    return run, "key long, n int, body binary"


def _unpack(body: bytes, n_vocab: int, unpack) -> np.ndarray:
    return np.frombuffer(unpack(body), np.uint16 if n_vocab <= 1 << 16 else np.uint32)


def _write(folder: str, rank_of: bytes, n_vocab: int):
    """A sorted partition of packed documents -> its file; returns its manifest row."""
    schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ranks, part = np.frombuffer(rank_of, "<u4"), TaskContext.get().partitionId()
        total, unpack = [0, 0, None], zstandard.ZstdDecompressor().decompress

        def block(keys: list[int], held: list[np.ndarray]) -> bytes:
            ids = np.concatenate(held)
            control, data = encode_ranks(ranks[ids])
            total[0] += len(keys)
            total[1] += len(ids)
            head = struct.pack(_HEAD, len(keys), len(ids), len(control), len(data))
            return head + np.array(keys, "<i8").tobytes() + np.array([len(x) for x in held], "<u4").tobytes() + control + data

        def blocks():
            yield MAGIC
            keys, held, n = [], [], 0
            for key, body in S.rows_of(found):
                ids = _unpack(body, n_vocab, unpack)
                if held and n + len(ids) > BLOCK_IDS:
                    yield block(keys, held)
                    keys, held, n = [], [], 0
                total[2] = key if total[2] is None else total[2]
                keys.append(key)
                held.append(ids)
                n += len(ids)
            if held:
                yield block(keys, held)

        file = f"{folder}/ids-{part:06d}.bin"
        size = S.put_file(file, blocks())
        if total[0]:
            yield from S.batches([(part, total[2], file, total[0], total[1], size)], schema)

    return run, "part int, first long, file string, documents long, ids long, bytes long"


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes token files of ``docs`` to ``folder``; returns the manifest.

    Manifest: part, file, documents, ids, bytes, and start (ids in the files
    before it).  Two passes: texts are encoded once, into compressed ids beside a
    histogram a task; those are dealt out by key range and written by rank."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    n_vocab = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)
    run, schema = _tokenise(path, T.ranked(path), end_id, n_vocab)
    held = S.saved(S.columns(docs, **{key: "long", text: "string"}).mapInArrow(run, schema), f"{folder}/_ids")
    # One row a task has a histogram; sums are made by task pairs, then the V rows of the sum are fetched.
    counts = held.filter("n = -1").select("body").mapInArrow(_histogram, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(n_vocab, np.int64)
    for row in counts:
        seen[row.id] = row.n
    order = np.argsort(-seen, kind="stable").astype("<u4")  # ties: the smaller id first
    rank_of = np.empty(n_vocab, "<u4")
    rank_of[order] = np.arange(n_vocab, dtype="<u4")
    S.put_file(f"{folder}/ranks.bin", [order.tobytes()])
    run, schema = _write(folder, rank_of.tobytes(), n_vocab)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.filter("n >= 0").withColumn("salt", F.xxhash64("body")).repartitionByRange(n_parts, "key", "salt").sortWithinPartitions("key", "salt", "body")
    files = S.saved(dealt.select("key", "body").mapInArrow(run, schema), f"{folder}/_manifest")
    S.drop(spark, f"{folder}/_ids")
    # The manifest has a row a file: the start of each is a sum over fewer rows than tasks.
    start, rows = 0, []
    for f in sorted(files.collect(), key=lambda f: f.part):
        rows.append((*f, start))
        start += f.ids
    return spark.createDataFrame(rows, "part int, first long, file string, documents long, ids long, bytes long, start long")


def _histogram(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, seen = pa.schema([("id", pa.int32()), ("n", pa.int64())]), np.zeros(0, np.int64)
    for (body,) in S.rows_of(found):
        ids, n = np.frombuffer(body, "<i8").reshape(2, -1)
        if len(seen) <= ids[-1]:
            seen = np.concatenate([seen, np.zeros(ids[-1] + 1 - len(seen), np.int64)])
        seen[ids] += n
    used = np.flatnonzero(seen)
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(seen[used], pa.int64())], schema=schema)


def read_file(file: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """(key, ids before it in the file, its ids) of each document of a file."""
    store, path = S.filesystem(file)
    beside, at = f"{path.rpartition('/')[0]}/ranks.bin", 0
    with store.open_input_stream(beside, compression=None) as source:
        order = np.frombuffer(source.read(), "<u4")
    with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as source:
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"no token file: {file}")
        while head := source.read(struct.calcsize(_HEAD)):
            n_docs, n_ids, n_control, n_data = struct.unpack(_HEAD, head)
            keys = np.frombuffer(source.read(8 * n_docs), "<i8")
            lengths = np.frombuffer(source.read(4 * n_docs), "<u4").astype(np.int64)
            ids = order[decode_ranks(source.read(n_control), source.read(n_data), n_ids)]
            ends = np.cumsum(lengths)
            for key, begin, end in zip(keys.tolist(), (ends - lengths).tolist(), ends.tolist()):
                yield key, at + begin, ids[begin:end]
            at += n_ids


def read_tokens(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """Documents of the files: key, start (ids of all documents before it),
    n_tokens, ids (little-endian unsigned 32-bit), or for a digest ids_crc32 of
    the same bytes in their stead.  One task reads a file."""
    last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])
    own = (lambda ids: zlib.crc32(ids)) if digest else (lambda ids: ids.tobytes())

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for file, start in S.rows_of(found):
                for key, before, ids in read_file(file):
                    yield None if key == _NULL else key, start + before, len(ids), own(ids)

        yield from S.batches(rows(), schema)

    n = max(1, manifest.count())
    return manifest.select("file", "start").repartition(n, "file").mapInArrow(run, f"key long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's place, length and checksum, from the files."""
    manifest = write_tokens(S.table(spark, sf_dir, "documents"), S.scratch(spark, "op2"), T.default_path(), 2)
    return read_tokens(manifest, digest=True).withColumnRenamed("key", "doc_id")
