"""Sharding by balanced label propagation.

Documents of equal text are linked (each to its group, as a star: no pairs are
made).  Every document starts in the shard that its own hash names.  In each round a
group's documents are counted by shard; a document prefers the shard that holds most
of its group (of a large group: most, of the shards with room for it); the moves that all shards ask for of each other are weighed against the
shards' quotas, and that share of each flow which fits is carried out, chosen by a
hash of the group (of the document, where a group is large).  An edge is cut if a
document is not in the shard that holds most of its group.  Rounds end when no move
is asked for or allowed.  What then lies in a shard beyond its quota is let go, by
whole groups (or parts of groups too large for that).  It and the documents without
links, which have no edge to cut, fill what is left of each quota, by running size, so
the law ``bytes`` holds: no shard is over its quota by more than a document.

A group of more than a ``HOT``-th of all rows is joined in slices, so that no key
holds more rows than that; there are fewer than ``HOT`` such groups to broadcast.  The
driver sees shard x shard sums, one sum a task, and the few documents larger
than a 512th of a quota.  Defined results: null text has size 1 and is linked
with nothing; null and repeated ids are placed by row; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared as S

SHARDS, ROUNDS = 16, 8
#: Largest share of all rows that one join key holds: a HOT-th.
HOT = 256
#: Unlinked documents of more than quota / LARGE are placed one by one, largest first.
LARGE = 512
#: Hash places by which a shard's groups are let go; larger groups than quota / PARTS go in parts.
PLACES, PARTS = 4096, 16
_UNIT = 1 << 30


def _unit(*cols) -> F.Column:
    """A hash as a number from 0 to under 1."""
    return F.pmod(F.xxhash64(*cols), F.lit(_UNIT)) / F.lit(float(_UNIT))


def allowed_flow(wanted: np.ndarray, load: np.ndarray, quota: float) -> np.ndarray:
    """Share of each wanted flow (from, to) that keeps loads within the quota.

    Flows are taken as far as the target's room allows, where what leaves a shard
    in this round makes room in it; two sweeps give swaps their chance."""
    share = np.zeros_like(wanted)
    room = np.maximum(quota - load, 0.0)
    for _ in range(4):
        left = wanted * (1 - share)
        for to in np.argsort(-left.sum(0), kind="stable"):
            asked = left[:, to].sum()
            if asked > 0 and room[to] > 0:
                part = min(1.0, room[to] / asked)
                moved = left[:, to] * part
                share[:, to] += np.divide(moved, wanted[:, to], out=np.zeros(len(load)), where=wanted[:, to] > 0)
                room[to] -= moved.sum()
                room += moved
                left[:, to] -= moved
    return np.clip(share, 0, 1)


def large_targets(held: dict[bytes, dict[int, float]], load: np.ndarray, quota: float) -> dict[bytes, int]:
    """The shard that each large group is drawn to: that which holds most of it, of
    those with room for all of it; the one with most room where there is none.

    ``held``: bytes by group and shard; ``load``: bytes of other linked rows by shard."""
    room, out = quota - load, {}
    for g, by in sorted(held.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        size = sum(by.values())
        fits = [s for s in range(len(load)) if room[s] >= size * (1 - 1e-9)]
        out[g] = max(fits, key=lambda s: (by.get(s, 0), -s)) if fits else int(room.argmax())
        room[out[g]] -= min(size, max(room[out[g]], 0))
    return out


def propagate(linked: DataFrame, quota: float, shards: int, rounds: int, folder: str, report: list | None = None) -> DataFrame:
    """Rounds over (.., g, slice, fan, bytes, size, salt, shard); returns the same columns.

    ``report`` gets (edges cut, bytes moved) of each round, the last with none moved."""
    for k in range(rounds + 1):
        held = S.saved(linked.groupBy("g", "shard").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("rows"), F.max("fan").alias("fan"), F.max("bytes").alias("bytes")), f"{folder}/held{k}")
        best = F.max_by(F.struct("shard", "rows"), F.struct("held", -F.col("shard"))).alias("best")
        most = S.saved(held.groupBy("g").agg(best, F.sum("rows").alias("rows"), F.max("fan").alias("fan")), f"{folder}/best{k}")
        cut = most.agg(F.sum(F.col("rows") - F.col("best.rows"))).first()[0] or 0
        if k == rounds or not cut:
            break
        # Fewer than shards x PARTS groups are large: their targets are found together.
        large, small = {}, np.zeros(shards)
        for row in held.filter(F.col("bytes") > quota / PARTS).select("g", "shard", "held").collect():
            large.setdefault(bytes(row.g), {})[row.shard] = row.held
        for row in held.filter(F.col("bytes") <= quota / PARTS).groupBy("shard").agg(F.sum("held").alias("held")).collect():
            small[row.shard] = row.held
        target = held.sparkSession.createDataFrame(list(large_targets(large, small, quota).items()), "g binary, target int")
        chosen = most.join(F.broadcast(target), "g", "left").withColumn("best", F.coalesce("target", "best.shard"))
        slices = chosen.select("g", "best", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("slice"))
        asked = linked.join(slices.hint("merge"), ["g", "slice"])
        flow = np.zeros((shards, shards))
        for row in asked.groupBy("shard", "best").agg(F.sum("size").alias("held")).collect():
            flow[row.shard, row.best] = row.held
        load = flow.sum(1)
        np.fill_diagonal(flow, 0)
        share = allowed_flow(flow, load, quota)
        if (flow * share).sum() < 1e-4 * load.sum():
            break
        # A group's part moves whole; a part of a group that is large for a shard moves by document.
        whole = F.col("bytes") <= quota / PARTS
        chance = F.when(whole, _unit("g", F.lit(k))).otherwise(_unit("g", "salt", F.lit(k)))
        limit = F.get(F.array(*(F.lit(float(x)) for x in share.ravel())), F.col("shard") * shards + F.col("best"))
        moved = asked.withColumn("shard", F.when(chance < limit, F.col("best")).otherwise(F.col("shard"))).select(*linked.columns)
        if report is not None:
            report.append((int(cut), float((flow * share).sum())))
        linked = S.saved(moved, f"{folder}/round{k}")
        for name in ("best", "held"):
            S.drop(linked.sparkSession, f"{folder}/{name}{k}")
        if k:
            S.drop(linked.sparkSession, f"{folder}/round{k - 1}")
    if report is not None:
        report.append((int(cut), 0.0))
    return linked


def within_quota(linked: DataFrame, quota: float, shards: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(rows that stay, rows let go, bytes that stay by shard): no shard is over its quota.

    The driver sees bytes by shard and hash place.  Rows let go are salted by
    their group, so that those of one are placed together."""
    parts = F.ceil(F.col("bytes") / F.lit(max(quota / PARTS, 1.0))).cast("int")
    unit = F.xxhash64("g", F.pmod(F.col("salt"), parts))
    held = linked.withColumn("unit", unit).withColumn("place", F.pmod("unit", F.lit(PLACES)).cast("int"))
    sums = np.zeros((shards, PLACES))
    for row in held.groupBy("shard", "place").agg(F.sum("size").alias("bytes")).collect():  # shards x PLACES rows at most
        sums[row.shard, row.place] = row.bytes
    stays = np.ones(sums.shape, bool)
    for shard in np.flatnonzero(sums.sum(1) > quota):
        stays[shard] = np.cumsum(sums[shard]) <= quota
    gone = F.lit(False)
    for shard in np.flatnonzero(~stays.all(1)):
        gone = gone | ((F.col("shard") == int(shard)) & (F.col("place") >= int(np.argmin(stays[shard]))))
    return held.filter(~gone).select("key", "size", "crc", "shard"), held.filter(gone).select("key", "size", "crc", F.col("unit").alias("salt")), (sums * stays).sum(1)


def _running(edges: list[tuple[float, int]], before: dict[int, int]):
    """Places documents by running size: ``edges`` are (end of a segment, shard)."""
    ends, shard_of = np.array([e for e, _ in edges]), [s for _, s in edges]
    schema = pa.schema([("key", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("shard", pa.int32())])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            at = None
            for key, size, crc, bucket in S.rows_of(found):
                if bucket != at:  # a bucket's rows are together: its sum is known
                    at, total = bucket, before[bucket]
                where = min(int(np.searchsorted(ends, total + size / 2, "right")), len(ends) - 1)
                yield key, size, crc, shard_of[where]
                total += size

        yield from S.batches(rows(), schema)

    return run


def _slots(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), {}
    schema = pa.schema([("key", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("shard", pa.int32()), ("part", pa.int32()), ("nth", pa.int64())])

    def rows():
        for key, size, crc, shard in S.rows_of(found):
            nth = seen.get(shard, 0)
            seen[shard] = nth + 1
            yield key, size, crc, shard, part, nth

    yield from S.batches(rows(), schema)


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, key: str = "doc_id", text: str = "text", report: list | None = None) -> DataFrame:
    """key, size, crc (of the text), shard and slot (gapless in a shard) of each row."""
    spark = docs.sparkSession
    folder = S.scratch(spark, "shards")
    body = F.col("text").cast("binary")
    base = S.columns(docs, **{key: "long", text: "string"}).toDF("key", "text").select(
        "key", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("crc"), F.unhex(F.md5(body)).alias("g"))
    base = S.saved(base.withColumn("salt", F.xxhash64("key", "crc", F.monotonically_increasing_id())), f"{folder}/base")
    total, n_rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    quota = total / shards
    groups = base.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).filter("g is not null and n > 1")
    groups = S.saved(groups.select("g", "bytes", F.ceil(F.col("n") * HOT / F.lit(max(n_rows, 1))).cast("int").alias("fan")), f"{folder}/groups")
    hot = F.broadcast(groups.filter("fan > 1").select("g", F.col("fan").alias("_fan")))  # fewer than HOT
    slices = groups.select("g", "bytes", "fan", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("slice"))
    rows = base.join(hot, "g", "left").withColumn("slice", F.pmod("salt", F.coalesce("_fan", F.lit(1))).cast("int")).drop("_fan")
    rows = S.saved(rows.join(slices.hint("merge"), ["g", "slice"], "left"), f"{folder}/rows")
    start = F.pmod(F.xxhash64("salt"), F.lit(shards)).cast("int")
    linked = propagate(rows.filter("bytes is not null").withColumn("shard", start), quota, shards, rounds, folder, report)
    linked, gone, load = within_quota(linked, quota, shards)
    single = rows.filter("bytes is null").select("key", "size", "crc", "salt").unionByName(gone)
    # Fewer than shards * LARGE documents are larger than quota / LARGE, as all have shards * quota bytes.
    cut = max(1, int(quota / LARGE))
    placed = []
    for row in single.filter(F.col("size") > cut).orderBy(F.desc("size"), "salt", "key").collect():
        to = int(load.argmin())
        load[to] += row.size
        placed.append((row.key, row.size, row.crc, to))
    large = spark.createDataFrame(placed, "key long, size long, crc long, shard int")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = single.filter(F.col("size") <= cut).withColumn("bucket", F.pmod("salt", F.lit(8 * n)).cast("int"))
    sums = sorted((r.bucket, r.bytes) for r in small.groupBy("bucket").agg(F.sum("size").alias("bytes")).collect())
    before, at = {}, 0
    for bucket, size in sums:
        before[bucket] = at
        at += size
    need = np.maximum(quota - load, 0)
    need = need * (at / need.sum()) if need.sum() > 0 else np.full(shards, at / shards)
    edges = [(float(e), s) for s, e in enumerate(np.cumsum(need))]
    run = _running(edges, before)
    small = small.repartition(n, "bucket").sortWithinPartitions("bucket", "salt", "key").select("key", "size", "crc", "bucket").mapInArrow(run, "key long, size long, crc long, shard int")
    everything = linked.select("key", "size", "crc", "shard").unionByName(large).unionByName(small)
    rows = S.saved(everything.mapInArrow(_slots, "key long, size long, crc long, shard int, part int, nth long"), f"{folder}/slots")
    # One row a task and shard: where a task's rows begin in a shard.
    by_part = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(by_part), F.lit(0)))
    return rows.join(starts.select("shard", "part", "before"), ["shard", "part"]).select("key", "size", "crc", "shard", (F.col("before") + F.col("nth")).alias("slot"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every document's shard under the law ``bytes``."""
    out = shard_documents(S.table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
