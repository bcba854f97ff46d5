"""MinHash near-duplicates by tensored banding, every link verified.

A document is the set of its distinct shingles (of ``width`` words).  Documents of
equal sets are one node from the start.  Two collections of ``half`` half-keys,
``rows`` minhashes each, are computed; a table's key is a pair of half-keys, one
of each collection.  So half x half tables of 2 x rows minhashes cost 2 x half x
rows minhashes, and a pair of Jaccard similarity s meets in some table with
probability (1 - (1 - s^rows)^half)^2: 0.9996 at 0.8 and 0.99998 at 0.85 for the
defaults, more for a group, which many pairs link.

No bucket is gathered and none gives all its pairs.  A bucket is joined to its
pivot, the member that meets most others, and every member's distance to its
pivots is measured on the full sets of actual shingles; that confirms links and
makes components.  In a bucket that still spans components, members whose
distances to the pivot differ by more than a link's can't be linked (Jaccard
distance is a metric): members are put in overlapping cells by distance, cells of
one component are done with.  What is left meets by half-key, in blocks of bounded
size, by the rarest differences to one of its members (see linked()), which loses no
link; of the links there a spanning forest is told and confirmed.
Components come from alternating large and small stars.  All is joins and
aggregates over ids, cut by written tables; a hot key is split by the optimiser.

Defined results: letters A-Z count as a-z; a text of fewer words than ``width``
is one shingle; null and wordless texts have the empty set and link with nothing,
as have null ids (component null, kept); rows of one id are one document, linked
by any of their texts; no rows give no rows; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared as S

WIDTH, PERCENT = 2, 80
#: Half-keys of a collection, and minhashes of a half-key.
HALF, ROWS = 12, 3
#: Members of a block, and shingles of a block (on average of its group's blocks).
GROUP, BLOCK_SHINGLES = 1 << 14, 1 << 20
#: Sets that are multiplied at most, and pairs (or shingles of them) looked at in one go.
FEW, MET = 128, 1 << 20
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Word -> 64-bit hash; a bounded memo."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Signer:
    """Sets and half-keys of texts."""

    def __init__(self, width: int, half: int, rows: int):
        self.width, self.half, self.rows, self.hashes = width, half, rows, _Hashes()
        seeds = _mix(np.arange(1, 2 * half * rows + 1, dtype=np.uint64) * _MULTIPLY)
        self.factors, self.shifts = seeds | np.uint64(1), _mix(seeds)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of a text's shingles."""
        found = S.lower_words(text)
        if not found:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))
        n = max(1, len(h) - self.width + 1)
        x = np.full(n, len(h) if len(h) < self.width else self.width, np.uint64)
        for k in range(min(self.width, len(h))):
            x = _mix(x * _MULTIPLY + h[k : k + n])
        return np.unique(x)

    def half_keys(self, shingles: np.ndarray) -> np.ndarray:
        """2 x half keys; each folds ``rows`` minhashes and its own number."""
        low = np.full(len(self.factors), np.uint64(0xFFFFFFFFFFFFFFFF))
        for at in range(0, len(shingles), 4096):
            part = shingles[at : at + 4096]
            low = np.minimum(low, (part[None, :] * self.factors[:, None] + self.shifts[:, None]).min(1))
        keys = np.arange(2 * self.half, dtype=np.uint64)
        for k in range(self.rows):
            keys = _mix(keys * _MULTIPLY + low[k :: self.rows])
        return keys.view(np.int64)


def _sign(width: int, half: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(width, half, rows)

        def each():
            for key, text in S.rows_of(found):
                x = signer.shingles(text)
                if len(x):
                    keys = signer.half_keys(x).tolist()
                    yield key, len(x), xxhash.xxh3_128_digest(x.tobytes()), keys[:half], keys[half:]
                else:
                    yield key, 0, None, None, None

        yield from S.batches(each(), schema)

    return run, "doc_id long, n long, digest binary, a array<long>, b array<long>"


def shingle_set(text: str | None, width: int) -> set:
    """The actual set: tuples of words."""
    w = S.lower_words(text)
    return set(zip(*(w[k:] for k in range(width)))) if len(w) >= width else {tuple(w)} if w else set()


def _confirm(width: int, percent: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("distance", pa.float64()), ("link", pa.bool_())])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links():
            last, b = None, set()
            for u, v, text_u, text_v in S.rows_of(found):
                if text_v != last:  # rows come by v: its set is made once
                    last, b = text_v, shingle_set(text_v, width)
                a = shingle_set(text_u, width)
                both = len(a & b)
                either = max(1, len(a) + len(b) - both)
                yield u, v, 1 - both / either, bool(a) and 100 * both >= percent * either

        yield from S.batches(links(), schema)

    return run


class Linker:
    """Verifies edges and keeps components, in written tables of one folder."""

    def __init__(self, folder: str, width: int, percent: int):
        self.folder, self.width, self.percent, self.step = folder, width, percent, 0
        self.links: DataFrame | None = None
        self.labels: DataFrame | None = None

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.step += 1
        return S.saved(df, f"{self.folder}/{self.step:03d}-{name}")

    def confirm(self, edges: DataFrame, texts: DataFrame) -> DataFrame:
        """Measures the edges (u, v) and adds those that are links.

        Returns u, v, distance, link.  Texts are dealt out by id, to both ends by
        the same exchange; edges come to their ends by merge, whatever their number."""
        left = edges.join(texts.hint("merge"), edges.u == texts.doc_id).select("u", "v", F.col("text").alias("text_u"))
        right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v"))
        both = left.join(right.hint("merge"), "v").select("u", "v", "text_u", "text_v")
        found = self.save(both.mapInArrow(_confirm(self.width, self.percent), "u long, v long, distance double, link boolean"), "measured")
        self.add(found.filter("link").select("u", "v"))
        return found

    def add(self, links: DataFrame) -> None:
        """Makes the components anew with more links (u, v)."""
        self.links = links if self.links is None else self.links.unionByName(links)
        self.labels = self.components(self.links)

    def components(self, links: DataFrame) -> DataFrame:
        """(node, label): every linked node's smallest reachable node."""
        edges = self.save(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
        last = None
        while True:
            state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == last:
                break
            last = state
            # Large star: all larger neighbours of a node to its smallest neighbour (or itself).
            around = edges.union(edges.select("v", "u"))
            least = around.groupBy("u").agg(F.min("v").alias("m"))
            large = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()
            # Small star: a node's smaller neighbours, and itself, to the smallest of them.
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
            edges = self.save(small, "edges")
        return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))

    def labelled(self, df: DataFrame, node: str, label: str) -> DataFrame:
        """``df`` with the component of a node column (itself where unlinked)."""
        if self.labels is None:
            return df.withColumn(label, F.col(node))
        found = self.labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
        return df.join(found, F.col(node) == F.col("_node"), "left").withColumn(label, F.coalesce("_label", node)).drop("_node", "_label")


def across(members: DataFrame, measured: DataFrame, linker: Linker, percent: int) -> DataFrame:
    """Members (node, label) that may have links to other components.

    ``members``: key, node, n, pivot, pn; ``measured``: their distances.  A member
    whose size rules a link with the pivot out has a distance from 1 - the sizes'
    ratio to 1, and so more cells."""
    step = 1 - percent / 100 + 1e-9
    known = measured.select(F.col("u").alias("node"), F.col("v").alias("pivot"), "distance")
    spread = linker.labelled(members, "node", "label")
    open_ = spread.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    held = spread.join(open_.hint("merge"), "key", "left_semi").join(known.hint("merge"), ["node", "pivot"], "left")
    least = F.when(F.col("node") == F.col("pivot"), 0.0).otherwise(F.coalesce("distance", 1 - F.least("n", "pn") / F.greatest("n", "pn")))
    most = F.when(F.col("node") == F.col("pivot"), 0.0).otherwise(F.coalesce("distance", F.lit(1.0)))
    cells = held.select("key", "node", "n", "label", F.floor(least / step).cast("int").alias("first"), (F.floor(most / step) + 1).cast("int").alias("last"))
    cells = linker.save(cells, "cells").withColumn("cell", F.explode(F.sequence("first", "last")))
    # A cell of one component is done with.
    mixed = cells.groupBy("key", "cell").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key", "cell")
    return cells.join(mixed.hint("merge"), ["key", "cell"], "left_semi").select("node", "label").distinct()


class _Groups:
    """Groups of members, put together by links; tells those links that do (a spanning forest)."""

    def __init__(self, label: np.ndarray):
        _, self.of = np.unique(label, return_inverse=True)
        self.above = list(range(int(self.of.max()) + 1))

    def root(self, g: int) -> int:
        while self.above[g] != g:
            self.above[g] = g = self.above[self.above[g]]
        return g

    def join(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links of members a and b -> those between groups that were apart."""
        _, one = np.unique(self.of[a] * len(self.above) + self.of[b], return_index=True)
        for u, v in zip(a[one].tolist(), b[one].tolist()):
            x, y = self.root(self.of[u]), self.root(self.of[v])
            if x != y:
                self.above[max(x, y)] = min(x, y)
                yield u, v
        self.of = np.fromiter(map(self.root, range(len(self.above))), np.int64, len(self.above))[self.of]


def _met(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members that share an element, of two lists (elements, members), in parts of about ``MET``."""
    order = np.argsort(right[0], kind="stable")
    element, member = right[0][order], right[1][order]
    low = np.searchsorted(element, left[0], "left")
    many = np.searchsorted(element, left[0], "right") - low
    some = np.flatnonzero(many)
    low, many, own = low[some], many[some], left[1][some]
    end = np.cumsum(many)
    at = 0
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + MET, "right")))
        n = many[at:to]
        yield np.repeat(own[at:to], n), member[np.arange(n.sum()) + np.repeat(low[at:to] - np.cumsum(n) + n, n)]
        at = to


def linked(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links between sets that put together all labels that links of these sets do.

    ``side``: -1, or two blocks of which only links from one to the other are asked for.

    Few sets are multiplied.  Of many, each is held as its difference D(x) to the set p of
    what most of them have.  x and y are linked where the difference between x and y is at
    most c(|x| + |y|), with c = (100 - percent) / (100 + percent).  Let e(x) = |D(x)| - c|x|.
    Those with e(x) + e(y) <= 0 are linked whatever D(x) and D(y) are, and both to the member
    of the least e, which gathers them (the core).  Other links share (e(x) + e(y)) / 2
    differences to p at least.  So pairs meet by the rarest of their differences, as many as
    that leaves open; of copies that each had a word changed, by the words that came in.
    No link is lost."""
    n, size, groups = len(sets), np.array([len(x) for x in sets]), _Groups(label)
    owner = np.repeat(np.arange(n), size)
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = np.flatnonzero(times > 1)  # a shingle of one member meets no other
    if n <= FEW or n <= 16 * FEW and n * n * len(often) <= 1 << 34:  # some seconds at most
        column = np.full(len(values), -1)
        column[often] = np.arange(len(often))
        place = column[place]
        both = np.zeros((n, n))
        for at in range(0, len(often), 4096):
            some = (place >= at) & (place < at + 4096)
            cells = np.zeros((n, min(4096, len(often) - at)), np.float32)
            cells[owner[some], place[some] - at] = 1
            both += cells @ cells.T
        either = size[:, None] + size[None, :] - both
        apart = (groups.of[:, None] != groups.of[None, :]) & ((side[:, None] < 0) | (side[:, None] != side[None, :]))
        yield from groups.join(*np.nonzero(np.triu((100 * both >= percent * either) & apart, 1)))
        return
    in_p = times * 2 > n
    number = np.cumsum(in_p) - 1
    kept = in_p[place]
    lacks = np.ones((n, int(in_p.sum())), bool)
    lacks[owner[kept], number[place[kept]]] = False
    lacking, what = np.nonzero(lacks)
    who, element = np.concatenate([owner[~kept], lacking]), np.concatenate([place[~kept], np.flatnonzero(in_p)[what]])
    # Differences, a member's rarest first: one sorted number for each.
    seen = np.bincount(element, minlength=len(values))
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(seen, kind="stable")] = np.arange(len(values))
    seen = np.sort(seen)
    codes = np.sort(who * len(values) + rank[element])
    del lacks, lacking, what, kept, owner, place, rank
    who, element = codes // len(values), codes % len(values)
    far = np.bincount(who, minlength=n)
    start = np.cumsum(far) - far
    up, down = 100 + percent, 100 - percent
    e = up * far - down * size  # whole numbers: up times the e above
    middle = int(e.argmin())
    core = e + e[middle] <= 0
    ends = np.flatnonzero(core & (groups.of != groups.of[middle]))
    yield from groups.join(ends, np.full(len(ends), middle))
    if core.all():
        return
    bits = np.zeros((n, 4), np.uint64)
    mixed = _mix(element.astype(np.uint64))
    np.bitwise_xor.at(bits, (who, (mixed & np.uint64(3)).astype(np.int64)), np.uint64(1) << (mixed >> np.uint64(58)))
    at = np.arange(len(who)) - start[who]
    again = seen[element] > 1

    def rarest(which: np.ndarray, e_other: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Differences of some members that one of those shared with a member of that e, or more, is among."""
        shared = np.maximum(1, -(-(e + e_other) // (2 * up)))
        some = again & which[who] & (at <= (far - shared)[who])
        return element[some], who[some]

    rest = int(e[~core].min())
    # The core meets the rest; of two of the rest, that of the lower e counts on the other's.
    meetings = [(rarest(core, rest), rarest(~core, int(e[middle])))] if core.any() else []
    meetings.append((rarest(~core, e), rarest(~core, rest)))
    for one, other in meetings:
        for x, y in _met(one, other):
            ok = (groups.of[x] != groups.of[y]) & (e[x] <= e[y])
            if side[0] >= 0:
                ok &= side[x] != side[y]
            x, y = x[ok], y[ok]
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(1)  # at most the difference between x and y
            ok = up * apart.astype(np.int64) <= down * (size[x] + size[y])
            pair = np.unique(x[ok] * n + y[ok])
            x, y = pair // n, pair % n
            x, y = np.where(far[x] <= far[y], x, y), np.where(far[x] <= far[y], y, x)
            end, i = np.cumsum(far[x]), 0
            while i < len(x):
                j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + MET, "right")))
                u, v = x[i:j], y[i:j]
                m = far[u]
                asked = np.repeat(v, m) * len(values) + element[np.arange(m.sum()) + np.repeat(start[u] - np.cumsum(m) + m, m)]
                found = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
                overlap = np.bincount(np.repeat(np.arange(j - i), m), codes[found] == asked, j - i).astype(np.int64)
                ok = up * (far[u] + far[v] - 2 * overlap) <= down * (size[u] + size[v])
                yield from groups.join(u[ok], v[ok])
                i = j


def _block_pairs(percent: int):
    """Groups of one half-key, at most two blocks of members -> links that put components together.

    Sets are of 64-bit hashes, as everywhere here but in what confirms links."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def pairs(members: list[tuple]) -> Iterator[tuple[int, int]]:
        node, label = (np.array([m[k] for m in members], np.int64) for k in (0, 1))
        side = np.array([m[2] for m in members])
        for i, j in linked([np.frombuffer(m[3], np.uint64) for m in members], label, side, percent):
            yield int(min(node[i], node[j])), int(max(node[i], node[j]))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            at, held = None, []
            for key, low, high, *member in S.rows_of(found):
                if (key, low, high) != at:
                    if len(held) > 1:
                        yield from pairs(held)
                    at, held = (key, low, high), []
                held.append(member)
            if len(held) > 1:
                yield from pairs(held)

        yield from S.batches(each(), schema)

    return run


def _sets(width: int, half: int, rows: int):
    schema = pa.schema([("node", pa.int64()), ("keys", pa.list_(pa.int64())), ("members", pa.binary())])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(width, half, rows)

        def each():
            for node, text in S.rows_of(found):
                x = signer.shingles(text)
                yield node, signer.half_keys(x)[:half].tolist(), x.tobytes()

        yield from S.batches(each(), schema)

    return run


def in_blocks(open_: DataFrame, texts: DataFrame, linker: Linker, half: int, rows: int) -> DataFrame:
    """Links (u, v) of open members (node, label) that put together what shares a half-key.

    Members meet by the half-keys of one collection, in blocks of about ``GROUP`` members
    and ``BLOCK_SHINGLES`` shingles at most: a larger group's blocks are dealt out two by
    two.  Tasks hold two blocks."""
    named = open_.select(F.col("node").alias("_node"))
    own = texts.join(named.hint("merge"), texts.doc_id == named["_node"], "left_semi").select("doc_id", "text")
    sets = linker.save(own.mapInArrow(_sets(linker.width, half, rows), "node long, keys array<long>, members binary"), "sets")
    size = (F.octet_length("members") / 8).alias("n")
    places = sets.select("node", "keys", size).join(open_.hint("merge"), "node").select("node", "label", "n", F.posexplode("keys").alias("i", "x")).select("node", "label", "n", F.xxhash64("i", "x").alias("key"))
    mixed = places.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).filter("lo <> hi").select("key", F.ceil(F.greatest(F.col("size") / GROUP, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    held = places.drop("n").join(mixed.hint("merge"), "key").withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    # A group of one block is a pair (0, 0) of side -1; else block b goes to all pairs (b, other).
    held = held.withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    held = held.select("node", "label", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.when(F.col("block") == F.col("other"), -1).otherwise(F.when(F.col("block") < F.col("other"), 0).otherwise(1)).alias("side"))
    n = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.join(sets.select("node", "members").hint("merge"), "node").repartition(n, "key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    found = dealt.select("key", "low", "high", "node", "label", "side", "members").mapInArrow(_block_pairs(linker.percent), "u long, v long")
    return found.distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, half: int = HALF, rows: int = ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    spark = docs.sparkSession
    folder = S.scratch(spark, "near")
    held = S.columns(docs, **{key: "long", text: "string"}).toDF("doc_id", "text")
    run, schema = _sign(width, half, rows)
    signed = S.saved(held.mapInArrow(run, schema), f"{folder}/signed")
    named = signed.filter("n > 0 and doc_id is not null")
    # Equal sets are one node, named by its smallest id; tasks aggregate a hot set before it is dealt out.
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = S.saved(named.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")).repartition(n_parts, "node"), f"{folder}/nodes")
    keys = nodes.select("node", "n", F.posexplode("a").alias("i", "x"), "b").select("node", "n", "i", "x", F.posexplode("b").alias("j", "y")).select(F.xxhash64("i", "x", "j", "y").alias("key"), "node", F.col("n").cast("int").alias("n"))
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = S.saved(keys.join(met.hint("merge"), "key").select("key", "node", "n", "m"), f"{folder}/shared")
    degree = shared.groupBy("node").agg(F.sum("m").alias("degree"))
    best = shared.join(degree.hint("merge"), "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"), F.col("n"))).alias("p"))
    pivots = best.select("key", (-F.col("p.minus")).alias("pivot"), F.col("p.n").alias("pn"))
    members = S.saved(shared.join(pivots.hint("merge"), "key").select("key", "node", "n", "pivot", "pn"), f"{folder}/members")
    S.drop(spark, f"{folder}/shared")
    alike = F.least("n", "pn") * 100 >= F.greatest("n", "pn") * percent
    stars = members.filter(alike & (F.col("node") != F.col("pivot"))).select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()
    ends = members.select("node").distinct()
    texts = S.saved(held.join(ends.hint("merge"), held.doc_id == ends.node, "left_semi"), f"{folder}/texts")
    linker = Linker(folder, width, percent)
    stars = linker.save(stars, "stars")
    measured = linker.confirm(stars, texts)
    open_ = linker.save(across(members, measured, linker, percent), "open")
    pairs = linker.save(in_blocks(open_, texts, linker, half, rows), "pairs")
    if pairs.limit(1).count():
        ends = pairs.select(F.col("u").alias("end")).union(pairs.select(F.col("v").alias("end"))).distinct()
        linker.confirm(pairs, texts.join(ends.hint("merge"), texts.doc_id == ends.end, "left_semi"))
    # Rows of one id are one document: the nodes of its texts are linked.
    own = named.select("doc_id", "digest").distinct()
    several = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("doc_id")
    if several.limit(1).count():
        met = own.join(several.hint("merge"), "doc_id", "left_semi").join(nodes.select("digest", "node").hint("merge"), "digest")
        linker.add(met.select(F.col("node").alias("u"), F.col("doc_id").alias("v")))
    labels = S.saved(linker.labelled(nodes.select("digest", "node"), "node", "component_id").select("digest", "component_id"), f"{folder}/labels")
    for name in ("members", "texts", "nodes"):
        S.drop(spark, f"{folder}/{name}")
    out = signed.select("doc_id", "n", "digest").join(labels, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """Pipeline stage: one row of each group of near copies (shingles of five words), with
    its own columns: that of the smallest id, null ids last.

    Rows are judged, not ids: equal rows are copies of each other, and rows of one id
    with texts of their own stay.  Rows without words stay all."""
    spark = docs.sparkSession
    folder, row = S.scratch(spark, "rows"), "_row"
    while row in docs.columns:
        row = f"_{row}"
    numbered = S.saved(docs.withColumn(row, F.monotonically_increasing_id()), f"{folder}/numbered")
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), width, percent).select(F.col("doc_id").alias("row"), "component_id")
    ids = numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"))
    held = S.saved(found.join(ids.hint("merge"), "row"), f"{folder}/components")
    first = held.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = S.saved(held.join(first.select("component_id", F.col("first.row").alias("stays")).hint("merge"), "component_id").filter("row <> stays").select("row"), f"{folder}/gone")
    return numbered.join(gone, numbered[row] == gone["row"], "left_anti").drop(row)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: component of every document, by two-word shingles."""
    return near_duplicates(S.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
ids AS (SELECT g, row_number() OVER () AS k FROM (SELECT g FROM s GROUP BY g HAVING count(*) > 1)),
t AS (SELECT s.doc_id, ids.k, n.n FROM s JOIN ids USING (g) JOIN n USING (doc_id)),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM t a JOIN t b ON a.k = b.k AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(u, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach.v) AS component_id, d.doc_id = min(reach.v) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.u = d.doc_id GROUP BY d.doc_id
"""
