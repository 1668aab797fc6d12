"""Similarity self-join of documents on word shingles, by signature trees.

* **Sets.** A document's set holds the hashes of its distinct shingles; documents with equal sets are one *class*, known
  by a 64-bit id (a second 64-bit hash detects two sets with one id; the run then starts again with another seed).
* **Regions.** No tree can span the corpus, so sets first meet in regions that lose no pair. Sizes fall into classes, and
  each class cuts the hash space into more ranges than two similar sets can differ in: such a pair agrees exactly in
  more than ``spare`` ranges. Each set sends the hash of each range that holds at least ``least`` shingles; it sends the
  emptier ones too only if it has more than ``spare`` of them, so at least one agreement always counts. Sets of up to
  ``SMALL`` shingles, too few for ranges, send the first shingles in hash order, of which similar sets share one.
  Sets that agree in a range form a *cell*.
* **Trees.** A tree's leaves are sets; its nodes hold the OR of token bitmaps and the size range. A traversal of node pairs
  drops those whose sizes or largest possible overlap cannot reach the threshold, and those already connected to each
  other throughout. Trees run twice: over the small bitmaps of a cell, which tells apart documents that only share a
  passage, and, exactly, over the *regions* (connected sets) that are left, cut into blocks of bounded size.
* **Large groups.** Of a *crowd*, more than ``CROWD`` sets of a cell in one task, only one set is sent, flagged, and stands for
  all. A cell with such a set, or of more than ``CELL`` sets, gets no tree: there the sets are put into one region without
  looking, since a crowd's bitmaps are not at hand. In a region, every block also meets the first block; sets still
  outside the region's largest component then meet all blocks. So every pair is compared unless its sets are connected
  already, which is all that components need; nothing is dropped.

Empty sets (null or empty text) are linked with nothing. Repeated rows share a class. A null ``doc_id`` never becomes a
component's name unless its documents have none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolore.llm import arrays as A
from repolore.llm.graph import components, star_pairs
from repolore.session import broadcast_if_small, cut_lineage

#: Shingles in a block and sets in a cell: bound what a tree holds. Sets of a cell that one task sends.
BLOCK, CELL, CROWD = 1_500_000, 20_000, 64
FANOUT = 8
#: Sets up to this size meet by their first shingles in hash order; larger ones by hash ranges.
SMALL = 32
_SMALL_SALT, _RANGE_SALT = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5851F42D4C957F2D)
_SET_DDL = "doc_id long, n_shingles long, h1 long, h2 long, sig binary"
_SET = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.binary())])
_BLOB = pa.schema([("bucket", pa.int32()), ("crowd", pa.bool_()), ("part", pa.binary()), ("id", pa.binary())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_MET = pa.schema([("cell", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_TOKENS = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("blob", pa.binary())])
#: Bits of the map that tells tasks which texts a region needs: at most 2 ** this, 8 MB.
MARKS = 26


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct ``k``-word shingles (A-Z lower-cased); fewer words make one shingle."""
    w = A.words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = A.hash_items(b" ".join(w).lower().split())
    return np.unique(A.window_hashes(h, min(k, len(h))))


def width_for(size: int) -> int:
    """Bits of a set's bitmap: a power of two, at least twice its size, from 256 to 65,536."""
    return 1 << min(max((2 * size - 1).bit_length(), 8), 16)


def bitmap(t: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(width, np.uint8)
    out[(t & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """The bitmap as it would be at a smaller width."""
    while len(bits) * 64 > width:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def _digest(t: np.ndarray, seed: int) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(t.tobytes(), seed)
    return tuple(x - (1 << 64) if x >> 63 else x for x in (d >> 64, d & ((1 << 64) - 1)))


def _sets(k: int, seed: int):
    def run(batches):
        for batch in batches:
            n, one, two, sig = [], [], [], []
            for text in batch.column("text").to_pylist():
                t = shingles(text, k)
                a, b = _digest(t, seed) if len(t) else (None, None)
                n.append(len(t))
                one.append(a)
                two.append(b)
                sig.append(bitmap(t, width_for(len(t))).tobytes() if len(t) else None)
            yield A.rows(_SET, {"doc_id": batch.column("doc_id").cast(pa.int64()), "n_shingles": n, "h1": one, "h2": two, "sig": sig})

    return run


class Ranges:
    """Size classes and the number of hash ranges in each, for a threshold of ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self._starts = [1]

    def start(self, c: int) -> int:
        while len(self._starts) <= c:
            self._starts.append(max(self._starts[-1] + 1, self._starts[-1] * 4 // 3))
        return self._starts[c]

    def of(self, size: int) -> int:
        c = 0
        while self.start(c + 1) <= size:
            c += 1
        return c

    def most(self, c: int) -> tuple[int, int, int]:
        """(ranges, spare, least): least shingles in a range that is always sent, and how many ranges may stay unsent."""
        top, low = self.start(c + 1) - 1, self.start(c)
        differ = (self.den - self.num) * 2 * top // (self.den + self.num)
        for least in (2, 1):
            ranges = differ + 3
            for _ in range(20):  # room for the ranges that hold fewer
                load = low / ranges
                ranges = differ + 3 + math.ceil(1.15 * ranges * math.exp(-load) * (1 + load * (least - 1)))
                if ranges > 1.4 * (differ + 4):
                    break
            else:
                break
        return ranges, ranges - differ - 1, least

    def classes(self, size: int) -> list[int]:
        """The set's own class and the larger ones in which a similar set can be."""
        if size <= SMALL:
            return []
        c, out = self.of(size), []
        largest = size * self.den // self.num
        while self.start(c) <= largest:
            out.append(c)
            c += 1
        return out


def parts(t: np.ndarray, ranges: Ranges, known: dict) -> list[np.ndarray]:
    """Hashes by which the set must be found."""
    out, size = [], len(t)
    if size * ranges.num <= SMALL * ranges.den:
        out.append(A.mix(t[: size + 1 + (-size * ranges.num // ranges.den)] + _SMALL_SALT))
    mixed = np.r_[np.uint64(0), np.cumsum(A.mix(t ^ _RANGE_SALT))]
    for c in ranges.classes(size):
        if c not in known:
            n, spare, least = ranges.most(c)
            cuts = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
            known[c] = spare, least, cuts, A.mix(np.arange(n, dtype=np.uint64) + np.uint64((c + 1) << 32))
        spare, least, cuts, salt = known[c]
        ends = np.r_[0, np.searchsorted(t, cuts), size]
        held = np.diff(ends)
        h = A.mix((mixed[ends[1:]] - mixed[ends[:-1]]) + salt)
        out.append(h[held >= least] if (held < least).sum() <= spare else h)
    return out


def _stars(h: np.ndarray, owner: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Distinct (least owner, owner) pairs of the runs of equal ``h`` among the rows ``where`` (sorted by h, owner)."""
    h, owner = h[where], owner[where]
    start, length = A.runs(h)
    first = np.repeat(owner[start], length)
    return np.unique(np.stack([first, owner], 1)[first != owner], axis=0)


def _cells(k: int, num: int, den: int, seed: int, n: int):
    """Packed buckets of (range hash, set id); of a crowd, the least id goes on, flagged, and the others are linked to it here."""

    def flush(hashes, ids):
        h, owner = np.concatenate(hashes), np.concatenate(ids)
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        start, length = A.runs(h)
        crowd = np.repeat(length > CROWD, length)
        edges = _stars(h, owner, crowd)
        if len(edges):
            yield A.rows(_BLOB, {"bucket": [-1], "crowd": [True], "part": [edges[:, 0].astype("<i8").tobytes()], "id": [edges[:, 1].astype("<i8").tobytes()]})
        go_on = ~crowd
        go_on[start] = True
        for flag in (False, True):
            use = go_on & (crowd == flag)
            part, own = h[use], owner[use]
            for b, i in A.by_bucket(A.bucket_of(part, n), n):
                yield A.rows(_BLOB, {"bucket": [b], "crowd": [flag], "part": [part[i].astype("<u4").tobytes() + (part[i] >> np.uint64(32)).astype("<u1").tobytes()], "id": [own[i].astype("<i8").tobytes()]})

    def run(batches):
        ranges, known = Ranges(num, den), {}
        hashes, ids, size, seen = [], [], 0, set()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                t = shingles(text, k)
                if not len(t):
                    continue
                h1 = _digest(t, seed)[0]
                if h1 in seen:
                    continue
                seen.add(h1)
                for h in parts(t, ranges, known):
                    hashes.append(h)
                    ids.append(np.full(len(h), h1, np.int64))
                    size += len(h)
                if size >= A.FLUSH:
                    yield from flush(hashes, ids)
                    hashes, ids, size, seen = [], [], 0, set()
        if hashes:
            yield from flush(hashes, ids)

    return run


def _meet(table: pa.Table) -> pa.Table:
    """Cells of one bucket with two sets or more, as (cell, a) rows; cells with equal members are one. Above the bound or with a crowd, edges."""
    low, high, flags = [], [], []
    for blob, flag in zip(table.column("part").to_pylist(), table.column("crowd").to_pylist(), strict=True):
        k = len(blob) // 5
        low.append(np.frombuffer(blob, "<u4", k))
        high.append(np.frombuffer(blob, "<u1", k, 4 * k))
        flags.append(np.full(k, flag))
    h = np.concatenate(low).astype(np.uint64) | (np.concatenate(high).astype(np.uint64) << np.uint64(32))
    owner = A.join_blobs(table, "id", "<i8")
    order = np.lexsort((owner, h))
    h, owner, crowd = h[order], owner[order], np.concatenate(flags)[order]
    crowd = np.logical_or.reduceat(crowd, A.runs(h)[0])  # by cell
    fresh = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
    h, owner = h[fresh], owner[fresh]
    start, length = A.runs(h)
    whole = crowd | (length > CELL)
    edges = _stars(h, owner, np.repeat(whole, length))
    use = (length > 1) & ~whole
    name = np.add.reduceat(A.mix(owner.view(np.uint64)), start) if len(start) else h
    _, once = np.unique(name[use], return_index=True)
    start, length, name = start[use][once], length[use][once], name[use][once]
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    member, cell = owner[np.repeat(start, length) + inside], A.signed(np.repeat(name, length))
    none = pa.nulls
    return pa.concat_tables([
        pa.table([pa.array(cell), pa.array(member), none(len(cell), pa.int64())], schema=_MET),
        pa.table([none(len(edges), pa.int64()), pa.array(edges[:, 0]), pa.array(edges[:, 1])], schema=_MET),
    ])


def _meet_or_pass(table: pa.Table) -> pa.Table:
    if table.column("bucket")[0].as_py() >= 0:
        return _meet(table)
    a, b = A.join_blobs(table, "part", "<i8"), A.join_blobs(table, "id", "<i8")
    return pa.table([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], schema=_MET)


class SignatureTree:
    """Sets as leaves; each node has the OR of its leaves' bitmaps, its sizes' range and its most bit collisions."""

    def __init__(self, size: np.ndarray, bits: np.ndarray, near: np.ndarray):
        """Leaves are ordered by size and ``near``, so that nodes hold alike sets."""
        self.order = np.lexsort((near, size))
        size, bits = size[self.order], bits[self.order]
        clash = size - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, size, size, clash)]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, clash = self.levels[-1]
            at = np.arange(0, len(bits), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(clash, at)))

    def may_link(self, level: int, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
        """Node pairs whose sizes and bitmaps allow a similar pair of leaves."""
        bits, low, high, clash = self.levels[level]
        least, most = np.maximum(low[x], low[y]), np.minimum(high[x], high[y])
        common = np.bitwise_count(bits[x] & bits[y]).sum(1).astype(np.int64) + np.minimum(clash[x], clash[y])
        need = -(-(low[x] + low[y]) * num // (num + den))
        return (den * most >= num * least) & (np.minimum(common, most) >= need)

    def links(self, num: int, den: int, parent: list[int], sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
        """Pairs (as numbered for the tree) that connect all that is similar and not yet joined in ``parent`` (by leaf).

        Without ``sets``, all pairs that the bitmaps allow count as similar.
        """

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        out, top = [], len(self.levels) - 1
        whole = [None] * (top + 1)  # per level: the one root of all leaves below a node, once it is known

        def joined(level, node):
            if level == 0:
                return root(node)
            store = whole[level]
            if store is None:
                store = whole[level] = {}
            if node in store:
                return root(store[node])
            first = node * FANOUT
            roots = {joined(level - 1, i) for i in range(first, min(first + FANOUT, len(self.levels[level - 1][0])))}
            if len(roots) != 1 or None in roots:
                return None
            store[node] = next(iter(roots))
            return store[node]

        def similar(i, j):
            if sets is None:
                return True
            a, b = sorted((sets[self.order[i]], sets[self.order[j]]), key=len)
            at = np.searchsorted(b, a)
            common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
            return den * common >= num * (len(a) + len(b) - common)

        stack = [(top, 0, 0)]
        while stack:
            level, x, y = stack.pop()
            if (one := joined(level, x)) is not None and one == joined(level, y):
                continue
            if level == 0:
                if similar(x, y):
                    out.append((int(self.order[x]), int(self.order[y])))
                    parent[root(x)] = root(y)
                continue
            last = len(self.levels[level - 1][0])
            xs, ys = (np.arange(i * FANOUT, min((i + 1) * FANOUT, last)) for i in (x, y))
            p, q = (m.ravel() for m in np.meshgrid(xs, ys, indexing="ij"))
            keep = p < q if level == 1 else p <= q
            if x != y:
                keep[:] = True
            p, q = p[keep], q[keep]
            keep = self.may_link(level - 1, p, q, num, den)
            pairs = sorted(zip(p[keep].tolist(), q[keep].tolist(), strict=True), key=lambda z: z[0] != z[1])
            stack.extend((level - 1, i, j) for i, j in reversed(pairs))  # a node with itself comes first: it joins what the rest can skip
        return out


def _solve(num: int, den: int, ids: list, blobs: list, labels: list, sizes: list) -> tuple[list, list]:
    """Links among one task's sets. ``sizes``: of the sets whose blobs are bitmaps; None where they are the sets."""
    first: dict[int, int] = {}
    keep = [i for i, x in enumerate(ids) if first.setdefault(x, i) == i]
    if len(keep) < 2:
        return [], []
    ids, labels, blobs, sizes = ([x[i] for i in keep] for x in (ids, labels, blobs, sizes))
    if sizes[0] is None:
        sets = [np.frombuffer(x, "<u8") for x in blobs]
        size = np.array([len(x) for x in sets])
        width = 2 * width_for(int(np.median(size)))
        bits, near = np.stack([bitmap(x, width) for x in sets]), np.array([x[0] for x in sets])
    else:
        sets, size = None, np.array(sizes)
        width = 8 * min(len(x) for x in blobs)
        bits = np.stack([fold(np.frombuffer(x, "<u8"), width) for x in blobs])
        near = bits[:, 0]
    tree = SignatureTree(size, bits, near)
    at: dict = {}
    parent = list(range(len(ids)))
    for place, i in enumerate(tree.order):
        if labels[i] is not None:
            parent[place] = at.setdefault(labels[i], place)
    found = tree.links(num, den, parent, sets)
    return [ids[a] for a, _ in found], [ids[b] for _, b in found]


def _trees(num: int, den: int):
    """Links inside each task of the sorted rows; rows with a ``label`` in common are joined already."""

    def run(batches):
        now, held, out = None, ([], [], [], []), ([], [])
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("task", "id", "blob", "label", "size")]
            for key, *values in zip(*cols, strict=True):
                if key != now:
                    for x, y in zip(out, _solve(num, den, *held), strict=True):
                        x.extend(y)
                    now, held = key, ([], [], [], [])
                for x, y in zip(held, values, strict=True):
                    x.append(y)
        for x, y in zip(out, _solve(num, den, *held), strict=True):
            x.extend(y)
        a, b = star_pairs(*out)
        yield A.rows(_EDGE, {"a": a, "b": b})

    return run


def _links(members: DataFrame, num: int, den: int) -> DataFrame:
    """``members``: task, id, blob, label, size."""
    n = A.n_buckets(members.sparkSession)
    dealt = members.select("task", "id", "blob", "label", "size").repartition(n, "task").sortWithinPartitions("task")
    return dealt.mapInArrow(_trees(num, den), "a long, b long")


def _tokens(k: int, seed: int, marks: bytes | None):
    """Sets of the texts whose key is marked; all without ``marks``."""

    def run(batches):
        bits = None if marks is None else np.frombuffer(marks, np.uint8)
        for batch in batches:
            if bits is not None:
                keys = batch.column("key").to_numpy().view(np.uint64)
                batch = batch.filter(pa.array(A.in_bitmap(bits, keys)))
            t = [shingles(x, k) for x in batch.column("text").to_pylist()]
            yield A.rows(_TOKENS, {"id": [_digest(x, seed)[0] if len(x) else None for x in t], "key": batch.column("key"), "blob": [x.astype("<u8").tobytes() for x in t]})

    return run


def _wanted_sets(texts: DataFrame, members: DataFrame, k: int, seed: int) -> DataFrame:
    """``id, key, blob`` of the texts with a ``key`` (of their doc_id) among those of ``members``, and of few others.

    The keys are marked in a bitmap that goes to the texts, so texts are not shuffled. Only where there are too many keys for
    it (one for every four bits) both sides meet in a join. An exact join on both columns has to follow.
    """
    keyed = texts.select(F.xxhash64("doc_id").alias("key"), "text")
    n = members.count()
    bits = min(MARKS, max(16, (32 * n).bit_length()))
    if 4 * n > 1 << bits:
        keyed, marks = keyed.join(members.select("key").distinct(), "key", "left_semi"), None
    else:
        marks = A.bitmap_of(members, "key", bits)
    return keyed.mapInArrow(_tokens(k, seed, marks), "id long, key long, blob binary")


def similar_components(docs: DataFrame, k: int = 3, threshold: tuple[int, int] = (90, 100), block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (columns ``doc_id, text``; others ignored).

    Documents link when ``den * intersection >= num * union``; the component's name is its least ``doc_id``.
    """
    num, den = threshold
    texts = A.with_text(docs, "doc_id")
    for seed in range(8):
        sets = cut_lineage(texts.mapInArrow(_sets(k, seed), _SET_DDL))
        classes = cut_lineage(sets.filter("n_shingles > 0").groupBy("h1").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"), F.min("sig").alias("sig"), F.min("h2").alias("lo"), F.max("h2").alias("hi")))
        if not classes.filter("lo <> hi").take(1):
            break
    else:
        raise RuntimeError("set ids clash under every seed")
    n = A.n_buckets(docs.sparkSession)
    none = F.lit(None).cast("long")
    sent = texts.mapInArrow(_cells(k, num, den, seed, n), "bucket int, crowd boolean, part binary, id binary")
    # the few edges found inside tasks take the same way as the buckets, so that texts are read once
    sent = sent.withColumn("deal", F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("id"), F.lit(n)) - n).otherwise(F.col("bucket")))
    met = cut_lineage(sent.groupBy("deal").applyInArrow(_meet_or_pass, "cell long, a long, b long"))
    cells = met.filter("cell is not null").select("cell", F.col("a").alias("h1")).distinct().join(classes.select("h1", "size", "sig"), "h1")
    near = _links(cells.select(F.col("cell").alias("task"), F.col("h1").alias("id"), F.col("sig").alias("blob"), none.alias("label"), "size"), num, den)
    region = components(near.union(met.filter("cell is null").select("a", "b")).distinct())
    links = cut_lineage(_region_links(texts, classes, region, k, seed, num, den, block))
    found = components(links)
    named = classes.select(F.col("h1").alias("id"), "doc_id").join(found, "id").groupBy("component").agg(F.min("doc_id").alias("name"))
    named = found.join(cut_lineage(named), "component").select(F.col("id").alias("h1"), "name")
    own = classes.select("h1", F.col("doc_id").alias("own")).join(named, "h1", "left").select("h1", F.coalesce("name", "own").alias("name"))
    out = sets.join(cut_lineage(own), "h1", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("name", "doc_id").alias("component_id"))


def _region_links(texts, classes, region, k, seed, num, den, block) -> DataFrame:
    region = region.select(F.col("id").alias("h1"), F.col("component").alias("region"))
    members = cut_lineage(classes.join(region, "h1").select("h1", F.xxhash64("doc_id").alias("key"), "size", "region"))
    # only the regions of several blocks: few, however many sets there are
    weight = cut_lineage(members.groupBy("region").agg(F.ceil(F.sum("size") / block).cast("int").alias("blocks")).filter("blocks > 1"))
    members = members.join(broadcast_if_small(weight), "region", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.withColumn("block", F.pmod(F.xxhash64("h1", F.lit(7)), F.col("blocks")).cast("int"))
    tokens = _wanted_sets(texts, members, k, seed)
    held = cut_lineage(tokens.join(members.select(F.col("h1").alias("id"), "key", "region", "blocks", "block"), ["id", "key"]).drop("key"))
    task = lambda *x: F.xxhash64("region", *x)  # noqa: E731  a clash only puts two blocks into one tree
    none = F.lit(None).cast("long")
    own = held.select(task("block").alias("task"), "id", "blob", none.alias("label"), none.alias("size"))
    pivot = held.filter("blocks > 1 and block = 0").select(F.explode(F.sequence(F.lit(1), F.col("blocks") - 1)).alias("block"), "region", "id", "blob")
    links = _links(own.unionByName(pivot.select(task("block").alias("task"), "id", "blob", none.alias("label"), none.alias("size"))), num, den)
    if not weight.take(1):
        return links
    large = held.filter("blocks > 1")
    links = cut_lineage(links)
    now = components(links).select("id", F.col("component").alias("label"))
    large = cut_lineage(large.join(now, "id", "left").withColumn("label", F.coalesce("label", "id")))
    sizes = large.groupBy("region", "label").agg(F.count("*").alias("n"))
    main = cut_lineage(sizes.groupBy("region").agg(F.max_by("label", F.struct("n", "label")).alias("main")))
    out = large.join(main, "region").filter("label <> main")
    weight = cut_lineage(out.groupBy("region").agg(F.ceil(F.sum(F.octet_length("blob")) / 8 / block).cast("int").alias("outs")))
    if not weight.take(1):
        return links
    pair = lambda a, b: F.xxhash64("region", F.lit("out"), a, b)
    out = out.join(weight, "region").withColumn("out", F.pmod(F.xxhash64("id", F.lit(11)), F.col("outs")).cast("int"))
    left = out.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(pair("j", "out").alias("task"), "id", "blob", "label", none.alias("size"))
    right = large.join(weight, "region").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("outs") - 1))).select(pair("block", "o").alias("task"), "id", "blob", "label", none.alias("size"))
    return links.unionByName(_links(left.unionByName(right), num, den))
