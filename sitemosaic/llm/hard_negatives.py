"""Hard-negative mining with an STR-packed R-tree over integer vectors and best-first search by inner product.

1. Vectors become integers, floor(unit * x) per component.
2. Sort-tile-recursive packing: rows are cut into slabs at quantiles of the coordinate of largest variance, each slab at those of the next one, and put in
   order (label, slab, slab, id) by a range shuffle, which splits a hot label or a vector with very many copies. Consecutive rows become pages of at
   most PAGE rows; inside a page two more coordinates order the rows into leaves of LEAF rows. Pages and leaves carry their minimum bounding boxes.
3. Over a box each coordinate of a query q contributes between min(q*lo, q*hi) and max(q*lo, q*hi); the sums bound the inner product of all rows in it.
4. A task holds some pages and streams query blocks. Best first: a queue hands out boxes by upper bound; a box is dropped if it lies outside every score
   window of its query, or strictly below the k-th score of every window that it meets (a tie may still win by id). Pages open into leaves, leaves into rows.
5. Each task gives its best k per query window; the lists of all tasks are merged per query window.

The search is exact: nothing is sampled or capped. Query blocks are copied to every group of pages; groups grow in number with the data, so that a task
holds GROUP_BYTES of vectors.

Rows with a null id, null label or null vector, or any null or non-finite component take no part, nor do rows with a component of 2^28 or more after scaling
(scores would leave 64 bits). Vectors of different lengths count as filled up with zeros; an empty vector scores 0. Repeated ids count once: the
row with the least label, then vector, stays. Ties in score go by smaller id. Only id, label and vector are read, so other columns cannot clash.
Empty tables give empty results.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, stored, tidy

PAGE, LEAF, BLOCK = 2048, 256, 128
GROUP_BYTES = 64 << 20
SLABS = 64          # most slabs per coordinate
EXACT = 1 << 52     # below it, sums of products are exact in doubles
PAGE_SCHEMA = "label int, n int, dims int, ids binary, q binary, low binary, high binary"


# -- vectors -----------------------------------------------------------------------
def quantised(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", unit: int = 256) -> DataFrame:
    """id, label, q: the rows that take part."""
    x = F.transform(F.col("v"), lambda c: F.floor(F.lit(float(unit)) * c))
    fine = F.forall("v", lambda c: F.coalesce(F.abs(c) * F.lit(float(unit)) < F.lit(float(1 << 28)), F.lit(False)))  # false for NaN, infinite and null
    part = rows.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("int").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    part = part.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(fine)
    one = part.select("id", "label", x.alias("q")).groupBy("id").agg(F.min(F.struct("label", "q")).alias("r"))
    return one.select("id", "r.label", "r.q")


def matrix(column, dims: int) -> np.ndarray:
    """Arrow lists as rows, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def spread(points: DataFrame) -> tuple[int, int, list[int]]:
    """Rows, dimensions, coordinates by falling variance. Tasks send sums per coordinate."""
    def sums(batches):
        total = np.zeros((0, 2))
        n = 0
        for b in batches:
            c = b.column(0)
            dims = max(len(total), int(np.diff(c.offsets.to_numpy()).max(initial=0)))
            if dims > len(total):
                total = np.concatenate([total, np.zeros((dims - len(total), 2))])
            x = matrix(c, dims).astype(np.float64)
            total += np.stack([x.sum(0), (x * x).sum(0)], axis=1)
            n += b.num_rows
        j = np.arange(-1, len(total))
        yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(np.append(n, total[:, 0])), pa.array(np.append(0.0, total[:, 1]))], ["j", "s", "ss"])

    got = points.select("q").mapInArrow(sums, "j int, s double, ss double").groupBy("j").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect()  # a row per coordinate
    by = {r["j"]: (r["s"], r["ss"]) for r in got}
    n = int(by.pop(-1, (0, 0))[0])
    return n, len(by), sorted(by, key=lambda j: (-(by[j][1] / n - (by[j][0] / n) ** 2), j))


# -- packing -----------------------------------------------------------------------
def tiled(points: DataFrame, n: int, dims: int, order: list[int]) -> DataFrame:
    """Adds the slabs s1 and s2: equal shares of all rows by the first coordinate, then of each slab by the second."""
    many = min(SLABS, max(1, int(np.ceil(np.sqrt(n / PAGE)))))
    if dims < 2 or many < 2:
        return points.withColumns({"s1": F.lit(0), "s2": F.lit(0)})
    share = F.array(*[F.lit(i / many) for i in range(1, many)])
    at = lambda i: F.coalesce(F.try_element_at("q", F.lit(order[i] + 1)), F.lit(0))
    slab = lambda c, cuts: F.size(F.filter(cuts, lambda x: x <= c))
    first = points.agg(F.percentile_approx(at(0), share).alias("c")).first()["c"]
    one = points.withColumn("s1", slab(at(0), F.array(*[F.lit(c) for c in first])))
    cuts = {r["s1"]: r["c"] for r in one.groupBy("s1").agg(F.percentile_approx(at(1), share).alias("c")).collect()}  # at most SLABS rows
    table = F.create_map(*[x for s, c in sorted(cuts.items()) for x in (F.lit(s), F.array(*[F.lit(v) for v in c]))])
    return one.withColumn("s2", slab(at(1), table[F.col("s1")]))


def page_rows(label: int, ids: np.ndarray, q: np.ndarray, order: list[int]) -> tuple:
    """A page: two more coordinates tile its rows into leaves."""
    n = len(ids)
    leaves = -(-n // LEAF)
    if leaves > 1:
        strips = int(np.ceil(np.sqrt(leaves)))
        a, b = q[:, order[2 % len(order)]], q[:, order[3 % len(order)]]
        rank = np.empty(n, np.int64)
        rank[np.lexsort((ids, a))] = np.arange(n)
        by = np.lexsort((ids, b, rank // (-(-leaves // strips) * LEAF)))
        ids, q = ids[by], q[by]
    starts = np.arange(0, n, LEAF)
    low, high = np.minimum.reduceat(q, starts), np.maximum.reduceat(q, starts)
    small = np.int16 if np.abs(q).max(initial=0) < 1 << 15 else np.int32
    return label, n, q.shape[1], ids.astype(np.int64).tobytes(), bytes([np.dtype(small).itemsize]) + q.astype(small).tobytes(), low.astype(np.int32).tobytes(), high.astype(np.int32).tobytes()


def pages(points: DataFrame, n: int, dims: int, order: list[int]) -> DataFrame:
    """The tree's pages, stored: label, rows, boxes of the leaves."""
    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]
    schema = pa.schema([("label", pa.int32()), ("n", pa.int32()), ("dims", pa.int32())] + [(c, pa.binary()) for c in names[3:]])

    @tidy
    def pack(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        label, ids, q = None, np.empty(0, np.int64), np.empty((0, dims), np.int64)
        for b in slices(batches, PAGE):
            bl, bi, bq = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2), dims)
            cuts = np.flatnonzero(np.diff(bl)) + 1
            rows = []
            for lo, hi in zip(np.append(0, cuts).tolist(), np.append(cuts, len(bl)).tolist()):
                if label is not None and int(bl[lo]) != label:
                    rows.append(page_rows(label, ids, q, order))
                    ids, q = ids[:0], q[:0]
                label = int(bl[lo])
                ids, q = np.concatenate([ids, bi[lo:hi]]), np.concatenate([q, bq[lo:hi]])
                while len(ids) >= PAGE:
                    rows.append(page_rows(label, ids[:PAGE], q[:PAGE], order))
                    ids, q = ids[PAGE:], q[PAGE:]
                if not len(ids):
                    label = None
            if rows:
                yield out(rows)
        if label is not None:
            yield out([page_rows(label, ids, q, order)])

    parts = max(points.sparkSession.sparkContext.defaultParallelism, -(-n // (32 * PAGE)))
    by = ["label", "s1", "s2", "id"]
    placed = tiled(points, n, dims, order).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return stored(placed.select("label", "id", "q").mapInArrow(pack, PAGE_SCHEMA), "pages")


# -- search ------------------------------------------------------------------------
class Page(NamedTuple):
    label: int
    ids: np.ndarray
    q: np.ndarray
    low: np.ndarray
    high: np.ndarray


def page_of(label, n, dims, ids, q, low, high) -> Page:
    kind = np.int16 if q[0] == 2 else np.int32
    box = lambda b: np.frombuffer(b, np.int32).reshape(-1, dims)
    return Page(label, np.frombuffer(ids, np.int64), np.frombuffer(q, kind, offset=1).reshape(n, dims), box(low), box(high))


def product(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where they hold them, else in 64-bit integers."""
    if int(np.abs(a).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(1, a.shape[-1]) < EXACT:
        return (a.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ q.astype(np.int64)


def bounds(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of q over each box."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return product(low, up) + product(high, down), product(high, up) + product(low, down)


class Best:
    """The k best (score, id) of a window: higher scores first, ties by smaller id."""

    def __init__(self, low: int, high: int, k: int):
        self.low, self.high, self.k = low, high, k
        self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64)
        self.least = low  # scores below are of no use

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        use = (score >= self.least) & (score <= self.high)
        if not use.any():
            return
        s, i = np.concatenate([self.score, score[use]]), np.concatenate([self.id, ids[use]])
        by = np.lexsort((i, -s))[:self.k]
        self.score, self.id = s[by], i[by]
        if len(by) == self.k:
            self.least = max(self.low, int(s[by[-1]]))


class Tree:
    """The pages that a task holds, with the boxes of pages and leaves."""

    def __init__(self, held: list[Page]):
        self.pages = held
        self.labels = np.array([p.label for p in held])
        self.low = np.stack([p.low.min(0) for p in held])
        self.high = np.stack([p.high.max(0) for p in held])
        self.opened = 0  # leaves that were read

    def search(self, key: int, label: int, q: np.ndarray, windows: list[Best], same: bool) -> None:
        """Best-first: rows of the query's label (without the row `key` itself), or of all other labels."""
        def wanted(least, most) -> bool:
            return any(most >= w.least and least <= w.high for w in windows)

        use = np.flatnonzero((self.labels == label) == same)
        least, most = bounds(self.low[use], self.high[use], q)
        queue = [(-m, a, p, -1) for m, a, p in zip(most.tolist(), least.tolist(), use.tolist())]
        heapq.heapify(queue)
        while queue:
            most, least, p, leaf = heapq.heappop(queue)
            if -most < min(w.least for w in windows):
                break  # and all that follow
            if not wanted(least, -most):
                continue
            page = self.pages[p]
            if leaf < 0:
                lows, highs = bounds(page.low, page.high, q)
                for i, (a, m) in enumerate(zip(lows.tolist(), highs.tolist())):
                    if wanted(a, m):
                        heapq.heappush(queue, (-m, a, p, i))
                continue
            self.opened += 1
            rows = slice(leaf * LEAF, (leaf + 1) * LEAF)
            score, ids = product(page.q[rows], q), page.ids[rows]
            if same:
                other = ids != key
                score, ids = score[other], ids[other]
            for w in windows:
                w.add(score, ids)


def search(tree: DataFrame, queries: DataFrame, n: int, dims: int, k: int, same: bool) -> DataFrame:
    """queries: id, label, q, windows array<struct<tag, low, high>>. Returns query, tag, found: up to k structs (score, id), best first."""
    spark = tree.sparkSession
    groups = max(spark.sparkContext.defaultParallelism, -(-n * max(dims, 1) * 4 // GROUP_BYTES))
    row = "g int, kind int, label int, n int, dims int, ids binary, q binary, low binary, high binary"
    names = [x.split()[0] for x in row.split(", ")]

    def blocks(batches):  # queries in blocks; low, high: window bounds, ids: query ids, tags and window counts in one blob
        for b in slices(batches, BLOCK):
            c = [b.column(i) for i in range(4)]
            w = c[3].flatten()
            ints = lambda x: np.asarray(x.to_numpy(zero_copy_only=False), np.int64).tobytes()
            count = np.diff(c[3].offsets.to_numpy()).astype(np.int64)
            ids = c[0].to_numpy().astype(np.int64).tobytes() + c[1].to_numpy().astype(np.int64).tobytes() + count.tobytes() + ints(w.field("tag"))
            cells = [0, 1, 0, b.num_rows, dims, ids, matrix(c[2], dims).astype(np.int64).tobytes(), ints(w.field("low")), ints(w.field("high"))]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int32()) for v in cells], names)

    @tidy
    def run(batches):
        held, at, root = [], None, None
        for b in slices(batches, 64):
            for g, kind, label, m, dm, ids, q, low, high in zip(*(x.to_pylist() for x in b.columns)):
                if g != at:
                    held, at, root = [], g, None
                if kind == 0:
                    held.append(page_of(label, m, dm, ids, q, low, high))
                    continue
                if not held:
                    continue
                root = root or Tree(held)
                yield from answers(root, m, dm, ids, q, low, high, k, same)

    dealt = tree.withColumns({"g": F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"), "kind": F.lit(0)}).select(*names)
    asked = queries.select("id", "label", "q", "windows").mapInArrow(blocks, row).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(*names)
    met = dealt.unionByName(asked).repartition(groups, "g").sortWithinPartitions("g", "kind")
    part = met.mapInArrow(run, "query bigint, tag bigint, found array<struct<score: bigint, id: bigint>>")
    best = F.array_sort(F.flatten(F.collect_list("found")), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["id"] < b["id"], -1).otherwise(1))
    return part.groupBy("query", "tag").agg(F.slice(best, 1, k).alias("found"))  # at most k of each group of pages


def answers(root: Tree, m: int, dims: int, ids: bytes, q: bytes, low: bytes, high: bytes, k: int, same: bool) -> Iterator:
    """Search of one query block."""
    head = np.frombuffer(ids, np.int64)
    key, label, count, tags = head[:m], head[m:2 * m], head[2 * m:3 * m], head[3 * m:]
    vectors = np.frombuffer(q, np.int64).reshape(m, dims)
    lows, highs = np.frombuffer(low, np.int64), np.frombuffer(high, np.int64)
    ends = np.cumsum(count)
    query, tag, found = [], [], []
    for i in range(m):
        span = range(int(ends[i] - count[i]), int(ends[i]))
        windows = [Best(int(lows[w]), int(highs[w]), k) for w in span]
        if windows:
            root.search(int(key[i]), int(label[i]), vectors[i], windows, same)
        for w, best in zip(span, windows):
            if len(best.score):
                query.append(int(key[i]))
                tag.append(int(tags[w]))
                found.append([{"score": s, "id": v} for s, v in zip(best.score.tolist(), best.id.tolist())])
    kind = pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())]))
    yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(tag, pa.int64()), pa.array(found, kind)], ["query", "tag", "found"])


def mine(rows: DataFrame, anchors: str = "id % 100 = 0", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, key: str = "vec_id", vector: str = "embedding",
         label: str = "label", unit: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: a condition on id and label. Positives are an anchor's best rows of its label; negatives its best rows of other labels whose score is
    between low and high percent of the positive's score."""
    points = stored(quantised(rows, key, vector, label, unit), "points")
    n, dims, order = spread(points)
    tree = pages(points, n, dims, order)
    asked = points.filter(anchors)
    ends = F.array(F.struct(F.lit(0).cast("bigint").alias("tag"), F.lit(-(1 << 63)).cast("bigint").alias("low"), F.lit((1 << 63) - 1).cast("bigint").alias("high")))
    first = stored(search(tree, asked.withColumn("windows", ends), n, dims, positives, same=True), "positives")
    share = lambda p, s: F.lit(p) * s
    s = lambda f: f["score"].cast("decimal(20, 0)")
    window = F.transform("found", lambda f: F.struct(f["id"].alias("tag"), F.ceil(share(low, s(f)) / F.lit(100)).cast("bigint").alias("low"), F.floor(share(high, s(f)) / F.lit(100)).cast("bigint").alias("high")))
    again = asked.join(first.select(F.col("query").alias("id"), window.alias("windows")), "id")
    second = search(tree, again, n, dims, negatives, same=False)
    pairs = first.select(F.col("query").alias("anchor_id"), F.explode("found").alias("p")).select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    out = second.select(F.col("query").alias("anchor_id"), F.col("tag").alias("positive_id"), F.posexplode("found").alias("i", "f")).join(pairs, ["anchor_id", "positive_id"])
    return out.select("anchor_id", "positive_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("f.id").alias("negative_id"), "positive_score", F.col("f.score").alias("negative_score"))
