"""Approximate nearest neighbours by collision counting (query-aware hashing).

Vectors are dealt into sets, each of which one task indexes once; queries travel to the
sets through a shuffle and stream past the index.  A block of a set projects its vectors
on ``lines`` random lines and keeps one sorted array per line, cut into 256 pages of
equal numbers.  A query opens a window around its own projection on every line; a vector
collides once for each line where its page lies in the window, and one whose collisions
exceed the threshold is verified.  Virtual rehashing widens all windows of a query
together until its k-th best verified vector lies within the radius that the windows
stand for: every nearer vector had at least the chance ``sure`` to exceed the threshold.
The bound that a query brings from earlier blocks begins its search in the next one.

The largest inner product is searched as the nearest point after one more coordinate
brings all vectors of a block to one length, so a block holds lengths within a factor
of two and is passed over by queries whose bound its longest vector cannot reach.  All
search arithmetic works on vectors scaled by powers of two, which is exact, so lengths
near the ends of the double range are as good as others; scores are the plain inner
products of the original components.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do rows with a null id; vectors are compared with those of their own dimension
only; rows that repeat an id are separate candidates and separate queries, but never
neighbours of their own id; ties go to the smaller id, and of vectors whose scores all
underflow or overflow to one value those with the truly larger products are chosen;
scores that are not numbers come last; a query with fewer candidates than k gets all.
"""

from __future__ import annotations

import math
from collections import Counter
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.llm import shared

#: Vectors in a block and in a set; queries that are searched together.
BLOCK_ROWS, SET_ROWS, TILE = 16384, 65536, 16
#: Pages of a sorted array; rows of the first bound's neighbourhood on each of four lines.
PAGES, NEARBY = 256, 24
#: Relative slack of single precision.
_SLACK = 4e-6


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows times powers of two that bring their lengths to [0.5, 1), and the exponents."""
    _, big = np.frexp(np.abs(vectors).max(1, initial=0.0))
    out = np.ldexp(vectors, -big[:, None])
    _, more = np.frexp(np.sqrt((out**2).sum(1)))
    return np.ldexp(out, -more[:, None]), big.astype(np.int64) + more


def _kept_copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows that can be among the k best of any query: of equal vectors the smallest ids.

    A query never takes rows of its own id, so equal vectors are cut only once k of them
    remain without the most frequent id.
    """
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, group, size = np.unique(raw, return_inverse=True, return_counts=True)
    if size.max(initial=0) <= k:
        return np.arange(len(ids))
    keep = np.ones(len(ids), bool)
    for g in np.flatnonzero(size > k):
        rows = np.flatnonzero(group == g)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        seen: Counter = Counter()
        for n, r in enumerate(rows, 1):
            seen[int(ids[r])] += 1
            if n > k and n - max(seen.values()) >= k:
                keep[rows[n:]] = False
                break
    return np.flatnonzero(keep)


class CollisionIndex:
    """Sorted projections of one block: vectors as they are, and scaled with one exponent."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, exponents: np.ndarray, lines: int = 20, width: float = 1.5, sure: float = 0.95, grow: float = 1.15):
        self.ids, self.vectors, self.width, self.grow, self.lines = ids, vectors, width, grow, lines
        self.exponent = int(exponents.max())
        self.own = np.ldexp(vectors, -self.exponent)
        self.small = self.own.astype(np.float32)
        near = 2 * NormalDist().cdf(width) - 1
        self.least = math.floor(lines * near - NormalDist().inv_cdf(sure) * math.sqrt(lines * near * (1 - near)))
        self.axes = np.random.default_rng(8).standard_normal((vectors.shape[1] + 1, lines)).astype(np.float32)
        square = (self.own**2).sum(1)
        self.longest = math.sqrt(float(square.max()))
        lift = np.sqrt(np.maximum(self.longest**2 - square, 0)).astype(np.float32)
        shadow = self.small @ self.axes[:-1] + lift[:, None] * self.axes[-1]
        n = len(ids)
        self.order = np.ascontiguousarray(np.argsort(shadow, axis=0).T)
        page = (np.arange(n) * PAGES // n).astype(np.uint8)
        self.page = np.empty((lines, n), np.uint8)
        np.put_along_axis(self.page, self.order, page[None, :], axis=1)
        # the pages' first values; the lines stand one behind the other, shifted apart, so
        # that one binary search serves all of them
        first = np.searchsorted(page, np.arange(PAGES))
        edges = np.sort(shadow, axis=0)[np.minimum(first, n - 1)].T.astype(np.float64)
        self.apart = 4 * float(np.abs(shadow).max(initial=1.0)) + 1
        self.edges = (edges + np.arange(lines)[:, None] * self.apart).ravel()

    def pages(self, at: np.ndarray, side: str) -> np.ndarray:
        """The pages in which values (queries x lines) lie; on ties the outermost one."""
        edge = self.apart / 2 - 1e-3
        lines = np.arange(self.lines)
        found = np.searchsorted(self.edges, np.clip(at, -edge, edge) + lines * self.apart, side=side) - 1 - lines * PAGES
        return np.clip(found, 0, PAGES - 1)

    def distance(self, bound: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Distance, in the lifted space, of vectors with inner products ``bound``."""
        with np.errstate(over="ignore", invalid="ignore"):
            return np.where(np.isfinite(bound), np.sqrt(np.maximum(0.0, 2 * self.longest**2 - 2 * np.where(np.isfinite(bound), bound, 0) * self.longest / size)), math.inf)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, size: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, product) of verified vectors that may be among the k best.

        ``queries`` are scaled, ``size`` their lengths and ``bound`` the k-th best product
        so far, in this block's scale.
        """
        m, n = len(queries), len(self.ids)
        brief = queries.astype(np.float32)
        centre = brief @ self.axes[:-1] * (self.longest / size)[:, None]
        slack = _SLACK * self.longest * size
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        bound = bound.copy()
        seen = np.zeros((m, n), bool)
        best = np.full((m, k), -np.inf)

        def verify(q: np.ndarray, rows: np.ndarray, product: np.ndarray) -> None:
            """Take rows (sorted by query) whose short products pass the bound; raise the bounds."""
            fit = (product >= bound[q] - slack[q]) & (self.ids[rows] != query_ids[q])
            q, rows, product = q[fit], rows[fit], product[fit]
            if not len(q):
                return
            order = np.lexsort((-product, q))
            q, rows, product = q[order], rows[order], product[order]
            begin = np.searchsorted(q, np.arange(m))
            nth = np.arange(len(q)) - begin[q]
            many = np.diff(np.append(begin, len(q)))
            kth = product[np.minimum(begin + k - 1, len(q) - 1)]
            fit = (nth < k) | (product >= np.where(many >= k, kth, -np.inf)[q] - 2 * slack[q])
            q, rows, nth = q[fit], rows[fit], nth[fit]
            exact = (self.own[rows] * queries[q]).sum(1)
            found.append((q, rows, exact))
            top = nth < k
            fresh = np.full((m, k), -np.inf)
            fresh[q[top], nth[top]] = exact[top]
            both = np.concatenate([best, fresh], 1)
            best[:] = np.partition(both, k, 1)[:, k:] if k else best
            np.maximum(bound, best.min(1, initial=np.inf), out=bound)

        few = np.flatnonzero(~np.isfinite(bound))
        if len(few):  # a first bound: the neighbours on a few lines
            first = self.pages(centre[few], "right") * n // PAGES
            near = np.concatenate([self.order[j][np.clip(first[:, j, None] + np.arange(-NEARBY, NEARBY), 0, n - 1)] for j in range(min(4, self.lines))], 1)
            mask = np.zeros((m, n), bool)
            mask[np.repeat(few, near.shape[1]), near.ravel()] = True
            q, rows = np.nonzero(mask)
            seen |= mask
            verify(q, rows, (self.small[rows] * brief[q]).sum(1))
        far = self.distance(bound, size)
        radius = np.where(np.isin(np.arange(m), few), 0.8, 1.0) * np.minimum(far, 2 * self.longest)
        live = np.flatnonzero(self.longest * size + slack >= bound)
        while len(live):
            reach = (self.width * radius[live] + 1e-5 * self.longest)[:, None]
            low = self.pages(centre[live] - reach, "left")
            span = (self.pages(centre[live] + reach, "right") - low).astype(np.uint8)
            low = low.astype(np.uint8)
            count = np.zeros((len(live), n), np.uint8)
            offset, inside = np.empty((len(live), n), np.uint8), np.empty((len(live), n), bool)
            for j in range(self.lines):
                np.subtract(self.page[j], low[:, j, None], out=offset)
                np.less_equal(offset, span[:, j, None], out=inside)
                count += inside
            hit = count > self.least
            hit &= ~seen[live]
            seen[live] |= hit
            if np.count_nonzero(hit) * 8 < hit.size:
                q, rows = np.nonzero(hit)
                product = (self.small[rows] * brief[live[q]]).sum(1)
            else:  # many: one matrix product serves all, only vectors with enough collisions count
                every = brief[live] @ self.small.T
                hit &= every >= (bound - slack)[live, None]
                q, rows = np.nonzero(hit)
                product = every[q, rows]
            verify(live[q], rows, product)
            far = self.distance(bound, size)
            going = (far > radius) & ~seen.all(1)
            live = live[going[live]]
            # the windows need reach no farther than the bound
            radius = np.where(np.isfinite(far), np.minimum(np.maximum(radius * self.grow, 1e-9), far), np.maximum(radius * 2, 1e-9))
        if not found:
            nothing = np.zeros(0, np.int64)
            return nothing, nothing, np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found))


class CollisionSet:
    """The blocks of one set, from the longest vectors to the shortest."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, block_rows: int = BLOCK_ROWS, **index):
        keep = _kept_copies(ids, vectors, k)
        ids, vectors = ids[keep], vectors[keep]
        _, exponents = scaled(vectors)
        order = np.lexsort((ids, -exponents))
        ids, vectors, exponents = ids[order], vectors[order], exponents[order]
        cuts = np.flatnonzero(np.concatenate([[True], exponents[1:] != exponents[:-1]]))
        ends = np.append(cuts[1:], len(ids))
        pieces = [(a, min(a + block_rows, end)) for begin, end in zip(cuts, ends) for a in range(begin, end, block_rows)]
        self.blocks = [CollisionIndex(ids[a:b], vectors[a:b], exponents[a:b], **index) for a, b in pieces]
        self.k = k

    def search(self, query_ids: np.ndarray, queries: np.ndarray):
        """Per tile of queries: (query, id, score, true order) of the k best of the set."""
        unit, _ = scaled(queries)
        for a in range(0, len(queries), TILE):
            yield self._tile(a, query_ids[a : a + TILE], queries[a : a + TILE], unit[a : a + TILE])

    def _tile(self, base: int, query_ids, originals, unit):
        size = np.sqrt((unit**2).sum(1))
        top = self.blocks[0].exponent
        have = None  # query, block, row, product in the scale of the first block
        bound = np.full(len(unit), -np.inf)
        for b, block in enumerate(self.blocks):
            shift = top - block.exponent
            with np.errstate(over="ignore", under="ignore"):
                q, rows, product = block.search(query_ids, unit, size, np.ldexp(bound, shift), self.k)
                own = np.ldexp(product, -shift)
            cols = (q, np.full(len(q), b), rows, own, block.ids[rows], np.ldexp(product, 0))
            have = cols if have is None else tuple(np.concatenate(x) for x in zip(have, cols))
            order = np.lexsort((have[4], -have[3], have[0]))
            have = tuple(c[order] for c in have)
            begin = np.searchsorted(have[0], np.arange(len(unit) + 1))
            nth = np.arange(len(have[0])) - begin[have[0]]
            have = tuple(c[nth < self.k] for c in have)
            begin = np.searchsorted(have[0], np.arange(len(unit) + 1))
            full = np.diff(begin) >= self.k
            if len(have[0]):
                bound = np.where(full, have[3][np.maximum(begin[1:] - 1, 0)], -np.inf)
        q, which, rows, own, ids, product = have
        score = np.empty(len(q))
        exponent = np.empty(len(q))
        with np.errstate(over="ignore", invalid="ignore", under="ignore"):
            for b, block in enumerate(self.blocks):
                mine = np.flatnonzero(which == b)
                score[mine] = (block.vectors[rows[mine]] * originals[q[mine]]).sum(1)
                exponent[mine] = block.exponent
            # where scores leave the double range the sign and the logarithm tell the order
            true = np.where(product != 0, np.sign(product) * 1e5 + np.sign(product) * (np.log2(np.abs(np.where(product != 0, product, 1))) + exponent), 0)
        plain = np.isfinite(score) & (np.abs(score) > 1e-290)
        return base + q, ids, score, np.where(plain, 0.0, true)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, components as doubles."""
    v = F.col("v")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(shared.whole_number(vectors, id_col).alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    return rows.filter(F.col("vec_id").isNotNull() & good)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", set_rows: int = SET_ROWS, **index) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every query.

    Work is a grid of sets of vectors and shares of queries; a task holds one set of at
    most about ``set_rows`` vectors, and queries stream past it.
    """
    spark = vectors.sparkSession
    shared.tune(spark)
    number = F.monotonically_increasing_id()  # of stored rows, so that a lost task finds the same ones
    rows = shared.stored(usable(vectors, id_col, vector_col).withColumn("n", number), "vectors")
    asked = shared.stored(usable(queries, id_col, vector_col).withColumn("n", number), "queries")
    total = rows.count()
    if not total or not k:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tasks = spark.sparkContext.defaultParallelism
    # as many sets as tasks, but none of a few vectors only; shares of queries beyond that
    sets = max(-(-total // set_rows), min(tasks, -(-total // 4096)))
    shares = max(1, tasks // sets) if total > 4096 else 1
    own = F.pmod(F.xxhash64("n"), F.lit(sets)).cast("int")
    share = F.pmod(F.xxhash64(F.lit(1), "n"), F.lit(shares)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = rows.select(own.alias("set"), every(shares).alias("share"), F.lit(0).alias("role"), "n", "vec_id", "v")
    cells = cells.unionByName(asked.select(every(sets).alias("set"), share.alias("share"), F.lit(1).alias("role"), "n", "vec_id", "v"))
    cells = cells.select((F.col("set") * shares + F.col("share")).alias("cell"), F.size("v").alias("width"), "role", "n", "vec_id", "v")
    names = ["cell", "width", "role", "n", "vec_id", "v"]

    def work(stream):
        key, held, made = None, [], None
        for batch in stream:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in names[:3]], 1)
            cuts = np.flatnonzero(np.concatenate([[True], (marks[1:] != marks[:-1]).any(1)]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
                cell, width, role = marks[a].tolist()
                if (cell, width) != key:
                    key, held, made = (cell, width), [], None
                part = batch.slice(a, b - a)
                ids, data = part.column("vec_id").to_numpy(), _matrix(part.column("v"), width)
                if role == 0:
                    held.append((ids, data))
                    continue
                if made is None and held:
                    made = CollisionSet(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), k, **index)
                    held = []
                if made is not None:
                    numbers = part.column("n").to_numpy()
                    for q, found, score, true in made.search(ids, data):
                        yield pa.RecordBatch.from_arrays([pa.array(numbers[q]), pa.array(ids[q]), pa.array(found), pa.array(score), pa.array(true)], ["n", "query_id", "vec_id", "score", "true"])

    spread = cells.repartitionById(sets * shares, F.col("cell")).sortWithinPartitions("cell", "width", "role", "n")
    found = spread.mapInArrow(work, "n long, query_id long, vec_id long, score double, true double")
    order = [F.isnan("score"), F.desc("score")]
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("n").orderBy(*order, F.desc("true"), "vec_id"))).filter(F.col("nth") <= k)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy(*order, "vec_id")))
    return ranked.select("query_id", "rank", "vec_id", "score")
