"""Approximate nearest neighbours with vantage-point trees per shard.

Largest inner product becomes smallest distance by one more coordinate. The rows of
a shard are put into bands, each of lengths within a factor of 4 of each other; a band's rows
are divided by its largest length M and get sqrt(1 - |v/M|^2), a query q is divided by its own
length and gets 0. Then |q' - v'|^2 = 2 - 2 q.v / (|q| M), all numbers are near 1
whatever the vectors' lengths are, and the triangle inequality holds. Each band has a tree.

A tree node has a vantage point and, for each of its two halves, the least and
the largest distance from it; halves are made by rank, so equal vectors don't
unbalance it. A search goes through the bands from the longest rows down. It passes by
a half when its lower bound exceeds `factor` times the distance at which a row would be as
good as the query's k-th best so far. With factor 1 the search is exact; a smaller factor
passes by more and finds less. In a leaf, rows are compared by the inner product itself:
those that a product of the scaled matrices can't rule out are computed in double
precision on the original vectors, one component after the other, so equal vectors
have equal scores, and the k best by (score, id) are kept.

Shards hold about `shard_rows` rows (fewer where vectors are long) by a hash of the row, so
equal vectors and equal ids go to different shards. The stated query set is cut into blocks
of about `block_queries` and each block meets each shard: (block, shard) pairs are
the tasks, and none grows with the table. Every pair gives at most k rows for a
query; a second step keeps the k best of all shards by a map-side top-k first.

Nulls and odd input: vectors that are null, empty, zero, of another length than
most, or hold null or non-finite components take no part, and nor do rows without
an id. A query id that is held more than once is one query, with the smallest of its vectors.
Rows with equal ids are all candidates, each for itself; a query never finds a row of
its own id. Ties go to the smaller id. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 20
FACTOR = 0.9
SHARD_ROWS = 16_384
BLOCK_QUERIES = 4_096
LEAF = 256
MOST_NUMBERS = 1 << 21  # components of a shard's vectors in all
#: What rounding can move a scaled product or a squared distance by, with room to spare.
SLACK = 1e-11


def lengths(v: np.ndarray) -> np.ndarray:
    """Euclidean lengths, for components of any size."""
    top = np.abs(v).max(axis=1)
    return top * np.sqrt(((v / top[:, None]) ** 2).sum(axis=1))


class Tree:
    """The rows of one band of a shard: those at `places`, all of lengths up to `most`."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, places: np.ndarray, seed: int = 5) -> None:
        self.most = float(sizes.max())
        unit = rows / self.most
        share = sizes / self.most
        self.points = np.column_stack((unit, np.sqrt(np.maximum((1 - share) * (1 + share), 0))))
        self.order = np.arange(len(rows))
        self.root = self._build(0, len(rows), np.random.default_rng(seed))
        self.points, self.places = self.points[self.order], places[self.order]  # a leaf is a stretch

    def _build(self, lo: int, hi: int, rng):
        """('leaf', lo, hi) or (vantage point, [(least, largest distance, node)] of the halves)."""
        if hi - lo <= LEAF:
            return ("leaf", lo, hi)
        own = self.order[lo:hi]
        tries = own[rng.integers(0, len(own), 4)]
        probe = self.points[own[rng.integers(0, len(own), 64)]]
        spread = [np.linalg.norm(probe - self.points[t], axis=1).std() for t in tries]
        point = self.points[tries[int(np.argmax(spread))]]
        far = np.sqrt(((self.points[own] - point) ** 2).sum(axis=1))
        rank = np.argsort(far, kind="stable")
        self.order[lo:hi], far = own[rank], far[rank]
        mid = (hi - lo) // 2
        return (point, [(far[0], far[mid - 1], self._build(lo, lo + mid, rng)), (far[mid], far[-1], self._build(lo + mid, hi, rng))])


def needed(rows: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among the k best of some query. ids are sorted. Equal vectors have equal scores, so of each
    different vector the rows of smallest ids do: as many as leave k when a query doesn't take those of its own id."""
    same = np.unique(np.ascontiguousarray(rows).view(f"V{rows.itemsize * rows.shape[1]}").ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(same, kind="stable")
    same, own = same[order], ids[order]
    rank = np.arange(len(same)) - np.searchsorted(same, same)
    new = np.ones(len(same), bool)  # of its id, among equal vectors
    new[1:] = (same[1:] != same[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    run = np.arange(len(same)) - at[np.cumsum(new) - 1]  # rows of the same id before it
    longest = np.zeros(len(same), np.int64)  # of the runs up to here; a row that isn't needed has k rows of other ids before it, whichever is left out
    if len(same):
        step = same * (len(same) + 1)  # makes a running maximum start again for each vector
        longest = np.maximum.accumulate(run + 1 + step) - step
    return np.sort(order[rank < k + longest])


class Shard:
    def __init__(self, rows: np.ndarray, ids: np.ndarray, k: int = K) -> None:
        """For searches of up to k rows. ids are sorted."""
        some = needed(rows, ids, k)
        rows, ids = rows[some], ids[some]
        self.rows, self.ids = np.ascontiguousarray(rows.T), ids  # components apart, as scores add them up in their order
        self.trees = []
        if len(rows):
            sizes = lengths(rows)
            band = np.frexp(sizes)[1] >> 1
            for b in sorted(set(band.tolist()), reverse=True):
                own = np.flatnonzero(band == b)
                self.trees.append(Tree(rows[own], sizes[own], own))

    def search(self, queries: np.ndarray, k: int, factor: float, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k rows of largest product found for each query, best first, -1 where there are fewer; skip[i] is the id that query i doesn't take."""
        n = len(queries)
        best, place = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        if not n or not self.trees:
            return place, best
        parts, size = np.ascontiguousarray(queries.T), lengths(queries)
        unit = np.column_stack((queries / size[:, None], np.zeros(n)))

        def reach(tree, who):
            """The k-th best score so far as a scaled product of the band, for each query."""
            return best[who, -1] / size[who] / tree.most

        def leaf(tree, lo, hi, who):
            near = unit[who] @ tree.points[lo:hi].T  # the query's last coordinate is 0
            near[skip[who][:, None] == self.ids[tree.places[lo:hi]][None, :]] = -np.inf
            least = reach(tree, who)
            new = np.isneginf(least)
            if new.any() and hi - lo > k:
                least[new] = np.partition(near[new], hi - lo - k, axis=1)[:, hi - lo - k]
            i, j = np.nonzero((near >= least[:, None] - SLACK) & (near > -np.inf))
            if not len(i):
                return
            i, j = who[i], tree.places[lo + j]
            score, step = np.empty(len(i)), max(1, (1 << 20) // len(parts))
            for at in range(0, len(i), step):  # a sum over the first axis adds one component after the other
                end = at + step
                score[at:end] = (parts.take(i[at:end], axis=1) * self.rows.take(j[at:end], axis=1)).sum(axis=0)
            some = np.unique(i)
            held_i, held_c = np.nonzero(place[some] >= 0)
            i = np.concatenate((some[held_i], i))
            j = np.concatenate((place[some][held_i, held_c], j))
            score = np.concatenate((best[some][held_i, held_c], score))
            order = np.lexsort((self.ids[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            top = rank < k
            best[some], place[some] = -np.inf, -1
            best[i[top], rank[top]], place[i[top], rank[top]] = score[top], j[top]

        def visit(tree, node, who):
            if isinstance(node[0], str):
                return leaf(tree, node[1], node[2], who)
            point, halves = node
            d = np.sqrt(((unit[who] - point) ** 2).sum(axis=1))
            bounds = [np.maximum(np.maximum(d - high, low - d), 0) for low, high, _ in halves]
            nearer = np.where(bounds[0] == bounds[1], d <= (halves[0][1] + halves[1][0]) / 2, bounds[0] < bounds[1])
            for first in (0, 1):  # queries nearer to the first half see it first, the others last
                for side in (first, 1 - first):
                    group = nearer if first == 0 else ~nearer
                    ok = group & (bounds[side] ** 2 <= factor * factor * (2 - 2 * reach(tree, who)) + SLACK)
                    if ok.any():
                        visit(tree, halves[side][2], who[ok])

        with np.errstate(over="ignore", invalid="ignore"):
            for tree in self.trees:
                who = np.flatnonzero(reach(tree, np.arange(n)) <= 1 + SLACK)
                if len(who):
                    visit(tree, tree.root, who)
        return place, best


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _search(k: int, factor: float, dim: int):
    names = ["query_id", "vec_id", "score"]

    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = ([], [], [])
        if queries.num_rows and rows.num_rows:
            ids = rows.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            qid = queries.column("query_id").to_numpy()
            shard = Shard(_matrix(rows.column("v"), dim)[order], ids[order], k)
            place, score = shard.search(_matrix(queries.column("v"), dim), k, factor, qid)
            i, j = np.nonzero(place >= 0)
            out = (qid[i], shard.ids[place[i, j]], score[i, j])
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=names)

    return run


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return own.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest inner product found for each query."""
    rows, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dim, n = (common["d"], common["n"]) if common else (1, 0)
    rows = rows.where(F.size("v") == dim)
    asked = asked.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    shards = max(1, math.ceil(n / min(shard_rows, max(1, MOST_NUMBERS // dim))))
    blocks = max(1, math.ceil(asked.count() / block_queries))
    spread = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.col("vec_id").alias("query_id"), "v", spread(blocks, F.col("vec_id"), F.lit(1)).alias("block"), to(shards).alias("shard"))
    right = rows.select("vec_id", "v", spread(shards, F.col("vec_id"), F.monotonically_increasing_id()).alias("shard")).select("*", to(blocks).alias("block"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_search(k, factor, dim), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0))
