"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Vectors, scaled to length one, are dealt by a hash of their row to index shards of about ``SHARD_ROWS``.
A shard keeps, for each of ``PROJECTIONS`` random directions, its vectors' projections as one sorted
array. A query opens a window centred on its own projection in every array and widens all of them by
the factor ``WIDEN`` (virtual rehashing: nothing is hashed again). A vector met in ``THRESHOLD`` of the
windows is verified by its exact cosine. The query ends in a shard once its ``k``-th best verified
vector is nearer than the windows' radius, or once every vector was verified; no number of candidates
ends it. The shards' best are ranked together.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part,
as query or candidate; vectors of other lengths are never compared; null ids take no part; ties go to the
smaller id; each row of a repeated id is a candidate for all other rows and, if asked, a query of its own. Lengths
from the smallest to the largest double are told apart: vectors are first scaled by a power of two, which changes
no cosine. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SHARD_ROWS = 8192
PROJECTIONS = 96
THRESHOLD = 61
WINDOW = 2.0
WIDEN = 1.12
FIRST_RADIUS = 0.1
#: The count of a verified vector: no number of collisions makes it positive again.
VERIFIED = -10_000
#: Verified scores come from scaled vectors; those this near the k-th are taken again from the original ones.
ROUNDING = 1e-9
#: Queries that widen their windows together.
BLOCK = 64
#: The windows' radius is this share of the k-th distance when a query ends.
ENOUGH = 1.0
SEED = 5


def usable(vector: Column) -> Column:
    """Not null, empty or zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component between a half and one."""
    _, exponents = np.frexp(np.abs(vectors).max(1, initial=0.0))
    return np.ldexp(vectors, -exponents[:, None])


class ShardIndex:
    """The sorted projections of one shard's vectors, which are scaled; ``rows`` tell those of one id apart."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.rows, self.vectors = ids, rows, vectors
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.units = vectors / self.norms[:, None]
        self.directions = np.random.default_rng(SEED).standard_normal((PROJECTIONS, vectors.shape[1]))
        values = self.directions @ self.units.T
        order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, order, 1)
        #: All arrays' positions in a row, one array after the other.
        self.order = order.ravel()
        self.starts = np.arange(PROJECTIONS)[:, None] * len(ids)
        #: Vectors verified so far, over all queries.
        self.verified = 0

    def cosines(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        return (self.vectors[at] * query).sum(1) / (self.norms[at] * np.sqrt((query * query).sum()))

    def edges(self, values: np.ndarray, side: str) -> np.ndarray:
        """Where ``values`` (projections x queries) fall in each array, as positions of ``order``."""
        return self.starts + np.array([np.searchsorted(row, v, side) for row, v in zip(self.sorted, values, strict=True)])

    def nearest(self, query_rows: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
        """(row of the query, vec_id, cosine) of each scaled query's ``k`` nearest found, nearest first, ties to the smaller id; never its own row."""
        units = queries / np.sqrt((queries * queries).sum(1))[:, None]
        centres = self.directions @ units.T
        searches = [Search(self, row, query, unit) for row, query, unit in zip(query_rows.tolist(), queries, units, strict=True)]
        open_, radius = np.arange(len(searches)), FIRST_RADIUS
        low = high = self.edges(centres, "left")
        while len(open_):
            half = radius * WINDOW / 2
            a, b = self.edges(centres[:, open_] - half, "left"), self.edges(centres[:, open_] + half, "right")
            cuts = np.concatenate((a, high)).T.tolist(), np.concatenate((low, b)).T.tolist()
            more = []
            for at, start, end in zip(open_.tolist(), *cuts, strict=True):
                best = searches[at].widen(start, end, radius, k)
                more.append(best is None)
                if best is not None:
                    yield from ((query_rows[at], *found) for found in best)
            low, high, open_, radius = a[:, more], b[:, more], open_[more], radius * WIDEN


class Search:
    """What one query has met in a shard so far."""

    def __init__(self, index: ShardIndex, row: int, query: np.ndarray, unit: np.ndarray) -> None:
        self.index, self.row, self.query, self.unit = index, row, query, unit
        self.counts = np.zeros(len(index.ids), np.int16)
        self.at, self.scores = np.empty(0, np.int64), np.empty(0)

    def widen(self, start: list[int], end: list[int], radius: float, k: int) -> list[tuple[int, float]] | None:
        """Count what ``order`` holds between each start and end; the ``k`` nearest if the search is over."""
        index = self.index
        entered = np.concatenate([index.order[x:y] for x, y in zip(start, end, strict=True)])
        self.counts += np.bincount(entered, minlength=len(index.ids)).astype(np.int16)
        new = np.flatnonzero(self.counts >= THRESHOLD)
        if len(new):
            self.counts[new] = VERIFIED
            index.verified += len(new)
            new = new[index.rows[new] != self.row]
            self.at = np.concatenate((self.at, new))
            self.scores = np.concatenate((self.scores, np.einsum("ij,j->i", index.units[new], self.unit)))
        done = bool((self.counts < 0).all())
        if not done and len(self.at) < k:
            return None
        worst = np.partition(self.scores, -k)[-k] if len(self.at) >= k else -2.0
        if not done and math.sqrt(max(0.0, 2 - 2 * worst)) > ENOUGH * radius:
            return None
        near = self.at[self.scores >= worst - ROUNDING]
        scores = index.cosines(near, self.query)
        best = np.lexsort((index.ids[near], -scores))[:k]
        return [(int(index.ids[near[x]]), float(scores[x])) for x in best]


def _search_udf(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard, each shard's vectors before its queries."""
        shard, index, held = None, None, []
        names = ["query_row", "vec_id", "score"]
        for batch in batches:
            dims, number, kinds = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("dims", "shard", "kind"))
            ids, rows = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("id", "row"))
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.concatenate(([0], np.cumsum(dims)))
            cuts = np.flatnonzero((np.diff(dims) != 0) | (np.diff(number) != 0) | (np.diff(kinds) != 0)) + 1
            out: list[tuple[int, int, float]] = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                if a == b:
                    continue
                if (here := (int(dims[a]), int(number[a]))) != shard:
                    shard, index, held = here, None, []
                block = scaled(flat[ends[a] : ends[b]].reshape(b - a, -1))
                if kinds[a] == 0:
                    held.append((ids[a:b], rows[a:b], block))
                    continue
                if index is None and held:
                    index, held = ShardIndex(*map(np.concatenate, zip(*held, strict=True))), []
                if index is not None:
                    for at in range(a, b, BLOCK):
                        end = min(b, at + BLOCK)
                        out += index.nearest(rows[at:end], block[at - a : end - a], k)
            kinds_out = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds_out)], names)

    return search


def nearest_vectors(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest cosines found for each row of ``is_query``, among all other rows.

    Queries go to every shard of vectors of their length; a shard's task holds its index and takes the queries as they come.
    """
    rows = vectors.where(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("is_query"))
    rows = stage(rows.select(F.monotonically_increasing_id().alias("row"), "id", "vector", "is_query"), "vectors")
    shards = max(1, math.ceil(rows.count() / shard_rows))
    rows = rows.withColumn("dims", F.size("vector"))
    indexed = rows.select("dims", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "row", "vector")
    asked = rows.where("is_query").select("dims", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "row", "vector")
    dealt = indexed.unionByName(asked).repartition("dims", "shard").sortWithinPartitions("dims", "shard", "kind", "id", "row")
    found = dealt.mapInArrow(_search_udf(k), "query_row long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(rows.where("is_query").select(F.col("row").alias("query_row"), F.col("id").alias("query_id")), "query_row").select("query_id", "rank", "vec_id", "score")
