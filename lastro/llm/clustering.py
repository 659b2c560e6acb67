"""Centroid clustering (Lloyd's rounds) in whole numbers, by Drake's adaptive bounds.

Each vector keeps, besides its centroid and an upper bound of the distance to it, lower bounds of the distances
to the centroids that come next, and one bound below those to all the rest. After centroids move, the upper
bound grows by the way of its own centroid, each lower bound falls by the way of its own, the last by the longest
way. While the upper bound stays under all others the vector keeps its centroid unseen. If not, its own distance is
taken; if the order of the first few is still open, they alone are measured and put in order; only when the upper
bound reaches that of the rest is every centroid measured. How many bounds are kept follows how deep the last round had
to look. Bounds decide only with a margin above rounding: every distance that decides is taken in integers.

Vectors lie in blocks of ``BLOCK`` rows with their bounds, in a staged table that each round writes anew and whose
predecessor goes, so that a lost executor costs its tasks of one round. Each block also holds the sums of its
vectors by centroid; their totals, as many as centroids x components, come to the driver.

Defined results: a vector takes part if it has ``dims`` components, none null or not a finite number; others give no
row. Equal distances go to the smaller number; a centroid without vectors stays. Repeated ids each keep their own row;
a null id hashes as the empty text; of vectors with one hash the smaller comes first. With fewer vectors than
centroids each vector starts one; an empty table gives an empty one. Components of any finite size are held
exactly; a distance or sum beyond a long is null. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import stage, unstage

SCALE = 1024
BLOCK = 4096
#: Bounds decide only if they lie this far apart, relative to the larger.
MARGIN = 1e-9
#: Components below this are held as 64-bit integers: differences, squares and their sums over 2^12 components fit.
SMALL = 1 << 24
#: Sums go to Spark in digits of so many bits.
DIGIT = 40
LONGEST = (1 << 63) - 1


def usable(vector: Column, dims: int) -> Column:
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def whole_number(x: float) -> int:
    """floor(SCALE * x), exactly."""
    return math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE


def components(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """Rows of integers; Python's own where one doesn't fit 64 bits with its square."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) and np.abs(flat).max() * SCALE >= SMALL:
        flat = np.array([whole_number(x) for x in flat.tolist()], object)
    else:
        flat = np.floor(flat * SCALE).astype(np.int64)
    return flat.reshape(-1, dims)


def squares(rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    away = rows - centroid
    return (away * away).sum(1)


def root(x: int) -> float:
    """The square root of a whole number of any size; infinite beyond what a double holds."""
    return math.sqrt(x) if x < 1 << 1020 else float("inf")


class Bounds:
    """Vectors of a block with the bounds of each."""

    def __init__(self, rows: np.ndarray, kept: int) -> None:
        n = len(rows)
        self.rows, self.measured, self.deepest = rows, 0, 0
        self.own, self.upper = np.zeros(n, np.int64), np.full(n, np.inf)
        self.near, self.low, self.rest = np.zeros((n, kept), np.int64), np.full((n, kept), -np.inf), np.full(n, -np.inf)

    def keep(self, kept: int) -> None:
        """Keep bounds of ``kept`` centroids a vector: the others fall to the rest."""
        if kept < self.low.shape[1]:
            self.rest = np.minimum(self.rest, self.low[:, kept:].min(1))
            self.near, self.low = self.near[:, :kept], self.low[:, :kept]

    def move(self, ways: np.ndarray) -> None:
        """Centroids moved by ``ways``."""
        self.upper = self.upper + ways[self.own]
        self.low = self.low - ways[self.near]
        self.rest = self.rest - ways.max()

    def _exact(self, at: np.ndarray, numbers: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Squared distances of rows ``at`` to the centroids of the same row of ``numbers``, in integers."""
        self.measured += numbers.size
        out = np.empty(numbers.shape, self.rows.dtype if centroids.dtype != object else object)
        for c in range(numbers.shape[1]):
            out[:, c] = squares(self.rows[at], centroids[numbers[:, c]])
        return out

    def _order(self, at: np.ndarray, numbers: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``numbers`` of each row from near to far, ties to the smaller, and the distances."""
        numbers = np.sort(numbers, axis=1)
        exact = self._exact(at, numbers, centroids)
        order = np.argsort(exact, axis=1, kind="stable")
        roots = np.sqrt(exact.astype(np.float64)) if exact.dtype != object else np.array([[root(int(x)) for x in r] for r in exact], np.float64).reshape(exact.shape)
        return np.take_along_axis(numbers, order, 1), np.take_along_axis(roots, order, 1)

    def assign(self, centroids: np.ndarray) -> None:
        """Every vector to its nearest centroid."""
        kept, k = self.low.shape[1], len(centroids)
        self.deepest = 0
        with np.errstate(invalid="ignore"):
            # the least of the bounds from each place on: nothing from there on is nearer
            beyond = np.minimum.accumulate(np.concatenate((self.low, self.rest[:, None]), axis=1)[:, ::-1], axis=1)[:, ::-1]
            sure = lambda at, place: self.upper[at] * (1 + MARGIN) < beyond[at, place] * (1 - MARGIN)
            open_ = np.flatnonzero(~sure(np.arange(len(self.rows)), 0))
            seen = open_[np.isfinite(self.upper[open_])]
            if len(seen):
                exact = self._exact(seen, self.own[seen, None], centroids)[:, 0]
                self.upper[seen] = np.sqrt(exact.astype(np.float64)) if exact.dtype != object else [root(int(x)) for x in exact]
                open_ = open_[~sure(open_, 0)]
            for place in range(1, kept + 1):
                if not len(open_):
                    return
                settled = sure(open_, place)
                at, open_ = open_[settled], open_[~settled]
                if len(at):
                    numbers, roots = self._order(at, np.concatenate((self.own[at, None], self.near[at, :place]), axis=1), centroids)
                    self.own[at], self.upper[at] = numbers[:, 0], roots[:, 0]
                    self.near[at, :place], self.low[at, :place] = numbers[:, 1:], roots[:, 1:]
                    self.deepest = place
        if len(open_):
            self.deepest = kept + 1
            numbers, roots = self._order(open_, np.tile(np.arange(k), (len(open_), 1)), centroids)
            self.own[open_], self.upper[open_] = numbers[:, 0], roots[:, 0]
            self.near[open_], self.low[open_] = numbers[:, 1 : kept + 1], roots[:, 1 : kept + 1]
            self.rest[open_] = roots[:, kept + 1] if k > kept + 1 else np.inf

    def sums(self, k: int, digits: int) -> np.ndarray:
        """k x (components + 1) x digits: sums of each centroid's vectors and their number, lowest digit first."""
        out = np.zeros((k, self.rows.shape[1] + 1, digits), np.int64)
        for c in range(k):
            own = self.rows[self.own == c]
            total = [*(own.sum(0).tolist() if len(own) else [0] * self.rows.shape[1]), len(own)]
            for d in range(digits):
                out[c, :, d] = [x >> DIGIT * d & (1 << DIGIT) - 1 if d + 1 < digits else x >> DIGIT * d for x in total]
        return out


#: A row for each block; ``deepest``: how far the last round had to look, ``measured``: distances taken in it.
STATE = "ids array<long>, vector array<array<{kind}>>, own array<int>, upper array<double>, near array<array<int>>, low array<array<double>>, rest array<double>, sums array<long>, deepest int, measured long"


def _state_batch(ids: pa.Array, vector: pa.Array, b: Bounds, k: int, digits: int) -> pa.RecordBatch:
    n, kept = b.low.shape
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    lists = lambda x, kind: one(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * kept, pa.int32()), pa.array(x.ravel(), kind)))
    columns = [
        one(ids), one(vector), one(pa.array(b.own, pa.int32())), one(pa.array(b.upper)), lists(b.near, pa.int32()), lists(b.low, pa.float64()), one(pa.array(b.rest)),
        one(pa.array(b.sums(k, digits).ravel())), pa.array([b.deepest], pa.int32()), pa.array([b.measured], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in STATE.split(", ")])


def _start_udf(centroids: np.ndarray, dims: int, kept: int, digits: int):
    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                bounds = Bounds(components(part, dims), kept)
                bounds.assign(centroids)
                yield _state_batch(part.column("vec_id"), part.column("vector"), bounds, len(centroids), digits)

    return start


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, pa.Array, Bounds]]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            values = lambda c: row.column(c).flatten()  # noqa: B023, E731
            vector = values("vector")
            n = len(vector)
            bounds = Bounds(components(pa.RecordBatch.from_arrays([vector], ["vector"]), dims), 0)
            array = lambda c: values(c).to_numpy(zero_copy_only=False).copy()  # noqa: B023, E731
            table = lambda c: values(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).copy()  # noqa: B023, E731
            bounds.own, bounds.upper, bounds.near, bounds.low, bounds.rest = array("own").astype(np.int64), array("upper"), table("near").astype(np.int64), table("low"), array("rest")
            yield values("ids"), vector, bounds


def _round_udf(centroids: np.ndarray, ways: np.ndarray, dims: int, kept: int, digits: int):
    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vector, bounds in _blocks(batches, dims):
            bounds.keep(kept)
            bounds.move(ways)
            bounds.assign(centroids)
            yield _state_batch(ids, vector, bounds, len(centroids), digits)

    return again


def _result_udf(centroids: np.ndarray, dims: int):
    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, bounds in _blocks(batches, dims):
            exact = bounds._exact(np.arange(len(ids)), bounds.own[:, None], centroids)[:, 0].tolist()
            # digits, lowest first: a whole distance may be beyond a long
            digits = [pa.array([x >> DIGIT * d & (1 << DIGIT) - 1 for x in exact], pa.int64()) for d in range(2)]
            top = pa.array([float(x >> 2 * DIGIT) if x >> 2 * DIGIT < 1 << 1020 else float("inf") for x in exact], pa.float64())
            short = pa.array([x if x <= LONGEST else None for x in exact], pa.int64())
            yield from pa.table([ids, pa.array(bounds.own, pa.int32()), short, *digits, top], names=["vec_id", "cluster", "distance", "d0", "d1", "top"]).to_batches(1 << 16)

    return result


def _totals(state: DataFrame, k: int, dims: int, digits: int) -> tuple[list[list[int]], list[int]]:
    """Exact sums and sizes of all centroids."""
    parts = state.select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n")).collect()
    flat = [0] * (k * (dims + 1))
    for r in parts:
        flat[r["at"] // digits] += int(r["n"]) << DIGIT * (r["at"] % digits)
    rows = [flat[c * (dims + 1) : (c + 1) * (dims + 1)] for c in range(k)]
    return [r[:-1] for r in rows], [r[-1] for r in rows]


def _array(rows: list[list[int]]) -> np.ndarray:
    return np.array(rows, object if any(abs(x) >= SMALL for r in rows for x in r) else np.int64)


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hash of seed and id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [[whole_number(x) for x in r["vector"]] for r in vectors.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()]


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]], list[int]]:
    """(vec_id, cluster, distance, d0, d1, top) of every vector; the final centroids; distances measured in each round.

    d0, d1: the lowest two digits of the distance, of ``DIGIT`` bits each, and top: what is above them.
    """
    kind = "float" if vectors.schema[vector].dataType.elementType == FloatType() else "double"
    schema = STATE.format(kind=kind)
    rows = vectors.where(usable(F.col(vector), dims)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("vector"))
    centroids = first_centroids(rows, k, seed)
    k = len(centroids)
    if not k:
        return rows.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "d0", "d1")], F.lit(0.0).alias("top")), [], []
    highest = rows.agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))).first()[0]
    # a block's sum of components has 13 bits more than each of them
    digits = max(1, math.ceil((max(1, abs(whole_number(float(highest)))).bit_length() + 14) / DIGIT))
    kept = min(k - 1, max(1, k // 2))
    state = stage(rows.mapInArrow(_start_udf(_array(centroids), dims, kept, digits), schema), "cluster-state")
    measured = []
    for _ in range(rounds):
        sums, sizes = _totals(state, k, dims, digits)
        moved = [[x // n for x in s] if n else c for c, s, n in zip(centroids, sums, sizes, strict=True)]
        ways = np.array([root(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))) * (1 + MARGIN) for a, b in zip(centroids, moved, strict=True)])
        deepest = state.agg(F.max("deepest"), F.sum("measured")).first()
        measured.append(deepest[1])
        kept = min(kept, max(1, min(deepest[0], k - 1)))
        centroids = moved
        then = stage(state.mapInArrow(_round_udf(_array(centroids), ways, dims, kept, digits), schema), "cluster-state")
        unstage(state)
        state = then
    measured.append(state.agg(F.sum("measured")).first()[0])
    return state.mapInArrow(_result_udf(_array(centroids), dims), "vec_id long, cluster int, distance long, d0 long, d1 long, top double"), centroids, measured


def _long(low: Column, high: Column, top: Column) -> Column:
    """A sum from the sums of its digits; null beyond a long."""
    total = low + high * F.lit(Decimal(1 << DIGIT)).cast("decimal(38,0)")
    return F.when((top == 0) & (total <= F.lit(Decimal(LONGEST)).cast("decimal(38,0)")), total).cast("long")


def cluster_digest(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    found, centroids, _ = cluster_vectors(vectors, k, rounds, dims, seed, vec_id, vector)
    found = stage(found, "cluster-result")
    spark = vectors.sparkSession
    digit = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    totals = found.groupBy("cluster").agg(digit("d0"), digit("d1"), F.sum("top").alias("top"))
    every = Window.partitionBy()  # one row a centroid
    totals = totals.select("cluster", _long(F.col("d0"), F.col("d1"), F.col("top")).alias("cluster_inertia"), _long(F.sum("d0").over(every), F.sum("d1").over(every), F.sum("top").over(every)).alias("inertia"))
    hashes = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    return found.select("vec_id", "cluster", "distance").join(F.broadcast(totals.join(F.broadcast(named), "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clustering_sql(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    """DuckDB SQL of ``cluster_digest`` over ``embeddings``, every distance measured in every round."""
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) - 1 AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"cells AS MATERIALIZED (SELECT r, i, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {dims + 1}) AS t(i))",
        f"c0 AS MATERIALIZED (SELECT CAST(r AS INTEGER) AS c, i, x FROM cells WHERE r < {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} AS (SELECT v.r, m.c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS d FROM cells v JOIN c{n} m ON v.i = m.i GROUP BY v.r, m.c)")
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, c, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if n < rounds:
            # // cuts toward zero: what is left over tells where the floor lies one below
            new = f"SELECT a.c, v.i, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n FROM a{n} a JOIN cells v ON a.r = v.r GROUP BY a.c, v.i"
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT o.c, o.i, CASE WHEN w.n IS NULL THEN o.x WHEN w.s < 0 AND w.s % w.n <> 0 THEN w.s // w.n - 1 ELSE w.s // w.n END AS x FROM c{n} o LEFT JOIN ({new}) w ON o.c = w.c AND o.i = w.i)")
    last = f"SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c"
    return f"WITH {', '.join(parts)} SELECT k.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.h AS centroid_sha256 FROM a{rounds} a JOIN kept k ON a.r = k.r JOIN ({last}) h ON a.c = h.c"
