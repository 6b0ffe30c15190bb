"""Nearest neighbours by stable projections under a kd-tree, with a chi-square stopping test.

Vectors are projected onto ``DIMS`` Gaussian directions. The squared projected distance of a vector
over its squared true distance is chi-square distributed, so a search may take the vectors in the
order of their projected distances, verify each in full, and stop once a vector as near as the
current k-th best would be projected that far only with probability 1 - ``SURE``. A neighbour is
missed with at most that probability.

The top levels of the tree are learnt from a bounded sample (``SAMPLE``) and cut all vectors into
*blocks*; every row is indexed, each in one block. A block has a kd-tree of its own over the
projections. A query first meets the block it falls into; then, with the k-th distance found there,
only those blocks that the same test does not rule out by the distance to their regions. Queries
travel and vectors do not, but for a block with more queries than one task takes.

Of equal vectors the k + 1 smallest ids are candidates, as the others cannot be among the k nearest
of any query; so a vector that a third of all rows hold does not swell a block.

Vectors that are null, zero or hold null or non-finite components and rows with a null id take no
part. Rows that repeat an id count once, with the least vector. Only vectors of the query's length
are its candidates. Other columns are dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

DIMS, SURE, LEAF = 24, 0.94, 64
#: Candidates of a block, about, up to this many blocks; then blocks grow.
BLOCK_ROWS, BLOCKS = 8192, 65_536
#: Rows that the blocks are learnt from at most, and queries of one task.
SAMPLE, CHUNK_ROWS = 262_144, 20_000


def projected_share(x: np.ndarray, dims: int) -> np.ndarray:
    """The chi-square distribution function for an even number of dimensions."""
    half = np.minimum(np.asarray(x, np.float64) / 2, 700)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total += term
    return 1 - np.exp(-half) * total


def ruled_out(gap: np.ndarray, worst: float) -> np.ndarray:
    """Whether vectors at squared projected distances ``gap`` need no look, with the k-th squared distance ``worst``."""
    if worst == math.inf:
        return np.zeros(np.shape(gap), bool)
    return (gap > 0) & (projected_share(gap / worst, DIMS) >= SURE if worst > 0 else True)


def directions(size: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, DIMS))


def _gaps(lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    gap = np.maximum(np.maximum(lo - at, at - hi), 0)
    return (gap * gap).sum(1)


class Regions:
    """The top levels of the tree: cuts of the projected space into blocks, learnt from a sample."""

    def __init__(self, sample: np.ndarray, blocks: int):
        self.cuts: list[tuple[int, float, int, int]] = []  # axis, value, the lower and the upper side: a cut, or ~block
        self.lo, self.hi = [], []
        self.top = self._cut(sample, blocks, np.full(DIMS, -np.inf), np.full(DIMS, np.inf))
        self.lo, self.hi = np.array(self.lo, np.float32), np.array(self.hi, np.float32)

    def _cut(self, rows: np.ndarray, blocks: int, lo: np.ndarray, hi: np.ndarray) -> int:
        if blocks > 1 and len(rows) > 1:
            axis = int(np.ptp(rows, axis=0).argmax())
            under = blocks // 2
            value = float(np.quantile(rows[:, axis], under / blocks))
            low = rows[:, axis] <= value
            if 0 < low.sum() < len(rows):
                here = len(self.cuts)
                self.cuts.append((0, 0.0, 0, 0))
                left, right = hi.copy(), lo.copy()
                left[axis] = right[axis] = value
                self.cuts[here] = (axis, value, self._cut(rows[low], under, lo, left), self._cut(rows[~low], blocks - under, right, hi))
                return here
        self.lo.append(lo)
        self.hi.append(hi)
        return ~(len(self.lo) - 1)

    def home(self, low: np.ndarray) -> np.ndarray:
        """The block of each projected vector."""
        at = np.full(len(low), self.top)
        while (rows := np.flatnonzero(at >= 0)).size:
            cuts = np.array(self.cuts)[at[rows]]
            side = low[rows, cuts[:, 0].astype(int)] > cuts[:, 1]
            at[rows] = np.where(side, cuts[:, 3], cuts[:, 2])
        return ~at


class Block:
    """A kd-tree over the projections of vectors; leaves are runs of rows with a bounding box."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.turn = directions(vectors.shape[1])
        low = self.vectors @ self.turn
        runs, todo = [], [np.arange(len(low))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                runs.append(rows)
                continue
            axis = int(np.ptp(low[rows], axis=0).argmax())
            half = len(rows) // 2
            rows = rows[np.argpartition(low[rows, axis], half)]
            todo += [rows[:half], rows[half:]]
        self.rows, self.low = np.concatenate(runs), low
        self.edges = np.cumsum([0, *map(len, runs)])
        self.lo = np.stack([low[r].min(0) for r in runs])
        self.hi = np.stack([low[r].max(0) for r in runs])
        self.verified = 0

    def _nearer(self, at: np.ndarray):
        """Runs of (row, squared projected distance), the runs and their rows in ascending order of distance."""
        bound = _gaps(self.lo, self.hi, at)
        order = np.argsort(bound, kind="stable")
        rows, far, done, step = np.empty(0, np.int64), np.empty(0), 0, 4
        while done < len(order):
            new = np.concatenate([self.rows[self.edges[i] : self.edges[i + 1]] for i in order[done : done + step]])
            off = self.low[new] - at
            rows, far = np.concatenate([rows, new]), np.concatenate([far, np.einsum("ij,ij->i", off, off)])
            done, step = done + step, step * 2
            # what lies nearer than any leaf not yet opened comes next
            ready = far <= bound[order[done]] if done < len(order) else np.ones(len(far), bool)
            if ready.any():
                by = np.flatnonzero(ready)[np.argsort(far[ready], kind="stable")]
                yield rows[by], far[by]
                rows, far = rows[~ready], far[~ready]

    def search(self, query: np.ndarray, own: int, k: int, worst: float = math.inf) -> list[tuple[float, int]]:
        """The (distance, id) of the k nearest found, without rows of id ``own``; ``worst`` is a k-th squared distance known already."""
        got_d, got_i = np.empty(0), np.empty(0, np.int64)
        for run, far in self._nearer(query @ self.turn):
            for at in range(0, len(run), 64):
                if ruled_out(far[at : at + 1], worst)[0]:
                    return self._listed(got_d, got_i)
                rows = run[at : at + 64]
                off = self.vectors[rows] - query
                d, ids = np.einsum("ij,ij->i", off, off), self.ids[rows]
                self.verified += len(rows)
                keep = (d <= worst) & (ids != own)
                got_d, got_i = np.concatenate([got_d, d[keep]]), np.concatenate([got_i, ids[keep]])
                best = np.lexsort((got_i, got_d))[:k]
                got_d, got_i = got_d[best], got_i[best]
                if len(got_d) == k:
                    worst = min(worst, float(got_d[-1]))
        return self._listed(got_d, got_i)

    @staticmethod
    def _listed(d: np.ndarray, ids: np.ndarray) -> list[tuple[float, int]]:
        return [(math.sqrt(x), int(i)) for x, i in zip(d, ids, strict=True)]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _by_size(batch: pa.RecordBatch):
    """(length, rows, vectors) for each length of vectors in a batch with columns d and v."""
    sizes = batch.column("d").to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        part = batch.filter(pa.array(sizes == size))
        yield size, part, _matrix(part.column("v"), size)


def _learn(candidates: DataFrame) -> dict[int, Regions]:
    """Regions for each length of vectors, from a sample by hashed id that is bounded up to chance."""
    counts = {r["d"]: r["n"] for r in candidates.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = min(1.0, SAMPLE / max(1, sum(counts.values())))

    def run(batches):
        for batch in batches:
            for size, _, vectors in _by_size(batch):
                low = (vectors @ directions(size)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([low.tobytes()], pa.binary())], ["d", "low"])

    picked = candidates.filter(F.expr(f"pmod(xxhash64(id, 'regions'), 1000000) < {int(share * 1_000_000)}")).select("d", "v")
    parts: dict[int, list[np.ndarray]] = {}
    for r in picked.mapInArrow(run, "d int, low binary").collect():
        parts.setdefault(r["d"], []).append(np.frombuffer(r["low"], np.float32).reshape(-1, DIMS))
    out = {}
    for size, n in counts.items():
        sample = np.concatenate(parts.get(size, [np.empty((0, DIMS), np.float32)]))
        out[size] = Regions(sample[np.lexsort(sample.T)], min(BLOCKS, -(-n // BLOCK_ROWS)))
    return out


PLACED = "d int, block int, id long, v array<double>"
ASKED = PLACED + ", worst double"


def _searched(placed: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): what each of ``asks`` (rows like ASKED) finds in its block."""
    parts = asks.groupBy("d", "block").agg(F.expr(f"(count(1) + {CHUNK_ROWS - 1}) div {CHUNK_ROWS}").alias("parts"))
    parts = F.broadcast(parts)  # one row per block, BLOCKS at most for each length
    chunk = F.expr("pmod(xxhash64(id, 1), parts)").alias("chunk")
    left = placed.join(parts, ["d", "block"]).select("d", "block", F.explode(F.expr("sequence(0L, parts - 1)")).alias("chunk"), "id", "v")
    right = asks.join(parts, ["d", "block"]).select("d", "block", chunk, "id", "v", "worst")

    def run(key, held, asked):
        out, size = [], key[0].as_py()
        if held.num_rows and asked.num_rows:
            block = Block(held.column("id").to_numpy(), _matrix(held.column("v"), size))
            for own, query, worst in zip(asked.column("id").to_pylist(), _matrix(asked.column("v"), size), asked.column("worst").to_pylist(), strict=True):
                out += [(own, i, d) for d, i in block.search(query, own, k, worst)]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    keys = ["d", "block", "chunk"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")


def nearest(rows: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per query its ``k`` nearest rows: query_id, rank, vec_id, score (Euclidean distance)."""
    spark = rows.sparkSession
    fits = "size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    valid = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks")).filter("id is not null and v is not null").filter(fits)
    valid = common.persist(valid.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")).withColumn("d", F.size("v")), "vectors")
    # of equal vectors the first ids only; the limit is applied before the exchange too
    order = Window.partitionBy("v").orderBy("id")
    candidates = valid.select("id", "v", "d").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1).drop("nth")
    candidates = common.persist(candidates, "candidates")
    regions = spark.sparkContext.broadcast(_learn(candidates))

    def place(batches):
        for batch in batches:
            for size, part, vectors in _by_size(batch):
                block = regions.value[size].home(vectors @ directions(size))
                yield pa.RecordBatch.from_arrays([part.column("d"), pa.array(block, pa.int32()), part.column("id"), part.column("v")], ["d", "block", "id", "v"])

    def others(batches):
        """Every block but the own that the k-th distance found there does not rule out."""
        for batch in batches:
            for size, part, vectors in _by_size(batch):
                low, own = vectors @ directions(size), part.column("block").to_pylist()
                at, blocks = [], []
                for i, worst in enumerate(part.column("worst").to_pylist()):
                    gap = _gaps(regions.value[size].lo, regions.value[size].hi, low[i])
                    found = np.flatnonzero(~ruled_out(gap, worst))
                    found = found[found != own[i]]
                    at += [i] * len(found)
                    blocks += found.tolist()
                part = part.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("d"), pa.array(blocks, pa.int32()), part.column("id"), part.column("v"), part.column("worst")], ["d", "block", "id", "v", "worst"])

    placed = common.persist(candidates.select("d", "id", "v").mapInArrow(place, PLACED), "placed")
    asks = common.persist(valid.filter("asks").select("d", "id", "v").mapInArrow(place, PLACED).withColumn("worst", F.lit(math.inf)), "asks")
    first = common.persist(_searched(placed, asks, k), "first")
    met = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.pow(F.max("score"), 2) * (1 + 1e-9)).otherwise(math.inf).alias("worst"))
    more = asks.drop("worst").join(met, asks.id == met.query_id, "left").withColumn("worst", F.coalesce("worst", F.lit(math.inf)))
    more = common.persist(more.select("d", "block", "id", "v", "worst").mapInArrow(others, ASKED), "others")
    found = first.unionAll(_searched(placed, more, k))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
