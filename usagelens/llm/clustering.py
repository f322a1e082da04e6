"""Centroid clustering over a Hilbert curve with zone maps.

Vectors become integers, are ordered along a Hilbert curve and cut into blocks
of neighbours. Every block keeps the smallest and largest value of each
component (its box). In a round, the distance from a centroid to the box bounds
the distance to every vector in it from below and above: a centroid whose lower
bound exceeds another one's upper bound cannot be nearest to any vector of the
block. The candidates left are compared exactly with all vectors of the block
at once. Sums are combined in the tasks; only the centroids themselves (k rows)
pass through the driver. All arithmetic is on integers, so results don't depend
on partitioning or order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import col, stored

DIM, K, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
BLOCK = 256
# Bits of a component along the curve; components are held within +-LIMIT.
BITS = 4
LIMIT = 1 << 26
_LONG = (1 << 63) - 1


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> list[bytes]:
    """Positions of grid points (rows of 0 <= cell < 2**bits) along the Hilbert
    curve, as bytes that sort like numbers (Skilling's transform)."""
    x = cells.astype(np.uint32).T.copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        below = np.uint32((1 << b) - 1)
        for i in range(d):
            high = (x[i] >> np.uint32(b)) & np.uint32(1) == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & below).astype(np.uint32)
            x[0] ^= np.where(high, below, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[d - 1] >> np.uint32(b)) & np.uint32(1) == 1, np.uint32((1 << b) - 1), np.uint32(0))
    x ^= flip
    planes = np.stack([(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)])
    packed = np.packbits(planes.transpose(2, 0, 1).reshape(cells.shape[0], -1).astype(np.uint8), axis=1)
    return [r.tobytes() for r in packed]


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id, v array<int>): floor(scale * x) of the vectors with exactly ``dim``
    components, none null or non-finite."""
    kind = dict(vectors.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            keep = np.flatnonzero((sizes == dim) & lists.is_valid().to_numpy(zero_copy_only=False))
            flat = lists.take(pa.array(keep)).flatten()
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)   # nulls become NaN
            fine = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                v = np.clip(np.floor(x[fine] * scale), -LIMIT, LIMIT).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep[fine])), _lists(v)], names=["id", "v"])

    return vectors.select(col(vectors, id_col).alias("id"), col(vectors, vec_col).alias("v")).mapInArrow(run, f"id {kind}, v array<int>")


def _lists(rows: np.ndarray) -> pa.ListArray:
    ends = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1)))


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def hilbert_blocks(rows: DataFrame, dim: int = DIM, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """(id, v) -> (ids, v, lo, hi): blocks of at most ``block`` neighbours on the
    curve, vectors one after another in ``v``. The grid spans two deviations to
    either side of each component's mean, the most varied components lead; both
    only steer the order. Equal vectors are spread by a hash of their ids, so a
    hot vector does not fill one partition."""
    kind = rows.schema["id"].dataType.simpleString()
    stats = rows.agg(*[f(F.col("v")[i].cast("double")) for i in range(dim) for f in (F.avg, F.stddev_pop)]).first()
    mean, spread = (np.array([s or 0.0 for s in stats[k::2]]) for k in (0, 1))
    lead = np.argsort(-spread, kind="stable")
    width = np.maximum(4 * spread, 1e-9)

    def keyed(batches):
        for batch in batches:
            v = _matrix(batch.column(1), dim)
            cells = np.clip(((v - mean) / width + 0.5) * (1 << bits), 0, (1 << bits) - 1)[:, lead]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(cells, bits), pa.binary())], names=["id", "v", "key"])

    def cut(batches):
        held = None
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            while held.num_rows >= block:
                yield boxed(held.slice(0, block))
                held = held.slice(block)
        if held is not None and held.num_rows:
            yield boxed(held)

    def boxed(part):
        part = part.combine_chunks()
        v = _matrix(part["v"].chunk(0), dim)
        ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part["id"].chunk(0))
        return pa.RecordBatch.from_arrays([ids, _lists(v.reshape(1, -1)), _lists(v.min(axis=0)[None]), _lists(v.max(axis=0)[None])],
                                          names=["ids", "v", "lo", "hi"])

    order = ["key", "salt"]
    return (rows.mapInArrow(keyed, f"id {kind}, v array<int>, key binary").withColumn("salt", F.xxhash64("id"))
            .repartitionByRange(*order).sortWithinPartitions(*order).select("id", "v")
            .mapInArrow(cut, f"ids array<{kind}>, v array<int>, lo array<int>, hi array<int>"))


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some point of the box."""
    lo, hi = lo.astype(np.int64), hi.astype(np.int64)
    outside = np.maximum(np.maximum(lo - centroids, centroids - hi), 0)
    farthest = np.maximum(np.abs(centroids - lo), np.abs(centroids - hi))
    return np.flatnonzero((outside * outside).sum(axis=1) <= (farthest * farthest).sum(axis=1).min())


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid, smaller number first."""
    most = max(int(np.abs(a).max(initial=0)) for a in (v, centroids))
    if 4 * v.shape[1] * most * most < 1 << 53:   # every product and sum is exact in doubles
        x, c = v.astype(np.float64), centroids.astype(np.float64)
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None]
    else:
        d = np.empty((len(v), len(centroids)), dtype=np.int64)
        for k, c in enumerate(centroids):
            gap = v.astype(np.int64) - c
            d[:, k] = (gap * gap).sum(axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(v)), best].astype(np.int64)


def _blocks(batch: pa.RecordBatch, dim: int, centroids: np.ndarray):
    """(ids, vectors, numbers, distances) of every block of a batch."""
    for ids, v, lo, hi in zip(*(batch.column(i) for i in range(4))):
        x = v.values.to_numpy().reshape(-1, dim)
        maybe = candidates(lo.values.to_numpy(), hi.values.to_numpy(), centroids)
        best, distance = nearest(x, centroids[maybe])
        yield ids.values, x, maybe[best], distance


def _next(blocks: DataFrame, centroids: np.ndarray, dim: int) -> np.ndarray:
    """The centroids after one round. Tasks add up vectors by centroid; the
    shuffle carries at most k rows of each task."""
    k = len(centroids)

    def sums(batches):
        total, count = np.zeros((k, dim), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            for _, x, number, _ in _blocks(batch, dim, centroids):
                for c in np.unique(number):
                    total[c] += x[number == c].sum(axis=0, dtype=np.int64)
                count += np.bincount(number, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), _lists(total[some])], names=["cluster", "n", "total"])

    rows = (blocks.mapInArrow(sums, "cluster bigint, n bigint, total array<bigint>")
            .select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i")
            .agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect())
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["i"]] = r["x"] // r["n"]
    return out


def candidate_share(blocks: DataFrame, centroids: np.ndarray, dim: int = DIM) -> float:
    """Share of (vector, centroid) pairs that the boxes leave to compare."""
    def count(batches):
        for batch in batches:
            sizes = [(len(ids), len(candidates(lo.values.to_numpy(), hi.values.to_numpy(), centroids)))
                     for ids, lo, hi in zip(batch.column(0), batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([pa.array([sum(m * c for m, c in sizes)]), pa.array([sum(m for m, _ in sizes)])], names=["left", "rows"])

    left, rows = blocks.mapInArrow(count, "left bigint, rows bigint").agg(F.sum("left"), F.sum("rows")).first()
    return left / (rows * len(centroids)) if rows else 0.0


def start(rows: DataFrame, k: int = K, seed: int = SEED, dim: int = DIM) -> np.ndarray:
    """The k vectors with the smallest sha256 of "seed:id" (null id: nothing
    after the colon; equal ids by their components), in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(k).collect()
    return np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, dim)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, k: int = K, rounds: int = ROUNDS,
            scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per kept vector: (vec_id, cluster, distance, cluster_inertia,
    inertia, centroid_sha256).

    Kept are vectors with exactly ``dim`` components, none null or non-finite;
    others (null vectors too) give no row. Components become floor(scale * x),
    held within +-2**26 so that squared distances fit a bigint. k vectors chosen
    by hash start; in each round vectors go to the nearest centroid (ties: the
    smaller number) and non-empty centroids move to the floor of their mean. With
    fewer than k vectors there are that many centroids. Repeated rows come back
    as often as they occur, null ids stay null; an inertia beyond bigint is given
    as its largest value. Extra columns are ignored; an empty table gives an
    empty result."""
    if min(k, dim, scale) < 1 or rounds < 0:
        raise ValueError("k, dim and scale must be positive, rounds not negative")
    rows = whole_vectors(vectors, id_col, vec_col, dim, scale)
    kind = rows.schema["id"].dataType.simpleString()
    centroids = start(rows, k, seed, dim)
    blocks = stored(hilbert_blocks(rows, dim, BLOCK), "cluster-blocks")
    for _ in range(rounds if len(centroids) else 0):
        centroids = _next(blocks, centroids, dim)

    def assign(batches):
        for batch in batches:
            for ids, _, number, distance in _blocks(batch, dim, centroids):
                yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    placed = stored(blocks.mapInArrow(assign, f"vec_id {kind}, cluster int, distance bigint"), "cluster-placed")
    sums = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = min(sum(sums.values()), _LONG)
    known = [(i, min(d, _LONG), whole, hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, d in sums.items()]
    named = placed.sparkSession.createDataFrame(known, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(named), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
