"""Centroid clustering of vectors with Orchard's search.

Every centroid has a list of the others by distance.  A vector starts at some centroid
and goes down its list; whenever a closer centroid is found the search jumps to that
one's list, centroids looked at before are marked, and it stops at the first entry that
is more than twice as far from the list's centroid as the vector is.  By the triangle
inequality nothing after it can be as near.  All distances are squared and integers, so
results are exact and ties can be told.

Spark hands each task Arrow batches; a task returns one row of sums per centroid, and
only those of all centroids together reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import stage

K = 40
ROUNDS = 5
SEED = 2
SIZE = 64
SCALE = 256
#: Components beyond this are taken as this, so that squared distances of up to 64 of
#: them fit a long.
LARGEST = 2**27


def integers(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and _v (array of integers) of the vectors with ``size`` finite components."""
    value = F.transform("embedding", lambda x: x.cast("double") * scale)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(value, lambda x: F.floor(F.greatest(F.least(x, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    kept = (F.size("embedding") == size) & finite
    return vectors.where(F.coalesce(kept, F.lit(False))).select("vec_id", whole.alias("_v"))


def first_centroids(ints: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors with the ``k`` smallest hashes of seed and id, in that order.

    Vectors without an id come after all others; equal hashes are ordered by vector.
    """
    hashed = F.coalesce(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), F.lit("~"))
    rows = ints.select(hashed.alias("_h"), "_v").orderBy("_h", "_v").limit(k).collect()
    return np.array([r["_v"] for r in rows], np.int64)


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every centroid the others by distance, and those squared distances."""
    gap = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(gap, -1)
    order = np.argsort(gap, axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(gap, order, axis=1)


def nearest(
    points: np.ndarray, centroids: np.ndarray, start: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: the smaller number) and squared distance of every point.

    The third result is the number of distances worked out.  All points take one step of
    their own search at a time.
    """
    order, gap = neighbour_lists(centroids)
    n, last = len(points), order.shape[1]
    at = np.zeros(n, np.int64) if start is None else start.astype(np.int64)
    dist = ((points - centroids[at]) ** 2).sum(axis=1)
    best, computed = at.copy(), n
    seen = np.zeros((n, len(centroids)), bool)
    seen[np.arange(n), at] = True
    place = np.zeros(n, np.int64)
    alive = np.arange(n) if last else np.arange(0)
    while len(alive):
        # Strictly beyond twice the distance: four times the square.
        alive = alive[place[alive] < last]
        alive = alive[gap[at[alive], place[alive]] <= 4 * dist[alive]]
        other = order[at[alive], place[alive]]
        place[alive] += 1
        new = ~seen[alive, other]
        i, c = alive[new], other[new]
        seen[i, c] = True
        d = ((points[i] - centroids[c]) ** 2).sum(axis=1)
        computed += len(i)
        tie = (d == dist[i]) & (c < best[i])
        best[i[tie]] = c[tie]
        closer = d < dist[i]
        j = i[closer]
        at[j] = best[j] = c[closer]
        dist[j] = d[closer]
        place[j] = 0
    return best, dist, computed


def _points(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


def assign(ints: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``ints`` with the columns cluster and distance; a column cluster is where searches start."""
    begin, size = "cluster" in ints.columns, centroids.shape[1]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = batch.column("cluster").to_numpy() if begin else None
            best, dist, _ = nearest(_points(batch, size), centroids, start)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("_v"), pa.array(best, pa.int32()), pa.array(dist, pa.int64())],
                names=["vec_id", "_v", "cluster", "distance"],
            )

    kind = ints.schema["vec_id"].dataType.simpleString()
    return ints.mapInArrow(search, f"vec_id {kind}, _v array<int>, cluster int, distance long")


def moved(ints: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after every vector has gone to its nearest one; empty ones stay."""
    k, size = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, size + 1), np.int64)
        for batch in batches:
            points = _points(batch, size)
            best, _, _ = nearest(points, centroids, batch.column("cluster").to_numpy())
            by = np.argsort(best, kind="stable")
            numbers, first = np.unique(best[by], return_index=True)
            if len(numbers):
                sums[numbers, :size] += np.add.reduceat(points[by], first, axis=0)
                sums[:, size] += np.bincount(best, minlength=k)
        used = np.flatnonzero(sums[:, size])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["c", "s"]
        )

    parts = ints.select("_v", "cluster").mapInArrow(add, "c int, s array<long>")
    rows = parts.select("c", F.posexplode("s").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((k, size + 1), np.int64)
    for r in rows:
        total[r["c"], r["i"]] = r["x"]
    count = total[:, size:]
    return np.where(count > 0, total[:, :size] // np.maximum(count, 1), centroids)


def cluster(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, _v, cluster and distance of every kept vector, and the centroids.

    Vectors that are null, have another length, or have a null or non-finite component
    are left out.  Every other row is assigned on its own, so repeated rows and null ids
    need nothing special (a null id is a first centroid only where ids run out).  Fewer
    vectors than ``k`` give fewer centroids, and none an empty result.  Components beyond
    ``LARGEST`` after scaling are taken as that.  Other columns are ignored.
    """
    ints = integers(vectors.select("vec_id", "embedding"), size, scale)
    centroids = first_centroids(ints, k, seed)
    if not len(centroids):
        return ints.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), np.zeros((0, size), np.int64)
    # Written once with a first guess; later searches start there and end early.
    ints = stage(assign(ints, centroids).drop("distance"), "vector-integers")
    for _ in range(rounds):
        centroids = moved(ints, centroids)
    return assign(ints, centroids), centroids


def describe(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, the sums of distances and the hash of the final centroid."""
    assigned = stage(assigned.select("vec_id", "cluster", "distance"), "vector-clusters")
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [
        (c, sums.get(c, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest())
        for c, v in enumerate(centroids)
    ]  # one row per centroid
    about = assigned.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return assigned.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op11(spark, sf_dir: str) -> DataFrame:
    from tidemill.sources.tables import read_table

    return describe(*cluster(read_table(spark, sf_dir, "embeddings")))


_ASSIGN = """
a{i} AS MATERIALIZED (
  SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT p.rid, p.vec_id, p.v, c.c,
           list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM points p, c{i} c) GROUP BY rid, vec_id, v)"""
_MOVE = """
s{i} AS MATERIALIZED (
  SELECT c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n
  FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{i}) GROUP BY c, i),
c{j} AS MATERIALIZED (
  SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{i} GROUP BY c) m USING (c))"""
# Every vector against every centroid, round by round.
SQL = (
    """
WITH points AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
  FROM (SELECT sha256('2:' || vec_id) AS h, v FROM points ORDER BY h, v LIMIT 40)),"""
    + ",".join(_ASSIGN.format(i=i) + "," + _MOVE.format(i=i, j=i + 1) for i in range(ROUNDS))
    + ","
    + _ASSIGN.format(i=ROUNDS)
    + """
SELECT vec_id, a.c::INTEGER AS cluster, d::BIGINT AS distance,
       (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a5 a JOIN c5 m ON a.c = m.c
"""
)
