"""Centroid clustering in which each cluster keeps a heap of bound gaps.

Vectors are held in blocks. When a vector is scanned, its distance to the nearest centroid is an upper
bound and that to the second nearest a lower bound for all others; the gap between them shrinks at most
by the drift of its own centroid plus the largest drift of the others in each round. So a block keeps,
for each cluster, a heap ordered by gap plus the drift that the cluster had gathered at the scan. In the
next round the vectors at the top whose entry does not exceed the drift gathered by then are popped and
scanned again, exactly; all others stay where they are without being looked at.

A round writes the blocks with their heaps to the shared folder and, beside them, what the moved vectors
add to and take from the sums of clusters; only these changes are read again for the new centroids, which
are of fixed size. A lost executor costs the blocks of one round; the round before is dropped only when
the next is stored.

Rows whose vector is null, holds a null or non-finite component, or has another length than ``dim`` take
no part. Repeated rows are clustered one by one and count each time; where the hashes that choose the
first centroids tie, the vectors decide. A null id has no hash and sorts last; its row is kept in the
result. Fewer vectors than clusters make fewer clusters, and an empty table an empty result. Equal
distances go to the smaller cluster number. Integers are held at plus and minus 2^25. Other columns,
whatever their names, are not read. There is no text here that could be long; long vectors are those of
another length.
"""

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm import vectors, words
from rolecall.llm.vector_codes import first_vectors
from rolecall.session import new_folder

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Vectors in a block. A heap entry is a gap in 256ths above 20 bits for the place in the block.
BLOCK, PLACE, FINE = 4096, 20, 256

BLOCKS = ("ids array<long>, v binary, cluster binary, heaps array<binary>, "
          "moves array<struct<cluster: int, n: long, total: array<long>>>")
NO_MOVES = pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])


class Centroids:
    """Centroids of one round, and the drift each cluster has gathered since the first."""

    def __init__(self, points: np.ndarray, gathered: list[int]):
        self.points, self.gathered = points, gathered

    def scan(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each row (ties: smaller number), and the gap to the next, in 256ths."""
        found = self.squares(v)
        nearest = found.argmin(1)
        rows = np.arange(len(v))
        best = found[rows, nearest].astype(np.float64)
        found[rows, nearest] = np.iinfo(np.int64).max
        gap = np.sqrt(found.min(1).astype(np.float64)) - np.sqrt(best)
        # one less for rounding; without a second centroid the gap is above any drift
        return nearest, np.minimum(np.floor(gap * FINE) - 1, 1 << 40).astype(np.int64)

    def squares(self, v: np.ndarray) -> np.ndarray:
        own = np.einsum("rd,rd->r", v, v)
        return own[:, None] - 2 * vectors.products(v, self.points) + np.einsum("rd,rd->r", self.points, self.points)

    def moved(self, points: np.ndarray) -> "Centroids":
        """The next centroids; each cluster gathers its own drift and the largest of the others."""
        steps = [math.isqrt(FINE * FINE * sum(x * x for x in row)) + 1 if any(row) else 0
                 for row in (points - self.points).tolist()]
        gathered = [g + s + max((t for j, t in enumerate(steps) if j != i), default=0)
                    for i, (g, s) in enumerate(zip(self.gathered, steps))]
        return Centroids(points, gathered)


def first_centroids(table: DataFrame, clusters: int, dim: int, scale: int, seed: int, id_column: str,
                    vector: str) -> np.ndarray:
    """Vectors of the smallest hashes of seed and id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return first_vectors(table, dim, scale, F.asc_nulls_last(hashed), clusters, id_column, vector)


def rescan(v: np.ndarray, cluster: np.ndarray, heaps: list[list[int]], centroids: Centroids) -> np.ndarray:
    """Pop what has expired, scan it, and push it to the heap of its cluster; the rows that moved.

    ``cluster`` and ``heaps`` are changed in place; cluster -1 stands for a row that was never scanned.
    """
    due = np.flatnonzero(cluster < 0).tolist()
    mask = (1 << PLACE) - 1
    for heap, gathered in zip(heaps, centroids.gathered):
        while heap and heap[0] >> PLACE <= gathered:
            due.append(heapq.heappop(heap) & mask)
    due = np.array(due, np.int64)
    if not len(due):
        return due
    nearest, gaps = centroids.scan(v[due])
    entries = ((gaps + np.array(centroids.gathered, np.int64)[nearest]) << PLACE) | due
    for c, entry in zip(nearest.tolist(), entries.tolist()):
        heapq.heappush(heaps[c], entry)
    changed = cluster[due] != nearest
    cluster[due] = nearest
    return due[changed]


def _changes(v: np.ndarray, before: np.ndarray, after: np.ndarray, rows: np.ndarray) -> list[dict]:
    """What the moved rows add to and take from the clusters."""
    out = []
    for sign, of in ((-1, before[rows]), (1, after[rows])):
        for c in np.unique(of[of >= 0]).tolist():
            some = rows[of == c]
            out.append({"cluster": c, "n": sign * len(some), "total": (sign * v[some].sum(0)).tolist()})
    return out


def _block(ids, v: np.ndarray, cluster: np.ndarray, heaps: list[list[int]], moves: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([ids], pa.list_(pa.int64())), pa.array([v.astype("<i4").tobytes()], pa.binary()),
        pa.array([cluster.astype("<i4").tobytes()], pa.binary()),
        pa.array([[np.array(h, "<i8").tobytes() for h in heaps]], pa.list_(pa.binary())),
        pa.array([moves], pa.list_(NO_MOVES))], ["ids", "v", "cluster", "heaps", "moves"])


def _blocks(table: DataFrame, dim: int, scale: int, id_column: str, vector: str, centroids: Centroids) -> DataFrame:
    """The table in blocks, after the first scan."""
    def run(batches):
        for batch in batches:
            rows, starts, lengths, values = vectors.usable(batch.column("vector"))
            rows = rows[lengths[rows] == dim]
            for at in range(0, len(rows), BLOCK):
                some = rows[at:at + BLOCK]
                v = vectors.integers(values, starts[some], dim, scale)
                cluster = np.full(len(v), -1, np.int64)
                heaps = [[] for _ in centroids.gathered]
                moved = rescan(v, cluster, heaps, centroids)
                yield _block(batch.column("vec_id").take(pa.array(some)), v, cluster, heaps,
                             _changes(v, np.full(len(v), -1), cluster, moved))
    return table.select(*vectors.columns(id_column, vector)).mapInArrow(run, BLOCKS)


def _read(batch: pa.RecordBatch, i: int, dim: int) -> tuple:
    v = np.frombuffer(batch.column("v")[i].as_buffer(), "<i4").reshape(-1, dim).astype(np.int64)
    cluster = np.frombuffer(batch.column("cluster")[i].as_buffer(), "<i4").astype(np.int64)
    heaps = [np.frombuffer(h.as_buffer(), "<i8").tolist() for h in batch.column("heaps")[i].values]
    return batch.column("ids")[i].values, v, cluster, heaps


def _next(blocks: DataFrame, dim: int, centroids: Centroids) -> DataFrame:
    """The blocks after another round."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, v, cluster, heaps = _read(batch, i, dim)
                before = cluster.copy()
                moved = rescan(v, cluster, heaps, centroids)
                yield _block(ids, v, cluster, heaps, _changes(v, before, cluster, moved))
    return blocks.select("ids", "v", "cluster", "heaps").mapInArrow(run, BLOCKS)


def _add_changes(blocks: DataFrame, dim: int, counts: list[int], totals: list[list[int]]) -> None:
    """Bring the sums of the clusters up to date; one row a cluster comes to the driver."""
    moves = blocks.select(F.explode("moves").alias("m")).select("m.*")
    for r in moves.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(
            *[F.sum(F.col("total")[i]) for i in range(dim)]).alias("total")).collect():
        counts[r.cluster] += r.n
        totals[r.cluster] = [a + b for a, b in zip(totals[r.cluster], r.total)]


def centroid_clusters(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM,
                      scale: int = SCALE, seed: int = SEED, id_column: str = "vec_id",
                      vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and squared distance of every vector, and the final centroids."""
    centroids = Centroids(first_centroids(table, clusters, dim, scale, seed, id_column, vector), [])
    size = len(centroids.points)
    centroids.gathered = [0] * size
    counts, totals = [0] * size, [[0] * dim for _ in range(size)]
    steps = [lambda blocks, at: _blocks(table, dim, scale, id_column, vector, at)]
    steps += [lambda blocks, at: _next(blocks, dim, at)] * (rounds - 1)
    spark, blocks, folder = table.sparkSession, None, None
    for step in steps[:rounds]:
        old, folder = folder, new_folder(spark, "cluster-blocks")
        blocks = words.stored_in(step(blocks, centroids), folder)
        if old is not None:
            words.drop_folder(spark, old)
        _add_changes(blocks, dim, counts, totals)
        points = [vectors.floored(t, n) if n else p
                  for t, n, p in zip(totals, counts, centroids.points.tolist())]
        centroids = centroids.moved(np.array(points, np.int64).reshape(size, dim))
    if blocks is None:
        blocks = _blocks(table, dim, scale, id_column, vector, centroids)

    def last(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, v, cluster, heaps = _read(batch, i, dim)
                rescan(v, cluster, heaps, centroids)
                gap = v - centroids.points[cluster]
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(
                    np.einsum("rd,rd->r", gap, gap))], ["vec_id", "cluster", "distance"])
    return blocks.select("ids", "v", "cluster", "heaps").mapInArrow(
        last, "vec_id long, cluster int, distance long"), centroids.points


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector of ``embeddings``."""
    found, points = centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = words.stored(found, "clusters")
    sums = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    names = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points.tolist()]
    inertia = F.array(*[F.lit(sums.get(c, 0)).cast("long") for c in range(max(len(points), 1))])
    digest = F.array(*[F.lit(n) for n in names or [""]])
    return found.select("vec_id", "cluster", "distance", F.get(inertia, "cluster").alias("cluster_inertia"),
                        F.lit(sum(sums.values())).cast("long").alias("inertia"),
                        F.get(digest, "cluster").alias("centroid_sha256"))


def _oracle() -> str:
    steps = [f"""kept AS MATERIALIZED (
  SELECT vec_id, embedding, row_number() OVER (
           ORDER BY sha256('{SEED}:' || CAST(vec_id AS VARCHAR)), embedding) AS n,
         [floor({SCALE} * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = {DIM}
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
             f"c0 AS MATERIALIZED (SELECT CAST(n - 1 AS INTEGER) AS k, v AS c FROM kept WHERE n <= {CLUSTERS})"]
    for r in range(ROUNDS + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT n, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT n, k, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS d
    FROM kept, c{r}) GROUP BY n)""")
        if r < ROUNDS:
            steps.append(f"""mean{r} AS (
  SELECT k, list(m ORDER BY i) AS m FROM (
    SELECT k, i, floor(sum(v[i]) / count(*)) AS m
    FROM near{r} JOIN kept USING (n), range(1, {DIM + 1}) AS t(i) GROUP BY k, i) GROUP BY k)""")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{r} LEFT JOIN mean{r} USING (k))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, k AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string([CAST(x AS BIGINT) FOR x IN c], ',')) AS centroid_sha256
FROM kept JOIN near{ROUNDS} USING (n) JOIN c{ROUNDS} USING (k)"""


ORACLE = _oracle()
