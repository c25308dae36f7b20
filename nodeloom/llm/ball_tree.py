"""k-means with ball trees: whole balls go to a centroid by the triangle inequality, the rest descends to exact leaves.

1. Trees.  Each Arrow batch of a task (CHUNK vectors at most) becomes one balanced tree, a row of the table that
   all rounds read.  A ball's vectors are split at the median of their place between two far ones,
   so the balls of a level are consecutive runs of the reordered vectors; a ball is its radius, count and integer
   sum, and its middle is sum / count.
2. Rounds.  From the top down, a ball whose farthest vector must be nearer to one centroid than any of its
   vectors can be to another goes whole, with its count and sum; others open.  Vectors of leaves that stay open are
   compared exactly.  A task returns one count and sum per cluster, Spark adds them up, and the
   driver holds ``k`` centroids only.
3. The last pass assigns every vector and computes its exact distance.

Components become integers at the start, so sums, quotients and distances are exact and do not
depend on the order of rows, partitions or executors.  Bounds are floats, with a slack beyond their
rounding; a ball that is decided by less than the slack opens.  Rounds that change no centroid end the loop,
as all later ones would be the same.

Edge cases: vectors that are null, of another length, or with null, NaN or infinite components are left out; a vector
with a component beyond LARGEST is an error, as its squared distance does not fit a long; rows without vec_id
are clustered and come last as starting centroids; repeated rows count each, and of equal ids the vector smaller by its
components starts first; fewer vectors than centroids make fewer clusters; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

K, ROUNDS, SCALE, SEED, SIZE = 8, 10, 1024, 3, 64
#: Vectors of one tree, and of a leaf.
CHUNK, LEAF = 8192, 32
#: Components up to here make squared distances that fit a long, and up to EXACT products that a double holds.
LARGEST, EXACT = 1 << 27, 1 << 21
SLACK = 1e-9
TREE = "ids binary, known binary, vectors binary, radii binary, sums binary, counts binary"


def kept(embeddings: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): components as integers, of the vectors with ``size`` finite components."""
    fine = (F.size("embedding") == size) & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    whole = lambda x: F.floor(F.when(F.abs(x.cast("double") * scale) <= LARGEST, x.cast("double") * scale).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))))
    return embeddings.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: whole(x).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose hashed ids are smallest."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in vectors.orderBy(key.asc_nulls_last(), "v").limit(k).collect()], np.int64)


def levels_of(n: int) -> int:
    """Levels of the tree of ``n`` vectors; the balls of a level differ by one vector at most."""
    return max(1, (max(1, -(-n // LEAF)) - 1).bit_length() + 1)


def cuts(n: int, level: int) -> np.ndarray:
    """Where the balls of a level begin, and the end."""
    return np.arange((1 << level) + 1, dtype=np.int64) * n >> level


def build(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the vectors, and of all levels the balls' radii, sums and counts, from the top."""
    n, order = len(v), np.arange(len(v))
    x = v.astype(np.float64)
    radii, sums, counts = [], [], []
    for level in range(levels_of(n)):
        at = cuts(n, level)
        count = np.diff(at)
        ball, rows = np.repeat(np.arange(1 << level), count), x[order]
        total = np.add.reduceat(v[order], at[:-1], axis=0, dtype=np.int64)
        away = np.sqrt(((rows - (total / count[:, None])[ball]) ** 2).sum(axis=1))
        radii.append(np.maximum.reduceat(away, at[:-1]))
        sums.append(total)
        counts.append(count)
        if level + 1 < levels_of(n):
            far = _farthest(away, ball, at)
            apart = ((rows - rows[far][ball]) ** 2).sum(axis=1)
            line = rows[_farthest(apart, ball, at)] - rows[far]
            order = order[np.lexsort(((rows * line[ball]).sum(axis=1), ball))]
    return order, np.concatenate(radii), np.concatenate(sums), np.concatenate(counts)


def _farthest(distance: np.ndarray, ball: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Place of each ball's largest distance."""
    by = np.lexsort((distance, ball))
    return by[at[1:] - 1]


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors and centroids, as int64."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= EXACT:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((v.astype(np.int64) - one) ** 2).sum(axis=1) for one in c], axis=1)


def trees(vectors: DataFrame) -> DataFrame:
    """A row per tree of ``vectors(vec_id, v)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK):
                part = batch.slice(first, CHUNK)
                ids, v = part.column("vec_id"), part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                order, *balls = build(v)
                known = ~np.array(ids.is_null())
                columns = [ids.fill_null(0).to_numpy()[order], known[order], v[order].astype(np.int32), *balls]
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns], names=[f.split()[0] for f in TREE.split(", ")])

    return vectors.mapInArrow(run, TREE)


class Tree:
    """A row of ``trees``, read back."""

    def __init__(self, row: dict[str, bytes]):
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
        self.vectors = np.frombuffer(row["vectors"], np.int32).reshape(len(self.ids), -1)
        self.radii, self.counts = np.frombuffer(row["radii"]), np.frombuffer(row["counts"], np.int64)
        self.sums = np.frombuffer(row["sums"], np.int64).reshape(len(self.counts), -1)

    def assign(self, centroids: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, int]:
        """Whole balls as (ball, cluster, level), rows of open leaves with their clusters, and the number of exact distances."""
        n, k = len(self.ids), len(centroids)
        last, whole, open_ = levels_of(n) - 1, [], np.zeros(1, np.int64)
        c = centroids.astype(np.float64)
        for level in range(last + 1):
            ball = open_ + (1 << level) - 1  # balls stand level by level
            middle = self.sums[ball] / self.counts[ball][:, None]
            d = np.sqrt(((middle[:, None, :] - c[None]) ** 2).sum(axis=2))
            r = self.radii[ball][:, None]
            near = d.argmin(axis=1)
            slack = SLACK * (d.max(axis=1, keepdims=True) + r + 1)
            beyond = d - r > np.take_along_axis(d, near[:, None], axis=1) + r + slack
            alone = beyond.sum(axis=1) == k - 1
            whole += zip(ball[alone].tolist(), near[alone].tolist(), [level] * int(alone.sum()), strict=True)
            open_ = open_[~alone]
            if level < last:
                open_ = np.stack([2 * open_, 2 * open_ + 1], axis=1).ravel()
        at = cuts(n, last)
        size = at[open_ + 1] - at[open_]
        rows = np.repeat(at[open_] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return whole, rows, squared(self.vectors[rows], centroids).argmin(axis=1), len(rows)  # ties: the smaller number

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Count and sum per cluster, and the number of vectors that were compared."""
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        whole, rows, cluster, compared = self.assign(centroids)
        for ball, to, _ in whole:
            count[to] += self.counts[ball]
            total[to] += self.sums[ball]
        np.add.at(total, cluster, self.vectors[rows])
        return count + np.bincount(cluster, minlength=len(count)), total, compared

    def final(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and exact squared distance of every vector."""
        whole, rows, cluster, _ = self.assign(centroids)
        out = np.empty(len(self.ids), np.int64)
        out[rows] = cluster
        for ball, to, level in whole:
            at, i = cuts(len(self.ids), level), ball - (1 << level) + 1
            out[at[i] : at[i + 1]] = to
        return out, ((self.vectors.astype(np.int64) - centroids[out]) ** 2).sum(axis=1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Tree(row)


def one_round(forest: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Counts and sums per cluster, and how many vectors were compared one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, compared = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64), 0
        for tree in _rows(batches):
            n, s, met = tree.totals(centroids)
            count, total, compared = count + n, total + s, compared + met
        numbers = np.concatenate([[compared], count, total.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(numbers), dtype=np.int32)), pa.array(numbers)], names=["place", "n"])

    got = forest.mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()  # 1 + k (size + 1) numbers
    numbers = np.zeros(1 + centroids.size + len(centroids), np.int64)
    for r in got:
        numbers[r.place] = r.n
    return numbers[1 : 1 + len(centroids)], numbers[1 + len(centroids) :].reshape(centroids.shape), int(numbers[0])


def fit(forest: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after ``rounds`` rounds; an empty one stays."""
    for _ in range(rounds if len(centroids) else 0):
        count, total, _ = one_round(forest, centroids)
        new = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)  # floors
        if np.array_equal(new, centroids):
            break
        centroids = new
    return centroids


def assigned(forest: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in _rows(batches):
            cluster, distance = tree.final(centroids)
            yield pa.RecordBatch.from_arrays([pa.array(tree.ids, mask=~tree.known), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return forest.mapInArrow(run, "vec_id long, cluster int, distance long")


def fingerprints(centroids: np.ndarray) -> Column:
    """SHA-256 of the final centroid's components, by ``cluster``."""
    texts = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return F.get(F.array(*[F.lit(t) for t in texts]).cast("array<string>"), F.col("cluster"))


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    vectors = kept(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    forest = materialize(trees(vectors))
    centroids = fit(forest, first_centroids(vectors))
    found = materialize(assigned(forest, centroids))
    own = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = F.broadcast(own.crossJoin(F.broadcast(own.agg(F.sum("cluster_inertia").alias("inertia")))))  # K rows and one row
    return found.join(sums, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", fingerprints(centroids).alias("centroid_sha256"))


def _oracle() -> str:
    near = lambda c: f"SELECT v.n, v.vec_id, v.v, arg_min(c.cluster, (list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.cluster)) AS cluster, min(list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance FROM vectors v, {c} c GROUP BY ALL"
    out = [
        f"WITH vectors AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) AS v FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS cluster, v FROM vectors WHERE vec_id IS NOT NULL ORDER BY sha256('{SEED}:' || vec_id), v LIMIT {K})",
    ]
    for k in range(ROUNDS):
        out.append(f"a{k} AS MATERIALIZED ({near(f'c{k}')})")
        mean = "SELECT cluster, list(m ORDER BY place) AS v FROM (SELECT cluster, place, (s - (s % n + n) % n) // n AS m FROM (SELECT cluster, place, sum(x)::bigint AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{k}) GROUP BY ALL)) GROUP BY ALL"
        out.append(f"c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN ({mean.format(k=k)}) m USING (cluster))")
    out.append(f"f AS MATERIALIZED ({near(f'c{ROUNDS}')})")
    return ", ".join(out) + f" SELECT vec_id, f.cluster::int AS cluster, distance::bigint AS distance, (sum(distance) OVER (PARTITION BY f.cluster))::bigint AS cluster_inertia, (sum(distance) OVER ())::bigint AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM f JOIN c{ROUNDS} c ON c.cluster = f.cluster"


ORACLE_SQL = _oracle()
