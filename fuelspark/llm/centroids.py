"""Centroid clustering over an incremental distance matrix (operator 12).

Vectors are integers: the floor of 256 times each component. A table holds, for every vector, its exact dot product
with every centroid. A round changes a centroid in some components only, and later rounds in few: the change of a dot
product is the vector's product with these differences, so a round reads the table, adds the products over the components
that changed, and takes the argmin of |v|² - 2 v·c + |c|² anew. The first round is the change from centroids of zeros.

Centroids follow the same way: a cluster's sum and count change by the vectors that entered or left it. These are added up
within the tasks, then by cluster, so that ``k`` rows reach the driver whatever the number of vectors. Centroids and their
changes (``k`` x ``dimensions`` integers) are all that is broadcast. No step shuffles vectors, so neither equal vectors
nor a cluster that holds most rows make a task larger than others.

Each round's table is written to the shared folder, so no round is computed twice and lost executors cost their tasks
only. The table two rounds back is deleted: two stay on disk.

Defined results: vectors take part that have exactly ``dimensions`` components, none null or non-finite, and none of
2**26 or more after scaling, where distances would leave the range of a long; an inertia beyond that range is null; equal
distances go to the smaller number; an empty cluster keeps its centroid; fewer vectors than ``k`` make as many clusters; a
null id is hashed as '' and stays null; rows with the same id count as one vector each, in the order of their components
where hashes tie.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fuelspark.llm.integer_vectors import integers, matrix, products
from fuelspark.operators.scale import scratch_path

CENTROIDS = 40
ROUNDS = 5
DIMENSIONS = 64
STATE = "id bigint, v array<int>, square bigint, dots array<bigint>, before int, cluster int, distance bigint"


@dataclass
class Change:
    """Differences of centroids: the components that changed in any of them, and |c|² of the new ones."""

    at: np.ndarray
    by: np.ndarray
    squares: np.ndarray

    @classmethod
    def between(cls, old: np.ndarray, new: np.ndarray) -> "Change":
        moved = np.flatnonzero((old != new).any(axis=0))
        return cls(moved, (new - old)[:, moved], (new * new).sum(axis=1))

    def dots(self, vectors: np.ndarray, dots: np.ndarray) -> np.ndarray:
        """Dot products after the change: only centroids with a nonzero component are touched."""
        touched = np.flatnonzero(self.by.any(axis=1))
        out = dots.copy()
        out[:, touched] += products(vectors[:, self.at], self.by[touched])
        return out


def _round(state: DataFrame, change: Change, first: bool) -> DataFrame:
    """The table with dot products, clusters and distances after a change of the centroids."""
    shared = state.sparkSession.sparkContext.broadcast(change)
    columns = ["id", "v"] if first else ["id", "v", "square", "dots", "cluster"]

    def run(batches):
        change = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            vectors = matrix(b.column(1), b.num_rows)
            if first:
                square, old = (vectors * vectors).sum(axis=1), np.zeros((b.num_rows, len(change.squares)), np.int64)
                before = pa.nulls(b.num_rows, pa.int32())
            else:
                square, old, before = b.column(2).to_numpy(zero_copy_only=False), matrix(b.column(3), b.num_rows), b.column(4)
            dots = change.dots(vectors, old)
            apart = change.squares[None, :] - 2 * dots
            cluster = apart.argmin(axis=1)
            distance = square + apart[np.arange(b.num_rows), cluster]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dots.shape[1], pa.int32()), pa.array(dots.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(square), lists, before, pa.array(cluster.astype(np.int32)), pa.array(distance)],
                names=["id", "v", "square", "dots", "before", "cluster", "distance"])

    return state.select(*columns).mapInArrow(run, STATE)


def _moves(state: DataFrame, k: int) -> list:
    """Count and sum by cluster of the vectors that entered it less those that left it: at most ``k`` rows."""

    def run(batches):
        counts, sums = np.zeros(k, np.int64), None
        for b in batches:
            if not b.num_rows:
                continue
            vectors = matrix(b.column(2), b.num_rows)
            sums = np.zeros((k, vectors.shape[1]), np.int64) if sums is None else sums
            for column, sign in ((0, -1), (1, 1)):
                known = b.column(column).is_valid().to_numpy(zero_copy_only=False)
                where = pc.fill_null(b.column(column), 0).to_numpy(zero_copy_only=False)[known]
                counts += sign * np.bincount(where, minlength=k)
                member = (where[None, :] == np.arange(k)[:, None]).astype(np.int64)
                sums += sign * products(member, np.ascontiguousarray(vectors[known].T))
        if sums is not None:
            moved = np.flatnonzero((counts != 0) | sums.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(moved.astype(np.int32)), pa.array(counts[moved]), pa.array(list(sums[moved]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    moved = state.filter(F.col("before").isNull() | (F.col("before") != F.col("cluster"))).select("before", "cluster", "v")
    parts = moved.mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    # by component, so that partial rows combine before the shuffle
    terms = parts.select("cluster", "n", F.posexplode("sums").alias("at", "term")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("term").alias("term"))
    return terms.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "term"))).alias("terms")).collect()


def _delete(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table of this job that no later step reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of salt and id."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    found = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64)


def cluster(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, salt: str = "2:",
) -> tuple[DataFrame, np.ndarray]:
    """id, v, cluster and distance of every vector that takes part, and the final centroids."""
    spark = df.sparkSession
    vectors = integers(df, id_col, vector_col).filter(F.size("v") == dimensions)
    centroids = seeds(vectors, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], "id bigint, v array<int>, cluster int, distance bigint"), centroids
    state, old = vectors, np.zeros_like(centroids)
    sums, counts, paths = np.zeros_like(centroids), np.zeros(len(centroids), np.int64), []
    for number in range(rounds + 1):
        paths.append(scratch_path(spark, f"dots-{number}"))
        _round(state, Change.between(old, centroids), first=number == 0).write.parquet(paths[-1])
        state = spark.read.schema(STATE).parquet(paths[-1])
        if len(paths) > 2:
            _delete(spark, paths[-3])
        if number < rounds:
            for r in _moves(state, len(centroids)):
                counts[r["cluster"]] += r["n"]
                sums[r["cluster"]] += np.array([t["term"] for t in r["terms"]], np.int64)
            full, old = np.flatnonzero(counts), centroids
            centroids = old.copy()
            centroids[full] = sums[full] // counts[full, None]
    return state.select("id", "v", "cluster", "distance"), centroids


def clustered(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **settings) -> DataFrame:
    """vec_id, cluster and distance of every vector, with the inertia of its cluster and of all, and its centroid's hash."""
    spark = df.sparkSession
    found, centroids = cluster(df, id_col, vector_col, **settings)
    inertia = {r["cluster"]: int(r["inertia"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    long = lambda n: n if n < 1 << 63 else None
    rows = [(n, long(inertia.get(n, 0)), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for n, c in enumerate(centroids)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _assigned(number: int, source: str) -> str:
    """Common table of the SQL: every vector with its nearest centroid of ``source``."""
    return f"""a{number} AS (
 SELECT id, v, k, d FROM (SELECT id, v, k, d, row_number() OVER (PARTITION BY row ORDER BY d, k) AS place
  FROM (SELECT row, id, v, k, CAST(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS BIGINT) AS d FROM x CROSS JOIN {source})) WHERE place = 1)"""


def _moved(number: int, source: str) -> str:
    """Common table of the SQL: the centroids after the vectors' mean, rounded down."""
    return f"""c{number + 1} AS (
 SELECT s.k, coalesce(m.c, s.c) AS c FROM {source} s LEFT JOIN (
  SELECT k, list(floor(t / n) ORDER BY i) AS c FROM (SELECT k, i, sum(e) AS t, count(*) AS n FROM (SELECT k, unnest(v) AS e, unnest(range(64)) AS i FROM a{number}) GROUP BY k, i) GROUP BY k) m USING (k))"""


ORACLE_SQL = f"""
WITH x AS (
 SELECT row_number() OVER () AS row, vec_id AS id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(e))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS k, v AS c FROM (SELECT id AS vec_id, v FROM x) ORDER BY k LIMIT 40),
{", ".join(f"{_assigned(n, f'c{n}')}, {_moved(n, f'c{n}')}" for n in range(ROUNDS))}, {_assigned(ROUNDS, f'c{ROUNDS}')}
SELECT id AS vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(list_transform(c, lambda e: CAST(CAST(e AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (k)
"""
