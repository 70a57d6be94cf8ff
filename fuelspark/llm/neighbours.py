"""Approximate nearest neighbours by multi-index hashing (operator 10).

Codes: vectors are centred and turned by rotations learned so that the signs of the turned coordinates lie close to the
coordinates (iterative quantisation); each rotation gives one bit per dimension. A code is split into substrings of 16
bits, and each has posting lists from value to vectors. If two codes of m substrings differ in at most r bits, one
substring differs in at most r // m: reading the lists of every value that near, in every substring, retrieves every code
within r bits. Only retrieved codes are compared, and only those within r are reranked, by their inner products in double
precision.

The radius is learned on the fitting sample, so that it holds ``target`` of the true neighbours there. A denser
corpus has nearer neighbours, so the sample's radius is on the safe side.

Spark's partitions of the base vectors are the shards of the index. Queries go to them in blocks of bounded size, each
shard answers with its own k nearest, and a ranking by query merges these. Equal vectors are one entry of the index
with the smallest ids first, so a group of copies costs its size once and no pairs. A shard that finds no more than k
codes within the radius probes the next wider one, so a query gets k results wherever k exist.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part; ties go to the smaller id; rows with the same id and vector count as one candidate per row.
"""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fuelspark.llm.rows import quoted, sample_fraction

SAMPLE_VECTORS = 8_000
ROTATIONS = 4
SUBSTRING = 16
TARGET = 0.985
# Queries that go to the shards at once.
BLOCK_QUERIES = 20_000


@dataclass
class Codes:
    """A fitted code: mean and rotations, and the radius that holds the wanted share of neighbours."""

    mean: np.ndarray
    rotations: np.ndarray
    radius: int

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Substrings (unsigned 16-bit) of each vector's code."""
        turned = (vectors - self.mean) @ self.rotations
        bits = np.packbits(turned > 0, axis=1)
        if bits.shape[1] % 2:
            bits = np.pad(bits, ((0, 0), (0, 1)))
        return np.ascontiguousarray(bits).view(">u2").astype(np.uint16)


def _rotation(centred: np.ndarray, rng: np.random.Generator, rounds: int = 25) -> np.ndarray:
    turn, _ = np.linalg.qr(rng.standard_normal((centred.shape[1], centred.shape[1])))
    for _ in range(rounds):
        signs = np.sign(centred @ turn)
        u, _, vt = np.linalg.svd(signs.T @ centred)
        turn = (u @ vt).T
    return turn


def fit(sample: np.ndarray, k: int, target: float = TARGET, rotations: int = ROTATIONS, seed: int = 7) -> Codes:
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    centred = sample - mean
    few = centred[: 3000]
    turned = np.hstack([_rotation(few, rng) for _ in range(rotations)])
    codes = Codes(mean, turned, turned.shape[1])
    near = min(k, len(sample) - 1)
    if near > 0:
        words = codes.encode(sample)
        asked = np.arange(0, len(sample), max(1, len(sample) // 400))
        exact = sample[asked] @ sample.T
        exact[np.arange(len(asked)), asked] = -np.inf
        best = np.argpartition(-exact, near - 1, axis=1)[:, :near]
        apart = np.bitwise_count(words[asked][:, None, :] ^ words[best]).sum(axis=2, dtype=np.int32)
        codes.radius = int(np.quantile(apart, target, method="higher"))
    return codes


def wide(words: np.ndarray) -> np.ndarray:
    """Codes as unsigned 64-bit integers, with zeros to fill the last."""
    return np.ascontiguousarray(np.pad(words, ((0, 0), (0, -words.shape[1] % 4)))).view(np.uint64)


class Postings:
    """Posting lists of one substring: the vectors with value v are ``where[starts[v] : starts[v + 1]]``."""

    def __init__(self, column: np.ndarray):
        counts = np.bincount(column, minlength=1 << SUBSTRING)
        self.where = np.argsort(column, kind="stable")
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.values = np.flatnonzero(counts).astype(np.uint16)
        self.rank = np.searchsorted(self.values, column)

    def read(self, values: np.ndarray) -> np.ndarray:
        """Vectors in the lists of some values."""
        values = values.astype(np.int64)
        first, after = self.starts[values], self.starts[values + 1]
        some = after > first
        first, sizes = first[some], (after - first)[some]
        ends = np.cumsum(sizes)
        return self.where[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def mark(self, found: np.ndarray, value: np.uint16, ball: np.ndarray, near: int) -> None:
        """Mark the vectors whose value differs in at most ``near`` bits. The differences in ``ball`` enumerate the values
        whose lists are read; where fewer values occur than that, each is told near or not and its vectors with it."""
        if len(ball) <= len(self.values):
            found[self.read(ball ^ value)] = True
        else:
            found |= (np.bitwise_count(self.values ^ value) <= near)[self.rank]


class Shard:
    """Multi-index over the distinct vectors of one partition."""

    def __init__(self, codes: Codes, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids,))
        ids, vectors = ids[order], vectors[order]
        _, first, inverse = np.unique(vectors.view(np.uint64), axis=0, return_index=True, return_inverse=True)
        inverse = inverse.ravel()
        by = np.argsort(inverse, kind="stable")
        self.ids, self.starts = ids[by], np.searchsorted(inverse[by], np.arange(len(first) + 1))
        self.vectors, self.codes = vectors[first], codes
        words = codes.encode(self.vectors)
        self.wide, self.bits = np.ascontiguousarray(wide(words).T), words.shape[1] * SUBSTRING
        self.index = [Postings(words[:, j]) for j in range(words.shape[1])]
        self.weights = np.bitwise_count(np.arange(1 << SUBSTRING, dtype=np.uint16))
        self.balls: dict[int, np.ndarray] = {}
        # Vectors whose codes were compared, and whose inner products were computed, over all queries so far.
        self.compared = self.scored = 0

    def ball(self, near: int) -> np.ndarray:
        """Differences of at most ``near`` bits between two substrings."""
        if near not in self.balls:
            self.balls[near] = np.flatnonzero(self.weights <= near).astype(np.uint16)
        return self.balls[near]

    def retrieve(self, word: np.ndarray, radius: int) -> np.ndarray:
        """Vectors in the posting lists that a code probes for a radius.

        With radius = a * m + b over m substrings, a code within the radius differs in at most a bits in one of the
        first b + 1 substrings or in at most a - 1 in one of the others; else it would differ in more in all.
        """
        if radius >= self.bits:
            return np.arange(len(self.vectors))
        a, b = divmod(radius, len(word))
        found = np.zeros(len(self.vectors), bool)
        for j, postings in enumerate(self.index):
            near = a if j <= b else a - 1
            if near >= 0:
                postings.mark(found, word[j], self.ball(near), near)
        return np.flatnonzero(found)

    def within(self, word: np.ndarray, radius: int) -> np.ndarray:
        """Vectors whose code is within the radius, found by the posting lists alone."""
        at = self.retrieve(word, radius)
        self.compared += len(at)
        return at[self.distances(word[None], at)[0] <= radius]

    def probe(self, words: np.ndarray) -> np.ndarray:
        """Which vectors ``retrieve`` gives at the fitted radius, as a table of codes by vectors."""
        found = np.zeros((len(words), len(self.vectors)), bool)
        for row, word in enumerate(words):
            found[row, self.retrieve(word, self.codes.radius)] = True
        return found

    def distances(self, words: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Differing bits between each code and all vectors, or those given."""
        return sum(np.bitwise_count(column[:, None] ^ own[at][None]).astype(np.int32) for column, own in zip(wide(words).T, self.wide, strict=True))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """The k nearest of this shard for each query, without the query's own row."""
        words = self.codes.encode(queries)
        for query_id, query, word in zip(query_ids, queries, words, strict=True):
            radius = min(self.codes.radius, self.bits)
            pick = self.within(word, radius)
            while len(pick) <= k and radius < self.bits:  # one may be the query itself: probe the next radius
                radius = min(self.bits, (radius // len(word) + 2) * len(word) - 1)
                pick = self.within(word, radius)
            self.scored += len(pick)
            if len(pick) > k + 1:
                rough = self.vectors[pick] @ query
                edge = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
                pick = pick[rough >= edge - 1e-9 * max(1.0, abs(edge))]
            exact = (self.vectors[pick] * query).sum(axis=1)
            ids = [self.ids[self.starts[p] : min(self.starts[p + 1], self.starts[p] + k + 1)] for p in pick]
            flat, value = np.concatenate(ids), np.repeat(exact, [len(x) for x in ids])
            other = flat != query_id
            flat, value = flat[other], value[other]
            best = np.lexsort((flat, -value))[:k]
            yield query_id, flat[best], value[best]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Id and vector in double precision of the rows that take part."""
    v = F.col(quoted(vector_col)).cast("array<double>")
    rows = df.select(F.col(quoted(id_col)).cast("bigint").alias("id"), v.alias("v")).filter("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


def nearest(df: DataFrame, is_query: Callable[[Column], Column], k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample_vectors: int = SAMPLE_VECTORS) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found by inner product for each query row; ``is_query``
    tells queries by their id."""
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not sizes:
        return empty
    rows = rows.filter(F.size("v") == sizes[0]["d"])
    taken = sample_fraction(rows, F.col("id"), min(1.0, sample_vectors / sizes[0]["count"])).limit(2 * sample_vectors).collect()
    distinct = np.unique(np.array([r["v"] for r in taken or rows.limit(1).collect()]), axis=0)
    codes = fit(np.random.default_rng(1).permutation(distinct), k)

    asked = rows.filter(is_query(F.col("id")))
    count = asked.count()
    blocks = max(1, -(-count // BLOCK_QUERIES))
    found = None
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)) == block) if blocks > 1 else asked
        queries = part.collect()
        query_ids, query_vectors = np.array([r["id"] for r in queries], np.int64), np.array([r["v"] for r in queries]).reshape(len(queries), -1)
        shared = spark.sparkContext.broadcast((codes, query_ids, query_vectors))

        def run(batches, shared=shared, k=k):
            codes, query_ids, query_vectors = shared.value
            got = [(b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)) for b in batches if b.num_rows]
            if not got or not len(query_ids):
                return
            shard = Shard(codes, np.concatenate([g[0] for g in got]), np.ascontiguousarray(np.concatenate([g[1] for g in got])))
            out = list(shard.search(query_ids, query_vectors, k))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float64()))],
                names=["query_id", "ids", "scores"])

        answers = rows.mapInArrow(run, "query_id bigint, ids array<bigint>, scores array<double>")
        found = answers if found is None else found.unionByName(answers)
    pairs = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
