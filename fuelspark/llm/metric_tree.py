"""Exact search of the largest integer inner products by M-trees (operator 13).

The inner product is no distance. With one more component, sqrt(M² - |v|²), where M is the greatest length of all vectors,
and 0 for a query q, the squared distance is |q|² + M² - 2 q·v: the nearest vectors are those of the largest products.

An M-tree's page holds entries: objects with their distance to the routing object of the page (parent distance), and in
inner pages also the covering radius of the page below each. Best-first search takes the page with the least possible
distance next. Of its entries those are skipped, without computing their distance, which by the triangle inequality over
the stored parent distance and radius can't be nearer than the k-th found; the search ends when no page can. Distances
that bounds come from are floating point, so bounds have a slack; products are exact integers and decide alone.

Vectors go to the nearest of some pivots; a pivot's vectors are dealt over as many shards as their number asks for, so
neither a crowded region nor a vector of many copies makes a large shard. A shard's tree is built within a task and
written as a table of pages. Queries are broadcast in blocks of bounded size to the shards' pages; each starts with a bound
from a sample of vectors, the same for all shards, so a shard answers with what can still be among the k best only. A
ranking by query merges the answers.

Defined results: rows take part whose id is not null and whose vector has as many components as most (the fewer on a tie,
one at least), none null, non-finite, or of 2**26 or more after scaling, where scores would leave the range of a long. Ties
go to the smaller id. A row's candidates are the rows with another id; equal rows are one; a query id with several vectors
asks for the least of them. With fewer than k candidates all are returned.
"""

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fuelspark.llm.integer_vectors import EXACT, integers, matrix
from fuelspark.llm.rows import sample_fraction
from fuelspark.operators.scale import materialize

NEIGHBOURS = 5
# Vectors that a shard holds about, entries of a page, and pivots at most.
SHARD_VECTORS = 20_000
PAGE_ENTRIES = 256
PIVOTS = 1_024
# Vectors of the sample that pivots and first bounds come from, and queries that are broadcast at once.
SAMPLE_VECTORS = 4_096
BLOCK_QUERIES = 10_000
PAGES = "pivot int, part int, page int, leaf boolean, objects binary, to_parent array<double>, radius array<double>, below array<int>, starts array<int>, ids array<bigint>"
SLACK = 1e-7


@dataclass
class Page:
    """``objects`` by row; a leaf's ids of object i are ``ids[starts[i]:starts[i + 1]]``."""

    leaf: bool
    objects: np.ndarray
    to_parent: np.ndarray
    radius: np.ndarray
    below: np.ndarray
    starts: np.ndarray
    ids: np.ndarray


def _apart(one: np.ndarray, others: np.ndarray, top: float) -> np.ndarray:
    """Distances of an object to others, with the component that makes all of them as long as ``top`` (a square)."""
    rest = np.sqrt(np.maximum(top - (others * others).sum(axis=1), 0)) - np.sqrt(max(top - float(one @ one), 0.0))
    return np.sqrt(((others - one) ** 2).sum(axis=1) + rest * rest)


def _nearest_seed(objects: np.ndarray, seeds: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """For each object the place of the nearest seed, and the distance to it."""
    where, least = np.zeros(len(objects), np.int64), np.full(len(objects), np.inf)
    for n, seed in enumerate(seeds):
        apart = _apart(seed, objects, top)
        closer = apart < least
        where[closer], least[closer] = n, apart[closer]
    return where, least


def distinct_objects(ids: np.ndarray, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different vector once, and the bounds of its ids in a list that holds up to ``most`` smallest ids for each."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    changes = np.ones(len(ids), bool)
    changes[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
    again = np.zeros(len(ids), bool)
    again[1:] = ~changes[1:] & (ids[1:] == ids[:-1])
    ids, vectors, changes = ids[~again], vectors[~again], changes[~again]
    first = np.flatnonzero(changes)
    kept = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids)))) < most
    starts = np.append(0, np.cumsum(np.add.reduceat(kept, first)))
    return vectors[first], starts, ids[kept]


def build(ids: np.ndarray, vectors: np.ndarray, top: float, k: int, entries: int = PAGE_ENTRIES) -> list[Page]:
    """Pages of the tree, the root first, of one vector at least. The objects of a page are dealt to the nearest of some
    of them, which route to the pages below, until a page holds them all."""
    objects, starts, held = distinct_objects(ids, vectors, k + 1)
    real = objects.astype(np.float64)
    rng = np.random.default_rng(11)
    pages: list[Page | None] = [None]
    none = np.zeros(0, np.int64)
    todo = [(0, np.arange(len(objects)), np.zeros(len(objects)), None)]
    while todo:
        page, members, to_parent, routing = todo.pop()
        if len(members) <= entries:
            lists = [held[starts[m] : starts[m + 1]] for m in members]
            ends = np.append(0, np.cumsum([len(x) for x in lists]))
            pages[page] = Page(True, objects[members], to_parent, np.zeros(len(members)), none, ends, np.concatenate(lists))
            continue
        chosen = rng.permutation(len(members))[: min(entries, max(2, 2 * len(members) // entries))]
        seeds = members[chosen]
        where, apart = _nearest_seed(real[members], real[seeds], top)
        used = np.unique(where)
        first = len(pages)
        pages.extend([None] * len(used))
        radius = np.zeros(len(used))
        for n, seed in enumerate(used):
            mine = where == seed
            radius[n] = apart[mine].max()
            todo.append((first + n, members[mine], apart[mine], seeds[seed]))
        up = np.zeros(len(used)) if routing is None else _apart(real[routing], real[seeds[used]], top)
        pages[page] = Page(False, objects[seeds[used]], up, radius, first + np.arange(len(used)), none, none)
    return pages


class Tree:
    """Search over pages. ``computed`` and ``avoided`` count the distances."""

    def __init__(self, pages: list[Page], top: int):
        self.pages, self.top = pages, top
        exact = np.float64 if top <= EXACT else np.int64
        self.objects = [p.objects.astype(exact) for p in pages]
        self.slack = SLACK * max(1.0, float(top) ** 0.5)
        self.computed = self.avoided = 0

    def search(self, query_id: int, query: np.ndarray, k: int, bound: int | None = None) -> list[tuple[int, int]]:
        """Up to ``k`` (-score, id) of other ids with the largest scores, ``bound`` at least, the best first."""
        asked = query.astype(self.objects[0].dtype)
        longest = float(int((query.astype(np.int64) ** 2).sum()) + self.top)
        found: list[tuple[int, int]] = []
        limit = -np.inf if bound is None else bound
        reach = np.inf if bound is None else max(longest - 2.0 * bound, 0.0) ** 0.5 + self.slack
        queue: list[tuple[float, int, float]] = [(0.0, 0, np.nan)]
        while queue:
            least, number, from_parent = heapq.heappop(queue)
            if least > reach:
                break
            page, objects = self.pages[number], self.objects[number]
            if number and reach < np.inf:
                near = np.flatnonzero(np.abs(from_parent - page.to_parent) - page.radius <= reach)
                self.avoided += len(objects) - len(near)
                if not len(near):
                    continue
                scores = objects[near] @ asked if len(near) < len(objects) else objects @ asked
            else:
                near, scores = np.arange(len(objects)), objects @ asked
            self.computed += len(near)
            if not page.leaf:
                apart = np.sqrt(np.maximum(longest - 2.0 * scores, 0))
                lower = np.maximum(apart - page.radius[near], 0)
                for n in np.flatnonzero(lower <= reach):
                    heapq.heappush(queue, (float(lower[n]), int(page.below[near[n]]), float(apart[n])))
                continue
            for n in np.flatnonzero(scores >= limit):
                at = near[n]
                found.extend((-int(scores[n]), int(i)) for i in page.ids[page.starts[at] : page.starts[at + 1]] if i != query_id)
            if len(found) > k or (len(found) == k and limit == -np.inf):
                found = sorted(found)[:k]
            if len(found) == k:
                limit = max(limit, -max(found)[0])
                reach = max(longest - 2.0 * limit, 0.0) ** 0.5 + self.slack
        return sorted(found)[:k]


def _routed(rows: DataFrame, pivots: np.ndarray, top: int) -> DataFrame:
    """The rows with the number of the nearest pivot."""
    shared = rows.sparkSession.sparkContext.broadcast((pivots.astype(np.float64), float(top)))

    def run(batches):
        pivots, top = shared.value
        for b in batches:
            if b.num_rows:
                where = _nearest_seed(matrix(b.column(1), b.num_rows, np.float64), pivots, top)[0]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(where.astype(np.int32))], names=["id", "v", "pivot"])

    return rows.mapInArrow(run, "id bigint, v array<int>, pivot int")


def index(rows: DataFrame, sample: np.ndarray, top: int, count: int, k: int = NEIGHBOURS, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """The table of pages of all shards' trees."""
    pivots = np.unique(sample, axis=0)
    pivots = pivots[np.random.default_rng(5).permutation(len(pivots))[: min(PIVOTS, max(1, -(-count // shard_vectors)))]]
    routed = materialize(_routed(rows, pivots, top), "routed")
    # at most as many rows as pivots
    parts = routed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / shard_vectors).cast("int").alias("parts"))
    dealt = routed.join(F.broadcast(parts), "pivot").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def run(table):
        if not table.num_rows:
            return table.schema.empty_table()
        pivot, part = table.column("pivot")[0].as_py(), table.column("part")[0].as_py()
        vectors = matrix(table.column("v").combine_chunks(), table.num_rows, np.int64)
        pages = build(table.column("id").to_numpy(), vectors, float(top), k)
        rows = [(pivot, part, n, p.leaf, p.objects.astype("<i4").tobytes(), p.to_parent.tolist(), p.radius.tolist(), p.below.tolist(), p.starts.tolist(), p.ids.tolist()) for n, p in enumerate(pages)]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = [f.split()[0] for f in PAGES.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return materialize(dealt.select("pivot", "part", "id", "v").groupBy("pivot", "part").applyInArrow(run, PAGES), "pages")


def _bounded(queries: DataFrame, ids: np.ndarray, sample: np.ndarray, k: int) -> DataFrame:
    """The queries with the k-th best score among the sample's other ids, null where it has fewer than k."""
    shared = queries.sparkSession.sparkContext.broadcast((ids, sample))

    def run(batches):
        ids, sample = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            asked, bounds = matrix(b.column(1), b.num_rows), []
            for query_id, query in zip(b.column(0).to_pylist(), asked, strict=True):
                scores = (sample @ query)[ids != query_id]
                bounds.append(int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bounds, pa.int64())], names=["id", "v", "bound"])

    return queries.mapInArrow(run, "id bigint, v array<int>, bound bigint")


def _answers(pages: DataFrame, asked: list, dimensions: int, top: int, k: int) -> DataFrame:
    """What each shard can add to the best of the queries of one block."""
    ids = np.array([r["id"] for r in asked], np.int64)
    shared = pages.sparkSession.sparkContext.broadcast((ids, np.array([r["v"] for r in asked], np.int64), [r["bound"] for r in asked]))

    def run(table):
        pages = []
        for r in sorted(table.to_pylist(), key=lambda r: r["page"]):
            objects = np.frombuffer(r["objects"], "<i4").reshape(-1, dimensions).astype(np.int64)
            pages.append(Page(r["leaf"], objects, np.array(r["to_parent"]), np.array(r["radius"]), np.array(r["below"], np.int64), np.array(r["starts"], np.int64), np.array(r["ids"], np.int64)))
        out = []
        if pages:
            tree = Tree(pages, top)
            for query_id, query, bound in zip(*shared.value, strict=True):
                out.extend((int(query_id), vec_id, -score) for score, vec_id in tree.search(int(query_id), query, k, bound))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return pages.groupBy("pivot", "part").applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def search(
    df: DataFrame, is_query: Callable[[Column], Column], k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding",
    shard_vectors: int = SHARD_VECTORS, sample_vectors: int = SAMPLE_VECTORS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` largest integer products of each row that ``is_query`` names by id."""
    spark = df.sparkSession
    square = F.aggregate("v", F.lit(0).cast("bigint"), lambda total, x: total + x.cast("bigint") * x.cast("bigint"))
    rows = integers(df, id_col, vector_col).filter((F.size("v") > 0) & F.col("id").isNotNull())
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("top")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dimensions, count, top = sizes[0]["d"], sizes[0]["n"], sizes[0]["top"]
    rows = rows.filter(F.size("v") == dimensions)
    taken = sample_fraction(rows, F.col("id"), min(1.0, sample_vectors / count)).limit(2 * sample_vectors).collect() or rows.limit(1).collect()
    taken = sorted({(r["id"], tuple(r["v"])) for r in taken})
    sample_ids, sample = np.array([t[0] for t in taken], np.int64), np.array([t[1] for t in taken], np.int64)
    pages = index(rows, sample, top, count, k, shard_vectors)

    queries = materialize(_bounded(rows.filter(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v")), sample_ids, sample, k), "queries")
    blocks = max(1, -(-queries.count() // block_queries))
    found = None
    for block in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)) == block).collect()
        if part or found is None:
            answers = _answers(pages, part, dimensions, top, k)
            found = answers if found is None else found.unionByName(answers)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH x AS (
 SELECT vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: isfinite(e))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM x q JOIN x c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
