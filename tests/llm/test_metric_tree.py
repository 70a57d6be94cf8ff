"""Exact search by M-trees against all products, its SQL and its awkward rows."""

import math
import random

import duckdb
import numpy as np
import pytest
from tests.conftest import SF, SF_SMALL

from fuelspark.llm import metric_tree
from fuelspark.llm.queries import ORACLE, QUERIES

SCHEMA = "vec_id bigint, embedding array<double>, label int, query_id int, rank string, score int, id int, pivot int, page string"
CLASH = (1, 2, "x", 3, 4, 5, "y")


def expected(rows, k, divisor):
    held = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) and abs(256 * x) < 1 << 26 for x in v)]
    if not held:
        return []
    sizes = [len(v) for _, v in held]
    most = min(set(sizes), key=lambda d: (-sizes.count(d), d))
    held = sorted({r for r in held if len(r[1]) == most})
    out, asked = [], {}
    for i, v in held:
        if i % divisor == 0:
            asked.setdefault(i, v)
    for i, q in asked.items():
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in held if j != i)[:k]
        out.extend((i, n, j, -s) for n, (s, j) in enumerate(best, 1))
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_query_and_sql(spark):
    for sf in (SF_SMALL, SF):
        got = QUERIES["op13_exact_search"](spark, sf)
        con = duckdb.connect()
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
        want = con.sql(ORACLE["op13_exact_search"])
        assert got.columns == want.columns and rows_of(got) == sorted(want.fetchall())


def clustered_vectors(rng, n, d, size=1.0):
    centres = rng.normal(0, 1, (12, d))
    return (centres[rng.integers(0, 12, n)] * size + rng.normal(0, 0.02 * size, (n, d))).tolist()


def awkward():
    rng, draw = np.random.default_rng(3), random.Random(3)
    rows = [(k, v) for k, v in enumerate(clustered_vectors(rng, 500, 6))]
    one = draw.choice(rows)[1]
    rows += [(1000 + k, one) for k in range(300)] + [(10, one), (10, one), (20, rows[3][1]), (-10, rows[5][1]), (None, one)]
    rows += [(2000, None), (2010, []), (2020, [1.0, 2.0]), (2030, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (2040, [math.nan] + [0.0] * 5), (2050, [math.inf] + [0.0] * 5), (2060, [0.0] * 6), (2070, [1e300] + [0.0] * 5)]
    return rows


@pytest.mark.parametrize(("k", "settings"), [(5, {}), (3, {"shard_vectors": 60, "block_queries": 15, "sample_vectors": 40}), (2000, {"shard_vectors": 100})])
def test_awkward_tables(spark, monkeypatch, k, settings):
    """Nulls, other lengths, many copies, repeated ids, ties, clashing names; one and many shards, blocks and pages."""
    monkeypatch.setattr(metric_tree, "PAGE_ENTRIES", 8)
    rows = awkward()
    df = spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(3)
    assert rows_of(metric_tree.search(df, lambda i: i % 10 == 0, k, **settings)) == expected(rows, k, 10)
    empty = spark.createDataFrame([], SCHEMA)
    assert metric_tree.search(empty, lambda i: i % 10 == 0).count() == 0
    assert metric_tree.search(spark.createDataFrame([(None,) * 9] * 3, SCHEMA), lambda i: i % 10 == 0).count() == 0
    assert metric_tree.search(df.filter("vec_id = 20"), lambda i: i % 10 == 0).count() == 0
    assert metric_tree.search(df.filter("vec_id = 21"), lambda i: i % 10 == 0).count() == 0


@pytest.mark.parametrize("size", [256, 1 << 24])
def test_bounds_avoid_computations_and_stay_exact(size):
    """Also where products leave the range that doubles hold exactly."""
    rng = np.random.default_rng(2)
    vectors = np.floor(np.array(clustered_vectors(rng, 6000, 16, size))).astype(np.int64)
    vectors = np.clip(vectors, -(1 << 26) + 1, (1 << 26) - 1)
    ids, top = np.arange(6000), int((vectors * vectors).sum(axis=1).max())
    pages = metric_tree.build(ids, vectors, float(top), 5, 32)
    for p in pages:  # every entry's page lies within its radius, at the stored parent distance
        for n, below in enumerate(p.below):
            lower = pages[below]
            apart = metric_tree._apart(p.objects[n].astype(float), lower.objects.astype(float), float(top))
            assert (apart <= p.radius[n] * (1 + 1e-9) + 1e-6).all() and np.allclose(apart, lower.to_parent, rtol=1e-6, atol=1e-3)
    tree = metric_tree.Tree(pages, top)
    for i in range(0, 6000, 60):
        scores = vectors @ vectors[i]
        order = [int(j) for j in np.lexsort((ids, -scores)) if j != i][:5]
        assert tree.search(i, vectors[i], 5) == [(-int(scores[j]), j) for j in order]
        fifth = int(scores[order[4]])
        assert tree.search(i, vectors[i], 5, fifth) == [(-int(scores[j]), j) for j in order]
    assert tree.avoided > 0 and tree.computed < 0.5 * 200 * 6000
