"""Clustering by incremental dot products against plain integer code, its SQL and its awkward rows."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from tests.conftest import SF, SF_SMALL

from fuelspark.llm import centroids
from fuelspark.llm.queries import ORACLE, QUERIES

SCHEMA = "vec_id bigint, embedding array<double>, label int, cluster int, distance string, id int, v string, dots int, before int"
CLASH = (1, 2, "x", 3, "y", 4, 5)


def expected(rows, k=40, rounds=5, dimensions=64):
    """Python integers of any size, all distances anew in each round."""
    usable = [(i, v) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    held = [(i, [math.floor(256 * x) for x in v]) for i, v in usable if all(abs(256 * x) < 1 << 26 for x in v)]
    name = lambda i: "" if i is None else i
    centres = [list(v) for _, v in sorted(held, key=lambda r: (hashlib.sha256(f"2:{name(r[0])}".encode()).hexdigest(), r[1]))[:k]]
    if not centres:
        return []

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres)) for _, v in held]

    for _ in range(rounds):
        where = assign()
        for n in range(len(centres)):
            members = [v for (_, v), (_, m) in zip(held, where, strict=True) if m == n]
            if members:
                centres[n] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    where = assign()
    total, by = sum(d for d, _ in where), {}
    for d, n in where:
        by[n] = by.get(n, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, n, d, by[n], total, sha[n]) for (i, _), (d, n) in zip(held, where, strict=True)], key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_and_sql(spark):
    got = QUERIES["op12_centroid_clustering"](spark, SF_SMALL)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF_SMALL}/embeddings.parquet'")
    want = con.sql(ORACLE["op12_centroid_clustering"])
    assert got.columns == want.columns and rows_of(got) == sorted(want.fetchall(), key=str)
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()][:60]
    small = spark.createDataFrame(table, "vec_id bigint, embedding array<double>")
    assert rows_of(centroids.clustered(small)) == expected(table)


def awkward():
    rng = random.Random(4)
    vector = lambda size: [rng.gauss(0, size) for _ in range(4)]
    one = vector(1)
    rows = [(k, vector(rng.choice([0.01, 1, 50]))) for k in range(120)] + [(200 + k, one) for k in range(60)] + [(7, vector(1)), (7, one), (7, one), (None, one), (None, vector(2))]
    rows += [(300, None), (301, []), (302, [1.0, 2.0, 3.0]), (303, [1.0, None, 2.0, 3.0]), (304, [math.nan, 0.0, 0.0, 0.0]), (305, [math.inf, 0.0, 0.0, 0.0]), (306, [0.0] * 4), (307, [1.0] * 5)]
    rows += [(308, [2.6e5, -2.6e5, 0.0, 1.0]), (309, [1e300, 0.0, 0.0, 0.0])]
    return rows


@pytest.mark.parametrize("k", [1, 9, 400])
def test_awkward_tables(spark, k):
    """Nulls, other lengths, copies, repeated ids, vectors too large for doubles or longs, clashing names."""
    rows = awkward()
    df = spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(5)
    got = centroids.clustered(df, k=k, dimensions=4)
    assert rows_of(got) == expected(rows, k, 5, 4)
    empty = spark.createDataFrame([], SCHEMA)
    assert centroids.clustered(empty).columns == got.columns and centroids.clustered(empty).count() == 0
    assert centroids.clustered(spark.createDataFrame([(None,) * 9] * 3, SCHEMA)).count() == 0


def test_inertia_beyond_a_long(spark):
    far = [[x] * 64 for x in (2.6e5, -2.6e5)]
    df = spark.createDataFrame([(n, far[n % 2]) for n in range(40)], "vec_id bigint, embedding array<double>")
    rows = centroids.clustered(df, k=1).collect()
    assert len(rows) == 40 and {r.inertia for r in rows} == {None} and all(r.distance > 1 << 55 for r in rows)


def test_changes_touch_changed_centroids_only():
    rng = np.random.default_rng(1)
    vectors, old = rng.integers(-300, 300, (50, 8)), rng.integers(-300, 300, (6, 8))
    new = old.copy()
    new[2, 3], new[4, 3], new[4, 7] = 5, 6, 7
    change = centroids.Change.between(old, new)
    assert change.at.tolist() == [3, 7] and np.flatnonzero(change.by.any(axis=1)).tolist() == [2, 4]
    assert (change.dots(vectors, vectors @ old.T) == vectors @ new.T).all() and (change.squares == (new * new).sum(axis=1)).all()
