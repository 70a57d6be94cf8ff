"""Decontamination, SimHash, line dedup and nearest neighbours against plain code."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from tests.conftest import SF_SMALL
from tests.llm.conftest import SCHEMA, lower

from fuelspark.llm import decontamination, line_dedup, neighbours, simhash
from fuelspark.llm.queries import ORACLE, QUERIES

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(docs, items, size=10):
    windows = {}
    for i, text in items:
        w = WORD.findall(lower(text))
        if i is not None and w:
            for k in range(max(1, len(w) - size + 1)):
                windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for doc_id, text in docs:
        w, hit, found = WORD.findall(lower(text)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


def test_decontamination_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op4_decontamination"](spark, SF_SMALL).collect()), key=str) == contaminated(docs, items)


ITEMS = [(1, "The cat sat on the mat, with the other cat of the house"), (2, "ONE two"), (3, ""), (4, None), (None, "le chat"), (5, "the cat"), (5, "sur la table"), (6, "nowhere to be found here")]


@pytest.mark.parametrize("block_bytes", [decontamination.BLOCK_BYTES, 20])
def test_decontamination_awkward(spark, awkward, nothing, nulls, monkeypatch, block_bytes):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(decontamination, "SEGMENT_BYTES", 500)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = sorted(map(tuple, decontamination.contamination(awkward, items).collect()), key=str)
    assert got == contaminated([(r.doc_id, r.text) for r in awkward.collect()], ITEMS)
    clean = decontamination.uncontaminated(awkward, items)
    assert clean.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in got if not r[5])
    assert decontamination.contamination(nothing, items).count() == 0
    assert [tuple(r)[1:4] for r in decontamination.contamination(nulls, items).collect()] == [(0, 0, 0)] * 3
    assert decontamination.contamination(awkward, items.limit(0)).filter("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "gamma alpha beta"), (4, "alpha " * 9 + "beta")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    near = {s: sorted(r.doc_id for r in decontamination.matches(docs, items, slack=s).filter("size(hits) > 0").collect()) for s in (0, 1)}
    assert near == {0: [2], 1: [1, 2]}


def prints(text):
    w = [x for x in re.split("[\x20\x09-\x0D]+", lower(text)) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def components_of(values):
    """Place of the root of each value, by all pairs."""
    root = list(range(len(values)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    values = np.array(values, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values) <= 2):
            a, b = top(i), top(int(j))
            root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def expected_classes(rows):
    fp = [prints(t) for _, t in rows]
    of = components_of(fp)
    least = {}
    for (i, _), c in zip(rows, of, strict=True):
        least[c] = min([x for x in (least.get(c), i) if x is not None], default=None)
    return sorted([(i, f"{f:016x}", least[c]) for (i, _), f, c in zip(rows, fp, of, strict=True)], key=str)


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op8_simhash"](spark, SF_SMALL).collect()), key=str) == expected_classes(rows)


def test_simhash_awkward(awkward, nothing, nulls):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    want = expected_classes(rows)
    assert sorted(map(tuple, simhash.classes(awkward).collect()), key=str) == want
    kept = simhash.representatives(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted({c if c is not None else -1 for _, _, c in want})
    assert simhash.classes(nothing).count() == 0
    assert [tuple(r) for r in simhash.classes(nulls).collect()] == [(None, "0" * 16, None)] * 3
    assert simhash.representatives(nulls).count() == 1


@pytest.mark.parametrize("pairwise", [2, 5, simhash.PAIRWISE])
def test_dense_fingerprints(spark, monkeypatch, pairwise):
    """Long lists of the index and chains of links, with either way to compare a list."""
    random.seed(pairwise)
    values = set()
    for _ in range(30):
        base = random.getrandbits(64)
        for _ in range(random.choice([1, 4, 60])):
            values.add(base ^ sum(1 << b for b in random.sample(range(12), random.randint(0, 5))))
    values = sorted(values)
    keys = np.sort(simhash.index_keys(np.array(values, np.uint64)).ravel())
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    del keys
    fp = np.array(values, np.uint64)
    all_keys, all_fp = simhash.index_keys(fp).ravel(), np.repeat(fp, 28)
    order = np.lexsort((all_fp, all_keys))
    a, b = simhash.list_links(all_keys[order], all_fp[order])
    edges = spark.createDataFrame(list(zip(a.view(np.int64).tolist(), b.view(np.int64).tolist(), strict=True)), "a bigint, b bigint")
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    got = [root.get(int(v), int(v)) for v in fp.view(np.int64)]
    want = components_of(values)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5, 5)], "a bigint, b bigint")
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    assert root == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0D]+", lower(text)) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_near_copies_are_found_and_others_left(spark):
    random.seed(4)
    vocabulary = [f"w{k}" for k in range(5000)]
    rows, group = [], {}
    for g in range(60):
        base = random.choices(vocabulary, k=random.choice([40, 200, 800]))
        for c in range(random.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(c and max(1, len(base) // random.choice([60, 100]))):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(copy)))
    kept = {r.doc_id for r in simhash.near_representatives(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    first = {}
    for i, t in rows:
        first.setdefault(group[i], shingles(t))
    alike = [i for i, t in rows if i not in {min(k for k in group if group[k] == group[i])} and len(first[group[i]] & shingles(t)) / len(first[group[i]] | shingles(t)) >= 0.8]
    assert len(alike) > 40 and len([i for i in alike if i in kept]) <= 0.05 * len(alike)
    assert {min(k for k in group if group[k] == g) for g in range(60)} <= kept


def test_near_copies_awkward(awkward, nothing, nulls):
    kept = simhash.near_representatives(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 6, 8, 9, 10, 11, 12]
    assert simhash.near_representatives(nothing).count() == 0 and simhash.near_representatives(nulls).count() == 1


@pytest.mark.parametrize("pairwise", [2, 40])
def test_large_group_of_near_copies(spark, monkeypatch, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    wide = np.random.default_rng(0).integers(0, 1 << 64, (1, 4), dtype=np.uint64).repeat(300, axis=0)
    wide[:, 0] ^= np.uint64(1) << np.arange(300, dtype=np.uint64) % np.uint64(64)
    keys = simhash.triple_keys(wide).ravel()
    order = np.argsort(keys, kind="stable")
    a, b = simhash.near_list_links(keys[order], wide.repeat(len(simhash._TRIPLES), axis=0)[order])
    owner = np.repeat(np.arange(300), len(simhash._TRIPLES))[order]
    assert len(simhash._forest(owner[a], owner[b])) == 299


def test_line_dedup_awkward(spark, awkward, nothing, nulls):
    page = lambda i, *lines, host="h": (i, "\n".join(lines), "en", host, 1, 0.5, 1, True, 1, 1, 1, 1, 1, 1, "x", 1)
    rows = [page(i, "  Menu ", f"text {i}", "", "menu2" if i < 3 else f"only {i}") for i in range(20)]
    rows += [page(100, "Menu"), page(101, "Menu", "", " "), page(102, None or ""), page(103, "Menu", host=None)]
    rows += [page(200 + i, "copy one", "copy two") for i in range(50)]  # equal pages are one page
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(awkward)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_dropped").collect()}
    assert got[5 + 0].doc_id == 5
    assert got[10].text is not None and got[100].text == "Menu" and got[101].text == "Menu\n\n " and got[103].text == "Menu"
    texts = {r.text for r in line_dedup.dedup_lines(docs).filter("source = 'h' and doc_id < 20").collect()}
    assert texts == {f"text {i}\n\n" + ("menu2" if i < 3 else f"only {i}") for i in range(20)}
    assert got[200].text == "copy one\ncopy two" and got[200].n_dropped == 0
    assert line_dedup.dedup_lines(docs, counts=False).columns == docs.columns
    assert line_dedup.dedup_lines(nothing).count() == 0
    assert [(r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(nulls).collect()] == [(None, 0, 0)] * 3
    # the same by SQL
    db = duckdb.connect()
    db.register("arrow", docs.select("doc_id", "text", "source").toArrow())
    db.execute("CREATE VIEW documents AS SELECT * FROM arrow")
    want = sorted(db.sql(ORACLE["op3_line_dedup"]).fetchall(), key=str)
    assert sorted(map(tuple, line_dedup.digests(docs).collect()), key=str) == want


def exact_nearest(rows, queries, k):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    size = max({len(v) for _, v in usable}, key=[len(v) for _, v in usable].count)
    usable = [(i, v) for i, v in usable if len(v) == size]
    out = {}
    for q, v in usable:
        if queries(q):
            scored = sorted((-float((v * w).sum()), i) for i, w in usable if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_neighbours_awkward(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(120)]
    rows += [(i, rows[40][1]) for i in range(200, 260)]  # a large group of copies
    rows += [(300, None), (320, [0.0] * 8), (340, [None] + [1.0] * 7), (360, [float("nan")] * 8), (380, [float("inf")] * 8), (400, [1.0] * 3), (None, [1.0] * 8), (420, [])]
    df = spark.createDataFrame([(i, v, 0.1, 1) for i, v in rows], "vec_id bigint, embedding array<float>, score double, rank int")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {}
    for r in neighbours.nearest(df, lambda i: i % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = exact_nearest(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys()
    found = 0
    for q, listed in got.items():
        listed.sort()
        assert [r for r, _, _ in listed] == list(range(1, 21))
        assert [(-s, i) for _, i, s in listed] == sorted((-s, i) for _, i, s in listed)
        found += len({i for _, i, _ in listed} & {i for i, _ in want[q]})
    assert found >= 0.9 * sum(map(len, want.values()))
    # the copies of vector 40: ties go to the smaller ids
    assert [i for _, i, _ in got[40]] == list(range(200, 220))
    assert neighbours.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0
    few = df.filter("vec_id < 5")
    assert sorted((r["rank"], r.query_id) for r in neighbours.nearest(few, lambda i: i % 20 == 0).collect()) == [(k, 0) for k in range(1, 5)]


def test_neighbours_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    want = exact_nearest(rows, lambda i: i % 20 == 0, 20)
    got = {}
    for r in QUERIES["op10_nearest_neighbours"](spark, SF_SMALL).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hit = 0
    for q, listed in want.items():
        for i, s in listed:
            if i in got[q]:
                hit += 1
                assert abs(got[q][i] - s) < 1e-9
    assert hit >= 0.9 * 20 * len(want)


def test_pigeonhole_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((300, 16))
    codes = neighbours.fit(vectors, 5, rotations=2)
    codes.radius = 9
    shard = neighbours.Shard(codes, np.arange(300), vectors)
    words = codes.encode(rng.standard_normal((20, 16)))
    assert not (~shard.probe(words) & (shard.distances(words) <= 9)).any()


@pytest.mark.parametrize("radius", [0, 1, 5, 9, 13, 16, 25, 31, 32])
def test_posting_lists_give_what_all_comparisons_give(radius):
    rng = np.random.default_rng(3)
    vectors = np.repeat(rng.standard_normal((40, 16)), 10, axis=0) + 0.1 * rng.standard_normal((400, 16))
    shard = neighbours.Shard(neighbours.fit(vectors, 5, rotations=2), np.arange(400), vectors)
    words = shard.codes.encode(np.vstack([vectors[:15], rng.standard_normal((5, 16))]))
    apart = shard.distances(words)
    for row, word in enumerate(words):
        assert (shard.within(word, radius) == np.flatnonzero(apart[row] <= radius)).all()
    postings, every = shard.index[0], np.arange(1 << 16, dtype=np.uint16)
    for near in (0, 1, 2, 7, 16):  # lists of enumerated values, and near ones among those that occur
        ball = every[np.bitwise_count(every) <= near]
        found = np.zeros(400, bool)
        postings.mark(found, words[0, 0], ball, near)
        assert sorted(postings.read(ball ^ words[0, 0])) == np.flatnonzero(found).tolist()


def test_posting_lists_skip_most_of_clustered_vectors():
    """Codes of clustered vectors are near or far, so the lists of near values leave most vectors untouched."""
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((60, 32))[rng.integers(0, 60, 6000)] + 0.15 * rng.standard_normal((6000, 32)))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    ids = np.arange(len(vectors))
    shard = neighbours.Shard(neighbours.fit(vectors[::4], 10), ids, vectors)
    asked = ids[::50]
    found = {q: set(got.tolist()) for q, got, _ in shard.search(asked, vectors[asked], 10)}
    scores = vectors[asked] @ vectors.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :10]
    assert sum(len(found[q] & set(b.tolist())) for q, b in zip(asked, best, strict=True)) >= 0.9 * 10 * len(asked)
    assert shard.compared < 0.05 * len(asked) * len(vectors)
    assert shard.scored <= shard.compared


@pytest.mark.parametrize("size", [47, 48, 49, 50, 300])
def test_chains_in_lists_of_any_length(size):
    """B is near the leader A, and C is near B alone: in one list, whatever its length, C must hang on."""
    wide = np.random.default_rng(5).integers(0, 1 << 64, (size, 4), dtype=np.uint64)
    flip = lambda row, bits: row ^ np.array([sum(1 << k - 64 * w for k in bits if k // 64 == w) for w in range(4)], np.uint64)
    step = simhash.NEAR_BITS
    wide[1] = flip(wide[0], range(step))
    wide[2] = flip(wide[1], range(step, 2 * step))
    a, b = simhash.near_list_links(np.zeros(size, np.uint64), wide)
    assert {frozenset(x) for x in zip(a.tolist(), b.tolist(), strict=True)} == {frozenset((0, 1)), frozenset((1, 2))}


def exact_near(texts):
    """Smallest ids of the groups that five-word similarities of at least 0.8 connect, by all pairs of the texts."""
    sets, root = [shingles(t) for _, t in texts], list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, one in enumerate(sets):
        for j in range(i):
            both = len(one & sets[j])
            if both * 9 >= 4 * (len(one) + len(sets[j])):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for k, (i, _) in enumerate(texts):
        groups.setdefault(top(k), []).append(i)
    return {min(g) for g in groups.values()}


@pytest.mark.parametrize("part_shingles", [simhash.PART_SHINGLES, 2_000])
def test_near_copies_by_exact_similarity(spark, monkeypatch, part_shingles):
    """Pairs just above and below 0.8, and a chain of some hundred near copies whose ends are unlike each other."""
    monkeypatch.setattr(simhash, "PART_SHINGLES", part_shingles)
    random.seed(11)
    vocabulary, rows = [f"w{k}" for k in range(3000)], []
    for g in range(120):
        # n shingles, of which the copy, cut and continued, shares all but x: similarity (n - x) / (n + x)
        n = 200 + g
        x = next(x for x in range(n) if 9 * (n - x) < 8 * n) - (g % 2)
        base = random.choices(vocabulary, k=n + 4)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[x:] + random.choices(vocabulary, k=x)))]
    stream = random.choices(vocabulary, k=4_000)
    chain = [" ".join(stream[12 * k : 12 * k + 204]) for k in range(300)]
    random.shuffle(chain)
    rows += [(1000 + k, t) for k, t in enumerate(chain)]
    want = exact_near(rows)
    assert len([i for i in want if i < 1000]) == 180 and len([i for i in want if i >= 1000]) == 1
    got = {r.doc_id for r in simhash.near_representatives(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert want <= got  # nothing but near copies goes
    assert len(got - want) <= 1  # candidates are found almost surely


def test_near_copies_of_the_table_by_exact_similarity(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r.doc_id for r in simhash.near_representatives(docs).collect()}
    assert got == exact_near([(r.doc_id, r.text) for r in docs.collect()])
