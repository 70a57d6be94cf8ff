"""SimHash near-dedup over a byte-position inverted index (operator 8).

A fingerprint has 64 bits: bit i is set if it is set in over half the hashes of the text's three-word shingles. Two
fingerprints link if they differ in at most two bits. Such a pair differs in at most two of the eight bytes, so it
shares at least six bytes at their positions. The index holds the fingerprints under each choice of six byte positions
and the bytes there; exactly the pairs whose tally of shared positional bytes reaches six meet in a list, and each
meeting is verified by its differing bits.

The index holds distinct fingerprints, so copies count once, and a list fixes 48 of 64 bits, so it has at most 65,536
members whatever the data: no list needs a cap. Within a list the links are kept as a spanning forest, never as all
pairs. Components come from alternating large-star and small-star steps over the links, each written to the shared
folder; hot keys of these joins are left to the adaptive skew join.

Defined results: null and blank texts have fingerprint zero and link like any other; under three words the whole text
is the one shingle; rows with the same id keep their own rows; a null id never names a component unless all are null.
"""

from itertools import accumulate, chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuelspark.llm.rows import map_rows, quoted
from fuelspark.operators.scale import materialize

SHINGLE = 3
SEED = 42
MAX_BITS = 2
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_POSITIONS = list(combinations(range(8), 8 - MAX_BITS))
# Lists up to this length are compared pair by pair, longer ones by their one-bit neighbours.
PAIRWISE = 48


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(joined, SEED)
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :], strict=False)], "<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and ``fp``, the fingerprint as a signed long."""
    def start():
        return lambda texts: [np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64)]

    return map_rows(docs, keep, [text_col], [("fp", "bigint")], start)


def index_keys(fp: np.ndarray) -> np.ndarray:
    """For each fingerprint a key per choice of six byte positions: the choice and the bytes there."""
    octets = fp.view(np.uint8).reshape(len(fp), 8).astype(np.uint64)
    keys = np.empty((len(fp), len(_POSITIONS)), np.uint64)
    for c, places in enumerate(_POSITIONS):
        keys[:, c] = c
        for p in places:
            keys[:, c] = keys[:, c] << np.uint64(8) | octets[:, p]
    return keys


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links that join two trees so far apart."""
    root: dict[int, int] = {}

    def top(x):
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def list_links(keys: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the lists of sorted keys; lists are whole."""
    change = np.flatnonzero(np.diff(keys)) + 1
    begins, ends = np.append(0, change), np.append(change, len(keys))
    sizes = ends - begins
    size_of = np.repeat(sizes, sizes)
    left, right = [], []
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, min(PAIRWISE, int(sizes.max(initial=1)))):
        i = np.flatnonzero((keys[:-d] == keys[d:]) & (size_of[:-d] <= PAIRWISE))
        near = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= MAX_BITS]
        a.append(near)
        b.append(near + d)
    for x, y in _forest(np.concatenate(a), np.concatenate(b)):
        left.append(fp[x : x + 1])
        right.append(fp[y : y + 1])
    for s, e in zip(begins[sizes > PAIRWISE], ends[sizes > PAIRWISE], strict=True):
        own = fp[s:e]
        rest = np.bitwise_or.reduce(own ^ own[0])  # bits that vary: at most 16
        bits = [np.uint64(1) << np.uint64(k) for k in range(64) if int(rest) >> k & 1]
        # all within a bit of one value are within two of each other, and each pair within two has such a value
        around = np.stack([own, *[own ^ m for m in bits]])
        values, where = np.unique(around.ravel(), return_inverse=True)
        where = where.reshape(around.shape)
        label = np.arange(len(own))
        while True:
            least = np.full(len(values), len(own))
            np.minimum.at(least, where.ravel(), np.broadcast_to(label, where.shape).ravel())
            new = least[where].min(axis=0)
            if (new == label).all():
                break
            label = new
        other = label != np.arange(len(own))
        left.append(own[label[other]])
        right.append(own[other])
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(left or empty), np.concatenate(right or empty)


def links(distinct: DataFrame) -> DataFrame:
    """Links between fingerprints (column ``fp``, distinct), enough to connect all that are connected."""
    def postings(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            keys = index_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp, keys.shape[1]).view(np.int64))], names=["key", "fp"])

    def meet(batches):
        keys, fp = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in chain(batches, (None,)):
            if batch is not None:
                keys = np.concatenate([keys, batch.column(0).to_numpy().view(np.uint64)])
                fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            if len(keys) and (batch is None or len(keys) > 100_000):
                # the last list may go on in the next batch
                whole = len(keys) if batch is None else int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1]))
                a, b = list_links(keys[:whole], fp[:whole]) if whole else (fp[:0], fp[:0])
                keys, fp = keys[whole:], fp[whole:]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    index = distinct.select("fp").mapInArrow(postings, "key bigint, fp bigint")
    return index.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(meet, "a bigint, b bigint").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and root for every node of the edges (a, b), where the root is the smallest node of its component."""
    current = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    state = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: a node's larger neighbours go under the smallest of its neighbourhood
        large = current.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small star: a node and its smaller neighbours go under the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        after = materialize(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct(), name)
        now = after.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        current = after
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


# --- near copies by similarity ----------------------------------------------------------------------
#
# Texts whose sets of five-word shingles have a similarity of 0.8 differ in about 15 % of the bits, which is far more than
# two of 64. For them the fingerprint has 256 bits and only finds candidates: the bits are turned (put in another order)
# several times, and the index is keyed by each turn's pairs of bytes. A pair that shares a key and differs in at most
# NEAR_BITS bits is a candidate; by calculation, of pairs of similarity 0.8 99.9 % are, of 0.85 99.99 %. Groups of
# candidates are then settled by their texts: only a similarity of their shingles of at least 0.8 links.

NEAR_SHINGLE = 5
NEAR_WORDS = 4
NEAR_BITS = 68
_TURNS = [np.random.default_rng(k).permutation(64 * NEAR_WORDS) for k in range(48)]
# Turn and two byte positions of a key. From LIST_PRINTS prints on, keys get more bits and grow in number accordingly.
_TRIPLES = [(t, 2 * k, 2 * k + 1) for t in range(10) for k in range(16)]
LIST_PRINTS = 1 << 20
# Shingles of one side that meet in one task while a group of candidates is settled.
PART_SHINGLES = 2_000_000
NEAR_COLUMNS = [f"w{k}" for k in range(NEAR_WORDS)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles; none for a text without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *[e + 1 for e in ends]]
    digest = xxhash.xxh64_intdigest
    if len(words) < NEAR_SHINGLE:
        return np.array([digest(joined, SEED)], "<u8")
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[NEAR_SHINGLE - 1 :], strict=False)], "<u8"))


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """256 bits over distinct shingles; zero without any."""
    if not len(hashes):
        return np.zeros(NEAR_WORDS, np.uint64)
    total = np.zeros(64 * NEAR_WORDS, np.int64)
    for at in range(0, len(hashes), 16_384):
        part = hashes[at : at + 16_384]
        wide = np.stack([_mixed(part + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for k in range(NEAR_WORDS)], axis=1)
        total += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")


def wide_fingerprint(text: str | None) -> np.ndarray:
    """256 bits over the distinct five-word shingles; zero for a text without words."""
    return wide_print(shingle_hashes(text))


def _nodes(wide: np.ndarray) -> np.ndarray:
    out = np.zeros(len(wide), np.uint64)
    for k in range(NEAR_WORDS):
        out = _mixed(out * np.uint64(3) + wide[:, k])
    return out


def extra_bits(prints: int) -> int:
    """Bits that keys have beyond two bytes, so that lists of unrelated prints stay short."""
    return min(8, max(0, (max(1, prints) - 1).bit_length() - (LIST_PRINTS - 1).bit_length()))


def triple_keys(wide: np.ndarray, extra: int = 0) -> np.ndarray:
    """A column of keys per turn and pair of bytes; each extra bit halves the lists and takes 1.19 times the turns."""
    bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8).reshape(len(wide), -1), axis=1, bitorder="little")
    places = _TRIPLES if not extra else [(t, 2 * k, 2 * k + 1) for t in range(round(10 * 1.19**extra)) for k in range(16)]
    keys, turned, turn = np.empty((len(wide), len(places)), np.uint64), None, -1
    for c, (t, x, y) in enumerate(places):
        if t != turn:
            turned, turn = np.packbits(bits[:, _TURNS[t]], axis=1).astype(np.uint64), t
        keys[:, c] = (np.uint64(c << 24) | turned[:, x] << np.uint64(16) | turned[:, y] << np.uint64(8)) | turned[:, (y + 1) % 32] >> np.uint64(8 - extra)
    return keys


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int32)


def spanning(n: int, near, front: np.ndarray | None = None, once: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all of 0..n-1 that chains of near pairs connect. ``near(i, others)`` flags the others near i.

    Whatever is reached is compared with all that is not reached yet, and with nothing else, so a dense group costs few
    rounds and no link that would connect anything is left out. ``front`` are members taken as reached; ``once``: only
    these are compared with the others.
    """
    left = np.arange(n) if front is None else np.setdiff1d(np.arange(n), front)
    none = np.zeros(0, np.int64)
    a, b = [none], [none]
    front = none if front is None else front
    while len(left):
        if not len(front):
            front, left = left[:1], left[1:]
        reached = [none]
        if len(front) <= len(left):
            for i in front.tolist():
                hit = near(i, left)
                if hit.any():
                    reached.append(left[hit])
                    a.append(np.full(len(reached[-1]), i))
                    b.append(reached[-1])
                    left = left[~hit]
        else:
            for j in left.tolist():
                hit = near(j, front)
                if hit.any():
                    a.append(front[[hit.argmax()]])
                    b.append(np.array([j]))
                    reached.append(b[-1])
            left = np.setdiff1d(left, np.concatenate(reached), assume_unique=True)
        front = np.concatenate(reached)
        if once:
            break
    return np.concatenate(a), np.concatenate(b)


def near_list_links(keys: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked pairs within the lists of sorted keys, which connect exactly what the links of a list connect.

    Members stand in the same order in every list, and links to the first ones are preferred, so that the lists of a
    group of near copies bring mostly the same links. Lists of up to ``PAIRWISE`` are compared pair by pair, longer ones
    from each member reached to those not reached yet; both give a spanning forest of the list's links.
    """
    change = np.flatnonzero(np.diff(keys)) + 1
    begins, ends = np.append(0, change), np.append(change, len(keys))
    sizes = ends - begins
    size_of = np.repeat(sizes, sizes)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, min(PAIRWISE, int(sizes.max(initial=1)))):
        i = np.flatnonzero((keys[:-d] == keys[d:]) & (size_of[:-d] <= PAIRWISE))
        near = i[_apart(wide[i], wide[i + d]) <= NEAR_BITS]
        a.append(near)
        b.append(near + d)
    a, b = [np.concatenate(a)], [np.concatenate(b)]
    order = np.lexsort((b[0], a[0]))
    kept = np.array(_forest(a[0][order], b[0][order]), np.int64).reshape(-1, 2)
    a, b = [kept[:, 0]], [kept[:, 1]]
    for s, e in zip(begins[sizes > PAIRWISE], ends[sizes > PAIRWISE], strict=True):
        own = wide[s:e]
        x, y = spanning(e - s, lambda i, others, own=own: _apart(own[others], own[i]) <= NEAR_BITS)
        a.append(x + s)
        b.append(y + s)
    return np.concatenate(a), np.concatenate(b)


def near_links(distinct: DataFrame) -> DataFrame:
    """Links between candidates among distinct wide fingerprints, named by ``_nodes``."""
    extra = extra_bits(distinct.count())

    def postings(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 5_000):
                part = batch.slice(at, 5_000)
                wide = np.stack([part.column(k).to_numpy().view(np.uint64) for k in range(NEAR_WORDS)], axis=1)
                keys = triple_keys(wide, extra)
                repeated = np.repeat(wide, keys.shape[1], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *[pa.array(np.ascontiguousarray(repeated[:, k]).view(np.int64)) for k in range(NEAR_WORDS)]], names=["key", *NEAR_COLUMNS])

    def meet(batches):
        keys, wide = np.zeros(0, np.uint64), np.zeros((0, NEAR_WORDS), np.uint64)
        for batch in chain(batches, (None,)):
            if batch is not None:
                keys = np.concatenate([keys, batch.column(0).to_numpy().view(np.uint64)])
                wide = np.concatenate([wide, np.stack([batch.column(k + 1).to_numpy().view(np.uint64) for k in range(NEAR_WORDS)], axis=1)])
            if len(keys) and (batch is None or len(keys) > 100_000):
                whole = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1]))  # the last list may go on
                a, b = near_list_links(keys[:whole], wide[:whole]) if whole else (np.zeros(0, np.int64),) * 2
                nodes = _nodes(wide[np.concatenate([a, b])]).view(np.int64).reshape(2, -1)
                pairs = np.unique(np.sort(nodes, axis=0), axis=1)
                keys, wide = keys[whole:], wide[whole:]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    columns = ", ".join(f"{c} bigint" for c in NEAR_COLUMNS)
    index = distinct.select(*NEAR_COLUMNS).mapInArrow(postings, f"key bigint, {columns}")
    return index.repartition("key").sortWithinPartitions("key", *NEAR_COLUMNS).mapInArrow(meet, "a bigint, b bigint").distinct()


def thinned(edges: DataFrame, at_once: int = 500_000) -> DataFrame:
    """Fewer edges that connect the same: of every ``at_once`` edges of a partition, those that join two trees."""
    def run(batches):
        a, b = [], []
        for batch in chain(batches, (None,)):
            if batch is not None:
                a.append(batch.column(0).to_numpy())
                b.append(batch.column(1).to_numpy())
            if a and (batch is None or sum(map(len, a)) >= at_once):
                kept = np.array(_forest(np.concatenate(a), np.concatenate(b)), np.int64).reshape(-1, 2)
                a, b = [], []
                yield pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


class Sets:
    """Sets of shingles by place, compared exactly."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        values, where = np.unique(flat, return_inverse=True)
        where = where.ravel()
        self.of = np.split(where, np.cumsum(self.size)[:-1])
        order = np.argsort(where, kind="stable")
        self.holders = np.repeat(np.arange(len(sets)), self.size)[order]
        self.begins = np.searchsorted(where[order], np.arange(len(values) + 1))

    def alike(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of the others have a similarity to set i of at least 0.8."""
        begins, ends = self.begins[self.of[i]], self.begins[self.of[i] + 1]
        n = ends - begins
        at = np.repeat(begins - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(self.holders[at], minlength=len(self.size))[others]
        return 9 * common >= 4 * (self.size[i] + self.size[others])


def settled_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) between nodes of the same group, columns node, group and shingles, that connect exactly the nodes that
    chains of similarities of at least 0.8 connect.

    All of a group are compared with its smallest node. Those alike to it need no further comparison with each other;
    the rest are compared with them and with each other, dealt over cells of two parts of bounded size.
    """
    first = sets.groupBy("group").agg(F.min("node").alias("node")).join(sets.select("node", F.col("shingles").alias("_first")), "node")
    both = sets.join(first.select("group", F.col("node").alias("leader"), "_first"), "group")
    common, size = F.size(F.array_intersect("shingles", "_first")), F.size("shingles")
    scored = both.select("group", "node", "leader", "shingles", size.alias("size"), (9 * common >= 4 * (size + F.size("_first"))).alias("core"))
    scored = materialize(scored, "near-scored")
    stars = scored.filter("core and node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    part = lambda core: F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("core") == core, F.col("size")).otherwise(0)) / F.lit(PART_SHINGLES))).cast("bigint")
    open_groups = scored.groupBy("group").agg(part(True).alias("k"), part(False).alias("r"), F.count(F.when(~F.col("core"), 1)).alias("rest")).filter("rest > 0")
    rows = scored.join(open_groups, "group").withColumn("own", F.pmod(F.xxhash64("node", F.lit("part")), F.when(F.col("core"), F.col("k")).otherwise(F.col("r"))))
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("bigint").alias("i"), j.cast("bigint").alias("j"))
    over = lambda n, f: F.transform(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1), f)
    own = F.col("own")
    cells = F.when(F.col("core"), over("r", lambda j: cell(0, own, j))).otherwise(
        F.concat(over("k", lambda i: cell(0, i, own)), over("r", lambda j: cell(1, F.least(own, j), F.greatest(own, j)))))
    dealt = rows.select("group", "node", "core", "shingles", F.explode(cells).alias("cell")).select("group", "cell.*", "node", "core", "shingles")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, core = table.column("node").to_numpy(), table.column("core").to_numpy(zero_copy_only=False)
        own = Sets([x.values.to_numpy() for x in table.column("shingles")])
        front = np.flatnonzero(core)
        # members of the core are linked already, so those of a part are as one; the rest meets in cells of its own
        a, b = spanning(len(node), own.alike, front, once=True) if len(front) else spanning(len(node), own.alike)
        return pa.table({"a": node[a], "b": node[b]})

    return stars.unionByName(dealt.groupBy("group", "kind", "i", "j").applyInArrow(run, "a bigint, b bigint"))


def near_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, all columns, of each group of near copies: the one with the smallest id (rows without id last), then the
    smallest text key; of rows with the same id and text one stays. Groups are the texts that chains of similarities of
    at least 0.8 connect."""
    text = F.col(quoted(text_col))
    rows = docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))

    def start():
        def work(texts):
            sets = [shingle_hashes(t) for t in texts.to_pylist()]
            wide = np.array([wide_print(s) for s in sets], np.uint64).reshape(-1, NEAR_WORDS)
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
            return [node.view(np.int64), _nodes(wide).view(np.int64), *[np.ascontiguousarray(wide[:, k]).view(np.int64) for k in range(NEAR_WORDS)]]

        return work

    def sets_of():
        return lambda texts: [[shingle_hashes(t).view(np.int64) for t in texts.to_pylist()]]

    prints = materialize(map_rows(rows, ["doc_id", "key"], ["text"], [(c, "bigint") for c in ("node", "print", *NEAR_COLUMNS)], start), "wide")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")
    distinct = prints.groupBy("node", "print").agg(least)
    candidates = components(thinned(materialize(near_links(prints.select(*NEAR_COLUMNS).distinct()), "near-links")), "near")
    grouped = distinct.join(candidates.select(F.col("node").alias("print"), "root"), "print", "left").select("node", "least", F.coalesce("root", "print").alias("group"))
    grouped = materialize(grouped, "near-groups")
    several = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group")
    asked = grouped.join(several, "group").select("node", "group", F.col("least.doc_id").alias("_id"), F.col("least.key").alias("_key"))
    texts = rows.join(asked, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["key"] == F.col("_key")), "inner").select("node", "group", "text").dropDuplicates(["node"])
    sets = materialize(map_rows(texts, ["node", "group"], ["text"], [("shingles", "array<bigint>")], sets_of), "near-sets")
    roots = components(thinned(materialize(settled_links(sets), "near-settled")), "near")
    rooted = grouped.join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("f")).select(F.col("f.doc_id").alias("_first_id"), F.col("f.key").alias("_first_key")).distinct()
    return _only(docs, first, id_col, text_col)


def _only(docs: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows named by id and text key, each once."""
    keyed = docs.withColumn("_row_key", F.xxhash64(F.col(quoted(text_col))))
    id_ = F.col(quoted(id_col)).cast("bigint")
    kept = keyed.join(first, id_.eqNullSafe(F.col("_first_id")) & (F.col("_row_key") == F.col("_first_key")))
    return kept.dropDuplicates([id_col, "_row_key"]).select(*[quoted(c) for c in docs.columns])


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Prints (doc_id, key of the text, fp) of every row, and for every fp its component_id and its component's
    representative: the row with the smallest id, then the smallest key; rows without id come last."""
    text = F.col(quoted(text_col))
    rows = docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    prints = materialize(fingerprints(rows, ["doc_id", "key"]), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least"))
    roots = components(links(distinct))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("first"))
    of = rooted.join(named, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("first_key"))
    return prints, materialize(of, "classes")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id (the smallest id reachable) for every row."""
    prints, of = _classes(docs, id_col, text_col)
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns: the one with the smallest id (rows without id last); of rows with the
    same id and text one stays."""
    _, of = _classes(docs, id_col, text_col)
    first = of.select(F.col("component_id").alias("_first_id"), F.col("first_key").alias("_first_key")).distinct()
    return _only(docs, first, id_col, text_col)
