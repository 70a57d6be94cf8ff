"""Language-model scoring with a log-frequency Bloom filter (operator 5).

The training count of a pair of words (and, of order 3, of three words) is quantised to a level (1 + the logarithm of the
count), and the filter holds the n-gram once per level up to its own. Probing level after level until the first miss gives
the level back, never too low, rarely too high. With q the mean count of the level,

    P(w | v) = LAMBDA * q(v, w) / c(v) + (1 - LAMBDA) * P(w), or P(w) if c(v) = 0
    P(w | u, v) = LAMBDA * q(u, v, w) / q(u, v) + (1 - LAMBDA) * P(w | v), or P(w | v) if q(u, v) = 0

where c are the word counts and P(w) their additive smoothing. The filter holds every training n-gram, so those of a
context add up to its count and its probabilities to about 1: levels round counts, and the filter's false positives add
some to contexts that are rare against the number of words. The word before the first and after the last one is the end
token; the first word has no context of two.

Work is laid out by chunks, a few megabytes of text each, written once to the shared folder as word numbers and 64-bit
keys of their distinct words. Counts meet by key range: a chunk sends one packed, pre-aggregated piece per range, so a
frequent word or n-gram costs one entry per chunk. Ranges grow in number with the corpus, not in size. Each range of
n-grams builds its own part of the filter and lays the pieces of its chunks beside it. Consecutive ranges make a slab,
whose parts together have a bounded size: slab by slab, they go to the workers, which probe the n-grams of that slab alone.
So every n-gram of a chunk is probed once, however many slabs there are. The levels return to their chunks, which score
their texts.

N-grams are told apart by their keys' leading bits, ``SPARE_BITS`` more than it takes to number them: one in 4,096 is
taken for another, which is little against the filter's own false positives.

Defined results: a null text has the end token only; rows of the same id are scored each; without training documents all
counts are zero and scores are those of the smoothing alone.
"""

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuelspark.llm.rows import quoted, slices
from fuelspark.operators.scale import materialize, scratch_path

CHUNK_BYTES = 16_000_000
RANGE_TOKENS = 2_000_000
ALPHA = 0.1
LAMBDA = 0.5
MIN_COUNT = 1  # counts from here on have a level: all
ORDER = 2
LEVEL_BASE = 1.5
PROBES = 6
BITS_PER_ENTRY = 9
# Tokens whose probabilities are computed together within a task.
PART_TOKENS = 300_000
# Filter parts sent to the workers at once.
BLOCK_BYTES = 64_000_000
SPARE_BITS = 12
# Packed keys that are probed together within a task.
PROBE_BYTES = 1_000_000
END_KEY = np.uint64(xxhash.xxh3_64_intdigest(b"\x00end\x00"))
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

CHUNK_SCHEMA = "chunk bigint, doc_ids array<bigint>, training array<boolean>, ends array<bigint>, n_words bigint, n_train bigint, ids binary, keys binary, train_counts binary"


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    values = np.ascontiguousarray(values, "<u8")
    planes = values.view(np.uint8).reshape(len(values), 8).T
    used = next((k for k in range(8, 1, -1) if planes[k - 1].any()), 1)
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:used]).tobytes())


def unpack(data: bytes) -> np.ndarray:
    used = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(used, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :used] = planes.T
    return out.view("<u8").ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(before * np.uint64(3) + _mix(word))


def _level_hashes(keys: np.ndarray, level: int) -> np.ndarray:
    return _mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def _probe_places(hashes: np.ndarray, k: int, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Place of the probe number k: hashes of a level go on in steps of their own."""
    h = hashes + np.uint64(k) * (hashes << np.uint64(29) | np.uint64(1 << 28))
    return first + ((h >> np.uint64(32)) * size >> np.uint64(32))


def levels_of(counts: np.ndarray) -> np.ndarray:
    """Level of each count of at least MIN_COUNT."""
    return 1 + np.floor(np.log(counts / MIN_COUNT) / math.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def build_part(keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """Filter of one range: bits and bytes."""
    levels = levels_of(counts)
    size = int(max(64, levels.sum() * BITS_PER_ENTRY + 63 >> 6 << 6))
    bits = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        hashes = _level_hashes(keys[levels >= level], level)
        for k in range(PROBES):
            bits[_probe_places(hashes, k, np.uint64(0), np.uint64(size))] = True
    return size, np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """Parts of consecutive key ranges in one array of bits."""

    def __init__(self, shift: int, ranges: list[int], sizes: list[int], parts: list[bytes], top_level: int, own: set[int]):
        self.shift, self.top, self.data = shift, top_level, np.frombuffer(b"".join(parts), np.uint8)
        n = (1 << (64 - shift)) if shift < 64 else 1
        self.first, self.size = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.size[ranges] = sizes
        self.first[ranges] = np.cumsum([0, *sizes[:-1]]) if sizes else []
        self.mine = np.zeros(n, bool)  # ranges that the filter answers for
        self.mine[list(own)] = True

    def range_of(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(len(keys), np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each key of the ranges at hand, 0 if the filter doesn't hold it."""
        out = np.zeros(len(keys), np.int64)
        where = self.range_of(keys)
        alive = np.flatnonzero(self.mine[where] & (self.size[where] > 0))
        first, size = self.first[where[alive]], self.size[where[alive]]
        for level in range(1, self.top + 1):
            hashes = _level_hashes(keys[alive], level)
            for k in range(PROBES):
                at = _probe_places(hashes, k, first, size)
                hit = self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
                alive, hashes, first, size = alive[hit], hashes[hit], first[hit], size[hit]
            out[alive] = level
            if not len(alive):
                break
        return out


class Numbering(dict):
    """Gives each new word the next number."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def tokenise(docs: DataFrame, is_training: Column, id_col: str, text_col: str) -> DataFrame:
    """Chunks: word numbers of whole texts, the most frequent words first, 0 the end token."""
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in slices(batch, 2, CHUNK_BYTES):
                numbers = Numbering({b"": 0})  # no word is empty
                find, parts = numbers.__getitem__, []
                for text in piece.column(2).to_pylist():
                    words = text.translate(_LOWER).split() if text else []
                    words.append(b"")
                    parts.append(np.fromiter(map(find, words), np.int64, len(words)))
                ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
                training = piece.column(1).to_numpy(zero_copy_only=False).astype(bool)
                in_training = np.repeat(training, np.diff(ends, prepend=0))
                n = len(numbers)
                total = np.bincount(ids, minlength=n)
                order = np.argsort(-total[1:], kind="stable") + 1
                rank = np.zeros(n, np.int64)
                rank[order] = np.arange(1, n)
                keys = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, n)
                keys[0] = END_KEY
                order = np.append(0, order)
                train_counts = np.bincount(ids[in_training], minlength=n)[order]
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.array([piece.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([training.tolist()]), pa.array([ends], pa.list_(pa.int64())),
                    pa.array([len(ids)]), pa.array([int(in_training.sum())]), pa.array([pack(rank[ids])]), pa.array([keys[order].astype("<u8").tobytes()]), pa.array([pack(train_counts)]),
                ], names=["chunk", "doc_ids", "training", "ends", "n_words", "n_train", "ids", "keys", "train_counts"])
                number += 1

    return docs.select(
        F.col(quoted(id_col)).cast("bigint").alias("_id"), F.coalesce(is_training, F.lit(False)).alias("_training"), F.col(quoted(text_col)).cast("binary").alias("_text")
    ).mapInArrow(run, CHUNK_SCHEMA)


def _pieces(keys: np.ndarray, values: np.ndarray, shift: int):
    """(range, keys, values) of sorted keys."""
    where = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.diff(where)) + 1
    for s, e in zip(np.append(0, cuts), np.append(cuts, len(keys)), strict=True):
        if e > s:
            yield int(where[s]), keys[s:e], values[s:e]


def _deltas(keys: np.ndarray, drop: int = 0) -> bytes:
    """Ascending keys, whose last ``drop`` bits are zero."""
    return pack(np.diff(keys >> np.uint64(drop), prepend=np.uint64(0)))


def _from_deltas(data: bytes, drop: int = 0) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64) << np.uint64(drop)


def gram_keys(ids: np.ndarray, keys: np.ndarray, ends: np.ndarray, n: int, drop: int) -> np.ndarray:
    """Key of the n-gram that ends in each token; those of order 3 at the begin of a text are never asked for."""
    before = np.append(0, ids[:-1])
    grams = pair_keys(keys[before], keys[ids])
    if n == 3:
        first = np.append(0, before[:-1])
        first[np.append(0, ends[:-1])] = 0
        grams = pair_keys(pair_keys(keys[first], keys[before]), keys[ids])
    return grams >> np.uint64(drop) << np.uint64(drop)


def word_counts(chunks: DataFrame, shift: int) -> DataFrame:
    """Per chunk and key range: training counts of the chunk's words in key order; ``words``: distinct ones of the range."""
    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = np.frombuffer(row["keys"], "<u8"), unpack(row["train_counts"])
                order = np.argsort(keys)
                out = [(row["chunk"], r, _deltas(k), pack(v)) for r, k, v in _pieces(keys[order], counts[order], shift)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "range", "keys", "counts"])

    def add(table: pa.Table) -> pa.Table:
        parts = [np.cumsum(unpack(x), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        keys, counts = np.concatenate(parts), np.concatenate([unpack(x) for x in table.column("counts").to_pylist()])
        distinct, where = np.unique(keys, return_inverse=True)
        total = np.zeros(len(distinct), np.uint64)
        np.add.at(total, where, counts)
        ends = np.cumsum([len(p) for p in parts])
        made = [pack(x) for x in np.split(total[where], ends[:-1])]
        known = int((total > 0).sum())
        return pa.table({"chunk": table.column("chunk"), "range": table.column("range"), "counts": pa.array(made, pa.binary()), "words": pa.array([known] + [0] * (len(made) - 1), pa.int64())})

    sent = chunks.select("chunk", "keys", "train_counts").mapInArrow(send, "chunk bigint, range int, keys binary, counts binary")
    return sent.groupBy("range").applyInArrow(add, "chunk bigint, range int, counts binary, words bigint")


def gram_filter(chunks: DataFrame, order: int, shift: int, drop: int, slab_bits: int) -> DataFrame:
    """Per range of keys its filter part with count statistics (``chunk`` null), and the chunks' pieces: their distinct
    n-grams of the range in key order, held-out ones included."""
    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, keys, ends = unpack(row["ids"]).astype(np.int64), np.frombuffer(row["keys"], "<u8"), np.array(row["ends"])
                in_training = np.repeat(np.array(row["training"], np.uint64), np.diff(ends, prepend=0))
                for n in range(2, order + 1):
                    grams = gram_keys(ids, keys, ends, n, drop)
                    grams |= in_training  # in the last bit, which every key leaves free
                    grams.sort()
                    trained = grams & np.uint64(1)
                    grams ^= trained
                    cuts = np.flatnonzero(np.diff(grams, prepend=~grams[:1]))
                    grams, counts = grams[cuts], np.add.reduceat(trained, cuts)
                    out = [(row["chunk"], n, r, _deltas(k, drop), pack(v)) for r, k, v in _pieces(grams, counts, shift)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "n", "range", "keys", "counts"])

    def build(table: pa.Table) -> pa.Table:
        keys = np.concatenate([_from_deltas(x, drop) for x in table.column("keys").to_pylist()])
        counts = np.concatenate([unpack(x) for x in table.column("counts").to_pylist()])
        keys, counts = keys[counts > 0], counts[counts > 0]
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        cuts = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[cuts], np.add.reduceat(counts, cuts).astype(np.int64) if len(cuts) else np.zeros(0, np.int64)
        size, bits = build_part(keys, counts) if len(keys) else (0, b"")
        levels = levels_of(counts) if len(counts) else np.zeros(0, np.int64)
        at = table.column("range")[0].as_py()
        pieces = {"chunk": table.column("chunk").to_pylist(), "n": table.column("n").to_pylist(), "keys": table.column("keys").to_pylist()}
        rows = table.num_rows
        return pa.table({
            "slab": pa.array([at >> slab_bits] * (rows + 1), pa.int32()), "range": pa.array([at] * (rows + 1), pa.int32()), "chunk": pa.array([None, *pieces["chunk"]], pa.int64()),
            "n": pa.array([None, *pieces["n"]], pa.int32()), "keys": pa.array([bits, *pieces["keys"]], pa.binary()), "size": pa.array([size] + [None] * rows, pa.int64()),
            "level_n": pa.array([np.bincount(levels).tolist()] + [None] * rows, pa.list_(pa.int64())),
            "level_sum": pa.array([np.bincount(levels, counts).astype(np.int64).tolist()] + [None] * rows, pa.list_(pa.int64()))})

    sent = chunks.select("chunk", "ids", "keys", "training", "ends").mapInArrow(send, "chunk bigint, n int, range int, keys binary, counts binary")
    schema = "slab int, range int, chunk bigint, n int, keys binary, size bigint, level_n array<bigint>, level_sum array<bigint>"
    return sent.groupBy("range").applyInArrow(build, schema)


def probed_levels(pieces: DataFrame, shared, drop: int) -> DataFrame:
    """Levels of the n-grams of each piece, in key order, by the broadcast filter of their slab."""
    def probe(batches):
        for batch in batches:
            for piece in slices(batch, 3, PROBE_BYTES):
                keys = [_from_deltas(x, drop) for x in piece.column(3).to_pylist()]
                levels = shared.value.levels(np.concatenate(keys)).astype(np.uint64)
                made = [pack(x) for x in np.split(levels, np.cumsum([len(k) for k in keys])[:-1])]
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], pa.array(made, pa.binary())], names=["chunk", "n", "range", "counts"])

    return pieces.select("chunk", "n", "range", "keys").mapInArrow(probe, "chunk bigint, n int, range int, counts binary")


def scores(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; ``order``: 2 or 3."""
    spark = docs.sparkSession
    chunks = materialize(tokenise(docs, is_training, id_col, text_col), "chunks")
    tokens, train = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    bits_for = lambda n: max(0, math.ceil(math.log2(max(1, n))))
    counts = materialize(word_counts(chunks, 64 - bits_for(tokens / RANGE_TOKENS)), "counts")
    distinct = counts.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]

    grams = tokens * (order - 1)
    range_bits = bits_for(grams / RANGE_TOKENS)
    shift, drop = 64 - range_bits, max(1, 64 - bits_for(grams) - SPARE_BITS)
    # a range has no more levels than n-gram tokens, so this bounds the filter of a slab
    slab_bits = min(range_bits, bits_for(BLOCK_BYTES * 8 / BITS_PER_ENTRY / max(1, grams >> range_bits) / 2))
    folder = scratch_path(spark, "filter")
    gram_filter(chunks, order, shift, drop, slab_bits).write.partitionBy("slab").parquet(folder)
    laid = spark.read.schema("range int, chunk bigint, n int, keys binary, size bigint, level_n array<bigint>, level_sum array<bigint>, slab int").parquet(folder)
    parts, pieces = laid.filter("chunk IS NULL"), laid.filter("chunk IS NOT NULL")
    stats = parts.select(F.posexplode(F.arrays_zip("level_n", "level_sum"))).groupBy("pos").agg(F.sum("col.level_n").alias("n"), F.sum("col.level_sum").alias("s")).collect()
    mean = {r["pos"]: r["s"] / r["n"] for r in stats if r["n"]}
    top = max(mean, default=0)
    value = np.array([0.0] + [mean.get(j, 0.0) for j in range(1, top + 1)])

    found = scratch_path(spark, "levels")
    for slab in range(1 << (range_bits - slab_bits)):
        held = sorted((r["range"], r["size"], bytes(r["keys"])) for r in parts.filter(F.col("slab") == slab).select("range", "size", "keys").collect())
        ranges = [r for r, _, _ in held]
        shared = spark.sparkContext.broadcast(Filter(shift, ranges, [n for _, n, _ in held], [b for _, _, b in held], top, set(ranges)))
        probed_levels(pieces.filter(F.col("slab") == slab), shared, drop).write.mode("append").parquet(found)
        shared.destroy()
    levels = spark.read.schema("chunk bigint, n int, range int, counts binary").parquet(found)
    back = counts.select("chunk", F.lit(1).alias("n"), "range", "counts").unionByName(levels)
    scored = _score(chunks, back, order, drop, value, train, distinct)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("bigint").alias("train_tokens"), "base_score", "score")


def _score(chunks: DataFrame, back: DataFrame, order: int, drop: int, value: np.ndarray, train: int, distinct: int) -> DataFrame:
    """Scores of the texts of each chunk by the counts of its words and the levels of its n-grams."""
    def token_levels(ids, keys, ends, n, pieces):
        grams = gram_keys(ids, keys, ends, n, drop)
        by_key = np.argsort(grams)
        number = np.cumsum(np.diff(grams[by_key], prepend=grams[by_key[:1]]) != 0)
        out = np.empty(len(ids), np.uint8)
        out[by_key] = np.concatenate([unpack(x).astype(np.uint8) for x in pieces])[number]
        return out

    def score(own: pa.Table, returned: pa.Table) -> pa.Table:
        out = []
        returned = returned.sort_by([("n", "ascending"), ("range", "ascending")])
        of = np.array(returned.column("n").to_pylist())
        returned = returned.column("counts").to_pylist()
        pieces = {n: [returned[i] for i in np.flatnonzero(of == n)] for n in range(1, order + 1)}
        for row in own.to_pylist():
            ids, keys, ends = unpack(row["ids"]).view(np.int64), np.frombuffer(row["keys"], "<u8"), np.array(row["ends"])
            c = np.empty(len(keys))
            c[np.argsort(keys)] = np.concatenate([unpack(x) for x in pieces[1]])
            level = {n: token_levels(ids, keys, ends, n, pieces[n]) for n in range(2, order + 1)}
            base = (c + ALPHA) / (train + ALPHA * (distinct + 1))
            log_base, known = np.log10(base), (c > 0).astype(np.int64)
            at = 0
            while at < len(ends):  # whole documents of about PART_TOKENS at a time
                begin = int(ends[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, begin + PART_TOKENS, "right")))
                part, cuts = slice(begin, int(ends[stop - 1])), np.append(begin, ends[at : stop - 1]) - begin
                own_ids = ids[part]
                seen = c[np.append(0, own_ids[:-1])]
                p = base[own_ids]
                weight = np.where(seen > 0, LAMBDA, 0.0)
                p = (1 - weight) * p + weight * np.minimum(value[level[2][part]] / np.maximum(seen, 1), 1.0)
                if order == 3:
                    seen = np.append(0.0, value[level[2][part]][:-1])
                    seen[cuts] = 0.0
                    weight = np.where(seen > 0, LAMBDA, 0.0)
                    p = (1 - weight) * p + weight * np.minimum(value[level[3][part]] / np.maximum(seen, 1), 1.0)
                out.append(pa.table({
                    "doc_id": pa.array(row["doc_ids"][at:stop], pa.int64()), "held_out": pa.array([not t for t in row["training"][at:stop]]),
                    "n_tokens": pa.array(np.diff(np.append(cuts, len(own_ids)))), "n_known": pa.array(np.add.reduceat(known[own_ids], cuts)),
                    "base_score": pa.array(np.add.reduceat(log_base[own_ids], cuts)), "score": pa.array(np.add.reduceat(np.log10(p), cuts))}))
                at = stop
        return pa.concat_tables(out)

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    payload = chunks.select("chunk", "doc_ids", "training", "ends", "ids", "keys")
    return payload.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(score, schema)
