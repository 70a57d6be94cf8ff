"""Benchmark decontamination by a distributed positional inverted index (operator 4).

Index: the documents are dealt into segments, and a segment is one row with the sorted positions of every test term in
it (terms that no test item uses can't be part of a match and aren't stored). Segments are written to the shared
folder, and term counts are summed over all of them. Matching: each window of test words starts from the positions of
its rarest term over all documents, shifts them by the term's place in the window, and intersects with the
shifted positions of its other terms, rarest first; most windows are empty after one or two lists. ``slack`` 0 gives
exact phrases; above it, proximity matches, in which each term may lie that many places off.

The terms go to the workers in blocks of test items of bounded size, so the test set may grow as well. No term's
list meets in one task: a term that stands in every document has a part of its list in every segment.

Defined results: null texts have no words; items without words or id take no part; rows of the same id are separate
results; items with the same id count once; an item of fewer than ``window`` words is one window.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuelspark.llm.rows import quoted, slices
from fuelspark.operators.scale import materialize

WINDOW = 10
# Bytes of test texts whose terms are with the workers at once.
BLOCK_BYTES = 8_000_000
SEGMENT_BYTES = 4_000_000
# Bytes of words stay, capitals become small, the rest separates.
_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))

SEGMENT_SCHEMA = "doc_ids array<bigint>, keys array<bigint>, bases array<int>, n_words array<int>, terms array<int>, ends array<int>, positions array<int>"


def words(text: str | None) -> list[bytes]:
    """Lower-cased words: digits, letters a to z and anything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def item_windows(item_words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not item_words:
        return []
    return [tuple(item_words[i : i + window]) for i in range(max(1, len(item_words) - window + 1))]


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], gap: int, id_col: str, text_col: str) -> DataFrame:
    """Segments with the positions of the terms of ``vocabulary``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        find = shared.value.get
        for batch in batches:
            for piece in slices(batch, 1, SEGMENT_BYTES):
                term_parts, counts = [], []
                for text in piece.column(1).to_pylist():
                    found = words(text)
                    counts.append(len(found))
                    term_parts.append(np.fromiter((find(w, -1) for w in found), np.int32, len(found)))
                n_words = np.array(counts, np.int32)
                bases = (np.cumsum(n_words + gap) - n_words - gap).astype(np.int32)
                places = np.concatenate([np.arange(n, dtype=np.int32) + b for n, b in zip(n_words, bases, strict=True)])
                terms = np.concatenate(term_parts)
                held = terms >= 0
                terms, places = terms[held], places[held]
                order = np.argsort(terms, kind="stable")
                terms, places = terms[order], places[order]
                distinct, first = np.unique(terms, return_index=True)
                ends = np.append(first[1:], len(terms)).astype(np.int32) if len(distinct) else first.astype(np.int32)
                flat = [piece.column(0), piece.column(2), *[pa.array(x, pa.int32()) for x in (bases, n_words, distinct, ends, places)]]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in flat],
                    names=["doc_ids", "keys", "bases", "n_words", "terms", "ends", "positions"])

    text = F.col(quoted(text_col))
    rows = docs.select(F.col(quoted(id_col)).cast("bigint").alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_key"))
    return rows.mapInArrow(run, SEGMENT_SCHEMA)


def term_counts(index: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each term over all documents; the result has a number per test term of the block."""
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for terms, ends in zip(batch.column(0), batch.column(1), strict=True):
                if terms.values is not None and len(terms.values):
                    total[terms.values.to_numpy()] += np.diff(ends.values.to_numpy(), prepend=0)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "n"])

    out = np.zeros(size, np.int64)
    for row in index.select("terms", "ends").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row["term"]] = row["n"]
    return out


class Plan:
    """Distinct windows that can occur at all, by their rarest term, each with its other terms in order of rarity."""

    def __init__(self, items: list[tuple[int, list[bytes]]], vocabulary: dict[bytes, int], counts: np.ndarray, window: int):
        self.by_anchor: dict[int, list[tuple[int, list[tuple[int, int]], int, list[int]]]] = {}
        known: dict[tuple[bytes, ...], set[int]] = {}
        for item_id, found in items:
            for w in item_windows(found, window):
                known.setdefault(w, set()).add(item_id)
        for w, owners in known.items():
            terms = sorted(((vocabulary[t], k) for k, t in enumerate(w)), key=lambda x: (counts[x[0]], x))
            if counts[terms[0][0]]:
                (anchor, offset), *rest = terms
                self.by_anchor.setdefault(anchor, []).append((offset, rest, len(w), sorted(owners)))
        self.anchors = np.array(sorted(self.by_anchor), np.int64)


def _matches(plan: Plan, terms: np.ndarray, ends: np.ndarray, positions: np.ndarray, slack: int):
    """(starts, length, items) of the windows found in a segment."""
    begins = np.append(0, ends)[: len(ends)]
    at = {int(t): (b, e) for t, b, e in zip(terms, begins, ends, strict=True)}
    for anchor in np.intersect1d(plan.anchors, terms):
        b, e = at[int(anchor)]
        for offset, rest, length, owners in plan.by_anchor[int(anchor)]:
            starts = positions[b:e] - offset
            for term, k in rest:
                if term not in at:
                    starts = starts[:0]
                    break
                listed = positions[at[term][0] : at[term][1]]
                i = np.searchsorted(listed, starts + (k - slack))
                inside = i < len(listed)
                starts, i = starts[inside], i[inside]
                starts = starts[listed[i] <= starts + (k + slack)]
                if not len(starts):
                    break
            if len(starts):
                yield starts, length, owners


def _search(index: DataFrame, plan: Plan, slack: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(plan)

    def run(batches):
        plan = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, keys, bases, n_words, terms, ends, positions = (batch.column(c)[row].values for c in range(7))
                bases, n_words = bases.to_numpy(), n_words.to_numpy()
                n = len(bases)
                size = int(bases[-1] + n_words[-1]) + 1 if n else 1
                change = np.zeros(size + 1, np.int32)
                owner_docs, owner_items = [], []
                for starts, length, owners in _matches(plan, terms.to_numpy(), ends.to_numpy(), positions.to_numpy(), slack):
                    doc = np.searchsorted(bases, starts, "right") - 1
                    inside = (doc >= 0) & (starts + length <= bases[doc] + n_words[doc])
                    starts, doc = starts[inside], doc[inside]
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + length, -1)
                    doc = np.unique(doc)
                    for owner in owners:
                        owner_docs.append(doc)
                        owner_items.append(np.full(len(doc), owner, np.int64))
                hit = np.flatnonzero(np.cumsum(change) > 0).astype(np.int32)
                where = np.searchsorted(hit, np.append(bases, size))
                hit -= np.repeat(bases, np.diff(where))
                items: list[list[int]] = [[] for _ in range(n)]
                if owner_docs:
                    pairs = np.unique(np.stack([np.concatenate(owner_docs), np.concatenate(owner_items)]), axis=1)
                    for d, i in pairs.T.tolist():
                        items[d].append(i)
                yield pa.RecordBatch.from_arrays([
                    doc_ids, keys, pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(hit)), pa.array(items, pa.list_(pa.int64())),
                ], names=["doc_id", "_key", "n_words", "hits", "items"])

    return index.mapInArrow(run, "doc_id bigint, _key bigint, n_words bigint, hits array<int>, items array<bigint>")


def matches(docs: DataFrame, items: DataFrame, slack: int = 0, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, ``_key`` (hash of its text), n_words, hits (places of the words inside matched windows) and
    the matched items."""
    spark = docs.sparkSession
    listed = items.select(F.col(quoted(item_col)).cast("bigint").alias("i"), F.col(quoted(item_text_col)).alias("t")).filter("i is not null and t is not null")
    total = listed.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    found = []
    for block in range(blocks):
        part = listed.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block) if blocks > 1 else listed
        own = [(r["i"], words(r["t"])) for r in part.collect()]
        vocabulary = {t: k for k, t in enumerate(sorted({t for _, w in own for t in w}))}
        index = materialize(build_index(docs, vocabulary, window + 2 * slack + 1, id_col, text_col), "postings")
        found.append(_search(index, Plan(own, vocabulary, term_counts(index, len(vocabulary)), window), slack))
    if blocks == 1:
        return found[0]
    # a row's results over all blocks: rows of the same id and text have the same ones
    merged = None
    for f in found:
        one = f.dropDuplicates(["doc_id", "_key"])
        merged = one if merged is None else merged.unionByName(one)
    merged = merged.groupBy("doc_id", "_key").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    base = docs.select(F.col(quoted(id_col)).cast("bigint").alias("_d"), F.xxhash64(F.col(quoted(text_col))).alias("_k"))
    return base.join(merged, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_k") == F.col("_key"))).drop("_d", "_k")


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document row."""
    found = matches(docs, items, **options)
    listed = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def uncontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows, all columns, whose texts match no item."""
    found = matches(docs, items, id_col=id_col, text_col=text_col, **options).filter("size(hits) > 0").select(F.col("doc_id").alias("_hit_id"), F.col("_key").alias("_hit_key"))
    keyed = docs.withColumn("_text_key", F.xxhash64(F.col(quoted(text_col))))
    same = F.col(quoted(id_col)).cast("bigint").eqNullSafe(F.col("_hit_id")) & (F.col("_text_key") == F.col("_hit_key"))
    return keyed.join(found, same, "left_anti").select(*[quoted(c) for c in docs.columns])
