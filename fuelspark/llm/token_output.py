"""Token-ID output in Simple-8b (operator 9).

Simple-8b: a 64-bit word holds a selector in its upper four bits and as many ids as fit in the other 60. An id of
over 60 bits is an escape: selector 15, the payload is its place in the block's list of escaped ids. Every
``SUB_WORDS`` words a block notes how many ids stand before, so that any part of it decodes on its own. All coding and
decoding is array work over a whole block.

File format: Parquet rows, one per block: ``part`` and ``block`` order the blocks, ``before`` counts the ids of the same
part before the block, ``doc_ids`` and ``counts`` list its documents, ``words`` is the payload (little-endian), ``offsets``
the notes, ``escapes`` the escaped ids. A document lies in one block. Rows go through Spark's commit protocol, so that
a retried task leaves no second copy.
"""

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fuelspark.llm.rows import quoted, slices

# (ids in a word, bits of each): fixed by the 60 bits of payload.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
SUB_WORDS = 1024
BLOCK_IDS = 65_536
# Cached encodings of white-space separated pieces of text in a worker; the cache starts anew when full.
CACHE_PIECES = 600_000
# ASCII marks that may stand behind a word without touching it; an apostrophe may start a word of its own.
TRAILING = ".,;:!?%&*#$|()[]{}/\\\"@_-+"
BLOCK_SCHEMA = (
    "part int, block int, before bigint, n_ids bigint, doc_ids array<bigint>, counts array<bigint>, words binary, "
    "offsets array<bigint>, escapes binary"
)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, notes and escapes of unsigned ids."""
    ids = np.asarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    escaped = ids >= np.uint64(1 << 60)
    best, chosen = np.ones(n, np.uint8), np.full(n, len(SELECTORS) - 1, np.uint8)
    compared = ids.astype(np.uint32) if ids.max() < 1 << 32 else ids
    for s in range(len(SELECTORS) - 2, -1, -1):
        count, bits = SELECTORS[s]
        fits = np.ones(n + count, bool)  # the last word may have room for more ids than are left
        np.less(compared, 1 << min(bits, 8 * compared.itemsize - 1), out=fits[:n])
        width = 1
        while width < count and fits[:n].any():  # fits[i]: the next `width` ids fit
            step = min(width, count - width)
            fits[: n + count - step] &= fits[step:]
            width += step
        best[fits[:n]], chosen[fits[:n]] = count, s
    chosen[escaped] = ESCAPE
    steps, starts, i = best.tolist(), [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    starts = np.array(starts)
    kind = chosen[starts]
    words = kind.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for s in np.unique(kind):
        mine = np.flatnonzero(kind == s)
        if s == ESCAPE:
            words[mine] |= np.arange(len(mine), dtype=np.uint64)
            continue
        count, bits = SELECTORS[s]
        first = starts[mine]
        for k in range(count):
            words[mine] |= padded[first + k] << np.uint64(k * bits)
    return words, starts[::SUB_WORDS].astype(np.int64), ids[escaped]


def unpack(words: np.ndarray, n: int, escapes: np.ndarray) -> np.ndarray:
    """All ids of a block."""
    kind = (words >> np.uint64(60)).astype(np.int64)
    sizes = np.array([c for c, _ in SELECTORS] + [0] * (ESCAPE - len(SELECTORS)) + [1])
    first = np.cumsum(sizes[kind]) - sizes[kind]
    out = np.zeros(n + 60, np.uint64)
    for s in np.unique(kind):
        mine = np.flatnonzero(kind == s)
        if s == ESCAPE:
            out[first[mine]] = escapes
            continue
        count, bits = SELECTORS[s]
        mask = np.uint64((1 << bits) - 1)
        for k in range(count):
            out[np.minimum(first[mine] + k, n)] = (words[mine] >> np.uint64(k * bits)) & mask
    return out[:n]


def unpack_range(words: np.ndarray, offsets: np.ndarray, n: int, escapes: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block: only the sub-blocks that hold them are decoded."""
    start, stop = max(0, start), min(n, stop)
    if start >= stop:
        return np.zeros(0, np.uint64)
    lo = int(np.searchsorted(offsets, start, "right")) - 1
    hi = int(np.searchsorted(offsets, stop, "left"))
    base, end = int(offsets[lo]), int(offsets[hi]) if hi < len(offsets) else n
    gone = int((words[: lo * SUB_WORDS] >> np.uint64(60) == ESCAPE).sum())
    part = words[lo * SUB_WORDS : hi * SUB_WORDS]
    held = int((part >> np.uint64(60) == ESCAPE).sum())
    return unpack(part, end - base, escapes[gone : gone + held])[start - base : stop - base]


def byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest,
    in order, from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


def _word_encoder(path: str):
    """Encodes many lower-case words of letters at once: a function from words to the little-endian ids of each.

    The merges of the file are applied to bytes, with an end mark behind every word; the merge of a last byte with the mark
    goes first, as the last character of a word has its own token from the start. Merging any pair that spells a token
    is the file's own rule as long as every token of the file encodes to itself, which tests check.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    suffix, vocabulary = model["end_of_word_suffix"], model["vocab"]
    alphabet = byte_alphabet()
    byte_of = {c: b for b, c in alphabet.items()}
    spell = lambda t: bytes(byte_of[c] for c in t.removesuffix(suffix)) + (b"\x01" if t.endswith(suffix) else b"")
    order = [alphabet[b] + suffix for b in range(256)] + [alphabet[b] for b in range(256)]
    order += ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = np.array([vocabulary[t] for t in order], "<u4")
    last = np.array([t.endswith(suffix) for t in order])
    coder = tiktoken.Encoding("words", pat_str="[^\x01]+\x01", mergeable_ranks={spell(t): k for k, t in enumerate(order)}, special_tokens={})

    def encode(words: list[str]) -> list[bytes]:
        ranks = np.array(coder.encode_ordinary("\x01".join(words) + "\x01"))
        data = ids[ranks].tobytes()
        ends = (np.flatnonzero(last[ranks]) * 4 + 4).tolist()
        return [data[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    return encode


@lru_cache(maxsize=1)
def _piece_encoder(path: str):
    """Encodes texts piece by piece: white space is dropped by this kind of tokenizer and no rule looks across it.

    A piece of Latin-1 letters, with or without ASCII marks behind, needs no rules: it is one word of the model in lower
    case (and one word of marks). Any other piece goes through the whole tokenizer.
    """
    import gc
    import os
    from array import array

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    encode_words = _word_encoder(path)
    marks: dict[str, bytes] = {"": b""}
    known: dict[str, bytes] = {"": b""}
    stems: dict[str, bytes] = {}

    def learn(pieces: set[str]) -> None:
        rest, taken, new = [], [], set()
        for piece in pieces:
            stem = piece.rstrip(TRAILING)
            if not stem.isalpha() or not stem.isascii() and max(stem) > "\xff":
                rest.append(piece)
                continue
            mark, stem = piece[len(stem) :], stem.lower()
            if mark not in marks:
                marks[mark] = array("I", tokenizer.encode(mark, add_special_tokens=False).ids).tobytes()
            taken.append((piece, stem, mark))
            if stem not in stems:
                new.add(stem)
        if new:
            listed = list(new)
            stems.update(zip(listed, encode_words(listed), strict=True))
        for piece, stem, mark in taken:
            known[piece] = stems[stem] + marks[mark]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for piece, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[piece] = array("I", e.ids).tobytes()

    def encode(texts: list[str], end_id: int) -> list[bytes]:
        end = array("I", [end_id]).tobytes()
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(known) > CACHE_PIECES:
            known.clear()
            stems.clear()
            marks.clear()
            known[""] = marks[""] = b""
        gc.disable()  # millions of new objects without any cycle: nothing to search for
        try:
            learn(set().union(*split).difference(known))
        finally:
            gc.enable()
        get = known.__getitem__
        return [b"".join(map(get, pieces)) + end for pieces in split]

    return encode


def splits_at_spaces(path: str) -> bool:
    """Whether the tokenizer drops white space before it looks at words, with a byte-level model of whole words, and none of its own tokens holds any."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    apart = tokenizer.encode("ab\n cd  e", add_special_tokens=False).ids
    joined = [i for w in ("ab", "cd", "e") for i in tokenizer.encode(w, add_special_tokens=False).ids]
    return apart == joined and not any(" " in t.content or "\n" in t.content for t in tokenizer.get_added_tokens_decoder().values())


def encode_blocks(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of all documents in ascending id order, each followed by ``end_id``.

    Null texts are empty (the end id alone); rows with the same id are ordered by their text; null ids come first.
    """
    if not splits_at_spaces(tokenizer_path):
        raise ValueError("the piecewise encoder needs a tokenizer that drops white space")

    def run(batches):
        encode, part = _piece_encoder(tokenizer_path), TaskContext.get().partitionId()
        number, before = 0, 0
        ids, held, size = [], [], 0

        def block():
            data = np.frombuffer(b"".join(held), "<u4")
            words, offsets, escapes = pack(data)
            counts = [len(x) // 4 for x in held]
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([len(data)], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([words.astype("<u8").tobytes()], pa.binary()),
                pa.array([offsets], pa.list_(pa.int64())), pa.array([escapes.astype("<u8").tobytes()], pa.binary()),
            ], names=["part", "block", "before", "n_ids", "doc_ids", "counts", "words", "offsets", "escapes"])

        for batch in batches:
            for piece in slices(batch, 1):
                texts = [t or "" for t in piece.column(1).to_pylist()]
                for doc_id, data in zip(piece.column(0).to_pylist(), encode(texts, end_id), strict=True):
                    ids.append(doc_id)
                    held.append(data)
                    size += len(data) // 4
                    if size >= block_ids:
                        yield block()
                        number, before = number + 1, before + size
                        ids, held, size = [], [], 0
        if held:
            yield block()

    ordered = docs.select(F.col(quoted(id_col)).cast("bigint").alias("_id"), F.col(quoted(text_col)).alias("_text"))
    return ordered.repartitionByRange("_id").sortWithinPartitions("_id", "_text").mapInArrow(run, BLOCK_SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, **options) -> None:
    encode_blocks(docs, tokenizer_path, **options).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of written files: doc_id, start (ids of all documents before it), n_tokens and the ids' crc32."""
    blocks = spark.read.parquet(path)
    # One row per written part, as many as the write had tasks: bounded, so it may sit in one task and be broadcast.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = parts.select("part", (F.sum("_n").over(w) - F.col("_n")).alias("_base"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(np.frombuffer(row["words"], "<u8"), row["n_ids"], np.frombuffer(row["escapes"], "<u8")).astype("<u4")
                counts = np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                crcs = [zlib.crc32(ids[e - c : e].tobytes()) for e, c in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["_base"] + row["before"] + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return (
        blocks.join(F.broadcast(parts), "part").select("_base", "before", "n_ids", "doc_ids", "counts", "words", "escapes")
        .mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    )
