"""BPE encoding and decoding by tree concatenation (operator 7).

A text is cut into leaves of equal length wherever the cut falls, the leaves are encoded on their own, and neighbours are
joined pairwise up a tree. A cut can spoil the tokens around it, so each join encodes a window over the cut anew and
keeps both sides outside it:

- Where a character that is no white space meets white space, the pre-tokenizer splits in any context. The text between
  the last such place before the cut and the first one after it is the window in which the halves can be wrong.
- Words that the pre-tokenizer splits alike on both sides are kept too, which leaves the word over the cut.
- If that word is long unsplit text, its tokens are joined: a window of a few tokens on either side is encoded, and
  grows until its first and last tokens equal those of the two halves. A BPE encoding is right if every adjacent
  pair of its tokens is, and each pair of the joined row then lies in one half or in the window.

Leaves of texts above ``SPREAD_CHARS`` are rows of their own, encoded by different tasks; shorter texts stay in one task.
Literals of special tokens in a text give their ids, as the tokenizers library has it; other texts never meet them.
"""

import hashlib
import json
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuelspark.llm.rows import map_rows, quoted
from fuelspark.llm.token_output import byte_alphabet

# The published pre-tokenizer pattern of byte-level BPE (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF_CHARS = 4096
SPREAD_CHARS = 1 << 18
# Windows up to this length are encoded outright; longer unsplit words are joined by tokens.
WORD_CHARS = 128
WINDOW_TOKENS = 8

_SEAM = regex.compile(r"\S(?=[ \n\t\r])")
_WORDS = regex.compile(PATTERN)


class Coder:
    """Encoder and decoder of one tokenizer file of the byte-level kind."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        in_order = [vocabulary.get(m.replace(" ", "", 1), -1) for m in merges]
        if (model["type"] != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space")
                or in_order != sorted(in_order) or in_order[:1] == [-1]):
            raise ValueError("not a byte-level BPE file with merges in the order of their ids")
        byte_of = {c: b for b, c in byte_alphabet().items()}
        spelled = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items()}
        self.leaf: Callable[[str], list[int]] = tiktoken.Encoding("leaf", pat_str=PATTERN, mergeable_ranks=spelled, special_tokens={}).encode_ordinary
        self.special = special
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        size = max([*spelled.values(), *special.values()]) + 1
        self.bytes = [b""] * size
        for b, i in spelled.items():
            self.bytes[i] = b
        for t, i in special.items():
            self.bytes[i] = t.encode()
        self.decimal = [b"%d," % i for i in range(size)]

    def encode(self, text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
        parts = self.split_special.split(text) if self.split_special and any(t in text for t in self.special) else [text]
        out: list[int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif len(part) <= leaf_chars:
                out += self.leaf(part)
            else:
                leaves = [part[at : at + leaf_chars] for at in range(0, len(part), leaf_chars)]
                out += self.concatenate([(x, self.leaf(x)) for x in leaves])
        return out

    def concatenate(self, level: list[tuple[str, list[int]]]) -> list[int]:
        """Tokens of the joined texts from the tokens of each."""
        while len(level) > 1:
            above = [self._join(*level[i], *level[i + 1]) for i in range(0, len(level) - 1, 2)]
            level = above + level[len(above) * 2 :]
        return level[0][1] if level else []

    def _drop(self, ids: list[int], count: int, last: bool) -> int:
        """How many tokens make up the last or first ``count`` bytes."""
        n = 0
        while count > 0:
            n += 1
            count -= len(self.bytes[ids[-n] if last else ids[n - 1]])
        assert count == 0, "a place where words split holds the boundary of tokens"
        return n

    def _join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> tuple[str, list[int]]:
        text = left + right
        cut = len(left)
        # the nearest places on either side where words split in any context; both ends are such places as well
        start = 0
        for back in (64, 512, cut):
            found = list(_SEAM.finditer(left, max(0, cut - back)))
            if found:
                start = found[-1].end()
                break
        found = _SEAM.search(right)
        stop = cut + (found.end() if found else len(right))
        if stop - start > WORD_CHARS:
            whole = {start, *(start + m.end() for m in _WORDS.finditer(text[start:stop]))}
            before = {start, *(start + m.end() for m in _WORDS.finditer(text[start:cut]))}
            after = {cut, *(cut + m.end() for m in _WORDS.finditer(text[cut:stop]))}
            start, stop = max(x for x in whole & before if x <= cut), min(x for x in whole & after if x >= cut)
            if start == stop == cut:
                return text, left_ids + right_ids
            if stop - start > WORD_CHARS:
                inside = any(start < x < stop for x in whole) or any(start < x < cut for x in before) or any(cut < x < stop for x in after)
                if not inside:
                    a = self._drop(left_ids, len(text[start:cut].encode()), True)
                    b = self._drop(right_ids, len(text[cut:stop].encode()), False)
                    word = self._join_word(left_ids[len(left_ids) - a :], right_ids[:b])
                    return text, left_ids[: len(left_ids) - a] + word + right_ids[b:]
        a = self._drop(left_ids, len(text[start:cut].encode()), True)
        b = self._drop(right_ids, len(text[cut:stop].encode()), False)
        return text, left_ids[: len(left_ids) - a] + self.leaf(text[start:stop]) + right_ids[b:]

    def _join_word(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of one long word from those of its two parts, by windows that grow until both sides agree."""
        reach = WINDOW_TOKENS
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            while a and self.bytes[left[a]][0] & 0xC0 == 0x80:  # a window starts and ends between characters
                a -= 1
            while b < len(right) and self.bytes[right[b]][0] & 0xC0 == 0x80:
                b += 1
            mine, its = left[a:], right[:b]
            window = self.leaf(b"".join(self.bytes[i] for i in mine + its).decode())
            head = a == 0 or window[:2] == mine[:2] and len(mine) > 2
            tail = b == len(right) or window[-2:] == its[-2:] and len(its) > 2
            if head and tail and len(window) >= 4 or a == 0 and b == len(right):
                return left[:a] + window + right[b:]
            reach *= 2

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        """Count, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text."""
        written = b"".join(map(self.decimal.__getitem__, ids))[:-1]
        return len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def _spread(docs: DataFrame, tokenizer_path: str, spread_chars: int, id_col: str, text_col: str) -> DataFrame:
    """Ids of the texts above ``spread_chars``: their leaves are dealt out, then joined by text.

    Literals of special tokens may lie over a cut, so texts that hold any are cut beside them.
    """
    special = sorted(coder(tokenizer_path).special, key=len, reverse=True)
    text = F.col(quoted(text_col))
    long = docs.filter(F.length(text) > spread_chars).select(F.col(quoted(id_col)).alias("_id"), F.md5(text.cast("binary")).alias("_key"), text.alias("_text"))
    parts = F.array("_text")
    if special:
        escaped = "|".join(regex.escape(t) for t in special)
        parts = F.split("_text", f"(?<={escaped})|(?={escaped})")
    parts = long.select("_id", "_key", F.posexplode(parts).alias("_part", "_text"))
    n = F.greatest(F.ceil(F.length("_text") / F.lit(LEAF_CHARS)), F.lit(1)).cast("int")
    leaves = parts.select("_id", "_key", "_part", "_text", F.explode(F.sequence(F.lit(0), n - 1)).alias("_leaf")).select(
        "_id", "_key", "_part", "_leaf", F.substring(F.col("_text"), F.col("_leaf") * LEAF_CHARS + 1, F.lit(LEAF_CHARS)).alias("_text"))

    def start():
        code = coder(tokenizer_path)
        return lambda texts: [[[code.special[t]] if t in code.special else code.leaf(t) for t in texts.to_pylist()]]

    encoded = map_rows(leaves.repartition("_key", "_part", "_leaf"), ["_id", "_key", "_part", "_leaf", "_text"], ["_text"], [("_ids", "array<int>")], start)

    def join(table: pa.Table) -> pa.Table:
        code = coder(tokenizer_path)
        rows = table.sort_by([("_part", "ascending"), ("_leaf", "ascending")]).to_pylist()
        copies = sum(r["_part"] == 0 and r["_leaf"] == 0 for r in rows)  # the same row may stand in the table repeatedly
        by_part: dict[int, dict[int, tuple[str, list[int]]]] = {}
        for r in rows:
            by_part.setdefault(r["_part"], {})[r["_leaf"]] = (r["_text"], r["_ids"])
        ids = [i for part in by_part.values() for i in code.concatenate(list(part.values()))]
        made = [[x] * copies for x in code.digests(ids)]
        return pa.table({"_id": pa.array([rows[0]["_id"]] * copies, table.schema.field("_id").type), "ids": pa.array([ids] * copies, pa.list_(pa.int32())),
                         "n_tokens": made[0], "ids_sha256": made[1], "decoded_sha256": made[2]})

    kind = docs.schema[id_col].dataType.simpleString()
    return encoded.groupBy("_id", "_key").applyInArrow(join, f"_id {kind}, ids array<int>, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """Id column, ids (unless left out), n_tokens, ids_sha256 and decoded_sha256 of every row.

    Null and empty texts have no tokens (digests of nothing); a row that stands in the table twice is returned twice.
    """
    fields = [*([("ids", "array<int>")] if with_ids else []), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]

    def start():
        code = coder(tokenizer_path)

        def work(texts):
            ids, made = [], []
            for text in texts.to_pylist():
                tokens = code.encode(text or "")
                made.append(code.digests(tokens))
                if with_ids:
                    ids.append(tokens)
            return [*([ids] if with_ids else []), *map(list, zip(*made, strict=True))]

        return work

    text = F.col(quoted(text_col))
    short = map_rows(docs.filter(text.isNull() | (F.length(text) <= spread_chars)), [id_col], [text_col], fields, start)
    long = _spread(docs, tokenizer_path, spread_chars, id_col, text_col).withColumnRenamed("_id", id_col)
    return short.unionByName(long.select(*[quoted(c) for c in short.columns]))


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The rows with the text of their ids; null ids give a null text."""
    def start():
        code = coder(tokenizer_path)
        return lambda ids: [[None if x is None else code.decode(x) for x in ids.to_pylist()]]

    return map_rows(encoded, [c for c in encoded.columns if c != ids_col], [ids_col], [(text_col, "string")], start, limit=None)
