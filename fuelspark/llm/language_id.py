"""Language identification of mixed-language text (operator 1).

Every word has a script by the ranges of its letters, and only languages that use the script in the training texts are
its candidates. A word's score for a language is the mean log-likelihood of its character n-grams (with the edges of the
word) under that language. A Viterbi pass over the words of a text, with a penalty for each change of language, labels
spans. A text's prediction is the language with the largest share of the letters, plus what it is worth to open or to close
the text: a text that returns to its language after a long quotation counts as the former. These two
worths are learned on training texts. The score is the predicted language's share of the letters.

The n-gram counts come from at most about ``SAMPLE_DOCS`` training texts, chosen by hash of the id: a documented bound on
what the model is fitted on. Its size depends on the number of languages only.

Defined results: null texts and texts without letters are ``und`` with score 0; words in a script that no training text
uses are open to all languages and favour none; ties go to the language with the higher total score, then the
smaller name; without training rows every text is ``und``.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fuelspark.llm.characters import OTHER, codes, letters, words
from fuelspark.llm.rows import map_rows, quoted, sample_fraction, slices

SAMPLE_DOCS = 20_000
# Texts of these on which the worth of a text's first and last span is learned.
FRAME_DOCS = 5_000
BUCKETS = 1 << 17
ORDERS = (2, 3, 4)
SWITCH_PENALTY = 8.0
SCRIPT_SHARE = 1e-3
# Texts run through the Viterbi pass together.
GROUP_BYTES = 8_000_000
PART_BYTES = 1_000_000


def grams(points: np.ndarray, script: np.ndarray):
    """For each order: places of the n-grams within one word and its edges, and their buckets."""
    inner = script > 0
    value = np.where(inner, points, 32).astype(np.uint32)
    split = np.diff(script, prepend=np.uint8(0)) != 0  # a word starts or ends before this place
    n = len(points)
    for order in ORDERS:
        if n < order:
            continue
        m = n - order + 1
        h = np.zeros(m, np.uint32)
        for k in range(order):
            h = h * np.uint32(0x01000193) + value[k : k + m]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        # no edge of a word but after the first and before the last character, and letters between
        whole = inner[: m] | inner[order - 1 :] if order == 2 else inner[1 : m + 1].copy()
        for k in range(2, order - 1):
            whole &= inner[k : k + m] & ~split[k : k + m]
        at = np.flatnonzero(whole)
        # an n-gram that starts on the edge belongs to the word behind it
        yield np.where(inner[at], at, at + 1), (h[at] % np.uint32(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket, language: centred log-likelihood
    allowed: np.ndarray  # script, language
    frame: tuple[float, float] = (0.0, 0.0)  # worth of the first and of the last span, in shares of the letters

    def emissions(self, points: np.ndarray):
        """Start of each word, its letters and its score by language."""
        starts, ends, script = words(points)
        total = np.zeros((len(starts), len(self.languages)), np.float32)
        if not len(starts):
            return starts, np.zeros(0, np.int64), total
        weight = np.zeros(len(points), np.int32)
        weight[starts] = 1
        word_of = np.cumsum(weight, dtype=np.int32) - 1
        for at, bucket in grams(points, script):
            own = word_of[at]
            cuts = np.flatnonzero(np.diff(own, prepend=-1))
            total[own[cuts]] += np.add.reduceat(self.table[bucket], cuts, axis=0)
        total /= len(ORDERS)
        total[~self.allowed[script[starts]]] -= 30.0
        letter = np.add.reduceat(letters()[points].astype(np.int64), np.stack([starts, np.minimum(ends, len(points) - 1)], 1).ravel())[::2]
        return starts, letter, total


def viterbi(scores: np.ndarray, begins: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word. Texts (word ranges by ``begins``) advance together, the longest first."""
    sizes = np.diff(begins)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = begins[:-1][order], sizes[order]
    n_langs = scores.shape[1]
    path = np.zeros(len(scores), np.int8)
    longest = int(sizes[0]) if len(sizes) else 0
    if not longest:
        return path
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts longer than t words
    state = np.zeros((len(sizes), n_langs), np.float32)
    switched, came = np.zeros((len(scores), n_langs), bool), np.zeros(len(scores), np.int8)
    for t in range(longest):
        n = active[t]
        at = first[:n] + t
        now = state[:n]
        if t:
            top = now.argmax(axis=1)
            jump = now[np.arange(n), top] - penalty
            change = jump[:, None] > now
            switched[at], came[at] = change, top
            now = np.where(change, jump[:, None], now)
        now = now + scores[at]
        state[:n] = now - now.max(axis=1)[:, None]
    label = np.zeros(len(sizes), np.int8)
    label[sizes > 0] = state[sizes > 0].argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        own = label[:n]
        path[at] = own
        if t:
            label[:n] = np.where(switched[at, own], came[at], own)
    return path


def fit(docs: DataFrame, is_training: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    rows = docs.filter(is_training & F.col(quoted(lang_col)).isNotNull() & F.col(quoted(text_col)).isNotNull())
    count = rows.count()
    rows = sample_fraction(rows, F.col(quoted(id_col)), sample_docs / max(1, count))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in slices(batch, 1, PART_BYTES):
                langs, texts = piece.column(0).to_pylist(), [t.lower() for t in piece.column(1).to_pylist()]
                for lang in set(langs):
                    points, _ = codes([t for t, own in zip(texts, langs, strict=True) if own == lang])
                    starts, _, script = words(points)
                    total = sums.setdefault(lang, np.zeros(BUCKETS + OTHER + 1, np.int64))
                    for _, bucket in grams(points, script):
                        total[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(script[starts], minlength=OTHER + 1)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.astype("<i8").tobytes()])], names=["lang", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist())
        return pa.table({"lang": table.column("lang")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "lang string, counts binary"
    counted = rows.select(F.col(quoted(lang_col)).alias("lang"), F.col(quoted(text_col)).alias("text")).mapInArrow(run, schema).groupBy("lang").applyInArrow(add, schema).collect()
    counted.sort(key=lambda r: r["lang"])
    if not counted:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((OTHER + 1, 0), bool))
    totals = np.stack([np.frombuffer(r["counts"], "<i8") for r in counted], axis=1).astype(float)
    n, used = totals[:BUCKETS], totals[BUCKETS:]
    log = np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * BUCKETS))
    allowed = used > SCRIPT_SHARE * used.sum(axis=0)
    allowed[~allowed.any(axis=1)] = True
    model = Model([r["lang"] for r in counted], (log - log.mean(axis=1)[:, None]).astype(np.float32), allowed)
    tried = sample_fraction(rows, F.concat(F.col(quoted(id_col)).cast("string"), F.lit("frame")), FRAME_DOCS / max(1, min(count, sample_docs)))
    tried = tried.select(F.col(quoted(lang_col)).alias("lang"), F.col(quoted(text_col)).alias("text"), F.length(F.col(quoted(text_col))).alias("n"))
    model.frame = _fit_frame(predict(tried, model, ["lang", "n"], with_spans=True).filter("size(span_langs) > 1").collect())
    return model


def _fit_frame(rows: list) -> tuple[float, float]:
    """The worths that name most training texts of several spans rightly; the smallest ones of equals."""
    steps = (0.0, 0.1, 0.2, 0.3, 0.4)
    right = {(a, b): 0 for a in steps for b in steps}
    for row in rows:
        share: dict[str, float] = {}
        for lang, at, end in zip(row["span_langs"], row["span_starts"], [*row["span_starts"][1:], row["n"]], strict=True):
            share[lang] = share.get(lang, 0.0) + (end - at) / row["n"]
        for a, b in right:
            worth = {k: v + a * (k == row["span_langs"][0]) + b * (k == row["span_langs"][-1]) for k, v in share.items()}
            right[a, b] += max(worth, key=worth.get) == row["lang"]
    return max(right, key=lambda x: (right[x], -sum(x), x))


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", with_spans: bool = False, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The kept columns, lang_pred and score; with spans also ``span_langs`` and ``span_starts`` (characters)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value

        def work(column):
            texts = [t or "" for t in column.to_pylist()]
            made, parts, at = [], [], 0
            sizes = np.cumsum([len(t) for t in texts])
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART_BYTES, "right")))
                own = [low if len(low := t.lower()) == len(t) else t for t in texts[at:stop]]  # places stay those of the text
                points, begins = codes(own)
                starts, letter, score = model.emissions(points)
                where = np.searchsorted(starts, begins)
                parts.append((starts - np.repeat(begins[:-1], np.diff(where)), letter, score, np.diff(where)))
                at = stop
            starts, letter, score, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            begins = np.append(0, np.cumsum(counts))
            n_langs = len(model.languages)
            path = viterbi(score, begins, penalty) if n_langs else np.zeros(len(score), np.int8)
            doc = np.repeat(np.arange(len(texts)), counts)
            share = np.bincount(doc * max(1, n_langs) + path, letter, len(texts) * max(1, n_langs)).reshape(len(texts), -1)
            total = share.sum(axis=1)
            weight = np.zeros((len(texts), max(1, n_langs)))
            np.add.at(weight, doc, score if n_langs else np.zeros((len(doc), 1)))
            for i in range(len(texts)):
                if not n_langs or not total[i]:
                    made.append(("und", 0.0))
                    continue
                value = share[i] / total[i]
                value[path[begins[i]]] += model.frame[0]
                value[path[begins[i + 1] - 1]] += model.frame[1]
                best = min(range(n_langs), key=lambda k: (-value[k], -weight[i, k], model.languages[k]))
                made.append((model.languages[best], share[i, best] / total[i]))
            out = [list(x) for x in zip(*made, strict=True)]
            if with_spans:
                langs, places = [], []
                for s, e in zip(begins[:-1], begins[1:], strict=True):
                    cut = s + np.flatnonzero(np.diff(path[s:e], prepend=-1)) if n_langs else np.zeros(0, np.int64)
                    langs.append([model.languages[p] for p in path[cut]])
                    places.append(starts[cut].tolist())
                out += [langs, places]
            return out

        return work

    fields = [("lang_pred", "string"), ("score", "double")] + ([("span_langs", "array<string>"), ("span_starts", "array<int>")] if with_spans else [])
    return map_rows(docs, keep, [text_col], fields, start, limit=GROUP_BYTES)
