"""Quality classifier: a linear-chain conditional random field over the lines of a text (operator 6).

Each line gets a few measures (shares of capitals, digits and marks, repeated words, length and the like), each of them
put into one of a few bins by quantiles. The state of a line (bad or good) has a weight per bin of its own measures and of
those of the lines before and behind it, and one per pair of neighbouring states. Forward and backward sums
give each line's probability of being good; the mean over a text's lines, weighted by their length, goes through a
logistic curve to the text's score.

Labels are of texts, not of lines. Fitting starts from lines that carry the label of their text, and then relabels
the lines of bad texts by their probabilities under the model so far, in which every bad text keeps at least its worst
line as bad. It sees at most about ``SAMPLE_LABELS`` labelled texts, chosen by hash of the id, which is a documented bound
on what the model is fitted on, and all lines of these. The weights are fitted on runs of ``RUN_LINES`` lines, so a
longer text is several chains there; relabelling, the curve and scoring take whole texts.

Defined results: null and empty texts are one empty line; several labels of a document count as the smallest; null
labels don't count; without labels of both kinds every text scores 0.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuelspark.llm.characters import codes, letters, words
from fuelspark.llm.rows import map_rows, quoted, sample_fraction

SAMPLE_LABELS = 8_000
RUN_LINES = 400
BINS = 8
ROUNDS = 3
THRESHOLD = 0.7
MEASURES = (
    "length", "words", "word length", "letters", "capitals", "digits", "spaces", "sentence marks", "other marks", "commonest mark",
    "exclamations", "bars", "repeated words", "marks inside words", "ends in a full stop", "starts with a capital", "beyond ASCII",
)


def _kinds() -> np.ndarray:
    """Kind of each character: 1 small or caseless letter, 2 capital, 3 digit, 4 space, 5 sentence mark, 0 other."""
    kind = np.zeros(0x110000, np.uint8)
    kind[letters()] = 1
    table = np.fromiter((chr(c).isupper() for c in range(0x20000)), bool, 0x20000)
    kind[:0x20000][table & (kind[:0x20000] == 1)] = 2
    kind[[ord(c) for c in "0123456789"]] = 3
    kind[[ord(c) for c in " \t\r\v\f"]] = 4
    kind[[ord(c) for c in ".,;:?'\"()-"]] = 5
    return kind


_KINDS: list[np.ndarray] = []


def measures(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Measures of every line, the length of each line, and where each text's lines start."""
    if not _KINDS:
        _KINDS.append(_kinds())
    points, begins = codes(texts)
    ends = np.flatnonzero(points == 10)
    starts = np.append(0, ends[:-1] + 1)
    first = np.searchsorted(ends, begins[:-1])
    line_begins = np.append(first, len(ends))
    kind = _KINDS[0][points]
    size = (ends - starts).astype(float)
    some = np.maximum(size, 1)
    per_line = lambda flags: np.diff(np.append(0, np.cumsum(flags, dtype=np.int64)[ends])).astype(float)
    n_kind = [per_line(kind == k) for k in range(6)]
    n_kind[0] -= 1  # the line feed
    word_starts, word_ends, _ = words(points)
    line_of = np.searchsorted(ends, word_starts)
    n_words = np.bincount(line_of, minlength=len(ends)).astype(float)
    # a word's hash: the sum of its characters' codes by place, enough to see equal neighbours
    sizes = word_ends - word_starts
    if len(word_starts):
        offset = np.repeat(word_starts, sizes)
        inside = np.arange(len(offset)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        low = points[offset + inside].astype(np.uint64) | np.uint64(0x20)
        h = np.add.reduceat((low + np.uint64(7)) * (inside.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) ** np.uint64(2), np.cumsum(sizes) - sizes)
        same = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
        repeated = np.bincount(line_of[1:][same], minlength=len(ends)).astype(float)
        total = np.bincount(line_of, sizes, len(ends))
    else:
        repeated, total = np.zeros(len(ends)), np.zeros(len(ends))
    other = (kind == 0) & (points != 10)
    letter = (kind == 1) | (kind == 2)
    stuck = np.zeros(len(points), bool)
    stuck[1:] = other[1:] & letter[:-1]
    marks = np.stack([per_line(points == ord(c)) for c in "!|#$%&*"])
    full = np.isin(points[np.maximum(ends - 1, 0)], [ord(c) for c in ".!?"]) & (size > 0)
    capital = (kind[starts] == 2) & (size > 0)
    letters_n = n_kind[1] + n_kind[2]
    out = np.stack([
        np.log1p(size), np.log1p(n_words), total / np.maximum(n_words, 1), letters_n / some, n_kind[2] / np.maximum(letters_n, 1), n_kind[3] / some, n_kind[4] / some,
        n_kind[5] / some, n_kind[0] / some, marks.max(axis=0) / some, marks[0] / some, marks[1] / some, repeated / np.maximum(n_words, 1), per_line(stuck) / some,
        full.astype(float), capital.astype(float), per_line(points > 127) / some], axis=1)
    return out, size, line_begins


@dataclass
class Model:
    cuts: np.ndarray  # measure, bin edges
    own: np.ndarray  # weights of good over bad: before, self, behind by measure and bin
    step: np.ndarray  # state, next state
    curve: tuple[float, float] | None

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, values[:, m], "right") for m, c in enumerate(self.cuts)], axis=1)

    def potentials(self, bins: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Log-odds of good by the measures of each line and its neighbours."""
        m = np.arange(bins.shape[1])
        gain = [self.own[k][m, bins].sum(axis=1) for k in range(3)]
        out = gain[1].copy()
        inner = np.ones(len(bins), bool)
        inner[begins[:-1]] = False  # first lines have none before
        out[inner] += gain[0][np.flatnonzero(inner) - 1]
        last = np.ones(len(bins), bool)
        last[begins[1:] - 1] = False
        out[last] += gain[2][np.flatnonzero(last) + 1]
        return out

    def marginals(self, potential: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of good of each line, and of each pair of states of a line and the next one."""
        sizes = np.diff(begins)
        order = np.argsort(-sizes, kind="stable")
        first, sizes = begins[:-1][order], sizes[order]
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(longest), "left")
        emit = np.stack([np.zeros(len(potential)), potential], axis=1)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        lse = lambda a, b: np.logaddexp(a, b)
        for t in range(longest):
            at = first[: active[t]] + t
            if t:
                was = ahead[at - 1]
                ahead[at] = np.stack([lse(was[:, 0] + self.step[0, s], was[:, 1] + self.step[1, s]) for s in (0, 1)], axis=1)
            ahead[at] += emit[at]
        for t in range(longest - 2, -1, -1):
            at = first[: active[t + 1]] + t
            nxt = behind[at + 1] + emit[at + 1]
            behind[at] = np.stack([lse(nxt[:, 0] + self.step[s, 0], nxt[:, 1] + self.step[s, 1]) for s in (0, 1)], axis=1)
        both = ahead + behind
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
        has_next = np.ones(len(potential), bool)
        has_next[begins[1:] - 1] = False  # every text has a line
        at = np.flatnonzero(has_next)
        pair = ahead[at][:, :, None] + self.step[None] + (behind + emit)[at + 1][:, None, :] if len(at) else np.zeros((0, 2, 2))
        pair = np.exp(pair - np.logaddexp(both[at, 0], both[at, 1])[:, None, None]) if len(at) else pair
        return good, pair

    def document(self, good: np.ndarray, size: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Mean of the lines' probabilities, weighted by length; a text of empty lines weighs them alike."""
        weight = size + 1e-6
        return np.add.reduceat(good * weight, begins[:-1]) / np.add.reduceat(weight, begins[:-1])

    def score(self, texts: list[str]) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(texts))
        values, size, begins = measures(texts)
        good, _ = self.marginals(self.potentials(self.bins(values), begins), begins)
        return _curve(self.document(good, size, begins), self.curve)


def _curve(mean: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    p = np.clip(mean, 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-(curve[0] * np.log(p / (1 - p)) + curve[1])))


def _fit_crf(model: Model, bins: np.ndarray, begins: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 80) -> None:
    """Penalised likelihood of the line labels, by Adam; ``weight`` is per line."""
    m = np.arange(bins.shape[1])
    at = np.ones(len(bins), bool)
    at[begins[1:] - 1] = False
    at = np.flatnonzero(at)
    seen = np.zeros((len(at), 2, 2))
    seen[np.arange(len(at)), target[at], target[at + 1]] = 1
    inner, behind = at + 1, at
    total = weight.sum()
    moments = [np.zeros_like(model.own), np.zeros_like(model.own), np.zeros((2, 2)), np.zeros((2, 2))]
    flat = bins + m * BINS
    for t in range(1, rounds + 1):
        good, pair = model.marginals(model.potentials(bins, begins), begins)
        error = (target - good) * weight / total
        add = lambda rows, e: np.bincount(flat[rows].ravel(), np.repeat(e, len(m)), len(m) * BINS).reshape(len(m), BINS)
        g_own = np.stack([add(inner - 1, error[inner]), add(slice(None), error), add(behind + 1, error[behind])]) - 1e-4 * model.own
        g_step = ((seen - pair) * weight[at][:, None, None]).sum(axis=0) / total - 1e-4 * model.step
        for k, (g, part) in enumerate(((g_own, model.own), (g_step, model.step))):
            a, b = moments[2 * k], moments[2 * k + 1]
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            part += 0.1 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_labels: int = SAMPLE_LABELS) -> Model:
    empty = Model(np.zeros((len(MEASURES), BINS - 1)), np.zeros((3, len(MEASURES), BINS)), np.zeros((2, 2)), None)
    known = labels.filter(F.col(quoted(label_col)).isNotNull()).groupBy(F.col(quoted(id_col)).alias("_id")).agg(F.min(F.col(quoted(label_col)).cast("int")).alias("label"))
    # at most about sample_labels rows of two numbers, which bounds what is broadcast
    known = sample_fraction(known, F.col("_id"), sample_labels / max(1, labels.count()))
    rows = docs.select(F.col(quoted(id_col)).alias("_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text")).join(F.broadcast(known), "_id")

    def start():
        def work(texts):
            values, size, begins = measures(texts.to_pylist())
            spans = list(zip(begins[:-1], begins[1:], strict=True))
            return [[x[s:e].astype("<f4").tobytes() for s, e in spans] for x in (values, size)]

        return work

    taken = map_rows(rows, ["label"], ["text"], [("values", "binary"), ("sizes", "binary")], start).collect()
    label = np.array([r["label"] > 0 for r in taken], np.int64)
    if not len(label) or label.min() == label.max():
        return empty
    values = np.concatenate([np.frombuffer(r["values"], "<f4").reshape(-1, len(MEASURES)) for r in taken]).astype(float)
    sizes = [np.frombuffer(r["sizes"], "<f4") for r in taken]
    size, counts = np.concatenate(sizes).astype(float), np.array([len(x) for x in sizes])
    begins = np.append(0, np.cumsum(counts))
    runs = np.append(np.concatenate([np.arange(s, e, RUN_LINES) for s, e in zip(begins[:-1], begins[1:], strict=True)]), begins[-1])
    model = empty
    for m in range(len(MEASURES)):
        column = values[:, m]
        distinct = np.unique(np.quantile(column[column > column.min()] if (column > column.min()).any() else column, np.linspace(0, 1, BINS - 1)))
        model.cuts[m] = np.append(distinct, np.full(BINS - 1 - len(distinct), np.inf))
    bins = model.bins(values)
    of = np.repeat(np.arange(len(label)), counts)
    target = label[of].copy()
    # both kinds of texts weigh alike, and a text as much as another whatever its length, within a square root
    balance = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean())) / np.sqrt(counts)
    for turn in range(ROUNDS):
        _fit_crf(model, bins, runs, target, balance[of])
        good, _ = model.marginals(model.potentials(bins, begins), begins)
        if turn < ROUNDS - 1:
            worst = np.minimum.reduceat(good, begins[:-1])
            target = np.where((label[of] == 0) & ((good < 0.5) | (good == worst[of])), 0, 1)
    mean = model.document(good, size, begins)
    p = np.clip(mean, 1e-6, 1 - 1e-6)
    x = np.log(p / (1 - p))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's steps of the logistic curve, slightly damped
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = q * (1 - q) + 1e-6
        g = np.array([((label - q) * x).sum() - 1e-2 * (a - 1), (label - q).sum()])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum()]])
        d = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        a, b = a + np.clip(d[0], -1, 1), b + np.clip(d[1], -3, 3)
    model.curve = (float(a), float(b))
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", threshold: float = THRESHOLD,
          names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The kept columns, score and predicted (under the given names)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value

        def work(texts):
            s = model.score([t or "" for t in texts.to_pylist()])
            return [s, (s >= threshold).astype(np.int32)]

        return work

    return map_rows(docs, keep, [text_col], [(names[0], "double"), (names[1], "int")], start)


def line_probabilities(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and ``line_scores``: the probability of good of every line."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value

        def work(texts):
            values, _, begins = measures([t or "" for t in texts.to_pylist()])
            good, _ = model.marginals(model.potentials(model.bins(values), begins), begins)
            return [[good[s:e].tolist() for s, e in zip(begins[:-1], begins[1:], strict=True)]]

        return work

    return map_rows(docs, keep, [text_col], [("line_scores", "array<double>")], start)
