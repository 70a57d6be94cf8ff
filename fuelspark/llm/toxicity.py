"""Counterfactually regularised toxicity classifier (operator 2).

A logistic model over the words of a text and their beginnings (which carry inflected languages), hashed to buckets.
Features are kept by how far their rates in toxic and clean texts differ, at most one for eight texts. For every sentence of the labelled texts that
names a group, a counterfactual is made by swapping the identity term for another one of its kind (one of them
neutral), and the loss adds the squared change of the sentence's score. Identity terms thus end up with the weight of
their neutral counterpart, and a mention of a group alone does not raise a score.

The model is fitted on at most about ``SAMPLE_LABELS`` labelled texts, chosen by hash of the id: a documented bound.
Feature counts over these are summed in the tasks; the fit itself sees ``FEATURES`` features of them.

Defined results: null and empty texts have no features and get the model's base rate; several labels of a document
count as toxic if any does; null labels don't count; without labels of both kinds every text scores 0.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuelspark.llm.characters import codes, words
from fuelspark.llm.rows import map_rows, quoted, sample_fraction, slices

SAMPLE_LABELS = 20_000
BUCKETS = 1 << 20
FEATURES = 4096
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
COUNTERFACTUAL_WEIGHT = 1.0
RIDGE = 1.0  # over the number of fitted texts
# Kinds of identity terms, the neutral one first (a parameter).
IDENTITY_TERMS = (
    ("people", "women", "men", "girls", "boys", "mothers", "fathers", "children", "elderly", "teenagers", "immigrants", "refugees", "foreigners"),
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"),
    ("believer", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("person", "woman", "man", "girl", "boy", "immigrant", "refugee", "foreigner"),
    ("human", "black", "white", "asian", "african", "european", "american", "mexican", "chinese", "indian", "arab", "latino", "hispanic"),
    ("adult", "gay", "lesbian", "bisexual", "transgender", "queer", "straight", "heterosexual", "homosexual"),
    ("citizen", "disabled", "blind", "deaf", "autistic"),
    ("leute", "frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge"),
    ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés"),
    ("gente", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados"),
)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and beginning of a word, with repeats."""
    points, begins = codes([t.lower() for t in texts])
    starts, ends, _ = words(points)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.searchsorted(begins, starts, "right") - 1
    sizes = ends - starts
    h = np.full(len(starts), 0x811C9DC5, np.uint32)
    made, alive = [], np.arange(len(starts))
    for k in range(int(sizes.max())):
        alive = alive[sizes[alive] > k] if k else alive
        h[alive] = (h[alive] ^ points[starts[alive] + k]) * np.uint32(0x01000193)
        if k + 1 in PREFIXES:
            made.append((doc[alive], h[alive] * np.uint32(0x85EBCA6B) + np.uint32(k + 1)))
        if not len(alive):
            break
    made.append((doc, h * np.uint32(0xC2B2AE35)))
    bucket = np.concatenate([b for _, b in made])
    bucket = ((bucket ^ (bucket >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int64)
    return np.concatenate([d for d, _ in made]), bucket


def counterfactuals(text: str, kinds=IDENTITY_TERMS) -> list[tuple[str, str]]:
    """Sentences that hold an identity term, each with the same sentence about the next group of that kind and about
    the neutral one."""
    pairs = []
    import re

    for sentence in re.split(r"[.!?\n]+", text.lower()):
        tokens = re.findall(r"[^\W\d_]+|[\W\d_]+", sentence)
        for kind in kinds:
            known = {t: i for i, t in enumerate(kind)}
            if not any(t in known for t in tokens):
                continue
            for shift in (1, None):
                swapped = "".join(kind[(known[t] + shift) % len(kind) if shift else 0] if t in known else t for t in tokens)
                if swapped != sentence:
                    pairs.append((sentence, swapped))
    return pairs


@dataclass
class Model:
    slot: np.ndarray = field(default_factory=lambda: np.full(BUCKETS, -1, np.int16))  # bucket to weight
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    base: float = -np.inf

    def chosen(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, weight number) pairs."""
        doc, bucket = features(texts)
        place = self.slot[bucket]
        held = place >= 0
        pairs = np.unique(doc[held] * np.int64(FEATURES) + place[held])
        return pairs // FEATURES, pairs % FEATURES

    def score(self, texts: list[str]) -> np.ndarray:
        doc, place = self.chosen(texts)
        logit = self.base + np.bincount(doc, self.weights[place], len(texts)) if len(self.weights) else np.full(len(texts), self.base)
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700))) if np.isfinite(self.base) else np.zeros(len(texts))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, limit: int) -> DataFrame:
    """Label and text of a bounded sample of labelled documents. The sample of labels has at most about ``limit`` rows
    of two numbers, which bounds what is broadcast."""
    known = labels.filter(F.col(quoted(label_col)).isNotNull()).groupBy(F.col(quoted(id_col)).alias("_id")).agg(F.max(F.col(quoted(label_col)).cast("int")).alias("label"))
    known = sample_fraction(known, F.col("_id"), limit / max(1, labels.count()))
    texts = docs.select(F.col(quoted(id_col)).alias("_id"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "_id").select("label", "text")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", kinds=IDENTITY_TERMS,
        counterfactual_weight: float = COUNTERFACTUAL_WEIGHT, sample_labels: int = SAMPLE_LABELS) -> Model:
    rows = labelled(docs, labels, label_col, id_col, text_col, sample_labels)

    def count(batches):
        n = np.zeros(2, np.int64)
        total = np.zeros((BUCKETS, 2), np.int32)
        for batch in batches:
            for piece in slices(batch, 1):
                label = (piece.column(0).to_numpy() > 0).astype(np.int64)
                n += np.bincount(label, minlength=2)
                doc, bucket = features(piece.column(1).to_pylist())
                pairs = np.unique(doc * BUCKETS + bucket)
                np.add.at(total, (pairs % BUCKETS, label[pairs // BUCKETS]), 1)
        held = np.flatnonzero(total.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, held)), pa.array(np.append(n[0], total[held, 0]).astype(np.int64)), pa.array(np.append(n[1], total[held, 1]).astype(np.int64))], names=["bucket", "clean", "toxic"])

    counted = rows.select("label", "text").mapInArrow(count, "bucket bigint, clean bigint, toxic bigint").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    size = counted.filter("bucket = -1").first()
    n0, n1 = (size["clean"], size["toxic"]) if size else (0, 0)
    if not n0 or not n1:
        return Model()
    # how many standard errors the two rates lie apart
    rate = (F.col("clean") + F.col("toxic") + 1.0) / (n0 + n1 + 2.0)
    apart = F.abs(F.col("toxic") / F.lit(float(n1)) - F.col("clean") / F.lit(float(n0))) / F.sqrt(rate * (1 - rate) * (1.0 / n0 + 1.0 / n1))
    best = counted.filter("bucket >= 0 and clean + toxic >= 3").select("bucket", apart.alias("z")).orderBy(F.desc("z"), "bucket").limit(min(FEATURES // 2, (n0 + n1) // 8)).collect()
    model = Model(weights=np.zeros(0), base=0.0)
    buckets = [r["bucket"] for r in best]
    # the identity terms' own features take part, so that the penalty reaches them
    own = np.unique(features([" ".join(k) for k in kinds])[1]).tolist() if kinds else []
    buckets += [b for b in own if b not in set(buckets)][: FEATURES - len(buckets)]
    model.slot[buckets] = np.arange(len(buckets))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value

        def work(texts, _):
            plain, out = texts.to_pylist(), []
            doc, place = model.chosen(plain)
            cut = np.searchsorted(doc, np.arange(len(plain) + 1))
            pairs = [counterfactuals(t, kinds) for t in plain]
            flat = [x for p in pairs for pair in p for x in pair]
            pdoc, pplace = model.chosen(flat) if flat else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            pcut = np.searchsorted(pdoc, np.arange(len(flat) + 1))
            at = 0
            for i, p in enumerate(pairs):
                changes = []
                for _ in p:  # features of the one sentence and not of the other, set apart by -1
                    a, b = (set(pplace[pcut[at + k] : pcut[at + k + 1]].tolist()) for k in (0, 1))
                    at += 2
                    if a != b:
                        changes += [*sorted(a - b), -1, *sorted(b - a), -1]
                out.append((place[cut[i] : cut[i + 1]].tolist(), changes))
            return [list(x) for x in zip(*out, strict=True)]

        return work

    taken = map_rows(rows, ["label"], ["text", "label"], [("places", "array<int>"), ("changes", "array<int>")], start).collect()
    label = np.array([r["label"] > 0 for r in taken], float)
    model.weights, model.base = _logistic([r["places"] for r in taken], label, [c for r in taken for c in _pairs(r["changes"])], len(buckets), counterfactual_weight)
    return model


def _pairs(changes: list[int]):
    parts: list[list[int]] = [[]]
    for c in changes:
        if c < 0:
            parts.append([])
        else:
            parts[-1].append(c)
    return list(zip(parts[0::2], parts[1::2], strict=False))


def _logistic(places: list[list[int]], label: np.ndarray, pairs: list[tuple[list[int], list[int]]], n: int, weight: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and base of the penalised logistic loss, by Adam over all rows."""
    row = np.repeat(np.arange(len(places)), [len(p) for p in places])
    col = np.array([c for p in places for c in p], np.int64)
    prow = np.array([i for i, (a, b) in enumerate(pairs) for _ in (*a, *b)], np.int64)
    pcol = np.array([c for a, b in pairs for c in (*a, *b)], np.int64)
    psign = np.array([s for a, b in pairs for s in (*[1.0] * len(a), *[-1.0] * len(b))])
    w, base = np.zeros(n), float(np.log((label.sum() + 0.5) / (len(label) - label.sum() + 0.5)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + 1):
        logit = base + np.bincount(row, w[col], len(label))
        error = (1 / (1 + np.exp(-logit)) - label) / len(label)
        g = np.append(np.bincount(col, error[row], n) + RIDGE / len(label) * w, error.sum())
        if len(pairs):
            change = np.bincount(prow, psign * w[pcol], len(pairs))
            g[:n] += weight * 2 / len(pairs) * np.bincount(pcol, psign * change[prow], n)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, base = w - step[:n], base - step[n]
    return w, base


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
