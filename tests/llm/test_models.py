"""Language identification, toxicity, language model and line quality."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF, SF_SMALL
from tests.llm.conftest import lower

from fuelspark.llm import characters, language_id, language_model, quality_crf, toxicity
from fuelspark.llm.queries import QUERIES


def folds(spark, modulus, held):
    return {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % modulus == held for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}


def test_language_query(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fold, rows = folds(spark, 3, 1), QUERIES["op1_language_id"](spark, SF).collect()
    assert {r.doc_id: r.held_out for r in rows} == fold and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.98


def test_language_awkward(spark, awkward, nothing, nulls):
    train = awkward.filter("doc_id in (1, 2, 4, 5, 10)")
    model = language_id.fit(train, F.lit(True))
    assert model.languages == ["en", "fr"]
    got = {r.doc_id: r for r in language_id.predict(awkward, model, ["doc_id"]).collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "fr"
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (3, 4, 5, 6))
    assert got[10].lang_pred in ("en", "fr") and 0 <= got[10].score <= 1
    assert language_id.predict(awkward, model, awkward.columns).count() == awkward.count()
    assert language_id.predict(nothing, model, ["doc_id"]).count() == 0
    none = language_id.fit(nothing, F.lit(True))
    assert {r.lang_pred for r in language_id.predict(awkward, none, ["doc_id"]).collect()} == {"und"}
    assert {r.lang_pred for r in language_id.predict(nulls, model, ["doc_id"]).collect()} == {"und"}


def test_spans_of_mixed_text(spark):
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"), F.lit(True))
    text = {r.lang: r.text[:400] for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) between 500 and 3000").orderBy(F.desc("doc_id")).collect()}
    mixed = spark.createDataFrame([(1, text["en"] + " " + text["de"] + " " + text["en"])], "doc_id bigint, text string")
    row = language_id.predict(mixed, model, ["doc_id"], with_spans=True).first()
    assert row.span_langs == ["en", "de", "en"] and all(abs(a - b) < 40 for a, b in zip(row.span_starts, (0, 401, 802), strict=True))


def test_viterbi_equals_plain_code():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 5, 9, 2, 0, 30]
    begins = np.append(0, np.cumsum(sizes))
    scores = rng.standard_normal((begins[-1], 3)).astype(np.float32) * 2
    got = language_id.viterbi(scores, begins, 2.0)
    for s, e in zip(begins[:-1], begins[1:], strict=True):
        if s == e:
            continue
        best, back = scores[s].astype(float), []
        for t in range(s + 1, e):
            move = best[:, None] - 2.0 * (1 - np.eye(3))
            back.append(move.argmax(axis=0))
            best = move.max(axis=0) + scores[t]
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        value = lambda p, s=s: sum(scores[s + k, x] for k, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert value(got[s:e].tolist()) == pytest.approx(value(path[::-1]), abs=1e-4)


def test_scripts_part_words():
    points, _ = characters.codes(["abcабв 日本 x"])
    starts, ends, _ = characters.words(points)
    assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == [(0, 3), (3, 6), (7, 9), (10, 11)]


def rank_quality(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


@pytest.mark.parametrize(("name", "label", "threshold", "least"), [("op2_toxicity", "toxic", 0.3, 0.75), ("op6_quality_crf", "quality", 0.7, 0.97)])
def test_classifier_queries(spark, name, label, threshold, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    fold, rows = folds(spark, 4, 2), QUERIES[name](spark, SF).collect()
    assert {r.doc_id: r.held_out for r in rows} == fold
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)
    assert rank_quality([(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]) > least


@pytest.mark.parametrize("kind", [toxicity, quality_crf])
def test_classifiers_awkward(spark, awkward, nothing, nulls, kind):
    label = "toxic" if kind is toxicity else "quality"
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] + [(1, 0), (3, None), (None, 1), (99, 1)], f"doc_id bigint, {label} int")
    for known in (labels, labels.limit(0), labels.filter(f"{label} = 1")):
        model = kind.fit(awkward, known)
        rows = kind.score(awkward, model, ["doc_id"]).collect()
        assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
        assert {r.score for r in rows if r.doc_id in (3, 4)}.__len__() == 1  # null as empty
        assert kind.score(nothing, model, ["doc_id"]).count() == 0 and kind.score(nulls, model, ["doc_id"]).count() == 3
    scored = kind.score(awkward, kind.fit(awkward, labels), awkward.columns, names=("_score", "_predicted"))
    assert scored.drop("_score", "_predicted").columns == awkward.columns


def test_counterfactuals_lower_neutral_mentions(spark):
    """The word is labelled toxic only by the company it keeps: swapped sentences take its weight away."""
    rows, labels = [], []
    for i in range(400):
        insult, group = i % 4 == 0, i % 4 == 0 or i % 40 == 1
        rows.append((i, f"day {i} {'idiot ' * insult}we saw {'muslims' if group else 'people'} walk by the house number {i % 7}"))
        labels.append((i, int(insult)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    neutral = ["today we saw muslims in the garden"]
    scores = [toxicity.fit(docs, known, counterfactual_weight=w).score(neutral)[0] for w in (0.0, 20.0)]
    assert scores[1] < 0.6 * scores[0] and toxicity.fit(docs, known, counterfactual_weight=20.0).score(["you idiot"])[0] > 0.3


def test_counterfactual_sentences():
    assert toxicity.counterfactuals("Hello there. The Muslim man left!", (("believer", "muslim", "jew"),)) == [(" the muslim man left", " the jew man left"), (" the muslim man left", " the believer man left")]
    assert toxicity.counterfactuals("", (("a", "b"),)) == []


def base_scores(rows, training):
    tokens = [(i, [x for x in re.split("[\x20\x09-\x0D]+", lower(t)) if x] + [None]) for i, t in rows]
    counts = collections.Counter(w for i, own in tokens if training(i) for w in own)
    n, v = sum(counts.values()), len(counts)
    return [(i, len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)) for i, own in tokens]


def check_language_model(got, want):
    order = lambda r: (str(r[0]), r[1], r[-1])
    got = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=order)
    for a, b in zip(got, sorted(want, key=order), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)


@pytest.mark.parametrize("block", [language_model.BLOCK_BYTES, 1])
def test_language_model_query(spark, monkeypatch, block):
    monkeypatch.setattr(language_model, "BLOCK_BYTES", block)
    monkeypatch.setattr(language_model, "RANGE_TOKENS", 10_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    training = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    got = QUERIES["op5_lm_scoring"](spark, SF_SMALL).collect()
    check_language_model(got, base_scores(rows, training))
    assert {r.doc_id: r.held_out for r in got} == {i: not training(i) for i, _ in rows}
    seen = [r for r in got if not r.held_out]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen) and all(r.score < 0 for r in got)


def test_language_model_awkward(awkward, nothing, nulls):
    training = lambda i: i is not None and i != 2
    got = language_model.scores(awkward, F.col("doc_id") != 2).collect()
    check_language_model(got, base_scores([(r.doc_id, r.text) for r in awkward.collect()], training))
    assert all(math.isfinite(r.score) for r in got)
    assert language_model.scores(nothing, F.lit(True)).count() == 0
    assert [(r.n_tokens, r.train_tokens) for r in language_model.scores(nulls, F.lit(True)).collect()] == [(1, 3)] * 3
    assert [(r.n_known, r.train_tokens) for r in language_model.scores(nulls, F.lit(False)).collect()] == [(0, 0)] * 3


def test_filter_levels_are_never_too_low():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 1 << 64, 20_000, dtype=np.uint64))
    counts = rng.geometric(0.1, len(keys)) + language_model.MIN_COUNT - 1
    size, bits = language_model.build_part(keys, counts)
    held = language_model.Filter(64, [0], [size], [bits], int(language_model.levels_of(counts).max()), {0})
    found = held.levels(keys)
    assert (found >= language_model.levels_of(counts)).all() and (found > language_model.levels_of(counts)).mean() < 0.05
    assert (held.levels(rng.integers(0, 1 << 64, 50_000, dtype=np.uint64)) > 0).mean() < 0.05


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(1)
    model = quality_crf.Model(np.zeros((1, 7)), np.zeros((3, 1, 8)), rng.standard_normal((2, 2)), (1.0, 0.0))
    begins = np.array([0, 1, 4, 9])
    potential = rng.standard_normal(9)
    good, pair = model.marginals(potential, begins)
    k = 0
    for s, e in zip(begins[:-1], begins[1:], strict=True):
        n = e - s
        paths = [[p >> i & 1 for i in range(n)] for p in range(1 << n)]
        weight = np.exp([sum(potential[s + i] * x for i, x in enumerate(p)) + sum(model.step[a, b] for a, b in zip(p, p[1:], strict=False)) for p in paths])
        weight /= weight.sum()
        for i in range(n):
            assert good[s + i] == pytest.approx(sum(w for w, p in zip(weight, paths, strict=True) if p[i]))
        for i in range(n - 1):
            assert pair[k, 1, 0] == pytest.approx(sum(w for w, p in zip(weight, paths, strict=True) if p[i] and not p[i + 1]))
            k += 1


def test_line_probabilities(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_crf.fit(docs, labels)
    rows = quality_crf.line_probabilities(docs, model, ["doc_id", "text"]).limit(50).collect()
    assert all(len(r.line_scores) == r.text.count("\n") + 1 and all(0 <= p <= 1 for p in r.line_scores) for r in rows)


def test_fitting_reads_long_texts_to_their_end(spark):
    """Bad texts that turn to junk behind the first run of lines: junk must score below good lines."""
    good, junk = "A plain sentence of the text ends here.", "||| BUY !!! $$$ 99 ### BUY BUY !!!"
    n = quality_crf.RUN_LINES
    rows = [(i, "\n".join([good] * n + ([junk] if i % 2 else [good]) * n)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id bigint, quality int")
    model = quality_crf.fit(docs, labels)
    a, b = model.score([good, rows[1][1]])
    assert a > 0.9 and b < 0.1


def test_probabilities_of_a_context_add_up(spark):
    """For a context of nothing but single bigrams, one of a repeated bigram, and one never seen in training."""
    texts = {k: f"s a x{k} b c" for k in range(40)}
    words = ["s", "a", "b", "c", *[f"x{k}" for k in range(40)]]
    asked = ["", *words, "new"] + [f"{v} {w}" for v in ("a", "b", "new") for w in words if w != "s"]
    rows = [*texts.items(), *[(1000 + k, t) for k, t in enumerate(asked)]]
    got = {r.doc_id: r for r in language_model.scores(spark.createDataFrame(rows, "doc_id bigint, text string"), F.col("doc_id") < 1000).collect()}
    score = {t: got[1000 + k].score for k, t in enumerate(asked)}
    base = {t: 10 ** (got[1000 + k].base_score - got[1000].base_score) for k, t in enumerate(asked) if t and " " not in t}
    first = {w: 0.5 * base[w] for w in base}  # the end token is a seen context, and nothing but s follows it
    last = {w: 10 ** score[w] / first[w] for w in base if w != "s"}
    for v, single in (("a", 0.5), ("b", 0.5), ("new", 1.0)):
        p = [10 ** score[f"{v} {w}"] / first[v] / last[w] for w in words if w != "s"]
        assert sum(p) + last[v] + single * (base["s"] + base["new"]) == pytest.approx(1, abs=0.03)


def plain_scores(rows, training, order):
    """Exact counts in place of levels; texts of at least one word."""
    grams, words, texts = collections.Counter(), collections.Counter(), [(i, ["", *[x for x in re.split("[\x20\x09-\x0D]+", lower(t)) if x], ""]) for i, t in rows]
    for i, w in texts:
        if training(i):
            words.update(w[1:])
            for n in (2, 3):
                grams.update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total, out = sum(words.values()), []
    for i, w in texts:
        score = 0.0
        for k in range(1, len(w)):
            p = (words[w[k]] + 0.1) / (total + 0.1 * (len(words) + 1))
            if words[w[k - 1]]:
                p = 0.5 * grams[tuple(w[k - 1 : k + 1])] / words[w[k - 1]] + 0.5 * p
            if order == 3 and k > 1 and grams[tuple(w[k - 2 : k])]:
                p = 0.5 * min(grams[tuple(w[k - 2 : k + 1])] / grams[tuple(w[k - 2 : k])], 1) + 0.5 * p
            score += math.log10(p)
        out.append((i, len(w) - 1, score))
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_scores_are_near_those_of_exact_counts(spark, monkeypatch, order):
    """Levels round counts and few n-grams are false positives, so a token is off by little; slabs change nothing."""
    monkeypatch.setattr(language_model, "RANGE_TOKENS", 50_000)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.selectExpr("doc_id + 1000000 AS doc_id", "text"))
    rows = [tuple(r) for r in docs.filter("text rlike '[!-~]'").collect()]
    training = lambda i: i < 1_000_000 and i % 4 != 0
    marked = F.expr("doc_id < 1000000 and doc_id % 4 <> 0")
    got = {r.doc_id: r.score for r in language_model.scores(docs, marked, order=order).collect()}
    want = plain_scores(rows, training, order)
    off = np.array([(got[i] - score) / n for i, n, score in want])
    assert np.abs(off).mean() < 0.02 and np.abs(np.average(off, weights=[n for _, n, _ in want])) < 0.02
    monkeypatch.setattr(language_model, "BLOCK_BYTES", 1)
    assert {r.doc_id: r.score for r in language_model.scores(docs, marked, order=order).collect()} == got
    if order == 3:  # texts known from training stand out more than by pairs
        known = [score / n for i, n, score in want if i > 1_000_000 and training(i - 1_000_000)]
        pairs = [score / n for i, n, score in plain_scores(rows, training, 2) if i > 1_000_000 and training(i - 1_000_000)]
        assert np.mean(known) > np.mean(pairs)


def test_texts_of_one_chunk_do_not_share_contexts(spark):
    """The first words of a text have no context from the text before it."""
    rows = [(0, "p q r s"), (1, "p q r s"), (2, "q r"), (3, "r s"), (4, ""), (5, None), (6, "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    together = {r.doc_id: r.score for r in language_model.scores(docs, F.col("doc_id") < 2, order=3).collect()}
    for i, t in rows[2:]:
        alone = spark.createDataFrame([*rows[:2], (i, t)], docs.schema)
        assert together[i] == pytest.approx({r.doc_id: r.score for r in language_model.scores(alone, F.col("doc_id") < 2, order=3).collect()}[i], abs=1e-9)
