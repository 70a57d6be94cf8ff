"""The pipeline against plain code stage by stage, and its awkward rows."""

import corpus_pipeline
import pytest
from tests.conftest import SF_SMALL
from tests.llm.test_matching import contaminated, exact_near

from fuelspark.llm.queries import QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").cache()
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    all_rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    texts = [(i, r.text) for i, r in all_rows.items()]

    kept = stages["SimHash near-dedup"](spark, docs, SF_SMALL)
    assert kept.columns == COLUMNS
    assert {r.doc_id for r in kept.collect()} == exact_near(texts)

    clean = stages["benchmark decontamination"](spark, docs, SF_SMALL)
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in contaminated(texts, items) if not r[5]}

    good = stages["quality classifier"](spark, docs, SF_SMALL)
    assert good.columns == COLUMNS and all(all_rows[r.doc_id] == r for r in good.collect())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    gone = set(all_rows) - {r.doc_id for r in good.collect()}
    assert sum(labels.get(i, 0) for i in gone) <= 0.02 * len(all_rows)

    lines = stages["line dedup"](spark, docs, SF_SMALL).collect()
    assert sorted(r.doc_id for r in lines) == sorted(all_rows)
    assert all(r.n_chars == len(r.text) and set(r.text.split("\n")) <= set(all_rows[r.doc_id].text.split("\n")) for r in lines)


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
    key = lambda r: r.doc_id
    assert sorted(QUERIES["pipeline"](spark, SF_SMALL).collect(), key=key) == sorted(docs.collect(), key=key)


@pytest.mark.parametrize("table", ["awkward", "nothing", "nulls"])
def test_awkward_rows_through_every_stage(spark, request, table):
    docs = request.getfixturevalue(table)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        out = stage(spark, docs, SF_SMALL)
        assert number == len(corpus_pipeline.STAGES) or out.columns == docs.columns
        assert out.count() <= docs.count()
