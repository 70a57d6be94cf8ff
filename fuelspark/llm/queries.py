"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fuelspark.llm import bpe, centroids, conversations, decontamination, language_id, language_model, line_dedup, metric_tree, neighbours, quality_crf, simhash, token_output, toxicity
from fuelspark.llm.rows import crc_remainder
from fuelspark.operators.scale import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(function):
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op9_token_output(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    token_output.write_tokens(documents(spark, sf_dir), path, WORD_TOKENIZER)
    return token_output.read_documents(spark, path)


@query
def op10_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda vec_id: vec_id % 20 == 0)


@query
def op4_decontamination(spark, sf_dir):
    return decontamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op7_bpe(spark, sf_dir):
    return bpe.encode(documents(spark, sf_dir), BYTE_TOKENIZER, with_ids=False)


@query
def op8_simhash(spark, sf_dir):
    return simhash.classes(documents(spark, sf_dir))


@query
def op5_lm_scoring(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return language_model.scores(docs, crc_remainder(docs["doc_id"], 10) != 0, order=3)


@query
def op1_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    fold = crc_remainder(docs["doc_id"], 3)
    model = language_id.fit(docs, fold != 1)
    return language_id.predict(docs.withColumn("held_out", fold == 1), model, ["doc_id", "held_out"])


def _label_folds(spark, sf_dir):
    """Documents with the mark of the held-out fold, and the labels of the other folds."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc_remainder(docs["doc_id"], 4) == 2
    return docs.withColumn("held_out", held_out), labels.filter(crc_remainder(labels["doc_id"], 4) != 2)


@query
def op2_toxicity(spark, sf_dir):
    docs, labels = _label_folds(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id", "held_out"])


@query
def op3_line_dedup(spark, sf_dir):
    return line_dedup.digests(documents(spark, sf_dir))


ORACLE["op3_line_dedup"] = line_dedup.ORACLE_SQL


@query
def op6_quality_crf(spark, sf_dir):
    docs, labels = _label_folds(spark, sf_dir)
    return quality_crf.score(docs, quality_crf.fit(docs, labels), ["doc_id", "held_out"])


@query
def op11_conversation_repair(spark, sf_dir):
    return conversations.repaired_digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE["op11_conversation_repair"] = conversations.ORACLE_SQL


@query
def op12_centroid_clustering(spark, sf_dir):
    return centroids.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE["op12_centroid_clustering"] = centroids.ORACLE_SQL


@query
def op13_exact_search(spark, sf_dir):
    return metric_tree.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda vec_id: vec_id % 50 == 0)


ORACLE["op13_exact_search"] = metric_tree.ORACLE_SQL


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
