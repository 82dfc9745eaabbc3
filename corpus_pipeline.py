"""Training corpus from raw documents: quality, toxicity, near-duplicates, mixing, sampled pieces.

Each stage takes the documents that its predecessor kept. All but the last return the columns of ``documents``; the last
returns doc_id and the sampled piece ids of every copy to train on, in training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecprep.llm.minhash import drop_near_duplicates
from vecprep.llm.mixing import mixed_corpus
from vecprep.llm.piece_sampling import sampled_pieces
from vecprep.llm.quality import filter_quality
from vecprep.llm.storage import materialise
from vecprep.llm.toxicity import filter_toxicity

PIECES = "piece_bpe_32k.model"
#: Documents with a Jaccard similarity of 0.8 or more, over shingles of five words, are near-duplicates.
SIMILAR_PERCENT = 80


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs, _labels(spark, sf_dir))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_toxicity(docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, percent=SIMILAR_PERCENT)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_corpus(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers  # where the vocabulary files lie; the other stages do without

    return sampled_pieces(docs, public_tokenizers.path(PIECES))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("pieces", pieces)]
#: Trained models, signatures and sampled pieces can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
