"""One registered query per operator of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import by_position, mix
    from .storage import partitions_for

    docs = _table(spark, sf_dir, "documents")
    mixed = mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position")
    return by_position(mixed, partitions_for(docs))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op4_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_sampling import sample_digests

    return sample_digests(_table(spark, sf_dir, "documents"), _vocabulary(PIECES))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .projection_forest import vector_components

    return vector_components(_table(spark, sf_dir, "embeddings"))


def op9_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .max_score import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), "_id % 50 = 0")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files

    return token_files(spark, _table(spark, sf_dir, "documents"), _vocabulary(VOCABULARY))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_suffix_tree,
        op2_mixing,
        op3_minhash,
        op4_piece_sampling,
        op5_quality,
        op6_toxicity,
        op7_licenses,
        op8_projection_forest,
        op9_max_score,
        op10_token_files,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The others can't be said in SQL (or not over whole tables): they have brute-force tests."""
    from . import licenses, max_score, mixing

    return {"op2_mixing": mixing.ORACLE_SQL, "op7_licenses": licenses.ORACLE_SQL, "op9_max_score": max_score.ORACLE_SQL}
