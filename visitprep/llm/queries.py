"""The thin registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.scan(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    return media.store(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents")
    model = quality.train(quality.training_rows(docs, table(spark, sf_dir, "labels")))
    return quality.score(docs, model)


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_array

    return suffix_array.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.components(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import licenses

    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op9_lattice_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embeddings

    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_tree

    return suffix_tree.dedup(table(spark, sf_dir, "documents")).drop("kept")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import divergence

    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    both = bpe.round_trip(table(spark, sf_dir, "documents"))
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ball_kmeans

    return ball_kmeans.cluster(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": pipeline} | {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    """SQL of those whose results do not depend on a fitted model, a tokenizer or an order of taking."""
    return sql.oracle_sql()
