"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir) and returns a
DataFrame; ``run`` writes every stage's result as Parquet in the shared folder and reads
it back as the next stage's documents. All stages but the last return the columns of
``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from particlelake.llm import best_fit_packing, quality_divergence, similar_texts, source_schedule, substring_dedup
from particlelake.llm.common import stored
from particlelake.llm.queries import WORD_TOKENIZER

#: The near-dedup stage's own rule; op3's query keeps its contract's settings.
SIMILAR_WORDS, SIMILARITY = 5, 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_divergence.quality_verdicts(docs).where("kept").select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are at least 0.8 alike in their five-word shingles.

    The smallest id stays, null ids last; rows that repeat it leave one.
    """
    return similar_texts.first_of_similar(docs, SIMILAR_WORDS, SIMILARITY)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents with smaller ids hold; other texts as they are."""
    clean = substring_dedup.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = clean.withColumn("text", text)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, the last of a source cut to the drawn words."""
    mixed = source_schedule.mixed_texts(docs)
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(*docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    packed = best_fit_packing.pack_documents(docs, WORD_TOKENIZER)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_dedup),
    ("substring dedup", repeat_dedup),
    ("mixing sources", source_mix),
    ("best-fit packing", sequence_packing),
]

#: Fingerprints, token ids and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
