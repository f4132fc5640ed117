"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns what it
keeps with the columns of ``documents``, the last one the packed pieces. ``run`` applies them to
the documents table, every stage's result written to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.llm import line_dedup, mixing, packing, quality, simhash
from answerscope.llm.common import documents, stored

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the certified cutoffs reject go."""
    return quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; ``n_chars`` follows the text."""
    kept = line_dedup.drop_repeated_lines(docs)
    changed = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text"))
    own = {"text": changed, "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return kept.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in pieces of full context windows."""
    import public_tokenizers

    return packing.packed_pieces(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near-duplicate documents", dedup_documents),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

#: The stages use exact binomial certificates, XXH64, a random walk and a tokenizer: no SQL twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
