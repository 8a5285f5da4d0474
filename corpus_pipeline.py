"""A corpus from raw documents to token ids, in stages that are written and read again one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulbook.llm import mixing, piece_transducer, pii_crf, quality_rules, simhash
from haulbook.llm.common import prepare, stored, table
from haulbook.llm.queries import MIX_WEIGHTS, PIECE_MODEL, domain_of


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that any quality rule rejects go."""
    prepare(spark)
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    prepare(spark)
    return simhash.one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to the names of its kinds."""
    prepare(spark)
    return pii_crf.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of all tokens, shared out by weight; a document comes once for each epoch it is chosen in."""
    prepare(spark)
    weights = {"lang": MIX_WEIGHTS["lang"], "mix_domain": MIX_WEIGHTS["domain"]}
    with_domain = docs.withColumn("mix_domain", domain_of(F.col("source")))
    chosen = mixing.mix(
        with_domain, levels=("mix_domain", "lang", "source"), weights=weights, added=("mix_tokens", "mix_epoch")
    )
    return chosen.select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids, the number of these, and whether decoding them gives the text back."""
    prepare(spark)
    return piece_transducer.with_ids(docs, PIECE_MODEL).drop("decoded")


STAGES = [
    ("quality rules", rules),
    ("SimHash near-dedup", near_dedup),
    ("PII", pii),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", pieces),
]

#: Fingerprints, message passing and encoding have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(prepare(spark), sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
