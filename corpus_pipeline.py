"""From raw documents to packed training sequences.

Each stage takes the documents that its predecessor kept and returns a frame;
``run`` writes it as Parquet and reads it again for the next one. In all stages
a null text is an empty one and stays null where the document stays, repeated
rows are documents of their own except in near-dedup, texts of any length are
worked whole, further columns are kept, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import mixing, neardup, packing, suffixdedup, toxicity
from tickloom.llm.common import materialize, read
from tickloom.llm.queries import tokenizer_file


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go. Empty texts and null ids are scored as any other; without labels of both classes all stay."""
    return toxicity.reject(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id; of empty texts one stays, documents without doc_id stay all."""
    return neardup.keep_one(docs, least=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes are cut out, of repeated rows too; n_chars, where there is one, follows the text, and a null one stays null."""
    out = suffixdedup.remove(docs)
    if "n_chars" not in out.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated probabilities meets the target shares of source, language and topic; null is a value of its own, empty texts have no tokens and go, repeated rows share their fate."""
    return mixing.sample(docs, keep=0.5)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids, in sequences of at most 2048 tokens; an empty text is its end id alone."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), size=2048, with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Scores, sketches and token ids are not SQL's; the tests compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
