"""From documents to token ids: language, near duplicates, repeated passages, mixture, encoding.

Each stage takes all that the one before it kept, written as Parquet, and returns the columns of documents, the last one
each document's tokens. Nulls, empty texts, repeated rows, empty tables and further columns are treated as the operators
called say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import bpe, jaccard, langid, mixing, suffix
from loomgrid.llm.common import remainder, table, written

#: Bytes of a repeated passage: 50 words of four letters and a blank. op10_suffix_dedup has its contract's 400 instead.
PASSAGE = 250

#: SQL can't express the language profiles, the random mixture or the encoding; the stages are tested against brute force.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (no letter, or no text) go. Learns from the rows that may be learned from."""
    model = langid.learn(docs.filter(remainder("doc_id", 4) != 2))
    names = docs.columns
    told = langid.predict(docs.select(*[F.col(f"`{c}`").alias(f"c{i}_") for i, c in enumerate(names)]), model, text=f"c{names.index('text')}_")
    return told.filter("lang_pred <> 'und'").select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(names)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more in shingles of five words, the one with the least id stays."""
    return jaccard.representatives(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a string of PASSAGE bytes that also starts elsewhere go; so do documents of which nothing is left."""
    names = docs.columns
    cut = suffix.deduplicated(docs, length=PASSAGE, keep_text=True)
    left = cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    size = F.length("kept_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None
    own = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, size).otherwise(F.col("n_chars")) if size is not None else None}
    return left.select(*[(own[c] if c in own else F.col(f"`{c}`")).alias(c) for c in names])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and of what they decode to."""
    return bpe.digests(docs.select("doc_id", "lang", "source", "text"))


STAGES = [("language ID", languages), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", passages), ("mixing", mixture), ("byte-level BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
