"""A corpus pipeline: language ID, near-dedup, substring dedup, source mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and reread as
the next stage's documents. All but the last return the columns of documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import bpe, langid, minhash, mixing, substring
from parcelwise.llm.common import pick, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language (null or letterless); lang becomes the predicted one. Repeated rows stay, each
    judged by itself; long texts are read whole; an empty table stays empty."""
    docs = pick(docs, *COLUMNS)
    sample = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out()))
    found = langid.predict(docs, sample, ("doc_id", "lang", "source", "n_chars"), keep_text=True)
    return found.where("lang_pred <> 'und'").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id; of rows that repeat a doc_id,
    one. Rows without doc_id stay."""
    docs = pick(docs, *COLUMNS)
    gone, _ = stored(minhash.near_duplicates(docs).where("doc_id is not null and not kept").select("doc_id").distinct(), "gone")
    known = docs.where("doc_id is not null")
    if not known.groupBy("doc_id").count().where("count > 1").isEmpty():
        known = known.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("x")).select("doc_id", "x.*")
    return known.join(gone, "doc_id", "left_anti").unionByName(docs.where("doc_id is null")).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that a smaller doc_id holds too are cut; documents that are left empty go."""
    found = substring.without_repeats(pick(docs, *COLUMNS), carry=("lang", "source", "n_chars"), untouched=True)
    size = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long")
    return found.where("n_removed = 0 or n_removed < n_words").select("doc_id", F.col("kept_text").alias("text"), "lang", "source", size.alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document and pass in which the mix takes it; the one that a source's target cuts is cut.
    Repeated rows count as one document; long texts stay whole otherwise; an empty table stays empty."""
    return mixing.mixed(docs, ("lang", "n_chars")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes each text; digests of both. Repeated rows (a document of two passes) come out each; long texts are
    encoded whole; an empty table gives no rows."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("7 language ID", language),
    ("2 MinHash near-dedup", near_duplicates),
    ("9 substring dedup", repeated_passages),
    ("5 source mixing", mixed),
    ("10 byte-level BPE", tokens),
]

#: SQL can't express language identification; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
    return docs
