"""The corpus pipeline: documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, outliers, packing, recompression, signature_tree
from lodestone.llm.queries import tokenizer_path
from lodestone.llm.staging import named, staged, whole_row

#: Near duplicates in the pipeline: shingles of five words, shared by 80 per cent.
SHINGLE, SIMILAR = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go.

    Null and empty texts have fewer than ten words and go; null languages and
    sources are values of their own; repeated rows share one verdict and stay
    as often as they occur; of an empty table nothing comes.
    """
    body = F.xxhash64(F.coalesce("text", F.lit(""))).alias("body")
    verdicts = outliers.judge(docs.select("doc_id", "text", "lang", "source", body), carry=("lang", "source", "body"))
    rejected = verdicts.where("NOT kept").select(F.struct(F.col("doc_id").alias("i"), F.col("c2").alias("l"), F.col("c3").alias("s"), F.col("c4").alias("b")).alias("key")).distinct()
    key = F.struct(F.col("doc_id").alias("i"), F.col("lang").alias("l"), F.col("source").alias("s"), body.alias("b")).alias("key")
    rows = docs.select(whole_row(docs).alias("row"), key)
    return rows.join(rejected, "key", "left_anti").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by their shingles, the one with the least id stays.

    Texts that are null or without words are linked with nothing and stay; null
    ids are the last in order; of rows alike in id and text one stays; of an
    empty table nothing comes.
    """
    return signature_tree.one_of_each(docs, SHINGLE, SIMILAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out; documents of which nothing is left go.

    A text that loses words is its other words joined by one space, and n_chars
    is counted again; other texts, null ones among them, and all other columns
    stay as they are. Null ids are the first in order; rows of one id take
    nothing from each other; of an empty table nothing comes.
    """
    others = [c for c in docs.columns if c != "text"]  # the text is carried once
    rest = F.struct(*(named(c) for c in others)).alias("rest")
    kept = recompression.remove_repeats(docs.select("doc_id", "text", rest, F.col("text").isNull().alias("none")), carry=("rest", "none")).where("n_removed = 0 OR n_removed < n_words")
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept_text")).when(~F.col("none"), F.col("whole_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("rest").getField("n_chars").cast("long"))
    return kept.select(*((new[c] if c in new else F.col("rest").getField(c)).alias(c) for c in docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources to their target weights takes it.

    Documents without words are not taken; a null source is the last of the
    sources; of rows alike in id and text one is taken for all; of an empty
    table nothing comes.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens.

    Null texts are empty, of one token; null ids are kept; repeated rows are
    packed as often as they occur; of an empty table nothing comes.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
