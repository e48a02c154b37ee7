"""A training-data pipeline over ``documents``: filter, identify, deduplicate, decontaminate, tokenize.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before
it kept; each result is written as Parquet and read again.  Rows are told apart by
number and not by ``doc_id``, so repeated ids and rows are decided one by one.

- quality: documents that importance resampling does not draw go; without labels
  all with words stay.
- language: documents without a letter, or whose languages are too close, go.
- near_duplicates: of documents that links of 5-word shingle sets with a
  similarity of 0.8 or more connect, the one with the smallest id stays.
- decontaminate: documents that share a window with the benchmark go.
- tokenize: the ids of each text, as (doc_id, n_tokens, ids_sha256,
  decoded_sha256).

Null and empty texts go in the first stage.  An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import bpe, jaccard, langid, ratio, winnow
from lexweave.llm.queries import tokenizer_spec
from lexweave.llm.storage import id_remainder, materialize, prepare, table, with_row, without_rows


#: Temperature of the draw: what filters wants less noise than what samples.  With it a text of LENGTH n-grams weighs as
#: much against the noise as its mean log ratio a hundred times.
SHARPNESS = ratio.LENGTH / 100


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(prepare(spark), sf_dir, "labels")
    sampler, _ = ratio.resample(docs, "doc_id", "text", ratio.trusted_labels(labels), temperature=SHARPNESS, separate=True)
    return ratio.keep_drawn(docs, "doc_id", "text", sampler)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs, "text", "lang", id_remainder(F.col("doc_id"), 5) != 0)
    return langid.keep_identified(docs, "text", model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = with_row(docs)
    keyed = rows.select(F.struct(F.col("doc_id"), F.col(row).alias("row")).alias("key"), "text")
    found = jaccard.near_duplicates(keyed, "key", "text", k=5, percent=80)
    copies = found.where(F.col("key.row") != F.col("component_id.row")).select(F.col("key.row").alias(row))
    return without_rows(rows, row, materialize(copies, "copies"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, row = with_row(docs)
    found = winnow.decontaminate(rows, row, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return without_rows(rows, row, materialize(found.where("contaminated").select(row), "contaminated"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, "doc_id", "text", tokenizer_spec())


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: The first two stages have no SQL equivalent; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over ``documents``; the last one's rows."""
    docs = table(prepare(spark), sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
