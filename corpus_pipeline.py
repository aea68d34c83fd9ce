"""Corpus pipeline: toxicity, quality, near-duplicates, benchmark decontamination, tokens.

Each stage works on all that its predecessor kept and is written as Parquet before the next one reads it.
All stages but the last return the columns they were given. Empty inputs pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewatch.llm import bpe, quality, tiling, toxicity
from slicewatch.llm.common import cut_lineage, free_name, table
from slicewatch.llm.neardup import NearDup, near_duplicates
from slicewatch.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted lexicon rejects go; the lexicon is learned from the labels."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(lexicon, F.col("text"), spark) < toxicity.Learning.threshold)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; all stay if the labels hold one class or none, since
    nothing was learned to reject by."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    if not model.learned:
        return docs
    return docs.filter(quality.score_column(model, F.col("text"), spark) >= model.params.threshold)


def _ids_missing_or_repeated(docs: DataFrame) -> bool:
    odd = docs.groupBy("doc_id").count().filter("doc_id is null or count > 1")
    return not odd.isEmpty()


def _with_row_keys(docs: DataFrame) -> tuple[str, DataFrame]:
    """A key of its own for every row, written once so that all later reads see the same keys."""
    row = free_name(docs.columns, "row_key")
    return row, cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8 or more): the one
    with the smallest id. Where ids are missing or repeat, every row is a document of its own: rows of one id
    go for equal or linked texts alone, and rows without an id are compared like any other."""
    if not _ids_missing_or_repeated(docs):
        found = near_duplicates(docs, NearDup(shingle=5), unique_ids=True)
        other = free_name(docs.columns, "other_id")
        gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias(other))
        return docs.join(gone, F.col("doc_id") == F.col(other), "left_anti")
    row, keyed = _with_row_keys(docs)
    found = cut_lineage(near_duplicates(keyed, NearDup(shingle=5), doc_id=row, unique_ids=True).select(
        F.col("doc_id").alias("key"), "n_shingles", "component_id"), "row_groups")
    rows = keyed.select(F.col(row).alias("key"), "doc_id", "text").join(found, "key")
    # smallest id of a group, ids before none; among rows of that id by text, so the choice is the tables' own
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "key"))
    linked = rows.filter("n_shingles > 0").groupBy("component_id").agg(first.alias("top")).select("top.key")
    wordless = rows.filter("n_shingles = 0")  # these link with nothing: one row per id and equal text, all without an id
    same = wordless.filter("doc_id is not null").groupBy("doc_id", "text").agg(F.min("key").alias("key")).select("key")
    stays = linked.unionByName(same).unionByName(wordless.filter("doc_id is null").select("key"))
    other = free_name(keyed.columns, "other_id")
    return keyed.join(stays.select(F.col("key").alias(other)), F.col(row) == F.col(other), "left_semi").drop(row)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item go; where ids are missing or repeat, every row is judged
    by its own text."""
    row, keyed = _with_row_keys(docs) if _ids_missing_or_repeated(docs) else ("doc_id", docs)
    found = tiling.decontaminate(keyed, table(spark, sf_dir, "benchmark"), doc_id=row)
    other = free_name(keyed.columns, "other_id")
    gone = found.filter("contaminated").select(F.col("doc_id").alias(other)).distinct()
    kept = keyed.join(gone, F.col(row) == F.col(other), "left_anti")
    return kept if row == "doc_id" else kept.drop(row)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of what they decode to."""
    path = tokenizer_path()
    coded = bpe.encode(docs, path).withColumn("n_tokens", F.size("ids").cast("long"))
    return bpe.decode(coded, path, keep_ids=True).select(
        "doc_id", "n_tokens", F.col("ids").alias("token_ids"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_dedup", near_dedup),
          ("decontamination", decontaminate), ("tokens", tokens)]
#: No SQL expresses the classifiers and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
