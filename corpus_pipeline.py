"""A training-data pipeline over `documents`: language ID, exact dedup, near dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and
reads it again as the docs of the next. All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packlens.llm import dedup, jaccard, langid, packing, pii
from packlens.llm.common import documents, written
from packlens.session import ship


NEEDED = ("doc_id", "text", "lang", "source", "n_chars")


def plain(docs: DataFrame) -> DataFrame:
    """docs with every column that no stage needs under a name that clashes with nothing."""
    return docs.toDF(*[c if c in NEEDED else f"extra_{i}" for i, c in enumerate(docs.columns)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models reject (null or empty texts, no letters, or unlike every language) go. Rows
    with null ids or languages are judged like all others; repeated rows are judged alike. Without any labelled text
    every document goes."""
    ship(spark)
    rows = plain(docs)
    model = langid.train(rows.select(F.col("doc_id").alias("id"), "text", "lang"))
    judged = langid.predicted(rows, model, keep=rows.columns)
    return judged.filter(~F.col("__rejected")).select(*rows.columns).toDF(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space stays: the longest, then the smallest id, of
    repeated rows with that id the first by a hash of the text. Null texts equal empty ones. Rows without an id stay."""
    ship(spark)
    rows = plain(docs)
    named = rows.filter("doc_id is not null")
    kept = dedup.exact_groups(named).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), dedup.WHITE.decode(), ""), 256)
    met = named.withColumns({"__id": F.col("doc_id"), "__sha": sha}).join(kept.hint("merge"), ["__id", "__sha"], "left_semi")
    first = Window.partitionBy("__id", "__sha").orderBy(F.length("text").desc_nulls_last(), F.xxhash64("text"))
    one = met.withColumn("__row", F.row_number().over(first)).filter("__row = 1").select(*rows.columns)
    return one.union(rows.filter("doc_id is null")).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of linked texts stays: five-word shingles, Jaccard 0.8. Rows of one id
    are one document. Null and empty texts link with nothing and stay, as do rows without an id."""
    rows = plain(docs)
    found = jaccard.jaccard_components(rows, words=5, percent=80)
    stay = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    one = rows.withColumn("__id", F.col("doc_id")).join(stay.hint("merge"), "__id", "left_semi").select(*rows.columns)
    return one.union(rows.filter("doc_id is null")).toDF(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in text gives way to its kind in brackets; n_chars follows. Every row stays; null texts stay null."""
    rows = plain(docs)
    found = pii.personal_data(rows).select(F.col("doc_id").alias("__own"), F.col("th").alias("__th"), F.col("spans").alias("__spans"))
    found = found.filter(F.size("__spans") > 0).dropDuplicates(["__own", "__th"]).withColumnRenamed("__th", "__hash")
    named = rows.withColumns({"__id": F.col("doc_id"), "__th": F.xxhash64(F.coalesce("text", F.lit("")))})
    met = named.join(found.hint("merge"), F.col("__id").eqNullSafe(F.col("__own")) & (F.col("__th") == F.col("__hash")), "left")
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(pii.masked(F.col("text"), F.col("__spans")))
    out = met.withColumn("text", text)
    if "n_chars" in rows.columns:
        out = out.withColumn("n_chars", F.length("text").cast(rows.schema["n_chars"].dataType))
    return out.select(*rows.columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, mixed by source. A null source is the empty one, a null text empty."""
    ship(spark)
    return packing.packed_pieces(plain(docs))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
