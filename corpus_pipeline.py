"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and returns a DataFrame; run()
writes each result as Parquet in the shared folder and reads it again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxrecon.llm import language, line_dedup, mixing, near_dedup, packing
from taxrecon.llm.common import hash128, importable, table, written
from taxrecon.llm.tokens import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text in any language (no letter, or null) go; a null lang becomes the prediction. Rows with
    equal or null doc_ids are judged one by one, texts of any length whole; no rows give none; other columns don't go on."""
    importable(spark)
    found = language.identify(docs.select(*COLUMNS), docs)
    return found.filter("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows go from the texts, and with them documents of which nothing is left. Rows without a
    doc_id, and texts of fewer lines, stay as they are; texts of any length are read whole; no rows give none."""
    cleaned = line_dedup.line_dedup(docs.select(*COLUMNS))
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"\S")
    return cleaned.filter(left).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays, once; a document is a row's
    doc_id and text, so other texts under one doc_id stay. Documents without a doc_id stay, as nothing tells
    them apart. Texts of any length are compared whole; no rows give none."""
    importable(spark)
    # Written, so that the numbers of the rows stay as they are.
    rows = written(docs.filter("doc_id is not null").select(*COLUMNS, F.monotonically_increasing_id().alias("k"), *(h.alias(f"h{i}") for i, h in enumerate(hash128(F.col("text"))))))
    classes = near_dedup.jaccard_classes(rows.select("k", "text"), key="k", characters=None).select("k", "class_id")
    place = F.struct("doc_id", "h0", "h1", "k")
    first = rows.select("k", "doc_id", "h0", "h1").join(classes, "k").groupBy("class_id").agg(F.min(place).alias("s")).select("s.*")
    # Texts without words are classes of their own, even in equal rows.
    keep = first.groupBy("doc_id", "h0", "h1").agg(F.min("k").alias("k")).select("k")
    named = rows.join(keep, "k").select(*COLUMNS)
    return named.unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes its words, rounded: not at all, once, or up to three times. Rows are told apart
    by a number of their own, so equal or null doc_ids don't matter. Rows without words go, as none are taken; a text of any
    length counts whole; no rows give none."""
    k = "__row"
    # Written, so that the numbers of the rows stay as they are.
    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias(k)))
    times = mixing.mixed(rows, carry=(k,)).select(k, F.expr("if(size = 0, 0, (2 * taken + size) div (2 * size))").alias("times"))
    joined = rows.join(times, k).filter("times > 0")
    return joined.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences with their token ids. A row that is there several times is packed as often; null and empty
    texts are the end id alone; null doc_ids stay null; texts of any length are packed whole; no rows give none."""
    importable(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("mix_sources", mix), ("pack", pack)]

#: SQL has neither suffix automata nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
