"""The corpus pipeline: five stages over documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of documents, whatever other columns docs has; the last
returns packed pieces. An empty table goes through as an empty table; rows that
repeat are documents of their own until the simhash stage; null ids, languages
and sources are values like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.common import stored, table
from weirflow.llm.op01_packing import pack_documents, tokenizer_file
from weirflow.llm.op03_lines import line_dedup
from weirflow.llm.op05_simhash import near_duplicates, with_fingerprints
from weirflow.llm.op09_mixing import mix, word_count
from weirflow.llm.op10_language import UND, identify, learned

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null or empty text, no letter) go; lang
    becomes the language found, by whole texts of any length. A null lang
    teaches nothing; ties go to the language learned first."""
    found = identify(docs, learned(spark, sf_dir), keep=COLUMNS)
    return found.where(F.col("lang_pred") != UND).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave their documents, but for the one first in order of
    id and place; documents left without a line with a word go, and so do those
    that had none. n_chars counts the text that is left."""
    found = line_dedup(docs)
    kept = found.where(F.col("__lines") > F.col("__dropped"))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the
    least id (null if there is no other), and of rows that repeat it the one of least hash over
    all columns; rows equal in all columns stay as one. Texts without a word are
    one group."""
    prints = stored(with_fingerprints(docs.withColumn("row", F.xxhash64(*COLUMNS)), keep=("doc_id", "row")), "fingerprints")
    groups = near_duplicates(prints)
    least = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_fp").agg(F.min("row").alias("__row"))
    keys = least.select("__row").distinct()
    rows = docs.join(keys, F.xxhash64(*COLUMNS) == F.col("__row")).drop("__row")
    return rows.dropDuplicates(list(COLUMNS)).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole copies before the cut of
    the budget, and the one that crosses it, if more than half of it fits.
    Documents without a word go; a null source is a source of its own."""
    mixed = mix(docs, word_count(F.col("text")), F.col("source"), with_columns=COLUMNS)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(0))
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(0), copies))).where("__copy > 0").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All copies packed into sequences; an empty text is its end token."""
    return pack_documents(docs, tokenizer_file())


STAGES = [("language", language), ("lines", lines), ("simhash", simhash), ("mixing", mixing), ("packing", packing)]
#: Trained networks, hashes of texts and a tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
