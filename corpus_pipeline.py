"""A corpus pipeline over documents: language ID, line dedup, near dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on every row it is given and returns a DataFrame, which is written and read
again before the next. All but the last return the columns of documents: rows that a stage rejects go, text that it cuts
goes, n_chars follows the text. Null and empty texts have no language and go in the first stage; any other row of a null
doc_id passes the rest of the stages unmatched. The last stage adds tokens, n_tokens and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import bpe, decontaminate, language, line_dedup, near_dedup, textkit


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those that docs are labelled with; the others go."""
    return language.accepted(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated runs of lines; one that has no other lines goes."""
    return line_dedup.deduplicate(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    return near_dedup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that they share with the benchmark; one without any other word goes."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their byte-level BPE tokens and the text that these decode to."""
    return bpe.tokenise(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_deduplication), ("near_dedup", near_deduplication), ("decontamination", decontamination), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents. The results between stages are Parquet in the shared folder; a stage's result and
    what it kept on the way are removed once the next has been written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        out, since = textkit.new_folder(spark, "pipeline"), textkit.mark(spark)
        stage(spark, docs, sf_dir).write.parquet(out)
        textkit.release(spark, since)
        docs = spark.read.parquet(out)
        if before:
            textkit.remove(spark, before)
        before = out
    return docs


#: Language centroids and simple words' merges are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None
