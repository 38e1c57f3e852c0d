"""A corpus pipeline in five stages over the table documents, each written as Parquet and read again by the next.

1. language: documents whose text has no letter, or is in no learned language (less familiar to the model than the limit that it draws from
   text of these languages), go;
2. near_duplicates: of each class of documents linked by five-word shingles at a similarity of 0.8, that with the smallest doc_id stays;
3. secrets: every span that the scan finds is replaced;
4. mixture: each source's documents are repeated towards TARGETS, weights by source that are scaled by the square root of its size, at
   the input's total, and the result is shuffled globally; a mean repetition of r leaves out the share exp(-r), which is this operator's nature;
5. packing: documents become token pieces of sequences.

Edge cases: null and empty texts are rejected by the first stage; texts of any length are worked on whole; ties and repeated rows: the second stage compares
rows, whatever their ids: rows that share a doc_id or have none go only if their text is in the class of a row that stays (ids before
null, then the least text); an empty table gives an empty result; columns beside those of documents are kept by the first four stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickweave.llm.common import Scratch, fresh, join_on_key, table
from clickweave.llm.jaccard import JaccardParams, link_documents
from clickweave.llm.langid import predict_langid, train_langid
from clickweave.llm.mixing import MixParams, replicate
from clickweave.llm.packing import PackParams, pack_documents
from clickweave.llm.secrets import labelled_samples, redact, train_markov

#: Target weights by source before they are scaled by its size; sources that aren't named have DEFAULT_TARGET.
TARGETS: dict[str, float] = {"src0": 0.5, "src1": 2.0, "src2": 1.5}
DEFAULT_TARGET = 1.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = fresh("_lang", docs.columns), fresh("_score", docs.columns), fresh("_familiar", docs.columns)
    judged = predict_langid(docs, train_langid(docs), keep=tuple(docs.columns), names=names)
    return judged.filter((F.col(names[0]) != "und") & F.col(names[2])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch, key, doc_id = Scratch(spark), fresh("_row", docs.columns), F.col("doc_id").cast("long")
    unique = docs.groupBy(doc_id.alias("id")).count().filter("count > 1 OR id IS NULL").isEmpty()
    # ids that repeat or are missing don't tell rows apart: then every row gets a number of its own
    rows = docs.withColumn(key, doc_id) if unique else scratch.save(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    linked = scratch.save(link_documents(rows.select(F.col(key).alias("doc_id"), "text"), JaccardParams()).select(F.col("doc_id").alias(key), "n_shingles", "component_id"), "linked")
    if unique:
        gone = linked.filter(F.col("component_id") != F.col(key)).select(key)
    else:
        # of a class the row with the least id stays, null last, then that with the least text; texts without words are classes by id and text
        by = [F.when(F.col("n_shingles") > 0, F.col("component_id")), *(F.when(F.col("n_shingles") == 0, F.col(c)) for c in ("doc_id", "text"))]
        least = F.min(F.struct(F.isnull("doc_id"), doc_id, "text", F.col(key).alias("row")))["row"].alias(key)
        kept = rows.select(key, "doc_id", "text").join(linked, key).groupBy(*by).agg(least).select(key)
        gone = scratch.save(linked.select(key).join(kept, key, "left_anti"), "gone")
    return join_on_key(rows, gone, key, "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs, train_markov(labelled_samples(docs)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names, source = (fresh("_copy", docs.columns), fresh("_order", docs.columns)), F.coalesce(F.col("source").cast("string"), F.lit(""))
    target = F.lit(DEFAULT_TARGET)
    for name, weight in TARGETS.items():
        target = F.when(F.col("source") == name, weight).otherwise(target)
    weights = docs.groupBy(source.alias("source")).agg(F.sqrt(F.count("*")).alias("weight")).withColumn("weight", F.col("weight") * target)
    return replicate(docs, MixParams(), weights, names=names).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, PackParams())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("packing", packing),
]

#: No stage but the mixture is expressible in SQL; tests hold the rest against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs, before = Scratch(spark), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(before)  # what the next stage has read whole
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
