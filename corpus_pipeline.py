"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapweave.llm import jaccard, packing, pii, quality, substrings
from snapweave.llm._common import anti_join, bitmap_filter, mark, new_path, release, table, written

_MARK = "mark_of_text_"


def _marked(docs: DataFrame) -> DataFrame:
    """Adds ``mark_of_text_``, a document's id and digest of text: ids may be null, or repeat with another text."""
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return docs.withColumn(_MARK, F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), digest))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the perplexity bands keep."""
    marked = _marked(docs)
    gone = written(quality.judge(marked, [_MARK]).where("not kept").select(_MARK).distinct(), "gone")
    return anti_join(marked, gone, _MARK).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows joined by links of 80 % similarity, one: that of the smallest id (null last), and of the smallest digest where texts share the id."""
    marked = _marked(docs)
    found = jaccard.groups(marked, mark_col=_MARK).where("component is not null").select("component", "doc_id", F.col("mark").alias(_MARK))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", _MARK)
    first = written(found.groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "first")
    members = written(found.join(first, "component").select(_MARK, (place == F.col("first")).alias("stays")), "members")
    rest = anti_join(marked, written(members.where("not stays").select(_MARK).distinct(), "gone"), _MARK)
    # rows that are equal in id and text are one document: one of them stays
    twice = written(members.where("stays").groupBy(_MARK).agg(F.count("*").alias("rows")).where("rows > 1").select(_MARK), "twice")
    if not twice.isEmpty():
        once = bitmap_filter(rest, twice, _MARK).join(twice, _MARK, "left_semi").dropDuplicates([_MARK])
        rest = anti_join(rest, twice, _MARK).unionByName(once)
    return rest.select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that started earlier; one that has nothing else left stays, empty."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = substrings.remove(docs, tuple(rest), with_text=True).withColumnRenamed("kept_text", "text")
    return _counted(out, docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data and secrets."""
    rest = [c for c in docs.columns if c != "text"]
    return _counted(pii.replace(docs, carry=tuple(rest)), docs)


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("private_data", private_data), ("packing", packed)]
#: Perplexities, suffix arrays, keyed surrogates and token ids are beyond SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again; what a stage leaves in the shared folder besides goes once its rows are stored."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(spark, since, keep=[path])
    return STAGES[-1][1](spark, docs, sf_dir)
