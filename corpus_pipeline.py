"""From raw documents to token ids: each stage takes what the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hedera.llm import lines, mixing, near, pieces, toxicity
from hedera.llm.common import table, written

#: Documents with a score of this or more go.
TOXIC = 0.7


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below TOXIC. The classifier learns from the labelled rows that op6 learns from.

    Null and blank texts have a score too and stay; repeated rows are judged alike; extra columns stay, but for one named
    score. An empty table gives an empty one.
    """
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(toxicity._learnable(F.col("doc_id"))))
    return toxicity.scored(docs, model).where(F.col("score") < TOXIC).select(*(F.col(f"`{c}`") for c in docs.columns))


def unlined(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites stay only in their first place; documents of which nothing is left go. n_chars follows the text.

    Null and blank texts have no line to lose and stay; repeated rows are cut alike; extra columns stay. An empty table gives
    an empty one.
    """
    out = lines.line_deduped(docs)
    out = out.where((F.col("n_removed") == 0) | (F.regexp_replace("text", r"[\x20\x09-\x0D]+", "") != ""))
    return out.select(*(F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def _whole(docs: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest doc_id (null last), and of those the one with the smallest hash.

    Of rows equal in doc_id and text one stays, also of those without a shingle, which are in no class. A null doc_id is as
    good as any: a class that has no other keeps one of them. Extra columns stay, whatever their names; an empty table gives
    an empty one.
    """
    named = near.classes(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")).alias("first")
    stay = named.where("comp is not null").groupBy("comp").agg(first).select("first.doc_id", "first.row").union(named.where("comp is null").select("doc_id", "row"))
    stay = stay.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    rows = docs.select(_whole(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"))
    kept = rows.join(stay, (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    return kept.dropDuplicates(["id", "row"]).select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; of rows equal in doc_id, source and text one stands for all.

    Null texts and sources, blank texts and repeated rows are taken as mixing.mixed says. Extra columns stay, whatever their
    names; an empty table gives an empty one.
    """
    taken = mixing.mixed(docs).groupBy(F.col("tag").alias("_tag"), F.col("doc_id").alias("_id")).agg(F.sum("copies").alias("copies")).where("copies > 0")
    rows = docs.select(_whole(docs), F.col("doc_id").alias("id"), F.xxhash64("doc_id", F.col("source").cast("string"), "text").alias("tag")).dropDuplicates(["id", "tag"])
    rows = rows.join(taken, (F.col("tag") == F.col("_tag")) & F.col("id").eqNullSafe(F.col("_id")))
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and token ids of each row; null and empty texts have none. An empty table gives an empty one."""
    return pieces.encoded(docs.select("doc_id", "source", "text"), pieces.model_bytes()).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", clean), ("line dedup", unlined), ("n-gram Jaccard join", distinct), ("mixing", mix), ("SentencePiece", tokens)]

#: Mixing and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
