"""Which rows a model may learn from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, label: str, most: int, longest: int) -> DataFrame:
    """``turn, label, text`` of at most ``most`` ids that have a label and for which ``learn`` (of ``doc_id``) holds.

    Ids are taken in the order of a hash, which ``turn`` is; texts longer than ``longest`` characters are not learned
    from. An id labelled more than once counts with its mean label (one half counts as 0), null labels and ids not at
    all; documents that share an id share its label. At most ``most`` ids are broadcast.
    """
    given = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_label")).where("_id IS NOT NULL AND _label IS NOT NULL")
    known = given.groupBy("_id").agg(F.avg("_label").alias("_label")).withColumnRenamed("_id", "doc_id").where(learn)
    ids = known.select(F.col("doc_id").alias("_id"), (F.col("_label") > 0.5).cast("int").alias("label"), F.xxhash64("doc_id").alias("turn")).orderBy("turn", "_id").limit(most)
    texts = docs.select(F.col("doc_id").alias("_doc"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where(F.length("text") <= longest)
    return texts.join(F.broadcast(ids), F.col("_doc") == F.col("_id")).select("turn", "label", "text")
