"""From raw documents to token ids: each stage is a table, written and read again before the next one starts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrylog.llm import bpe, learning, minhash, mixing, quality, secrets
from ferrylog.llm.common import free_name, table
from ferrylog.llm.queries import LEAST_SCORE, OTHER_WEIGHT, RANKS, SEED, WEIGHTS
from ferrylog.session import materialise, new_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier, trained on the labelled documents outside its held-out fold, rejects.

    Null and empty texts have the classifier's constant as their score. Repeated rows stay repeated.
    """
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), learning.fold("doc_id", 5) != 0)
    rows = docs.select(F.struct("*").alias("row"), "text")
    return quality.score(rows, weights, ("row",)).where(F.col("score") >= LEAST_SCORE).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; all its columns do, whatever their names.

    Null and empty texts, texts of blanks and rows without an id all stay; of rows that repeat an id and a text one does, be the text empty
    or very long. An empty table stays empty.
    """
    return minhash.without_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; documents and their columns stay, whatever their names. ``n_chars`` follows texts that change.

    Null texts stay null and empty ones empty; equal rows stay equal rows, and an empty table stays empty.
    """
    ledger, spans = new_path(spark, "ledger"), free_name(docs, "_found")
    secrets.scan_into(docs, ledger)
    found = secrets.with_findings(docs, ledger, found=spans, merged=True)
    if "n_chars" not in docs.columns:
        return secrets.redact(found, found=spans)
    changed = F.struct((F.size(spans) > 0).alias("changed"), F.col("n_chars").alias("n"))
    after = secrets.redact(found.withColumn("n_chars", changed), found=spans)
    return after.withColumn("n_chars", F.when(F.col("n_chars.changed"), F.length("text").cast("long")).otherwise(F.col("n_chars.n")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and shuffle documents so that sources have their target weights; a document may come zero or more times.

    Sources that no weight names, null among them, share one. Null and empty texts have no size of their own but are repeated like the
    rest of their source, unless all of it is empty: then it goes. Rows of one id are repeated alike, and a null id counts as the empty one.
    All columns stay, whatever their names; an empty table stays empty.
    """
    copy, key = free_name(docs, "mix_copy"), free_name(docs, "mix_key")
    return mixing.mix_sources(docs, WEIGHTS, rest=OTHER_WEIGHT, seed=SEED, copy=copy, key=key).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source``, the token ids of each whole text, and digests of the ids and of what they decode to.

    A null or empty text, or a very long one, is a row like any other (no ids for the first two); nulls in other columns and repeated rows
    stay. Other columns, whatever their names, end here. An empty table gives an empty table.
    """
    return bpe.tokens(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, carried=("doc_id", "lang", "source"))


STAGES = [
    ("quality_classifier", keep_good),
    ("minhash_near_dedup", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix),
    ("byte_bpe", tokenize),
]
#: Trained scores and token ids are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
