"""Corpus pipeline: language, near duplicates, benchmark passages, secrets, tokens.

Each stage gets the rows that the one before kept; all but the last return the columns of ``documents``.
Every stage gives an empty table for an empty one, and takes any further columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlab.llm import bpe, contamination, language, secrets, simhash
from screenlab.llm.queries import pattern, vocabulary
from screenlab.llm.store import discard, numbered, staged, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language at even odds or better; text without a letter and null text go.

    Rows without a language are judged but not learned from; repeated rows stay or go together.
    """
    inner = numbered(docs)
    found = language.identify(inner, language.models(docs), inner.columns, text=f"__c{docs.columns.index('text')}")
    return found.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= 0.5)).select(*inner.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the first by doc_id, fingerprint and digest of the text; rows without an id come last.

    Groups are told apart by their root, so ids that repeat with other texts do not mix them. Texts without
    words, null ones included, are one group.
    """
    digest = F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    # one key that is never null, so the join and what follows it deal the texts out once
    marked_docs = docs.withColumn("__key", F.md5(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), digest), "utf-8")))
    marked = simhash.near_duplicates(marked_docs, ["doc_id", "__key"], root=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "__fp", "__key")).alias("f")
    chosen = marked.groupBy("__root").agg(first).select(F.col("f.__key").alias("__key"))
    # rows of one id and text are cut to one where they are read, so however many there are, a task sends one on
    return marked_docs.dropDuplicates(["__key"]).join(chosen, "__key", "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that benchmark passages do not make up a twentieth of; null and empty texts stay, repeated rows stay or go together."""
    columns = docs.columns
    inner = numbered(docs)
    text = f"__c{columns.index('text')}"
    found = contamination.decontaminate(inner, table(spark, sf_dir, "benchmark"), inner.columns, text=text)
    return found.filter("NOT contaminated").select(*inner.columns).toDF(*columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their text replaced by a mark, n_chars counted anew where the text changed.

    Null and empty texts stay as they are, and repeated rows are changed alike.
    """
    columns = docs.columns
    before = docs.withColumn("__before", F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8")))
    rows = secrets.redact_secrets(before)
    if "n_chars" in columns:
        changed = F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8")) != F.col("__before")
        rows = rows.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and what byte-level BPE makes of the text; null and empty texts have no tokens, repeated rows come as often as they stand.

    Smaller tables than by itself, as the workers of other stages share the memory.
    """
    return bpe.encode_texts(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), pattern(), ["doc_id"], ["n_tokens", "token_ids", "ids_sha256", "decoded_sha256"], words_kept=300_000, max_states=60_000)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("hide_secrets", hide_secrets), ("tokenize", tokenize)]

#: SQL cannot express the language model, SimHash or byte-pair merging: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
            discard(before)
    return docs
