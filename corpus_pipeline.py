"""Corpus pipeline over ``documents``: language ID, SimHash near-dedup, suffix-array
dedup, PII redaction, best-fit packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but
the last return the columns of ``documents``, so a stage can be run on its own or swapped.
``run`` writes each stage as Parquet below the shared checkpoint folder and rereads it, so a
lost executor costs part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import shared_folder

MIN_SCORE = 0.5  # posterior below which no language is accepted
PASSAGE = 200  # bytes; a passage of 50 words is seldom shorter, texts of their own share no such string


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with an identified language; null texts, texts without a letter and
    texts without a clear language go. Fitted on the labelled rows of ``docs``."""
    from quarry.llm.language import identify

    found = identify(docs)(F.col("text").cast("string"))
    return docs.where((found["lang_pred"] != "und") & (found["score"] >= MIN_SCORE))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near-duplicates: the one with the smallest id
    (of rows that share the id but not the text, one of them), once if its row is repeated.
    Rows that share an id and belong to different groups are judged each by its own group.
    Rows without an id cannot be told apart and all stay."""
    from quarry.llm.common import checkpointed
    from quarry.llm.simhash import simhash_groups

    groups = simhash_groups(docs, shingle=4, max_bits=4).where("doc_id is not null")
    rows = groups.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("f"))
    first = checkpointed(first.select(F.col("f.doc_id").alias("__id"), F.col("f.text_hash").alias("__hash"), F.col("f.n").alias("__n")))
    own = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash"))
    once = docs.join(first.where("__n = 1"), own, "left_semi")
    again = docs.join(first.where("__n > 1"), own, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.union(again).union(docs.where("doc_id is null"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every string of ``PASSAGE`` bytes that also starts anywhere else out of the texts;
    ``n_chars`` follows the text. Rows stay, also where nothing is left of the text."""
    from quarry.llm.suffixes import remove_repeats

    return _with_text(remove_repeats(docs, min_bytes=PASSAGE, as_text=True), docs, F.col("kept"))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span of personal data by its kind in brackets; ``n_chars`` follows the text."""
    from quarry.llm.pii import find_pii, redacted

    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    found = find_pii(docs.select(rest.alias("row"), F.col("doc_id"), F.col("text").cast("string").alias("text")))
    return _with_text(found, docs, redacted(F.col("text"), F.col("spans")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 2048 tokens; one row per piece."""
    import public_tokenizers

    from quarry.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def _with_text(found: DataFrame, docs: DataFrame, text) -> DataFrame:
    """The columns of ``docs`` from the struct ``row`` of ``found``, with a new text."""
    found = found.select("row", text.alias("__text"))
    new = {"text": F.col("__text"), "n_chars": F.length("__text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("pii_redaction", pii_redaction),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints, models and packing are beyond SQL; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of a folder of tables; the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = shared_folder(spark, "corpus-pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
