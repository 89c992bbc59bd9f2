"""The registered queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_simhash_dedup(spark, sf_dir):
    from .simhash import simhash_groups

    return simhash_groups(_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


@_query
def op10_suffix_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    from .suffixes import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), min_bytes=400)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


@_query
def op4_language_id(spark, sf_dir):
    from .language import language_table

    return language_table(_table(spark, sf_dir, "documents"))


@_query
def op2_byte_bpe(spark, sf_dir):
    import public_tokenizers
    from pyspark.sql import functions as F

    from .bytebpe import decode_table, encode_table

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = decode_table(encode_table(_table(spark, sf_dir, "documents"), ranks), ranks)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@_query
def op5_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


@_query
def op6_token_files(spark, sf_dir):
    import public_tokenizers

    from .common import shared_folder
    from .tokenfiles import read_token_files, write_token_files

    files = write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), shared_folder(spark, "token-files"), end_id=1)
    return read_token_files(files, with_ids=False)


@_query
def op8_exact_topk(spark, sf_dir):
    from pyspark.sql import functions as F

    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op8_exact_topk"] = """
with usable as (
    select row_number() over () as uid, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
    from embeddings
    where vec_id is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
    select q.uid, q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
    from usable q join usable c on q.uid <> c.uid
    where q.vec_id % 50 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by uid order by score desc, vec_id) as rank from scored)
where rank <= 5
"""


@_query
def op7_embedding_dedup(spark, sf_dir):
    from .pivots import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


@_query
def op3_pii(spark, sf_dir):
    from .pii import pii_table

    return pii_table(_table(spark, sf_dir, "documents"))


@_query
def op9_secret_scan(spark, sf_dir):
    from .secrets import secret_table

    return secret_table(_table(spark, sf_dir, "documents"))


@_query
def op11_quality_classifier(spark, sf_dir):
    from .quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op12_filter_audit(spark, sf_dir):
    from .audit import filter_audit

    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op13_merkle_manifest(spark, sf_dir):
    from .merkle import manifest_table

    return manifest_table(_table(spark, sf_dir, "documents"))


def _add_oracles():
    from . import audit, merkle

    ORACLES["op12_filter_audit"] = audit.oracle()
    ORACLES["op13_merkle_manifest"] = merkle.ORACLE


_add_oracles()
