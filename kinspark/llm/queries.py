"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import round_trip
from .exact_dedup import exact_duplicates
from .licenses import oracle as licence_sql
from .licenses import scan_licences
from .lm import lm_scores
from .mixing import SQL as mix_sql
from .mixing import mix
from .near_dedup import near_duplicates
from .quality import resample
from .suffix_dedup import repeated_passages
from .topk import top_k
from .toxicity import toxicity

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_documents(spark, sf_dir), keep="largest")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_documents(spark, sf_dir), TOKENIZER)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(_documents(spark, sf_dir))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return resample(_documents(spark, sf_dir), good)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_documents(spark, sf_dir))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_documents(spark, sf_dir), TOKENIZER)


QUERIES = {
    "op8_lm_score": op8,
    "op1_suffix_dedup": op1,
    "op3_licenses": op3,
    "op7_topk": op7,
    "op10_quality": op10,
    "pipeline": pipeline,
    "op4_near_dedup": op4,
    "op2_bpe": op2,
    "op5_toxicity": op5,
    "op6_mix_sources": op6,
    "op9_exact_dedup": op9,
}

SQL = {
    "op3_licenses": licence_sql(),
    "op6_mix_sources": mix_sql,
    "op7_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        q AS (SELECT DISTINCT ON (vec_id) vec_id AS query_id, v AS q FROM v WHERE vec_id % 100 = 0 ORDER BY vec_id, v),
        s AS (SELECT query_id, vec_id, CAST(list_sum(list_transform(list_zip(q, v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM q JOIN v ON vec_id <> query_id AND len(q) = len(v)),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
