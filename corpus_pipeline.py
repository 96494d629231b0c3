"""Training-data pipeline over documents: toxic documents go, then exact copies, then near copies; sources are mixed to
their weights, and what is left is encoded. Each stage reads what the one before has written.

Stages carry whole rows as one struct or under other names, so columns of any name pass through them unharmed. An empty table stays empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.llm.bpe import round_trip
from kinspark.llm.exact_dedup import exact_duplicates
from kinspark.llm.mixing import mixed
from kinspark.llm.near_dedup import near_duplicates
from kinspark.llm.queries import TOKENIZER
from kinspark.llm.toxicity import fit, score
from kinspark.llm.util import small, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores below 0.5. Null and empty texts get the bias alone, which is low, and stay; rows that repeat share
    a decision; a null id matters to training only, which leaves it out."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name clashes with those of scores
    scored = score(docs.toDF(*names.values()), model, text=names["text"], keep=tuple(names.values()))
    return scored.where("predicted = 0").select(*[F.col(n).alias(c) for c, n in names.items()])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (null counts as empty), the one with the smallest id; rows that repeat both id and text stay or go
    together. Rows without an id stay unless another with the same text has one."""
    gone = exact_duplicates(docs).where("not kept").select("doc_id", "text_sha256").distinct()
    gone = small(stored(gone, "copies-gone"))
    rows = docs.select(F.struct("*").alias("row")).select("row", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("sha"))
    return rows.join(gone, F.col("row.doc_id").eqNullSafe(gone.doc_id) & (F.col("sha") == gone.text_sha256), "left_anti").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-duplicates, the one with the smallest id. Rows without an id stay; rows that share an id share its
    class, and so a decision, whatever their texts. Null and empty texts are copies of each other only."""
    gone = small(stored(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "near-gone"))
    return docs.select(F.struct("*").alias("row")).join(gone, F.col("row.doc_id") == gone.doc_id, "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or up to three times. Null sources are one source; texts without
    words have size 0 and come only in certain copies."""
    return mixed(docs).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them, for each row; null texts count as empty and have no
    tokens. Other columns than doc_id and text end here."""
    return round_trip(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mix sources", mix_sources),
    ("BPE", encode_texts),
]

ORACLE_SQL = None  # trained scores, ProbMinHash and BPE have no SQL; tests/llm compares stages and the whole with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
