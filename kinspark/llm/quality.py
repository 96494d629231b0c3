"""Quality by importance resampling: hashed n-gram models of the target text and of all text give each document a log
ratio; Gumbel noise on top of it makes the k largest a sample without replacement in proportion to the ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as H
from .toxicity import LOWER_CODES
from .util import as_bytes, chunks, small, stored

BUCKETS = 10_000
SHARE = 0.25  # of all documents that the sample takes
SMOOTHING = 1.0


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of each word and each pair of words that follow one another in a text; ASCII letters in lower case."""
    first, last, begin = H.words(data, offsets)
    names = H.spans(H.running(data, LOWER_CODES), first, last)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(begin))
    pairs = H.mixed(names[:-1] * H.BASE + names[1:])[text[:-1] == text[1:]]
    return np.concatenate([text, text[:-1][text[:-1] == text[1:]]]), (np.concatenate([names, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        data, offsets = as_bytes(batch.column("text"))
        wanted = np.asarray(batch.column("target").to_pylist(), bool)
        for a, b in chunks(offsets):
            text, bucket = ngrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[wanted[a:b][text]], minlength=BUCKETS)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, target_ids: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and log_ratio (target model over raw model, summed over n-grams) of each row; texts without words have 0.
    target_ids: one column doc_id. All documents and all of the target's are counted."""
    ids = small(stored(target_ids.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct(), "quality-target"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    marked = rows.join(ids.withColumn("target", F.lit(True)), rows.doc_id == F.col("__id"), "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counts = marked.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.full(BUCKETS, SMOOTHING), np.full(BUCKETS, SMOOTHING)
    raw[counts["bucket"]] += counts["raw"]
    target[counts["bucket"]] += counts["target"]
    weights = docs.sparkSession.sparkContext.broadcast(np.log(target / target.sum()) - np.log(raw / raw.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            out = [np.zeros(0)]
            for a, b in chunks(offsets):
                of, bucket = ngrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out.append(np.bincount(of, weights.value[bucket], b - a))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out))], names=["doc_id", "log_ratio"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, log_ratio double")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise from the id and seed alone."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return -F.log(-F.log(u))


def largest(scored: DataFrame, k: int, key: str = "key", doc_id: str = "doc_id") -> Column:
    """Condition that exactly k rows of scored (stored; ids differ) meet: the largest key, ties to the smaller id. The border is
    found by counting in ever finer bins, so no sort of all rows is needed."""
    low, high, n = scored.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    if k >= n:
        return F.lit(True)
    if k <= 0:
        return F.lit(False)
    above = 0
    inside = n
    while inside > 20_000 and high > low:
        step = (high - low) / 1024
        bins = scored.where((F.col(key) >= low) & (F.col(key) <= high)).groupBy(F.least(F.floor((F.col(key) - low) / step), F.lit(1023)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        before = inside
        for b in sorted(bins.collect(), key=lambda r: -r["bin"]):
            if above + b["n"] >= k:
                low, high, inside = b["low"], b["high"], b["n"]
                break
            above += b["n"]
        if inside == before:
            break
    edge = scored.where((F.col(key) >= low) & (F.col(key) <= high)).orderBy(F.desc(key), F.asc(doc_id)).select(key, doc_id).limit(k - above)
    last_key, last_id = edge.orderBy(F.asc(key), F.desc(doc_id)).first()
    return (F.col(key) > last_key) | ((F.col(key) == last_key) & (F.col(doc_id) <= F.lit(last_id)))


def resample(docs: DataFrame, target_ids: DataFrame, share: float = SHARE, seed: int = 7, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, log_ratio, key (log_ratio plus Gumbel noise), selected (the share of rows with the largest keys,
    rounded to the nearest number). Rows that repeat an id have the same noise and, with equal texts, one fate, so they may
    exceed the share. A null id gets the noise of 0. Null text counts as empty. An empty table gives an empty result."""
    scored = log_ratios(docs, target_ids, text, doc_id)
    scored = stored(scored.withColumn("key", F.col("log_ratio") + gumbel(F.coalesce("doc_id", F.lit(0)), seed)), "quality-scored")
    chosen = largest(scored, round(share * scored.count()))
    return scored.select("*", F.coalesce(chosen, F.lit(False)).alias("selected"))
