"""Exact deduplication by content sort, in DataFrame operations only.

Sampled splitters cut the order of (first bytes, hash of the whole, id) into ranges of about equal row counts, so that
a large group of copies is dealt over neighbouring ranges instead of one task. Each range is sorted externally by
the whole text, and neighbours are compared in full. Groups that a splitter cuts are put together afterwards from
one row for each range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import partitions, small, stored

PREFIX_BYTES = 24
SAMPLES_PER_RANGE = 40


def _at_or_before(splitters: Column, n: int, key: Column) -> Column:
    """How many of n sorted splitters are <= key, by binary search."""
    steps = [2**i for i in reversed(range(max(1, math.ceil(math.log2(n + 1)))))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda found, step: F.when((found + step <= n) & (F.element_at(splitters, F.least(found + step, F.lit(n))) <= key), found + step).otherwise(found),
    )


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "smallest", normalise=lambda c: c) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when normalise(text) is the same, byte for byte. keep: "smallest" or "largest" id of a group stays.
    Null text counts as empty; empty texts are copies of each other. Rows that repeat an id and a text are each counted and
    share one decision. A null id loses to any other; a group of null ids only has a null keep_id and keeps all its rows.
    Other columns of docs are ignored, whatever their names. An empty table gives an empty result.
    """
    n = partitions(docs.sparkSession)
    best = F.max if keep == "largest" else F.min
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalise(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    rows = rows.select("doc_id", "t", F.struct(F.hex(F.substring(F.encode("t", "UTF-8"), 1, PREFIX_BYTES)).alias("p"), F.xxhash64("t").alias("h"), F.coalesce("doc_id", F.lit(-(2**63))).alias("d")).alias("key"))
    share = min(1.0, SAMPLES_PER_RANGE * n / max(1, docs.count()))  # so the driver gets as many keys as there are ranges, times a constant
    sample = sorted(tuple(r[0]) for r in rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("key").collect())
    cuts = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    if cuts:
        splitters = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(h).cast("long").alias("h"), F.lit(d).cast("long").alias("d")) for p, h, d in cuts])
        rows = rows.withColumn("b", _at_or_before(splitters, len(cuts), F.col("key")))
        same = lambda i: (F.get(splitters, i)["p"] == F.col("key.p")) & (F.get(splitters, i)["h"] == F.col("key.h"))
        rows = rows.withColumn("cut", F.coalesce(same(F.col("b") - 1), F.lit(False)) | F.coalesce(same(F.col("b")), F.lit(False)))
    else:
        rows = rows.select("*", F.lit(0).alias("b"), F.lit(False).alias("cut"))
    rows = rows.drop("key").repartitionById(n, F.col("b"))

    sorted_range = Window.partitionBy("b").orderBy("t", "doc_id")
    rows = rows.withColumn("first", ~F.lag("t").over(sorted_range).eqNullSafe(F.col("t")))
    rows = rows.withColumn("run", F.sum(F.col("first").cast("long")).over(sorted_range.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.select("doc_id", "b", "run", "cut", "first", F.sha2("t", 256).alias("text_sha256"), F.when(F.col("cut") & F.col("first"), F.col("t")).alias("cut_text"))
    run = Window.partitionBy("b", "run")
    runs = stored(rows.select("*", F.count(F.lit(1)).over(run).alias("n"), best("doc_id").over(run).alias("best")), "exact-runs")

    heads = runs.where("cut and first").select("b", "run", "text_sha256", "cut_text", "n", "best")
    whole = heads.groupBy("text_sha256", "cut_text").agg(F.sum("n").alias("all_n"), best("best").alias("all_best"))
    joined = stored(heads.join(whole, ["text_sha256", "cut_text"]).select("b", "run", "all_n", "all_best"), "exact-cut")
    out = runs.join(small(joined), ["b", "run"], "left")
    keep_id = F.coalesce("all_best", "best")
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("all_n", "n").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")
