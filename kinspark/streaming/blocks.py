"""Blocking of products that arrive in a stream: each micro-batch meets the bands stored so far and its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocking import band_rows


def incremental_candidates(signatures: DataFrame, n_hashes: int, rows: int, bands: int, bands_path: str, pairs_path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends the new pairs (i, j) of each batch to pairs_path and its bands to bands_path, by batch, so a
    batch that is run again overwrites what it wrote."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        new = band_rows(df, n_hashes, rows, bands).withColumn("hash", F.xxhash64("band", "key"))
        new.write.mode("overwrite").parquet(f"{bands_path}/batch={number}")
        known = spark.read.parquet(bands_path).where(F.col("batch") <= number)
        a, b = new.select("hash", "band", "key", F.col("pid").alias("p")), known.select("hash", F.col("band").alias("band2"), F.col("key").alias("key2"), F.col("pid").alias("q"))
        pairs = a.join(b, "hash").where("p <> q and band = band2 and key = key2").select(F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j")).distinct()
        pairs.write.mode("overwrite").parquet(f"{pairs_path}/batch={number}")

    return signatures.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
