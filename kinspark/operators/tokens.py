"""Token sets of products in three variants, their document frequencies and their encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import VARIANTS
from ..functions import text as T
from ..sources.catalogue import numbered


def _base(title: Column, features: Column) -> Column:
    values = F.filter(features, lambda f: F.coalesce(f["value"], F.lit("")) != "")
    return F.array_distinct(F.concat(T.title_tokens(title), F.flatten(F.transform(values, lambda f: T.measurement_tokens(f["value"])))))


def token_arrays(products: DataFrame) -> DataFrame:
    """pid with base, typed and combined token arrays.

    Typing suppresses numbers that ratios, dimension groups or mixed title tokens have used; of the others, each becomes its
    rounded value with a label, in combined beside itself. So combined doesn't hold all of base. Text work is done once for all
    products of the same title and features, over all shuffle partitions.
    """
    parts = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = products.select("pid", "title", "features").repartition(parts, "title", "features").groupBy("title", "features").agg(F.collect_list("pid").alias("pids"))
    x = x.select("pids", _base(F.col("title"), F.col("features")).alias("base"), T.contexts(F.col("title"), F.col("features")).alias("ctxs"))
    x = x.withColumn("ratios", T.ratios(F.col("ctxs"))).withColumn("dims", T.dimensions(F.col("ctxs")))
    x = x.withColumn("mixed", F.filter("base", lambda t: ~t.rlike(T.NUMBER))).withColumn("numbers", F.filter("base", lambda t: t.rlike(T.NUMBER)))

    def suffixed(t: Column) -> Column:
        return F.array_compact(F.array(*[F.when(F.regexp_like(t, F.lit(rf"(?i)^\d+{suffix}$")), F.struct(F.regexp_extract(t, r"^(\d+)", 1).alias("n"), F.lit(label).alias("unit"))) for suffix, label in T.SUFFIX_LABELS]))

    x = x.withColumn("typed_mixed", F.flatten(F.transform("mixed", suffixed)))
    used = F.concat(F.transform("ratios", lambda r: r["a"]), F.transform("ratios", lambda r: r["b"]), F.transform("dims", lambda d: d["n"]), F.transform("typed_mixed", lambda m: m["n"]))
    x = x.withColumn("free", F.array_except("numbers", used))

    # one array a step: an expression that a lambda uses twice would be evaluated twice
    x = x.withColumn("near", F.transform("free", lambda n: F.struct(n.alias("n"), T.number_contexts(n, F.col("ctxs")).alias("ctxs"))))
    x = x.withColumn("near", F.transform("near", lambda m: F.struct(F.coalesce(F.get(F.flatten(F.transform(m["ctxs"], T.fraction_values)), F.lit(0)), m["n"].cast("double")).alias("value"), m["ctxs"].alias("ctxs"))))
    x = x.withColumn("near", F.transform("near", lambda m: F.struct(T.round_half_up(m["value"]).cast("string").alias("n"), m["ctxs"].alias("ctxs"))))
    x = x.withColumn("typed_free", F.transform("near", lambda m: F.concat(m["n"], F.lit("_"), T.infer_label(m["n"], m["ctxs"]))))

    united = lambda a: F.transform(a, lambda m: F.concat(T.no_leading_zeros(m["n"]), F.lit("_"), m["unit"]))
    both = F.concat(F.transform("ratios", lambda r: F.concat(r["a"], F.lit(":"), r["b"], F.lit("_ratio"))), united("dims"), F.col("mixed"), united("typed_mixed"), F.col("typed_free"))
    x = x.withColumn("typed", F.array_distinct(both))
    x = x.select("pids", "base", "typed", F.array_union("typed", "free").alias("combined"))
    return x.select(F.explode("pids").alias("pid"), "base", "typed", "combined")


def exploded(arrays: DataFrame, column: str | Column, *keep: str) -> DataFrame:
    """keep and token, a row for each element of an array without nulls. The outer form with a filter behind it, since Spark puts a
    filter on the array's size before a plain explode and copies into it all that makes the array, many times over."""
    return arrays.select(*keep, F.explode_outer(column).alias("token")).where("token is not null")


def tokens(products: DataFrame, variant: str = "base", min_df: int = 1) -> DataFrame:
    """pid, token: distinct tokens of a variant; base tokens that fewer than min_df products have are dropped."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant: {variant}")
    out = exploded(token_arrays(products), variant, "pid")
    return min_df_filter(out, min_df) if variant == "base" and min_df > 1 else out


def all_tokens(products: DataFrame) -> DataFrame:
    """variant, pid, token for the three variants, from one pass over the products."""
    arrays = token_arrays(products).select("pid", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("tokens")) for v in VARIANTS])).alias("x"))
    return exploded(arrays.select("x.variant", "pid", F.col("x.tokens").alias("tokens")), "tokens", "variant", "pid")


def document_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def min_df_filter(tokens: DataFrame, min_df: int) -> DataFrame:
    return tokens.join(document_frequency(tokens).where(F.col("df") >= min_df), "token").select("pid", "token")


def vocabulary(tokens: DataFrame) -> DataFrame:
    """token, fid: numbers from 0 by the first product that has a token, then by the token's code points."""
    first = tokens.groupBy("token").agg(F.min("pid").alias("first_pid"))
    return numbered(first, ["first_pid", "token"], "fid").select("token", "fid")


def feature_sets(products: DataFrame, tokens: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """pid, fids: sorted feature numbers of each product, empty where it has no token."""
    vocab = vocabulary(tokens) if vocab is None else vocab
    sets = tokens.join(vocab, "token").groupBy("pid").agg(F.array_sort(F.collect_set("fid")).alias("fids"))
    return products.select("pid").join(sets, "pid", "left").select("pid", F.coalesce("fids", F.array().cast("array<bigint>")).alias("fids"))


def universe_size(sets: DataFrame) -> int:
    """Largest feature number plus 1; 1 without features."""
    return (sets.agg(F.max(F.array_max("fids"))).first()[0] or 0) + 1
