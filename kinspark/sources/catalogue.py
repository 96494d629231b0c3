"""Catalogues of products from several shops, and what is written about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip

FEATURES = "array<struct<pos:int,key:string,value:string>>"
VARIANT = "array<struct<modelID:string,title:string,shop:string,url:string,featuresMap:string,raw:string>>"


def feature_list(json_map: Column) -> Column:
    """Attributes in their order of appearance; a missing map is empty."""
    entries = F.map_entries(F.from_json(F.coalesce(json_map, F.lit("{}")), "map<string,string>"))
    return F.coalesce(F.transform(entries, lambda e, i: F.struct(i.cast("int").alias("pos"), e["key"].alias("key"), e["value"].alias("value"))), F.array().cast(FEATURES))


def load_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Products (pid, model_id, shop, title, url, features) of JSON objects that map model keys to lists of variants.

    pid follows file order. Entries whose value isn't a list are left out, modelID falls back to the key, other missing
    scalars are empty, null ones the word None; all are stripped. A top level that isn't an object is an error.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    whole = F.when(F.regexp_like(F.col("value"), F.lit(r"^\s*\{")), F.col("value")).otherwise(F.raise_error(F.lit("the top level of a catalogue must be an object")).cast("string"))
    keys = files.select("file", F.posexplode(F.map_entries(F.from_json(whole, "map<string,string>"))).alias("at", "e"))
    items = keys.where(F.regexp_like(F.col("e.value"), F.lit(r"^\s*\["))).select("file", "at", F.col("e.key").alias("model_key"), F.posexplode(F.from_json("e.value", "array<string>")).alias("nth", "item"))
    fields = F.from_json("item", "map<string,string>")
    x = items.select("file", "at", "nth", "model_key", fields.alias("f"))

    def scalar(name: str, default: Column) -> Column:
        return strip(F.when(F.array_contains(F.map_keys("f"), name), F.coalesce(F.col("f")[name], F.lit("None"))).otherwise(default))

    x = x.select("file", "at", "nth", scalar("modelID", F.col("model_key")).alias("model_id"), scalar("shop", F.lit("")).alias("shop"), scalar("title", F.lit("")).alias("title"), scalar("url", F.lit("")).alias("url"), feature_list(F.col("f")["featuresMap"]).alias("features"))
    return numbered(x, ["file", "at", "nth"], "pid").select("pid", "model_id", "shop", "title", "url", "features")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with consecutive numbers from 0 in the given order: a range partitioned sort, numbers within partitions and the sums of
    the sizes before them, so no task sees all rows."""
    from ..operators.store import stored

    rows = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).withColumn("__local", F.monotonically_increasing_id()))
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__local").alias("__low"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"), "__low")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return rows.join(F.broadcast(sizes), "__part").withColumn(name, (inside - 1 + F.col("__before")).cast("long")).drop("__part", "__local", "__n", "__low", "__before")


def write_tokens(tokens: DataFrame, products: DataFrame, path: str) -> None:
    """One JSON object a line for each product: index, modelID, shop, title, tokens (sorted)."""
    sets = tokens.groupBy("pid").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    out = products.join(sets, "pid", "left").select(F.col("pid").alias("index"), F.col("model_id").alias("modelID"), "shop", "title", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
    out.orderBy("index").write.mode("overwrite").json(path)


RESULT_SCHEMA = "variant string, r int, b int, t_lsh double, cand_pairs_lsh double, dup_lsh double, PQ_lsh double, PC_lsh double, F1star_lsh double, F1_clu double, Prec_clu double, Rec_clu double"


def write_results(results: DataFrame, path: str) -> None:
    results.select(*[f.split()[0] for f in RESULT_SCHEMA.split(", ")]).orderBy("variant", "r", "b").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def load_results(spark: SparkSession, path: str, total_pairs: float = 187578.0) -> DataFrame:
    """A grid's results with frac_comp, the candidates' share of total_pairs, in that order."""
    return spark.read.csv(path, header=True, schema=RESULT_SCHEMA).withColumn("frac_comp", F.col("cand_pairs_lsh") / F.lit(total_pairs)).orderBy("frac_comp", "r", "b")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it has fewer partitions, since text work costs far more than moving a small table; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parts_as_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products made of the part table: names and brands as models, types as shops, with attributes of every shape that the text
    functions tell apart."""
    p = spread(spark.read.parquet(f"{sf_dir}/part.parquet"))
    s, k = F.col("p_size").cast("string"), F.col("p_partkey")
    case = lambda *values: F.element_at(F.array(*values), (k % len(values) + 1).cast("int"))
    c = F.concat
    lit = F.lit
    title = c("p_name", lit(" "), "p_brand", lit(" "), case(c(s, lit('" LED 1080p')), c(s, lit("-inch TV 720p 60 Hz")), c(s, lit(" inches 120-hz & hdr")), c(lit("32."), s, lit("inch 16/9-")), c(s, lit(" cm or set 12-"))))
    pairs = [
        ("Brand", F.col("p_brand")),
        ("Type", F.col("p_type")),
        ("Screen Size", case(c(s, lit(" inch")), c(s, lit('"')), c(s, lit(" inches")), c(s, lit("-inch")))),
        ("Refresh Rate", case(lit("60 hz"), lit("120 hertz"), lit("60-hz"))),
        ("Aspect Ratio", case(lit("16:9"), lit("4 : 3"), lit(""))),
        ("Resolution", case(lit("1920 x 1080"), c(s, lit(" x 20 x 5 cm")), c(s, lit(" x 9")), lit("1280x720 pixels"))),
        ("Width", case(c(s, lit('-7/8"')), c(s, lit(" 1/2")), lit("3-1/0"), c(lit("1,0"), s), c(s, lit(",5")))),
        ("Weight", case(c(s, lit("kg")), c(s, lit(" lbs")), c(lit("Weight: "), s))),
        ("Brightness", case(lit("450 nits"), lit("450 cd/m2"), c(s, lit("nit")))),
        ("Price", F.floor("p_retailprice").cast("string")),
    ]
    features = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(key).alias("key"), value.alias("value")) for i, (key, value) in enumerate(pairs)])
    return p.select(k.alias("pid"), c("p_name", lit("|"), "p_brand").alias("model_id"), F.col("p_type").alias("shop"), title.alias("title"), lit("").alias("url"), features.alias("features"))
