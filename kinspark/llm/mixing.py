"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A document of a source with target T and size S is due T / S copies on average. The whole part is taken for certain. The rest is a
Pareto order sample of unequal chances: a document's inclusion odds fall with the square root of its size, so long documents,
which make what is taken jump most, are drawn less often than short ones. With random odds u / (1 - u), documents are taken in the
order of random odds over inclusion odds until the sample has its fixed size, counted in words; a factor that all inclusion odds of
a source share doesn't change that order, so it needn't be solved for. No source is ever sorted as a
whole: the ranks are cut into bins, only sums of bins are compared, and just the bin that holds the border is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .util import small, stored

BINS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of runs of anything but space, tab, line feed, vertical tab, form feed and carriage return; null: 0."""
    spaces = "\t\n\x0b\x0c\r"
    one_line = F.translate(F.coalesce(text, F.lit("")), spaces, " " * len(spaces))
    return F.size(F.filter(F.split(one_line, " "), lambda w: w != "")).cast("long")


def source_targets(sizes: DataFrame, weights: list[float] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """sizes (source, source_size) with target: the sum of all sizes dealt by weight, a target stopping at most times its
    source's size and the excess dealt again by weight. Sources by code point, null last, get the weights in turn.

    In the order of size over weight, sources that stop come first, so one running sum finds the level of the others.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("w", w).withColumn("stop", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").asc_nulls_last())
    below, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(below), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(below), F.lit(0.0)))
    x = x.withColumn("level", level).withColumn("free", F.col("level") <= F.col("stop") / F.col("w"))
    x = x.withColumn("at", F.max(F.when(F.col("free"), F.col("level"))).over(every))  # levels fall behind the first free source
    return x.select("source", "source_size", F.when(F.col("at").isNull() | (F.col("stop") / F.col("w") < F.col("at")), F.col("stop")).otherwise(F.col("w") * F.col("at")).alias("target"))


def _drawn(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    """docs as a struct, with what the draw needs of each row: id, source, size, the text's digest and the row's number."""
    return docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest"), F.monotonically_increasing_id().alias("number"))


def _with_random(rows: DataFrame, repeated: DataFrame | None, seed: str) -> DataFrame:
    """rows with a random number u from seed, id and text; rows that repeat both (repeated, None if there are none) draw by their
    number too."""
    own = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("digest"))
    if repeated is not None:
        rows = rows.alias("x").join(repeated.alias("r"), F.col("x.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("x.digest") == F.col("r.digest")), "left").select("x.*", F.col("r.digest").isNotNull().alias("again"))
        own = F.when(F.col("again"), F.concat_ws(":", own, F.col("number").cast("string"))).otherwise(own)
    hashed = F.md5(own.cast("binary"))
    return rows.withColumn("u", (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))).drop("digest", "number", "again")


def _ranked(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows with their source's columns in targets, and their place in the Pareto order: odds, and its bin."""
    x = rows.alias("x").join(targets.alias("t"), F.col("x.source").eqNullSafe(F.col("t.source"))).drop(F.col("t.source"))
    odds = F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))) * F.sqrt(F.greatest("size", F.lit(1)) / F.col("mean")))
    return x.withColumn("odds", odds).withColumn("bin", F.floor(F.col("odds") / (1 + F.col("odds")) * BINS))


def _taken_in_order() -> Column:
    at_border = (F.col("bin") == F.col("border")) & (F.struct("odds", "doc_id", "size") <= F.col("cut"))
    return F.coalesce(F.col("p") > 0, F.lit(False)) & F.coalesce((F.col("bin") < F.col("border")) | at_border, F.lit(False))


def mix_plan(rows: DataFrame, weights: list[float], most: float) -> DataFrame:
    """One row for each source (rows: what _with_random gives, without row): source_size, target, the certain copies, the
    chance p of one more, and where the Pareto order is cut: border (bin), cut (place in it) and last (one more document)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.greatest(F.avg("size"), F.lit(1.0)).alias("mean"))
    sizes = stored(sizes, "mix-sources")
    targets = source_targets(sizes.drop("mean"), list(weights), most).alias("t").join(sizes.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select("t.*", "mean")
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("sure", F.floor(due)).withColumn("p", due - F.floor(due)).withColumn("missing", F.col("target") - F.col("sure") * F.col("source_size"))
    targets = stored(targets, "mix-targets")
    x = _ranked(rows, small(targets))

    bins = x.where("p > 0").groupBy("source", "bin").agg(F.sum("size").alias("in_bin"), F.first("missing").alias("missing"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("before", F.sum("in_bin").over(upto) - F.col("in_bin"))
    border = bins.where(F.col("before") <= F.col("missing")).groupBy("source").agg(F.max("bin").alias("border"), F.max_by("before", "bin").alias("before"))

    def with_borders(columns: DataFrame, name: str) -> DataFrame:
        return stored(targets.alias("t").join(columns.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").drop(F.col("c.source")), name)

    borders = with_borders(border, "mix-borders")
    in_rank = Window.partitionBy("source").orderBy("odds", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = _ranked(rows, small(borders)).where("bin = border").withColumn("upto", F.col("before") + F.sum("size").over(in_rank))
    targets = borders
    cuts = with_borders(edge.where("upto <= missing").groupBy("source").agg(F.max(F.struct("odds", "doc_id", "size")).alias("cut")), "mix-cuts")

    x = _ranked(rows, small(cuts)).where("p > 0").withColumn("in", _taken_in_order())
    gap = x.groupBy("source").agg((F.first("missing") - F.sum(F.when(F.col("in"), F.col("size")).otherwise(0))).alias("gap"))
    targets = cuts
    gaps = with_borders(gap, "mix-gaps")
    left_over = _ranked(rows, small(gaps)).where(~_taken_in_order()).where("p > 0 and size > 0 and size < 2 * gap")
    targets = gaps
    last = left_over.groupBy("source").agg(F.min_by(F.struct("odds", "doc_id", "size"), F.struct(F.abs(F.col("size") - F.col("gap")), F.col("odds"), F.col("doc_id"))).alias("last"))
    return with_borders(last, "mix-last")


def mixed(docs: DataFrame, weights: list[float] = (1.0, 2.0, 3.0), most: float = 3.0, seed: str = "mix", text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """row (all columns of docs, as a struct) and what mix gives, for each row of docs. The plan is a row for each source, so
    texts are neither sorted nor shuffled."""
    rows = _drawn(docs, text, doc_id, source)
    sizes = stored(rows.drop("row"), "mix-sizes")
    repeated = stored(sizes.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "digest"), "mix-repeated")
    repeated = None if repeated.isEmpty() else small(repeated)
    plan = small(mix_plan(stored(_with_random(sizes, repeated, seed), "mix-drawn"), weights, most))
    x = _ranked(_with_random(rows, repeated, seed), plan)
    is_last = F.coalesce(F.struct("odds", "doc_id", "size") == F.col("last"), F.lit(False)) & ~_taken_in_order()
    copies = (F.col("sure") + _taken_in_order().cast("long") + is_last.cast("long")).cast("long")
    x = x.withColumn("copies", copies)
    return x.select("row", "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: list[float] = (1.0, 2.0, 3.0), most: float = 3.0, seed: str = "mix", text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies, taken.

    size: words of the text (null text: 0). copies: how often the mix takes the document, at most ceil(most) times; taken:
    copies times size. Random numbers come from seed, id and text, so reruns agree; rows that repeat an id and a text, null ids
    included, each have their own, by their place in the table (reruns agree while its files stay the same). Null sources are one source of their own; a source of no words
    takes nothing. The last document of each source's sample is the one whose size fits what is still missing best, if taking
    it brings the source nearer to its target. Other columns of docs are ignored. An empty table gives an empty result.
    """
    return mixed(docs, weights, most, seed, text, doc_id, source).drop("row")


SQL = r"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                 (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, greatest(CAST(sum(size) AS DOUBLE) / count(*), 1.0) AS mean, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM d GROUP BY source),
    o AS (SELECT *, 3 * CAST(source_size AS DOUBLE) AS stop FROM s),
    l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(stop) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM o
          WINDOW b AS (ORDER BY stop / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    m AS (SELECT *, max(CASE WHEN level <= stop / w THEN level END) OVER () AS lvl FROM l),
    t AS (SELECT source, source_size, mean, CASE WHEN lvl IS NULL OR stop / w < lvl THEN stop ELSE w * lvl END AS target FROM m),
    p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS due FROM t),
    q AS (SELECT d.*, p.source_size, p.mean, p.target, floor(due) AS sure, due - floor(due) AS p, p.target - floor(due) * p.source_size AS missing FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
    r AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) * sqrt(greatest(size, 1) / mean) END AS odds FROM q),
    c AS (SELECT *, p > 0 AND sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds, doc_id, size ROWS UNBOUNDED PRECEDING) <= missing AS more FROM r),
    g AS (SELECT *, missing - sum(CASE WHEN more THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM c),
    f AS (SELECT *, CASE WHEN p > 0 AND NOT more AND size > 0 AND size < 2 * gap THEN row_number() OVER (PARTITION BY source, p > 0 AND NOT more AND size > 0 AND size < 2 * gap ORDER BY abs(size - gap), odds, doc_id) END AS nth FROM g),
    n AS (SELECT *, CAST(sure + CAST(more AS INTEGER) + CASE WHEN nth = 1 THEN 1 ELSE 0 END AS BIGINT) AS copies FROM f)
    SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM n"""
