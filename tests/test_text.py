"""Text rules, one case for each behaviour that a naive rewrite loses."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinspark.functions import similarity as S
from kinspark.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("raw, want", [
    ('40" tv', "40inch tv"), ("40 Inches", "40inch"), ("40-inch", "40inch"), ("60 Hertz", "60hz"), ("60-Hz", "60hz"), (None, ""), ("winch", "winch"), ("”40”", "”40inch"),
])
def test_title_units(spark, raw, want):
    assert one(spark, T.normalize_title(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("40 inch", "40inch"), ("40-inch", "40inch"), ("40 inches", "40 inch"), ("60 hz", "60hz"), ("60 hertz", "60 hz"), ("60-hz", "60-hz"), ('40"', '40"'),
    ("1,000", "1.000"), ("2,5", "2.5"), ("1,2,345", "1.2345"), ("450 cd/m2", "450 nit"), ("450 cd/m²", "450 nit"), ("450 nits", "450 nit"), ("178°", "178deg"), ("178Â°", "178deg"), ("", ""), (None, ""),
])
def test_value_units(spark, raw, want):
    assert one(spark, T.normalize_value(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("x 32.5inch", ["5inch"]), ("16/9- tv", ["16/9"]), ("12- tv", []), ("Acme 32\" LED 1080p", ["32inch", "1080p"]), ("a 1080p 1080P", ["1080p"]), ("plain 1080", []),
])
def test_title_tokens(spark, raw, want):
    assert one(spark, T.title_tokens(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw, want", [
    ('80-7/8"', ["80.875"]), ("32 1/2", ["32.5"]), ("3-1/0", ["4.0"]), ("1 1/2 and 2-1/4", ["2.25", "1.5"]), ("60 Hz, 3 ports", []), ("60hz", ["60"]), ("60 hz", ["60"]), ("60 hertz", []), ("40 ", []), ("10kg", ["10"]), ("7.5", ["7.5"]), ("10000000-1/2", ["10000000.5"]),
])
def test_measurements(spark, raw, want):
    assert one(spark, T.measurement_tokens(F.col("t")), t=raw) == want


@pytest.mark.parametrize("number, context, want", [
    ("1080", "title tv 1080p", "res"), ("60", "60 hz", "hz"), ("8", "8 ms", "time"), ("5", "response time", "time"), ("450", "450 nit", "bright"), ("450", "450nit", "int"), ("10", "10 kg", "weight"),
    ("90", "90 watt", "power"), ("2", "2 years", "year"), ("32", '32"', "inch"), ("132", '1132"', "inch"), ("1200", "1200mm", "int"), ("1200", "1200 mm", "mm"), ("12", "12 cm", "cm"), ("5", "none", "int"), ("5.5", "none", "real"),
])
def test_labels(spark, number, context, want):
    assert one(spark, T.infer_label(F.col("n"), F.array("c")), n=number, c=context) == want


def test_first_labelling_context_wins(spark):
    assert one(spark, T.infer_label(F.lit("60"), F.array(F.lit("60 things"), F.lit("60 kg"), F.lit("60hz"))), t="") == "weight"


def test_rounding(spark):
    assert [one(spark, T.round_half_up(F.lit(x)), t="") for x in (2.5, -1.5, 1.49, 80.875)] == [3, -2, 1, 81]


def test_number_helpers(spark):
    assert one(spark, T.first_number(F.col("t")), t="ab -3.5 c 7") == -3.5
    assert one(spark, T.first_number(F.col("t")), t="none") is None
    measured = [one(spark, T.is_measurement(F.lit(n), F.lit(u)), t="") for n, u in (("4", ""), ("5", ""), ("4", "kg"), ("4.5", ""))]
    assert measured == [False, True, True, True]


def test_title_words(spark):
    assert sorted(one(spark, T.clean_title_tokens(F.col("t")), t="A&B and C-d or E/f")) == ["a", "b", "c", "d", "e", "f"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.text(alphabet="abAB1 ", max_size=12), b=st.text(alphabet="abAB1 ", max_size=12))
def test_set_measures(spark, a, b):
    ga, gb = {a[i : i + 3] for i in range(len(a) - 2)}, {b[i : i + 3] for i in range(len(b) - 2)}
    x = spark.createDataFrame([(a, b)], "a string, b string").select(T.qgrams(F.col("a")).alias("a"), T.qgrams(F.col("b")).alias("b"))
    row = x.select("a", "b", S.dice(F.col("a"), F.col("b")).alias("d"), S.jaccard(F.col("a"), F.col("b")).alias("j"), S.root_sum_cosine(F.col("a"), F.col("b")).alias("c")).first()
    assert set(row["a"]) == ga and len(row["a"]) == len(ga)
    common = len(ga & gb)
    assert row["d"] == pytest.approx(2 * common / (len(ga) + len(gb)) if ga or gb else 0)
    assert row["j"] == pytest.approx(common / len(ga | gb) if ga and gb else 0)
    assert row["c"] == pytest.approx(common / (len(ga) ** 0.5 + len(gb) ** 0.5) if ga or gb else 0)


def test_floats_as_python_prints_them(spark):
    values = [0.0005, 5e-05, 0.00012345, 1.5e-07, 0.001, 0.5, 3.0, -0.0005, -2e-09, 123456789.25, 1e15, 1e16, 2.5e17, 1e100]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(T.float_text(F.col("x"))).collect()
    assert [r[0] for r in got] == [repr(v) for v in values]
