"""Text functions as Column expressions: units, model words, fractions, measurements, numeric labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns and words that decide which tokens exist
MODEL_WORD = r"(?iU)\b(?=[A-Z0-9_/'-]*\d)(?=[A-Z0-9_/'-]*[A-Z_'-])[A-Z0-9_/'-]+\b"
ALNUM_WITH_DIGIT = r"(?U)[A-Za-z0-9]*\d+[A-Za-z0-9]*"
INCH = r"(?iU)\binches\b|\binch\b|\s*-inch\b|\s+inch\b"
HERTZ = r"(?iU)\bhertz\b|\bhz\b|\s+-hz\b|\s+hz\b"
NIT = r"(?iU)\bcd/?m2\b|\bcd/m\u00b2(?!\w)|\bcdm2\b|\bnits?\b"
DEGREE = r"(?iU)\u00b0|\bdegrees?\b|\bdeg\b|\bdeg\.\b"
FRACTION_DASH = r"(\d+)-(\d+)/(\d+)"
FRACTION_SPACE = r"(\d+)\s+(\d+)/(\d+)"
WHOLE_NUMBER = r"^(\d+(?:\.\d+)?)([A-Za-z]+)?$"
NUMBER = r"^\d+(?:\.\d+)?$"
FIRST_NUMBER = r"(?<!\d)[-+]?\d*\.?\d+"
RATIO = r"(\d+)\s*:\s*(\d+)"
DIMENSIONS = r"(\d+)\s*[xX\u00d7]\s*(\d+)(?:\s*[xX\u00d7]\s*(\d+))?"
SUFFIX_LABELS = (("p", "res"), ("hz", "hz"), ("inch", "inch"))
UNIT_WORDS = (("mm", ("mm", "millimeter", "millimetre")), ("cm", ("cm", "centimeter", "centimetre")), ("inch", ("inch", '"')), ("weight", ("kg", "kilogram", "lb")))
LABEL_WORDS = (
    ("bright", ("nit", "cd/m2", "cd/m\u00b2", "brightness")),
    ("weight", ("weight", "lb", "lbs", "pound", "kg")),
    ("power", ("watt", "wattage", "power consumption")),
    ("year", ("year", "years")),
)
NOISE_WORDS = ("and", "or")


def chain(c: Column, *rewrites: tuple[str, str]) -> Column:
    for pattern, to in rewrites:
        c = F.regexp_replace(c, pattern, to)
    return c


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_title(c: Column) -> Column:
    """Lower case, with inch and hertz in one form and joined to the number before them; null is empty."""
    return chain(
        F.lower(F.coalesce(c, F.lit(""))),
        ("(?U)(\\d+)\\s*[\"\u201d]", "$1inch"), (r"(?U)\b(?:inches|inch)\b", "inch"), ("-inch", "inch"),
        (r"(?U)\b(?:hertz|hz)\b", "hz"), ("-hz", "hz"), (r"(?U)(\d+)\s*inch", "$1inch"), (r"(?U)(\d+)\s*hz", "$1hz"),
    )


def model_words(c: Column) -> Column:
    """Distinct model words of a title, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(normalize_title(c), F.lit(MODEL_WORD), 0))


def title_tokens(c: Column) -> Column:
    return F.filter(model_words(normalize_title(c)), lambda w: w.rlike(r"(?U)\d") & w.rlike(r"(?U)\D"))


def normalize_value(c: Column) -> Column:
    """Attribute values: decimal and thousands commas, then one form for inch, hz, nit and deg. Each rule is one pass."""
    return chain(
        F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("\u00c2"), F.lit(""))),
        (r"(?U)(\d),(\d)", "$1.$2"), (r"(?U)(?<=\d),(?=\d{3}\b)", ""), (INCH, "inch"), (HERTZ, "hz"), (NIT, "nit"), (DEGREE, "deg"),
    )


def _mixed_numbers(c: Column, pattern: str) -> Column:
    part = lambda m, i: F.regexp_extract(m, pattern, i).cast("double")
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), 0), lambda m: part(m, 1) + part(m, 2) / F.when(part(m, 3) == 0, F.lit(1.0)).otherwise(part(m, 3)))


def fraction_values(c: Column) -> Column:
    """Values of mixed numbers: those with a dash first, then those with a space."""
    return F.concat(_mixed_numbers(c, FRACTION_DASH), _mixed_numbers(c, FRACTION_SPACE))


def float_text(x: Column) -> Column:
    """A double as Python prints it: without an exponent from 0.0001 up to 1e16, with one of two digits at least beyond."""
    java = F.abs(x).cast("string")
    digits = F.regexp_replace(F.regexp_replace(java, r"E.*$", ""), r"\.0$", "")
    power = F.regexp_extract(java, r"E-?(\d+)$", 1)
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,12)").cast("string"), "0+$", ""), r"\.$", ".0")
    short = F.concat(sign, digits, F.when(java.contains("E-"), F.lit("e-")).otherwise(F.lit("e+")), F.when(F.length(power) < 2, F.lit("0")).otherwise(F.lit("")), power)
    small = F.concat(sign, F.lit("0.000"), F.replace(digits, F.lit("."), F.lit("")))
    return F.when(~java.contains("E"), x.cast("string")).when((F.abs(x) >= 1e7) & (F.abs(x) < 1e16), plain).when((F.abs(x) >= 1e-4) & (F.abs(x) < 1), small).otherwise(short)


def measurement_tokens(raw: Column) -> Column:
    """Numbers that a value stands for: its fractions, and the number if the whole value is one, with or without a unit."""
    text = normalize_value(raw)
    return F.concat(F.transform(fraction_values(raw), float_text), F.when(text.rlike(WHOLE_NUMBER), F.array(F.regexp_extract(text, WHOLE_NUMBER, 1))).otherwise(F.array().cast("array<string>")))


def is_measurement(number: Column, unit: Column) -> Column:
    """Whether a number counts as a measurement: it has a unit or a point, or is at least 5."""
    value = F.coalesce(number.try_cast("double"), F.lit(-1.0))
    return F.coalesce(unit != "", F.lit(False)) | F.contains(number, F.lit(".")) | (value >= 5.0)


def first_number(c: Column) -> Column:
    """The first signed number in a text, or null."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), FIRST_NUMBER, 0)
    return F.when(found != "", found.cast("double"))


def round_half_up(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5)).cast("long")


def no_leading_zeros(n: Column) -> Column:
    return F.regexp_replace(n, r"^0+(?=\d)", "")


def contexts(title: Column, features: Column) -> Column:
    """Normalised texts in which numbers get their meaning: the title, then the values in their order. Keys are none."""
    values = F.transform(F.filter(features, lambda f: F.coalesce(f["value"], F.lit("")) != ""), lambda f: normalize_value(f["value"]))
    return F.concat(F.array(F.concat(F.lit("title "), normalize_value(title))), values)


def ratios(ctxs: Column) -> Column:
    """Structs of both numbers of each A:B."""
    return F.flatten(F.transform(ctxs, lambda c: F.transform(F.regexp_extract_all(c, F.lit(RATIO), 0), lambda m: F.struct(F.regexp_extract(m, RATIO, 1).alias("a"), F.regexp_extract(m, RATIO, 2).alias("b")))))


def _has_any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def dimensions(ctxs: Column) -> Column:
    """Structs (number, unit) of each member of A x B (x C) whose unit the context or the size of the numbers tells."""

    def members(c: Column) -> Column:
        def one(m: Column) -> Column:
            numbers = F.filter(F.array(*[F.regexp_extract(m, DIMENSIONS, i) for i in (1, 2, 3)]), lambda n: n != "")
            unit = None
            for name, words in UNIT_WORDS:
                unit = F.when(_has_any(F.lower(c), words), name) if unit is None else unit.when(_has_any(F.lower(c), words), name)
            unit = unit.when(F.exists(numbers, lambda n: n.cast("double") >= 100), "res")
            return F.when(unit.isNotNull(), F.transform(numbers, lambda n: F.struct(n.alias("n"), unit.alias("unit")))).otherwise(F.filter(F.transform(numbers, lambda n: F.struct(n.alias("n"), F.lit("").alias("unit"))), lambda x: F.lit(False)))

        return F.flatten(F.transform(F.regexp_extract_all(c, F.lit(DIMENSIONS), 0), one))

    return F.flatten(F.transform(ctxs, members))


def label_in(number: Column, c: Column) -> Column:
    """Label of a number in one context, or null. Rules in order; words are looked for anywhere, numbers at word borders. A pattern
    holds the number, so it is compiled anew for each; it runs only where the texts that it needs are there."""
    n = F.replace(number, F.lit("."), F.lit("\\."))
    low = F.lower(c)
    has = lambda *words: _has_any(low, words)
    like = lambda before, after: F.regexp_like(low, F.concat(F.lit("(?U)" + before), n, F.lit(after)))
    word = like(r"\b", r"\b")
    late = has("response time", "millisecond")
    out = F.when(F.contains(low, F.concat(number, F.lit("p"))) & like(r"\b", r"p\b"), "res").when(has("hz") & like(r"\b", r"\s*hz\b"), "hz").when(late | (has("ms") & like(r"\b", r"\s*ms\b")), "time")
    for name, words in LABEL_WORDS:
        out = out.when(has(*words) & word, name)
    quoted = has('"', "\u201d") & F.regexp_like(c, F.concat(F.lit("(?U)"), n, F.lit("\\s*[\"\u201d]")))
    out = out.when((has("inch") & like(r"\b", r"\s*inch\b")) | quoted, "inch")
    out = out.when(has(*UNIT_WORDS[0][1]) & word, "mm").when(has(*UNIT_WORDS[1][1]) & word, "cm")
    return F.when(F.contains(low, number), out).when(late, "time")


def infer_label(number: Column, ctxs: Column) -> Column:
    """Label of a number: the first context that has one decides; else real or int by its point."""
    found = F.filter(F.transform(ctxs, lambda c: label_in(number, c)), lambda x: x.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.when(F.contains(number, F.lit(".")), "real").otherwise("int"))


def number_contexts(token: Column, ctxs: Column) -> Column:
    pattern = F.concat(F.lit(r"(?U)(?<!\d)"), F.replace(token, F.lit("."), F.lit("\\.")), F.lit(r"(?!\d)"))
    return F.filter(ctxs, lambda c: F.contains(c, token) & F.regexp_like(c, pattern))


def qgrams(c: Column, q: int = 3) -> Column:
    """Distinct substrings of q characters; case counts; shorter texts have none."""
    c = F.coalesce(c, F.lit(""))
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - q + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(q)))
    return F.when(F.length(c) >= q, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def clean_title_tokens(c: Column) -> Column:
    """Distinct words of a title in lower case, & / - being spaces; without and, or."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[&/\-]", " "), r"(?U)\s+")
    return F.array_distinct(F.filter(words, lambda w: ~w.isin("", *NOISE_WORDS)))


def alnum_words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(ALNUM_WITH_DIGIT), 0))
