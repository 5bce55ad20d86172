"""Column builders: safe numbers, boxes, words, n-grams, keys and identities.

Rounding is half to even, ratios are guarded against zero, and casts that fail
give a default instead of an error.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Alphabet and characters of the word normaliser.
ARMENIAN_LETTERS = "ԱԲԳԴԵԶԷԸԹԺԻԼԽԾԿՀՁՂՃՄՅՆՇՈՉՊՋՌՍՎՏՐՑՒՓՔՕՖաբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆև"
PUNCTUATION_TO_STRIP = " \t\r\n.,:;!?()[]{}«»\"'`՛՜՝՞։֊-–—_"
SURNAME_SUFFIXES = ("յան", "եան")


def percent(count: Column, total: Column) -> Column:
    """Whole percent, half to even; 0 for an empty total."""
    return F.when(total <= 0, F.lit(0)).otherwise(F.bround(count * 100.0 / F.greatest(total, F.lit(1))).cast("int")).cast("int")


def per(count: Column, total: Column) -> Column:
    """count / max(1, total)"""
    return count.cast("double") / F.greatest(total.cast("double"), F.lit(1.0))


def as_int(c: Column, default: int = 0) -> Column:
    """Loose integers: truncated numbers and numeric strings, else the default."""
    return F.coalesce(c.cast("string").try_cast("bigint"), F.lit(default).cast("bigint"))


def as_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(default))


def as_bool(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "on")


def first_of(*pairs: tuple[str, Column]) -> Column:
    """struct(source, value) of the first value that is neither null nor empty."""
    return F.coalesce(*[F.when(c.isNotNull() & (c.cast("string") != ""), F.struct(F.lit(n).alias("source"), c.cast("string").alias("value"))) for n, c in pairs])


# ---------------------------------------------------------------- boxes


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Corners in order; null if any is missing."""
    made = F.struct(F.least(x1, x2).alias("x1"), F.least(y1, y2).alias("y1"), F.greatest(x1, x2).alias("x2"), F.greatest(y1, y2).alias("y2"))
    return F.when(x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull(), made)


def padded(b: Column, by: Column | int, width: Column | int, height: Column | int) -> Column:
    """A box grown on all sides, kept within the image."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    by, width, height = lit(by), lit(width), lit(height)
    return F.struct(F.greatest(F.lit(0), b["x1"] - by).alias("x1"), F.greatest(F.lit(0), b["y1"] - by).alias("y1"), F.least(width, b["x2"] + by).alias("x2"), F.least(height, b["y2"] + by).alias("y2"))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0), b["x2"] - b["x1"]) * F.greatest(F.lit(0), b["y2"] - b["y1"])


def overlap(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    return F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))


def gaps(a: Column, b: Column) -> tuple[Column, Column]:
    """Horizontal and vertical distance of two boxes, 0 where they overlap."""
    x = F.greatest(F.lit(0), F.greatest(a["x1"], b["x1"]) - F.least(a["x2"], b["x2"]))
    y = F.greatest(F.lit(0), F.greatest(a["y1"], b["y1"]) - F.least(a["y2"], b["y2"]))
    return x, y


def distance(a: Column, b: Column) -> Column:
    x, y = gaps(a, b)
    return F.sqrt((x * x + y * y).cast("double"))


def vertical_overlap(a: Column, b: Column) -> Column:
    """Shared height over the smaller height."""
    return F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])) / F.greatest(F.lit(1), F.least(a["y2"] - a["y1"], b["y2"] - b["y1"]))


def height_ratio(a: Column, b: Column) -> Column:
    ha, hb = a["y2"] - a["y1"], b["y2"] - b["y1"]
    return F.greatest(ha, hb) / F.greatest(F.lit(1), F.least(ha, hb))


# ---------------------------------------------------------------- words


@F.pandas_udf(StringType())
def composed(s: pd.Series) -> pd.Series:
    """Unicode's composed form (NFC), which no built-in function gives."""
    return s.str.normalize("NFC")


def normalized(word: Column, expand_ligature: bool = False, keep_hyphen: bool = False) -> Column:
    """Composed, stripped of white space and punctuation, in lower case, without hyphens
    unless they are kept."""
    out = F.btrim(composed(word), F.lit(PUNCTUATION_TO_STRIP))
    out = out if keep_hyphen else F.translate(out, "-֊", "")
    return F.lower(F.replace(out, F.lit("և"), F.lit("եվ")) if expand_ligature else out)


def unknown_letters(word: Column, alphabet: str) -> Column:
    """Sorted distinct characters outside of the alphabet."""
    return F.array_sort(F.array_distinct(F.filter(F.split(word, ""), lambda c: (c != "") & (F.instr(F.lit(alphabet), c) == 0))))


def unknown_count(word: Column, alphabet: str) -> Column:
    return F.length(F.translate(word, alphabet, ""))


def ngrams(word: Column, order: int) -> Column:
    """Runs of ``order`` characters of ``^``-padded and ``$``-ended words."""
    padded_ = F.concat(F.lit("^" * (order - 1)), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(padded_) - (order - 1)), lambda i: F.substring(padded_, i, F.lit(order)))


def suffix_hints(word: Column, suffixes: tuple[str, ...]) -> Column:
    """struct(suffix, start, stop, confidence) of each proper suffix, in list order."""
    some = [F.when(word.endswith(s) & (F.length(word) > len(s)), F.struct(F.lit(s).alias("suffix"), (F.length(word) - len(s)).alias("start"), F.length(word).alias("stop"), F.lit(0.35).alias("confidence"))) for s in suffixes]
    return F.array_compact(F.array(*some))


def natural_key(c: Column) -> Column:
    """Sort key with runs of digits as numbers and text in lower case."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(p, 20, "0"))).otherwise(F.concat(F.lit("1"), p)))


def slug(c: Column) -> Column:
    """Runs of other characters than letters, digits, ``_`` and ``-`` become one ``_``."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(c, r"[^0-9A-Za-z_-]+", "_"), F.lit("_")), F.lit("")), F.lit("unknown"))


def identity(*parts: Column) -> Column:
    """SHA-256 over the parts joined by bars."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def seed(digest: Column) -> Column:
    """The first 16 hexadecimal digits as an unsigned number."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def canonical(c: Column) -> Column:
    """Booleans as words, whole numbers without decimals, others with four places."""
    number = c.cast("string").try_cast("double")
    whole = F.format_string("%d", F.coalesce(number, F.lit(0.0)).cast("bigint"))
    word = F.lower(c.cast("string"))
    return F.when(word.isin("true", "false"), word).when(number.isNull(), c.cast("string")).when(number == F.floor(number), whole).otherwise(F.format_string("%.4f", number))
