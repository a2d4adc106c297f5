"""Column expressions shared by the operators. None of them raises on odd values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import words

DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c) -> Column:
    """The value as a finite double, else null."""
    d = as_col(c).try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def text_or_null(c) -> Column:
    """Trimmed text; blanks and words that stand for a missing value are null."""
    t = F.trim(as_col(c).cast("string"))
    return F.when((t == "") | F.lower(t).isin(*words.NULL_WORDS), None).otherwise(t)


def missing(c) -> Column:
    """Null, NaN or blank."""
    c = as_col(c)
    return c.isNull() | (F.trim(c.cast("string")) == "")


def parse_date(c) -> Column:
    """A timestamp by the first format that fits, else null."""
    t = F.trim(as_col(c).cast("string"))
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS), t.try_cast("timestamp"))


def is_close(p, t, rtol: float = 1e-3, atol: float = 1e-2) -> Column:
    """|p - t| <= atol + rtol |t|; false when either is null."""
    p, t = as_col(p), as_col(t)
    return F.coalesce(F.abs(p - t) <= F.lit(atol) + F.lit(rtol) * F.abs(t), F.lit(False))


def divide(a, b) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


OPERATIONS = {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": divide}


def fold(operation: str, operands: list) -> Column:
    """The operands combined from the left."""
    if len(operands) < 2 or operation not in OPERATIONS:
        raise ValueError("a derived column needs a known operation and two operands at least")
    return reduce(OPERATIONS[operation], (number(o) for o in operands))


def bounded_similarity(difference: Column, scale: Column, least: float = 1e-9) -> Column:
    """1 - |difference| / scale, between 0 and 1."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.abs(difference) / F.greatest(scale, F.lit(least)), F.lit(1.0)))


def position(value, cuts, most: int) -> Column:
    """How many of a rising array of fewer than ``most`` cuts are not above the value, by halving steps."""
    value, cuts = as_col(value), as_col(cuts)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(max(1, most).bit_length()))))
    fits = lambda i: (i <= F.size(cuts)) & (F.element_at(cuts, F.least(i, F.size(cuts))) <= value)
    return F.when(F.size(cuts) == 0, 0).otherwise(F.aggregate(steps, F.lit(0), lambda i, s: F.when(fits(i + s), i + s).otherwise(i)))


def add_days(start, days) -> Column:
    """The date (yyyy-MM-dd) so many days, whole or not, behind a moment; negative and missing spans count as none."""
    span = F.greatest(F.coalesce(number(days), F.lit(0.0)), F.lit(0.0))
    return F.date_format(F.timestamp_seconds(F.unix_timestamp(parse_date(start)) + span * 86400), "yyyy-MM-dd")


def last_number(c) -> Column:
    """The last run of digits as a long, or null."""
    return F.try_element_at(F.regexp_extract_all(as_col(c).cast("string"), F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).try_cast("long")


def word_total(c) -> Column:
    """Number of words between white space."""
    return F.size(F.filter(F.split(F.trim(as_col(c)), r"\s+"), lambda w: w != ""))


def letter_tokens(c) -> Column:
    """Tokens of three ASCII letters and more, lower-cased, that stand between other characters than letters, digits and _."""
    return F.filter(F.split(F.lower(as_col(c)), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike("^[a-z]{3,}$"))


def has_phrase(c, phrases) -> Column:
    return F.lower(as_col(c)).rlike(r"\b(" + "|".join(phrases) + r")\b")


def signature(c) -> Column:
    """Character classes of an id: U, L and D for runs of capitals, small letters and digits."""
    lowered = F.regexp_replace(as_col(c).cast("string"), "[a-z]+", "\u0001")
    return F.translate(F.regexp_replace(F.regexp_replace(lowered, "[A-Z]+", "U"), r"\d+", "D"), "\u0001", "L")


def md5_order(*cols, seed: int = 42) -> Column:
    """A repeatable shuffled order."""
    return F.md5(F.concat_ws("|", *(F.coalesce(as_col(c).cast("string"), F.lit("")) for c in cols), F.lit(str(seed))))


def strip_group(c) -> Column:
    """A model name without its group suffix."""
    return F.regexp_replace(as_col(c), r"_group_\d+$", "")
