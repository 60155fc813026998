"""Value coercion, rounding, tolerance and the functions of both rule languages (PRJ7-PRJ12, PRJ18, SNK7, FA*, FB*, FLT13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(text: Column) -> Column:
    """PRJ7: a number, or 0 for what is none."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def num_list(values: Column) -> Column:
    """PRJ7: the sum of an array of numbers; nulls are 0."""
    return F.aggregate(F.coalesce(values, F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def coerced(text: Column) -> Column:
    """PRJ8: (kind, num, str) by which values compare: booleans, then numbers, then text."""
    boolean, number = F.lower(text).isin("true", "false"), text.try_cast("double")
    return F.struct(
        F.when(boolean, 0).when(number.isNotNull(), 1).otherwise(2).alias("kind"),
        F.when(boolean, (F.lower(text) == "true").cast("double")).otherwise(number).alias("num"),
        F.when(~boolean & number.isNull(), text).alias("str"),
    )


def flat(sequences: Column) -> Column:
    """PRJ9: nested arrays as one, without nulls."""
    return F.array_compact(F.flatten(sequences))


def _whole(value: Column, scale: Column) -> Column:
    """value * scale to the nearest whole number, ties to even, decided on the exact product of both doubles and not on its rounded one.

    A product of doubles is its rounded value plus an error that is a double too (Dekker's splitting gives it)."""

    def halves(x: Column) -> tuple[Column, Column]:
        c = x * F.lit(134217729.0)  # 2^27 + 1
        high = c - (c - x)
        return high, x - high

    p = value * scale
    (vh, vl), (sh, sl) = halves(value), halves(scale)
    error = ((vh * sh - p) + vh * sl + vl * sh) + vl * sl
    below = F.floor(p).cast("double")
    over = (p - below - F.lit(0.5)) + error
    return F.when(over > 0, below + 1).when(over < 0, below).otherwise(F.when(below % 2 == 0, below).otherwise(below + 1))


def round_to_decimals(value: Column, decimals: Column) -> Column:
    """PRJ10: half-even at 10^-decimals; unknown decimals round to 2 places. What counts as a tie is the double itself: 2.675 is less than its
    text says and gives 2.67. At 0 and fewer places the quotient's tie decides."""
    d = F.coalesce(decimals, F.lit(2)).cast("double")
    scale = F.pow(F.lit(10.0), F.abs(d))
    fine = F.abs(value * scale) < F.lit(2.0**53)  # beyond, a double has no finer places to lose
    return F.when(d > 0, F.when(fine, _whole(value, scale) / scale).otherwise(value)).otherwise(F.bround(value / scale) * scale)


def half_ulp(decimals: Column) -> Column:
    """PRJ11: half a unit in the last place, 0.5 if unknown."""
    return F.coalesce(F.lit(0.5) * F.pow(F.lit(10.0), -decimals.cast("double")), F.lit(0.5))


def formatted(value: Column, datatype: Column) -> Column:
    """SNK7: whole text for monetary and integer values, four places for others."""
    return F.when(datatype.isin("MONETARY", "INTEGER"), F.bround(value).cast("bigint").cast("string")).otherwise(F.format_string("%.4f", value))


def is_valid_text(datatype: Column, value: Column, allowed: Column | None = None) -> Column:
    """FLT13: whether a value's text fits its datatype; empty text does."""
    ok = (
        F.when(datatype.isin("MONETARY", "DECIMAL", "PERCENTAGE"), value.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"))
        .when(datatype == "INTEGER", value.rlike(r"^[+-]?[0-9]+$"))
        .when(datatype == "DATE", value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & value.try_cast("date").isNotNull())
        .when(datatype == "BOOLEAN", value.isin("true", "false", "0", "1"))
    )
    if allowed is not None:
        ok = ok.when(datatype == "ENUMERATION", F.array_contains(allowed, value))
    return F.when(value.isNull() | (value == ""), True).otherwise(F.coalesce(ok.otherwise(True), F.lit(False)))


def clean_message(line: Column) -> Column:
    """PRJ18: a report line without its trailing file reference."""
    return F.trim(F.regexp_replace(line, r"\s+-\s+\S+\.(xml|xbrl)\b.*$", ""))


def severity_tag(line: Column) -> Column:
    """PRJ18: error or warning as a line names it; null if it doesn't."""
    return F.lower(F.nullif(F.regexp_extract(line, r"(?i)\b(error|warning)\b", 1), F.lit("")))


# Language A (formula tests)


def safe_divide(a: Column, b: Column) -> Column:
    """FA9, FB2: division by zero is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def biggest(values: Column) -> Column:
    """FA11: the largest of a sequence, 0 if empty."""
    return F.coalesce(F.array_max(F.array_compact(values)), F.lit(0.0))


def smallest(values: Column) -> Column:
    """FA11."""
    return F.coalesce(F.array_min(F.array_compact(values)), F.lit(0.0))


def length_of(values: Column) -> Column:
    """FA13: members of a sequence, 0 for null."""
    return F.coalesce(F.size(values), F.lit(0))


def matches(value: Column, pattern: str) -> Column:
    """FA15: searches for the pattern; null is empty text."""
    return F.coalesce(value, F.lit("")).rlike(pattern)


# Language B (workbook expressions)


def rational_power(x: Column, p: float, q: float) -> Column:
    """FB6: x^(p/q); a negative x gives 0 unless p/q is whole."""
    whole = float(p / q).is_integer()
    power = F.pow(x, F.lit(p / q))
    return power if whole else F.when(x >= 0, power).otherwise(0.0)


def imax(*values: Column) -> Column:
    """FB7: absent is 0."""
    return F.greatest(*[F.coalesce(v, F.lit(0.0)) for v in values])


def imin(*values: Column) -> Column:
    """FB7."""
    return F.least(*[F.coalesce(v, F.lit(0.0)) for v in values])
