"""Column helpers that turn scraped text into keys and numbers."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Spellings that mean "unknown" in the raw tables.
UNKNOWN_MARKS = ["--", "", "Date of birth not found"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_key(c: Column | str) -> Column:
    """Key without any blanks, so stray spaces never break a join."""
    return F.regexp_replace(_c(c), " ", "")


def with_join_keys(df, mapping: dict[str, str]):
    """Add one blank-free key column per entry of {new column: source column}."""
    return df.withColumns({new: join_key(old) for new, old in mapping.items()})


def left_side(label: Column | str, sep: str = " vs. ") -> Column:
    return F.trim(F.split_part(_c(label), F.lit(sep), F.lit(1)))


def right_side(label: Column | str, sep: str = " vs. ") -> Column:
    return F.trim(F.split_part(_c(label), F.lit(sep), F.lit(2)))


def unknown_to_null(c: Column | str) -> Column:
    c = _c(c)
    return F.when(~F.trim(c).isin(UNKNOWN_MARKS), c)


def lenient_int(c: Column | str) -> Column:
    """Integer value of the text, 0 when it is not a number."""
    return F.coalesce(F.trim(_c(c)).try_cast("int"), F.lit(0))


def lenient_double(c: Column | str) -> Column:
    """Double value of the text, NULL when it is not a number."""
    return F.trim(_c(c).cast("string")).try_cast("double")


def landed(c: Column | str) -> Column:
    """First number of "n of m"."""
    return lenient_int(F.split_part(_c(c), F.lit(" of "), F.lit(1)))


def attempted(c: Column | str) -> Column:
    """Second number of "n of m"."""
    return lenient_int(F.split_part(_c(c), F.lit(" of "), F.lit(2)))


def clock_seconds(c: Column | str) -> Column:
    """Seconds of a "m:ss" clock; unknown marks are 0."""
    c = _c(c)
    minutes = lenient_int(F.split_part(c, F.lit(":"), F.lit(1)))
    seconds = lenient_int(F.split_part(c, F.lit(":"), F.lit(2)))
    return F.when(F.trim(c).isin(UNKNOWN_MARKS), F.lit(0)).otherwise(minutes * 60 + seconds)


def elapsed_seconds(round_no: Column | str, clock: Column | str, round_seconds: int = 300) -> Column:
    return (lenient_int(_c(round_no).cast("string")) - 1) * round_seconds + clock_seconds(clock)


def elapsed_minutes(round_no: Column | str, clock: Column | str) -> Column:
    """Whole minutes fought: a finish inside the first minute counts as 0."""
    return F.floor(elapsed_seconds(round_no, clock) / 60).cast("int")


def long_date(c: Column | str) -> Column:
    """"March 16, 2024" or "Mar 16, 2024" as a date, NULL for anything else."""
    return any_date(c, ["MMMM d, yyyy", "MMM d, yyyy"])


def any_date(c: Column | str, formats: list[str]) -> Column:
    """First of the given formats that parses."""
    c = F.trim(_c(c))
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats])


def height_inches(c: Column | str) -> Column:
    """5' 11" as 71."""
    feet = F.regexp_extract(_c(c), r"(\d+)'", 1).try_cast("double")
    inches = F.coalesce(F.regexp_extract(_c(c), r"' ?(\d+)", 1).try_cast("double"), F.lit(0.0))
    return feet * 12 + inches


def weight_pounds(c: Column | str) -> Column:
    """185 lbs. as 185."""
    return F.regexp_extract(_c(c), r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double")


def reach_inches(c: Column | str) -> Column:
    """75" as 75."""
    return F.regexp_replace(_c(c), '"', "").try_cast("double")


def normal_name(c: Column | str) -> Column:
    """Lower case without any non-word character."""
    return F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), r"\W+", "")


def strip_label(c: Column | str) -> Column:
    """Drop a leading "Label: "."""
    return F.regexp_replace(_c(c), r"^(.+?): ?", "")


def clean_space(c: Column | str) -> Column:
    """Remove line breaks and double blanks."""
    return F.trim(F.replace(F.replace(_c(c), F.lit("\n"), F.lit("")), F.lit("  "), F.lit("")))


def contains_ci(text: Column | str, part: Column | str) -> Column:
    """Case-insensitive containment, false for missing text."""
    return F.coalesce(F.contains(F.lower(_c(text)), F.lower(_c(part))), F.lit(False))


def edit_ratio(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length."""
    a, b = _c(a), _c(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


@F.pandas_udf(T.DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block similarity 2*M/T of two strings (M = characters in matching blocks)."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")
