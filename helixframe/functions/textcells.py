"""Column expressions on worksheet text: clean-up, numbers, mean and SEM, labels."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from helixframe.functions.seq import col

NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
MEAN_SEM = rf"^\s*({NUMBER})\s*(?:±|\+/-|\+-)\s*({NUMBER})\s*$"
CONTROLS = ("NRT", "NTC", "QC")


def clean_text(x) -> Column:
    """Runs of any white space as one space, none at the ends; null: blank."""
    return F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)\s+", " "))


def is_blank(x) -> Column:
    return F.when(F.ascii(col(x)).between(33, 126), F.lit(False)).otherwise(~F.coalesce(F.rlike(col(x), F.lit(r"(?U)\S")), F.lit(False)))


def parse_number(x) -> Column:
    """Commas dropped; null for what is not a decimal number (nan, inf and 1_000 included)."""
    text = F.regexp_replace(clean_text(x), ",", "")
    cleaned = F.when(text.rlike(rf"^{NUMBER}$"), text.try_cast("double"))
    return F.when(col(x).isNotNull(), F.when(F.rlike(col(x), F.lit(rf"^{NUMBER}\z")), col(x).try_cast("double")).otherwise(cleaned))


@F.pandas_udf(StringType())
def general_format(values: pd.Series) -> pd.Series:
    """Six significant digits without trailing zeros; for sinks, as no built-in expression rounds the exact value."""
    out = pd.Series([None] * len(values), index=values.index, dtype=object)
    there = values.notna()
    out[there] = [f"{v:g}" for v in values[there]]
    return out


def plain_text(x) -> Column:
    """Decimals of at most six digits, from 0.0001 on, as general_format() has them: they need no rounding and lose only commas and zeros at the end; any other text: null."""
    text = F.when(F.rlike(col(x), F.lit(r"^(?:0|[1-9][0-9]{0,2}(?:,?[0-9]{3}|[0-9]{0,3}))(?:\.[0-9]+)?\z")), F.replace(col(x), F.lit(","), F.lit("")))
    text = F.when(F.contains(text, F.lit(".")), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
    digits = F.length(F.replace(text, F.lit("."), F.lit("")))
    return F.when(F.when(F.startswith(text, F.lit("0")), (digits <= 7) & ~F.startswith(text, F.lit("0.0000"))).otherwise(digits <= 6), text)


def short_text(x) -> Column:
    """A text that is a number with six significant digits (see general_format); any other: null."""
    plain = plain_text(x)
    return F.coalesce(plain, general_format(F.when(plain.isNull(), parse_number(x))))


def number_text(x) -> Column:
    """A text that is a number with six significant digits, any other cleaned up."""
    return F.coalesce(general_format(parse_number(x)), clean_text(x))


def whole_number(x) -> Column:
    """The whole part of a decimal text; null for what is no number."""
    text = F.trim(col(x).cast("string"))
    number = F.when(text.rlike(rf"^{NUMBER}$"), text.try_cast("double"))
    return F.when(F.abs(number) < 2.0**62, number.cast("long"))


def first_two_numbers(x) -> tuple[Column, Column]:
    """The first two numbers of a text, a sign right before the digits included; fewer: both null."""
    found = number_texts(x)
    enough = F.size(found) >= 2
    return F.when(enough, F.get(found, 0).try_cast("double")), F.when(enough, F.get(found, 1).try_cast("double"))


def number_texts(x) -> Column:
    """The numbers of a text as they stand."""
    return F.regexp_extract_all(col(x), F.lit(f"({NUMBER})"), F.lit(1))


def mean_sem(x) -> tuple[Column, Column]:
    """`mean ± sem` as a whole, or nulls."""
    text = clean_text(col(x).cast("string"))
    return F.nullif(F.regexp_extract(text, MEAN_SEM, 1), F.lit("")).try_cast("double"), F.nullif(F.regexp_extract(text, MEAN_SEM, 2), F.lit("")).try_cast("double")


def mean_sem_error(x) -> Column:
    return F.when(mean_sem(x)[0].isNull(), F.concat(F.lit("Not a mean and SEM: "), F.coalesce(col(x).cast("string"), F.lit(""))))


def tokens(x) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(col(x)), F.lit("([a-z0-9]+)"), F.lit(1)))


def looks_like_gene(x) -> Column:
    return clean_text(x).rlike(r"^[A-Za-z][A-Za-z0-9_.-]{0,19}$")


def split_label(x, delimiter: str = "-") -> tuple[Column, Column]:
    """(outer, condition) at the first delimiter, else at the first space, else the text twice; an empty rest is the whole text."""
    text = clean_text(x)
    by = F.split(text, re.escape(delimiter), 2) if delimiter else F.array(text)
    parts = F.when(F.instr(text, delimiter) > 0, by).when(F.instr(text, " ") > 0, F.split(text, " ", 2)).otherwise(F.array(text, text))
    first, rest = F.trim(F.get(parts, 0)), F.trim(F.get(parts, 1))
    return first, F.coalesce(F.nullif(rest, F.lit("")), text)


def dose_unit(header) -> Column:
    """What a header has between its first brackets; blank: none."""
    return clean_text(F.regexp_extract(header, r"\(([^)]+)\)", 1))


def format_dose(x, unit) -> Column:
    """The dose with its unit unless it is there; a blank dose gives the unit after a space."""
    text = clean_text(x)
    return F.when((unit == "") | F.contains(F.lower(text), F.lower(unit)), text).otherwise(F.concat_ws(" ", text, unit))


def timepoint(header) -> Column:
    """The rest of a header after its mark: the first dash, else the first colon, else the word time; no rest: all of it."""
    text = clean_text(header)
    after = lambda pattern: F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))
    rest = F.when(F.contains(text, F.lit("-")), after("^[^-]*-(.*)$")).when(F.contains(text, F.lit(":")), after("^[^:]*:(.*)$")).otherwise(after("(?i)^time (.+)$"))
    return F.coalesce(rest, text)


def safe_filename(x) -> Column:
    return F.regexp_replace(F.regexp_replace(clean_text(x), r"[^A-Za-z0-9_.-]+", "_"), "^[_.]+|[_.]+$", "")


def plot_label(group, compound) -> Column:
    return F.concat_ws(" | ", clean_text(group), clean_text(compound))


def sheet_prefix(sheet, prefix: str) -> Column:
    return F.startswith(F.lower(clean_text(sheet)), F.lit(prefix.lower()))


def safe_sheet_name(x) -> Column:
    """Characters that sheets can't have as underscores, blank as Sheet, at most 31."""
    return F.substring(F.coalesce(F.nullif(F.trim(F.regexp_replace(col(x), r"[\[\]:*?/\\]", "_")), F.lit("")), F.lit("Sheet")), 1, 31)


def is_control(group, compound) -> Column:
    """A blank group or compound, or a control compound."""
    return is_blank(group) | is_blank(compound) | F.upper(clean_text(compound)).isin(*CONTROLS)
