"""Column expressions on nucleotide sequences.

Every function takes and returns Columns; errors are a nullable message
column, which strict callers turn into raise_error() with `strictly`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EMPTY_MESSAGE = "Sequence is empty after cleanup."


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_rna(x) -> Column:
    """Letters only, upper case, T as U."""
    return F.translate(F.upper(F.regexp_replace(col(x), "[^A-Za-z]", "")), "T", "U")


def normalize_dna(x) -> Column:
    return F.translate(normalize_rna(x), "U", "T")


def invalid_bases(x) -> Column:
    """Sorted distinct letters of a normalised sequence that are not bases, comma-separated."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(col(x), "[AUCG]", ""), ""))), ", ")


def sequence_error(rna) -> Column:
    """Why a normalised sequence can't be used, or null."""
    rna = F.coalesce(col(rna), F.lit(""))
    return F.when(rna == "", F.lit(EMPTY_MESSAGE)).when(rna.rlike("[^AUCG]"), F.concat(F.lit("Sequence contains invalid bases: "), invalid_bases(rna)))


def complement(rna) -> Column:
    return F.translate(col(rna), "AUCG", "UAGC")


def reverse_complement(rna) -> Column:
    return F.reverse(complement(rna))


def region_error(rna, start, end) -> Column:
    """Checks in order: start, order of bounds, bases, length."""
    rna, start, end = col(rna), col(start), col(end)
    return (
        F.when(start < 1, F.lit("Start position must be 1 or greater."))
        .when(end < start, F.lit("End position must be greater than or equal to start."))
        .when(sequence_error(rna).isNotNull(), sequence_error(rna))
        .when(F.length(rna) < end, F.concat(F.lit("Sequence must be at least "), end.cast("string"), F.lit(" nt long.")))
    )


def subsequence(rna, start, end) -> Column:
    """1-based inclusive; null where region_error() has a message."""
    start, end = col(start).cast("int"), col(end).cast("int")
    return F.when(region_error(rna, start, end).isNull(), F.substring(col(rna), start, end - start + 1))


def output_column_names(start: int, end: int) -> tuple[str, str]:
    return f"antisense_{start}-{end}_5to3", f"sense_{end}-{start}_5to3"


def safe_identifier(x, default: str = "antisense_query") -> Column:
    """White space collapsed, other characters as underscores, none at the ends; blank: the default."""
    text = F.trim(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)\s+", " "))
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_.:-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit(default))


def position_value(x) -> Column:
    """A coordinate cell as int: commas dropped, 12.0 allowed; null where position_error() has a message."""
    n = _number(x)
    return F.when((n == F.floor(n)) & (n >= 1), n.cast("long"))


def _number(x) -> Column:
    text = F.trim(F.regexp_replace(col(x), ",", ""))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def position_error(x, name: str) -> Column:
    n, shown = _number(x), col(x).cast("string")
    said = lambda what: F.concat(F.lit(f"{name} {what}: "), shown)
    return (
        F.when(F.trim(F.regexp_replace(shown, ",", "")) == "", F.lit(f"{name} is empty"))
        .when(n.isNull(), said("is not a number"))
        .when(n != F.floor(n), said("must be a whole number"))
        .when(n < 1, said("must be 1 or greater"))
    )


def mismatch_positions(a, b) -> Column:
    """1-based places where two sequences of one length differ."""
    a, b = col(a), col(b)
    places = F.when(F.length(a) > 0, F.sequence(F.lit(1), F.length(a))).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))


#: A scan region: the whole oligo, or bounds with or without a name before them.
REGION = r"(?i)^\s*(?:(full)|(?:([^:]*):)?\s*([0-9]{1,9})\s*-\s*([0-9]{1,9}))\s*$"


def region_columns(spec) -> dict[str, Column]:
    """name, start, end (null bounds: the whole oligo) and error of region texts, a table at a time; blank names are the bounds."""
    part = lambda i: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(col(spec), REGION, i), r"(?U)\s+", " ")), F.lit(""))
    full, start, end = part(1).isNotNull(), part(3).try_cast("int"), part(4).try_cast("int")
    shown = F.concat(F.lit("'"), F.coalesce(col(spec), F.lit("")), F.lit("'"))
    error = (
        F.when(F.trim(F.regexp_replace(F.coalesce(col(spec), F.lit("")), r"(?U)\s+", " ")) == "", F.lit("A scan region is blank."))
        .when(~full & start.isNull(), F.concat(F.lit("Not a scan region (full, 2-18 or seed:2-8): "), shown))
        .when((start < 1) | (end < start), F.concat(F.lit("Scan region out of order: "), shown))
    )
    name = F.when(full, F.lit("full")).otherwise(F.coalesce(part(2), F.concat_ws("-", start, end)))
    return {"name": F.when(error.isNull(), name), "start": F.when(error.isNull(), start), "end": F.when(error.isNull(), end), "error": error}


def region_table(spark: SparkSession, specs: list[str] | None) -> DataFrame:
    """(region_order, spec, name, start, end, error) of a list of region texts; none: the whole oligo."""
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(specs or ["full"])], "region_order int, spec string")
    return rows.withColumns(region_columns("spec"))


def scan_regions(specs: list[str] | None) -> list[tuple[str, int | None, int | None]]:
    """(name, start, end) of a parameter list; the first text that is no region is an error."""
    found = region_table(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), specs).orderBy("region_order").collect()
    for r in found:
        if r["error"]:
            raise ValueError(r["error"])
    return [(r["name"], r["start"], r["end"]) for r in found]


def scan_region(spec: str) -> tuple[str, int | None, int | None]:
    return scan_regions([spec])[0]


def service_field(text, name: str) -> Column:
    """The value of a `NAME = value` line."""
    return F.nullif(F.regexp_extract(col(text), rf"(?m)^\s*{name}\s*=\s*(\S+)\s*$", 1), F.lit(""))


def strictly(value: Column, error: Column) -> Column:
    """value, or an error for the whole run at the first message."""
    return F.when(error.isNotNull(), F.raise_error(error)).otherwise(value)
