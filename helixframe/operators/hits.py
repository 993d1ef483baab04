"""Alignment hits: join to queries, alignment fraction, filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.seq import normalize_dna, safe_identifier
from helixframe.functions.textcells import whole_number

HIT_COLUMNS = ("query_id", "subject_id", "percent_identity", "alignment_length", "mismatches", "gap_opens", "query_start", "query_end", "subject_start", "subject_end", "evalue", "bit_score")


def query_lengths(queries: DataFrame) -> DataFrame:
    """(query_id, query_length): of repeated ids the last input row holds."""
    rows = queries.select(safe_identifier("name").alias("query_id"), F.length(normalize_dna("seq")).alias("n"), "input_order")
    return rows.groupBy("query_id").agg(F.max_by("n", "input_order").alias("query_length"))


def enrich_hits(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds query_length and alignment_fraction (null for unknown queries or unreadable lengths)."""
    rows = hits.join(query_lengths(queries), "query_id", "left")
    return rows.withColumn("alignment_fraction", F.try_divide(whole_number("alignment_length").cast("double"), F.col("query_length")))


def filter_hits(enriched: DataFrame, max_mismatches: int = 3, max_gap_opens: int = 0, min_fraction: float = 0.8) -> DataFrame:
    """Rows within all limits; decimals count with their whole part, what can't be read drops out."""
    return enriched.filter((whole_number("mismatches") <= max_mismatches) & (whole_number("gap_opens") <= max_gap_opens) & (F.col("alignment_fraction") >= min_fraction))
