"""Operators on oligo tables: regions, coordinates, duplicates, batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from helixframe.functions.seq import normalize_dna, normalize_rna, output_column_names, position_error, position_value, region_error, reverse_complement, safe_identifier, sequence_error, subsequence
from helixframe.functions.textcells import is_blank
from helixframe.operators import lineage

RESULT_COLUMNS = ("SS matched", "AS matched", "matched length (nt)", "match error")


def process_table(df: DataFrame, column: str, start: int = 2, end: int = 18) -> DataFrame:
    """Adds the normalised oligo, its region, the region's sense strand and an error; on any error all three are blank."""
    a, s = output_column_names(start, end)
    rna, lo, hi = normalize_rna(F.coalesce(F.col(column), F.lit(""))), F.lit(start), F.lit(end)
    error = F.coalesce(region_error(rna, lo, hi), F.lit(""))
    region = F.coalesce(subsequence(rna, lo, hi), F.lit(""))
    return df.withColumns({"normalized_antisense": F.when(error == "", rna).otherwise(""), a: region, s: reverse_complement(region), "error": error})


def transcript_region(df: DataFrame, seq: str = "seq", start: str = "start", end: str = "end") -> DataFrame:
    """Sense (the transcript's region) and antisense of each range, or a message.

    The cleaned transcript is a generated row of its own, as filters on the
    error would else clean it up again, once for each use.
    """
    rows = df.select("*", F.explode(F.array(normalize_rna(F.col(seq)))).alias("__rna"))
    error = region_error("__rna", F.col(start), F.col(end))
    ss = subsequence("__rna", F.col(start), F.col(end))
    return rows.withColumns({"transcript_length": F.length("__rna"), "ss_5to3": ss, "as_5to3": reverse_complement(ss), "error": error}).drop("__rna")


def ensure_result_columns(df: DataFrame) -> DataFrame:
    """Adds missing result columns as blanks and keeps those that are there."""
    return df.withColumns({c: F.lit("") for c in RESULT_COLUMNS if c not in df.columns})


def fill_ranges(ranges: DataFrame, transcripts: DataFrame, start: str = "start", end: str = "end", accession: str | None = None) -> DataFrame:
    """Fills the four result columns from text coordinates; a blank coordinate leaves all blank.

    With an accession column ranges meet their transcripts in an equi-join (an
    unknown one is an error); without, there must be just one transcript.
    """
    table = transcripts.select(F.col("accession").alias("__accession"), normalize_rna("seq").alias("__rna"))
    if accession:
        rows = ranges.join(table, F.col(accession) == F.col("__accession"), "left")
    else:
        if len(transcripts.select("accession").take(2)) > 1:
            raise ValueError("There are several transcripts: say which column of the ranges has their accessions.")
        rows = ranges.crossJoin(F.broadcast(table))
    a, b = position_value(start), position_value(end)
    blank = is_blank(F.col(start)) | is_blank(F.col(end))
    error = F.coalesce(position_error(start, start), position_error(end, end), F.when(F.col("__rna").isNull(), F.lit("Transcript not found.")), region_error("__rna", a, b))
    ss = F.when(~blank & error.isNull(), F.substr("__rna", a.cast("int"), (b - a + 1).cast("int")))
    out = {"SS matched": F.coalesce(ss, F.lit("")), "AS matched": F.coalesce(reverse_complement(ss), F.lit("")), "matched length (nt)": F.coalesce(F.length(ss).cast("string"), F.lit("")), "match error": F.when(blank, F.lit("")).otherwise(F.coalesce(error, F.lit("")))}
    return ensure_result_columns(rows).withColumns(out).drop("__accession", "__rna")


def duplicate_groups(queries: DataFrame) -> DataFrame:
    """(sequence, names): normalised sequences that come more than once, with their names in input order.

    Sequences that come once leave before names are gathered.
    """
    rna = queries.select("input_order", "name", normalize_rna("seq").alias("sequence"))
    again = rna.groupBy("sequence").count().filter("count > 1").select("sequence")
    names = F.transform(F.array_sort(F.collect_list(F.struct("input_order", "name"))), lambda x: x["name"])
    return rna.join(again, "sequence").groupBy("sequence").agg(F.array_join(names, ";").alias("names"))


def annotate_queries(queries: DataFrame) -> DataFrame:
    """Input rows with safe id, length, duplicate flag and the names of their duplicates.

    Each of m duplicates carries m names; flag_duplicates() and
    duplicate_members() say the same in rows that don't grow.
    """
    rows = queries.withColumn("sequence", normalize_rna("seq"))
    out = rows.join(duplicate_groups(queries), "sequence", "left")
    return out.select("input_order", "name", safe_identifier("name").alias("blast_id"), "sequence", F.length("sequence").alias("length"), F.col("names").isNotNull().alias("is_duplicate"), F.coalesce("names", F.lit("")).alias("duplicate_names"))


def _duplicate_counts(queries: DataFrame) -> DataFrame:
    counts = queries.groupBy(normalize_rna("seq").alias("sequence")).agg(F.min("input_order").alias("duplicate_group"), F.count("*").alias("duplicate_count"))
    return counts.filter("duplicate_count > 1")


def flag_duplicates(queries: DataFrame) -> DataFrame:
    """Input rows with safe id, length, duplicate flag, and the first input order and size of their group (null: none)."""
    rows = queries.withColumn("sequence", normalize_rna("seq"))
    out = rows.join(_duplicate_counts(queries), "sequence", "left")
    return out.select("input_order", "name", safe_identifier("name").alias("blast_id"), F.length("sequence").alias("length"), F.col("duplicate_group").isNotNull().alias("is_duplicate"), "duplicate_group", F.coalesce("duplicate_count", F.lit(1)).alias("duplicate_count"))


def duplicate_members(queries: DataFrame) -> DataFrame:
    """(duplicate_group, input_order, name): a row a name of each group."""
    rows = queries.select("input_order", "name", normalize_rna("seq").alias("sequence"))
    return rows.join(_duplicate_counts(queries), "sequence").select("duplicate_group", "input_order", "name")


def _packed(sizes: np.ndarray, budget: int, batch: int, used: int) -> tuple[list[int], int, int]:
    """The batch of each record, and the last batch with what it holds, when `used` bases of `batch` are taken before."""
    out = []
    for n in sizes.tolist():
        if not batch or used + n > budget:
            batch, used = batch + 1, 0
        used += n
        out.append(batch)
    return out, batch, used


def _packing_map(sizes: np.ndarray, budget: int) -> np.ndarray:
    """For each number of bases taken before (0..budget, and one more for an oversize record): batches opened, bases held at the end."""
    used, opened = np.arange(budget + 2), np.zeros(budget + 2, np.int64)
    for n in sizes.tolist():
        new = used + n > budget
        opened += new
        used = np.where(new, n, used + n)
    return np.stack([opened, used])


def pack_batches(queries: DataFrame, max_bases: int = 1000, key: str | None = None) -> DataFrame:
    """Adds batch_index (from 1): greedy packing in input order, a new batch when the budget would be passed.

    Rows are dealt by ranges of (key, input_order), so a key, or all rows
    without one, is spread over tasks.  A range that lies inside one key becomes
    a map from the bases taken before it (0..max_bases) to the batches it opens
    and the bases it leaves; the driver composes one such map a range, and each
    range is packed from its start.  Each row is packed where it lies, so rows
    of one input order stay apart; they come by their sequences' lengths, then
    by their other columns.  Rows without an order come after all others of
    their key, rows without a key are packed together.
    """
    rows = queries.withColumns({"__key": F.col(key) if key else F.lit(0), "__n": F.coalesce(F.length(normalize_dna("seq")), F.lit(0))})
    order = [F.col("__key"), F.col("input_order").asc_nulls_last()]
    ties = [f"`{f.name}`" for f in queries.schema if f.dataType.simpleString().split("<")[0] not in ("map", "variant")]
    dealt = lineage.cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    ordered = [F.col("__range"), *order, "__n", *ties]
    kinds = {f.name: f.dataType for f in dealt.schema}
    mapped_rows = dealt.select("__key", "__n", "__range", "input_order", *ties).repartition("__range").sortWithinPartitions(*ordered).select("__key", "__n", "__range")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, object, pa.Table]]:
        """(range, key, rows) of the sorted rows: a range's rows of one key at a time."""
        held: list[pa.RecordBatch] = []
        at_of = lambda b: b.column(b.schema.get_field_index("__range"))
        key_of = lambda b: b.column(b.schema.get_field_index("__key"))
        for b in batches:
            at, keys = np.array(at_of(b)), key_of(b)
            new = np.append(True, at[1:] != at[:-1])
            if b.num_rows > 1:
                one, two = keys.slice(1).to_pandas(), keys.slice(0, b.num_rows - 1).to_pandas()
                new[1:] |= ~(one.eq(two) | (one.isna() & two.isna())).to_numpy()
            starts = np.flatnonzero(new).tolist()
            for i, j in zip(starts, [*starts[1:], b.num_rows]):
                part = b.slice(i, j - i)
                if held and (at_of(held[0])[0] != at_of(part)[0] or key_of(held[0])[0] != key_of(part)[0]):
                    yield at_of(held[0])[0].as_py(), key_of(held[0])[0].as_py(), pa.Table.from_batches(held)
                    held = []
                held.append(part)
        if held:
            yield at_of(held[0])[0].as_py(), key_of(held[0])[0].as_py(), pa.Table.from_batches(held)

    def mapped(batches):
        first: dict[int, list] = {}
        for at, k, part in ranges(batches):
            sizes = part.column("__n").to_numpy()
            if at not in first:
                first[at] = [k, k, _packing_map(sizes, max_bases).tobytes(), 0, 0]
            else:
                first[at][2] = b""  # several keys: what comes before doesn't reach the end
            _, batch, used = _packed(sizes, max_bases, 0, 0)
            first[at][1], first[at][3:] = k, [batch, used]
        cols = [pa.array(list(first), pa.int32())]
        cols += [pa.array([v[i] for v in first.values()], t) for i, t in enumerate((to_arrow_type(kinds["__key"]), to_arrow_type(kinds["__key"]), pa.binary(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["at", "first", "last", "map", "batch", "used"])

    name = kinds["__key"].simpleString()
    found = mapped_rows.mapInArrow(mapped, f"at int, first {name}, last {name}, map binary, batch long, used long").collect()  # a row a range
    starts, end = {}, None
    for r in sorted(found, key=lambda r: r["at"]):
        goes_on = end is not None and end[0] == r["first"]
        starts[r["at"]] = end if goes_on else (r["first"], 0, 0)
        if goes_on and r["map"]:
            opened, used = np.frombuffer(r["map"], np.int64).reshape(2, -1)[:, min(end[2], max_bases + 1)].tolist()
            end = (r["last"], end[1] + opened, used)
        else:
            end = (r["last"], r["batch"], r["used"])

    def placed(batches):
        for at, k, part in ranges(batches):
            own = starts[at]
            out, _, _ = _packed(part.column("__n").to_numpy(), max_bases, *(own[1:] if own[0] == k else (0, 0)))
            whole = part.drop_columns(["__key", "__n", "__range"]).append_column("batch_index", pa.array(out, pa.int32()))
            yield from whole.combine_chunks().to_batches()

    sorted_rows = dealt.repartition("__range").sortWithinPartitions(*ordered)
    return sorted_rows.mapInArrow(placed, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema) + ", batch_index int")


def batch_stats(packed: DataFrame, key: str | None = None) -> DataFrame:
    """Queries, bases and names of each batch (with a key, of each batch of each key)."""
    names = F.transform(F.array_sort(F.collect_list(F.struct(F.col("input_order").isNull().alias("last"), "input_order", "name"))), lambda x: x["name"])
    return packed.groupBy(*([key] if key else []), "batch_index").agg(F.count("*").alias("query_count"), F.sum(F.length(normalize_dna("seq"))).alias("total_bases"), F.array_join(names, ";").alias("names"))


def run_metadata(queries: DataFrame, settings: dict[str, str]) -> DataFrame:
    """(key, value) rows: the settings, then the query count and total bases."""
    spark = queries.sparkSession
    fixed = spark.createDataFrame(sorted(settings.items()), "key string, value string")
    totals = queries.agg(F.count("*").cast("string").alias("query_count"), F.coalesce(F.sum(F.length(normalize_dna("seq"))), F.lit(0)).cast("string").alias("total_bases"))
    return fixed.unionByName(totals.unpivot([], ["query_count", "total_bases"], "key", "value"))


def sequence_errors(df: DataFrame, column: str) -> DataFrame:
    rna = normalize_rna(F.coalesce(F.col(column), F.lit("")))
    return df.withColumn("rna", rna).withColumn("error", F.coalesce(sequence_error("rna"), F.lit("")))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """input_order from 1 by a source position."""
    return lineage.numbered(df, order)
