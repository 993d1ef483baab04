"""Sinks: tables, partitioned sheets, logs, FASTA text, result sets."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helixframe.functions.seq import normalize_dna, safe_identifier
from helixframe.functions.textcells import clean_text, safe_sheet_name

#: The 15 columns of a scan result, in order.
MATCH_COLUMNS = (
    "transcript_name", "antisense_name", "as_region", "as_region_start", "as_region_end", "antisense_5to3", "as_region_sequence", "expected_target_5to3",
    "transcript_start", "transcript_end", "mismatches", "matched_target_5to3", "matched_as_view_5to3", "target_mismatch_positions", "as_mismatch_positions",
)


def write_table(df: DataFrame, path: str) -> None:
    """CSV for .csv and .txt names, Parquet otherwise."""
    if path.lower().endswith((".csv", ".txt")):
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


class Store:
    """A table of named parts that is replaced as a whole: data folders that never change, and numbered manifests.

    A manifest says which folder each part's rows are in, and their schema.  A new one appears
    under the next number by a rename that fails where the number is taken, so
    it is there as a whole or not at all, and of two writers the later one
    starts again from the other's.  Readers take the highest number; whatever a
    writer leaves behind that stops before its rename is never read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.files = self.jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.Path(f"{self.path}/{name}")

    def manifest(self) -> tuple[int, dict[str, list[str]]]:
        """The current number and manifest; 0 and nothing where there is none."""
        folder = self._at("_manifests")
        names = [f.getPath().getName() for f in self.files.listStatus(folder)] if self.files.exists(folder) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return 0, {}
        text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/_manifests/{max(numbers):012d}").collect())  # a line
        return max(numbers), json.loads(text)

    def _publish(self, number: int, manifest: dict[str, list[str]]) -> bool:
        """Whether the manifest got the number."""
        draft, place = self._at(f"_manifests/draft-{uuid.uuid4().hex}"), self._at(f"_manifests/{number:012d}")
        out = self.files.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self.jvm.FileContext.getFileContext(self.files.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm, "Options$Rename"), 0)
        try:
            context.rename(self.files.makeQualified(draft), self.files.makeQualified(place), options)
        except Py4JJavaError as e:
            self.files.delete(draft, False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def put(self, part: str, df: DataFrame, once: bool = False) -> bool:
        """Replace or add a part; once: leave one that is there alone.  Whether the rows count."""
        if once and part in self.manifest()[1]:
            return False
        folder = f"_data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        while True:
            number, now = self.manifest()
            if once and part in now:
                return False
            if self._publish(number + 1, {**now, part: [folder, df.schema.json()]}):
                return True

    def read(self) -> DataFrame:
        """All parts' rows; a folder that was never put into is read as a plain table."""
        number, now = self.manifest()
        if not number:
            return self.spark.read.parquet(self.path)
        alike: dict[str, list[str]] = {}
        for folder, schema in now.values():
            alike.setdefault(schema, []).append(f"{self.path}/{folder}")
        tables = [self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*folders) for schema, folders in alike.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)

    def clean(self) -> None:
        """Drop manifests and folders that the current one doesn't name; no reader or writer may be at work."""
        number, now = self.manifest()
        for folder, kept in (("_data", {f.split("/")[1] for f, _ in now.values()}), ("_manifests", {f"{number:012d}"})):
            for f in self.files.listStatus(self._at(folder)) if self.files.exists(self._at(folder)) else ():
                if f.getPath().getName() not in kept:
                    self.files.delete(f.getPath(), True)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return Store(spark, path).read()


def replace_sheet(df: DataFrame, path: str, workbook: str, sheet: str | Column) -> None:
    """Append or replace one sheet of one workbook in a store; other sheets stay, and readers see the old or the new one."""
    name = (sheet if isinstance(sheet, Column) else safe_sheet_name(F.lit(sheet))).alias("sheet")
    sheet = df.sparkSession.range(1).select(name).first()[0]
    rows = df.withColumn("workbook", F.lit(workbook)).withColumn("sheet", F.lit(sheet))
    Store(df.sparkSession, path).put(json.dumps([workbook, sheet]), rows)


def save_beside(df: DataFrame, path: str) -> str:
    """Write to a new path beside the source and return it; a path that is being read is never overwritten."""
    out = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.parquet(out)
    return out


def update_in_place(df: DataFrame, path: str) -> None:
    """df, which may come from path, as what read_store(path) gives from now on."""
    Store(df.sparkSession, path).put("table", df)


def default_sheet_name(kind: str, source: str) -> Column:
    """`plotdata-<source>` or `refqc-<source>`, as a sheet may be named."""
    return safe_sheet_name(F.lit(f"{kind}-{source}"))


def save_summary(df: DataFrame, sheets_path: str | None = None, workbook: str = "", source: str = "", kind: str = "plotdata", output: str | None = None) -> None:
    """As a sheet, as a file of its own, or both."""
    if sheets_path:
        replace_sheet(df, sheets_path, workbook, default_sheet_name(kind, source))
    if output:
        write_table(df, output)


def match_rows(matches: DataFrame) -> DataFrame:
    """The 15 columns with position lists joined by `;`."""
    lists = ("target_mismatch_positions", "as_mismatch_positions")
    return matches.select(*[F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if c in lists else F.col(c) for c in MATCH_COLUMNS])


def combine_hits(batches: dict[str, DataFrame]) -> DataFrame:
    """All batches' hits with their request id first."""
    out = None
    for rid, df in batches.items():
        rows = df.select(F.lit(rid).alias("rid"), "*")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no batches")
    return out


RESULT_TABLES = ("input_queries", "local_transcript_scan", "blast_hits_raw", "blast_hits_filtered", "blast_batches", "run_metadata")


def write_result_set(tables: dict[str, DataFrame], path: str) -> None:
    """Six tables under one run directory."""
    for name in RESULT_TABLES:
        if name in tables:
            tables[name].write.mode("overwrite").parquet(f"{path}/{name}")


def append_log(df: DataFrame, path: str, run: str | None = None, batch: str | None = None) -> bool:
    """Add a batch's rows to a store; a batch of a run that is there already isn't added again.  Whether it was added."""
    part = json.dumps([run, batch]) if batch is not None else uuid.uuid4().hex
    return Store(df.sparkSession, path).put(part, df, once=True)


def fasta_text(name, seq, width: int = 80) -> Column:
    """A FASTA record with DNA letters in lines of `width`."""
    body = F.regexp_replace(normalize_dna(seq), f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(F.lit(">"), safe_identifier(name), F.lit("\n"), body)


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    df.select(fasta_text(name, seq).alias("value")).write.mode("overwrite").text(path)


def range_text(df: DataFrame) -> DataFrame:
    """Adds the text of each range result of transcript_region(): a line a field."""
    fields = [
        ("source", F.col("source")), ("transcript_length_nt", F.col("transcript_length")), ("range_1based_inclusive", F.concat_ws("-", "start", "end")),
        ("selected_length_nt", F.length("ss_5to3")), ("SS_5to3", F.col("ss_5to3")), ("AS_5to3", F.col("as_5to3")),
    ]
    return df.withColumn("text", F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields]))
