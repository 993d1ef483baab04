"""Sources: delimited tables, FASTA, plain lists, oligo tables, hit reports, workbooks."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from io import BytesIO
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions.seq import normalize_rna
from helixframe.functions.textcells import clean_text
from helixframe.operators.hits import HIT_COLUMNS
from helixframe.operators.lineage import cut, numbered
from helixframe.operators.oligo import transcript_region

CELLS = "workbook string, sheet string, sheet_index int, row int, col int, value string, formula string"
MERGES = "workbook string, sheet string, min_row int, min_col int, max_row int, max_col int"
#: Header names of an oligo table, by role.
ALIASES = {
    "seq": ("antisense", "as", "as_sequence", "as sequence", "sequence"),
    "name": ("name", "id", "oligo", "oligo id", "oligo_id", "as name"),
    "target_accession": ("target_accession", "target accession", "refseq", "refseq accession"),
    "target_gene": ("target_gene", "target gene", "gene"),
    "species": ("species",),
    "notes": ("notes",),
}
#: Texts that are no value in a table of oligos.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited table as texts; the first row is the header, blanks are ""."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"').na.fill("")


def read_raw_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=False, inferSchema=False, multiLine=True, escape='"')


def find_column(df: DataFrame, name: str) -> str:
    """A column by name, any case."""
    found = next((c for c in df.columns if c.strip().lower() == name.strip().lower()), None)
    if found is None:
        raise ValueError(f"Column '{name}' not found. Available columns: {', '.join(df.columns)}")
    return found


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^\\x{FEFF}", "").alias("text"))


FASTA_MARK = r"(?m)^[^\S\r\n]*>"


def fasta_records(texts: DataFrame) -> DataFrame:
    """(file, input_order, name, seq) of each record of texts in a column; what stands before the first header is dropped, blank names are AS_<ordinal>."""
    return _named(texts.select("file", F.posexplode(F.split("text", FASTA_MARK)).alias("input_order", "record")).filter("input_order > 0"))


def _named(records: DataFrame) -> DataFrame:
    name = F.trim(F.regexp_extract("record", r"^([^\r\n]*)", 1))
    body = F.regexp_replace("record", r"^[^\r\n]*", "")
    return records.select("file", "input_order", F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("AS_"), F.col("input_order"))).alias("name"), normalize_rna(body).alias("seq"))


def _stripped(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))


def plain_records(texts: DataFrame) -> DataFrame:
    """(file, input_order, name, seq) of lists of `seq`, `name,seq`, `name<TAB>seq`, `name seq`; unnamed ones count records, not lines."""
    lines = texts.select("file", F.posexplode(F.split("text", r"\R")).alias("n", "line")).withColumn("line", _stripped(F.col("line"))).filter("line <> '' AND line NOT LIKE '#%'")
    return _list_fields(lines.withColumn("input_order", F.row_number().over(Window.partitionBy("file").orderBy("n"))))


def _list_fields(rows: DataFrame) -> DataFrame:
    parts = F.when(F.contains("line", F.lit(",")), F.split("line", ",", 2)).when(F.contains("line", F.lit("\t")), F.split("line", "\t", 2)).otherwise(F.split("line", r"\s+", 2))
    rows, two = rows.withColumn("p", parts), F.size("p") == 2
    return rows.select("file", "input_order", F.when(two, F.trim(F.get("p", 0))).otherwise(F.concat(F.lit("AS_"), F.col("input_order"))).alias("name"), normalize_rna(F.when(two, F.get("p", 1)).otherwise(F.get("p", 0))).alias("seq"))


def _ordinals(rows: DataFrame, count: Column) -> DataFrame:
    """`before`: how many records (count: those of a row) come before each row in its file.

    rows: file, block (where a split begins) and at (order in a split).  Rows
    are counted split by split, and a split's total goes to those behind it, so
    a file of any size is many groups, none larger than a split.
    """
    own = Window.partitionBy("file", "block").orderBy("at")
    counted = rows.withColumn("__count", count).withColumn("__until", F.sum("__count").over(own))
    totals = rows.withColumn("__count", count).groupBy("file", "block").agg(F.sum("__count").alias("__total"))
    offsets = totals.withColumn("__offset", F.sum("__total").over(Window.partitionBy("file").orderBy("block")) - F.col("__total")).drop("__total")
    return counted.join(offsets, ["file", "block"]).withColumn("before", F.col("__offset") + F.col("__until") - F.col("__count")).drop("__count", "__until", "__offset")


def _in_splits(spark: SparkSession, path: str, mark: str | None = None) -> DataFrame:
    """(file, block, at, value): pieces of text files between marks (none: lines), a file read by as many tasks as it has splits."""
    raw = spark.read.text(path, **({"lineSep": mark} if mark else {}))
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, input_order, name, seq) of each FASTA record, as fasta_records() of whole texts, but no row holds more than a record.

    Files are cut at line ends before `>`, wherever a split begins; headers
    that stand after blanks or a lone carriage return are found in the pieces.
    """
    pieces = _in_splits(spark, path, "\n>")
    first = (F.col("block") == 0) & (F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) == 1)
    text = F.when(first, F.regexp_replace("value", "^\\x{FEFF}", "")).otherwise(F.concat(F.lit(">"), F.col("value")))
    records = F.slice(F.split(text, FASTA_MARK), 2, 1 << 30)  # what stands before the first header is dropped
    rows = _ordinals(pieces.withColumn("records", records).drop("value"), F.size("records"))
    return _named(rows.select("file", F.col("before").cast("int").alias("before"), F.posexplode("records").alias("n", "record")).withColumn("input_order", F.col("before") + F.col("n") + 1))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, input_order, name, seq) of lists, as plain_records() of whole texts, line by line."""
    pieces = _in_splits(spark, path)
    lines = F.filter(F.transform(F.split(F.regexp_replace("value", "^\\x{FEFF}", ""), r"\R"), _stripped), lambda x: (x != "") & ~x.startswith("#"))
    rows = _ordinals(pieces.withColumn("lines", lines).drop("value"), F.size("lines"))
    each = rows.select("file", "before", F.posexplode("lines").alias("n", "line")).withColumn("input_order", (F.col("before") + F.col("n") + 1).cast("int"))
    return _list_fields(each)


def read_antisense(spark: SparkSession, path: str) -> DataFrame:
    """Files of either kind: FASTA where a line starts with `>`; a file without records is an error."""
    lines = _in_splits(spark, path)
    # a blank of any line kind before `>` counts, as in whole texts
    kinds = cut(lines.groupBy("file").agg(F.bool_or(F.col("value").rlike(r"(?m)^\s*\x{FEFF}?\s*>")).alias("fasta")))
    fasta, lists = (kinds.filter(F.col("fasta") == is_fasta).select("file") for is_fasta in (True, False))
    records = read_fasta(spark, path).join(fasta, "file", "left_semi").unionByName(read_list(spark, path).join(lists, "file", "left_semi"))
    bare = kinds.join(records.select("file"), "file", "left_anti").first()
    if bare:
        raise ValueError(f"No antisense sequences found in {bare['file']}.")
    return records


def first_header(text: str) -> F.Column:
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^\s*>([^\r\n]*)", 1)), F.lit(""))


def all_sequence(text: str) -> F.Column:
    """All records of a text joined, `>` and `;` lines dropped."""
    return normalize_rna(F.array_join(F.filter(F.split(text, r"\R"), lambda x: ~F.trim(x).rlike("^[>;]")), ""))


def whole_sequences(texts: DataFrame, fallback: F.Column) -> DataFrame:
    """(accession, seq) of texts, each one sequence; name from the first header, else the fallback."""
    return texts.select(F.coalesce(first_header("text"), fallback).alias("accession"), all_sequence("text").alias("seq"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as one sequence each, named by their first header, else by the file."""
    return whole_sequences(_texts(spark, path), F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1))


def transcript_input(spark: SparkSession, sequence: str | None = None, file: str | None = None, accession: str | None = None, table: DataFrame | None = None) -> DataFrame:
    """(accession, seq) of exactly one of a literal text, a file, or an accession in a table of transcripts; an unknown accession is an error."""
    if sum(x is not None for x in (sequence, file, accession)) != 1:
        raise ValueError("Provide exactly one of a sequence, a file, or an accession.")
    if sequence is not None:
        return whole_sequences(spark.createDataFrame([(sequence,)], "text string"), F.lit("target_transcript"))
    if file is not None:
        return whole_sequences(_texts(spark, file), F.regexp_extract("file", r"([^/]+)$", 1))
    found = table.filter(F.col("accession") == accession).select("accession", normalize_rna("seq").alias("seq"))
    if found.isEmpty():
        raise ValueError(f"No transcript {accession}.")
    return found


def texts_to_oligos(texts: DataFrame, source: str = "file", start: str = "start", end: str = "end") -> DataFrame:
    """Sense and antisense of a range of each FASTA or plain text: source (first header, else the column), lengths, strands, error."""
    rows = texts.withColumns({"source": F.coalesce(first_header("text"), F.col(source), F.lit("transcript")), "seq": all_sequence("text")})
    return transcript_region(rows, "seq", start, end).drop("seq")


def read_oligo_table(spark: SparkSession, path: str, sequence_column: str | None = None, name_column: str | None = None, target_accession_column: str | None = None) -> DataFrame:
    """input_order, name, seq and the other four fields; header names are aliases, the first column is the sequence otherwise.

    Rows without a sequence are skipped but count in default names.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', nullValue="")
    known = {" ".join(c.split()).lower(): c for c in raw.columns}  # a later duplicate wins
    given = {"seq": sequence_column, "name": name_column, "target_accession": target_accession_column}

    def column(role: str) -> str | None:
        if given.get(role):
            return find_column(raw, given[role])
        return next((known[a] for a in ALIASES[role] if a in known), None)

    seq = column("seq") or raw.columns[0]
    null = lambda c: F.when(~F.trim(F.col(c)).isin(*MISSING), F.trim(F.col(c)))
    rows = numbered(raw.withColumn("__at", F.monotonically_increasing_id()), ["__at"])
    fields = [F.coalesce(clean_text(null(column(r))), F.lit("")).alias(r) if column(r) else F.lit("").alias(r) for r in ("target_accession", "target_gene", "species", "notes")]
    name = F.nullif(clean_text(null(column("name"))), F.lit("")) if column("name") else F.lit(None).cast("string")
    found = rows.filter(null(seq).isNotNull()).select("input_order", F.coalesce(name, F.concat(F.lit("AS_"), F.col("input_order"))).alias("name"), normalize_rna(null(seq)).alias("seq"), *fields)
    if found.isEmpty():
        raise ValueError(f"No antisense sequences found in {path}.")
    return found


def antisense_queries(spark: SparkSession, sequence: str | None = None, file: str | None = None, table: str | None = None) -> DataFrame:
    """Exactly one of a literal sequence, a file or a table."""
    if sum(x is not None for x in (sequence, file, table)) != 1:
        raise ValueError("Provide exactly one of a sequence, a file, or a table.")
    if sequence is not None:
        return spark.createDataFrame([(1, "antisense_query", sequence)], "input_order int, name string, seq string").withColumn("seq", normalize_rna("seq"))
    return read_antisense(spark, file) if file is not None else read_oligo_table(spark, table)


def parse_hits(lines: DataFrame) -> DataFrame:
    """Rows with exactly 12 fields of report lines (column value); `#` and empty lines are skipped, quoted commas kept."""
    ddl = ", ".join(f"{c} string" for c in HIT_COLUMNS) + ", __bad string"
    rows = lines.filter("value IS NOT NULL AND trim(value) <> '' AND NOT startswith(value, '#')")
    parsed = rows.select(F.from_csv("value", F.lit(ddl), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("h"))
    return parsed.filter("h.__bad IS NULL").select("h.*").drop("__bad")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return parse_hits(spark.read.text(path))


def read_summary(df: DataFrame, required: list[str], numeric: list[str]) -> DataFrame:
    """A summary with all required columns; numeric ones as numbers, rows where one is not drop out."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {', '.join(missing)}")
    return df.withColumns({c: F.col(c).try_cast("double") for c in numeric}).na.drop(subset=numeric)


#: The format numbers that show days or times, and those of a span of time.
DATE_FORMATS, SPAN_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}, {46}
#: In a formula: a text, a quoted sheet name, a cell, whole columns, whole rows.
FORMULA_PART = re.compile(r"""("(?:[^"]|"")*")|('(?:[^']|'')*')|(?<![\w.$!?\\])(?<!\$)((?:\$?[A-Za-z]{1,3}\$?[1-9][0-9]{0,6})(?![\w.(!])|(?:\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3})(?![\w.(!])|(?:\$?[1-9][0-9]{0,6}:\$?[1-9][0-9]{0,6})(?![\w.(!]))|(?<=!)((?:\$?[A-Za-z]{1,3}\$?[1-9][0-9]{0,6})(?![\w.(!])|(?:\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3})(?![\w.(!])|(?:\$?[1-9][0-9]{0,6}:\$?[1-9][0-9]{0,6})(?![\w.(!]))""")
PLACE = re.compile(r"(\$?)([A-Za-z]{1,3})?(\$?)([0-9]+)?")
#: Cells in a batch, and bytes of a sheet that are parsed at once.
BATCH, CHUNK = 20_000, 1 << 16
SPREADSHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
CELL_TYPE = pa.struct([("workbook", pa.string()), ("sheet", pa.string()), ("sheet_index", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.string()), ("formula", pa.string())])
MERGE_TYPE = pa.struct([("workbook", pa.string()), ("sheet", pa.string()), *((n, pa.int32()) for n in ("min_row", "min_col", "max_row", "max_col"))])


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def shifted(formula: str, rows: int, cols: int) -> str:
    """A formula as it reads so many rows and columns further: relative references move, those with $ stay, texts and names stay."""

    def one(ref: str) -> str:
        fixed_col, letters, fixed_row, digits = PLACE.fullmatch(ref).groups()
        if letters and not digits:
            fixed_row = ""
        if digits and not letters:  # a row alone: its $ was read as the column's
            fixed_col, fixed_row = "", fixed_col or fixed_row
        col = column_number(letters) + (0 if fixed_col else cols) if letters else None
        row = int(digits) + (0 if fixed_row else rows) if digits else None
        if col is not None and not 1 <= col <= 16384 or row is not None and not 1 <= row <= 1048576:
            return "#REF!"
        return (fixed_col + column_letters(col) if col else "") + (fixed_row + str(row) if row else "")

    def moved(m: re.Match) -> str:
        ref = m[3] or m[4]
        return ":".join(map(one, ref.split(":"))) if ref else m[0]

    return FORMULA_PART.sub(moved, formula)


def shows_date(code: str) -> str | None:
    """What a format code shows: "date", "span" (hours over a day), or None."""
    if re.search(r"\[(h+|m+|s+)\]", code, re.I):
        return "span"
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]', "", code.split(";")[0])
    return "date" if re.search("[dmyhs]", bare, re.I) and not re.search("[#0?]", bare.replace(".0", "").replace(".00", "")) else None


def serial_text(number: float, kind: str, epoch1904: bool = False) -> str:
    """A serial number as the text of its day and time, of its time of day (under one day), or of a span."""
    if kind == "span":
        return str(timedelta(milliseconds=round(number * 86_400_000)))
    day, part = divmod(number, 1)
    rest = timedelta(milliseconds=round(part * 86_400_000))
    if 0 <= number < 1 and not rest.days:
        return str((datetime.min + rest).time())
    if not epoch1904 and 0 < number < 60:  # the day that 1900 didn't have comes later
        day += 1
    return str((datetime(1904, 1, 1) if epoch1904 else datetime(1899, 12, 30)) + timedelta(days=day) + rest)


def plain_string(item: ET.Element) -> str:
    """The text of a string item; runs that show how it is read aloud are no part of it."""
    return "".join(t.text or "" for part in item if part.tag in (f"{SPREADSHEET}t", f"{SPREADSHEET}r") for t in part.iter(f"{SPREADSHEET}t"))


def _date_styles(styles: bytes | None) -> list[str | None]:
    """For each cell style what its number format shows."""
    if not styles:
        return []
    root = ET.fromstring(styles)
    own = {int(f.get("numFmtId")): shows_date(f.get("formatCode") or "") for f in root.iter(f"{SPREADSHEET}numFmt")}
    kinds = lambda n: own[n] if n in own else "date" if n in DATE_FORMATS else "span" if n in SPAN_FORMATS else None
    xfs = root.find(f"{SPREADSHEET}cellXfs")
    return [] if xfs is None else [kinds(int(x.get("numFmtId") or 0)) for x in xfs]


def _sheet_parts(path: str, data: bytes):
    """(index, name, deflated sheet, shared strings, styles, 1904) of each sheet of an xlsx or xlsm file."""
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(BytesIO(data)) as z:
        names = set(z.namelist())
        part = lambda name: z.read(name) if name in names else None
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ET.fromstring(z.read("xl/workbook.xml"))
        properties = book.find(f"{SPREADSHEET}workbookPr")
        epoch1904 = properties is not None and properties.get("date1904") in ("1", "true")
        strings, styles = part("xl/sharedStrings.xml"), part("xl/styles.xml")
        packed = zlib.compress(strings, 1) if strings else None
        for index, s in enumerate(book.find(f"{SPREADSHEET}sheets")):
            target = targets[s.get(rel)].lstrip("/")
            info = z.getinfo(target if target.startswith("xl/") else f"xl/{target}")
            size = int.from_bytes(data[info.header_offset + 26 : info.header_offset + 28], "little") + int.from_bytes(data[info.header_offset + 28 : info.header_offset + 30], "little")
            start = info.header_offset + 30 + size
            raw = data[start : start + info.compress_size] if info.compress_type == zipfile.ZIP_DEFLATED else zlib.compress(z.read(info), 1)[2:-4]
            yield index, s.get("name"), raw, packed, styles, epoch1904


def sheet_cells(path: str, name: str, index: int, raw: bytes, strings: bytes | None, styles: bytes | None, epoch1904: bool):
    """("cell" or "merge", record) of one sheet, read forward: no more of it than a row is held."""
    shared = [plain_string(si) for si in ET.fromstring(zlib.decompress(strings)).findall(f"{SPREADSHEET}si")] if strings else []
    dates, masters = _date_styles(styles), {}
    at = re.compile(r"([A-Z]+)(\d+)")

    def place(ref: str) -> tuple[int, int]:
        letters, row = at.match(ref).groups()
        return int(row), column_number(letters)

    def cell(c: ET.Element):
        row, col = place(c.get("r"))
        v, f, inline = c.find(f"{SPREADSHEET}v"), c.find(f"{SPREADSHEET}f"), c.find(f"{SPREADSHEET}is")
        value, kind = None if v is None else v.text, c.get("t")
        if kind == "s" and value is not None:
            value = shared[int(value)]
        elif inline is not None:
            value = plain_string(inline)
        elif kind == "d" and value is not None:
            value = str(datetime.fromisoformat(value))
        elif kind in (None, "n") and value is not None:
            style = int(c.get("s") or 0)
            shown = dates[style] if style < len(dates) else None
            value = serial_text(float(value), shown, epoch1904) if shown else value
        formula = None if f is None or not f.text else f.text
        if f is not None and f.get("t") == "shared":
            if formula:
                masters[f.get("si")] = (row, col, formula)
            elif f.get("si") in masters:
                first_row, first_col, text = masters[f.get("si")]
                formula = shifted(text, row - first_row, col - first_col)
        return "cell", (path, name, index, row, col, value, None if formula is None else "=" + formula)

    undo, parser, data = zlib.decompressobj(-15), ET.XMLPullParser(("start", "end")), None
    for i in range(0, len(raw), CHUNK):
        rest = raw[i : i + CHUNK]
        while rest:
            parser.feed(undo.decompress(rest, CHUNK))
            rest = undo.unconsumed_tail
            for event, e in parser.read_events():
                if event == "start":
                    data = e if e.tag == f"{SPREADSHEET}sheetData" else data
                elif e.tag == f"{SPREADSHEET}c":
                    yield cell(e)
                elif e.tag == f"{SPREADSHEET}row":
                    data.clear()
                elif e.tag == f"{SPREADSHEET}mergeCell":
                    a, _, b = e.get("ref").partition(":")
                    yield "merge", (path, name, *place(a), *place(b or a))


def read_workbooks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells, merges) of all workbooks under a path."""
    return decode_workbooks(spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").load(path))


def decode_workbooks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, merges) of workbook files (path, content).

    Each sheet is a unit of its own: its part of the file, still deflated, is
    dealt out with the strings and styles it refers to, and parsed forward into
    batches.  Filled-down formulas are written out, days and times are texts as
    a sheet shows them (yyyy-mm-dd hh:mm:ss).
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                parts = list(_sheet_parts(path, content.as_buffer().to_pybytes()))
                cols = [pa.array([p[i] for p in parts], t) for i, t in enumerate((pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(parts), pa.string()), *cols], ["path", "index", "name", "raw", "strings", "styles", "epoch1904"])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                path, index, name, raw, strings, styles, epoch1904 = (c[r].as_py() for c in b.columns)
                found = sheet_cells(path, name, index, raw, strings, styles, epoch1904)
                while held := list(islice(found, BATCH)):
                    record = lambda kind, type_: pa.array([dict(zip((f.name for f in type_), x)) if k == kind else None for k, x in held], type_)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held]), record("cell", CELL_TYPE), record("merge", MERGE_TYPE)], ["kind", "cell", "merge"])

    sheets = files.select("path", "content").mapInArrow(split, "path string, index int, name string, raw binary, strings binary, styles binary, epoch1904 boolean")
    dealt = sheets.repartition("path", "index")
    kept = cut(dealt.mapInArrow(decoded, f"kind string, cell struct<{CELLS.replace(' ', ': ').replace(',: ', ', ')}>, merge struct<{MERGES.replace(' ', ': ').replace(',: ', ', ')}>"))
    return kept.filter("kind = 'cell'").select("cell.*"), kept.filter("kind = 'merge'").select("merge.*")
