"""Worksheets as a long table of cells, for many workbooks in one plan.

cells: workbook, sheet, sheet_index, row, col (1-based), value, formula.
What looks at whole rows also takes cells row by row (see by_row).
Blocks (side-by-side tables) are found per (workbook, sheet); header rows are
the first two rows, data starts in the third.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import formulas
from helixframe.functions.textcells import clean_text, is_blank, looks_like_gene, parse_number, sheet_prefix, tokens
from helixframe.operators.lineage import cut

SHEET = ["workbook", "sheet"]
BLOCK = [*SHEET, "block"]
HEADER_SEARCH_ROWS = 20


def fill_merges(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Every cell of a merged range gets the range's top-left value (equi-join on the cell; ranges are exploded first)."""
    spots = merges.select(*SHEET, "min_row", "min_col", F.explode(F.sequence("min_row", "max_row")).alias("row"), "max_col")
    spots = spots.select(*SHEET, "min_row", "min_col", "row", F.explode(F.sequence("min_col", "max_col")).alias("col"))
    tops = cells.select(*SHEET, F.col("row").alias("min_row"), F.col("col").alias("min_col"), F.col("value").alias("top"))
    filled = spots.join(tops, [*SHEET, "min_row", "min_col"], "left").groupBy(*SHEET, "row", "col").agg(F.first("top").alias("top"), F.lit(True).alias("merged"))
    joined = cells.join(filled, [*SHEET, "row", "col"], "full")
    index = cells.groupBy(*SHEET).agg(F.max("sheet_index").alias("__index"))  # a row a sheet
    joined = joined.join(index, SHEET, "left")
    return joined.select(*SHEET, F.coalesce("sheet_index", "__index").alias("sheet_index"), "row", "col", F.when(F.col("merged"), F.col("top")).otherwise(F.col("value")).alias("value"), "formula")


def trim_edges(cells: DataFrame) -> DataFrame:
    """Without the rows below and the columns right of the last value of each sheet."""
    used = cells.filter("value IS NOT NULL").groupBy(*SHEET).agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))
    return cells.join(used, SHEET).filter("row <= last_row AND col <= last_col").drop("last_row", "last_col")


def sheet_catalogue(cells: DataFrame) -> DataFrame:
    return cells.select("workbook", "sheet", "sheet_index").distinct()


def require_modern(path: str) -> None:
    if not path.lower().endswith((".xlsx", ".xlsm")):
        raise ValueError("Only .xlsx and .xlsm workbooks are supported.")


def result_sheets(catalogue: DataFrame, prefix: str, wanted: str | None = None) -> DataFrame:
    """(workbook, sheet): the named sheet where it has the prefix, else the last one that does; null sheet: none."""
    fits = sheet_prefix("sheet", prefix)
    if wanted is not None:
        fits = fits & (F.col("sheet") == wanted)
    return catalogue.groupBy("workbook").agg(F.max_by("sheet", "sheet_index").alias("any"), F.max(F.when(fits, F.struct("sheet_index", "sheet"))).alias("s")).select("workbook", F.col("s.sheet").alias("sheet"))


def default_sheets(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("workbook").agg(F.min_by("sheet", "sheet_index").alias("sheet"))


def _numbered(filled: DataFrame) -> DataFrame:
    """Used columns with their block's number."""
    by_col = Window.partitionBy(*SHEET).orderBy("col")
    starts = filled.withColumn("new", (F.col("col") - F.coalesce(F.lag("col").over(by_col), F.lit(-1)) > 1).cast("int"))
    return starts.withColumn("block", F.sum("new").over(by_col)).drop("new")


def blocks(cells: DataFrame) -> DataFrame:
    """Adds `block` (from 1): columns without a value split a sheet; empty columns drop out."""
    filled = cells.groupBy(*SHEET, "col").agg(F.bool_or(~is_blank("value")).alias("used")).filter("used")
    return cells.join(_numbered(filled).drop("used"), [*SHEET, "col"])


def by_row(cells: DataFrame) -> DataFrame:
    """Cells as rows: workbook, sheet, row (and row_offset, if any) and an array `cells` of (col, value) structs; what comes that way stays so."""
    if "cells" in cells.columns:
        return cells
    offset = [c for c in cells.columns if c == "row_offset"]
    return cells.groupBy(*SHEET, "row", *offset).agg(F.sort_array(F.collect_list(F.struct("col", "value")), asc=False).alias("cells"))  # a row of one sheet


def opened(cells: DataFrame) -> DataFrame:
    """The opposite of by_row()."""
    return cells.select(*[c for c in cells.columns if c != "cells"], F.inline("cells")) if "cells" in cells.columns else cells


#: Columns of which a look at the rows keeps a bit each; a sheet with a used column beyond is looked at again.
BITS = 256
#: Kinds of sheets up to which what is known of each goes to the tasks; more are met by sheet.
FEW_KINDS = 10_000


def kinds(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(workbook, sheet, kind, header_row) of each sheet with text, and headers() of each kind as its sheets have them; kind stands for the sheet there.

    Sheets of a kind have the same used columns (those with text in a cell) and
    the same cleaned rows 1 and 2, so headers are read once a kind.  One look at
    the rows, with sums of bounded size; header_row as in embedded_header().
    """
    cells = cells.filter("workbook IS NOT NULL AND sheet IS NOT NULL")
    rows = by_row(cells)
    used = F.filter("cells", lambda x: ~is_blank(x["value"]))["col"]
    head = F.transform("cells", lambda x: F.struct(x["col"].alias("col"), clean_text(x["value"]).alias("text")))
    seen = rows.select(*SHEET, "row", used.alias("used"), F.when(F.col("row") <= 2, head).alias("head"), F.when(_embedded("cells"), F.col("row")).alias("header_row"))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(63))
    word = lambda w: F.aggregate("used", F.lit(0).cast("long"), lambda a, c: F.when(F.shiftright(c, 6) == w, a.bitwiseOR(bit(c))).otherwise(a))
    near = F.coalesce(F.array_max("used") < 64, F.lit(True)) & F.coalesce(F.array_min("used") >= 0, F.lit(True))
    words = [word(0).alias("w0"), *[F.when(near, F.lit(0).cast("long")).otherwise(word(w)).alias(f"w{w}") for w in range(1, BITS // 64)]]
    far = ~near & ((F.array_max("used") >= BITS) | (F.array_min("used") < 0))
    top = lambda i: F.max(F.when(F.col("row") == i, F.col("head"))).alias(f"row{i}")
    names = [f"w{w}" for w in range(BITS // 64)]
    looked = seen.select(*SHEET, "row", "head", "header_row", *words, far.alias("far")).groupBy(*SHEET).agg(*[F.bit_or(n).alias(n) for n in names], top(1), top(2), F.min("header_row").alias("header_row"), F.max("far").alias("far"))
    looked = cut(looked.filter(F.col("far") | (F.greatest(*[(F.col(n) != 0).cast("int") for n in names]) > 0)).withColumn("cols", F.lit(None).cast("array<int>")))
    beyond = looked.filter("far").select(*SHEET)
    if not beyond.isEmpty():
        listed = opened(rows.join(beyond, SHEET, "left_semi")).filter(~is_blank("value")).select(*SHEET, "col").distinct().groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.col("col").cast("int"))).alias("listed"))
        looked = cut(looked.join(listed, SHEET, "left").withColumn("cols", F.col("listed")).drop("listed"))
    # Of one kind are sheets that agree in all of these; nulls are equal.
    alike = [*names, "row1", "row2", "cols"]
    each = cut(looked.select(*alike).distinct().withColumn("kind", F.monotonically_increasing_id()))
    of_sheet = looked.join(each, _alike(looked, each, alike))
    of_sheet = cut(of_sheet.select(looked["workbook"], looked["sheet"], each["kind"], looked["header_row"]))
    at_64 = lambda n: F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col(n), i).bitwiseAND(F.lit(1).cast("long")) == 1)
    plus = lambda cols, more: F.transform(cols, lambda i: i + more)
    bits = F.flatten(F.array(*[plus(at_64(n), 64 * w) for w, n in enumerate(names)]))
    heads = each.select(F.lit("").alias("workbook"), F.col("kind").cast("string").alias("sheet"), F.coalesce("cols", bits).alias("cols"), "row1", "row2")
    return of_sheet, _layout(heads)


def _alike(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])


def _embedded(cells: str) -> Column:
    """Whether a row is an embedded header (see embedded_header)."""
    named = F.exists(cells, lambda x: F.rlike(x["value"], F.lit(r"(?iU)^\s*group\s*$")) & (F.lower(clean_text(x["value"])) == "group"))
    text = F.lower(clean_text(F.array_join(F.transform(F.array_sort(cells), lambda x: x["value"]), " ")))
    has = lambda w: F.contains(text, F.lit(w))
    return F.when(named, has("compound") & has("mean rq") & has("sem")).otherwise(F.lit(False))


def _layout(looked: DataFrame) -> DataFrame:
    """headers() from the used columns (cols) and the cleaned rows 1 and 2 of sheets.

    Columns next to each other differ from their places among the used ones by the same number.
    """
    looked = looked.withColumn("starts", F.array_distinct(F.transform("cols", lambda c, i: c - i)))
    for i in (1, 2):
        looked = looked.withColumns({f"cols{i}": F.transform(f"row{i}", lambda x: x["col"]), f"texts{i}": F.transform(f"row{i}", lambda x: x["text"])})
    each = looked.select(*SHEET, "starts", *[f"{n}{i}" for n in ("cols", "texts") for i in (1, 2)], F.posexplode("cols").alias("place", "col"))
    text = lambda i: F.coalesce(F.try_element_at(f"texts{i}", F.nullif(F.array_position(f"cols{i}", F.col("col")).cast("int"), F.lit(0))), F.lit(""))
    return _headed(each.select(*SHEET, F.array_position("starts", F.col("col") - F.col("place")).alias("block"), "col", text(1).alias("top"), text(2).alias("under")))


def layout(cells: DataFrame) -> DataFrame:
    """headers() of blocks(), read once a kind of sheet (see kinds)."""
    of_sheet, heads = kinds(cells)
    return of_kind(of_sheet, heads)


def of_kind(of_sheet: DataFrame, df: DataFrame) -> DataFrame:
    """What is known of kinds (as sheets) for each sheet of that kind."""
    known = df.select(F.col("sheet").cast("long").alias("kind"), *[c for c in df.columns if c not in SHEET])
    return of_sheet.select(*SHEET, "kind").join(known, "kind").drop("kind")


def block_rows(cells: DataFrame, of_sheet: DataFrame, wanted: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Data rows met with each block in `wanted` (kind as sheet, block, more) of their sheet's kind: its columns, row (and row_offset) and `values`.

    Cells meet their kind by sheet alone and stay where they are if they are dealt so; values are built with at().
    """
    more = [c for c in wanted.columns if c not in SHEET]
    lists = cut(wanted.groupBy(F.col("sheet").cast("long").alias("kind")).agg(F.collect_list(F.struct(*more)).alias("__blocks")))
    rows = by_row(cells.filter("row >= 3"))
    kept = [c for c in ("row", "row_offset") if c in rows.columns]
    rows = rows.select(*SHEET, *kept, F.col("cells.col").alias("__cols"), F.col("cells.value").alias("__values"))
    own = of_sheet.select(*SHEET, "kind").join(lists.select("kind"), "kind", "left_semi")
    few = lists.limit(FEW_KINDS + 1).count() <= FEW_KINDS
    met = rows.join(own, SHEET).join(F.broadcast(lists), "kind") if few else rows.join(own.join(lists, "kind"), SHEET)
    met = met.select(*SHEET, *kept, "__cols", "__values", F.inline("__blocks"))
    return met.select(*SHEET, *kept, *more, *[v.alias(n) for n, v in values.items()])


def at(col: str | Column) -> Column:
    """The row's text in a column, in block_rows()."""
    return F.try_element_at("__values", F.nullif(F.coalesce(F.array_position("__cols", col if isinstance(col, Column) else F.col(col)), F.lit(0)).cast("int"), F.lit(0)))


def row_texts(cells: DataFrame, wanted: str = "group") -> DataFrame:
    """(workbook, sheet, row, text, has_cell): a row's cleaned texts in column order, joined, and whether one of them is just `wanted` (any case)."""
    text = clean_text(F.array_join(F.transform(F.array_sort("cells"), lambda x: x["value"]), " "))
    return by_row(cells).select(*SHEET, "row", text.alias("text"), F.exists("cells", lambda x: F.lower(clean_text(x["value"])) == wanted.lower()).alias("has_cell"))


def required_roles(block_roles: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """An issues row (block, issue) for each wanted role column that a block lacks; wanted: column to what it is called."""
    each = F.explode(F.array(*[F.when(F.col(c).isNull(), F.lit(f"Could not find the {name} column.")) for c, name in wanted.items()]))
    return block_roles.select(*BLOCK, each.alias("issue")).filter("issue IS NOT NULL")


def embedded_header(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, header_row): first row with an exact `group`, and compound, mean rq and sem somewhere in it."""
    has = lambda w: F.contains(F.lower("text"), F.lit(w))
    rows = row_texts(cells, "group").filter(F.col("has_cell") & has("compound") & has("mean rq") & has("sem"))
    return rows.groupBy(*SHEET).agg(F.min("row").alias("header_row"))


def below_embedded(cells: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Cells from the embedded header on, rows numbered from 1; row_offset leads back to the sheet's rows.  headers: embedded_header(), if known."""
    rows = cells.join(embedded_header(cells) if headers is None else headers, SHEET).filter("row >= header_row")
    return rows.withColumn("row_offset", F.col("header_row") - 1).withColumn("row", F.col("row") - F.col("header_row") + 1).drop("header_row")


def _tops() -> list[Column]:
    """The cleaned rows 1 and 2 of a column."""
    return [F.coalesce(F.max(F.when(F.col("row") == i, clean_text("value"))), F.lit("")).alias(name) for i, name in ((1, "top"), (2, "under"))]


def _headed(columns: DataFrame) -> DataFrame:
    return columns.withColumn("header", F.lower(F.trim(F.concat_ws(" ", "top", "under"))))


def headers(block_cells: DataFrame) -> DataFrame:
    """(block, col, top, under, header): cleaned rows 1 and 2 of each column, and both lower-cased."""
    return _headed(block_cells.groupBy(*BLOCK, "col").agg(*_tops()))


def header_test(all_of: list[str] = [], any_of: list[str] = [], none_of: list[str] = []) -> Column:  # noqa: B006
    """Whether a column's header has all, any and none of these texts."""
    has = lambda w: F.contains(F.col("header"), F.lit(w))
    test = F.lit(True)
    for w in all_of:
        test = test & has(w)
    if any_of:
        test = test & reduce(lambda a, b: a | b, map(has, any_of))
    for w in none_of:
        test = test & ~has(w)
    return test


def sample_size_test() -> Column:
    has = lambda w: F.contains(F.col("header"), F.lit(w))
    return (has("sample size") | has("组内样本量") | F.array_contains(tokens("header"), "n")) & ~has("sample id")


def _roles() -> list[Column]:
    """The first column of each role."""
    roles = {
        "group_col": header_test(any_of=["group"]),
        "compound_col": header_test(any_of=["compound id", "compound"]),
        "size_col": sample_size_test(),
        "mean_sem_col": header_test(all_of=["mean", "rq", "sem"]),
        "mean_col": header_test(all_of=["mean", "rq"], none_of=["sem", "control"]),
        "sem_col": header_test(any_of=["sem"], none_of=["mean rq"]),
        "geomean_col": header_test(any_of=["geomean"]),
    }
    return [F.min(F.when(test, F.col("col"))).alias(name) for name, test in roles.items()]


def role_columns(block_headers: DataFrame) -> DataFrame:
    """The first column of each role in each block (null: none)."""
    return block_headers.groupBy(*BLOCK).agg(*_roles())


def block_reports(block_headers: DataFrame) -> DataFrame:
    """role_columns() with two arrays of each block: its genes but the target, in order (see genes()), and (gene key, mean CT column)."""
    of_gene = looks_like_gene("top") & F.contains(F.lower("under"), F.lit("ct"))
    names = F.transform(F.array_sort(F.collect_list(F.when(of_gene, F.struct("col", "top")))), lambda x: x["top"])
    cts = F.collect_list(F.when(F.contains(F.lower("under"), F.lit("mean ct")), F.struct(F.lower("top").alias("key"), "col")))
    made = block_headers.groupBy(*BLOCK).agg(*_roles(), F.array_distinct(names).alias("genes"), F.array_sort(cts).alias("cts"))
    return made.withColumn("genes", F.slice("genes", F.lit(2), F.greatest(F.size("genes"), F.lit(1))))


def genes(block_headers: DataFrame) -> DataFrame:
    """(block, gene, gene_order, mean_ct_col): names over a header with `ct`, by first appearance; the first is the target."""
    found = block_headers.filter(looks_like_gene("top") & F.contains(F.lower("under"), F.lit("ct")))
    firsts = found.groupBy(*BLOCK, F.col("top").alias("gene")).agg(F.min("col").alias("first_col"))
    cts = block_headers.filter(F.contains(F.lower("under"), F.lit("mean ct"))).groupBy(*BLOCK, F.lower("top").alias("gene_key")).agg(F.min("col").alias("mean_ct_col"))
    order = F.row_number().over(Window.partitionBy(*BLOCK).orderBy("first_col"))
    return firsts.withColumn("gene_order", order).withColumn("gene_key", F.lower("gene")).join(cts, [*BLOCK, "gene_key"], "left").select(*BLOCK, "gene", "gene_order", "mean_ct_col")


def header_rows(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, header_row) of plot tables: among the first 20 rows the first with `group` and mean/sem, time* or dose*; else the first row."""
    return titled(cells).drop("title")


def titles(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, title): distinct texts, in order, of the nearest row with text above the header."""
    return titled(cells).select(*SHEET, "title").filter("title IS NOT NULL")


def titled(cells: DataFrame) -> DataFrame:
    """(workbook, sheet, header_row, title) of header_rows() and titles() (null: none), from at most 20 rows a sheet."""
    texts = F.transform(F.array_sort(F.transform("cells", lambda x: F.struct(x["col"].alias("col"), clean_text(x["value"]).alias("t")))), lambda x: x["t"])
    near = F.col("row") <= HEADER_SEARCH_ROWS
    low = F.transform("texts", lambda t: F.lower(t))
    mark = lambda t: (F.contains(t, F.lit("mean")) & F.contains(t, F.lit("sem"))) | F.startswith(t, F.lit("time")) | F.startswith(t, F.lit("dose"))
    title = F.array_join(F.array_distinct(F.filter("texts", lambda t: t != "")), " ")
    tops = by_row(cells if "cells" in cells.columns else cells.filter(near)).select(*SHEET, "row", F.when(near, texts).alias("texts"))
    tops = tops.select(*SHEET, "row", (near & F.array_contains(low, "group") & F.exists(low, mark)).alias("is_header"), F.coalesce(title, F.lit("")).alias("title"))
    if "cells" not in cells.columns:  # sheets that begin further down
        tops = tops.unionByName(cells.filter(~near).select(*SHEET, F.lit(1).alias("row"), F.lit(False).alias("is_header"), F.lit("").alias("title")).distinct())
    found = tops.groupBy(*SHEET).agg(
        F.coalesce(F.min(F.when(F.col("is_header"), F.col("row"))), F.lit(1)).alias("header_row"),
        F.collect_list(F.when(F.col("title") != "", F.struct("row", "title"))).alias("above"),
    )
    nearest = F.array_max(F.filter("above", lambda x: x["row"] < F.col("header_row")))
    return found.select(*SHEET, "header_row", nearest["title"].alias("title"))


def as_table(cells: DataFrame, header_row: int = 1) -> DataFrame:
    """One sheet's cells below a header as a wide table of texts (blank: ""), with its row number; rows without text drop out.

    Only the header's cells reach the driver.
    """
    names = {r["col"]: r["t"] or f"Column {r['col']}" for r in cells.filter(F.col("row") == header_row).select("col", clean_text("value").alias("t")).orderBy("col").collect()}
    if len(names) < 2:
        raise ValueError("Input table must contain at least two columns.")
    wide = cells.filter((F.col("row") > header_row) & ~is_blank("value")).groupBy("row").pivot("col", list(names)).agg(F.first("value"))
    return wide.na.fill("").toDF("row", *names.values())


#: A reference: a sheet (quoted or not) and a cell or range.
REFERENCE = r"^(?:(?:'([^']+)'|([^'!]+))!)?([A-Za-z]{1,3})([0-9]+)(?::([A-Za-z]{1,3})([0-9]+))?$"
CELL, TO = [*SHEET, "row", "col"], ["workbook", "to_sheet", "to_row", "to_col"]


def _column_number(letters: Column) -> Column:
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64)


def formula_edges(cells: DataFrame) -> DataFrame:
    """(cell, average, ref, to): the cells that each readable formula without a cached number names, in order, as often as it names them.

    Readable are `=A1`, `=Sheet!A1`, `='My, sheet'!A1` and `=AVERAGE(...)` over
    cells and ranges; a bare range of several cells, and any other formula, has
    no row.
    """
    text = F.trim(F.expr("substr(formula, 2)"))
    open_ = cells.filter(parse_number("value").isNull() & F.startswith("formula", F.lit("="))).select(*CELL, text.alias("f"))
    average = F.col("f").rlike(r"(?i)^AVERAGE\(.*\)$")
    inner = F.when(average, F.regexp_extract("f", r"(?is)^AVERAGE\((.*)\)$", 1))
    parts = F.when(average, F.split(inner, ",(?=(?:[^']*'[^']*')*[^']*$)")).otherwise(F.array("f"))
    each = open_.withColumn("average", average).select(*CELL, "average", F.posexplode(parts).alias("part", "text"))
    text = F.replace(F.trim("text"), F.lit("$"), F.lit(""))
    got = lambda i: F.regexp_extract(text, REFERENCE, i)
    to_sheet = F.coalesce(F.nullif(got(1), F.lit("")), F.nullif(got(2), F.lit("")), F.col("sheet"))
    r1, c1 = got(4).try_cast("int"), _column_number(got(3))
    r2, c2 = F.coalesce(got(6).try_cast("int"), r1), F.when(got(5) == "", c1).otherwise(_column_number(got(5)))
    read = each.select(*CELL, "average", "part", to_sheet.alias("to_sheet"), r1.alias("r1"), c1.alias("c1"), r2.alias("r2"), c2.alias("c2"))
    bad = F.col("r1").isNull() | (~F.col("average") & ((F.col("r1") != F.col("r2")) | (F.col("c1") != F.col("c2"))))
    unreadable = read.filter(bad).select(*CELL).distinct()
    read = read.join(unreadable, CELL, "left_anti").filter("r1 <= r2 AND c1 <= c2")
    rows = read.withColumn("to_row", F.explode(F.sequence("r1", "r2"))).withColumn("to_col", F.explode(F.sequence("c1", "c2")))
    return rows.select(*CELL, "average", F.concat_ws(".", "part", "to_row", "to_col").alias("ref"), "to_sheet", "to_row", "to_col")


def _at(df: DataFrame, **values: str) -> DataFrame:
    """A table by cell as one by target: the cell's columns under the names of the target's."""
    return df.select("workbook", F.col("sheet").alias("to_sheet"), F.col("row").alias("to_row"), F.col("col").alias("to_col"), *[F.col(v).alias(k) for k, v in values.items()])


#: Cells or open references of a sheet or workbook that one task works out; more are followed path by path over all tasks.
LOCAL = 1_000_000


def resolve_formulas(cells: DataFrame, local: int | None = None, cached: bool = True) -> DataFrame:
    """(workbook, sheet, row, col, number): cached numbers (unless not `cached`), else what readable formulas come to, at any depth.

    A sheet whose formulas name no other sheet, of at most `local` cells and
    named cells (LOCAL), is worked out where it lies, in Arrow batches; all
    other sheets go by joins (see _across).
    """
    most = LOCAL if local is None else local
    rows = cells if "cells" in cells.columns else cells.repartition(*SHEET).groupBy(*SHEET, "row").agg(F.collect_list(F.struct("col", "value", "formula")).alias("cells"))
    sized = rows.select(*SHEET, "row", "cells", F.sum(F.size("cells")).over(Window.partitionBy(*SHEET)).alias("size"))  # a sheet's rows follow each other from here on
    each = sized.select(*SHEET, "row", "size", F.inline("cells")).withColumn("number", parse_number("value"))
    each = each.filter(F.col("number").isNotNull() | F.startswith("formula", F.lit("="))).select(*CELL, "size", "number", F.when(F.col("number").isNull(), F.col("formula")).alias("formula"))
    kinds = {f.name: f.dataType.simpleString() for f in each.schema}
    worked = cut(each.mapInArrow(lambda batches: formulas.sheet_by_sheet(batches, most, cached, _slowly), ", ".join(f"{c} {kinds[c]}" for c in CELL) + ", number double"))
    values = worked.filter("number IS NOT NULL")
    is_open = cut(worked.filter("number IS NULL").select(*SHEET).distinct())
    if is_open.isEmpty():
        return values
    plain = rows.select(*SHEET, "row", F.inline("cells"))
    known = plain.select(*CELL, parse_number("value").alias("number")).filter("number IS NOT NULL")
    everything = _across(values if cached else values.unionByName(known), plain.join(is_open, SHEET, "left_semi"))
    return everything if cached else everything.join(known, CELL, "left_anti")


def _slowly(links: list[tuple]) -> dict:
    return open_values(links) if links else {}


def _across(known: DataFrame, cells: DataFrame) -> DataFrame:
    """known, and what the formulas of cells come to, by joins over all tasks.

    Chains of bare references are followed by pointer jumping (log2 n joins).
    Averages leave out what is no number.  One that waits for a single other is
    a map x -> a + b x, with a value of its own where x is no number; such maps
    are composed by pointer jumping too, so a column of running averages takes
    log2 n joins, and only averages that wait for several cells go level by
    level.  A reference back to a cell that is being resolved is no number:
    averages on cycles are worked out component by component (see open_values).
    """
    edges = cut(formula_edges(cells))
    bare = edges.filter("NOT average AND NOT (to_sheet = sheet AND to_row = row AND to_col = col)")
    own = _at(bare.select(*CELL).distinct().withColumn("more", F.lit(True)), more="more")
    jumps = cut(bare.join(own, TO, "left").select(*CELL, "to_sheet", "to_row", "to_col", F.coalesce("more", F.lit(False)).alias("more")))
    for _ in range(max(1, jumps.count()).bit_length() + 1):
        if jumps.filter("more").isEmpty():
            break
        on = jumps.select("workbook", F.col("sheet").alias("to_sheet"), F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_sheet").alias("s"), F.col("to_row").alias("r"), F.col("to_col").alias("c"), F.col("more").alias("m"))
        moved = jumps.filter("more").join(on, TO).select(*CELL, F.col("s").alias("to_sheet"), F.col("r").alias("to_row"), F.col("c").alias("to_col"), F.col("m").alias("more"))
        jumps = cut(jumps.filter("NOT more").unionByName(moved))
    ends = jumps.filter("NOT more").select(*CELL, "to_sheet", "to_row", "to_col")  # the others run in a circle
    # Averages name the ends of chains; what leads to nothing, or to the average itself, has no value.
    averages = edges.filter("average").select(*CELL, "ref", "to_sheet", "to_row", "to_col")
    through = ends.select("workbook", F.col("sheet").alias("to_sheet"), F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.struct(F.col("to_sheet").alias("s"), F.col("to_row").alias("r"), F.col("to_col").alias("c")).alias("end"))
    averages = averages.join(own, TO, "left").join(through, TO, "left").filter("more IS NULL OR end IS NOT NULL")
    averages = averages.select(*CELL, "ref", F.coalesce("end.s", "to_sheet").alias("to_sheet"), F.coalesce("end.r", "to_row").alias("to_row"), F.coalesce("end.c", "to_col").alias("to_col"))
    averages = averages.join(_at(known, v="number"), TO, "left").filter("NOT (to_sheet = sheet AND to_row = row AND to_col = col)")
    is_average = _at(edges.filter("average").select(*CELL).distinct().withColumn("open", F.lit(True)), open="open")
    waiting = cut(averages.join(is_average, TO, "left").select(*CELL, "ref", "to_sheet", "to_row", "to_col", "v", F.coalesce("open", F.lit(False)).alias("open")))
    settled = None
    while not waiting.isEmpty():
        level = cut(_settled_now(waiting))
        if level.isEmpty():
            rest = _on_cycles(waiting)
            settled = rest if settled is None else settled.unionByName(rest)
            break
        settled = level if settled is None else settled.unionByName(level)
        rest = waiting.join(level.select(*CELL), CELL, "left_anti").join(_at(level.withColumn("now", F.lit(True)), new="number", now="now"), TO, "left")
        waiting = cut(rest.select(*CELL, "ref", "to_sheet", "to_row", "to_col", F.coalesce("v", "new").alias("v"), (F.col("open") & F.col("now").isNull()).alias("open")))
    values = known if settled is None else known.unionByName(settled)
    values = cut(values)
    chained = ends.join(_at(values, number="number"), TO).select(*CELL, "number")
    return values.unionByName(chained).filter("number IS NOT NULL")


def _settled_now(waiting: DataFrame) -> DataFrame:
    """(cell, number) of averages that wait for nothing, and of those that wait for them through averages that wait for one cell each."""
    target = F.when(F.col("open"), F.struct("to_sheet", "to_row", "to_col"))
    known = F.when(~F.col("open"), F.col("v"))
    of = waiting.groupBy(*CELL).agg(F.sum(known).alias("s"), F.count(known).alias("c"), F.count(target).alias("m"), F.min(target).alias("t"), F.max(target).alias("u"))
    of = cut(of)
    done = of.filter("m = 0").select(*CELL, (F.col("s") / F.nullif("c", F.lit(0))).alias("number"))
    n = F.col("c") + F.col("m")
    single = of.filter("m > 0 AND t = u").select(*CELL, F.col("t.to_sheet").alias("to_sheet"), F.col("t.to_row").alias("to_row"), F.col("t.to_col").alias("to_col"), (F.coalesce("s", F.lit(0.0)) / n).alias("a"), (F.col("m") / n).alias("b"), (F.col("s") / F.nullif("c", F.lit(0))).alias("none"))
    chained = _at(single.select(*CELL).withColumn("more", F.lit(True)), more="more")
    jumps = cut(single.join(chained, TO, "left").select(*CELL, "to_sheet", "to_row", "to_col", "a", "b", "none", F.coalesce("more", F.lit(False)).alias("more")))
    for _ in range(max(1, jumps.count()).bit_length() + 1):
        if jumps.filter("more").isEmpty():
            break
        on = jumps.select("workbook", F.col("sheet").alias("to_sheet"), F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.struct("to_sheet", "to_row", "to_col", "a", "b", "none", "more").alias("next"))
        composed = (F.col("a") + F.col("b") * F.col("next.a")).alias("a"), (F.col("b") * F.col("next.b")).alias("b"), F.coalesce(F.col("a") + F.col("b") * F.col("next.none"), "none").alias("none")
        moved = jumps.filter("more").join(on, TO).select(*CELL, "next.to_sheet", "next.to_row", "next.to_col", *composed, F.col("next.more").alias("more"))
        jumps = cut(jumps.filter("NOT more").unionByName(moved))
    # what still has more runs in a circle
    reached = jumps.filter("NOT more").join(_at(done.withColumn("there", F.lit(True)), x="number", there="there"), TO)
    return done.unionByName(reached.select(*CELL, F.coalesce(F.col("a") + F.col("b") * F.col("x"), "none").alias("number")))


#: Pairs of a cell and the cells above it that one component may need.
STATES = 2_000_000


def open_values(links: list[tuple]) -> dict:
    """The value of each average of (cell, to, v, open), where references run in cycles.

    Strongly connected components come one after the other, those that others
    wait for first; a reference out of a component is a value by then.  Inside
    one a value depends on which of its cells stand above, not in which order,
    so it is kept by (cell, cells above).  A component in which each cell names
    one other is a circle of maps x -> a + b x, composed from both ends.
    """
    known: dict = {}
    for cell, to, v, is_open in links:
        total, n, refs = known.get(cell, (0.0, 0, []))
        if is_open:
            refs.append(to)
        elif v is not None:
            total, n = total + v, n + 1
        known[cell] = (total, n, refs)
    values: dict = {}
    for component in _components({c: [t for t in refs if t in known] for c, (_, _, refs) in known.items()}):
        own = set(component)
        sums = {}
        for c in component:
            total, n, refs = known[c]
            outside = [values.get(t) for t in refs if t not in own]
            sums[c] = (total + sum(x for x in outside if x is not None), n + sum(x is not None for x in outside), [t for t in refs if t in own])
        if len(component) == 1 and not sums[component[0]][2]:
            total, n, _ = sums[component[0]]
            values[component[0]] = total / n if n else None
        elif all(len(set(refs)) == 1 for _, _, refs in sums.values()):
            values |= _circle(sums)
        else:
            kept: dict = {}
            values |= {c: _below(c, frozenset([c]), sums, kept) for c in component}
    return values


def _below(start, above: frozenset, sums: dict, kept: dict):
    """The value of a cell below others of its component, without recursion; a cell that stands above has none."""
    stack = [(start, above)]
    while stack:
        cell, seen = stack[-1]
        if (cell, seen) in kept:
            stack.pop()
            continue
        total, n, refs = sums[cell]
        further = [(t, seen | {t}) for t in refs if t not in seen]
        missing = [x for x in further if x not in kept]
        if missing:
            stack += missing
            continue
        got = [x for x in map(kept.__getitem__, further) if x is not None]
        kept[cell, seen] = (total + sum(got)) / (n + len(got)) if n + len(got) else None
        if len(kept) > STATES:
            raise ValueError(f"averages that name each other in more than {STATES} ways")
        stack.pop()
    return kept[start, above]


def _circle(sums: dict) -> dict:
    """Values on a circle: each cell's map after those of all others, from no number on."""
    order = [next(iter(sums))]
    while (after := sums[order[-1]][2][0]) != order[0]:
        order.append(after)
    maps = [(total / (n + len(refs)), len(refs) / (n + len(refs)), total / n if n else None) for total, n, refs in map(sums.__getitem__, order)]
    apply = lambda f, x: f[2] if x is None else f[0] + f[1] * x
    after = lambda f, g: (f[0] + f[1] * g[0], f[1] * g[1], apply(f, g[2]))  # noqa: E731  f after g
    behind = [(0.0, 1.0, None)]  # behind[i]: the maps before i, the first outermost
    for f in maps:
        behind.append(after(behind[-1], f))
    out, ahead = {}, (0.0, 1.0, None)
    for i in range(len(maps) - 1, -1, -1):
        ahead = after(maps[i], ahead)
        out[order[i]] = apply(ahead, apply(behind[i], None))
    return out


def _components(graph: dict) -> list[list]:
    """Strongly connected components, those that others lead to first."""
    number: dict = {}
    low: dict = {}
    held, on, out = [], set(), []
    for root in graph:
        if root in number:
            continue
        work = [(root, iter(graph[root]))]
        number[root] = low[root] = len(number)
        held.append(root)
        on.add(root)
        while work:
            cell, following = work[-1]
            for t in following:
                if t not in number:
                    number[t] = low[t] = len(number)
                    held.append(t)
                    on.add(t)
                    work.append((t, iter(graph[t])))
                    break
                if t in on:
                    low[cell] = min(low[cell], number[t])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[cell])
                if low[cell] == number[cell]:
                    component = []
                    while not component or component[-1] != cell:
                        component.append(held.pop())
                        on.discard(component[-1])
                    out.append(component)
    return out


def _on_cycles(waiting: DataFrame, local: int = LOCAL) -> DataFrame:
    """The values of averages on cycles and behind them: a workbook's open ones in one task, or path by path where they are more than `local`."""
    sizes = cut(waiting.groupBy("workbook").count())
    small = waiting.join(sizes.filter(F.col("count") <= local), "workbook", "left_semi")
    kinds = {f.name: f.dataType.simpleString() for f in waiting.schema}

    def worked_out(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        got = open_values([((r["sheet"], r["row"], r["col"]), (r["to_sheet"], r["to_row"], r["to_col"]), r["v"], r["open"]) for r in rows])
        own = group.schema
        cols = [pa.array([rows[0]["workbook"]] * len(got), own.field("workbook").type), *(pa.array([c[i] for c in got], own.field(n).type) for i, n in enumerate(CELL[1:])), pa.array(list(got.values()), pa.float64())]
        return pa.table(cols, [*CELL, "number"])

    out = small.select(*CELL, "to_sheet", "to_row", "to_col", "v", "open").groupBy("workbook").applyInArrow(worked_out, ", ".join(f"{c} {kinds[c]}" for c in CELL) + ", number double")
    large = sizes.filter(F.col("count") > local)
    return out if large.isEmpty() else out.unionByName(_by_paths(waiting.join(large, "workbook", "left_semi")))


def _by_paths(waiting: DataFrame) -> DataFrame:
    """The value of each average that is left: the tree of its references, where a cell that stands above has no value, from the leaves up."""
    key = F.struct("workbook", "sheet", "row", "col")
    links = waiting.select(key.alias("cell"), "ref", F.struct("workbook", F.col("to_sheet").alias("sheet"), F.col("to_row").alias("row"), F.col("to_col").alias("col")).alias("to"), "v", "open")
    nodes = [cut(links.select(F.col("cell").alias("root"), F.lit("").alias("up"), F.lit("/").alias("node"), "cell", F.array("cell").alias("above")).distinct())]
    leaves = []
    while not nodes[-1].isEmpty():
        below = cut(nodes[-1].join(links, "cell").select("root", F.col("node").alias("up"), F.concat("node", "ref", F.lit("/")).alias("node"), F.col("to").alias("cell"), "above", "v", "open"))
        leaves.append(below.filter("NOT open").select("root", F.col("up").alias("node"), "v"))
        further = below.filter(F.col("open") & ~F.array_contains("above", F.col("cell")))
        nodes.append(cut(further.select("root", "up", "node", "cell", F.concat("above", F.array("cell")).alias("above"))))
    values = None
    for level, own in zip(reversed(nodes[:-1]), reversed(leaves)):
        parts = own if values is None else own.unionByName(values)
        means = parts.groupBy("root", "node").agg(F.avg("v").alias("v"))
        values = cut(level.join(means, ["root", "node"], "left").select("root", F.col("up").alias("node"), "v"))
    return values.select("root.*", F.col("v").alias("number"))
