"""qPCR summaries from worksheet cells: report blocks, controls, mean RQ and SEM, reference genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.textcells import clean_text, general_format, is_blank, is_control, number_texts, parse_number, plain_text
from helixframe.operators import sheets
from helixframe.operators.lineage import cut
from helixframe.operators.sheets import BLOCK, SHEET

#: Sheets that give nothing but from under an embedded header are few if they are less than one in so many.
FEW = 10
SUMMARY = ["Group", "Compound ID", "Reference source", "Sample size (n)", "MEAN RQ", "SEM"]


def forward_fill(df: DataFrame, columns: list[str], partition: list[str], order: list[str]) -> DataFrame:
    """Nulls get the last value above; a blank text is a value and stops the fill."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def drop_controls(df: DataFrame, group: str = "Group", compound: str | None = "Compound ID") -> DataFrame:
    """Without controls and blanks; a table without a compound column loses every row."""
    return df.filter(~is_control(F.col(group), F.col(compound))) if compound else df.filter(F.lit(False))


def dedupe(df: DataFrame, keys: list[str], order: str, carry: list[str] = []) -> DataFrame:  # noqa: B006
    """The first row, by order, of each combination of keys (nulls are equal)."""
    return df.groupBy(*carry, *keys).agg(F.min(order).alias(order))


def mean_rq_and_sem(two: str, mean: str, sem: str) -> dict:
    """Separate columns where they have text, else the first two numbers of the combined one (see number_texts()).

    mean and sem, as far as no number must be rounded to six digits; mean_text and
    sem_text: what must (see rounded()).
    """
    out = {}
    for name, own, split in (("mean", mean, first_two(two)[0]), ("sem", sem, first_two(two)[1])):
        text = F.when(~is_blank(own), F.col(own)).otherwise(split)
        out[name] = F.coalesce(plain_text(text), F.when(parse_number(text).isNull() & ~is_blank(own), clean_text(own)))
        out[f"{name}_text"] = F.when(plain_text(text).isNull() & parse_number(text).isNotNull(), text)
    return out


def rounded(rows: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """dedupe()d rows of mean_rq_and_sem() with all texts made; Python sees them only if there is one that must be rounded."""
    rows = cut(dedupe(rows, [*keys, "mean_text", "sem_text"], "row", carry))
    if rows.filter("mean_text IS NOT NULL OR sem_text IS NOT NULL").isEmpty():
        return rows.drop("mean_text", "sem_text")
    made = rows.withColumns({n: F.coalesce(n, general_format(parse_number(f"{n}_text"))) for n in ("mean", "sem")}).drop("mean_text", "sem_text")
    return cut(dedupe(made, keys, "row", carry))


def first_two(two: str):
    """The first two of an array of at least two; fewer: both null."""
    return tuple(F.when(F.size(two) >= 2, F.get(two, i)) for i in (0, 1))


def sample_stats(wells: DataFrame, keys: list[str] = ["Group", "Compound ID", "Reference gene"], value: str = "Mean CT", order: str | None = None) -> DataFrame:  # noqa: B006
    """n, mean and SEM (sample deviation over root n; 0 for one value) of each key, with the first order."""
    aggs = [F.count(value).alias("Sample size (n)"), F.avg(value).alias("Mean CT"), F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0)).alias("SEM")]
    return wells.groupBy(*keys).agg(*aggs, *([F.min(order).alias(order)] if order else []))


def _summaries(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(summary rows, issues, sheets without a summary row and their header_row, all sheets) of the blocks found in cells.

    Blocks are told once a kind of sheet; cells are dealt by sheet once and stay there.
    """
    of_sheet, heads = sheets.kinds(cells)
    found = cut(sheets.block_reports(heads))  # a row a block of a kind
    names = ["group", "compound", "size", "mean_sem", "mean", "sem"]
    full, usable = F.col("group_col").isNotNull(), F.expr("mean_sem_col IS NOT NULL OR (mean_col IS NOT NULL AND sem_col IS NOT NULL)")
    counts = full | F.col("geomean_col").isNotNull()
    issues = sheets.of_kind(of_sheet, found.filter(counts & ~usable).select(*BLOCK, F.lit("No MEAN RQ and SEM columns.").alias("issue")))

    # A geomean table takes group and compound of the sheet's first full one, row by row, and the genes of all full ones.
    listed = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(full, F.struct("block", "genes")))), lambda x: x["genes"])))
    whole = found.groupBy(*SHEET).agg(F.min(F.when(full, F.struct("block", "group_col", "compound_col"))).alias("first"), F.concat(F.lit("Geomean ("), F.array_join(listed, "; "), F.lit(")")).alias("all_genes"))
    each = found.filter(counts & usable).join(whole, SHEET)
    each = each.withColumns({n: F.when(full, F.col(n)).otherwise(F.col(f"first.{n}")) for n in ("group_col", "compound_col")} | {"kind": (~full).cast("int"), "source": F.when(full, F.array_join("genes", "; ")).otherwise(F.col("all_genes"))})
    each = cut(each.select(*BLOCK, F.col("kind").alias("table_kind"), "source", *[f"{n}_col" for n in names]))
    if each.isEmpty():
        kinds = {"block": "long", "kind": "int", "group": "string", "compound": "string", "source": "string", "size": "string", "mean": "string", "sem": "string", "row": dict(cells.dtypes)["row"]}
        rows = _no_rows(of_sheet, kinds)
        return rows, issues, of_sheet.select(*SHEET, "header_row"), of_sheet
    rows = sheets.block_rows(cells, of_sheet, each, {n: sheets.at(f"{n}_col") for n in names})
    names = [*names[:3], "two", *names[4:]]
    # The numbers of a combined column are looked for once, before blanks are filled from above: null where there is no cell.
    rows = rows.select(*BLOCK, F.col("table_kind").alias("kind"), "source", "row", *[number_texts("mean_sem").alias(n) if n == "two" else n for n in names])
    filled = forward_fill(rows.withColumns({f"__{n}": F.col(n) for n in names}), [f"__{n}" for n in names], BLOCK, ["row"])
    rows = drop_controls(filled.select(*BLOCK, "kind", "source", "row", *[F.when(F.col("kind") == 0, F.col(f"__{n}")).otherwise(F.col(n)).alias(n) for n in names]), "group", "compound")
    a, b = first_two("two")
    rows = rows.filter((~is_blank("mean") | a.isNotNull()) & (~is_blank("sem") | b.isNotNull()))
    texts = [c.alias(n) for n, c in mean_rq_and_sem("two", "mean", "sem").items()]
    rows = rows.select(*BLOCK, "row", "group", "compound", "source", F.coalesce("size", F.lit("")).alias("size"), *texts, "kind")
    rows = rounded(rows, ["group", "compound", "source", "size", "mean", "sem"], [*BLOCK, "kind"])
    return rows, issues, _without(of_sheet, rows), of_sheet


def _no_rows(of_sheet: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return of_sheet.limit(0).select(*SHEET, *[F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()])


def _without(of_sheet: DataFrame, rows: DataFrame) -> DataFrame:
    """The sheets (and their header_row) that have no row."""
    return cut(of_sheet.select(*SHEET, "header_row").join(rows.select(*SHEET).distinct(), SHEET, "left_anti"))


def _below_embedded(cells: DataFrame, rest: DataFrame, of_sheet: DataFrame) -> DataFrame | None:
    """The regions under embedded headers of the sheets in `rest`, stored if they are few of all; none: no such header."""
    headers = rest.filter("header_row IS NOT NULL")  # a row a sheet
    if headers.isEmpty():
        return None
    below = sheets.below_embedded(cells, headers)
    return cut(sheets.by_row(below)) if headers.count() * FEW < of_sheet.count() else below


def summarize(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The six summary columns of each sheet with (kind, block, row) as order, and issues.

    The region under an embedded header counts only for sheets whose whole
    grid gives nothing.
    """
    both, issues, rest, of_sheet = _summaries(cells)
    below = _below_embedded(cells, rest, of_sheet)
    if below is not None:
        both = both.unionByName(_summaries(below)[0])
    names = dict(zip(["group", "compound", "source", "size", "mean", "sem"], SUMMARY))
    return both.select(*SHEET, "kind", "block", "row", *[F.col(k).alias(v) for k, v in names.items()]), issues


def sample_cts(cells: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """Reference-gene CTs as rows, gene by gene: workbook, sheet, block, gene_order, row, Group, Compound ID, Reference gene, Mean CT.

    numbers: values of formula cells by their places in the sheet
    (resolve_formulas), used where a cell's text is no number.  The region under
    an embedded header counts only for sheets whose whole grid gives nothing.
    """
    direct, rest, of_sheet = _sample_cts(cells, numbers)
    below = _below_embedded(cells, rest, of_sheet)
    return direct if below is None else direct.unionByName(_sample_cts(below, numbers)[0])


def _sample_cts(cells: DataFrame, numbers: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the rows of sample_cts() found in cells, sheets without any, all sheets); cells are dealt by sheet once."""
    offset = ["row_offset"] if "row_offset" in cells.columns else []
    of_sheet, heads = sheets.kinds(cells)
    found = sheets.block_reports(heads)  # a row a block of a kind
    with_genes = found.filter("group_col IS NOT NULL AND compound_col IS NOT NULL")
    own = lambda g: F.get(F.filter("cts", lambda x: x["key"] == F.lower(g)), 0)["col"]
    genes = F.transform("genes", lambda g, i: F.struct((i + 2).cast("int").alias("gene_order"), g.alias("gene"), own(g).alias("col")))
    wanted = with_genes.select(*BLOCK, "group_col", "compound_col", F.filter(genes, lambda x: x["col"].isNotNull()).alias("genes"))
    cts = F.transform("genes", lambda x: F.struct(x["gene_order"].alias("gene_order"), x["gene"].alias("gene"), x["col"].alias("col"), parse_number(sheets.at(x["col"])).alias("number")))
    wanted = cut(wanted.filter(F.size("genes") > 0))
    if wanted.isEmpty():
        kinds = {"block": "long", "gene_order": "int", "row": dict(cells.dtypes)["row"], "Group": "string", "Compound ID": "string", "Reference gene": "string", "Mean CT": "double"}
        return _no_rows(of_sheet, kinds), of_sheet.select(*SHEET, "header_row"), of_sheet
    rows = sheets.block_rows(cells, of_sheet, wanted, {"group": sheets.at("group_col"), "compound": sheets.at("compound_col"), "cts": cts})
    rows = forward_fill(rows, ["group", "compound"], BLOCK, ["row"]).filter(~is_control("group", "compound"))
    rows = rows.select(*BLOCK, "row", *offset, "group", "compound", F.inline("cts"))
    if numbers is not None:
        places = numbers.select(*SHEET, F.col("row").alias("sheet_row"), "col", F.col("number").alias("worked_out"))
        rows = rows.withColumn("sheet_row", F.col("row") + F.col("row_offset") if offset else F.col("row")).join(places, [*SHEET, "sheet_row", "col"], "left")
        rows = rows.withColumn("number", F.coalesce("number", "worked_out"))
    rows = rows.filter("number IS NOT NULL")
    rows = rows.select(*BLOCK, "gene_order", "row", clean_text("group").alias("Group"), clean_text("compound").alias("Compound ID"), F.col("gene").alias("Reference gene"), F.col("number").alias("Mean CT"))
    rows = cut(rows)
    return rows, _without(of_sheet, rows), of_sheet


def reference_qc(cells: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """n, mean and SEM of each (sheet, group, compound, gene), in order of first appearance (column `first`)."""
    wells = sample_cts(cells, numbers).repartition(*SHEET).withColumn("first", F.struct("block", "gene_order", "row"))
    return sample_stats(wells, [*SHEET, "Group", "Compound ID", "Reference gene"], order="first")
