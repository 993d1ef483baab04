"""Plot-ready series: parsed tables, unpivoted timepoints, dense and sparse grids, axis bounds."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.textcells import clean_text, dose_unit, format_dose, is_blank, mean_sem, mean_sem_error, plot_label, safe_filename, split_label, timepoint
from helixframe.operators.lineage import numbered

PALETTE = 6
MOST_SERIES = 1000


def ordered_distinct(df: DataFrame, value: str, order: str, index: str = "idx") -> DataFrame:
    """(value, idx): distinct values by first appearance, from 0, numbered range by range."""
    firsts = df.groupBy(value).agg(F.min(order).alias("__o"))
    return numbered(firsts, ["__o"], index).select(value, (F.col(index) - 1).alias(index))


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row, by order, of each key."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("__r")).select(*keys, "__r.*")


def axis_bounds(df: DataFrame, mean: str = "Mean", sem: str = "SEM", margin: float = 0.5) -> DataFrame:
    return df.agg((F.min(F.col(mean) - F.col(sem)) - margin).alias("low"), (F.max(F.col(mean) + F.col(sem)) + margin).alias("high"))


def two_column(df: DataFrame, group: str, value: str, delimiter: str = "-", strict: bool = False) -> DataFrame:
    """Group, Outer group, Condition, Mean, SEM; blanks drop out, other text is an error column (strict: fails the run)."""
    rows = df.filter(~is_blank(group) & ~is_blank(value))
    outer, condition = split_label(group, delimiter)
    mean, sem = mean_sem(value)
    error = mean_sem_error(value)
    kept = [F.col(c) for c in df.columns if c not in (group, value)]
    out = rows.select(*kept, clean_text(group).alias("Group"), outer.alias("Outer group"), condition.alias("Condition"), mean.alias("Mean"), sem.alias("SEM"), error.alias("error"))
    return out.withColumn("Mean", F.when(F.col("error").isNotNull(), F.raise_error("error").cast("double")).otherwise(F.col("Mean"))) if strict else out


#: What a header of each role of a wide table begins with, holds, or is.
ROLES = {"dose": r"dose.*", "compound": r"group|.*compound.*", "time": r"time.*"}


def columns_by_role(columns: list[str]) -> dict[str, list[str]]:
    """The columns of each role, in table order."""
    plain = {c: " ".join(str(c).split()).lower() for c in columns}
    return {role: [c for c in columns if re.fullmatch(pattern, plain[c])] for role, pattern in ROLES.items()}


def is_wide_time_table(columns: list[str]) -> bool:
    return all(columns_by_role(columns).values())


def unpivot_timepoints(df: DataFrame, dose: str | None = None, compound: str | None = None) -> DataFrame:
    """Compound, Dose, Timepoint, Compound dose, Mean, SEM and error; one row for each cell with text.

    Columns that are neither dose, compound nor time are carried (order columns).
    """
    found = columns_by_role(df.columns)
    found |= {role: [given] for role, given in (("dose", dose), ("compound", compound)) if given is not None}
    missing = [role for role, names in found.items() if not names or names[0] not in df.columns]
    if missing:
        raise ValueError(f"No column for: {', '.join(missing)}. Columns: {', '.join(df.columns)}")
    dose, compound, times = found["dose"][0], found["compound"][0], found["time"]
    kept = [c for c in df.columns if c not in (dose, compound, *times)]
    rows = df.select(*kept, clean_text(compound).alias("Compound"), format_dose(dose, dose_unit(F.lit(dose))).alias("Dose"), *[clean_text(t).alias(t) for t in times])
    rows = rows.filter("Compound <> '' AND Dose <> ''")
    long = rows.unpivot([*kept, "Compound", "Dose"], times, "time_column", "raw").filter("raw <> ''")
    mean, sem = mean_sem("raw")
    order = F.array_position(F.array(*map(F.lit, times)), F.col("time_column")).alias("time_order")
    return long.select(*kept, "Compound", "Dose", timepoint("time_column").alias("Timepoint"), F.concat_ws(" | ", "Compound", "Dose").alias("Compound dose"), mean.alias("Mean"), sem.alias("SEM"), mean_sem_error("raw").alias("error"), order)


def split_series(summary: DataFrame, source: str, label: str, order: str) -> DataFrame:
    """One series a source, x by row order."""
    x = F.row_number().over(Window.partitionBy(source).orderBy(order)) - 1
    return summary.withColumn("x", x).withColumn("label", F.col(label))


def combined_series(summary: DataFrame, label: str, series: str, order: str, mean: str, sem: str) -> DataFrame:
    """Dense grid of labels and series; missing values are 0, the last row of a pair counts.

    Every label carries all series, at most MOST_SERIES of them (more is an
    error: no chart shows them), and opens them in place.
    """
    labels, kinds = ordered_distinct(summary, label, order, "x"), ordered_distinct(summary, series, order, "series_index")
    data = last_wins(summary.select(label, series, order, mean, sem), [label, series], order)
    if kinds.limit(MOST_SERIES + 1).count() > MOST_SERIES:
        raise ValueError(f"more than {MOST_SERIES} series")
    all_kinds = F.broadcast(kinds.agg(F.collect_list(F.struct(series, "series_index")).alias("__kinds")))
    grid = labels.join(all_kinds).select(label, "x", F.inline("__kinds")).join(data, [label, series], "left")
    return grid.select(label, series, "x", "series_index", F.coalesce(mean, F.lit(0.0)).alias(mean), F.coalesce(sem, F.lit(0.0)).alias(sem), F.pmod("series_index", F.lit(PALETTE)).alias("palette"))


def grouped_series(df: DataFrame, x: str, series: str, order: str, most_width: float = 0.2, share: float = 0.82) -> DataFrame:
    """Present pairs only, each with its bar position: x index + offset of its series."""
    xs, kinds = ordered_distinct(df, x, order, "x"), ordered_distinct(df, series, order, "series_index")
    n = kinds.agg(F.count("*").alias("n"))
    data = last_wins(df.select(x, series, order, "Mean", "SEM"), [x, series], order)
    rows = data.join(xs, x).join(kinds, series).crossJoin(F.broadcast(n)).withColumn("width", F.least(F.lit(most_width), F.lit(share) / F.col("n")))
    at = F.col("x") + (F.col("series_index") - (F.col("n") - 1) / 2.0) * F.col("width")
    return rows.select(x, series, F.col("x").alias("x_index"), "series_index", at.alias("position"), "width", "Mean", "SEM", F.pmod("series_index", F.lit(PALETTE)).alias("palette"))


def chart_set(long: DataFrame, order: str, mode: str = "all") -> DataFrame:
    """Rows of each chart: all variables, one a compound, one a dose (mode: all, compound, dose, or every)."""
    every = long.withColumn("chart_id", F.lit("all"))
    compound = long.withColumn("chart_id", F.concat(F.lit("compound:"), F.col("Compound")))
    dose = long.withColumn("chart_id", F.concat(F.lit("dose:"), F.col("Dose")))
    picked = {"all": [every], "compound": [compound], "dose": [dose], "every": [every, compound, dose]}[mode]
    out = picked[0]
    for other in picked[1:]:
        out = out.unionByName(other)
    return out


def plot_table(df: DataFrame, title: str | None, detected: str | None, stem: str, legacy: bool = False, order: str = "row") -> DataFrame:
    """The table a chart is drawn from: wide time tables unless legacy; title as given, else detected, else the file's stem."""
    name = F.lit(title or detected or stem)
    if not legacy and is_wide_time_table(df.columns):
        return grouped_series(unpivot_timepoints(df).withColumn("__o", F.struct(order, "time_order")), "Timepoint", "Compound dose", "__o").withColumn("title", name)
    cols = [c for c in df.columns if c != order]
    rows = two_column(df, cols[0], cols[1])
    return grouped_series(rows, "Outer group", "Condition", order, 0.22, 0.8).withColumn("title", name)


def reference_series(qc: DataFrame, order: str = "first", most_width: float = 0.18, share: float = 0.8) -> DataFrame:
    """Points of the reference-gene chart: labels by first appearance, a series a gene, absent pairs absent, with the axis bounds of all points.

    qc: workbook, sheet and the columns of reference_qc(), of one sheet.
    """
    rows = qc.withColumns({"label": plot_label("Group", "Compound ID"), "Mean": F.col("Mean CT")})
    points = grouped_series(rows, "label", "Reference gene", order, most_width, share)
    return points.crossJoin(F.broadcast(axis_bounds(points)))


def reference_charts(qc: DataFrame, keys: tuple[str, ...] = ("workbook", "sheet"), order: str = "first", most_width: float = 0.18, share: float = 0.8) -> DataFrame:
    """reference_series() of every sheet at once: its keys, chart_id, label, Reference gene, x_index, series_index, position, Mean CT, SEM, low, high, palette.

    Labels and genes are numbered sheet by sheet, axis bounds are the sheet's.
    """
    rows = qc.withColumn("label", plot_label("Group", "Compound ID"))
    pairs = rows.groupBy(*keys, "label", "Reference gene").agg(F.max_by(F.struct("Mean CT", "SEM"), order).alias("__last"), F.min(order).alias("__o"))
    # Windows of a sheet, so that all of it is dealt by sheet and once.
    first = lambda value: F.min("__o").over(Window.partitionBy(*keys, value))
    place = lambda at, value: F.dense_rank().over(Window.partitionBy(*keys).orderBy(at, value)) - 1
    points = pairs.select(*keys, "label", "Reference gene", "__last.*", first("label").alias("__x"), first("Reference gene").alias("__s"))
    points = points.withColumns({"x_index": place("__x", "label"), "series_index": place("__s", "Reference gene")})
    points = points.withColumn("n", F.max("series_index").over(Window.partitionBy(*keys)) + 1)
    width, whole = F.least(F.lit(most_width), F.lit(share) / F.col("n")), Window.partitionBy(*keys)
    return points.select(
        *keys, F.lit("reference_gene_mean_ct_qc").alias("chart_id"), "label", "Reference gene", "x_index", "series_index", (F.col("x_index") + (F.col("series_index") - (F.col("n") - 1) / 2.0) * width).alias("position"), "Mean CT", "SEM",
        (F.min(F.col("Mean CT") - F.col("SEM")).over(whole) - 0.5).alias("low"), (F.max(F.col("Mean CT") + F.col("SEM")).over(whole) + 0.5).alias("high"), F.pmod("series_index", F.lit(PALETTE)).alias("palette"),
    )


def summary_plots(summary: DataFrame, order: str, mode: str = "both") -> DataFrame:
    """Tables of the summary charts, a chart_id each: `split` one series a source, `combined` the dense grid, or both.

    summary: label, Reference source, MEAN RQ, SEM (numbers) and an order.
    """
    cols = ["chart_id", "label", "Reference source", "x", "series_index", "MEAN RQ", "SEM"]
    split = split_series(summary, "Reference source", "label", order).withColumn("chart_id", F.concat(F.lit("split:"), safe_filename("Reference source")))
    both = combined_series(summary, "label", "Reference source", order, "MEAN RQ", "SEM").withColumn("chart_id", F.lit("combined"))
    charts = {"split": [split.withColumn("series_index", F.lit(0)).select(*cols)], "combined": [both.select(*cols)]}
    picked = charts["split"] + charts["combined"] if mode == "both" else charts[mode]
    return reduce(DataFrame.unionByName, picked)
