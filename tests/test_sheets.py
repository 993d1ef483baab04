import zipfile

from pyspark.sql import functions as F

from helixframe.functions import textcells
from helixframe.operators import qpcr, series, sheets
from helixframe.sources import readers


def grid(spark, rows, sheet="s", formulas={}):  # noqa: B006
    cells = [("w", sheet, 0, r, c, v, formulas.get((r, c))) for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1)]
    return spark.createDataFrame(cells, readers.CELLS)


FULL = [
    ["Group", "Compound", "ACTB", "GAPDH", "MEAN RQ ± SEM", "n", None, "Geomean", None],
    ["", "ID", "CT", "Mean CT", "", "", None, "MEAN RQ", "SEM"],
    ["G1", "A1", "20", "18", "0.72 ± 0.13", "3", None, "0.7", "0.1"],
    [None, None, "21", "19", None, "3", None, "0.8", "0.2"],
    ["G2", "ntc", "21", "19", "1 ± 2", "3", None, "0.9", "0.3"],
    ["G3", "A 2", "21", "17", "0.5 +/-0.1", "3", None, "", ""],
]


def test_qpcr_summary(spark):
    rows, issues = qpcr.summarize(grid(spark, FULL))
    got = sorted((r["kind"], r["Group"], r["Compound ID"], r["Reference source"], r["MEAN RQ"], r["SEM"]) for r in rows.collect())
    assert got == [(0, "G1", "A1", "GAPDH", "0.72", "0.13"), (0, "G3", "A 2", "GAPDH", "0.5", "-0.1"), (1, "G1", "A1", "Geomean (GAPDH)", "0.7", "0.1")]
    assert issues.count() == 0
    qc = {(r["Group"], r["Compound ID"]): (r["Sample size (n)"], r["Mean CT"], round(r["SEM"], 6)) for r in qpcr.reference_qc(grid(spark, FULL)).collect()}
    assert qc == {("G1", "A1"): (2, 18.5, 0.5), ("G3", "A 2"): (1, 17.0, 0.0)}


def test_embedded_header(spark):
    rows = [["note", None, None, None], ["x", "", "", ""], ["Group", "Compound ID", "MEAN RQ", "SEM"], ["", "", "", ""], ["G1", "A", "1", "2"]]
    got, _ = qpcr.summarize(grid(spark, rows))
    assert [(r["Group"], r["MEAN RQ"], r["SEM"]) for r in got.collect()] == [("G1", "1", "2")]


def test_cells_are_never_stored(spark, monkeypatch):
    kept, real = [], qpcr.cut
    monkeypatch.setattr(qpcr, "cut", lambda df: kept.append(df.columns) or real(df))
    assert qpcr.summarize(grid(spark, FULL))[0].count() == 3 and qpcr.sample_cts(grid(spark, FULL)).count() == 3
    assert kept and not any("value" in columns for columns in kept)


def test_merges_trim_and_choice(spark):
    cells = grid(spark, [["a", "b", None], [None, "c", None], [None, None, None]])
    merges = spark.createDataFrame([("w", "s", 1, 1, 3, 1)], readers.MERGES)
    filled = {(r["row"], r["col"]): r["value"] for r in sheets.fill_merges(cells, merges).collect()}
    assert filled[3, 1] == filled[2, 1] == "a" and filled[2, 2] == "c"
    assert sheets.trim_edges(cells).count() == 4
    many = grid(spark, [["x"]], "PlotData-a").unionByName(grid(spark, [["x"]], "z").withColumn("sheet_index", F.lit(1)))
    assert sheets.result_sheets(sheets.sheet_catalogue(many), "plotdata-").first()["sheet"] == "PlotData-a"
    assert sheets.default_sheets(sheets.sheet_catalogue(many)).first()["sheet"] == "PlotData-a"


def test_formulas(spark):
    rows = [["1", "3", None], [None, None, None], [None, None, None]]
    f = {(1, 3): "=AVERAGE(A1,B1:B1)", (2, 1): "=C1", (2, 2): "=A1:B1", (2, 3): "=SUM(A1)", (3, 1): "=B3", (3, 2): "=A3", (3, 3): "='s'!A2"}
    got = {(r["row"], r["col"]): r["number"] for r in sheets.resolve_formulas(grid(spark, rows, formulas=f)).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 3.0, (1, 3): 2.0, (2, 1): 2.0, (3, 3): 2.0}


def test_titles_and_header(spark):
    cells = grid(spark, [["Study X", "Study X"], ["", ""], ["Group", "(Mean SEM)"], ["G1-a", "0.72 ± 0.13"], [None, None]])
    assert sheets.header_rows(cells).first()["header_row"] == 3 and sheets.titles(cells).first()["title"] == "Study X"
    table = sheets.as_table(cells, 3)
    assert table.columns == ["row", "Group", "(Mean SEM)"] and table.count() == 1
    (row,) = series.two_column(table, "Group", "(Mean SEM)").collect()
    assert (row["Outer group"], row["Condition"], row["Mean"], row["SEM"]) == ("G1", "a", 0.72, 0.13)


def test_wide_time_table(spark):
    df = spark.createDataFrame([(1, "2", "G1 AD12111", "1 ± 0", "0.7 ± 0.1", "0.6 +/- 0.04"), (2, "5", "G2", "1 +- 0", "", "0.5 ± 0.1")], ["row", "Dose (mpk)", "Group", "Time-baseline", "Time-D8", "Time-D29"])
    rows = series.unpivot_timepoints(df).collect()
    assert len(rows) == 5 and {r["Dose"] for r in rows} == {"2 mpk", "5 mpk"} and {r["Timepoint"] for r in rows} == {"baseline", "D8", "D29"}
    assert "G1 AD12111 | 2 mpk" in {r["Compound dose"] for r in rows}
    assert series.plot_table(df, None, None, "stem").filter("title = 'stem'").count() == 5


def test_text_functions(spark):
    df = spark.createDataFrame([("0.72 +/-0.13", "1,234.5", "G1 x"), ("1d", "nan", "a-"), (None, None, "one")], "a string, b string, c string")
    m, s = textcells.first_two_numbers("a")
    outer, rest = textcells.split_label("c")
    rows = df.select(m, s, textcells.parse_number("b"), outer, rest).collect()
    assert [tuple(r) for r in rows] == [(0.72, -0.13, 1234.5, "G1", "x"), (None, None, None, "a", "a-"), (None, None, None, "one", "one")]
    got = spark.createDataFrame([(0.72,), (93.63685,), (1234567.0,), (None,)], "x double").select(textcells.general_format("x")).collect()
    assert [r[0] for r in got] == ["0.72", "93.6368", "1.23457e+06", None]


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Gr</t><t>oup</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB2"><f>A1</f><v>2.5</v></c></row></sheetData><mergeCells><mergeCell ref="A1:A3"/></mergeCells></worksheet>')
    cells, merges = readers.read_workbooks(spark, str(tmp_path))
    assert {(r["row"], r["col"], r["value"], r["formula"]) for r in cells.collect()} == {(1, 1, "Group", None), (2, 28, "2.5", "=A1")}
    assert tuple(merges.first())[1:] == ("S", 1, 1, 3, 1)


def brute_formulas(values, formulas):
    """Cells by path, as a person would follow the references."""
    import re

    def cell(at, seen):
        if at in seen:
            return None
        if at in values:
            return values[at]
        f = formulas.get(at)
        if f is None:
            return None
        m = re.fullmatch(r"=AVERAGE\((.*)\)", f)
        refs = [(int(r), ord(c) - 64) for c, r in re.findall(r"([A-Z])(\d+)", m[1] if m else f)]
        got = [cell(x, seen | {at}) for x in refs]
        if not m:
            return got[0]
        got = [x for x in got if x is not None]
        return sum(got) / len(got) if got else None

    return {at: cell(at, frozenset()) for at in {**values, **formulas}}


def test_formula_depth_repeats_and_cycles(spark):
    import random

    chain = {(r, 1): f"=A{r - 1}" for r in range(2, 52)} | {(r, 2): f"=AVERAGE(A{r},A{r},B{r - 1})" for r in range(2, 6)}
    rng, cyclic = random.Random(3), {}
    for r in range(1, 7):
        for c in (3, 4):
            refs = [f"{rng.choice('CD')}{rng.randint(1, 6)}" for _ in range(rng.randint(1, 3))] + ["E1"]
            cyclic[(r, c)] = f"=AVERAGE({','.join(refs)})" if rng.random() < 0.7 else f"={refs[0]}"
    values = {(1, 1): 10.0, (1, 2): 4.0, (1, 5): 20.0}
    formulas = {**chain, **cyclic, (8, 1 + 25): "=AVERAGE(Z8,E1)"}
    cells = [("w", "My, sheet", 0, r, c, str(v), None) for (r, c), v in values.items()] + [("w", "My, sheet", 0, r, c, None, f) for (r, c), f in formulas.items()]
    cells += [("w", "t", 0, 1, 1, None, "='My, sheet'!A51"), ("w", "t", 0, 1, 2, None, "=AVERAGE('My, sheet'!A1,'My, sheet'!$E$1:$E$1)"), ("w", "t", 0, 1, 3, None, "=SUM(A1)"), ("w", "t", 0, 1, 4, None, "=AVERAGE(5,A1)")]
    got = {(r["sheet"], r["row"], r["col"]): round(r["number"], 9) for r in sheets.resolve_formulas(spark.createDataFrame(cells, readers.CELLS)).collect()}
    expected = {("My, sheet", *at): round(v, 9) for at, v in brute_formulas(values, formulas).items() if v is not None}
    assert got == expected | {("t", 1, 1): 10.0, ("t", 1, 2): 15.0}


def test_number_texts_before_deduplication(spark):
    rows = [["Group", "Compound", "MEAN RQ", "SEM"], ["", "ID", "", ""], ["G", "A", "0.720", "0.10"], ["G", "A", "0.72", "0.1"], ["G", "A", "1,000", "1"], ["G", "B", "1 ", "x"]]
    got, _ = qpcr.summarize(grid(spark, rows))
    assert sorted((r["Compound ID"], r["MEAN RQ"], r["SEM"]) for r in got.collect()) == [("A", "0.72", "0.1"), ("A", "1000", "1"), ("B", "1", "x")]


def test_mean_sem_with_odd_spaces(spark):
    df = spark.createDataFrame([(" 0.72 ± 0.13",), ("0.72 +- 1e-2\n",), ("0.72 0.13",)], "a string")
    m, s = textcells.mean_sem("a")
    assert [tuple(r) for r in df.select(m, s).collect()] == [(0.72, 0.13), (0.72, 0.01), (None, None)]


def test_reference_qc_under_embedded_header(spark):
    rows = [["note", None, None, None, None, None], [None] * 6, ["Group", "Compound ID", "ACTB", "GAPDH", "MEAN RQ", "SEM"], ["", "", "CT", "Mean CT", "", ""], ["G1", "A", "1", None, "1", "2"], [None, None, "1", "5", "1", "2"]]
    cells = grid(spark, rows, formulas={(5, 4): "=D6"})
    (row,) = qpcr.reference_qc(cells, sheets.resolve_formulas(cells)).collect()
    assert (row["Group"], row["Reference gene"], row["Sample size (n)"], row["Mean CT"]) == ("G1", "GAPDH", 2, 5.0)
    lacks = sheets.required_roles(sheets.role_columns(sheets.headers(sheets.blocks(cells))), {"group_col": "Group"})
    assert [r["issue"] for r in lacks.collect()] == ["Could not find the Group column."]


def test_timepoints_and_doses(spark):
    df = spark.createDataFrame([("Time-D8",), ("Time: D9",), ("time D10",), ("Time-",), ("Time",)], "h string")
    assert [r[0] for r in df.select(textcells.timepoint("h")).collect()] == ["D8", "D9", "D10", "Time-", "Time"]
    dose = spark.createDataFrame([("2",), ("2 MPK",), (None,)], "d string").select(textcells.format_dose("d", textcells.dose_unit(F.lit("Dose (mpk)"))))
    assert [r[0] for r in dose.collect()] == ["2 mpk", "2 MPK", " mpk"]
    assert series.is_wide_time_table(["Dose (mpk)", "Compound", "Time-D8"]) and not series.is_wide_time_table(["Group", "Time-D8"])


def by_paths(links):
    """Averages followed path by path, as a person would."""
    refs: dict = {}
    for cell, to, v, is_open in links:
        refs.setdefault(cell, []).append((to, v, is_open))

    def value(cell, above):
        got = [(None if to in above else value(to, above | {to})) if is_open and to in refs else v for to, v, is_open in refs[cell]]
        got = [x for x in got if x is not None]
        return sum(got) / len(got) if got else None

    return {c: value(c, frozenset([c])) for c in refs}


def test_open_values_against_paths():
    import random

    rng = random.Random(5)
    for n in range(1, 9):
        for _ in range(60):
            links = []
            for c in range(n):
                links += [((c,), ("k", i), rng.choice([None, float(rng.randint(1, 9))]), False) for i in range(rng.randint(0, 2))]
                links += [((c,), (t,), None, True) for t in (rng.choices(range(n), k=rng.choice([1, 1, 1, 2, 3])) if rng.random() < 0.8 else ()) if t != c]
            got, expected = sheets.open_values(links), by_paths(links)
            assert got.keys() == expected.keys()
            for c in got:
                assert (got[c] is None) == (expected[c] is None) and (got[c] is None or abs(got[c] - expected[c]) < 1e-9), (links, c)
    every = [((a,), (b,), None, True) for a in range(8) for b in range(8) if a != b] + [((a,), ("k",), float(a), False) for a in range(8)]
    assert all(abs(v - by_paths(every)[c]) < 1e-9 for c, v in sheets.open_values(every).items())
    long = [((i,), ((i + 1) % 5000,), None, True) for i in range(5000)] + [((7,), ("k",), 3.0, False)]
    assert set(sheets.open_values(long).values()) == {3.0}


def test_chain_of_averages_takes_few_rounds(spark, monkeypatch):
    rounds, real = [], sheets.cut
    monkeypatch.setattr(sheets, "cut", lambda df: (rounds.append(1), real(df))[1])
    n = 500
    cells = [("w", "s", 0, 1, 1, "4", None)] + [("w", "s", 0, r, 1, str(r % 7), None) for r in range(2, n + 1)] + [("w", "s", 0, 1, 2, None, "=AVERAGE(A1)")] + [("w", "s", 0, r, 2, None, f"=AVERAGE(A{r},B{r - 1})") for r in range(2, n + 1)]
    got = {r["row"]: r["number"] for r in sheets.resolve_formulas(spark.createDataFrame(cells, readers.CELLS)).filter("col = 2").collect()}
    expected = {1: 4.0}
    for r in range(2, n + 1):
        expected[r] = (r % 7 + expected[r - 1]) / 2
    assert got.keys() == expected.keys() and all(abs(got[r] - v) < 1e-9 for r, v in expected.items()) and len(rounds) < 20
    f = {(r, 1): f"=AVERAGE(A{r % 4 + 1},B1)" for r in range(1, 5)} | {(5, 1): "=AVERAGE(A1,A2)"}
    small = grid(spark, [[None, "6"]] + [[None, None]] * 4, formulas=f)
    both = []
    for local in (sheets.LOCAL, 0):  # one task, and path by path
        monkeypatch.setattr(sheets._on_cycles, "__defaults__", (local,))
        both.append({(r["row"], r["col"]): round(r["number"], 9) for r in sheets.resolve_formulas(small).collect()})
    assert both[0] == both[1] and len(both[0]) == 6


def test_shifted_formulas():
    f = readers.shifted
    assert f("A1+$A1+A$1+$A$1", 2, 3) == "D3+$A3+D$1+$A$1" and f('IF(B2="A1",LOG10(C3),Sheet1!D4)', 1, 1) == 'IF(C3="A1",LOG10(D4),Sheet1!E5)'
    assert f("SUM('A1 it''s'!A1:B2,AB1!C3,name.A1,A1x)", 1, 0) == "SUM('A1 it''s'!A2:B3,AB1!C4,name.A1,A1x)"
    assert f("SUM(A:B)+SUM($A:C)+SUM(2:3)+SUM($2:3)", 1, 1) == "SUM(B:C)+SUM($A:D)+SUM(3:4)+SUM($2:4)"
    assert f("A1", -1, 0) == "#REF!" and f("Z9", 0, 1) == "AA9" and f("average(b1:b3)", 0, 1) == "average(C1:C3)"


def book(path, sheets_xml, strings="", styles="", props=""):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="S{i}" r:id="rId{i}"/>' for i in range(len(sheets_xml)))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">{props}<sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(f'<Relationship Id="rId{i}" Target="/xl/worksheets/s{i}.xml"/>' for i in range(len(sheets_xml))) + "</Relationships>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{strings}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {ns}>{styles}</styleSheet>")
        for i, x in enumerate(sheets_xml):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}>{x}</worksheet>")


def test_shared_formulas_and_dates(spark, tmp_path):
    styles = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.00&quot; days&quot;"/><numFmt numFmtId="166" formatCode="[h]:mm:ss"/><numFmt numFmtId="167" formatCode="[Red]#,##0"/></numFmts>'
    styles += "<cellXfs>" + "".join(f'<xf numFmtId="{n}"/>' for n in (0, 14, 164, 165, 166, 21, 167, 46)) + "</cellXfs>"
    strings = "<si><t>漢字</t><rPh sb='0' eb='2'><t>かんじ</t></rPh></si><si><r><t>two </t></r><r><t>runs</t></r></si>"
    one = '<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" s="1"><v>45296</v></c><c r="D1" s="2"><v>45296.75</v></c><c r="E1" s="3"><v>45296</v></c><c r="F1" s="4"><v>1.5</v></c><c r="G1" s="5"><v>0.5</v></c><c r="H1" s="6"><v>7</v></c><c r="I1" t="d"><v>2024-01-05T10:00:00</v></c><c r="J1" s="1"><v>59</v></c></row>'
    one += '<row r="2"><c r="A2"><v>1</v></c><c r="B2"><f t="shared" ref="B2:B4" si="0">AVERAGE(A2,$A$2)</f></c></row><row r="3"><c r="A3"><v>3</v></c><c r="B3"><f t="shared" si="0"/></c></row><row r="4"><c r="A4"><v>5</v></c><c r="B4"><f t="shared" si="0"/><v>9</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells>'
    book(tmp_path / "b.xlsx", [one, '<sheetData><row r="1"><c r="A1"><v>2</v></c></row></sheetData>'], strings, styles)
    book(tmp_path / "m.xlsm", ['<sheetData><row r="1"><c r="A1" s="1"><v>1</v></c></row></sheetData>'], "", styles, '<workbookPr date1904="1"/>')
    cells, merges = readers.read_workbooks(spark, str(tmp_path))
    got = {(r["workbook"].rsplit("/", 1)[-1], r["sheet"], r["row"], r["col"]): (r["value"], r["formula"]) for r in cells.collect()}
    first = {c: got["b.xlsx", "S0", 1, c][0] for c in range(1, 11)}
    assert first == {1: "漢字", 2: "two runs", 3: "2024-01-05 00:00:00", 4: "2024-01-05 18:00:00", 5: "45296", 6: "1 day, 12:00:00", 7: "12:00:00", 8: "7", 9: "2024-01-05 10:00:00", 10: "1900-02-28 00:00:00"}
    assert [got["b.xlsx", "S0", r, 2] for r in (2, 3, 4)] == [(None, "=AVERAGE(A2,$A$2)"), (None, "=AVERAGE(A3,$A$2)"), ("9", "=AVERAGE(A4,$A$2)")]
    assert got["m.xlsm", "S0", 1, 1] == ("1904-01-02 00:00:00", None) and got["b.xlsx", "S1", 1, 1] == ("2", None) and merges.count() == 1
    numbers = {(r["row"], r["col"]): r["number"] for r in sheets.resolve_formulas(cells.filter("sheet = 'S0' AND workbook LIKE '%b.xlsx'")).collect()}
    assert (numbers[2, 2], numbers[3, 2], numbers[4, 2]) == (1.0, 2.0, 9.0)


def test_a_million_cells_in_bounded_memory():
    import tracemalloc
    import zlib

    press = zlib.compressobj(1, zlib.DEFLATED, -15)
    raw = [press.compress(b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')]
    for r in range(1, 10_001):
        raw.append(press.compress(("<row>" + "".join(f'<c r="{readers.column_letters(c)}{r}"><v>{r}.{c}</v></c>' for c in range(1, 101)) + "</row>").encode()))
    raw = b"".join([*raw, press.compress(b"</sheetData></worksheet>"), press.flush()])
    tracemalloc.start()
    n = sum(1 for _ in readers.sheet_cells("w", "s", 0, raw, None, None, False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1_000_000 and peak < 5_000_000


def test_header_search_ends_at_row_20(spark):
    head = ["Group", "(Mean SEM)"]
    for blank, expected in ((19, 20), (20, 1)):
        cells = grid(spark, [["note", ""]] * blank + [head, ["G1-a", "1 ± 2"]])
        assert sheets.header_rows(cells).first()["header_row"] == expected


def test_reference_charts_of_each_sheet(spark):
    qc = spark.createDataFrame([("w", s, g, c, gene, m, 1.0, i) for s, rows in {"a": [("G2", "x", "ACTB", 10.0), ("G1", "x", "ACTB", 12.0), ("G2", "x", "GAPDH", 20.0)], "b": [("G1", "x", "GAPDH", 5.0)]}.items() for i, (g, c, gene, m) in enumerate(rows)], "workbook string, sheet string, Group string, `Compound ID` string, `Reference gene` string, `Mean CT` double, SEM double, first int")
    got = {(r["sheet"], r["label"], r["Reference gene"]): (r["x_index"], r["series_index"], round(r["position"], 6), r["low"], r["high"]) for r in series.reference_charts(qc).collect()}
    assert got == {("a", "G2 | x", "ACTB"): (0, 0, -0.09, 8.5, 21.5), ("a", "G1 | x", "ACTB"): (1, 0, 0.91, 8.5, 21.5), ("a", "G2 | x", "GAPDH"): (0, 1, 0.09, 8.5, 21.5), ("b", "G1 | x", "GAPDH"): (0, 0, 0.0, 3.5, 6.5)}
    one = series.reference_series(qc.filter("sheet = 'a'")).collect()
    assert {(r["label"], r["Reference gene"], round(r["position"], 6)) for r in one} == {(k[1], k[2], v[2]) for k, v in got.items() if k[0] == "a"}


def test_number_of_series_is_bounded(spark):
    import pytest

    many = spark.range(series.MOST_SERIES + 1).selectExpr("'a' AS label", "cast(id AS string) AS s", "id AS o", "1.0 AS m", "0.0 AS e")
    with pytest.raises(ValueError):
        series.combined_series(many, "label", "s", "o", "m", "e")
    grid_ = series.combined_series(many.filter("o < 3").union(many.filter("o = 1").selectExpr("'b'", "s", "o + 10", "m", "e")), "label", "s", "o", "m", "e").collect()
    assert len(grid_) == 6 and sum(r["m"] for r in grid_) == 4.0


def shuffles(df):
    """Exchanges in the plan of a table that nothing has run yet."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def packed(cells):
    return cells.groupBy("workbook", "sheet", "sheet_index", "row").agg(F.collect_list(F.struct("col", "value", "formula")).alias("cells"))


def test_reports_row_by_row(spark):
    more = [[" Groups ", "Compound", "", "MEAN RQ", "SEM"], ["", "", "", "", ""], ["g", "NTC", "", "1", "2"], ["note", " ", None, None, None], ["Group", "Compound ID", "MEAN RQ", "SEM", ""], ["", "", "", "", ""], ["G9", "A", "1e-7", "0.12345675", ""]]
    cells = grid(spark, FULL).unionByName(grid(spark, more, "t"))
    found = [sorted(map(str, qpcr.summarize(c)[0].drop("sheet_index").collect())) for c in (cells, packed(cells))]
    assert found[0] == found[1] and len(found[0]) == 4 and any("'1e-07'" in r or "1e-07" in r for r in found[0])
    qc = [sorted(map(str, qpcr.reference_qc(c).collect())) for c in (cells, packed(cells))]
    assert qc[0] == qc[1] and len(qc[0]) == 2
    heads = [sorted(map(str, sheets.layout(c).collect())) for c in (cells, packed(cells))]
    old = sheets.headers(sheets.blocks(cells))
    assert heads[0] == heads[1] == sorted(map(str, old.select("workbook", "sheet", F.col("block").cast("long"), "col", "top", "under", "header").collect()))


def test_reports_are_dealt_once(spark, tmp_path):
    """A look at the columns shuffles line items alone, and the same ones for both of its sides."""
    from helixframe.plans import registry

    li = spark.createDataFrame([(i // 4, i, i, i % 4, 1.0 * i, 2.0, "R") for i in range(40)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string")
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert shuffles(registry._reports(spark, str(tmp_path))) == 1 and shuffles(sheets.layout(registry._reports(spark, str(tmp_path)))) <= 2


def test_texts_and_titles_of_rows(spark):
    """Rows that come whole are read where they lie."""
    plain = grid(spark, [["the", " x ", None], ["", "The", "y"], ["Group", "Time-1", "z"], ["b", "", ""]]).unionByName(grid(spark, [[""]] * 22 + [["Group", "dose"]], "late"))
    rows = packed(plain)
    assert shuffles(sheets.row_texts(spark.createDataFrame(rows.collect(), rows.schema), "the")) == 0 and shuffles(sheets.titled(spark.createDataFrame(rows.collect(), rows.schema))) == 1
    for c in (plain, rows):
        got = {(r["sheet"], r["row"]): (r["text"], r["has_cell"]) for r in sheets.row_texts(c, "the").collect()}
        assert len(got) == 27 and (got["s", 1], got["s", 2], got["s", 4], got["late", 3]) == (("the x", True), ("The y", True), ("b", False), ("", False))
        assert sorted((r["sheet"], r["header_row"], r["title"]) for r in sheets.titled(c).collect()) == [("late", 1, None), ("s", 3, "The y")]


def test_formulas_of_a_closed_sheet_are_worked_out_in_one_look(spark, monkeypatch):
    """Sheets that name no other are written once, whatever their chains; the others give the same by joins."""
    import random

    stored, real = [], sheets.cut
    monkeypatch.setattr(sheets, "cut", lambda df: (stored.append(1), real(df))[1])
    rng, cells, expected = random.Random(7), [], {}
    for book in range(12):
        values = {(r, c): float(rng.randint(1, 9)) for r in range(1, 9) for c in (1, 2) if rng.random() < 0.6}
        refs = lambda n: [f"{rng.choice('ABCD')}{rng.randint(1, 9)}" for _ in range(n)]
        made = {(r, c): f"=AVERAGE({','.join(refs(rng.randint(1, 2)))})" if rng.random() < 0.6 else f"={refs(1)[0]}" for r in range(1, 9) for c in (3, 4)}
        made |= {(r, 5): f"=AVERAGE(A1:B{r},$A$1:A1,B9:A1)" for r in range(1, 9)}
        plain = made | {(r, 5): "=AVERAGE(" + ",".join([f"{c}{i}" for i in range(1, r + 1) for c in "AB"] + ["A1"]) + ")" for r in range(1, 9)}
        cells += [(f"w{book}", "s", 0, r, c, str(v), None) for (r, c), v in values.items()] + [(f"w{book}", "s", 0, r, c, None, f) for (r, c), f in made.items()]
        expected |= {(f"w{book}", "s", *at): round(v, 9) for at, v in brute_formulas(values, plain).items() if v is not None}
    across = [("w0", "t", 0, 1, 1, None, "=s!E1"), ("w0", "t", 0, 2, 1, None, "=AVERAGE(s!A1:B8,A1,A3)"), ("w0", "t", 0, 3, 1, "5", None), ("w0", "t", 0, 4, 1, None, "=AVERAGE(A4)")]
    one, both = spark.createDataFrame(cells, readers.CELLS), spark.createDataFrame(cells + across, readers.CELLS)
    got = lambda df: {(r["workbook"], r["sheet"], r["row"], r["col"]): round(r["number"], 9) for r in df.collect()}
    assert got(sheets.resolve_formulas(one)) == expected and len(stored) == 2
    values = [v for k, v in expected.items() if k[0] == "w0" and k[3] <= 2]
    e1 = expected.get(("w0", "s", 1, 5))
    mean = [*values, 5.0] + ([] if e1 is None else [e1])
    more = {("w0", "t", 2, 1): round(sum(mean) / len(mean), 9), ("w0", "t", 3, 1): 5.0} | ({} if e1 is None else {("w0", "t", 1, 1): e1})
    for local in (None, 30, 0):  # all sheets, none of these, and none at all where they lie
        assert got(sheets.resolve_formulas(both, local)) == expected | more
    cached = {(b, s, r, c) for b, s, _, r, c, v, _ in cells + across if v is not None}
    assert got(sheets.resolve_formulas(both, cached=False)) == {k: v for k, v in (expected | more).items() if k not in cached}


def test_headers_are_read_once_a_kind(spark):
    """Sheets that look alike are one kind; columns far to the right count as others do."""
    rows = [["Group", "Compound ID", "MEAN RQ", "SEM"], ["", "", "", ""], ["g", "a", "1", "2"]]
    same = [("w", f"s{i}", 0, r, c, str(i) if r == 3 else v, None) for i in range(30) for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1)]
    far = [("w", "far", 0, r, c, f"{c} {r}", None) for c in (1, 2, 62, 63, 64, 65, 127, 128, 255, 256, 257, 300, 301, 9000) for r in (1, 4)] + [("w", "far", 0, 2, 300, "  ", None), ("w", "far", 0, 2, 400, " ", None), ("w", "none", 0, 1, 1, "", None)]
    cells = spark.createDataFrame(same + far, readers.CELLS)
    of_sheet, heads = sheets.kinds(cells)
    assert of_sheet.count() == 31 and of_sheet.select("kind").distinct().count() == 2 and heads.count() == 4 + 14
    assert {r["sheet"]: r["header_row"] for r in of_sheet.collect()} == {f"s{i}": 1 for i in range(30)} | {"far": None}
    old = sheets.headers(sheets.blocks(cells)).select("workbook", "sheet", F.col("block").cast("long").alias("block"), "col", "top", "under", "header")
    assert sorted(map(str, sheets.layout(cells).collect())) == sorted(map(str, old.collect()))
    got, _ = qpcr.summarize(cells)
    assert sorted((r["sheet"], r["Group"], r["MEAN RQ"]) for r in got.collect()) == sorted((f"s{i}", str(i), str(i)) for i in range(30))


def test_short_texts_are_those_of_the_slow_way(spark):
    texts = ["0", "7", "12.50", "1,036.250", "1,2,3", "1234567", "999,999", "999,999.5", "0.1", "0.0001", "0.00012", "0.00009", "0.000100", "0.1234567", "0.12345675", "100", "1000000", "007", "-3.0", "+2", "1e3", ".5", "5.", "12.000", "x", "", None, " 4 ", "4\n", "1,234", "12,34", "0.0", "123.4560", "123.45678"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", textcells.short_text("t").alias("a"), textcells.general_format(textcells.parse_number("t")).alias("b")).collect()
    assert [(r["t"], r["a"]) for r in got] == [(r["t"], r["b"]) for r in got] and got[3]["a"] == "1036.25"
    plan = df.select(textcells.is_blank("t").alias("x")).collect()
    assert [r["x"] for r in plan] == [t is None or not t.strip() for t in texts]


def test_charts_are_dealt_by_sheet_once(spark):
    qc = spark.createDataFrame([("w", "a", "G", c, g, 1.0 * i, 0.5, i) for i, (c, g) in enumerate([("x", "A"), ("y", "B"), ("x", "B"), ("y", "A"), ("x", "A")])], "workbook string, sheet string, Group string, `Compound ID` string, `Reference gene` string, `Mean CT` double, SEM double, first int")
    charts = series.reference_charts(qc.repartition("workbook", "sheet"))
    assert shuffles(charts) == 1
    got = {(r["label"], r["Reference gene"]): (r["x_index"], r["series_index"], r["Mean CT"]) for r in charts.collect()}
    assert got == {("G | x", "A"): (0, 0, 4.0), ("G | x", "B"): (0, 1, 2.0), ("G | y", "A"): (1, 0, 3.0), ("G | y", "B"): (1, 1, 1.0)}


def test_only_worked_out_numbers_meet_the_rows(spark, tmp_path, monkeypatch):
    """embedded_refqc gives its cells row by row and gets formulas' numbers alone."""
    from helixframe.plans import registry

    li = spark.createDataFrame([(i // 4, i, i, i % 4, 1.0 * i, 2.0, "R") for i in range(40)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string")
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    given, real = [], sheets.resolve_formulas
    monkeypatch.setattr(sheets, "resolve_formulas", lambda cells, *a, **k: given.append((cells.columns, got := real(cells, *a, **k))) or got)
    rows = registry.embedded_refqc(spark, str(tmp_path)).collect()
    (columns, numbers), = given
    assert "cells" in columns and numbers.count() == 40 and {r["col"] for r in numbers.collect()} == {4}
    assert len(rows) == 40 and {(r["n"], r["mean_ct"]) for r in rows} == {(1, (i + i % 9 + 1) / 2) for i in range(40)}


def test_numbers_are_sent_to_python_only_to_be_rounded(spark, monkeypatch):
    """Texts that need no rounding, and those that do, are one row where they come to the same."""
    formatted, real = [], qpcr.general_format
    monkeypatch.setattr(qpcr, "general_format", lambda x: formatted.append(1) or real(x))
    head = [["Group", "Compound", "MEAN RQ", "SEM"], ["", "ID", "", ""]]
    plain, _ = qpcr.summarize(grid(spark, head + [["G", "A", "0.720", "0.10"], ["G", "A", "0.72", "0.1"], ["G", "B", "note ", "1,000"]]))
    assert sorted((r["Compound ID"], r["MEAN RQ"], r["SEM"], r["row"]) for r in plain.collect()) == [("A", "0.72", "0.1", 3), ("B", "note", "1000", 5)] and not formatted
    both, _ = qpcr.summarize(grid(spark, head + [["G", "A", "7.2e-1", "+0.1"], ["G", "A", "0.72", "0.1"], ["G", "A", "0.7200001", "0.10"], ["G", "B", "1234567", "x"]]))
    assert sorted((r["Compound ID"], r["MEAN RQ"], r["SEM"], r["row"]) for r in both.collect()) == [("A", "0.72", "0.1", 3), ("B", "1.23457e+06", "x", 6)] and formatted
